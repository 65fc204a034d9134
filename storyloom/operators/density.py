"""Density clusters: the hierarchy of HDBSCAN over the exact minimum spanning tree of mutual reachability.

1. Copies of a vector are one node with a count; core distances count them.
2. The tree grows by rounds (Borůvka). Lists of near neighbours offer each component an edge, which is proven to be its
   lightest where no point could see a lighter one beyond its list. The points that could search further, only in cells
   that hold other components and lie near enough; a component whose lists hold no edge that leaves it gets its bound
   from one such search for one of its points.
3. Edges are folded from the lightest on, in batches of bounded size, inside the components that a batch forms. A
   component carries its size, the sum of size / distance of what has left it, and the worth of its parts, which is all
   that stability needs. Clusters are rows as soon as they are part of a larger one.
4. The parts win against a cluster whose stability is less than their worth; pointer jumping finds for each point the
   largest cluster above it that won.

Edges of equal weight join at once. The cluster of all points is never chosen. Without `min_cluster_size` points, or
where all is one cluster, there are only outliers.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.graph import SMALL_GRAPH, connected_components
from storyloom.operators.spanning import best_edges, ordered
from storyloom.operators.vectors import SLACK, SLICE, _Index, _matrix, distance, nearest_neighbors
from storyloom.session import cut_lineage

FLOOR = 1e-6  # distances below this count as equal, so that 1 / distance stays finite
NEAR = 15  # length of the lists that offer edges first
VISITING = 64  # points whose visits to cells are listed at once
BATCH_EDGES = 200_000  # edges that a fold takes at a time

STATE = "node long, size long, leave double, parts double, key_w double, key_low long, points array<long>"
FOLDED = f"kind string, id long, up_w double, up_low long, wins boolean, {STATE}"


# --- the tree ----------------------------------------------------------------------------------
def _cores(lists: DataFrame, copies: DataFrame, min_samples: int) -> DataFrame:
    """(id, core, n): distance to the (min_samples - 1)-th other point, copies counted; the farthest one if there are fewer."""
    wanted = max(1, min_samples - 1)
    counted = lists.join(copies.select(F.col("id").alias("other"), F.col("n").alias("n_other")), "other")
    seen = F.sum("n_other").over(Window.partitionBy("seed").orderBy("rank"))
    reached = counted.withColumn("seen", seen).join(copies.select(F.col("id").alias("seed"), "n"), "seed")
    far = reached.groupBy("seed").agg(F.min(F.when(F.col("seen") + F.col("n") - 1 >= wanted, F.col("d"))).alias("near"), F.max("d").alias("far"))
    joined = copies.join(far.withColumnRenamed("seed", "id"), "id", "left")
    return joined.select("id", F.when(F.col("n") > wanted, FLOOR).otherwise(F.coalesce("near", "far", F.lit(FLOOR))).alias("core"), "n")


def _extent(index: _Index, labels: DataFrame) -> list:
    """(cell, low, high): the smallest and the largest component of every cell; at most COARSE rows."""
    placed = index.data.select(F.col("rep").alias("id"), "cell").join(labels, "id")
    return placed.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).collect()


def _lightest_outside(index: _Index, asked: DataFrame, labels: DataFrame, extent: list) -> DataFrame:
    """(comp, a, b, weight): the lightest edges from the points (id, comp, core, radius) to other components within their radius.

    labels: id, comp, core. Cells that hold one component only are not searched for it.
    """
    pivots, radius = index.pivots, index.radius
    pure = np.full(len(radius), -1, dtype=np.int64)
    for r in extent:
        if r["low"] == r["high"]:
            pure[r["cell"]] = r["low"]
    mixed = pure == -1
    live = np.flatnonzero(np.isfinite(radius))

    def plan(batches):
        for batch in batches:
            for low in range(0, len(batch), VISITING):
                pdf = batch.iloc[low : low + VISITING]
                away = np.sqrt(np.maximum(0, 2 - 2 * (_matrix(pdf["v"]) @ pivots.value[live].T)))
                go = away - radius[live] <= pdf["radius"].to_numpy()[:, None] + SLACK
                go &= mixed[live] | (pure[live] != pdf["comp"].to_numpy()[:, None])
                which, cell = np.nonzero(go)
                yield pdf[["id", "v", "comp", "core", "radius"]].iloc[which].assign(cell=live[cell].astype("int32"))

    queries = asked.join(index.distinct.withColumnRenamed("rep", "id"), "id").select("id", "v", "comp", "core", "radius")
    visits = queries.mapInPandas(plan, "id long, v array<double>, comp long, core double, radius double, cell int")
    asked = cut_lineage(index.within(visits, "radius").select("id", "v", "comp", "core", "cell", "block"))
    placed = index.data.withColumnRenamed("rep", "id").join(labels, "id")
    left, right = index.met(asked, placed.select("id", "v", "comp", "core", "cell", "block"), "id")

    def lightest(queries: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(d):
            return pd.DataFrame({"comp": [], "a": [], "b": [], "weight": []})
        v = _matrix(d["v"])
        out = pd.concat([some(queries.iloc[low : low + SLICE].reset_index(drop=True), d, v) for low in range(0, len(queries), SLICE)])
        return out.sort_values(["weight", "a", "b"]).drop_duplicates("comp")

    def some(q: pd.DataFrame, d: pd.DataFrame, v: np.ndarray) -> pd.DataFrame:
        away = np.sqrt(np.maximum(0, 2 - 2 * (_matrix(q["v"]) @ v.T)))
        weight = np.maximum(np.maximum(away, FLOOR), np.maximum(q["core"].to_numpy()[:, None], d["core"].to_numpy()[None, :]))
        weight[q["comp"].to_numpy()[:, None] == d["comp"].to_numpy()[None, :]] = np.inf
        # the first of equal weights by (a, b), as everywhere
        own, other = np.broadcast_to(q["id"].to_numpy()[:, None], weight.shape), np.broadcast_to(d["id"].to_numpy()[None, :], weight.shape)
        at = np.lexsort((np.maximum(own, other), np.minimum(own, other), weight), axis=1)[:, 0]
        row = np.arange(len(q))
        out = pd.DataFrame({"comp": q["comp"], "a": np.minimum(own[row, at], other[row, at]), "b": np.maximum(own[row, at], other[row, at]), "weight": weight[row, at]})
        return out[np.isfinite(out["weight"])].sort_values(["weight", "a", "b"]).drop_duplicates("comp")

    key = ["cell", "block", "chunk"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lightest, "comp long, a long, b long, weight double")


def reachability_tree(index: _Index, min_samples: int = 2, near: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """(a, b, weight) of the minimum spanning tree over different vectors, and (id, core, n) of these with their copies."""
    nodes = index.distinct.select(F.col("rep").alias("id"), "v")
    copies = cut_lineage(index.members.groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    lists = cut_lineage(nearest_neighbors(nodes, max(near, min_samples), "id", "v").select("seed", "other", "rank", F.greatest(F.lit(FLOOR), distance(F.col("similarity"))).alias("d")))
    cores = cut_lineage(_cores(lists, copies, min_samples))
    core = cores.select("id", "core")
    ends = lists.join(core.toDF("seed", "core_s"), "seed").join(core.toDF("other", "core_o"), "other")
    weighed = [cut_lineage(ends.select("seed", "other", F.greatest("d", "core_s", "core_o").alias("weight")))]
    nothing = cores.select(F.col("id").alias("comp"), F.col("id").alias("a"), F.col("id").alias("b"), F.col("core").alias("weight")).limit(0)
    # what lies beyond the list of a point is at least as far as its last entry
    full = lists.groupBy("seed").agg(F.count(F.lit(1)).alias("k"), F.max("d").alias("last"))
    seen = max(near, min_samples)
    horizon = cut_lineage(full.where(F.col("k") >= seen).join(core.toDF("seed", "core"), "seed").select(F.col("seed").alias("id"), F.greatest("last", "core").alias("beyond")))

    def best(labels: DataFrame, done: int) -> DataFrame:
        known = labels.join(core, "id")
        extent = _extent(index, known)
        if len({c for r in extent for c in (r["low"], r["high"])}) <= 1:
            return nothing
        lightest = lambda rows: rows.groupBy("comp").agg(F.min(ordered()).alias("e")).select("comp", "e.a", "e.b", "e.weight")
        side = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"c_{c}"))
        crossing = cut_lineage(weighed[0].join(side("seed"), "seed").join(side("other"), "other").where("c_seed <> c_other"))
        weighed[0] = crossing.select("seed", "other", "weight")
        offered = crossing.select("weight", F.least("seed", "other").alias("a"), F.greatest("seed", "other").alias("b"), F.explode(F.array("c_seed", "c_other")).alias("comp"))
        found = cut_lineage(lightest(offered))
        points = known.join(horizon, "id").join(found.select("comp", "weight"), "comp", "left")
        one = F.row_number().over(Window.partitionBy("comp").orderBy("id"))
        blind = cut_lineage(points.where("weight IS NULL").withColumn("r", one).where("r = 1").select("id", "comp", "core", F.lit(math.inf).alias("radius")))
        if not blind.isEmpty():
            found = cut_lineage(found.unionByName(lightest(_lightest_outside(index, blind, known, extent))))
            points = known.join(horizon, "id").join(found.select("comp", "weight"), "comp")
        open_ = cut_lineage(points.where("beyond <= weight").select("id", "comp", "core", F.col("weight").alias("radius")))
        if open_.isEmpty():
            return found
        return lightest(found.unionByName(_lightest_outside(index, open_, known, extent)))

    return cut_lineage(best_edges(nodes, best).distinct()), cores


# --- the fold ----------------------------------------------------------------------------------
class _Part:
    """A component on its way up: open cluster (key) or fewer points than a cluster needs."""

    __slots__ = ("size", "leave", "parts", "key", "points")

    def __init__(self, size, leave, parts, key, points):
        self.size, self.leave, self.parts, self.key, self.points = size, leave, parts, key, points


def _joined(children: list[_Part], weight: float, low: int, least: int, out: list) -> _Part:
    """What components become that join at this distance; finished clusters and placed points go to `out`."""
    rate = 1.0 / weight
    size = sum(c.size for c in children)
    points = [p for c in children for p in c.points]
    open_ = [c for c in children if c.key is not None]
    if len(open_) == 1:
        kept = open_[0]
        part = _Part(size, kept.leave + rate * (size - kept.size), kept.parts, kept.key, [])
    elif not open_ and size < least:
        return _Part(size, 0.0, None, None, points)
    else:
        part = _Part(size, rate * size, None, (weight, low), [])
        if open_:
            part.parts = sum(_finished(c, rate, part.key, out) for c in open_)
    out.extend(("member", p, *part.key, None) for p in points)
    return part


def _finished(part: _Part, rate: float, above: tuple, out: list) -> float:
    """The worth of a cluster that becomes part of a larger one."""
    stability = part.leave - rate * part.size
    wins = part.parts is None or stability >= part.parts
    out.append(("cluster", None, *above, wins, part.key))
    return stability if wins else part.parts


def fold(edges: list[tuple], states: dict[int, _Part], least: int) -> tuple[int, _Part, list]:
    """One component of a batch: its name, its state after all edges, and the rows that are settled."""
    up = {n: n for n in states}
    rows: list = []

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for weight, same in groupby(sorted(edges), key=lambda e: e[0]):
        group = list(same)
        before = {find(n): None for _, a, b in group for n in (a, b)}
        for _, a, b in group:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        meet: dict[int, list[int]] = {}
        for root in before:
            meet.setdefault(find(root), []).append(root)
        for low, roots in meet.items():
            if len(roots) > 1:
                states[low] = _joined([states.pop(r) for r in sorted(roots)], weight, low, least, rows)
    (name, part), = states.items()
    return name, part, rows


def _state_row(node: int, p: _Part) -> tuple:
    return ("state", None, None, None, None, node, p.size, p.leave, p.parts, *(p.key or (None, None)), p.points)


def _fold_rows(least: int):
    names = [f.split()[0] for f in FOLDED.split(", ")]
    none = lambda x: None if x is None or x != x else x  # noqa: E731  pandas turns nulls to NaN

    def run(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        states = {
            int(r.node): _Part(int(r.size), r.leave, none(r.parts), None if none(r.key_w) is None else (r.key_w, int(r.key_low)), list(r.points))
            for r in nodes.itertuples(index=False)
        }
        name, part, settled = fold(list(zip(edges["weight"].tolist(), edges["x"].tolist(), edges["y"].tolist())), states, least)
        rows = [_state_row(name, part)]
        for kind, point, w, low, wins, *key in settled:
            rows.append((kind, point, w, low, wins, None, None, None, None, *(key[0] if key else (None, None)), None))
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("id", "up_low", "node", "size", "key_low")})

    return run


def _start(index: _Index, cores: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """States of the nodes, and (id, key_w, key_low) of copies that are a cluster by their number."""
    crowd = cores.where(F.col("n") >= least)
    few = index.members.join(cores.where(F.col("n") < least).select(F.col("id").alias("rep")), "rep").groupBy("rep").agg(F.collect_list("id").alias("points"))
    joined = cores.join(few.withColumnRenamed("rep", "id"), "id", "left")
    big = F.col("n") >= least
    states = joined.select(
        F.col("id").alias("node"), F.col("n").alias("size"), F.when(big, F.col("n") / F.col("core")).otherwise(0.0).alias("leave"), F.lit(None).cast("double").alias("parts"),
        F.when(big, 0.0).alias("key_w"), F.when(big, F.col("id")).alias("key_low"), F.coalesce("points", F.array().cast("array<long>")).alias("points"),
    )
    members = index.members.join(crowd.select(F.col("id").alias("rep")), "rep").select("id", F.lit(0.0).alias("up_w"), F.col("rep").alias("up_low"))
    return states, members


def hierarchy(tree: DataFrame, states: DataFrame, least: int, batch_edges: int = BATCH_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters (key_w, key_low, up_w, up_low, wins) and points (id, up_w, up_low) with the first cluster they are in."""
    n = tree.count()
    batches = max(1, -(-n // batch_edges))
    cuts = [-math.inf, math.inf]
    if batches > 1:
        cuts[1:1] = sorted(set(tree.agg(F.percentile_approx("weight", [i / batches for i in range(1, batches)], 100_000)).first()[0]))
    parts = []
    states = cut_lineage(states)
    place = states.select(F.col("node").alias("id"), "node")
    for low, high in zip(cuts, cuts[1:]):
        batch = tree.where((F.col("weight") > low) & (F.col("weight") <= high))
        side = lambda c, x: place.select(F.col("id").alias(c), F.col("node").alias(x))
        edges = cut_lineage(batch.join(side("a", "x"), "a").join(side("b", "y"), "b").select("weight", "x", "y"))
        comps = cut_lineage(connected_components(edges, "x", "y", alone=SMALL_GRAPH))
        named = edges.join(comps.select(F.col("id").alias("x"), F.col("component").alias("comp")), "x")
        touched = states.join(comps.select(F.col("id").alias("node"), F.col("component").alias("c")), "node")
        folded = cut_lineage(named.groupBy("comp").cogroup(touched.groupBy("c")).applyInPandas(_fold_rows(least), FOLDED))
        parts.append(folded.where("kind <> 'state'"))
        after = folded.where("kind = 'state'").select([f.split()[0] for f in STATE.split(", ")])
        states = cut_lineage(states.join(comps.select(F.col("id").alias("node")), "node", "left_anti").unionByName(after))
        place = cut_lineage(place.join(comps.select(F.col("id").alias("node"), "component"), "node", "left").select("id", F.coalesce("component", "node").alias("node")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    clusters = rows.where("kind = 'cluster'").select("key_w", "key_low", "up_w", "up_low", "wins")
    open_ = states.where("key_w IS NOT NULL")
    several = open_.limit(2).count() > 1  # only where the tree is a forest: its parts join at no distance
    top = open_.select("key_w", "key_low", F.lit(None).cast("double").alias("up_w"), F.lit(None).cast("long").alias("up_low"), (F.lit(several) & (F.col("parts").isNull() | (F.col("leave") >= F.col("parts")))).alias("wins"))
    return cut_lineage(clusters.unionByName(top)), rows.where("kind = 'member'").select("id", "up_w", "up_low")


def chosen(clusters: DataFrame) -> DataFrame:
    """(key_w, key_low, top): the largest cluster above each cluster (or itself) that won; by pointer jumping."""
    key = F.struct(F.col("key_w").alias("w"), F.col("key_low").alias("low"))
    up = F.when(F.col("up_w").isNotNull(), F.struct(F.col("up_w").alias("w"), F.col("up_low").alias("low")))
    at = cut_lineage(clusters.select(key.alias("key"), up.alias("up"), F.when(F.col("wins"), key).alias("top")))
    while not at.where("up IS NOT NULL").isEmpty():
        above = at.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("top").alias("higher"))
        at = cut_lineage(at.join(above, "up", "left").select("key", F.col("next").alias("up"), F.coalesce("higher", "top").alias("top")))
    return at.where("top IS NOT NULL").select("key", "top")


def density_clusters(
    vectors: DataFrame, min_cluster_size: int = 3, min_samples: int = 2, id_col: str = "id", vector_col: str = "embedding",
    near: int = NEAR, batch_edges: int = BATCH_EDGES,
) -> DataFrame:
    """(id, cluster) of clustered points, a cluster named by its smallest id; points in no row are outliers."""
    least = max(2, min_cluster_size)
    index = _Index(vectors, id_col, vector_col, 1)
    tree, cores = reachability_tree(index, min_samples, near)
    states, crowds = _start(index, cores, least)
    clusters, members = hierarchy(tree, states, least, batch_edges)
    top = chosen(clusters)
    placed = members.unionByName(crowds).select("id", F.struct(F.col("up_w").alias("w"), F.col("up_low").alias("low")).alias("key"))
    labelled = cut_lineage(placed.join(top, "key").select("id", "top"))
    names = labelled.groupBy("top").agg(F.min("id").alias("cluster"))
    return labelled.join(names, "top").select("id", "cluster")


def point_analysis(points: DataFrame, clusters: DataFrame, density: DataFrame, sources: DataFrame) -> DataFrame:
    """Per point: cluster, its size, outlier flag, local density and nearby sources."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    joined = points.select("id").join(clusters.join(sizes, "cluster"), "id", "left").join(density, "id", "left").join(sources, "id", "left")
    return joined.select(
        "id", "cluster", F.coalesce("cluster_size", F.lit(0)).alias("cluster_size"), F.col("cluster").isNull().alias("is_outlier"),
        F.coalesce("local_density", F.lit(0.0)).alias("local_density"), "nearby_sources", "diversity",
    )

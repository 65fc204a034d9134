"""Connected components on edge tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.session import cut_lineage


#: Edges that one task may close: the size is counted before, the result is the same.
SMALL_GRAPH = 500_000
#: Rows up to which Spark may broadcast a side of these joins; ids are so compressible that it would send far more.
BROADCAST_ROWS = 100_000


def joinable(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join that has about so many rows; large ones are marked for sort-merge, so that none goes through the driver."""
    return side.hint("merge") if rows > BROADCAST_ROWS else side


def smallest_reachable(pairs) -> dict:
    """Union-find over (u, v): the smallest id of the component of every node."""
    up: dict = {}

    def find(x):
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for u, v in pairs:
        up.setdefault(u, u)
        up.setdefault(v, v)
        a, b = find(u), find(v)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def _in_one_task(rest: DataFrame) -> DataFrame:
    """(id, to) of a graph of counted, small size."""

    def close(batches):
        rows = [pair for pdf in batches for pair in zip(pdf["u"].tolist(), pdf["v"].tolist())]
        found = smallest_reachable(rows)
        yield pd.DataFrame({"id": list(found), "to": list(found.values())})

    kind = rest.schema["u"].dataType
    return rest.coalesce(1).mapInPandas(close, T.StructType([T.StructField("id", kind), T.StructField("to", kind)]))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", alone: int = 0) -> DataFrame:
    """(id, component): smallest id reachable from each node that has an edge; ids of any type with an order.

    Each round hooks every node to its smallest neighbour, follows the pointers to their ends (each step doubles
    their reach) and contracts the graph, which at least halves the nodes that still have an edge. It ends when no
    edge is left. Minima combine before the shuffle, so a hub costs no more than others, and every round is written
    to shared storage. What is left of a graph of plain ids is closed in one task once it has at most `alone` edges.
    """
    rest = cut_lineage(edges.where(F.col(src) != F.col(dst)).select(F.col(src).alias("u"), F.col(dst).alias("v")).distinct())
    labels, n, known = None, rest.count(), 0
    while n:
        last = n <= alone and isinstance(rest.schema["u"].dataType, (T.LongType, T.IntegerType, T.StringType))
        if last:
            point = _in_one_task(rest) if labels is None else cut_lineage(_in_one_task(rest))
        else:
            both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
            point = cut_lineage(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("id"), F.least("u", "low").alias("to")), 2 * n)
        moving = not last
        while moving:
            onward = point.select(F.col("id").alias("to"), F.col("to").alias("next"))
            jumped = cut_lineage(point.join(joinable(onward, n), "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), 2 * n)
            moving = not jumped.where("moved").isEmpty()
            point = jumped.select("id", "to")
        if labels is None:
            labels, known = point.select("id", F.col("to").alias("component")), 2 * n
        else:
            # the nodes of a later round are the components of the rounds before
            onward = point.select(F.col("id").alias("component"), "to")
            labels = cut_lineage(labels.join(joinable(onward, n), "component", "left").select("id", F.coalesce("to", "component").alias("component")), known)
        if last:
            break
        ends = [joinable(point.select(F.col("id").alias(k), F.col("to").alias(f"r{k}")), n) for k in ("u", "v")]
        joined = rest.join(ends[0], "u").join(ends[1], "v").where("ru <> rv")
        rest = cut_lineage(joined.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), n)
        n = rest.count()
    if labels is None:
        return rest.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return labels


def with_singletons(nodes: DataFrame, components: DataFrame, key: str = "id") -> DataFrame:
    """Every node with its component; nodes without edges stand alone."""
    joined = nodes.select(F.col(key).alias("id")).join(components, "id", "left")
    return joined.select("id", F.coalesce("component", "id").alias("component"))


def components_by_level(edges: DataFrame, levels: Sequence[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of several edge sets in one run: (level…, id, component).

    `edges` carries level columns; a node is the struct of its levels and its id, so nodes of different levels
    never touch and one run serves all levels.
    """
    node = lambda c: F.struct(*levels, F.col(c).alias("id"))
    found = connected_components(edges.select(node(src).alias("src"), node(dst).alias("dst")))
    return found.select(*[F.col(f"id.{c}").alias(c) for c in levels], F.col("id.id").alias("id"), F.col("component.id").alias("component"))

"""Spanning forests of edge tables and of vectors, by rounds in which every component takes its best edge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.graph import SMALL_GRAPH, connected_components, joinable
from storyloom.session import cut_lineage


def grown(labels: DataFrame, picks: DataFrame, nodes: int = 0) -> DataFrame:
    """(id, comp) after the components that picks (comp, other_comp) names are joined; a component is named by its smallest id.

    nodes: how many labels there are, if known.
    """
    roots = connected_components(picks, "comp", "other_comp", alone=SMALL_GRAPH).select(F.col("id").alias("comp"), F.col("component").alias("root"))
    return cut_lineage(labels.join(joinable(roots, nodes), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))


def best_edges(nodes: DataFrame, best: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(a, b, weight): edges of a spanning forest; `best` gives for labels (id, comp) and the round the best edge (comp, a, b, weight) that leaves each component.

    Every component takes one edge a round, so at least half of those that have one vanish: the rounds are at most the
    logarithm of the nodes. Edges compare by (weight, a, b), which leaves no cycle among the chosen.
    """
    labels = cut_lineage(nodes.select("id", F.col("id").alias("comp")).distinct())
    n, parts = labels.count(), []
    while True:
        chosen = cut_lineage(best(labels, len(parts)))
        if chosen.isEmpty():
            break
        parts.append(chosen.select("a", "b", "weight").distinct())
        side = lambda c: joinable(labels.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}")), n)
        picks = chosen.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("comp"), F.col("cb").alias("other_comp"))
        labels = grown(labels, picks, n)
    if not parts:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("weight")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ordered(weight: Column | str = "weight") -> Column:
    """The order of edges: lighter first, then the smaller ends."""
    return F.struct((F.col(weight) if isinstance(weight, str) else weight).alias("weight"), "a", "b")


def minimum_forest(edges: DataFrame) -> DataFrame:
    """(a, b, weight): the minimum spanning forest of edges (a, b, weight) with a < b; ties fall to the smaller (a, b).

    The components of all edges up to a weight are those of the forest's edges up to it, so one forest answers every
    threshold. Edges inside a component are left behind after each round.
    """
    rest = [cut_lineage(edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("weight").alias("weight")))]

    n = rest[0].count()

    def best(labels: DataFrame, done: int) -> DataFrame:
        side = lambda c: joinable(labels.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}")), n)
        crossing = rest[0].join(side("a"), "a").join(side("b"), "b").where("ca <> cb")
        if done:
            rest[0] = cut_lineage(crossing.select("a", "b", "weight"))
            crossing = rest[0].join(side("a"), "a").join(side("b"), "b")
        ends = crossing.select("a", "b", "weight", F.explode(F.array("ca", "cb")).alias("comp"))
        return ends.groupBy("comp").agg(F.min(ordered()).alias("e")).select("comp", "e.a", "e.b", "e.weight")

    nodes = rest[0].select(F.explode(F.array("a", "b")).alias("id"))
    return best_edges(nodes, best)

"""Ranks, previous-row lookups, round robin and medians that hold when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(
    df: DataFrame, keys: Sequence[str], coarse: Sequence[Column], order: Sequence[Column], out: str
) -> DataFrame:
    """row_number within keys, in two levels.

    `coarse` must be a prefix of the order in coarser steps (score, then minute, for example).
    Rows are numbered inside (keys, coarse) and shifted by the counts of the earlier steps. The
    counts are aggregated map-side, so a key that holds most of the rows is never sorted in one
    task: the largest sort is one step of one key.
    """
    steps = [f"__step{i}" for i in range(len(coarse))]
    ordering = [_order_parts(c) for c in coarse]
    for name, (value, _) in zip(steps, ordering, strict=True):
        df = df.withColumn(name, value)
    by_step = [
        F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first()
        for name, (_, down) in zip(steps, ordering, strict=True)
    ]
    counts = df.groupBy(*keys, *steps).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(*by_step).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *steps, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = df.withColumn("__local", F.row_number().over(Window.partitionBy(*keys, *steps).orderBy(*order)))
    joined = local.alias("l").join(
        offsets.alias("o"), [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*keys, *steps)]
    )
    kept = [F.col(f"l.{c}") for c in df.columns if c not in steps]
    return joined.select(*kept, (F.col("__before") + F.col("__local")).cast("long").alias(out))


def pinned(df: DataFrame) -> DataFrame:
    """Stop later filters from being pushed into costly computed columns.

    Filter push-down copies the defining expression into the filter, so a long cascade or a Python
    function would run once more per filter; a lambda over such a column would run it per element.
    A one-element explode keeps the column computed once per row.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("row")).select("row.*")


def _order_parts(column) -> tuple[Column, bool]:
    """(value, descending) of a step given as a Column or as ('desc', Column)."""
    if isinstance(column, tuple):
        return column[1], column[0] == "desc"
    return column, False


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per key. Spark prunes to k rows per key before the shuffle."""
    numbered = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(out) <= k)


def round_robin(
    df: DataFrame, source: str, order: Sequence[Column], limit: int, tie: str = "id"
) -> DataFrame:
    """Take rows source by source in turns: first of every source, then second, up to limit.

    Sources take turns in the order in which they first appear. No source can place more than
    `limit` rows, so each is pruned to that many before the shuffle.
    """
    kept = top_k(df.withColumn(source, F.coalesce(F.col(source), F.lit(""))), [source], order, limit, "turn")
    heads = kept.where(F.col("turn") == 1)
    places = heads.orderBy(*order).limit(max(limit, 1))
    first = places.select(
        F.col(source).alias("__source"),
        F.row_number().over(Window.orderBy(*order)).alias("__place"),
    )
    return (
        kept.join(first, kept[source] == first["__source"])
        .drop("__source")
        .orderBy("turn", "__place")
        .limit(limit)
        .withColumn("pick", F.row_number().over(Window.orderBy("turn", "__place")).cast("long"))
        .drop("__place", "turn")
    )


def previous_row(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, out: str, span: int = 100_000
) -> DataFrame:
    """lag(value) per key by position, without sorting a hot key in one task.

    Positions are cut into spans; lag runs inside (key, span) and the first row of a span takes
    the last value of the closest earlier span of its key.
    """
    block = F.floor(F.col(position) / F.lit(span))
    staged = df.withColumn("__value", value).withColumn("__block", block)
    lasts = staged.groupBy(*keys, "__block").agg(F.max_by("__value", position).alias("__last"))
    over_blocks = Window.partitionBy(*keys).orderBy("__block")
    carried = lasts.select(*keys, "__block", F.lag("__last").over(over_blocks).alias("__carried"))
    inside = Window.partitionBy(*keys, "__block").orderBy(position)
    return (
        staged.withColumn("__lag", F.lag("__value").over(inside))
        .join(carried, [*keys, "__block"], "left")
        .withColumn(out, F.coalesce("__lag", "__carried"))
        .drop("__value", "__block", "__lag", "__carried")
    )


def exact_median(df: DataFrame, column: str, width: float = 0.001, out: str = "median") -> DataFrame:
    """Exact median of a bounded measure by histogram: find the bin, then order inside it only."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    binned = values.withColumn("bin", F.floor(F.col("v") / F.lit(width)))
    bins = binned.groupBy("bin").agg(F.sum("n").alias("bin_n"))
    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto", F.sum("bin_n").over(running)).withColumn(
        "total", F.sum("bin_n").over(Window.partitionBy(F.lit(1)))
    )
    low, high = F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)
    start = F.col("upto") - F.col("bin_n")
    hit = bins.where((start < high) & (F.col("upto") >= low)).select("bin", start.alias("start"), low.alias("low"), high.alias("high"))
    inside = Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = binned.join(F.broadcast(hit), "bin").withColumn("last", F.col("start") + F.sum("n").over(inside))
    first = F.col("last") - F.col("n") + 1
    at = lambda rank: F.max(F.when((first <= F.col(rank)) & (F.col("last") >= F.col(rank)), F.col("v")))
    return placed.agg(at("low").alias("a"), at("high").alias("b")).select(((F.col("a") + F.col("b")) / 2).alias(out))

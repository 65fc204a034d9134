"""Explorer over projected points: filters, pages, coverage counters, facets, detail, selections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators import editorial as ed
from storyloom.operators.ranking import round_robin


@dataclass(frozen=True)
class ExplorerFilters:
    projection_set: str | None = None
    source: str | None = None
    section: str | None = None
    cluster: int | None = None
    story: int | None = None
    highlight: bool = False
    dimension: str | None = None
    value: str | None = None
    outliers_only: bool = False
    date_from: str | None = None
    date_to: str | None = None
    search: str | None = None


def point_rows(points: DataFrame, articles: DataFrame, analysis: DataFrame | None = None, editorial: DataFrame | None = None) -> DataFrame:
    """Points with their article, and analysis and editorial columns where there are any."""
    rows = points.join(articles, "id")
    if analysis is not None:
        keys = ["id", "projection_set"] if "projection_set" in analysis.columns and "projection_set" in points.columns else ["id"]
        rows = rows.join(analysis, keys, "left")
    if editorial is not None:
        rows = rows.join(editorial.withColumnRenamed("article_id", "id"), "id", "left")
    return rows


def _matches(f: ExplorerFilters) -> Column:
    """The predicates that highlight mode shows instead of applying."""
    hit = F.lit(True)
    if f.search:
        needle = F.lit(f.search.strip().lower())
        hit = hit & (F.contains(F.lower("title"), needle) | F.contains(F.lower("summary"), needle))
    if f.dimension == "article_type" and f.value:
        hit = hit & (F.col("article_type") == f.value)
    if f.dimension == "bias_label" and f.value:
        hit = hit & F.coalesce(ed.strict_bias_match(F.lit(f.value)), F.lit(False))
    return hit


def filtered(rows: DataFrame, f: ExplorerFilters, story_members: DataFrame | None = None) -> DataFrame:
    """Rows that pass the filters, with is_match.

    In highlight mode the search, story and editorial predicates only mark rows; all others
    still filter. Membership is a semi-join, or one small flag join when it only marks.
    """
    if f.projection_set:
        rows = rows.where(F.col("projection_set") == f.projection_set)
    for column, value in (("source", f.source), ("section", f.section), ("cluster", f.cluster)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if f.outliers_only:
        rows = rows.where("is_outlier")
    if f.date_from:
        rows = rows.where(F.col("published_at") >= F.lit(f.date_from).cast("timestamp"))
    if f.date_to:
        rows = rows.where(F.col("published_at") < F.lit(f.date_to).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    in_story = None
    if f.story is not None:
        in_story = story_members.where(F.col("cluster") == f.story).select("id").distinct()
    hit = F.coalesce(_matches(f), F.lit(False))
    if not f.highlight:
        rows = rows.where(hit)
        if in_story is not None:
            rows = rows.join(in_story, "id", "left_semi")
        return rows.withColumn("is_match", F.lit(True))
    if in_story is None:
        return rows.withColumn("is_match", hit)
    marked = rows.join(in_story.withColumn("__in", F.lit(True)), "id", "left")
    return marked.withColumn("is_match", hit & F.col("__in").isNotNull()).drop("__in")


def page(rows: DataFrame, limit: int, matched_first: bool = False) -> DataFrame:
    """First rows, newest first; in highlight mode the matches lead."""
    lead = [F.when(F.col("is_match"), 0).otherwise(1)] if matched_first else []
    return rows.orderBy(*lead, F.desc("published_at"), F.desc("id")).limit(limit)


def coverage(rows: DataFrame) -> DataFrame:
    """Thirteen counters over points and their (optional) editorial rows, in one pass."""
    status = F.coalesce("analysis_status", F.lit("pending"))
    scope = F.coalesce("editorial_applicability", F.lit("full"))
    label = F.coalesce("bias_label", F.lit("unclear"))
    sure = F.coalesce("bias_confidence", F.lit(0.0))
    done = status == "completed"
    counters = {
        "pending": status == "pending", "failed": status == "failed",
        "unknown": F.coalesce("article_type", F.lit("unclear")) == "unclear", "limited": scope == "limited",
        "out_of_domain": scope == "out_of_domain", "bias_total_completed": done,
        "bias_low_confidence": done & (sure < ed.LOW_CONFIDENCE), "bias_unknown": done & (label == "unclear"),
        "bias_pending": status == "pending", "bias_failed": status == "failed", "bias_limited": scope == "limited",
        "bias_out_of_domain": scope == "out_of_domain",
    }
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in counters.items()])


def page_summary(rows: DataFrame, facets: dict[str, Column], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Total, bounds, days and facets of a filtered page, from one scan by grouping sets.

    One row a facet value (facet, value, n, matched, first_at, last_at, min and max of the axes) and one row with the
    facet 'total'. `facets` names value columns; null values are no facet value. Partial counts meet in the shuffle,
    so it carries a row a value and task, whatever the number of rows.
    """
    named = rows.select("is_match", "published_at", *axes, *[c.alias(f"f_{n}") for n, c in facets.items()])
    keys = [F.col(f"f_{n}") for n in facets]
    spans = [f(a).alias(f"{side}_{a}") for a in axes for side, f in (("min", F.min), ("max", F.max))]
    grouped = named.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count_if("is_match").alias("matched"),
        F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), *spans)
    every = (1 << len(keys)) - 1
    facet = F.coalesce(*[F.when(F.col("g") == every - (1 << (len(keys) - 1 - i)), name) for i, name in enumerate(facets)], F.lit("total"))
    value = F.coalesce(*keys) if len(keys) > 1 else keys[0]
    shown = grouped.withColumns({"facet": facet, "value": value}).where((F.col("facet") == "total") | F.col("value").isNotNull())
    return shown.select("facet", "value", "n", "matched", "first_at", "last_at", *[f"{side}_{a}" for a in axes for side in ("min", "max")])


def type_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("article_type", F.lit("unclear")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def bias_counts(rows: DataFrame) -> DataFrame:
    return rows.where(ed.strict_bias_match()).groupBy(F.col("bias_label").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    value = F.col(column).alias("value")
    return rows.select(value).where(F.col("value") != "").distinct().orderBy("value")


def detail(article_id: int, rows: DataFrame, neighbors: DataFrame, story_members: DataFrame, k: int = 5) -> DataFrame:
    """One article with its nearest articles (`neighbors`: those of this article) and the stories it belongs to."""
    near = neighbors.where(F.col("rank") <= k).agg(
        F.array_sort(F.collect_list(F.struct("rank", "other", "similarity"))).alias("neighbors")
    )
    told = story_members.where(F.col("id") == article_id).agg(F.array_sort(F.collect_list("cluster")).alias("stories"))
    return rows.where(F.col("id") == article_id).crossJoin(near).crossJoin(told)  # one row each


def points_with_neighbors(rows: DataFrame, neighbors: DataFrame, k: int = 3) -> DataFrame:
    near = neighbors.where(F.col("rank") <= k).groupBy(F.col("seed").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "other", "similarity"))).alias("neighbors")
    )
    return rows.join(near, "id", "left")


def cluster_first_selection(
    rows: DataFrame, members: DataFrame, stories: DataFrame, limit: int, order: list[Column], min_size: int = 2
) -> DataFrame:
    """Up to `limit` article ids: whole stories first while they fit, then sources in turns.

    Stories of at least min_size articles go newest first; one that is not complete in `rows` or
    exceeds the room left is passed over. At most `limit` articles are taken, and a story that
    is taken holds two or more, so the fold reads sizes only: small integers, kept as runs.
    """
    present = members.join(rows.select("id"), "id", "left_semi").groupBy("cluster").agg(F.count(F.lit(1)).alias("here"))
    whole = stories.where(F.col("article_count") >= min_size).join(present, "cluster").where(F.col("here") == F.col("article_count"))
    # a story larger than the limit never fits, and of each size at most limit / size can be taken
    place = F.struct((-F.unix_micros("last_at")).alias("t"), F.col("cluster"))
    by_size = Window.partitionBy("article_count").orderBy(place)
    fitting = whole.where(F.col("article_count") <= limit).withColumn("r", F.row_number().over(by_size)).where(
        (F.col("r") <= max(1, limit // max(min_size, 1))) & (F.col("r") * F.col("article_count") <= limit)
    )
    sizes = fitting.agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("article_count").alias("n"), "cluster"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))
    folded = F.aggregate(
        "s", start,
        lambda acc, x: F.when(
            acc["used"] + x["n"] <= limit,
            F.struct((acc["used"] + x["n"]).alias("used"), F.array_append(acc["taken"], x["cluster"]).alias("taken")),
        ).otherwise(acc),
    )
    taken = sizes.select(F.posexplode(folded["taken"]).alias("at", "cluster"))
    first = members.join(taken, "cluster").select("id", "at")
    chosen = rows.select("id", "source", *[c for c in rows.columns if c not in ("id", "source")]).join(first, "id")
    picked = chosen.select("id", "source", F.lit(0).alias("part"), F.col("at").cast("long").alias("a"), F.col("id").alias("b"))
    rest = rows.join(first.select("id"), "id", "left_anti")
    turns = round_robin(rest, "source", order, limit).select("id", "source", F.lit(1).alias("part"), F.col("pick").alias("a"), F.lit(0).cast("long").alias("b"))
    both = picked.unionByName(turns).orderBy("part", "a", "b").limit(limit)
    return both.withColumn("pick", F.row_number().over(Window.orderBy("part", "a", "b")).cast("long")).select("id", "source", "pick")

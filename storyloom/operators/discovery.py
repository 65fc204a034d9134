"""URL discovery over candidate tables: decision cascade, priority, layers and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import lexicons as lx
from storyloom.functions import text as tx

UNKNOWN_AGE = 9999
STALE_DAYS = 3
# columns of the profile table: source, include_paths, exclude_paths, exclude_sections,
# bucket_terms (arrays of text) and locality_rules (array of struct<patterns, penalty>)
PROFILE_SCHEMA = (
    "source string, include_paths array<string>, exclude_paths array<string>, "
    "exclude_sections array<string>, bucket_terms array<string>, "
    "locality_rules array<struct<patterns: array<string>, penalty: int>>"
)


def _any_of(terms: Column, text: Column) -> Column:
    """True when the text contains an element of the row's own term list."""
    return F.exists(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.contains(text, F.lower(t)))


def with_url_parts(candidates: DataFrame) -> DataFrame:
    """Add url_date, noise flag and empty hints to (source, url, origin, …) rows."""
    for name in ("feed_pubdate", "section_hint", "title_hint"):
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, F.lit(""))
    return candidates.withColumn("url_date", tx.url_date(F.col("url"))).withColumn(
        "is_noise", tx.is_noise_url(F.col("url"))
    )


def decide_candidates(
    candidates: DataFrame, profiles: DataFrame, target_date: str, national=lx.NATIONAL_URL_SIGNALS,
    timezone: str = "Europe/Madrid",
) -> DataFrame:
    """Add accepted, reason, scope_score, locality_penalty, same_local_day and age_days."""
    joined = candidates.join(profiles, "source", "left")
    path = tx.url_path(F.col("url"))
    text = F.lower(F.concat_ws(" ", path, "section_hint", "title_hint"))
    feed_day = tx.local_day(tx.parse_timestamp(F.col("feed_pubdate")), timezone)
    staged = (
        joined.withColumn("__path", path)
        .withColumn("__text", text)
        .withColumn("__national", tx.any_term(F.col("__text"), national))
        .withColumn("local_day", F.coalesce(feed_day, F.col("url_date")))
    )
    if target_date:
        target = F.lit(target_date).cast("date")
        same_day = F.coalesce(F.col("local_day") == target, F.lit(False))
        age = F.coalesce(F.abs(F.datediff(target, F.col("local_day"))), F.lit(UNKNOWN_AGE))
    else:
        same_day, age = F.lit(False), F.lit(0)
    included = _any_of(F.col("include_paths"), F.col("__path"))
    penalty = F.when(F.col("__national"), F.lit(0)).otherwise(
        F.aggregate(
            F.coalesce(F.col("locality_rules"), F.array().cast("array<struct<patterns:array<string>,penalty:int>>")),
            F.lit(0),
            lambda total, rule: total
            + F.when(_any_of(rule["patterns"], F.col("__path")), rule["penalty"]).otherwise(0),
        )
    )
    scope = (
        F.when(included, 4).otherwise(0)
        + F.when(_any_of(F.col("bucket_terms"), F.col("__text")), 2).otherwise(0)
        + F.when(F.col("__national"), 2).otherwise(0)
        + F.when(F.col("origin") == "rss", 1).otherwise(0)
    )
    has_include = F.coalesce(F.size("include_paths"), F.lit(0)) > 0
    staged = staged.withColumns(
        {"__same": same_day, "__age": age, "__penalty": penalty, "__scope": scope}
    )
    reason = (
        F.when(F.trim("url") == "", "rejected_scope")
        .when(F.col("is_noise"), "rejected_noise")
        .when(has_include & ~included & ~F.col("__national"), "rejected_scope")
        .when(_any_of(F.col("exclude_paths"), F.col("__path")), "rejected_scope")
        .when(_any_of(F.col("exclude_sections"), F.col("__text")), "rejected_article_type")
        .when(
            F.lit(bool(target_date)) & (F.col("__age") > STALE_DAYS) & (F.col("origin") != "html"),
            "rejected_stale",
        )
        .when((F.col("__penalty") >= 3) & (F.col("__scope") < 4), "rejected_locality")
        .otherwise("accepted")
    )
    staged = staged.withColumn("reason", reason)
    reached_age = ~F.col("reason").isin("rejected_scope", "rejected_noise", "rejected_article_type")
    reached_score = F.col("reason").isin("accepted", "rejected_locality")
    return staged.select(
        *candidates.columns,
        "reason",
        (F.col("reason") == "accepted").alias("accepted"),
        F.when(reached_score, F.col("__scope")).otherwise(0).alias("scope_score"),
        F.when(reached_score, F.col("__penalty")).otherwise(0).alias("locality_penalty"),
        F.when(reached_age, F.col("__same")).otherwise(False).alias("same_local_day"),
        F.when(reached_age, F.col("__age")).otherwise(UNKNOWN_AGE).alias("age_days"),
    )


def priority_order() -> list[Column]:
    """Same day first, then scope, freshness, locality penalty and URL."""
    return [
        F.when(F.col("same_local_day"), 0).otherwise(1).asc(),
        F.col("scope_score").desc(),
        F.col("age_days").asc(),
        F.col("locality_penalty").asc(),
        F.col("url").asc(),
    ]


def freshness_tier(url: Column, target_date: str) -> tuple[Column, Column]:
    """(tier, age in days) of a URL by the date in its path."""
    age = F.abs(F.datediff(F.lit(target_date).cast("date"), tx.url_date(url)))
    tier = F.when(age == 0, 0).when(age <= 2, 1).otherwise(2)
    return tier, F.coalesce(age, F.lit(UNKNOWN_AGE))


def first_seen(candidates: DataFrame, key: str, position: list[str]) -> DataFrame:
    """Keep the first row of each key by position (an aggregate, so partials merge map-side)."""
    order = F.struct(*position)
    others = [c for c in candidates.columns if c != key]
    picked = candidates.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("row"))
    return picked.select(key, *[F.col(f"row.{c}").alias(c) for c in others])


def layer_counters(decided: DataFrame, layer: str = "origin") -> DataFrame:
    """Attempted, accepted and rejected counts per discovery layer."""
    reasons = ("noise", "scope", "stale", "locality", "article_type")
    return decided.groupBy(layer).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if("accepted").alias("accepted"),
        *[F.count_if(F.col("reason") == f"rejected_{r}").alias(f"rejected_{r}") for r in reasons],
        F.count_if(F.col("accepted") & F.col("same_local_day")).alias("same_local_day_candidates"),
    )


def layered(
    decided: DataFrame, layers: list[str], min_usable: int, max_urls: int, layer: str = "origin"
) -> DataFrame:
    """Accepted URLs layer by layer: a later layer counts only while the earlier ones gave fewer
    than min_usable same-day URLs; the overall cap keeps the first max_urls by priority."""
    place = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col(layer)).cast("int")
    usable = decided.where(F.col("accepted")).withColumn("layer_place", place)
    usable = first_seen(usable, "url", ["layer_place"])
    per_layer = usable.groupBy("layer_place").agg(
        F.count_if("same_local_day").alias("n")
    )
    earlier = Window.orderBy("layer_place").rowsBetween(Window.unboundedPreceding, -1)
    open_layers = per_layer.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(
        F.col("before") < min_usable
    )
    return (
        usable.join(F.broadcast(open_layers.select("layer_place")), "layer_place")
        .orderBy("layer_place", *priority_order())
        .limit(max_urls)
    )


def extraction_budget(
    pages: DataFrame, target_day: str, max_articles: int = 120, max_errors: int = 20, order: str = "position"
) -> DataFrame:
    """Rows a bounded extraction run would process, with the outcome of each.

    `pages` carries position, local_day and failed. The run stops after max_articles rows or
    when the error count reaches max_errors; only the first max_articles rows can matter, so
    the running count is over that many rows at most.
    """
    head = pages.orderBy(order).limit(max_articles)
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    errors_before = F.coalesce(F.sum(F.col("failed").cast("int")).over(running), F.lit(0))
    outcome = (
        F.when(F.col("failed"), "error")
        .when(F.coalesce(F.col("local_day") == F.lit(target_day).cast("date"), F.lit(False)), "kept")
        .otherwise("discarded_by_date")
    )
    return head.withColumn("errors_before", errors_before).where(
        F.col("errors_before") < max_errors
    ).withColumn("outcome", outcome)


def keep_local_day(df: DataFrame, target_day: str, column: str = "published_at", timezone: str = "Europe/Madrid"):
    """(kept rows, one-row counts of kept and discarded)."""
    same = F.coalesce(tx.local_day(F.col(column), timezone) == F.lit(target_day).cast("date"), F.lit(False))
    counts = df.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(same).alias("kept"),
        F.count_if(~same).alias("discarded_by_date"),
    )
    return df.where(same), counts

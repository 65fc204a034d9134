"""Corpus selection: ordered eligibility rules, score, topic bucket, daily rank, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import lexicons as lx
from storyloom.functions import text as tx
from storyloom.operators.ranking import ranked, top_k
from storyloom.session import cut_lineage
from storyloom.sources import tables

LONG_BODY = 1200
MIN_SCORE = 2.5
PROFILE_VERSION = "matching-v2"


def _per_source(source: Column, table: dict, hit) -> Column:
    """True when the rules listed for this row's source fire."""
    fired = F.lit(False)
    for name, terms in table.items():
        fired = fired | ((source == name) & hit(terms))
    return fired


def topic_bucket(text: Column, buckets: dict) -> Column:
    """Bucket with most pattern hits; the earlier bucket wins a tie; none gives ''."""
    counts = [tx.count_terms(text, terms) for terms in buckets.values()]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    pick = F.when(best == 0, F.lit(""))
    for name, count in zip(buckets, counts, strict=True):
        pick = pick.when(count == best, F.lit(name))
    return pick


def decide(articles: DataFrame, rules: lx.CorpusRules = lx.CorpusRules()) -> DataFrame:
    """Add local_day, eligible, reason, bucket and score; rules are tried in a fixed order."""
    low = lambda name: F.lower(tx.blank_if_null(F.col(name)))
    path_of, section_of = tx.url_path(F.col("url")), low("section")
    staged = articles.withColumns(
        {
            "local_day": tx.local_day(F.col("published_at"), rules.timezone),
            "__path": path_of,
            "__section": section_of,
            "__text": F.concat_ws(" ", section_of, low("title"), low("summary"), low("tags"), path_of),
        }
    ).withColumns(
        {
            "__bucket": topic_bucket(F.col("__text"), rules.buckets),
            "__national": tx.any_term(F.col("__text"), rules.national_terms),
        }
    )
    path, section, text, source = (F.col(c) for c in ("__path", "__section", "__text", "source"))
    body = F.length(tx.strip(tx.blank_if_null(F.col("article_text"))))
    score = F.lit(3.0) + F.when(body >= LONG_BODY, 2.0).otherwise(0.5)
    score = score + F.when(F.col("__national"), 1.5).otherwise(0.0)
    for name, term, bonus in rules.source_path_bonus:
        score = score + F.when((source == name) & F.contains(path, F.lit(term)), bonus).otherwise(0.0)
    local_only = tx.any_term(path, rules.locality_paths) & ~F.col("__national")
    score = score - F.when(local_only, 2.0).otherwise(0.0)

    rejected = (
        F.when(F.col("local_day").isNull(), "missing_local_date")
        .when(tx.any_term(path, rules.excluded_paths), "excluded_non_article_path")
        .when(tx.any_term(section, rules.excluded_sections), "excluded_section")
        .when(
            _per_source(source, rules.source_excluded_sections, lambda t: tx.any_term(section, t)),
            "excluded_source_section",
        )
        .when(tx.any_term(text, rules.excluded_text), "excluded_article_type")
        .when(
            _per_source(
                source, rules.source_excluded_text, lambda t: tx.any_term(path, t) | tx.any_term(text, t)
            ),
            "excluded_source_policy",
        )
        .when(tx.any_term(text, rules.soft_lifestyle), "excluded_soft_lifestyle")
        .when(F.col("__bucket") == "", "excluded_no_hard_news_bucket")
    )
    judged = staged.withColumns({"__rejected": rejected, "__score": score})
    passed = F.col("__rejected").isNull()
    reason = F.when(~passed, F.col("__rejected")).when(
        F.col("__score") < MIN_SCORE, "excluded_locality_bias"
    ).otherwise("eligible_hard_news")
    return judged.select(
        *articles.columns,
        "local_day",
        (passed & (F.col("__score") >= MIN_SCORE)).alias("eligible"),
        reason.alias("reason"),
        F.when(passed, F.col("__bucket")).otherwise("").alias("bucket"),
        F.when(passed, F.col("__score")).otherwise(0.0).alias("score"),
    )


def rank_daily(decided: DataFrame, daily_cap: int = 0) -> DataFrame:
    """Add selection_rank: eligible rows per (source, local day) by score, time, URL.

    Rows that are not eligible, or fall beyond a positive cap, keep a null rank.
    """
    keys = ["source", "local_day", "eligible"]
    order = [F.col("score").desc(), F.col("published_at").asc(), F.col("url").asc()]
    minute = F.date_trunc("minute", F.col("published_at"))
    rows = ranked(decided, keys, [("desc", F.col("score")), minute], order, "selection_rank")
    within = F.col("eligible") & ((F.col("selection_rank") <= daily_cap) if daily_cap > 0 else F.lit(True))
    return rows.withColumn("selection_rank", F.when(within, F.col("selection_rank")))


def build_selection(
    articles: DataFrame, as_of, days_back: int = 3, daily_cap: int = 0,
    rules: lx.CorpusRules = lx.CorpusRules(),
) -> DataFrame:
    """One row per recent article: decision plus its daily rank (null when not selected).

    The decisions are written once (a narrow table without texts), so the texts are read once
    although the two-level ranking needs its input twice.
    """
    columns = ["id", "source", "title", "url", "published_at", "section", "summary", "article_text", "tags"]
    decided = decide(tables.recent(articles.select(*columns), as_of, days_back), rules).select(
        "id", "source", "section", "url", "published_at", "local_day", "eligible", "reason", "bucket", "score"
    )
    ranks = rank_daily(cut_lineage(decided), daily_cap)
    return ranks.withColumn("profile_version", F.lit(PROFILE_VERSION))


def audit(selection: DataFrame, top: int = 10) -> DataFrame:
    """Counts per source with its busiest sections and the buckets it contributed."""
    # one pass over the articles; everything else works on these few cells
    cells = cut_lineage(
        selection.groupBy("source", F.coalesce(F.col("section"), F.lit("")).alias("section"), "bucket").agg(
            F.count(F.lit(1)).alias("raw"),
            F.count_if("eligible").alias("eligible"),
            F.count_if(F.col("selection_rank").isNotNull()).alias("picked"),
        )
    )
    totals = cells.groupBy("source").agg(
        F.sum("raw").alias("raw_count"), F.sum("eligible").alias("eligible_count"), F.sum("picked").alias("selected_count")
    )
    by_section = cells.groupBy("source", F.col("section").alias("name")).agg(
        F.sum("raw").alias("raw"), F.sum("picked").alias("picked")
    )
    by_bucket = cells.groupBy("source", F.col("bucket").alias("name")).agg(F.sum("picked").alias("n"))

    def as_map(counts: DataFrame, count: str, name: str, limit: int | None) -> DataFrame:
        counts = counts.where(F.col(count) > 0)
        if limit:
            counts = top_k(counts, ["source"], [F.col(count).desc(), F.col("name").asc()], limit)
        entry = F.struct(F.col("name"), F.col(count).alias("count"))
        return counts.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))

    result = totals
    for part in (
        as_map(by_section, "raw", "raw_sections", top),
        as_map(by_section, "picked", "selected_sections", top),
        as_map(by_bucket, "n", "selected_buckets", None),
    ):
        result = result.join(part, "source", "left")
    return result


def run_metrics(selection: DataFrame) -> DataFrame:
    """One row: how many articles were seen, eligible and selected."""
    return selection.agg(
        F.count(F.lit(1)).alias("article_count"),
        F.count_if("eligible").alias("eligible_count"),
        F.count_if(F.col("selection_rank").isNotNull()).alias("selected_count"),
    )

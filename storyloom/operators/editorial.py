"""Editorial analysis: canonical rows from raw model answers, review flags, source comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import taxonomy as tax
from storyloom.operators.ranking import top_k

LOW_CONFIDENCE = 0.45


# --- scalar rules ------------------------------------------------------------------------------
def resolve_confidence(own: Column, shared: Column, label: Column, fallback: float) -> Column:
    """Stated confidence, else the shared one, else a default; low when the label is unclear."""
    unclear = label == "unclear"
    value = F.coalesce(own, shared, F.when(unclear, 0.3).otherwise(fallback))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.bround(F.when(unclear, F.least(value, F.lit(0.6))).otherwise(value), 3)


def resolve_bias_score(own: Column, label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in tax.BIAS_SCORES.items() for x in pair])
    bound = F.when(label == "unclear", 0.2).when(label == "center", 0.3).otherwise(1.0)
    return F.when(own.isNull(), table[label]).otherwise(F.bround(F.greatest(-bound, F.least(bound, own)), 3))


def review_flags(
    status: Column, bias_label: Column, bias_confidence: Column, evidence_count: Column, unclear_reasons: Column,
    applicability: Column,
) -> Column:
    """Nine booleans; needs_review is true when any of the others is."""
    completed = status == "completed"
    flags = {
        "missing_evidence": completed & (evidence_count == 0),
        "low_confidence": completed & (bias_confidence < LOW_CONFIDENCE),
        "failed_analysis": status == "failed",
        "unclear_bias": bias_label == "unclear",
        "provider_missing": F.array_contains(unclear_reasons, "provider_missing"),
        "mapping_loss": F.array_contains(unclear_reasons, "mapping_loss")
        | F.array_contains(unclear_reasons, "repair_data_loss"),
        "out_of_domain": applicability == "out_of_domain",
        "pending_analysis": status == "pending",
    }
    anything = F.lit(False)
    for flag in flags.values():
        anything = anything | flag
    return F.struct(*[f.alias(n) for n, f in flags.items()], anything.alias("needs_review"))


# fixed values: what a reader sees before an article is analysed
PENDING = {
    "analysis_status": "pending", "editorial_applicability": "full",
    "editorial_applicability_reason": "general_editorial_content", "article_type": "unclear",
    "bias_label": "unclear", "tone_emotional": "unclear", "tone_target": "unclear", "opinionatedness": "unclear",
    "sensationalism": "unclear", "rhetorical_certainty": "unclear", "rationale": "Editorial analysis pending.",
}
PENDING_NUMBERS = ("article_type_confidence", "bias_score", "bias_confidence")
STATUS_COLUMNS = tuple(f"{d}_status" for d in tax.DIMENSIONS)


def with_summary(articles: DataFrame, editorial: DataFrame) -> DataFrame:
    """Articles with their editorial row or the pending defaults, flags and a preview.

    editorial: article_id, the columns of PENDING, the three numbers, framing_devices, unclear_reasons
    (arrays of text), evidence_spans (array of struct type, text, note) and the *_status columns.
    """
    known = editorial.withColumn("has_analysis", F.lit(True))
    joined = articles.join(known, articles["id"] == known["article_id"], "left").drop("article_id")
    empty = F.array().cast("array<string>")
    evidence = F.coalesce("evidence_spans", F.array().cast("array<struct<type:string,text:string,note:string>>"))
    filled = joined.withColumns(
        {
            **{c: F.coalesce(c, F.lit(v)) for c, v in PENDING.items()},
            **{c: F.coalesce(c, F.lit(0.0)) for c in PENDING_NUMBERS},
            "framing_devices": F.coalesce("framing_devices", empty),
            "unclear_reasons": F.coalesce("unclear_reasons", empty),
            "evidence_count": F.size(evidence),
            "evidence_spans": F.slice(F.filter(evidence, lambda e: e["text"] != ""), 1, 3),
        }
    )
    flags = review_flags(*[F.col(c) for c in (
        "analysis_status", "bias_label", "bias_confidence", "evidence_count", "unclear_reasons", "editorial_applicability")])
    named = F.map_from_arrays(F.array(*[F.lit(d) for d in tax.DIMENSIONS]), F.array(*[F.coalesce(c, F.lit("")) for c in STATUS_COLUMNS]))
    return filled.withColumn("review_flags", flags).withColumn(
        "dimension_status", F.map_filter(named, lambda _, v: v != "")
    )


def strict_bias_match(value: Column | None = None) -> Column:
    """Bias label that may be shown: completed, fully applicable, clear and confident enough."""
    label = F.col("bias_label")
    clear = (
        (F.col("analysis_status") == "completed") & (F.col("editorial_applicability") == "full")
        & (label != "unclear") & (F.col("bias_confidence") >= LOW_CONFIDENCE)
    )
    return clear if value is None else clear & (label == value)


def article_type_bucket() -> Column:
    return (
        F.when(F.col("analysis_status") == "pending", "pending")
        .when(F.col("analysis_status") == "failed", "failed")
        .when(F.col("article_type").isin("", "unclear"), "unknown")
        .when(F.col("editorial_applicability") == "out_of_domain", "out_of_domain")
        .when(F.col("editorial_applicability") == "limited", "limited")
        .otherwise("typed")
    )


def bias_bucket() -> Column:
    return (
        F.when(F.col("analysis_status") == "pending", "pending")
        .when(F.col("analysis_status") == "failed", "failed")
        .when(F.col("editorial_applicability") == "out_of_domain", "out_of_domain")
        .when(F.col("editorial_applicability") == "limited", "limited")
        .when(F.col("bias_label").isin("", "unclear"), "unknown")
        .when((F.col("analysis_status") == "completed") & (F.col("bias_confidence") < LOW_CONFIDENCE), "low_confidence")
        .otherwise("typed")
    )


# --- lists -------------------------------------------------------------------------------------
def filter_list(rows: DataFrame, *, status: str | None = None, date_from=None, date_to=None, min_confidence=None, **equals) -> DataFrame:
    """Rows of an article ⟕ editorial join; a missing analysis counts as pending only for that filter."""
    for column, value in equals.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if min_confidence is not None:
        rows = rows.where(F.col("bias_confidence") >= min_confidence)
    if date_from:
        rows = rows.where(F.col("published_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        rows = rows.where(F.col("published_at") < F.lit(date_to).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    if status == "pending":
        rows = rows.where(F.coalesce("analysis_status", F.lit("pending")) == "pending")
    elif status:
        rows = rows.where(F.col("analysis_status") == status)
    return rows


def list_order(name: str) -> list[Column]:
    """Six named orders with explicit null places; unknown names mean newest first."""
    orders = {
        "published_at_asc": [F.asc_nulls_first("published_at"), F.asc("id")],
        "published_at_desc": [F.desc_nulls_last("published_at"), F.desc("id")],
        "analyzed_at_desc": [F.desc_nulls_last("analyzed_at"), F.desc_nulls_last("published_at"), F.desc("id")],
        "bias_score_asc": [F.asc_nulls_first("bias_score"), F.asc("id")],
        "bias_score_desc": [F.desc_nulls_last("bias_score"), F.desc("id")],
        "bias_confidence_desc": [F.desc_nulls_last("bias_confidence"), F.desc("id")],
    }
    return orders.get(name, orders["published_at_desc"])


def work_list(rows: DataFrame, status: str, as_of, days_back: int, limit: int, ids: list[int] | None = None, **filters) -> DataFrame:
    """Articles to analyse: explicit ids, or recent ones by status, newest first."""
    if status not in ("pending", "failed", "completed", "any"):
        raise ValueError(f"unknown status {status}")
    if ids:
        picked = rows.where(F.col("id").isin(ids))
    else:
        cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days_back)} DAYS")
        picked = filter_list(rows.where(F.col("published_at") >= cutoff), status=None if status == "any" else status, **filters)
    return picked.orderBy(F.desc("published_at"), F.desc("id")).limit(limit)


def work_counts(rows: DataFrame, as_of, days_back: int, limit: int) -> DataFrame:
    """Size of the work list per status; the limit holds for each status."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days_back)} DAYS")
    status = F.coalesce("analysis_status", F.lit("pending"))
    counts = rows.where(F.col("published_at") >= cutoff).agg(
        *[F.count_if(status == s).alias(s) for s in ("pending", "failed", "completed")], F.count(F.lit(1)).alias("any")
    )
    return counts.select(*[F.least(F.lit(limit), F.col(c)).alias(c) for c in counts.columns])


# --- comparison inside a story -----------------------------------------------------------------
BREAKDOWNS = {
    "applicability": "editorial_applicability", "article_type": "article_type", "bias_label": "bias_label",
    "opinionatedness": "opinionatedness", "tone_emotional": "tone_emotional",
}


def source_breakdown(rows: DataFrame) -> DataFrame:
    """(cluster, source, dimension, value, n): value counts over articles that have an analysis.

    rows: cluster, id, source plus with_summary's columns.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("value")) for n, c in BREAKDOWNS.items()]))
    cells = rows.where("has_analysis").select("cluster", "source", pairs.alias("p")).select("cluster", "source", "p.*")
    return cells.groupBy("cluster", "source", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def source_summary(rows: DataFrame) -> DataFrame:
    """One row per (cluster, source): counts, value maps, flag counts, top three framing devices."""
    has, flags = F.coalesce("has_analysis", F.lit(False)), "review_flags"
    base = rows.groupBy("cluster", "source").agg(
        F.count(F.lit(1)).alias("article_count"),
        F.count_if(has & (F.col("analysis_status") == "completed")).alias("analyzed_article_count"),
        *[F.count_if(has & F.col(f"{flags}.{f}")).alias(f) for f in ("low_confidence", "needs_review", "out_of_domain")],
        F.count_if(has & (F.col("editorial_applicability") == "limited")).alias("limited"),
    )
    cells = source_breakdown(rows)
    maps = cells.groupBy("cluster", "source").agg(
        *[
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dimension") == d, F.struct("value", "n"))))).alias(f"{d}_breakdown")
            for d in BREAKDOWNS
        ]
    )
    return base.join(maps, ["cluster", "source"], "left").join(top_framing(rows), ["cluster", "source"], "left")


def top_framing(rows: DataFrame, devices: int = 3, examples: int = 3) -> DataFrame:
    """Most used framing devices per (cluster, source) with the first example articles."""
    used = rows.where("has_analysis").select("cluster", "source", "id", F.explode("framing_devices").alias("device"))
    counts = used.groupBy("cluster", "source", "device").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    best = top_k(counts, ["cluster", "source"], [F.desc("n"), F.asc("first"), F.asc("device")], devices)
    shown = top_k(used.join(best.select("cluster", "source", "device"), ["cluster", "source", "device"], "left_semi"),
                  ["cluster", "source", "device"], [F.asc("id")], examples, "e")
    named = shown.groupBy("cluster", "source", "device").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return best.join(named, ["cluster", "source", "device"]).groupBy("cluster", "source").agg(
        F.array_sort(F.collect_list(F.struct("rank", "device", "n", "examples"))).alias("top_framing_devices")
    )


def cluster_status(rows: DataFrame) -> DataFrame:
    """Analysed, pending and failed articles per cluster; no analysis counts as pending."""
    status = F.coalesce("analysis_status", F.lit("pending"))
    return rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(status == "completed").alias("analyzed"),
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "failed").alias("failed"),
        F.count_distinct(F.when(F.col("has_analysis") & ~F.col("bias_label").isin("", "unclear"), F.col("bias_label"))).alias("bias_labels"),
    )


def cluster_signals(rows: DataFrame) -> DataFrame:
    """Signals of a cluster: framing devices seen in two or more articles, a mixed or contested note."""
    used = rows.where("has_analysis").select("cluster", "source", F.explode("framing_devices").alias("device"))
    support = used.groupBy("cluster", "device").agg(
        F.least(F.count(F.lit(1)), F.lit(4)).alias("support"), F.count_distinct("source").alias("sources")
    )
    top = top_k(support, ["cluster"], [F.desc("support"), F.asc("device")], 3).where("support >= 2")
    framing = top.select(
        "cluster", F.concat(F.lit("Framing device: "), "device").alias("label"),
        F.when(F.col("support") >= 3, "strong").otherwise("moderate").alias("strength"), "sources", "support",
    )
    status = cluster_status(rows)
    every = rows.groupBy("cluster").agg(F.count_distinct("source").alias("sources"))
    noted = status.join(every, "cluster")
    mixed = noted.where("analyzed > 0").join(top.select("cluster"), "cluster", "left_anti").select(
        "cluster", F.lit("Framing signal is mixed").alias("label"), F.lit("weak").alias("strength"), "sources", F.lit(0).cast("long").alias("support")
    )
    contested = noted.where("bias_labels > 1").select(
        "cluster", F.lit("Bias labels are contested across the cluster").alias("label"),
        F.when(F.col("analyzed") >= 3, "moderate").otherwise("weak").alias("strength"), "sources", F.lit(0).cast("long").alias("support"),
    )
    return framing.unionByName(mixed).unionByName(contested)


# fixed values: scores of the comparison; the second preset serves the canonical taxonomy
REFERENCE_SCALES = {
    "opinionatedness": {"low": 0.0, "mixed": 0.5, "high": 1.0},
    "tone": {"measured": 0.0, "somewhat_emotional": 0.5, "critical": 1.0, "emotional": 1.0},
    "bias": {"left": -1.0, "center_left": -0.5, "unclear": 0.0, "center": 0.0, "center_right": 0.5, "right": 1.0},
}
CANONICAL_SCALES = {
    "opinionatedness": {"straight_reporting": 0.0, "interpretive": 0.5, "opinionated": 1.0, "activist": 1.0},
    "tone": {"calm": 0.0, "loaded": 0.5, "inflammatory": 1.0},
    "bias": {**REFERENCE_SCALES["bias"], "far_left": -1.0, "far_right": 1.0},
}
SCALED = {
    "opinionatedness": ("opinionatedness", "opinionatedness_status"), "tone": ("tone_emotional", "tone_emotional_status"),
    "bias": ("bias_label", "bias_status"),
}
# (dimension, threshold for moderate, threshold for strong)
DIVERGENCE = (("opinionatedness", 0.34, 0.66), ("tone", 0.34, 0.66), ("bias", 0.75, 1.25), ("framing", 0.2, 0.35))
MIN_SUPPORT = 2


def source_metrics(rows: DataFrame, scales: dict = REFERENCE_SCALES) -> DataFrame:
    """Per (cluster, source): usable counts, eligibility, four indexes, support and confidence band.

    Only rows with an analysis count; usable means completed and not out of domain. An index needs
    two resolved values.
    """
    usable = (F.col("analysis_status") == "completed") & (F.col("editorial_applicability") != "out_of_domain")
    values = {}
    for name, (column, status) in SCALED.items():
        table = F.create_map(*[F.lit(x) for p in scales[name].items() for x in p])
        values[name] = F.when(usable & (F.col(status) == "resolved"), F.try_element_at(table, F.col(column)))
    n = F.size("framing_devices")
    most = F.array_max(F.transform(F.array_distinct("framing_devices"), lambda d: F.size(F.filter("framing_devices", lambda x: x == d))))
    values["framing"] = F.when(usable & (F.col("framing_status") == "resolved") & (n > 0), most / n)
    staged = rows.where("has_analysis").withColumns({f"v_{k}": v for k, v in values.items()}).withColumn("usable", usable)
    index = lambda d: F.when(F.count(f"v_{d}") >= MIN_SUPPORT, F.bround(F.avg(f"v_{d}"), 3))
    metrics = staged.groupBy("cluster", "source").agg(
        F.count_if("usable").alias("usable_count"),
        F.count_if(F.col("usable") & (F.col("editorial_applicability") == "full")).alias("full_count"),
        F.count_if(F.col("usable") & (F.col("editorial_applicability") == "limited")).alias("limited_count"),
        F.count_if(F.col("usable") & F.col("review_flags.low_confidence")).alias("low_confidence_count"),
        *[index(d).alias(f"{d}_index") for d in values],
        *[F.count(f"v_{d}").alias(f"{d}_support") for d in values],
    )
    few = F.col("usable_count") < MIN_SUPPORT
    partial = (F.col("full_count") == 0) | (F.col("limited_count") >= F.col("full_count"))
    eligibility = F.when(few, "insufficient_sample").when(partial, "limited").otherwise("eligible")
    band = (
        F.when((F.col("usable_count") >= 3) & (F.col("eligibility") == "eligible") & (F.col("low_confidence_count") == 0), "high")
        .when(few, "insufficient")
        .when((F.col("eligibility") == "limited") | (F.col("limited_count") > 0), "low")
        .when(F.col("low_confidence_count") > 0, "moderate")
        .otherwise("high")
    )
    return metrics.withColumn("eligibility", eligibility).withColumn("confidence_band", band)


def divergence_signals(metrics: DataFrame) -> DataFrame:
    """Best ordered pair of sources per (cluster, dimension) whose indexes differ enough.

    The widest gap above a positive threshold is always between the largest and the smallest
    index, so two aggregates replace the pairs of sources. Gaps are compared to three digits and
    the first source by name leads on a tie.
    """
    kept = metrics.where(F.col("eligibility") != "insufficient_sample")
    cells = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("moderate"), F.lit(s).alias("strong"),
                 F.col(f"{d}_index").alias("value"), F.col(f"{d}_support").alias("support"))
        for d, m, s in DIVERGENCE
    ])
    long = kept.select("cluster", "source", F.explode(cells).alias("c")).select("cluster", "source", "c.*").where(
        F.col("value").isNotNull() & (F.col("support") >= MIN_SUPPORT)
    )
    row = F.struct("source", "value", "support")
    ends = long.groupBy("cluster", "dimension", "moderate", "strong").agg(
        F.min_by(row, F.struct(-F.col("value"), F.col("source"))).alias("lead"),
        F.min_by(row, F.struct("value", "source")).alias("trail"),
    )
    delta = F.col("lead.value") - F.col("trail.value")
    return ends.where(delta >= F.col("moderate")).select(
        "cluster", "dimension", F.col("lead.source").alias("leading_source"), F.col("trail.source").alias("trailing_source"),
        F.round(delta, 3).alias("delta"), F.when(delta >= F.col("strong"), "strong").otherwise("moderate").alias("strength"),
        F.col("lead.support").alias("leading_support"), F.col("trail.support").alias("trailing_support"),
    )


def comparison_note(metrics: DataFrame, signals: DataFrame) -> DataFrame:
    """Per cluster: how many sources can be compared and what that allows."""
    counts = metrics.groupBy("cluster").agg(F.count_if(F.col("eligibility") != "insufficient_sample").alias("eligible_sources"))
    found = signals.groupBy("cluster").agg(F.count(F.lit(1)).alias("signals"))
    note = (
        F.when(F.col("eligible_sources") < 2, "suppressed").when(F.coalesce("signals", F.lit(0)) == 0, "no_divergence").otherwise("compared")
    )
    return counts.join(found, "cluster", "left").select("cluster", "eligible_sources", F.coalesce("signals", F.lit(0)).alias("signals"), note.alias("note"))


# --- contracts ---------------------------------------------------------------------------------
def editorial_violations() -> Column:
    """Names of the rules a canonical editorial row breaks; an empty array means valid."""
    c = F.col
    target = F.create_map(*[F.lit(x) for p in tax.BIAS_SCORES.items() for x in p])[c("bias_label")]
    sided = ~c("bias_label").isin("unclear", "center")
    rules = {
        **{f"{d}_value": ~c(d).isin(*allowed) for d, allowed in tax.ALLOWED.items()},
        "confidence_range": ~c("article_type_confidence").between(0, 1) | ~c("bias_confidence").between(0, 1),
        "bias_score_range": ~c("bias_score").between(-1, 1),
        "unclear_bias_not_neutral": (c("bias_label") == "unclear") & ((F.abs("bias_score") > 0.2) | (c("bias_confidence") > 0.6)),
        "center_bias_not_neutral": (c("bias_label") == "center") & (F.abs("bias_score") > 0.3),
        "bias_side": sided & (((target < 0) & (c("bias_score") > -0.1)) | ((target > 0) & (c("bias_score") < 0.1))),
        "bias_distance": sided & (F.abs(c("bias_score") - target) > 0.55),
        "unclear_type_too_sure": (c("article_type") == "unclear") & (c("article_type_confidence") > 0.6),
        "inflammatory_low_sensationalism": (c("tone_emotional") == "inflammatory") & (c("sensationalism") == "low"),
        "hostile_straight_reporting": (c("tone_target") == "hostile") & (c("opinionatedness") == "straight_reporting"),
        "absolute_without_confidence": (c("rhetorical_certainty") == "absolute") & (c("bias_confidence") < 0.2),
    }
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules.items()]))


def article_violations(required=("source", "title", "url", "published_at")) -> Column:
    """Required article fields that are missing."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in required]))


def split_valid(rows: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    marked = rows.withColumn("violations", violations)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)

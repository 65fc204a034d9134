"""Registered queries for editorial rows, comparison inside stories, lists and evaluation.

Editorial rows are derived from events: the event is the article, user_id % 50 its story, the event
type its source, and residues of the event id choose the values, so that every rule fires.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import editorial as ed
from storyloom.operators import evaluate as ev
from storyloom.operators import explorer as ex
from storyloom.operators import raw_editorial as raw
from storyloom.operators import stories
from storyloom.plans import sqltext as q
from storyloom.plans.registry import Catalogue
from storyloom.sources import tables as tb

catalogue = Catalogue()
AS_OF = "2024-01-31 00:00:00"


def _case(modulus: int, *values: str) -> str:
    branches = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE event_id % {modulus} {branches} ELSE '{values[-1]}' END"


COLUMNS = {
    "analysis_status": _case(10, "pending", "failed", "completed"),
    "editorial_applicability": _case(7, "limited", "out_of_domain", "full"),
    "article_type": _case(5, "news_report", "analysis", "opinion", "unclear", "feature"),
    "bias_label": _case(6, "left", "center_left", "center", "right", "unclear", "center_right"),
    "tone_emotional": _case(5, "measured", "critical", "emotional", "somewhat_emotional", "calm"),
    "tone_target": _case(4, "neutral", "hostile", "mixed"),
    "opinionatedness": _case(4, "low", "mixed", "high", "unclear"),
    "sensationalism": _case(3, "low", "medium", "high"),
    "rhetorical_certainty": _case(3, "cautious", "assertive", "absolute"),
    "editorial_applicability_reason": "'general_editorial_content'",
    "rationale": "'why'",
    "article_type_status": _case(3, "weak_signal_abstain", "resolved"),
    "bias_status": _case(3, "resolved", "weak_signal_abstain", "resolved"),
    "tone_emotional_status": _case(4, "mapping_loss", "resolved"),
    "tone_target_status": "'resolved'",
    "opinionatedness_status": _case(5, "provider_missing", "resolved"),
    "sensationalism_status": "'resolved'",
    "rhetorical_certainty_status": "''",
    "framing_status": _case(6, "mapping_loss", "resolved"),
    "article_type_confidence": "CAST(value / 500 AS DOUBLE)",
    "bias_score": "CAST(value / 500 - 0.3 AS DOUBLE)",
}
FRAMING = [[], ["conflict"], ["conflict", "humanitarian"], ["victimization", "conflict", "victimization"]]
REASONS = [["provider_missing"], ["mapping_loss", "out_of_domain"], ["repair_data_loss"], []]
HAS = "event_id % 13 <> 0"


def _arrays(options, literal, empty) -> str:
    cells = [literal(o) if o else empty for o in options]
    branches = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cells[:-1]))
    return f"CASE event_id % {len(cells)} {branches} ELSE {cells[-1]} END"


def _spark_array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _editorial(spark, folder):
    e = tb.read_table(spark, folder, "events")
    empty = "CAST(array() AS ARRAY<STRING>)"
    span = F.struct(F.lit("body").alias("type"), F.lit("text").alias("text"), F.lit("note").alias("note"))
    return e.where(HAS).select(
        F.col("event_id").alias("article_id"),
        *[F.expr(x).alias(c) for c, x in COLUMNS.items()],
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("bias_confidence"),
        F.expr(_arrays(FRAMING, _spark_array, empty)).alias("framing_devices"),
        F.expr(_arrays(REASONS, _spark_array, empty)).alias("unclear_reasons"),
        F.when(F.col("event_id") % 9 == 0, F.array().cast("array<struct<type:string,text:string,note:string>>")).otherwise(F.array(span)).alias("evidence_spans"),
        F.when(F.col("event_id") % 10 > 1, F.col("ts")).alias("analyzed_at"),
    )


def _articles(spark, folder):
    e = tb.read_table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("cluster"), F.col("event_type").alias("source"),
        F.col("ts").alias("published_at"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("title"),
        F.lit("").alias("summary"),
    )


def _rows(spark, folder):
    return ed.with_summary(_articles(spark, folder), _editorial(spark, folder).drop("analyzed_at"))


def _joined(spark, folder):
    """Articles with the raw editorial columns, null where there is no analysis."""
    return _articles(spark, folder).join(_editorial(spark, folder).withColumnRenamed("article_id", "id"), "id", "left")


BASE_SQL = f"""
base AS (SELECT event_id AS id, user_id % 50 AS cluster, event_type AS source, ts AS published_at, event_type || ' ' || user_id AS title, {HAS} AS has_analysis,
  {', '.join(f'CASE WHEN {HAS} THEN {x} END AS {c}' for c, x in COLUMNS.items())},
  CASE WHEN {HAS} THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 END AS bias_confidence,
  CASE WHEN {HAS} THEN {_arrays(FRAMING, q.array, '[]')} ELSE [] END AS framing_devices,
  CASE WHEN {HAS} THEN {_arrays(REASONS, q.array, '[]')} ELSE [] END AS unclear_reasons,
  CASE WHEN {HAS} AND event_id % 9 <> 0 THEN 1 ELSE 0 END AS evidence_count,
  CASE WHEN {HAS} AND event_id % 10 > 1 THEN ts END AS analyzed_at FROM events),
shaped AS (SELECT id, cluster, source, published_at, title, has_analysis, coalesce(analysis_status, 'pending') AS analysis_status,
  coalesce(editorial_applicability, 'full') AS editorial_applicability, coalesce(article_type, 'unclear') AS article_type, coalesce(bias_label, 'unclear') AS bias_label,
  coalesce(tone_emotional, 'unclear') AS tone_emotional, coalesce(opinionatedness, 'unclear') AS opinionatedness, coalesce(rationale, 'Editorial analysis pending.') AS rationale,
  coalesce(bias_confidence, 0) AS bias_confidence, framing_devices, unclear_reasons, evidence_count, article_type_status, bias_status, tone_emotional_status, opinionatedness_status, framing_status FROM base),
flagged AS (SELECT *, analysis_status = 'completed' AND evidence_count = 0 AS missing_evidence, analysis_status = 'completed' AND bias_confidence < 0.45 AS low_confidence,
  analysis_status = 'failed' AS failed_analysis, bias_label = 'unclear' AS unclear_bias, list_contains(unclear_reasons, 'provider_missing') AS provider_missing,
  list_contains(unclear_reasons, 'mapping_loss') OR list_contains(unclear_reasons, 'repair_data_loss') AS mapping_loss, editorial_applicability = 'out_of_domain' AS out_of_domain,
  analysis_status = 'pending' AS pending_analysis FROM shaped),
rows AS (SELECT *, missing_evidence OR low_confidence OR failed_analysis OR unclear_bias OR provider_missing OR mapping_loss OR out_of_domain OR pending_analysis AS needs_review FROM flagged)"""
WITH = f"WITH {BASE_SQL}"
FLAGS = ("missing_evidence", "low_confidence", "failed_analysis", "unclear_bias", "provider_missing", "mapping_loss", "out_of_domain", "pending_analysis", "needs_review")


@catalogue.add("a18_review_flags", f"{WITH} SELECT id, {', '.join(FLAGS)} FROM rows")
def a18(spark, folder):
    return _rows(spark, folder).select("id", *[f"review_flags.{f}" for f in FLAGS])


@catalogue.add(
    "c15_editorial_summary",
    f"""{WITH} SELECT id, analysis_status, editorial_applicability, article_type, bias_label, bias_confidence, tone_emotional, opinionatedness, rationale,
       array_to_string(framing_devices, ',') AS framing_devices, evidence_count, needs_review FROM rows""",
)
def c15(spark, folder):
    return _rows(spark, folder).select(
        "id", "analysis_status", "editorial_applicability", "article_type", "bias_label", "bias_confidence", "tone_emotional",
        "opinionatedness", "rationale", F.array_join("framing_devices", ",").alias("framing_devices"), "evidence_count",
        "review_flags.needs_review",
    )


STRICT = "analysis_status = 'completed' AND editorial_applicability = 'full' AND bias_label <> 'unclear' AND bias_confidence >= 0.45"


@catalogue.add(
    "f12_status_buckets",
    f"""{WITH} SELECT id, {STRICT} AS strict,
      CASE WHEN analysis_status IN ('pending', 'failed') THEN analysis_status WHEN article_type = 'unclear' THEN 'unknown' WHEN editorial_applicability <> 'full' THEN editorial_applicability ELSE 'typed' END AS type_bucket,
      CASE WHEN analysis_status IN ('pending', 'failed') THEN analysis_status WHEN editorial_applicability <> 'full' THEN editorial_applicability WHEN bias_label = 'unclear' THEN 'unknown' WHEN low_confidence THEN 'low_confidence' ELSE 'typed' END AS bias_bucket FROM rows""",
)
def f12(spark, folder):
    return _rows(spark, folder).select(
        "id", ed.strict_bias_match().alias("strict"), ed.article_type_bucket().alias("type_bucket"), ed.bias_bucket().alias("bias_bucket")
    )


@catalogue.add(
    "f8_editorial_filter",
    f"{WITH} SELECT id, source, bias_label FROM base WHERE source = 'click' AND coalesce(analysis_status, 'pending') = 'pending' AND published_at >= TIMESTAMP '2024-01-05' AND published_at < TIMESTAMP '2024-01-20'",
)
def f8(spark, folder):
    rows = ed.filter_list(_joined(spark, folder), status="pending", date_from="2024-01-05", date_to="2024-01-19", source="click")
    return rows.select("id", "source", "bias_label")


@catalogue.add(
    "f9_work_list",
    f"{WITH} SELECT id, source FROM base WHERE published_at >= TIMESTAMP '2024-01-26' AND analysis_status = 'failed' ORDER BY published_at DESC, id DESC LIMIT 100",
)
def f9(spark, folder):
    return ed.work_list(_joined(spark, folder), "failed", AS_OF, 5, 100).select("id", "source")


@catalogue.add(
    "f9_work_counts",
    f"""{WITH} SELECT least(300, count(*) FILTER (coalesce(analysis_status, 'pending') = 'pending')) AS pending, least(300, count(*) FILTER (analysis_status = 'failed')) AS failed,
      least(300, count(*) FILTER (analysis_status = 'completed')) AS completed, least(300, count(*)) AS "any" FROM base WHERE published_at >= TIMESTAMP '2024-01-26'""",
)
def f9_counts(spark, folder):
    return ed.work_counts(_joined(spark, folder), AS_OF, 5, 300)


@catalogue.add(
    "l4_editorial_list",
    f"{WITH} SELECT id, bias_score, row_number() OVER (ORDER BY bias_score ASC NULLS FIRST, id) AS place FROM base ORDER BY place LIMIT 500",
)
def l4(spark, folder):
    from pyspark.sql import Window

    order = ed.list_order("bias_score_asc")
    rows = _joined(spark, folder).select("id", "bias_score").orderBy(*order).limit(500)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


TONE_MAP = "CASE tone_emotional WHEN 'measured' THEN 0.0 WHEN 'somewhat_emotional' THEN 0.5 WHEN 'critical' THEN 1.0 WHEN 'emotional' THEN 1.0 END"
BIAS_MAP = "CASE bias_label WHEN 'left' THEN -1.0 WHEN 'center_left' THEN -0.5 WHEN 'unclear' THEN 0.0 WHEN 'center' THEN 0.0 WHEN 'center_right' THEN 0.5 WHEN 'right' THEN 1.0 END"
OPINION_MAP = "CASE opinionatedness WHEN 'low' THEN 0.0 WHEN 'mixed' THEN 0.5 WHEN 'high' THEN 1.0 END"
METRICS_SQL = f"""
v AS (SELECT *, analysis_status = 'completed' AND editorial_applicability <> 'out_of_domain' AS usable,
  CASE WHEN opinionatedness_status = 'resolved' THEN CAST({OPINION_MAP} AS DOUBLE) END AS o, CASE WHEN tone_emotional_status = 'resolved' THEN CAST({TONE_MAP} AS DOUBLE) END AS t,
  CASE WHEN bias_status = 'resolved' THEN CAST({BIAS_MAP} AS DOUBLE) END AS b,
  CASE WHEN framing_status = 'resolved' THEN CASE len(framing_devices) WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 2.0::DOUBLE / 3 END END AS f FROM rows WHERE has_analysis),
m AS (SELECT cluster, source, count(*) FILTER (usable) AS usable_count, count(*) FILTER (usable AND editorial_applicability = 'full') AS full_count,
  count(*) FILTER (usable AND editorial_applicability = 'limited') AS limited_count, count(*) FILTER (usable AND low_confidence) AS low_confidence_count,
  {', '.join(f"CASE WHEN count({c}) FILTER (usable) >= 2 THEN round(avg({c}) FILTER (usable), 3) END AS {n}_index, count({c}) FILTER (usable) AS {n}_support" for c, n in (("o", "opinionatedness"), ("t", "tone"), ("b", "bias"), ("f", "framing")))}
  FROM v GROUP BY cluster, source),
e AS (SELECT *, CASE WHEN usable_count < 2 THEN 'insufficient_sample' WHEN full_count = 0 OR limited_count >= full_count THEN 'limited' ELSE 'eligible' END AS eligibility FROM m)"""


@catalogue.add(
    "a16_source_compare",
    f"""{WITH}, {METRICS_SQL} SELECT cluster, source, usable_count, full_count, limited_count, low_confidence_count, eligibility,
      opinionatedness_support, tone_support, bias_support, framing_support,
      CASE WHEN usable_count >= 3 AND eligibility = 'eligible' AND low_confidence_count = 0 THEN 'high' WHEN usable_count < 2 THEN 'insufficient'
        WHEN eligibility = 'limited' OR limited_count > 0 THEN 'low' WHEN low_confidence_count > 0 THEN 'moderate' ELSE 'high' END AS confidence_band FROM e""",
)
def a16(spark, folder):
    return ed.source_metrics(_rows(spark, folder)).select(
        "cluster", "source", "usable_count", "full_count", "limited_count", "low_confidence_count", "eligibility",
        "opinionatedness_support", "tone_support", "bias_support", "framing_support", "confidence_band",
    )


@catalogue.add(
    "a16_source_indexes",
    f"""{WITH}, {METRICS_SQL} SELECT cluster, source, CAST(round(opinionatedness_index * 100) AS BIGINT) AS o, CAST(round(tone_index * 100) AS BIGINT) AS t,
      CAST(round(bias_index * 100) AS BIGINT) AS b, CAST(round(framing_index * 100) AS BIGINT) AS f FROM e""",
)
def a16_indexes(spark, folder):
    rows = ed.source_metrics(_rows(spark, folder))
    hundredths = lambda c, n: F.round(F.col(f"{c}_index") * 100).cast("long").alias(n)
    return rows.select("cluster", "source", hundredths("opinionatedness", "o"), hundredths("tone", "t"), hundredths("bias", "b"), hundredths("framing", "f"))


@catalogue.add(
    "a17_divergence",
    f"""{WITH}, {METRICS_SQL}, l AS (
      SELECT cluster, source, 'opinionatedness' AS dimension, 0.34 AS lo, 0.66 AS hi, opinionatedness_index AS x, opinionatedness_support AS s FROM e WHERE eligibility <> 'insufficient_sample'
      UNION ALL SELECT cluster, source, 'tone', 0.34, 0.66, tone_index, tone_support FROM e WHERE eligibility <> 'insufficient_sample'
      UNION ALL SELECT cluster, source, 'bias', 0.75, 1.25, bias_index, bias_support FROM e WHERE eligibility <> 'insufficient_sample'
      UNION ALL SELECT cluster, source, 'framing', 0.2, 0.35, framing_index, framing_support FROM e WHERE eligibility <> 'insufficient_sample'),
    p AS (SELECT a.cluster, a.dimension, a.source AS leading_source, b.source AS trailing_source, a.x - b.x AS delta, a.hi, a.s AS leading_support, b.s AS trailing_support,
      row_number() OVER (PARTITION BY a.cluster, a.dimension ORDER BY round(a.x - b.x, 3) DESC, a.source, b.source) AS rn
      FROM l a JOIN l b ON a.cluster = b.cluster AND a.dimension = b.dimension AND a.source <> b.source WHERE a.x - b.x >= a.lo AND a.s >= 2 AND b.s >= 2)
    SELECT cluster, dimension, leading_source, trailing_source, CASE WHEN delta >= hi THEN 'strong' ELSE 'moderate' END AS strength, leading_support, trailing_support FROM p WHERE rn = 1""",
)
def a17(spark, folder):
    signals = ed.divergence_signals(ed.source_metrics(_rows(spark, folder)))
    return signals.drop("delta")


@catalogue.add(
    "a14_source_breakdown",
    f"""{WITH}, x AS (SELECT cluster, source, unnest([{{'d': 'applicability', 'v': editorial_applicability}}, {{'d': 'article_type', 'v': article_type}}, {{'d': 'bias_label', 'v': bias_label}},
       {{'d': 'opinionatedness', 'v': opinionatedness}}, {{'d': 'tone_emotional', 'v': tone_emotional}}]) AS p FROM rows WHERE has_analysis)
    SELECT cluster, source, p.d AS dimension, p.v AS value, count(*) AS n FROM x GROUP BY ALL""",
)
def a14(spark, folder):
    return ed.source_breakdown(_rows(spark, folder))


@catalogue.add(
    "a14_source_summary",
    f"""{WITH}, d AS (SELECT cluster, source, id, unnest(framing_devices) AS device FROM rows WHERE has_analysis),
    c AS (SELECT cluster, source, device, count(*) AS n, min(id) AS first FROM d GROUP BY ALL),
    t AS (SELECT cluster, source, string_agg(device || '=' || n, ',' ORDER BY rn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY cluster, source ORDER BY n DESC, first, device) AS rn FROM c) WHERE rn <= 3 GROUP BY ALL)
    SELECT r.cluster, r.source, count(*) AS article_count, count(*) FILTER (has_analysis AND analysis_status = 'completed') AS analyzed_article_count,
      count(*) FILTER (has_analysis AND low_confidence) AS low_confidence, count(*) FILTER (has_analysis AND needs_review) AS needs_review, count(*) FILTER (has_analysis AND out_of_domain) AS out_of_domain,
      count(*) FILTER (has_analysis AND editorial_applicability = 'limited') AS limited, any_value(top) AS framing FROM rows r LEFT JOIN t ON t.cluster = r.cluster AND t.source = r.source GROUP BY r.cluster, r.source""",
)
def a14_summary(spark, folder):
    rows = ed.source_summary(_rows(spark, folder))
    framing = F.array_join(F.transform("top_framing_devices", lambda d: F.concat(d["device"], F.lit("="), d["n"].cast("string"))), ",")
    return rows.select("cluster", "source", "article_count", "analyzed_article_count", "low_confidence", "needs_review", "out_of_domain", "limited", framing.alias("framing"))


@catalogue.add(
    "a15_cluster_signals",
    f"""{WITH}, d AS (SELECT cluster, source, unnest(framing_devices) AS device FROM rows WHERE has_analysis),
    s AS (SELECT cluster, device, least(count(*), 4) AS support, count(DISTINCT source) AS sources FROM d GROUP BY ALL),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY support DESC, device) AS rn FROM s) WHERE rn <= 3 AND support >= 2),
    k AS (SELECT cluster, count(*) FILTER (analysis_status = 'completed') AS analyzed, count(DISTINCT source) AS sources, count(DISTINCT CASE WHEN has_analysis AND bias_label <> 'unclear' THEN bias_label END) AS labels FROM rows GROUP BY cluster)
    SELECT cluster, 'Framing device: ' || device AS label, CASE WHEN support >= 3 THEN 'strong' ELSE 'moderate' END AS strength, sources, support FROM t
    UNION ALL SELECT cluster, 'Framing signal is mixed', 'weak', sources, 0 FROM k WHERE analyzed > 0 AND cluster NOT IN (SELECT cluster FROM t)
    UNION ALL SELECT cluster, 'Bias labels are contested across the cluster', CASE WHEN analyzed >= 3 THEN 'moderate' ELSE 'weak' END, sources, 0 FROM k WHERE labels > 1""",
)
def a15(spark, folder):
    return ed.cluster_signals(_rows(spark, folder))


@catalogue.add(
    "f13_contract_violations",
    f"""{WITH} SELECT id, array_to_string(list_filter([
      CASE WHEN tone_emotional NOT IN ('calm', 'loaded', 'inflammatory', 'unclear') THEN 'tone_emotional_value' END,
      CASE WHEN opinionatedness NOT IN ('straight_reporting', 'interpretive', 'opinionated', 'activist', 'unclear') THEN 'opinionatedness_value' END,
      CASE WHEN NOT (article_type_confidence BETWEEN 0 AND 1) OR NOT (bias_confidence BETWEEN 0 AND 1) THEN 'confidence_range' END,
      CASE WHEN NOT (bias_score BETWEEN -1 AND 1) THEN 'bias_score_range' END,
      CASE WHEN bias_label = 'unclear' AND (abs(bias_score) > 0.2 OR bias_confidence > 0.6) THEN 'unclear_bias_not_neutral' END,
      CASE WHEN bias_label = 'center' AND abs(bias_score) > 0.3 THEN 'center_bias_not_neutral' END,
      CASE WHEN (bias_label IN ('left', 'center_left') AND bias_score > -0.1) OR (bias_label IN ('right', 'center_right') AND bias_score < 0.1) THEN 'bias_side' END,
      CASE WHEN bias_label NOT IN ('unclear', 'center') AND abs(bias_score - CASE bias_label WHEN 'left' THEN -0.65 WHEN 'center_left' THEN -0.35 WHEN 'right' THEN 0.65 ELSE 0.35 END) > 0.55 THEN 'bias_distance' END,
      CASE WHEN article_type = 'unclear' AND article_type_confidence > 0.6 THEN 'unclear_type_too_sure' END,
      CASE WHEN rhetorical_certainty = 'absolute' AND bias_confidence < 0.2 THEN 'absolute_without_confidence' END], lambda x: x IS NOT NULL), ',') AS violations FROM base WHERE has_analysis""",
)
def f13(spark, folder):
    rows = _editorial(spark, folder)
    return rows.select(F.col("article_id").alias("id"), F.array_join(ed.editorial_violations(), ",").alias("violations"))


@catalogue.add(
    "u6_state_transitions",
    """SELECT event_id AS article_id, CASE WHEN event_id % 4 = 0 THEN 'completed' WHEN event_id % 4 = 1 THEN 'failed' ELSE 'pending' END AS analysis_status,
      CASE WHEN event_id % 4 = 0 THEN 'opinion' WHEN event_id % 3 = 0 THEN 'unclear' ELSE 'news_report' END AS article_type,
      CASE WHEN event_id % 4 = 1 THEN substring('timeout: ' || repeat(event_type, 60), 1, 255) ELSE '' END AS failure_reason FROM events""",
)
def u6(spark, folder):
    from storyloom.operators import changes as ch

    e = tb.read_table(spark, folder, "events").select(F.col("event_id").alias("article_id"), "event_type")
    key = F.col("article_id")
    known = {c: F.lit(v) for c, v in ch.EDITORIAL_DEFAULTS.items()} | {"article_type": F.when(key % 3 == 0, "").otherwise("news_report")}
    stored = e.where(key % 2 == 0).select(
        "article_id", *[v.alias(c) for c, v in known.items()], F.lit("failed").alias("analysis_status"), F.lit("x").alias("failure_reason"), F.lit("old").alias("content_hash")
    )
    fresh = e.where(key % 2 == 1).select(
        "article_id", *[v.alias(c) for c, v in known.items()], F.lit("").alias("analysis_status"), F.lit("").alias("failure_reason"), F.lit("").alias("content_hash")
    )
    pending = ch.mark_pending(stored.unionByName(fresh), e.select("article_id", F.lit("new").alias("content_hash")))
    done = e.where(key % 4 == 0).select(
        "article_id", *[(F.lit("opinion") if c == "article_type" else F.lit(v)).alias(c) for c, v in ch.EDITORIAL_DEFAULTS.items()]
    )
    failed = e.where(key % 4 == 1).select("article_id", F.lit("timeout").alias("failure_class"), F.repeat("event_type", F.lit(60)).alias("failure_message"))
    return ch.apply_outcomes(pending, done, failed).select("article_id", "analysis_status", "article_type", "failure_reason")


# --- raw answers -------------------------------------------------------------------------------
CONFIDENCES = """CASE event_id % 4 WHEN 0 THEN '"high"' WHEN 1 THEN '0.4' WHEN 2 THEN '{"level": "odd", "score": 0.9}' ELSE '"certain"' END"""
FRAMINGS = """CASE event_id % 3 WHEN 0 THEN '["security", "odd", "corruption"]' WHEN 1 THEN '{"conflict": true, "notes": ["stability"]}' ELSE '"geopolitics"' END"""
SPANS = """CASE event_id % 4 WHEN 0 THEN '["a quoted span"]' WHEN 1 THEN '[{"location": "titular", "quote": "a headline", "function": "sets tone"}]'
  WHEN 2 THEN '{"text": "single span"}' ELSE '[]' END"""


def _answers(spark, folder):
    """Fenced JSON answers of several shapes, one per event."""
    e = tb.read_table(spark, folder, "events")
    text = lambda name, x: F.concat(F.lit(f'"{name}": "'), x.cast("string"), F.lit('"'))
    value = lambda name, x: F.concat(F.lit(f'"{name}": '), x)
    fields = [
        text("article_type", F.expr(_case(6, "breaking_news", "op-ed", "column", "Q&A", "odd kind", "feature"))),
        value("confidence", F.expr(CONFIDENCES)),
        text("bias_label", F.expr(_case(5, "center-left", "neutral", "right", "centre", "upwards"))),
        text("bias_score", F.expr("CAST(value / 500 AS DECIMAL(9, 3))")),
        value("tone_dimensions", F.concat(F.lit('{"accusatory": "'), F.expr(_case(3, "high", "moderate", "low")), F.lit('", "procedural": {"level": "moderate"}}'))),
        value("framing_devices", F.expr(FRAMINGS)),
        value("evidence_spans", F.expr(SPANS)),
        text("rationale", F.concat("event_type", F.lit(" coverage of user "), F.col("user_id").cast("string"), F.lit(" with enough text to judge"))),
    ]
    return e.select("event_id", F.concat(F.lit("```json\n{"), F.concat_ws(", ", *fields), F.lit("}\n```")).alias("answer"))


@catalogue.add("c13_editorial_normalize")
def c13(spark, folder):
    rows = raw.normalize(_answers(spark, folder), "event_id", "answer")
    return rows.select(
        "event_id", "error", "article_type", "article_type_confidence", "bias_label", "bias_score", "bias_confidence", "tone_emotional",
        "tone_target", "opinionatedness", "sensationalism", "rhetorical_certainty", F.array_join("framing_devices", ",").alias("framing_devices"),
        F.size("evidence_spans").alias("evidence_count"), "editorial_applicability", "bias_status", "framing_status",
        F.array_join("unclear_reasons", ",").alias("unclear_reasons"),
    )


@catalogue.add(
    "c13_canonical_fields",
    f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'news_report' WHEN 1 THEN 'opinion' WHEN 2 THEN 'opinion' WHEN 3 THEN 'interview' WHEN 4 THEN 'unclear' ELSE 'feature' END AS article_type,
      CASE event_id % 5 WHEN 0 THEN 'center_left' WHEN 2 THEN 'right' WHEN 3 THEN 'center' ELSE 'unclear' END AS bias_label,
      CASE event_id % 3 WHEN 0 THEN 'public_order_security,corruption_scandal' WHEN 1 THEN 'conflict,institutional_stability' ELSE 'strategic_geopolitics' END AS framing_devices,
      CASE event_id % 4 WHEN 3 THEN 0 ELSE 1 END AS evidence_count,
      CASE event_id % 3 WHEN 0 THEN 'inflammatory' WHEN 1 THEN 'loaded' ELSE 'calm' END AS tone_emotional,
      CASE event_id % 3 WHEN 0 THEN 'hostile' WHEN 1 THEN 'critical' ELSE 'neutral' END AS tone_target FROM events""",
)
def c13_fields(spark, folder):
    rows = raw.normalize(_answers(spark, folder), "event_id", "answer")
    return rows.select(
        "event_id", "article_type", "bias_label", F.array_join("framing_devices", ",").alias("framing_devices"),
        F.size("evidence_spans").alias("evidence_count"), "tone_emotional", "tone_target",
    )


@catalogue.add("a19_editorial_run_metrics")
def a19_editorial(spark, folder):
    return raw.run_metrics(raw.normalize(_answers(spark, folder), "event_id", "answer"))


@catalogue.add(
    "c14_applicability",
    """WITH t AS (SELECT doc_id, lower(substring(text, 1, 3000)) AS x, lower(text) AS whole FROM documents),
    r AS (SELECT doc_id, CASE WHEN length(trim(whole)) < 40 THEN 'insufficient_text'
      WHEN contains(whole, 'liga') OR contains(whole, 'gol') OR contains(whole, 'partido') OR contains(whole, 'entrenador') OR contains(whole, 'victoria') OR contains(whole, 'derrota') OR contains(whole, 'champions') THEN 'sports_recap'
      WHEN contains(whole, 'accidente') OR contains(whole, 'herido') OR contains(whole, 'muerto') OR contains(whole, 'emergencias') OR contains(whole, 'suceso') OR contains(whole, 'arma blanca') OR contains(whole, 'tráfico') THEN 'accident_crime_bulletin'
      WHEN contains(whole, 'precio') OR contains(whole, 'euros') OR contains(whole, 'ofertas') OR contains(whole, 'hoteles') OR contains(whole, 'viajar') OR contains(whole, 'gasolina') OR contains(whole, 'supermercado') THEN 'consumer_price_roundup'
      WHEN contains(whole, 'temperaturas') OR contains(whole, 'lluvia') OR contains(whole, 'cortes') OR contains(whole, 'aviso amarillo') OR contains(whole, 'servicio') THEN 'weather_or_service_info'
      WHEN contains(whole, 'procedural') OR contains(whole, 'votación') OR contains(whole, 'tribunal') OR contains(whole, 'congreso') THEN 'procedural_hard_news' ELSE 'general_editorial_content' END AS reason FROM t)
    SELECT doc_id, reason, CASE WHEN reason IN ('consumer_price_roundup', 'procedural_hard_news') THEN 'limited' WHEN reason = 'general_editorial_content' THEN 'full' ELSE 'out_of_domain' END AS applicability FROM r""",
)
def c14(spark, folder):
    docs = tb.read_table(spark, folder, "documents").select("doc_id", F.lower("text").alias("t"))
    scope, reason = raw.applicability(F.col("t"))
    return docs.select("doc_id", reason.alias("reason"), scope.alias("applicability"))


@catalogue.add("a28_replay_report")
def a28(spark, folder):
    """Replay answers against expectations derived from the same events (one family is wrong)."""
    answers = _answers(spark, folder)
    key = F.col("event_id")
    mode = F.when(key % 4 == 3, "normalization_error").otherwise("success")
    label = F.when(key % 5 == 0, "center_left").when(key % 5 == 2, "right").when(key % 5 == 3, "center")
    expected = answers.select("event_id", mode.alias("mode"), label.alias("bias_label"))
    return raw.replay_report(raw.replay(raw.normalize(answers, "event_id", "answer"), expected, "event_id"))


# --- explorer ----------------------------------------------------------------------------------
FILTERS = ex.ExplorerFilters(source="click", date_from="2024-01-10", date_to="2024-01-25", dimension="bias_label", value="left", search="1")
FILTER_SQL = "source = 'click' AND published_at >= TIMESTAMP '2024-01-10' AND published_at < TIMESTAMP '2024-01-26'"
MATCH_SQL = f"contains(title, '1') AND coalesce({STRICT.replace('bias_label <>', 'bias_label = ' + chr(39) + 'left' + chr(39) + ' AND bias_label <>')}, false)"


@catalogue.add("f6_explorer_filter", f"{WITH} SELECT id, published_at FROM base WHERE {FILTER_SQL} AND {MATCH_SQL}")
def f6(spark, folder):
    return ex.filtered(_joined(spark, folder), FILTERS).select("id", "published_at")


@catalogue.add(
    "l5_highlight_page",
    f"""{WITH} SELECT id, is_match, row_number() OVER (ORDER BY CASE WHEN is_match THEN 0 ELSE 1 END, published_at DESC, id DESC) AS place FROM (
      SELECT id, published_at, {MATCH_SQL} AND cluster = 7 AS is_match FROM base WHERE {FILTER_SQL}) ORDER BY place LIMIT 250""",
)
def l5(spark, folder):
    from dataclasses import replace

    from pyspark.sql import Window

    members = _articles(spark, folder).select("id", "cluster")
    rows = ex.filtered(_joined(spark, folder), replace(FILTERS, highlight=True, story=7), members)
    shown = ex.page(rows, 250, matched_first=True).select("id", "is_match", "published_at")
    order = Window.orderBy(F.when(F.col("is_match"), 0).otherwise(1), F.desc("published_at"), F.desc("id"))
    return shown.select("id", "is_match", F.row_number().over(order).cast("long").alias("place"))


@catalogue.add(
    "l5_page_summary",
    f"""{WITH}, m AS (SELECT *, {MATCH_SQL} AND cluster = 7 AS is_match, CAST(bias_confidence AS DOUBLE) AS x, CAST(cluster AS DOUBLE) AS y, CAST(id % 100 AS DOUBLE) AS z FROM base WHERE {FILTER_SQL}),
    f AS (SELECT *, coalesce(article_type, 'unclear') AS ty, coalesce(analysis_status, 'pending') AS st, CASE WHEN {STRICT} THEN bias_label END AS bi, CAST(cluster AS VARCHAR) AS cl FROM m)
    SELECT CASE WHEN grouping(ty) = 0 THEN 'article_type' WHEN grouping(st) = 0 THEN 'status' WHEN grouping(bi) = 0 THEN 'bias' WHEN grouping(cl) = 0 THEN 'cluster' ELSE 'total' END AS facet,
      coalesce(ty, st, bi, cl) AS value, count(*) AS n, count(*) FILTER (is_match) AS matched, min(published_at) AS first_at, max(published_at) AS last_at,
      min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z
    FROM f GROUP BY GROUPING SETS ((ty), (st), (bi), (cl), ()) HAVING value IS NOT NULL OR facet = 'total'""",
)
def l5_summary(spark, folder):
    """Total, bounds and facets of the highlighted explorer page."""
    from dataclasses import replace

    members = _articles(spark, folder).select("id", "cluster")
    rows = ex.filtered(_joined(spark, folder), replace(FILTERS, highlight=True, story=7), members)
    placed = rows.withColumns({"x": F.col("bias_confidence").cast("double"), "y": F.col("cluster").cast("double"), "z": (F.col("id") % 100).cast("double")})
    facets = {
        "article_type": F.coalesce("article_type", F.lit("unclear")), "status": F.coalesce("analysis_status", F.lit("pending")),
        "bias": F.when(ed.strict_bias_match(), F.col("bias_label")), "cluster": F.col("cluster").cast("string"),
    }
    return ex.page_summary(placed, facets)


@catalogue.add("a2_value_counts", f"{WITH} SELECT 'type' AS kind, coalesce(article_type, 'unclear') AS value, count(*) AS n FROM base GROUP BY ALL UNION ALL SELECT 'bias', bias_label, count(*) FROM base WHERE {STRICT} GROUP BY ALL")
def a2(spark, folder):
    rows = _joined(spark, folder)
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "value", "n")
    return kind(ex.type_counts(rows), "type").unionByName(kind(ex.bias_counts(rows), "bias"))


@catalogue.add(
    "a3_coverage_counts",
    f"""{WITH}, s AS (SELECT coalesce(analysis_status, 'pending') AS st, coalesce(editorial_applicability, 'full') AS ap, coalesce(bias_label, 'unclear') AS b, coalesce(bias_confidence, 0) AS c, coalesce(article_type, 'unclear') AS ty FROM base)
    SELECT count(*) AS total, count(*) FILTER (st = 'pending') AS pending, count(*) FILTER (st = 'failed') AS failed, count(*) FILTER (ty = 'unclear') AS unknown, count(*) FILTER (ap = 'limited') AS limited,
      count(*) FILTER (ap = 'out_of_domain') AS out_of_domain, count(*) FILTER (st = 'completed') AS bias_total_completed, count(*) FILTER (st = 'completed' AND c < 0.45) AS bias_low_confidence,
      count(*) FILTER (st = 'completed' AND b = 'unclear') AS bias_unknown, count(*) FILTER (st = 'pending') AS bias_pending, count(*) FILTER (st = 'failed') AS bias_failed,
      count(*) FILTER (ap = 'limited') AS bias_limited, count(*) FILTER (ap = 'out_of_domain') AS bias_out_of_domain FROM s""",
)
def a3(spark, folder):
    return ex.coverage(_joined(spark, folder))


@catalogue.add("a4_filter_values", "SELECT DISTINCT event_type AS value FROM events WHERE event_type <> ''")
def a4(spark, folder):
    return ex.distinct_values(tb.read_table(spark, folder, "events"), "event_type")


@catalogue.add(
    "jn2_story_membership",
    "SELECT event_id AS id FROM events WHERE user_id % 50 = 7",
)
def jn2(spark, folder):
    members = _articles(spark, folder).select("id", "cluster")
    return ex.filtered(_articles(spark, folder), ex.ExplorerFilters(story=7), members).select("id")


@catalogue.add(
    "jn1_point_rows",
    f"{WITH} SELECT b.id, b.source, b.article_type, round(CAST(e.embedding[1] AS DOUBLE), 5) AS x FROM base b JOIN embeddings e ON e.vec_id = b.id",
)
def jn1(spark, folder):
    points = tb.read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.round(F.col("embedding")[0].cast("double"), 5).alias("x"))
    return ex.point_rows(points, _articles(spark, folder), None, _editorial(spark, folder)).select("id", "source", "article_type", "x")


# --- stories over given groups -----------------------------------------------------------------
def _orders(spark, folder):
    """Orders as articles: the customer is the story, the priority the source, the status the tag."""
    o = tb.read_table(spark, folder, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("source"),
        F.col("o_orderdate").alias("published_at"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("about "), F.col("o_orderstatus")).alias("summary"), F.array("o_orderstatus").alias("tag_codes"), "o_totalprice",
    )
    return rows.drop("cluster"), rows.select("id", "cluster")


STORY_SQL = """
a AS (SELECT o_orderkey AS id, o_custkey AS cluster, o_orderpriority AS source, o_orderdate AS published_at, 'Order ' || o_orderkey AS title, 'about ' || o_orderstatus AS summary, o_orderstatus AS tag, o_totalprice FROM orders),
st AS (SELECT cluster, min(published_at) AS first_at, max(published_at) AS last_at, count(*) AS article_count, count(DISTINCT source) AS source_count FROM a GROUP BY cluster),
hd AS (SELECT cluster, title AS headline FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY published_at, id) AS rn FROM a) WHERE rn = 1),
sm AS (SELECT cluster, string_agg(summary, ' | ' ORDER BY seen_at, aid) AS summary_text FROM (SELECT cluster, summary, min(published_at) AS seen_at, min(id) FILTER (published_at = fp) AS aid FROM (SELECT *, min(published_at) OVER (PARTITION BY cluster, summary) AS fp FROM a) GROUP BY cluster, summary) GROUP BY cluster),
tg AS (SELECT cluster, tag AS primary_tag FROM (SELECT cluster, tag, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, min(id)) AS rn FROM a GROUP BY cluster, tag) WHERE rn = 1),
story AS (SELECT st.*, headline, summary_text, primary_tag FROM st JOIN hd USING (cluster) JOIN sm USING (cluster) JOIN tg USING (cluster))"""


def _stories(spark, folder):
    articles, members = _orders(spark, folder)
    return articles, members, stories.story_summaries(articles, members)


@catalogue.add("a8_story_summary", f"WITH {STORY_SQL} SELECT cluster, headline, summary_text, primary_tag, article_count, source_count, first_at, last_at FROM story")
def a8(spark, folder):
    return _stories(spark, folder)[2].select("cluster", "headline", "summary_text", "primary_tag", "article_count", "source_count", "first_at", "last_at")


PAIR_EDGES = "o_orderkey AS left_id, o_orderkey + 1 AS right_id"


@catalogue.add(
    "a9_membership_scores",
    """WITH m AS (SELECT o_orderkey AS id, o_custkey % 5 AS cluster FROM orders), n AS (SELECT max(o_orderkey) AS top FROM orders),
    e AS (SELECT a.o_orderkey AS l, a.o_orderkey + 1 AS r, (a.o_orderkey % 40 + 60) / 100.0::DOUBLE AS score, CASE WHEN a.o_orderkey % 3 = 0 THEN 'followup_penalty' END AS pen FROM orders a JOIN n ON a.o_orderkey < n.top),
    i AS (SELECT e.* FROM e JOIN m x ON x.id = l JOIN m y ON y.id = r WHERE x.cluster = y.cluster),
    s AS (SELECT id, count(*) AS c, avg(score) AS mean, max(score) AS best, string_agg(DISTINCT pen, ',') AS pens FROM (SELECT l AS id, score, pen FROM i UNION ALL SELECT r, score, pen FROM i) GROUP BY id)
    SELECT m.id, cluster, coalesce(c, 0) AS support_edge_count, round(coalesce(mean, 1), 6) AS membership_score, round(coalesce(best, 1), 4) AS best_support_score, coalesce(pens, '') AS penalties FROM m LEFT JOIN s USING (id)""",
)
def a9(spark, folder):
    o = tb.read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    key = F.col("o_orderkey")
    members = o.select(key.alias("id"), (F.col("o_custkey") % 5).alias("cluster"))
    pen = F.when(key % 3 == 0, F.array(F.lit("followup_penalty"))).otherwise(F.array().cast("array<string>"))
    reason = F.struct(((key % 40 + 60) / 100).alias("score"), pen.alias("penalties"), F.lit(False).alias("risky_bridge_pair"))
    edges = o.select(key.alias("left_id"), (key + 1).alias("right_id"), reason.alias("reason"))
    rows = stories.member_scores(members, edges)
    return rows.select(
        "id", "cluster", "support_edge_count", F.round("membership_score", 6).alias("membership_score"), "best_support_score",
        F.array_join("penalties", ",").alias("penalties"),
    )


def _lines(spark, folder):
    """Line items as entity mentions of an order."""
    li = tb.read_table(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 20).cast("string").alias("slug"), F.col("l_quantity").cast("long").alias("mention_count"),
        F.col("l_discount").alias("relevance"),
    )


ENTITY_SQL = """en AS (SELECT o_custkey AS cluster, CAST(l_suppkey % 20 AS VARCHAR) AS slug, count(DISTINCT l_orderkey) AS article_coverage_count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS mention_count,
  round(sum(l_discount), 4) AS aggregate_relevance_score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"""


@catalogue.add("a10_cluster_entities", f"WITH {ENTITY_SQL} SELECT * FROM en")
def a10(spark, folder):
    _, members = _orders(spark, folder)
    return stories.cluster_entities(members, _lines(spark, folder))


@catalogue.add("f7_story_filter", f"WITH {STORY_SQL} SELECT cluster FROM story s WHERE last_at >= TIMESTAMP '1995-01-01' AND first_at < TIMESTAMP '1996-01-01' AND cluster IN (SELECT cluster FROM a WHERE source = '1-URGENT' AND tag = 'F') AND (contains(lower(headline), '7') OR contains(lower(summary_text), '7') OR cluster IN (SELECT cluster FROM a WHERE source = '1-URGENT' AND tag = 'F' AND contains(lower(title), '7')))")
def f7(spark, folder):
    articles, members, made = _stories(spark, folder)
    return stories.filter_stories(
        made, members, articles, source="1-URGENT", tag="F", date_from="1995-01-01", date_to="1995-12-31", search="7"
    ).select("cluster")


@catalogue.add(
    "l2_story_page",
    f"""WITH {STORY_SQL}, {ENTITY_SQL}, p AS (SELECT * FROM story ORDER BY article_count DESC, source_count DESC, last_at DESC, cluster DESC LIMIT 20 OFFSET 20),
    t AS (SELECT cluster, string_agg(slug, ',' ORDER BY rn) AS top_entities FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY article_coverage_count DESC, aggregate_relevance_score DESC, slug) AS rn FROM en) WHERE rn <= 5 GROUP BY cluster),
    s AS (SELECT cluster, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM a GROUP BY cluster)
    SELECT p.cluster, headline, article_count, sources, top_entities FROM p LEFT JOIN t USING (cluster) LEFT JOIN s USING (cluster)""",
)
def l2(spark, folder):
    articles, members, made = _stories(spark, folder)
    rows = stories.story_page(made, members, articles, stories.cluster_entities(members, _lines(spark, folder)), 20, 20)
    return rows.select("cluster", "headline", "article_count", F.array_join("sources", ",").alias("sources"), F.array_join("top_entities", ",").alias("top_entities"))


@catalogue.add("l3_story_detail", f"WITH {STORY_SQL} SELECT id, source, title, published_at FROM a WHERE cluster = 8")
def l3(spark, folder):
    articles, members = _orders(spark, folder)
    return stories.story_detail(8, members.withColumn("membership_score", F.lit(1.0)), articles).select("id", "source", "title", "published_at")


@catalogue.add(
    "a1_facets",
    f"""WITH {STORY_SQL}, e AS (SELECT o_custkey AS cluster, CAST(l_suppkey % 20 AS VARCHAR) AS slug FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT 'source' AS facet, source AS value, count(DISTINCT cluster) AS clusters FROM a GROUP BY source UNION ALL SELECT 'tag', tag, count(DISTINCT cluster) FROM a GROUP BY tag
    UNION ALL (SELECT 'entity', slug, count(DISTINCT cluster) AS clusters FROM e GROUP BY slug ORDER BY clusters DESC, slug LIMIT 50)""",
)
def a1(spark, folder):
    articles, members = _orders(spark, folder)
    named = lambda df, facet, column: df.select(F.lit(facet).alias("facet"), F.col(column).alias("value"), "clusters")
    tags = articles.select("id", F.explode("tag_codes").alias("tag"))
    return (
        named(stories.facet_counts(members, articles, "source"), "source", "source")
        .unionByName(named(stories.facet_counts(members, tags, "tag"), "tag", "tag"))
        .unionByName(named(stories.facet_counts(members, _lines(spark, folder), "slug", 50), "entity", "slug"))
    )


@catalogue.add("a25_coverage_share", f"WITH {STORY_SQL} SELECT cluster, source, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY cluster) AS DOUBLE), 6) AS share FROM a GROUP BY cluster, source")
def a25(spark, folder):
    articles, members = _orders(spark, folder)
    return stories.coverage_share(members, articles)


@catalogue.add(
    "a27_story_report",
    f"""WITH {STORY_SQL}, {ENTITY_SQL}, p AS (SELECT * FROM story ORDER BY article_count DESC, source_count DESC, last_at DESC, cluster DESC LIMIT 10),
    t AS (SELECT cluster, string_agg(slug, ',' ORDER BY rn) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY article_coverage_count DESC, mention_count DESC, slug) AS rn FROM en) WHERE rn <= 8 GROUP BY cluster),
    s AS (SELECT cluster, string_agg(source || '=' || n, ',' ORDER BY source) AS sources FROM (SELECT cluster, source, count(*) AS n FROM a GROUP BY ALL) GROUP BY cluster)
    SELECT p.cluster, article_count, sources, entities FROM p LEFT JOIN t USING (cluster) LEFT JOIN s USING (cluster)""",
)
def a27(spark, folder):
    articles, members, made = _stories(spark, folder)
    rows = stories.story_report(made, members, articles, stories.cluster_entities(members, _lines(spark, folder)))
    flat = F.array_join(F.transform("sources", lambda s: F.concat(s["source"], F.lit("="), s["n"].cast("string"))), ",")
    return rows.select("cluster", "article_count", flat.alias("sources"), F.array_join(F.transform("entities", lambda e: e["slug"]), ",").alias("entities"))


@catalogue.add("l1_article_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200")
def l1(spark, folder):
    return tb.read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(200).limit(100)


@catalogue.add(
    "l8_cluster_first_selection",
)
def l8(spark, folder):
    articles, members, made = _stories(spark, folder)
    return ex.cluster_first_selection(articles.select("id", "source", "published_at"), members, made, 60, [F.desc("published_at"), F.desc("id")])


# --- evaluation --------------------------------------------------------------------------------
PR_SQL = """CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS p, CASE WHEN positives > 0 THEN tp / positives::DOUBLE ELSE 0 END AS r"""


@catalogue.add(
    "a20_pair_metrics",
    f"""WITH c AS (SELECT count(*) AS labeled, count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (quality = 1) AS predicted, count(*) FILTER (quality = 1 AND toxic = 1) AS tp,
      count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn FROM labels), x AS (SELECT *, {PR_SQL} FROM c)
    SELECT labeled, positives, predicted, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM x""",
)
def a20(spark, folder):
    rows = tb.read_table(spark, folder, "labels")
    return ev.pair_metrics(rows, F.col("quality") == 1, F.col("toxic") == 1)


@catalogue.add(
    "a21_cluster_metrics",
    f"""WITH m AS (SELECT vec_id, label AS g, vec_id % 12 AS p FROM embeddings),
    c AS (SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM m GROUP BY p, g)) AS tp, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM m GROUP BY p)) AS predicted,
      (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM m GROUP BY g)) AS positives, (SELECT count(DISTINCT p) FROM m) AS predicted_clusters, (SELECT count(DISTINCT g) FROM m) AS gold_clusters), x AS (SELECT *, {PR_SQL} FROM c)
    SELECT tp, predicted, positives, predicted_clusters, gold_clusters, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM x""",
)
def a21(spark, folder):
    e = tb.read_table(spark, folder, "embeddings")
    return ev.evaluate_clusters(
        e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 12).alias("cluster")), e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    )


LABELS_SQL = """
lab AS (SELECT least(doc_id, doc_id + 1 + doc_id % 3) AS left_id, doc_id + 1 + doc_id % 3 AS right_id, CASE WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'same_event' ELSE 'different_event' END AS label FROM labels),
prs AS (SELECT doc_id AS left_id, doc_id + 1 + doc_id % 3 AS right_id, doc_id % 60 + 1 AS rank, (doc_id % 97) / 97.0::DOUBLE AS score, doc_id % 11 = 0 AS blocked FROM documents WHERE doc_id % 4 <> 0)"""


def _label_tables(spark, folder):
    labels = tb.read_table(spark, folder, "labels")
    other = lambda c: F.col(c) + 1 + F.col(c) % 3
    named = labels.select(
        other("doc_id").alias("left_id"), F.col("doc_id").alias("right_id"),
        F.when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "same_event").otherwise("different_event").alias("label"),
    )
    docs = tb.read_table(spark, folder, "documents").select("doc_id").where("doc_id % 4 <> 0")
    score = (F.col("doc_id") % 97) / F.lit(97.0)
    block = F.when(F.col("doc_id") % 11 == 0, "blocked")
    pairs = docs.select(
        F.col("doc_id").alias("left_id"), other("doc_id").alias("right_id"), (F.col("doc_id") % 60 + 1).alias("rank"),
        F.struct(score.alias("score"), block.alias("hard_block")).alias("reason"), (block.isNull() & (score >= 0.55)).alias("accepted"), score.alias("score"),
    )
    return named, pairs


METRIC_COLUMNS = "labeled, positives, predicted, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1"


@catalogue.add(
    "jn9_label_join",
    f"""WITH {LABELS_SQL}, j AS (SELECT label = 'same_event' AS yes, coalesce(NOT blocked AND score >= 0.55, false) AS said FROM lab LEFT JOIN prs USING (left_id, right_id)),
    c AS (SELECT count(*) AS labeled, count(*) FILTER (yes) AS positives, count(*) FILTER (said) AS predicted, count(*) FILTER (said AND yes) AS tp, count(*) FILTER (said AND NOT yes) AS fp, count(*) FILTER (yes AND NOT said) AS fn FROM j),
    x AS (SELECT *, {PR_SQL} FROM c) SELECT {METRIC_COLUMNS} FROM x""",
)
def jn9(spark, folder):
    return ev.evaluate_pairs(*_label_tables(spark, folder))


@catalogue.add(
    "a22_candidate_recall",
    f"""WITH {LABELS_SQL}, j AS (SELECT rank FROM lab LEFT JOIN prs USING (left_id, right_id) WHERE label = 'same_event')
    SELECT count(*) AS positives, {', '.join(f'round(count(*) FILTER (rank <= {k}) / count(*)::DOUBLE, 4) AS recall_{k}' for k in ev.KS)} FROM j""",
)
def a22(spark, folder):
    return ev.candidate_recall(*_label_tables(spark, folder))


@catalogue.add(
    "a24_review_sweep",
    f"""WITH {LABELS_SQL}, t AS (SELECT unnest([0.25, 0.45, 0.55, 0.68]) AS threshold), j AS (SELECT CAST(threshold AS DOUBLE) AS threshold, label = 'same_event' AS yes, coalesce(NOT blocked AND score >= threshold, false) AS said
      FROM (SELECT * FROM lab WHERE label <> 'uncertain') LEFT JOIN prs USING (left_id, right_id) CROSS JOIN t),
    c AS (SELECT threshold, count(*) AS labeled, count(*) FILTER (yes) AS positives, count(*) FILTER (said) AS predicted, count(*) FILTER (said AND yes) AS tp, count(*) FILTER (said AND NOT yes) AS fp, count(*) FILTER (yes AND NOT said) AS fn FROM j GROUP BY threshold),
    x AS (SELECT *, {PR_SQL} FROM c) SELECT threshold, {METRIC_COLUMNS} FROM x""",
)
def a24(spark, folder):
    return ev.sweep(*_label_tables(spark, folder), [0.25, 0.45, 0.55, 0.68])


@catalogue.add(
    "a24_review_summary",
    f"""WITH l AS (SELECT CASE WHEN doc_id % 5 = 0 THEN '' WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'same_event' ELSE 'different_event' END AS label, doc_id % 2 = 0 AS said FROM labels),
    d AS (SELECT *, label = 'same_event' AS yes, label NOT IN ('', 'uncertain') AS decided FROM l),
    c AS (SELECT count(*) AS row_count, count(*) FILTER (label <> '') AS labeled_count, count(*) FILTER (decided) AS decided_count, count(*) FILTER (label = 'uncertain') AS uncertain_count,
      count(*) FILTER (decided AND said AND yes) AS tp, count(*) FILTER (decided AND said AND NOT yes) AS fp, count(*) FILTER (decided AND NOT said AND yes) AS fn, count(*) FILTER (decided AND NOT said AND NOT yes) AS tn,
      count(*) FILTER (decided AND said) AS predicted, count(*) FILTER (decided AND yes) AS positives FROM d), x AS (SELECT *, {PR_SQL} FROM c)
    SELECT row_count, labeled_count, decided_count, uncertain_count, tp, fp, fn, tn, predicted, positives, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM x""",
)
def a24_summary(spark, folder):
    labels = tb.read_table(spark, folder, "labels")
    label = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "same_event").otherwise("different_event")
    said = F.when(F.col("doc_id") % 2 == 0, "same_event").otherwise("different_event")
    return ev.review_summary(labels.select(label.alias("label"), said.alias("predicted_label")))


@catalogue.add(
    "l10_review_batch",
    f"""WITH {LABELS_SQL}, p AS (SELECT *, NOT blocked AND score >= 0.55 AS accepted FROM prs), u AS (
      (SELECT *, 'accepted_high' AS bucket, 0 AS place FROM p WHERE accepted ORDER BY score DESC, left_id, right_id LIMIT 6) UNION ALL
      (SELECT *, 'borderline', 1 FROM p ORDER BY abs(score - 0.55), score DESC, left_id, right_id LIMIT 8) UNION ALL
      (SELECT *, 'rejected_high', 2 FROM p WHERE NOT accepted ORDER BY score DESC, left_id, right_id LIMIT 6))
    SELECT left_id, right_id, min_by(bucket, place) AS bucket, round(any_value(score), 6) AS score, CASE WHEN any_value(accepted) THEN 'same_event' ELSE 'different_event' END AS predicted_label FROM u GROUP BY left_id, right_id""",
)
def l10(spark, folder):
    pairs = _label_tables(spark, folder)[1].select("left_id", "right_id", "score", "accepted")
    batch = ev.review_batch(pairs, 0.55, 20)
    return batch.select("left_id", "right_id", "bucket", F.round("score", 6).alias("score"), "predicted_label")


@catalogue.add(
    "a23_threshold_pairs",
    """WITH t AS (SELECT unnest([0.25, 0.55, 0.75]) AS threshold), p AS (SELECT (doc_id % 97) / 97.0::DOUBLE AS score, doc_id % 11 = 0 AS blocked FROM documents WHERE doc_id % 4 <> 0)
    SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (NOT blocked AND score >= threshold) AS accepted_pairs FROM p CROSS JOIN t GROUP BY threshold""",
)
def a23(spark, folder):
    from storyloom.operators.scoring import accepted

    pairs = _label_tables(spark, folder)[1]
    each = pairs.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.25, 0.55, 0.75)])))
    return each.groupBy("threshold").agg(F.count_if(accepted(F.col("threshold"))).alias("accepted_pairs"))


@catalogue.add(
    "a23_recluster_sweep",
    f"""WITH RECURSIVE {LABELS_SQL}, t AS (SELECT CAST(unnest([0.25, 0.55, 0.75, 0.95]) AS DOUBLE) AS threshold),
    art AS (SELECT doc_id AS id, doc_id - doc_id % 4 AS gold FROM documents),
    ok AS (SELECT threshold, left_id, right_id FROM prs JOIN t ON NOT blocked AND score >= threshold WHERE right_id IN (SELECT doc_id FROM documents)),
    e AS (SELECT threshold, left_id AS a, right_id AS b FROM ok UNION SELECT threshold, right_id, left_id FROM ok),
    reach AS (SELECT threshold, a AS id, a AS low FROM e UNION SELECT e.threshold, e.b, r.low FROM reach r JOIN e ON e.threshold = r.threshold AND e.a = r.id),
    comp AS (SELECT threshold, id, min(low) AS cluster FROM reach GROUP BY ALL),
    m AS (SELECT threshold, id, gold, coalesce(cluster, id) AS cluster FROM art CROSS JOIN t LEFT JOIN comp USING (threshold, id)),
    s AS (SELECT threshold, cluster, count(*) AS n FROM m GROUP BY ALL), g AS (SELECT threshold, gold, count(*) AS n FROM m GROUP BY ALL), c AS (SELECT threshold, cluster, gold, count(*) AS n FROM m GROUP BY ALL),
    r AS (SELECT threshold, (SELECT count(*) FROM ok WHERE ok.threshold = t.threshold) AS accepted_pairs, (SELECT count(*) FROM s WHERE s.threshold = t.threshold) AS clusters,
      (SELECT count(*) FROM s WHERE s.threshold = t.threshold AND n = 1) AS singletons, (SELECT count(*) FROM s WHERE s.threshold = t.threshold AND n > 1) AS multi_article_clusters,
      (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM s WHERE s.threshold = t.threshold) AS predicted, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM c WHERE c.threshold = t.threshold) AS tp,
      (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM g WHERE g.threshold = t.threshold) AS positives FROM t),
    q AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN positives > 0 THEN tp / positives ELSE 0 END AS rc FROM r)
    SELECT threshold, accepted_pairs, clusters, singletons, multi_article_clusters, predicted, tp, positives, round(p, 4) AS precision, round(rc, 4) AS recall,
      round(CASE WHEN p > 0 AND rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 4) AS f1 FROM q""",
)
def a23_recluster(spark, folder):
    """Components at four thresholds from one forest, measured against groups of four neighbouring ids."""
    docs = tb.read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") - F.col("doc_id") % 4).alias("cluster"))
    pairs = _label_tables(spark, folder)[1].join(docs.select(F.col("id").alias("right_id")), "right_id", "left_semi")
    return ev.component_sweep(docs, pairs, docs, [0.25, 0.55, 0.75, 0.95])


@catalogue.add(
    "jn10_snapshot_compare",
    """WITH b AS (SELECT o_orderpriority AS source, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY ALL), c AS (SELECT o_orderpriority AS source, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY ALL),
    m0 AS (SELECT o_orderpriority AS source, count(*) AS discovered, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 7 = 0) AS kept FROM orders WHERE year(o_orderdate) = 1996 GROUP BY o_orderpriority),
    m AS (SELECT *, CASE WHEN source = '1-URGENT' THEN NULL ELSE discovered END AS processed, CASE WHEN source = '5-LOW' THEN 12 ELSE 0 END AS noise FROM m0)
    SELECT source, b.n AS baseline_count, c.n AS current_count, c.n - b.n AS delta_abs, round((c.n - b.n) / b.n::DOUBLE * 100.0, 2) AS delta_pct,
      array_to_string(list_filter([CASE WHEN discovered >= 20 AND kept = 0 THEN 'zero_keep_after_discovery' END, CASE WHEN NOT (discovered >= 20 AND kept = 0) AND coalesce(processed, 0) >= 20 AND kept / processed::DOUBLE < 0.2 THEN 'low_keep_ratio' END,
        CASE WHEN noise >= 10 THEN 'high_noise_rejection:' || noise END, CASE WHEN processed IS NULL THEN 'missing_metrics:processed' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM b JOIN c USING (source) JOIN m USING (source)""",
)
def jn10(spark, folder):
    o = tb.read_table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "source")
    now = o.where(F.year("o_orderdate") == 1996)
    counts = now.groupBy("source").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0)).alias("kept")
    )
    metrics = counts.withColumns({
        "processed": F.when(F.col("source") != "1-URGENT", F.col("discovered")), "rejected_noise": F.when(F.col("source") == "5-LOW", 12).otherwise(0),
    })
    rows = ev.snapshot_comparison(o.where(F.year("o_orderdate") == 1995), now, metrics)
    return rows.select("source", "baseline_count", "current_count", "delta_abs", "delta_pct", F.array_join("warnings", ",").alias("warnings"))

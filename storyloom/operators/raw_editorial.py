"""From raw model answers to canonical editorial rows.

The answers are semi-structured JSON: a field may be a text, a number, a list or an object. They
stay variants inside Spark; every repair is an expression over the variant, aliases are map
literals, and rows that cannot be repaired go to a quarantine with their reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import taxonomy as tax
from storyloom.functions import measures as ms
from storyloom.functions import text as tx
from storyloom.operators import editorial as ed
from storyloom.operators.ranking import pinned

FRAMING_CAP, EVIDENCE_CAP, HINT_CAP = 12, 6, 12
DEFAULT_NOTE = "quoted evidence span"
PLAIN_NOTE = "quoted evidence span from article body"
FALLBACK_RATIONALE = (
    "Normalized conservatively from raw model output because the original rationale was missing or too short."
)
# fixed values: raw text fields and their length limits
TEXT_LIMITS = {
    "article_type": 120, "bias_label": 80, "tone_emotional": 80, "tone_target": 80, "opinionatedness": 80,
    "sensationalism": 80, "rhetorical_certainty": 80,
}
# fixed values: object keys that may hold the wanted text, in order
TEXT_KEYS = {
    "rationale": (("summary", "description", "rationale", "justification", "framing_summary"), 12),
    "notes": (("summary", "description", "note", "classification_notes", "source_treatment"), 3),
    "uncertainty_reason": (("summary", "description", "reason"), 3),
}
CONFIDENCE_KEYS = ("value", "score", "confidence", "level", "label")
CHOICE_KEYS = ("value", "valence", "level", "label", "description")
HINT_KEYS = ("description", "label", "value", "level")
BIAS_KEYS = ("direction", "bias", "bias_type", "bias_direction", "position", "orientation")
BIAS_HINT_KEYS = (
    "position", "orientation", "description", "evidence", "justification", "notes", "framing_summary",
    "source_treatment", "classification_notes",
)
# fixed values: tone dimensions that answer a question, in order of preference
TONE_SOURCES = {
    "tone_emotional": ("emotionality", "emotional_valence", "overall_tone", "overall", "emotional_tone",
                       "emotional_charge", "dramatic", "sentiment"),
    "tone_target": ("target", "polarity", "government_assessment", "sentiment"),
    "opinionatedness": ("opinionatedness", "style", "neutral_reporting", "partisan", "subjectivity", "analytical",
                        "informational_balance"),
    "sensationalism": ("sensationalism", "alarmism", "loaded_language"),
    "rhetorical_certainty": ("rhetorical_certainty", "certainty", "confidence"),
}
DIRECT_TONES = ("emotionality", "emotional_valence", "target", "polarity", "opinionatedness", "style",
                "sensationalism", "alarmism", "rhetorical_certainty", "certainty")
STRENGTHS = {
    3: ("very_high", "extreme", "explicit", "hostile", "positive_legitimizing", "high", "strong", "critical",
        "accusatory", "implied"),
    2: ("medium", "moderate", "mixed", "present", "partial"),
    1: ("low", "mild", "subtle", "neutral", "none", "absent"),
}
BALANCE_KEYS = ("neutral_reporting", "informational_balance")
EMPTY_FRAMING_KEYS = ("", "main_narrative", "key_framing_elements", "balance", "sources_represented", "device_1",
                      "device_2", "device_3")
FIELDS = (*TEXT_LIMITS, "article_type_confidence", "bias_confidence", "confidence", *TEXT_KEYS, "ideological_bias_framing", "bias_score",
          "tone_dimensions", "framing_devices", "evidence_spans")
_NO_TEXTS = "array<string>"


def let(value: Column, body) -> Column:
    """body(value) with the value bound once, so that nested expressions stay small."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


# --- variants ----------------------------------------------------------------------------------
def child(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def field(name: str) -> Column:
    """A field of the answer, once it is opened."""
    return F.col(f"field_{name}")


def kind(value: Column) -> Column:
    """STRING, OBJECT, ARRAY, BOOLEAN, NUMBER, or null for a missing or null value."""
    name = F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)
    names = {k: k for k in ("STRING", "OBJECT", "ARRAY", "BOOLEAN")}
    names |= {k: "NUMBER" for k in ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")}
    return lookup(names, name)


def as_text(value: Column) -> Column:
    """The text of a string variant, else null."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def filled(text: Column) -> Column:
    return F.nullif(tx.strip(text), F.lit(""))


def entries(value: Column) -> Column:
    """Key/value structs of an object."""
    pairs = F.try_variant_get(F.when(kind(value) == "OBJECT", value), "$", "map<string,variant>")
    return F.coalesce(F.map_entries(pairs), F.array().cast("array<struct<key:string,value:variant>>"))


def items(value: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(F.when(kind(value) == "ARRAY", value), "$", "array<variant>"), F.array().cast("array<variant>")
    )


def lookup(table: dict, key: Column) -> Column:
    """Value of a constant table (a literal that is folded once), null for other keys."""
    flat = ";".join(f"{k}={v}" for k, v in table.items())
    found = F.try_element_at(F.str_to_map(F.lit(flat), F.lit(";"), F.lit("=")), key)
    return found.cast("double") if all(isinstance(v, float) for v in table.values()) else found


def _underscored(text: Column) -> Column:
    return F.replace(F.lower(tx.strip(text)), F.lit(" "), F.lit("_"))


# --- repairs -----------------------------------------------------------------------------------
def confidence(value: Column, name: str, depth: int = 2) -> Column:
    """struct<value, dropped>: number, word or numeric text; objects are searched, best keys first."""
    text = F.lower(tx.strip(as_text(value)))
    parsed = F.coalesce(lookup(tax.CONFIDENCE_WORDS, text), F.try_to_number(text, F.lit("S9999D999999")).cast("double"),
                        F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), text.try_cast("double")))
    lost = F.array(F.lit(name))
    none = F.array().cast(_NO_TEXTS)
    result = lambda v, d: F.struct(v.cast("double").alias("value"), d.alias("dropped"))
    k = kind(value)
    out = (
        F.when(k.isNull() | ((k == "STRING") & (text == "")), result(F.lit(None), none))
        .when(k.isin("NUMBER", "BOOLEAN"), result(F.coalesce(F.try_variant_get(value, "$", "double"), F.lit(1.0)), none))
        .when(k == "STRING", result(parsed, F.when(parsed.isNull(), lost).otherwise(none)))
    )
    if depth > 1:
        named = F.array(*[F.struct(F.lit(key).alias("key"), child(value, key).alias("value")) for key in CONFIDENCE_KEYS])
        found = F.aggregate(
            F.concat(named, entries(value)),
            result(F.lit(None), none),
            lambda acc, e: F.when(acc["value"].isNotNull(), acc).otherwise(
                let(confidence(e["value"], name, depth - 1), lambda f: _join(acc, f))
            ),
        )
        out = out.when(
            k == "OBJECT",
            let(found, lambda f: F.when(f["value"].isNull(), result(f["value"], F.concat(f["dropped"], lost))).otherwise(f)),
        )
    return out.otherwise(result(F.lit(None), lost))


def _join(acc: Column, found: Column) -> Column:
    return F.struct(found["value"].alias("value"), F.concat(acc["dropped"], found["dropped"]).alias("dropped"))


def text_like(value: Column, name: str) -> Column:
    """struct<value, dropped>: a text, or the first long enough text of an object."""
    keys, shortest = TEXT_KEYS[name]
    options = [F.when(F.length(tx.strip(as_text(child(value, k)))) >= shortest, tx.strip(as_text(child(value, k)))) for k in keys]
    k = kind(value)
    found = F.when(k == "STRING", filled(as_text(value))).when(k == "OBJECT", F.coalesce(*options))
    lost = k.isNotNull() & (k != "STRING") & found.isNull()
    return F.struct(found.alias("value"), F.when(lost, F.array(F.lit(name))).otherwise(F.array().cast(_NO_TEXTS)).alias("dropped"))


def _bool_signal(key: Column, value: Column) -> Column:
    low = F.lower(tx.strip(key))
    return (
        F.when(low.isin(*BALANCE_KEYS), F.when(value, "false").otherwise("absent"))
        .otherwise(F.when(value, "true").otherwise("false"))
    )


def tone_choices(tones: Column) -> Column:
    """array<struct<key, choice, hint>> of the tone dimensions, each reduced to one text."""
    listed = F.transform(items(tones), lambda v, i: F.struct(F.concat(F.lit("item_"), i.cast("string")).alias("key"), v.alias("value")))
    pairs = F.concat(entries(tones), F.filter(listed, lambda e: kind(e["value"]) == "OBJECT"))
    boolean = lambda v: F.try_variant_get(v, "$", "boolean")

    def choice(e):
        nested = [
            F.coalesce(F.when(filled(as_text(child(e["value"], k))).isNotNull(), as_text(child(e["value"], k))),
                       F.when(kind(child(e["value"], k)) == "BOOLEAN", F.when(boolean(child(e["value"], k)), "true").otherwise("false")))
            for k in CHOICE_KEYS
        ]
        return F.when(kind(e["value"]) == "STRING", as_text(e["value"])).when(
            kind(e["value"]) == "BOOLEAN", _bool_signal(e["key"], boolean(e["value"]))
        ).otherwise(F.coalesce(*nested))

    def hint(e):
        nested = F.coalesce(*[filled(as_text(child(e["value"], k))) for k in HINT_KEYS])
        plain = F.when(kind(e["value"]) == "BOOLEAN", choice(e)).otherwise(filled(as_text(e["value"])))
        return F.when(~e["key"].isin(*DIRECT_TONES), F.concat(e["key"], F.lit("="), F.coalesce(plain, nested)))

    return F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), choice(e).alias("choice"), hint(e).alias("hint")))


def _usable_key(key: Column) -> Column:
    return ~_underscored(key).isin(*EMPTY_FRAMING_KEYS)


def framing_items(value: Column) -> Column:
    """array<string> of framing names; an entry that cannot be read is null."""

    def name_of(v):
        keys = ("device", "type", "description", "label", "name")
        texts = [F.when(F.length(tx.strip(as_text(child(v, k)))) >= 3, tx.strip(as_text(child(v, k)))) for k in keys]
        only = F.element_at(entries(v), 1)
        promoted = F.when((F.size(entries(v)) == 1) & (kind(only["value"]) == "ARRAY") & _usable_key(only["key"]), only["key"])
        return F.when(kind(v) == "STRING", as_text(v)).when(kind(v) == "OBJECT", F.coalesce(promoted, *texts))

    def of_entry(e):
        is_flag = kind(e["value"]) == "BOOLEAN"
        wanted = _usable_key(e["key"]) & F.when(is_flag, F.try_variant_get(e["value"], "$", "boolean")).otherwise(True)
        head = F.when(wanted, F.array(e["key"])).otherwise(F.array().cast(_NO_TEXTS))
        tail = F.when(kind(e["value"]) == "ARRAY", F.transform(items(e["value"]), name_of)).when(
            kind(e["value"]).isin("OBJECT", "STRING"), F.array(name_of(e["value"]))
        ).otherwise(F.array().cast(_NO_TEXTS))
        return F.concat(head, tail)

    k = kind(value)
    return (
        F.when(k == "ARRAY", F.transform(items(value), name_of))
        .when(k == "OBJECT", F.flatten(F.transform(entries(value), of_entry)))
        .when(k.isNotNull(), F.array(name_of(value)))
        .otherwise(F.array().cast(_NO_TEXTS))
    )


_SPAN = "array<struct<type:string,text:string,note:string,plain:boolean>>"


def evidence_items(value: Column) -> Column:
    """array of spans; an entry that cannot be read has a null text."""

    def first(v, *keys):
        return F.coalesce(*[F.nullif(as_text(child(v, k)), F.lit("")) for k in keys])

    def span(v):
        plain = kind(v) == "STRING"
        return F.struct(
            F.when(~plain, first(v, "type", "location")).alias("type"),
            F.when(plain, as_text(v)).otherwise(first(v, "text", "span", "quote", "context")).alias("text"),
            F.when(~plain, first(v, "note", "explanation", "justification", "function")).alias("note"),
            plain.alias("plain"),
        )

    single = F.lit(False)
    for key in ("text", "span", "quote", "context"):
        single = single | child(value, key).isNotNull()
    k = kind(value)
    values = F.filter(F.transform(entries(value), lambda e: e["value"]), lambda v: kind(v).isNotNull())
    return (
        F.when(k == "ARRAY", F.transform(items(value), span))
        .when((k == "OBJECT") & single, F.array(span(value)))
        .when(k == "OBJECT", F.transform(values, span))
        .when(k.isNotNull(), F.array(span(value)))
        .otherwise(F.array().cast(_SPAN))
    )


def canonical_spans(spans: Column) -> Column:
    def clean(s):
        kind_ = F.lower(tx.strip(F.coalesce(s["type"], F.lit("body"))))
        kind_ = F.coalesce(lookup(tax.ALIASES["evidence_type"], kind_), kind_)
        note = tx.strip(F.coalesce(s["note"], F.lit(DEFAULT_NOTE)))
        return F.struct(
            F.when(kind_.isin(*tax.EVIDENCE_TYPES), kind_).otherwise("body").alias("type"),
            F.substring(tx.strip(s["text"]), 1, 400).alias("text"),
            F.when(s["plain"], PLAIN_NOTE).when(F.length(note) < 3, DEFAULT_NOTE).otherwise(F.substring(note, 1, 240)).alias("note"),
        )

    long_enough = F.filter(spans, lambda s: F.length(tx.strip(s["text"])) >= 3)
    return F.slice(F.transform(long_enough, clean), 1, 3)


def choose(text: Column, dimension: str) -> Column:
    """Canonical value of a raw text; unknown and missing ones are 'unclear'."""
    raw = _underscored(text)
    value = F.coalesce(lookup(tax.ALIASES[dimension], raw), raw)
    return F.when(filled(text).isNotNull() & value.isin(*tax.ALLOWED[dimension]), value).otherwise("unclear")


# --- job ---------------------------------------------------------------------------------------
def _tone(name: str) -> Column:
    return F.try_element_at("tone_map", F.lit(name))


def _strength(*names: str) -> Column:
    text = F.coalesce(*[F.nullif(_underscored(_tone(n)), F.lit("")) for n in names])
    rank = F.when(text.isNull(), 0)
    for level, known in STRENGTHS.items():
        rank = rank.when(text.isin(*known), level)
    return rank.otherwise(2)


def _inferred() -> dict[str, Column]:
    accusing = F.greatest("accusatory", "critical")
    heated = F.greatest("accusatory", "critical", "partisan", "conflict")
    stirred = F.greatest("accusatory", "critical", "conflict")
    accountability, mobilization = F.col("accountability"), F.col("mobilization")
    procedural = F.col("procedural") >= 2
    has = lambda *parts: tx.any_term(F.coalesce(mobilization, F.lit("")), parts)
    return {
        "tone_emotional": F.when(heated >= 3, "inflammatory").when(heated >= 2, "loaded").when(procedural, "calm"),
        "tone_target": F.when(F.col("accusatory") >= 3, "hostile").when(accusing >= 2, "critical")
        .when(accountability.isNotNull() & ~accountability.isin("none", "neutral", "mixed"), "critical")
        .when(has("positive"), "supportive").when(procedural, "neutral"),
        "opinionatedness": F.when(has("legitimizing", "advocacy"), "activist")
        .when((F.col("partisan") >= 2) | (accusing >= 3), "opinionated").when(accusing >= 2, "interpretive")
        .when(procedural, "straight_reporting"),
        "sensationalism": F.when(stirred >= 3, "high").when(stirred >= 2, "medium").when(procedural, "low"),
        "rhetorical_certainty": F.when(accusing >= 3, "absolute").when(accusing >= 2, "assertive").when(procedural, "cautious"),
    }


def applicability(text: Column) -> tuple[Column, Column]:
    """(applicability, reason) of the lower-case text of an answer."""
    reason = F.when(F.length(tx.strip(text)) < 40, "insufficient_text")
    for name, terms in tax.OUT_OF_DOMAIN.items():
        reason = reason.when(tx.any_term(text, terms), name)
    reason = reason.when(tx.any_term(text, tax.PROCEDURAL), "procedural_hard_news").otherwise("general_editorial_content")
    scope = F.when(reason.isin("consumer_price_roundup", "procedural_hard_news"), "limited").when(
        reason == "general_editorial_content", "full"
    ).otherwise("out_of_domain")
    return scope, reason


def dimension_status(final: Column, raw: Column, hints: Column, scope: Column, dropped: Column, truncated: Column) -> Column:
    mixed = tx.any_term(F.lower(F.coalesce(raw, F.lit(""))), ("/", "mixed", "both"))
    return (
        F.when(scope == "out_of_domain", "out_of_domain")
        .when((final != "unclear") & mixed, "conflicted_signal")
        .when(final != "unclear", "resolved")
        .when(hints, "mapping_loss")
        .when(raw.isNull() & ~dropped, "provider_missing")
        .when(dropped | truncated, "mapping_loss")
        .otherwise("weak_signal_abstain")
    )


def framing_status(values: Column, unmapped: Column, scope: Column, dropped: Column) -> Column:
    known, lost = F.size(values) > 0, F.size(unmapped) > 0
    return (
        F.when(scope == "out_of_domain", "out_of_domain").when(known & lost, "conflicted_signal").when(known, "resolved")
        .when(lost | dropped, "mapping_loss").otherwise("weak_signal_abstain")
    )


def strict_status(final: Column, scope: Column) -> Column:
    """Status of a dimension when the answer followed the schema."""
    return F.when(scope == "out_of_domain", "out_of_domain").when(final != "unclear", "resolved").otherwise("weak_signal_abstain")


def _raw_error(whole: Column) -> Column:
    """Contract of the raw answer, a value of kind `whole`: shapes and lengths its opened fields may have."""
    problems = [F.when(whole.isNull() | (whole != "OBJECT"), "answer is not a JSON object")]
    for name, limit in TEXT_LIMITS.items():
        value = field(name)
        bad = kind(value).isNotNull() & ((kind(value) != "STRING") | (F.length(as_text(value)) > limit))
        problems.append(F.when(bad, f"raw payload validation failed: {name}"))
    for name in ("article_type_confidence", "bias_confidence", "confidence"):
        value = field(name)
        number = F.try_variant_get(value, "$", "double")
        bad = (kind(value) == "ARRAY") | ((kind(value) == "NUMBER") & ~number.between(0, 1)) | (F.length(as_text(value)) > 40)
        problems.append(F.when(bad, f"raw payload validation failed: {name}"))
    for name, limit in (("rationale", 1200), ("notes", 500), ("uncertainty_reason", 500)):
        value = field(name)
        bad = kind(value).isin("ARRAY", "NUMBER", "BOOLEAN") | (F.length(as_text(value)) > limit)
        problems.append(F.when(bad, f"raw payload validation failed: {name}"))
    return F.coalesce(*problems)


def normalize(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """Canonical fields, statuses, applicability and `error` per raw answer; nothing shuffles."""
    parsed = pinned(rows.select(key, F.try_parse_json(ms.json_block(F.col(raw))).alias("v")))
    # a child is a copy of its part of the answer, so each field is cut out once and not wherever it is named
    opened = pinned(parsed.select(key, kind(F.col("v")).alias("whole"), *[child(F.col("v"), n).alias(f"field_{n}") for n in FIELDS]))
    bias, score = field("ideological_bias_framing"), field("bias_score")
    score_text = tx.strip(as_text(score))
    score_value = F.when(kind(score) == "NUMBER", F.try_variant_get(score, "$", "double")).otherwise(score_text.try_cast("double"))
    read = pinned(opened.select(
        key,
        _raw_error(F.col("whole")).alias("raw_error"),
        *[filled(as_text(field(n))).alias(f"raw_{n}") for n in TEXT_LIMITS],
        *[confidence(field(n), n).alias(n) for n in ("article_type_confidence", "bias_confidence", "confidence")],
        confidence(F.when(kind(bias) == "OBJECT", child(bias, "confidence")), "ideological_bias_framing.confidence").alias("nested"),
        *[text_like(field(n), n).alias(n) for n in TEXT_KEYS],
        score_value.alias("score"),
        F.when(kind(score).isNotNull() & score_value.isNull(), F.array(F.lit("bias_score"))).otherwise(F.array().cast(_NO_TEXTS)).alias("score_lost"),
        F.when(kind(bias) == "STRING", filled(as_text(bias))).otherwise(
            F.coalesce(*[F.when(filled(as_text(child(bias, k))).isNotNull(), as_text(child(bias, k))) for k in BIAS_KEYS])
        ).alias("framed_bias"),
        F.when(kind(bias) == "STRING", F.array_compact(F.array(filled(as_text(bias))))).otherwise(
            F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), filled(as_text(child(bias, k)))) for k in BIAS_HINT_KEYS]))
        ).alias("bias_hints"),
        tone_choices(field("tone_dimensions")).alias("tones"),
        framing_items(field("framing_devices")).alias("framing_all"),
        evidence_items(field("evidence_spans")).alias("evidence_all"),
    ))
    return _finish(_resolve(read, key), key)


def _resolve(read: DataFrame, key: str) -> DataFrame:
    framing = F.slice("framing_all", 1, FRAMING_CAP)
    evidence = F.slice("evidence_all", 1, EVIDENCE_CAP)
    lost_parts = [F.col(f"{c}.dropped") for c in ("confidence", "article_type_confidence", "bias_confidence", *TEXT_KEYS, "nested")]
    lost_lists = [
        F.when(F.exists(framing, lambda f: f.isNull()), F.array(F.lit("framing_devices"))).otherwise(F.array().cast(_NO_TEXTS)),
        F.when(F.exists(evidence, lambda e: e["text"].isNull()), F.array(F.lit("evidence_spans"))).otherwise(F.array().cast(_NO_TEXTS)),
    ]
    truncated = F.array_compact(F.array(
        F.when(F.size("framing_all") > FRAMING_CAP, F.lit("framing_devices")),
        F.when(F.size("evidence_all") > EVIDENCE_CAP, F.lit("evidence_spans")),
    ))
    texts = F.array_compact(F.array(F.col("notes.value"), F.col("uncertainty_reason.value")))
    stated = F.filter("tones", lambda t: t["choice"].isNotNull())
    named = F.map_from_entries(F.transform(stated, lambda t: F.struct(t["key"], t["choice"])))
    staged = pinned(read.withColumn("tone_map", named).select(
        "*",
        F.array_compact(framing).alias("framing_raw"),
        F.filter(evidence, lambda e: e["text"].isNotNull()).alias("spans_raw"),
        F.concat(*lost_parts, "score_lost", *lost_lists).alias("dropped_fields"),
        truncated.alias("truncated_fields"),
        F.coalesce("raw_bias_label", "framed_bias").alias("bias_source"),
        F.coalesce("bias_confidence.value", "nested.value").alias("bias_sure"),
        F.slice(F.concat(F.filter(F.transform("tones", lambda t: t["hint"]), lambda h: h.isNotNull()), texts), 1, HINT_CAP).alias("tone_hints"),
        _strength("accusatory").alias("accusatory"), _strength("critical").alias("critical"),
        _strength("partisancy", "partisan").alias("partisan"), _strength("procedural").alias("procedural"),
        _strength("conflict_framing").alias("conflict"),
        F.nullif(_underscored(_tone("accountability_attribution")), F.lit("")).alias("accountability"),
        F.nullif(_underscored(_tone("mobilization_framing")), F.lit("")).alias("mobilization"),
    ))
    guess = _inferred()
    sources = {
        name: F.coalesce(F.col(f"raw_{name}"), *[F.nullif(_tone(k), F.lit("")) for k in keys], guess[name])
        for name, keys in TONE_SOURCES.items()
    }
    quoted = lambda t: F.when(t.isNull(), "None").otherwise(F.concat(F.lit("'"), t, F.lit("'")))
    as_listed = lambda s: F.when(s["plain"], quoted(s["text"])).otherwise(F.concat(
        F.lit("{'type': "), quoted(s["type"]), F.lit(", 'text': "), quoted(s["text"]), F.lit(", 'note': "), quoted(s["note"]), F.lit("}")))
    spans = F.slice("spans_raw", 1, 3)
    listed = F.when(F.size(spans) > 0, F.concat(F.lit("["), F.array_join(F.transform(spans, as_listed), ", "), F.lit("]")))
    whole = F.lower(F.concat_ws(" ", "raw_article_type", "rationale.value", "notes.value", "uncertainty_reason.value", listed))
    return pinned(staged.select(
        key, "raw_error", "raw_article_type", "article_type_confidence", "bias_source", "bias_sure", "confidence", "score",
        "bias_hints", "tone_hints", "dropped_fields", "truncated_fields", "framing_raw",
        "rationale", "notes", "uncertainty_reason",
        canonical_spans(F.col("spans_raw")).alias("evidence_spans"),
        *[s.alias(f"{n}_source") for n, s in sources.items()],
        whole.alias("whole"),
    ))


def _finish(rows: DataFrame, key: str) -> DataFrame:
    scope, why = applicability(F.col("whole"))
    table = {**{d: d for d in tax.FRAMING_DEVICES}, **tax.ALIASES["framing"]}
    # the reading stops at the fifth canonical value, so later names are not judged
    judged = F.aggregate(
        F.filter("framing_raw", lambda f: filled(f).isNotNull()),
        F.struct(F.array().cast(_NO_TEXTS).alias("known"), F.array().cast(_NO_TEXTS).alias("lost")),
        lambda acc, f: F.when(F.size(acc["known"]) >= 5, acc).otherwise(
            let(lookup(table, _underscored(f)), lambda m: F.struct(
                F.when(m.isNull(), acc["known"]).otherwise(F.array_union(acc["known"], F.array(m))).alias("known"),
                F.when(m.isNull(), F.array_append(acc["lost"], tx.strip(f))).otherwise(acc["lost"]).alias("lost"),
            ))
        ),
    )
    rows = pinned(rows.withColumn("judged", judged))
    values, unmapped = F.col("judged.known"), F.slice("judged.lost", 1, 12)
    rationale = F.coalesce(*[
        F.when(F.length(F.col(f"{c}.value")) >= 12, F.substring(F.col(f"{c}.value"), 1, 1200)) for c in ("rationale", "notes", "uncertainty_reason")
    ], F.lit(FALLBACK_RATIONALE))
    chosen = pinned(rows.select(
        "*", scope.alias("editorial_applicability"), why.alias("editorial_applicability_reason"),
        choose(F.col("raw_article_type"), "article_type").alias("article_type"),
        choose(F.col("bias_source"), "bias_label").alias("bias_label"),
        *[choose(F.col(f"{n}_source"), n).alias(n) for n in TONE_SOURCES],
        values.alias("framing_devices"), unmapped.alias("framing_unmapped"), rationale.alias("final_rationale"),
    ))
    scope = F.col("editorial_applicability")
    dropped, truncated = F.size("dropped_fields") > 0, F.size("truncated_fields") > 0
    hinted = F.size("tone_hints") > 0
    status = lambda final, raw, hints: dimension_status(F.col(final), F.col(raw), hints, scope, dropped, truncated)
    statuses = {
        "article_type_status": status("article_type", "raw_article_type", F.lit(False)),
        "bias_status": status("bias_label", "bias_source", F.size("bias_hints") > 0),
        **{f"{n}_status": status(n, f"{n}_source", hinted) for n in TONE_SOURCES},
        "framing_status": framing_status(F.col("framing_devices"), F.col("framing_unmapped"), scope, dropped),
    }
    shared = F.col("confidence.value")
    judged = pinned(chosen.withColumns({
        **statuses,
        "type_sure": ed.resolve_confidence(F.col("article_type_confidence.value"), shared, F.col("article_type"), 0.55),
        "sure": ed.resolve_confidence(F.col("bias_sure"), shared, F.col("bias_label"), 0.5),
        "bias_score": ed.resolve_bias_score(F.col("score"), F.col("bias_label")),
    }))
    weak = (F.col("bias_label") == "unclear") & (
        F.col("bias_source").isNull() | F.lower(tx.strip(F.col("bias_source"))).isin("unclear", "neutral", "none"))
    noted = F.array_intersect(F.array(*[F.col(s) for s in statuses]),
                              F.array(*[F.lit(s) for s in ("mapping_loss", "provider_missing", "weak_signal_abstain", "out_of_domain")]))
    reasons = F.array_sort(F.array_distinct(F.concat(noted, F.array_compact(F.array(
        F.when(scope == "out_of_domain", F.lit("out_of_domain")), F.when(scope == "limited", F.lit("limited_applicability")),
        F.when(weak, F.lit("semantic_weak_signal")), F.when(dropped | truncated, F.lit("repair_data_loss")),
    )))))
    final = judged.select(
        key, "raw_error", "article_type", F.col("type_sure").alias("article_type_confidence"), "bias_label", "bias_score",
        F.col("sure").alias("bias_confidence"), *TONE_SOURCES, "framing_devices", "evidence_spans",
        F.col("final_rationale").alias("rationale"), "editorial_applicability", "editorial_applicability_reason",
        *statuses, reasons.alias("unclear_reasons"), "dropped_fields", "truncated_fields", "framing_unmapped", "tone_hints",
    )
    broken = ed.editorial_violations()
    error = F.coalesce(
        F.col("raw_error"),
        F.when(F.size("evidence_spans") == 0, "normalization failed: no usable evidence_spans"),
        F.when(F.size(broken) > 0, F.concat(F.lit("final payload validation failed: "), F.array_join(broken, ","))),
    )
    return pinned(final.withColumn("error", error).drop("raw_error"))


def split(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, quarantine)."""
    return normalized.where("error IS NULL").drop("error"), normalized.where("error IS NOT NULL")


def run_metrics(normalized: DataFrame) -> DataFrame:
    """One row of counters for a normalization run."""
    ok = F.col("error").isNull()
    return normalized.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("analyzed_count"), F.count_if(~ok).alias("failed_count"),
        F.count_if(ok & (F.size("dropped_fields") > 0)).alias("rows_with_dropped_fields_count"),
        F.count_if(ok & F.array_contains("truncated_fields", "evidence_spans")).alias("rows_with_truncated_evidence_count"),
        F.count_if(ok & (F.col("bias_label") == "unclear")).alias("unclear_bias_count"),
        F.count_if(ok & (F.col("editorial_applicability") == "out_of_domain")).alias("out_of_domain_count"),
        F.count_if(ok & (F.col("editorial_applicability") == "limited")).alias("limited_applicability_count"),
        F.count_if(ok & (F.col("bias_status") == "mapping_loss")).alias("bias_mapping_loss_count"),
        F.count_if(ok & (F.col("bias_status") == "weak_signal_abstain")).alias("bias_weak_signal_count"),
        F.count_if(ok & (F.col("framing_status") == "mapping_loss")).alias("framing_mapping_loss_count"),
        F.count_if(ok & ((F.size("framing_unmapped") > 0) | (F.size("tone_hints") > 0))).alias("rows_with_unmapped_signals_count"),
    )


def status_counts(normalized: DataFrame) -> DataFrame:
    """(dimension, status, n) over the canonical rows."""
    columns = ("article_type_status", "bias_status", *[f"{n}_status" for n in TONE_SOURCES], "framing_status")
    pairs = F.explode(F.array(*[F.struct(F.lit(c.removesuffix("_status")).alias("dimension"), F.col(c).alias("status")) for c in columns]))
    return normalized.where("error IS NULL").select(pairs.alias("p")).select("p.*").groupBy("dimension", "status").agg(F.count(F.lit(1)).alias("n"))


# --- replay ------------------------------------------------------------------------------------
def replay(normalized: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Compare normalized rows with expectations: mismatches per case, verdict and bucket.

    expected: key, mode ('success' or 'normalization_error') and any canonical column to check
    (null means unchecked).
    """
    checks = [c for c in expected.columns if c not in (key, "mode")]
    want = expected.select(key, "mode", *[F.col(c).alias(f"want_{c}") for c in checks])
    joined = want.join(normalized, key, "left")
    failed = F.col("error").isNotNull()
    success = F.col("mode") == "success"
    wrong = [F.when(success & failed, "unexpected normalization error"), F.when(~success & ~failed, "expected an error")]
    wrong += [F.when(success & ~failed & F.col(f"want_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"want_{c}")), f"{c} mismatch") for c in checks]
    reasons = F.coalesce("unclear_reasons", F.array().cast(_NO_TEXTS))
    has = lambda r: F.array_contains(reasons, r)
    bucket = (
        F.when(~success, F.when(failed, "normalization_error").otherwise("unexpected_success"))
        .when(F.col("editorial_applicability") == "out_of_domain", "out_of_domain")
        .when(F.col("editorial_applicability") == "limited", "limited")
        .when(has("mapping_loss"), "mapping_loss").when(has("provider_missing"), "provider_missing")
        .when(has("weak_signal_abstain") | has("semantic_weak_signal"), "honest_abstention").otherwise("resolved_or_mixed")
    )
    mismatches = F.array_compact(F.array(*wrong))
    return joined.select(key, "mode", mismatches.alias("mismatches"), F.when(F.size(mismatches) == 0, "pass").otherwise("fail").alias("verdict"),
                         bucket.alias("bucket"), "editorial_applicability")


def replay_report(results: DataFrame) -> DataFrame:
    return results.groupBy("bucket", "editorial_applicability", "verdict").agg(F.count(F.lit(1)).alias("n"))

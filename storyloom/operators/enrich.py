"""Article enrichment: type, tags, key phrases, entities, canonical names, merged mentions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from storyloom import lexicons as lx
from storyloom.functions import text as tx
from storyloom.operators.changes import article_hash, needs_work
from storyloom.operators.ranking import pinned
from storyloom.session import cut_lineage

MAX_ENTITIES = 12
CAPITALISED_NAME = r"\b([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)+)\b"
# fixed values: relevance of a hit by kind and by presence in the title
LISTED_RELEVANCE = (0.8, 0.6)
NAME_RELEVANCE = (0.75, 0.55)


def article_type(section: Column, title: Column, summary: Column, rules: dict) -> tuple[Column, Column]:
    """(type, confidence); the first rule with a hit decides."""
    text = F.lower(F.concat_ws(" ", section, title, summary))
    kind, confidence = None, None
    for name, terms in rules.items():
        hit = tx.any_term(text, terms)
        if name == "opinion":
            value = F.when(F.contains(text, F.lit("editorial")), "editorial").otherwise(name)
            sure = F.when(F.contains(text, F.lit("editorial")), 0.98).otherwise(0.95)
        else:
            value, sure = F.lit(name), F.lit(0.8)
        kind = F.when(hit, value) if kind is None else kind.when(hit, value)
        confidence = F.when(hit, sure) if confidence is None else confidence.when(hit, sure)
    return kind.otherwise("news_report"), confidence.otherwise(0.7)


def tag_codes(section, tags, title, summary, section_tags: dict, keyword_tags: dict) -> Column:
    """Codes in rule order without repeats: the first is primary, up to three more follow."""
    text = F.lower(F.concat_ws(" | ", section, tags, title, summary))
    hits = [F.when(F.contains(text, F.lit(raw)), F.lit(code)) for raw, code in section_tags.items()]
    hits += [F.when(tx.any_term(text, terms), F.lit(code)) for code, terms in keyword_tags.items()]
    found = F.array_distinct(F.filter(F.array(*hits), lambda c: c.isNotNull()))
    return F.slice(found, 1, 4)


def key_phrases(title: Column) -> Column:
    pieces = F.transform(F.split(title, r"[,;:.]"), tx.strip)
    return F.slice(F.filter(pieces, lambda p: p != ""), 1, 3)


def classify(articles: DataFrame, rules: lx.EnrichRules = lx.EnrichRules()) -> DataFrame:
    """Add type, confidence, event flag, tag codes, key phrases, claims and content hash."""
    section, title, summary, tags = (F.col(c) for c in ("section", "title", "summary", "tags"))
    kind, confidence = article_type(section, title, summary, rules.article_types)
    claim = tx.strip(summary)
    return (
        articles.withColumn("article_type", kind)
        .withColumn("article_type_confidence", confidence)
        .withColumn("is_event_coverage", ~F.col("article_type").isin("opinion", "editorial"))
        .withColumn("tag_codes", tag_codes(section, tags, title, summary, rules.section_tags, rules.keyword_tags))
        .withColumn("key_phrases", key_phrases(title))
        .withColumn("claims", F.when(claim != "", F.array(claim)).otherwise(F.array().cast("array<string>")))
    )


def unknown_tags(rows: DataFrame, codes: str, tags: DataFrame) -> DataFrame:
    """Quarantine: rows that name a tag outside the canonical list."""
    exploded = rows.select("id", F.explode(F.array_distinct(codes)).alias("tag_code"))
    return exploded.join(tags.select("tag_code"), "tag_code", "left_anti")


def canonical_tags(spark: SparkSession) -> DataFrame:
    rows = [(i, code, name, group, f"Articles about: {name}", 10 * i) for i, (code, name, group) in enumerate(lx.CANONICAL_TAGS, 1)]
    return spark.createDataFrame(
        rows, "tag_id int, tag_code string, display_name string, tag_group string, description string, sort_order int"
    )


# --- entities ----------------------------------------------------------------------------------
def _listed_pattern(terms) -> str:
    return r"(?iU)\b(%s)\b" % "|".join(re.escape(t) for t in terms)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of one text in another."""
    removed = F.replace(text, part, F.lit(""))
    return F.when(F.length(part) == 0, F.lit(0).cast("long")).otherwise(
        ((F.length(text) - F.length(removed)) / F.length(part)).cast("long")
    )


def extract_entities(articles: DataFrame, rules: lx.EnrichRules = lx.EnrichRules(), counts: bool = True) -> DataFrame:
    """Up to twelve entities per article: listed names first by relevance, then capitalised names.

    Rows: id, entity_type, name, relevance, place and the hit counts in all texts, title, summary
    and body. Repeats of a listed name keep the place of the first hit and the spelling of the
    last; capitalised names keep the first spelling. All of it is array work inside the article's
    row, so no text is shuffled. Without counts the rows are id, entity_type and name in no order of
    their own: occurrences are then counted only where there are more than twelve names.
    """
    text = F.concat_ws(" ", "title", "summary", "article_text")

    def hits_of(kind, names):
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("entity_type"), F.trim(n).alias("name")))

    groups = []
    for kind, terms in rules.entity_terms.items():
        names = F.regexp_extract_all("text", F.lit(_listed_pattern(terms)), F.lit(1))
        groups.append(hits_of(kind, names))
    people = F.regexp_extract_all("text", F.lit("(?U)" + CAPITALISED_NAME), F.lit(1))
    skip = F.array(*[F.lit(w) for w in rules.person_articles])
    head_of = lambda name: F.lower(F.split(name, r"\s+")[0])
    groups.append(hits_of("person", F.filter(people, lambda n: ~F.array_contains(skip, head_of(n)))))
    beside = ["summary", "article_text"] if counts else []
    # pinned: a filter on a column that is still an expression would evaluate every pattern again
    hit = pinned(articles.select("id", "title", *beside, text.alias("text")).withColumn("hits", F.concat(*groups))).where(F.size("hits") > 0)
    low = F.lower("text")
    # words with a blank on both sides, so that a word is counted by a plain search
    spaced = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(low, F.lit(f"({tx.WORD})"), F.lit(1)), "  "), F.lit(" "))
    staged = hit.withColumn("keys", F.transform("hits", lambda h: F.concat_ws("|", h["entity_type"], F.lower(h["name"])))).withColumn("back", F.reverse("keys"))
    if counts:
        lowered = {f"low_{k}": F.lower(c) for k, c in (("title", "title"), ("summary", "summary"), ("body", "article_text"))}
        staged = staged.withColumns({"low": low, "tokens": spaced, **lowered}).drop("text", *beside)
    else:
        staged = staged.withColumn("tokens", F.when(F.size(F.array_distinct("keys")) > MAX_ENTITIES, spaced)).drop("text")

    # each step below is one array pass, so nothing is evaluated twice per entity
    places = F.transform(
        F.array_distinct("keys"),
        lambda k: F.struct(
            F.array_position("keys", k).cast("int").alias("first"),
            (F.size("keys") + 1 - F.array_position("back", k)).cast("int").alias("final"),
        ),
    )
    named = F.transform(
        places,
        lambda p: F.struct(
            p["first"].alias("first"),
            F.element_at("hits", p["first"])["entity_type"].alias("entity_type"),
            F.when(
                F.element_at("hits", p["first"])["entity_type"] == "person", F.element_at("hits", p["first"])["name"]
            ).otherwise(F.element_at("hits", p["final"])["name"]).alias("name"),
        ),
    )
    headed = F.transform(
        named, lambda e: F.struct(e.alias("e"), head_of(e["name"]).alias("head"), F.contains("title", e["name"]).alias("t"))
    )
    relevance = lambda e, t: F.when(e["entity_type"] != "person", F.when(t, LISTED_RELEVANCE[0]).otherwise(LISTED_RELEVANCE[1])).otherwise(
        F.when(t, NAME_RELEVANCE[0]).otherwise(NAME_RELEVANCE[1])
    )
    rated = F.transform(
        headed,
        lambda x: F.struct(
            (-relevance(x["e"], x["t"])).alias("worst"),
            (-occurrences(F.col("tokens"), F.concat(F.lit(" "), x["head"], F.lit(" ")))).alias("rare"),  # null without tokens
            x["e"]["first"].alias("first"),
            x["e"]["entity_type"].alias("entity_type"),
            x["e"]["name"].alias("name"),
            relevance(x["e"], x["t"]).alias("relevance"),
        ),
    )
    best = F.slice(F.array_sort(rated), 1, MAX_ENTITIES)

    def counted(e):
        part = F.lower(F.trim(e["name"]))
        return F.struct(
            e["entity_type"].alias("entity_type"), e["name"].alias("name"), e["relevance"].alias("relevance"),
            F.greatest(occurrences(F.col("low"), part), F.lit(1)).alias("n"), occurrences(F.col("low_title"), part).alias("nt"),
            occurrences(F.col("low_summary"), part).alias("ns"), occurrences(F.col("low_body"), part).alias("nb"),
        )

    # pinned: lambdas over a column that is still an expression would evaluate it per element
    if not counts:
        return pinned(staged).select("id", F.explode(best).alias("e")).select("id", "e.entity_type", "e.name")
    rows = pinned(staged).select("id", F.posexplode(F.transform(best, counted)).alias("at", "e"))
    return rows.select("id", "e.entity_type", "e.name", "e.relevance", (F.col("at") + 1).alias("place"), "e.n", "e.nt", "e.ns", "e.nb")


def canonicalize(entities: DataFrame, rules: lx.EnrichRules = lx.EnrichRules()) -> DataFrame:
    """Add canonical_name, normalized_name, slug and canonical_source from the alias list."""
    known = {f"{kind}|{key}": name for kind, key, name, _ in rules.aliases}
    pairs = [F.lit(x) for item in known.items() for x in item]
    table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    key = tx.lookup_key(F.col("name"))
    hit = F.try_element_at(table, F.concat_ws("|", "entity_type", key))
    canonical = F.coalesce(hit, F.trim("name"))
    return (
        entities.withColumn("canonical_name", canonical)
        .withColumn("normalized_name", tx.lookup_key(F.col("canonical_name")))
        .withColumn("slug", F.concat_ws("-", "entity_type", tx.slug(F.col("canonical_name"))))
        .withColumn("canonical_source", F.when(hit.isNotNull(), "alias_map").otherwise("rule"))
    )


def new_aliases(canonical: DataFrame, known: DataFrame, rules: lx.EnrichRules = lx.EnrichRules()) -> DataFrame:
    """(entity_type, normalized_name, alias, normalized_alias) pairs that are not stored yet."""
    listed = {}
    for kind, _, name, aliases in rules.aliases:
        listed.setdefault(f"{kind}|{name}", set()).update(aliases)
    parts = [c for k, v in listed.items() for c in (F.lit(k), F.array(*[F.lit(a) for a in sorted(v)]))]
    table = F.create_map(*parts) if parts else F.create_map().cast("map<string,array<string>>")
    extra = F.coalesce(
        F.try_element_at(table, F.concat_ws("|", "entity_type", "canonical_name")), F.array().cast("array<string>")
    )
    aliases = F.when(F.col("canonical_source") == "alias_map", F.array_append(extra, F.col("name"))).otherwise(F.array("name"))
    rows = canonical.select("entity_type", "normalized_name", F.explode(aliases).alias("alias")).withColumn(
        "normalized_alias", tx.lookup_key(F.col("alias"))
    )
    key = ["entity_type", "normalized_name", "normalized_alias"]
    distinct = rows.where(F.col("normalized_alias") != "").groupBy(*key).agg(F.min("alias").alias("alias"))
    return distinct.join(known.select(*key), key, "left_anti")


def mentions(canonical: DataFrame) -> DataFrame:
    """One row per (article, entity, spelling key): hit counts summed, best relevance, longest form."""
    longest = F.struct(F.length("surface"), -F.col("place"))
    rows = canonical.withColumn("surface", F.trim("name")).withColumn("mention_key", tx.lookup_key(F.col("name")))
    return rows.groupBy("id", "entity_type", "normalized_name", "slug", "mention_key").agg(
        F.sum("n").alias("mention_count"),
        F.sum("nt").alias("title_hits"),
        F.sum("ns").alias("summary_hits"),
        F.sum("nb").alias("body_hits"),
        F.max("relevance").alias("relevance"),
        F.max_by("surface", longest).alias("surface_form"),
    )


def enriched(articles: DataFrame, rules: lx.EnrichRules = lx.EnrichRules()) -> DataFrame:
    """Article rows with type, tags, phrases and the slugs of their entities (one shuffle)."""
    found = canonicalize(extract_entities(articles, rules, counts=False), rules)
    slugs = found.groupBy("id").agg(F.array_sort(F.collect_set("slug")).alias("entity_slugs"))
    return classify(articles, rules).join(slugs, "id", "left").withColumn(
        "entity_slugs", F.coalesce("entity_slugs", F.array().cast("array<string>"))
    )


@dataclass
class EnrichmentRun:
    """The tables of one enrichment run, and what was counted beside them once they are written."""

    analysis: DataFrame
    entities: DataFrame
    mentions: DataFrame
    aliases: DataFrame
    observed: dict[str, Observation]

    def write(self, folder: str) -> dict[str, int]:
        """Write the four tables as Parquet below the folder; returns the counters of the run.

        The counters come from the jobs that write (DataFrame.observe), so nothing is read a second time for them.
        """
        for name in ("analysis", "entities", "mentions", "aliases"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        found = {k: v for o in self.observed.values() for k, v in o.get.items()}
        found["skipped_count"] = found["article_count"] - found["enriched_count"]
        return found


def enrichment_run(articles: DataFrame, done: DataFrame, known_aliases: DataFrame, rules: lx.EnrichRules = lx.EnrichRules()) -> EnrichmentRun:
    """Enrich the articles whose content hash is missing in `done` (id, content_hash) or differs: types, tags and phrases,
    entities with their canonical names, mentions, and spellings that `known_aliases` does not hold yet.

    The entities are extracted once and written to shared storage, as three of the tables are made from them.
    """
    seen = {name: Observation(name) for name in ("articles", "analysis", "entities", "mentions", "aliases")}
    hashed = articles.withColumn("content_hash", article_hash()).observe(seen["articles"], F.count(F.lit(1)).alias("article_count"))
    work = cut_lineage(needs_work(hashed, done, "id", ["content_hash"]))
    entities = cut_lineage(canonicalize(extract_entities(work, rules), rules))
    slugs = entities.groupBy("id").agg(F.array_sort(F.collect_set("slug")).alias("entity_slugs"))  # twelve entities an article at most
    rows = classify(work, rules).join(slugs, "id", "left").withColumn("entity_slugs", F.coalesce("entity_slugs", F.array().cast("array<string>")))
    count = lambda name: F.count(F.lit(1)).alias(name)
    return EnrichmentRun(
        rows.observe(seen["analysis"], count("enriched_count"), F.count_if(F.size("tag_codes") == 0).alias("untagged_count"), F.count_if("is_event_coverage").alias("event_coverage_count")),
        entities.observe(seen["entities"], count("entity_count"), F.count_if(F.col("canonical_source") == "alias_map").alias("aliased_count")),
        mentions(entities).observe(seen["mentions"], count("mention_row_count"), F.coalesce(F.sum("mention_count"), F.lit(0)).alias("mention_count")),
        new_aliases(entities, known_aliases, rules).observe(seen["aliases"], count("new_alias_count")),
        seen,
    )

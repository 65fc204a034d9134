"""Registered queries for scans, corpus selection, discovery, upserts and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom import lexicons as lx
from storyloom.functions import text as tx
from storyloom.operators import changes as ch
from storyloom.operators import corpus, discovery, enrich
from storyloom.operators.ranking import pinned, round_robin, top_k
from storyloom.plans import entity_sql as es
from storyloom.plans import sqltext as q
from storyloom.plans import vocab
from storyloom.plans.registry import Catalogue
from storyloom.plans.text_queries import EMBEDDING_TEXT_SQL, PHRASES_SQL, TAGS_SQL, TYPES_SQL, _embedding_text
from storyloom.session import cut_lineage, shared_folder
from storyloom.sources import pages as pg
from storyloom.sources import tables as tb

catalogue = Catalogue()
AS_OF = "2024-01-31 00:00:00"
DAY = lambda c: F.date_format(c, "yyyy-MM-dd")


@catalogue.add(
    "src1_recent_rows",
    "SELECT event_id, user_id, event_type, value FROM events WHERE ts IS NOT NULL AND ts >= TIMESTAMP '2024-01-24 00:00:00'",
)
def src1(spark, folder):
    events = tb.read_table(spark, folder, "events")
    return tb.recent(events, AS_OF, 7, "ts").select("event_id", "user_id", "event_type", "value")


@catalogue.add(
    "f1_date_window",
    "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-26' AND DATE '2024-01-30'",
)
def f1(spark, folder):
    window = tb.date_window(as_of="2024-01-30", days_back=5)
    return tb.in_window(tb.read_table(spark, folder, "events"), window, "ts").select("event_id", "event_type")


def _decision_sql() -> str:
    r = vocab.CORPUS
    per_source = lambda table, columns: " OR ".join(
        f"(source = {q.quoted(s)} AND ({' OR '.join(q.any_term(c, t) for c in columns)}))" for s, t in table.items()
    )
    counts = {name: q.count_terms("blob", terms) for name, terms in r.buckets.items()}
    best = f"greatest({', '.join(counts.values())})"
    bucket = f"CASE WHEN {best} = 0 THEN ''" + "".join(f" WHEN {c} = {best} THEN '{n}'" for n, c in counts.items()) + " END"
    national = q.any_term("blob", r.national_terms)
    bonus = " + ".join(f"CASE WHEN source = '{s}' AND contains(path, '{t}') THEN {b} ELSE 0.0 END" for s, t, b in r.source_path_bonus)
    return f"""
    text_blob AS (
      SELECT *, {q.path('url')} AS path, lower(section) AS sec,
        lower(section) || ' ' || lower(title) || ' ' || lower(summary) || ' ' || lower(tags) || ' ' || {q.path('url')} AS blob,
        CAST((published_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS DATE) AS local_day
      FROM articles),
    scored AS (
      SELECT *, {bucket} AS raw_bucket,
        CAST(3.0 + CASE WHEN length(regexp_replace(article_text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) >= 1200 THEN 2.0 ELSE 0.5 END
          + CASE WHEN {national} THEN 1.5 ELSE 0.0 END + {bonus}
          - CASE WHEN {q.any_term('path', r.locality_paths)} AND NOT {national} THEN 2.0 ELSE 0.0 END AS DOUBLE) AS raw_score
      FROM text_blob),
    reasoned AS (
      SELECT *, CASE WHEN local_day IS NULL THEN 'missing_local_date'
        WHEN {q.any_term('path', r.excluded_paths)} THEN 'excluded_non_article_path'
        WHEN {q.any_term('sec', r.excluded_sections)} THEN 'excluded_section'
        WHEN {per_source(r.source_excluded_sections, ['sec'])} THEN 'excluded_source_section'
        WHEN {q.any_term('blob', r.excluded_text)} THEN 'excluded_article_type'
        WHEN {per_source(r.source_excluded_text, ['path', 'blob'])} THEN 'excluded_source_policy'
        WHEN {q.any_term('blob', r.soft_lifestyle)} THEN 'excluded_soft_lifestyle'
        WHEN raw_bucket = '' THEN 'excluded_no_hard_news_bucket'
        WHEN raw_score < 2.5 THEN 'excluded_locality_bias' ELSE 'eligible_hard_news' END AS reason
      FROM scored),
    decided AS (
      SELECT *, reason = 'eligible_hard_news' AS eligible,
        CASE WHEN reason IN ('eligible_hard_news', 'excluded_locality_bias') THEN raw_bucket ELSE '' END AS bucket,
        CASE WHEN reason IN ('eligible_hard_news', 'excluded_locality_bias') THEN raw_score ELSE 0 END AS score
      FROM reasoned),
    selection AS (
      SELECT d.*, r.selection_rank FROM decided d LEFT JOIN (
        SELECT id, row_number() OVER (PARTITION BY source, local_day ORDER BY score DESC, published_at, url) AS selection_rank
        FROM decided WHERE eligible) r USING (id))"""


DECISION_SQL = f"WITH {q.ARTICLES}, {_decision_sql()}"


def _selection(spark, folder):
    return corpus.build_selection(tb.articles(spark, folder), AS_OF, 30, 0, vocab.CORPUS)


@catalogue.add(
    "f2_eligibility",
    f"{DECISION_SQL} SELECT id, eligible, reason, score, strftime(local_day, '%Y-%m-%d') AS local_day FROM decided",
)
def f2(spark, folder):
    decided = corpus.decide(tb.articles(spark, folder), vocab.CORPUS)
    return decided.select("id", "eligible", "reason", "score", DAY("local_day").alias("local_day"))


@catalogue.add("f3_topic_bucket", f"{DECISION_SQL} SELECT raw_bucket AS bucket, count(*) AS n, sum(id)::BIGINT AS ids FROM scored GROUP BY ALL")
def f3(spark, folder):
    articles = tb.articles(spark, folder)
    low = lambda c: F.lower(F.col(c))
    blob = F.concat_ws(" ", low("section"), low("title"), low("summary"), low("tags"), tx.url_path(F.col("url")))
    bucket = corpus.topic_bucket(F.col("blob"), vocab.CORPUS.buckets)
    rows = articles.select("id", blob.alias("blob")).select("id", bucket.alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@catalogue.add(
    "w1_daily_rank",
    """SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day,
       row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""",
)
def w1(spark, folder):
    from storyloom.operators.ranking import ranked

    orders = tb.read_table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    step = ("desc", F.floor(F.col("o_totalprice") / 10_000))
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    rows = ranked(orders, ["o_orderpriority", "o_orderdate"], [step], order, "rank")
    return rows.select("o_orderkey", "o_orderpriority", DAY("o_orderdate").alias("day"), "rank")


@catalogue.add(
    "c17_corpus_selection",
    f"""{DECISION_SQL} SELECT id, source, strftime(local_day, '%Y-%m-%d') AS local_day, eligible, reason, bucket, score,
        selection_rank, 'matching-v2' AS profile_version FROM selection""",
)
def c17(spark, folder):
    return _selection(spark, folder).select(
        "id", "source", DAY("local_day").alias("local_day"), "eligible", "reason", "bucket", "score", "selection_rank", "profile_version"
    )


@catalogue.add(
    "a6_corpus_audit",
    f"""{DECISION_SQL},
    s AS (SELECT source, section, count(*) AS raw, count(selection_rank) AS picked FROM selection GROUP BY ALL),
    b AS (SELECT source, bucket, count(*) AS n FROM selection WHERE selection_rank IS NOT NULL GROUP BY ALL)
    SELECT t.source, raw_count, eligible_count, selected_count, raw_sections, selected_sections, selected_buckets FROM
     (SELECT source, count(*) AS raw_count, count(*) FILTER (eligible) AS eligible_count, count(selection_rank) AS selected_count FROM selection GROUP BY ALL) t
     LEFT JOIN (SELECT source, string_agg(section || '=' || raw, ',' ORDER BY section) AS raw_sections,
        string_agg(section || '=' || picked, ',' ORDER BY section) FILTER (picked > 0) AS selected_sections FROM s GROUP BY ALL) x USING (source)
     LEFT JOIN (SELECT source, string_agg(bucket || '=' || n, ',' ORDER BY bucket) AS selected_buckets FROM b GROUP BY ALL) y USING (source)""",
)
def a6(spark, folder):
    flat = lambda c: F.array_join(
        F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    ).alias(c)
    rows = corpus.audit(_selection(spark, folder))
    return rows.select(
        "source", "raw_count", "eligible_count", "selected_count",
        flat("raw_sections"), flat("selected_sections"), flat("selected_buckets"),
    )


# --- discovery ---------------------------------------------------------------------------------
TARGET_DAY = "2024-01-10"
SIGNALS = ("spam", "thon", "tion")
LAYERS = ["rss", "sitemap", "html"]
CANDIDATE_SQL = """
candidates AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, url,
    CASE page_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'sitemap' ELSE 'html' END AS origin,
    regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS source,
    CASE WHEN page_id % 3 = 0 THEN '2024-01-' || lpad(CAST(4 + page_id % 12 AS VARCHAR), 2, '0') ELSE '' END AS feed_pubdate
  FROM pages)"""


def _profiles(spark):
    rows = [
        ("en", ["/en/"], ["/en/9"], ["en/8"], ["en/7", "net"], [(["/en/1", "/en/2"], 1), (["/en/2"], 2)]),
        ("fr", [], ["/fr/1"], ["fr/2"], ["fr/3"], [(["/fr/"], 3)]),
        ("es", ["/es/5", "/es/1"], [], [], [], []),
    ]
    return spark.createDataFrame(rows, discovery.PROFILE_SCHEMA)


def _candidates(spark, folder):
    pages = tb.read_table(spark, folder, "pages")
    n = F.col("page_id")
    day = F.concat(F.lit("2024-01-"), F.lpad((n % 12 + 4).cast("string"), 2, "0"))
    rows = pages.select(
        "page_id", "url",
        F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("source"),
        F.when(n % 3 == 0, "rss").when(n % 3 == 1, "sitemap").otherwise("html").alias("origin"),
        F.when(n % 3 == 0, day).otherwise("").alias("feed_pubdate"),
    )
    return discovery.with_url_parts(rows)


def _decided(spark, folder):
    return discovery.decide_candidates(_candidates(spark, folder), _profiles(spark), TARGET_DAY, SIGNALS)


_INC = "CASE source WHEN 'en' THEN contains(path, '/en/') WHEN 'es' THEN contains(path, '/es/5') OR contains(path, '/es/1') ELSE false END"
_NATIONAL = q.any_term("path", SIGNALS)
DISCOVERY_SQL = f"""WITH {CANDIDATE_SQL},
c AS (SELECT *, {q.path('url')} AS path FROM candidates),
d AS (SELECT *, path || '  ' AS txt, {_INC} AS inc, {_NATIONAL} AS nat,
   CASE WHEN feed_pubdate <> '' THEN CAST(feed_pubdate AS DATE) END AS local_day,
   ({q.any_term('lower(url)', lx.NOISE_URL_FRAGMENTS)} OR {' OR '.join(f"suffix(path, '{s}')" for s in lx.ASSET_SUFFIXES)}) AS noise FROM c),
e AS (SELECT *, coalesce(local_day = DATE '{TARGET_DAY}', false) AS same, coalesce(abs(date_diff('day', local_day, DATE '{TARGET_DAY}')), 9999) AS age,
   CASE WHEN nat THEN 0 ELSE CASE source WHEN 'en' THEN CASE WHEN contains(path, '/en/1') OR contains(path, '/en/2') THEN 1 ELSE 0 END + CASE WHEN contains(path, '/en/2') THEN 2 ELSE 0 END
      WHEN 'fr' THEN CASE WHEN contains(path, '/fr/') THEN 3 ELSE 0 END ELSE 0 END END AS pen,
   CASE WHEN inc THEN 4 ELSE 0 END + CASE WHEN (source = 'en' AND (contains(txt, 'en/7') OR contains(txt, 'net'))) OR (source = 'fr' AND contains(txt, 'fr/3')) THEN 2 ELSE 0 END
     + CASE WHEN nat THEN 2 ELSE 0 END + CASE WHEN origin = 'rss' THEN 1 ELSE 0 END AS scope FROM d),
f AS (SELECT *, CASE WHEN noise THEN 'rejected_noise'
   WHEN source IN ('en', 'es') AND NOT inc AND NOT nat THEN 'rejected_scope'
   WHEN (source = 'en' AND contains(path, '/en/9')) OR (source = 'fr' AND contains(path, '/fr/1')) THEN 'rejected_scope'
   WHEN (source = 'en' AND contains(txt, 'en/8')) OR (source = 'fr' AND contains(txt, 'fr/2')) THEN 'rejected_article_type'
   WHEN age > 3 AND origin <> 'html' THEN 'rejected_stale'
   WHEN pen >= 3 AND scope < 4 THEN 'rejected_locality' ELSE 'accepted' END AS reason FROM e),
decided AS (SELECT page_id, url, origin, reason, reason = 'accepted' AS accepted,
   CASE WHEN reason IN ('accepted', 'rejected_locality') THEN scope ELSE 0 END AS scope_score,
   CASE WHEN reason IN ('accepted', 'rejected_locality') THEN pen ELSE 0 END AS locality_penalty,
   CASE WHEN reason IN ('rejected_scope', 'rejected_noise', 'rejected_article_type') THEN false ELSE same END AS same_local_day,
   CASE WHEN reason IN ('rejected_scope', 'rejected_noise', 'rejected_article_type') THEN 9999 ELSE age END AS age_days FROM f)"""
PRIORITY_SQL = "CASE WHEN same_local_day THEN 0 ELSE 1 END, scope_score DESC, age_days, locality_penalty, url"


@catalogue.add("f4_candidate_decision", f"{DISCOVERY_SQL} SELECT page_id, reason, accepted, scope_score, locality_penalty, same_local_day, age_days FROM decided")
def f4(spark, folder):
    return _decided(spark, folder).select(
        "page_id", "reason", "accepted", "scope_score", "locality_penalty", "same_local_day", "age_days"
    )


@catalogue.add(
    "f5_keep_local_day",
    """SELECT count(*) AS processed, count(*) FILTER (d = DATE '2024-01-10') AS kept, count(*) FILTER (d <> DATE '2024-01-10') AS discarded_by_date
       FROM (SELECT CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS DATE) AS d FROM events)""",
)
def f5(spark, folder):
    return discovery.keep_local_day(tb.read_table(spark, folder, "events"), TARGET_DAY, "ts")[1]


@catalogue.add("a26_layer_counters", f"""{DISCOVERY_SQL} SELECT origin, count(*) AS attempted, count(*) FILTER (accepted) AS accepted,
  count(*) FILTER (reason = 'rejected_noise') AS rejected_noise, count(*) FILTER (reason = 'rejected_scope') AS rejected_scope,
  count(*) FILTER (reason = 'rejected_stale') AS rejected_stale, count(*) FILTER (reason = 'rejected_locality') AS rejected_locality,
  count(*) FILTER (reason = 'rejected_article_type') AS rejected_article_type,
  count(*) FILTER (accepted AND same_local_day) AS same_local_day_candidates FROM decided GROUP BY ALL""")
def a26(spark, folder):
    return discovery.layer_counters(_decided(spark, folder))


@catalogue.add("l9_candidate_priority", f"{DISCOVERY_SQL} SELECT url, row_number() OVER (ORDER BY {PRIORITY_SQL}, page_id) AS place FROM decided WHERE accepted ORDER BY place LIMIT 100")
def l9(spark, folder):
    from pyspark.sql import Window

    best = _decided(spark, folder).where("accepted").orderBy(*discovery.priority_order(), "page_id").limit(100)
    order = Window.orderBy(*discovery.priority_order(), "page_id")
    return best.select("url", F.row_number().over(order).cast("long").alias("place"))


@catalogue.add(
    "w5_first_seen_links",
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref=["'']([^"'']+)["'']', 1, 'i')) AS h,
         generate_subscripts(regexp_extract_all(html, '<a\\b[^>]*?\\bhref=["'']([^"'']+)["'']', 1, 'i'), 1) AS pos FROM pages)
    SELECT h AS link, page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id, pos) AS rn FROM l) WHERE rn = 1""",
)
def w5(spark, folder):
    pages = tb.read_table(spark, folder, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*?\bhref=["']([^"']+)["']"""), F.lit(1))
    links = pages.select("page_id", F.posexplode(hrefs).alias("pos", "link")).withColumn("pos", F.col("pos") + 1)
    return discovery.first_seen(links, "link", ["page_id", "pos"])


@catalogue.add(
    "w6_layered_fallback",
    f"""{DISCOVERY_SQL},
    u AS (SELECT *, CASE origin WHEN 'rss' THEN 1 WHEN 'sitemap' THEN 2 ELSE 3 END AS layer FROM decided WHERE accepted),
    v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY layer) AS rn FROM u) WHERE rn = 1),
    p AS (SELECT layer, count(*) FILTER (same_local_day) AS n FROM v GROUP BY layer),
    o AS (SELECT layer FROM (SELECT layer, coalesce(sum(n) OVER (ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) WHERE before < 24)
    SELECT url, origin FROM v WHERE layer IN (SELECT layer FROM o) ORDER BY layer, {PRIORITY_SQL} LIMIT 60""",
)
def w6(spark, folder):
    return discovery.layered(_decided(spark, folder), LAYERS, 24, 60).select("url", "origin")


@catalogue.add(
    "l12_extraction_budget",
    """WITH p AS (SELECT page_id, length(html) % 6 = 0 AS failed,
         CAST('2024-01-' || lpad(CAST(9 + page_id % 3 AS VARCHAR), 2, '0') AS DATE) AS d FROM pages ORDER BY page_id LIMIT 120),
    r AS (SELECT *, coalesce(sum(CAST(failed AS INTEGER)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
    SELECT page_id, CASE WHEN failed THEN 'error' WHEN d = DATE '2024-01-10' THEN 'kept' ELSE 'discarded_by_date' END AS outcome FROM r WHERE before < 20""",
)
def l12(spark, folder):
    pages = tb.read_table(spark, folder, "pages")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 3 + 9).cast("string"), 2, "0")).cast("date")
    rows = pages.select("page_id", (F.length("html") % 6 == 0).alias("failed"), day.alias("local_day"))
    return discovery.extraction_budget(rows, TARGET_DAY, order="page_id").select("page_id", "outcome")


@catalogue.add("src6_pages_to_articles")
def src6(spark, folder):
    rows = pg.article_rows(tb.read_table(spark, folder, "pages"), pg.host(F.col("url")))
    return rows.select("source", "url", "title", F.length("article_text").alias("body_chars"), "tags")


# --- changes -----------------------------------------------------------------------------------
ORDER_FIELDS = ["o_orderstatus", "o_totalprice", "o_orderpriority"]


def _order_batches(spark, folder):
    """Stored rows (two thirds) and a batch that repeats keys: new, changed and equal rows."""
    o = tb.read_table(spark, folder, "orders").select("o_orderkey", *ORDER_FIELDS)
    key = F.col("o_orderkey")
    current = o.where(key % 3 != 0)
    changed = F.when(key % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    first = o.where(key % 3 != 1).withColumn("o_totalprice", changed).withColumn("pos", key)
    again = o.where(key % 10 == 0).withColumn("o_orderstatus", F.lit("X")).withColumn("pos", key + 10_000_000)
    return current, first.unionByName(again)


BATCH_SQL = """
current AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0),
batch AS (
  SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority, o_orderkey AS pos
  FROM orders WHERE o_orderkey % 3 <> 1
  UNION ALL SELECT o_orderkey, 'X', o_totalprice, o_orderpriority, o_orderkey + 10000000 FROM orders WHERE o_orderkey % 10 = 0)"""


@catalogue.add(
    "u1_upsert_orders",
    f"""WITH {BATCH_SQL}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos DESC) AS rn FROM batch) WHERE rn = 1)
    SELECT coalesce(l.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(l.o_orderstatus, c.o_orderstatus) AS o_orderstatus,
      coalesce(l.o_totalprice, c.o_totalprice) AS o_totalprice, coalesce(l.o_orderpriority, c.o_orderpriority) AS o_orderpriority,
      CASE WHEN l.o_orderkey IS NULL THEN 'kept' WHEN c.o_orderkey IS NULL THEN 'inserted'
        WHEN l.o_orderstatus = c.o_orderstatus AND l.o_totalprice = c.o_totalprice AND l.o_orderpriority = c.o_orderpriority THEN 'unchanged' ELSE 'updated' END AS status
    FROM current c FULL JOIN last l ON c.o_orderkey = l.o_orderkey""",
)
def u1(spark, folder):
    current, batch = _order_batches(spark, folder)
    return ch.upsert(current, batch, ["o_orderkey"], ORDER_FIELDS, "pos")


@catalogue.add(
    "u1_batch_statuses",
    f"""WITH {BATCH_SQL}, prior AS (
      SELECT b.*, lag(o_orderstatus) OVER w AS s0, lag(o_totalprice) OVER w AS p0, lag(o_orderkey) OVER w AS k0 FROM batch b WINDOW w AS (PARTITION BY o_orderkey ORDER BY pos)),
    judged AS (SELECT p.o_orderkey, p.pos, CASE
        WHEN k0 IS NOT NULL THEN CASE WHEN s0 = p.o_orderstatus AND p0 = p.o_totalprice THEN 'unchanged' ELSE 'updated' END
        WHEN c.o_orderkey IS NULL THEN 'inserted'
        WHEN c.o_orderstatus = p.o_orderstatus AND c.o_totalprice = p.o_totalprice THEN 'unchanged' ELSE 'updated' END AS status
      FROM prior p LEFT JOIN current c ON c.o_orderkey = p.o_orderkey)
    SELECT status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM judged GROUP BY ALL""",
)
def u1_statuses(spark, folder):
    current, batch = _order_batches(spark, folder)
    rows = ch.change_statuses(current, batch, ["o_orderkey"], ORDER_FIELDS, "pos")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@catalogue.add(
    "u2_patch_and_delete",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 0.5 ELSE o_totalprice END AS o_totalprice,
       (SELECT count(*) FROM lineitem WHERE l_orderkey % 7 <> 0) AS lines_left FROM orders WHERE o_orderkey % 7 <> 0""",
)
def u2(spark, folder):
    o = tb.read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    patches = o.where(key % 5 == 0).select(
        "o_orderkey", F.lit("P").alias("o_orderstatus"), F.when(key % 2 == 0, F.lit(0.5)).alias("o_totalprice")
    )
    lines = tb.read_table(spark, folder, "lineitem").select("l_orderkey")
    kept, children = ch.delete_cascade(
        ch.patch(o, patches, "o_orderkey"), o.where(key % 7 == 0), "o_orderkey", {"lines": (lines, "l_orderkey")}
    )
    left = children["lines"].agg(F.count(F.lit(1)).alias("lines_left"))
    return kept.join(F.broadcast(left))  # left is one row


@catalogue.add(
    "u3_vector_upsert",
    """SELECT vec_id AS article_id, len(embedding) AS embedding_dim, round(CAST(embedding[1] AS DOUBLE) * CASE WHEN vec_id % 2 = 0 AND vec_id % 3 = 0 THEN 2 ELSE 1 END, 5) AS first,
       CASE WHEN vec_id % 2 = 1 THEN 'kept' WHEN vec_id % 4 = 0 THEN 'inserted' WHEN vec_id % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS status FROM embeddings""",
)
def u3(spark, folder):
    v = tb.read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("article_id"), "embedding")
    rows = v.withColumn("embedding_model", F.lit("m")).withColumn("embedding_dim", F.size("embedding"))
    key = F.col("article_id")
    current = rows.where((key % 2 == 1) | (key % 4 != 0))
    scaled = F.transform("embedding", lambda x: (x * F.when(key % 3 == 0, 2.0).otherwise(1.0)).cast("float"))
    batch = rows.where(key % 2 == 0).withColumn("embedding", scaled).withColumn("at", key)
    merged = ch.upsert_vectors(current, batch, 64, ["embedding", "embedding_model", "embedding_dim"], "at")
    return merged.select("article_id", "embedding_dim", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), "status")


@catalogue.add(
    "u3_vector_violations",
    "SELECT vec_id AS article_id, CASE WHEN vec_id % 5 = 0 THEN 'wrong_dimension' ELSE 'not_finite' END AS violation FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 7 = 0",
)
def u3_violations(spark, folder):
    v = tb.read_table(spark, folder, "embeddings")
    key = F.col("vec_id")
    broken = F.when(key % 5 == 0, F.slice("embedding", 1, 63)).when(
        key % 7 == 0, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))
    ).otherwise(F.col("embedding"))
    rows = v.select(key.alias("article_id"), broken.alias("embedding"), F.lit("m").alias("embedding_model"))
    return ch.vector_violations(rows, 64).select("article_id", "violation")


STALE = "CASE WHEN doc_id % 6 = 0 THEN text || '!' ELSE text END"


@catalogue.add(
    "u4_changed_content",
    "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 4 = 0 OR doc_id % 6 = 0 OR doc_id % 5 = 0",
)
def u4(spark, folder):
    docs = tb.read_table(spark, folder, "documents").select("doc_id", "text")
    key = F.col("doc_id")
    rows = docs.select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), F.lit("m2").alias("model"))
    stored = docs.where(key % 4 != 0).select(
        "doc_id", tx.content_hash(F.expr(STALE)).alias("content_hash"), F.when(key % 5 == 0, "m1").otherwise("m2").alias("model")
    )
    return ch.needs_work(rows, stored, "doc_id", ["content_hash", "model"]).select("doc_id", "content_hash")


@catalogue.add(
    "u5_seed_regions",
    """SELECT r_regionkey, upper(r_name) AS r_name, CASE WHEN r_regionkey = 0 THEN 'inserted' WHEN upper(r_name) = CASE WHEN r_regionkey % 2 = 0 THEN upper(r_name) ELSE lower(r_name) END THEN 'unchanged' ELSE 'updated' END AS status FROM region""",
)
def u5(spark, folder):
    region = tb.read_table(spark, folder, "region").select("r_regionkey", "r_name")
    name = F.col("r_name")
    current = region.where("r_regionkey > 0").withColumn(
        "r_name", F.when(F.col("r_regionkey") % 2 == 0, F.upper(name)).otherwise(F.lower(name))
    )
    return ch.seed_dimension(current, region.withColumn("r_name", F.upper(name)), "r_regionkey", ["r_name"])


# --- enrichment --------------------------------------------------------------------------------
def _entity_rows(spark, folder):
    return enrich.canonicalize(enrich.extract_entities(tb.articles(spark, folder), vocab.ENRICH), vocab.ENRICH)


@catalogue.add("c1_entities", es.C1)
def c1(spark, folder):
    return enrich.extract_entities(tb.articles(spark, folder), vocab.ENRICH).select("id", "entity_type", "name", "relevance", "place")


@catalogue.add("c1b_canonical_entities", es.C1B)
def c1b(spark, folder):
    rows = _entity_rows(spark, folder)
    return rows.groupBy("entity_type", "slug", "canonical_source").agg(
        F.count_distinct("id").alias("articles"), F.min("canonical_name").alias("canonical_name")
    )


@catalogue.add("c1b_new_aliases", es.C1B_NEW)
def c1b_aliases(spark, folder):
    rows = _entity_rows(spark, folder)
    known = rows.where(F.length("name") % 3 == 0).select(
        "entity_type", "normalized_name", tx.lookup_key(F.col("name")).alias("normalized_alias")
    )
    return enrich.new_aliases(rows, known.distinct(), vocab.ENRICH)


@catalogue.add("a7_entity_mentions", es.A7)
def a7(spark, folder):
    return enrich.mentions(_entity_rows(spark, folder))


HASH_SQL = "sha256(title || chr(10) || summary || chr(10) || article_text || chr(10) || section || chr(10) || tags)"


@catalogue.add(
    "c8_enrichment",
    f"""WITH {q.ARTICLES}, e AS (SELECT id, {TYPES_SQL}, {TAGS_SQL} AS codes, array_to_string({PHRASES_SQL}, '|') AS phrases, {HASH_SQL} AS content_hash FROM articles)
    SELECT id, article_type, article_type_confidence, article_type NOT IN ('opinion', 'editorial') AS is_event_coverage, array_to_string(codes, ',') AS tags, phrases, content_hash
    FROM e WHERE id % 4 <> 0""",
)
def c8(spark, folder):
    """Enrich the articles whose stored hash is missing or stale (a quarter is up to date)."""
    articles = tb.articles(spark, folder).withColumn("content_hash", ch.article_hash())
    stored = articles.select("id", F.when(F.col("id") % 4 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"))
    work = ch.needs_work(articles, stored, "id", ["content_hash"])
    rows = enrich.classify(work, vocab.ENRICH)
    return rows.select(
        "id", "article_type", "article_type_confidence", "is_event_coverage",
        F.array_join("tag_codes", ",").alias("tags"), F.array_join("key_phrases", "|").alias("phrases"), "content_hash",
    )


RUN_SQL = f"""WITH {q.ARTICLES.replace('FROM documents', 'FROM documents WHERE doc_id % 4 <> 0')}, {es.ENTITIES}, {es.SLUGS}"""


def _run(spark, folder):
    """An enrichment run over articles of which every fourth is up to date; a third of the spellings is known."""
    articles = tb.articles(spark, folder)
    done = articles.where(F.col("id") % 4 == 0).select("id", ch.article_hash().alias("content_hash"))
    stale = articles.where(F.col("id") % 4 == 1).select("id", F.lit("old").alias("content_hash"))
    none = spark.createDataFrame([], "entity_type string, normalized_name string, normalized_alias string")
    return enrich.enrichment_run(articles, done.unionByName(stale), none, vocab.ENRICH)


@catalogue.add(
    "c8_enrichment_run",
    f"""{RUN_SQL}, n AS (SELECT id, count(DISTINCT (entity_type, normalized_name, slug, {es.KEY_SQL})) AS mention_rows FROM canonical GROUP BY id)
    SELECT id, {TYPES_SQL}, array_to_string({TAGS_SQL}, ',') AS tags, array_to_string({PHRASES_SQL}, '|') AS phrases, coalesce(array_to_string(entity_slugs, ','), '') AS entity_slugs, coalesce(mention_rows, 0) AS mention_rows
    FROM articles LEFT JOIN slugs USING (id) LEFT JOIN n USING (id)""",
)
def c8_run(spark, folder):
    """The analysis rows of the run with the number of mentions that the same run made of each article."""
    run = _run(spark, folder)
    counted = run.mentions.groupBy("id").agg(F.count(F.lit(1)).alias("mention_rows"))
    return run.analysis.join(counted, "id", "left").select(
        "id", "article_type", "article_type_confidence", F.array_join("tag_codes", ",").alias("tags"), F.array_join("key_phrases", "|").alias("phrases"),
        F.array_join("entity_slugs", ",").alias("entity_slugs"), F.coalesce("mention_rows", F.lit(0)).alias("mention_rows"))


@catalogue.add(
    "a19_enrichment_run_metrics",
    f"""{RUN_SQL}, a AS (SELECT {TYPES_SQL}, {TAGS_SQL} AS codes FROM articles), x AS (SELECT (SELECT count(*) FROM documents) AS article_count, (SELECT count(*) FROM articles) AS enriched_count)
    SELECT article_count, enriched_count, article_count - enriched_count AS skipped_count, (SELECT count(*) FROM a WHERE len(codes) = 0) AS untagged_count,
      (SELECT count(*) FROM a WHERE article_type NOT IN ('opinion', 'editorial')) AS event_coverage_count, (SELECT count(*) FROM canonical) AS entity_count,
      (SELECT count(*) FROM canonical WHERE canonical_source = 'alias_map') AS aliased_count FROM x""",
)
def a19_enrichment(spark, folder):
    """Counters of the run, taken from the jobs that write its tables."""
    found = _run(spark, folder).write(shared_folder(spark))
    names = ("article_count", "enriched_count", "skipped_count", "untagged_count", "event_coverage_count", "entity_count", "aliased_count")
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))


@catalogue.add(
    "src2_enriched_articles",
    f"""WITH {q.ARTICLES}, {es.ENTITIES}, {es.SLUGS} SELECT id, source, {TYPES_SQL}, array_to_string({TAGS_SQL}, ',') AS tags, array_to_string({PHRASES_SQL}, '|') AS phrases,
      coalesce(array_to_string(entity_slugs, ','), '') AS entity_slugs FROM articles LEFT JOIN slugs USING (id) WHERE published_at >= TIMESTAMP '2024-01-21 00:00:00'""",
)
def src2(spark, folder):
    rows = enrich.enriched(tb.recent(tb.articles(spark, folder), AS_OF, 10), vocab.ENRICH)
    return rows.select(
        "id", "source", "article_type", "article_type_confidence",
        F.array_join("tag_codes", ",").alias("tags"), F.array_join("key_phrases", "|").alias("phrases"),
        F.array_join("entity_slugs", ",").alias("entity_slugs"),
    )


# --- selection ---------------------------------------------------------------------------------
@catalogue.add(
    "w2_round_robin",
    f"""WITH {q.ARTICLES}, n AS (SELECT id, source, row_number() OVER (ORDER BY published_at DESC, id DESC) AS pos FROM articles),
    t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY source) AS first FROM n)
    SELECT id, source, row_number() OVER (ORDER BY turn, first) AS pick FROM t ORDER BY turn, first LIMIT 150""",
)
def w2(spark, folder):
    rows = tb.articles(spark, folder).select("id", "source", "published_at")
    picked = round_robin(rows, "source", [F.desc("published_at"), F.desc("id")], 150)
    return picked.select("id", "source", "pick")


@catalogue.add(
    "f10_min_text",
    f"WITH {q.ARTICLES}, t AS (SELECT id, {EMBEDDING_TEXT_SQL} AS t FROM articles) SELECT id, length(t) AS n, sha256(t) AS content_hash FROM t WHERE length(t) >= 40",
)
def f10(spark, folder):
    rows = pinned(tb.articles(spark, folder).select("id", _embedding_text().alias("t"))).where(F.length("t") >= 40)
    return rows.select("id", F.length("t").alias("n"), F.sha2("t", 256).alias("content_hash"))


@catalogue.add(
    "l11_stale_embeddings",
    f"""WITH {q.ARTICLES}, t AS (SELECT id, source, published_at, {EMBEDDING_TEXT_SQL} AS t FROM articles),
    w AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, id DESC) AS pos FROM t WHERE length(t) >= 40 AND id % 3 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY source) AS first FROM w)
    SELECT id, source, sha256(t) AS content_hash FROM r ORDER BY turn, first LIMIT 100""",
)
def l11(spark, folder):
    texts = pinned(tb.articles(spark, folder).select("id", "source", "published_at", _embedding_text().alias("t")))
    rows = cut_lineage(
        texts.where(F.length("t") >= 40).select(
            "id", "source", "published_at", F.sha2("t", 256).alias("content_hash"), F.lit("m").alias("embedding_model")
        )
    )
    stored = rows.where(F.col("id") % 3 == 0).select("id", "content_hash", "embedding_model")
    stale = ch.needs_work(rows, stored, "id", ["content_hash", "embedding_model"])
    return round_robin(stale, "source", [F.desc("published_at"), F.desc("id")], 100).select("id", "source", "content_hash")


@catalogue.add(
    "w4_top_entities",
    """SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT o_custkey, o_orderkey, o_totalprice,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""",
)
def w4(spark, folder):
    orders = tb.read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@catalogue.add(
    "c16_inference_batches",
    f"""WITH {q.ARTICLES} SELECT id, batch, sum(length(prompt)) OVER (PARTITION BY batch)::BIGINT AS batch_chars, md5(prompt) AS prompt FROM (
      SELECT id, (row_number() OVER (ORDER BY id) - 1) // 20 AS batch,
      'Source: ' || source || chr(10) || 'Section: ' || section || chr(10) || 'Title: ' || title || chr(10) || 'Summary: ' || summary || chr(10) || 'Body: ' || substring(article_text, 1, 6000) AS prompt FROM articles)""",
)
def c16(spark, folder):
    from storyloom.operators.inference import input_batches

    rows = input_batches(tb.articles(spark, folder), 20, 6000)
    from pyspark.sql import Window

    chars = F.sum(F.length("prompt")).over(Window.partitionBy("batch")).alias("batch_chars")
    return rows.select("id", "batch", chars, F.md5("prompt").alias("prompt"))

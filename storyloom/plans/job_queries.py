"""Registered queries for feeds, the semantic map and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import density as dn
from storyloom.operators import vectors as vc
from storyloom.plans import sqltext as q
from storyloom.plans.registry import Catalogue
from storyloom.plans.story_queries import _knn, _vectors
from storyloom.session import cut_lineage
from storyloom.sources import feeds
from storyloom.sources import tables as tb
from storyloom.streaming import jobs

catalogue = Catalogue()
HREFS = r"""(?i)<a\b[^>]*?\bhref=["']([^"']+)["']"""
HREFS_SQL = """regexp_extract_all(html, '<a\\b[^>]*?\\bhref=["'']([^"'']+)["'']', 1, 'i')"""


def _linked(spark, folder):
    pages = tb.read_table(spark, folder, "pages")
    safe = lambda h: F.replace(F.replace(h, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    links = F.transform(F.regexp_extract_all("html", F.lit(HREFS), F.lit(1)), safe)
    return pages.select("page_id", links.alias("links"))


@catalogue.add(
    "src3_embedding_window",
    f"""WITH {q.ARTICLES} SELECT a.id, source, len(embedding) AS dim FROM embeddings e JOIN articles a ON a.id = e.vec_id
    WHERE CAST(published_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND label IN (1, 3, 5)""",
)
def src3(spark, folder):
    articles = tb.in_window(tb.articles(spark, folder), tb.date_window(date_from="2024-01-05", date_to="2024-01-12")).select("id", "source")
    e = tb.read_table(spark, folder, "embeddings")
    chosen = e.where(F.col("label").isin(1, 3, 5)).select(F.col("vec_id").alias("id"))
    vectors = e.select(F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("dim"))
    return vectors.join(articles, "id").join(chosen, "id", "left_semi").select("id", "source", "dim")


@catalogue.add(
    "src7_feed_items",
    f"""WITH l AS (SELECT page_id, unnest({HREFS_SQL}) AS link, generate_subscripts({HREFS_SQL}, 1) AS pos FROM pages WHERE page_id % 10 <> 0)
    SELECT page_id, link, CASE WHEN pos % 3 = 0 THEN '' ELSE 'item ' || pos END AS title, CASE WHEN pos % 2 = 0 THEN '' ELSE 'Wed, 10 Jan 2024 10:00:00 +0000' END AS "pubDate" FROM l""",
)
def src7(spark, folder):
    """A feed per page built from its links; every tenth text is cut off and goes to quarantine."""
    def item(h, i):
        n = i + 1
        title = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("<title>item "), n.cast("string"), F.lit("</title>")))
        day = F.when(n % 2 == 0, "").otherwise("<pubDate>Wed, 10 Jan 2024 10:00:00 +0000</pubDate>")
        return F.concat(F.lit("<item>"), title, F.lit("<link>"), h, F.lit("</link>"), day, F.lit("</item>"))

    body = F.array_join(F.transform("links", item), "")
    xml = F.concat(F.lit("<rss><channel><title>feed</title>"), body, F.when(F.col("page_id") % 10 == 0, "").otherwise("</channel></rss>"))
    return feeds.feed_items(_linked(spark, folder).select("page_id", xml.alias("xml")), "xml")[0].select("page_id", "link", "title", "pubDate")


@catalogue.add("src8_sitemap_locations", f"SELECT page_id, unnest({HREFS_SQL}) AS loc FROM pages WHERE page_id % 10 <> 0")
def src8(spark, folder):
    body = F.array_join(F.transform("links", lambda h: F.concat(F.lit("<url><loc> "), h, F.lit(" </loc></url>"))), "")
    end = F.when(F.col("page_id") % 10 == 0, "").otherwise("</urlset>")
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, end)
    return feeds.sitemap_locations(_linked(spark, folder).select("page_id", xml.alias("xml")), "xml")


@catalogue.add(
    "src9_robots_sitemaps",
    f"""WITH l AS (SELECT page_id, list_distinct({HREFS_SQL}) AS d, {HREFS_SQL} AS h FROM pages)
    SELECT page_id, array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i)[1:3], ',') AS sitemaps FROM l""",
)
def src9(spark, folder):
    lines = F.transform("links", lambda h: F.concat(F.lit("Sitemap: "), F.replace(h, F.lit("&amp;"), F.lit("&"))))
    text = F.concat(F.lit("User-agent: *\nDisallow: /x\n"), F.array_join(lines, "\n"))
    return _linked(spark, folder).select("page_id", F.array_join(feeds.robots_sitemaps(text), ",").alias("sitemaps"))


@catalogue.add("c10_density_clusters")
def c10(spark, folder):
    return dn.density_clusters(_vectors(spark, folder))


@catalogue.add("c11_projection_refresh")
def c11(spark, folder):
    """Vectors to points, clusters, density, nearby sources and the per-point table."""
    vectors = _vectors(spark, folder)
    near = cut_lineage(_knn(spark, folder))
    points = vc.project(vectors)
    rows = dn.point_analysis(points, dn.density_clusters(vectors), vc.local_density(near), vc.nearby_sources(near, vectors))
    joined = points.join(rows, "id").withColumn("projection_set", F.lit("pca"))
    return joined.select(
        "projection_set", "id", *[F.round(a, 6).alias(a) for a in "xyz"], "cluster", "cluster_size", "is_outlier", "local_density",
        F.array_join("nearby_sources", ",").alias("nearby_sources"), "diversity",
    )


@catalogue.add(
    "c12_semantic_build",
    f"""WITH {q.ARTICLES}, j AS (SELECT id, source, published_at FROM articles WHERE id IN (SELECT vec_id FROM embeddings)),
    n AS (SELECT id, source, row_number() OVER (ORDER BY published_at DESC, id DESC) AS pos FROM j),
    t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY source) AS first FROM n),
    s AS (SELECT id, source FROM t ORDER BY turn, first LIMIT 200),
    u AS (SELECT s.id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM s JOIN embeddings ON vec_id = s.id)
    SELECT seed, other, rank FROM (SELECT a.id AS seed, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS rank FROM u a JOIN u b ON a.id <> b.id) WHERE rank <= 5""",
)
def c12(spark, folder):
    """A source-balanced slice of the embedded articles and the neighbours inside it."""
    from storyloom.operators.ranking import round_robin

    vectors = _vectors(spark, folder).select("id", "embedding")
    rows = tb.articles(spark, folder).select("id", "source", "published_at").join(vectors.select("id"), "id", "left_semi")
    slice_ = cut_lineage(round_robin(rows, "source", [F.desc("published_at"), F.desc("id")], 200).select("id"))
    return vc.nearest_neighbors(vectors.join(slice_, "id", "left_semi"), 5).select("seed", "other", "rank")


@catalogue.add(
    "l7_points_with_neighbors",
)
def l7(spark, folder):
    from storyloom.operators.explorer import points_with_neighbors

    rows = points_with_neighbors(vc.project(_vectors(spark, folder)), _knn(spark, folder))
    return rows.select("id", F.round("x", 6).alias("x"), F.array_join(F.transform("neighbors", lambda n: n["other"].cast("string")), ",").alias("neighbors"))


@catalogue.add(
    "l6_article_detail",
    f"""WITH {q.ARTICLES}, u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    n AS (SELECT b.id AS other, row_number() OVER (ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS rank FROM u a JOIN u b ON a.id <> b.id WHERE a.id = 17)
    SELECT id, title, substring(article_text, 1, 400) AS excerpt, (SELECT string_agg(CAST(other AS VARCHAR), ',' ORDER BY rank) FROM n WHERE rank <= 5) AS neighbors, CAST(id % 50 AS VARCHAR) AS stories FROM articles WHERE id = 17""",
)
def l6(spark, folder):
    from storyloom.operators.explorer import detail

    articles = tb.articles(spark, folder).select("id", "title", F.substring("article_text", 1, 400).alias("excerpt"))
    told = articles.select("id", (F.col("id") % 50).alias("cluster"))
    row = detail(17, articles, vc.nearest_to(_vectors(spark, folder), 17, 5), told)
    flat = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return row.select("id", "title", "excerpt", flat("neighbors", lambda n: n["other"].cast("string")), flat("stories", lambda s: s.cast("string")))


# --- streaming ---------------------------------------------------------------------------------
PARTS = 4
EVENT_FIELDS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _event_files(spark, folder):
    """The events as a few files in arrival order; some rows arrive twice."""
    events = tb.read_table(spark, folder, "events")
    path = jobs.work_folder(spark, "arrivals")
    bounds = events.agg(F.max("event_id").alias("top")).first()["top"] + 1
    for part in range(PARTS):
        low, high = bounds * part // PARTS, bounds * (part + 1) // PARTS
        rows = events.where(F.col("event_id").between(low, high - 1))
        again = rows.where(F.col("event_id") % 20 == 0)
        rows.unionByName(again).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENT_FIELDS).option("maxFilesPerTrigger", 1).parquet(path)


@catalogue.add(
    "st1_stream_ingest",
    "SELECT event_type AS source, user_id AS url, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY ALL",
)
def st1(spark, folder):
    return _ingested(spark, folder).read()


def _ingested(spark, folder):
    stream = _event_files(spark, folder).select(
        F.col("event_type").alias("source"), F.col("user_id").alias("url"), "value", "props", F.col("event_id").alias("position")
    )
    table = jobs.KeyedTable(spark, jobs.work_folder(spark, "ingest"), "source string, url bigint, value double, props string", ["source", "url"], 16)
    jobs.ingest(stream, table, ["value", "props"], "position", jobs.work_folder(spark, "ingest-state")).awaitTermination()
    return table


@catalogue.add(
    "st1_batch_log",
    f"""WITH RECURSIVE n AS (SELECT max(event_id) + 1 AS n FROM events), p AS (SELECT event_type, user_id, value, props, event_id, (SELECT CAST(max(i) AS BIGINT) FROM range({PARTS}) t(i) WHERE event_id >= n.n * i // {PARTS}) AS batch FROM events, n),
    l AS (SELECT batch, event_type, user_id, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM p GROUP BY ALL),
    w AS (SELECT *, lag((value, props)) OVER (PARTITION BY event_type, user_id ORDER BY batch) AS old FROM l)
    SELECT batch, CASE WHEN old IS NULL THEN 'inserted' WHEN old = (value, props) THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n FROM w GROUP BY ALL""",
)
def st1_log(spark, folder):
    """Inserted, updated and unchanged keys of every micro-batch."""
    return _ingested(spark, folder).log().select("batch", "status", "n")


@catalogue.add(
    "st2_daily_coverage",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS source, count(*) AS n FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
)
def st2(spark, folder):
    stream = _event_files(spark, folder)
    out, state = jobs.work_folder(spark, "coverage"), jobs.work_folder(spark, "coverage-state")
    jobs.run_to_files(jobs.daily_coverage(stream, "ts", "event_type", ["event_id"]), out, state)
    rows = spark.read.parquet(out)
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "source", "n")



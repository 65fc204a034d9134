"""Feed, sitemap and robots texts to rows, labelled JSON files, and plain file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as tx

ITEM = "struct<title: string, link: string, pubDate: string>"
FEED_SCHEMA = f"channel struct<item: array<{ITEM}>>, item array<{ITEM}>, broken string"
SITEMAP_SCHEMA = "url array<struct<loc: string>>, sitemap array<struct<loc: string>>, broken string"
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}


def feed_items(feeds: DataFrame, xml: str) -> tuple[DataFrame, DataFrame]:
    """(title, link, pubDate rows with the feed's other columns, feeds that are no XML)."""
    others = [c for c in feeds.columns if c != xml]
    parsed = feeds.withColumn("__f", F.from_xml(F.col(xml), FEED_SCHEMA, PERMISSIVE))
    broken = F.col("__f").isNull() | F.col("__f.broken").isNotNull()
    items = F.concat(*[F.coalesce(c, F.array().cast(f"array<{ITEM}>")) for c in ("__f.channel.item", "__f.item")])
    rows = parsed.where(~broken).select(*others, F.explode(items).alias("i"))
    text = lambda name: F.trim(F.coalesce(F.col(f"i.{name}"), F.lit(""))).alias(name)
    return rows.select(*others, text("title"), text("link"), text("pubDate")), parsed.where(broken).select(*feeds.columns)


def sitemap_locations(sitemaps: DataFrame, xml: str) -> DataFrame:
    """loc rows; a text that is no XML gives none."""
    others = [c for c in sitemaps.columns if c != xml]
    plain = F.regexp_replace(F.col(xml), r"\sxmlns(:\w+)?=([\"'])[^\"']*\2", "")
    parsed = sitemaps.withColumn("__s", F.from_xml(plain, SITEMAP_SCHEMA, PERMISSIVE)).where(
        F.col("__s").isNotNull() & F.col("__s.broken").isNull()
    )
    kind = "array<struct<loc:string>>"
    both = F.concat(*[F.coalesce(c, F.array().cast(kind)) for c in ("__s.url", "__s.sitemap")])
    rows = parsed.select(*others, F.explode(both).alias("u")).select(*others, F.trim("u.loc").alias("loc"))
    return rows.where(F.coalesce(F.col("loc"), F.lit("")) != "")


def robots_sitemaps(text: Column, limit: int = 3) -> Column:
    """Distinct sitemap URLs of a robots.txt, the first few."""
    found = F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, limit)


# --- labelled files ----------------------------------------------------------------------------
LABELLED_SCHEMA = """
articles array<struct<article: struct<id: bigint, source: string, title: string, url: string, published_at: string, section: string,
    author: string, summary: string, article_text: string, tags: string>,
  analysis: struct<article_type: string, article_type_confidence: double, is_event_coverage: boolean>,
  tag_codes: array<string>, entity_slugs: array<string>, key_phrases: array<string>>>,
pair_labels array<struct<left_article_id: bigint, right_article_id: bigint, label: string, notes: string>>,
gold_clusters array<array<bigint>>"""


def labelled_dataset(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, pair labels, gold clusters) of a labelled JSON file, or of files with one dataset a line."""
    data = spark.read.schema(LABELLED_SCHEMA).json(path, multiLine=not lines)
    rows = data.select(F.explode("articles").alias("a")).select(
        "a.article.*", "a.analysis.article_type", "a.tag_codes", "a.entity_slugs", "a.key_phrases"
    )
    articles = rows.withColumn("published_at", tx.parse_timestamp(F.col("published_at")))
    labels = data.select(F.explode("pair_labels").alias("l")).select(
        F.col("l.left_article_id").alias("left_id"), F.col("l.right_article_id").alias("right_id"), "l.label"
    )
    gold = data.select(F.posexplode("gold_clusters").alias("cluster", "ids")).select(F.explode("ids").alias("id"), F.col("cluster").cast("long").alias("cluster"))
    return articles, labels, gold


REVIEW_SCHEMA = "bucket string, left_id bigint, right_id bigint, predicted_label string, score double, label string, labeler_notes string"


def review_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEW_SCHEMA).json(path)


# --- sinks -------------------------------------------------------------------------------------
EXPORT_COLUMNS = ("source", "title", "url", "published_at", "section", "author", "summary", "article_text", "tags")


def export_articles(articles: DataFrame, path: str, kind: str = "json") -> None:
    """Articles with the fixed columns as JSON lines or CSV with a header."""
    rows = articles.select(*[tx.iso_text(F.col(c)).alias(c) if c == "published_at" else F.col(c) for c in EXPORT_COLUMNS])
    if kind == "json":
        rows.write.mode("overwrite").json(path)
    elif kind == "csv":
        rows.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        raise ValueError(f"unknown export kind {kind}")


def export_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def replace_partitions(rows: DataFrame, path: str, by: str = "projection_set") -> None:
    """Replace only the partitions that `rows` holds; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

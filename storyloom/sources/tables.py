"""Typed readers and the article view over a document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_COLUMNS = (
    "source", "title", "url", "published_at", "section", "author", "summary", "article_text", "tags",
)
ARTICLE_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType())]
    + [
        T.StructField(name, T.TimestampType() if name == "published_at" else T.StringType())
        for name in ARTICLE_COLUMNS
    ]
)
VIEW_EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z
VIEW_MINUTES = 43_200


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table; zone-less timestamps become UTC instants once, here."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for column in df.schema:
        if isinstance(column.dataType, T.TimestampNTZType):
            df = df.withColumn(column.name, F.col(column.name).cast("timestamp"))
    return df


def articles_view(documents: DataFrame) -> DataFrame:
    """Articles from documents: first sentence is the title, second the summary."""
    doc = F.col("doc_id")
    sentence = lambda n: F.trim(F.split_part("text", F.lit("."), F.lit(n)))
    return documents.select(
        doc.alias("id"),
        "source",
        sentence(1).alias("title"),
        F.concat(
            F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), doc.cast("string")
        ).alias("url"),
        F.timestamp_seconds(F.lit(VIEW_EPOCH) + (doc * 37 % VIEW_MINUTES) * 60).alias("published_at"),
        F.col("lang").alias("section"),
        F.lit("").alias("author"),
        sentence(2).alias("summary"),
        F.col("text").alias("article_text"),
        F.lit("").alias("tags"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return articles_view(read_table(spark, folder, "documents"))


def recent(df: DataFrame, as_of, days_back: int, column: str = "published_at") -> DataFrame:
    """Rows with a timestamp at or after as_of minus days_back."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days_back)} DAYS")
    return df.where(F.col(column).isNotNull() & (F.col(column) >= cutoff))


def date_window(
    as_of: str | None = None, days_back: int | None = None, date_from: str | None = None,
    date_to: str | None = None,
) -> tuple[str | None, str | None]:
    """Check and resolve an inclusive UTC date window; days_back ends on as_of."""
    from datetime import date, timedelta

    if days_back is not None:
        if days_back < 1:
            raise ValueError("days_back must be at least 1")
        if date_from or date_to:
            raise ValueError("give days_back or explicit dates, not both")
        if as_of is None:
            raise ValueError("days_back needs as_of")
        end = date.fromisoformat(as_of[:10])
        return (end - timedelta(days=days_back - 1)).isoformat(), end.isoformat()
    for value in (date_from, date_to):
        if value:
            date.fromisoformat(value)
    if date_from and date_to and date_from > date_to:
        raise ValueError("date_from is after date_to")
    return date_from, date_to


def in_window(df: DataFrame, window: tuple[str | None, str | None], column: str = "published_at") -> DataFrame:
    """Half-open timestamp bounds, so that the filter reaches the Parquet scan."""
    start, end = window
    if start:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col(column) < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return df

"""A training-data pipeline over `documents`; each stage is written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns the columns of
`docs`; the last one adds its own. Columns of any names may come along; only doc_id, text and lang are looked at.
Null and empty texts: language identification rejects them, as they have no letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import bpe, decontam, exact, langid, near
from storyloom.llm.common import stored
from storyloom.plans.registry import Catalogue

#: A text stays if its likeliest language has at least this chance.
SURE = 0.5

catalogue = Catalogue()


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can be told stay; languages are learnt from the rows' own `lang`. Texts without a letter go."""
    found = langid.identify(docs, docs.columns, F.col("lang").isNotNull())
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("kept.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space stays: the longest, then the smallest doc_id."""
    return exact.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share four fifths of their five-word shingles stays: the smallest doc_id."""
    return near.deduplicated(docs, width=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts stay unless benchmark windows cover a twentieth of their words or more."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find(docs, benchmark, docs.columns).filter(~F.col("contaminated")).select("kept.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their token ids and the text decoded from these. A column of the same name gives way."""
    encoded = bpe.encode(docs, docs.columns)
    own = [F.col(f"kept.`{c}`") for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]
    return encoded.select(*own, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("BPE encoding", tokens),
]

#: Language identification and BPE are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


@catalogue.add("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import bpe, decontam, exact, langid, licence, lm, near, prefix_trie, quality, ranked_search, secrets, sharding, toxicity
from storyloom.llm.common import crc_rest
from storyloom.plans.registry import Catalogue

catalogue = Catalogue()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@catalogue.add("op1_quality")
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learnt from the labels of four fifths of them."""
    found = quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"], crc_rest("doc_id", 5) != 0)
    return found.select("kept.doc_id", (crc_rest("kept.doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@catalogue.add("op2_language")
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from four fifths of them."""
    docs = table(spark, folder, "documents")
    held_out = crc_rest("doc_id", 5) == 0
    found = langid.identify(docs, ["doc_id"], ~held_out)
    return found.select("kept.doc_id", (crc_rest("kept.doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@catalogue.add("op3_near_dedup", near.SQL)
def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are alike."""
    return near.groups(table(spark, folder, "documents"), width=2)


@catalogue.add("op4_decontamination", decontam.SQL)
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of documents that benchmark windows cover."""
    return decontam.digests(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@catalogue.add("op5_language_model")
def op5_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probability of every document, learnt from nine tenths of them."""
    return lm.score(table(spark, folder, "documents"), crc_rest("doc_id", 10) == 0, ["doc_id"]).select("kept.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@catalogue.add("op6_licences", licence.SQL)
def op6_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory above."""
    return licence.documents_licences(table(spark, folder, "documents"))


@catalogue.add("op7_exact_dedup", exact.SQL)
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    return exact.groups(table(spark, folder, "documents")).drop("row")


@catalogue.add("op8_bpe")
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of the word-end BPE, as digests."""
    return bpe.digests(table(spark, folder, "documents"))


@catalogue.add("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of three quarters of them."""
    found = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"], crc_rest("doc_id", 4) != 2)
    return found.select("kept.doc_id", (crc_rest("kept.doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@catalogue.add("op10_sharding")
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """24 shards of equally many documents, equal texts together."""
    return sharding.shard(table(spark, folder, "documents"), 24)


@catalogue.add("op11_secrets", secrets.SQL)
def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Places of secrets in every document."""
    return secrets.digests(table(spark, folder, "documents"))


@catalogue.add("op12_ranked_search", ranked_search.SQL)
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@catalogue.add("op13_prefix_trie", prefix_trie.SQL)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix trie of the rebuilt conversations."""
    return prefix_trie.rebuilt_nodes(table(spark, folder, "conversations"))

"""Exact dedup over an extendible-hash index, with DataFrame operations only.

Texts are normalised (ASCII white space deleted) and hashed to keys of 64 bits. One narrow entry a row goes to
shared files. Entries of one text are summed to a chain head before anything is placed, so a text that fills a third
of the table is one head. A directory over the top bits of the key is doubled until no bucket holds more than
`capacity` heads; owner tasks hold buckets, thus ranges of keys, and chain the heads of one key. Keys of several rows are settled
by comparing bytes: the rows are grouped by the normalised text itself.

Defined results: null text counts as empty, and empty texts equal each other; of equal texts the row with the most
code points in the original text stays, then the smallest doc_id (null last), and of wholly repeated rows exactly one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm.common import stored

#: Chain heads that a bucket holds at most.
CAPACITY = 20_000
#: Parts into which the rows of one key are dealt while their bytes are compared.
SALTS = 32
#: Depth to which the directory may be doubled.
DEEPEST = 30


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def key_of(norm: Column, key_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - key_bits)


def entries(docs: DataFrame, text: str = "text", key_bits: int = 64) -> DataFrame:
    """One narrow entry a row, in shared files."""
    norm = normalised(F.col(text))
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            key_of(norm, key_bits).alias("key"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("n_cp"),
            F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
        )
    )


def chain_heads(rows: DataFrame) -> DataFrame:
    """One head for each text: its number of rows and the row that stays."""
    order = F.struct("n_cp", (-F.col("doc_id")).alias("back"), (-F.col("row")).alias("first"))
    return rows.groupBy("key", "text_sha256").agg(F.count("*").alias("group_size"), F.max(order).alias("best")).select(
        "key", "text_sha256", "group_size", (-F.col("best.back")).alias("keep_id"), (-F.col("best.first")).alias("keep_row"))


def directory(heads: DataFrame, capacity: int, key_bits: int) -> DataFrame:
    """Buckets (depth, prefix, n): doubling splits each prefix that holds more than `capacity` heads.

    The counts of one fine level are summed to all coarser levels at once; a bucket is a prefix that fits below a
    parent that doesn't.
    """
    total = heads.count()
    deepest = min(DEEPEST, key_bits, max(0, (max(1, total) // max(1, capacity)).bit_length() + 4) if total > capacity else 0)
    cells = heads.groupBy(F.shiftrightunsigned("key", key_bits - deepest).alias("cell") if deepest else F.lit(0).cast("long").alias("cell")).count()
    levels = cells.select(F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"), "cell", "count").groupBy(
        "depth", F.expr(f"shiftrightunsigned(cell, {deepest} - depth)").alias("prefix")).agg(F.sum("count").alias("n"))
    parent = levels.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("n").alias("n_up"))
    split = levels.withColumn("up", F.shiftright("prefix", 1)).join(parent, ["depth", "up"], "left")
    fits = (F.col("n") <= capacity) | (F.col("depth") == deepest)
    return split.filter(fits & (F.coalesce("n_up", F.lit(capacity + 1)) > capacity)).select("depth", "prefix", "n", F.lit(deepest).alias("global_depth"))


def index(rows: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """The heads by bucket, in shared files: owner tasks hold whole buckets and number the chain of each key."""
    heads = chain_heads(rows)
    buckets = directory(heads, capacity, key_bits)
    fine = buckets.select("depth", "prefix", "global_depth", F.explode(F.expr("sequence(shiftleft(prefix, global_depth - depth), shiftleft(prefix + 1, global_depth - depth) - 1)")).alias("cell"))
    deepest = (buckets.first() or {"global_depth": 0})["global_depth"]
    cell = F.shiftrightunsigned("key", key_bits - deepest) if deepest else F.lit(0).cast("long")
    placed = heads.withColumn("cell", cell).join(fine.select("cell", "depth", "prefix"), "cell")
    chain = Window.partitionBy("depth", "prefix", "key").orderBy("text_sha256")
    return stored(placed.repartition("depth", "prefix").withColumn("place_in_chain", F.row_number().over(chain)).drop("cell"))


def compared(docs: DataFrame, heads: DataFrame, text: str = "text", key_bits: int = 64) -> DataFrame:
    """(key, text_sha256) of keys of several rows, one row for each text of different bytes."""
    several = heads.groupBy("key").agg(F.sum("group_size").alias("n")).filter("n > 1").select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    norm = normalised(F.col(text))
    rows = docs.select("doc_id", norm.alias("norm")).withColumn("key", key_of(F.col("norm"), key_bits)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    texts = rows.join(several, ["key", "salt"], "left_semi").groupBy("key", "norm").count()
    return texts.select("key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.col("count").alias("same_bytes"))


def groups(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = entries(docs, text, key_bits)
    heads = index(rows, capacity, key_bits)
    agreed = F.assert_true(F.col("group_size") == F.col("same_bytes"), "texts of different bytes share a SHA-256")
    repeated = heads.filter("group_size > 1").join(compared(docs, heads, text, key_bits), ["key", "text_sha256"], "left")
    repeated = repeated.filter(F.coalesce(agreed.cast("string"), F.lit("")) == "").select("key", "text_sha256", "keep_id", "keep_row", "group_size")
    own = F.col("keep_row").isNull()
    return rows.join(repeated, ["key", "text_sha256"], "left").select(
        "row",
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (own | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that stay. Rows whose doc_id repeats (or is null) are told apart by their texts."""
    decided = groups(docs, text)
    whole = docs.select(F.struct("*").alias("kept"))  # columns of any name travel inside
    norm = normalised(F.col(f"kept.{text}"))
    times = decided.groupBy("doc_id").agg(F.count("*").alias("n"))
    again = times.filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"))
    once = decided.filter("kept AND doc_id IS NOT NULL").join(again, F.col("doc_id") == F.col("_id"), "left_anti").select(F.col("doc_id").alias("_id"))
    same = F.col("kept.doc_id").eqNullSafe(F.col("_id"))
    keepers = decided.filter("kept").join(again, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_keeper"))
    longest = Window.partitionBy("kept.doc_id", "_sha").orderBy(F.char_length(F.coalesce(F.col(f"kept.{text}"), F.lit(""))).desc(), F.col(f"kept.{text}").isNull())
    rows = whole.join(again, same, "left_semi").withColumn("_sha", F.sha2(norm.cast("binary"), 256))
    rows = rows.withColumn("_at", F.row_number().over(longest)).filter("_at = 1")
    rows = rows.join(keepers, same & (F.col("_sha") == F.col("_keeper")), "left_semi").select("kept")
    return whole.join(once, F.col("kept.doc_id") == F.col("_id"), "left_semi").unionByName(rows).select("kept.*")


SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""

"""Helpers of the training-data operators: Arrow batches of texts, shared tables, exact numbering."""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from storyloom.session import bounded_batches
from storyloom.session import cut_lineage as stored  # noqa: F401  the operators take it from here

#: UTF-8 bytes of text that a task works on at a time; a longer text is a piece of its own.
PIECE_BYTES = 2_000_000


def stretches(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, number) of rows that hold at most `limit` bytes of text each (or one row)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i - start
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes) - start


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most `limit` bytes of text each (or one row)."""
    for start, n in stretches(batch.column(column), limit):
        yield batch.slice(start, n)


def map_texts(df: DataFrame, text: str, keep: list[str], make: Callable, fields: str) -> DataFrame:
    """Whole texts through make()(list of str or None) -> Arrow arrays, one value a row.

    The columns in `keep` travel in the struct `kept`, so that their names can't clash with the results. A text that is
    kept travels once, and batches are bounded in bytes, so that a worker holds few texts at a time.
    """
    bounded_batches(df.sparkSession)
    added = T._parse_datatype_string(fields)
    inside = keep.index(text) if text in keep and df.schema[text].dataType == T.StringType() else None
    apart = [] if inside is not None else [F.col(f"`{text}`").cast("string").alias("text")]
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), *apart)
    schema = T.StructType([source.schema["kept"], *added.fields])
    names = schema.names

    def run(batches):
        gc.collect()  # workers are reused: what an earlier task left in cycles goes before this one starts
        work = make()
        for batch in batches:
            kept = batch.column("kept")
            texts = batch.column("text") if inside is None else pc.struct_field(kept, [inside])
            for start, n in stretches(texts):
                yield pa.RecordBatch.from_arrays([kept.slice(start, n), *work(texts.slice(start, n).to_pylist())], names=names)

    return source.mapInArrow(run, schema)


class Shipped:
    """A broadcast model that carries its classes by value, so that executors need no copy of this package."""

    def __init__(self, spark: SparkSession, model):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    @property
    def value(self):
        return pickle.loads(self.packed.value)


def crc_rest(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`: the fold of a document."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def numbered(df: DataFrame, keys: list[str], order: str, name: str, rows_per_chunk: int = 100_000) -> DataFrame:
    """Gapless numbers from 0 within each key, by chunks of the hash of `order`.

    Counts of chunks give each chunk its first number, and row_number() works inside a chunk only, so no task
    holds a whole key. The order within a key is the hash of `order` (deterministic), ties by `order`.
    """
    total = df.count()
    n_chunks = max(1, -(-total // rows_per_chunk))
    marked = df.withColumn("_h", F.xxhash64(order)).withColumn("_chunk", F.pmod(F.shiftright("_h", 20), F.lit(n_chunks)))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_h", order)
    ranked = marked.withColumn("_at", F.row_number().over(inside) - 1)
    joined = ranked.join(starts.drop("_n"), [*keys, "_chunk"])
    return joined.withColumn(name, (F.col("_first") + F.col("_at")).cast("long")).drop("_h", "_chunk", "_first", "_at")


#: CTE: the 256 entries of the CRC-32 table as one list.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY n) AS tab FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) t(n)))"""


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII string in SQL, beside crc_table."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295)"

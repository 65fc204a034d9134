"""Structured Streaming: continuous keyed ingest and daily coverage counts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import changes as ch
from storyloom.session import ensure_checkpoint_dir


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, on storage that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


class KeyedTable:
    """A keyed table in buckets of the key's hash; a micro-batch reads and rewrites only the buckets that its keys fall in.

    Batch n is staged with a status for each row before anything is replaced. The staged rows then overwrite their
    buckets, and the log of the batch (counts by status) is written last. A batch that runs again after a failure
    takes what it had staged, so it has the same effect and the same counts wherever it stopped.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets

    def _there(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)

    def _drop(self, path: str) -> None:
        gone = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def _bucketed(self) -> DataFrame:
        fields = f"{self.schema}, bucket int"
        if not self._there(f"{self.path}/rows"):
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).parquet(f"{self.path}/rows")

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self._bucketed().drop("bucket")

    def log(self) -> DataFrame:
        """(batch, status, n) of all batches that are applied."""
        return self.spark.read.schema("status string, n long, batch long").parquet(f"{self.path}/log")

    def stage(self, rows: DataFrame, number: int, fields: Sequence[str], position: str) -> DataFrame:
        """The touched buckets after the batch, with a status for each row, written once for each batch."""
        path = f"{self.path}/staged/batch={number}"
        if not self._there(f"{path}/_SUCCESS"):
            touched = [r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]  # at most `buckets` numbers
            held = self._bucketed().where(F.col("bucket").isin(touched)).drop("bucket")
            merged = ch.upsert(held, rows, self.keys, fields, position).withColumn("bucket", self.bucket())
            merged.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(f"{self.schema}, status string, bucket int").parquet(path)

    def replace(self, staged: DataFrame) -> None:
        """Each bucket becomes what is staged for it; others aren't touched. One task writes a bucket, so it stays few files."""
        rows = staged.drop("status").repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")

    def apply(self, rows: DataFrame, number: int, fields: Sequence[str], position: str) -> None:
        done = f"{self.path}/log/batch={number}"
        if self._there(f"{done}/_SUCCESS"):
            return
        staged = self.stage(rows, number, fields, position)
        self.replace(staged)
        staged.where("status <> 'kept'").groupBy("status").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(done)
        self._drop(f"{self.path}/staged/batch={number}")


def ingest(stream: DataFrame, table: KeyedTable, fields: Sequence[str], position: str, checkpoint: str):
    """Upsert every micro-batch into the table; returns the started query."""

    def apply(batch: DataFrame, number: int) -> None:
        table.apply(batch, number, fields, position)

    return (
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def daily_coverage(stream: DataFrame, ts: str, source: str, unique: Sequence[str], lateness: str = "1 day") -> DataFrame:
    """Articles per source and UTC day; repeats and rows later than `lateness` are dropped."""
    fresh = stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(unique))
    return fresh.groupBy(F.window(ts, "1 day").alias("w"), F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("day"), "source", "n")


def run_to_files(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Append a streaming result to Parquet until the available input is read."""
    query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start(path)
    query.awaitTermination()

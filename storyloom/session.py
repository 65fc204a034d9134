"""Session settings shared by tests, bench and entry points, and tables in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app: str = "storyloom", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of rows that Spark hands to a Python worker at a time; its own bound is 10,000 rows of any length.
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes too, so that a worker's memory doesn't follow the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can read")


def work_root(spark: SparkSession) -> str:
    """The folder of this application in shared storage."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        ensure_checkpoint_dir(spark)
        configured = spark.sparkContext.getCheckpointDir()
    return f"{configured.rstrip('/')}/storyloom-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the storage that driver and executors share."""
    return f"{work_root(spark)}/{uuid.uuid4().hex}"


#: Rows that one task writes where the number of rows is known.
ROWS_PER_FILE = 50_000


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write as Parquet to shared storage and read again: a lost executor replays from files, readers take the columns they use.

    rows: about how many there are, if known; few rows are written by few tasks.
    """
    path = shared_folder(df.sparkSession)
    if rows is not None:
        tasks = max(1, rows // ROWS_PER_FILE)
        if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_work(spark: SparkSession) -> None:
    """Delete all that this application wrote to shared storage; call it when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Session settings, the shared work folder and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table that may be sent whole to every executor.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app_name: str = "vocatio", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win elsewhere."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Chained joins on one id are split at a hot id too, at the price of a shuffle between them.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a missing setting is
    an error, since a folder on one machine would not survive the loss of that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="vocatio-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """Where this session keeps its intermediate tables, apart from other sessions'."""
    return f"{shared_folder(spark)}/vocatio/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the session's folder."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_work(spark: SparkSession) -> bool:
    """Delete the session's intermediate tables, once nothing reads them any more; True if there were any.

    Results that have not been written elsewhere read those tables, so this is left to the end of a run.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and fixes the rows, so later stages neither recompute the inputs nor lose
    them with an executor.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_LIMIT_BYTES) -> tuple[DataFrame, bool]:
    """Mark ``df`` for broadcast only if its measured size is within ``limit``.

    ``row_bytes`` estimates the bytes of one row. Callers need another way for the other case.
    """
    total = df.agg(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0)).alias("b")).first()["b"]
    return (F.broadcast(df), True) if total <= limit else (df, False)


# Bytes of one Arrow batch that a Python worker gets, so that long texts come few at a time.
BATCH_BYTES = 8 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch, where it is unset or higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = str(spark.conf.get(name)).lower().rstrip("b")
    if not set_to.isdigit() or not 0 < int(set_to) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores where it yields fewer partitions, as a single small file does.

    Large tables have splits enough and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

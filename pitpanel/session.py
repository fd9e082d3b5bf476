"""Session helpers: configuration, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest dimension table, in bytes, that the library asks Spark to broadcast.
BROADCAST_LIMIT = 64 * 1024 * 1024


def local_session(cores: int | str = 8, app: str = "pitpanel", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small test inputs: keep every core busy instead of merging to one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is made only where the session names none and runs in
    one process, as tests do; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir() or made


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it an action's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint()


def store(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    For inputs that several branches of one plan read: each branch then scans only
    its columns instead of computing the input again.
    """
    path = f"{scratch_root(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dim(df: DataFrame, rows: int | None, width: int = 64) -> DataFrame:
    """Ask for a broadcast only when ``rows * width`` is known to be small.

    ``rows`` is an upper bound the caller can prove (calendar length, fold
    count, pool size). Without a bound, or beyond the limit, the join is left to
    Catalyst and AQE, which measure the side at run time.
    """
    if rows is not None and rows * width <= BROADCAST_LIMIT:
        return F.broadcast(df)
    return df

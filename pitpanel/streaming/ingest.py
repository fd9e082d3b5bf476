"""Incremental ingest of landed price files with Structured Streaming.

The panel lies in parts (ticker bucket, year). A micro-batch rewrites only the parts it
touches, under ``data/batch=N``, and then lists in ``manifest/batch=N`` which batch holds
the current version of every part. Readers go by the newest complete list: they never see
half a batch, and a read needs no sort and no shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel import contracts
from pitpanel.session import scratch_root, shuffles_dropped
from pitpanel.sources.feeds import keep_first


#: Ticker buckets of the stored panel; a table keeps the count it was started with.
BUCKETS = 16
PART = ["bucket", "year"]
#: Steps in which a batch is merged.
SLICES = 4
#: Checksums are half of a row; as hexadecimal digits they shrink by half with this codec, and not at all with the default one.
CODEC = "zstd"


def _manifest(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """``(bucket, year, holder)`` of the newest complete batch, or of the newest below ``before``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/manifest")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    # a list is complete once its writer's success mark stands
    names = [s.getPath() for s in files.listStatus(path)]
    done = [int(n.getName().split("=")[1]) for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
    done = [b for b in done if before is None or b < before]
    if not done:
        return None
    return spark.read.schema("bucket int, year int, holder long").parquet(f"{table}/manifest/batch={max(done)}")


def _parts(spark: SparkSession, table: str, held: dict[tuple[int, int], int]) -> DataFrame:
    """Rows of the parts ``(bucket, year)``, each in the batch that holds it."""
    paths = [f"{table}/data/batch={holder}/bucket={bucket}/year={year}" for (bucket, year), holder in held.items()]
    if not paths:
        return spark.createDataFrame([], contracts.PRICES)
    return spark.read.schema(contracts.PRICES).parquet(*paths)


def _held(listed: DataFrame | None) -> dict[tuple[int, int], int]:
    """The list as a whole: a row a part, so buckets times years."""
    return {} if listed is None else {(r.bucket, r.year): r.holder for r in listed.collect()}


def merge_batch(batch: DataFrame, table: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Upsert ``batch`` by (date, ticker); within a batch the smallest checksum wins.

    A retry of the same batch starts from the list before it and writes the same parts. The batch is read
    where it lies, without a second copy; parts are merged in ``SLICES`` steps by bucket, one after the other, so
    that the shuffle files of one step alone lie on disk beside the parts.
    """
    spark = batch.sparkSession
    part = {"bucket": F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int"), "year": F.coalesce(F.year("date"), F.lit(0))}
    new = batch.withColumns(part)
    touched = sorted((r.bucket, r.year) for r in new.select(*PART).distinct().collect())
    held, mode = _held(_manifest(spark, table, before=batch_id)), "overwrite"
    for step in range(SLICES):
        mine = [p for p in touched if p[0] % SLICES == step]
        if not mine:
            continue
        rows = new.where(F.col("bucket") % SLICES == step).withColumn("_age", F.lit(0))
        old = {p: held[p] for p in mine if p in held}
        if old:
            rows = rows.unionByName(_parts(spark, table, old).withColumns(part).withColumn("_age", F.lit(1)))
        merged = keep_first(rows, ["date", "ticker", *PART], [F.col("_age"), F.col("raw_checksum")]).drop("_age")
        with shuffles_dropped(spark):
            merged.write.mode(mode).option("compression", CODEC).partitionBy(*PART).parquet(f"{table}/data/batch={batch_id}")
        mode = "append"
    now = held | dict.fromkeys(touched, batch_id)
    parts = spark.createDataFrame([(*p, holder) for p, holder in now.items()], "bucket int, year int, holder long")
    parts.coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/batch={batch_id}")


def ingest_once(spark: SparkSession, landing: str, table: str, checkpoint: str) -> None:
    """Merge every landed file not yet taken into ``table``, then stop.

    The checkpoint makes a restart skip files already taken.
    """
    stream = spark.readStream.schema(contracts.PRICES).parquet(landing)
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, table, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def ingested(spark: SparkSession, table: str) -> DataFrame:
    """The panel so far: for a key landed twice the latest batch wins."""
    return _parts(spark, table, _held(_manifest(spark, table)))


def fresh_workspace(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared scratch root."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

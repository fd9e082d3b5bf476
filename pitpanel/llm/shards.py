"""Proportional stratified interleaving into shards of equal row counts.

Rows of a source are put in a seeded random order and get the fractional rank
``(rank - 1/2) / rows of the source``. All rows are then ordered by fractional rank and
cut into equal runs, so that every shard holds each source in proportion.

Law: ``rows``, that is shard sizes in rows differ by one at most.

Only DataFrame functions are used. No order is ever established in one task: a rank is
the number of rows in lower buckets plus the rank inside the bucket. Buckets cut the
range of the seeded hash, or of the fractional rank, evenly into cells of about
``cell_rows`` rows, so a source with a third of all rows fills more buckets instead of a
longer one. Only counts per bucket are summed up in order, first within blocks of
buckets and then over blocks.

NULL sources are a stratum of their own; NULL and empty texts weigh 16 bytes; ties in
the hash are broken by id and text digest, and rows equal in all of these are
interchangeable. An empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitpanel.llm.common import table
from pitpanel.session import store

SEED = "shards-1"
BLOCK, SALTS = 1024, 64


def _before(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in lower buckets of the same ``keys``; ``counts`` has keys, ``bucket``, ``n``."""
    blocks = counts.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    inside = Window.partitionBy(*keys, "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy(*keys, "block").agg(F.sum("n").alias("m"))
    base = base.select(*keys, "block", F.coalesce(F.sum("m").over(over), F.lit(0)).alias("base"))
    return blocks.withColumn("part", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        base, [*keys, "block"]
    ).select(*keys, "bucket", (F.col("base") + F.col("part")).alias("before"))


def _unit(digest: Column) -> Column:
    """An integer below 2**48 from the first twelve hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def interleaved(docs: DataFrame, *, shards: int, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", seed: str = SEED, cell_rows: int = 2000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = store(docs.select(
        F.col(id_col).alias("doc_id"), F.concat(F.lit("s"), F.col(source_col).cast("string")).alias("source"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("draw"),
    ).withColumn("source", F.coalesce("source", F.lit("n"))), "shards")
    # dealt by source alone, a hot source would meet in one task: its total is copied to SALTS parts
    total = rows.groupBy("source").agg(F.count("*").alias("rows")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    )
    n = rows.count()
    cells = max(1, -(-n // cell_rows))
    # a bucket of a source is a slice of the hash range as wide as that source's share asks
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("draw", "doc_id"), F.lit(SALTS)))
    dealt = salted.join(total, ["source", "salt"]).drop("salt").withColumn("unit", _unit(F.col("draw"))).withColumn(
        "bucket", F.floor(F.col("unit") / F.lit(float(1 << 48)) * F.ceil(F.col("rows") / cell_rows))
    )
    counts = dealt.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "text_crc32", "size")
    ranked = dealt.join(_before(counts, ["source"]), ["source", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(inside)
    )
    placed = store(ranked.select(
        "doc_id", "size", "text_crc32", "source", "draw", "rank", "rows",
        ((2 * F.col("rank") - 1) / (2 * F.col("rows"))).alias("fraction"),
    ).withColumn("cell", F.least(F.floor(F.col("fraction") * cells), F.lit(cells - 1)).cast("long")), "shards")
    by_cell = placed.groupBy(F.col("cell").alias("bucket")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("cell").orderBy("fraction", "source", "draw", "doc_id", "text_crc32", "size")
    at = placed.join(
        _before(by_cell.withColumn("all", F.lit(0)), ["all"]).select(F.col("bucket").alias("cell"), "before"), "cell"
    ).withColumn("position", F.col("before") + F.row_number().over(order) - 1)
    return at.withColumn("shard", F.expr(f"cast(position * {shards} div {max(n, 1)} AS int)")).withColumn(
        "first", F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    ).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards with the corpus mixture in each."""
    return interleaved(table(spark, sf_dir, "documents"), shards=40)

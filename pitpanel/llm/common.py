"""Shared helpers of the operators: reading, Arrow batches, lineage, words, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.session import cut_lineage, store

#: Rows and bytes that one Arrow batch may hold; bounds the Python side whatever a row weighs.
BATCH_ROWS, BATCH_BYTES = 512, 16 * 1024 * 1024
#: Signs of text that are worked on at a time.
PIECE = 1 << 22

#: Bits of the map that tells rows without a partner from the others.
MEMBER_BITS = 1 << 25

__all__ = [
    "batches", "batches_of", "components", "cut_lineage", "fresh", "pieces", "possible", "store", "table", "text_words",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, setup=None) -> DataFrame:
    """``fn`` over Arrow batches of bounded size; ``setup()`` runs once per task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in it:
            if batch.num_rows:
                yield fn(batch, state) if setup else fn(batch)

    return batches_of(df, run, schema)


def batches_of(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded size."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def pieces(texts: list[str | None], signs: int = PIECE) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive rows of about so many ``signs``, each text whole, with the first row's number."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > signs:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, texts[first:]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def possible(df: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``name``, false only where ``column`` is surely not in the one column of ``keys``.

    A map of hashed keys, ``MEMBER_BITS`` at most whatever the tables hold, goes to every task. So heavy rows
    without a partner need not be shuffled for a join; the join itself decides on the others.
    """
    if df.schema[column].dataType != keys.schema[0].dataType:  # equal values may have other hashes
        return df.withColumn(name, F.lit(True))
    word, bits, at = fresh(df, "word", "bits", "at")
    where = keys.select(F.pmod(F.xxhash64(keys.columns[0]), F.lit(MEMBER_BITS)).alias(at))
    words = store(where.groupBy(F.shiftright(at, 6).alias(word)).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST({at} % 64 AS INT))")).alias(bits)
    ), "members")
    placed = df.withColumn(at, F.pmod(F.xxhash64(column), F.lit(MEMBER_BITS))).withColumn(word, F.shiftright(at, 6))
    known = placed.join(F.broadcast(words), word, "left")
    found = F.coalesce(F.getbit(bits, F.col(at) % 64) == 1, F.lit(False))
    return known.withColumn(name, found).select(*df.columns, name)


def text_words(text: Column) -> Column:
    """Number of words between white space; 0 for NULL."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x09-\x0D\x20]+"), lambda w: w != "")), F.lit(0)).cast("long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` of every id in ``links(a, b)``; ``component`` is the smallest id reachable.

    Large-star and small-star rounds: each round hangs the neighbours of an id on
    its smallest neighbour, so depth falls geometrically and rows stay bounded by
    the links. A hub's neighbours are never gathered: the minimum is a partial
    aggregate and the join that follows splits skewed keys. Each round is cut by a
    reliable checkpoint. Reaching ``max_rounds`` raises; nothing is left half done.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(joined.select("a", F.col("m").alias("b"))).distinct()
        )
        edges = cut_lineage(small)
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select("b", F.lit(0), F.lit(1))
        )
        # settled: every id hangs on one centre, and no centre hangs on anything
        state = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if state.where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            roots = edges.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Line dedup by site-relative frequency.

Pages are grouped by host; the pages that hold a line are divided by the host's pages,
and lines above a boilerplate ratio are dropped from every page of that host. A line
counts once per page, trimmed of white space; blank lines are never dropped.

Only DataFrame functions are used. Lines travel as two 64-bit hashes and are counted
with a partial aggregate, so a hot host or a hot line shrinks before the shuffle. A
host has at most (lines per page / ratio) boilerplate lines, so its list is bounded by
the data model and not by the corpus; the lists are written once, and whether they are
broadcast or joined by a shuffle is decided on their measured size. Texts themselves
are not shuffled unless those lists are large.

A NULL host is a host of its own. NULL texts stay NULL, empty texts stay empty.
Repeated rows count as pages of their own. An empty table gives no rows. Extra columns
are kept; added ones that would clash get a leading underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.common import fresh, table
from pitpanel.session import store


def _digest(line: Column) -> Column:
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("h"), F.xxhash64(F.lit("line"), trimmed).alias("g"))


def boilerplate(docs: DataFrame, *, host_col: str, text_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """``(host, lines)``: digests of the lines to drop, as one array per host."""
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.split(text_col, "\n").alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    wanted = F.filter("lines", lambda x: F.trim(x) != "")
    held = pages.select("host", F.explode(F.array_distinct(F.transform(wanted, _digest))).alias("line"))
    counted = held.groupBy("host", "line.h", "line.g").agg(F.count("*").alias("holders")).where(F.col("holders") >= min_pages)
    frequent = counted.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(
        F.col("holders") > max_ratio * F.col("pages")
    )
    return frequent.groupBy("c.host").agg(F.collect_list(F.struct("h", "g")).alias("lines"))


def drop_lines(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.02,
               min_pages: int = 5) -> DataFrame:
    """``docs`` with its boilerplate lines removed, the count of lines and of dropped lines."""
    bad = store(boilerplate(docs, host_col=host_col, text_col=text_col, max_ratio=max_ratio, min_pages=min_pages), "lines")
    host, dropped, lines, kept, n_lines, n_dropped = fresh(
        docs, "b_host", "b_lines", "lines", "kept_lines", "n_lines", "n_dropped"
    )
    bad = bad.select(F.col("host").alias(host), F.col("lines").alias(dropped))
    joined = docs.join(bad, F.col(host_col).cast("string").eqNullSafe(F.col(host)), "left")
    split = joined.withColumn(lines, F.split(text_col, "\n"))
    filtered = split.withColumn(
        kept, F.when(F.col(dropped).isNull(), F.col(lines)).otherwise(
            F.filter(lines, lambda x: ~F.array_contains(F.col(dropped), _digest(x)))
        )
    )
    out = filtered.withColumn(n_lines, F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn(
        n_dropped, F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long")
    ).withColumn(text_col, F.array_join(kept, "\n"))
    return out.drop(host, dropped, lines, kept)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on more than 2% of a source's documents, five at least, leave all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs, max_ratio=0.02, min_pages=5)

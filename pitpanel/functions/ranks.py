"""Cross-sectional statistics whose groups grow with the data.

A cross-section (all tickers on one date) is as large as the universe, so it is
never sorted inside one task: moments are partial aggregates, and ranks are put
together from counts per value bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.session import cut_lineage, dim


def with_average_rank(
    df: DataFrame,
    by: list[str],
    value: str,
    rank: str,
    pct: bool = False,
    groups: int | None = None,
    buckets: int = 64,
) -> DataFrame:
    """Exact rank of ``value`` within ``by``, ties sharing their average rank.

    1. Count rows per distinct value, which folds any mass of ties into one row.
    2. Cut the distinct values of each group at approximate quantiles. Where the
       cuts fall only balances the buckets; it cannot change a rank, as long as all
       uses see the same cuts. A sketch depends on the order in which its parts meet,
       so the cuts (a row per group) are computed once and kept.
    3. Rank = rows in lower buckets + running count inside the bucket.

    ``groups`` is an upper bound on the number of groups, if the caller has one.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    levels = [i / buckets for i in range(1, buckets)]
    cuts = cut_lineage(counts.groupBy(*by).agg(
        F.percentile_approx(value, levels, 1000).alias("_cuts"), F.sum("_n").alias("_all")
    ))
    placed = counts.join(dim(cuts, groups, 16 * buckets), by).withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    )
    below = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_b").agg(F.sum("_n").alias("_in"))
    offsets = totals.select(*by, "_b", F.coalesce(F.sum("_in").over(below), F.lit(0)).alias("_off"))
    bound = None if groups is None else groups * buckets
    running = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    through = F.col("_off") + F.sum("_n").over(running)
    average = through - (F.col("_n") - 1) / 2
    ranked = placed.join(dim(offsets, bound, 48), [*by, "_b"]).select(
        *by, value, (average / F.col("_all") if pct else average.cast("double")).alias(rank)
    )
    # rows without a value have no rank; a digest spreads them, or they would share one task
    spread = F.when(F.col(value).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(4096))).otherwise(F.lit(0))
    keyed = df.withColumn("_spread", spread.cast("long"))
    return keyed.join(ranked.withColumn("_spread", F.lit(0).cast("long")), [*by, value, "_spread"], "left").drop("_spread")


def with_zscores(
    df: DataFrame, by: list[str], columns: dict[str, str], groups: int | None = None
) -> DataFrame:
    """``(x - mean) / (population std + 1e-12)`` within each group."""
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{o}") for c, o in columns.items()],
        *[F.stddev_pop(c).alias(f"_s_{o}") for c, o in columns.items()],
    )
    scaled = {
        o: (F.col(c) - F.col(f"_m_{o}")) / (F.col(f"_s_{o}") + F.lit(1e-12))
        for c, o in columns.items()
    }
    drop = [f"_{p}_{o}" for o in columns.values() for p in "ms"]
    return df.join(dim(stats, groups, 32 * len(columns)), by).withColumns(scaled).drop(*drop)

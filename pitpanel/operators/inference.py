"""Block bootstrap and multiple-test adjustment as joins and aggregates.

A resample of whole blocks needs only sums over blocks, and the sum of any block is a
difference of two running sums; values themselves are never repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.scalars import md5_draw, ratio


def paired_differences(returns: DataFrame, first: str, others: list[str] | None = None) -> DataFrame:
    """(test, pos, x): date-aligned differences of ``first`` to each other strategy, or to ``others``."""
    mean = returns.groupBy("strategy", "date").agg(F.avg("ret").alias("ret"))
    a = mean.where(F.col("strategy") == first).select("date", F.col("ret").alias("_a"))
    peer = F.col("strategy") != first if others is None else F.col("strategy").isin(others)
    b = mean.where(peer).select("strategy", "date", "ret")
    joined = b.join(a, "date").where(F.col("ret").isNotNull() & F.col("_a").isNotNull())
    named = joined.select(
        F.concat(F.lit(f"{first}_vs_"), F.col("strategy")).alias("test"),
        "date",
        (F.col("_a") - F.col("ret")).alias("x"),
    )
    return positioned(named, "test")


def positioned(series: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*(order or ["date"]))
    return series.withColumn("pos", F.row_number().over(w) - 1)


def block_sums(series: DataFrame, key: str, block: int) -> DataFrame:
    """(key, pos, n, and sums over the block that starts at ``pos``), from running sums.

    ``s`` and ``q`` are the sums of ``x`` and of its square over ``block`` values, ``ts`` and ``tq`` those over
    the ``n`` mod ``block`` values of a replicate's last block (``block`` of them if that is 0). Differences of
    running sums: a stretch of zeros gives 0 exactly.
    """
    along = Window.partitionBy(key).orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    run = series.select(
        key, "pos", F.sum("x").over(upto).alias("c"), F.sum(F.col("x") * F.col("x")).over(upto).alias("d"),
        F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"),
    )
    tail = ((F.col("n") - 1) % block + 1).cast("int")
    zero = F.lit(0.0)
    whole = run.withColumns({
        "c0": F.coalesce(F.lag("c").over(along), zero), "d0": F.coalesce(F.lag("d").over(along), zero),
        "c1": F.lead("c", block - 1).over(along), "d1": F.lead("d", block - 1).over(along), "tail": tail,
    })
    ends = run.select(F.col(key).alias("_key"), (F.col("pos") - tail + 1).alias("_at"), F.col("c").alias("c2"), F.col("d").alias("d2"))
    joined = whole.join(ends, (F.col(key) == F.col("_key")) & (F.col("pos") == F.col("_at")))
    return joined.select(
        key, "pos", "n", (F.col("c1") - F.col("c0")).alias("s"), (F.col("d1") - F.col("d0")).alias("q"),
        (F.col("c2") - F.col("c0")).alias("ts"), (F.col("d2") - F.col("d0")).alias("tq"),
    )


def block_resamples(
    series: DataFrame, key: str, seed: int, samples: int, block: int
) -> DataFrame:
    """(key, replicate, n, total, squares): sums of circularless block resamples of ``series`` (key, pos, x).

    Each replicate draws ceil(n / block) block starts; its first n values are
    kept. Starts come from an md5 of (seed, key, replicate, block number). A start is
    joined with the sums of its block, so a replicate costs a row per block, not per value.
    Series shorter than two blocks give no resample.
    """
    lengths = series.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * block)
    blocks = F.ceil(F.col("n") / block).cast("int")
    starts = (
        lengths.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            key, "replicate", (F.col("b") == blocks - 1).alias("last"),
            md5_draw(F.col("n") - block + 1, F.lit(str(seed)), key, "replicate", "b").alias("pos"),
        )
    )
    taken = starts.join(block_sums(series, key, block), [key, "pos"])
    return taken.groupBy(key, "replicate").agg(
        F.first("n").alias("n"), F.sum(F.when(F.col("last"), F.col("ts")).otherwise(F.col("s"))).alias("total"),
        F.sum(F.when(F.col("last"), F.col("tq")).otherwise(F.col("q"))).alias("squares"),
    )


def paired_block_bootstrap(
    series: DataFrame, seed: int, samples: int = 500, block: int = 10
) -> DataFrame:
    """(test, mean_difference, ci_low, ci_high, p_value); too short gives NULLs."""
    base = series.groupBy("test").agg(F.avg("x").alias("mean_difference"))
    means = block_resamples(series, "test", seed, samples, block).withColumn("m", F.col("total") / F.col("n"))
    below = F.avg((F.col("m") <= 0).cast("double"))
    above = F.avg((F.col("m") >= 0).cast("double"))
    stats = means.groupBy("test").agg(
        F.percentile("m", F.lit(0.025)).alias("ci_low"),
        F.percentile("m", F.lit(0.975)).alias("ci_high"),
        F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p_value"),
    )
    return base.join(stats, "test", "left")


def sharpe_interval(
    returns: DataFrame,
    risk_free: float,
    seed: int,
    samples: int = 300,
    block: int = 10,
    periods: int = 252,
) -> DataFrame:
    """(strategy, sharpe_ci_low, sharpe_ci_high) of the arithmetic Sharpe ratio."""
    series = positioned(
        returns.where(F.col("ret").isNotNull()).select(
            "strategy", "fold", "date", F.col("ret").alias("x")
        ),
        "strategy",
        ["fold", "date"],
    )
    n, total = F.col("n"), F.col("total")
    spread = (F.col("squares") - total * total / n) / (n - 1)
    per = block_resamples(series, "strategy", seed, samples, block).withColumns(
        {"m": total / n, "s": F.sqrt(F.greatest(spread, F.lit(0.0)))}
    )
    vol = F.col("s") * float(periods) ** 0.5
    sharpe = per.withColumn("v", ratio(F.col("m") * periods - risk_free, vol))
    bounds = sharpe.groupBy("strategy").agg(
        F.percentile("v", F.lit(0.025)).alias("sharpe_ci_low"),
        F.percentile("v", F.lit(0.975)).alias("sharpe_ci_high"),
    )
    return series.select("strategy").distinct().join(bounds, "strategy", "left")


def holm_adjust(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values over the tests that have one.

    The unkeyed window sees one row per test.
    """
    known = tests.where(F.col("p_value").isNotNull() & ~F.isnan("p_value"))
    by_p = Window.orderBy("p_value", "test")
    running = by_p.rowsBetween(Window.unboundedPreceding, 0)
    total = F.count(F.lit(1)).over(Window.partitionBy())
    stepped = known.withColumns({"_m": total, "_k": F.row_number().over(by_p)})
    scaled = (F.col("_m") - F.col("_k") + 1) * F.col("p_value")
    adjusted = stepped.withColumn(
        "p_value_holm", F.least(F.lit(1.0), F.max(scaled).over(running))
    ).select("test", "p_value_holm")
    verdict = (
        F.when(F.col("p_value_holm").isNull(), "insufficient_observations")
        .when(F.col("p_value_holm") < level, "significant")
        .otherwise("not_significant")
    )
    return tests.join(adjusted, "test", "left").withColumn("conclusion", verdict)

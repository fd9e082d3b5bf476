"""Performance metrics, market regimes and summaries of return series.

Series are one row per (strategy, date), so every ordered window here is as long
as the calendar at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.rolling import filled
from pitpanel.functions.scalars import ratio
from pitpanel.session import dim


def wealth_curve(
    returns: DataFrame, by: list[str], order: list[str] | None = None, value: str = "ret"
) -> DataFrame:
    """Compounded wealth, running peak and drawdown. The peak starts at the first wealth."""
    w = Window.partitionBy(*by).orderBy(*(order or ["date"])).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.where(F.col(value).isNotNull()).withColumn(
        "wealth", F.product(1 + F.col(value)).over(w)
    )
    return grown.withColumn("peak", F.max("wealth").over(w)).withColumn(
        "drawdown", ratio(F.col("wealth"), F.col("peak")) - 1
    )


def performance_metrics(
    returns: DataFrame,
    by: list[str],
    risk_free: float = 0.03,
    order: list[str] | None = None,
    value: str = "ret",
    periods: int = 252,
) -> DataFrame:
    """Nine metrics per group: a wealth window, then one aggregate."""
    r, year = F.col(value), float(periods) ** 0.5
    keys = F.struct(*(order or ["date"]))
    agg = (
        wealth_curve(returns, by, order, value)
        .groupBy(*by)
        .agg(
            F.max_by("wealth", keys).alias("_w"),
            F.count(F.lit(1)).alias("observations"),
            (F.stddev_samp(r) * year).alias("annualized_volatility"),
            (F.stddev_samp(F.when(r < 0, r)) * year).alias("_down"),
            F.min("drawdown").alias("max_drawdown"),
            F.avg((r > 0).cast("double")).alias("positive_day_ratio"),
        )
    )
    grown = agg.withColumns(
        {
            "cumulative_return": F.col("_w") - 1,
            "annualized_return": F.pow("_w", F.lit(float(periods)) / F.col("observations")) - 1,
        }
    )
    excess = F.col("annualized_return") - risk_free
    return grown.select(
        *by,
        "cumulative_return",
        "annualized_return",
        "annualized_volatility",
        ratio(excess, F.col("annualized_volatility")).alias("sharpe"),
        ratio(excess, F.col("_down")).alias("sortino"),
        "max_drawdown",
        ratio(F.col("annualized_return"), F.abs("max_drawdown")).alias("calmar"),
        "positive_day_ratio",
        "observations",
    )


def expanding_median(rows: DataFrame, value: str, name: str, levels: int = 5, bits: int = 5) -> DataFrame:
    """``rows`` with the median of all non-null values up to each date; one row per date.

    Order statistics by bisection: values are ranked once, and every date asks for the one
    or two ranks in its middle. On each level all ranks and questions of a node lie in date
    order; running counts per child of the node tell a question where its rank lies. That is
    ``levels`` passes over three rows a date, and ``2 ** (levels * bits)`` dates, more than
    the date type has, can be told apart.
    """
    width = 1 << bits
    seen = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    row = F.struct(*rows.columns)
    ranked = rows.select(
        "date",
        F.col(value).alias("_v"),
        row.alias("_row"),
        F.count(F.col(value)).over(seen).alias("_n"),
        (F.row_number().over(Window.orderBy(F.col(value).asc_nulls_last(), "date")) - 1).alias("_rank"),
    )
    # a row with its value asks nothing; its two questions hold how many values must lie at or below the answer
    asked = [F.struct(F.expr(f"CASE WHEN _n > 0 THEN (_n + {k}) div 2 END").alias("left"), F.lit(None).alias("v"), F.lit(None).alias("row")) for k in (1, 2)]
    own = F.struct(F.lit(None).cast("long").alias("left"), F.col("_v").alias("v"), F.col("_row").alias("row"))
    state = ranked.select("date", "_rank", F.explode(F.array(own, *asked)).alias("_q")).select(
        "date", "_rank", "_q.*", F.lit(0).cast("long").alias("_node")
    )
    held = F.col("v").isNotNull()
    for level in range(levels):
        digit = F.shiftright("_rank", bits * (levels - 1 - level)).bitwiseAND(width - 1)
        upto = Window.partitionBy("_node").orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
        counts = F.array(*[F.count(F.when(held & (digit <= j), 1)).over(upto) for j in range(width)])
        # lower children, all of whose ranks come before the one asked for
        below = F.filter("_counts", lambda c: c < F.col("left"))
        state = state.withColumn("_counts", counts).withColumn("_below", below).select(
            "date", "_rank", "v", "row",
            (F.col("left") - F.coalesce(F.array_max("_below"), F.lit(0))).alias("left"),
            (F.col("_node") * width + F.when(F.col("left").isNull(), digit).otherwise(F.size("_below"))).alias("_node"),
        )
    found = state.withColumn("_found", F.max("v").over(Window.partitionBy("_node")))
    answer = F.avg(F.when(F.col("left").isNotNull(), F.col("_found"))).alias(name)
    return found.groupBy("date").agg(F.max("row").alias("_row"), answer).select("_row.*", name)


def market_regimes(market: DataFrame, n: int = 60, band: float = 0.05) -> DataFrame:
    """(date, regime) from trailing market information only.

    ``market``: (date, market_ret), one row per date; the unkeyed windows see the
    calendar, never the panel.
    """
    m = F.col("market_ret")
    frame = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    all_before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    trailing = market.withColumns(
        {
            "trailing_return": filled(n, m, F.product(1 + m).over(frame) - 1, frame),
            "trailing_vol": filled(n, m, F.stddev_samp(m).over(frame), frame),
        }
    )
    v = F.col("trailing_vol")
    known = F.count(v).over(all_before) >= n
    middle = expanding_median(trailing, "trailing_vol", "vol_median").withColumn(
        "vol_median", F.when(known, F.col("vol_median"))
    )
    trend = (
        F.when(F.col("trailing_return") > band, "bull")
        .when(F.col("trailing_return") < -band, "bear")
        .otherwise("sideway")
    )
    stress = F.when(v > F.col("vol_median"), "_high_vol").otherwise("_low_vol")
    return middle.withColumn("regime", F.concat(trend, stress))


def metrics_by_regime(
    returns: DataFrame, regimes: DataFrame, risk_free: float = 0.03, dates: int | None = None, periods: int = 252
) -> DataFrame:
    labelled = returns.join(dim(regimes.select("date", "regime"), dates, 48), "date", "left")
    return performance_metrics(labelled, ["strategy", "regime"], risk_free, ["date", "fold"], periods=periods)


def returns_wide(returns: DataFrame, strategies: list[str]) -> DataFrame:
    """One column per strategy, the mean of its returns on each date."""
    return returns.groupBy("date").pivot("strategy", strategies).agg(F.avg("ret"))


def rank_ic_summary(ic: DataFrame) -> DataFrame:
    """Mean, median and range of the per-fold rank correlation."""
    per_fold = ic.groupBy("fold").agg(F.first("rank_ic", ignorenulls=True).alias("ic"))
    return per_fold.agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("ic").alias("mean_ic"),
        F.percentile("ic", F.lit(0.5)).alias("median_ic"),
        F.min("ic").alias("min_ic"),
        F.max("ic").alias("max_ic"),
    )


def ablation_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("configuration", "selector", "solver").agg(
        F.count_distinct("fold").alias("folds"),
        F.avg("objective").alias("objective_mean"),
        F.avg("feasibility_rate").alias("feasibility_rate"),
        F.avg("optimality_gap").alias("optimality_gap"),
        F.avg("turnover").alias("turnover_mean"),
        F.sum("transaction_cost").alias("transaction_cost"),
    )


def sensitivity_summary(grid: DataFrame, by: list[str]) -> DataFrame:
    return grid.groupBy(*by).agg(
        F.avg("net_return").alias("net_return_mean"),
        F.avg("gross_return").alias("gross_return_mean"),
        F.avg("turnover").alias("turnover_mean"),
        F.count(F.lit(1)).alias("cases"),
    )

"""Turnover, drift, costs and portfolio returns for weights per (strategy, fold)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.operators.folds import fold_dates
from pitpanel.operators.moments import PROBLEM
from pitpanel.session import dim


def equal_weights(chosen: DataFrame) -> DataFrame:
    """1/k for each chosen ticker."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*PROBLEM))
    return chosen.select(*PROBLEM, "ticker", (F.lit(1.0) / size).alias("weight"))


def holdings(
    weights: DataFrame, returns: DataFrame, folds: DataFrame, rows: int | None = None
) -> DataFrame:
    """Daily rows of held tickers in each fold's test window ``(start, end]``.

    Test windows are stretched to days, so the panel is joined on (ticker, date) and
    only those dates are read. A missing return counts as zero.
    """
    days = fold_dates(folds).where("role = 'test'").select("fold", "date")
    held = weights.join(days, "fold")
    daily = returns.select("ticker", "date", "ret1").join(dim(held, None if rows is None else rows * 62, 96), ["ticker", "date"])
    return daily.select(
        *PROBLEM, "ticker", "weight", "date", F.coalesce("ret1", F.lit(0.0)).alias("ret1")
    )


def holding_growth(daily: DataFrame) -> DataFrame:
    """Compounded growth of each held ticker over the test window."""
    return daily.groupBy(*PROBLEM, "ticker").agg(F.product(1 + F.col("ret1")).alias("growth"))


def drift(weights: DataFrame, growth: DataFrame) -> DataFrame:
    """Weights after the test window; a worthless portfolio keeps its targets."""
    moved = weights.join(growth, [*PROBLEM, "ticker"], "left").withColumn(
        "_v", F.col("weight") * F.coalesce("growth", F.lit(1.0))
    )
    total = F.sum("_v").over(Window.partitionBy(*PROBLEM))
    alive = F.coalesce(total > 0, F.lit(False))
    return (
        moved.withColumns({"_alive": alive, "_total": total})
        .withColumn(
            "drifted",
            F.when(F.col("_alive"), F.try_divide(F.col("_v"), F.col("_total"))).otherwise(
                F.col("weight")
            ),
        )
        .where(~F.col("_alive") | (F.col("drifted") > 1e-12))
        .select(*PROBLEM, "ticker", "weight", "drifted")
    )


def trades(weights: DataFrame, drifted: DataFrame, cost_bps: Column | float) -> DataFrame:
    """Trades of each fold against the previous completed fold's drifted weights."""
    cost = cost_bps if isinstance(cost_bps, Column) else F.lit(float(cost_bps))
    order = Window.partitionBy("strategy").orderBy("fold")
    done = weights.select(*PROBLEM).distinct().withColumn("next_fold", F.lead("fold").over(order))
    before = (
        drifted.join(done, PROBLEM)
        .where(F.col("next_fold").isNotNull())
        .select(
            "strategy",
            F.col("next_fold").alias("fold"),
            "ticker",
            F.col("drifted").alias("pre_trade_weight"),
        )
    )
    both = weights.select(*PROBLEM, "ticker", F.col("weight").alias("target_weight")).join(
        before, [*PROBLEM, "ticker"], "full"
    )
    both = both.fillna(0.0, ["target_weight", "pre_trade_weight"])
    change = F.col("target_weight") - F.col("pre_trade_weight")
    return both.withColumn("trade_weight", change).withColumns(
        {
            "turnover": F.abs("trade_weight"),
            "transaction_cost": F.abs("trade_weight") * cost / 10000.0,
        }
    )


def turnover(traded: DataFrame) -> DataFrame:
    return traded.groupBy(*PROBLEM).agg(
        F.sum("turnover").alias("turnover"), F.sum("transaction_cost").alias("transaction_cost")
    )


def portfolio_returns(daily: DataFrame, costs: DataFrame) -> DataFrame:
    """(strategy, fold, date, ret): weighted returns, cost taken on the first date."""
    gross = daily.groupBy(*PROBLEM, "date").agg(F.sum(F.col("weight") * F.col("ret1")).alias("gross"))
    first = F.min("date").over(Window.partitionBy(*PROBLEM))
    charged = gross.withColumn("_first", first).join(costs, PROBLEM, "left")
    fee = F.when(F.col("date") == F.col("_first"), F.coalesce("transaction_cost", F.lit(0.0)))
    return charged.select(
        *PROBLEM, "date", "gross", (F.col("gross") - F.coalesce(fee, F.lit(0.0))).alias("ret")
    )


@dataclass
class Backtest:
    daily: DataFrame
    drifted: DataFrame
    trades: DataFrame
    turnover: DataFrame
    returns: DataFrame


def backtest(
    weights: DataFrame,
    returns: DataFrame,
    folds: DataFrame,
    cost_bps: Column | float = 10.0,
    rows: int | None = None,
) -> Backtest:
    """All backtest tables, lazy, for every strategy and fold together."""
    daily = holdings(weights, returns, folds, rows)
    drifted = drift(weights, holding_growth(daily))
    traded = trades(weights, drifted, cost_bps)
    costs = turnover(traded)
    return Backtest(daily, drifted, traded, costs, portfolio_returns(daily, costs))


def cardinality_cost_grid(
    gross: DataFrame, costs: DataFrame, bps: list[float]
) -> DataFrame:
    """Net compounded return per (strategy, fold, cost level).

    ``gross``: portfolio returns before cost; ``costs``: turnover per problem.
    """
    held = gross.groupBy(*PROBLEM).agg((F.product(1 + F.col("gross")) - 1).alias("gross_return"))
    levels = F.array(*[F.lit(float(b)) for b in bps])
    grid = held.join(costs.select(*PROBLEM, "turnover"), PROBLEM).withColumn(
        "transaction_cost_bps", F.explode(levels)
    )
    net = F.col("gross_return") - F.col("turnover") * F.col("transaction_cost_bps") / 10000.0
    return grid.withColumn("net_return", net)

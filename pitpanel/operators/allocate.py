"""Weights of chosen subsets by enumerating active sets, each strategy's folds in order.

Minimised is ``a w'Cw - mu'w + t |w - p|`` over weights between bounds that sum to one, where ``p`` are
the weights held before. At the minimum every asset is in one of five states: at the lower
bound, at the upper bound, at its old weight, below it, or above it. A pattern gives each
asset a state; its linear system (first-order conditions of the free assets, the given
weights of the others, the sum) has one solution, which is affine in ``p``. The problem is
strictly convex, so the feasible solution with the least objective is the minimum.

Patterns are rows: all folds and strategies are solved at once, without knowing ``p``, by
Gauss-Jordan steps on arrays. What has to be sequential, since the weights of a fold drift
into the next fold's ``p``, is only a walk over the solved folds of a strategy: evaluate the
patterns at ``p``, take the best, drift. Its row holds folds x patterns x k(k+1) numbers, whatever
the number of tickers, dates or prices.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.moments import PROBLEM

#: Most assets that a subset may hold: 5 ** MAX_HELD patterns are solved for each.
MAX_HELD = 5
#: How far a weight may miss a bound, or the sum miss one, by rounding.
SLACK = 1e-9
LOWER, UPPER, KEEP, SELL, BUY = range(5)
HELD = "array<struct<ticker:string,weight:double>>"
ROWS = "array<struct<fold:int,ticker:string,weight:double,pre_trade_weight:double>>"


@dataclass(frozen=True)
class WeightRule:
    lower: float = 0.0
    upper: float = 0.6
    risk_aversion: float = 1.0
    turnover_penalty: float = 0.001


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once."""
    return F.transform(F.array(value), body)[0]


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _clean(values: Column) -> Column:
    """Missing and undefined numbers as 0."""
    return F.transform(values, lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))


def eliminated(rows: Column, n: Column) -> Column:
    """Gauss-Jordan on an array of rows: column ``i`` becomes the i-th unit vector, for ``i`` below ``n``.

    Pivots are taken in order; a pivot of 0 leaves a row of zeros.
    """

    def step(m: Column, i: Column) -> Column:
        pivot = F.get(F.get(m, i), i)
        lead = F.transform(F.get(m, i), lambda x: F.when(F.abs(pivot) > 1e-15, x / pivot).otherwise(F.lit(0.0)))
        return _let(
            lead,
            lambda r: F.transform(
                m, lambda row, j: F.when(j == i, r).otherwise(F.zip_with(row, r, lambda x, y: x - F.get(row, i) * y))
            ),
        )

    return F.aggregate(_upto(n), rows, step)


def pattern_solutions(problems: DataFrame, rule: WeightRule) -> DataFrame:
    """One row per problem and pattern: ``at``, for each asset the constant and the factors of ``p``.

    ``problems``: (strategy, fold, k, mu, cov), ``cov`` row by row.
    """
    a, t, k = rule.risk_aversion, rule.turnover_penalty, F.col("k")
    patterns = problems.select(
        *PROBLEM, "k", "mu", "cov", F.explode(F.expr("sequence(0, cast(power(5, k) as int) - 1)")).alias("pattern")
    )
    states = F.transform(_upto(k), lambda i: F.floor(F.col("pattern") / F.pow(F.lit(5.0), i.cast("double"))).cast("int") % 5)
    patterns = patterns.withColumn("states", states)

    def cell(i: Column, c: Column) -> Column:
        """Columns: k weights, the multiplier of the sum, the constant, k old weights."""
        state = F.get("states", i)
        side = F.when(state == SELL, -1.0).otherwise(1.0)
        free = (
            F.when(c < k, 2.0 * a * F.get("cov", i * k + c)).when(c == k, F.lit(-1.0))
            .when(c == k + 1, F.get("mu", i) - t * side).otherwise(0.0)
        )
        bound = F.when(state == LOWER, rule.lower).when(state == UPPER, rule.upper).otherwise(0.0)
        given = (
            F.when(c == i, 1.0).when(c == k + 1, bound)
            .when((state == KEEP) & (c == k + 2 + i), 1.0).otherwise(0.0)
        )
        total = F.when((c < k) | (c == k + 1), 1.0).otherwise(0.0)
        return F.when(i == k, total).when(state >= SELL, free).otherwise(given)

    system = F.transform(F.sequence(F.lit(0), k), lambda i: F.transform(F.sequence(F.lit(0), 2 * k + 1), lambda c: cell(i, c)))
    solved = F.slice(eliminated(system, k + 1), F.lit(1), k)
    at = F.flatten(F.transform(solved, lambda row: F.slice(row, k + 2, k + 1)))
    return patterns.select(*PROBLEM, "pattern", at.alias("at"))


def _held(holdings: Column, ticker: Column) -> Column:
    hit = F.filter(holdings, lambda h: h["ticker"] == ticker)
    return F.coalesce(F.get(hit, F.lit(0))["weight"], F.lit(0.0))


def best_weights(fold: Column, prev: Column, rule: WeightRule) -> Column:
    """Weights of the best feasible pattern of one solved fold, at the old weights ``prev``."""
    k = F.size(fold["mu"])

    def scored(option: Column) -> Column:
        def asset(i: Column) -> Column:
            first = i * (k + 1)
            return F.get(option["at"], first) + _sum(
                F.transform(prev, lambda p, j: p * F.get(option["at"], first + 1 + j))
            )

        def judged(w: Column) -> Column:
            inside = F.forall(w, lambda x: (x >= rule.lower - SLACK) & (x <= rule.upper + SLACK))
            risk = _sum(F.transform(w, lambda x, i: x * _sum(F.transform(w, lambda y, j: y * F.get(fold["cov"], i * k + j)))))
            reward = _sum(F.zip_with(w, fold["mu"], lambda x, m: x * m))
            moved = _sum(F.zip_with(w, prev, lambda x, p: F.abs(x - p)))
            goal = rule.risk_aversion * risk - reward + rule.turnover_penalty * moved
            return F.when(
                inside & (F.abs(_sum(w) - 1.0) <= SLACK), F.struct(goal.alias("goal"), option["pattern"].alias("pattern"), w.alias("w"))
            )

        return _let(F.transform(_upto(k), asset), judged)

    best = F.array_min(F.filter(F.transform(fold["options"], scored), lambda o: o.isNotNull()))
    return F.transform(best["w"], lambda x: F.least(F.greatest(x, F.lit(rule.lower)), F.lit(rule.upper)))


def _walked(folds: Column, rule: WeightRule) -> Column:
    """Rows of all folds of a strategy in order; the state is what the last fold's weights drifted to."""

    def step(state: Column, fold: Column) -> Column:
        held = state["held"]

        def traded(w: Column) -> Column:
            target = F.zip_with(
                fold["tickers"], w, lambda name, x: F.struct(name.alias("ticker"), x.alias("weight"))
            )
            grown = F.zip_with(w, fold["growth"], lambda x, g: x * g)
            total = _sum(grown)
            alive = (total > 0) & (total < float("inf"))
            drifted = F.zip_with(
                fold["tickers"], grown, lambda name, v: F.struct(name.alias("ticker"), F.try_divide(v, total).alias("weight"))
            )
            names = F.array_sort(F.array_union(F.transform(held, lambda h: h["ticker"]), fold["tickers"]))
            rows = F.transform(
                names,
                lambda name: F.struct(
                    fold["fold"].alias("fold"), name.alias("ticker"), _held(target, name).alias("weight"),
                    _held(held, name).alias("pre_trade_weight"),
                ),
            )
            after = F.when(alive, F.filter(drifted, lambda h: h["weight"] > 1e-12)).otherwise(target)
            return F.struct(after.cast(HELD).alias("held"), F.concat(state["rows"], rows).cast(ROWS).alias("rows"))

        prev = F.transform(fold["tickers"], lambda name: _held(held, name))
        return _let(prev, lambda p: _let(best_weights(fold, p, rule), traded))

    start = F.struct(F.expr(f"cast(array() as {HELD})").alias("held"), F.expr(f"cast(array() as {ROWS})").alias("rows"))
    return F.aggregate(folds, start, step)["rows"]


def allocate_weights(
    chosen: DataFrame, moments: DataFrame, growth: DataFrame, rule: WeightRule
) -> DataFrame:
    """(strategy, fold, ticker, weight, pre_trade_weight) over old and new holdings.

    ``chosen``: (strategy, fold, idx, ticker). ``growth``: (strategy, fold,
    ticker, growth) over the test window, used to drift the weights. Bounds that no
    weights meet, and subsets of more than ``MAX_HELD`` assets, raise.
    """
    if rule.risk_aversion <= 0 or rule.lower > rule.upper:
        raise ValueError("risk aversion must be positive and the bounds in order")
    pick = chosen.select(*PROBLEM, "idx", "ticker")
    rows = pick.join(growth, [*PROBLEM, "ticker"], "left")
    a = pick.select(*PROBLEM, F.col("idx").alias("i"))
    b = pick.select(*PROBLEM, F.col("idx").alias("j"))
    inside = moments.join(a, [*PROBLEM, "i"], "left_semi").join(b, [*PROBLEM, "j"], "left_semi")
    matrix = inside.groupBy(*PROBLEM).agg(
        F.sort_array(F.collect_list(F.struct("i", "j", "cov"))).alias("_c"),
        F.sort_array(
            F.collect_list(F.when(F.col("i") == F.col("j"), F.struct("i", "mu")))
        ).alias("_m"),
    )
    vectors = rows.groupBy(*PROBLEM).agg(
        F.sort_array(
            F.collect_list(
                F.struct("idx", "ticker", F.coalesce("growth", F.lit(1.0)).alias("growth"))
            )
        ).alias("_v")
    )
    k = F.size("_v")
    checked = (
        F.when(k > MAX_HELD, F.raise_error(F.lit(f"weights are limited to subsets of {MAX_HELD} assets")).cast("int"))
        .when((k * rule.lower > 1 + 1e-12) | (k * rule.upper < 1 - 1e-12),
              F.raise_error(F.concat(F.lit("infeasible weight bounds for a subset of "), k.cast("string"))).cast("int"))
        .otherwise(k)
    )
    flat = _clean(F.col("_c.cov"))
    even = F.transform(
        F.sequence(F.lit(0), k * k - 1),
        lambda x: (F.get(flat, x) + F.get(flat, (x % k) * k + F.floor(x / k).cast("int"))) / 2.0
        + F.when(F.floor(x / k) == x % k, 1e-10).otherwise(0.0),
    )
    problems = vectors.join(matrix, PROBLEM).select(
        *PROBLEM,
        checked.alias("k"),
        F.col("_v.ticker").alias("tickers"),
        F.col("_v.growth").alias("growth"),
        _clean(F.col("_m.mu")).alias("mu"),
        even.alias("cov"),
    )
    options = pattern_solutions(problems, rule).groupBy(*PROBLEM).agg(F.collect_list(F.struct("pattern", "at")).alias("options"))
    fold = F.struct(F.col("fold").cast("int").alias("fold"), "tickers", "growth", "mu", "cov", "options")
    lined = problems.join(options, PROBLEM).groupBy("strategy").agg(F.collect_list(fold).alias("folds"))
    ordered = F.array_sort("folds", lambda x, y: F.when(x["fold"] < y["fold"], -1).when(x["fold"] > y["fold"], 1).otherwise(0))
    walked = lined.select("strategy", F.explode(_walked(ordered, rule)).alias("r"))
    return walked.select("strategy", "r.fold", "r.ticker", "r.weight", "r.pre_trade_weight")

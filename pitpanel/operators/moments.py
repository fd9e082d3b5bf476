"""Mean vectors, covariance matrices and selection matrices for many problems.

A problem is one (strategy, fold) with a small candidate pool; matrices stay in
long form (strategy, fold, i, j, ...), so every problem is estimated in the same
aggregate. Pairs are formed within a pool only, whose size is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.session import dim

PROBLEM = ["strategy", "fold"]


def complete_rows(
    pools: DataFrame,
    returns: DataFrame,
    decisions: DataFrame,
    last_n: int = 252,
    pool_rows: int | None = None,
) -> DataFrame:
    """(strategy, fold, date, age, row): complete-case returns of each pool.

    The cut to ``last_n`` dates comes before dropping incomplete dates; ``age``
    counts the complete rows that are left, newest 0. ``row`` lists
    (idx, ret1) by ``idx``.
    """
    sized = pools.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*PROBLEM)))
    asked = sized.join(decisions.select("fold", "decision_time"), "fold").select(
        *PROBLEM, "idx", "ticker", "_size", "decision_time"
    )
    past = returns.select("ticker", "date", "ret1").join(dim(asked, pool_rows, 96), "ticker")
    rows = (
        past.where(F.col("date") <= F.col("decision_time"))
        .groupBy(*PROBLEM, "date")
        .agg(
            F.sort_array(F.collect_list(F.struct("idx", "ret1"))).alias("row"),
            F.count("ret1").alias("_known"),
            F.max("_size").alias("_size"),
        )
    )
    newest = Window.partitionBy(*PROBLEM).orderBy(F.col("date").desc())
    recent = rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= last_n)
    full = recent.where(F.col("_known") == F.col("_size"))
    return full.withColumn("age", F.row_number().over(newest) - 1).select(
        *PROBLEM, "date", "age", "row"
    )


def _pairs(rows: DataFrame, *extra: str | Column) -> DataFrame:
    """All ordered pairs inside one row list (pool size squared)."""
    left = rows.select(*PROBLEM, *extra, "row", F.explode("row").alias("a"))
    return left.select(*PROBLEM, *extra, "a", F.explode("row").alias("b")).select(
        *PROBLEM,
        *extra,
        F.col("a.idx").alias("i"),
        F.col("b.idx").alias("j"),
        F.col("a.ret1").alias("x"),
        F.col("b.ret1").alias("y"),
    )


def ewma_moments(rows: DataFrame, span: int = 60, horizon: int = 20) -> DataFrame:
    """(strategy, fold, i, j, mu, cov): exponentially weighted, bias-corrected.

    One pass: weights depend on ``age`` only, and every sum is a partial
    aggregate. ``mu`` is the mean of asset ``i``. Fewer than two rows give no
    estimate.
    """
    if span <= 1 or horizon <= 0:
        raise ValueError("span must exceed one and horizon must be positive")
    w = F.pow(F.lit(1.0 - 2.0 / (span + 1.0)), F.col("age").cast("double"))
    sums = (
        _pairs(rows.withColumn("w", w), "w")
        .groupBy(*PROBLEM, "i", "j")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("w").alias("sw"),
            F.sum(F.col("w") * F.col("w")).alias("sww"),
            F.sum(F.col("w") * F.col("x")).alias("sx"),
            F.sum(F.col("w") * F.col("y")).alias("sy"),
            F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"),
        )
        .where("n >= 2")
    )
    sw = F.col("sw")
    raw = F.col("sxy") / sw - (F.col("sx") / sw) * (F.col("sy") / sw)
    left = 1.0 - F.col("sww") / (sw * sw)
    cov = F.when(left > 1e-12, raw / left).otherwise(raw)
    ridge = F.when(F.col("i") == F.col("j"), 1e-10).otherwise(0.0)
    return sums.select(
        *PROBLEM,
        "i",
        "j",
        (F.col("sx") / sw * horizon).alias("mu"),
        ((cov + ridge) * horizon).alias("cov"),
    )


def shrunk_moments(rows: DataFrame, horizon: int = 20) -> DataFrame:
    """Plain mean and the Ledoit-Wolf (2004) covariance, as aggregates.

    With S the (1/n) covariance of p assets, m = trace(S)/p and c the centred
    returns: d = (sum S^2 - p m^2)/p, b = (sum_t (sum_i c^2)^2 / n - sum S^2)/(p n),
    share = min(b, d)/d, result = (1 - share) S + share m I.
    """
    asset = Window.partitionBy(*PROBLEM, "idx")
    long = rows.select(*PROBLEM, "date", F.inline("row"))
    centred = long.withColumns(
        {"mean": F.avg("ret1").over(asset), "c": F.col("ret1") - F.avg("ret1").over(asset)}
    )
    per_date = centred.groupBy(*PROBLEM, "date").agg(
        F.sort_array(F.collect_list(F.struct("idx", F.col("c").alias("ret1")))).alias("row"),
        F.sum(F.col("c") * F.col("c")).alias("sq"),
    )
    spread = per_date.groupBy(*PROBLEM).agg(
        F.sum(F.col("sq") * F.col("sq")).alias("quartic"), F.count(F.lit(1)).alias("n")
    )
    s = _pairs(per_date).groupBy(*PROBLEM, "i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("s"))
    shape = s.groupBy(*PROBLEM).agg(
        F.sum(F.col("s") * F.col("s")).alias("ss"),
        F.sum(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("trace"),
        F.count_distinct("i").alias("p"),
    )
    facts = shape.join(spread, PROBLEM).where("n >= 2")
    p, n, m = F.col("p"), F.col("n"), F.col("trace") / F.col("p")
    d = (F.col("ss") - p * m * m) / p
    b = (F.col("quartic") / n - F.col("ss")) / (p * n)
    share = F.coalesce(F.try_divide(F.least(b, d), d), F.lit(0.0))
    facts = facts.select(*PROBLEM, m.alias("m"), F.when(b == 0, 0.0).otherwise(share).alias("share"))
    means = centred.groupBy(*PROBLEM, F.col("idx").alias("i")).agg(F.first("mean").alias("mean"))
    eye = F.when(F.col("i") == F.col("j"), F.col("share") * F.col("m")).otherwise(0.0)
    return (
        s.join(facts, PROBLEM)
        .join(means, [*PROBLEM, "i"])
        .select(
            *PROBLEM,
            "i",
            "j",
            (F.col("mean") * horizon).alias("mu"),
            (((1 - F.col("share")) * F.col("s") + eye) * horizon).alias("cov"),
        )
    )


def estimate_moments(
    rows: DataFrame, method: str = "ewma", span: int = 60, horizon: int = 20
) -> DataFrame:
    if method == "ewma":
        return ewma_moments(rows, span, horizon)
    if method == "ledoit_wolf":
        return shrunk_moments(rows, horizon)
    raise ValueError(f"unsupported covariance method: {method}")


def selection_matrix(moments: DataFrame, risk_aversion: float) -> DataFrame:
    """``q_ij = a cov_ij - (1 - a) [i = j] mu_i``."""
    reward = F.when(F.col("i") == F.col("j"), (1.0 - risk_aversion) * F.col("mu")).otherwise(0.0)
    return moments.withColumn("q", risk_aversion * F.col("cov") - reward)

"""Rolling and recursive window expressions over a keyed, ordered panel.

A panel holds one row per (key, order value), so the longest window partition is
the calendar: it does not grow with the number of keys or the raw row count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along(key: str | list[str] = "ticker", order: str = "date") -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def last_rows(n: int, key: str | list[str] = "ticker", order: str = "date") -> WindowSpec:
    return along(key, order).rowsBetween(-(n - 1), 0)


def filled(n: int, probe: Column, value: Column, w: WindowSpec) -> Column:
    """``value`` where the frame ``w`` holds ``n`` non-null probes, else NULL."""
    return F.when(F.count(probe).over(w) == n, value)


#: Decay, in nats of the fastest average, after which a running sum starts afresh.
EMA_BLOCK = 300.0


def with_emas(
    df: DataFrame,
    value: str,
    spans: dict[str, int],
    key: str = "ticker",
    order: str = "date",
    position: str | None = None,
    decay: bool = False,
) -> DataFrame:
    """Exponential moving averages started at the first value (no bias correction).

    Gaps are counted in rows, or in steps of the column ``position``. With ``decay`` a column
    ``<name>_decay`` keeps the running decay, by which averages can be started anew (``ewma_scores``).
    Across a gap of g rows (g - 1 of them NULL) the old average weighs ``(1-a)^g``
    and both weights are renormalised; a NULL row carries the last average. With
    ``c`` the weight of the old average, ``y = c y' + (1 - c) x`` unrolls to a
    weighted running sum in the decay ``sum(-log c)``. The weights would overflow on
    long histories, so rows are cut into blocks of that decay and sums are kept
    relative to the block's start; one block back is enough, since older rows weigh
    less than the rounding error.
    """
    rate = {n: -math.log(1.0 - 2.0 / (s + 1.0)) for n, s in spans.items()}
    fast = max(rate, key=rate.get)
    if EMA_BLOCK * min(rate.values()) < 39.0 * rate[fast]:
        for name, span in spans.items():
            df = with_emas(df, value, {name: span}, key, order, position, decay)
        return df
    at, known = along(key, order), F.col(value).isNotNull()
    earlier = at.rowsBetween(Window.unboundedPreceding, -1)
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_pos", F.col(position) if position else F.row_number().over(at))
    out = out.withColumn("_gap", F.col("_pos") - F.max(F.when(known, F.col("_pos"))).over(earlier))
    old = {n: F.exp(F.col("_gap") * F.lit(-rate[n])) for n in spans}
    new = {n: F.lit(2.0 / (s + 1.0)) for n, s in spans.items()}
    share = {n: F.when(F.col("_gap").isNull(), F.lit(1.0)).otherwise(new[n] / (old[n] + new[n])) for n in spans}
    loss = {n: F.when(known & F.col("_gap").isNotNull(), -F.log(old[n] / (old[n] + new[n]))).otherwise(F.lit(0.0)) for n in spans}
    out = out.withColumns({f"_d_{n}": F.sum(loss[n]).over(upto) for n in spans})
    out = out.withColumn("_blk", F.floor(F.col(f"_d_{fast}") / EMA_BLOCK).cast("int"))
    block = Window.partitionBy(key, "_blk")
    inside = along([key, "_blk"], order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_blk").rangeBetween(-1, -1)
    out = out.withColumns({f"_b_{n}": F.min(f"_d_{n}").over(block) for n in spans})
    out = out.withColumns({
        f"_t_{n}": F.when(known, share[n] * F.col(value) * F.exp(F.col(f"_d_{n}") - F.col(f"_b_{n}"))) for n in spans
    })
    out = out.withColumns({f"_s_{n}": F.sum(f"_t_{n}").over(inside) for n in spans})
    out = out.withColumns(
        {f"_p_{n}": F.sum(f"_t_{n}").over(before) for n in spans} | {f"_q_{n}": F.min(f"_b_{n}").over(before) for n in spans}
    )
    result = {}
    for n in spans:
        here = F.col(f"_s_{n}") * F.exp(F.col(f"_b_{n}") - F.col(f"_d_{n}"))
        back = F.col(f"_p_{n}") * F.exp(F.col(f"_q_{n}") - F.col(f"_d_{n}"))
        # no value yet: NULL
        result[n] = F.when(here.isNull(), back).otherwise(here + F.coalesce(back, F.lit(0.0)))
    if decay:
        result |= {f"{n}_decay": F.col(f"_d_{n}") for n in spans}
    helpers = ["_pos", "_gap", "_blk"] + [f"_{p}_{n}" for n in spans for p in "dbtspq"]
    return out.withColumns(result).drop(*helpers)

"""Market features, the forward label and publication-time features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.contracts import PIT_FEATURES
from pitpanel.functions.ranks import with_average_rank
from pitpanel.functions.rolling import (
    along, filled, last_rows, with_emas,
)
from pitpanel.functions.scalars import ratio
from pitpanel.operators.asof import asof_join, asof_on_dates
from pitpanel.session import dim, store

P = "adjusted_close"
HORIZONS = (5, 20, 60, 120)
EMA_SPANS = [12, 20, 26]


@dataclass
class Step:
    """What one feature needs: shifted inputs, row expressions, rolling frames.

    Steps are merged layer by layer, so any set of features costs one window pass
    for the shifts and one for all frames, in the same partitioning and order.
    Names starting with an underscore are dropped at the end.
    """

    shifts: dict[str, Column] = field(default_factory=dict)
    derived: dict[str, Column] = field(default_factory=dict)
    rolled: dict[str, Column] = field(default_factory=dict)
    market: bool = False


def _price() -> Column:
    return F.col(P)


def _prev() -> dict[str, Column]:
    return {"_prev": F.lag(P).over(along())}


def _ret1() -> dict[str, Column]:
    return {"ret1": ratio(_price(), F.col("_prev")) - 1}


def returns_step() -> Step:
    return Step(
        {**_prev(), **{f"_p{n}": F.lag(P, n).over(along()) for n in HORIZONS}},
        {**_ret1(), **{f"return_{n}d": ratio(_price(), F.col(f"_p{n}")) - 1 for n in HORIZONS}},
    )


def sma_step(n: int = 20) -> Step:
    w, p = last_rows(n), _price()
    return Step(rolled={f"sma_ratio_{n}": filled(n, p, ratio(p, F.avg(p).over(w)) - 1, w)})


def rsi_step(n: int = 14) -> Step:
    """Relative strength from plain means; no losses in the frame gives NULL."""
    w, d = last_rows(n), F.col("_d")
    gain = F.avg(F.when(d > 0, d).when(d.isNotNull(), 0.0)).over(w)
    loss = F.avg(F.when(d < 0, -d).when(d.isNotNull(), 0.0)).over(w)
    strength = 100 - ratio(F.lit(100.0), 1 + ratio(gain, loss))
    return Step(
        _prev(), {"_d": _price() - F.col("_prev")}, {f"rsi_{n}": filled(n, d, strength, w)}
    )


def atr_step(n: int = 14) -> Step:
    """Mean true range over price; gaps are measured to the prior adjusted close."""
    w, before, tr = last_rows(n), F.col("_prev"), F.col("_tr")
    widest = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
    )
    mean = filled(n, tr, F.avg(tr).over(w), w)
    return Step(_prev(), {"_tr": widest}, {f"atr_{n}": ratio(mean, _price())})


def volatility_step(n: int = 20) -> Step:
    w, r = last_rows(n), F.col("ret1")
    return Step(
        _prev(), _ret1(), {f"volatility_{n}d": filled(n, r, F.stddev_samp(r).over(w), w)}
    )


def downside_step(n: int = 20) -> Step:
    """A missing return counts as zero here, so this starts one row earlier."""
    w, r = last_rows(n), F.col("ret1")
    down = F.stddev_samp(F.when(r < 0, r).otherwise(0.0)).over(w)
    return Step(
        _prev(), _ret1(), {f"downside_volatility_{n}d": filled(n, F.lit(1), down, w)}
    )


def drawdown_step(n: int = 60) -> Step:
    w, p = last_rows(n), _price()
    return Step(rolled={f"drawdown_{n}d": filled(n, p, ratio(p, F.max(p).over(w)) - 1, w)})


def liquidity_step(n: int = 20) -> Step:
    w, v = last_rows(n), F.col("trading_value")
    return Step(rolled={f"liquidity_{n}d": filled(n, v, F.log1p(F.avg(v).over(w)), w)})


def beta_step(n: int = 60) -> Step:
    """Covariance with the market over the market's variance."""
    w, r, m = last_rows(n), F.col("ret1"), F.col("market_ret")
    both = F.when(r.isNotNull() & m.isNotNull(), F.lit(1))
    cov = filled(n, both, F.covar_samp(r, m).over(w), w)
    var = filled(n, m, F.var_samp(m).over(w), w)
    return Step(_prev(), _ret1(), {f"beta_{n}d": ratio(cov, var)}, market=True)


def target_step(n: int = 20) -> Step:
    """Forward return; a label, never a feature."""
    return Step(
        {"_ahead": F.lead(P, n).over(along())},
        {f"target_return_{n}d": ratio(F.col("_ahead"), _price()) - 1},
    )


def with_ret1(prices: DataFrame) -> DataFrame:
    """One-row return per ticker; NULL on the first row and around NULL prices."""
    return prices.withColumn("ret1", ratio(_price(), F.lag(P).over(along())) - 1)


def market_returns(returns: DataFrame, out: str = "market_ret") -> DataFrame:
    """Equal-weight mean return per date."""
    return returns.groupBy("date").agg(F.avg("ret1").alias(out))


def with_price_emas(df: DataFrame) -> DataFrame:
    spans = {f"_ema{n}": n for n in EMA_SPANS}
    return (
        with_emas(df, P, spans)
        .withColumns(
            {
                "ema_ratio_20": ratio(_price(), F.col("_ema20")) - 1,
                "macd": F.col("_ema12") - F.col("_ema26"),
            }
        )
        .drop(*spans)
    )


def with_features(
    prices: DataFrame,
    steps: list[Step],
    dates: int | None = None,
    market: DataFrame | None = None,
    ema: bool = False,
) -> DataFrame:
    """Add the steps' columns to a price panel.

    ``market`` is (date, market_ret), derived from the prices if a step needs it
    and it is absent. ``dates`` bounds the rows per ticker: it allows the market's
    broadcast, which keeps rows partitioned by ticker.
    """
    shifts = {k: v for s in steps for k, v in s.shifts.items()}
    derived = {k: v for s in steps for k, v in s.derived.items()}
    rolled = {k: v for s in steps for k, v in s.rolled.items()}
    df = prices
    if shifts:
        df = df.withColumns(shifts)
    if derived:
        df = df.withColumns(derived)
    if any(s.market for s in steps):
        if market is None:
            market = market_returns(with_ret1(prices))
        df = df.join(dim(market, dates), "date", "left")
    if rolled:
        df = df.withColumns(rolled)
    df = df.drop("market_ret", *[c for c in (*shifts, *derived) if c.startswith("_")])
    return with_price_emas(df) if ema else df


def add_target_rank(df: DataFrame, target: str = "target_return_20d", dates: int | None = None):
    """Percentile rank of the label within each date, ties averaged."""
    return with_average_rank(df, ["date"], target, "target_rank", pct=True, groups=dates)


def market_features(
    prices: DataFrame, dates: int | None = None, market: DataFrame | None = None
) -> DataFrame:
    """All market features and the label: one shuffle by ticker, two window passes."""
    steps = [
        returns_step(), sma_step(), rsi_step(), atr_step(), volatility_step(), downside_step(),
        drawdown_step(), liquidity_step(), beta_step(), target_step(),
    ]
    return with_features(prices, steps, dates, market, ema=True)


def build_features(
    prices: DataFrame, dates: int | None = None, market: DataFrame | None = None
) -> DataFrame:
    """Features, label and label rank; publication-time columns are kept, or empty if absent.

    Attach slow tables to the prices, before this: their as-of joins then sort slim rows, and the
    optimiser need not carry every feature's expression through them.
    """
    df = add_target_rank(market_features(prices, dates, market), dates=dates)
    unknown = F.lit(None).cast("double")
    slow = {c: unknown for c in PIT_FEATURES if c not in prices.columns}
    return df.withColumns({"feature_available_at": F.col("date"), **slow})


def all_features(
    prices: DataFrame,
    financials: DataFrame | None = None,
    macro: DataFrame | None = None,
    dates: int | None = None,
    market: DataFrame | None = None,
) -> DataFrame:
    """Market features and publication-time features; prices with the latter are stored once for all branches."""
    if financials is not None or macro is not None:
        if market is None:
            market = market_returns(with_ret1(prices))
        prices = store(attach_point_in_time(prices, financials, macro, dates), "prices")
    return build_features(prices, dates, market)


def fundamental_ratios(financials: DataFrame) -> DataFrame:
    """Return on equity and growth over four statements, in publication order."""
    w = Window.partitionBy("ticker").orderBy("available_at", "fiscal_period_end")
    return financials.withColumns(
        {
            "roe_pit": ratio(F.col("net_income"), F.col("equity")),
            "revenue_growth_yoy_pit": ratio(F.col("revenue"), F.lag("revenue", 4).over(w)) - 1,
        }
    )


def policy_series(macro: DataFrame, contains: str = "POLICY_RATE") -> DataFrame:
    return macro.where(F.upper(F.col("series_id")).contains(contains.upper()))


def attach_point_in_time(
    features: DataFrame,
    financials: DataFrame | None = None,
    macro: DataFrame | None = None,
    dates: int | None = None,
) -> DataFrame:
    """Join slow tables as of their publication; an absent table leaves NULLs."""
    out = features
    if financials is not None:
        values = ["roe_pit", "revenue_growth_yoy_pit"]
        out = asof_join(
            out.drop(*values),
            fundamental_ratios(financials),
            key="ticker",
            left_on="date",
            right_on="available_at",
            values=values,
            tiebreak="fiscal_period_end",
        )
    if macro is not None:
        policy = policy_series(macro).withColumnRenamed("value", "policy_rate_pit")
        out = asof_on_dates(
            out.drop("policy_rate_pit"),
            policy,
            left_on="date",
            right_on="available_at",
            values=["policy_rate_pit"],
            tiebreak="series_id",
            dates=dates,
        )
    return out

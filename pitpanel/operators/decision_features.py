"""Market features on a few dates: the rows that decisions read, not every row of the panel.

A sliding frame is summed anew on every row, wanted or not. Here rows are dealt by ticker and
sorted, and tasks form the features of the wanted dates alone, from the rows before
them. ``features.market_features`` says what each feature is; tests hold both equal.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.contracts import MARKET_FEATURES
from pitpanel.operators.features import EMA_SPANS, HORIZONS, P

# tasks get this module's functions themselves: executors need not be able to import the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tickers that a task works on at a time.
PART = 128
INPUTS = [P, "high", "low", "trading_value"]


class _Rows:
    """Some tickers' rows in order; ``value, known`` pairs stand for nullable columns."""

    def __init__(self, code: np.ndarray, at: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        self.size = np.diff(np.r_[starts, len(code)])
        self.group = np.repeat(np.arange(len(starts)), self.size)
        self.place = np.arange(len(code)) - np.repeat(starts, self.size)
        self.at = at

    def shifted(self, col, n: int):
        """The column ``n`` rows earlier, on every row."""
        there = self.place >= n
        back = np.maximum(np.arange(len(there)) - n, 0)
        return col[0][back], col[1][back] & there

    def frame(self, col, n: int):
        """Values of the last ``n`` rows on the wanted rows, and whether there are ``n``, all known."""
        index = np.maximum(self.at[:, None] - np.arange(n - 1, -1, -1), 0)
        return col[0][index], (self.place[self.at] >= n - 1) & col[1][index].all(1)

    def ema(self, col, span: int):
        """As ``with_emas``: over a gap of g rows the old average weighs ``(1-a)^g``, and both weights are renormalised."""
        new = 2.0 / (span + 1.0)
        x, known = np.zeros((int(self.size.max()), len(self.size))), np.zeros((int(self.size.max()), len(self.size)), bool)
        x[self.place, self.group], known[self.place, self.group] = col
        level, begun, old = np.zeros(x.shape[1]), np.zeros(x.shape[1], bool), np.ones(x.shape[1])
        out, some = np.zeros(x.shape), np.zeros(x.shape, bool)
        for t in range(len(x)):
            old = old * (1.0 - new)
            here, share = known[t], new / (old + new)
            level = np.where(here, np.where(begun, (1 - share) * level + share * x[t], x[t]), level)
            begun, old = begun | here, np.where(here, 1.0, old)
            out[t], some[t] = level, begun
        return out[self.place[self.at], self.group[self.at]], some[self.place[self.at], self.group[self.at]]


def _ratio(a, b):
    """``a / b``; unknown where either is, or ``b`` is zero."""
    known = a[1] & b[1] & (b[0] != 0)
    return a[0] / np.where(known, b[0], 1.0), known


def _less_one(a):
    return a[0] - 1, a[1]


def _spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sample covariance of rows; deviations from a value of the row, so that equal values give 0."""
    x, y = x - x[:, :1], y - y[:, :1]
    return ((x - x.mean(1, keepdims=True)) * (y - y.mean(1, keepdims=True))).sum(1) / (x.shape[1] - 1)


def _features(rows: _Rows, price, high, low, value, market) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    at = rows.at

    def here(col):
        return col[0][at], col[1][at]

    prev, p = rows.shifted(price, 1), here(price)
    ret = _less_one(_ratio(price, prev))
    out = {f"return_{n}d": _less_one(_ratio(p, here(rows.shifted(price, n)))) for n in HORIZONS}

    x, full = rows.frame(price, 20)
    out["sma_ratio_20"] = _less_one(_ratio(p, (x.mean(1), full)))

    x, full = rows.frame((price[0] - prev[0], price[1] & prev[1]), 14)
    gain, loss = np.where((x > 0) | np.isnan(x), x, 0.0).mean(1), np.where(x < 0, -x, 0.0).mean(1)
    strength = _ratio((gain, full), (loss, full))
    part = _ratio((np.full(len(at), 100.0), full), (1 + strength[0], strength[1]))
    out["rsi_14"] = 100 - part[0], part[1]

    ranges = [
        (high[0] - low[0], high[1] & low[1]), (np.abs(high[0] - prev[0]), high[1] & prev[1]),
        (np.abs(low[0] - prev[0]), low[1] & prev[1]),
    ]
    widest = ranges[0][1] | ranges[1][1] | ranges[2][1]
    x, full = rows.frame((np.max([np.where(k, v, -np.inf) for v, k in ranges], axis=0), widest), 14)
    out["atr_14"] = _ratio((x.mean(1), full), p)

    x, full = rows.frame(ret, 20)
    out["volatility_20d"] = np.sqrt(_spread(x, x)), full
    x, full = rows.frame((np.where(ret[1] & (ret[0] < 0), ret[0], 0.0), np.ones(len(ret[0]), bool)), 20)
    out["downside_volatility_20d"] = np.sqrt(_spread(x, x)), full

    x, full = rows.frame(price, 60)
    out["drawdown_60d"] = _less_one(_ratio(p, (x.max(1), full)))

    x, full = rows.frame(value, 20)
    mean = x.mean(1)
    known = full & ~(mean <= -1)
    out["liquidity_20d"] = np.log1p(np.where(known, mean, 0.0)), known

    x, r_full = rows.frame(ret, 60)
    m, m_full = rows.frame(market, 60)
    out["beta_60d"] = _ratio((_spread(x, m), r_full & m_full), (_spread(m, m), m_full))

    ema = {n: rows.ema(price, n) for n in EMA_SPANS}
    out["ema_ratio_20"] = _less_one(_ratio(p, ema[20]))
    out["macd"] = ema[12][0] - ema[26][0], ema[12][1]
    return out


def market_features_on(prices: DataFrame, wanted: DataFrame, market: DataFrame) -> DataFrame:
    """(ticker, date, every market feature) of the rows on the ``date``s of ``wanted``.

    ``market`` is (date, market_ret). Both are as long as the calendar at most.
    """
    return market_features_of(histories(prices), wanted, market)


def histories(prices: DataFrame, *more: str) -> DataFrame:
    """One row per ticker: its dates in order, and what features and returns read on them, as arrays."""
    names = ["date", *(n for n in (*INPUTS, *more) if n != "date")]
    values = [F.col(n) if n == "date" else F.col(n).cast("double").alias(n) for n in names]
    listed = prices.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(*values))).alias("_h"))
    return listed.select("ticker", *[F.col(f"_h.{n}").alias(n) for n in names])


def unrolled(history: DataFrame, *names: str) -> DataFrame:
    """(ticker, date, each of ``names``): the rows behind ``histories``."""
    return history.select("ticker", F.inline(F.arrays_zip("date", *names)))


def market_features_of(history: DataFrame, wanted: DataFrame, market: DataFrame) -> DataFrame:
    """``market_features_on`` for prices that lie as one row per ticker: no shuffle."""
    spark = history.sparkSession
    days = spark.sparkContext.broadcast((
        wanted.select("date").where("date IS NOT NULL").distinct().toArrow()["date"].cast(pa.int32()).to_numpy(),
        {d: v for d, v in zip(*(c.to_pylist() for c in market.select(
            F.unix_date("date").alias("date"), F.col("market_ret").cast("double")
        ).where("date IS NOT NULL").toArrow().columns), strict=True)},
    ))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        asked, market_of = days.value
        lists = part.column(1)
        owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        date = lists.flatten()
        day, at_day = np.unique(pc.fill_null(date.cast(pa.int32()), -(1 << 31)).to_numpy(zero_copy_only=False), return_inverse=True)
        rows = _Rows(owner, np.flatnonzero(np.isin(day, asked)[at_day] & date.is_valid().to_numpy(zero_copy_only=False)))
        seen = [market_of.get(int(d)) for d in day]
        market = np.array([0.0 if v is None else v for v in seen])[at_day], np.array([v is not None for v in seen])[at_day]
        given = [part.column(n + 2).flatten() for n in range(len(INPUTS))]
        cols = [(pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)) for c in given]
        with np.errstate(all="ignore"):
            found = _features(rows, *cols, market)
        keep = pa.array(rows.at)
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(owner[rows.at])), date.take(keep), *(pa.array(found[n][0], mask=~found[n][1]) for n in MARKET_FEATURES)],
            ["ticker", "date", *MARKET_FEATURES],
        )

    def run(it):
        for batch in it:
            for start in range(0, batch.num_rows, PART):
                yield work(batch.slice(start, PART))

    names = ", ".join(f"{n} double" for n in MARKET_FEATURES)
    return history.select("ticker", "date", *INPUTS).mapInArrow(run, f"ticker string, date date, {names}")

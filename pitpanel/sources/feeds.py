"""Normalisers: landed vendor payloads to the price and macro contracts.

Every normaliser takes a whole landed frame for any number of tickers (column
``ticker``, or one given name) and stays lazy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel import contracts
from pitpanel.session import dim

# Vendor field names and what they mean.
ALIASES = {
    "a": {
        "date": ["TradingDate", "tradingDate", "date"],
        "open": ["Open", "open", "OpenPrice"],
        "high": ["High", "high", "HighPrice"],
        "low": ["Low", "low", "LowPrice"],
        "close": ["Close", "close", "ClosePrice"],
        "volume": ["Volume", "volume"],
        "trading_value": ["Value", "value", "trading_value"],
    },
    "b": {
        "date": ["TradingDate"],
        "open": ["OpenPrice"],
        "high": ["HighestPrice"],
        "low": ["LowestPrice"],
        "close": ["ClosePrice"],
        "adjusted_close": ["AdjustPrice"],
        "volume": ["TotalVol"],
        "trading_value": ["TotalVal"],
    },
    "c": {
        "date": ["time", "date"],
        "open": ["open"],
        "high": ["high"],
        "low": ["low"],
        "close": ["close"],
        "volume": ["volume"],
    },
    "d": {
        "date": ["Date", "index", "date"],
        "open": ["Open", "open"],
        "high": ["High", "high"],
        "low": ["Low", "low"],
        "close": ["Close", "close"],
        "adjusted_close": ["Adj Close", "adjusted_close"],
        "volume": ["Volume", "volume"],
    },
}
OHLCV = ["date", "open", "high", "low", "close", "volume"]
OBSERVATIONS = (
    "struct<observations: array<struct<date: string, value: string, realtime_start: string>>>"
)


def _pick(df: DataFrame, feed: str) -> dict[str, Column]:
    """First present, non-null alias per contract field; required fields checked."""
    # exact match: Spark resolves names without case, the vendors' names differ by it
    found = {}
    for field, names in ALIASES[feed].items():
        present = [F.col(f"`{n}`") for n in names if n in df.columns]
        if present:
            found[field] = present[0] if len(present) == 1 else F.coalesce(*present)
    absent = sorted(set(OHLCV) - set(found))
    if absent:
        raise ValueError(f"feed {feed} missing normalized fields: {absent}")
    return found


def _number(c: Column, kind: str = "double") -> Column:
    return c.cast("string").try_cast(kind)


def keep_first(df: DataFrame, keys: list[str], priority: list[Column]) -> DataFrame:
    """One row per key, the lowest by ``priority``.

    An aggregate and not a row_number: copies of one key are folded map-side, so
    a key holding a third of all rows never meets in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*priority)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def _finish(
    df: DataFrame,
    fields: dict[str, Column],
    ticker: str | None,
    source: str,
    url: str,
    parser: str,
    lag_days: int,
) -> DataFrame:
    name = F.lit(ticker) if ticker is not None else F.col("ticker")
    raw = F.sha2(
        F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]),
        256,
    )
    staged = df.select(
        F.upper(F.trim(name)).alias("ticker"),
        *[fields[f].alias(f) for f in fields],
        raw.alias("raw_checksum"),
    )
    close = F.col("close")
    turnover = F.col("volume") * close
    adjusted = F.coalesce(F.col("adjusted_close"), close) if "adjusted_close" in fields else close
    valued = F.coalesce(F.col("trading_value"), turnover) if "trading_value" in fields else turnover
    return contracts.conform(
        staged.withColumns(
            {
                "adjusted_close": adjusted,
                "trading_value": valued,
                "source": F.lit(source),
                "source_url": F.lit(url),
                "fetched_at": F.current_timestamp(),
                "available_at": F.date_add("date", lag_days),
                "parser_version": F.lit(parser),
                "data_class": F.lit("real"),
            }
        ),
        contracts.PRICES,
    )


def _complete(df: DataFrame) -> DataFrame:
    """Drop bars without OHLCV, then keep one bar per (date, ticker)."""
    return keep_first(
        df.dropna(subset=OHLCV), ["date", "ticker"], [F.col("raw_checksum"), F.col("close")]
    )


def normalize_feed_a(
    df: DataFrame, url: str, ticker: str | None = None, date_format: str = "yyyy-MM-dd"
) -> DataFrame:
    """Alias-rich feed, available on the trading day itself."""
    f = _pick(df, "a")
    f["date"] = F.to_date(f["date"].cast("string"), date_format)
    for c in f.keys() - {"date"}:
        f[c] = _number(f[c])
    f.pop("adjusted_close", None)
    return _finish(df, f, ticker, "feed_a", url, "feed-a-v1", 0)


def normalize_feed_b(df: DataFrame, url: str, ticker: str | None = None) -> DataFrame:
    """Text feed with ``/Date(ms)/`` stamps, available the next day."""
    f = _pick(df, "b")
    millis = F.regexp_extract(f["date"].cast("string"), r"/Date\((\d+)", 1).try_cast("bigint")
    f["date"] = F.date_from_unix_date(F.floor(millis / 86400000).cast("int"))
    for c in f.keys() - {"date"}:
        f[c] = _number(f[c])
    return _finish(df, f, ticker, "feed_b", url, "feed-b-v1", 1)


def normalize_feed_c(df: DataFrame, url: str, ticker: str | None = None) -> DataFrame:
    """Prices quoted in thousands with a time of day, available the next day."""
    f = _pick(df, "c")
    f["date"] = F.to_date(F.substring(f["date"].cast("string"), 1, 10), "yyyy-MM-dd")
    for c in ("open", "high", "low", "close"):
        f[c] = _number(f[c]) * 1000.0
    f["volume"] = _number(f["volume"])
    return _complete(_finish(df, f, ticker, "feed_c", url, "feed-c-v1", 1))


def normalize_feed_d(df: DataFrame, url: str, ticker: str | None = None) -> DataFrame:
    """Bars stamped with the prior calendar date; shifted, available the next day."""
    f = _pick(df, "d")
    stamped = F.to_date(F.substring(f["date"].cast("string"), 1, 10), "yyyy-MM-dd")
    f["date"] = F.date_add(stamped, 1)
    for c in f.keys() - {"date"}:
        f[c] = _number(f[c])
    return _complete(_finish(df, f, ticker, "feed_d", url, "feed-d-v1", 1))


def normalize_macro(df: DataFrame, payload: str = "payload", source: str = "macro_api") -> DataFrame:
    """JSON pages of observations to (date, available_at, series_id, value, source)."""
    rows = df.select(
        "series_id", F.explode(F.from_json(payload, OBSERVATIONS)["observations"]).alias("o")
    )
    day = F.to_date(F.col("o.date"))
    return rows.select(
        day.alias("date"),
        F.coalesce(F.to_date(F.col("o.realtime_start")), day).alias("available_at"),
        "series_id",
        F.col("o.value").try_cast("double").alias("value"),
        F.lit(source).alias("source"),
    )


def filter_listing(
    df: DataFrame,
    symbol: str = "symbol",
    position: str = "position",
    pattern: str = "^[A-Z]{3}$",
    first: int | None = None,
    requested: list[str] | None = None,
) -> DataFrame:
    """Clean symbols that match ``pattern``, once each, in listing order.

    ``requested`` keeps those symbols in the requested order; otherwise ``first``
    keeps the head of the listing.
    """
    clean = df.withColumn(symbol, F.upper(F.trim(F.col(symbol).cast("string")))).where(
        F.col(symbol).rlike(pattern)
    )
    once = keep_first(clean, [symbol], [F.col(position)])
    if requested is not None:
        wanted = list(dict.fromkeys(s.strip().upper() for s in requested if s.strip()))
        order = df.sparkSession.createDataFrame(
            [(s, i) for i, s in enumerate(wanted)], f"{symbol} string, _at int"
        )
        return once.join(dim(order, len(wanted), 64), symbol).orderBy("_at").drop("_at")
    if first is not None:
        return once.orderBy(position).limit(first)
    return once


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

"""Table contracts: declared schemas, required columns and the check for them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "DATE": T.DateType(),
    "STRING": T.StringType(),
    "DOUBLE": T.DoubleType(),
    "BIGINT": T.LongType(),
    "TIMESTAMP": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    """Schema from ``name TYPE, ...``; needs no running session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Column names and order of every contract table.
PRICES = _schema(
    "date DATE, ticker STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "adjusted_close DOUBLE, volume BIGINT, trading_value DOUBLE, source STRING, "
    "source_url STRING, fetched_at TIMESTAMP, available_at DATE, raw_checksum STRING, "
    "parser_version STRING, data_class STRING"
)
SECURITY_MASTER = _schema(
    "ticker STRING, company_name STRING, exchange STRING, industry STRING, sector STRING, "
    "listing_date DATE, delisting_date DATE, effective_from DATE, effective_to DATE, "
    "available_at DATE, source STRING, data_class STRING"
)
CORPORATE_ACTIONS = _schema(
    "ticker STRING, event_type STRING, event_date DATE, announcement_date DATE, "
    "effective_date DATE, available_at DATE, cash_dividend DOUBLE, split_ratio DOUBLE, "
    "adjustment_factor DOUBLE, source STRING"
)
INDEX_MEMBERSHIP = _schema(
    "ticker STRING, index_code STRING, effective_from DATE, effective_to DATE, "
    "announcement_date DATE, available_at DATE, source STRING, data_class STRING"
)
FINANCIAL_STATEMENTS = _schema(
    "ticker STRING, fiscal_period_end DATE, publication_date DATE, available_at DATE, "
    "revenue DOUBLE, net_income DOUBLE, total_assets DOUBLE, equity DOUBLE, source STRING, "
    "data_class STRING"
)
MACRO = _schema(
    "series_id STRING, observation_date DATE, release_date DATE, available_at DATE, "
    "value DOUBLE, source STRING, data_class STRING"
)
FOREIGN_FLOW = _schema(
    "date DATE, ticker STRING, available_at DATE, foreign_net_value DOUBLE, source STRING, "
    "data_class STRING"
)

SIDE_TABLES = {
    "index_membership": INDEX_MEMBERSHIP,
    "corporate_actions": CORPORATE_ACTIONS,
    "financial_statements": FINANCIAL_STATEMENTS,
    "macro": MACRO,
    "foreign_flow": FOREIGN_FLOW,
}

# The columns an import must bring.
REQUIRED = {
    "prices": ["date", "ticker", "open", "high", "low", "close", "volume"],
    "index_membership": [
        "ticker", "index_code", "effective_from", "effective_to", "available_at", "source",
    ],
    "corporate_actions": [
        "ticker", "event_type", "announcement_date", "effective_date", "available_at", "source",
    ],
    "financial_statements": [
        "ticker", "fiscal_period_end", "publication_date", "available_at", "source",
    ],
    "macro": ["series_id", "observation_date", "release_date", "available_at", "value", "source"],
    "foreign_flow": ["date", "ticker", "available_at", "foreign_net_value", "source"],
}

# The features an asset must have to enter a decision snapshot, and
# the slow-moving ones joined as of their publication.
MARKET_FEATURES = [
    "return_5d", "return_20d", "return_60d", "return_120d", "sma_ratio_20", "ema_ratio_20",
    "rsi_14", "macd", "atr_14", "volatility_20d", "downside_volatility_20d", "drawdown_60d",
    "liquidity_20d", "beta_60d",
]
PIT_FEATURES = ["roe_pit", "revenue_growth_yoy_pit", "policy_rate_pit"]
FEATURES = MARKET_FEATURES + PIT_FEATURES


def require(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    """Raise ``ValueError`` naming the absent columns; runs on the driver, no job."""
    absent = sorted(set(columns).difference(df.columns))
    if absent:
        raise ValueError(f"{what} missing required columns: {absent}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the contract's columns, order and types."""
    require(df, schema.fieldNames(), "table")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])

"""Point-in-time universe per month end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.session import dim


def month_end_anchors(prices: DataFrame) -> DataFrame:
    """Month ends of months with a non-null close."""
    return (
        prices.where(F.col("close").isNotNull())
        .select(F.last_day("date").alias("decision_time"))
        .distinct()
    )


def month_end_closes(prices: DataFrame) -> DataFrame:
    """Last non-null close per ticker and month."""
    return (
        prices.where(F.col("close").isNotNull())
        .groupBy("ticker", F.last_day("date").alias("month_end"))
        .agg(F.max_by("close", "date").alias("close"))
    )


def build_universe(
    prices: DataFrame, master: DataFrame, rebalance: str = "monthly", months: int | None = None
) -> DataFrame:
    """Tickers listed and known at each month end.

    Each master row is stretched over the month ends it is eligible for and
    meets the anchors by equality; no anchors x master product is formed.
    ``months`` bounds the number of anchors.
    """
    if rebalance != "monthly":
        raise ValueError(f"unsupported rebalance: {rebalance}")
    anchors = month_end_anchors(prices)
    last = anchors.agg(F.max("decision_time")).scalar()
    start = F.greatest("listing_date", "available_at")
    known = F.col("listing_date").isNotNull() & F.col("available_at").isNotNull()
    # the month end of the delisting month is past the delisting unless it falls on it
    delisted = F.col("delisting_date")
    whole_months = F.when(
        delisted == F.last_day(delisted), delisted
    ).otherwise(F.date_sub(F.trunc(delisted, "month"), 1))
    stop = F.least(last, F.coalesce(whole_months, last))
    spans = master.where(known).withColumns({"_a": F.last_day(start), "_b": stop})
    months_of = F.transform(
        F.expr("sequence(trunc(_a, 'month'), trunc(_b, 'month'), interval 1 month)"),
        lambda d: F.last_day(d),
    )
    eligible = spans.where("_a <= _b").withColumn("decision_time", F.explode(months_of))
    return (
        eligible.join(dim(anchors, months, 8), "decision_time", "left_semi")
        .select(
            "decision_time",
            "ticker",
            F.lit(True).alias("eligible"),
            F.lit("listed_and_available_point_in_time").alias("reason"),
            "data_class",
        )
    )

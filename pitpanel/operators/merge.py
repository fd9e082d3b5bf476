"""Merging two vendors' bars into one panel, with the tables that explain it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel import contracts
from pitpanel.functions.scalars import ratio
from pitpanel.operators.quality import split_bad_bars
from pitpanel.session import dim
from pitpanel.sources.feeds import keep_first


def source_stats(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(ticker, source, records, start, end) of the vendor that serves each ticker.

    A ticker known to the primary vendor is taken from it whole; the others come
    from the fallback. Ranks travel with the per-ticker statistics, so no row of
    either feed is moved to decide.
    """

    def stats(df: DataFrame, rank: int) -> DataFrame:
        return df.groupBy("ticker").agg(
            F.lit(rank).alias("_rank"),
            F.first("source").alias("source"),
            F.count(F.lit(1)).alias("records"),
            F.min("date").alias("start"),
            F.max("date").alias("end"),
        )

    both = stats(primary, 0).unionByName(stats(fallback, 1))
    return keep_first(both, ["ticker"], [F.col("_rank")])


def rank_candidates(stats: DataFrame, reaches: dt.date | str) -> DataFrame:
    """Candidate order: reaches the target date, earliest start, most rows, ticker."""
    return stats.withColumn("ends_at_target", F.col("end") >= F.lit(reaches).cast("date"))


def top_candidates(stats: DataFrame, reaches: dt.date | str, n: int) -> DataFrame:
    ranked = rank_candidates(stats, reaches)
    return ranked.orderBy(F.desc("ends_at_target"), "start", F.desc("records"), "ticker").limit(n)


def require_candidates(selected: DataFrame, n: int) -> DataFrame:
    """Raise if fewer than ``n`` candidates exist (one small job)."""
    found = selected.count()
    if found < n:
        raise RuntimeError(f"only {found} usable candidates; target is {n}")
    return selected


def pick_rows(primary: DataFrame, fallback: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of each chosen ticker from its vendor, one per (date, ticker)."""
    served = chosen.select("ticker", F.col("_rank").alias("_served"))
    ranked = primary.withColumn("_rank", F.lit(0)).unionByName(
        fallback.withColumn("_rank", F.lit(1))
    )
    kept = ranked.join(served, "ticker").where(F.col("_rank") == F.col("_served"))
    return keep_first(
        kept.drop("_rank", "_served"), ["date", "ticker"], [F.col("source"), F.col("raw_checksum")]
    )


def crosscheck(a: DataFrame, b: DataFrame, value: str = "adjusted_close") -> DataFrame:
    """Absolute relative difference of two vendors per ticker, over shared dates."""
    left = a.select("ticker", "date", F.col(value).alias("_a"))
    right = b.select("ticker", "date", F.col(value).alias("_b"))
    ape = ratio(F.abs(F.col("_a") - F.col("_b")), F.abs("_b"))
    return (
        left.join(right, ["ticker", "date"])
        .withColumn("_e", ape)
        .groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("overlap_rows"),
            F.percentile("_e", F.lit(0.5)).alias("median_abs_pct_diff"),
            F.avg("_e").alias("mean_abs_pct_diff"),
        )
    )


def build_master(
    listing: DataFrame, prices: DataFrame | None = None, start: str | None = None,
    exchange: str = "TAPE", source: str = "listing",
) -> DataFrame:
    """Security master from a listing (symbol, name); first trades date the listing."""
    named = listing.select(F.col("symbol").alias("ticker"), F.col("name").alias("company_name"))
    none = F.lit(None)
    if prices is not None:
        firsts = prices.groupBy("ticker").agg(
            F.min("date").alias("first"), F.min("source").alias("_vendor")
        )
        named = named.join(firsts, "ticker")
        first, vendor, listed = F.col("first"), F.col("_vendor"), F.col("first")
    else:
        first, vendor, listed = F.lit(start), F.lit(source), none
    return contracts.conform(
        named.withColumns(
            {
                "exchange": F.lit(exchange),
                "industry": none,
                "sector": none,
                "listing_date": listed,
                "delisting_date": none,
                "effective_from": first,
                "effective_to": none,
                "available_at": first,
                "source": vendor,
                "data_class": F.lit("real"),
            }
        ),
        contracts.SECURITY_MASTER,
    )


@dataclass
class Merged:
    prices: DataFrame
    quarantine: DataFrame
    candidates: DataFrame
    selected: DataFrame
    master: DataFrame
    crosscheck: DataFrame
    source_counts: DataFrame
    summary: DataFrame


def merge_sources(
    primary: DataFrame,
    fallback: DataFrame,
    listing: DataFrame,
    reaches: dt.date | str,
    target: int | None = None,
    tickers: int | None = None,
) -> Merged:
    """Every table of the merge, lazy.

    ``target`` keeps the best candidates and raises if there are too few; None
    keeps all. Availability is reset to the trading day: the daily clock treats
    a bar as known at that day's close. ``tickers`` bounds the listing.
    """
    known = listing.select(F.col("symbol").alias("ticker"))
    stats = source_stats(primary, fallback).join(dim(known, tickers, 16), "ticker", "left_semi")
    candidates = rank_candidates(stats, reaches)
    selected = candidates
    if target is not None:
        selected = require_candidates(top_candidates(stats, reaches, target), target)
    good, bad = split_bad_bars(pick_rows(primary, fallback, selected))
    prices = good.withColumn("available_at", F.col("date"))
    checked = crosscheck(primary, fallback).join(selected.select("ticker"), "ticker", "left_semi")
    counts = selected.groupBy("source").agg(F.count(F.lit(1)).alias("tickers"))
    summary = prices.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("ticker").alias("tickers"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
    )
    return Merged(
        prices, bad, candidates, selected, build_master(listing, prices), checked, counts, summary
    )

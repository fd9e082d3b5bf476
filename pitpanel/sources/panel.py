"""Contract tables built from the order and event tables.

``lineitem`` is read as a tape of fills (one row per trade in one supplier's
paper); weekly bars per ticker come from it, and the last close is carried into
weeks without a trade. Everything stays lazy.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitpanel import contracts
from pitpanel.session import store
from pitpanel.sources import feeds

WEEK = "interval 7 days"


def _bounds(spark: SparkSession, path: str) -> tuple[int, tuple[int, ...] | None]:
    """Weeks between the first and last fill, and how many bits order, line and part take (None below zero or empty)."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    row = spark.read.parquet(path).agg(
        F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).alias("d"),
        *[f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)],
    ).first()
    least, most = ([row[f"{f}_{k}"] for k in keys] for f in ("min", "max"))
    known = None not in least and min(least) >= 0
    return (row.d or 0) // 7 + 2, tuple(max(1, int(m).bit_length()) for m in most) if known else None


class TradePanel:
    """Lazy views of the test tables under one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _bounds(self) -> tuple[int, tuple[int, ...] | None]:
        return _bounds(self.spark, f"{self.sf_dir}/lineitem.parquet")

    # -- fills and bars ---------------------------------------------------

    def fills(self) -> DataFrame:
        """One row per fill; ``at`` orders the fills of a week.

        ``at`` packs (weekday, order, line, part) into one long if the table's largest keys
        fit, as ``_bounds`` says, and into one exact decimal otherwise, which costs twice the time. A
        fixed-width key keeps first and last price in a hash aggregate, where a
        struct key would sort every task's fills. Keys past the packed widths raise.
        """
        value, qty = F.col("l_extendedprice"), F.col("l_quantity")
        order, line, part = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint"), F.col("l_partkey")
        day = F.weekday(F.col("l_shipdate").cast("date")).cast("bigint")
        bits = self._bounds[1]
        if bits and sum(bits) <= 60:
            n_order, n_line, n_part = bits
            packed = (
                F.shiftleft(day, sum(bits)) + F.shiftleft(order, n_line + n_part) + F.shiftleft(line, n_part) + part
            )
            fits = (F.shiftright(order, n_order) == 0) & (F.shiftright(line, n_line) == 0) & (F.shiftright(part, n_part) == 0)
        else:
            high = F.shiftleft(day, 60) + order
            low = F.shiftleft(line, 52) + part
            packed = high.cast("decimal(19,0)") * F.lit(Decimal(10) ** 19) + low.cast("decimal(19,0)")
            fits = (order < 1 << 60) & (line < 1 << 11) & (part < 1 << 52)
        beyond = F.raise_error(F.lit("fill key exceeds the packed width"))
        return self.table("lineitem").select(
            "l_suppkey",
            F.trunc(F.col("l_shipdate").cast("date"), "week").alias("date"),
            F.when(fits, packed).otherwise(beyond).alias("at"),
            F.try_divide(value, qty).alias("price"),
            qty.alias("qty"),
            value.alias("value"),
            (F.col("l_linestatus") == "F").alias("final"),
        )

    @staticmethod
    def _named(grouped: DataFrame) -> DataFrame:
        return grouped.withColumn("ticker", F.col("l_suppkey").cast("string")).drop("l_suppkey")

    def bars(self, which: Column | None = None) -> DataFrame:
        """Weekly bars, one row per (ticker, week) with a trade.

        Partial aggregation folds the fills map-side, so a ticker holding a
        third of all fills reaches the shuffle as one row per week and task.
        """
        tape = self.fills() if which is None else self.fills().where(which)
        grouped = tape.groupBy("l_suppkey", "date").agg(
            F.min_by("price", "at").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "at").alias("close"),
            F.sum("qty").cast("bigint").alias("volume"),
            F.sum("value").alias("trading_value"),
        )
        return self._named(grouped)

    def last_week(self) -> Column:
        """Last week of the tape as a scalar subquery."""
        tape = self.table("lineitem")
        last = tape.agg(F.trunc(F.max("l_shipdate").cast("date"), "week").alias("d"))
        return last.scalar()

    def prices(self) -> DataFrame:
        """Contract prices: bars with the last close carried into empty weeks.

        Each bar is stretched to the week before the next one, so no grid of
        weeks x tickers is joined.
        """
        w = Window.partitionBy("ticker").orderBy("week")
        until = F.coalesce(F.date_sub(F.lead("week").over(w), 7), self.last_week())
        stretched = (
            self.bars()
            .withColumnRenamed("date", "week")
            .withColumn("_until", until)
            .withColumn("date", F.explode(F.expr(f"sequence(week, _until, {WEEK})")))
        )
        traded = F.col("date") == F.col("week")

        def carried(name: str) -> Column:
            return F.when(traded, F.col(name)).otherwise(F.col("close"))

        return stretched.select(
            "date",
            "ticker",
            carried("open").alias("open"),
            carried("high").alias("high"),
            carried("low").alias("low"),
            "close",
            F.col("close").alias("adjusted_close"),
            F.when(traded, F.col("volume")).otherwise(F.lit(0)).cast("bigint").alias("volume"),
            F.when(traded, F.col("trading_value")).otherwise(F.lit(0.0)).alias("trading_value"),
            F.lit("trade_tape").alias("source"),
            F.lit("table://lineitem").alias("source_url"),
            F.current_timestamp().alias("fetched_at"),
            F.col("date").alias("available_at"),
            F.sha2(F.concat_ws("|", "ticker", "date", "close"), 256).alias("raw_checksum"),
            F.lit("weekly-bars-v1").alias("parser_version"),
            F.lit("real").alias("data_class"),
        )

    def priced(self) -> DataFrame:
        """The columns features need."""
        return self.prices().select("ticker", "date", "high", "low", "close", "adjusted_close", "trading_value")

    def stored_prices(self) -> DataFrame:
        """``priced``, written once for plans that branch on them."""
        return store(self.priced(), "prices")

    def tape(self) -> DataFrame:
        """Two unmerged vendors' bars, as a quality check meets them.

        The first takes high and low from final fills only, so it can contradict
        its own open and close; the second covers open fills one day late. Both
        may report the same (ticker, week).
        """
        final = F.col("final")
        first = self._named(
            self.fills()
            .groupBy("l_suppkey", "date")
            .agg(
                F.min_by("price", "at").alias("open"),
                F.max(F.when(final, F.col("price"))).alias("high"),
                F.min(F.when(final, F.col("price"))).alias("low"),
                F.max_by("price", "at").alias("close"),
                F.sum("qty").cast("bigint").alias("volume"),
                F.sum("value").alias("trading_value"),
            )
        ).withColumns({"source": F.lit("final_tape"), "available_at": F.col("date")})
        second = self.bars(~final).withColumns(
            {"source": F.lit("open_tape"), "available_at": F.date_add("date", 1)}
        )
        return first.unionByName(second).withColumns(
            {"adjusted_close": F.col("close"), "data_class": F.lit("real")}
        )

    # -- calendar -----------------------------------------------------------

    def weeks(self) -> int:
        """Upper bound on panel dates; decides broadcasts only, never a result."""
        return self._bounds[0]

    def calendar(self) -> DataFrame:
        """Every panel date. Weeks are contiguous, so the tape's bounds suffice."""
        shipped = F.col("l_shipdate").cast("date")
        return (
            self.table("lineitem")
            .agg(
                F.trunc(F.min(shipped), "week").alias("a"),
                F.trunc(F.max(shipped), "week").alias("b"),
            )
            .select(F.explode(F.expr(f"sequence(a, b, {WEEK})")).alias("date"))
        )

    # -- reference tables ----------------------------------------------------

    def _listing_span(self) -> DataFrame:
        spans = self.fills().groupBy("l_suppkey").agg(
            F.min("date").alias("first"), F.max("date").alias("last")
        )
        return spans

    def master(self) -> DataFrame:
        names = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        )
        joined = names.join(self._listing_span(), F.col("s_suppkey") == F.col("l_suppkey"))
        quiet = F.col("last") < F.date_sub(self.last_week(), 7)
        return contracts.conform(
            joined.select(
                F.col("s_suppkey").cast("string").alias("ticker"),
                F.col("s_name").alias("company_name"),
                F.lit("TAPE").alias("exchange"),
                F.col("n_name").alias("industry"),
                F.col("r_name").alias("sector"),
                F.col("first").alias("listing_date"),
                F.when(quiet, F.col("last")).alias("delisting_date"),
                F.col("first").alias("effective_from"),
                F.lit(None).cast("date").alias("effective_to"),
                F.col("first").alias("available_at"),
                F.lit("supplier_listing").alias("source"),
                F.lit("real").alias("data_class"),
            ),
            contracts.SECURITY_MASTER,
        )

    def financials(self) -> DataFrame:
        """Quarterly statements per ticker, published 35 days after the quarter."""
        ordered = F.col("o_orderdate").cast("date")
        booked = (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("l_suppkey", F.trunc(ordered, "quarter").alias("_q"))
            .agg(
                F.sum("l_extendedprice").alias("revenue"),
                F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.04)).alias("net_income"),
                F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("total_assets"),
                F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("equity"),
            )
        )
        ends = self._named(booked).withColumn(
            "fiscal_period_end", F.last_day(F.add_months("_q", 2))
        )
        published = F.date_add("fiscal_period_end", 35)
        return contracts.conform(
            ends.withColumns(
                {
                    "publication_date": published,
                    "available_at": published,
                    "source": F.lit("order_book"),
                    "data_class": F.lit("real"),
                }
            ),
            contracts.FINANCIAL_STATEMENTS,
        )

    def macro(self) -> DataFrame:
        """Monthly mean discount and tax, published five days after month end."""
        monthly = (
            self.table("lineitem")
            .groupBy(F.last_day(F.col("l_shipdate").cast("date")).alias("observation_date"))
            .agg(F.avg("l_discount").alias("POLICY_RATE"), F.avg("l_tax").alias("TAX_RATE"))
        )
        released = F.date_add("observation_date", 5)
        long = monthly.unpivot(
            ["observation_date"], ["POLICY_RATE", "TAX_RATE"], "series_id", "value"
        )
        return contracts.conform(
            long.withColumns(
                {
                    "release_date": released,
                    "available_at": released,
                    "source": F.lit("trade_tape"),
                    "data_class": F.lit("real"),
                }
            ),
            contracts.MACRO,
        )

    def foreign_flow(self) -> DataFrame:
        day = F.col("ts").cast("date")
        daily = self.table("events").groupBy(day.alias("date")).agg(
            F.sum("value").alias("foreign_net_value")
        )
        return contracts.conform(
            daily.withColumns(
                {
                    "ticker": F.lit("MARKET"),
                    "available_at": F.col("date"),
                    "source": F.lit("event_stream"),
                    "data_class": F.lit("real"),
                }
            ),
            contracts.FOREIGN_FLOW,
        )

    def index_membership(self) -> DataFrame:
        """One index per sector; a ticker joins at its first trade."""
        m = self.master()
        return contracts.conform(
            m.select(
                "ticker",
                F.col("sector").alias("index_code"),
                F.col("listing_date").alias("effective_from"),
                F.col("delisting_date").alias("effective_to"),
                F.col("listing_date").alias("announcement_date"),
                "available_at",
                "source",
                "data_class",
            ),
            contracts.INDEX_MEMBERSHIP,
        )

    def corporate_actions(self) -> DataFrame:
        return self.spark.createDataFrame([], contracts.CORPORATE_ACTIONS)

    # -- vendor payloads -------------------------------------------------------

    def good_standing(self) -> DataFrame:
        """Tickers the primary vendor covers: a balance that is not negative."""
        return self.table("supplier").where("s_acctbal >= 0").select(
            F.col("s_suppkey").cast("string").alias("ticker")
        )

    def payload_a(self) -> DataFrame:
        return self.bars().select(
            "ticker",
            F.date_format("date", "yyyy-MM-dd").alias("TradingDate"),
            F.col("open").alias("OpenPrice"),
            F.col("high").alias("HighPrice"),
            F.col("low").alias("LowPrice"),
            F.col("close").alias("ClosePrice"),
            F.col("volume").alias("Volume"),
        )

    def payload_b(self) -> DataFrame:
        """Text payload with epoch-millisecond dates and some empty fields."""
        millis = F.unix_date("date").cast("bigint") * 86400000
        flat = F.col("open") == F.col("close")
        return self.bars().select(
            "ticker",
            F.concat(F.lit("/Date("), millis.cast("string"), F.lit(")/")).alias("TradingDate"),
            F.col("open").cast("string").alias("OpenPrice"),
            F.col("high").cast("string").alias("HighestPrice"),
            F.col("low").cast("string").alias("LowestPrice"),
            F.col("close").cast("string").alias("ClosePrice"),
            F.when(flat, F.lit("n/a"))
            .otherwise((F.col("close") / 2).cast("string"))
            .alias("AdjustPrice"),
            F.col("volume").cast("string").alias("TotalVol"),
            F.when(flat, F.lit(None))
            .otherwise(F.col("trading_value").cast("string"))
            .alias("TotalVal"),
        )

    def payload_c(self, which: Column | None = None) -> DataFrame:
        """Prices in thousands, with a session time of day."""
        return self.bars(which).select(
            "ticker",
            F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 07:00:00")).alias("time"),
            *[(F.col(c) / 1000).alias(c) for c in ("open", "high", "low", "close")],
            "volume",
        )

    def payload_d(self, which: Column | None = None) -> DataFrame:
        """Dates stamped one day early; an adjusted close at half the close."""
        return self.bars(which).select(
            "ticker",
            F.date_format(F.date_sub("date", 1), "yyyy-MM-dd").alias("Date"),
            F.col("open").alias("Open"),
            F.col("high").alias("High"),
            F.col("low").alias("Low"),
            F.col("close").alias("Close"),
            F.when(F.col("open") == F.col("close"), F.lit(None))
            .otherwise(F.col("close") / 2)
            .alias("Adj Close"),
            F.col("volume").alias("Volume"),
        )

    def payload_macro(self) -> DataFrame:
        """One JSON page per series and year; an unknown value is a full stop."""
        text = F.when(F.col("value") == 0, F.lit(".")).otherwise(F.col("value").cast("string"))
        known = F.when(F.col("series_id") == "POLICY_RATE", F.col("release_date"))
        pages = self.macro().groupBy("series_id", F.year("observation_date").alias("page")).agg(
            F.collect_list(
                F.struct(
                    F.date_format("observation_date", "yyyy-MM-dd").alias("date"),
                    text.alias("value"),
                    F.date_format(known, "yyyy-MM-dd").alias("realtime_start"),
                )
            ).alias("observations")
        )
        return pages.select("series_id", F.to_json(F.struct("observations")).alias("payload"))

    def primary_feed(self) -> DataFrame:
        """Final fills of tickers in good standing, through the feed D normaliser.

        Bars of some volumes come with a high below their low, as vendors' bad bars do.
        """
        final = F.col("final")
        raw = self.payload_d(final).join(self.good_standing(), "ticker", "left_semi")
        bars = feeds.normalize_feed_d(raw, "table://lineitem/final")
        return bars.withColumn("high", F.when(F.col("volume") % 97 == 0, F.col("low") / 2).otherwise(F.col("high")))

    def fallback_feed(self) -> DataFrame:
        """Open fills of every ticker, through the feed C normaliser."""
        return feeds.normalize_feed_c(self.payload_c(~F.col("final")), "table://lineitem/open")

    def listing(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("position"),
            F.col("s_suppkey").cast("string").alias("symbol"),
            F.col("s_name").alias("name"),
        )

    def repeated_listing(self) -> DataFrame:
        """Every supplier's name twice, the second time later in the listing."""
        once = self.listing().withColumn("symbol", F.concat(F.lit(" "), F.col("name")))
        return once.unionByName(once.withColumn("position", F.col("position") + 3))


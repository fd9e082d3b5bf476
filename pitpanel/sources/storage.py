"""Readers, imports, sinks and the run ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel import contracts
from pitpanel.operators.moments import PROBLEM
from pitpanel.session import store


@dataclass(frozen=True)
class Layers:
    """The four storage layers under one root."""

    root: str

    def path(self, layer: str, name: str) -> str:
        if layer not in {"raw", "normalized", "curated", "reports"}:
            raise ValueError(f"unknown layer: {layer}")
        return f"{self.root.rstrip('/')}/{layer}/{name}"


def read_contract(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet read with the declared schema, so pruning and pushdown reach the files."""
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Text columns from CSV, typed columns from parquet, chosen by suffix."""
    if path.rstrip("/").lower().endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).csv(path)


def import_prices(
    spark: SparkSession, path: str, source: str, source_url: str, date_format: str | None = None
) -> DataFrame:
    """CSV prices to the contract, with defaults for the optional columns."""
    raw = contracts.require(read_table(spark, path), contracts.REQUIRED["prices"], "prices import")
    return _priced(raw.withColumn("_path", F.col("_metadata.file_path")), path, source, source_url, date_format)


def _priced(raw: DataFrame, path: str, source: str, source_url: str, date_format: str | None = None) -> DataFrame:
    """Text rows with the ``_path`` of their file as contract prices."""
    spark = raw.sparkSession
    files = (
        spark.read.format("binaryFile")
        .load(path)
        .select(F.col("path").alias("_path"), F.sha2("content", 256).alias("raw_checksum"))
    )

    def number(name: str):
        return F.col(name).try_cast("double")

    def day(name: str):
        text = F.col(name).cast("string")
        return F.to_date(text, date_format) if date_format else F.to_date(text)

    close, volume = number("close"), number("volume")
    has = set(raw.columns)
    out = raw.join(files, "_path", "left")  # a row per file; Spark knows its size
    out = out.withColumns(
        {
            "date": day("date"),
            "available_at": day("available_at") if "available_at" in has else day("date"),
            "adjusted_close": F.coalesce(number("adjusted_close"), close)
            if "adjusted_close" in has
            else close,
            "trading_value": F.coalesce(number("trading_value"), volume * close)
            if "trading_value" in has
            else volume * close,
            **{c: number(c) for c in ("open", "high", "low", "close")},
            "volume": volume,
            "source": F.lit(source),
            "source_url": F.lit(source_url),
            "fetched_at": F.current_timestamp(),
            "parser_version": F.lit("csv-v1"),
            "data_class": F.lit("real"),
        }
    )
    return contracts.conform(out, contracts.PRICES)


def checked_rows(spark: SparkSession, path: str, name: str, date_format: str | None = None) -> DataFrame:
    """Every row of landed CSV files as text, with ``_path``, ``_line`` and ``reasons``.

    ``reasons`` is empty for a good row. A line with too many or too few fields is kept whole in
    ``_line`` and is ``malformed_line``. Otherwise a required key or date that is empty, a date and a
    number that cannot be read are named with their column. All files must have the first one's
    header. One pass; nothing is dropped.
    """
    schema = contracts.PRICES if name == "prices" else contracts.SIDE_TABLES[name]
    head = contracts.require(read_table(spark, path), contracts.REQUIRED[name], f"{name} import").columns
    shape = ", ".join([*(f"`{c}` string" for c in head), "_line string"])
    rows = (
        spark.read.schema(shape).option("header", True).option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", "_line").csv(path)
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    types = {f.name: f.dataType for f in schema.fields}
    faults = []
    for c in head:
        if c not in types:
            continue
        text = F.trim(F.coalesce(F.col(c), F.lit("")))
        empty = text == ""
        if types[c] == T.DateType():
            read = F.try_to_timestamp(text, F.lit(date_format)) if date_format else F.try_to_timestamp(text)
            faults.append(F.when(~empty & read.isNull(), f"bad_date:{c}"))
        elif types[c] in (T.DoubleType(), T.LongType()):
            faults.append(F.when(~empty & text.try_cast("double").isNull(), f"bad_number:{c}"))
        if c in contracts.REQUIRED[name] and types[c] in (T.DateType(), T.StringType()) and c != "effective_to":
            faults.append(F.when(empty, f"missing:{c}"))
    found = F.filter(F.array(*faults), lambda r: r.isNotNull())
    return rows.withColumn("reasons", F.when(F.col("_line").isNotNull(), F.array(F.lit("malformed_line"))).otherwise(found))


def import_prices_checked(
    spark: SparkSession, path: str, source: str, source_url: str, date_format: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): contract prices, and the other lines with their file and reasons.

    Rows are read once and stored, so both tables come from the same reading.
    """
    rows = store(checked_rows(spark, path, "prices", date_format), "landed")
    good = rows.where(F.size("reasons") == 0).drop("_line", "reasons")
    text = [c for c in rows.columns if c not in ("_line", "reasons", "_path")]
    line = F.coalesce("_line", F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in text]))
    rejected = rows.where(F.size("reasons") > 0).select(F.col("_path").alias("file"), "date", "ticker", "reasons", line.alias("line"))
    return _priced(good, path, source, source_url, date_format), rejected


def import_side_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A side table checked for its required columns; dates that do not parse are NULL.

    Contract columns are cast by the contract's types, so every date column is a
    date whatever its name; further columns pass through.
    """
    schema = contracts.SIDE_TABLES[name]
    raw = contracts.require(read_table(spark, path), contracts.REQUIRED[name], name)
    types = {f.name: f.dataType for f in schema.fields}

    def typed(column: str):
        c = F.col(column)
        if column not in types:
            return c
        if types[column] == T.DateType():
            return F.to_date(F.try_to_timestamp(c.cast("string"))).alias(column)
        return c.cast("string").try_cast(types[column].simpleString()).alias(column)

    return raw.select(*[typed(c) for c in raw.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None):
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def read_artifact(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"):
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def stale_tickers(incoming: DataFrame, stored: DataFrame, end: str, slack_days: int = 10) -> DataFrame:
    """Incoming rows of tickers whose stored bars do not yet reach the end date."""
    return incoming.join(fresh_tickers(stored, end, slack_days), "ticker", "left_anti")


def fresh_tickers(stored: DataFrame, end, slack_days: int = 10) -> DataFrame:
    limit = F.date_sub(end if not isinstance(end, str) else F.lit(end).cast("date"), slack_days)
    return (
        stored.groupBy("ticker")
        .agg(F.max("date").alias("last_date"))
        .where(F.col("last_date") >= limit)
        .select("ticker", "last_date")
    )


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """All per-ticker files of a landing folder as one panel."""
    return spark.read.schema(contracts.PRICES).parquet(path)


def run_ledger(prices: DataFrame, source: str, requested: DataFrame) -> DataFrame:
    """One row describing a batch: volumes, span, and requested tickers not collected.

    ``requested``: (ticker). Missing tickers are counted, not listed, so the row
    stays small at any universe size; ``missing_tickers`` lists them.
    """
    got = prices.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("ticker").alias("tickers_collected"),
        F.min("date").alias("date_start"),
        F.max("date").alias("date_end"),
    )
    asked = requested.select("ticker").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    lost = missing_tickers(prices, requested).agg(F.count(F.lit(1)).alias("n")).scalar()
    return got.withColumns(
        {"source": F.lit(source), "tickers_requested": asked, "failures": lost}
    ).withColumn("status", F.when(F.col("failures") > 0, "partial").otherwise("success"))


def missing_tickers(prices: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.select("ticker").distinct().join(
        prices.select("ticker").distinct(), "ticker", "left_anti"
    )


def nested_instances(
    moments: DataFrame, pools: DataFrame, decisions: DataFrame, cardinality: int
) -> DataFrame:
    """One document per problem: tickers, mean vector, covariance and matrix rows."""
    by_row = moments.groupBy(*PROBLEM, "i").agg(
        F.max("mu").alias("mu"),
        F.sort_array(F.collect_list(F.struct("j", "cov", "q"))).alias("_r"),
    )
    packed = by_row.groupBy(*PROBLEM).agg(
        F.sort_array(
            F.collect_list(
                F.struct("i", "mu", F.col("_r.cov").alias("cov"), F.col("_r.q").alias("q"))
            )
        ).alias("_p")
    )
    names = pools.groupBy(*PROBLEM).agg(
        F.sort_array(F.collect_list(F.struct("idx", "ticker"))).alias("_t")
    )
    return (
        packed.join(names, PROBLEM)
        .join(decisions.select("fold", "decision_time"), "fold")
        .select(
            *PROBLEM,
            "decision_time",
            F.col("_t.ticker").alias("tickers"),
            F.least(F.lit(cardinality), F.size("_t")).alias("cardinality"),
            F.col("_p.mu").alias("expected_return"),
            F.col("_p.cov").alias("covariance"),
            F.col("_p.q").alias("selection_matrix"),
        )
    )

"""Panel validation, coverage, leakage audit, run gate and fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel import contracts
from pitpanel.functions.scalars import any_true, bad_ohlc, ratio

OUTLIER = 0.30


def validation_issues(prices: DataFrame) -> DataFrame:
    """(severity, check, count) of every violated check.

    Row checks are one partial aggregate. Copies of a key are counted by an
    aggregate per key, so a key with very many copies costs one row per task.
    """
    row_checks = prices.agg(
        F.count_if(bad_ohlc()).alias("ohlc_logic"),
        F.count_if(any_true(F.col("volume") < 0, F.col("trading_value") < 0)).alias(
            "nonnegative_volume_value"
        ),
        F.count_if(F.col("available_at") < F.col("date")).alias("available_before_observation"),
    )
    duplicates = (
        prices.groupBy("date", "ticker")
        .count()
        .where("count > 1")
        .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("unique_date_ticker"))
    )
    outliers = return_outliers(prices).agg(F.count(F.lit(1)).alias("return_outlier_flag"))
    parts = []
    for frame in (duplicates, row_checks, outliers):
        parts.append(frame.unpivot([], frame.columns, "check", "count"))
    counted = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("count > 0")
    severity = F.when(F.col("check") == "return_outlier_flag", "warning").otherwise("error")
    return counted.select(severity.alias("severity"), "check", F.col("count").cast("bigint"))


def return_outliers(prices: DataFrame, limit: float = OUTLIER) -> DataFrame:
    """Rows whose one-row return exceeds ``limit`` in size.

    Every bar is checked, each against the bar before it of its own source.
    """
    w = Window.partitionBy("ticker", "source").orderBy("date", "adjusted_close")
    moved = ratio(F.col("adjusted_close"), F.lag("adjusted_close").over(w)) - 1
    once = prices.select("ticker", "date", "source", "adjusted_close")
    return once.withColumn("ret1", moved).where(F.abs("ret1") > limit)


def coverage_by_year(prices: DataFrame) -> DataFrame:
    return prices.groupBy(
        "ticker", F.year("date").alias("year"), "source", "data_class"
    ).agg(
        F.count(F.lit(1)).alias("records"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.count_if(F.col("close").isNull()).alias("missing_close"),
    )


def coverage_by_ticker(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker", "source").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.datediff(F.max("date"), F.min("date")).alias("calendar_span_days"),
        F.count_if(F.col("open").isNull()).alias("missing_open"),
        F.count_if(F.col("close").isNull()).alias("missing_close"),
        F.count_if(F.col("close") <= 0).alias("nonpositive_close"),
    )


def dataset_summary(prices: DataFrame) -> DataFrame:
    return prices.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("ticker").alias("tickers"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.array_join(F.array_sort(F.collect_set("data_class")), "|").alias("data_classes"),
    )


def validation_verdict(prices: DataFrame) -> DataFrame:
    """One row: status, summary and the failed checks, worst first; nothing passes through the driver."""
    worst = F.sort_array(F.collect_list(F.struct("severity", "check", "count")))
    said = validation_issues(prices).agg(
        F.struct(
            F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("failed"),
            F.array_join(F.transform(worst, lambda i: F.concat_ws(":", i["severity"], i["check"], i["count"].cast("string"))), "|").alias("issues"),
        )
    )
    report = dataset_summary(prices).withColumn("_said", said.scalar())
    status = F.when(F.col("_said.failed"), "fail").otherwise("pass").alias("status")
    return report.select(status, "records", "tickers", "start", "end", "data_classes", F.col("_said.issues").alias("issues"))


def validate_panel(prices: DataFrame) -> dict:
    """The quality report: status, summary and issues. Runs two small jobs."""
    issues = [r.asDict() for r in validation_issues(prices).collect()]
    summary = dataset_summary(prices).first().asDict()
    failed = any(i["severity"] == "error" for i in issues)
    summary["data_class"] = [c for c in (summary.pop("data_classes") or "").split("|") if c]
    return {"status": "fail" if failed else "pass", **summary, "issues": issues}


def split_bad_bars(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows by the OHLC predicate."""
    return prices.where(~bad_ohlc()), prices.where(bad_ohlc())


# -- leakage audit ---------------------------------------------------------------


def _is_fixture(df: DataFrame) -> Column:
    found = F.lit(False)
    if "data_class" in df.columns:
        found = found | F.coalesce(F.col("data_class") == "fixture", F.lit(False))
    if "source" in df.columns:
        found = found | F.coalesce(F.lower("source").contains("fixture"), F.lit(False))
    return found


def side_table_status(tables: dict[str, DataFrame | None], spark) -> DataFrame:
    """(table, status): missing, fixture or real_or_empty; one aggregate per table."""
    parts = []
    for name in contracts.SIDE_TABLES:
        table = tables.get(name)
        if table is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table"), F.lit("missing").alias("status")))
            continue
        seen = F.coalesce(F.bool_or(_is_fixture(table)), F.lit(False))
        parts.append(
            table.agg(seen.alias("_f")).select(
                F.lit(name).alias("table"),
                F.when(F.col("_f"), "fixture").otherwise("real_or_empty").alias("status"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leakage_checks(
    prices: DataFrame, master: DataFrame, tables: dict[str, DataFrame | None]
) -> DataFrame:
    """(check, passed, fixture_only) rows, one per leakage contract.

    Schema contracts are known on the driver; the others are one aggregate over
    prices and one per side table.
    """
    listed = {"listing_date", "delisting_date", "available_at"} <= set(master.columns)
    actions = tables.get("corporate_actions")
    stamps = {"announcement_date", "effective_date", "available_at"}
    stamped = actions is None or stamps <= set(actions.columns) or actions.isEmpty()
    fixture = F.coalesce(F.col("data_class") == "fixture", F.lit(False))
    facts = prices.agg(
        F.coalesce(F.bool_or(fixture), F.lit(False)).alias("some"),
        F.coalesce(F.bool_and(fixture), F.lit(True)).alias("every"),
        F.coalesce(
            F.bool_and(F.coalesce(F.col("available_at") <= F.col("date"), F.lit(False))),
            F.lit(True),
        ).alias("timely"),
    )
    side = side_table_status(tables, prices.sparkSession).agg(
        (F.count_if(F.col("status") == "fixture") == 0).alias("clean")
    )
    clean = side.scalar()
    checks = facts.select(
        "every",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("check"), v.alias("passed"))
                    for n, v in {
                        "current_universe_not_backfilled": F.lit(listed),
                        "real_prices_only": ~F.col("some"),
                        "auxiliary_tables_fixture_free": clean,
                        "corporate_action_timestamps": F.lit(stamped),
                        "available_at_not_after_decision_observation": F.col("timely"),
                    }.items()
                ]
            )
        ),
    )
    return checks.select("check", "passed", F.col("every").alias("fixture_only"))


def leakage_audit(
    prices: DataFrame, master: DataFrame, tables: dict[str, DataFrame | None]
) -> dict:
    """The audit report. A panel of fixtures only waives its blockers."""
    rows = leakage_checks(prices, master, tables).collect()
    side = {r.table: r.status for r in side_table_status(tables, prices.sparkSession).collect()}
    fixture_only = bool(rows and rows[0].fixture_only)
    blockers = [] if fixture_only else [r.check for r in rows if not r.passed]
    limits = [f"{n}_not_configured" for n, s in side.items() if s == "missing"]
    if fixture_only:
        status = "pass_for_fixture_demo"
    elif blockers:
        status = "blocked"
    else:
        status = "pass_with_limitations" if limits else "pass"
    return {
        "status": status,
        "checks": {r.check: r.passed for r in rows},
        "blockers": blockers,
        "limitations": limits,
        "auxiliary_tables": side,
    }


def audit_verdict(
    prices: DataFrame, master: DataFrame, tables: dict[str, DataFrame | None]
) -> DataFrame:
    """One row: the audit's status, its blockers and its limitations."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("check"))))
    checks = leakage_checks(prices, master, tables).agg(
        F.coalesce(F.bool_or("fixture_only"), F.lit(False)).alias("fixture_only"), failed.alias("_failed")
    )
    missing = F.array_sort(F.collect_set(F.when(F.col("status") == "missing", F.concat("table", F.lit("_not_configured")))))
    limits = side_table_status(tables, prices.sparkSession).agg(F.array_join(missing, "|"))
    blockers = F.when(F.col("fixture_only"), "").otherwise(F.array_join("_failed", "|"))
    status = (
        F.when(F.col("fixture_only"), "pass_for_fixture_demo")
        .when(F.col("blockers") != "", "blocked")
        .when(F.col("limitations") != "", "pass_with_limitations")
        .otherwise("pass")
    )
    one = checks.withColumn("blockers", blockers).withColumn("limitations", limits.scalar())
    return one.select(status.alias("status"), "blockers", "limitations", "fixture_only")


def gate_verdict(quality: DataFrame, audit: DataFrame, modes: list[str]) -> DataFrame:
    """(mode, allowed, reason) from the two one-row verdicts."""
    reports = quality.select(F.col("status").alias("_quality"), "data_classes", audit.select("status").scalar().alias("_audit"))
    rows = reports.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    fixture = F.array_contains(F.split("data_classes", r"\|"), "fixture")
    reason = (
        F.when(F.col("_quality") != "pass", "data_quality_failed")
        .when(F.col("_audit") == "blocked", "leakage_audit_blocked")
        .when((F.col("mode") == "research") & fixture, "research_refuses_fixtures")
        .otherwise("")
    )
    return rows.select("mode", (reason == "").alias("allowed"), reason.alias("reason"))


def run_gate(quality: dict, audit: dict, mode: str) -> None:
    """Refuse a run on failed quality, a blocked audit or fixtures in research mode."""
    if quality["status"] != "pass":
        raise RuntimeError("data quality failed; run refused")
    if audit["status"] == "blocked":
        raise RuntimeError(f"leakage audit blocked by {audit['blockers']}; run refused")
    if mode == "research" and "fixture" in quality["data_class"]:
        raise RuntimeError("research mode refuses fixture data")


# -- fingerprint --------------------------------------------------------------------


def fingerprint(df: DataFrame, columns: list[str], scale: int = 10000) -> DataFrame:
    """Order-free fingerprint: rows and four lanes of summed sha-256 pieces.

    Sums are partial aggregates of fixed size, so no task holds a group's hashes;
    equal multisets of rows give equal lanes on any partitioning. Doubles enter
    as integers of ``1/scale``. A value is written after its length, a NULL as a dash, so
    that no two different rows read alike.
    """
    kinds = dict(df.dtypes)
    parts = []
    for name in columns:
        c = F.col(name)
        if kinds[name] in ("double", "float"):
            c = F.floor(c * scale + 0.5).cast("bigint")
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    digest = F.sha2(F.concat(*parts), 256)
    lanes = {
        f"lane{i}": F.sum(
            F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
        ).cast("string")
        for i in range(4)
    }
    return df.agg(F.count(F.lit(1)).alias("records"), *[v.alias(k) for k, v in lanes.items()])


def file_checksums(spark, path: str) -> DataFrame:
    """sha-256 of each landed file, read whole by one task per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("checksum"))

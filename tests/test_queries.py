"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
CHECKED = [
    "panel_prices", "feat_macd", "feat_target_rank", "asof_financials", "universe_monthly",
    "merge_sources", "incremental_ingest", "adaptive_selection", "shrunk_cov", "backtest_equal",
    "fold_counts", "regimes", "paired_bootstrap", "allocate_weights", "run_gate", "import_prices_rejected", "fold_status",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(result.fetchall(), columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partition_count_does_not_change_results(spark):
    name = "selection_trace"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = rows_of(entry.queries()[name](spark, SF).collect(), ["a"] * 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == rows_of(entry.queries()[name](spark, SF).collect(), ["a"] * 4)


def plan_of(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_bars_hash_aggregate(spark):
    plan = plan_of(spark, "feat_rsi")
    scan = [line for line in plan.splitlines() if "FileScan" in line]
    assert scan and all("l_discount" not in line and "l_returnflag" not in line for line in scan)
    assert "SortAggregate" not in plan and "CartesianProduct" not in plan


def test_market_return_joins_by_broadcast(spark):
    plan = plan_of(spark, "feat_beta")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

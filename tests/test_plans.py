"""Plans of registered queries, and the experiment from end to end."""

from dataclasses import replace

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pitpanel.operators import ranker, selection
from pitpanel.operators.folds import WalkForward, decision_dates, make_folds, recent_dates
from pitpanel.plans import queries as q
from pitpanel.plans.walkforward import STRATEGIES, ExperimentConfig, WalkForwardRun, run_experiment
from pitpanel.sources.panel import TradePanel

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def panel(spark):
    return TradePanel(spark, SF)


def test_top_m_limits_rows_before_the_shuffle(spark):
    snap = spark.range(100).select((F.col("id") % 3).alias("fold"), F.col("id").alias("ticker"), F.rand(1).alias("x"))
    text = plan(selection.top_by(snap, "x", 6))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["fold_counts", "topm_liquidity", "ewma_cov", "asof_macro", "feat_all", "backtest_equal"])
def test_no_nested_loop_or_product(spark, name):
    text = plan(q.QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_decisions_and_windows_by_equality(panel):
    calendar = panel.calendar()
    made = make_folds(calendar, WalkForward())
    assert made.count() == 53
    decided = decision_dates(made, calendar)
    window = recent_dates(decided, calendar, 5)
    for df in (decided, window):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    days = sorted(r.date for r in calendar.collect())
    for f in decided.collect():
        want = [d for d in days if d <= f.test_start]
        assert f.decision_time == want[-1]
    held = {(r.fold, r.age): r.date for r in window.collect()}
    last = {r.fold: r.decision_time for r in decided.collect()}
    assert all(held[f, a] == days[days.index(last[f]) - a] for f, a in held)


def test_no_training_row_reaches_the_test_window(panel):
    fold = make_folds(panel.calendar(), WalkForward()).orderBy(F.desc("fold")).first()
    rows = ranker.training_rows(panel.prices(), fold).agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    assert fold.train_start <= rows.lo and rows.hi < fold.train_end


def test_experiment_end_to_end(panel):
    """The formula signal keeps this short; the ranker has its own test."""
    cfg = ExperimentConfig(walk=WalkForward(24, 3, 1, max_folds=2), ranker=None, periods=52)
    tables = run_experiment(
        panel.prices(), panel.master(), {"financial_statements": panel.financials(), "macro": panel.macro()}, cfg
    )
    assert tables["fold_manifest"].count() == 2
    weights = tables["weights"].groupBy("strategy", "fold").agg(F.sum("weight").alias("w")).collect()
    assert weights and all(abs(r.w - 1) < 1e-6 for r in weights)
    assert tables["portfolio_returns"].where("ret IS NULL").count() == 0


def test_no_fold_vanishes(panel):
    """Folds without tickers, complete rows or test dates are told apart from completed ones."""
    walk = WalkForward(24, 3, 1, max_folds=4)
    made = {f.fold: f for f in make_folds(panel.calendar(), walk).collect()}
    prices = panel.prices()
    test = (F.col("date") > F.lit(made[3].test_start)) & (F.col("date") <= F.lit(made[3].test_end))
    last = decision_dates(make_folds(panel.calendar(), walk), panel.calendar()).where("fold = 1").first().decision_time
    few = (F.col("date") == F.lit(last)) & (F.col("ticker") > "3")
    # the last date of the panel stays, so that the list of folds does
    cut = prices.where(~few & (~test | (F.col("date") == F.lit(prices.agg(F.max("date")).first()[0]))))
    cfg = ExperimentConfig(walk=walk, ranker=None, periods=52)
    run = WalkForwardRun(cut.cache(), cfg, calendar=cut.select("date").distinct())
    got = {(r.strategy, r.fold): r for r in run.fold_status.collect()}
    assert got.keys() == {(n, f) for n, _, _ in STRATEGIES for f in range(4)}
    for (_, fold), r in got.items():
        want = {0: "completed", 1: "too_few_tickers", 2: "completed", 3: "completed" if r.test_dates else "no_test_dates"}[fold]
        assert r.stage == want, (fold, r)
        assert (r.candidates == 0) == (fold == 1)
    done = {(r.strategy, r.fold) for r in run.test_chosen.select("strategy", "fold").distinct().collect()}
    assert done == {k for k, r in got.items() if r.stage == "completed"}
    for r in run.run_summary().collect():
        assert (r.folds_requested, r.folds_completed) == (4, sum(k[0] == r.strategy for k in done)) and "too_few_tickers" in r.stopped
    short = WalkForwardRun(cut, replace(cfg, history=1), calendar=cut.select("date").distinct())
    assert {r.stage for r in short.fold_status.where("fold <> 1").collect()} == {"too_few_complete_rows"}


def test_rankers_score_as_their_models(spark, panel):
    """Every fold's signal is that of its own Spark model, trained on its own rows, with its own medians."""
    made = make_folds(panel.calendar(), WalkForward(24, 3, 1, max_folds=2))
    rows = panel.prices().select(
        "ticker", "date", F.when(F.col("volume") % 3 > 0, F.col("close")).alias("a"),
        F.when(F.col("volume") % 5 == 0, float("nan")).otherwise(F.col("volume").cast("double")).alias("b"),
        F.lit(None).cast("double").alias("c"), F.when(F.col("volume") % 7 > 0, F.col("close") % 1000 / 1000).alias("target_rank"),
    ).cache()
    last = rows.agg(F.max("date")).first()[0]
    snap = rows.where(F.col("date") == F.lit(last)).crossJoin(made.select("fold"))
    cfg, names = ranker.RankerConfig(trees=4), ["a", "b", "c"]
    got = {(r.fold, r.ticker): r.signal for r in ranker.rank_assets(rows, snap, made, cfg, names).collect()}
    assert len(got) == snap.count()
    medians = {r.fold: r for r in ranker.fold_medians(rows, made, names).collect()}
    for f in made.collect():
        train = ranker.training_rows(rows, f)
        known = train.where("target_rank IS NOT NULL")
        m = medians[f.fold]
        assert m.train_rows == known.count() and m.c == 0.0
        low, high = known.agg(F.percentile("a", F.lit([0.49, 0.51]))).first()[0]
        assert low <= m.a <= high
        model = ranker.fit_ranker(train, {n: m[n] for n in names}, cfg, names, m.train_rows)
        filled = snap.where(F.col("fold") == f.fold).fillna({n: m[n] for n in names})
        for r in model.transform(VectorAssembler(inputCols=names, outputCol="_x").transform(filled)).collect():
            assert abs(got[r.fold, r.ticker] - r.prediction) < 1e-12
    assert len({round(v, 9) for v in got.values()}) > 2


def test_jobs_of_the_ranker_do_not_grow_with_folds(spark, panel, monkeypatch):
    """A level of a tree is one job for all folds; no fold is fitted on its own."""
    rows = panel.prices().select(
        "ticker", "date", F.col("close").alias("a"), F.col("volume").cast("double").alias("b"),
        (F.col("close") % 1000 / 1000).alias("target_rank"),
    ).cache()
    last = rows.agg(F.max("date")).first()[0]
    monkeypatch.setattr(ranker, "fit_ranker", None)
    jobs = []
    for n in (1, 4):
        made = make_folds(panel.calendar(), WalkForward(24, 3, 1, max_folds=n)).cache()
        snap = rows.where(F.col("date") == F.lit(last)).crossJoin(made.select("fold"))
        spark.sparkContext.setJobGroup(f"ranker {n}", "")
        got = ranker.rank_assets(rows, snap, made, ranker.RankerConfig(trees=2, depth=2), ["a", "b"])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ranker {n}")))
        assert {r.fold for r in got.select("fold").distinct().collect()} == set(range(n))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 3


def test_ranker_without_rows_is_refused(panel):
    made = make_folds(panel.calendar(), WalkForward(24, 3, 1, max_folds=1))
    rows = panel.prices().select("ticker", "date", F.col("close").alias("a"), F.lit(None).cast("double").alias("target_rank"))
    with pytest.raises(ValueError, match="no fold"):
        ranker.rank_assets(rows, rows.limit(3).withColumn("fold", F.lit(0)), made, ranker.RankerConfig(trees=1), ["a"])


def test_research_refuses_fixture_rows(panel):
    fixture = panel.prices().withColumn("data_class", F.lit("fixture"))
    with pytest.raises(RuntimeError):
        run_experiment(fixture, panel.master(), {})

"""Steps whose cost must not grow faster than what their readers ask for."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitpanel.contracts import MARKET_FEATURES
from pitpanel.llm import toxicity
from pitpanel.llm.common import possible
from pitpanel.operators import decision_features, features, selection
from pitpanel.operators.folds import WalkForward
from pitpanel.plans.walkforward import ExperimentConfig, WalkForwardRun
from pitpanel.sources.panel import TradePanel


@pytest.fixture(scope="module")
def panel(spark):
    return TradePanel(spark, "/root/testdata/sf0.001")


def test_features_on_dates_are_the_panels(panel):
    """With holes in every column, missing rows, and small parts."""
    hole = F.xxhash64("ticker", "date") % 37
    names = ["high", "low", "adjusted_close", "trading_value"]
    prices = panel.prices().where("xxhash64(date, ticker) % 50 <> 0").select(
        "ticker", "date", *[F.when((hole != i) | (F.col("ticker") < "3"), F.col(c)).alias(c) for i, c in enumerate(names)]
    ).cache()
    market = features.market_returns(features.with_ret1(prices)).cache()
    asked = prices.select("date").distinct().where("day(date) < 9")
    want = features.market_features(prices, None, market).join(asked, "date")
    got = decision_features.market_features_on(prices, asked, market)
    want, got = ({(r.ticker, r.date): r for r in rows.collect()} for rows in (want, got))
    assert want.keys() == got.keys() and len(got) > 500
    for key, r in want.items():
        for name in MARKET_FEATURES:
            a, b = r[name], got[key][name]
            assert (a is None) == (b is None), (key, name)
            assert a is None or abs(a - b) <= 1e-9 * max(1.0, abs(a)), (key, name, a, b)
    assert all(sum(r[n] is not None for r in got.values()) > 50 for n in MARKET_FEATURES)


def test_greedy_rounds_see_only_rows_that_could_be_picked(spark):
    cfg = selection.Reduction()
    scores = [float(n) / 100 for n in range(1000)] + [None, float("nan")]
    rows = spark.createDataFrame(
        [(f, f"T{n:04d}", s) for f in range(2) for n, s in enumerate(scores)], "fold int, ticker string, base_score double"
    ).union(spark.createDataFrame([(7, "A", 1.0), (7, "B", -9.0)], "fold int, ticker string, base_score double"))
    got = {(r.fold, r.ticker) for r in selection._able(rows, cfg, None).collect()}
    assert {(7, "A"), (7, "B")} <= got  # fewer rows than rounds
    for fold in range(2):
        kept = {t for f, t in got if f == fold}
        assert {"T1000", "T1001"} <= kept
        # six best, and those less than the penalty of 0.1 below the sixth (9.94)
        assert {f"T{n:04d}" for n in range(985, 1000)} <= kept and len(kept) <= 2 + 16


def test_rows_that_could_have_a_partner(spark):
    rows = spark.createDataFrame([(n, "x" * 10) for n in range(5000)] + [(None, "y")], "id long, text string")
    keys = spark.createDataFrame([(n,) for n in range(0, 5000, 50)] + [(9999,)], "k long")
    got = {r.id: r.asked for r in possible(rows, "id", keys, "asked").collect()}
    assert len(got) == 5001 and all(got[n] for n in range(0, 5000, 50))
    assert sum(got.values()) < 150  # of rows without a partner only those whose bit is taken
    none = possible(rows, "id", keys.where("k < 0"), "asked")
    assert none.columns == ["id", "text", "asked"] and none.where("asked").isEmpty()
    other = spark.createDataFrame([("7",)], "k string")
    assert possible(rows, "id", other, "asked").where("NOT asked").isEmpty()  # hashes of other types say nothing


def test_features_are_chosen_as_from_all_counts(spark, monkeypatch):
    """The choice without reading clean rows for every feature, in few and in many bands."""
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    one = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("int").alias("l_toxic"))
    picked = docs.join(one, F.col("doc_id") == F.col("l_id")).select("text", "l_toxic").cache()
    chars = toxicity.corpus_model(docs)
    sent = spark.sparkContext.broadcast(chars)
    count = {y: Counter() for y in (0, 1)}
    reader, total = toxicity.Reader(chars, None), Counter()
    for r in picked.collect():
        count[r.l_toxic].update(reader.text(r.text))
        total[r.l_toxic] += 1
    T, N = total[1], total[0]
    want = sorted(
        (-toxicity._ratio(t, count[0][f], T, N), f) for f, t in count[1].items()
        if t >= toxicity.MIN_TOXIC and t / T > 4 * count[0][f] / N and toxicity._ratio(t, count[0][f], T, N) >= toxicity.MIN_RATIO
    )
    assert len(want) > 20
    for most, held in ((600, 300_000), (10, 300_000), (10, 40)):
        monkeypatch.setattr(toxicity, "HELD_FEATURES", held)
        got, found = toxicity._chosen(picked, sent, T, N, most)
        assert got == [f for _, f in want[:most]]
        assert found.agg(F.sum("n")).first()[0] == T + N


def test_features_reach_the_driver_in_small_bands(spark, monkeypatch):
    """The same choice where the driver holds a few features at a time."""
    rows = [("bad worse worst text", 1)] * 30 + [("bad words here", 1)] * 20 + [("some text here", 0)] * 150
    picked = spark.createDataFrame(rows, "text string, l_toxic int").cache()
    sent = spark.sparkContext.broadcast(toxicity.corpus_model(picked))
    want, _ = toxicity._chosen(picked, sent, 50, 150, 600)
    held = []
    pairs = toxicity._pairs
    monkeypatch.setattr(toxicity, "_pairs", lambda df: held.append(pairs(df)) or held[-1])
    monkeypatch.setattr(toxicity, "BAND_FEATURES", 1)
    got, _ = toxicity._chosen(picked, sent, 50, 150, 600)
    assert got == want and len(want) > 2 and len(held) > 3


def test_newton_steps_bring_no_row_objects_to_the_driver(spark, monkeypatch):
    """Sums come as Arrow batches; at the end the slope of the penalised likelihood is nought."""
    given = [([0, 1], 1, 5), ([0], 1, 3), ([2], 0, 4), ([1, 2], 0, 2), ([], 0, 9), ([0, 2], 1, 1)]
    rows = spark.createDataFrame(given, "at array<int>, y int, n long")

    def refused(*_):
        raise AssertionError("rows as objects")

    monkeypatch.setattr(type(rows), "toPandas", refused)
    monkeypatch.setattr(type(rows), "collect", refused)
    w, bias = toxicity._logistic(rows, 3, (9, 15))
    prior = math.log(9.5 / 15.5)
    slope = [-0.005 * w[0], -0.005 * w[1], -0.005 * w[2], -2.4 * (bias - prior)]
    for at, y, n in given:
        error = n * (y - 1 / (1 + math.exp(-bias - sum(w[i] for i in at))))
        for i in [*at, 3]:
            slope[i] += error
    assert max(map(abs, slope)) < 1e-3


def test_fill_order_is_a_long_where_keys_fit(spark, panel, tmp_path):
    """Both packings order the fills of a week alike."""
    assert panel.fills().schema["at"].dataType.simpleString() == "bigint"
    wide = panel.table("lineitem").withColumn("l_orderkey", F.expr("l_orderkey + (1L << 50)"))
    wide.write.parquet(str(tmp_path / "lineitem.parquet"))
    far = TradePanel(spark, str(tmp_path))
    assert far.fills().schema["at"].dataType.simpleString() == "decimal(38,0)"
    bars, same = panel.bars(), far.bars()
    assert bars.count() > 1000 and not bars.exceptAll(same).count() and not same.exceptAll(bars).count()


def test_averages_read_one_row_a_ticker(spark):
    """Averages of windows with gaps, each from its own rows; no window over the panel's rows."""
    days = [(f"2020-01-{d:02d}",) for d in range(1, 29)]
    rows = [(t, d, float((n * 7 + len(t)) % 11) - 4) for t in ("A", "BB", "C") for n, (d,) in enumerate(days) if (n * len(t) + n // 5) % 3]
    returns = spark.createDataFrame([*rows, ("D", days[0][0], 1.0), ("E", days[3][0], None)], "ticker string, d string, ret1 double").select(
        "ticker", F.col("d").cast("date").alias("date"), "ret1"
    )
    spans = {0: (0, 9), 1: (4, 20), 2: (12, 27)}
    window = spark.createDataFrame(
        [(f, days[n][0], hi - n) for f, (lo, hi) in spans.items() for n in range(lo, hi + 1)], "fold int, d string, age int"
    ).select("fold", F.col("d").cast("date").alias("date"), "age")
    scores = selection.ewma_scores(returns, window, 5)
    got = {(r.fold, r.ticker): r.score for r in scores.collect()}
    want = {}
    for f, (lo, hi) in spans.items():
        for t in "A", "BB", "C", "D":
            at = [(n, x) for n, (d,) in enumerate(days) for u, e, x in [*rows, ("D", days[0][0], 1.0)] if (u, e) == (t, d) and lo <= n <= hi]
            for k, (n, x) in enumerate(at):
                if not k:
                    want[f, t] = x
                else:
                    old = (1 - 1 / 3) ** (n - at[k - 1][0])
                    want[f, t] += (1 / 3) / (old + 1 / 3) * (x - want[f, t])
    assert got.keys() == want.keys()
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert "Window" not in scores._jdf.queryExecution().executedPlan().toString()


def test_history_is_the_one_shuffle_of_the_panel(panel):
    """A ticker's rows lie in one stored row; greedy rounds, averages and features on dates read it as rows were read."""
    prices = panel.priced().where("xxhash64(date, ticker) % 50 <> 0").cache()
    run = WalkForwardRun(prices, ExperimentConfig(walk=WalkForward(24, 3, 1, max_folds=3), ranker=None, periods=52), calendar=panel.calendar())
    rows = features.with_ret1(prices).select("ticker", "date", "ret1")
    assert run.history.count() == prices.select("ticker").distinct().count()
    assert not run.returns.exceptAll(rows).count() and not rows.exceptAll(run.returns).count()
    window = run.window(60)
    args = window, run.cfg.reduction, run.cfg.walk
    for one in (
        lambda r: selection.ewma_scores(r, window, 60).select("fold", "ticker", F.round("score", 12)),
        lambda r: selection.adaptive_reduce(run.snapshot, r, *args).select("fold", "ticker", "pick", F.round("pick_score", 12)),
    ):
        want, got = (Counter(map(tuple, one(r).collect())) for r in (rows, run.history))
        assert want == got and len(got) > 20
    plan = decision_features.market_features_of(run.history, run.decisions.select(F.col("decision_time").alias("date")), run.market)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    held = {r.ticker for r in run.pool_returns.select("ticker").distinct().collect()}
    assert held == {r.ticker for r in run.pools.select("ticker").distinct().collect()}

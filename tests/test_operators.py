"""Literal-row and brute-force tests of the operators."""

import datetime as dt
import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel import contracts
from pitpanel.functions.ranks import with_average_rank
from pitpanel.functions.rolling import with_emas
from pitpanel.operators import allocate, asof, backtest, features, folds, inference, merge, metrics, moments
from pitpanel.operators import quality, selection, subset
from pitpanel.sources import feeds, storage

D = dt.date


def days(n, start=D(2022, 1, 3)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def panel(spark, closes, start=D(2022, 1, 3)):
    """Contract-like prices from {ticker: closes}."""
    rows = [
        (d, t, c, c * 1.01, c * 0.99, c, c, 100, 100.0 * c, "fixture", d, "fixture")
        for t, cs in closes.items()
        for d, c in zip(days(len(cs), start), map(float, cs))
    ]
    return spark.createDataFrame(
        rows,
        "date date, ticker string, open double, high double, low double, close double, "
        "adjusted_close double, volume long, trading_value double, source string, "
        "available_at date, data_class string",
    )


def walk(seed, n):
    return list(100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n))))


def test_feed_b_reads_epoch_dates_and_lags_a_day(spark):
    raw = spark.createDataFrame(
        [("/Date(1704067200000)/", 10, 12, 9, 11, 10.5, 100, 1100)],
        "TradingDate string, OpenPrice int, HighestPrice int, LowestPrice int, ClosePrice int, "
        "AdjustPrice double, TotalVol int, TotalVal int",
    )
    row = feeds.normalize_feed_b(raw, "u", "vcb").first()
    assert (row.ticker, row.close, row.date) == ("VCB", 11.0, D(2024, 1, 1))
    assert row.available_at > row.date


def test_feed_c_converts_thousands(spark):
    raw = spark.createDataFrame(
        [("2020-01-02 07:00:00", 10.0, 11.0, 9.0, 10.5, 100)],
        "time string, open double, high double, low double, close double, volume long",
    )
    row = feeds.normalize_feed_c(raw, "u", "vcb").first()
    assert (row.close, row.trading_value) == (10500.0, 1050000.0)


def test_feed_d_shifts_the_session_date(spark):
    raw = spark.createDataFrame(
        [(D(2020, 1, 1), 10000, 11000, 9000, 10500, 10250, 100)],
        "Date date, Open int, High int, Low int, Close int, `Adj Close` int, Volume int",
    )
    row = feeds.normalize_feed_d(raw, "u", "vcb").first()
    assert (row.date, row.adjusted_close) == (D(2020, 1, 2), 10250.0)


def test_missing_columns_are_named(spark, tmp_path):
    frame = spark.createDataFrame([("AAA",)], "ticker string")
    with pytest.raises(ValueError, match="close"):
        feeds.normalize_feed_a(frame, "u")
    path = str(tmp_path / "membership.csv")
    frame.write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="index_code"):
        storage.import_side_table(spark, path, "index_membership")


def test_csv_import_fills_defaults(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("date,ticker,open,high,low,close,volume\n2024-01-02,AAA,1,2,0.5,1.5,10\n")
    row = storage.import_prices(spark, str(path), "src", "url").first()
    assert (row.adjusted_close, row.trading_value, row.available_at) == (1.5, 15.0, D(2024, 1, 2))
    assert len(row.raw_checksum) == 64


def test_import_keeps_every_line_good_or_rejected(spark, tmp_path):
    head = "date,ticker,open,high,low,close,volume"
    (tmp_path / "a.csv").write_text(
        f"{head}\n2024-01-02,AAA,1,2,0.5,1.5,10\n2024-13-02,AAA,1,2,0.5,1.5,10\n2024-01-03,AAA,1,2,0.5,1.5\n2024-01-04,AAA,1,2,0.5,1.5,10,9\n"
    )
    (tmp_path / "b.csv").write_text(f"{head}\n2024-01-05,,x,2,,1.5,10\n,BBB,1,2,0.5,1.5,many\n2024-01-05,BBB,1,2,,1.5,\n")
    good, rejected = storage.import_prices_checked(spark, str(tmp_path), "src", "url")
    assert {(r.date, r.ticker, r.low, r.volume) for r in good.collect()} == {(D(2024, 1, 2), "AAA", 0.5, 10), (D(2024, 1, 5), "BBB", None, None)}
    assert len({r.raw_checksum for r in good.collect()}) == 2
    got = {(r.file.rsplit("/", 1)[1], r.line): r.reasons for r in rejected.collect()}
    assert got == {
        ("a.csv", "2024-13-02,AAA,1,2,0.5,1.5,10"): ["bad_date:date"], ("a.csv", "2024-01-03,AAA,1,2,0.5,1.5"): ["malformed_line"],
        ("a.csv", "2024-01-04,AAA,1,2,0.5,1.5,10,9"): ["malformed_line"],
        ("b.csv", "2024-01-05,,x,2,,1.5,10"): ["missing:ticker", "bad_number:open"],
        ("b.csv", ",BBB,1,2,0.5,1.5,many"): ["missing:date", "bad_number:volume"],
    }
    (tmp_path / "c.csv").write_text("ticker,date,open,high,low,close,volume\nAAA,2024-01-02,1,2,0.5,1.5,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        storage.checked_rows(spark, str(tmp_path), "prices").collect()


def test_listing_filter_keeps_order_and_pattern(spark):
    raw = spark.createDataFrame(
        [(0, " vnm ", "a"), (1, "FPT", "b"), (2, "E1VFVN30", "c"), (3, "VNM", "d")],
        "position int, symbol string, name string",
    )
    kept = feeds.filter_listing(raw, first=2).collect()
    assert [(r.symbol, r.name) for r in kept] == [("VNM", "a"), ("FPT", "b")]
    asked = feeds.filter_listing(raw, requested=["fpt", "zzz", "vnm"]).collect()
    assert [r.symbol for r in asked] == ["FPT", "VNM"]


def test_ema_matches_recursion_over_many_blocks(spark):
    x = walk(1, 3000)
    df = panel(spark, {"A": x})
    got = with_emas(df, "adjusted_close", {"e3": 3, "e26": 26}).orderBy("date").toPandas()
    for name, span in (("e3", 3), ("e26", 26)):
        want = pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()
        np.testing.assert_allclose(got[name].to_numpy(), want, rtol=1e-12)


def test_features_match_pandas(spark):
    closes = {"A": walk(2, 200), "B": walk(3, 200)}
    got = features.market_features(panel(spark, closes), dates=200).toPandas()
    wide = pd.DataFrame(closes)
    r = wide.pct_change()
    market = r.mean(axis=1)
    for t in closes:
        g = got[got.ticker == t].sort_values("date").reset_index(drop=True)
        p = wide[t]
        want = {
            "return_60d": p.pct_change(60),
            "sma_ratio_20": p / p.rolling(20).mean() - 1,
            "ema_ratio_20": p / p.ewm(span=20, adjust=False).mean() - 1,
            "volatility_20d": r[t].rolling(20).std(),
            "downside_volatility_20d": r[t].where(r[t] < 0, 0).rolling(20).std(),
            "drawdown_60d": p / p.rolling(60).max() - 1,
            "beta_60d": r[t].rolling(60).cov(market) / market.rolling(60).var(),
            "target_return_20d": p.shift(-20) / p - 1,
        }
        for name, series in want.items():
            np.testing.assert_allclose(
                g[name].to_numpy(dtype=float), series.to_numpy(), rtol=1e-8, atol=1e-10, err_msg=name
            )


def test_features_never_look_ahead(spark):
    closes = {"A": walk(4, 160), "B": walk(5, 160)}
    cut = D(2022, 1, 3) + dt.timedelta(days=139)
    names = ["ticker", "date", *contracts.MARKET_FEATURES]
    whole = features.market_features(panel(spark, closes), 200).select(names)
    short = features.market_features(panel(spark, {t: c[:140] for t, c in closes.items()}), 200)
    a = whole.where(F.col("date") <= F.lit(cut)).orderBy("ticker", "date").toPandas()
    b = short.select(names).orderBy("ticker", "date").toPandas()
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("span", [2, 60])
def test_window_averages_start_anew_in_every_fold(spark, span):
    """Scores of overlapping, short and long windows, with gaps, equal a recursion over each window."""
    rng = np.random.default_rng(span)
    n, alpha = 900, 2.0 / (span + 1)
    dates = days(n)
    series = {
        "A": [float(v) for v in rng.normal(size=n)], "B": [float(v) if rng.random() < 0.5 else None for v in rng.normal(size=n)],
        "C": [None] * 700 + [float(v) for v in rng.normal(size=100)] + [None] * 100, "D": [1.0] + [None] * (n - 1),
    }
    windows = {0: range(0, 40), 1: range(20, 60), 2: range(650, 902 - 2), 3: range(720, 721), 4: range(850, 900)}
    rows = [(t, d, v) for t, x in series.items() for d, v in zip(dates, x) if v is not None or t == "D"]
    window = [(f, dates[i], r[-1] - i) for f, r in windows.items() for i in r]
    got = selection.ewma_scores(
        spark.createDataFrame(rows, "ticker string, date date, ret1 double"), spark.createDataFrame(window, "fold int, date date, age int"), span
    )
    want = {}
    for f, r in windows.items():
        for t, x in series.items():
            y, last = None, None
            for i in r:
                if x[i] is not None:
                    w = (1 - alpha) ** (i - last) if last is not None else 0.0
                    y = x[i] if y is None else (w * y + alpha * x[i]) / (w + alpha)
                    last = i
            if y is not None:
                want[f, t] = y
    found = {(r.fold, r.ticker): r.score for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(np.isclose(found[k], want[k], rtol=1e-9, atol=1e-12) for k in want)


def test_average_rank_handles_a_mass_of_ties(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([np.zeros(400), rng.normal(size=600)])
    df = spark.createDataFrame(
        [(i % 2, i, float(v)) for i, v in enumerate(values)], "g int, id int, v double"
    )
    got = with_average_rank(df, ["g"], "v", "r", pct=True, buckets=8).toPandas()
    want = got.groupby("g")["v"].rank(pct=True)
    np.testing.assert_allclose(got["r"], want, rtol=1e-12)


def test_asof_keeps_a_null_field_and_takes_exact_hits(spark):
    left = spark.createDataFrame(
        [("A", D(2024, 1, 1)), ("A", D(2024, 1, 5)), ("A", D(2024, 1, 9))], "k string, t date"
    )
    right = spark.createDataFrame(
        [("A", D(2024, 1, 2), 1.0), ("A", D(2024, 1, 9), None)], "k string, at date, v double"
    )
    got = asof.asof_join(left, right, "k", "t", "at", ["v"]).orderBy("t").collect()
    assert [r.v for r in got] == [None, 1.0, None]


def test_validation_gate_and_audit(spark):
    good = panel(spark, {"A": walk(7, 30)})
    report = quality.validate_panel(good)
    assert report["status"] == "pass" and report["data_class"] == ["fixture"]
    master = spark.createDataFrame([], contracts.SECURITY_MASTER)
    audit = quality.leakage_audit(good, master, {})
    assert audit["status"] == "pass_for_fixture_demo" and audit["blockers"] == []
    with pytest.raises(RuntimeError, match="refuses fixture"):
        quality.run_gate(report, audit, "research")
    doubled = quality.validation_issues(good.unionByName(good))
    assert {r.check: r["count"] for r in doubled.collect()} == {"unique_date_ticker": 60}
    late = good.withColumns({"available_at": F.date_add("date", 1), "data_class": F.lit("real")})
    assert quality.leakage_audit(late, master, {})["blockers"] == [
        "available_at_not_after_decision_observation"
    ]


def test_fingerprint_ignores_order_and_sees_copies(spark):
    df = panel(spark, {"A": walk(8, 20)})
    cols = ["date", "ticker", "close"]
    a = quality.fingerprint(df, cols).first()
    assert a == quality.fingerprint(df.repartition(7).orderBy(F.desc("date")), cols).first()
    assert a != quality.fingerprint(df.unionByName(df.limit(1)), cols).first()


def test_fingerprint_tells_null_and_separators_apart(spark):
    def lanes(*rows):
        return quality.fingerprint(spark.createDataFrame(list(rows), "a string, b string"), ["a", "b"]).first()

    seen = [lanes(r) for r in ((None, "x"), ("", "x"), ("x", None), ("a,b", "c"), ("a", "b,c"), ("a,b|", "c"), ("1:a", "-"), (None, None))]
    assert len(set(seen)) == len(seen)


def test_verdicts_agree_with_the_reports(spark):
    good = panel(spark, {"A": walk(30, 1), "B": walk(30, 2)})
    bad = good.withColumn("low", F.when(F.col("ticker") == "A", F.col("high") + 1).otherwise(F.col("low")))
    fixture = good.withColumn("data_class", F.lit("fixture"))
    late = good.withColumns({"available_at": F.date_add("date", 1), "data_class": F.lit("real")})
    for df in (good.withColumn("data_class", F.lit("real")), bad, fixture, late):
        report = quality.validate_panel(df)
        row = quality.validation_verdict(df).first()
        assert row.status == report["status"] and row.records == report["records"]
        assert sorted(i["check"] for i in report["issues"]) == sorted(x.split(":")[1] for x in row.issues.split("|") if x)
        listed = spark.createDataFrame([], "ticker string, listing_date date, delisting_date date, available_at date")
        audit = quality.leakage_audit(df, listed, {})
        said = quality.audit_verdict(df, listed, {}).first()
        assert said.status == audit["status"] and said.blockers == "|".join(sorted(audit["blockers"]))
        assert said.limitations == "|".join(sorted(audit["limitations"]))
        for gate in quality.gate_verdict(quality.validation_verdict(df), quality.audit_verdict(df, listed, {}), ["demo", "research"]).collect():
            try:
                quality.run_gate(report, audit, gate.mode)
                assert gate.allowed and gate.reason == ""
            except RuntimeError:
                assert not gate.allowed and gate.reason


@pytest.mark.parametrize("n", [20, 27, 40])
def test_resamples_equal_drawn_values(spark, n):
    """Sums over blocks are those of the values a replicate draws, zeros exactly."""
    rng = np.random.default_rng(n)
    x = np.where(np.arange(n) % 15 < 12, 0.0, rng.normal(size=n))
    series = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(x)], "k string, pos int, x double")
    for r in inference.block_resamples(series, "k", 5, 30, 10).collect():
        drawn = []
        for b in range(-(-n // 10)):
            seed = hashlib.md5(f"5|t|{r.replicate}|{b}".encode()).hexdigest()[:8]
            start = int(seed, 16) % (n - 10 + 1)
            drawn += x[start : start + 10].tolist()
        drawn = np.array(drawn[:n])
        assert r.n == n and np.isclose(r.total, drawn.sum(), atol=1e-12) and np.isclose(r.squares, (drawn**2).sum(), atol=1e-12)
        assert (r.total == 0) == (not drawn.any())
    assert inference.block_resamples(series.where("pos < 19"), "k", 5, 3, 10).count() == 0


def moment_rows(spark, columns):
    n = len(next(iter(columns.values())))
    rows = [
        ("s", 0, d, n - 1 - i, [(j, float(c[i])) for j, c in enumerate(columns.values())])
        for i, d in enumerate(days(n))
    ]
    return spark.createDataFrame(
        rows,
        "strategy string, fold int, date date, age int, row array<struct<idx: int, ret1: double>>",
    )


def dense(df, name, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.i, r.j] = r[name]
    return out


def test_ewma_moments_micro_case(spark):
    a, b = [0.01, -0.01, 0.02, 0.03], [0.0, 0.01, -0.02, 0.01]
    got = moments.ewma_moments(moment_rows(spark, {"A": a, "B": b}), span=3, horizon=20)
    cov = dense(got, "cov", 2)
    x = np.array([a, b]).T
    w = 0.5 ** np.arange(3, -1, -1)
    w /= w.sum()
    c = x - w @ x
    want = ((c * w[:, None]).T @ c / (1 - w @ w) + 1e-10 * np.eye(2)) * 20
    np.testing.assert_allclose(cov, want, rtol=1e-9)
    assert np.linalg.eigvalsh(cov).min() >= -1e-9
    assert dense(got, "mu", 2)[0, 0] > np.mean(a) * 20


def test_shrunk_covariance_matches_the_formula(spark):
    x = np.random.default_rng(9).normal(size=(30, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    got = moments.shrunk_moments(moment_rows(spark, dict(enumerate(x.T))), horizon=1)
    c = x - x.mean(axis=0)
    n, p = c.shape
    s = c.T @ c / n
    m = np.trace(s) / p
    d = ((s - m * np.eye(p)) ** 2).sum() / p
    b = sum(((np.outer(t, t) - s) ** 2).sum() for t in c) / n**2 / p
    share = min(b, d) / d
    np.testing.assert_allclose(dense(got, "cov", 3), (1 - share) * s + share * m * np.eye(p), rtol=1e-9)


def matrix(spark, q):
    return spark.createDataFrame(
        [("s", 0, i, j, float(q[i, j])) for i in range(len(q)) for j in range(len(q))],
        "strategy string, fold int, i int, j int, q double",
    )


def test_best_subset_is_the_brute_force_minimum(spark):
    q = np.random.default_rng(10).normal(size=(7, 7))
    q = q + q.T
    inst = subset.instances(matrix(spark, q), 3)
    best = subset.best_subset(inst).first()
    want = min(itertools.combinations(range(7), 3), key=lambda s: q[np.ix_(s, s)].sum())
    assert best.mask == sum(1 << i for i in want)
    assert np.isclose(best.energy, q[np.ix_(want, want)].sum())
    found = subset.random_search(inst, 11, 256).first()
    assert 0 <= found.feasibility_rate <= 1 and found.shots == 256


@pytest.mark.parametrize("n,k", [(1, 1), (4, 9), (6, 3), (20, 3)])
def test_subsets_are_all_of_their_size(spark, n, k):
    q = np.random.default_rng(n).normal(size=(n, n))
    got = {r.mask: r.energy for r in subset.enumerate_subsets(subset.instances(matrix(spark, q), k)).collect()}
    want = {sum(1 << i for i in s): q[np.ix_(s, s)].sum() for s in itertools.combinations(range(n), min(n, k))}
    assert got.keys() == want.keys() and all(np.isclose(got[m], want[m]) for m in want)


def test_subset_size_is_guarded(spark):
    with pytest.raises(Exception, match="limited to 100000 subsets"):
        subset.best_subset(subset.instances(matrix(spark, np.eye(40)), 6)).collect()


def problem_tables(spark, problems):
    """``chosen``, ``moments`` and ``growth`` of (strategy, fold, tickers, mu, cov, growth) problems."""
    chosen, cells, grown = [], [], []
    for s, f, names, mu, cov, g in problems:
        chosen += [(s, f, 2 * i, t) for i, t in enumerate(names)]  # indices of a pool have gaps
        cells += [(s, f, 2 * i, 2 * j, float(mu[i]), float(cov[i][j])) for i in range(len(names)) for j in range(len(names))]
        cells += [(s, f, 1, 2 * i, 0.1, 0.2) for i in range(len(names))]  # not chosen
        grown += [(s, f, t, None if x is None else float(x)) for t, x in zip(names, g)]
    key = "strategy string, fold int"
    return (
        spark.createDataFrame(chosen, f"{key}, idx int, ticker string"),
        spark.createDataFrame(cells, f"{key}, i int, j int, mu double, cov double"),
        spark.createDataFrame(grown, f"{key}, ticker string, growth double"),
    )


@pytest.mark.parametrize("size,rule", [
    (3, allocate.WeightRule(0.0, 0.6, 1.0, 0.01)), (4, allocate.WeightRule(0.05, 0.5, 2.5, 0.002)),
    (2, allocate.WeightRule(0.0, 1.0, 0.5, 0.0)), (1, allocate.WeightRule(0.0, 1.0)),
])
def test_weights_are_the_minimum_fold_after_fold(spark, size, rule):
    rng = np.random.default_rng(size)
    problems = []
    for s in "xy":
        for f in (0, 2, 3, 7):
            a = rng.normal(size=(size, size)) * 0.2
            names = sorted(rng.choice(list("ABCDEF"), size, replace=False).tolist())
            problems.append((s, f, names, rng.normal(0, 0.05, size), a @ a.T, [*rng.uniform(0.5, 1.5, size - 1), None]))
    got = allocate.allocate_weights(*problem_tables(spark, problems), rule).collect()
    held = {}
    for s, f, names, mu, cov, growth in sorted(problems, key=lambda p: (p[0], p[1])):
        rows = {r.ticker: r for r in got if (r.strategy, r.fold) == (s, f)}
        before = held.get(s, {})
        assert rows.keys() == set(names) | before.keys()
        for t, r in rows.items():
            assert np.isclose(r.pre_trade_weight, before.get(t, 0.0), atol=1e-12) and (t in names or r.weight == 0)
        w, prev = np.array([rows[t].weight for t in names]), np.array([before.get(t, 0.0) for t in names])
        assert np.isclose(w.sum(), 1) and (w >= rule.lower).all() and (w <= rule.upper).all()

        def cost(v):
            return rule.risk_aversion * v @ (cov + 1e-10 * np.eye(size)) @ v - mu @ v + rule.turnover_penalty * np.abs(v - prev).sum()

        # separable kinks: no exchange between two assets may gain anything
        for i in range(size):
            for j in range(size):
                for e in (1e-2, 1e-4, 1e-6):
                    v = w.copy()
                    v[i], v[j] = v[i] + e, v[j] - e
                    if i != j and v[i] <= rule.upper and v[j] >= rule.lower:
                        assert cost(v) >= cost(w) - 1e-12
        grown = w * np.array([1.0 if g is None else g for g in growth])
        held[s] = {t: x for t, x in zip(names, grown / grown.sum()) if x > 1e-12}


def test_weights_beat_a_grid(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3, 3)) * 0.2
    mu, cov, rule = rng.normal(0, 0.05, 3), a @ a.T, allocate.WeightRule(0.0, 0.6, 1.0, 0.01)
    got = allocate.allocate_weights(*problem_tables(spark, [("s", 0, ["A", "B", "C"], mu, cov, [1, 1, 1])]), rule)
    w = np.array([r.weight for r in got.orderBy("ticker").collect()])

    def cost(v):
        return v @ cov @ v - mu @ v + 0.01 * np.abs(v).sum()

    steps = np.linspace(0, 0.6, 61)
    grid = (np.array([x, y, 1 - x - y]) for x in steps for y in steps if -1e-9 <= 1 - x - y <= 0.6)
    assert cost(w) <= min(map(cost, grid)) + 1e-9


def test_weights_that_cannot_be_are_refused(spark):
    eye = np.eye(6).tolist()
    three = problem_tables(spark, [("s", 0, ["A", "B", "C"], [0, 0, 0], eye, [1, 1, 1])])
    with pytest.raises(Exception, match="infeasible weight bounds for a subset of 3"):
        allocate.allocate_weights(*three, allocate.WeightRule(0.0, 0.2)).collect()
    six = problem_tables(spark, [("s", 0, list("ABCDEF"), [0] * 6, eye, [1] * 6)])
    with pytest.raises(Exception, match="limited to subsets of 5"):
        allocate.allocate_weights(*six, allocate.WeightRule()).collect()
    with pytest.raises(ValueError, match="risk aversion"):
        allocate.allocate_weights(*three, allocate.WeightRule(risk_aversion=0.0))


def test_a_worthless_portfolio_keeps_its_targets(spark):
    cells = [("s", f, ["A", "B"], [0.0, 0.0], np.eye(2).tolist(), [0.0, 0.0]) for f in (0, 1)]
    cells.append(("s", 2, ["A", "C"], [float("nan"), 0.0], np.eye(2).tolist(), [1.0, 1.0]))
    got = allocate.allocate_weights(*problem_tables(spark, cells), allocate.WeightRule(turnover_penalty=0.0)).collect()
    want = [(0, "A", 0.5, 0.0), (0, "B", 0.5, 0.0), (1, "A", 0.5, 0.5), (1, "B", 0.5, 0.5), (2, "A", 0.5, 0.5), (2, "B", 0.0, 0.5), (2, "C", 0.5, 0.0)]
    assert sorted((r.fold, r.ticker, round(r.weight, 9), round(r.pre_trade_weight, 9)) for r in got) == want


def test_turnover_counts_sales_and_purchases(spark):
    weights = spark.createDataFrame(
        [("s", 0, "AAA", 0.6), ("s", 0, "BBB", 0.4), ("s", 2, "AAA", 0.3), ("s", 2, "CCC", 0.7)],
        "strategy string, fold int, ticker string, weight double",
    )
    drifted = weights.withColumn("drifted", F.col("weight"))
    traded = backtest.trades(weights, drifted, 10.0)
    got = {r.ticker: round(r.trade_weight, 9) for r in traded.where("fold = 2").collect()}
    assert got == {"AAA": -0.3, "BBB": -0.4, "CCC": 0.7}
    total = {r.fold: r for r in backtest.turnover(traded).collect()}
    assert np.isclose(total[2].turnover, 1.4) and np.isclose(total[2].transaction_cost, 0.0014)


def test_drift_follows_growth(spark):
    weights = spark.createDataFrame(
        [("s", 0, "AAA", 0.5), ("s", 0, "BBB", 0.5)],
        "strategy string, fold int, ticker string, weight double",
    )
    growth = weights.select("strategy", "fold", "ticker").withColumn(
        "growth", F.when(F.col("ticker") == "AAA", 1.1).otherwise(1.0)
    )
    got = {r.ticker: r.drifted for r in backtest.drift(weights, growth).collect()}
    assert np.isclose(sum(got.values()), 1) and got["AAA"] > 0.5


def test_holm_steps_down(spark):
    tests = spark.createDataFrame(
        [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "test string, p_value double"
    )
    got = {r.test: (r.p_value_holm, r.conclusion) for r in inference.holm_adjust(tests).collect()}
    assert np.isclose(got["a"][0], 0.03) and np.isclose(got["c"][0], 0.06) and np.isclose(got["b"][0], 0.06)
    assert got["a"][1] == "significant" and got["d"][1] == "insufficient_observations"


def test_short_series_have_no_interval(spark):
    series = spark.createDataFrame([("t", i, 0.1) for i in range(15)], "test string, pos int, x double")
    row = inference.paired_block_bootstrap(series, 1, 20, 10).first()
    assert np.isclose(row.mean_difference, 0.1) and row.p_value is None


def test_merge_prefers_the_primary_vendor_per_ticker(spark):
    a = panel(spark, {"AAA": [10, 11]}).withColumns({"source": F.lit("p"), "raw_checksum": F.lit("x")})
    b = panel(spark, {"AAA": [20, 21, 22], "BBB": [5, 6, 7]}).withColumns(
        {"source": F.lit("f"), "raw_checksum": F.lit("y")}
    )
    listing = spark.createDataFrame([("AAA", "a"), ("BBB", "b")], "symbol string, name string")
    out = merge.merge_sources(a, b, listing, "2022-01-04")
    rows = {(r.ticker, r.source) for r in out.prices.collect()}
    assert rows == {("AAA", "p"), ("BBB", "f")} and out.prices.count() == 5
    with pytest.raises(RuntimeError, match="target is 3"):
        merge.merge_sources(a, b, listing, "2022-01-04", target=3)


def test_ema_across_gaps_and_long_histories(spark):
    rng = np.random.default_rng(0)
    rows, frames = [], {}
    for ticker, n, holes in (("A", 6000, slice(3000, 5200)), ("B", 80, slice(10, 11)), ("C", 300, slice(0, 7))):
        x = 100 + np.cumsum(rng.normal(size=n))
        x[holes] = np.nan
        frames[ticker] = pd.Series(x)
        rows += [(ticker, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ticker string, date int, p double")
    got = with_emas(df, "p", {"e12": 12, "e26": 26}).orderBy("ticker", "date").toPandas()
    for ticker, part in got.groupby("ticker"):
        for name, span in (("e12", 12), ("e26", 26)):
            want = frames[ticker].ewm(span=span, adjust=False).mean()
            np.testing.assert_allclose(part[name].astype(float), want, rtol=1e-9)


def test_asof_breaks_ties_by_value_not_text(spark):
    left = spark.createDataFrame([("t", 5)], "k string, at int")
    right = spark.createDataFrame([("t", 3, 9, "nine"), ("t", 3, 10, "ten")], "k string, known int, version int, v string")
    assert asof.asof_join(left, right, "k", "at", "known", ["v"], "version").first().v == "ten"
    with pytest.raises(ValueError):
        asof.asof_join(left.withColumn("v", F.lit("x")), right, "k", "at", "known", ["v"], "version")


def test_every_source_is_checked_for_outliers(spark):
    rows = [("A", D(2022, 1, d), s, p) for s, ps in (("x", (10.0, 10.1, 20.0)), ("y", (10.0, 10.0, 10.0))) for d, p in enumerate(ps, 1)]
    df = spark.createDataFrame(rows, "ticker string, date date, source string, adjusted_close double")
    assert [(r.source, r.date.day) for r in quality.return_outliers(df).collect()] == [("x", 3)]


def test_ranks_keep_rows_without_a_value(spark):
    df = spark.createDataFrame([(1, i, None if i % 2 else float(i % 6)) for i in range(40)], "g int, i int, v double")
    got = {r.i: r.r for r in with_average_rank(df, ["g"], "v", "r").collect()}
    want = pd.Series([None if i % 2 else float(i % 6) for i in range(40)]).rank()
    assert got == {i: None if np.isnan(w) else w for i, w in want.items()}


def test_ranks_see_one_set_of_cuts(spark):
    """A sketch depends on the order in which its parts meet, so no plan may hold it twice."""
    n = 20_000
    value = (F.xxhash64("id") % 1_000_000_007).cast("double")
    df = spark.range(0, n, 1, 4).select((F.col("id") % 2).alias("g"), "id", value.alias("v"))
    ranked = with_average_rank(df, ["g"], "v", "r", pct=True, groups=2)
    assert "percentile_approx" not in ranked._jdf.queryExecution().executedPlan().toString()
    got = ranked.toPandas()
    want = got.groupby("g")["v"].rank(method="average") / got.groupby("g")["v"].transform("count")
    assert len(got) == n and (got["r"] == want).all()


def test_correlations_by_blocks(spark):
    """Pairwise complete over each fold's window, from one row a ticker instead of one a pair and date."""
    rng, n = np.random.default_rng(5), 40
    days = pd.date_range("2001-01-01", periods=n, freq="7D").date
    wide = pd.DataFrame(rng.normal(size=(n, 4)), columns=list("abcd"), index=days)
    wide["e"], wide["f"] = wide["a"], 0.1  # an equal series, and one without spread
    wide.loc[days[3:9], "b"] = np.nan
    wide.loc[days[2:], "d"] = np.nan
    long = [(t, d, None if np.isnan(v) else float(v)) for t in wide for d, v in wide[t].items() if t != "d" or d < days[2]]
    returns = spark.createDataFrame(long, "ticker string, date date, ret1 double")
    window = spark.createDataFrame([(f, d) for f, at in ((0, slice(0, 20)), (1, slice(5, 40))) for d in days[at]], "fold int, date date")
    chosen = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "d")], "fold int, ticker string")
    got = selection.correlation_to(returns, chosen, window, 40)
    assert "corr(" not in got._jdf.queryExecution().executedPlan().toString()
    got = {(r.fold, r.ticker, r.other): r["corr"] for r in got.collect()}
    want = {}
    for f, o, at in ((0, "a", slice(0, 20)), (0, "b", slice(0, 20)), (1, "b", slice(5, 40))):
        for t in "abcdef":
            if f == 0 or t != "d":
                c = wide[t].iloc[at].corr(wide[o].iloc[at], min_periods=2)
                want[f, t, o] = 0.0 if np.isnan(c) or t == "f" else c
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert all(got[f, "a", o] == got[f, "e", o] for f, o in ((0, "a"), (0, "b"), (1, "b")))


def test_expanding_median_by_bisection(spark):
    import random
    import statistics

    rng = random.Random(3)
    day = dt.date(2020, 1, 1)
    values = [None if rng.random() < 0.2 else rng.choice([1.0, 2.5, rng.random(), -rng.random()]) for _ in range(300)]
    rows = [(day + dt.timedelta(i), v, f"x{i}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "date date, v double, other string")
    got = {r.date: (r.m, r.v, r.other) for r in metrics.expanding_median(df, "v", "m").collect()}
    for i, (d, v, other) in enumerate(rows):
        seen = [x for x in values[: i + 1] if x is not None]
        assert got[d] == (statistics.median(seen) if seen else None, v, other)
    assert metrics.expanding_median(df.limit(0), "v", "m").collect() == []


def test_fold_counts_from_segments(spark):
    import random

    rng = random.Random(5)
    wf = folds.WalkForward(6, 2, 1)
    day = dt.date(2019, 1, 1)
    rows = list({(f"t{rng.randint(0, 5)}", day + dt.timedelta(rng.randint(0, 700))) for _ in range(150)})
    rows += [rows[0]] * 3 + [(None, rows[1][1]), ("t1", None)]
    df = spark.createDataFrame(rows, "ticker string, date date")
    made = folds.make_folds(df, wf)
    want = {
        (r.fold, r.role): (r.records, r.dates, r.tickers)
        for r in folds.assign_folds(df, made, wf).groupBy("fold", "role").agg(
            F.count(F.lit(1)).alias("records"), F.count_distinct("date").alias("dates"), F.count_distinct("ticker").alias("tickers")
        ).collect()
    }
    got = {(r.fold, r.role): (r.records, r.dates, r.tickers) for r in folds.fold_counts(df, made, wf).collect()}
    assert want and got == want


def test_batches_are_merged_by_part_and_retried_whole(spark, tmp_path):
    from pitpanel.streaming import ingest

    names = contracts.PRICES.fieldNames()

    def batch(*rows):  # (ticker, date, close, checksum)
        made = [{**dict.fromkeys(names), "ticker": t, "date": d, "close": c, "raw_checksum": k} for t, d, c, k in rows]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in made], contracts.PRICES)

    def state():
        return sorted((r.ticker, r.date, r.close) for r in ingest.ingested(spark, table).collect())

    table, a, b = str(tmp_path / "table"), dt.date(2020, 1, 2), dt.date(2021, 1, 4)
    assert ingest.ingested(spark, table).count() == 0
    ingest.merge_batch(batch(("A", a, 1.0, "x"), ("A", a, 9.0, "y"), ("A", b, 2.0, "x"), ("B", a, 3.0, "x")), table, 0)
    first = [("A", a, 1.0), ("A", b, 2.0), ("B", a, 3.0)]
    assert state() == first
    second = batch(("A", b, 5.0, "z"), ("C", b, 6.0, "z"))
    ingest.merge_batch(second, table, 1)
    want = sorted([("A", a, 1.0), ("A", b, 5.0), ("B", a, 3.0), ("C", b, 6.0)])
    assert state() == want
    # only parts of 2021 were written again
    assert {p.name for p in (tmp_path / "table/data/batch=1").glob("*/year=*")} == {"year=2021"}
    # a batch without its list is not seen, and its retry takes nothing twice
    (tmp_path / "table/manifest/batch=1/_SUCCESS").unlink()
    assert state() == first
    ingest.merge_batch(second, table, 1)
    assert state() == want


def test_ingest_leaves_no_second_copy_and_no_shuffle_files(spark, tmp_path, monkeypatch):
    from pitpanel import session
    from pitpanel.streaming import ingest

    stored, shuffle = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    monkeypatch.setattr(session, "store", lambda df, name="stage": stored.append(name) or df)
    monkeypatch.setattr(ingest, "store", session.store, raising=False)
    names, table, before = contracts.PRICES.fieldNames(), str(tmp_path / "table"), spark.conf.get(shuffle)
    day = dt.date(2020, 1, 2)
    for k in range(2):
        # the same keys again, and every bucket: parts of all steps are written into one batch
        rows = [{**dict.fromkeys(names), "ticker": f"t{i}", "date": day, "close": float(k), "raw_checksum": "x"} for i in range(40 + k)]
        ingest.merge_batch(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], contracts.PRICES), table, k)
        got = ingest.ingested(spark, table).collect()
        assert sorted((r.ticker, r.close) for r in got) == sorted((f"t{i}", float(k)) for i in range(40 + k))
    assert len({p.parent.name for p in (tmp_path / "table/data/batch=1").glob("bucket=*/year=*")}) > ingest.SLICES
    assert stored == [] and spark.conf.get(shuffle) == before
    assert all(".zstd." in p.name for p in (tmp_path / "table/data").rglob("*.parquet"))
    # an empty batch changes nothing
    ingest.merge_batch(spark.createDataFrame([], contracts.PRICES), table, 2)
    assert ingest.ingested(spark, table).count() == 41


def test_split_candidates_take_steps_by_cut_and_not_by_value():
    import time

    from pitpanel.operators import ranker

    def by_value(values, bins):
        value, count = np.unique(values, return_counts=True)
        middle = (value[:-1] + value[1:]) / 2
        if len(middle) <= bins - 1:
            return middle
        stride, seen = len(values) / bins, np.cumsum(count)
        out, target = [], stride
        for i in range(1, len(value)):
            if abs(seen[i - 1] - target) < abs(seen[i] - target):
                out.append(middle[i - 1])
                target += stride
        return np.array(out)

    rng = np.random.default_rng(2)
    for n in range(1, 300):
        for values in (rng.normal(size=n), rng.integers(0, 60, n).astype(float), np.round(rng.exponential(size=n), 1)):
            bins = int(rng.integers(1, 40))
            assert np.array_equal(ranker.cuts_of(values, bins), by_value(values, bins))
    values, took = rng.normal(size=100_000), []
    for cuts in (ranker.cuts_of, by_value):
        start = time.process_time()
        cuts(values, 32)
        took.append(time.process_time() - start)
    assert took[0] < took[1] / 3


def test_levels_do_not_ask_for_sorted_batches(spark):
    """A batch that reaches over two stored files has its days in two runs."""
    from pitpanel.operators import ranker

    rng = np.random.default_rng(4)
    rows = [(int(d), float(rng.normal()), [int(c) for c in rng.integers(0, 4, 2)]) for d in [*range(40), *range(40)]]
    lookup = {k: np.array([[0, 1, 2, 3, 3, 0]] * 2, np.uint8) for k in (0, 1)}
    able = {k: np.arange(ranker.BINS - 1) < np.array([3, 3])[:, None] for k in (0, 1)}
    sent = spark.sparkContext.broadcast((lookup, {0: [5, 25], 1: [15, 35]}, able))
    cfg = ranker.RankerConfig(trees=1, depth=1)
    empty = {k: (np.zeros((1, 1), int), np.zeros((1, 1), int), np.zeros((1, 2)), np.ones(1)) for k in (0, 1)}
    grown = spark.sparkContext.broadcast(empty)

    def splits(rows):
        df = spark.createDataFrame(rows, "day int, y double, codes array<int>").coalesce(1)
        return sorted(map(str, ranker.level_splits(df, sent, grown, 0, 0, cfg.depth, 2).collect()))

    got, want = splits(rows), splits(sorted(rows, key=lambda r: r[0]))
    assert len(want) == 2 and got == want

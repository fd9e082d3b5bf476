"""Registered queries: one callable per operator over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.operators import (
    asof, backtest, features, folds, inference, merge, metrics, quality, ranker, selection,
    subset, universe,
)
from pitpanel.operators import moments as mom
from pitpanel.plans.shape import shaped
from pitpanel.plans.shapes import SHAPES
from pitpanel.plans.walkforward import HEADLINE, STRATEGIES, ExperimentConfig, WalkForwardRun
from pitpanel.session import cut_lineage, shuffles_dropped
from pitpanel.sources import feeds, storage
from pitpanel.sources.panel import TradePanel
from pitpanel.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WALK = folds.WalkForward(24, 3, 1)
#: Weekly bars; the formula signal is asked for, since SQL cannot fit a ranker.
CONFIG = ExperimentConfig(walk=WALK, ranker=None, periods=52)
REACHES = "2001-10-15"
LISTED = "^SUPPLIER#[0-9]{8}[0-4]$"


def query(fn):
    """Register ``fn(panel)`` under its name, shaped by ``SHAPES``."""
    name = fn.__name__

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(TradePanel(spark, sf_dir))
        return shaped(out, SHAPES[name]) if name in SHAPES else out

    call.__name__ = name
    call.__doc__ = fn.__doc__
    QUERIES[name] = call
    return fn


def walk(p: TradePanel, cfg: ExperimentConfig = CONFIG, **kw) -> WalkForwardRun:
    return WalkForwardRun(p.priced(), cfg, calendar=p.calendar(), dates=p.weeks(), **kw)


# -- contract tables -------------------------------------------------------------


@query
def panel_prices(p):
    return p.prices()


@query
def panel_master(p):
    return p.master()


@query
def panel_financials(p):
    return p.financials()


@query
def panel_macro(p):
    return p.macro()


@query
def panel_foreign_flow(p):
    return p.foreign_flow()


@query
def panel_index_membership(p):
    return p.index_membership()


# -- features ----------------------------------------------------------------------


def _featured(p, *steps, ema=False):
    branches = any(s.market for s in steps)
    prices = p.stored_prices() if branches else p.prices()
    return features.with_features(prices, list(steps), p.weeks(), ema=ema)


@query
def flagship_features_latest(p):
    """Per ticker at its latest week: SMA ratio, volatility, beta, return, liquidity."""
    df = _featured(
        p, features.returns_step(), features.sma_step(), features.volatility_step(),
        features.beta_step(), features.liquidity_step(),
    )
    kept = ("sma_ratio_20", "volatility_20d", "beta_60d", "return_20d", "liquidity_20d")
    return df.groupBy("ticker").agg(
        F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in kept]
    )


@query
def feat_returns(p):
    return _featured(p, features.returns_step())


@query
def feat_sma_ema(p):
    return _featured(p, features.sma_step(), ema=True)


@query
def feat_rsi(p):
    return _featured(p, features.rsi_step())


@query
def feat_macd(p):
    """Averages alone, without the other features."""
    return features.with_price_emas(p.prices())


@query
def feat_atr(p):
    return _featured(p, features.atr_step())


@query
def feat_vol(p):
    return _featured(p, features.volatility_step())


@query
def feat_downside(p):
    return _featured(p, features.downside_step())


@query
def feat_drawdown(p):
    return _featured(p, features.drawdown_step())


@query
def feat_liquidity(p):
    return _featured(p, features.liquidity_step())


@query
def feat_beta(p):
    return _featured(p, features.beta_step())


@query
def feat_target_rank(p):
    rows = features.with_features(p.stored_prices(), [features.target_step()], p.weeks())
    return features.add_target_rank(rows, dates=p.weeks())


@query
def feat_all(p):
    """Every market feature, the label, its rank and the publication-time features."""
    return features.all_features(p.stored_prices(), p.financials(), p.macro(), p.weeks())


@query
def market_return(p):
    return features.market_returns(features.with_ret1(p.prices()))


# -- quality and leakage -------------------------------------------------------------


@query
def validate_issues(p):
    return quality.validation_issues(p.tape())


@query
def return_outliers(p):
    return quality.return_outliers(p.tape())


@query
def coverage_year(p):
    return quality.coverage_by_year(p.tape())


@query
def coverage_ticker(p):
    return quality.coverage_by_ticker(p.tape())


@query
def dataset_summary(p):
    return quality.dataset_summary(p.tape())


@query
def quarantine_rows(p):
    return quality.split_bad_bars(p.tape())[1]


def _side_tables(p):
    return {
        "index_membership": p.index_membership(),
        "corporate_actions": p.corporate_actions(),
        "financial_statements": p.financials().join(
            p.good_standing().withColumn("_good", F.lit(True)), "ticker", "left"
        ).withColumn("data_class", F.when(F.col("_good"), F.col("data_class")).otherwise("fixture")).drop("_good"),
        "macro": p.macro(),
    }


@query
def leakage_checks(p):
    return quality.leakage_checks(p.tape(), p.master(), _side_tables(p))


@query
def side_table_status(p):
    return quality.side_table_status(_side_tables(p), p.spark)


@query
def validation_verdict(p):
    """The quality report of the raw tape in one row."""
    return quality.validation_verdict(p.tape())


@query
def audit_verdict(p):
    """The leakage audit in one row."""
    return quality.audit_verdict(p.tape(), p.master(), _side_tables(p))


@query
def run_gate(p):
    """Whether a run may start in each mode, and why not."""
    audit = quality.audit_verdict(p.tape(), p.master(), _side_tables(p))
    return quality.gate_verdict(quality.validation_verdict(p.tape()), audit, ["demo", "research"])


@query
def fingerprint(p):
    columns = ["date", "ticker", "open", "high", "low", "close", "volume"]
    return quality.fingerprint(p.prices(), columns)


# -- imports and sinks -----------------------------------------------------------------


def _landed(p) -> str:
    """The panel as CSV lines in a landing folder; lines of some volumes have one fault each."""
    v = F.col("volume")
    day = F.when(v % 11 == 0, "2001-13-45").otherwise(F.date_format("date", "yyyy-MM-dd"))
    fields = [
        day, F.when(v % 13 == 0, "").otherwise(F.col("ticker")), F.col("open").cast("string"), F.col("high").cast("string"),
        F.when(v % 17 == 0, "n/a").otherwise(F.col("low").cast("string")), F.col("close").cast("string"), v.cast("string"),
    ]
    line = F.concat_ws(",", *fields)
    line = F.when(v % 19 == 0, F.concat(line, F.lit(",7"))).when(v % 23 == 0, F.concat_ws(",", *fields[:5])).otherwise(line)
    path = ingest.fresh_workspace(p.spark, "landing")
    # one column whose name is the header; no quoting, so that lines stay as they are
    lines = p.prices().select(line.alias("date,ticker,open,high,low,close,volume"))
    lines.write.option("header", True).option("sep", "\x01").option("quote", "\x00").csv(path)
    return path


@query
def import_prices_good(p):
    """Prices of landed CSV files whose lines can be read."""
    return storage.import_prices_checked(p.spark, _landed(p), "tape", "landing")[0].withColumn(
        "has_checksum", F.length("raw_checksum") == 64
    )


@query
def import_prices_rejected(p):
    """Lines of landed CSV files that cannot be read, with the reasons."""
    rejected = storage.import_prices_checked(p.spark, _landed(p), "tape", "landing")[1]
    return rejected.withColumn("reasons", F.array_join("reasons", "|"))


@query
def import_financials(p):
    """Statements landed as CSV and as parquet, imported by suffix; an unreadable date is NULL."""
    rows = p.financials()
    late = F.when(F.day("publication_date") % 3 == 0, "soon").otherwise(F.date_format("available_at", "yyyy-MM-dd"))
    text, typed = (f"{ingest.fresh_workspace(p.spark, 'statements')}.{kind}" for kind in ("csv", "parquet"))
    storage.write_table(rows.withColumn("available_at", late), text, "csv")
    storage.write_table(rows, typed)
    parts = [
        storage.import_side_table(p.spark, path, "financial_statements").withColumn("landed_as", F.lit(kind))
        for kind, path in (("csv", text), ("parquet", typed))
    ]
    return parts[0].unionByName(parts[1])


@query
def artifact_csv(p):
    """The fold manifest written as CSV and read back with its types."""
    made = folds.make_folds(p.calendar(), WALK)
    path = ingest.fresh_workspace(p.spark, "manifest")
    storage.write_table(made, path, "csv")
    return storage.read_artifact(p.spark, path, made.schema, "csv")


@query
def artifact_parquet(p):
    """Coverage written as parquet by year and read back."""
    rows = quality.coverage_by_year(p.tape())
    path = ingest.fresh_workspace(p.spark, "coverage")
    storage.write_table(rows, path, partition_by=["year"])
    return storage.read_artifact(p.spark, path, rows.schema)


# -- universe and as-of -------------------------------------------------------------


@query
def universe_monthly(p):
    return universe.build_universe(p.bars(), p.master(), months=p.weeks())


@query
def month_end_closes(p):
    return universe.month_end_closes(p.bars())


@query
def fundamental_ratios(p):
    return features.fundamental_ratios(p.financials())


@query
def asof_financials(p):
    return asof.asof_join(
        p.prices().select("ticker", "date", "close"),
        features.fundamental_ratios(p.financials()),
        "ticker", "date", "available_at",
        ["roe_pit", "revenue_growth_yoy_pit"], "fiscal_period_end",
    )


@query
def asof_macro(p):
    policy = features.policy_series(p.macro()).withColumnRenamed("value", "policy_rate_pit")
    return asof.asof_on_dates(
        p.prices().select("ticker", "date", "close"), policy, "date", "available_at",
        ["policy_rate_pit"], "series_id", p.weeks(),
    )


# -- ingest ----------------------------------------------------------------------------


@query
def norm_feed_a(p):
    return feeds.normalize_feed_a(p.payload_a(), "table://lineitem/a")


@query
def norm_feed_b(p):
    return feeds.normalize_feed_b(p.payload_b(), "table://lineitem/b")


@query
def norm_feed_c(p):
    return feeds.normalize_feed_c(p.payload_c(), "table://lineitem/c")


@query
def norm_feed_d(p):
    return feeds.normalize_feed_d(p.payload_d(), "table://lineitem/d")


@query
def norm_macro(p):
    return feeds.normalize_macro(p.payload_macro())


@query
def listing_filter(p):
    return feeds.filter_listing(p.repeated_listing(), pattern=LISTED)


@query
def listing_first(p):
    """The head of the listing; the limit is the feature."""
    return feeds.filter_listing(p.repeated_listing(), pattern=LISTED, first=7)


@query
def listing_requested(p):
    """Requested symbols in the requested order, unknown ones left out."""
    asked = ["supplier#000000003 ", "SUPPLIER#000000001", "nobody", "SUPPLIER#000000003", "SUPPLIER#000000009"]
    return feeds.filter_listing(p.repeated_listing(), pattern=LISTED, requested=asked)


def _merged(p) -> merge.Merged:
    return merge.merge_sources(p.primary_feed(), p.fallback_feed(), p.listing(), REACHES)


@query
def merge_sources(p):
    return _merged(p).prices


@query
def merge_quarantine(p):
    return _merged(p).quarantine


@query
def merged_master(p):
    return _merged(p).master


@query
def crosscheck(p):
    return merge.crosscheck(p.primary_feed(), p.fallback_feed())


@query
def source_counts(p):
    return _merged(p).source_counts


@query
def candidates_topn(p):
    stats = merge.source_stats(p.primary_feed(), p.fallback_feed())
    return merge.require_candidates(merge.top_candidates(stats, REACHES, 10), 10)


@query
def fresh_tickers(p):
    end = p.table("lineitem").agg(F.max(F.col("l_shipdate").cast("date")).alias("d")).scalar()
    return storage.fresh_tickers(p.bars(F.col("final")), end, 10)


@query
def stale_rows(p):
    """Open-fill bars still needed: their ticker's stored bars end too early."""
    end = p.table("lineitem").agg(F.max(F.col("l_shipdate").cast("date")).alias("d")).scalar()
    stored = p.bars(F.col("final"))
    fresh = storage.fresh_tickers(stored, end, 10).select("ticker")
    return p.bars(~F.col("final")).join(fresh, "ticker", "left_anti")


@query
def run_ledger(p):
    return storage.run_ledger(p.primary_feed(), "feed_d", p.listing().withColumnRenamed("symbol", "ticker"))


@query
def incremental_ingest(p):
    """Land two vendors' files, ingest as a stream twice, read the panel back."""
    root = ingest.fresh_workspace(p.spark, "ingest")
    for name, feed in (("first", p.fallback_feed()), ("second", p.primary_feed())):
        with shuffles_dropped(p.spark):
            feed.write.mode("append").option("compression", ingest.CODEC).parquet(f"{root}/landing/{name}")
        ingest.ingest_once(p.spark, f"{root}/landing/*", f"{root}/table", f"{root}/state")
    return ingest.ingested(p.spark, f"{root}/table")


# -- folds -------------------------------------------------------------------------------


@query
def fold_manifest(p):
    return folds.make_folds(p.calendar(), WALK)


@query
def fold_manifest_last12(p):
    """The fold limit is the feature here."""
    return folds.make_folds(p.calendar(), folds.WalkForward(24, 3, 1, max_folds=12))


@query
def fold_counts(p):
    made = folds.make_folds(p.calendar(), WALK)
    return folds.fold_counts(p.prices().select("ticker", "date"), made, WALK)


@query
def snapshots(p):
    return walk(p).snapshot


# -- selection ------------------------------------------------------------------------------


@query
def base_scores(p):
    run = walk(p)
    return selection.base_scores(run.snapshot, CONFIG.reduction, run.cfg.walk.fold_bound)


@query
def adaptive_selection(p):
    return walk(p).selected


@query
def selection_trace(p):
    return walk(p).selected.where("selected_candidate").withColumn("round", F.col("pick") + 1)


@query
def topm_liquidity(p):
    return selection.top_by(walk(p).snapshot, "liquidity_20d", CONFIG.reduction.candidate_size)


@query
def topm_signal(p):
    return selection.top_by(walk(p).snapshot, "signal", CONFIG.reduction.candidate_size)


@query
def topm_ewma(p):
    run = walk(p)
    return selection.top_by(run.ewma_scores(), "score", CONFIG.reduction.candidate_size)


@query
def corr_to_chosen(p):
    """Correlation of every ticker with each ticker that the greedy reduction chose in the fold."""
    run = walk(p)
    chosen = run.selected.where("selected_candidate").select("fold", "ticker")
    window = run.window(CONFIG.reduction.lookback)
    return selection.correlation_to(run.history, chosen, window, run.cfg.walk.fold_bound)


# -- moments and subsets -----------------------------------------------------------------------


@query
def ewma_mean(p):
    run = walk(p)
    return mom.ewma_moments(run.rows_of(run.pools), CONFIG.span, CONFIG.horizon).where("i = j")


@query
def ewma_cov(p):
    run = walk(p)
    return mom.ewma_moments(run.rows_of(run.pools), CONFIG.span, CONFIG.horizon)


@query
def shrunk_cov(p):
    run = walk(p)
    return mom.shrunk_moments(run.rows_of(run.pools), CONFIG.horizon)


@query
def selection_matrix(p):
    return walk(p).moments


@query
def subset_energies(p):
    return subset.enumerate_subsets(walk(p).instances)


@query
def best_subset(p):
    return walk(p).best


@query
def subset_random_search(p):
    return subset.random_search(walk(p).instances, CONFIG.seeds[0], CONFIG.shots)


@query
def subset_gap(p):
    return walk(p).subset_runs()


@query
def method_comparison(p):
    return subset.compare_methods(walk(p).subset_runs())


@query
def instances_json(p):
    """Nested problem documents written as JSON and read back."""
    run = walk(p)
    docs = storage.nested_instances(run.moments, run.pools, run.decisions, CONFIG.reduction.cardinality)
    path = ingest.fresh_workspace(p.spark, "instances")
    storage.write_table(docs, path, "json")
    back = storage.read_artifact(p.spark, path, docs.schema, "json")
    return back.select(
        "strategy", "fold", "decision_time", "cardinality",
        F.array_join("tickers", "|").alias("tickers"),
        F.aggregate("expected_return", F.lit(0.0), lambda a, x: a + x).alias("mu_sum"),
        F.aggregate(F.flatten("covariance"), F.lit(0.0), lambda a, x: a + x).alias("cov_sum"),
        F.aggregate(F.flatten("selection_matrix"), F.lit(0.0), lambda a, x: a + x).alias("q_sum"),
    )


# -- backtest ------------------------------------------------------------------------------------


@query
def turnover_equal(p):
    return walk(p).equal.turnover


@query
def trades_equal(p):
    return walk(p).equal.trades


@query
def drift_equal(p):
    return walk(p).equal.drifted


@query
def backtest_equal(p):
    return walk(p).equal.returns


@query
def ablation_equal(p):
    run = walk(p)
    return run.ablation(run.equal)


@query
def ablation_summary_equal(p):
    run = walk(p)
    return metrics.ablation_summary(run.ablation(run.equal))


@query
def cardinality_cost_grid(p):
    return walk(p).sensitivity()


@query
def sensitivity_summary(p):
    return metrics.sensitivity_summary(walk(p).sensitivity(), ["cardinality", "transaction_cost_bps"])


@query
def allocate_weights(p):
    return walk(p).weights_optimised


@query
def fold_status(p):
    """How far every requested fold of every strategy came."""
    return walk(p).fold_status


@query
def run_summary(p):
    """Folds requested and completed."""
    return walk(p).run_summary()


@query
def ablation_summary(p):
    run = walk(p)
    return metrics.ablation_summary(run.ablation(run.optimised))


@query
def backtest_optimised(p):
    return walk(p).portfolio


# -- evaluation -------------------------------------------------------------------------------------


@query
def sensitivity_by_cost(p):
    """The grid's other grouping: over all cardinalities of a cost level."""
    return metrics.sensitivity_summary(walk(p).sensitivity(), ["transaction_cost_bps"])


@query
def performance_metrics(p):
    run = walk(p)
    return metrics.performance_metrics(
        run.equal.returns, ["strategy"], CONFIG.risk_free, ["date", "fold"], periods=CONFIG.periods
    )


@query
def market_metrics(p):
    """Metrics of an equal holding in each sector's tickers, over the whole panel."""
    rets = features.with_ret1(p.prices()).select("ticker", "date", "ret1")
    sectors = p.master().select("ticker", "sector")
    daily = rets.join(sectors, "ticker").groupBy("sector", "date").agg(F.avg("ret1").alias("ret"))
    return metrics.performance_metrics(daily, ["sector"], CONFIG.risk_free, periods=CONFIG.periods)


@query
def wealth_curve(p):
    return metrics.wealth_curve(walk(p).equal.returns, ["strategy"], ["date", "fold"])


@query
def returns_pivot(p):
    return metrics.returns_wide(walk(p).equal.returns, [n for n, _, _ in STRATEGIES])


@query
def regimes(p):
    return metrics.market_regimes(features.market_returns(features.with_ret1(p.prices())))


@query
def metrics_by_regime(p):
    run = walk(p)
    return metrics.metrics_by_regime(
        cut_lineage(run.equal.returns), run.regimes(), CONFIG.risk_free, p.weeks(), CONFIG.periods
    )


@query
def paired_bootstrap(p):
    run = walk(p)
    others = [n for n, _, _ in STRATEGIES if n != HEADLINE]
    diffs = inference.paired_differences(cut_lineage(run.equal.returns), HEADLINE, others)
    return inference.paired_block_bootstrap(diffs, CONFIG.seed)


@query
def sharpe_ci(p):
    return inference.sharpe_interval(
        cut_lineage(walk(p).equal.returns), CONFIG.risk_free, CONFIG.seed, periods=CONFIG.periods
    )


@query
def holm(p):
    run = walk(p)
    return run.statistical_tests(cut_lineage(run.equal.returns))


@query
def sector_bootstrap(p):
    """Each sector's equal holding against the market: paired bootstrap and Holm."""
    rets = cut_lineage(features.with_ret1(p.prices()).select("ticker", "date", "ret1"))
    sectors = p.master().select("ticker", F.col("sector").alias("strategy"))
    held = rets.join(sectors, "ticker").groupBy("strategy", "date").agg(F.avg("ret1").alias("ret"))
    whole = features.market_returns(rets, "ret").withColumn("strategy", F.lit("market"))
    both = held.unionByName(whole.select("strategy", "date", "ret"))
    diffs = cut_lineage(inference.paired_differences(both, "market"))
    return inference.holm_adjust(inference.paired_block_bootstrap(diffs, CONFIG.seed))


# -- ranker ---------------------------------------------------------------------------------------------


def _labelled(p):
    run = walk(p)
    rows = features.market_features(run.prices, p.weeks(), run.market)
    snap = run.at_decisions(
        rows.withColumn("signal", selection.linear_signal()), ["date", "signal", "target_return_20d"]
    )
    return features.add_target_rank(snap, dates=WALK.fold_bound)


@query
def rank_ic(p):
    return ranker.rank_ic(_labelled(p), WALK.fold_bound)


@query
def rank_ic_summary(p):
    return metrics.rank_ic_summary(ranker.rank_ic(_labelled(p), WALK.fold_bound))


@query
def ranker_scores(p):
    """Boosted-tree signals of all folds, fitted per fold on its training rows."""
    cfg = ExperimentConfig(walk=WALK, periods=52)
    run = walk(p, cfg, financials=p.financials(), macro=p.macro())
    return run.snapshot

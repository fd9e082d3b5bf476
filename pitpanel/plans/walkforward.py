"""The walk-forward experiment: folds, selection, subsets, backtest, evaluation.

Every stage is a lazy DataFrame for all folds and strategies together. Tables
that several stages read (slim returns, snapshots, pools, moments, weights) are
cut to reliable storage once, so the tape is not read again per stage.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel import contracts
from pitpanel.operators import allocate, backtest, decision_features, features, folds, inference, metrics
from pitpanel.operators import moments, quality, ranker, selection, subset
from pitpanel.session import cut_lineage, dim, store

#: Strategy, its candidate selector, and whether trading costs are charged.
STRATEGIES = [
    ("liquidity", "liquidity", False),
    ("ewma", "ewma", False),
    ("signal", "signal", False),
    ("adaptive", "adaptive", False),
    ("adaptive_costed", "adaptive", True),
]
HEADLINE = "adaptive_costed"
#: What a ticker's history keeps beside the inputs of features.
KEPT = ["close", "ret1"]


@dataclass(frozen=True)
class ExperimentConfig:
    walk: folds.WalkForward = field(default_factory=folds.WalkForward)
    reduction: selection.Reduction = field(default_factory=selection.Reduction)
    weights: allocate.WeightRule = field(default_factory=allocate.WeightRule)
    #: None takes ``selection.linear_signal`` instead of a fitted model
    ranker: ranker.RankerConfig | None = field(default_factory=ranker.RankerConfig)
    subset_risk_aversion: float = 0.55
    covariance: str = "ewma"
    span: int = 60
    horizon: int = 20
    history: int = 252
    seeds: tuple[int, ...] = (11, 23, 47)
    shots: int = 1024
    cost_bps: float = 10.0
    risk_free: float = 0.03
    periods: int = 252
    seed: int = 42
    use_universe: bool = False


class WalkForwardRun:
    """One experiment over contract prices.

    ``dates`` bounds the number of panel dates, and so of folds, which start a month apart
    (broadcast decisions only).
    """

    def __init__(
        self,
        prices: DataFrame,
        cfg: ExperimentConfig | None = None,
        calendar: DataFrame | None = None,
        financials: DataFrame | None = None,
        macro: DataFrame | None = None,
        universe: DataFrame | None = None,
        dates: int | None = None,
    ):
        cfg = cfg or ExperimentConfig()
        self.cfg = replace(cfg, walk=replace(cfg.walk, folds_at_most=dates))
        self.given = prices
        self.calendar = calendar if calendar is not None else prices.select("date").distinct()
        self.financials, self.macro, self.universe = financials, macro, universe
        self.dates = dates

    # -- inputs -----------------------------------------------------------

    @property
    def pool_rows(self) -> int | None:
        bound = self.cfg.walk.fold_bound
        return None if bound is None else len(STRATEGIES) * bound * self.cfg.reduction.candidate_size

    @cached_property
    def history(self) -> DataFrame:
        """One row of arrays per ticker, stored: the one shuffle of the panel by ticker."""
        return store(decision_features.histories(features.with_ret1(self.given), *KEPT), "history")

    @cached_property
    def prices(self) -> DataFrame:
        return decision_features.unrolled(self.history, *decision_features.INPUTS, "close")

    @cached_property
    def returns(self) -> DataFrame:
        return decision_features.unrolled(self.history, "ret1")

    @cached_property
    def pool_returns(self) -> DataFrame:
        """Returns of the tickers of any pool, which are folds x strategies x pool size at most."""
        asked = dim(self.pools.select("ticker").distinct(), self.pool_rows, 32)
        return cut_lineage(decision_features.unrolled(self.history.join(asked, "ticker", "left_semi"), "ret1"))

    @cached_property
    def market(self) -> DataFrame:
        return features.market_returns(self.returns)

    @cached_property
    def folds(self) -> DataFrame:
        return cut_lineage(folds.make_folds(self.calendar, self.cfg.walk))

    @cached_property
    def decisions(self) -> DataFrame:
        return cut_lineage(folds.decision_dates(self.folds, self.calendar))

    def window(self, n: int) -> DataFrame:
        return folds.recent_dates(self.decisions, self.calendar, n)

    @cached_property
    def features(self) -> DataFrame:
        return features.all_features(self.prices, self.financials, self.macro, self.dates, self.market)

    @cached_property
    def snapshot(self) -> DataFrame:
        """Decision-date rows with every market feature and a signal."""
        if self.cfg.ranker is None:
            asked = self.decisions.select(F.col("decision_time").alias("date"))
            rows = decision_features.market_features_of(self.history, asked, self.market)
            return self.at_decisions(
                rows.withColumn("signal", selection.linear_signal()),
                ["signal", "liquidity_20d", "volatility_20d"],
            )
        stored = store(self.features, "features")
        snap = self.at_decisions(stored)
        return ranker.rank_assets(
            stored, snap, self.folds, self.cfg.ranker, minimum=self.cfg.reduction.candidate_size, bound=self.cfg.walk.fold_bound
        ).select(
            "fold", "decision_time", "ticker", "signal", "target_rank", "liquidity_20d",
            "volatility_20d",
        )

    def at_decisions(self, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Snapshot rows of folds with enough tickers, within the universe if asked.

        The snapshot is cut before its rows are counted, so the features behind it
        are computed once.
        """
        snap = folds.snapshots(rows, self.decisions, contracts.MARKET_FEATURES, self.cfg.walk)
        if columns is not None:
            snap = snap.select("fold", "decision_time", "ticker", *columns)
        if self.cfg.use_universe and self.universe is not None:
            month = self.decisions.select("fold", F.col("test_start").alias("decision_time"))
            listed = self.universe.join(
                dim(month, self.cfg.walk.fold_bound, 16), "decision_time"
            ).select("fold", "ticker")
            snap = snap.join(listed, ["fold", "ticker"], "left_semi")
        snap = cut_lineage(snap)
        self.snapshot_sizes = snap.groupBy("fold").agg(F.count(F.lit(1)).alias("tickers"))
        enough = self.snapshot_sizes.where(F.col("tickers") >= self.cfg.reduction.candidate_size)
        return snap.join(dim(enough.select("fold"), self.cfg.walk.fold_bound, 16), "fold", "left_semi")

    # -- candidates ---------------------------------------------------------

    @cached_property
    def selected(self) -> DataFrame:
        return selection.adaptive_reduce(
            self.snapshot,
            self.history,
            self.window(self.cfg.reduction.lookback),
            self.cfg.reduction,
            self.cfg.walk,
        )

    def ewma_scores(self) -> DataFrame:
        scores = selection.ewma_scores(
            self.history, self.window(self.cfg.history), self.cfg.span, self.cfg.walk.fold_bound
        )
        return scores.join(self.snapshot.select("fold", "ticker"), ["fold", "ticker"], "left_semi")

    def pool(self, selector: str) -> DataFrame:
        """(fold, idx, ticker): up to candidate_size tickers in preference order."""
        m = self.cfg.reduction.rounds if selector == "adaptive" else self.cfg.reduction.candidate_size
        if selector == "adaptive":
            kept = self.selected.where("selected_candidate")
            return selection.top_by(kept, "base_score", m).select("fold", "idx", "ticker")
        if selector == "ewma":
            return selection.top_by(self.ewma_scores(), "score", m).select("fold", "idx", "ticker")
        column = {"liquidity": "liquidity_20d", "signal": "signal"}[selector]
        return selection.top_by(self.snapshot, column, m).select("fold", "idx", "ticker")

    def pools_of(self, names: list[str] | None = None) -> DataFrame:
        parts = []
        for name, selector, _ in STRATEGIES:
            if names is None or name in names:
                parts.append(self.pool(selector).select(F.lit(name).alias("strategy"), "fold", "idx", "ticker"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def pools(self) -> DataFrame:
        return cut_lineage(self.pools_of())

    # -- subsets --------------------------------------------------------------

    def rows_of(self, pools: DataFrame) -> DataFrame:
        return moments.complete_rows(
            pools, self.pool_returns, self.decisions, self.cfg.history, self.pool_rows
        )

    def moments_of(self, pools: DataFrame) -> DataFrame:
        c = self.cfg
        est = moments.estimate_moments(self.rows_of(pools), c.covariance, c.span, c.horizon)
        return moments.selection_matrix(est, c.subset_risk_aversion)

    @cached_property
    def moments(self) -> DataFrame:
        return cut_lineage(self.moments_of(self.pools))

    @cached_property
    def instances(self) -> DataFrame:
        return subset.instances(self.moments, self.cfg.reduction.cardinality)

    @cached_property
    def best(self) -> DataFrame:
        return cut_lineage(subset.best_subset(self.instances))

    def subset_runs(self) -> DataFrame:
        return subset.subset_runs(self.instances, list(self.cfg.seeds), self.cfg.shots)

    @cached_property
    def chosen(self) -> DataFrame:
        return subset.chosen_tickers(self.best, self.pools)

    # -- weights and backtest ----------------------------------------------------

    def cost(self):
        charged = [n for n, _, costed in STRATEGIES if costed]
        return F.when(F.col("strategy").isin(charged), self.cfg.cost_bps).otherwise(0.0)

    @cached_property
    def test_dates(self) -> DataFrame:
        """(fold, test_dates) of folds whose test window has panel dates."""
        days = folds.fold_dates(self.folds).where("role = 'test'")
        return self.calendar.join(days, "date").groupBy("fold").agg(F.count(F.lit(1)).alias("test_dates"))

    @cached_property
    def test_chosen(self) -> DataFrame:
        """Chosen tickers of folds whose test window has panel dates."""
        return cut_lineage(self.chosen.join(self.test_dates, "fold", "left_semi"))

    @cached_property
    def weights_equal(self) -> DataFrame:
        return backtest.equal_weights(self.test_chosen)

    @cached_property
    def weights_optimised(self) -> DataFrame:
        """(strategy, fold, ticker, weight, pre_trade_weight), folds in order."""
        growth = backtest.holding_growth(
            backtest.holdings(self.weights_equal, self.pool_returns, self.folds, self.pool_rows)
        )
        return cut_lineage(
            allocate.allocate_weights(self.test_chosen, self.moments, growth, self.cfg.weights)
        )

    def backtest_of(self, weights: DataFrame, cost=None) -> backtest.Backtest:
        charge = self.cost() if cost is None else cost
        return backtest.backtest(weights, self.pool_returns, self.folds, charge, self.pool_rows)

    @cached_property
    def equal(self) -> backtest.Backtest:
        return self.backtest_of(self.weights_equal)

    @cached_property
    def optimised(self) -> backtest.Backtest:
        held = self.weights_optimised.where("weight <> 0").select(
            "strategy", "fold", "ticker", "weight"
        )
        return self.backtest_of(held)

    @cached_property
    def portfolio(self) -> DataFrame:
        """Returns of every optimised strategy and of the equal-weight comparator."""
        peer = self.weights_equal.where(F.col("strategy") == HEADLINE).withColumn(
            "strategy", F.lit("equal_weight_selected")
        )
        base = self.backtest_of(peer, 0.0).returns
        return cut_lineage(self.optimised.returns.unionByName(base))

    # -- what became of every fold ------------------------------------------------

    @cached_property
    def fold_status(self) -> DataFrame:
        """One row per requested (strategy, fold): how far it came, and why it stopped there.

        Everything is a left join from the list of folds, so no fold can vanish. The tables joined
        hold a row per fold or problem.
        """
        m = self.cfg.reduction.candidate_size
        names = F.explode(F.array(*[F.lit(n) for n, _, _ in STRATEGIES])).alias("strategy")
        ranked = self.snapshot.select("fold").distinct().withColumn("_ranked", F.lit(True))
        pools = self.pools.groupBy("strategy", "fold").agg(F.count(F.lit(1)).alias("candidates"))
        solved = self.moments.select("strategy", "fold").distinct().withColumn("_solved", F.lit(True))
        out = (
            self.folds.select("fold", "test_start", names)
            .join(self.decisions.select("fold", "decision_time"), "fold", "left")
            .join(self.snapshot_sizes, "fold", "left")
            .join(ranked, "fold", "left")
            .join(self.test_dates, "fold", "left")
            .join(pools, ["strategy", "fold"], "left")
            .join(solved, ["strategy", "fold"], "left")
        )
        stage = (
            F.when(F.col("decision_time").isNull(), "no_decision_date")
            .when(F.coalesce("tickers", F.lit(0)) < m, "too_few_tickers")
            .when(F.col("_ranked").isNull(), "no_training_rows")
            .when(F.col("candidates").isNull(), "no_candidates")
            .when(F.col("_solved").isNull(), "too_few_complete_rows")
            .when(F.col("test_dates").isNull(), "no_test_dates")
            .otherwise("completed")
        )
        counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tickers", "candidates", "test_dates")]
        return out.select("strategy", "fold", "test_start", "decision_time", *counts, stage.alias("stage"))

    def run_summary(self) -> DataFrame:
        """(strategy, folds_requested, folds_completed, stopped): counts of the run's folds."""
        done = F.col("stage") == "completed"
        stopped = F.array_join(F.array_sort(F.collect_set(F.when(~done, F.col("stage")))), "|")
        return self.fold_status.groupBy("strategy").agg(
            F.count(F.lit(1)).alias("folds_requested"), F.count_if(done).alias("folds_completed"), stopped.alias("stopped")
        )

    # -- evaluation -------------------------------------------------------------

    def ablation(self, bt: backtest.Backtest) -> DataFrame:
        """One row per (strategy, fold): subset, objective, gap, turnover, cost, return."""
        names = self.test_chosen.groupBy("strategy", "fold").agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("idx", "ticker"))), lambda s: s["ticker"]), "|"
            ).alias("selected_tickers")
        )
        gross = bt.returns.groupBy("strategy", "fold").agg(
            (F.product(1 + F.col("ret")) - 1).alias("net_return")
        )
        spec = self.given.sparkSession.createDataFrame(
            [(n, s) for n, s, _ in STRATEGIES], "strategy string, selector string"
        )
        return (
            names.join(self.best.select("strategy", "fold", F.col("energy").alias("objective")), ["strategy", "fold"])
            .join(bt.turnover, ["strategy", "fold"], "left")
            .join(gross, ["strategy", "fold"], "left")
            .join(F.broadcast(spec), "strategy")
            .select(
                "fold",
                F.col("strategy").alias("configuration"),
                "selector",
                F.lit("exact").alias("solver"),
                "selected_tickers",
                "objective",
                F.lit(0.0).alias("optimality_gap"),
                F.lit(1.0).alias("feasibility_rate"),
                "turnover",
                "transaction_cost",
                "net_return",
                F.lit(self.cfg.covariance).alias("covariance_method"),
            )
        )

    def sensitivity(self, bps: list[float] | None = None, strategy: str = "adaptive") -> DataFrame:
        """Cardinality {k-1, k} x cost levels, equal weights, all folds."""
        k = self.cfg.reduction.cardinality
        levels = bps or sorted({0.0, self.cfg.cost_bps, 25.0})
        pool = self.pools.where(F.col("strategy") == strategy)
        matrix = self.moments.where(F.col("strategy") == strategy)
        parts = []
        for size in sorted({max(1, k - 1), k}):
            best = subset.best_subset(subset.instances(matrix, size))
            hit = subset.chosen_tickers(best, pool)
            bt = self.backtest_of(backtest.equal_weights(hit), 0.0)
            grid = backtest.cardinality_cost_grid(bt.returns, bt.turnover, levels)
            parts.append(grid.withColumn("cardinality", F.lit(size)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def regimes(self) -> DataFrame:
        return metrics.market_regimes(self.market)

    def statistical_tests(self, returns: DataFrame) -> DataFrame:
        others = [n for n, _, _ in STRATEGIES if n != HEADLINE]
        diffs = inference.paired_differences(returns, HEADLINE, others)
        return inference.holm_adjust(inference.paired_block_bootstrap(diffs, self.cfg.seed))

    def metrics(self, returns: DataFrame) -> DataFrame:
        table = metrics.performance_metrics(
            returns, ["strategy"], self.cfg.risk_free, ["date", "fold"], periods=self.cfg.periods
        )
        ci = inference.sharpe_interval(returns, self.cfg.risk_free, self.cfg.seed, periods=self.cfg.periods)
        return table.join(ci, "strategy", "left")


def run_experiment(
    prices: DataFrame,
    master: DataFrame,
    side_tables: dict[str, DataFrame | None],
    cfg: ExperimentConfig | None = None,
    mode: str = "research",
    dates: int | None = None,
) -> dict[str, DataFrame]:
    """Gates, then every table of the experiment by name. Prices are stored once for all branches."""
    prices = store(prices, "prices")
    report = quality.validate_panel(prices)
    audit = quality.leakage_audit(prices, master, side_tables)
    quality.run_gate(report, audit, mode)
    run = WalkForwardRun(
        prices,
        cfg,
        financials=side_tables.get("financial_statements"),
        macro=side_tables.get("macro"),
        dates=dates,
    )
    returns = run.portfolio
    bt = run.optimised
    regimes = run.regimes()
    out = {
        "fold_manifest": run.folds,
        "fold_status": run.fold_status,
        "run_summary": run.run_summary(),
        "rankings": run.snapshot,
        "selected_universe": run.selected,
        "moments": run.moments,
        "subset_runs": run.subset_runs(),
        "comparisons": subset.compare_methods(run.subset_runs()),
        "weights": run.weights_optimised,
        "trades": bt.trades,
        "portfolio_returns": returns,
        "metrics": run.metrics(returns),
        "regimes": regimes,
        "regime_metrics": metrics.metrics_by_regime(returns, regimes, run.cfg.risk_free, dates, run.cfg.periods),
        "ablations": run.ablation(bt),
        "sensitivity": run.sensitivity(),
        "statistical_tests": run.statistical_tests(returns),
    }
    if run.cfg.ranker is not None:
        out["rank_ic"] = ranker.rank_ic(run.snapshot, run.cfg.walk.fold_bound)
    return out

"""Columns and rounding of each registered query, see ``shape``."""

_BAR = "open:8 high:8 low:8 close:8 adjusted_close:8 volume:i trading_value:7"
_METRICS = (
    "cumulative_return:s annualized_return:s annualized_volatility:8 sharpe:s sortino:s "
    "max_drawdown:8 calmar:s positive_day_ratio:8 observations:i"
)

SHAPES = {
    "panel_prices": f"date:d ticker {_BAR} source available_at:d data_class",
    "panel_master": "ticker company_name exchange industry sector listing_date:d delisting_date:d "
    "effective_from:d effective_to:d available_at:d source data_class",
    "panel_financials": "ticker fiscal_period_end:d publication_date:d available_at:d revenue:4 "
    "net_income:4 total_assets:4 equity:4 source data_class",
    "panel_macro": "series_id observation_date:d release_date:d available_at:d value:8 source data_class",
    "panel_foreign_flow": "date:d ticker available_at:d foreign_net_value:2 source data_class",
    "panel_index_membership": "ticker index_code effective_from:d effective_to:d "
    "announcement_date:d available_at:d source data_class",
    "flagship_features_latest": "ticker date:d sma_ratio_20:8 volatility_20d:8 beta_60d:8 "
    "return_20d:8 liquidity_20d:8",
    "feat_returns": "ticker date:d ret1:8 return_5d:8 return_20d:8 return_60d:8 return_120d:8",
    "feat_sma_ema": "ticker date:d sma_ratio_20:8 ema_ratio_20:8",
    "feat_rsi": "ticker date:d rsi_14:6",
    "feat_macd": "ticker date:d macd:5",
    "feat_atr": "ticker date:d atr_14:8",
    "feat_vol": "ticker date:d volatility_20d:8",
    "feat_downside": "ticker date:d downside_volatility_20d:8",
    "feat_drawdown": "ticker date:d drawdown_60d:8",
    "feat_liquidity": "ticker date:d liquidity_20d:8",
    "feat_beta": "ticker date:d beta_60d:7",
    "feat_target_rank": "ticker date:d target_return_20d:8 target_rank:8",
    "feat_all": "ticker date:d return_5d:7 return_20d:7 return_60d:7 return_120d:7 sma_ratio_20:7 "
    "ema_ratio_20:7 rsi_14:5 macd:4 atr_14:7 volatility_20d:7 downside_volatility_20d:7 "
    "drawdown_60d:7 liquidity_20d:7 beta_60d:6 target_return_20d:7 target_rank:7 roe_pit:9 "
    "revenue_growth_yoy_pit:7 policy_rate_pit:8 feature_available_at:d",
    "market_return": "date:d market_ret:8",
    "validate_issues": "severity check count:i",
    "return_outliers": "ticker date:d ret1:8",
    "coverage_year": "ticker year:i source data_class records:i start:d end:d missing_close:i",
    "coverage_ticker": "ticker source records:i start:d end:d calendar_span_days:i missing_open:i "
    "missing_close:i nonpositive_close:i",
    "dataset_summary": "records:i tickers:i start:d end:d data_classes",
    "quarantine_rows": "date:d ticker source open:8 high:8 low:8 close:8",
    "leakage_checks": "check passed fixture_only",
    "side_table_status": "table status",
    "fingerprint": "records:i lane0 lane1 lane2 lane3",
    "universe_monthly": "decision_time:d ticker eligible reason data_class",
    "month_end_closes": "ticker month_end:d close:8",
    "fundamental_ratios": "ticker fiscal_period_end:d available_at:d roe_pit:9 revenue_growth_yoy_pit:8",
    "asof_financials": "ticker date:d close:8 roe_pit:9 revenue_growth_yoy_pit:8",
    "asof_macro": "ticker date:d close:8 policy_rate_pit:8",
    "norm_feed_a": f"date:d ticker {_BAR} source available_at:d parser_version data_class",
    "norm_feed_b": f"date:d ticker {_BAR} source available_at:d parser_version data_class",
    "norm_feed_c": f"date:d ticker {_BAR} source available_at:d parser_version data_class",
    "norm_feed_d": f"date:d ticker {_BAR} source available_at:d parser_version data_class",
    "norm_macro": "date:d available_at:d series_id value:8 source",
    "listing_filter": "symbol position:i name",
    "listing_first": "symbol position:i name",
    "listing_requested": "symbol position:i name",
    "merge_sources": f"date:d ticker {_BAR} source available_at:d",
    "merge_quarantine": f"date:d ticker {_BAR} source available_at:d",
    "merged_master": "ticker company_name exchange listing_date:d effective_from:d available_at:d source",
    "crosscheck": "ticker overlap_rows:i median_abs_pct_diff:8 mean_abs_pct_diff:8",
    "source_counts": "source tickers:i",
    "candidates_topn": "ticker source records:i start:d end:d ends_at_target",
    "fresh_tickers": "ticker last_date:d",
    "stale_rows": "date:d ticker open:8 close:8 volume:i",
    "run_ledger": "source status records:i tickers_requested:i tickers_collected:i failures:i "
    "date_start:d date_end:d",
    "incremental_ingest": f"date:d ticker {_BAR} source available_at:d",
    "fold_manifest_last12": "fold:i train_start:d train_end:d validation_end:d test_start:d test_end:d",
    "fold_manifest": "fold:i train_start:d train_end:d validation_end:d test_start:d test_end:d",
    "fold_counts": "fold:i role records:i dates:i tickers:i",
    "snapshots": "fold:i decision_time:d ticker signal:8 liquidity_20d:8 volatility_20d:8",
    "base_scores": "fold:i decision_time:d ticker signal_z:7 liquidity_z:7 risk_z:7 base_score:7",
    "adaptive_selection": "fold:i decision_time:d ticker base_score:7 selected_candidate decision_reason",
    "selection_trace": "fold:i round:i ticker pick_score:7",
    "topm_liquidity": "fold:i idx:i ticker liquidity_20d:8",
    "topm_signal": "fold:i idx:i ticker signal:8",
    "topm_ewma": "fold:i idx:i ticker score:9",
    "corr_to_chosen": "fold:i ticker other corr:7",
    "ewma_mean": "strategy fold:i i:i mu:7",
    "ewma_cov": "strategy fold:i i:i j:i cov:7",
    "shrunk_cov": "strategy fold:i i:i j:i mu:7 cov:7",
    "selection_matrix": "strategy fold:i i:i j:i q:7",
    "subset_energies": "strategy fold:i mask:i energy:s",
    "best_subset": "strategy fold:i n:i k:i mask:i energy:7",
    "subset_random_search": "strategy fold:i mask:i energy:7 feasibility_rate:8 shots:i",
    "subset_gap": "strategy fold:i method run:i mask:i energy:7 feasibility_rate:8 optimality_gap:6",
    "method_comparison": "method energy_mean:7 feasibility_rate:8 optimality_gap_mean:6 runs:i",
    "instances_json": "strategy fold:i decision_time:d cardinality:i tickers mu_sum:6 cov_sum:6 q_sum:6",
    "turnover_equal": "strategy fold:i turnover:8 transaction_cost:9",
    "trades_equal": "strategy fold:i ticker pre_trade_weight:8 target_weight:8 trade_weight:8 "
    "turnover:8 transaction_cost:9",
    "drift_equal": "strategy fold:i ticker weight:8 drifted:8",
    "backtest_equal": "strategy fold:i date:d gross:8 ret:8",
    "ablation_equal": "fold:i configuration selector solver selected_tickers objective:7 "
    "optimality_gap:7 feasibility_rate:7 turnover:8 transaction_cost:9 net_return:8 covariance_method",
    "ablation_summary_equal": "configuration selector solver folds:i objective_mean:7 "
    "feasibility_rate:7 optimality_gap:7 turnover_mean:8 transaction_cost:9",
    "cardinality_cost_grid": "fold:i cardinality:i transaction_cost_bps:2 gross_return:8 turnover:8 net_return:8",
    "sensitivity_summary": "cardinality:i transaction_cost_bps:2 net_return_mean:8 gross_return_mean:8 "
    "turnover_mean:8 cases:i",
    "sensitivity_by_cost": "transaction_cost_bps:2 net_return_mean:8 gross_return_mean:8 turnover_mean:8 cases:i",
    "import_prices_good": "date:d ticker open:8 high:8 low:8 close:8 adjusted_close:8 volume:i trading_value:7 source available_at:d data_class has_checksum",
    "import_prices_rejected": "date ticker reasons",
    "import_financials": "landed_as ticker fiscal_period_end:d publication_date:d available_at:d revenue:4 net_income:4 source data_class",
    "artifact_csv": "fold:i train_start:d train_end:d validation_end:d test_start:d test_end:d",
    "artifact_parquet": "ticker year:i source data_class records:i start:d end:d missing_close:i",
    "validation_verdict": "status records:i tickers:i start:d end:d data_classes issues",
    "audit_verdict": "status blockers limitations fixture_only",
    "run_gate": "mode allowed reason",
    "allocate_weights": "strategy fold:i ticker weight:6 pre_trade_weight:6",
    "ablation_summary": "configuration selector solver folds:i objective_mean:7 feasibility_rate:7 "
    "optimality_gap:7 turnover_mean:6 transaction_cost:6",
    "fold_status": "strategy fold:i test_start:d decision_time:d tickers:i candidates:i test_dates:i stage",
    "run_summary": "strategy folds_requested:i folds_completed:i stopped",
    "backtest_optimised": "strategy fold:i date:d gross:6 ret:6",
    "performance_metrics": f"strategy {_METRICS}",
    "market_metrics": f"sector {_METRICS}",
    "wealth_curve": "strategy fold:i date:d wealth:s peak:s drawdown:8",
    "returns_pivot": "date:d liquidity:8 ewma:8 signal:8 adaptive:8 adaptive_costed:8",
    "regimes": "date:d market_ret:8 trailing_return:s trailing_vol:8 vol_median:8 regime",
    "metrics_by_regime": f"strategy regime {_METRICS}",
    "paired_bootstrap": "test mean_difference:8 ci_low:8 ci_high:8 p_value:6",
    "sharpe_ci": "strategy sharpe_ci_low:6 sharpe_ci_high:6",
    "holm": "test mean_difference:8 p_value:6 p_value_holm:6 conclusion",
    "sector_bootstrap": "test mean_difference:8 ci_low:8 ci_high:8 p_value:6 p_value_holm:6 conclusion",
    "rank_ic": "fold:i n:i rank_ic:7",
    "rank_ic_summary": "folds:i mean_ic:7 median_ic:7 min_ic:7 max_ic:7",
    "ranker_scores": "fold:i decision_time:d ticker signal:6 target_rank:7 liquidity_20d:7 volatility_20d:7",
}

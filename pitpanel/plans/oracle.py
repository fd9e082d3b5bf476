"""ANSI SQL twins of the registered queries, for DuckDB over the same tables.

Shared steps are named common table expressions; each query takes those it needs.
They are written the direct way (grids, self-joins, recursion), not the way the
Spark side works, so agreement is evidence.
"""

from __future__ import annotations

from pitpanel.plans.shape import shaped_sql
from pitpanel.plans.shapes import SHAPES

REACHES = "2001-10-15"
PERIODS, TRAIN, VALID, TEST = 52, 24, 3, 1
M, K, LOOKBACK, HISTORY, SPAN, HORIZON = 6, 3, 120, 252, 60, 20
SEEDS, SHOTS, SEED = (11, 23, 47), 1024, 42
COST, RF, AVERSION = 10.0, 0.03, 0.55
STRATEGIES = ["liquidity", "ewma", "signal", "adaptive", "adaptive_costed"]
DECAY = f"(1.0 - 2.0 / ({SPAN} + 1.0))"


def _bars(where: str = "TRUE") -> str:
    key = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey)"
    return f"""
    SELECT CAST(l_suppkey AS VARCHAR) AS ticker, date,
           arg_min(price, {key}) AS open, max(price) AS high, min(price) AS low,
           arg_max(price, {key}) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume,
           sum(l_extendedprice) AS trading_value
    FROM fills WHERE {where} GROUP BY l_suppkey, date"""


def _ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def _rows(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, probe: str, value: str) -> str:
    return f"CASE WHEN count({probe}) OVER {_rows(n)} = {n} THEN {value} END"


def _pct_rank(value: str, by: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) "
        f"+ (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0) "
        f"/ count({value}) OVER (PARTITION BY {by})"
    )


def _draw(modulus: str, *parts: str) -> str:
    text = ", ".join(parts)
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::BIGINT % ({modulus}))"


def _energy(mask: str) -> str:
    return f"sum(CASE WHEN (({mask} >> i) & 1) = 1 AND (({mask} >> j) & 1) = 1 THEN q ELSE 0 END)"


_MARKET_FEATURES = (
    "return_5d return_20d return_60d return_120d sma_ratio_20 ema_ratio_20 rsi_14 macd atr_14 "
    "volatility_20d downside_volatility_20d drawdown_60d liquidity_20d beta_60d"
).split()

# name -> (names it reads, SQL)
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, reads: str, sql: str) -> None:
    CTES[name] = (reads.split(), sql)


cte("fills", "", """
    SELECT *, l_extendedprice / nullif(l_quantity, 0) AS price,
           CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem""")
cte("bars", "fills", _bars())
cte("bars_f", "fills", _bars("l_linestatus = 'F'"))
cte("bars_o", "fills", _bars("l_linestatus <> 'F'"))
cte("weeks", "fills", """
    SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date
    FROM fills""")
cte("panel", "bars weeks", """
    SELECT ticker, date, coalesce(open, c) AS open, coalesce(high, c) AS high,
           coalesce(low, c) AS low, c AS close, c AS adjusted_close,
           coalesce(volume, 0) AS volume, coalesce(trading_value, 0.0) AS trading_value,
           'trade_tape' AS source, date AS available_at, 'real' AS data_class
    FROM (SELECT g.ticker, g.date, b.open, b.high, b.low, b.volume, b.trading_value,
                 last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date) AS c
          FROM (SELECT t.ticker, w.date
                FROM (SELECT ticker, min(date) AS first FROM bars GROUP BY ticker) t
                JOIN weeks w ON w.date >= t.first) g
          LEFT JOIN bars b ON b.ticker = g.ticker AND b.date = g.date)""")
cte("rets", "panel", f"""
    SELECT *, {_ratio('adjusted_close',
                      'lag(adjusted_close) OVER (PARTITION BY ticker ORDER BY date)')} - 1 AS ret1
    FROM panel""")
cte("market", "rets", "SELECT date, avg(ret1) AS market_ret FROM rets GROUP BY date")
_w = "OVER (PARTITION BY ticker ORDER BY date)"
cte("shifted", "rets market", f"""
    SELECT r.*, m.market_ret, adjusted_close AS p,
           adjusted_close - lag(adjusted_close) {_w} AS d,
           greatest(high - low, abs(high - lag(adjusted_close) {_w}),
                    abs(low - lag(adjusted_close) {_w})) AS tr,
           row_number() {_w} AS i
    FROM rets r LEFT JOIN market m USING (date)""")
cte("ema", "shifted", """
    SELECT ticker, i, p AS e12, p AS e20, p AS e26 FROM shifted WHERE i = 1
    UNION ALL
    SELECT s.ticker, s.i, s.p * 2 / 13 + e.e12 * 11 / 13, s.p * 2 / 21 + e.e20 * 19 / 21,
           s.p * 2 / 27 + e.e26 * 25 / 27
    FROM ema e JOIN shifted s ON s.ticker = e.ticker AND s.i = e.i + 1""")
_gain = f"avg(CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END) OVER {_rows(14)}"
_loss = f"avg(CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END) OVER {_rows(14)}"
cte("feat0", "shifted", f"""
    SELECT *,
      {", ".join(f"{_ratio('p', f'lag(p, {n}) {_w}')} - 1 AS return_{n}d" for n in (5, 20, 60, 120))},
      {_full(20, 'p', f"{_ratio('p', f'avg(p) OVER {_rows(20)}')} - 1")} AS sma_ratio_20,
      {_full(14, 'd', f"100 - 100 / (1 + {_ratio(_gain, _loss)})")} AS rsi_14,
      {_full(14, 'tr', _ratio(f'avg(tr) OVER {_rows(14)}', 'p'))} AS atr_14,
      {_full(20, 'ret1', f'stddev_samp(ret1) OVER {_rows(20)}')} AS volatility_20d,
      {_full(20, '*', f'stddev_samp(CASE WHEN ret1 < 0 THEN ret1 ELSE 0 END) OVER {_rows(20)}')}
        AS downside_volatility_20d,
      {_full(60, 'p', f"{_ratio('p', f'max(p) OVER {_rows(60)}')} - 1")} AS drawdown_60d,
      {_full(20, 'trading_value', f'ln(1 + avg(trading_value) OVER {_rows(20)})')} AS liquidity_20d,
      CASE WHEN count(CASE WHEN ret1 IS NOT NULL AND market_ret IS NOT NULL THEN 1 END)
                OVER {_rows(60)} = 60 AND count(market_ret) OVER {_rows(60)} = 60
           THEN {_ratio(f'covar_samp(ret1, market_ret) OVER {_rows(60)}',
                        f'var_samp(market_ret) OVER {_rows(60)}')} END AS beta_60d,
      {_ratio(f'lead(p, 20) {_w}', 'p')} - 1 AS target_return_20d
    FROM shifted""")
cte("feat", "feat0 ema", """
    SELECT f.*, f.p / nullif(e.e20, 0) - 1 AS ema_ratio_20, e.e12 - e.e26 AS macd
    FROM feat0 f JOIN ema e ON e.ticker = f.ticker AND e.i = f.i""")
cte("ranked", "feat0", f"""
    SELECT ticker, date, target_return_20d,
           CASE WHEN target_return_20d IS NOT NULL
                THEN {_pct_rank('target_return_20d', 'date')} END AS target_rank
    FROM feat0""")
cte("tape", "fills bars_o", """
    SELECT CAST(l_suppkey AS VARCHAR) AS ticker, date,
           arg_min(price, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS open,
           max(price) FILTER (WHERE l_linestatus = 'F') AS high,
           min(price) FILTER (WHERE l_linestatus = 'F') AS low,
           arg_max(price, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS close,
           CAST(sum(l_quantity) AS BIGINT) AS volume, sum(l_extendedprice) AS trading_value,
           'final_tape' AS source, date AS available_at, 'real' AS data_class
    FROM fills GROUP BY l_suppkey, date
    UNION ALL
    SELECT *, 'open_tape', date + 1, 'real' FROM bars_o""")
_BAD = ("(coalesce(high < greatest(open, close, low), FALSE) "
        "OR coalesce(low > least(open, close, high), FALSE) "
        "OR coalesce(least(open, high, low, close) <= 0, FALSE))")
cte("outliers", "tape", """
    SELECT * FROM (
      SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker, source ORDER BY date, close), 0) - 1 AS ret1
      FROM tape)
    WHERE abs(ret1) > 0.3""")
cte("master", "fills", """
    SELECT CAST(s_suppkey AS VARCHAR) AS ticker, s_name AS company_name, 'TAPE' AS exchange,
           n_name AS industry, r_name AS sector, first AS listing_date,
           CASE WHEN last < (SELECT max(date) FROM fills) - 7 THEN last END AS delisting_date,
           first AS effective_from, CAST(NULL AS DATE) AS effective_to, first AS available_at,
           'supplier_listing' AS source, 'real' AS data_class
    FROM supplier
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    JOIN (SELECT l_suppkey, min(date) AS first, max(date) AS last FROM fills GROUP BY 1)
      ON l_suppkey = s_suppkey""")
cte("financials", "fills", """
    SELECT ticker, e AS fiscal_period_end, e + 35 AS publication_date, e + 35 AS available_at,
           revenue, net_income, total_assets, equity, 'order_book' AS source, 'real' AS data_class
    FROM (SELECT CAST(l_suppkey AS VARCHAR) AS ticker,
                 last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS e,
                 sum(l_extendedprice) AS revenue,
                 sum(l_extendedprice * (l_discount - 0.04::DOUBLE)) AS net_income,
                 sum(l_extendedprice * l_tax) AS total_assets,
                 sum(l_extendedprice * (1 - l_discount)) AS equity
          FROM fills JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""")
cte("fin_ratios", "financials", """
    SELECT *, net_income / nullif(equity, 0) AS roe_pit,
           revenue / nullif(lag(revenue, 4) OVER (PARTITION BY ticker ORDER BY available_at), 0) - 1
             AS revenue_growth_yoy_pit
    FROM financials""")
cte("macro", "", """
    SELECT series_id, e AS observation_date, e + 5 AS release_date, e + 5 AS available_at, value,
           'trade_tape' AS source, 'real' AS data_class
    FROM (SELECT last_day(l_shipdate) AS e, 'POLICY_RATE' AS series_id, avg(l_discount) AS value
          FROM lineitem GROUP BY 1
          UNION ALL
          SELECT last_day(l_shipdate), 'TAX_RATE', avg(l_tax) FROM lineitem GROUP BY 1)""")
cte("policy", "macro", """
    SELECT available_at, value AS policy_rate_pit FROM macro
    WHERE contains(upper(series_id), 'POLICY_RATE')""")
_D_ADJ = "CASE WHEN open = close THEN close ELSE close / 2 END"
cte("primary_feed", "bars_f", f"""
    SELECT date, ticker, open, CASE WHEN volume % 97 = 0 THEN low / 2 ELSE high END AS high, low, close,
           {_D_ADJ} AS adjusted_close, volume, volume * close AS trading_value, 'feed_d' AS source, date + 1 AS available_at
    FROM bars_f WHERE ticker IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal >= 0)""")


def _feed_c(src: str) -> str:
    t = "(({0} / 1000) * 1000.0)"
    o, h, lo, c = (t.format(x) for x in ("open", "high", "low", "close"))
    return f"""
    SELECT date, ticker, {o} AS open, {h} AS high, {lo} AS low, {c} AS close,
           {c} AS adjusted_close, volume, volume * {c} AS trading_value, 'feed_c' AS source,
           date + 1 AS available_at, 'feed-c-v1' AS parser_version, 'real' AS data_class
    FROM {src}"""


cte("fallback_feed", "bars_o", "SELECT * EXCLUDE (parser_version, data_class) FROM (" + _feed_c("bars_o") + ")")
cte("served", "primary_feed fallback_feed", """
    SELECT * FROM primary_feed
    UNION ALL
    SELECT * FROM fallback_feed WHERE ticker NOT IN (SELECT ticker FROM primary_feed)""")
cte("merged", "served", f"SELECT * REPLACE (date AS available_at) FROM served WHERE NOT {_BAD}")
cte("fold_ends", "weeks", f"""
    SELECT last_day(CAST(m AS DATE)) AS t
    FROM (SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi),
                                        INTERVAL 1 MONTH)) AS m, lo, hi
          FROM (SELECT CAST(min(date) + INTERVAL {TRAIN + VALID} MONTH AS DATE) AS lo,
                       CAST(max(date) - INTERVAL {TEST} MONTH AS DATE) AS hi FROM weeks))
    WHERE last_day(CAST(m AS DATE)) BETWEEN lo AND hi""")
cte("folds", "fold_ends", f"""
    SELECT row_number() OVER (ORDER BY t) - 1 AS fold,
           CAST(t - INTERVAL {TRAIN + VALID} MONTH AS DATE) AS train_start,
           CAST(t - INTERVAL {VALID} MONTH AS DATE) AS train_end,
           t AS validation_end, t AS test_start, CAST(t + INTERVAL {TEST} MONTH AS DATE) AS test_end
    FROM fold_ends""")
cte("folds_last12", "folds", """
    SELECT * REPLACE (row_number() OVER (ORDER BY test_start) - 1 AS fold)
    FROM (SELECT * FROM folds ORDER BY test_start DESC LIMIT 12)""")
cte("decisions", "folds weeks", """
    SELECT f.*, (SELECT max(date) FROM weeks WHERE date <= f.test_start) AS decision_time
    FROM folds f""")
cte("win", "decisions weeks", f"""
    SELECT fold, date, age FROM (
      SELECT d.fold, w.date,
             row_number() OVER (PARTITION BY d.fold ORDER BY w.date DESC) - 1 AS age
      FROM decisions d JOIN weeks w ON w.date <= d.decision_time) WHERE age < {HISTORY}""")
cte("snap", "feat decisions", f"""
    SELECT * FROM (
      SELECT d.fold, d.decision_time, f.*,
             0.5 * return_60d + 0.3 * return_20d - 0.2 * volatility_20d AS signal,
             count(*) OVER (PARTITION BY d.fold) AS n_fold
      FROM feat f JOIN decisions d ON f.date = d.decision_time
      WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _MARKET_FEATURES)})
    WHERE n_fold >= {M}""")


def _z(c: str) -> str:
    return (f"({c} - avg({c}) OVER (PARTITION BY fold)) "
            f"/ (stddev_pop({c}) OVER (PARTITION BY fold) + 1e-12)")


cte("scores", "snap", f"""
    SELECT *, 0.55 * signal_z + 0.20 * liquidity_z - 0.15 * risk_z AS base_score
    FROM (SELECT fold, decision_time, ticker, {_z('signal')} AS signal_z,
                 {_z('liquidity_20d')} AS liquidity_z, {_z('volatility_20d')} AS risk_z FROM snap)""")
cte("near", "win rets", f"""
    SELECT w.fold, r.ticker, r.date, r.ret1 FROM win w JOIN rets r ON r.date = w.date
    WHERE w.age < {LOOKBACK} AND r.ret1 IS NOT NULL""")
cte("corrs", "near snap", """
    SELECT fold, ticker, other, CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE c END AS corr FROM (
      SELECT a.fold, a.ticker, b.ticker AS other, corr(a.ret1, b.ret1) AS c
      FROM near a JOIN near b ON a.fold = b.fold AND a.date = b.date
      SEMI JOIN snap s ON s.fold = b.fold AND s.ticker = b.ticker
      GROUP BY 1, 2, 3)""")
cte("greedy", "scores corrs", f"""
    SELECT fold, decision_time, 0 AS r, ticker, base_score, CAST(0 AS DOUBLE) AS pen,
           CAST(NULL AS INTEGER) AS pick, CAST(NULL AS DOUBLE) AS pick_score FROM scores
    UNION ALL
    SELECT s.fold, s.decision_time, s.r + 1, s.ticker, s.base_score,
           s.pen + coalesce(abs(c.corr), 0),
           CASE WHEN s.ticker = s.best THEN s.r ELSE s.pick END,
           CASE WHEN s.ticker = s.best THEN s.score ELSE s.pick_score END
    FROM (SELECT *, first_value(ticker) OVER (PARTITION BY fold ORDER BY score DESC NULLS LAST, ticker) AS best
          FROM (SELECT *, CASE WHEN pick IS NULL THEN base_score - 0.1 * pen / greatest(r, 1) END AS score
                FROM greedy WHERE r < {M})) s
    LEFT JOIN corrs c ON c.fold = s.fold AND c.ticker = s.ticker AND c.other = s.best""")
cte("adaptive", "greedy", f"""
    SELECT *, pick IS NOT NULL AS selected_candidate,
           CASE WHEN pick IS NOT NULL THEN 'selected_by_signal_liquidity_risk_and_correlation'
                ELSE 'outside_budget' END AS decision_reason
    FROM greedy WHERE r = {M}""")
cte("ewma_list", "win rets snap", """
    SELECT w.fold, r.ticker, list({'pos': -w.age, 'y': r.ret1} ORDER BY w.age DESC) AS l
    FROM win w JOIN rets r ON r.date = w.date
    SEMI JOIN snap s ON s.fold = w.fold AND s.ticker = r.ticker
    WHERE r.ret1 IS NOT NULL GROUP BY 1, 2""")
_step = f"power({DECAY}, x.pos - a.pos)"
_alpha = f"(2.0 / ({SPAN} + 1.0))"
cte("ewma_scores", "ewma_list", f"""
    SELECT fold, ticker, list_reduce(l, lambda a, x:
      {{'pos': x.pos, 'y': ({_step} * a.y + {_alpha} * x.y) / ({_step} + {_alpha})}}).y AS score
    FROM ewma_list""")


def _top(col: str, src: str, m: int = M) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold "
            f"ORDER BY {col} DESC, ticker) - 1 AS idx FROM {src}) WHERE idx < {m}")


cte("top_liquidity", "snap", _top("liquidity_20d", "snap"))
cte("top_signal", "snap", _top("signal", "snap"))
cte("top_ewma", "ewma_scores", _top("score", "ewma_scores"))
cte("top_adaptive", "adaptive", _top("base_score", "(SELECT * FROM adaptive WHERE selected_candidate)"))
cte("pools", "top_liquidity top_signal top_ewma top_adaptive", """
    SELECT 'liquidity' AS strategy, fold, idx, ticker FROM top_liquidity
    UNION ALL SELECT 'ewma', fold, idx, ticker FROM top_ewma
    UNION ALL SELECT 'signal', fold, idx, ticker FROM top_signal
    UNION ALL SELECT 'adaptive', fold, idx, ticker FROM top_adaptive
    UNION ALL SELECT 'adaptive_costed', fold, idx, ticker FROM top_adaptive""")

def _moments(tag: str, pools: str) -> None:
    """CTEs rows/mom/q over one pool table, each suffixed by ``tag``."""
    cte(f"rows{tag}", f"{pools} decisions rets", f"""
    SELECT * EXCLUDE (age0, known, size), row_number() OVER
             (PARTITION BY strategy, fold, idx ORDER BY date DESC) - 1 AS age
    FROM (SELECT p.strategy, p.fold, p.idx, r.date, r.ret1,
                 dense_rank() OVER (PARTITION BY p.strategy, p.fold ORDER BY r.date DESC) AS age0,
                 count(r.ret1) OVER (PARTITION BY p.strategy, p.fold, r.date) AS known, p.size
          FROM (SELECT *, count(*) OVER (PARTITION BY strategy, fold) AS size FROM {pools}) p
          JOIN decisions d ON d.fold = p.fold
          JOIN rets r ON r.ticker = p.ticker AND r.date <= d.decision_time)
    WHERE age0 <= {HISTORY} AND known = size""")
    cte(f"weighted{tag}", f"rows{tag}", f"""
    SELECT *, power({DECAY}, age) / sum(power({DECAY}, age)) OVER (PARTITION BY strategy, fold, idx) AS w
    FROM rows{tag}""")
    cte(f"means{tag}", f"weighted{tag}", f"""
    SELECT strategy, fold, idx, sum(w * ret1) AS m, avg(ret1) AS plain, sum(w * w) AS ww
    FROM weighted{tag} GROUP BY ALL""")
    cte(f"mom{tag}", f"weighted{tag} means{tag}", f"""
    SELECT a.strategy, a.fold, a.idx AS i, b.idx AS j, any_value(ma.m) * {HORIZON} AS mu,
           (sum(a.w * (a.ret1 - ma.m) * (b.ret1 - mb.m)) / (1 - any_value(ma.ww))
            + CASE WHEN a.idx = b.idx THEN 1e-10 ELSE 0 END) * {HORIZON} AS cov
    FROM weighted{tag} a
    JOIN weighted{tag} b ON a.strategy = b.strategy AND a.fold = b.fold AND a.date = b.date
    JOIN means{tag} ma ON ma.strategy = a.strategy AND ma.fold = a.fold AND ma.idx = a.idx
    JOIN means{tag} mb ON mb.strategy = b.strategy AND mb.fold = b.fold AND mb.idx = b.idx
    GROUP BY 1, 2, 3, 4""")
    cte(f"q{tag}", f"mom{tag}", f"""
    SELECT *, {AVERSION} * cov - CASE WHEN i = j THEN {1 - AVERSION} * mu ELSE 0 END AS q
    FROM mom{tag}""")
    cte(f"size{tag}", f"q{tag}", f"""
    SELECT strategy, fold, max(i) + 1 AS n, least({K}, max(i) + 1) AS k, sum(abs(q)) AS total
    FROM q{tag} GROUP BY 1, 2""")
    for k in (K, K - 1):
        cte(f"energies{tag}{k}", f"q{tag} size{tag}", f"""
    SELECT q.strategy, q.fold, any_value(s.n) AS n, least({k}, any_value(s.n)) AS k, m.mask,
           {_energy('m.mask')} AS energy
    FROM q{tag} q JOIN size{tag} s ON s.strategy = q.strategy AND s.fold = q.fold
    JOIN range({2 ** M}) m(mask) ON m.mask < (1 << CAST(s.n AS INTEGER))
         AND bit_count(m.mask) = least({k}, s.n)
    GROUP BY q.strategy, q.fold, m.mask""")
        cte(f"best{tag}{k}", f"energies{tag}{k}", f"""
    SELECT * FROM energies{tag}{k}
    QUALIFY row_number() OVER (PARTITION BY strategy, fold ORDER BY energy, mask) = 1""")
    for run, seed in enumerate(SEEDS):
        cte(f"draws{tag}{run}", f"size{tag}", f"""
    SELECT s.*, shot, {_draw('1 << CAST(n AS INTEGER)', f"'{seed}'", 'strategy', 'fold', 'shot')} AS mask
    FROM size{tag} s, range({SHOTS}) t(shot)""")
        cte(f"search{tag}{run}", f"draws{tag}{run} q{tag}", f"""
    SELECT strategy, fold, arg_min(mask, row(penalised, shot)) AS mask,
           arg_min(energy, row(penalised, shot)) AS energy,
           avg(CASE WHEN bit_count(mask) = k THEN 1.0 ELSE 0.0 END) AS feasibility_rate,
           count(*) AS shots
    FROM (SELECT *, energy + greatest(1.0, total) * power(bit_count(mask) - k, 2) AS penalised
          FROM (SELECT d.strategy, d.fold, d.shot, d.mask, any_value(d.k) AS k,
                       any_value(d.total) AS total, {_energy('d.mask')} AS energy
                FROM draws{tag}{run} d
                JOIN q{tag} q ON q.strategy = d.strategy AND q.fold = d.fold
                GROUP BY d.strategy, d.fold, d.shot, d.mask))
    GROUP BY strategy, fold""")
    searches = " ".join(f"search{tag}{r}" for r in range(len(SEEDS)))
    union = " UNION ALL ".join(
        f"SELECT strategy, fold, 'random_search' AS method, {r} AS run, mask, energy, "
        f"feasibility_rate FROM search{tag}{r}" for r in range(len(SEEDS)))
    cte(f"runs{tag}", f"best{tag}{K} {searches}", f"""
    SELECT r.*, (r.energy - b.energy) / (abs(b.energy) + 1e-12) AS optimality_gap
    FROM (SELECT strategy, fold, 'exact' AS method, 0 AS run, mask, energy, 1.0 AS feasibility_rate
          FROM best{tag}{K} UNION ALL {union}) r
    JOIN best{tag}{K} b ON b.strategy = r.strategy AND b.fold = r.fold""")


_moments("", "pools")
cte("shrink", "rows means", f"""
    WITH c AS (SELECT r.strategy, r.fold, r.idx, r.date, r.ret1 - m.plain AS x
               FROM rows r JOIN means m USING (strategy, fold, idx)),
    s AS (SELECT a.strategy, a.fold, a.idx AS i, b.idx AS j, avg(a.x * b.x) AS s
          FROM c a JOIN c b USING (strategy, fold, date) GROUP BY 1, 2, 3, 4),
    f AS (SELECT strategy, fold, sum(s * s) AS ss, sum(s) FILTER (WHERE i = j) AS tr,
                 count(DISTINCT i) AS p FROM s GROUP BY 1, 2),
    t AS (SELECT strategy, fold, sum(sq * sq) AS quartic, count(*) AS n
          FROM (SELECT strategy, fold, date, sum(x * x) AS sq FROM c GROUP BY ALL) GROUP BY 1, 2),
    g AS (SELECT strategy, fold, tr / p AS m, (ss - tr * tr / p) / p AS d,
                 (quartic / n - ss) / (p * n) AS b FROM f JOIN t USING (strategy, fold))
    SELECT s.strategy, s.fold, s.i, s.j, m.plain * {HORIZON} AS mu,
           ((1 - least(b, d) / d) * s
            + CASE WHEN s.i = s.j THEN least(b, d) / d * g.m ELSE 0 END) * {HORIZON} AS cov
    FROM s JOIN g USING (strategy, fold)
    JOIN means m ON m.strategy = s.strategy AND m.fold = s.fold AND m.idx = s.i""")


def _equal_weights(tag: str, chosen: str) -> None:
    cte(f"weights{tag}", f"{chosen} folds weeks", f"""
    SELECT strategy, fold, ticker, 1.0 / count(*) OVER (PARTITION BY strategy, fold) AS weight
    FROM {chosen} c WHERE EXISTS (SELECT 1 FROM weeks w JOIN folds f
      ON w.date > f.test_start AND w.date <= f.test_end WHERE f.fold = c.fold)""")


def _backtest(tag: str, costed: str) -> None:
    cte(f"held{tag}", f"weights{tag} folds rets", f"""
    SELECT w.strategy, w.fold, w.ticker, w.weight, r.date, coalesce(r.ret1, 0) AS ret1
    FROM weights{tag} w JOIN folds f ON f.fold = w.fold
    JOIN rets r ON r.ticker = w.ticker AND r.date > f.test_start AND r.date <= f.test_end""")
    cte(f"drifted{tag}", f"weights{tag} held{tag}", f"""
    SELECT * FROM (
      SELECT strategy, fold, ticker, weight, CASE WHEN total > 0 THEN v / total ELSE weight END AS drifted, total
      FROM (SELECT *, sum(v) OVER (PARTITION BY strategy, fold) AS total
            FROM (SELECT w.*, w.weight * coalesce(g.growth, 1) AS v
                  FROM weights{tag} w LEFT JOIN (
                    SELECT strategy, fold, ticker, product(1 + ret1) AS growth FROM held{tag} GROUP BY ALL) g
                  USING (strategy, fold, ticker))))
    WHERE NOT (total > 0) OR drifted > 1e-12""")
    cte(f"trades{tag}", f"weights{tag} drifted{tag}", f"""
    SELECT *, abs(trade_weight) AS turnover,
           abs(trade_weight) * CASE WHEN {costed} THEN {COST} ELSE 0 END / 10000 AS transaction_cost
    FROM (SELECT strategy, fold, ticker, coalesce(weight, 0) AS target_weight,
                 coalesce(prev, 0) AS pre_trade_weight,
                 coalesce(weight, 0) - coalesce(prev, 0) AS trade_weight
          FROM weights{tag} FULL JOIN (
            SELECT d.strategy, n.next AS fold, d.ticker, d.drifted AS prev
            FROM drifted{tag} d JOIN (
              SELECT strategy, fold, lead(fold) OVER (PARTITION BY strategy ORDER BY fold) AS next
              FROM (SELECT DISTINCT strategy, fold FROM weights{tag})) n
            ON n.strategy = d.strategy AND n.fold = d.fold WHERE n.next IS NOT NULL) p
          USING (strategy, fold, ticker))""")
    cte(f"turns{tag}", f"trades{tag}", f"""
    SELECT strategy, fold, sum(turnover) AS turnover, sum(transaction_cost) AS transaction_cost
    FROM trades{tag} GROUP BY 1, 2""")
    cte(f"port{tag}", f"held{tag} turns{tag}", f"""
    SELECT g.strategy, g.fold, g.date, gross,
           gross - CASE WHEN g.date = min(g.date) OVER (PARTITION BY g.strategy, g.fold)
                        THEN coalesce(t.transaction_cost, 0) ELSE 0 END AS ret
    FROM (SELECT strategy, fold, date, sum(weight * ret1) AS gross FROM held{tag} GROUP BY 1, 2, 3) g
    LEFT JOIN turns{tag} t ON t.strategy = g.strategy AND t.fold = g.fold""")


for _k in (K, K - 1):
    cte(f"chosen{_k}", f"best{_k} pools", f"""
    SELECT p.* FROM pools p JOIN best{_k} b ON b.strategy = p.strategy AND b.fold = p.fold
    WHERE ((b.mask >> p.idx) & 1) = 1""")
    cte(f"chosen_ad{_k}", f"chosen{_k}", f"SELECT * FROM chosen{_k} WHERE strategy = 'adaptive'")
_equal_weights("", f"chosen{K}")
_backtest("", "strategy = 'adaptive_costed'")
for _k in (K, K - 1):
    _equal_weights(f"_ad{_k}", f"chosen_ad{_k}")
    _backtest(f"_ad{_k}", "FALSE")

# Optimised weights of subsets of three. The assets strictly between their bounds and off their old
# weights number none to three; each case has a closed form.
LOW, HIGH, RISK, TRADE = 0.0, 0.6, 1.0, 0.001
cte("asked", f"weights chosen{K} held mom", f"""
    SELECT w.strategy, w.fold, row_number() OVER (PARTITION BY w.strategy ORDER BY w.fold) AS step,
           list(w.ticker ORDER BY c.idx) AS names, list(coalesce(g.growth, 1) ORDER BY c.idx) AS growth,
           any_value(m.mu) AS mu, any_value(m.cov) AS cov
    FROM weights w JOIN chosen{K} c USING (strategy, fold, ticker)
    LEFT JOIN (SELECT strategy, fold, ticker, product(1 + ret1) AS growth FROM held GROUP BY ALL) g
      USING (strategy, fold, ticker)
    JOIN (SELECT strategy, fold, list(mu ORDER BY i) FILTER (WHERE i = j) AS mu, list(cov ORDER BY i, j) AS cov
          FROM (SELECT m.* FROM mom m JOIN chosen{K} a ON a.strategy = m.strategy AND a.fold = m.fold AND a.idx = m.i
                JOIN chosen{K} b ON b.strategy = m.strategy AND b.fold = m.fold AND b.idx = m.j) GROUP BY 1, 2) m
      ON m.strategy = w.strategy AND m.fold = w.fold
    GROUP BY w.strategy, w.fold""")
cte("states", "", """
    SELECT [x, y, z] AS s, list_filter([1, 2, 3], lambda i: [x, y, z][i] > 2) AS f
    FROM range(5) a(x), range(5) b(y), range(5) c(z)""")


def _c(i: str, j: str) -> str:
    return f"(cov[3 * ({i} - 1) + {j}] + CASE WHEN {i} = {j} THEN 1e-10 ELSE 0 END)"


def _b(i: str) -> str:
    """Slope of asset ``i`` with every free asset at 0."""
    others = " + ".join(f"CASE WHEN list_contains(f, {j}) THEN 0 ELSE {_c(i, str(j))} * v[{j}] END" for j in (1, 2, 3))
    return f"(mu[{i}] - {TRADE} * CASE WHEN s[{i}] = 3 THEN -1 ELSE 1 END - {2 * RISK} * ({others}))"


def _pair(a: str, b: str) -> str:
    """Weight of ``a`` when ``a`` and ``b`` share what is left."""
    return (f"(({2 * RISK} * rest * ({_c(b, b)} - {_c(a, b)}) + {_b(a)} - {_b(b)}) / "
            f"({2 * RISK} * ({_c(a, a)} - 2 * {_c(a, b)} + {_c(b, b)})))")


# with the third weight 1 - x - y: two equations for x and y
_m11 = f"({_c('1', '1')} - 2 * {_c('1', '3')} + {_c('3', '3')})"
_m22 = f"({_c('2', '2')} - 2 * {_c('2', '3')} + {_c('3', '3')})"
_m12 = f"({_c('1', '2')} - {_c('1', '3')} - {_c('2', '3')} + {_c('3', '3')})"
_r1 = f"({_c('3', '3')} - {_c('1', '3')} + ({_b('1')} - {_b('3')}) / {2 * RISK})"
_r2 = f"({_c('3', '3')} - {_c('2', '3')} + ({_b('2')} - {_b('3')}) / {2 * RISK})"
_det = f"({_m11} * {_m22} - {_m12} * {_m12})"
_x, _y = f"(({_r1} * {_m22} - {_r2} * {_m12}) / {_det})", f"(({_r2} * {_m11} - {_r1} * {_m12}) / {_det})"
_goal = " + ".join(
    [f"{RISK} * w[{i}] * w[{j}] * {_c(str(i), str(j))}" for i in (1, 2, 3) for j in (1, 2, 3)]
    + [f"{TRADE} * abs(w[{i}] - p[{i}]) - mu[{i}] * w[{i}]" for i in (1, 2, 3)])
_feasible = " AND ".join(f"w[{i}] BETWEEN {LOW} - 1e-9 AND {HIGH} + 1e-9" for i in (1, 2, 3))
cte("walk", "asked states", f"""
    SELECT strategy, 0 AS step, 0 AS fold, []::VARCHAR[] AS names, []::DOUBLE[] AS w, []::VARCHAR[] AS old_names,
           []::DOUBLE[] AS old, []::DOUBLE[] AS after FROM (SELECT DISTINCT strategy FROM asked)
    UNION ALL
    SELECT strategy, step, fold, names, w, old_names, old,
           CASE WHEN t > 0 THEN list_transform(list_transform(g, lambda x: x / t), lambda x: CASE WHEN x > 1e-12 THEN x ELSE 0 END) ELSE w END
    FROM (SELECT *, list_sum(g) AS t FROM (
      SELECT *, [w[1] * growth[1], w[2] * growth[2], w[3] * growth[3]] AS g FROM (
        SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY {_goal}, s) AS best FROM (
          SELECT *, CASE len(f)
                    WHEN 0 THEN v
                    WHEN 1 THEN list_transform([1, 2, 3], lambda i: CASE WHEN i = f[1] THEN rest ELSE v[i] END)
                    WHEN 2 THEN list_transform([1, 2, 3], lambda i: CASE WHEN i = f[1] THEN half WHEN i = f[2] THEN rest - half ELSE v[i] END)
                    ELSE [x, y, 1 - x - y] END AS w
          FROM (SELECT *, CASE WHEN len(f) = 2 THEN {_pair('f[1]', 'f[2]')} END AS half,
                       CASE WHEN len(f) = 3 THEN {_x} END AS x, CASE WHEN len(f) = 3 THEN {_y} END AS y
                FROM (SELECT *, 1 - list_sum(v) AS rest FROM (
                  SELECT *, list_transform([1, 2, 3], lambda i:
                              CASE s[i] WHEN 0 THEN {LOW} WHEN 1 THEN {HIGH} WHEN 2 THEN p[i] ELSE 0 END) AS v
                  FROM (SELECT a.strategy, a.step, a.fold, a.names, a.growth, a.mu, a.cov, k.names AS old_names, k.after AS old,
                               list_transform(a.names, lambda n: coalesce(k.after[list_position(k.names, n)], 0)) AS p
                        FROM walk k JOIN asked a ON a.strategy = k.strategy AND a.step = k.step + 1), states)))
        ) WHERE abs(list_sum(w) - 1) <= 1e-9 AND {_feasible}) WHERE best = 1))""")
cte("allocated", "walk", """
    SELECT strategy, fold, ticker, coalesce(w, 0) AS weight, coalesce(old, 0) AS pre_trade_weight
    FROM (SELECT strategy, fold, unnest(names) AS ticker, unnest(w) AS w FROM walk WHERE step > 0)
    FULL JOIN (SELECT * FROM (SELECT strategy, fold, unnest(old_names) AS ticker, unnest(old) AS old FROM walk WHERE step > 0) WHERE old > 0)
      USING (strategy, fold, ticker)""")
cte("weights_o", "allocated", "SELECT strategy, fold, ticker, weight FROM allocated WHERE weight <> 0")
_backtest("_o", "strategy = 'adaptive_costed'")
cte("weights_peer", "weights", """
    SELECT 'equal_weight_selected' AS strategy, fold, ticker, weight FROM weights WHERE strategy = 'adaptive_costed'""")
_backtest("_peer", "FALSE")
_grid = " UNION ALL ".join(
    f"""SELECT g.fold, {k} AS cardinality, b.bps AS transaction_cost_bps, g.gross_return, t.turnover,
           g.gross_return - t.turnover * b.bps / 10000 AS net_return
    FROM (SELECT strategy, fold, product(1 + gross) - 1 AS gross_return FROM port_ad{k} GROUP BY 1, 2) g
    JOIN turns_ad{k} t ON t.strategy = g.strategy AND t.fold = g.fold
    CROSS JOIN (VALUES (0.0), ({COST}), (25.0)) b(bps)""" for k in (K, K - 1))
cte("grid", " ".join(f"port_ad{k} turns_ad{k}" for k in (K, K - 1)), _grid)
cte("fold_status", "folds decisions feat snap pools mom weeks", f"""
    SELECT *, CASE WHEN decision_time IS NULL THEN 'no_decision_date'
                   WHEN tickers < {M} THEN 'too_few_tickers'
                   WHEN NOT ranked THEN 'no_training_rows'
                   WHEN candidates = 0 THEN 'no_candidates'
                   WHEN NOT solved THEN 'too_few_complete_rows'
                   WHEN test_dates = 0 THEN 'no_test_dates' ELSE 'completed' END AS stage
    FROM (SELECT s.strategy, d.fold, d.test_start, d.decision_time,
                 (SELECT count(*) FROM feat f WHERE f.date = d.decision_time
                    AND {" AND ".join(f"f.{c} IS NOT NULL" for c in _MARKET_FEATURES)}) AS tickers,
                 EXISTS (SELECT 1 FROM snap n WHERE n.fold = d.fold) AS ranked,
                 (SELECT count(*) FROM pools p WHERE p.strategy = s.strategy AND p.fold = d.fold) AS candidates,
                 EXISTS (SELECT 1 FROM mom m WHERE m.strategy = s.strategy AND m.fold = d.fold) AS solved,
                 (SELECT count(*) FROM weeks w WHERE w.date > d.test_start AND w.date <= d.test_end) AS test_dates
          FROM decisions d CROSS JOIN (VALUES {", ".join(f"('{n}')" for n in STRATEGIES)}) s(strategy))""")


def _ablation(tag: str) -> None:
    cte(f"ablation{tag}", f"weights chosen{K} best{K} turns{tag} port{tag}", f"""
    SELECT b.fold, b.strategy AS configuration, split_part(b.strategy, '_', 1) AS selector,
           'exact' AS solver, c.names AS selected_tickers, b.energy AS objective,
           0.0 AS optimality_gap, 1.0 AS feasibility_rate, t.turnover, t.transaction_cost,
           g.net_return, 'ewma' AS covariance_method
    FROM best{K} b
    JOIN (SELECT strategy, fold, string_agg(ticker, '|' ORDER BY idx) AS names
          FROM chosen{K} SEMI JOIN weights USING (strategy, fold) GROUP BY 1, 2) c USING (strategy, fold)
    LEFT JOIN turns{tag} t USING (strategy, fold)
    LEFT JOIN (SELECT strategy, fold, product(1 + ret) - 1 AS net_return FROM port{tag} GROUP BY 1, 2) g
      USING (strategy, fold)""")


_ablation("")
_ablation("_o")
cte("regimes", "market", """
    SELECT *, CASE WHEN trailing_return > 0.05 THEN 'bull' WHEN trailing_return < -0.05 THEN 'bear'
                   ELSE 'sideway' END
              || CASE WHEN trailing_vol > vol_median THEN '_high_vol' ELSE '_low_vol' END AS regime
    FROM (SELECT *, CASE WHEN count(trailing_vol) OVER u >= 60
                         THEN quantile_cont(trailing_vol, 0.5) OVER u END AS vol_median
          FROM (SELECT *, CASE WHEN count(market_ret) OVER r = 60 THEN product(1 + market_ret) OVER r - 1 END
                            AS trailing_return,
                       CASE WHEN count(market_ret) OVER r = 60 THEN stddev_samp(market_ret) OVER r END
                            AS trailing_vol
                FROM market WINDOW r AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
          WINDOW u AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")


def _wealth(src: str, by: str) -> str:
    w = f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""(SELECT *, wealth / nullif(peak, 0) - 1 AS drawdown FROM (
      SELECT *, max(wealth) OVER {w} AS peak FROM (
        SELECT *, product(1 + ret) OVER {w} AS wealth FROM {src} WHERE ret IS NOT NULL)))"""


def _metrics(src: str, by: str) -> str:
    return f"""
    SELECT *, (annualized_return - {RF}) / nullif(annualized_volatility, 0) AS sharpe,
           (annualized_return - {RF}) / nullif(down, 0) AS sortino,
           annualized_return / nullif(abs(max_drawdown), 0) AS calmar
    FROM (SELECT *, w - 1 AS cumulative_return, power(w, {PERIODS}.0 / observations) - 1 AS annualized_return
          FROM (SELECT {by}, arg_max(wealth, date) AS w, count(*) AS observations,
                       stddev_samp(ret) * sqrt({PERIODS}) AS annualized_volatility,
                       stddev_samp(ret) FILTER (WHERE ret < 0) * sqrt({PERIODS}) AS down,
                       min(drawdown) AS max_drawdown,
                       avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS positive_day_ratio
                FROM {_wealth(src, by)} GROUP BY {by}))"""


cte("sector_daily", "rets master", """
    SELECT m.sector, r.date, avg(r.ret1) AS ret FROM rets r JOIN master m USING (ticker) GROUP BY 1, 2""")


def _resample(series: str, key: str, samples: int) -> str:
    """(key, replicate, x) from ``series`` (key, pos, x)."""
    start = _draw("n - 10 + 1", f"'{SEED}'", key, "replicate", "b")
    return f"""
    SELECT s.{key}, s.replicate, v.x
    FROM (SELECT {key}, replicate, {start} + o AS pos
          FROM (SELECT {key}, count(*) AS n FROM {series} GROUP BY 1 HAVING count(*) >= 20)
          CROSS JOIN range({samples}) r(replicate)
          CROSS JOIN LATERAL (SELECT unnest(range(CAST(ceil(n / 10.0) AS BIGINT))) AS b)
          CROSS JOIN range(10) t(o)
          WHERE b * 10 + o < n) s
    JOIN {series} v ON v.{key} = s.{key} AND v.pos = s.pos"""


def _tests(tag: str, diffs: str) -> None:
    cte(f"sample{tag}", diffs, _resample(diffs, "test", 500))
    cte(f"boot{tag}", f"{diffs} sample{tag}", f"""
    SELECT b.test, b.mean_difference, ci_low, ci_high, p_value
    FROM (SELECT test, avg(x) AS mean_difference FROM {diffs} GROUP BY 1) b
    LEFT JOIN (SELECT test, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high,
                      least(1.0, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0 END),
                                           avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0 END))) AS p_value
               FROM (SELECT test, replicate, avg(x) AS m FROM sample{tag} GROUP BY 1, 2) GROUP BY 1) s
      ON s.test = b.test""")
    cte(f"holm{tag}", f"boot{tag}", f"""
    SELECT b.*, h.p_value_holm,
           CASE WHEN h.p_value_holm IS NULL THEN 'insufficient_observations'
                WHEN h.p_value_holm < 0.05 THEN 'significant' ELSE 'not_significant' END AS conclusion
    FROM boot{tag} b LEFT JOIN (
      SELECT test, least(1.0, max((m - k + 1) * p_value) OVER (ORDER BY k)) AS p_value_holm
      FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, test) AS k
            FROM boot{tag} WHERE p_value IS NOT NULL)) h ON h.test = b.test""")


cte("diffs", "port", """
    SELECT 'adaptive_costed_vs_' || b.strategy AS test, a.ret - b.ret AS x,
           row_number() OVER (PARTITION BY b.strategy ORDER BY a.date) - 1 AS pos
    FROM (SELECT date, avg(ret) AS ret FROM port WHERE strategy = 'adaptive_costed' GROUP BY 1) a
    JOIN (SELECT strategy, date, avg(ret) AS ret FROM port WHERE strategy <> 'adaptive_costed'
          GROUP BY 1, 2) b ON a.date = b.date""")
cte("sector_diffs", "sector_daily market", """
    SELECT 'market_vs_' || s.sector AS test, m.market_ret - s.ret AS x,
           row_number() OVER (PARTITION BY s.sector ORDER BY s.date) - 1 AS pos
    FROM sector_daily s JOIN market m ON m.date = s.date
    WHERE s.ret IS NOT NULL AND m.market_ret IS NOT NULL""")
_tests("", "diffs")
_tests("_s", "sector_diffs")
cte("port_pos", "port", """
    SELECT strategy, ret AS x, row_number() OVER (PARTITION BY strategy ORDER BY fold, date) - 1 AS pos
    FROM port WHERE ret IS NOT NULL""")
cte("sharpe_sample", "port_pos", _resample("port_pos", "strategy", 300))
cte("labelled", "snap", "SELECT fold, ticker, signal, target_return_20d FROM snap")
cte("rank_pairs", "labelled", f"""
    SELECT fold, {_pct_rank('signal', 'fold')} AS rs, {_pct_rank('t', 'fold')} AS rt
    FROM (SELECT fold, signal, {_pct_rank('target_return_20d', 'fold')} AS t
          FROM labelled WHERE target_return_20d IS NOT NULL)""")
cte("ic", "rank_pairs", """
    SELECT fold, count(*) AS n, CASE WHEN count(*) > 2 THEN corr(rs, rt) END AS rank_ic
    FROM rank_pairs GROUP BY 1""")


def _resolve(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for dep in CTES[name][0]:
            if dep != name:
                visit(dep)
        seen.append(name)

    for n in names:
        visit(n)
    return seen


ORACLE_SQL: dict[str, str] = {}


def oracle(name: str, reads: str, body: str) -> None:
    """Register ``body`` (a table name or a SELECT) with its steps and shape."""
    parts = [f"{n} AS ({CTES[n][1]})" for n in _resolve(reads.split())]
    source = body if " " not in body.strip() else f"({body})"
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    ORACLE_SQL[name] = head + shaped_sql(source, SHAPES[name])


for _name, _table in {
    "panel_prices": "panel", "panel_master": "master", "panel_financials": "financials",
    "panel_macro": "macro", "feat_returns": "feat0", "feat_sma_ema": "feat", "feat_rsi": "feat0",
    "feat_macd": "feat", "feat_atr": "feat0", "feat_vol": "feat0", "feat_downside": "feat0",
    "feat_drawdown": "feat0", "feat_liquidity": "feat0", "feat_beta": "feat0",
    "feat_target_rank": "ranked", "market_return": "market", "return_outliers": "outliers",
    "fundamental_ratios": "fin_ratios", "merge_sources": "merged", "fold_manifest": "folds", "fold_manifest_last12": "folds_last12",
    "snapshots": "snap", "base_scores": "scores", "adaptive_selection": "adaptive",
    "topm_liquidity": "top_liquidity", "topm_signal": "top_signal", "topm_ewma": "top_ewma",
    "ewma_cov": "mom", "shrunk_cov": "shrink", "selection_matrix": "q",
    "subset_energies": f"energies{K}", "best_subset": f"best{K}",
    "allocate_weights": "allocated", "subset_random_search": "search0", "subset_gap": "runs", "turnover_equal": "turns",
    "trades_equal": "trades", "drift_equal": "drifted", "backtest_equal": "port",
    "ablation_equal": "ablation", "cardinality_cost_grid": "grid", "regimes": "regimes",
    "paired_bootstrap": "boot", "holm": "holm", "sector_bootstrap": "holm_s", "rank_ic": "ic",
}.items():
    oracle(_name, _table, _table)

oracle("panel_foreign_flow", "", """
    SELECT CAST(ts AS DATE) AS date, 'MARKET' AS ticker, CAST(ts AS DATE) AS available_at,
           sum(value) AS foreign_net_value, 'event_stream' AS source, 'real' AS data_class
    FROM events GROUP BY 1""")
oracle("panel_index_membership", "master", """
    SELECT ticker, sector AS index_code, listing_date AS effective_from,
           delisting_date AS effective_to, listing_date AS announcement_date, available_at,
           source, data_class FROM master""")
oracle("flagship_features_latest", "feat0", """
    SELECT * FROM feat0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""")
oracle("feat_all", "feat ranked fin_ratios policy", """
    SELECT f.*, k.target_rank, r.roe_pit, r.revenue_growth_yoy_pit, p.policy_rate_pit,
           f.date AS feature_available_at
    FROM feat f JOIN ranked k ON k.ticker = f.ticker AND k.date = f.date
    ASOF LEFT JOIN fin_ratios r ON r.ticker = f.ticker AND f.date >= r.available_at
    ASOF LEFT JOIN policy p ON f.date >= p.available_at""")
cte("issues", "tape outliers", f"""
    SELECT * FROM (
      SELECT 'error' AS severity, 'unique_date_ticker' AS "check", sum(n) AS count
      FROM (SELECT count(*) AS n FROM tape GROUP BY date, ticker HAVING count(*) > 1)
      UNION ALL SELECT 'error', 'ohlc_logic', count(*) FROM tape WHERE {_BAD}
      UNION ALL SELECT 'error', 'nonnegative_volume_value', count(*) FROM tape
                WHERE volume < 0 OR trading_value < 0
      UNION ALL SELECT 'error', 'available_before_observation', count(*) FROM tape
                WHERE available_at < date
      UNION ALL SELECT 'warning', 'return_outlier_flag', count(*) FROM outliers)
    WHERE count > 0""")
oracle("validate_issues", "issues", "issues")
for _name in ("coverage_year", "artifact_parquet"):
    oracle(_name, "tape", """
    SELECT ticker, year(date) AS year, source, data_class, count(*) AS records,
           min(date) AS start, max(date) AS "end",
           count(*) FILTER (WHERE close IS NULL) AS missing_close
    FROM tape GROUP BY 1, 2, 3, 4""")
oracle("coverage_ticker", "tape", """
    SELECT ticker, source, count(*) AS records, min(date) AS start, max(date) AS "end",
           max(date) - min(date) AS calendar_span_days,
           count(*) FILTER (WHERE open IS NULL) AS missing_open,
           count(*) FILTER (WHERE close IS NULL) AS missing_close,
           count(*) FILTER (WHERE close <= 0) AS nonpositive_close
    FROM tape GROUP BY 1, 2""")
oracle("dataset_summary", "tape", """
    SELECT count(*) AS records, count(DISTINCT ticker) AS tickers, min(date) AS start,
           max(date) AS "end", string_agg(DISTINCT data_class, '|' ORDER BY data_class) AS data_classes
    FROM tape""")
oracle("quarantine_rows", "tape", f"SELECT * FROM tape WHERE {_BAD}")
cte("checks", "tape financials", """
    SELECT "check", passed, bool_and(data_class = 'fixture') OVER () AS fixture_only FROM (
      SELECT 'current_universe_not_backfilled' AS "check", TRUE AS passed, 'real' AS data_class
      UNION ALL SELECT 'real_prices_only', NOT bool_or(data_class = 'fixture'), 'real' FROM tape
      UNION ALL SELECT 'auxiliary_tables_fixture_free', NOT bool_or(s_acctbal < 0), 'real'
                FROM financials JOIN supplier ON CAST(s_suppkey AS VARCHAR) = ticker
      UNION ALL SELECT 'corporate_action_timestamps', TRUE, 'real'
      UNION ALL SELECT 'available_at_not_after_decision_observation',
                       bool_and(available_at <= date), 'real' FROM tape)""")
oracle("leakage_checks", "checks", "checks")
cte("side_status", "financials macro", """
    SELECT 'financial_statements' AS "table", CASE WHEN bool_or(s_acctbal < 0) THEN 'fixture' ELSE 'real_or_empty' END AS status
    FROM financials JOIN supplier ON CAST(s_suppkey AS VARCHAR) = ticker
    UNION ALL SELECT 'macro', CASE WHEN bool_or(data_class = 'fixture') THEN 'fixture' ELSE 'real_or_empty' END FROM macro
    UNION ALL SELECT * FROM (VALUES ('index_membership', 'real_or_empty'), ('corporate_actions', 'real_or_empty'),
      ('foreign_flow', 'missing')) t("table", status)""")
oracle("side_table_status", "side_status", "side_status")
cte("quality_verdict", "tape issues", """
    SELECT CASE WHEN EXISTS (SELECT 1 FROM issues WHERE severity = 'error') THEN 'fail' ELSE 'pass' END AS status,
           count(*) AS records, count(DISTINCT ticker) AS tickers, min(date) AS start, max(date) AS "end",
           string_agg(DISTINCT data_class, '|' ORDER BY data_class) AS data_classes,
           coalesce((SELECT string_agg(severity || ':' || "check" || ':' || CAST(count AS BIGINT), '|' ORDER BY severity, "check") FROM issues), '')
             AS issues FROM tape""")
oracle("artifact_csv", "folds", "folds")
oracle("import_prices_good", "panel", """
    SELECT date, ticker, open, high, low, close, close AS adjusted_close, volume, volume * close AS trading_value,
           'tape' AS source, date AS available_at, 'real' AS data_class, TRUE AS has_checksum
    FROM panel WHERE volume % 11 <> 0 AND volume % 13 <> 0 AND volume % 17 <> 0 AND volume % 19 <> 0 AND volume % 23 <> 0""")
oracle("import_prices_rejected", "panel", """
    SELECT CASE WHEN volume % 11 = 0 THEN '2001-13-45' ELSE strftime(date, '%Y-%m-%d') END AS date,
           CASE WHEN volume % 13 <> 0 THEN ticker END AS ticker,
           CASE WHEN volume % 19 = 0 OR volume % 23 = 0 THEN 'malformed_line'
                ELSE concat_ws('|', CASE WHEN volume % 11 = 0 THEN 'bad_date:date' END,
                               CASE WHEN volume % 13 = 0 THEN 'missing:ticker' END,
                               CASE WHEN volume % 17 = 0 THEN 'bad_number:low' END) END AS reasons
    FROM panel WHERE volume % 11 = 0 OR volume % 13 = 0 OR volume % 17 = 0 OR volume % 19 = 0 OR volume % 23 = 0""")
oracle("import_financials", "financials", """
    SELECT 'csv' AS landed_as, * REPLACE (CASE WHEN day(publication_date) % 3 <> 0 THEN available_at END AS available_at) FROM financials
    UNION ALL SELECT 'parquet', * FROM financials""")
oracle("validation_verdict", "quality_verdict", "quality_verdict")
cte("audit", "checks side_status", """
    SELECT *, CASE WHEN fixture_only THEN 'pass_for_fixture_demo' WHEN blockers <> '' THEN 'blocked'
                   WHEN limitations <> '' THEN 'pass_with_limitations' ELSE 'pass' END AS status
    FROM (SELECT bool_or(fixture_only) AS fixture_only,
                 CASE WHEN bool_or(fixture_only) THEN ''
                      ELSE coalesce(string_agg("check", '|' ORDER BY "check") FILTER (WHERE NOT passed), '') END AS blockers,
                 (SELECT coalesce(string_agg("table" || '_not_configured', '|' ORDER BY "table") FILTER (WHERE status = 'missing'), '')
                  FROM side_status) AS limitations FROM checks)""")
oracle("audit_verdict", "audit", "audit")
oracle("run_gate", "quality_verdict audit", """
    SELECT mode, reason = '' AS allowed, reason FROM (
      SELECT mode, CASE WHEN q.status <> 'pass' THEN 'data_quality_failed' WHEN a.status = 'blocked' THEN 'leakage_audit_blocked'
                        WHEN mode = 'research' AND contains(q.data_classes, 'fixture') THEN 'research_refuses_fixtures' ELSE '' END AS reason
      FROM quality_verdict q, audit a, (VALUES ('demo'), ('research')) m(mode))""")
_marked = " || ".join(
    f"coalesce(length({t}) || ':' || {t}, '-')" for t in (
        "strftime(date, '%Y-%m-%d')", "ticker",
        *(f"CAST(CAST(floor({c} * 10000 + 0.5) AS BIGINT) AS VARCHAR)" for c in ("open", "high", "low", "close")),
        "CAST(volume AS VARCHAR)"))
_lane = "sum(('0x' || substr(h, {0}, 15))::BIGINT)::VARCHAR AS lane{1}"
oracle("fingerprint", "panel", f"""
    SELECT count(*) AS records, {", ".join(_lane.format(1 + 15 * i, i) for i in range(4))}
    FROM (SELECT sha256({_marked}) AS h FROM panel)""")
oracle("universe_monthly", "bars master", """
    SELECT a.d AS decision_time, m.ticker, TRUE AS eligible,
           'listed_and_available_point_in_time' AS reason, m.data_class
    FROM (SELECT DISTINCT last_day(date) AS d FROM bars) a JOIN master m
      ON m.listing_date <= a.d AND m.available_at <= a.d
     AND (m.delisting_date IS NULL OR m.delisting_date >= a.d)""")
oracle("month_end_closes", "bars", """
    SELECT ticker, last_day(date) AS month_end, arg_max(close, date) AS close FROM bars GROUP BY 1, 2""")
oracle("asof_financials", "panel fin_ratios", """
    SELECT p.ticker, p.date, p.close, r.roe_pit, r.revenue_growth_yoy_pit
    FROM panel p ASOF LEFT JOIN fin_ratios r ON r.ticker = p.ticker AND p.date >= r.available_at""")
oracle("asof_macro", "panel policy", """
    SELECT p.ticker, p.date, p.close, r.policy_rate_pit
    FROM panel p ASOF LEFT JOIN policy r ON p.date >= r.available_at""")
oracle("norm_feed_a", "bars", """
    SELECT *, close AS adjusted_close, 'feed_a' AS source, date AS available_at,
           'feed-a-v1' AS parser_version, 'real' AS data_class
    FROM (SELECT * REPLACE (volume * close AS trading_value) FROM bars)""")
oracle("norm_feed_b", "bars", f"""
    SELECT *, {_D_ADJ} AS adjusted_close, 'feed_b' AS source, date + 1 AS available_at,
           'feed-b-v1' AS parser_version, 'real' AS data_class
    FROM (SELECT * REPLACE (CASE WHEN open = close THEN volume * close ELSE trading_value END
                            AS trading_value) FROM bars)""")
oracle("norm_feed_c", "bars", _feed_c("bars"))
oracle("norm_feed_d", "bars", f"""
    SELECT *, {_D_ADJ} AS adjusted_close, 'feed_d' AS source, date + 1 AS available_at,
           'feed-d-v1' AS parser_version, 'real' AS data_class
    FROM (SELECT * REPLACE (volume * close AS trading_value) FROM bars)""")
oracle("norm_macro", "macro", """
    SELECT observation_date AS date, series_id, nullif(value, 0) AS value, 'macro_api' AS source,
           CASE WHEN series_id = 'POLICY_RATE' THEN release_date ELSE observation_date END AS available_at
    FROM macro""")
oracle("listing_filter", "", """
    SELECT upper(trim(s_name)) AS symbol, min(s_suppkey) AS position, arg_min(s_name, s_suppkey) AS name
    FROM supplier WHERE regexp_matches(upper(trim(s_name)), '^SUPPLIER#[0-9]{8}[0-4]$') GROUP BY 1""")
oracle("listing_first", "", """
    SELECT upper(s_name) AS symbol, s_suppkey AS position, s_name AS name
    FROM supplier WHERE s_suppkey % 10 < 5 ORDER BY s_suppkey LIMIT 7""")
oracle("listing_requested", "", """
    SELECT upper(s_name) AS symbol, s_suppkey AS position, s_name AS name
    FROM supplier WHERE s_suppkey IN (1, 3)""")
oracle("merge_quarantine", "served", f"SELECT * FROM served WHERE {_BAD}")
oracle("merged_master", "merged", """
    SELECT m.ticker, s_name AS company_name, 'TAPE' AS exchange, first AS listing_date,
           first AS effective_from, first AS available_at, source
    FROM (SELECT ticker, min(date) AS first, min(source) AS source FROM merged GROUP BY 1) m
    JOIN supplier ON CAST(s_suppkey AS VARCHAR) = m.ticker""")
oracle("crosscheck", "primary_feed fallback_feed", """
    SELECT ticker, count(*) AS overlap_rows, quantile_cont(e, 0.5) AS median_abs_pct_diff,
           avg(e) AS mean_abs_pct_diff
    FROM (SELECT a.ticker, abs(a.adjusted_close - b.adjusted_close) / nullif(abs(b.adjusted_close), 0) AS e
          FROM primary_feed a JOIN fallback_feed b ON a.ticker = b.ticker AND a.date = b.date)
    GROUP BY 1""")
oracle("source_counts", "served", """
    SELECT source, count(DISTINCT ticker) AS tickers FROM served GROUP BY 1""")
oracle("candidates_topn", "served", f"""
    SELECT *, "end" >= DATE '{REACHES}' AS ends_at_target
    FROM (SELECT ticker, source, count(*) AS records, min(date) AS start, max(date) AS "end"
          FROM served GROUP BY 1, 2)
    ORDER BY ends_at_target DESC, start, records DESC, ticker LIMIT 10""")
_fresh = ("(SELECT ticker, max(date) AS last_date FROM bars_f GROUP BY 1 "
          "HAVING max(date) >= (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) - 10)")
oracle("fresh_tickers", "bars_f", f"SELECT * FROM {_fresh}")
oracle("stale_rows", "bars_f bars_o",
       f"SELECT * FROM bars_o WHERE ticker NOT IN (SELECT ticker FROM {_fresh})")
oracle("run_ledger", "primary_feed", """
    SELECT 'feed_d' AS source, CASE WHEN asked > got THEN 'partial' ELSE 'success' END AS status,
           records, asked AS tickers_requested, got AS tickers_collected, asked - got AS failures,
           date_start, date_end
    FROM (SELECT count(*) AS records, count(DISTINCT ticker) AS got, min(date) AS date_start,
                 max(date) AS date_end, (SELECT count(*) FROM supplier) AS asked FROM primary_feed)""")
oracle("incremental_ingest", "primary_feed fallback_feed", """
    SELECT * FROM primary_feed
    UNION ALL
    SELECT * FROM fallback_feed f WHERE NOT EXISTS
      (SELECT 1 FROM primary_feed p WHERE p.ticker = f.ticker AND p.date = f.date)""")
oracle("fold_counts", "folds panel", """
    SELECT f.fold, r.role, count(*) AS records, count(DISTINCT p.date) AS dates,
           count(DISTINCT p.ticker) AS tickers
    FROM panel p CROSS JOIN (VALUES ('train'), ('validation'), ('test')) r(role) JOIN folds f
      ON (role = 'train' AND p.date >= train_start AND p.date < train_end)
      OR (role = 'validation' AND p.date >= train_end AND p.date < validation_end)
      OR (role = 'test' AND p.date > test_start AND p.date <= test_end)
    GROUP BY 1, 2""")
oracle("selection_trace", "adaptive", "SELECT *, pick + 1 AS round FROM adaptive WHERE selected_candidate")
oracle("corr_to_chosen", "corrs adaptive", """
    SELECT c.* FROM corrs c JOIN adaptive a ON a.fold = c.fold AND a.ticker = c.other WHERE a.selected_candidate""")
oracle("ewma_mean", "mom", "SELECT * FROM mom WHERE i = j")
oracle("method_comparison", "runs", """
    SELECT method, avg(energy) AS energy_mean, avg(feasibility_rate) AS feasibility_rate,
           avg(optimality_gap) AS optimality_gap_mean, count(*) AS runs FROM runs GROUP BY 1""")
oracle("instances_json", "q pools decisions", f"""
    SELECT q.*, d.decision_time, p.cardinality, p.tickers
    FROM (SELECT strategy, fold, sum(mu) FILTER (WHERE i = j) AS mu_sum, sum(cov) AS cov_sum,
                 sum(q) AS q_sum FROM q GROUP BY 1, 2) q
    JOIN (SELECT strategy, fold, least({K}, count(*)) AS cardinality,
                 string_agg(ticker, '|' ORDER BY idx) AS tickers FROM pools GROUP BY 1, 2) p
      USING (strategy, fold)
    JOIN decisions d USING (fold)""")
for _name, _tag in (("ablation_summary_equal", ""), ("ablation_summary", "_o")):
    oracle(_name, f"ablation{_tag}", f"""
    SELECT configuration, selector, solver, count(DISTINCT fold) AS folds,
           avg(objective) AS objective_mean, avg(feasibility_rate) AS feasibility_rate,
           avg(optimality_gap) AS optimality_gap, avg(turnover) AS turnover_mean,
           sum(transaction_cost) AS transaction_cost
    FROM ablation{_tag} GROUP BY 1, 2, 3""")
oracle("fold_status", "fold_status", "fold_status")
oracle("run_summary", "fold_status", """
    SELECT strategy, count(*) AS folds_requested, count(*) FILTER (WHERE stage = 'completed') AS folds_completed,
           coalesce(string_agg(DISTINCT stage, '|' ORDER BY stage) FILTER (WHERE stage <> 'completed'), '') AS stopped
    FROM fold_status GROUP BY 1""")
oracle("backtest_optimised", "port_o port_peer", "SELECT * FROM port_o UNION ALL SELECT * FROM port_peer")
for _name, _by in (("sensitivity_summary", "cardinality, transaction_cost_bps"), ("sensitivity_by_cost", "transaction_cost_bps")):
    oracle(_name, "grid", f"""
    SELECT {_by}, avg(net_return) AS net_return_mean,
           avg(gross_return) AS gross_return_mean, avg(turnover) AS turnover_mean, count(*) AS cases
    FROM grid GROUP BY {_by}""")
oracle("performance_metrics", "port", _metrics("port", "strategy"))
oracle("market_metrics", "sector_daily", _metrics("sector_daily", "sector"))
oracle("wealth_curve", "port", f"SELECT * FROM {_wealth('port', 'strategy')}")
oracle("returns_pivot", "port", "SELECT date, " + ", ".join(
    f"avg(ret) FILTER (WHERE strategy = '{s}') AS {s}" for s in STRATEGIES
) + " FROM port GROUP BY 1")
oracle("metrics_by_regime", "port regimes", _metrics(
    "(SELECT p.*, r.regime FROM port p LEFT JOIN regimes r ON r.date = p.date)", "strategy, regime"))
oracle("sharpe_ci", "sharpe_sample port_pos", f"""
    SELECT k.strategy, sharpe_ci_low, sharpe_ci_high
    FROM (SELECT DISTINCT strategy FROM port_pos) k LEFT JOIN (
      SELECT strategy, quantile_cont(v, 0.025) AS sharpe_ci_low, quantile_cont(v, 0.975) AS sharpe_ci_high
      FROM (SELECT strategy, replicate,
                   (avg(x) * {PERIODS} - {RF}) / nullif(stddev_samp(x) * sqrt({PERIODS}), 0) AS v
            FROM sharpe_sample GROUP BY 1, 2) GROUP BY 1) s ON s.strategy = k.strategy""")
oracle("rank_ic_summary", "ic", """
    SELECT count(*) AS folds, avg(rank_ic) AS mean_ic, quantile_cont(rank_ic, 0.5) AS median_ic,
           min(rank_ic) AS min_ic, max(rank_ic) AS max_ic FROM ic""")

"""Cutting the universe to a few candidates per fold."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pitpanel.functions.ranks import with_zscores
from pitpanel.operators.folds import WalkForward
from pitpanel.session import cut_lineage, dim, store


@dataclass(frozen=True)
class Reduction:
    candidate_size: int = 6
    budget: int = 6
    cardinality: int = 3
    signal_weight: float = 0.55
    liquidity_weight: float = 0.20
    risk_weight: float = 0.15
    correlation_penalty: float = 0.10
    lookback: int = 120

    @property
    def rounds(self) -> int:
        return min(self.candidate_size, self.budget)


def linear_signal() -> Column:
    """A fitted-model-free signal: momentum less risk."""
    return (
        0.5 * F.col("return_60d")
        + 0.3 * F.col("return_20d")
        - 0.2 * F.col("volatility_20d")
    )


def base_scores(snapshot: DataFrame, cfg: Reduction, folds: int | None = None) -> DataFrame:
    """Weighted z-scores of signal, liquidity and (negatively) risk per fold."""
    z = with_zscores(
        snapshot,
        ["fold"],
        {"signal": "signal_z", "liquidity_20d": "liquidity_z", "volatility_20d": "risk_z"},
        folds,
    )
    score = (
        cfg.signal_weight * F.col("signal_z")
        + cfg.liquidity_weight * F.col("liquidity_z")
        - cfg.risk_weight * F.col("risk_z")
    )
    return z.withColumn("base_score", score)


# tasks get this module's functions themselves: executors need not be able to import the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tickers whose returns are held as one matrix.
SLICE = 512


def _numbered(window: DataFrame) -> DataFrame:
    """(date, at): the distinct dates of all windows in order; as long as the calendar."""
    order = Window.orderBy("date")
    return cut_lineage(window.select("date").distinct().withColumn("at", (F.row_number().over(order) - 1).cast("int")))


def _series(returns: DataFrame, numbered: DataFrame, bound: int | None) -> DataFrame:
    """(ticker, at, ret): one row per ticker, its returns on the numbered dates as arrays.

    ``returns`` may lie as one row per ticker already (``decision_features.histories``): no shuffle then.
    """
    if isinstance(returns.schema["date"].dataType, ArrayType):
        return _placed(returns, numbered)
    known = returns.select("ticker", "date", "ret1").join(dim(numbered, bound, 16), "date")
    listed = known.groupBy("ticker").agg(F.collect_list(F.struct("at", "ret1")).alias("_s"))
    return listed.select("ticker", F.col("_s.at").alias("at"), F.col("_s.ret1").alias("ret"))


def _placed(history: DataFrame, numbered: DataFrame) -> DataFrame:
    """As ``_series``, from one row of arrays per ticker; ``numbered`` is as long as the calendar."""
    days = numbered.select(F.unix_date("date").alias("d"), "at").where("d IS NOT NULL").orderBy("d").toArrow()
    sent = history.sparkSession.sparkContext.broadcast((days["d"].to_numpy(), days["at"].to_numpy()))

    def run(it):
        known, place = sent.value
        for batch in it:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                lists = part.column(1)
                owner = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                day = pc.fill_null(lists.flatten().cast(pa.int32()), -(1 << 31)).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(np.isin(day, known))
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(owner[keep], minlength=part.num_rows))], pa.int32())
                at = pa.array(place[np.searchsorted(known, day[keep])], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.ListArray.from_arrays(ends, at),
                    pa.ListArray.from_arrays(ends, part.column(2).flatten().take(pa.array(keep))),
                ], ["ticker", "at", "ret"])

    return history.select("ticker", "date", "ret1").mapInArrow(run, "ticker string, at array<int>, ret array<double>")


def _positions(window: DataFrame, numbered: DataFrame) -> dict[int, np.ndarray]:
    """Numbers of each fold's dates: folds x lookback integers."""
    rows = window.join(numbered, "date").groupBy("fold").agg(F.sort_array(F.collect_list("at")).alias("at")).collect()
    return {r["fold"]: np.array(r["at"], np.int64) for r in rows}


def _matrix(at: pa.Array, ret: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Returns of a slice of tickers by date number, where they are known, and where there is a row."""
    rows = np.repeat(np.arange(len(at)), pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False))
    cols, values = at.flatten().to_numpy(zero_copy_only=False), ret.flatten()
    x, known, seen = np.zeros((len(at), width)), np.zeros((len(at), width), bool), np.zeros((len(at), width), bool)
    x[rows, cols] = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
    known[rows, cols] = pc.is_valid(values).to_numpy(zero_copy_only=False)
    seen[rows, cols] = True
    return x, known, seen


def _centred(x: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Rows less their mean over ``both``, 0 elsewhere; taken from a value of the row first, so that equal values give 0."""
    first = np.take_along_axis(x, both.argmax(1)[:, None], 1)
    x = np.where(both, x - first, 0.0)
    return np.where(both, x - (x.sum(1) / np.maximum(both.sum(1), 1))[:, None], 0.0)


def correlations(x: np.ndarray, known: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Pairwise complete correlation of every row of ``x`` with each of ``others`` (values, known); undefined ones are 0.

    Rows are summed one by one, so equal rows get equal results wherever they lie.
    """
    out, whole = [], known.all(1)
    with np.errstate(all="ignore"):
        plain = _centred(x[whole], known[whole])
        spread = (plain * plain).sum(1)
        for y, y_known in others:
            corr = np.zeros(len(x))
            rest = np.ones(len(x), bool)
            if y_known.all():
                c = _centred(y[None], y_known[None])
                corr[whole] = (plain * c).sum(1) / np.sqrt(spread * (c * c).sum())
                rest = ~whole
            if rest.any():
                both = known[rest] & y_known
                a, b = _centred(x[rest], both), _centred(np.broadcast_to(y, both.shape), both)
                corr[rest] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
            out.append(np.where(np.isfinite(corr), corr, 0.0))
    return out


def correlation_to(
    returns: DataFrame, chosen: DataFrame, window: DataFrame, bound: int | None = None
) -> DataFrame:
    """(fold, ticker, other, corr) of every ticker with each chosen one.

    Only columns of chosen tickers are formed, never all pairs. A ticker's returns become one row
    of arrays; the chosen series (folds x chosen x lookback numbers) go to every task, which
    correlates its tickers by blocks of them. Pairwise complete; an undefined
    correlation is 0. Pairs without a common date in the fold's window have no row.
    ``bound`` is an upper bound on the number of dates and folds, if the caller has one.
    """
    spark = returns.sparkSession
    numbered = _numbered(window)
    series = _series(returns, numbered, bound)
    places = _positions(window, numbered)
    width = 1 + max((int(p.max()) for p in places.values()), default=0)
    wanted = chosen.select("fold", F.col("ticker").alias("other")).distinct()
    found = series.join(F.broadcast(wanted), F.col("ticker") == F.col("other")).orderBy("fold", "other").collect()
    pairs = []  # (fold, other, values, known, seen) by date number
    for r in found:
        if r["fold"] in places:
            y = _matrix(pa.array([r["at"]], pa.list_(pa.int32())), pa.array([r["ret"]], pa.list_(pa.float64())), width)
            pairs.append((r["fold"], r["other"], *(m[0, places[r["fold"]]] for m in y)))
    sent = spark.sparkContext.broadcast((places, [(p[0], *p[2:]) for p in pairs]))

    def run(it):
        windows, asked = sent.value
        folds: dict[int, list] = {}
        for k, (fold, *y) in enumerate(asked):
            folds.setdefault(fold, []).append((k, *y))
        for batch in it:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                x, known, seen = _matrix(part.column(1), part.column(2), width)
                out, common = np.zeros((part.num_rows, len(asked))), np.zeros((part.num_rows, len(asked)), bool)
                for fold, ys in folds.items():
                    at = windows[fold]
                    got = correlations(x[:, at], known[:, at], [(y, y_known) for _, y, y_known, _ in ys])
                    for (k, _, _, y_seen), c in zip(ys, got, strict=True):
                        out[:, k], common[:, k] = c, (seen[:, at] & y_seen).any(1)
                values = pa.array(out.ravel(), mask=~common.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(asked), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["ticker", "corr"])

    rows = series.mapInArrow(run, "ticker string, corr array<double>")
    fold_type = chosen.schema["fold"].dataType.simpleString()
    names = spark.createDataFrame([(k, p[0], p[1]) for k, p in enumerate(pairs)], f"k int, fold {fold_type}, other string")
    return rows.select("ticker", F.posexplode("corr").alias("k", "corr")).where("corr IS NOT NULL").join(
        F.broadcast(names), "k"
    ).select("fold", "ticker", "other", "corr")


def _best_of(tickers: np.ndarray, score: np.ndarray, known: np.ndarray) -> int:
    """Index of the best row in Spark's order of (-score, ticker): unknown first, not-a-number last."""
    group = np.where(~known, 0, np.where(np.isnan(score), 2, 1))
    rows = np.flatnonzero(group == group.min())
    if group[rows[0]] == 1:
        rows = rows[score[rows] == score[rows].max()]
    return min(rows, key=lambda r: tickers[r])


def _able(scored: DataFrame, cfg: Reduction, bound: int | None) -> DataFrame:
    """Rows that a greedy round could pick; no other row can be.

    A round charges between nothing and the whole penalty. So it never picks a row more than the penalty
    below the fold's ``rounds``-th best base score: of the rows down to that one some are still
    unpicked, and each beats it whatever it is charged. Scores that are unknown or no numbers stay.
    """
    slack = abs(cfg.correlation_penalty) * (1 + 1e-6) + 1e-9  # correlations are rounded
    # scores that are no numbers come first in this order: the bound is taken over the others
    known = scored.where(F.col("base_score").isNotNull() & ~F.isnan("base_score"))
    last = top_by(known.select("fold", "ticker", "base_score"), "base_score", cfg.rounds).where(F.col("idx") == cfg.rounds - 1)
    least = last.select("fold", (F.col("base_score") - slack).alias("_least"))
    rows = scored.join(dim(least, bound, 16), "fold", "left")
    return rows.where(
        F.col("_least").isNull() | F.col("base_score").isNull() | F.isnan("base_score") | (F.col("base_score") >= F.col("_least"))
    ).drop("_least")


def adaptive_reduce(
    snapshot: DataFrame,
    returns: DataFrame,
    window: DataFrame,
    cfg: Reduction,
    wf: WalkForward,
) -> DataFrame:
    """Greedy selection, all folds at once.

    ``snapshot``: (fold, decision_time, ticker, signal, liquidity_20d,
    volatility_20d). ``returns``: (ticker, date, ret1), or one row per ticker. ``window``: (fold, date),
    the lookback dates of each fold.

    Each round takes the best ticker per fold (ties to the lower ticker), then charges every
    other ticker its absolute correlation with it. A ticker's scores and returns are one stored
    row of arrays (calendar-sized). A round is one pass over these rows: each task knows the series picked
    so far (folds x picks x lookback numbers), and gives its best ticker per fold.
    """
    spark, bound = snapshot.sparkSession, wf.fold_bound
    scored = cut_lineage(base_scores(snapshot, cfg, bound).select("fold", "decision_time", "ticker", "base_score"))
    numbered = _numbered(window)
    places = _positions(window, numbered)
    width = 1 + max((int(p.max()) for p in places.values()), default=0)
    listed = _able(scored, cfg, bound).groupBy("ticker").agg(F.collect_list(F.struct("fold", "base_score")).alias("_b"))
    bases = store(listed.select(
        "ticker", F.col("_b.fold").cast("array<int>").alias("folds"), F.col("_b.base_score").alias("base")
    ), "bases")
    known = returns.join(bases.select("ticker"), "ticker", "left_semi")
    history = _series(known, numbered, None if bound is None else bound * cfg.lookback)
    profiles = store(bases.join(history, "ticker", "left"), "profiles")
    picked: list[tuple] = []  # (fold, ticker, pick, pick_score): a row per fold and round
    asked: dict[int, list[tuple]] = {}
    for i in range(cfg.rounds):
        gone: dict[int, list[str]] = {}
        for fold, ticker, *_ in picked:
            gone.setdefault(fold, []).append(ticker)
        sent = spark.sparkContext.broadcast((places, asked, gone))
        best = profiles.mapInArrow(
            _round_of(sent, width, cfg.correlation_penalty, max(i, 1)), "fold int, ticker string, s double"
        ).groupBy("fold").agg(F.min_by(F.struct("ticker", "s"), F.struct(-F.col("s"), F.col("ticker"))).alias("b"))
        new = [(r["fold"], r["b"]["ticker"], i, r["b"]["s"]) for r in best.collect()]  # a row per fold
        picked += new
        if new and i + 1 < cfg.rounds:
            wanted = spark.createDataFrame([r[:2] for r in new], "_fold int, _ticker string")
            rows = profiles.join(F.broadcast(wanted), F.col("ticker") == F.col("_ticker")).select("_fold", "at", "ret").collect()
            for r in rows:
                if r["_fold"] in places and r["at"]:
                    y = _matrix(pa.array([r["at"]], pa.list_(pa.int32())), pa.array([r["ret"]], pa.list_(pa.float64())), width)
                    asked.setdefault(r["_fold"], []).append(tuple(m[0, places[r["_fold"]]] for m in y[:2]))
    chosen = spark.createDataFrame(picked, "_fold int, _ticker string, pick int, pick_score double")
    state = scored.join(
        F.broadcast(chosen), (F.col("fold") == F.col("_fold")) & (F.col("ticker") == F.col("_ticker")), "left"
    )
    selected = F.col("pick").isNotNull()
    reason = F.when(selected, "selected_by_signal_liquidity_risk_and_correlation").otherwise(
        "outside_budget"
    )
    return state.select(
        "fold",
        "decision_time",
        "ticker",
        "base_score",
        selected.alias("selected_candidate"),
        reason.alias("decision_reason"),
        "pick",
        "pick_score",
    )


def _round_of(sent, width: int, weight: float, picks: int):
    """The best ticker per fold of each task's profiles, given the series picked before."""

    def run(it):
        windows, asked, gone = sent.value
        best: dict[int, list[tuple]] = {}
        for batch in it:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                names = np.array(part.column(0).to_pylist(), object)
                x, known, _ = _matrix(part.column(3), part.column(4), width)
                owner = np.repeat(np.arange(len(names)), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
                folds, base = part.column(1).flatten().to_numpy(zero_copy_only=False), part.column(2).flatten()
                given, base = pc.is_valid(base).to_numpy(zero_copy_only=False), pc.fill_null(base, 0.0).to_numpy(zero_copy_only=False)
                for fold in np.unique(folds):
                    at = np.flatnonzero(folds == fold)
                    if fold in gone:
                        at = at[~np.isin(names[owner[at]], gone[fold])]
                    if not len(at):
                        continue
                    rows, penalty = owner[at], np.zeros(len(at))
                    if fold in asked:
                        span = np.ix_(rows, windows[fold])
                        for c in correlations(x[span], known[span], asked[fold]):
                            penalty += np.abs(c)
                    score = base[at] - weight * (penalty / picks)
                    b = _best_of(names[rows], score, given[at])
                    best.setdefault(int(fold), []).append((names[rows[b]], float(score[b]) if given[at[b]] else None))
        out = [(f, *r) for f, found in best.items() for r in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in out], t) for n, t in enumerate((pa.int32(), pa.string(), pa.float64()))], ["fold", "ticker", "s"]
        )

    return run


def top_by(snapshot: DataFrame, column: str, m: int, by: str = "fold") -> DataFrame:
    """Top ``m`` tickers per fold, ties to the lower ticker.

    The bound is on the bare row number, so Spark keeps ``m`` rows per fold in each
    map task before the shuffle.
    """
    w = Window.partitionBy(by).orderBy(F.col(column).desc(), "ticker")
    ranked = snapshot.where(F.col(column).isNotNull()).withColumn("_rn", F.row_number().over(w))
    return ranked.where(F.col("_rn") <= m).withColumn("idx", F.col("_rn") - 1).drop("_rn")


def ewma_scores(
    returns: DataFrame, window: DataFrame, span: int = 60, bound: int | None = None
) -> DataFrame:
    """(fold, ticker, score): last value of the EMA of returns over the window.

    ``window``: (fold, date, age), for each fold a run of dates of the calendar. Across a gap of
    g dates the old weight decays to ``(1-a)^g`` and the update is renormalised.

    Every ticker's average is formed once, over its whole history, from one row of arrays per ticker.
    One that starts at row ``i`` of the history differs from it at row ``t`` by the weight that the rows
    before ``i`` still have: ``E(t) - exp(decay(i) - decay(t)) (E(i) - x(i))``. So a fold needs the first
    and the last known row of its window only, whatever the window's length.
    """
    spark = returns.sparkSession
    numbered = _numbered(window)
    ends = window.join(numbered, "date").groupBy("fold").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect()  # a row per fold
    sent = spark.sparkContext.broadcast([(r["fold"], r["lo"], r["hi"]) for r in ends])
    width = 1 + max((r["hi"] for r in ends), default=0)
    series = _series(returns, numbered, None if bound is None else bound * 64)

    def run(it):
        folds = sent.value
        for batch in it:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                x, known, _ = _matrix(part.column(1), part.column(2), width)
                level, decay, first, last = _averages(x.T, known.T, span)
                # one list per ticker, a value per fold
                out, some, each = np.zeros((part.num_rows, len(folds))), np.zeros((part.num_rows, len(folds)), bool), np.arange(part.num_rows)
                for k, (_, lo, hi) in enumerate(folds):
                    i, t = first[lo], last[hi]
                    some[:, k] = (i <= hi) & (t >= lo)
                    i, t = np.minimum(i, width - 1), np.maximum(t, 0)
                    excess = level[i, each] - x[each, i]
                    out[:, k] = level[t, each] - np.exp(np.minimum(decay[i, each] - decay[t, each], 0.0)) * excess
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(part.num_rows + 1) * len(folds), pa.int32()), pa.array(out.ravel(), mask=~some.ravel())
                )
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["ticker", "scores"])

    rows = series.mapInArrow(run, "ticker string, scores array<double>")
    fold_type = window.schema["fold"].dataType.simpleString()
    names = spark.createDataFrame([(k, r["fold"]) for k, r in enumerate(ends)], f"k int, fold {fold_type}")
    return rows.select("ticker", F.posexplode("scores").alias("k", "score")).where("score IS NOT NULL").join(
        F.broadcast(names), "k"
    ).select("fold", "ticker", "score")


def _averages(x: np.ndarray, known: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By (date number, ticker): the running average, its decay so far, the next known date and the last known one."""
    width, new = len(x), 2.0 / (span + 1.0)
    level, decay, last = np.zeros(x.shape), np.zeros(x.shape), np.full(x.shape, -1)
    now, lost, before = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.full(x.shape[1], -1)
    for t in range(width):
        old = (1.0 - new) ** (t - before)
        share = np.where(before < 0, 1.0, new / (old + new))
        here = known[t]
        now = np.where(here, np.where(before < 0, x[t], (1 - share) * now + share * x[t]), now)
        lost = np.where(here & (before >= 0), lost - np.log(old / (old + new)), lost)
        before = np.where(here, t, before)
        level[t], decay[t], last[t] = now, lost, before
    first, after = np.zeros(x.shape, int), np.full(x.shape[1], width)
    for t in range(width - 1, -1, -1):
        after = np.where(known[t], t, after)
        first[t] = after
    return level, decay, first, last

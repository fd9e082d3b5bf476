"""Ranking assets per fold with boosted regression trees, all folds together.

Medians for imputation and row counts of all folds come from one grouped aggregate. Folds that
overlap share their rows: a row is stored once, each feature as its place among the split
candidates of all folds. A level of a tree is one Spark job for all folds: tasks add up residuals
by (fold, node, feature, bin) of the rows they read, and a fold's sums, whose size does not
depend on its rows, give its best splits. So the number of jobs is trees x depth, however many folds there
are. A fold's trees are those that Spark ML's regressor grows on its rows (``fit_ranker``); where a fold has more rows
than Spark ML looks at for split candidates, the sample is another one of the same size. The models of all
folds become one table of arrays, so that the snapshots of all folds are scored in one pass.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.contracts import FEATURES
from pitpanel.functions.ranks import with_average_rank
from pitpanel.operators.folds import fold_dates
from pitpanel.session import dim, store

# tasks get this module's functions themselves: executors need not be able to import the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Training rows of one partition.
TASK_ROWS = 100_000
#: Rank error of a median is at most one part in so many of the rows.
MEDIAN_ACCURACY = 10_000
#: Bins of a feature, and rows at least that split candidates are looked for in, as Spark ML has them.
BINS, CANDIDATE_ROWS = 32, 10_000
#: Rows of one Arrow batch.
BATCH = 16_384
MODEL = (
    "fold int, fill array<double>, depth int, tree_weights array<double>, split_features array<int>, "
    "thresholds array<double>, leaves array<double>"
)


@dataclass(frozen=True)
class RankerConfig:
    trees: int = 40
    depth: int = 3
    step: float = 0.05
    seed: int = 42


def training_rows(features: DataFrame, fold) -> DataFrame:
    """Rows of one fold's training window ``[train_start, train_end)``."""
    return features.where(
        (F.col("date") >= F.lit(fold.train_start)) & (F.col("date") < F.lit(fold.train_end))
    )


def fold_medians(features: DataFrame, folds: DataFrame, names: list[str], bound: int | None = None) -> DataFrame:
    """(fold, train_rows, one median per feature) over labelled training rows; a feature without values is 0.

    Medians are approximate (``MEDIAN_ACCURACY``), so a fold's state is bounded.
    """
    days = fold_dates(folds).where("role = 'train'").select("fold", "date")
    rows = features.where(F.col("target_rank").isNotNull()).select("date", *names)
    middle = [F.coalesce(F.percentile_approx(n, 0.5, MEDIAN_ACCURACY), F.lit(0.0)).cast("double").alias(n) for n in names]
    return rows.join(dim(days, bound, 16), "date").groupBy("fold").agg(F.count(F.lit(1)).alias("train_rows"), *middle)


def fit_ranker(train: DataFrame, fill: dict[str, float], cfg: RankerConfig, names: list[str], rows: int) -> GBTRegressionModel:
    """Impute and boost on the label rank; only training rows are used. Trees need no scaling."""
    usable = train.where(F.col("target_rank").isNotNull()).select(*names, "target_rank").fillna(fill)
    packed = VectorAssembler(inputCols=names, outputCol="_x").transform(usable).select("_x", "target_rank")
    boosted = GBTRegressor(
        featuresCol="_x", labelCol="target_rank", maxIter=cfg.trees, maxDepth=cfg.depth, stepSize=cfg.step, seed=cfg.seed
    )
    return boosted.fit(packed.coalesce(max(1, -(-rows // TASK_ROWS))))


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Split candidates of one feature: midpoints of neighbouring values, at equal shares of the rows if these are too many."""
    value, count = np.unique(values, return_counts=True)
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) <= bins - 1:
        return middle
    stride, seen = len(values) / bins, np.cumsum(count)
    # a value is the last below a cut if the next one is farther from the share asked for
    ends, out, target, i = seen[:-1] + seen[1:], [], stride, 0
    while True:
        # the place by halves, then by the distances themselves, lest rounding decide
        i = max(i, int(np.searchsorted(ends, 2 * target, "right")) - 1)
        while i < len(middle) and not abs(seen[i] - target) < abs(seen[i + 1] - target):
            i += 1
        if i >= len(middle):
            return np.array(out)
        out.append(middle[i])
        target, i = target + stride, i + 1


def candidates(rows: DataFrame, days: DataFrame, known: list, names: list[str], bound: int | None) -> dict[int, list[np.ndarray]]:
    """Split candidates of each fold and feature, of about ``CANDIDATE_ROWS`` rows a fold (all, if fewer)."""
    fills, sizes = {f["fold"]: [f[n] for n in names] for f in known}, {f["fold"]: f["train_rows"] for f in known}
    share = rows.sparkSession.createDataFrame([(f, min(1.0, max(BINS**2, CANDIDATE_ROWS) / n)) for f, n in sizes.items()], "fold int, share double")
    drawn = F.pmod(F.xxhash64("fold", "date", "_in"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = rows.join(dim(days, bound, 16), "date").join(dim(share, bound, 16), "fold").where(drawn).select("fold", "_in")

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        fold = key[0].as_py()
        x = matrix(table.column("_in").combine_chunks(), len(names))
        bins = min(BINS, sizes[fold])
        found = [cuts_of(np.where(np.isnan(c), fill, c), bins).tolist() for c, fill in zip(x, fills[fold], strict=True)]
        return pa.table({"fold": pa.array([fold], pa.int32()), "cuts": pa.array([found], pa.list_(pa.list_(pa.float64())))})

    got = sample.groupBy("fold").applyInArrow(cut, "fold int, cuts array<array<double>>").collect()
    return {r["fold"]: [np.array(c) for c in r["cuts"]] for r in got}


def matrix(column, width: int) -> np.ndarray:
    """One row per feature of a column of arrays without NULL; NULL elements are NaN."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width).T)


def coded(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """``(day, y, codes)``: the places of a row's features among all folds' candidates, -1 if missing; by day within a part."""

    def code(it):
        for batch in it:
            x = matrix(batch.column(2), len(edges))
            places = np.stack([np.where(np.isnan(c), -1, np.searchsorted(e, c, "left")) for c, e in zip(x, edges, strict=True)], 1)
            flat = pa.array(places.astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(edges), dtype=np.int32), flat),
            ], ["day", "y", "codes"])

    slim = rows.select(F.unix_date("date").alias("day"), F.col("target_rank").cast("double").alias("y"), "_in")
    return store(slim.mapInArrow(code, "day int, y double, codes array<int>").sortWithinPartitions("day"), "codes")


@dataclass
class Trees:
    """Trees of one fold in heap order: a row goes left if the bin of ``feature`` is at most ``split``."""

    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    weight: np.ndarray

    def place(self, bins: np.ndarray, t: int, depth: int) -> np.ndarray:
        """Place of each row among the nodes of the level ``depth`` of tree ``t``."""
        at, first = np.zeros(bins.shape[1], np.int64), 0
        for d in range(depth):
            right = [bins[self.feature[t, k]] > self.split[t, k] for k in range(first, first + 2**d)]
            at = 2 * at + (right[0] if d == 0 else np.choose(at, right) if d < 6 else np.array(right)[at, np.arange(len(at))])
            first += 2**d
        return at

    def residual(self, bins: np.ndarray, y: np.ndarray, t: int, depth: int) -> np.ndarray:
        """What tree ``t`` is fitted to: the label, then twice what the trees before it leave of it."""
        if t == 0:
            return y
        guess = np.zeros(len(y))
        for k in range(t):
            guess += self.weight[k] * self.leaf[k, self.place(bins, k, depth)]
        return 2 * (y - guess)


def best_splits(n: np.ndarray, s: np.ndarray, able: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node, of counts and sums ``(node, feature, bin)``: feature (-1: none), split, and means left, right and of all."""
    left_n, left_s = n.cumsum(2)[:, :, :-1], s.cumsum(2)[:, :, :-1]
    all_n, all_s = n[:, :1].sum(2, keepdims=True), s[:, :1].sum(2, keepdims=True)
    right_n, right_s = all_n - left_n, all_s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_n + right_s**2 / right_n - all_s**2 / all_n
        gain = np.where((left_n > 0) & (right_n > 0) & able, gain, -np.inf).reshape(len(n), -1)
        best = gain.argmax(1)
        node, feature, split = np.arange(len(n)), best // able.shape[1], best % able.shape[1]
        means = [(a / b)[node, feature, split] for a, b in ((left_s, left_n), (right_s, right_n))]
        mean = (all_s / all_n)[:, 0, 0]
    return np.where(gain[node, best] > 0, feature, -1), split, *means, mean


def fit_all(codes: DataFrame, known: list, cuts: dict[int, list[np.ndarray]], edges: list[np.ndarray], fills: dict, cfg: RankerConfig) -> dict[int, Trees]:
    """Trees of every fold, a level of all folds at a time; the driver holds trees and candidates alone."""
    spark, width, inner = codes.sparkSession, len(edges), 2**cfg.depth - 1
    wide = max(map(len, edges)) + 2
    lookup = {}
    for fold, by_feature in cuts.items():
        bins = np.zeros((width, wide), np.uint8)
        for j, (mine, every) in enumerate(zip(by_feature, edges, strict=True)):
            # a code is the number of all candidates below a value; the last entry is that of missing values
            bins[j, : len(every) + 1] = np.searchsorted(np.searchsorted(every, mine), np.arange(len(every) + 1), "left")
            bins[j, -1] = np.searchsorted(mine, fills[fold][j], "left")
        lookup[fold] = bins
    able = {fold: np.arange(BINS - 1) < np.array([len(c) for c in by])[:, None] for fold, by in cuts.items()}
    epoch = np.datetime64("1970-01-01")
    spans = {f["fold"]: [int((np.datetime64(f[k]) - epoch).astype(int)) for k in ("train_start", "train_end")] for f in known}
    sent = spark.sparkContext.broadcast((lookup, spans, able))
    trees = {
        fold: Trees(np.zeros((cfg.trees, inner), int), np.zeros((cfg.trees, inner), int), np.zeros((cfg.trees, inner + 1)), np.r_[1.0, np.full(cfg.trees - 1, cfg.step)])
        for fold in cuts
    }
    for t in range(cfg.trees):
        stopped = {fold: {} for fold in cuts}
        for level in range(cfg.depth):
            grown = spark.sparkContext.broadcast({f: (m.feature[: t + 1], m.split[: t + 1], m.leaf[: t + 1], m.weight) for f, m in trees.items()})
            for r in level_splits(codes, sent, grown, t, level, cfg.depth, width).collect():
                model, below = trees[r["fold"]], 2 ** (cfg.depth - level)
                for k in range(2**level):
                    at, ends = 2**level - 1 + k, slice(k * below, (k + 1) * below)
                    if any((k >> up, level - up) in stopped[r["fold"]] for up in range(1, level + 1)):
                        continue  # a node above has no split
                    if r["feature"][k] < 0:
                        stopped[r["fold"]][k, level] = True
                        model.leaf[t, ends] = r["mean"][k]
                        continue
                    model.feature[t, at], model.split[t, at] = r["feature"][k], r["split"][k]
                    model.leaf[t, ends] = np.repeat([r["low"][k], r["high"][k]], below // 2)
            grown.unpersist()
    sent.unpersist()
    return trees


def level_splits(codes: DataFrame, sent, grown, t: int, level: int, depth: int, width: int) -> DataFrame:
    """The best split of each (fold, node) of one level of tree ``t``, in one row per fold."""
    nodes = 2**level

    def add(it):
        lookup, spans, _ = sent.value
        sums = {}
        for batch in it:
            day, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            code = batch.column(2).flatten().to_numpy().reshape(-1, width).T
            if (day[1:] < day[:-1]).any():  # a batch may reach from one stored file into the next
                order = np.argsort(day, kind="stable")
                day, y, code = day[order], y[order], code[:, order]
            for fold, (start, end) in spans.items():
                lo, hi = np.searchsorted(day, [start, end])
                if lo == hi or fold not in lookup:
                    continue
                bins = np.stack([lookup[fold][j][code[j, lo:hi]] for j in range(width)])
                model = Trees(*grown.value[fold])
                rest = model.residual(bins, y[lo:hi], t, depth)
                base = model.place(bins, t, level) * BINS
                both = sums.setdefault(fold, np.zeros((2, nodes, width, BINS)))
                for j in range(width):
                    at = base + bins[j]
                    both[0, :, j] += np.bincount(at, minlength=nodes * BINS).reshape(nodes, BINS)
                    both[1, :, j] += np.bincount(at, rest, nodes * BINS).reshape(nodes, BINS)
        flat = [v.ravel().tolist() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], ["fold", "sums"])

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        fold = key[0].as_py()
        n, s = matrix(table.column("sums").combine_chunks(), 2 * nodes * width * BINS).sum(1).reshape(2, nodes, width, BINS)
        found = best_splits(n, s, sent.value[2][fold])
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        columns = [pa.array([v.tolist()], pa.list_(k)) for v, k in zip(found, kinds, strict=True)]
        return pa.table([pa.array([fold], pa.int32()), *columns], names=["fold", "feature", "split", "low", "high", "mean"])

    summed = codes.mapInArrow(add, "fold int, sums array<double>").groupBy("fold")
    return summed.applyInArrow(choose, "fold int, feature array<int>, split array<int>, low array<double>, high array<double>, mean array<double>")


def score(models: DataFrame, rows: DataFrame, names: list[str], depth: int, bound: int | None = None) -> DataFrame:
    """``rows`` of all folds with a ``signal``, from one table of models keyed by fold."""
    inner, ends = 2**depth - 1, 2**depth
    inputs = F.array(*[F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(None)), F.get("fill", F.lit(i))) for i, n in enumerate(names)])

    def leaf(tree: Column) -> Column:
        node = F.lit(0)
        for _ in range(depth):
            at = tree * inner + node
            left = F.get("_in", F.get("split_features", at)) <= F.get("thresholds", at)
            node = 2 * node + F.when(left, 1).otherwise(2)
        return F.get("leaves", tree * ends + node - inner)

    signal = F.aggregate(
        F.sequence(F.lit(0), F.size("tree_weights") - 1), F.lit(0.0), lambda s, t: s + F.get("tree_weights", t) * leaf(t)
    )
    joined = rows.join(dim(models, bound, 8192), "fold").withColumn("_in", inputs).withColumn("signal", signal)
    return joined.select(*rows.columns, "signal")


def rank_ic(scored: DataFrame, folds: int | None = None) -> DataFrame:
    """(fold, n, rank_ic): Spearman correlation of signal and label rank per fold."""
    # each ranking reads its input several times: stored once
    known = store(scored.where(F.col("target_rank").isNotNull() & F.col("signal").isNotNull()).select(
        "fold", "ticker", "signal", "target_rank"
    ), "ranks")
    ranked = store(with_average_rank(known, ["fold"], "signal", "_rs", groups=folds), "ranks")
    ranked = with_average_rank(ranked, ["fold"], "target_rank", "_rt", groups=folds)
    ic = F.nanvl(F.corr("_rs", "_rt"), F.lit(None).cast("double"))
    return ranked.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), ic.alias("_ic")).select(
        "fold", "n", F.when(F.col("n") > 2, F.col("_ic")).alias("rank_ic")
    )


def rank_assets(
    features: DataFrame,
    snapshot: DataFrame,
    folds: DataFrame,
    cfg: RankerConfig,
    names: list[str] | None = None,
    minimum: int = 1,
    bound: int | None = None,
) -> DataFrame:
    """Snapshot rows of every fold with a model signal.

    ``features`` should be stored: medians, candidates and codes each read it once. Folds whose
    snapshot has fewer than ``minimum`` rows, or that have no labelled training rows, are skipped.
    """
    names = names or FEATURES
    spark = features.sparkSession
    sizes = snapshot.groupBy("fold").count().where(F.col("count") >= minimum).select("fold")
    asked = folds.join(sizes, "fold", "left_semi")
    known = folds.join(fold_medians(features, asked, names, bound), "fold").orderBy("fold").collect()  # a row per fold
    if not known:
        raise ValueError("no fold has enough snapshot rows to rank")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    inputs = F.array(*[F.nanvl(F.col(n).cast("double"), F.lit(None)) for n in names])
    rows = features.where(F.col("target_rank").isNotNull()).select("date", "target_rank", inputs.alias("_in"))
    days = fold_dates(asked).where("role = 'train'").select("fold", "date")
    cuts = candidates(rows, days, known, names, bound and bound * 31 * 24)
    edges = [np.unique(np.concatenate([by[j] for by in cuts.values()])) for j in range(len(names))]
    fills = {f["fold"]: [f[n] for n in names] for f in known}
    trees = fit_all(coded(rows, edges), known, cuts, edges, fills, cfg)
    models = [
        (fold, fills[fold], cfg.depth, m.weight.tolist(), m.feature.ravel().tolist(), thresholds(m, cuts[fold]), m.leaf.ravel().tolist())
        for fold, m in sorted(trees.items())
    ]
    return store(score(spark.createDataFrame(models, MODEL), snapshot, names, cfg.depth, bound or len(models)), "signals")


def thresholds(trees: Trees, cuts: list[np.ndarray]) -> list[float]:
    """Values at most which a row goes left; 0 at nodes without a split."""
    return [float(cuts[j][k]) if k < len(cuts[j]) else 0.0 for j, k in zip(trees.feature.ravel(), trees.split.ravel(), strict=True)]

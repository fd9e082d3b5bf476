"""Fixed-size subset choice for many small problems at once.

Each problem is one row holding its matrix (pool size squared); candidate
subsets are generated beside it and scored in place, so nothing is joined and
the minimum is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.scalars import md5_draw
from pitpanel.operators.moments import PROBLEM

#: Most subsets of one problem, and most assets that a mask of 64 bits numbers.
MAX_SUBSETS, MAX_ASSETS = 100_000, 62


def instances(matrix: DataFrame, cardinality: int) -> DataFrame:
    """One row per problem: ``n``, ``k`` and the matrix cells sorted by (i, j)."""
    packed = matrix.groupBy(*PROBLEM).agg(
        F.sort_array(F.collect_list(F.struct("i", "j", "q"))).alias("cells"),
        (F.max("i") + 1).cast("int").alias("n"),
    )
    k = F.least(F.lit(cardinality), F.col("n"))
    subsets = F.aggregate(F.sequence(F.lit(1), k), F.lit(1.0), lambda c, i: c * (F.col("n") - k + i) / i)
    fits = F.when(
        (subsets > MAX_SUBSETS) | (F.col("n") > MAX_ASSETS),
        F.raise_error(F.lit(f"subset enumeration is limited to {MAX_SUBSETS} subsets of {MAX_ASSETS} assets")).cast("int"),
    ).otherwise(F.col("n"))
    return packed.withColumn("k", k).withColumn("n", fits)


def _has(mask: Column, i: Column) -> Column:
    return F.getbit(mask, i) == 1


def subset_energy(cells: Column, mask: Column) -> Column:
    """Sum of ``q_ij`` over the pairs both in the subset."""
    return F.aggregate(
        cells,
        F.lit(0.0),
        lambda acc, c: acc
        + F.when(_has(mask, c["i"]) & _has(mask, c["j"]), c["q"]).otherwise(F.lit(0.0)),
    )


def enumerate_subsets(inst: DataFrame) -> DataFrame:
    """Every k-of-n subset as a bit mask with its energy.

    Subsets grow by one member at a time, each larger than the last and small enough to leave
    room for the rest, so exactly C(n, k) are made. A new member adds its own cell and those it
    shares with the members before it; the cells are one dense array.
    """
    n, k = F.col("n"), F.col("k")
    q = F.transform("cells", lambda c: c["q"])

    def grown(found: Column, size: Column) -> Column:
        def joined(s: Column, j: Column) -> Column:
            shared = F.aggregate(
                s["members"], F.get("_q", j * n + j), lambda t, i: t + F.get("_q", i * n + j) + F.get("_q", j * n + i)
            )
            return F.struct(
                F.array_append(s["members"], j).alias("members"), (s["energy"] + shared).alias("energy")
            )

        def extended(s: Column) -> Column:
            first = F.coalesce(F.try_element_at(s["members"], F.lit(-1)) + 1, F.lit(0))
            return F.transform(F.sequence(first, n - k + size - 1), lambda j: joined(s, j))

        return F.flatten(F.transform(found, extended))

    start = F.array(F.struct(F.expr("cast(array() as array<int>)").alias("members"), F.lit(0.0).alias("energy")))
    every = F.aggregate(F.sequence(F.lit(1), k), start, grown)
    made = inst.withColumn("_q", q).withColumn("_s", F.explode(every))
    mask = F.aggregate("_s.members", F.lit(0).cast("bigint"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    return made.withColumn("mask", mask).withColumn("energy", F.col("_s.energy")).drop("_s", "_q")


def best_subset(inst: DataFrame, problem: list[str] | None = None) -> DataFrame:
    """The minimum-energy subset per problem; equal energies go to the lower mask."""
    keys = problem or PROBLEM
    best = F.min_by(F.struct("mask", "energy"), F.struct("energy", "mask")).alias("_b")
    return (
        enumerate_subsets(inst)
        .groupBy(*keys)
        .agg(best, F.first("k").alias("k"), F.first("n").alias("n"))
        .select(*keys, "n", "k", F.col("_b.mask").alias("mask"), F.col("_b.energy").alias("energy"))
    )


def random_search(inst: DataFrame, seed: int, shots: int = 1024) -> DataFrame:
    """Uniform random subsets of any size, scored with a size penalty.

    The penalty is ``max(1, sum |q|) (size - k)^2``. Returns the best draw's
    unpenalised energy and the share of draws of the right size. Draws come from
    an md5 of (seed, strategy, fold, shot) and repeat on any partitioning.
    """
    total = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + F.abs(c["q"]))
    states = F.pow(F.lit(2.0), F.col("n").cast("double")).cast("bigint")
    drawn = (
        inst.withColumn("scale", F.greatest(F.lit(1.0), total))
        .withColumn("shot", F.explode(F.sequence(F.lit(0), F.lit(shots - 1))))
        .withColumn("mask", md5_draw(states, F.lit(str(seed)), "strategy", "fold", "shot"))
        .withColumn("energy", subset_energy(F.col("cells"), F.col("mask")))
    )
    off = (F.bit_count("mask") - F.col("k")).cast("double")
    drawn = drawn.withColumn("penalised", F.col("energy") + F.col("scale") * off * off)
    best = F.min_by(F.struct("mask", "energy"), F.struct("penalised", "shot")).alias("_b")
    return (
        drawn.groupBy(*PROBLEM)
        .agg(
            best,
            F.avg((F.bit_count("mask") == F.col("k")).cast("double")).alias("feasibility_rate"),
            F.count(F.lit(1)).alias("shots"),
        )
        .select(
            *PROBLEM,
            F.col("_b.mask").alias("mask"),
            F.col("_b.energy").alias("energy"),
            "feasibility_rate",
            "shots",
        )
    )


def optimality_gap(energy: Column, best: Column) -> Column:
    return (energy - best) / (F.abs(best) + F.lit(1e-12))


def subset_runs(inst: DataFrame, seeds: list[int], shots: int = 1024) -> DataFrame:
    """One row per problem and method run, with its gap to the exact minimum."""
    exact = best_subset(inst)
    runs = exact.select(
        *PROBLEM,
        F.lit("exact").alias("method"),
        F.lit(0).alias("run"),
        "mask",
        "energy",
        F.lit(1.0).alias("feasibility_rate"),
    )
    for i, seed in enumerate(seeds):
        found = random_search(inst, seed, shots)
        runs = runs.unionByName(
            found.select(
                *PROBLEM,
                F.lit("random_search").alias("method"),
                F.lit(i).alias("run"),
                "mask",
                "energy",
                "feasibility_rate",
            )
        )
    best = exact.select(*PROBLEM, F.col("energy").alias("best_energy"))
    return runs.join(best, PROBLEM).withColumn(
        "optimality_gap", optimality_gap(F.col("energy"), F.col("best_energy"))
    )


def compare_methods(runs: DataFrame) -> DataFrame:
    return runs.groupBy("method").agg(
        F.avg("energy").alias("energy_mean"),
        F.avg("feasibility_rate").alias("feasibility_rate"),
        F.avg("optimality_gap").alias("optimality_gap_mean"),
        F.count(F.lit(1)).alias("runs"),
    )


def chosen_tickers(best: DataFrame, pools: DataFrame) -> DataFrame:
    """Pool rows whose bit is set in the problem's best mask."""
    keys = [c for c in best.columns if c not in {"n", "k", "mask", "energy"}]
    hit = pools.join(best.select(*keys, "mask", "k"), [k for k in keys if k in pools.columns])
    return hit.where(F.getbit(F.col("mask"), F.col("idx")) == 1).drop("mask")

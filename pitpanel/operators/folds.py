"""Walk-forward folds and the assignment of dates and rows to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.session import dim


@dataclass(frozen=True)
class WalkForward:
    """Interval lengths in months; ``max_folds``, if given, keeps the latest folds.

    ``folds_at_most`` bounds the number of folds where they are not limited. It decides broadcasts
    only, never a result.
    """

    train_months: int = 24
    validation_months: int = 3
    test_months: int = 1
    max_folds: int | None = None
    folds_at_most: int | None = None

    @property
    def fold_bound(self) -> int | None:
        return self.folds_at_most if self.max_folds is None else self.max_folds

    @property
    def days_bound(self) -> int | None:
        """Upper bound on (fold, date) pairs over all roles."""
        if self.fold_bound is None:
            return None
        months = self.train_months + self.validation_months + self.test_months
        return self.fold_bound * (months + 1) * 31


def make_folds(dates: DataFrame, wf: WalkForward) -> DataFrame:
    """One row per fold; ``dates`` needs a ``date`` column.

    Anchors are the month ends between ``min + train + validation`` and
    ``max - test``. The list is built from the two bounds alone, so the panel
    gives one min/max aggregate and no window.
    """
    back = wf.train_months + wf.validation_months
    bounds = dates.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.add_months("lo", back).alias("lo"), F.add_months("hi", -wf.test_months).alias("hi")
    )
    ends = F.transform(
        F.expr("sequence(trunc(lo, 'month'), trunc(hi, 'month'), interval 1 month)"),
        lambda d: F.last_day(d),
    )
    listed = bounds.where("lo <= hi").select(
        F.filter(ends, lambda d: (d >= F.col("lo")) & (d <= F.col("hi"))).alias("_a")
    )
    if wf.max_folds is not None:
        keep = F.least(F.size("_a"), F.lit(wf.max_folds))
        listed = listed.withColumn("_a", F.slice("_a", F.size("_a") - keep + 1, keep))
    t = F.col("test_start")
    return listed.select(F.posexplode("_a").alias("fold", "test_start")).select(
        "fold",
        F.add_months(t, -back).alias("train_start"),
        F.add_months(t, -wf.validation_months).alias("train_end"),
        t.alias("validation_end"),
        "test_start",
        F.add_months(t, wf.test_months).alias("test_end"),
    )


def fold_dates(folds: DataFrame) -> DataFrame:
    """(fold, role, date): train ``[a, b)``, validation ``[b, c)``, test ``(c, d]``."""

    def days(role: str, a: str, b: str) -> DataFrame:
        span = folds.where(F.expr(f"{a} <= {b}"))
        return span.select(
            "fold", F.lit(role).alias("role"), F.explode(F.expr(f"sequence({a}, {b})")).alias("date")
        )

    return (
        days("train", "train_start", "date_sub(train_end, 1)")
        .unionByName(days("validation", "train_end", "date_sub(validation_end, 1)"))
        .unionByName(days("test", "date_add(test_start, 1)", "test_end"))
    )


def assign_folds(rows: DataFrame, folds: DataFrame, wf: WalkForward, role: str | None = None):
    """Rows joined to every fold and role their date falls in, by equality."""
    days = fold_dates(folds)
    if role is not None:
        days = days.where(F.col("role") == role)
    return rows.join(dim(days, wf.days_bound, 32), "date")


def decision_dates(folds: DataFrame, calendar: DataFrame) -> DataFrame:
    """Folds with ``decision_time``, the latest panel date not after the test start.

    Dates and test starts meet in one sorted pass, as long as the calendar.
    """
    marks = calendar.select("date", F.lit(None).cast("int").alias("fold")).unionByName(
        folds.select(F.col("test_start").alias("date"), F.col("fold").cast("int").alias("fold"))
    )
    w = Window.orderBy("date", F.col("fold").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumn("decision_time", F.max(F.when(F.col("fold").isNull(), F.col("date"))).over(w))
    latest = seen.where("fold IS NOT NULL AND decision_time IS NOT NULL").select("fold", "decision_time")
    return folds.join(latest, "fold")


def recent_dates(decisions: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """(fold, date, age): the ``n`` latest panel dates up to each decision; age 0 newest."""
    # dates are numbered once, in one pass as long as the calendar; a window is a run of numbers
    numbered = calendar.withColumn("_at", F.row_number().over(Window.orderBy("date")))
    last = decisions.select("fold", F.col("decision_time").alias("date")).join(numbered, "date")
    ages = F.explode(F.expr(f"sequence(0, {n - 1})")).alias("age")
    asked = last.select("fold", "_at", ages).select("fold", "age", (F.col("_at") - F.col("age")).alias("_at"))
    return asked.join(numbered, "_at").select("fold", "date", "age")


def fold_segments(folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calendar cut at all bounds of folds: ``(date, segment)`` and ``(fold, role, first, segment)``.

    Segments are disjoint and numbered in order; every fold and role is a run of them,
    listed one row a segment beside the run's first number.
    """

    def span(role: str, lo: Column, hi: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), lo.alias("lo"), hi.alias("hi"))

    spans = folds.select(
        "fold",
        F.explode(F.array(
            span("train", F.col("train_start"), F.col("train_end")),
            span("validation", F.col("train_end"), F.col("validation_end")),
            span("test", F.date_add("test_start", 1), F.date_add("test_end", 1)),
        )).alias("s"),
    ).select("fold", "s.*").where("lo < hi")
    order = Window.orderBy("date")  # a few bounds a fold
    cuts = spans.select(F.explode(F.array("lo", "hi")).alias("date")).distinct().select(
        "date", F.row_number().over(order).alias("segment"), F.lead("date").over(order).alias("next")
    )
    days = cuts.where("next IS NOT NULL").select(
        "segment", F.explode(F.expr("sequence(date, date_sub(next, 1))")).alias("date")
    )
    at = cuts.select("date", "segment")
    runs = spans.join(at.select(F.col("date").alias("lo"), F.col("segment").alias("first")), "lo").join(
        at.select(F.col("date").alias("hi"), F.col("segment").alias("stop")), "hi"
    )
    return days.select("date", "segment"), runs.select(
        "fold", "role", "first", F.explode(F.expr("sequence(first, stop - 1)")).alias("segment")
    )


def fold_counts(rows: DataFrame, folds: DataFrame, wf: WalkForward) -> DataFrame:
    """Rows, dates and tickers per fold and role.

    Each row is counted once, in its segment of the calendar, however many folds overlap
    there. A ticker counts in a run of segments where it was last seen before the run, so
    distinct tickers are sums over (segment, segment last seen in) as well.
    """
    days, runs = fold_segments(folds)
    placed = rows.join(dim(days, wf.days_bound, 32), "date")
    dated = placed.groupBy("segment", "date").agg(F.count(F.lit(1)).alias("n")).groupBy("segment").agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("dates")
    )
    in_order = Window.partitionBy("ticker").orderBy("segment")
    first_seen = (
        placed.where("ticker IS NOT NULL").select("ticker", "segment").distinct()
        .withColumn("last", F.coalesce(F.lag("segment").over(in_order), F.lit(0)))
        .groupBy("segment", "last").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = runs.join(dated, "segment").groupBy("fold", "role").agg(
        F.sum("records").alias("records"), F.sum("dates").alias("dates")
    )
    tickers = runs.join(first_seen, "segment").groupBy("fold", "role").agg(
        F.sum(F.when(F.col("last") < F.col("first"), F.col("n")).otherwise(0)).alias("tickers")
    )
    return totals.join(tickers, ["fold", "role"], "left").select(
        "fold", "role", "records", "dates", F.coalesce("tickers", F.lit(0)).alias("tickers")
    )


def snapshots(
    features: DataFrame, decisions: DataFrame, required: list[str], wf: WalkForward
) -> DataFrame:
    """Feature rows on each fold's decision date with all ``required`` present."""
    at = decisions.select("fold", F.col("decision_time").alias("date"))
    return (
        features.join(dim(at, wf.fold_bound, 16), "date")
        .dropna(subset=required)
        .withColumn("decision_time", F.col("date"))
    )

"""Backward as-of joins without a non-equi join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.session import dim


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_on: str,
    right_on: str,
    values: list[str],
    tiebreak: str | None = None,
) -> DataFrame:
    """Latest right row with ``right_on <= left_on`` per key; an exact hit counts.

    Both sides meet in one sorted pass per key: right rows sort before left rows
    of the same time, and the last right row seen is carried forward. The values
    travel as one struct, so a NULL field of the latest row stays NULL. One
    shuffle, linear in rows. On equal times the highest ``tiebreak`` wins.
    """
    clash = [c for c in left.columns if c in values]
    if clash:
        raise ValueError(f"columns of both sides: {clash}; drop or rename them on the left")
    kind = right.schema[tiebreak].dataType if tiebreak else "string"
    order = F.col(tiebreak) if tiebreak else F.lit(None).cast("string")
    probe = left.select(
        F.col(key).alias("_key"),
        F.col(left_on).alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(kind).alias("_tie"),
        F.struct(*left.columns).alias("_row"),
    )
    known = right.where(F.col(right_on).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col(right_on).alias("_at"),
        F.lit(0).alias("_side"),
        order.alias("_tie"),
        F.struct(*values).alias("_hit"),
    )
    both = known.unionByName(probe, allowMissingColumns=True)
    w = (
        Window.partitionBy("_key")
        .orderBy("_at", "_side", "_tie")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = both.withColumn("_last", F.last("_hit", ignorenulls=True).over(w))
    return seen.where("_side = 1").select(
        "_row.*", *[F.col(f"_last.{v}").alias(v) for v in values]
    )


def asof_on_dates(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    values: list[str],
    tiebreak: str | None = None,
    dates: int | None = None,
) -> DataFrame:
    """As-of join without a key.

    A global window over the panel would pass through one task, so the join runs
    on the distinct dates (calendar-sized) and the answer joins back by date.
    """
    calendar = left.select(left_on).distinct().withColumn("_one", F.lit(1))
    answered = asof_join(
        calendar,
        right.withColumn("_one", F.lit(1)),
        key="_one",
        left_on=left_on,
        right_on=right_on,
        values=values,
        tiebreak=tiebreak,
    ).drop("_one")
    return left.join(dim(answered, dates), left_on, "left")

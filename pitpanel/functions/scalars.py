"""Column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL where either is NULL or ``b`` is zero."""
    return F.try_divide(a, b)


def bad_ohlc(o: str = "open", h: str = "high", lo: str = "low", c: str = "close") -> Column:
    """True where a bar contradicts itself; NULL prices never make a bar bad."""
    o_, h_, l_, c_ = F.col(o), F.col(h), F.col(lo), F.col(c)
    broken = (
        F.coalesce(h_ < F.greatest(o_, c_, l_), F.lit(False))
        | F.coalesce(l_ > F.least(o_, c_, h_), F.lit(False))
        | F.coalesce(F.least(o_, h_, l_, c_) <= 0, F.lit(False))
    )
    return broken


def any_true(*conditions: Column) -> Column:
    out = F.lit(False)
    for cond in conditions:
        out = out | F.coalesce(cond, F.lit(False))
    return out


def md5_draw(modulus: Column | int, *parts: Column | str) -> Column:
    """Deterministic draw in ``[0, modulus)`` from the md5 of the parts.

    The same parts give the same number on any partitioning, in any order.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    return number % m.cast("bigint")

"""Output shapes shared by the Spark queries and their SQL counterparts.

A shape is a string of ``name[:kind]`` items. Kinds: none = as is, ``d`` = date as
ISO text, ``i`` = BIGINT, ``s`` = eight significant digits as text (for compounded
values of any size), a digit = double rounded to that many places (a zero is
always positive).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _items(shape: str) -> list[tuple[str, str]]:
    return [tuple((item + ":").split(":")[:2]) for item in shape.split()]


def shaped(df: DataFrame, shape: str) -> DataFrame:
    out = []
    for name, kind in _items(shape):
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "s":
            e = F.floor(F.log10(F.abs(c)))
            digits = F.round(c / F.pow(F.lit(10.0), e.cast("double")), 7).cast("string")
            c = F.when(c == 0, "0").otherwise(F.concat(digits, F.lit("e"), e.cast("string")))
        elif kind:
            r = F.round(c.cast("double"), int(kind))
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        out.append(c.alias(name))
    return df.select(*out)


def shaped_sql(source: str, shape: str) -> str:
    out = []
    for plain, kind in _items(shape):
        name = f'"{plain}"'
        if kind == "d":
            e = f"strftime({name}, '%Y-%m-%d')"
        elif kind == "i":
            e = f"CAST({name} AS BIGINT)"
        elif kind == "s":
            x = f"CAST(floor(log10(abs({name}))) AS BIGINT)"
            e = f"""CASE WHEN {name} = 0 THEN '0' WHEN {name} IS NOT NULL THEN
                 CAST(round({name} / power(10.0::DOUBLE, {x}), 7) AS VARCHAR) || 'e' || {x} END"""
        elif kind:
            r = f"round(CAST({name} AS DOUBLE), {kind})"
            e = f"CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END"
        else:
            e = name
        out.append(f"{e} AS {name}")
    return "SELECT " + ", ".join(out) + f" FROM {source}"

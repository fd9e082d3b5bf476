"""Mixing sources to target weights by iterative proportional fitting.

Token counts per cell (source x language x topic) are raked until their marginals meet
the targets; a document is kept with probability ``budget * fitted share / token share``
of its cell, cut at 1, by a draw from the digest of its id.

Texts are read once, for their word counts. Raking runs on the cell table, which has at
most one row per combination of categories that occurs, whatever the corpus weighs:
each step is a window sum per category, and every few sweeps the table is cut by a
checkpoint. The number of sweeps is fixed, so that the result does not hang on a
stopping rule. Documents get their probability by a join on the cell; the cell table is
written first, and its measured size decides how it is joined.

A NULL category is a category of its own. Empty and NULL texts have no tokens and share
their cell's probability; in a cell without any tokens it is the budget. Equal ids draw
alike. An empty table gives no rows. Extra columns are kept; added ones that would
clash get a leading underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitpanel.llm.common import cut_lineage, fresh, table
from pitpanel.session import store

SEED = "mix-1"
SPACE = r"[\x09-\x0D\x20]"
#: Exponents that temper the corpus shares into targets: 1 keeps, 0 levels.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET, SWEEPS, SWEEPS_A_CUT = 0.6, 12, 4


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    edges = text.rlike(f"^{SPACE}").cast("int") + text.rlike(f"{SPACE}\\z").cast("int")
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(F.split(text, f"{SPACE}+")) - edges).cast("long")


def form_of(text: Column, tokens: Column) -> Column:
    """The documents have no topic column; their form stands in for it."""
    return (
        F.when(text.contains(" | "), "table").when(text.contains("%%%"), "noisy")
        .when(tokens < 100, "short").when(tokens >= 2000, "long").otherwise("prose")
    )


def rake(cells: DataFrame, temper: dict[str, float], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (one column per dimension, ``tokens``) with ``share`` and fitted ``weight``.

    ``target_<d>`` columns hold each category's target; they sum to 1 over a dimension.
    """
    everything = Window.partitionBy(F.lit(0))
    out = cells
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for d, power in temper.items():
        marginal = cells.groupBy(d).agg((F.sum("tokens") / F.lit(float(max(total, 1)))).alias("m"))
        tempered = marginal.withColumn("t", F.when(F.col("m") > 0, F.pow("m", F.lit(power))).otherwise(0.0))
        norm = tempered.withColumn("all", F.sum("t").over(everything))
        out = out.join(norm.select(d, F.when(F.col("all") > 0, F.col("t") / F.col("all")).otherwise(0.0).alias(f"target_{d}")), d)
    out = out.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))).withColumn("weight", F.col("share"))
    for k in range(sweeps):
        for d in temper:
            held = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"target_{d}") / held).otherwise(0.0))
        if (k + 1) % SWEEPS_A_CUT == 0:
            out = cut_lineage(out)
    return out


def _category(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))


def mixed(docs: DataFrame, dims: dict[str, Column], *, temper: dict[str, float] = TEMPER, budget: float = BUDGET,
          sweeps: int = SWEEPS, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> tuple[DataFrame, list[str]]:
    """``docs`` with tokens, probability, decision and one column per dimension added."""
    names = fresh(docs, "tokens", "probability", "kept", *[f"dim_{d}" for d in dims])
    tokens, probability, kept, *columns = names
    keyed = docs.withColumn(tokens, tokens_of(F.col(text_col)))
    for (_, value), c in zip(dims.items(), columns, strict=True):
        keyed = keyed.withColumn(c, value(keyed, tokens) if callable(value) else value)
        keyed = keyed.withColumn(c, _category(c))
    cells = store(keyed.groupBy(*[F.col(c).alias(d) for d, c in zip(dims, columns, strict=True)]).agg(
        F.sum(tokens).alias("tokens"), F.count("*").alias("rows")
    ), "cells")
    fitted = store(rake(cells, temper, sweeps).select(
        *[F.col(d).alias(c) for d, c in zip(dims, columns, strict=True)],
        F.when(F.col("share") > 0, F.least(F.lit(1.0), budget * F.col("weight") / F.col("share"))).otherwise(
            F.least(F.lit(1.0), F.lit(float(budget)))
        ).alias(probability),
    ), "cells")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return keyed.join(fitted, columns, "left").withColumn(kept, draw < F.col(probability)), names


def document_dims() -> dict:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": lambda df, tokens: form_of(df["text"], df[tokens])}


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mixture keeps."""
    out, names = mixed(docs, document_dims(), **options)
    return out.where(F.col(names[2])).select(*docs.columns)


def op3_target_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, calibrated probability and decision."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    out, (tokens, probability, kept, _, _, topic) = mixed(docs, document_dims())
    return out.select(
        "doc_id", "source", "lang", F.expr(f"substring({topic}, 2)").alias("topic"), F.col(tokens).alias("tokens"),
        F.round(probability, 6).alias("probability"), F.col(kept).alias("kept"),
    )

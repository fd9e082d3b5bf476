"""From raw documents to training shards: five stages, each one operator of ``pitpanel.llm``.

Toxic documents go, one document of each near-duplicate group stays, documents that
hold benchmark windows go, sources are sampled to target weights, and what is left is
cut into shards. Each stage reads what its predecessor wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm import decontaminate, minhash, mixing, shards, toxicity
from pitpanel.llm.common import table
from pitpanel.session import scratch_root

#: SQL cannot restore disguised words, so the run has no SQL twin.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out, score = toxicity.scored(docs, model)
    return out.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80% of its five-word shingles."""
    return minhash.deduplicated(docs, n=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of source, language and form."""
    return mixing.sample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each remaining document."""
    return shards.interleaved(docs, shards=40)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix),
    ("shards", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    root = f"{scratch_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs

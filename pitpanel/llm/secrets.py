"""Secret scans over an incremental ledger of content-addressed texts.

Every version of a text is addressed by its SHA-256. The ledger holds the pairs
(blob, rule version) that have been scanned, one entry a pair with its findings; a run
scans only pairs it does not hold, and joins findings back to every path that ever had
the blob. Copies are therefore scanned once, however many there are, a second run over
the same texts scans nothing, and a new or changed rule is the only one that runs over
old texts. A rule's version is a digest of all that decides its findings (kind, pattern,
group, least length), so no change of a rule can meet findings of its older form.

A pair may be entered more than once, by runs at the same time; readers take each pair
once. Entries of a pair are equal, whoever wrote them.

One text per blob goes through the scan: the holder with the smallest id is found by a
partial aggregate of (blob, id), and texts are joined on (id, blob), so a group of
copies never meets in one task. Findings are small and joined back on the blob.

Rules are (kind, pattern, group, least length): matches are leftmost and do
not overlap within a kind; a match whose group is too short is dropped after matching.
Offsets are code points, end exclusive.

NULL texts count as empty. Empty texts and empty tables have no findings. Repeated
rows and paths each get their blob's findings. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.common import batches, table
from pitpanel.session import scratch_root

FINDING = "array<struct<kind:string,rank:int,first:int,end:int>>"


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        """Differs between any two rules that could find different spans."""
        parts = [self.kind, self.pattern, str(self.group), str(self.least)]
        return hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()[:32]


#: The three kinds and their patterns, in the order of the listing.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)


def compiled(rule: Rule) -> re.Pattern:
    if rule.kind == "assign":  # only the letters of the name may be in either case
        head, tail = rule.pattern.split(")", 1)
        return re.compile(f"(?i:{head}))" + tail, re.ASCII)
    if rule.kind == "hex":  # a run is maximal, so the least length may stand in the pattern
        return re.compile(rf"[0-9a-f]{{{rule.least},}}")
    return re.compile(rule.pattern)


def find(text: str, rule: Rule, pattern: re.Pattern) -> list[tuple[int, int]]:
    """``(first, end)`` of the rule's findings, in order."""
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


class Ledger:
    """Scanned (blob, rule version) pairs and their spans under ``path``."""

    schema = "blob string, rule string, spans array<struct<first:int,end:int>>"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{scratch_root(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"

    def entries(self) -> DataFrame:
        """All entries as written; a pair may have several."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """``(blob, findings)`` of ``rules`` for blobs with any: by start, then by the rules' order."""
        rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.version, k)])
        kind = F.array(*[F.lit(r.kind) for r in rules])
        spans = self.entries().where(F.col("rule").isin([r.version for r in rules]) & (F.size("spans") > 0))
        # equal entries of one pair fold to one
        once = spans.groupBy("blob", "rule").agg(F.max("spans").alias("spans")).withColumn("rank", rank[F.col("rule")])
        each = F.transform("spans", lambda s: F.struct(
            s["first"].alias("first"), F.col("rank").alias("rank"), s["end"].alias("end"), kind[F.col("rank")].alias("kind")
        ))
        held = once.select("blob", each.alias("each")).groupBy("blob").agg(F.flatten(F.collect_list("each")).alias("each"))
        return held.select("blob", F.transform(F.array_sort("each"), lambda s: F.struct(
            s["kind"].alias("kind"), s["rank"].alias("rank"), s["first"].alias("first"), s["end"].alias("end")
        )).alias("findings"))

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan the pairs of ``versions(path, blob, text)`` and ``rules`` that the ledger lacks; return its findings."""
        known = self.entries().where(F.col("rule").isin([r.version for r in rules]))
        done = known.groupBy("blob").agg(F.collect_set("rule").alias("done"))  # at most one name a rule
        keepers = versions.groupBy("blob").agg(F.min("path").alias("path"))
        unseen = keepers.join(done, "blob", "left").where(
            F.col("done").isNull() | (F.size("done") < len({r.version for r in rules}))
        ).select(F.col("blob").alias("k_blob"), F.col("path").alias("k_path"), F.coalesce("done", F.array().cast("array<string>")).alias("done"))
        todo = versions.join(
            unseen.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("k_path")) & (F.col("blob") == F.col("k_blob"))
        ).select("blob", "text", "done")

        def run(batch: pa.RecordBatch, patterns) -> pa.RecordBatch:
            blobs, names, found = [], [], []
            for blob, text, done in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for rule, version, pattern in patterns:
                    if version not in done:
                        blobs.append(blob)
                        names.append(version)
                        found.append([{"first": a, "end": b} for a, b in find(text or "", rule, pattern)])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.string()), pa.array(names, pa.string()), pa.array(found, kind)], ["blob", "rule", "spans"]
            )

        fresh = batches(todo, run, self.schema, setup=lambda: [(r, r.version, compiled(r)) for r in rules])
        # a repeated row is the same holder twice; its pairs are entered once
        once = fresh.groupBy("blob", "rule").agg(F.max("spans").alias("spans"))
        once.write.mode("append").parquet(self.path)
        return self.findings(rules)


def versions_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def secrets(docs: DataFrame, *, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(path, blob, findings)`` for every row of ``docs``."""
    versions = versions_of(docs, id_col, text_col)
    ledger = ledger or Ledger(docs.sparkSession)
    found = ledger.scan(versions, rules)
    empty = F.array().cast(FINDING)
    return versions.select("path", "blob").join(found, "blob", "left").select(
        "path", "blob", F.coalesce("findings", empty).alias("findings")
    )


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned through a new ledger; digests of the spans per document."""
    found = secrets(table(spark, sf_dir, "documents"))
    counts = [
        F.expr(f"cast(size(filter(findings, f -> f.kind = '{r.kind}')) AS bigint)").alias(f"n_{r.kind}") for r in RULES
    ]
    spans = F.array_join(
        F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["first"].cast("string"), f["end"].cast("string"))), ","
    )
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans")
    )

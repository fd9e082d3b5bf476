"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned over all texts.

Windows are ``n`` consecutive words; an item with fewer words, but not none, is one
window. Words are runs of letters and digits, A-Z lower-cased; every non-ASCII
character counts as a letter. A text word inside any occurrence of a window is hit.
A window is found by a 64-bit hash and then compared word by word, so a hash
collision never makes a hit.

The scan is one pass without a shuffle, so neither a hot source nor a common passage
gathers anywhere. The set is broadcast in blocks of at most ``block_windows`` windows
(counted before anything is collected); a larger benchmark is scanned block by block,
and the findings of one row grow with each pass.

NULL and empty texts have no words and no hits. Repeated rows are scanned each by
itself. Empty tables give an empty result or no hits. Columns of the input are kept
under their names; added columns that would clash get a leading underscore.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.common import BATCH_BYTES, BATCH_ROWS, cut_lineage, fresh, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = "array<struct<first:int,end:int>>"
#: odd, so that it has an inverse modulo 2**64
BASE = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[str]:
    # lower() of bytes touches A-Z alone
    return WORD.findall(text.encode("utf-8").lower().decode("utf-8")) if text else []


class _Ids(dict):
    """64-bit hash of each word seen; emptied when it grows, since it is only a cache."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class _Powers:
    """BASE**i and its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)])
        return self.up[:n], self.down[:n]


def _window_hashes(ids: np.ndarray, n: int, powers: _Powers) -> np.ndarray:
    """Polynomial hash of every ``n`` consecutive ids, from one running sum."""
    up, down = powers.get(len(ids))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * up)))
    return (total[n:] - total[:-n]) * down[: len(ids) - n + 1]


class WindowSet:
    """Windows of a block of items by length, hash and words."""

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        ids, powers = _Ids(), _Powers()
        self.by_length: dict[int, tuple[np.ndarray, dict]] = {}
        found: dict[int, dict[int, dict]] = {}
        for item, text in items:
            w = words(text)
            size = min(n, len(w))
            if not size:
                continue
            hashes = _window_hashes(np.fromiter(map(ids.__getitem__, w), np.uint64, len(w)), size, powers)
            for i, h in enumerate(hashes.tolist()):
                found.setdefault(size, {}).setdefault(h, {}).setdefault(tuple(w[i : i + size]), set()).add(item)
        for size, known in found.items():
            near = np.zeros(1 << 20, bool)
            near[np.fromiter(known, np.uint64, len(known)) >> np.uint64(44)] = True
            self.by_length[size] = (near, known)

    def scan(self, w: list[str], ids: np.ndarray, powers: _Powers) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans ``[first, end)`` in words, and the items whose windows occur."""
        spans, items = [], set()
        for size, (near, known) in self.by_length.items():
            if len(w) < size:
                continue
            hashes = _window_hashes(ids, size, powers)
            for i in np.flatnonzero(near[hashes >> np.uint64(44)]).tolist():
                same = known.get(int(hashes[i]))
                if same and (hit := same.get(tuple(w[i : i + size]))):
                    items |= hit
                    spans.append((i, i + size))
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(spark: SparkSession, items: DataFrame, id_col: str, text_col: str, n: int, block_windows: int):
    """Items in blocks of bounded size; sizes are known before any block is collected."""
    sized = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"),
        (F.octet_length(F.coalesce(text_col, F.lit("")))).alias("size"),
    ).distinct()
    total = sized.agg(F.sum("size")).first()[0] or 0
    count = max(1, -(-total // (2 * block_windows)))  # a word and its gap have two bytes at least
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    for block in range(count):
        yield [(r["id"], r["text"]) for r in dealt.where(F.col("block") == block).select("id", "text").toLocalIterator()]


def scan(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    n: int = 10, block_windows: int = 4_000_000,
) -> tuple[DataFrame, list[str]]:
    """``docs`` with word count, hit spans and item ids (as strings) in three added columns."""
    spark = docs.sparkSession
    n_words, spans, found = names = fresh(docs, "n_words", "hit_spans", "hit_items")
    out = docs.select("*", F.lit(0).cast("long").alias(n_words), F.expr(f"cast(array() as {SPAN})").alias(spans),
                      F.expr("cast(array() as array<string>)").alias(found))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    for k, block in enumerate(_blocks(spark, items, item_id, item_text, n, block_windows)):
        sent = spark.sparkContext.broadcast(WindowSet(block, n))

        def run(it, sent=sent):
            known, ids, powers = sent.value, _Ids(), _Powers()
            for batch in it:
                at = {c: batch.schema.get_field_index(c) for c in names}
                counts, all_spans, all_items = [], [], []
                old_spans, old_items = batch.column(at[spans]), batch.column(at[found])
                for row, text in enumerate(batch.column(batch.schema.get_field_index(text_col)).to_pylist()):
                    w = words(text)
                    hit, which = [], set()
                    if w:
                        hit, which = known.scan(w, np.fromiter(map(ids.__getitem__, w), np.uint64, len(w)), powers)
                    counts.append(len(w))
                    before = [(s["first"], s["end"]) for s in old_spans[row].as_py()]
                    all_spans.append([{"first": a, "end": b} for a, b in merged(before + hit)])
                    all_items.append(sorted(which.union(old_items[row].as_py())))
                columns = list(batch.columns)
                for name, values in zip(names, (counts, all_spans, all_items), strict=True):
                    columns[at[name]] = pa.array(values, batch.schema.field(at[name]).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        if k:
            out = cut_lineage(out)  # one block in memory at a time
        out = out.mapInArrow(run, out.schema)
    return out, names


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: words, hit words, items, their digest and the verdict."""
    found, (n_words, spans, hit_items) = scan(docs, items, **options)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["first"])
    return found.select(
        F.col(id_col), F.col(n_words).alias("n_words"), hit.alias("n_hit"),
        F.size(hit_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit_items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, mode: str = "document", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``mode="span"``) without the hit words."""
    found, (n_words, spans, hit_items) = scan(docs, items, text_col=text_col, **options)
    if mode == "document":
        return found.where(F.size(spans) == 0).drop(n_words, spans, hit_items)

    def run(it):
        for batch in it:
            at = batch.schema.get_field_index(text_col)
            texts = [
                without_words(t, [(s["first"], s["end"]) for s in cut]) if cut else t
                for t, cut in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index(spans)).to_pylist(), strict=True)
            ]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return found.mapInArrow(run, found.schema).drop(n_words, spans, hit_items)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``; the marks around them stay."""
    at = [m.span() for m in WORD.finditer(text.encode("utf-8").lower().decode("utf-8"))]
    out, done = [], 0
    for first, end in spans:
        out.append(text[done : at[first][0]])
        done = at[end - 1][1]
    return "".join([*out, text[done:]])


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, windows of ten words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark"), n=10)

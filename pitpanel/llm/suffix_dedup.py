"""Suffix-array dedup with a logarithmic family of indexes.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere
else, in the same text or another. Equal strings hold an anchor at the same offset
(``anchors``), so a sparse suffix array over anchors, about 70 bytes apart, finds every
match: suffixes are ordered by their first bytes and a fingerprint of the seed.

Texts come in batches. A batch's suffix array is a level of rank 0; it is merge-scanned
against all existing levels for seeds that occur again, and levels of equal rank are
merged into one of the next rank, so there are at most log(batches) of them and every
suffix is rewritten log(batches) times.

Seeds that occur again are decided exactly. An anchor owns the windows for which it is
the anchor, a run of starts; the run's bytes are its context. Contexts that occur again
are removed whole. The others share only some windows: within a seed, contexts are put
side by side and every window is looked up. A seed with more than ``SEED_CONTEXTS``
contexts is not put into one task; its windows are dealt out by content instead. Both
ways look at all windows of all contexts. Context and window identity is a pair of
64-bit hashes.

Texts are dealt once into a bucketed table in the shared folder, from which each pass
reads without another shuffle; other tables are dropped as soon as nothing reads them. A
text's list of runs is bounded by its length.

NULL texts count as empty. Texts shorter than ``LENGTH`` lose nothing. Equal rows are
texts of their own, each a repeat of the other. NULL ids are allowed. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.anchors import LENGTH, anchors
from pitpanel.llm.common import batches, batches_of, table
from pitpanel.session import scratch_root

BATCHES, SEED_CONTEXTS, CHUNK_BYTES = 4, 4096, 2 << 20
RUN = "tid long, first int, end int"


def _release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Shelf:
    """Tables of one run in the shared folder, dropped once nothing reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{scratch_root(spark).rstrip('/')}/suffix-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for path in paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        _release(self.spark)


def _dealt(docs: DataFrame, id_col: str, text_col: str, count: int) -> DataFrame:
    """``(id, tid, raw, batch)`` written once, bucketed by ``tid``, a number per row."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    rows = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("tid"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"),
    ).repartition(n, "tid").withColumn("batch", F.pmod(F.xxhash64("tid"), F.lit(count)).cast("int"))
    rows.write.partitionBy("batch").bucketBy(n, "tid").option("path", f"{scratch_root(spark).rstrip('/')}/{name}").option(
        "compression", "zstd"
    ).saveAsTable(name)
    return spark.table(name)


class SuffixIndex:
    """Levels of sorted suffixes; ``repeated`` holds the seeds seen more than once."""

    def __init__(self, shelf: Shelf) -> None:
        self.shelf = shelf
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.found: list[DataFrame] = []

    def _sorted(self, entries: DataFrame) -> tuple[DataFrame, str]:
        return self.shelf.put(entries.repartition("key").sortWithinPartitions("key"))

    def add(self, entries: DataFrame) -> None:
        """Suffix array of a batch, merge-scan against the levels, geometric merges."""
        new, path = self._sorted(entries)
        scan = new.select("key", F.lit(1).alias("new"))
        for _, level, _ in self.levels:
            scan = scan.union(level.select("key", F.lit(0)))
        again = scan.groupBy("key").agg(F.count("*").alias("n"), F.max("new").alias("new")).where("n > 1 AND new = 1")
        self.found.append(self.shelf.put(again.select("key"))[0])
        self.levels.append((0, new, path))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, b, b_path), (_, a, a_path) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, *self._sorted(a.union(b))))
            self.shelf.drop(a_path, b_path)

    def repeated(self) -> DataFrame:
        """Entries of all levels whose seed occurs more than once."""
        seeds = self.found[0]
        for more in self.found[1:]:
            seeds = seeds.union(more)
        entries = self.levels[0][1]
        for _, level, _ in self.levels[1:]:
            entries = entries.union(level)
        return entries.join(seeds.distinct(), "key", "left_semi")


def _entries(texts: DataFrame) -> DataFrame:
    """``(key, tid, at, back, ahead)``: anchors, with the first and last window start as distances."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: list[list] = [[] for _ in range(5)]
        for tid, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            key, at, first, last = anchors(raw.as_buffer())
            for column, values in zip(parts, (key, np.full(len(key), tid), at, at - first, at - last), strict=True):
                column.append(values)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16()]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c), t) for c, t in zip(parts, kinds, strict=True)], ["key", "tid", "at", "back", "ahead"]
        )

    return batches(texts.select("tid", "raw"), run, "key long, tid long, at int, back short, ahead short")


def _per_text(texts: DataFrame, lists: DataFrame, fn, schema: str, how: str = "inner", columns: tuple[str, ...] = ()) -> DataFrame:
    """``fn`` over texts with their lists; the bucketed texts stay where they are."""
    joined = texts.select(*columns, "tid", "raw").join(lists.hint("shuffle_hash"), "tid", how).select(*columns, "tid", "raw", "list")
    return batches(joined, fn, schema)


def _lists(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("tid").agg(F.collect_list(F.struct(*columns)).alias("list"))


def _columns(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat fields of a column of lists; a NULL list is empty."""
    flat = lists.flatten()
    size = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
    return np.concatenate(([0], np.cumsum(size))), [c.to_numpy(zero_copy_only=False) for c in flat.flatten()]


def _contexts(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """``(key, c, tid, first, last)``: repeated entries with the digest ``c`` of their context."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut, (key, at, back, ahead) = _columns(batch.column(2))
        first, last, out = at - back, at - ahead, np.empty(len(at), np.int64)
        ends = (last + LENGTH).tolist()
        begins, salts = first.tolist(), back.tolist()
        for i, raw in enumerate(batch.column(1)):
            text = memoryview(raw.as_buffer())
            for j in range(cut[i], cut[i + 1]):
                # the anchor's place in the context is part of its identity
                out[j] = xxhash.xxh3_64_intdigest(text[begins[j] : ends[j]], salts[j]) - (1 << 63)
        tid = np.repeat(batch.column(0).to_numpy(), np.diff(cut))
        return pa.RecordBatch.from_arrays([
            pa.array(key, pa.int64()), pa.array(out), pa.array(tid, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())
        ], ["key", "c", "tid", "first", "last"])

    return _per_text(texts, _lists(repeated, "key", "at", "back", "ahead"), run, "key long, c long, tid long, first int, last int")


_BASES = [np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)]
_TABLES = np.random.default_rng(200).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window of ``LENGTH`` bytes."""
    out = []
    for base, values in zip(_BASES, _TABLES, strict=True):
        n = len(data)
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)])
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * up[:n])))
        h = (total[LENGTH:] - total[:-LENGTH]) * down[: n - LENGTH + 1]
        out.append(h ^ (h >> np.uint64(31)))
    return out[0], out[1]


def _window_table(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, offset and both hashes of every window of every context."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts])
    many = size - LENGTH + 1
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(contexts)), many)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    a, b = window_hashes(data)
    at = start[owner] + offset
    return owner, offset, a[at], b[at]


def _runs(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``[first, end)`` of the bytes covered by windows at sorted ``position``, as maximal runs."""
    if not len(position):
        return position, position
    cut = np.flatnonzero(np.diff(position) > LENGTH) + 1
    first = position[np.concatenate(([0], cut))]
    end = position[np.concatenate((cut - 1, [len(position) - 1]))] + LENGTH
    return first, end


def _side_by_side(contexts: DataFrame) -> DataFrame:
    """Runs of the contexts seen once that share windows with others of their seed.

    Rows come sorted by seed; a chunk is cut between seeds, so a seed is never split.
    """
    dealt = contexts.repartition("key").sortWithinPartitions("key")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        owner, offset, a, b = _window_table([r[4] for r in rows])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        twice = np.zeros(len(order), bool)
        twice[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        out: list[list] = [[], [], []]
        once = np.array([r[3] == 1 for r in rows])
        hit = np.flatnonzero(twice & once[owner])
        edges = np.searchsorted(owner[hit], np.arange(len(rows) + 1))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            first, end = _runs(rows[i][2] + offset[hit[edges[i] : edges[i + 1]]])
            out[0] += [rows[i][1]] * len(first)
            out[1] += first.tolist()
            out[2] += end.tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int32(), pa.int32()], strict=True)], ["tid", "first", "end"]
        )

    def run(it):
        held: list[tuple] = []
        weight = 0
        for batch in it:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if weight > CHUNK_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[4])
        if held:
            yield solve(held)

    return batches_of(dealt.select("key", "tid", "first", "n", "context"), run, RUN)


def _by_content(contexts: DataFrame, shelf: Shelf) -> DataFrame:
    """The same for seeds with very many contexts: windows are dealt out one by one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, offset, a, b = _window_table(batch.column(3).to_pylist())
        tid, first, n = (batch.column(i).to_numpy()[owner] for i in range(3))
        return pa.RecordBatch.from_arrays([
            pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(tid), pa.array(first + offset, pa.int32()), pa.array(n)
        ], ["a", "b", "tid", "at", "n"])

    windows, _ = shelf.put(batches(contexts.select("tid", "first", "n", "context"), run, "a long, b long, tid long, at int, n long"))
    again = windows.groupBy("a", "b").count().where("count > 1").select("a", "b")
    return windows.where("n = 1").join(again, ["a", "b"], "left_semi").select("tid", F.col("at").alias("first"), (F.col("at") + LENGTH).alias("end"))


def _with_context(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes with the bytes of their context."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut, (key, first, last, n, many) = _columns(batch.column(2))
        begins, ends, contexts = first.tolist(), (last + LENGTH).tolist(), []
        for i, raw in enumerate(batch.column(1).to_pylist()):
            contexts += [raw[begins[j] : ends[j]] for j in range(cut[i], cut[i + 1])]
        tid = np.repeat(batch.column(0).to_numpy(), np.diff(cut))
        return pa.RecordBatch.from_arrays([
            pa.array(key), pa.array(tid), pa.array(first, pa.int32()), pa.array(n), pa.array(many), pa.array(contexts, pa.binary())
        ], ["key", "tid", "first", "n", "many", "context"])

    return _per_text(texts, _lists(classes, "key", "first", "last", "n", "many"), run,
                     "key long, tid long, first int, n long, many long, context binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count: int = BATCHES,
                    seed_contexts: int = SEED_CONTEXTS) -> DataFrame:
    """``(id, n_bytes, spans, kept)`` per row: size, maximal removed runs, remaining bytes."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    texts = _dealt(docs, id_col, text_col, count)
    _release(spark)
    index = SuffixIndex(shelf)
    for b in range(count):
        index.add(_entries(texts.where(F.col("batch") == b)))
    contexts, contexts_path = shelf.put(_contexts(texts, index.repeated()))
    shelf.drop(*[path for *_, path in index.levels])
    classes, classes_path = shelf.put(contexts.groupBy("key", "c").agg(
        F.count("*").alias("n"), F.min(F.struct("tid", "first", "last")).alias("r")
    ))
    # seeds of which some context was seen once, among others
    open_seeds = classes.groupBy("key").agg(F.count("*").alias("many"), F.min("n").alias("least")).where("least = 1 AND many > 1").drop("least")
    sought, sought_path = shelf.put(_with_context(texts, classes.join(open_seeds, "key").select("key", "n", "many", "r.*")))
    _release(spark)
    whole, _ = shelf.put(contexts.join(classes.where("n > 1").select("key", "c"), ["key", "c"], "left_semi").select(
        "tid", "first", (F.col("last") + LENGTH).alias("end")
    ))
    shelf.drop(contexts_path, classes_path)
    shared, _ = shelf.put(_side_by_side(sought.where(F.col("many") <= seed_contexts)))
    dealt, _ = shelf.put(_by_content(sought.where(F.col("many") > seed_contexts), shelf))
    shelf.drop(sought_path)
    runs = whole.union(shared).union(dealt)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, spans, kept = [], [], []
        cut, fields = _columns(batch.column(3))
        first, end = (f.tolist() for f in fields)
        for i, raw in enumerate(batch.column(2).to_pylist()):
            gone = merged(list(zip(first[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]], strict=True)))
            rest, done = [], 0
            for a, b in gone:
                rest.append(raw[done:a])
                done = b
            size.append(len(raw))
            spans.append([{"first": a, "end": b} for a, b in gone])
            kept.append(b"".join([*rest, raw[done:]]))
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"]
        )

    id_type = docs.schema[id_col].dataType.simpleString()
    return _per_text(texts, _lists(runs, "first", "end"), run, f"id {id_type}, n_bytes long, spans array<struct<first:int,end:int>>, kept binary",
                     "left", ("id",))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a repeated string of 200 bytes."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["first"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

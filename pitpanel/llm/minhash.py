"""Near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of ``n`` words (A-Z lower-cased, words
between white space; fewer words are one shingle). Sketching throws every shingle into
``BINS`` bins, in rounds: in each of the first ``BINS`` rounds a shingle falls into one
hashed bin, in the next ``BINS`` rounds all fall into the bin of the round; a bin keeps
its smallest (round, hash), and once all bins are full later rounds change nothing. So
every coordinate fills, and the share of equal coordinates concentrates about the
Jaccard similarity. ``BANDS`` bands of ``ROWS`` coordinates give the candidates; at a
similarity of 0.8 a pair misses all bands with a probability of 3e-6. Links are decided
on the full sets.

Equal sets are one class from the start, so exact copies never meet pair by pair. In a
band's bucket every class is compared with the bucket's smallest class only (a star,
linear in the bucket). A link that a star does not show joins two classes of different
components. For buckets that still hold several, a second star goes out from the member
with the fewest shingles of its own; then the members outside a bucket's main component
are asked against all its members in blocks of bounded weight, which emit links alone.
Members with too many shingles of their own cannot link at all and drop out first. No
pair that could add a link is dropped, and no bucket is gathered in one task.

Rows that share an id are one document. NULL ids link with nothing: their component is
NULL and they are kept. Texts without words have an empty set and link with nothing.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.common import batches, batches_of, components, fresh, possible, table
from pitpanel.session import store

BINS, BANDS, ROWS = 252, 42, 6
ASKED_TOKENS, MEMBER_TOKENS = 1 << 20, 1 << 23
LEAST = 80  # percent
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_SEEDS = np.random.default_rng(2017).integers(1, 1 << 63, 2 * BINS, dtype=np.uint64)
_FOLD = np.random.default_rng(80).integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> _SHIFT)) * _M1
    h = (h ^ (h >> _SHIFT)) * _M2
    return h ^ (h >> _SHIFT)


class _Words(dict):
    """Hash of each word; emptied when large, since it is only a cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    # split() and lower() of bytes know ASCII alone
    w = text.encode("utf-8").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(w) - size + 1 + j])
    return np.unique(h)


def sketch(h: np.ndarray) -> np.ndarray:
    """``BINS`` coordinates of a non-empty set."""
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    first, step = 0, max(1, 6 * BINS // len(h))  # rounds at a time; surplus rounds change nothing
    while first < 2 * BINS:
        rounds = np.arange(first, min(first + step, 2 * BINS))
        v = _mix(h[None, :] ^ _SEEDS[rounds, None])
        bins = np.where((rounds < BINS)[:, None], (v >> np.uint64(52)) * np.uint64(BINS) >> np.uint64(12), rounds[:, None] - BINS)
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(52)) | (v & np.uint64((1 << 52) - 1))
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        if out.max() < np.iinfo(np.uint64).max:
            break
        first += step
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    rows = s.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * _FOLD[j] + rows[:, j])
    return key


def sketched(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, version, size, d1, d2, keys)`` per row: set size, set digest and band keys."""

    def run(batch: pa.RecordBatch, words: _Words) -> pa.RecordBatch:
        size, low, high, keys = [], [], [], []
        for text in batch.column(2).to_pylist():
            h = shingles(text, n, words)
            size.append(len(h))
            digest = xxhash.xxh3_128_intdigest(h.tobytes())
            low.append((digest & (1 << 64) - 1) - (1 << 63))
            high.append((digest >> 64) - (1 << 63))
            keys.append(band_keys(sketch(h)).view(np.int64) if len(h) else None)
        return pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(low, pa.int64()),
            pa.array(high, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
        ], ["id", "version", "size", "d1", "d2", "keys"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return batches(rows, run, f"id {docs.schema[id_col].dataType.simpleString()}, version long, size long, d1 long, d2 long, keys array<long>", setup=_Words)


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``pairs(a, b)`` with the sizes of intersection and union of their full sets."""
    held = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"
    ).select("a", "b", "text_a", "text_b")

    def run(batch: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        inter, union = [], []
        for text_a, text_b in zip(batch.column(2), batch.column(3), strict=True):
            text_a = text_a.as_py()
            if state.get("text") != text_a:  # rows of one centre come together
                state["text"], state["set"] = text_a, shingles(text_a, n, state["words"])
            x, y = state["set"], shingles(text_b.as_py(), n, state["words"])
            both = len(np.intersect1d(x, y, assume_unique=True))
            inter.append(both)
            union.append(len(x) + len(y) - both)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(union, pa.int64())],
            ["a", "b", "both", "either"],
        )

    kind = pairs.schema["a"].dataType.simpleString()
    return batches(held, run, f"a {kind}, b {kind}, both long, either long", setup=lambda: {"words": _Words()})


def _linked(checked: DataFrame) -> DataFrame:
    return checked.where(F.expr(f"100 * both >= {LEAST} * either")).select("a", "b")


def _united(links: DataFrame, more: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with ``more``, and their components."""
    if more.isEmpty():
        return links, known
    return links.union(more), components(links.union(more))


def _tokens(reps: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``(rep, size, tokens)``: the full set of each class."""

    def run(batch: pa.RecordBatch, words: _Words) -> pa.RecordBatch:
        sets = [shingles(t, n, words).view(np.int64) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "size", "tokens"]
        )

    kind = reps.schema["rep"].dataType.simpleString()
    held = texts.join(reps.withColumnRenamed("rep", "id"), "id").select("id", "text")
    return store(batches(held, run, f"rep {kind}, size long, tokens array<long>", setup=_Words), "tokens")


def _able(tokens: DataFrame) -> DataFrame:
    """Members that can link to another: ``(rep, size, lone)``.

    ``lone`` counts shingles that no other member has; the others must be at least 80%
    of the set.
    """
    each = tokens.select("rep", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    common = each.join(shared, "token").groupBy("rep").agg(F.count("*").alias("common"))
    return tokens.select("rep", "size").distinct().join(common, "rep").where(f"100 * common >= {LEAST} * size").select(
        "rep", "size", (F.col("size") - F.col("common")).alias("lone")
    )


def _across(near: DataFrame, joined: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links between members of one bucket in different components.

    A bucket belongs to the group of the component that most of its members have. In a
    group, the members outside that component are asked against all, in blocks of
    bounded weight: a task holds one block of askers and streams one block of members.
    """
    kind = near.schema["rep"].dataType.simpleString()
    now = near.select("key", "rep", "size").join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    most = now.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("kinds")
    ).where("kinds > 1")
    placed = store(now.join(most.select("key", F.col("m.component").alias("grp")), "key").select(
        "grp", "rep", "component", "size", (F.col("component") != F.col("grp")).alias("asks")
    ).distinct(), "groups")
    weight = placed.groupBy("grp").agg(
        F.ceil(F.sum(F.when(F.col("asks"), F.col("size"))) / ASKED_TOKENS).alias("p"), F.ceil(F.sum("size") / MEMBER_TOKENS).alias("q")
    )
    dealt = placed.join(weight, "grp")

    def block(count: str, salt: int):
        return F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(count))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    askers = dealt.where("asks").select("grp", "rep", "component", F.lit(0).alias("side"), block("p", 1).alias("i"), every("q").alias("j"))
    others = dealt.select("grp", "rep", "component", F.lit(1).alias("side"), every("p").alias("i"), block("q", 2).alias("j"))
    rows = askers.unionByName(others).join(tokens.select("rep", "tokens"), "rep")
    rows = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side").select(
        "grp", "i", "j", "side", "rep", "component", "tokens"
    )

    def run(it):
        here, askers, index = None, [], None
        for batch in it:
            a, b = [], []
            parts = [batch.column(k).to_pylist() for k in range(6)]
            sets = batch.column(6)
            for at, (grp, i, j, side, rep, component) in enumerate(zip(*parts, strict=True)):
                if (grp, i, j) != here:
                    here, askers, index = (grp, i, j), [], None
                values = sets[at].values.to_numpy(zero_copy_only=False)
                if side == 0:
                    askers.append((rep, component, values))
                    continue
                if index is None:
                    index = _Postings(askers)
                for other in index.linked(rep, component, values):
                    a.append(min(rep, other))
                    b.append(max(rep, other))
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(4).type), pa.array(b, batch.schema.field(4).type)], ["a", "b"])

    return batches_of(rows, run, f"a {kind}, b {kind}").distinct()


class _Postings:
    """Askers by shingle, so that one member is counted against all of them at once."""

    def __init__(self, askers: list[tuple]) -> None:
        self.askers = askers
        size = [len(v) for _, _, v in askers]
        owner = np.repeat(np.arange(len(askers)), size)
        flat = np.concatenate([v for _, _, v in askers]) if askers else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.token, self.start, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.size = np.array(size)

    def linked(self, rep, component, values: np.ndarray) -> list:
        if not len(self.token):
            return []
        at = np.searchsorted(self.token, values)
        at = at[(at < len(self.token)) & (self.token[np.minimum(at, len(self.token) - 1)] == values)]
        many = self.many[at]
        first = np.repeat(self.start[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many) if len(at) else at
        both = np.bincount(self.owner[first + np.arange(len(first))], minlength=len(self.askers))
        hit = np.flatnonzero(100 * both >= LEAST * (self.size + len(values) - both))
        return [self.askers[k][0] for k in hit.tolist() if self.askers[k][1] != component]


def near_duplicates(docs: DataFrame, *, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, component)`` per row of ``docs``; ``component`` is the smallest id reachable."""
    sets = store(sketched(docs, n, id_col, text_col), "sets")
    known = sets.where("id IS NOT NULL AND size > 0")
    classes = store(known.groupBy("d1", "d2").agg(F.min(F.struct("id", "version", "size", "keys")).alias("r")).select(
        "d1", "d2", F.col("r.id").alias("rep"), F.col("r.version").alias("version"), F.col("r.size").alias("size"),
        F.col("r.keys").alias("keys"),
    ), "classes")
    # dealt once for both: the smallest of each bucket, and the bucket's rows
    banded = classes.select("rep", F.explode("keys").alias("key")).repartition("key")
    centres = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").drop("last")
    buckets = store(banded.join(centres, "key").select("key", "rep", "hub"), "buckets")
    stars = store(buckets.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    needed = stars.select(F.col("a").alias("rep")).union(stars.select("b")).distinct()
    at = classes.join(needed, "rep").select("rep", "version")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
    # texts that no pair asks for are not moved
    rows = possible(rows, "id", needed, "_asked").where("_asked").drop("_asked")
    texts = store(rows.join(
        at.withColumnRenamed("version", "v").hint("shuffle_hash"), (F.col("id") == F.col("rep")) & (F.col("version") == F.col("v"))
    ).select("id", "text"), "texts")
    found = store(_verified(stars, texts, n), "verified")
    links = _linked(found)
    first = components(links)
    # links that no star shows lie between members of one bucket in different components
    placed = buckets.where("rep <> hub").join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    members = store(placed.join(mixed, "key").select("key", "rep", "component"), "members")
    tokens = _tokens(members.select("rep").distinct(), texts, n)
    near = store(members.join(_able(tokens), "rep"), "members")
    # second stars, about the member of a bucket with the fewest shingles of its own
    middle = near.groupBy("key").agg(F.min(F.struct("lone", "rep", "component")).alias("m"))
    pairs = near.join(middle, "key").where(F.col("component") != F.col("m.component")).select(
        F.least("rep", "m.rep").alias("a"), F.greatest("rep", "m.rep").alias("b")
    ).distinct()
    again = store(_verified(pairs.join(found.select("a", "b"), ["a", "b"], "left_anti"), texts, n), "verified")
    links, joined = _united(links, _linked(again), first)
    links, joined = _united(links, store(_across(near, joined, tokens), "links"), joined)
    member = classes.select("d1", "d2", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component")
    )
    out = sets.select("id", "size", "d1", "d2").join(member, ["d1", "d2"], "left").select(
        "id", "size", F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component")
    )
    return out.withColumn("component", F.when(F.col("id").isNotNull(), F.col("component")))


def deduplicated(docs: DataFrame, *, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Equal rows are one document. Where an id has several texts each is a document of its own.
    """
    digest = F.xxhash64(text_col)
    several = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    if several.where("lo <> hi").isEmpty():
        groups = store(near_duplicates(docs, n=n, id_col=id_col, text_col=text_col), "groups")
        gone = groups.where("id <> component").select(F.col("id").alias("_gone")).distinct()
        return _once(_without(docs, id_col, gone), id_col, groups)
    (key,) = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col, text_col)))
    groups = store(near_duplicates(keyed, n=n, id_col=key, text_col=text_col), "groups")
    names = keyed.select(F.col(key).alias("id"), F.col(id_col).alias("name")).distinct()
    members = groups.where("id IS NOT NULL").select("id", "component").distinct().join(names, "id")
    keepers = members.groupBy("component").agg(F.min_by("id", F.struct("name", "id")).alias("keeper"))
    gone = members.join(keepers, "component").where("id <> keeper").select(F.col("id").alias("_gone")).distinct()
    return _once(_without(keyed, key, gone), key, groups).drop(key)


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``key`` is in ``gone``; only rows that could be are moved for it."""
    (name,) = fresh(docs, "asked")
    gone = store(gone, "gone")
    marked = possible(docs, key, gone, name)
    doubtful = marked.where(F.col(name)).join(gone.hint("merge"), F.col(key) == F.col("_gone"), "left_anti")
    return marked.where(~F.col(name)).unionByName(doubtful).drop(name)


def _once(docs: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """``docs`` with one row for each key that is not NULL."""
    if groups.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        return docs
    return docs.where(F.col(key).isNull()).unionByName(docs.where(F.col(key).isNotNull()).dropDuplicates([key]))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 80% of their two-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), n=2)
    return found.select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )

"""Alignment of two tokenizers' tokens over a corpus by inverted pair bitmaps.

A text, with a space before it, is cut into tokens by a byte-level vocabulary (A) and a
piece vocabulary (B). Both cut the same bytes, so every stretch between neighbouring cuts of
either lies in one A and one B token: the stretches are the links, and the cuts that both
share bound the groups. All of it is arithmetic on sorted offsets, a batch of texts at a time.

*Index.* A task numbers its documents within chunks. For every id pair linked in a chunk it
keeps the set of documents: a sorted list of 16-bit numbers, or one bit per document
where that is shorter. Sets of batches are OR-merged into their chunk's. Planes hold the
multiplicity: bit ``p`` of (links of the pair in the document - 1) puts the document into
plane ``p``. Chunks share no document, so OR-merging across chunks is a union of rows, and
popcounts add up: a pair's documents are the popcounts of its sets, its links those plus
``2**p`` times the popcounts of its planes. Both are partial aggregates in Spark.

*Scores.* A pair's document count goes back along its postings: every set and plane is joined
with it, dealt by chunk, and expanded into sums per document there. A pair that every chunk
holds has one row for each of its sets a chunk, never one a document.

Batches, chunks and the sums of one chunk are bounded; documents are never gathered. The
vocabularies are read on the driver from paths that are parameters and broadcast as bytes; their
tables are as long as the vocabularies. Equal ids in A's table of maxima: at most one row an A id.

NULL and empty texts, and texts whose A or B bytes do not join to the space and the text
(signs that B normalises), have no tokens: counts 0 and an empty digest. Strings of special
tokens inside a text are plain text. Repeated rows and rows without an id are documents of their
own. Empty tables give no rows. Extra columns are ignored; ids may have any type.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.common import batches_of, pieces, store, table

#: Where the query finds its vocabularies; the operator takes any paths.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of a chunk (their numbers have 15 bits) and postings after which a chunk ends.
CHUNK, CHUNK_POSTINGS = 1 << 15, 1 << 22
#: Bytes of a set with one bit per document; a list of numbers is always shorter.
DENSE = CHUNK // 8
#: Signs whose classes no version of the Unicode tables differs in.
SETTLED = re.compile("[\x00-ɏ]*")
MARK = "▁"


def byte_signs() -> dict[str, int]:
    """Byte of each sign that byte-level vocabularies write: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Codec:
    """Both tokenizers, made from the bytes of their files."""

    def __init__(self, byte_json: bytes, piece_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        said = json.loads(byte_json)
        sign, vocab = byte_signs(), self.a.get_vocab()
        size = max(vocab.values()) + 1
        self.a_bytes = [b""] * size
        added = {t["content"] for t in said.get("added_tokens", ())}
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode("utf-8") if token in added else bytes(sign[c] for c in token)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode("utf-8"))
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        na, nb = [b"%d" % i for i in range(size)], [b"%d" % i for i in range(len(self.b_bytes))]
        #: ids as written in a digest: A inside and at the end of its half of a group, then B
        self.written = [n + s for names, signs in ((na, b",|"), (nb, b",;")) for s in (signs[:1], signs[1:]) for n in names]
        self.ranks = self._ranked(said, vocab, added)

    def _ranked(self, said: dict, vocab: dict[str, int], added: set[str]):
        """The same vocabulary as ranks, which cuts faster; None unless ids are in the order of the merges."""
        import tiktoken

        merges = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        ids = [vocab["".join(m)] for m in merges]
        first = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or first.get("type") != "ByteLevel" or not first.get("use_regex", True) or ids != sorted(set(ids)):
            return None
        ranks = {self.a_bytes[i]: i for t, i in vocab.items() if t not in added}
        # fixed value: how a byte-level vocabulary parts a text before merging
        parts = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranks", pat_str=parts, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self.ranks and SETTLED.fullmatch(text):
                out[i] = self.ranks.encode_ordinary(text)
            else:
                slow.append(i)
        for i, e in zip(slow, self.a.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


@lru_cache(2)
def _codec(byte_json: bytes, piece_model: bytes) -> Codec:
    return Codec(byte_json, piece_model)


@dataclass
class Aligned:
    """Tokens and links of the rows of one piece; ``rows`` says which rows have tokens."""

    rows: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    link_row: np.ndarray  # per link its place in ``rows``
    link_a: np.ndarray
    link_b: np.ndarray


def align(texts: list[str | None], codec: Codec) -> Aligned:
    some = [i for i, t in enumerate(texts) if t]
    spaced = [" " + texts[i] for i in some]
    ids_a, ids_b = codec.encode_a(spaced), codec.encode_b([texts[i] for i in some])
    keep = []
    for i, text in enumerate(spaced):
        want = text.encode("utf-8")
        if b"".join(map(codec.a_bytes.__getitem__, ids_a[i])) == want and b"".join(map(codec.b_bytes.__getitem__, ids_b[i])) == want:
            keep.append(i)
    n_a = np.array([len(ids_a[i]) for i in keep], np.int64)
    n_b = np.array([len(ids_b[i]) for i in keep], np.int64)
    a = np.fromiter((t for i in keep for t in ids_a[i]), np.int64, int(n_a.sum()))
    b = np.fromiter((t for i in keep for t in ids_b[i]), np.int64, int(n_b.sum()))
    end_a, end_b = np.cumsum(codec.a_length[a]), np.cumsum(codec.b_length[b])
    total = int(end_a[-1]) + 1 if len(a) else 1
    cut_a, cut_b = np.zeros(total, bool), np.zeros(total, bool)
    cut_a[end_a], cut_b[end_b] = True, True
    both, cuts = cut_a & cut_b, np.flatnonzero(cut_a | cut_b)
    row_a = np.repeat(np.arange(len(keep)), n_a)
    at_a = np.cumsum(cut_a)[cuts] - cut_a[cuts]
    at_b = np.cumsum(cut_b)[cuts] - cut_b[cuts]
    link_row = row_a[at_a] if len(cuts) else np.zeros(0, np.int64)
    shared = both[end_a]
    before = np.cumsum(both) - both  # groups that end earlier
    group_a, group_b = before[end_a], before[end_b]
    groups = int(both.sum())
    # A's tokens of a group, then B's
    seen_a = np.cumsum(np.bincount(group_a, minlength=groups))
    seen_b = np.cumsum(np.bincount(group_b, minlength=groups))
    written = np.zeros(len(a) + len(b), np.int64)
    size_a, size_b = len(codec.a_bytes), len(codec.b_bytes)
    if groups:
        earlier_b = np.r_[0, seen_b[:-1]]
        written[np.arange(len(a)) + earlier_b[group_a]] = a + np.where(shared, size_a, 0)
        written[np.arange(len(b)) + seen_a[group_b]] = 2 * size_a + b + np.where(both[end_b], size_b, 0)
    ends = np.cumsum(n_a + n_b)
    digests = [
        hashlib.sha256(b"".join(map(codec.written.__getitem__, written[e - n : e].tolist()))[:-1]).hexdigest()
        for e, n in zip(ends.tolist(), (n_a + n_b).tolist(), strict=True)
    ]
    per_row = len(keep)
    return Aligned(
        np.array([some[i] for i in keep], np.int64), n_a, n_b,
        np.bincount(row_a[shared], minlength=per_row), np.bincount(link_row, minlength=per_row), digests,
        link_row, a[at_a], b[at_b],
    )


# -- sets of documents -----------------------------------------------------------------------


def or_merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sets of several batches as one: (pair and document, links) sorted; a document's links add up."""
    key = np.concatenate([k for k, _ in parts])
    times = np.concatenate([t for _, t in parts])
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(times, first) if len(first) else times


def compressed(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pairs, popcounts and compressed sets of sorted ``pair << 16 | document`` numbers."""
    pair, doc = key >> 16, (key & 0xFFFF).astype("<u2")
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    count = np.diff(np.r_[first, len(key)])
    dense = 2 * count >= DENSE
    length = np.where(dense, DENSE, 2 * count)
    offset = np.r_[0, np.cumsum(length)].astype(np.int32)
    data = np.zeros(int(offset[-1]), np.uint8)
    of = np.repeat(np.arange(len(first)), count)
    listed = ~dense[of]
    rank = np.arange(len(key)) - first[of]
    data.view("<u2")[(offset[:-1] // 2)[of[listed]] + rank[listed]] = doc[listed]
    for i in np.flatnonzero(dense):
        bits = np.zeros(CHUNK, bool)
        bits[doc[first[i] : first[i] + count[i]]] = True
        data[offset[i] : offset[i + 1]] = np.packbits(bits, bitorder="little")
    sets = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offset), pa.py_buffer(data)])
    return pair[first], count, sets


def expanded(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Documents of all sets one after the other, and how many each has."""
    offset = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1]
    length = np.diff(offset)
    data = np.frombuffer(sets.buffers()[2], np.uint8)[offset[0] : offset[-1]] if len(sets) and sets.buffers()[2] else np.zeros(0, np.uint8)
    dense = np.flatnonzero(length == DENSE)
    if not len(dense):
        return np.frombuffer(data.tobytes(), "<u2").astype(np.int64), length // 2
    count, parts, done = length // 2, [], 0
    for i in dense:
        at = int(offset[i] - offset[0])
        parts.append(np.frombuffer(data[done:at].tobytes(), "<u2"))
        members = np.flatnonzero(np.unpackbits(data[at : at + DENSE], bitorder="little"))
        parts.append(members.astype("<u2"))
        count[i], done = len(members), at + DENSE
    parts.append(np.frombuffer(data[done:].tobytes(), "<u2"))
    return np.concatenate(parts).astype(np.int64), count


class _Chunk:
    """Documents numbered so far and the sets of their pairs."""

    def __init__(self, number: int) -> None:
        self.number, self.docs, self.postings, self.parts = number, 0, 0, []

    def add(self, found: Aligned, first: int, size_b: int) -> None:
        key = ((found.link_a * size_b + found.link_b) << 16) | (first + found.rows[found.link_row])
        part = np.unique(key, return_counts=True)
        self.parts.append(part)
        self.postings += len(part[0])

    def planes(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
        """``(plane, links a document of it stands for, pairs, popcounts, sets)``; plane -1 is the set itself."""
        if not self.parts:
            return
        key, times = or_merged(self.parts)
        if len(key):
            yield -1, 1, *compressed(key)
            extra = times - 1
            for p in range(int(extra.max()).bit_length()):
                in_plane = key[(extra >> p) & 1 == 1]
                if len(in_plane):
                    yield p, 1 << p, *compressed(in_plane)


def pair_index(docs: DataFrame, byte_json: bytes, piece_model: bytes, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: documents (``pair`` NULL) with their counts, and sets of a chunk's pairs."""
    sent = docs.sparkSession.sparkContext.broadcast((byte_json, piece_model))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"chunk long, local int, id {kind}, n_a long, n_b long, n_groups long, n_links long, digest string, "
        "pair long, plane int, times long, documents long, members binary"
    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value)
        size_b, base = len(codec.b_bytes), TaskContext.get().partitionId() << 32
        chunk, id_type = _Chunk(base), pa.int64()

        def row(n: int, **given) -> pa.RecordBatch:
            types = {
                "chunk": pa.int64(), "local": pa.int32(), "id": id_type, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
                "n_links": pa.int64(), "digest": pa.string(), "pair": pa.int64(), "plane": pa.int32(), "times": pa.int64(),
                "documents": pa.int64(), "members": pa.binary(),
            }
            return pa.RecordBatch.from_arrays(
                [given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in types.items()],
                list(types),
            )

        def sets() -> Iterator[pa.RecordBatch]:
            for plane, times, pair, count, members in chunk.planes():
                for i in range(0, len(pair), 1 << 16):
                    n = min(1 << 16, len(pair) - i)
                    yield row(
                        n, chunk=np.full(n, chunk.number), pair=pair[i : i + n], plane=np.full(n, plane, np.int32),
                        times=np.full(n, times), documents=count[i : i + n], members=members.slice(i, n),
                    )

        for batch in it:
            id_type = batch.column(0).type
            for first, texts in pieces(batch.column(1).to_pylist()):
                if chunk.docs + len(texts) > CHUNK or chunk.postings > CHUNK_POSTINGS:
                    yield from sets()
                    chunk = _Chunk(chunk.number + 1)
                found, n = align(texts, codec), len(texts)
                chunk.add(found, chunk.docs, size_b)
                counts = np.zeros((4, n), np.int64)
                counts[:, found.rows] = found.n_a, found.n_b, found.n_groups, found.n_links
                digest = [""] * n
                for r, d in zip(found.rows.tolist(), found.digests, strict=True):
                    digest[r] = d
                yield row(
                    n, chunk=np.full(n, chunk.number), local=np.arange(chunk.docs, chunk.docs + n, dtype=np.int32),
                    id=batch.column(0).slice(first, n), n_a=counts[0], n_b=counts[1], n_groups=counts[2], n_links=counts[3], digest=digest,
                )
                chunk.docs += n
        yield from sets()

    return batches_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)


def _sums(postings: DataFrame) -> DataFrame:
    """``(chunk, local, n_best, count_sum)`` from sets with their pair's count, sorted by chunk."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), now, np.int64)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])],
                ["chunk", "local", "n_best", "count_sum"],
            )

        for batch in it:
            if not batch.num_rows:
                continue
            chunk, times, count, is_best = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            edges = np.r_[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(chunk)]
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if now is None or chunk[s] != now:
                    if now is not None:
                        yield done()
                    now, best, total = chunk[s], np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
                docs, size = expanded(batch.column(1).slice(s, e - s))
                np.add.at(total, docs, np.repeat(times[s:e] * count[s:e], size))
                np.add.at(best, docs, np.repeat(times[s:e] * is_best[s:e], size))
        if now is not None:
            yield done()

    return batches_of(postings, run, "chunk long, local int, n_best long, count_sum long")


@dataclass
class Alignment:
    """Everything the two vocabularies have in common on a corpus."""

    documents: DataFrame  # id, counts and digest of every row, with its scores
    pairs: DataFrame  # (a, b, documents, links) of every linked id pair


def aligned(
    docs: DataFrame, *, byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text",
) -> Alignment:
    """Index ``docs`` and score every document by its pairs' document counts."""
    with open(byte_path, "rb") as a, open(piece_path, "rb") as b:
        byte_json, piece_model = a.read(), b.read()
    size_b = len(_codec(byte_json, piece_model).b_bytes)
    index = store(pair_index(docs, byte_json, piece_model, id_col, text_col), "pairs")
    sets = index.where("pair IS NOT NULL").select("chunk", "pair", "plane", "times", "documents", "members")
    pairs = store(
        sets.groupBy("pair").agg(
            F.sum(F.when(F.col("plane") < 0, F.col("documents"))).alias("count"), F.sum(F.col("times") * F.col("documents")).alias("links")
        ).withColumn("a", F.expr(f"pair div {size_b}")), "counts",
    )
    highest = pairs.groupBy("a").agg(F.max("count").alias("highest"))  # a row for each id of A at most
    judged = pairs.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("is_best"))
    postings = sets.join(judged, "pair").select("chunk", "members", "times", "count", "is_best")
    sums = _sums(postings.repartition("chunk").sortWithinPartitions("chunk"))
    rows = index.where("pair IS NULL").select("chunk", "local", "id", "n_a", "n_b", "n_groups", "n_links", "digest")
    zero = F.lit(0).cast("long")
    out = rows.join(sums, ["chunk", "local"], "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), F.col("digest").alias("groups_sha256"),
    )
    return Alignment(out, pairs.select("a", F.expr(f"pair % {size_b}").alias("b"), F.col("count").alias("documents"), "links"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups, links and scores of every document under the two public vocabularies."""
    out = aligned(table(spark, sf_dir, "documents").select("doc_id", "text")).documents
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))

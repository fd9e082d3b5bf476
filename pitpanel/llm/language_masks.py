"""Language identification by bit-sliced Bloom filters over character n-grams.

One filter serves all languages: every slot is a row of bits, one bit a language. An
n-gram hashes to ``HASHES`` slots, and the AND of their rows is the mask of all languages
that hold it, in one look-up whatever the number of languages. For a text, the masks of
its n-grams are popcounted per language. Of ``N`` n-grams a language whose filter answers
falsely with probability ``f`` (its share of set bits to the power ``HASHES``) gets
``N f`` for nothing, so ``(count - N f) / (1 - f)`` decides.

*Learning.* N-grams of one to four signs, words parted by one space, are counted over every text
that may be learnt from; tasks count, Spark sums. A language's filter holds an n-gram whose
share of the language's n-grams of that length is at least ``floor`` and no less than one
``ratio``-th of its share in any other language. With ``floor = orders * languages / capacity``
at most ``capacity`` n-grams can pass, whatever the corpus, since shares sum to one; that
bounds what reaches the driver and the filter that is broadcast. Labels are read only from
rows whose ``crc32(id) % 4`` is not 2. Language, source and id are no inputs of a prediction.

*Deciding.* Texts are read whole where they lie, without a shuffle. The language with the
greatest corrected count wins; equal counts go to the language with more learnt n-grams,
then to the smaller name. The score is the winner's part of the corrected counts of the
winner and the runner-up (0.5 where both are 0, 1 without a runner-up).

A text that is NULL or without a letter is ``und`` with score 0; so is every text where
nothing was learnt. Rows without an id are never learnt from and not held out. NULL
languages are not learnt. Equal texts get equal answers. Repeated rows are learnt as often
as they stand. An empty table gives no rows. Extra columns are kept; added ones get a
leading underscore where they clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.common import batches_of, fresh, pieces, table

ORDERS = (1, 2, 3, 4)
CAPACITY, RATIO, HASHES, SLOTS_PER_GRAM = 1 << 21, 4.0, 4, 10
UNKNOWN = "und"
#: Distinct n-grams that a learning task holds before it hands them to Spark.
PENDING = 1 << 21
SPACE = 32


@lru_cache(1)
def _kinds() -> np.ndarray:
    """0 for signs outside words, 1 for letters, 2 for marks that go with letters; by code point."""
    kinds = {"L": 1, "M": 2}
    return np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def read(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per order the hashes of all n-grams and the row of each (ascending); and which rows have a letter."""
    joined = "\0".join(f" {t.lower().replace(chr(0), ' ')} " if t else " " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, cut = _kinds()[code], code == 0
    row = np.cumsum(cut)
    lettered = np.bincount(row[kind == 1], minlength=len(texts)) > 0
    sign = np.where(kind > 0, code, np.uint32(SPACE))
    blank = (kind == 0) & ~cut
    keep = ~cut
    keep[1:] &= ~(blank[1:] & blank[:-1])  # one space between words
    sign, row = sign[keep].astype(np.uint64), row[keep].astype(np.int32)
    space = sign == SPACE
    out, h = [], np.zeros(len(sign), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = max(0, len(sign) - n + 1)
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + sign[n - 1 : n - 1 + m] + np.uint64(n)
        if n in ORDERS:
            if n == 1:
                valid = ~space[:m]
            else:
                valid = row[:m] == row[n - 1 : n - 1 + m]
                for inner in range(1, n - 1):  # spaces stand at the ends of an n-gram only
                    valid &= ~space[inner : inner + m]
                if n == 2:
                    valid &= ~(space[:m] & space[1 : 1 + m])
            at = np.flatnonzero(valid)
            out.append((_mixed(h[at]), row[at]))
    return out, lettered


class _Counts:
    """Counts of (language, order, n-gram) of one task, handed over whenever they grow."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, order: int, grams: np.ndarray) -> None:
        found = np.unique(grams, return_counts=True)
        self.held.setdefault((lang, order), []).append(found)
        self.size += len(found[0])

    def merged(self) -> None:
        for key, parts in self.held.items():
            if len(parts) > 1:
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.zeros(len(grams), np.int64)
                np.add.at(n, at, np.concatenate([c for _, c in parts]))
                self.held[key] = [(grams, n)]
        self.size = sum(len(g) for parts in self.held.values() for g, _ in parts)

    def handed_over(self) -> Iterator[pa.RecordBatch]:
        self.merged()
        for (lang, order), [(grams, n)] in self.held.items():
            for i in range(0, len(grams), 1 << 16):
                g, c = grams[i : i + (1 << 16)], n[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g)), pa.array(np.full(len(g), order, np.int32)), pa.array(g.view(np.int64)), pa.array(c)],
                    ["lang", "length", "gram", "n"],
                )
        self.held, self.size = {}, 0


def gram_counts(learnt: DataFrame) -> DataFrame:
    """``(lang, length, gram, n)`` over all rows of ``learnt(text, lang)``; grams are 64-bit hashes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in it:
            rows = sorted(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True), key=lambda r: r[0])
            langs = [r[0] for r in rows]
            for first, texts in pieces([r[1] for r in rows]):
                here = langs[first : first + len(texts)]
                starts = [i for i in range(len(here)) if not i or here[i] != here[i - 1]]
                for (grams, row), order in zip(read(texts)[0], ORDERS, strict=True):
                    cuts = np.r_[np.searchsorted(row, starts), len(row)]
                    for k, i in enumerate(starts):
                        if cuts[k] < cuts[k + 1]:
                            counts.add(here[i], order, grams[cuts[k] : cuts[k + 1]])
                if counts.size > 2 * PENDING:
                    counts.merged()
                    if counts.size > PENDING:
                        yield from counts.handed_over()
        yield from counts.handed_over()

    part = batches_of(learnt.select("text", "lang"), run, "lang string, length int, gram long, n long")
    return part.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


@dataclass
class MaskFilter:
    """``slices[slot, word]``: bit ``l % 64`` of word ``l // 64`` says that language ``l`` has the slot set."""

    langs: list[str]  # by learnt n-grams, most first, then by name
    slices: np.ndarray
    false: np.ndarray  # per language, the chance of a false answer

    @classmethod
    def built(cls, langs: list[str], lang: np.ndarray, grams: np.ndarray, slots_per_gram: int = SLOTS_PER_GRAM) -> MaskFilter:
        largest = int(np.bincount(lang, minlength=1).max()) if len(lang) else 1
        slots = 1 << max(6, (slots_per_gram * largest - 1).bit_length())
        slices = np.zeros((slots, -(-max(1, len(langs)) // 64)), np.uint64)
        bit = np.uint64(1) << (lang % 64).astype(np.uint64)
        for at in cls.places(grams, slots):
            np.bitwise_or.at(slices, (at, lang // 64), bit)
        fill = [float(((slices[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(langs))]
        return cls(langs, slices, np.array(fill) ** HASHES)

    @staticmethod
    def places(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
        step = (grams >> np.uint64(32)) | np.uint64(1)
        at = grams.copy()
        for _ in range(HASHES):
            yield (at & np.uint64(slots - 1)).astype(np.int64)
            at += step

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """All languages that may hold each n-gram: one row of mask words each."""
        out = None
        for at in self.places(grams, len(self.slices)):
            got = self.slices[at]
            out = got if out is None else out & got
        return out

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected popcounts by row and language, and which rows have a letter."""
        orders, lettered = read(texts)
        total = np.zeros((len(texts), len(self.langs)))
        for grams, row in orders:
            if not len(grams):
                continue
            masks, cuts = self.masks(grams), np.searchsorted(row, np.arange(len(texts) + 1))
            size = np.diff(cuts)
            some = np.flatnonzero(size)
            for k in range(len(self.langs)):
                bits = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                seen = np.add.reduceat(bits.astype(np.int64), cuts[some])
                f = self.false[k]
                total[some, k] += np.maximum(0.0, (seen - size[some] * f) / max(1e-12, 1.0 - f))
        return total, lettered

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, lettered = self.counts(texts)
        best = total.argmax(1)  # the first of equal counts
        top = total[np.arange(len(texts)), best]
        total[np.arange(len(texts)), best] = -1.0
        second = np.maximum(0.0, total.max(1))
        score = np.where(top + second > 0, top / np.maximum(top + second, 1e-300), 0.5 if len(self.langs) > 1 else 1.0)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def fold_of(id_col: Column) -> Column:
    """Remainder of the checksum of an id written as text; NULL without an id."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        capacity: int = CAPACITY, ratio: float = RATIO, slots_per_gram: int = SLOTS_PER_GRAM) -> MaskFilter:
    """Learn the filter from rows outside the held-out fold with a language and a text."""
    learnt = docs.where((fold_of(F.col(id_col)) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    counts = gram_counts(learnt).persist()
    totals = counts.groupBy("lang", "length").agg(F.sum("n").alias("total")).collect()  # languages x orders
    size: dict[str, int] = {}
    for r in totals:
        size[r["lang"]] = size.get(r["lang"], 0) + r["total"]
    langs = sorted(size, key=lambda name: (-size[name], name))
    if not langs:
        counts.unpersist()
        return MaskFilter([], np.zeros((1, 1), np.uint64), np.zeros(0))
    floor = len(ORDERS) * len(langs) / capacity
    of = docs.sparkSession.createDataFrame(
        [(r["lang"], r["length"], langs.index(r["lang"]), float(r["total"])) for r in totals], "lang string, length int, k int, total double"
    )
    shares = counts.join(F.broadcast(of), ["lang", "length"]).select("k", "gram", (F.col("n") / F.col("total")).alias("share"))
    got = shares.where(F.col("share") >= floor).toArrow()  # ``capacity`` rows at most
    counts.unpersist()
    lang, grams, share = (got.column(c).to_numpy() for c in ("k", "gram", "share"))
    _, at = np.unique(grams, return_inverse=True)
    most = np.zeros(at.max() + 1 if len(at) else 0)
    np.maximum.at(most, at, share)
    kept = share * ratio >= most[at]
    return MaskFilter.built(langs, lang[kept].astype(np.int64), grams[kept].view(np.uint64), slots_per_gram)


def identified(docs: DataFrame, model: MaskFilter, *, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with predicted language and score in two added columns, whose names are returned too."""
    lang, score = names = fresh(docs, "lang_pred", "score")
    out = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in it:
            found, scores = [], []
            for _, texts in pieces(batch.column(batch.schema.get_field_index(text_col)).to_pylist()):
                names_here, scores_here = known.decide(texts)
                found += names_here
                scores.append(scores_here)
            columns = list(batch.columns)
            for name, values in zip(names, (pa.array(found, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))), strict=True):
                columns[batch.schema.get_field_index(name)] = values
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return batches_of(out, run, out.schema), lang, score


def op13_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; labels of the held-out quarter are never read."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    out, lang, score = identified(docs.select("doc_id", "text"), model)
    held = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))

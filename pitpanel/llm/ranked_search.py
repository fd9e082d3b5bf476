"""Ranked lexical search by NRA: sorted reads only, with score intervals per document.

Terms, weights and scores are integers (``op11`` states the law): a query's score of a
document sums, over its terms, the term's weight times the document's impact for it.

*Index.* One pass reads every text whole and keeps, per document, its length and the
counts of those terms that some query asks for. That table is written once; corpus
figures (documents, terms, documents per term) are Spark aggregates over it. Queries
come in blocks of bounded size, so the terms asked for fit in a task; each block makes
one pass.

*Search.* Every task cuts its documents into shards of bounded size. In a shard each term
has a list of postings, greatest impact first. For each query NRA reads its lists from the
top, a growing block at a time, and never looks a document up elsewhere. A document's
lower bound sums what was read of it, its upper bound adds, for every list it has not been
seen in, what that list may still give (the impact read last, 0 at its end). Documents whose
upper bound falls below the k-th best lower bound leave; once the bound of an unseen document
has fallen below it too, no more join. Reading goes on until the k best, their ties and their
scores are settled: lower and upper bounds of all that are left are equal. The k best of a
task's earlier shards set the bar for its later ones. A shard ends with k documents at most for a
query, so what is merged is small: first within groups of tasks, then over all.

Work per task is bounded by its documents; a common term or a hot source adds postings to
its shards alone. NULL and empty texts have no terms and count nowhere; queries without
terms find nothing. Ties go to the smaller id, a NULL id last; repeated rows of documents
are documents of their own. Equal query rows count once; an id with several texts is
ranked for each. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitpanel.llm.common import batches_of, store, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
K = 20
#: Bytes of query texts in one block: at most half as many terms reach a task.
BLOCK_BYTES = 2 * 1024 * 1024
#: Bounds of one shard of a task.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 22
#: Postings of a list that are read first, and how each further read grows.
FIRST_READ, GROWTH = 256, 4


def terms(text: str | None) -> list[str]:
    """Maximal runs of digits, letters and all signs beyond ASCII; A-Z lower-cased."""
    # lower() of bytes touches A-Z alone
    return WORD.findall(text.encode("utf-8").lower().decode("utf-8")) if text else []


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, bar: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents ``0..size-1`` that may be among the k best with a score of ``bar`` or more, with exact scores.

    ``lists`` holds (documents, gains) per term, gains descending. All documents tied with
    the k-th stay in. Lists are read from the top in blocks that grow; nothing is looked up.
    """
    lists = [(d, g) for d, g in lists if len(d) and g[0] > 0]
    lower = np.zeros(size, np.int64)
    unread = np.ones((len(lists), size), bool)  # lists that a document has not been seen in
    at, step = [0] * len(lists), FIRST_READ
    last = np.array([g[0] for _, g in lists], np.int64)  # most that each list may still give
    kept: np.ndarray | None = None  # the only documents left, once no unseen one can enter
    while True:
        for t, (docs, gains) in enumerate(lists):
            end = min(len(docs), at[t] + step)
            d, g = docs[at[t] : end], gains[at[t] : end]
            lower[d] += g
            unread[t, d] = False
            at[t] = end
            last[t] = gains[end] if end < len(docs) else 0
        step *= GROWTH
        seen = np.flatnonzero(lower) if kept is None else kept
        floor = bar
        if len(seen) >= k:
            floor = max(floor, int(np.partition(lower[seen], len(seen) - k)[len(seen) - k]))
        upper = lower[seen] + last @ unread[:, seen]
        inside = upper >= floor
        left, upper = seen[inside], upper[inside]
        if kept is not None or int(last.sum()) < floor:
            kept = left
            if (upper == lower[left]).all():
                return left, lower[left]


class Best:
    """The k best of each query so far in one task."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, {}

    def bar(self, query: int) -> int:
        rows = self.rows.get(query, ())
        return rows[-1][0] if len(rows) == self.k else 1

    def add(self, query: int, found: list[tuple[int, object]]) -> None:
        rows = [*self.rows.get(query, ()), *found]
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        self.rows[query] = rows[: self.k]


class Queries:
    """A block of queries by number: their terms, each with weight times repeats."""

    def __init__(self, asked: list[Counter], weights: dict[str, int]) -> None:
        self.names = sorted(weights)
        number = {t: i for i, t in enumerate(self.names)}
        self.asked = [sorted((number[t], n * weights[t]) for t, n in c.items() if t in number and weights[t] > 0) for c in asked]

    def search(self, best: Best, ids: list, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Search one shard: postings (document, term, impact) of documents ``ids``."""
        order = np.lexsort((-impact, term))
        doc, impact, term = doc[order], impact[order], term[order]
        cuts = np.searchsorted(term, np.arange(len(self.names) + 1))
        for query, wanted in enumerate(self.asked):
            lists = [(doc[cuts[t] : cuts[t + 1]], impact[cuts[t] : cuts[t + 1]] * w) for t, w in wanted]
            rows, scores = nra(lists, len(ids), best.k, best.bar(query))
            if len(rows):
                best.add(query, [(int(s), ids[d]) for d, s in zip(rows.tolist(), scores.tolist(), strict=True)])


def _blocks(queries: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Distinct ``(id, text)`` rows in blocks whose size is known before anything is collected."""
    rows = queries.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    for block in range(count):
        yield [(r["id"], r["text"]) for r in dealt.where(F.col("block") == block).select("id", "text").toLocalIterator()]


def term_counts(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, times)`` of every document with a term: its length, and its counts of the vocabulary."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in it:
            keep, length, found, times = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = terms(text)
                if words:
                    keep.append(row)
                    length.append(len(words))
                    here = [(number[t], n) for t, n in Counter(words).items() if t in number]
                    found.append([t for t, _ in here])
                    times.append([n for _, n in here])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int32())), pa.array(length, pa.int64()),
                 pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                ["id", "n", "terms", "times"],
            )

    return batches_of(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
        f"id {kind}, n long, terms array<int>, times array<int>",
    )


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _searched(index: DataFrame, queries: Queries, k: int, documents: int, words: int, kind: str) -> DataFrame:
    """``(query, id, score)``: the k best of every task."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, docs, postings, id_type = Best(k), [], 0, 0, pa.int64()

        def search() -> None:
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            lists = [b.column(2) for b in held]
            size = np.concatenate([np.diff(a.offsets.to_numpy()) for a in lists])
            term = np.concatenate([a.flatten().to_numpy() for a in lists]).astype(np.int64)
            times = np.concatenate([b.column(3).flatten().to_numpy() for b in held]).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), size)
            m = 75 + (25 * n * documents) // words
            impact = (1_000_000_000 * times) // (1000 * times + 12 * m[doc])
            ids = [i for b in held for i in b.column(0).to_pylist()]
            sent.value.search(best, ids, doc, term, impact)

        for batch in it:
            if not batch.num_rows:
                continue
            id_type = batch.column(0).type
            held.append(batch)
            docs, postings = docs + batch.num_rows, postings + len(batch.column(2).flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                search()
                held, docs, postings = [], 0, 0
        if held:
            search()
        rows = [(q, i, s) for q, found in best.rows.items() for s, i in found]
        schema = pa.schema([("query", pa.int32()), ("id", id_type), ("score", pa.int64())])
        for first in range(0, len(rows), 1 << 16):
            part = rows[first : first + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in part], schema.types[j]) for j in range(3)], schema=schema
            )

    return batches_of(index, run, f"query int, id {kind}, score long")


def ranked(
    docs: DataFrame, queries: DataFrame, *, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    query_id: str = "item_id", query_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(query_id, query_text, rank, id_col, score)``: each query's k best documents with a score above 0."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"query int, q_id {queries.schema[query_id].dataType.simpleString()}, q_text string"
    parts = []
    for block in _blocks(queries, query_id, query_text, block_bytes):
        asked = [Counter(terms(text)) for _, text in block]
        vocabulary = sorted({t for c in asked for t in c})
        index = store(term_counts(docs, vocabulary, id_col, text_col), "terms")
        documents, words = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # the block's terms
        weights = {vocabulary[r["term"]]: weight(documents, r["count"]) for r in held}
        # terms keep their numbers of the index
        known = Queries(asked, {t: weights.get(t, 0) for t in vocabulary})
        found = _searched(index, known, k, documents, max(1, words), kind)
        order = [F.desc("score"), F.asc_nulls_last("id")]
        near = Window.partitionBy("query", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(*order)
        found = found.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k).drop("_r")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, *row) for i, row in enumerate(block)], shape)
        parts.append(found.join(names, "query").select(
            F.col("q_id").alias(query_id), F.col("q_text").alias("query_text"), "rank", F.col("id").alias(id_col), "score"
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("doc_id").cast("long").alias("doc_id"), "score")

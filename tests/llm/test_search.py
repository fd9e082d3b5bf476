"""Ranked search: the law by hand, NRA beside full scores, blocks, odd rows."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitpanel.llm import ranked_search as rs
from pitpanel.llm.common import table

from .odd import documents

SF = "/root/testdata/sf0.001"


def naive(docs, items, k):
    """Scores of every document for every item, read off the description."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for _, t in docs]
    counts = [Counter(w) for w in words]
    N, L = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        asked = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        scored = []
        for (doc, _), w, c in zip(docs, words, counts, strict=True):
            score = 0
            for t in asked:
                if t in c:
                    m = 75 + 25 * len(w) * N // L
                    score += math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_whole_table_by_hand(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = rs.op11_ranked_search(spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == naive(docs, items, 20)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 8), st.integers(1, 400), st.integers(1, 30), st.booleans())
def test_nra_finds_the_best_with_ties(seed, lists, size, k, coarse):
    rng = np.random.default_rng(seed)
    postings, full = [], np.zeros(size, np.int64)
    for _ in range(lists):
        docs = rng.choice(size, rng.integers(0, size + 1), replace=False)
        gains = np.sort(rng.integers(0, 4 if coarse else 10**6, len(docs)))[::-1]
        postings.append((docs, gains))
        full[docs] += gains
    rs_first, rs.FIRST_READ = rs.FIRST_READ, 3
    try:
        rows, scores = rs.nra(postings, size, k)
    finally:
        rs.FIRST_READ = rs_first
    best = np.sort(full[full > 0])[::-1]
    floor = best[min(k, len(best)) - 1] if len(best) else 1
    want = {(d, s) for d, s in enumerate(full.tolist()) if s >= max(1, floor)}
    assert set(zip(rows.tolist(), scores.tolist(), strict=True)) == want


def test_nra_stops_before_the_end():
    """A list is read no further than the intervals need."""

    n = 100_000
    docs, gains = np.arange(n), np.r_[np.full(10, 10**6), np.ones(n - 10, np.int64)]
    seen = []

    class Gains:
        def __init__(self, g):
            self.g = g

        def __len__(self):
            return len(self.g)

        def __getitem__(self, at):
            if isinstance(at, slice):
                seen.append(at.stop)
            return self.g[at]

    rows, scores = rs.nra([(docs, Gains(gains))], n, 10)
    assert sorted(rows.tolist()) == list(range(10)) and set(scores.tolist()) == {10**6} and max(seen) <= rs.FIRST_READ


def test_blocks_shards_and_bars(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = sorted(map(str, rs.ranked(docs, items, k=5).collect()))
    assert sorted(map(str, rs.ranked(docs, items, k=5, block_bytes=4000).collect())) == want
    asked = [Counter(rs.terms(r.text)) for r in items.collect()]
    best, many = rs.Best(3), rs.Best(3)
    rng = np.random.default_rng(2)
    names = sorted({t for c in asked for t in c})
    known = rs.Queries(asked, {t: 1 + i % 7 for i, t in enumerate(names)})
    doc, term = np.repeat(np.arange(60), 40), rng.integers(0, len(names), 2400)
    keep = np.unique(doc * 10**6 + term, return_index=True)[1]
    doc, term, impact = doc[keep], term[keep], rng.integers(1, 5, 2400)[keep]
    ids = list(range(60))
    known.search(best, ids, doc, term, impact)
    for part in range(3):  # later shards start from the bar of the earlier ones
        here = doc // 20 == part
        known.search(many, ids[part * 20 : part * 20 + 20], doc[here] - part * 20, term[here], impact[here])
    assert best.rows == many.rows


def test_odd_rows(spark):
    docs = documents(spark).withColumn("rank", F.lit(1)).withColumn("query", F.lit("q"))
    items = spark.createDataFrame(
        [(1, "same words"), (1, "same words"), (1, "text"), (2, None), (3, ""), (4, "zzz"), (None, "PASSWORD text"), (5, "東京 élan ipsum")],
        "item_id long, text string",
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = list({(r.item_id, r.text) for r in items.collect()})
    got = rs.ranked(docs, items, k=3)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == naive(rows, asked, 3)
    assert rs.ranked(docs.limit(0), items).collect() == [] and rs.ranked(docs, items.limit(0)).collect() == []
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert rs.ranked(named, items, k=3).count() == got.count()

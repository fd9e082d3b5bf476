"""MinHash near-dedup against all pairs of exact sets."""

import random
import re

import pytest
from pyspark.sql import Row

from pitpanel.llm.minhash import deduplicated, near_duplicates, op2_minhash_near_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    w = [re.sub(r"[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, n):
    """id -> (size, smallest id reachable) from all pairs of rows."""
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    lo, hi = sorted((root(i), root(j)))
                    parent[hi] = lo
    return {i: (len(s), root(i)) for i, s in sets}


def test_whole_table_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 2)
    got = op2_minhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def chained():
    """Two families whose members link to each other but not to a common centre."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows, text = [], list(base)
    for i in range(30):  # each step changes a few words: neighbours link, ends do not
        rows.append((i + 1, " ".join(text)))
        for at in rng.sample(range(200), 7):
            text[at] = f"x{i}_{at}"
    return rows + [(100 + i, " ".join(base[:150] + [f"y{i}"])) for i in range(40)]


def test_chains_and_hot_groups(spark):
    rows = chained() + [(500 + i, "same text in all of these rows") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.size, r.component) for r in near_duplicates(df, n=2).collect()}
    assert got == brute(rows, 2)


def test_odd_rows(spark):
    rows = [
        Row(doc_id=1, text=None, ID="a"), Row(doc_id=2, text="", ID="a"), Row(doc_id=3, text="One", ID=None),
        Row(doc_id=4, text="one", ID="a"), Row(doc_id=None, text="one", ID="a"), Row(doc_id=5, text=" \t\n", ID="a"),
        Row(doc_id=6, text="é one", ID="a"), Row(doc_id=6, text="é one", ID="a"), Row(doc_id=7, text="w " * 40000, ID="a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, ID string")
    got = sorted(((r.id, r.size, r.component) for r in near_duplicates(df, n=2).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (None, 1, None), (5, 0, 5), (6, 1, 6), (6, 1, 6), (7, 1, 7)], key=str)
    kept = deduplicated(df, n=2)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "None"]
    assert near_duplicates(df.limit(0), n=2).collect() == []


def test_texts_under_one_id_are_not_lost(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, other), (1, other), (0, long + " end"), (7, other + " end"), (7, "nothing like it at all here"), (None, long), (8, None), (8, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Text_Key string")
    kept = deduplicated(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(0, long + " end"), (1, other), (7, "nothing like it at all here"), (None, long), (8, None), (8, "")]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("size", [1, 3, 40, 5000])
def test_sketch_fills_and_estimates(size):
    import numpy as np

    from pitpanel.llm.minhash import BINS, sketch

    rng = np.random.default_rng(size)
    x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    y = np.unique(np.r_[x[: max(1, size * 9 // 10)], rng.integers(0, 1 << 63, size // 10, dtype=np.uint64)])
    a, b = sketch(x), sketch(y)
    assert (a < np.iinfo(np.uint64).max).all()
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((a == b).mean() - true) < 5 * (true * (1 - true) / BINS) ** 0.5 + 1e-9

"""Suffix-array dedup against a dictionary of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import pytest

from pitpanel.llm.suffix_dedup import op7_suffix_array_dedup, without_repeats

SF = "/root/testdata/sf0.001"


def brute(texts):
    """``(n_bytes, n_removed, n_spans, digest of the rest)`` per text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(hash(r[i : i + 200]) for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        spans = []
        for i in range(len(r) - 199):
            if seen[hash(r[i : i + 200])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 200
                else:
                    spans.append([i, i + 200])
        rest, done = b"", 0
        for a, b in spans:
            rest, done = rest + r[done:a], b
        rest += r[done:]
        out.append((len(r), len(r) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
    return out


def digest(rows):
    return sorted(
        (r.id, r.n_bytes, sum(s.end - s.first for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows
    )


def test_whole_table_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows]), strict=True))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_suffix_array_dedup(spark, SF).collect())
    assert got == want and sum(r[2] for r in got) > 0


def made():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(120)
    texts = [prose(rng.randint(0, 60)) + passage[rng.randint(0, 40) : rng.randint(200, 700)] + prose(rng.randint(0, 60)) for _ in range(60)]
    texts += ["a" * 5000, "ab" * 900, passage * 3, "x" * 199, "y" * 200, "z" * 201, None, "", passage, passage, prose(40_000)]
    return texts


@pytest.mark.parametrize("limit", [4096, 2])
def test_edges_periods_and_hot_seeds(spark, limit):
    texts = made()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, TID string")
    got = digest(without_repeats(df, seed_contexts=limit).collect())
    assert got == sorted((i, *b) for i, b in enumerate(brute(texts)))


def test_repeated_ids_nulls_and_no_rows(spark):
    long = "".join(random.Random(2).choice("abcdefgh ") for _ in range(400))
    rows = [(1, long), (1, long), (1, "other" + long[:150]), (None, long[100:]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.n_bytes, len(r.kept)) for r in without_repeats(df).collect()), key=str)
    assert got == sorted([(1, 400, 0), (1, 400, 0), (1, 155, 155), (None, 300, 0), (None, 0, 0)], key=str)
    assert without_repeats(df.limit(0)).collect() == []

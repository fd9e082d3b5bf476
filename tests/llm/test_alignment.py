"""Token alignment: whole results by hand, sets of documents, both ways of cutting, odd rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitpanel.llm import token_alignment as ta
from pitpanel.llm.common import table

from .odd import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return ta.Codec(open(ta.BYTE_BPE, "rb").read(), open(ta.PIECE_BPE, "rb").read())


def naive(texts, codec):
    """Counts, digest and links of each text by nested loops; then the scores."""
    out, held = [], Counter()
    for t in texts:
        if not t:
            out.append(None)
            continue
        a, b = codec.a.encode(" " + t, add_special_tokens=False).ids, codec.b.encode(t)
        ends = []
        for ids, known in ((a, codec.a_bytes), (b, codec.b_bytes)):
            spans, at = [], 0
            for i in ids:
                spans.append((at, at + len(known[i]), i))
                at += len(known[i])
            ends.append((spans, b"".join(known[i] for i in ids)))
        (sa, ba), (sb, bb) = ends
        if ba != (" " + t).encode() or bb != ba:
            out.append(None)
            continue
        links, low = [], 0
        for x, y, i in sa:
            while sb[low][1] <= x:
                low += 1
            k = low
            while k < len(sb) and sb[k][0] < y:
                links.append((i, sb[k][2]))
                k += 1
        shared = sorted({y for _, y, _ in sa} & {y for _, y, _ in sb})
        groups, last = [], 0
        for c in shared:
            groups.append("|".join(",".join(str(i) for _, y, i in s if last < y <= c) for s in (sa, sb)) if len(sa) < 2000 else "")
            last = c
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if len(sa) < 2000 else None
        out.append((len(sa), len(sb), len(shared), links, digest))
        held.update(set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    rows = [
        (0, 0, 0, 0, 0, 0, "") if r is None
        else (*r[:3], len(r[3]), sum(held[p] == best[p[0]] for p in r[3]), sum(held[p] for p in r[3]), r[4])
        for r in out
    ]
    return rows, held, Counter(p for r in out if r for p in r[3])


def check(rows, texts, codec):
    want, held, links = naive(texts, codec)
    for got, w in zip(rows, want, strict=True):
        assert got[:-1] == w[:-1] and (w[-1] is None or got[-1] == w[-1])
    return held, links


def test_whole_table_by_hand(spark, codec):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in ta.op12_token_alignment(spark, SF).collect()}
    assert got.keys() == docs.keys()
    check([got[d] for d in docs], list(docs.values()), codec)


def test_odd_rows_and_pairs(spark, codec):
    extra = [(20, "<|endoftext|> and <s> </s> <0x0A> are plain"), (21, "piece ▁ mark"), (22, "  two  spaces \t\n end "), (23, "🙂" * 50 + "é"),
             (24, "\x00\x01 control"), (25, "don't it's we'll 12345 　 ideographic")]
    odd = documents(spark, extra=False)
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).coalesce(1)
    texts = [r.text for r in docs.collect()]
    out = ta.aligned(docs)
    rows = [tuple(r)[1:] for r in out.documents.collect()]
    want, held, links = naive(texts, codec)
    assert sorted(map(str, rows)) == sorted(str((*w[:-1], w[-1])) if w[-1] is not None else next(str(r) for r in rows if r[:-1] == w[:-1]) for w in want)
    assert {(r.a, r.b): (r.documents, r.links) for r in out.pairs.collect()} == {p: (n, links[p]) for p, n in held.items()}
    assert ta.aligned(docs.limit(0)).documents.collect() == []
    named = ta.aligned(odd.selectExpr("cast(doc_id as string) as id", "text as body", "source as pair"), id_col="id", text_col="body")
    assert named.documents.count() == odd.count()


def test_chunks_do_not_show(spark, monkeypatch, codec):
    docs = [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    found = ta.align(docs, codec)
    whole, parts = ta._Chunk(0), [ta._Chunk(0), ta._Chunk(1)]
    size = len(codec.b_bytes)
    whole.add(found, 0, size)
    for i, c in enumerate(parts):
        c.add(ta.align(docs[i * 30 : i * 30 + 30], codec), 0, size)

    def totals(chunks):
        n, links = Counter(), Counter()
        for c in chunks:
            for plane, times, pair, count, _ in c.planes():
                for p, k in zip(pair.tolist(), count.tolist(), strict=True):
                    n[p] += k if plane < 0 else 0
                    links[p] += times * k
        return n, links

    assert totals([whole]) == totals(parts)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 5))
def test_sets_come_back(seed, pairs):
    rng = np.random.default_rng(seed)
    wanted = [np.sort(rng.choice(ta.CHUNK, rng.choice([1, 3, 100, 2047, 2048, 20_000]), replace=False)) for _ in range(pairs)]
    key = np.concatenate([(np.int64(7 + i) << 16) | w for i, w in enumerate(wanted)])
    pair, count, sets = ta.compressed(key)
    docs, size = ta.expanded(sets)
    assert pair.tolist() == list(range(7, 7 + pairs)) and count.tolist() == size.tolist() == [len(w) for w in wanted]
    assert (docs == np.concatenate(wanted)).all() and max(len(s) for s in sets.to_pylist()) <= ta.DENSE
    some, n = ta.expanded(sets.slice(1, pairs - 1))
    assert (some == np.concatenate([*wanted[1:], np.zeros(0, np.int64)])).all() and n.tolist() == count[1:].tolist()
    odd = key[::2]
    merged, times = ta.or_merged([(key, np.ones(len(key), np.int64)), (odd, np.full(len(odd), 2))])
    assert (merged == key).all() and times.sum() == len(key) + 2 * len(odd)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_ranks_cut_as_the_vocabulary(codec, text):
    assert codec.ranks is not None
    assert codec.encode_a([text]) == [codec.a.encode(text, add_special_tokens=False).ids]


def test_bytes_round_trip(codec):
    for text in ["plain words, signs!", "é ß 東京 🙂", "\n\n  x\t", "A" * 5000]:
        ids = codec.encode_a([text])[0]
        assert b"".join(codec.a_bytes[i] for i in ids) == text.encode()
        assert b"".join(codec.b_bytes[i] for i in codec.encode_b([text])[0]) == (" " + text).encode()

"""Language masks: odd rows, exact sets beside the filter, held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.llm import language_masks as lm
from pitpanel.llm.common import table

from .odd import documents

SF = "/root/testdata/sf0.01"
TEXTS = {
    "en": ["the weather was good and the people went out to the sea", "she thought that nothing would ever be the same again"],
    "fr": ["le temps était beau et les gens allaient vers la mer", "elle pensait que rien ne serait plus jamais comme avant"],
    "de": ["das wetter war schön und die leute gingen an das meer", "sie dachte dass nichts mehr so sein würde wie früher"],
    "ru": ["погода была хорошая и люди пошли к морю", "она думала что ничего уже не будет как прежде"],
}


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i * 10 + j, t, lang) for i, (lang, texts) in enumerate(TEXTS.items()) for j, t in enumerate(texts * 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def naive_grams(text):
    """All n-grams of a text, read off their description."""
    import unicodedata

    signs = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    s = " " + " ".join(signs.split()) + " "
    for n in lm.ORDERS:
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if " " not in g[1:-1] and g.strip():
                yield g


def test_grams_are_those_of_the_description():
    texts = ["Ab  c.", None, "", "éà x", "12 34", "a\0b", "naïve—İstanbul"]
    orders, lettered = lm.read(texts)
    assert lettered.tolist() == [True, False, False, True, False, True, True]
    for row, text in enumerate(texts):
        want = [list(filter(lambda g, n=n: len(g) == n, naive_grams(text or ""))) for n in lm.ORDERS]
        got = [grams[rows == row] for grams, rows in orders]
        assert [len(g) for g in got] == [len(w) for w in want], text
        for g, w in zip(got, want, strict=True):
            assert len(set(g.tolist())) == len(set(w))


def test_filter_never_forgets_and_corrects_false_answers():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 2**64, 30_000, np.uint64)
    lang = np.repeat(np.arange(70), 430)[:30_000] % 70
    known = lm.MaskFilter.built([f"l{i:02}" for i in range(70)], lang, grams, slots_per_gram=6)
    masks = known.masks(grams)
    assert all((int(masks[i, k // 64]) >> (k % 64)) & 1 for i, k in enumerate(lang.tolist()))
    strange = known.masks(rng.integers(0, 2**64, 50_000, np.uint64))
    share = np.array([((strange[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(70)])
    assert np.abs(share - known.false).max() < 0.01 and 0 < known.false.max() < 0.2


def test_same_as_exact_sets(spark, small):
    model = lm.fit(small)
    learnt = [r for r in small.withColumn("f", lm.fold_of(F.col("doc_id"))).collect() if r.f != 2]
    counts = {}
    for r in learnt:
        for g in naive_grams(r.text):
            counts.setdefault((r.lang, len(g)), {}).setdefault(g, 0)
            counts[r.lang, len(g)][g] += 1
    share = {(k[0], g): n / sum(c.values()) for k, c in counts.items() for g, n in c.items()}
    top = {}
    for (_, g), s in share.items():
        top[g] = max(top.get(g, 0), s)
    sets = {lang: {g for (name, g), s in share.items() if name == lang and s * lm.RATIO >= top[g]} for lang in TEXTS}
    probes = ["the people thought", "les gens pensaient", "die leute dachten", "люди думали", "sie war am meer"]
    names, scores = model.decide(probes)
    for probe, name, score in zip(probes, names, scores, strict=True):
        n = sorted(((sum(g in s for g in naive_grams(probe)), lang) for lang, s in sets.items()), reverse=True)
        assert name == n[0][1] and abs(score - n[0][0] / (n[0][0] + n[1][0])) < 0.03
    assert lm.MaskFilter([], np.zeros((1, 1), np.uint64), np.zeros(0)).decide(["x"])[0] == ["und"]


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang")
    got = lm.op13_language_masks(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)


def test_held_out_labels_do_not_matter(spark, small):
    changed = small.withColumn("lang", F.when(lm.fold_of(F.col("doc_id")) == 2, "xx").otherwise(F.col("lang")))
    a, b = lm.fit(small), lm.fit(changed)
    assert a.langs == b.langs and (a.slices == b.slices).all()


def test_odd_rows(spark, small):
    docs = documents(spark).withColumn("LANG_PRED", F.lit(3))
    model = lm.fit(docs.unionByName(small, allowMissingColumns=True))
    out, lang, score = lm.identified(docs, model)
    assert lang == "_lang_pred" and score == "_score" and out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r[score] <= 1 for r in rows)
    for r in rows:
        assert (r[lang] == "und") == (not any(c.isalpha() for c in r.text or "")) and (r[lang] != "und" or r[score] == 0)
    empty = lm.fit(docs.limit(0))
    assert {r[lang] for r in lm.identified(docs, empty)[0].collect()} == {"und"}
    assert lm.identified(docs.limit(0), model)[0].collect() == []

"""Decontamination, secrets and toxicity on odd rows and planted cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.llm import decontaminate as dc
from pitpanel.llm import toxicity as tx
from pitpanel.llm.secrets import RULES, Ledger, Rule, op9_secret_ledger, secrets, versions_of
from pitpanel.session import scratch_root, store

from .odd import documents, same_rows

SF = "/root/testdata/sf0.01"
ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, "short item"), (3, None), (4, ""), (5, ITEM), (None, "nameless item here")], "item_id long, text string")


def test_windows_and_spans(spark, bench):
    rows = [(1, "x One, TWO three four five six seven eight nine ten end"), (2, "one two three four five six seven eight nine"),
            (3, f"a {ITEM} b Short-item c"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in dc.contamination(docs, bench).collect()}
    assert [(got[i].n_hit, got[i].n_items) for i in range(1, 6)] == [(10, 2), (0, 0), (14, 3), (0, 0), (0, 0)]
    assert got[3].items_sha256 == hashlib.sha256(b"1,2,5").hexdigest() and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, mode="span").collect()}
    assert re.sub(r"\W+", " ", cut[3]).split() == ["a", "b", "c"] and cut[4] is None
    assert {r.doc_id for r in dc.decontaminate(docs, bench).collect()} == {2, 4, 5}


def test_blocks_give_the_same(spark, bench):
    docs = documents(spark).union(documents(spark).withColumn("text", F.lit(f"q {ITEM}")))
    one = dc.contamination(docs, bench).collect()
    many = dc.contamination(docs, bench, block_windows=8).collect()
    assert same_rows(one, many) and any(r.contaminated for r in one)


def test_decontamination_odd_rows(spark, bench):
    docs = documents(spark).withColumn("N_Words", F.lit(3))
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert dc.contamination(docs.limit(0), bench).collect() == []
    assert all(r.n_hit == 0 for r in dc.contamination(docs, bench.limit(0)).collect())


def naive_secrets(text):
    """The three kinds, read off their description."""
    out = []
    for m in re.finditer(r"(?i:password|passwd|secret|token|api_key|apikey)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A):
        if len(m.group(1)) >= 8:
            out.append(("assign", 0, *m.span()))
    out += [("access", 1, *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", 2, *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{k}:{a}:{b}" for k, _, a, b in sorted(out, key=lambda f: (f[2], f[1])))


def spans(found):
    return ",".join(f"{f['kind']}:{f['first']}:{f['end']}" for f in found)


def test_secrets_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op9_secret_ledger(spark, SF).collect()}
    assert len(got) == len(rows) and sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 0
    for r in rows:
        want = naive_secrets(r.text or "")
        assert got[r.doc_id].spans == want and got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_secret_shapes(spark):
    texts = ["Api_Key = 'abcd.1234'", "apikey:short", "paſsword=abcdefghij", "token=token=abcdefgh", "AKIA" + "A" * 11, "AKIA" + "A" * 12,
             "é" + "f" * 32 + "g", "secret\"= \"x-y_z/1+2=", "PASSWD:12345678 passwd:1234567"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.path: spans(r.findings) for r in secrets(df).collect()}
    assert got == {i: naive_secrets(t) for i, t in enumerate(texts)} and got[6] == "hex:1:33" and got[2] == ""


def test_ledger_scans_only_what_it_has_not_seen(spark):
    docs = documents(spark)
    ledger = Ledger(spark, f"{scratch_root(spark)}/test-ledger-{id(docs)}")
    first = secrets(docs, ledger=ledger).collect()
    size = ledger.entries().count()
    assert size == len(RULES) * versions_of(docs).select("blob").distinct().count() and len(first) == docs.count()
    assert same_rows(first, secrets(docs, ledger=ledger).collect()) and ledger.entries().count() == size
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(99, "token: new-secret-9")], "doc_id long, text string"))
    assert {r.path for r in secrets(more, ledger=ledger).collect() if r.findings} >= {None, 8, 99}
    assert ledger.entries().count() == size + len(RULES)
    assert secrets(docs.limit(0), ledger=ledger).collect() == []


def test_a_new_or_changed_rule_scans_only_its_own_pairs(spark):
    docs = spark.createDataFrame([(1, "key=AKIA" + "A" * 16 + " pin 123456"), (2, "pin 99 pin 4321"), (3, None)], "doc_id long, text string")
    ledger = Ledger(spark, f"{scratch_root(spark)}/test-rules-{id(docs)}")
    secrets(docs, ledger=ledger)
    entries = lambda: {(r.blob, r.rule) for r in ledger.entries().collect()}
    before = entries()
    pin = Rule("pin", r"pin (\d+)", 1, 4)
    got = {r.path: spans(r.findings) for r in secrets(docs, ledger=ledger, rules=(*RULES, pin)).collect()}
    assert got == {1: "access:4:24,pin:25:35", 2: "pin:7:15", 3: ""}
    assert {rule for _, rule in entries() - before} == {pin.version} and len(entries() - before) == 3
    shorter = pin._replace(least=2)
    got = {r.path: spans(r.findings) for r in secrets(docs, ledger=ledger, rules=(*RULES, shorter)).collect()}
    assert got[2] == "pin:0:6,pin:7:15"
    changed = [pin, shorter, pin._replace(kind="p"), pin._replace(group=0), pin._replace(pattern=r"pin (\d+) ")]
    assert len({r.version for r in changed}) == len(changed)
    # the older rule still has its own findings
    got = {r.path: spans(r.findings) for r in secrets(docs, ledger=ledger, rules=(pin,)).collect()}
    assert got == {1: "pin:25:35", 2: "pin:7:15", 3: ""}


def test_pairs_entered_twice_are_read_once(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "x")], "doc_id long, text string")
    ledger = Ledger(spark, f"{scratch_root(spark)}/test-twice-{id(docs)}")
    first = secrets(docs, ledger=ledger).collect()
    store(ledger.entries()).write.mode("append").parquet(ledger.path)  # as another run at the same time would
    assert ledger.entries().count() == 2 * 2 * len(RULES)
    assert same_rows(first, secrets(docs, ledger=ledger).collect()) and len(first) == 3


@pytest.fixture(scope="module")
def toxic_model(spark):
    words = ["grumpf", "snarkle", "blotch"]
    rows = [(i, f"calm words number {i} stay here" + (f" you {words[i % 3]} and {words[(i + 1) % 3]}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df, tx.fit(df.drop("toxic"), df.select("doc_id", "toxic"))


def test_disguised_words_are_restored(toxic_model):
    _, model = toxic_model
    reader = tx.Reader(model.chars, model.weights)
    for text in ("you grumpf", "you gr.u.m.p.f", "you snarkl3", "b l o t c h", "gruuuumpf", "bl0tch!", "SNARKLE"):
        assert model.score(reader.text(text)) >= tx.THRESHOLD, text
    assert model.score(reader.text("calm words number 7 stay here")) < 0.3


def test_disguises_of_every_shape_beside_clean_texts(toxic_model):
    _, model = toxic_model
    reader = tx.Reader(model.chars, model.weights)
    for word in ("grumpf", "snarkle", "blotch"):
        one_mark = [word[:k] + mark + word[k:] for k in range(1, len(word)) for mark in ".-_,~"]
        doubled = [word[:k] + word[k] + word[k:] for k in range(len(word))]
        spaced = [" ".join(word) + mark for mark in ".,!"] + [" ".join(f"a{word}i"), f'"{" ".join(word)}"']
        for text in (*one_mark, *doubled, *spaced, word + "!", f"({word})"):
            assert model.score(reader.text(f"you {text} stay")) >= tx.THRESHOLD, text
    for text in ("snark1e", "snarkl3", "gr(umpf", "6rumpf", "8lotch", "b|otch", "blo7ch", "blo+ch"):
        assert model.score(reader.text(f"you {text} stay")) >= tx.THRESHOLD, text
    clean = ("calm words, number 7!", "well-known (letters) add 1,000.50 + 455 * 3", "c a l m w o r d s.", "a, b, c", "stay-here", "********", "- - - -")
    for text in clean:
        assert model.score(reader.text(text)) < 0.3, text


def test_signs_at_the_end_of_a_token_are_read():
    rows = np.zeros((tx.LETTERS,) * 3)
    for word in ("idiot", "stay", "calm") * 50:
        path = [0, 0, *(tx.CharModel.of(c) for c in word), 0]
        for gram in zip(path, path[1:], path[2:], strict=False):
            rows[gram] += 1
    chars = tx.CharModel(rows.ravel())
    for text in ("idio7", "idio+", "idio+.", "id-iot", "iddiot", "idiot!", "(idiot)", "id10+!", "1d1ot"):
        assert "idiot" in tx.words_of(text, chars), text
    assert "stay" in tx.words_of("stay!", chars) and tx.words_of("!", chars) <= {"i"}


def test_held_out_labels_do_not_matter(spark, toxic_model):
    df, model = toxic_model
    held = tx.fold_of(F.col("doc_id")) == 1
    other = tx.fit(df.drop("toxic"), df.select("doc_id", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic")), chars=model.chars)
    assert other.weights == model.weights and other.bias == model.bias


def test_toxicity_odd_rows(spark, toxic_model):
    _, model = toxic_model
    docs = documents(spark)
    out, name = tx.scored(docs, model)
    rows = out.collect()
    assert name == "_score" and len(rows) == docs.count() and out.columns[:-1] == docs.columns
    by = {r.doc_id: r[name] for r in rows}
    assert by[2] == by[3] == by[4] and by[6] == by[7] and all(0 <= r[name] <= 1 for r in rows)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.fit(docs, labels).score(set()) < 1e-6
    assert tx.scored(docs.limit(0), tx.fit(docs.limit(0), labels))[0].collect() == []


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = tx.op4_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right > 0.93 and sum(r.predicted and not r.toxic for r in rows) <= 1


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that only the rows with the largest digests hold is learnt like any other."""
    ids = spark.range(15_000).where(tx.fold_of(F.col("id")) != 1).withColumn("h", F.xxhash64("id"))
    last = ids.approxQuantile("h", [0.97], 0.0)[0]
    late, early = F.col("h") > last, F.col("id") % 50 == 0
    word = F.when(late, "zorblat").when(early, "grumpfel").otherwise("garden")
    df = ids.select(
        F.col("id").alias("doc_id"), F.concat(F.lit("the quiet river and the "), word).alias("text"), (late | early).cast("int").alias("toxic")
    ).cache()
    assert df.count() > 9000
    model = tx.fit(df.drop("text").join(df.drop("toxic"), "doc_id").drop("toxic"), df.select("doc_id", "toxic"))
    reader = tx.Reader(model.chars, model.weights)
    assert all(model.score(reader.text(f"a {w} here")) >= tx.THRESHOLD for w in ("zorblat", "grumpfel"))
    assert model.score(reader.text("a garden here")) < tx.THRESHOLD

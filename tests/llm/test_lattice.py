"""The character lattice: every path of short tokens by enumeration, and the skip that loses nothing."""

import random

import numpy as np
import pytest

from pitpanel.llm import toxicity as tx
from pitpanel.llm.common import table

SF = "/root/testdata/sf0.01"
WORDS = ["idiot", "stupid", "moron", "pathetic", "worthless", "clown", "trash"]


@pytest.fixture(scope="module")
def chars():
    counts = np.zeros((tx.LETTERS,) * 3)
    for w in WORDS * 5 + ["letter", "all", "seven", "house", "one", "the", "banana"]:
        c = [0, 0, *map(tx.CharModel.of, w), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            counts[a, b, d] += 1
    return tx.CharModel(counts.ravel())


def every_path(model, token):
    """Best score and word over all ways to read a token, one sign after the other."""
    token = tx.LONG.sub(r"\1\1\1\1", token)
    inside = [any(m.start() <= i < m.end() for m in tx.RUN.finditer(token)) for i in range(len(token))]
    best = []

    def go(i, a, b, last, score, out):
        if i == len(token):
            best.append((score + model.log[a][b][0] if b else score, out) if out else (score, ""))
            return
        sign = token[i]
        if sign.isalpha():
            letters = [(sign, 0.0)]
        else:
            letters = [(c, tx.COST_WILD if sign == "*" else tx.COST_LOOKS) for c in tx.LOOKS.get(sign, "")]
            go(i + 1, a, b, last, score - (tx.COST_GAP if sign in tx.GAP_SIGNS else tx.COST_SIGN), out)
        for c, cost in letters:
            k = model.of(c)
            go(i + 1, b, k, c, score - cost + model.log[a][b][k], out + c)
            if c == last:
                go(i + 1, a, b, last, score - cost - (tx.COST_REPEAT if inside[i] else tx.COST_DOUBLE), out)

    go(0, 0, 0, "", 0.0, "")
    return max(best)


def test_restore_is_the_best_path(chars):
    rng = random.Random(4)
    signs = "idotstupmrnace" + "013457@$!|*.-_é"
    tokens = ["1d10t", "st*pid", "m0r0n", "i.d.i.o.t", "iiidiot", "cl0wn!", "tra$h", "|diot", "***", "...", "a", "*"]
    tokens += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    for token in tokens:
        score, word = every_path(chars, token)
        got = chars.restore(token)
        scores = {w: s for s, w in [(score, word)]}
        assert got == ([word] if word else []), (token, scores)


def test_skipped_tokens_have_no_feature(chars):
    model = chars.knowing({w: 5 for w in WORDS})
    known = {f"={w}": 1.0 for w in WORDS} | {"^idio": 1.0, "$upid": 1.0, "^clow": 1.0, "$oron": 1.0}
    reader, full = tx.Reader(model, known), tx.Reader(model, known)
    full.reach = None
    rng = random.Random(5)
    signs = "abcdeilmnoprstuw" + "013457@$!|*.-_~'" + "é"
    tokens = ["1d10t", "m.o.r.o.n", "s t u p i d", "xidiot", "idio+", "cl0wn5", "tr-ash", "w0r7hl355"]
    tokens += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for w in WORDS:  # disguises
        for _ in range(60):
            back = {"o": "0", "i": "1!|", "e": "3", "a": "4@", "s": "5$", "t": "7+", "l": "|1"}
            t = "".join(rng.choice(back[c]) if c in back and rng.random() < 0.5 else c * rng.choice([1, 1, 1, 3]) for c in w)
            tokens.append(rng.choice(["", "x", "."]) + rng.choice(["", ".", "-"]).join(t) + rng.choice(["", "!", "s", ","]))
    assert sum(map(reader.reach, tokens)) < len(tokens)
    for token in tokens:
        assert set(reader.token(token)) == set(full.token(token)), token
        assert reader.text(f"so {token} it is") == full.text(f"so {token} it is")


def test_reach_keeps_letters_together(chars):
    """Letters that no reading drops may not part a feature: such tokens are not decoded."""
    reach = tx.Reach({"=idiot", "^moro", "$upid"})
    assert not any(map(reach, ["indicator", "kidxiot", "mxoro", "stup1nd", "supplied", "idi ot".replace(" ", "k")]))
    assert all(map(reach, ["idiot", "iiddiioott", "1-d.1?o_t", "xid10+s", "m0r0n", "st*p!d", "mo~~ro", "upppid"]))


def test_plain_words_are_read_as_before(chars):
    model = chars.knowing({w: 5 for w in WORDS})
    tokens = ["idiot", "idiot.", "(idiot)", "idiot!", ")idiot", "*idiot", "idiot's", "letter", "ünfug,", "x²", "²", "a", "$", "\"clown\""]
    for t in tokens:
        word = tx.plain_word(t)
        assert word is None or tx.words_of(t, model) == {word}, t
    assert [tx.plain_word(t) for t in ("idiot.", "idiot's", "letter", ")idiot")] == ["idiot", None, None, None]
    known = {f: 1.0 for w in (*WORDS, "so") for f in tx.features(w)}
    reader, full = tx.Reader(model, known), tx.Reader(model, None)
    for t in [*tokens, *WORDS, "idiots", "clowning", "untrash", "m o r o n", "so m o r o n."]:
        assert reader.text(t) == full.text(t) & known.keys(), t


def test_scores_are_those_of_the_full_decode(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    model = tx.fit(docs, table(spark, SF, "labels"))
    reader, full = tx.Reader(model.chars, model.weights), tx.Reader(model.chars, model.weights)
    full.reach = None
    texts = [r.text for r in docs.collect()]
    assert [model.score(reader.text(t)) for t in texts] == [model.score(full.text(t)) for t in texts]
    tokens = {t for text in texts for t in text.lower().split()}
    assert sum(map(reader.reach, tokens)) < 0.1 * len(tokens)


def test_short_features_do_not_open_every_token(chars, monkeypatch):
    """Features of one or two letters are looked for at the ends of words alone."""
    model = chars.knowing({w: 5 for w in WORDS})
    known = dict.fromkeys(["=l", "=s", "=ol", "^idio", "$tupid", "=moron", "^aabb"], 1.0)
    reader, full, read = tx.Reader(model, known), tx.Reader(model, known), []
    full.reach = None
    whole = tx.words_of
    monkeypatch.setattr(tx, "words_of", lambda token, model: read.append(token) or whole(token, model))
    idle = ["letter", "banana$$$", "well-known", "hello!!", "(266)", "small,", "seven***", "pool", "aidiot", "xmoron"]
    assert not any(reader.token(t) for t in idle) and read == []
    tokens = [*idle, "ll", "l", "s.", "$", "5", "$$$", "ooll", "ool", "mmoroon", "m0ron!!", "sttupid", "st-upid!", "iddiot", "a-l-b", "x.s", "aaabbc", "aabbcd", "xstupidd", "aab"]
    for token in tokens:
        assert set(reader.token(token)) == set(full.token(token)), token
    assert {"=l"} == set(reader.token("ll")) and set(reader.token("sttupid")) == {"$tupid"}


def test_trigrams_of_texts_in_a_row(spark, monkeypatch):
    """Texts counted together give the trigrams of each text alone."""
    monkeypatch.setattr(tx, "COUNTED", 12)
    rows = ["", None, "a", "Bé 東x", "no\0yes", "x" * 40, "ab", "\0", "two  words."]
    got = tx.corpus_model(spark.createDataFrame([(t,) for t in rows], "text string").coalesce(1))
    counts, classes = np.zeros((tx.LETTERS,) * 3), tx._classes()
    for t in rows:
        c = [0, 0, *(int(classes[ord(x)]) if ord(x) < len(classes) else 27 for x in t or ""), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            counts[a, b, d] += 1
    assert got.log == tx.CharModel(counts.ravel()).log

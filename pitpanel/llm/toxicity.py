"""Toxicity by noisy-channel restoration.

Writers hide words by leetspeak, spacing and repetition. Each suspicious token becomes a
lattice: a sign may stand for itself or for the letters it resembles, a separator or a
repeated letter may be dropped. The Viterbi path under a character trigram model, plus
the cost of each disguise, is the restored word. The score is a logistic model over
words and character n-grams of the restored text.

The character model counts all texts of the corpus, one partial table per task, summed
by Spark; its size is the alphabet cubed. The classifier is fitted on all labelled
rows and keeps at most ``max_features`` features, chosen by likelihood ratio; rows with
the same features and label are one weighted row, and a Newton step is one Spark
aggregate over these. Labels come only from rows whose
``crc32(id) % 3`` is not 1; labels, language, source and id are no inputs of a score.
Texts are scored where they lie, without a shuffle, whole, in batches of bounded bytes. When
scoring, only tokens whose signs can spell a feature of the model are decoded (``Reach``).

NULL and empty texts get the score of a text without features. Equal texts get equal
scores. Rows without an id are never learnt from. Without labelled rows, or with labels
of one kind only, every score is the share of toxic labels (0 without any). An empty
table gives no rows. ``scored`` keeps extra columns; its own get a leading underscore
where they clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.common import BATCH_BYTES, BATCH_ROWS, fresh, pieces, possible, store, table

MAX_FEATURES, MIN_TOXIC, MIN_RATIO = 600, 3, 20.0
#: A word is known if so many labelled rows hold it, and so large a share of them; the share bounds the list.
KNOWN_ROWS, KNOWN_SHARE = 3, 3 / 8000
#: Features whose counts a task holds before it passes them on.
HELD_FEATURES = 300_000
#: Features that the driver holds at a time, and pattern rows of one task of the fit.
BAND_FEATURES, FIT_ROWS = 50_000, 2_000
THRESHOLD = 0.7
LETTERS = 28  # boundary, a-z, any other letter
#: Signs and the letters they stand for.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "li", "+": "t", "*": "aeiou", "€": "e", "£": "l", "(": "c",
}
COST_LOOKS, COST_WILD, COST_REPEAT, COST_DOUBLE, COST_GAP, COST_SIGN = 0.7, 2.0, 0.2, 4.0, 0.1, 15.0
COST_EDGE, COST_BREAK, COST_KNOWN, COST_NEW = 1.0, 2.0, 1.0, 8.0
GAP_SIGNS = "._-*~'’ "
DOUBLE = re.compile(r"([^\W\d_])\1")
RUN = re.compile(r"(.)\1\1+")
REPEAT = re.compile(r"(.)\1+")
LONG = re.compile(r"(.)\1{4,}")
PARTS = re.compile(r"[^\W\d_]+")
BREAKS = re.compile(r"[\W\d_]+")
#: Marks that stand for no letter, and those that a clean word may carry at its end.
MARKS = ".,;:?\"'’“”)[]{}<>%#&~=-_/\\"
EDGES = ".,;:?!\"'’“”()[]{}<>%#&*~=-_/\\$+|"
#: Single signs between white space, in quotation marks or before a stop too.
SPACED = re.compile(r"(?<!\S)[\"'‘’“”(\[{<]*\S(?:\s+\S){2,}[.,;:?!\"'’“”)\]}>…]*(?!\S)")
#: The second and third sign of such a run; quicker to look for.
PAIR = re.compile(r"\s\S\s+\S[.,;:?!\"'’“”)\]}>…]*(?!\S)")
#: Signs of text whose trigrams are counted at a time.
COUNTED = 1 << 20


def _classes() -> np.ndarray:
    """Letter class of every code point below 0x250 and, past that, of the alphabetic ones."""
    out = np.zeros(0x3000, np.uint8)
    for i in range(len(out)):
        c = chr(i).lower()
        out[i] = ord(c) - 96 if "a" <= c[:1] <= "z" and len(c) == 1 else 27 if c.isalpha() else 0
    return out


class CharModel:
    """Interpolated trigram log-probabilities over letter classes."""

    def __init__(self, counts: np.ndarray, weight: float = 8.0) -> None:
        three = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float) + 1e-3
        two, one = three.sum(0), three.sum((0, 1))
        p1 = one / one.sum()
        p2 = (two + weight * p1) / (two.sum(1, keepdims=True) + weight)
        p3 = (three + weight * p2[None]) / (three.sum(2, keepdims=True) + weight)
        self.log = np.log(p3).tolist()
        self.words: dict[str, float] = {}
        self.prefixes: set[str] = set()

    def knowing(self, counts: dict[str, int]) -> CharModel:
        """This model with known words, by how often they are seen; a path may spell one at its own price."""
        out, total = copy(self), max(1, sum(counts.values()))
        # a single letter is a word of its own more often in a run of signs than in prose
        counts = counts | {c: max(counts.get(c, 0), total / 1000) for c in "abcdefghijklmnopqrstuvwxyz"}
        out.words = {w: math.log(n / total) for w, n in counts.items()}
        out.prefixes = {w[:n] for w in counts for n in range(1, len(w) + 1)}
        return out

    @staticmethod
    def of(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27

    def restore(self, token: str, *, breaks: bool = False, spaced: bool = False, edges: bool = False) -> list[str]:
        """Words on the best path through the token's lattice.

        With ``breaks`` a sign that is no letter may part two words, with ``spaced`` two
        words may meet between any two signs, with ``edges`` signs before the first and
        after the last letter are dropped cheaply.
        """
        log, prefixes, new = self.log, self.prefixes, COST_NEW if spaced and self.words else 0.0
        token = LONG.sub(r"\1\1\1\1", token)
        paths: dict[tuple[int, int, str], tuple[float, tuple]] = {(0, 0, ""): (0.0, ())}
        spelt: dict[str, tuple[float, tuple]] = {}  # beginnings of known words
        runs = [False] * len(token)
        for m in RUN.finditer(token):
            runs[m.start() : m.end()] = [True] * (m.end() - m.start())
        at_letters = [i for i, sign in enumerate(token) if sign.isalpha()] if edges else []
        first, last_letter = (at_letters[0], at_letters[-1]) if at_letters else (0, len(token))
        for at, sign in enumerate(token):
            drop = COST_REPEAT if runs[at] else COST_DOUBLE
            after: dict[tuple[int, int, str], tuple[float, tuple]] = {}
            letter, options = sign.isalpha(), OPTIONS.get(sign)
            if options is None:
                options = [(sign, self.of(sign), 0.0)] if letter else []
            skip = COST_GAP if sign in GAP_SIGNS else COST_EDGE if edges and not first < at < last_letter else COST_SIGN
            part = COST_GAP if not options or sign in GAP_SIGNS else COST_BREAK
            if spaced:
                self._end_words(paths, spelt, paths, 0.0, new)
            # where two paths come to one state, the first of the best stays
            begun = max((x for key, x in paths.items() if not key[1]), default=None, key=lambda x: x[0])
            spelt_after: dict[str, tuple[float, tuple]] = {}
            for w, (score, path) in [*spelt.items(), *([("", begun)] if begun else [])]:
                for c, _, cost in options:
                    if (key := w + c) in prefixes and ((old := spelt_after.get(key)) is None or score - cost > old[0]):
                        spelt_after[key] = score - cost, (path, c)
                    if w and c == w[-1]:
                        s = score - cost - min(drop, COST_KNOWN)
                        if (old := spelt_after.get(w)) is None or s > old[0]:
                            spelt_after[w] = s, path
                if w and not letter and ((old := spelt_after.get(w)) is None or score - skip > old[0]):
                    spelt_after[w] = score - skip, path
            for state, (score, path) in paths.items():
                a, b, last = state
                row = log[a][b]
                for c, k, cost in options:
                    key, s = (b, k, c), score - cost + row[k]
                    if (old := after.get(key)) is None or s > old[0]:
                        after[key] = s, (path, c)
                    if c == last:
                        s = score - cost - drop
                        if (old := after.get(state)) is None or s > old[0]:
                            after[state] = s, path
                if not letter and ((old := after.get(state)) is None or score - skip > old[0]):
                    after[state] = score - skip, path
            if breaks and not letter:
                self._end_words(paths, spelt, after, part, new)
            paths, spelt = after, spelt_after
        self._end_words(paths, spelt, paths, 0.0, new)
        best = max((x for key, x in paths.items() if not key[1]), default=(0.0, ()), key=lambda x: x[0])
        out, path = [], best[1]
        while path:
            path, c = path
            out.append(c)
        return "".join(reversed(out)).split()

    def _end_words(self, paths: dict, spelt: dict, into: dict, cost: float, new: float) -> None:
        """Let the open word of every path end here; ``new`` is the price of a word that is not known."""
        ends = [((b, 0, ""), score - new + self.log[a][b][0], path) for (a, b, _), (score, path) in paths.items() if b]
        ends += [((self.of(w[-1]), 0, ""), score + self.words[w], path) for w, (score, path) in spelt.items() if w in self.words]
        for key, score, path in ends:
            if key not in into or score - cost > into[key][0]:
                into[key] = score - cost, (path, " ")


#: Letters that a sign may stand for: letter, class, cost.
OPTIONS = {sign: [(c, CharModel.of(c), COST_WILD if sign == "*" else COST_LOOKS) for c in letters] for sign, letters in LOOKS.items()}


class Reach:
    """Which tokens a lattice could turn into a word with a known feature.

    Every letter of a restored word comes from a sign of its own, in order, and no reading leaves a
    letter out unless it repeats the one before; only signs that are no letters may mean nothing. So a
    feature can only arise where its letters stand among the letters that the signs may mean, with
    nothing between them but repeats and such signs. All features are followed at once: a bit for each
    of their letters is set when the letters up to it are found. A token that ends without a full
    feature has none in any reading, and need not be decoded.

    In a token (``token``) a word begins at its start or after a sign that is no letter, and ends at its
    end or before such a sign; so features of beginnings and ends of words are looked for there alone. Where
    no sign may part words, one word takes all letters. In a run of single signs words meet anywhere.
    """

    def __init__(self, known) -> None:
        self.masks: dict[str, int] = {}
        self.starts = self.ends = 0
        self.inner = self.closed = 0  # where features begin that may begin inside a word, and end that end with it
        at = 0
        for f in sorted(known):
            self.starts |= 1 << at
            self.inner |= 0 if f[0] != "$" else 1 << at
            for c in f[1:]:
                self.masks[c] = self.masks.get(c, 0) | 1 << at
                at += 1
            self.ends |= 1 << at - 1
            self.closed |= 0 if f[0] == "^" else 1 << at - 1
        for sign, letters in LOOKS.items():
            self.masks[sign] = 0
            for c in letters:
                self.masks[sign] |= self.masks.get(c, 0)

    def __call__(self, signs: str) -> bool:
        found, masks, starts, ends = 0, self.masks, self.starts, self.ends
        for sign in signs:
            mask = masks.get(sign, 0)
            stay = mask if sign.isalpha() else -1
            found = (found << 1 | starts) & mask | found & stay
            if found & ends:
                return True
        return False

    def token(self, signs: str, breaks: bool = True) -> bool:
        """Whether a token can spell a feature; without ``breaks`` in one word that takes all its letters."""
        found, masks, starts, closed, open_, on = 0, self.masks, self.starts, self.closed, self.ends & ~self.closed, ~self.ends
        start, after = starts, starts
        for sign in signs:
            mask = masks.get(sign, 0)
            if sign.isalpha():
                found = ((found & on) << 1 | start | found) & mask
                start = self.inner
                if not breaks:
                    after = start
            elif breaks and found & closed:
                return True
            else:
                found |= ((found & on) << 1 | start) & mask
                start = after
            if found & open_:
                return True
        return bool(found & closed)


class Spellings:
    """Which words of letters could be restored to one with a known feature: only doubled letters are in doubt."""

    def __init__(self, known) -> None:
        self.whole = {REPEAT.sub(r"\1", f[1:]) for f in known if f[0] == "="}
        self.heads = {REPEAT.sub(r"\1", f[1:]) for f in known if f[0] == "^"}
        self.tails = {REPEAT.sub(r"\1", f[1:]) for f in known if f[0] == "$"}
        self.sizes = [sorted({len(x) for x in xs}) for xs in (self.heads, self.tails)]
        # the shortest piece that all of them hold is looked up first
        self.least = [min(x, default=1) for x in self.sizes]
        self.begun, self.ended = {x[: self.least[0]] for x in self.heads}, {x[-self.least[1] :] for x in self.tails}

    def __call__(self, word: str) -> bool:
        word = REPEAT.sub(r"\1", word)
        return (
            word in self.whole
            or (word[: self.least[0]] in self.begun and any(word[:n] in self.heads for n in self.sizes[0]))
            or (word[-self.least[1] :] in self.ended and any(word[-n:] in self.tails for n in self.sizes[1]))
        )


def _bare(token: str) -> str:
    """The token without marks before it, and without signs after it that a clean word may carry."""
    return token.lstrip(".,;:?\"'’“”([{<%#&*~=-_/\\").rstrip(EDGES)


def words_of(token: str, model: CharModel) -> set[str]:
    """Words of one lower-case token: as it stands, and restored wherever it could be a disguise.

    A sign at the edge may be a letter or a mark, and a sign inside may be a letter, nothing
    or a break; the words of each reading are given.
    """
    s = _bare(token)
    whole = token.strip(MARKS)
    parts = PARTS.findall(s)
    out = {*parts, "".join(parts)} - {""}
    for p in parts:
        if DOUBLE.search(p):
            out.update(model.restore(p))
    for form in {s, whole}:
        if form and not form.isalpha():
            out.update(model.restore(form))
            if len(BREAKS.findall(form)) > 1:
                out.update(model.restore(form, breaks=True))
    if whole != s:
        out.update(model.restore(whole, edges=True))
    return out


def words_of_run(run: str, model: CharModel) -> set[str]:
    """Words of single signs between white space: all of them as one word, and parted where the model parts them."""
    signs = "".join(run.split())
    out = set()
    for form in {signs, signs.strip(MARKS), signs.lstrip(MARKS).rstrip(EDGES)}:
        out.update([form] if form.isalpha() else [], model.restore(form), model.restore(form, spaced=True))
    return out


def features(word: str) -> list[str]:
    """The word and the n-grams at its ends."""
    return [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n), *(f"${word[-n:]}" for n in (5, 6) if len(word) > n)]


def letters_of(token: str) -> str | None:
    """The letters of a lower-case token of letters between marks; only doubled ones are in doubt. None for other tokens."""
    if token.isalpha():
        return token
    whole = token.strip(MARKS)
    return whole if whole.isalpha() and whole == _bare(token) else None


def plain_word(token: str) -> str | None:
    """The only word of a lower-case token of letters between marks; None where ``words_of`` may find others."""
    word = letters_of(token)
    return None if word is None or DOUBLE.search(word) else word


def edges_of(known) -> tuple[frozenset, frozenset, frozenset]:
    """How words with a feature among ``known`` begin, in five letters or in four, or end, in five."""
    heads = [f[1:6] for f in known if f[0] != "$"]
    return frozenset(heads), frozenset(f[1:] for f in known if f[0] == "^" and len(f) == 5), frozenset(f[-5:] for f in known if f[0] == "$")


class Reader:
    """Features of texts among ``known`` (all of them if None), with a cache by token."""

    def __init__(self, model: CharModel, known: dict | None) -> None:
        self.model, self.known, self.cache = model, known, {}
        self.reach = None if known is None else Reach(known)
        self.spelt = Spellings(known or ())
        self.none: set[str] = set()  # tokens without a feature
        self.wanted = frozenset(known or ())
        self.heads, self.short, self.tails = edges_of(self.wanted)

    def token(self, token: str) -> tuple:
        got = self.cache.get(token)
        if got is None:
            self._bound()
            got = self._features(token)
            if got:
                self.cache[token] = got
            else:
                self.none.add(token)
        return got

    def _bound(self) -> None:
        if len(self.cache) + len(self.none) > 300_000:
            self.cache.clear()
            self.none.clear()

    def _able(self, tokens: set[str]) -> list[str]:
        """The tokens that may have a wanted feature: all but words of letters whose ends tell that they have none."""
        heads, short, tails, twice, spelt = self.heads, self.short, self.tails, DOUBLE.search, self.spelt
        return [
            t for t in tokens if not (w := t if t.isalpha() else letters_of(t))
            or w[:5] in heads or w[-5:] in tails or w[:4] in short or twice(w) and spelt(w)
        ]

    def _reached(self, token: str) -> bool:
        """Whether some reading of a token with other signs than marks around letters may have a wanted feature."""
        if not self.reach(token):
            return False
        forms = {_bare(token), token.strip(MARKS)}
        if any(len(BREAKS.findall(form)) > 1 for form in forms):
            return self.reach.token(token)
        parts = PARTS.findall(token)
        return not all(p.isalpha() for p in parts) or bool(self._able(parts)) or any(self.reach.token(f, breaks=False) for f in forms)

    def _features(self, token: str) -> tuple:
        word = letters_of(token)
        plain = word is not None and not DOUBLE.search(word)
        if self.known is None:
            return tuple({f for w in ([word] if plain else words_of(token, self.model)) for f in features(w)})
        if plain:
            return tuple(self.wanted.intersection(features(word))) if self._able([word]) else ()
        # not as it stands either: its own letters are a reading, too
        if self.reach is not None and not (self._reached(token) if word is None else self.spelt(word)):
            return ()
        return tuple(self.wanted.intersection(f for w in words_of(token, self.model) for f in features(w)))

    def text(self, text: str | None) -> set[str]:
        if not text:
            return set()
        low = text.lower()
        tokens, out, cache = set(low.split()), set(), self.cache
        new = tokens - self.none
        if self.reach is not None:
            able = self._able(new)
            self._bound()
            self.none |= new.difference(able)
            new = able
        for t in new:
            out.update(cache.get(t) or self.token(t))
        # the second sign of a run is a token
        for m in SPACED.finditer(low) if 1 in map(len, tokens) and PAIR.search(low) else ():
            if self.reach is not None and not self.reach(m.group()):
                continue
            out.update(
                f for w in words_of_run(m.group(), self.model) for f in features(w) if self.known is None or f in self.known
            )
        return out


def corpus_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Character trigrams counted over every text."""
    classes = _classes()

    def count(it):
        total = np.zeros(LETTERS**3, np.int64)
        for batch in it:
            for _, texts in pieces(batch.column(0).to_pylist(), COUNTED):
                # texts in a row, two boundaries before each and one after; trigrams that reach into the next text go
                code = np.frombuffer("".join(f"\0\0{t or ''}\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                c = np.where(code < len(classes), classes[np.minimum(code, len(classes) - 1)], 27).astype(np.int32)
                index = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
                last = np.cumsum([len(t or "") + 3 for t in texts])[:-1]
                total += np.bincount(np.delete(index, np.concatenate((last - 2, last - 1))), minlength=LETTERS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])

    _bounded_batches(docs.sparkSession)
    # as many rows as the alphabet has trigrams, at most
    rows = docs.select(text_col).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(LETTERS**3)
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return CharModel(counts)


def _pairs(rows: DataFrame) -> dict:
    """First column to second: Arrow batches come to the driver as they are, without an object a row."""
    got = rows.toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def _bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold_of(id_col: Column) -> Column:
    """Remainder of the checksum of an id written as text."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3, F.lit(0))


@dataclass
class Classifier:
    chars: CharModel
    weights: dict[str, float]
    bias: float

    def score(self, found: set[str]) -> float:
        z = self.bias + sum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(rows: DataFrame, width: int, totals: tuple[int, int], ridge: float = 0.005, steps: int = 25) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on weighted binary rows ``(at, y, n)``, by Newton steps.

    A step is one aggregate: tasks sum the gradient and the curvature of their rows, which are
    as large as the features and their pairs.
    """
    toxic, clean = totals
    # the intercept is held near the prior, so that one toxic word alone can carry a text
    w, penalty = np.zeros(width + 1), np.r_[np.full(width, ridge), 0.1 * (toxic + clean)]
    prior = w[width] = math.log((toxic + 0.5) / (clean + 0.5))
    start = w.copy()

    def summed(w: np.ndarray):
        def run(it):
            slope, curve = np.zeros(width + 1), np.zeros((width + 1, width + 1))
            for batch in it:
                for at, y, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    at = np.array([*at, width])
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, w[at].sum()))))
                    slope[at] += n * (y - p)
                    curve[np.ix_(at, at)] += n * max(p * (1 - p), 1e-6)
            both = np.vstack([np.triu(curve), slope]).ravel()  # the curvature is symmetric
            found = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(both[found])], ["i", "v"])

        return run

    for _ in range(steps):
        # at most as many rows as there are pairs of features
        got = rows.mapInArrow(summed(w), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        both = np.zeros((width + 2) * (width + 1))
        both[got["i"].to_numpy()] = got["v"].to_numpy()
        both = both.reshape(width + 2, width + 1)
        curve = both[:-1] + np.triu(both[:-1], 1).T
        step = np.linalg.solve(curve + np.diag(penalty), both[-1] - penalty * (w - start))
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w[:width], w[width]


def _ratio(t: int, n: int, T: int, N: int) -> float:
    """Likelihood ratio of a feature that ``t`` of ``T`` toxic and ``n`` of ``N`` clean rows have."""
    rate = (t + n) / (T + N)
    return 2 * sum(seen * math.log(seen / expected) for seen, expected in ((t, rate * T), (n, rate * N)) if seen > 0)


def _counted(rows: DataFrame, reader, least: int = 1) -> DataFrame:
    """``(feature, n)``: how many texts of ``rows`` have each feature; ``reader()`` gives a task's features of a text."""

    def count(it):
        read, held = reader(), Counter()

        def given():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["feature", "n"])

        for batch in it:
            for text in batch.column(0).to_pylist():
                held.update(read(text))
            if len(held) > HELD_FEATURES:
                yield given()
                held = Counter()
        yield given()

    _bounded_batches(rows.sparkSession)
    return rows.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class PlainReader:
    """Features among ``known`` of a text's letter runs as they stand: some of those that ``Reader`` finds."""

    def __init__(self, known) -> None:
        self.known, self.cache = known, {}
        self.heads, self.short, self.tails = edges_of(known)
        self.none: set[str] = set()  # tokens without a feature

    def __call__(self, text: str | None) -> set[str]:
        out, heads, short, tails = set(), self.heads, self.short, self.tails
        # no run of letters reaches over white space
        new = set((text or "").lower().split()) - self.none
        able = [
            t for t in new if not (w := t if t.isalpha() else t.strip(MARKS)).isalpha() or w[:5] in heads or w[-5:] in tails or w[:4] in short
        ]
        if len(self.cache) + len(self.none) > 300_000:
            self.cache.clear()
            self.none.clear()
        self.none |= new.difference(able)
        for token in able:
            got = self.cache.get(token)
            if got is None:
                got = self.cache[token] = tuple({f for w in PARTS.findall(token) for f in features(w) if f in self.known})
            out.update(got)
        return out


def _looked(picked: DataFrame, sent, wanted: set[str]) -> DataFrame:
    """``(found, y, n)``: labelled rows by the wanted features they have, and how many rows these are."""

    def look(it):
        reader = Reader(sent.value, dict.fromkeys(wanted))
        for batch in it:
            found = [sorted(reader.text(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], ["found", "y"])

    _bounded_batches(picked.sparkSession)
    return store(picked.mapInArrow(look, "found array<string>, y int").groupBy("found", "y").agg(F.count("*").alias("n")), "looked")


def _patterns(found: DataFrame, index: dict[str, int]) -> DataFrame:
    """``(at, y, n)``: rows by the numbers of their chosen features."""

    def number(it):
        for batch in it:
            at = [sorted(index[f] for f in fs if f in index) for fs in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["at", "y", "n"])

    return found.mapInArrow(number, "at array<int>, y int, n long").groupBy("at", "y").agg(F.sum("n").alias("n"))


def _chosen(picked: DataFrame, sent, T: int, N: int, max_features: int) -> tuple[list[str], DataFrame]:
    """The features with the highest likelihood ratios, and the labelled rows by the features they have.

    Only toxic rows are read for every feature. The ratio falls with the clean rows that have a feature, and
    letter runs as they stand are a lower bound of these rows; so features are tried in the order of
    the most their ratio may be, until that is below the worst ratio of those kept. Clean rows are decoded
    for these few alone. Nothing is estimated: the choice is that of all counts.
    """
    clean = picked.where("l_toxic = 0")
    toxic = store(_counted(picked.where("l_toxic <> 0"), lambda: Reader(sent.value, None).text, MIN_TOXIC), "toxic")
    best: list[tuple[float, str]] = []
    found, looks = None, 0
    for times in _bands(toxic):
        bar = max(MIN_RATIO, best[-1][0] if len(best) == max_features else 0)
        if _ratio(times[1], 0, T, N) < bar:  # nor can any feature that fewer rows have
            break
        able = {f: t for f, t in _pairs(toxic.where(F.col("n").between(*times))).items() if _ratio(t, 0, T, N) >= bar}
        if not able:
            continue
        names = picked.sparkSession.sparkContext.broadcast(frozenset(able))
        plain = _pairs(_counted(clean, lambda names=names: PlainReader(names.value)))
        open_ = sorted(
            ((_ratio(t, plain.get(f, 0), T, N), f) for f, t in able.items() if t / T > 4 * plain.get(f, 0) / N), key=lambda x: (-x[0], x[1])
        )
        while open_:
            bar = max(MIN_RATIO, best[-1][0] if len(best) == max_features else 0)
            part, open_ = open_[: 2 * max_features], open_[2 * max_features :]
            wanted = {f for most, f in part if most >= bar}
            if not wanted:
                break
            found, looks = _looked(picked, sent, wanted), looks + 1
            count = _pairs(found.where("y = 0").select(F.explode("found").alias("f"), "n").groupBy("f").agg(F.sum("n").alias("n")))
            for f in wanted:
                n = count.get(f, 0)
                ratio = _ratio(able[f], n, T, N)
                if able[f] / T > 4 * n / N and ratio >= MIN_RATIO:
                    best.append((ratio, f))
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:max_features]
    chosen = [f for _, f in best]
    return chosen, found if looks == 1 else _looked(picked, sent, set(chosen))


def _bands(toxic: DataFrame) -> list[tuple[int, int]]:
    """Ranges of counts, highest first, with about ``BAND_FEATURES`` features each, which the driver looks at together."""
    out, size, high = [], 0, None
    for r in toxic.groupBy("n").count().orderBy(F.desc("n")).collect():
        high, size = high or r["n"], size + r["count"]
        if size >= BAND_FEATURES:
            out.append((r["n"], high))
            size, high = 0, None
        last = r["n"]
    return out + [(last, high)] if high else out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_features: int = MAX_FEATURES, chars: CharModel | None = None) -> Classifier:
    spark = docs.sparkSession
    chars = chars or corpus_model(docs, text_col)
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold_of(F.col(id_col)) != 1)).groupBy(
        F.col(id_col).alias("l_id")
    ).agg(F.max(label_col).cast("int").alias("l_toxic"))
    # texts without a label are not moved; the join is the same at any size
    asked = possible(docs.select(id_col, text_col).where(fold_of(F.col(id_col)) != 1), id_col, one.select("l_id"), "_asked")
    joined = asked.where("_asked").join(one.hint("merge"), F.col(id_col) == F.col("l_id"))
    picked = store(joined.select(F.col(text_col).alias("text"), "l_toxic"), "labelled")
    # words of labelled rows as they stand make restored words more exact
    seen = picked.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("word <> ''")
    least = max(KNOWN_ROWS, math.ceil(KNOWN_SHARE * picked.count()))
    # bounded by the share: at most the distinct words of a mean row, divided by it
    chars = chars.knowing(_pairs(seen.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)))
    sent = spark.sparkContext.broadcast(chars)

    _bounded_batches(spark)
    totals = picked.agg(F.count_if(F.col("l_toxic") != 0).alias("t"), F.count_if(F.col("l_toxic") == 0).alias("n")).first()
    T, N = totals["t"], totals["n"]
    if not T or not N:
        share = T / (T + N) if T + N else 0.0
        return Classifier(chars, {}, math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    chosen_features, found = _chosen(picked, sent, T, N, max_features)
    index = {f: i for i, f in enumerate(chosen_features)}
    rows = store(_patterns(found, index), "patterns")
    # every step reads these rows: no more tasks than they need
    w, b = _logistic(rows.coalesce(max(1, -(-rows.count() // FIT_ROWS))), len(index), (T, N))
    return Classifier(chars, {f: float(w[i]) for f, i in index.items()}, float(b))


def scored(docs: DataFrame, model: Classifier, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the score in an added column, whose name is returned too."""
    (name,) = fresh(docs, "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(name, F.lit(0.0))

    def run(it):
        known = sent.value
        reader = Reader(known.chars, known.weights)
        for batch in it:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            at = batch.schema.get_field_index(name)
            yield batch.set_column(at, batch.schema.field(at), pa.array([known.score(reader.text(t)) for t in texts], pa.float64()))

    _bounded_batches(docs.sparkSession)
    return out.mapInArrow(run, out.schema), name


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of the held-out third are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out, score = scored(docs, model)
    return out.select(
        "doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), F.col(score).alias("score"),
        (F.col(score) >= THRESHOLD).cast("int").alias("predicted"),
    )

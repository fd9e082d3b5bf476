"""A forgiving reader of HTML: elements, text blocks and their features."""

from __future__ import annotations

import html
import re

import numpy as np

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: A tag without ``<`` in it: as most are, and never read beyond the next ``<``.
PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+)>""")
SPECIAL = re.compile(r"""[>"']""")
#: One attribute: its whole name and, after an equals sign, its value.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
TELLING = {"class", "id", "role", "itemprop"}
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template iframe textarea title".split())
#: Never shown as text of the page; all else is for the trees to judge.
UNSEEN = RAW | {"head", "select", "datalist", "desc", "metadata", "annotation"}
FOREIGN = {"svg", "math"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption head button".split()
)
#: A start tag of the first kind closes an open tag of the second kind, unless one of the third lies between.
P_ENDS = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "button", "html", "body", "head", "legend"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
SCOPE = {"table", "td", "th", "caption", "button", "object", "html", "template"}
#: What attribute words and tags say about their part of a page.
GROUPS = {
    "nav": r"nav|menu|breadcrumb|pagination|pager|toc|tabs?$|skip", "header": r"header|masthead|topbar|toolbar|logo|brand",
    "footer": r"foot|copyright|legal|colophon", "side": r"side|aside|widget|rail|related|recommend|popular|trending|complementary",
    "notice": r"cookie|consent|gdpr|notice|alert|warning|popup|modal|overlay|toast|paywall|banner$",
    "ad": r"ad$|ads$|adv|adsense|sponsor|promo|doubleclick|dfp|commercial|outbrain|taboola",
    "form": r"form|login|signin|signup|subscri|newsletter|search|contact|input", "comment": r"comment|reply|replies|disqus|discuss|respond|review|thread",
    "share": r"share|social|follow|tweet|like|rating|tags?$|byline|meta$", "content": r"article|content|post$|entry|story|main|text$|body|prose|blog",
}
GROUP_RE = [re.compile(p) for p in GROUPS.values()]
TAG_GROUP = {
    "nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "dialog": 4, "ins": 5, "form": 6, "fieldset": 6, "button": 6,
    "select": 6, "option": 6, "label": 6, "legend": 6, "search": 6, "article": 9, "main": 9,
}
KINDS = ["#text", "p", "h", "li", "list", "cell", "table", "div", "section", "quote", "inline", "other"]
KIND = {"#text": 0, "p": 1, **{f"h{i}": 2 for i in range(1, 7)}, "li": 3, "dt": 3, "dd": 3, "ul": 4, "ol": 4, "dl": 4, "menu": 4,
        "td": 5, "th": 5, "tr": 6, "table": 6, "tbody": 6, "thead": 6, "div": 7, "section": 8, "article": 8, "main": 8,
        "blockquote": 9, "pre": 9, "figure": 9, "figcaption": 9, "span": 10, "a": 10, "b": 10, "i": 10, "em": 10, "strong": 10}
COMMENT = 1 << list(GROUPS).index("comment")
_attr_cache: dict[str, tuple[int, bool, str | None]] = {}


def _attributes(raw: str) -> tuple[int, bool, str | None]:
    """Groups named by an attribute string as bits, whether it hides the element, and a training mark."""
    got = _attr_cache.get(raw)
    if got is None:
        if len(_attr_cache) > 50_000:
            _attr_cache.clear()
        groups, hides, mark = 0, False, None
        for name, *values in ATTRIBUTE.findall(raw):
            name, value = name.lower(), "".join(values)
            if name == "data-y":
                mark = value
            elif name == "hidden":
                hides = True
            elif name == "style":
                hides |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            elif name in TELLING:
                for t in TOKEN.findall(value):
                    groups |= sum(1 << k for k, p in enumerate(GROUP_RE) if p.match(t.lower()))
        got = _attr_cache[raw] = (groups, hides, mark)
    return got


class _Tags:
    """Tags, comments and declarations of a page from left to right, in linear time.

    A tag ends at the first ``>`` outside quotes. Where none follows, its ``<`` is text;
    what was learned on the way there is kept, so no sign is walked over again.
    """

    def __init__(self, source: str) -> None:
        self.source, self.last = source, source.rfind(">")
        self.near = (0, -1)  # from here on the next special sign is there
        self.ends: dict[int, int] = {}  # end of a tag by the special sign met first; -1 without one

    def _special(self, at: int) -> int:
        m = SPECIAL.search(self.source, at)
        return m.start() if m else len(self.source)

    def _end(self, at: int) -> int:
        lo, q = self.near
        if not lo <= at <= q:
            q = self._special(at)
            self.near = (at, q)
        walked = []
        while True:
            end = self.ends.get(q)
            if end is None and q >= len(self.source):
                end = -1
            elif end is None and self.source[q] == ">":
                end = q
            if end is not None:
                break
            walked.append(q)
            close = self.source.find(self.source[q], q + 1)
            q = len(self.source) if close < 0 else self._special(close + 1)
        for w in walked:
            self.ends[w] = end
        return end

    def next(self, at: int):
        """``(start, end, closing, name, attributes)`` of the next tag; no name for a comment; None at the end."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            if m := PLAIN.match(source, start):
                return start, m.end(), m[1] == "/", m[2].lower(), m[3]
            if source.startswith("<!--", start):
                close = source.find("-->", start + 4)
                return start, len(source) if close < 0 else close + 3, False, None, ""
            if start > self.last:
                # nothing closes any more; only a comment may still come
                comment = source.find("<!--", start)
                return (comment, len(source), False, None, "") if comment >= 0 else None
            if source[start + 1 : start + 2] in ("!", "?"):
                return start, source.find(">", start) + 1, False, None, ""
            if m := OPEN.match(source, start):
                end = self._end(m.end())
                if end >= 0:
                    return start, end + 1, bool(m.group(1)), m.group(2).lower(), source[m.end() : end]
            at = start + 1
        return None


class Page:
    """Nodes in page order: elements that may be decided on, and text blocks as leaves.

    An inline element is no node; its text belongs to the block around it, and what its
    attributes tell counts for the block if the element holds half of the block's text.
    ``marks``: read training marks, which only pages made by this library carry.
    """

    def __init__(self, source: str | None, marks: bool = False) -> None:
        self.tag, self.parent, self.groups, self.label, self.depth = ["#root"], [-1], [0], [None], [0]
        self.text, self.linked, self.end, self.above = [None], [0], [0], [0]
        self.marks = marks
        self._parts: list[str] = []
        self._link = 0
        self._told: dict[int, int] = {}
        if source:
            self._read(source)
        self.end[0] = len(self.tag)

    def _add(self, tag, parent, groups, label) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.groups.append(groups)
        self.label.append(label)
        self.depth.append(self.depth[parent] + 1)
        self.above.append(self.above[parent] | self.groups[parent])
        self.text.append(None)
        self.linked.append(0)
        self.end.append(len(self.tag))
        return len(self.tag) - 1

    def _flush(self, node: int) -> None:
        """Close the running text block; it becomes a leaf of ``node``."""
        if self._parts:
            raw = "".join(self._parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                told = 0
                for k in range(len(GROUPS)) if self._told else ():
                    if 2 * sum(n for g, n in self._told.items() if g >> k & 1) >= len(text):
                        told |= 1 << k
                leaf = self._add("#text", node, told, None)
                self.text[leaf], self.linked[leaf] = text, min(self._link, len(text))
            self._parts, self._link, self._told = [], 0, {}

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool, int]] = [("#root", 0, False, False, 0)]  # tag, node, in a link, unseen, inline groups
        where: dict[str, list[int]] = {}  # places of open tags in the stack
        unseen = 0
        at = 0

        def pop_to(k: int) -> None:
            nonlocal unseen
            while len(stack) > k:
                tag, node, _, dark, _ = stack.pop()
                where[tag].pop()
                unseen -= dark
                below = stack[-1][1]
                if node != below:
                    self._flush(node)
                    self.end[node] = len(self.tag)
                elif tag in BLOCK and not unseen:
                    self._flush(node)

        def innermost(names) -> int:
            return max((where[t][-1] for t in names if where.get(t)), default=0)

        def find(wanted, stop) -> int:
            k = innermost(wanted)
            return k if k and k > innermost(stop) else 0

        lowered = None
        pos = 0
        tags = _Tags(source)
        while m := tags.next(pos):
            start, pos, closing, name, raw = m
            if start > at and not unseen:
                piece = source[at:start]
                self._parts.append(piece)
                if stack[-1][2]:
                    self._link += len(piece.strip())
                if told := stack[-1][4]:
                    self._told[told] = self._told.get(told, 0) + len(piece.strip())
            at = pos
            if name is None:
                continue
            if closing:
                k = find({name}, set() if name not in {"li", "p"} else SCOPE - {"td", "th"})
                if k:
                    pop_to(k)
                continue
            if name in VOID:
                if name == "br":
                    self._parts.append(" ")
                elif name == "hr":
                    self._flush(stack[-1][1])
                continue
            if raw.endswith("/") and (name in FOREIGN or innermost(FOREIGN)):
                continue
            if name in P_ENDS and (k := find({"p"}, SCOPE)):
                pop_to(k)
            if name in CLOSES and (k := find(*CLOSES[name])):
                pop_to(k)
            groups, hides, label = _attributes(raw) if "=" in raw or "hidden" in raw.lower() else (0, False, None)
            if name in TAG_GROUP:
                groups |= 1 << TAG_GROUP[name]
            _, node, link, _, told = stack[-1]
            dark = hides or name in UNSEEN
            if name in BLOCK and not unseen:
                self._flush(node)
                if not dark:
                    node = self._add(name, node, groups, label if self.marks else None)
            elif name not in BLOCK:
                told |= groups
            unseen += dark
            where.setdefault(name, []).append(len(stack))
            stack.append((name, node, link or name == "a", dark, told))
            if name in RAW:
                if lowered is None:
                    lowered = source.lower() if len(source.lower()) == len(source) else source
                close = lowered.find(f"</{name}", pos)
                pos = at = len(source) if close < 0 else close
        if at < len(source) and not unseen:
            self._parts.append(source[at:])
        self._flush(stack[-1][1])
        pop_to(1)

    def decode(self, keep: np.ndarray) -> list[bool]:
        """Most probable labels in which no node is kept below a removed one.

        ``keep`` are log-odds. A subtree is worth the better of removing all of it and of
        keeping its root with the best of each child.
        """
        n = len(self.tag)
        yes, no = -np.logaddexp(0, -keep), -np.logaddexp(0, keep)
        total = np.concatenate(([0.0], np.cumsum(no)))
        out_all = (total[np.array(self.end)] - total[np.arange(n)]).tolist()
        best_in = yes.tolist()
        value = [0.0] * n
        for i in range(n - 1, -1, -1):
            value[i] = max(best_in[i], out_all[i])
            if i:
                best_in[self.parent[i]] += value[i]
        kept = [False] * n
        for i in range(n):
            kept[i] = (i == 0 or kept[self.parent[i]]) and best_in[i] >= out_all[i]
        return kept

    def main_text(self, keep: np.ndarray) -> str:
        kept = self.decode(keep)
        return "\n\n".join(t for t, k in zip(self.text, kept, strict=True) if k and t is not None)


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of all pages, in order: subtree, sibling, depth, attribute and tag statistics."""
    shift = np.cumsum([0] + [len(p.tag) for p in pages])
    n = int(shift[-1])
    at = np.arange(n)
    size = np.diff(shift)
    base = np.repeat(shift[:-1], size)
    root = base
    end = np.concatenate([np.array(p.end) for p in pages]) + base
    parent = np.concatenate([np.array(p.parent) for p in pages])
    up = np.maximum(parent, 0) + base
    tags = [t for p in pages for t in p.tag]
    texts = [t for p in pages for t in p.text]
    linked = np.concatenate([np.array(p.linked, float) for p in pages])
    chars = np.array([len(t) if t else 0 for t in texts], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts], float)
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") if t else 0 for t in texts], float)

    def below(x):
        total = np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)))
        return total[end] - total[at]

    kinds = np.array([KIND.get(t, 11) for t in tags])
    s_chars, s_words, s_stops, s_links, s_leaves, s_p = below(np.stack(
        [chars, words, stops, linked, (chars > 0).astype(float), (kinds == KIND["p"]).astype(float)], 1
    )).T
    before = np.concatenate(([0.0], np.cumsum(chars)))[:-1]
    before = before - before[root]
    inner = at != root
    kin = np.bincount(up[inner], minlength=n)
    # siblings in page order: sorted by parent, then position
    by = np.lexsort((at, np.where(inner, up, -1)))
    p_by = np.where(inner, up, -1)[by]
    same = np.concatenate(([False], (p_by[1:] == p_by[:-1]) & (p_by[1:] >= 0)))
    prev, nxt, order = np.zeros(n), np.zeros(n), np.zeros(n)
    prev[by[1:]] = np.where(same[1:], s_chars[by[:-1]], 0)
    nxt[by[:-1]] = np.where(same[1:], s_chars[by[1:]], 0)
    starts = np.maximum.accumulate(np.where(same, 0, at))
    order[by] = at - starts
    bits = np.arange(len(GROUPS))
    own = (np.array([g for p in pages for g in p.groups])[:, None] >> bits & 1).astype(float)
    above = (np.array([g for p in pages for g in p.above])[:, None] >> bits & 1).astype(float)
    depth = np.concatenate([np.array(p.depth) for p in pages])
    held = np.minimum(below(own) - own, 1)
    kind = np.zeros((n, len(KINDS)))
    kind[at, kinds] = 1
    stats = np.stack([
        np.log1p(s_chars), np.log1p(s_words), s_stops / np.maximum(s_chars, 1), s_links / np.maximum(s_chars, 1),
        s_leaves, s_chars / np.maximum(s_leaves, 1), s_p, s_chars / np.maximum(s_chars[root], 1),
        before / np.maximum(s_chars[root], 1), (end - at) / np.maximum(s_words, 1), depth, kin[up],
        order / np.maximum(kin[up], 1), np.log1p(prev), np.log1p(nxt), s_chars / np.maximum(s_chars[up], 1),
        np.log1p(s_chars[up] / np.maximum(kin[up], 1)),
    ], 1)
    return np.concatenate([stats, own, above, held, kind, kind[up]], 1).astype(np.float32)

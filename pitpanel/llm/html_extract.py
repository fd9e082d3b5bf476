"""Main text of web pages by gradient-boosted trees over the nodes of the page.

Every element and every text block is a node with features of its subtree (text, link
and sentence density), attribute words, depth and siblings. Boosted trees give each
node the odds of holding main text; the page's labels are the most probable ones in
which nothing is kept below a removed node, by a sum over the tree from its leaves.

The trees are fitted by Spark on at most ``sample_pages`` distinct pages (the smallest
digests of their text) of those in the whole table that have an article element, less
what lies inside it as comment, aside, menu or form. Each of them is also
rebuilt ``variants`` times from its own blocks in other layouts, with menus, headers,
sidebars, notices, adverts, forms and comments around and inside the article, so that
the model does not lean on one site's tags. Labels of rebuilt pages are marks that are
read from these pages alone: no attribute of a page of the table is ever a label. Where
no page has an article, the trees are fitted on the layouts with made-up words.

Pages are extracted where they lie, whole, without a shuffle. NULL and empty pages give
an empty text; so do pages without main text. Broken markup is read as far as it goes.
Repeated rows are extracted each by itself; an empty table gives no rows. Extra columns
are kept; added ones that would clash get a leading underscore.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.common import batches, fresh, table
from pitpanel.llm.html_tree import COMMENT, Page, features
from pitpanel.session import store

SAMPLE_PAGES, VARIANTS, TREES, DEPTH = 160, 8, 24, 4


@dataclass
class Trees:
    """Boosted regression trees as arrays; leaf nodes point at themselves."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    value: list[np.ndarray]
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, t, low, high, v in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, f[at]] <= t[at], low[at], high[at])
            total += v[at]
        return 2 * total  # the loss of the boosted trees has this scale


def _trees(model, depth: int) -> Trees:
    out = Trees([], [], [], [], [], depth)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        f, t, low, high, v = [], [], [], [], []

        def walk(node, f=f, t=t, low=low, high=high, v=v, weight=weight) -> int:
            me = len(f)
            for column, x in ((f, 0), (t, 0.0), (low, me), (high, me), (v, weight * node.prediction())):
                column.append(x)
            if node.subtreeDepth() > 0:
                f[me], t[me] = node.split().featureIndex(), node.split().threshold()
                low[me], high[me] = walk(node.leftChild()), walk(node.rightChild())
            return me

        walk(tree._java_obj.rootNode())
        for column, x in ((out.feature, f), (out.threshold, t), (out.left, low), (out.right, high), (out.value, v)):
            column.append(np.array(x))
    return out


#: Not part of an article though inside it; also what holds no articles of its own.
ASIDE, LISTS = {"article", "aside", "nav", "form", "dialog"}, {"section", "ol", "ul"}


def labels_of(page: Page) -> np.ndarray | None:
    """1 for nodes that hold main text, from marks or the article element; None without either."""
    n = len(page.tag)
    state = [0] * n  # 0 outside, 1 main, 2 set apart, with all below
    for i in range(1, n):
        up, tag, said = state[page.parent[i]], page.tag[i], page.groups[i] & COMMENT
        state[i] = up
        if page.marks:
            if page.label[i] is not None:
                state[i] = 1 if page.label[i] == "1" else 2
        elif up == 0 and tag == "article":
            state[i] = 1
        elif up == 0 and (tag in ("aside", "nav") or said and tag in LISTS):
            state[i] = 2
        elif up == 1 and (tag in ASIDE or said and tag != "#text"):
            state[i] = 2
    if 1 not in state:
        return None
    y = np.array([float(s == 1 and t is not None) for s, t in zip(state, page.text, strict=True)])
    total = np.concatenate(([0.0], np.cumsum(y)))
    return (total[np.array(page.end)] - total[np.arange(n)] > 0).astype(float)


def default_pages(count: int = 60) -> list[str]:
    """Plain articles of made-up words, for tables in which no page has an article."""
    rng = random.Random(7)
    letters = "aeiou", "bcdfghklmnprstvw"
    words = ["".join(rng.choice(letters[k % 2]) for k in range(rng.randint(1, 9))) for _ in range(400)]
    some = lambda low, high: " ".join(rng.choice(words) for _ in range(rng.randint(low, high))).capitalize()
    text = lambda: " ".join(some(4, 25) + "." for _ in range(rng.randint(1, 6)))
    out = []
    for _ in range(count):
        blocks = "".join(f"<p>{text()}</p>" for _ in range(rng.randint(2, 12)))
        menu = "".join(f"<li><a href=#>{some(1, 3)}</a></li>" for _ in range(rng.randint(3, 8)))
        out.append(f"<nav><ul>{menu}</ul></nav><article><h1>{some(2, 8)}</h1>{blocks}</article><footer><p>{some(3, 12)}</p></footer>")
    return out


def _rebuilt(page: Page, rng: random.Random) -> str | None:
    """The page's own blocks in a made-up layout; ``data-y`` marks what is main text."""
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    y = labels_of(page)
    body = [esc(t) for t, k in zip(page.text, y, strict=True) if t and k]
    rest = [esc(t) for t, k in zip(page.text, y, strict=True) if t and not k] or ["Home"]
    if not body:
        return None
    pick = rng.choice
    few = lambda n=6: [pick(rest)[:40] for _ in range(rng.randint(1, n))]
    links = lambda: "".join(f'<li><a href="#">{t}</a></li>' for t in few())
    said = lambda: " ".join(pick(body).split()[: rng.randint(2, 60)])

    def part(kind: str) -> str:
        if kind == "menu":
            return pick([f"<nav><ul>{links()}</ul></nav>", f'<ul class="menu">{links()}</ul>', f'<div class="navbar">{links()}</div>',
                         f'<div role="navigation"><ul>{links()}</ul></div>', f'<div id="breadcrumbs">{" &gt; ".join(few())}</div>'])
        if kind == "header":
            inner = f"<h1>{pick(rest)[:30]}</h1>" * rng.randint(0, 1) + f"<p>{pick(rest)}</p>"
            return pick([f"<header>{inner}</header>", f'<div id="header">{inner}</div>', f'<div class="masthead">{inner}</div>'])
        if kind == "footer":
            inner = pick([f"<p>{pick(rest)}</p>", pick(rest), f"<ul>{links()}</ul>&copy; {pick(rest)}", f"<p>{said()}</p>"])
            return pick([f"<footer>{inner}</footer>", f'<div class="footer">{inner}</div>', f'<div id="page-footer">{inner}</div>'])
        if kind == "side":
            inner = pick([f"<ul>{links()}</ul>", f"<h3>{pick(rest)[:20]}</h3><p>{said()}</p>", f"<p>{said()}</p><p>{said()}</p>"])
            return pick([f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div class="widget">{inner}</div>',
                         f'<div class="related-posts">{inner}</div>', f'<aside class="related">{inner}</aside>'])
        if kind == "notice":
            inner = f"<p>{pick([pick(rest), said()])}</p>" + "<button>OK</button>" * rng.randint(0, 1)
            return pick([f'<div class="cookie-notice">{inner}</div>', f'<div role="alert">{inner}</div>', f'<div id="consent-banner">{inner}</div>',
                         f'<div class="notice">{inner}</div>', f"<dialog>{inner}</dialog>", f'<div class="popup">{inner}</div>'])
        if kind == "ad":
            inner = pick([pick(rest), f"<p>{said()}</p>", f'<a href="#">{pick(rest)}</a>'])
            return pick([f'<div class="ad">{inner}</div>', f'<div class="advert">{inner}</div>', f'<div id="ad-slot-1">{inner}</div>',
                         f"<ins class=\"adsbygoogle\">{inner}</ins>", f'<div class="sponsored">{inner}</div>', f'<p class="promo">{pick(rest)}</p>'])
        if kind == "form":
            inner = f"<label>{pick(rest)[:30]}</label><input><p>{pick([pick(rest), said()])}</p><button>Send</button>"
            return pick([f"<form>{inner}</form>", f'<form class="search-form">{inner}</form>', f'<div class="newsletter">{inner}</div>'])
        if kind == "share":
            return pick([f'<div class="share">{" ".join(few(3))}</div>', f'<ul class="social-links">{links()}</ul>'])
        each = [pick([f"<p>{said()}</p>", said()]) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            each = [f"<b>{pick(rest)[:12]}</b> {t}" for t in each]
        return pick([
            f'<section id="comments"><h3>Comments</h3>{"".join(f"<div>{t}</div>" for t in each)}</section>',
            f'<div class="comments">{"".join(f"<div class=comment>{t}</div>" for t in each)}</div>',
            f'<ol class="comment-list">{"".join(f"<li>{t}</li>" for t in each)}</ol>', f'<div id="respond">{"".join(each)}</div>',
            f'<section class="replies">{"".join(f"<article data-y=0><p>{t}</p></article>" for t in each)}</section>',
        ])

    def block(t: str) -> str:
        if rng.random() < 0.2 and " " in t:
            cut = t.index(" ")
            t = pick([f"<b>{t[:cut]}</b>{t[cut:]}", f'{t[:cut]} <a href="#">{t[cut + 1 :]}</a>' if len(t) < 80 else f"<i>{t[:cut]}</i>{t[cut:]}"])
        return f"{shape[0]}{t}{shape[1]}"

    shape = pick([("<p>", "</p>")] * 6 + [("<p>", ""), ("<div>", "</div>"), ("<li>", "</li>"), ("<blockquote><p>", "</p></blockquote>"), ("", "<hr>")])
    size = max(1, len(body) // 2)
    chosen = body if rng.random() < 0.6 else body[: rng.randint(1, size)]
    title, chosen = (chosen[0], chosen[1:]) if len(chosen) > 1 and rng.random() < 0.7 else (None, chosen)
    inside = [block(t) if rng.random() < 0.93 else f"<h2>{t[:60]}</h2>" for t in chosen]
    for kind in rng.sample(["ad", "share", "side", "form", "notice", "comments"], rng.randint(0, 2)):
        where = len(inside) if kind in ("comments", "share", "form") else rng.randint(0, len(inside))
        inside.insert(where, part(kind).replace(">", " data-y=0>", 1))
    if title:
        inside.insert(0, pick([f"<h1>{title}</h1>", f"<h2>{title}</h2>", f'<h1 class="title">{title}</h1>']))
    opened, closed = pick([
        ("<article data-y=1>", "</article>"), ("<main data-y=1>", "</main>"), ('<div class="post-content" data-y=1>', "</div>"),
        ('<div id="content" data-y=1><div class="entry">', "</div></div>"), ('<section class="story" data-y=1>', "</section>"),
        ("<div data-y=1>", "</div>"), ("<div data-y=1><div>", "</div></div>"), ('<main><article class="post" data-y=1>', "</article></main>"),
        ("<table><tr><td data-y=1>", "</td></tr></table>"), ('<div class="wrapper"><div class="article-body" data-y=1>', "</div></div>"),
    ])
    first = [part(k) for k in rng.sample(["menu", "header", "notice", "ad", "form", "side"], rng.randint(0, 4))]
    after = [part(k) for k in rng.sample(["footer", "comments", "side", "ad", "form", "notice", "menu"], rng.randint(0, 5))]
    out = "".join([*first, opened, *inside, closed, *after])
    return f"<html><body data-y=0>{out}</body></html>"


def labelled(pages: DataFrame, *, html_col: str, sample_pages: int) -> DataFrame:
    """``(key, html)`` of at most ``sample_pages`` distinct pages with an article, found over the whole table."""
    named = pages.where(F.col(html_col).isNotNull()).select(F.sha2(html_col, 256).alias("key"), F.col(html_col).alias("html"))

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [labels_of(Page(h)) is not None for h in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(found, pa.bool_()))], ["key"])

    # only pages with this word can have one; they are read to be sure
    maybe = named.where(F.col("html").rlike("(?i)<article"))
    # bounded by the limit, so it may be broadcast
    keys = batches(maybe, marked, "key string").distinct().orderBy("key").limit(sample_pages)
    return named.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("html").alias("html"))


def training_rows(chosen: DataFrame, *, variants: int) -> DataFrame:
    """``(features, label)`` of the nodes of pages ``(key, html)`` and of their rebuilt forms."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read, y = [], []
        for source in batch.column(1).to_pylist():
            page = Page(source)
            own = labels_of(page)
            if own is None:
                continue
            read.append(page)
            y.append(own)
            rng = random.Random(zlib.crc32(source.encode("utf-8", "replace")))
            for _ in range(variants):
                if made := _rebuilt(page, rng):
                    read.append(Page(made, marks=True))
                    y.append(labels_of(read[-1]))
        x = features(read).astype(float) if read else np.zeros((0, 1))
        return pa.RecordBatch.from_arrays([
            pa.array(list(x), pa.list_(pa.float64())), pa.array(np.concatenate(y) if y else [], pa.float64())
        ], ["x", "label"])

    return batches(chosen.repartition(8, "key"), run, "x array<double>, label double")


def fit(pages: DataFrame, *, html_col: str = "html", sample_pages: int = SAMPLE_PAGES,
        variants: int = VARIANTS, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees from the table's own articles, or from the built-in layouts if it has none."""
    chosen = labelled(pages, html_col=html_col, sample_pages=sample_pages)
    rows = store(training_rows(chosen, variants=variants), "nodes")
    if rows.select("label").distinct().count() < 2:
        made = pages.sparkSession.createDataFrame([(str(k), h) for k, h in enumerate(default_pages())], "key string, html string")
        rows = store(training_rows(made, variants=variants), "nodes")
    rows = rows.select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.25, seed=11, maxBins=32, minInstancesPerNode=5).fit(rows)
    return _trees(model, depth)


def extracted(pages: DataFrame, model: Trees, *, html_col: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with the main text in an added column, whose name is returned too."""
    (name,) = fresh(pages, "text")
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = [Page(h) for h in batch.column(batch.schema.get_field_index(html_col)).to_pylist()]
        at = np.cumsum([0] + [len(p.tag) for p in read])
        odds = sent.value.log_odds(features(read))
        texts = [p.main_text(odds[a:b]) for p, a, b in zip(read, at[:-1], at[1:], strict=True)]
        where = batch.schema.get_field_index(name)
        return batch.set_column(where, batch.schema.field(where), pa.array(texts, pa.string()))

    out = pages.withColumn(name, F.lit(""))
    return batches(out, run, out.schema), name


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by trees fitted on the same table."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out, text = extracted(pages, fit(pages))
    return out.select("page_id", "url", F.col(text).alias("text"), F.char_length(text).cast("long").alias("n_chars"))

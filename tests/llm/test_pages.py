"""Main-text extraction: parsing, decoding and rebuilt layouts."""

import random
import re

import numpy as np
import pytest

from pitpanel.llm import html_extract as hx
from pitpanel.llm.html_tree import Page, features

SF = "/root/testdata/sf0.001"


def blocks(source):
    return [t for t in Page(source).text if t]


def test_blocks_and_broken_markup():
    assert blocks("<p>a &amp; b<br>c\n d<p>e<b>f</p>g") == ["a & b c d", "ef", "g"]
    assert blocks("<ul><li>x<li>y<ul><li>z</ul></ul>") == ["x", "y", "z"]
    assert blocks("<script>if (a<b) {'</p>'}</script><style>p{}</style><p hidden>no</p><p>yes") == ["yes"]
    assert blocks("a < b and 1<2 &copy; &#233;&#x41;") == ["a < b and 1<2 © éA"]
    assert blocks("<!-- <p>no</p> --><td>q<td>r<!-- open") == ["q", "r"]
    assert blocks(None) == blocks("") == blocks("<p></p>") == []
    assert blocks("<div " * 3) == ["<div <div <div"]


def test_only_the_attribute_named_hidden_hides():
    for attribute in ('href="/hidden-gems"', 'title="Hidden"', 'data-title="the hidden city"', 'aria-hidden="false"', "title='a hidden=1 b'", "data-hidden", 'alt="style=display:none"'):
        assert blocks(f"<p>see <a {attribute}>the link</a> here") == ["see the link here"], attribute
        assert blocks(f"<article {attribute}><p>text</article>") == ["text"], attribute
    for attribute in ("hidden", "HIDDEN", 'hidden=""', "hidden='until-found'", 'title="x" hidden', "class=a hidden", 'style="display: none"'):
        assert blocks(f"<p>a</p><div {attribute}><p>no</div><p>b") == ["a", "b"], attribute


def test_no_block_is_kept_below_a_removed_node():
    page = Page("<div class=a><p>one</p><div class=b><p>two</p></div></div><p>three</p>")
    rng = np.random.default_rng(0)
    for _ in range(200):
        kept = page.decode(rng.normal(scale=3, size=len(page.tag)))
        assert all(not k or page.parent[i] < 0 or kept[page.parent[i]] for i, k in enumerate(kept))
    odds = np.full(len(page.tag), -5.0)
    odds[page.text.index("three")] = odds[0] = 5
    assert page.main_text(odds) == "three"


def test_decoding_is_the_best_labelling():
    page = Page("<div><p>a</p><p>b</p></div>")
    n = len(page.tag)
    rng = np.random.default_rng(1)
    for _ in range(50):
        odds = rng.normal(scale=2, size=n)
        worth = lambda k: sum(o if x else 0 for o, x in zip(odds, k, strict=True))
        legal = [k for k in np.ndindex(*[2] * n) if all(not x or page.parent[i] < 0 or k[page.parent[i]] for i, x in enumerate(k))]
        assert worth(page.decode(odds)) == pytest.approx(max(map(worth, legal)))


@pytest.fixture(scope="module")
def model(spark):
    return hx.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_articles_of_the_whole_table(spark, model):
    rows = hx.extracted(spark.read.parquet(f"{SF}/pages.parquet"), model)[0].collect()

    def truth(source):
        import html

        inner = re.search(r"<article>(.*)</article>", source, re.S).group(1).replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        return "\n\n".join(p for p in parts if p)

    assert sum(r.text == truth(r.html) for r in rows) >= 0.98 * len(rows)


def test_rebuilt_layouts_not_seen_in_training(spark, model):
    right = total = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect():
        rng = random.Random(f"held out {r.page_id}")
        page = Page(r.html)
        hx.labels_of(page)
        if made := hx._rebuilt(page, rng):
            other = Page(made, marks=True)
            y = hx.labels_of(other)
            kept = other.decode(model.log_odds(features([other])))
            leaves = [i for i, t in enumerate(other.text) if t]
            right += sum(kept[i] == bool(y[i]) for i in leaves)
            total += len(leaves)
    assert right / total > 0.93


def test_the_sample_holds_distinct_labelled_pages(spark):
    marked = [f"<nav>menu {i}</nav><ARTICLE><p>text {i}</p></article>" for i in range(5)]
    rows = [f"<p>page {i} without a mark, article in words</p>" for i in range(400)] + [marked[0]] * 200 + marked + ["", None, "<!-- <article> -->"]
    df = spark.createDataFrame([(f"u{i}", h) for i, h in enumerate(rows)], "url string, html string")
    got = [r.html for r in hx.labelled(df, html_col="html", sample_pages=5).collect()]
    assert sorted(got) == sorted(marked)
    assert {r.label for r in hx.training_rows(hx.labelled(df, html_col="html", sample_pages=5), variants=1).collect()} == {0.0, 1.0}


def test_odd_rows(spark, model):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<p>" + "word " * 200_000, None), (3, "u", "<nav><a>x</a></nav>", "t"), (None, None, "plain", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    out, name = hx.extracted(df, model)
    got = [(r.page_id, r[name]) for r in out.collect()]
    assert name == "_text" and len(got) == 5 and dict(got[:2]) == {1: "", 2: ""}
    assert hx.extracted(df.limit(0), model)[0].collect() == []


def test_inline_elements_keep_their_sentence():
    assert blocks('<p>I <a class="comment-link">like</a> <span class=ad>it</span></p>') == ["I like it"]
    page = Page('<div><span class="ad">buy now</span></div><p>a long sentence <i class=ad>x</i></p>')
    told = {t: g for t, g in zip(page.text, page.groups, strict=True) if t}
    assert told["buy now"] and not told["a long sentence x"]


def test_nothing_but_unseen_parts_is_dropped():
    assert blocks("<p>Let <math><mi>x</mi><mspace/></math> be a <svg><path d=1 /><title>no</title><text>y</text></svg> number</p>") == ["Let x be a y number"]
    assert blocks("<p>a<noscript>b</noscript><object>c</object><canvas>d</canvas><video>e</video></p>f") == ["abcde", "f"]
    assert blocks("<p>a<textarea>no</textarea><select><option>no</select><template>no</template>b</p>") == ["ab"]


def test_labels_come_from_articles_and_made_pages_only():
    page = Page('<article><p>one</p><div data-y="0">two</div><section class=comments><article><p>said</p></article></section><aside>by</aside></article>'
                '<nav><article>menu</article></nav><ol class="comment-list"><li><article>said too</article></ol>')
    y = dict(zip(page.text, hx.labels_of(page), strict=True))
    assert {t: y[t] for t in page.text if t} == {"one": 1, "two": 1, "said": 0, "by": 0, "menu": 0, "said too": 0}
    assert hx.labels_of(Page('<div data-y="1">story</div>')) is None
    made = Page('<body data-y=0><div data-y=1>story</div>x', marks=True)
    assert dict(zip(made.text, hx.labels_of(made), strict=True))["story"] == 1


@pytest.mark.parametrize("unit", ["<a b ", '<a "', "<div>", "<a '\"", "<p><table><b>", "<!", "<li><b>", "<svg><g>"])
def test_broken_pages_take_linear_time(unit):
    import time

    seconds = []
    for size in (100_000, 1_000_000):
        for tail in ("", ">", '""'):
            began = time.process_time()
            page = Page(unit * (size // len(unit)) + tail)
            assert len(features([page])) == len(page.tag)
            seconds.append(time.process_time() - began)
    assert max(seconds[3:]) < 30 * max(max(seconds[:3]), 0.05)


def test_a_table_without_articles_gets_the_built_in_trees(spark):
    menu = "<ul class=menu>" + "".join(f"<li><a href=/{k}>Part {k}</a></li>" for k in range(6)) + "</ul>"
    story = [f"This is sentence {k} of the story, and it goes on for quite a while. It ends here." for k in range(5)]
    source = f"<div id=header><p>My Site</p></div>{menu}<div class=post-content>{''.join(f'<p>{t}</p>' for t in story)}</div>" \
             "<div class=footer><p>Copyright</p></div>"
    df = spark.createDataFrame([(1, source), (2, "")], "page_id long, html string")
    out, name = hx.extracted(df, hx.fit(df))
    assert {r.page_id: r[name] for r in out.collect()} == {1: "\n\n".join(story), 2: ""}


def test_plain_tags_are_read_as_by_the_full_walk(monkeypatch):
    from pitpanel.llm import html_tree

    rng = random.Random(1)
    bits = ["<a", " b", "=", '"', "'", ">", "<", "/", "x", "<!--", "-->", "<!"]
    sources = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 16))) for _ in range(5000)]

    def walk(source):
        tags, pos, out = html_tree._Tags(source), 0, []
        while m := tags.next(pos):
            out.append(m)
            pos = m[1]
        return out

    quick = [walk(s) for s in sources]
    monkeypatch.setattr(html_tree, "PLAIN", re.compile(r"(?!)"))
    assert quick == [walk(s) for s in sources]

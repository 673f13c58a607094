import html
import random
import re

import itertools
import math

import pytest

from palimpsest.llm import html_extract, quality_lm
from palimpsest.llm.common import table


def english(seed, n):
    rnd = random.Random(seed)
    parts = ["the", "and", "ing", "tion", "er", "on", "th", "re", "ou", "of"]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_classify(spark, make):
    good = [(i, english(i, 120), "en" if i % 3 else None) for i in range(300)]
    bad = [(1000 + i, "".join(random.Random(i).choice("#$%&*XQZ|") for _ in range(600)), "en") for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", "xx"), (2002, english(7, 400_000), "xx"), (2003, "on", "en"), (5, english(5, 120), "en")]
    same = [(3000 + i, "tion " * 300, "en") for i in range(2)]
    docs = make(*good, *bad, *odd, *same)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200)] + [(1000, 0, 0), (3, 0, 0), (None, 1, 0), (9999, 1, 0), (4, 1, 0)],
        "doc_id long, quality int, toxic int")
    out = quality_lm.classify(docs, labels)
    kept = {r.doc_id: r["__quality"].kept for r in out.collect()}
    assert out.count() == docs.count() and all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in bad)
    assert (kept[2000], kept[2001], kept[2003]) == (False, False, True) and not kept[3000] and not kept[3001]
    assert quality_lm.keep_good(docs, labels).columns == docs.columns
    assert quality_lm.classify(docs.limit(0), labels).count() == 0
    assert quality_lm.classify(docs, labels.limit(0)).where("__quality.kept").count() == docs.where("text <> ''").count()


def test_held_out_accuracy(spark, sf):
    """Trained on half of the labels, it keeps the good of the other half and drops most of the bad."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = quality_lm.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality",
        "__quality.kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


@pytest.fixture(scope="module")
def extractor():
    return html_extract.default_model()


def test_pages(spark, sf):
    for r in html_extract.extract(table(spark, sf, "pages")).join(table(spark, sf, "pages").select("page_id", "html"), "page_id").collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*?)</article>", r.html).group(1))
        texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
        assert r.text == "\n".join(t for t in texts if t) and r.n_chars == len(r.text)


def test_layouts(extractor):
    """Layouts that the model is not trained on, drawn with another seed."""
    right = total = 0
    for source, _ in html_extract.labelled_pages(60, seed=99):
        page = html_extract.Page(source)
        states = [False]
        for i in range(1, len(page.tags)):
            own = html_extract._label(page.marks[i])
            states.append(states[page.parents[i]] if own is None else own)
        belief = html_extract.given_content(*extractor.infer(page))
        for _, node, text in page.pieces:
            if text.strip():
                total += len(text)
                right += len(text) * ((belief[node] > 0) == states[node])
    assert right / total > 0.97


def test_marginals_by_enumeration():
    """On random trees, messages give what summing over all states gives, with and without the prior of an empty page."""
    rnd = random.Random(1)
    for n in range(1, 10):
        parents = [-1] + [rnd.randrange(i) for i in range(1, n)]
        own = [rnd.uniform(-3, 3) for _ in range(n)]
        pair = []
        for _ in range(n):
            a, b = rnd.uniform(0.1, 0.9), rnd.uniform(0.1, 0.9)
            pair.append((a, 1 - a, 1 - b, b))
        weight = {s: math.prod(math.exp(own[i] * s[i]) * (pair[i][2 * s[parents[i]] + s[i]] if i else 1) for i in range(n)) for s in itertools.product((0,
            1), repeat=n)}
        odds = lambda w, i: math.log(sum(v for s, v in w.items() if s[i]) / sum(v for s, v in w.items() if not s[i]))
        below = list(own)
        found = html_extract.propagate(list(own), parents, pair, below)
        assert all(abs(found[i] - odds(weight, i)) < 1e-9 for i in range(n))
        none, total = weight[(0,) * n], sum(weight.values())
        before = math.prod(p[0] for p in pair[1:])
        if 1 < n and before > html_extract.EMPTY:
            empty = html_extract.EMPTY * none / before
            some = (1 - html_extract.EMPTY) * (total - none) / (1 - before)
            given = html_extract.given_content(found, pair, below)
            for i in range(n):
                p = sum(v for s, v in weight.items() if s[i]) / (total - none) * some / (some + empty)
                assert abs(given[i] - math.log(p / (1 - p))) < 1e-6


@pytest.mark.parametrize("source,expected", [
    ("<article><datalist><option value=a></datalist><p>text</p><p>more</p></article>", "text\nmore"),
        ("<article><p>a</p><noscript><p>b</p><p>c</p></article>", "a\nb\nc"),
    ("<article><p>a <svg><path d='x'> b</p><p>c</p></article>", "a b\nc"),
        ("<article><p>x</p><template>hid<template>in</template>hid</template><p>y</p></article>", "x\ny"),
    ("<article><p>x</p><select><option>One<option>Two<p>text</p></article>", "x\ntext"),
        ("<article><p>x</p><select><option>One</option></select><p>y</p></article>", "x\ny"),
    ("<body><div><p>para one with some words</p><p>para two</p></div></body>", "para one with some words\npara two"), ("<p>a<wbr>b su<img>per</p>", "ab super"),
    ("<article><p title=it's>one</p><p>don't</p></article>", "one\ndon't"), ("<article><p>x</p><svg/><p>y</p><math><mi>q</mi></math><p>z</p></article>",
        "x\ny\nz"), ("<article><!--> <p>kept</p></article>", "kept"),
    ("<html><head><title>T</title><p>body text here and there</p></html>", "body text here and there"),
        ("<table><tr><td><p>a table that lays out the page</p><p>two</p></td></tr></table>", "a table that lays out the page\ntwo"),
    ("<nav><a href=/>Home</a></nav><footer><p>All rights</p></footer>", ""), ("<article><p>a</p><noscript><p>no script</p></noscript><p>b</p></article>",
        "a\nb"),
])
def test_text_is_kept(extractor, source, expected):
    assert extractor.extract(source) == expected


@pytest.mark.parametrize("source,expected", [
    (None, ""), ("", ""), ("<html>", ""), ("<article><p>a  b\n c</p><p>d&amp;e &lt;x&gt; &am</p></article>", "a b c\nd&e <x> &am"),
        ("<article><p>one<br>two<p>three</article><footer>no</footer>", "one two\nthree"),
    ("<main><h1>T</h1><script>x<p>y</p></script><style>p{}</style><p>b<!-- <p>no</p> -->c</p></main>", "T\nbc"),
        ("<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><p>text <a href='x'>link</a> more</p><div class='comments'><p>me too</p></div></article>", "text link more"),
    ("<article><p>open <b>bold <a href=\"unclosed>x</a></p></article>", None), ("<div>" * 3000 + "<article><p>deep</p></article>", "deep"),
        ("<article>" + "<p>x" * 5000 + "</article>", "\n".join("x" * 5000)),
])
def test_awkward_html(extractor, source, expected):
    got = extractor.extract(source or "")
    assert expected is None or got == expected


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, None, None), (1, "u", "<article><p>x</p></article>"), (None, "u", "")],
        "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    assert sorted(map(str, html_extract.extract(df).collect())) == sorted(map(str,
        spark.createDataFrame([(1, None, "", 0), (1, "u", "x", 1), (None, "u", "", 0)], "page_id long, url string, text string, n_chars long").collect()))
    assert html_extract.extract(df.limit(0)).count() == 0

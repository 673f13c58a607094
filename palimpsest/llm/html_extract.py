"""HTML extraction with a tree-structured graphical model.

Each element of a page's DOM is a variable, content or not. Potentials between parent and child, and between an
element and what is seen of it (tag, class and id words, share of link text, amount of text), are counts from labelled
pages. Sum-product messages pass upward and then downward, which gives each element's marginal of being content; the
text of elements that are content more likely than not is the page's main text.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, renamed, text_of

# Fixed values from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())  # no markup up to their end tag
HIDDEN = frozenset("script style noscript template iframe noembed noframes svg math title select option optgroup datalist textarea head".split())
# Hidden subtrees that end where their parent does, without an end tag of their own, were left open by mistake.
SHOWN_IF_OPEN = frozenset("noscript template svg math select datalist".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
IN_HEAD = frozenset("head base link meta noframes noscript script style template title".split())
# An opening tag on the left closes an open element on the right, unless a stop lies between.
CLOSES_P = BLOCKS - frozenset("html head body td th tr tbody thead tfoot li dd dt".split())
SAME = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"),
}
STOPS = frozenset("table ul ol dl div section article aside nav header footer main body html form blockquote td th select datalist".split())
BLOCK_ENDS = ("option", "optgroup", "select", "datalist", "svg", "math")  # elements that no block lies in

TOKEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
COMMENT_END = re.compile(r"--!?>")
# A name, then attributes: a quote is one only where a value begins, and one that is never closed is none.
TAG = re.compile(
    r"""/?([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?)?)*+)>"""
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
WORDS = re.compile(r"[a-z]+")


class Page:
    """A page's elements in document order (parents first) and its pieces of text with the block and element they are in."""

    def __init__(self, source: str):
        self.tags, self.parents, self.marks, self.link, self.hidden = ["#root"], [-1], [""], [False], [False]
        self._open_now: Counter = Counter()
        self.pieces: list[tuple[int, int, str]] = []
        self._parse(source)
        for i in range(1, len(self.tags)):
            self.hidden[i] = self.hidden[i] or self.hidden[self.parents[i]]
        self.pieces = [p for p in self.pieces if not self.hidden[p[1]]]

    def _open(self, stack: list[int], tag: str, mark: str) -> int:
        self.tags.append(tag)
        self.parents.append(stack[-1])
        self.marks.append(mark)
        self.link.append(tag == "a" or self.link[stack[-1]])
        self.hidden.append(tag in HIDDEN)
        return len(self.tags) - 1

    def _close(self, stack: list[int], names: tuple[str, ...], stops: frozenset = frozenset(), meant: bool = True) -> None:
        """Pops the innermost element of these names with all that is open in it; meant: a tag of its own says so."""
        if not any(self._open_now[name] for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] in names:
                self._leave(stack, k, meant)
                return
            if self.tags[stack[k]] in stops:
                return

    def _leave(self, stack: list[int], k: int, meant: bool) -> None:
        for i in stack[k + meant:]:
            if self.tags[i] in SHOWN_IF_OPEN:
                self.hidden[i] = False
        self._open_now.subtract(self.tags[i] for i in stack[k:])
        del stack[k:]

    def _parse(self, s: str) -> None:
        stack, block, at, n = [0], 0, 0, len(s)
        while at < n:
            m = TOKEN.search(s, at)
            upto = m.start() if m else n
            if upto > at:
                if self.tags[stack[-1]] == "head" and not s[at:upto].isspace():
                    self._close(stack, ("head",))
                self.pieces.append((block, stack[-1], s[at:upto]))
            if not m:
                break
            if m.group() == "<!--":
                end = COMMENT_END.search(s, m.start() + 2)
                at = end.end() if end else n
                continue
            if m.group()[1] in "!?":
                end = s.find(">", m.end())
                at = n if end < 0 else end + 1
                continue
            tag = TAG.match(s, m.start() + 1)
            if not tag:
                break  # a tag that the page ends in
            name, at = tag.group(1).lower(), tag.end()
            if name in BLOCKS:
                block += 1
            if s[m.start() + 1] == "/":
                if name == "br":
                    self.pieces.append((block, stack[-1], " "))
                elif name == "p" or name in BLOCKS or name in HIDDEN:
                    self._close(stack, (name,))
                else:
                    self._close(stack, (name,), STOPS | {"p"})
                continue
            if name not in IN_HEAD and self.tags[stack[-1]] == "head":
                self._close(stack, ("head",))
            if name in BLOCKS:
                while any(self._open_now[x] for x in BLOCK_ENDS):
                    before = len(stack)
                    self._close(stack, BLOCK_ENDS, frozenset(("noscript", "template")))
                    if len(stack) == before:
                        break
            if name in CLOSES_P:
                self._close(stack, ("p",), STOPS)
            if name in SAME:
                self._close(stack, SAME[name], STOPS - frozenset(SAME[name]))
            if name in VOID:
                if name == "br":
                    self.pieces.append((block, stack[-1], " "))
                continue
            attributes = tag.group(2)
            mark = " ".join(a.strip("\"'").lower() for a in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
            node = self._open(stack, name, mark)
            if attributes.endswith("/") and (name in ("svg", "math") or self._open_now["svg"] or self._open_now["math"]):
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(s, at)
                if name not in HIDDEN:
                    self.pieces.append((block, node, s[at:close.start() if close else n]))
                at = close.end() if close else n
                continue
            stack.append(node)
            self._open_now[name] += 1
        self._leave(stack, 1, False)

    def features(self) -> list[tuple]:
        """What is seen of each element: its tag, the words of its class, id and role, and two buckets of its text."""
        n = len(self.tags)
        chars, linked = [0] * n, [0] * n
        for _, node, text in self.pieces:
            size = len(text) - text.count(" ")
            chars[node] += size
            if self.link[node]:
                linked[node] += size
        for i in range(n - 1, 0, -1):
            chars[self.parents[i]] += chars[i]
            linked[self.parents[i]] += linked[i]
        out = []
        for i in range(n):
            share = 0 if not chars[i] else 1 + (linked[i] * 10 > chars[i]) + (linked[i] * 2 > chars[i])
            out.append((self.tags[i], WORDS.findall(self.marks[i]) if self.marks[i] else (), share, min(4, chars[i].bit_length() // 3)))
        return out

    def text(self, content: list[bool]) -> str:
        """Blocks of the pieces that are in content elements: references decoded, white space made one space, in page order."""
        out, held, last = [], [], -1
        for block, node, piece in self.pieces:
            if block != last and held:
                out.append(" ".join("".join(held).split()))
                held = []
            last = block
            if content[node]:
                held.append(html.unescape(piece) if "&" in piece else piece)
        if held:
            out.append(" ".join("".join(held).split()))
        return "\n".join(b for b in out if b)


EMPTY = 0.05  # prior of a page without any content
PARTS = frozenset("article aside div footer form header main nav section".split())
PLAIN = frozenset("div section td".split())


def own_part(tag: str, marks) -> int:
    """Whether an element is a part of the page of its own: such differ from their parent far more often than others.

    0: no part; 1: a container that says nothing of what it holds; 2: one that does, by its name or its tag.
    """
    return 2 if marks or tag in PARTS and tag not in PLAIN else int(tag in PLAIN)


def propagate(belief: list[float], parents: list[int], pair: list[tuple], subtree: list[float] | None = None) -> list[float]:
    """Sum-product on a tree, parents before children: own log-odds to those of marginals, in place.

    pair[i] is (p00, p01, p10, p11), the potential of i's parent's state and then i's. subtree, if given, is filled
    with each element's log-odds by itself and what lies below it.
    """
    exp, log, n = math.exp, math.log, len(belief)
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        p00, p01, p10, p11 = pair[i]
        e = exp(max(-50.0, min(50.0, belief[i])))
        up[i] = m = log((p11 * e + p10) / (p01 * e + p00))
        belief[parents[i]] += m
    if subtree is not None:
        subtree[:] = belief
    for i in range(1, n):
        p00, p01, p10, p11 = pair[i]
        e = exp(max(-50.0, min(50.0, belief[parents[i]] - up[i])))
        belief[i] += log((p11 * e + p01) / (p10 * e + p00))
    return belief


def given_content(belief: list[float], pair: list[tuple], subtree: list[float]) -> list[float]:
    """Log-odds where the prior of a page without any content is EMPTY, if the tree's potentials alone make it more.

    Of a page with content, marginals are those of states that are not all off; so all grow by one factor. Small
    pages without marks need it: their potentials alone leave off too likely.
    """
    zero, rest = 0.0, math.log1p(math.exp(min(50.0, subtree[0])))
    for (p00, p01, _, _), e in zip(pair[1:], subtree[1:]):
        zero += math.log(p00)
        rest += math.log((p00 + p01 * math.exp(min(50.0, e))) / p00)
    if zero <= math.log(EMPTY):
        return belief
    some, some_before = -math.expm1(-rest) or 1e-300, -math.expm1(zero) or 1e-300
    ratio = EMPTY / (1 - EMPTY) * math.exp(min(700.0, (-rest - zero) + math.log(some_before) - math.log(some)))
    scale = 1 / (1 + ratio) / some
    out = []
    for b in belief:
        p = min(1 - 1e-12, scale / (1 + math.exp(-max(-50.0, min(50.0, b)))))
        out.append(math.log(p / (1 - p)))
    return out


class Model:
    """Log-odds of content for what is seen, and P(child's state | parent's state) by kind of child, from labelled pages."""

    def __init__(self, pages: list[tuple[str, object]]):
        seen, pairs = Counter(), Counter()
        totals = Counter()
        for source, is_content in pages:
            page = Page(source)
            states = [bool(is_content(m)) for m in page.marks]
            for i in range(1, len(states)):  # a state marked on an element holds below it
                states[i] = is_content(page.marks[i]) if is_content(page.marks[i]) is not None else states[page.parents[i]]
            for i, (tag, marks, share, size) in enumerate(page.features()):
                if page.hidden[i]:
                    continue
                marks = [w for w in marks if w not in ("y", "n")]
                keys = [("tag", tag), ("share", share), ("size", size), *(("mark", w) for w in set(marks))]
                for k in keys:
                    seen[k, states[i]] += 1
                totals[states[i]] += 1
                if i:
                    pairs[own_part(tag, marks), states[page.parents[i]], states[i]] += 1
        self.odds = {}
        for kind_value in {k for k, _ in seen}:
            # Amounts of text, and tags that occur in all parts of a page, are weak evidence on their own.
            weight = 1.0 if kind_value[0] == "mark" or kind_value[1] in PARTS else 0.3
            p = [(seen[kind_value, s] + 0.5) / (totals[s] + 1) for s in (False, True)]
            self.odds[kind_value] = weight * math.log(p[1] / p[0])
        row = {(o, s): pairs[o, s, False] + pairs[o, s, True] + 2 for o in range(3) for s in (False, True)}
        self.pair = {o: tuple((pairs[o, a, b] + 1) / row[o, a] for a in (False, True) for b in (False, True)) for o in range(3)}

    def marginals(self, page: Page) -> list[float]:
        """The log-odds of each element's marginal of being content."""
        return self.infer(page)[0]

    def infer(self, page: Page) -> tuple[list[float], list[tuple], list[float]]:
        """Marginals, the potentials between each element and its parent, and what each subtree says by itself."""
        odds, n = self.odds, len(page.tags)
        belief, pair = [0.0] * n, [self.pair[0]] * n
        for i, (tag, marks, share, size) in enumerate(page.features()):
            if page.hidden[i]:  # says nothing of what is around it
                continue
            pair[i] = self.pair[own_part(tag, marks)]
            v = odds.get(("tag", tag), 0.0) + odds.get(("share", share), 0.0) + odds.get(("size", size), 0.0)
            for w in marks:
                v += odds.get(("mark", w), 0.0)
            belief[i] = v
        below = list(belief)
        return propagate(belief, page.parents, pair, below), pair, below

    def extract(self, source: str) -> str:
        page = Page(source)
        return page.text([b > 0 for b in given_content(*self.infer(page))])


def labelled_pages(count: int = 600, seed: int = 5) -> list[tuple[str, object]]:
    """Pages of many layouts whose elements say in their class what they are: `y` content, `n` not, inherited if neither.

    The layouts are those of common site software: articles in article, main or div elements, with menus, headers,
    footers, sidebars, notices, adverts, forms, share bars, related links and reader comments around and inside them.
    """
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("aeiou" if k % 2 else "bcdfglmnprst") for k in range(rnd.randint(2, 9))) for _ in range(600)]

    def words(least: int, most: int) -> str:
        return " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(least, most)))

    def links(tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{words(1, 1)}'>{words(1, 3)}</a></{tag}>" for _ in range(rnd.randint(2, 9)))

    def off(*names: str) -> str:
        tag, *marks = rnd.choice(names).split(".")
        title = rnd.choice(("h1", "h2", "h3", "h4"))
        emphasis = rnd.choice(("b", "em", "i", "strong", "span", "code"))
        plain = rnd.choice((
            f"<{title}>{words(1, 6)}</{title}>", f"<p><{emphasis}>{words(1, 3)}</{emphasis}> {words(3, 60)}</p>",
                f"<blockquote><p>{words(3, 30)}</p></blockquote>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>",
            f"<ol><li>{words(1, 20)}</li><li>{words(1, 20)}</li></ol>", f"<figure><figcaption>{words(2, 12)}</figcaption></figure>",
                f"<pre>{words(2, 20)}</pre>", f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>", ""))
        inner = plain + rnd.choice((f"<ul>{links()}</ul>", f"<p>{words(2, 40)}</p>", words(2, 40), f"<div>{words(1, 20)}</div>", links("span"),
            f"<p>{words(3, 20)} <a href='#'>{words(1, 3)}</a></p><p>{words(3, 30)}</p>"))
        return f"<{tag} class='n {' '.join(marks)}'>{inner}</{tag}>"

    around = ("nav", "nav.menu", "div.menu", "div.navigation", "ul.nav", "header", "header.site", "div.header", "div.banner", "div.cookie.notice",
        "div.notice", "div.consent",
              "div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside", "aside.sidebar", "div.sidebar", "div.widget",
                  "div.breadcrumb", "div.alert", "section.ads", "div.popup", "p.ad", "p.notice")
    after = ("footer", "footer.site", "div.footer", "div.copyright", "div.comments", "section.comments", "div.comment", "ul.comments", "ol.commentlist",
        "div.disqus", "div.related", "aside.related", "section.related",
             "div.share", "div.social", "form", "form.search", "form.subscribe", "div.newsletter", "div.pagination", "nav.pager", "div.responses",
                 "section.discussion")

    def inline() -> str:
        return rnd.choice((f"<b>{words(1, 4)}</b>", f"<a href='#'>{words(1, 4)}</a>", f"<i>{words(1, 3)}</i>", f"<em>{words(1, 3)}</em>",
            f"<strong>{words(1, 3)}</strong>", f"<code>{words(1, 2)}</code>", f"<span>{words(1, 5)}</span>"))

    def paragraph() -> str:
        body = rnd.choice((words(1, 5), words(5, 60), words(60, 200), f"{words(1, 30)} {inline()} {words(1, 30)}", f"<b>{words(2, 30)}<br>", inline()))
        kind = rnd.random()
        if kind < 0.75:
            return f"<p>{body}</p>"
        return rnd.choice((f"<h2>{words(1, 8)}</h2>", f"<h3>{words(1, 8)}</h3>", f"<ul><li>{words(1, 20)}</li><li>{words(1, 20)}</li></ul>",
            f"<ol><li>{words(1, 20)}</li></ol>", f"<blockquote><p>{body}</p></blockquote>",
                           f"<pre>{words(1, 30)}</pre>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", f"<div>{body}</div>",
                               f"<section><h2>{words(1, 6)}</h2><p>{body}</p></section>", f"<figure><figcaption>{words(2, 12)}</figcaption></figure>"))

    homes = ("article", "article.post", "main", "div.content", "div.article", "div.post", "div.entry", "div.story", "section.article", "div.main",
        "div.text", "div.body", "article.entry", "main.content", "div", "div", "section", "body", "body", "td")
    pages = []
    for _ in range(count):
        tag, *marks = rnd.choice(homes).split(".")
        inside = [paragraph() for _ in range(rnd.randint(1, 25))]
        for _ in range(rnd.choice((0, 0, 0, 1, 2))):
            inside.insert(rnd.randint(0, len(inside)), off("div.ad", "aside", "div.share", "div.related", "div.advert", "form", "div.promo",
                "aside.related", "div.newsletter", "div.comments", "nav.toc", "div.notice"))
        head = rnd.choice((f"<h1>{words(1, 12)}</h1>", f"<header class='y'><h1>{words(1, 12)}</h1></header>", f"<h1>{words(1, 12)}</h1>", ""))
        article = head + "".join(inside)
        body = article if tag == "body" else f"<{tag} class='y {' '.join(marks)}'>{article}</{tag}>"
        if tag == "td":
            body = f"<table><tr>{body}</tr></table>"
        for _ in range(0 if tag == "body" else rnd.choice((0, 0, 1, 2))):
            body = f"<div class='{rnd.choice(('', 'wrapper', 'container', 'page', 'row', 'layout'))}'>{off(*around) if rnd.random() < 0.6 else ''}{body}{off(*after) if rnd.random() < 0.6 else ''}</div>"
        least = 0 if not marks else 1
        before = "".join(off(*around) for _ in range(rnd.randint(least, 4)))
        behind = "".join(off(*after) for _ in range(rnd.randint(least, 4)))
        if not marks:  # plain pages have plain parts
            before = rnd.choice((f"<header class='n'>{words(1, 4)}</header>", off("header"), "")) + rnd.choice((off("nav"),
                f"<nav class='n'>{links('span')}</nav>", "")) + before
            behind += rnd.choice((f"<footer class='n'>{words(1, 8)}</footer>", off("footer"), ""))
        open_body = "<body class='y'>" if tag == "body" else "<body>"
        pages.append((f"<html><head><title>{words(1, 9)}</title></head>{open_body}{before}{body}{behind}</body></html>", _label))
    return pages


def _label(mark: str) -> bool | None:
    first = mark.split(" ", 1)[0]
    return True if first == "y" else False if first == "n" else None


_default: Model | None = None


def default_model() -> Model:
    global _default
    if _default is None:
        _default = Model(labelled_pages())
    return _default


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; null or empty html, and pages without content, have empty text.

    Each row is taken by itself, so repeated rows give repeated results and null ids or addresses pass; of no rows, no
    rows come. Other columns are left out, whatever their names. Texts are whole, however long: parsing takes time in
    proportion to the page, whatever is left open in it. An element whose marginal is a tie is not content. The model
    is some hundred numbers.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    slim = renamed(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", text_of(F.col("html")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [shared.value.extract(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(slim.dtypes)
    return map_batches(slim, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string").withColumn("n_chars", F.length("text").cast("long"))

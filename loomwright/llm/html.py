"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A linear classifier gives each block a
price, the log odds of content: how long it is, how it ends, its punctuation, links and tag,
and how deep it lies, beside one bounded term for the container it stands in. The price is a
terminal capacity; neighbouring blocks, and blocks under one parent, are tied by edges that
weigh less the further apart they are in the tree, and less where a container of content or
boilerplate ends between them, on the same scale. The minimum cut of that
graph separates content from boilerplate: a short or much linked block goes with the blocks
around it unless its own price outweighs them.

The weights are fitted on a bounded sample of the pages (SAMPLE pages, LABELLED blocks of each
at most): blocks in elements that are content or boilerplate by definition (article, main;
nav, aside, footer, form) are its labels, and how a block itself looks is what it learns from.
A ridge draws the weights towards USUAL, which stand where a table has no such elements.

Defined results: null, empty and textless pages give an empty text; broken markup is read as
far as it goes (an unclosed tag ends with its parent, a lone ``<`` is text); rows are judged
one by one; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, small_batches
from .mincut import min_cut
from .training import logistic, sampled_ids, texts_of

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>?|<[!?][^>]*+>?|(?P<text>[^<]++|<)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|itemprop|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
#: Elements whose inside is no text of the page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "select", "noembed", "noframes"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag ends an open element of these kinds first.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {
    k: {"p"} for k in ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul", "figure")
}
#: An element is not looked for beyond these when a tag closes it by implication.
FENCE = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "html", "td", "th", "nav", "footer", "header", "aside", "form", "blockquote"}
BAD_TAG = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "label", "legend", "fieldset"}
GOOD_TAG = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class and id names. A name is one of boilerplate if it has such a word and else only NEUTRAL ones.
BAD_WORD = set(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs footer footers sidebar sidebars"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending pagination pager toolbar copyright masthead skip search widget".split()
)
COMMENT_WORD = set("comment comments commentlist disqus reply replies respond discussion".split())
#: Of these, the ones that in an article may as well name a part of its text.
PERHAPS_COMMENT = set("reply discussion".split())
NEUTRAL = set("main site left right top bottom upper lower box block container wrapper wrap inner outer area section list item items group col row bar links link text body header head title content post posts form btn button primary secondary global left1 fixed sticky id div ul li the".split())
GOOD_WORD = set("article articlebody story post entry content main body text".split())
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What a block's price is made of, and the usual weights.
FEATURES = ("bias", "words", "sentence", "commas", "linked", "heading", "item", "paragraph", "depth")
USUAL = np.array([-1.5, 2.0, 1.2, 0.4, -4.0, 0.8, -0.5, 0.6, -0.1])
FULL_WORDS = 20
#: Bounds of that sum, and the term for a block's container.
LEAST, MOST, IN_CONTENT, NAMED_CONTENT, IN_BOILERPLATE = -4.0, 3.0, 3.5, 1.5, -5.0
#: Ties: what it costs to part two blocks next to each other, divided by their distance to a power, and two in turn
#: under one parent. BORDER: steps that the end of a container adds.
TIE, POWER, SIDE, BORDER = 24.0, 3, 1.0, 2
#: The ridge is so much for each labelled block.
SAMPLE, LABELLED, RIDGE = 2000, 200, 0.03


class _Element:
    """place: 2 in an element that is content by definition, 1 in one so named, -1 in boilerplate by name, -2 in boilerplate for good."""

    __slots__ = ("tag", "number", "depth", "parent", "place", "link", "by_tag")

    def __init__(self, tag: str, number: int, parent: _Element | None):
        self.tag, self.number, self.parent = tag, number, parent
        self.depth = parent.depth + 1 if parent else 0
        self.place = parent.place if parent else 0
        self.by_tag = parent.by_tag if parent else 0
        self.link = parent.link if parent else False


def named(value: str, in_content: bool = False) -> int:
    """What a class or id attribute says of an element, perhaps in an article: -2 comments, -1 boilerplate, 1 content, 0 nothing."""
    out = 0
    for name in value.split():
        words = {w.lower() for w in NAME_WORD.findall(name) if not w.isdigit()}
        plain = words - NEUTRAL
        if plain & COMMENT_WORD and plain <= COMMENT_WORD | BAD_WORD:
            if in_content and plain <= PERHAPS_COMMENT:
                continue
            return -2
        if plain & BAD_WORD and plain <= BAD_WORD:
            out = -1
        elif not out and words & GOOD_WORD and not words - GOOD_WORD - NEUTRAL:
            out = 1
    return out


def _mark(e: _Element, tag: str, rest: str) -> None:
    if tag == "a":
        e.link = True
    # A form may stand round a whole page: it ends like boilerplate by name.
    says = -1 if tag == "form" else -2 if tag in BAD_TAG or tag == "header" and e.place <= 0 else 2 if tag in GOOD_TAG else 0
    e.by_tag = says or e.by_tag
    if "=" in rest or "hidden" in rest:
        for name, a, b, c in ATTRIBUTE.findall(rest):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                if tag in ("html", "body", "a", "span"):
                    continue
                new = named(value, e.place == 2)
                says = new if says in (0, 1) or new == -2 else says
            elif name == "role":
                says = -2 if value.lower() in BAD_ROLE else 2 if value.lower() in ("main", "article") else says
            elif name == "itemprop":
                says = 2 if value.lower() == "articlebody" else says
            elif name == "style":
                says = -2 if HIDDEN.search(value) else says
            elif name == "hidden" or value.lower() == "true":
                says = -2
    # Boilerplate by name ends where an element that is content by definition begins; other boilerplate does not end inside.
    if e.place == -2 or e.place == -1 and says == 1:
        return
    if says:
        e.place = max(says, e.place) if says == 1 else says


def blocks(page: str) -> list[tuple[str, int, _Element]]:
    """The page's blocks: (text, characters in links, the element that holds them)."""
    root = here = _Element("", 0, None)
    out: list[tuple[str, int, _Element]] = []
    parts: list[tuple[str, bool]] = []
    holder = root
    at, n, number = 0, len(page), 0

    def flush() -> None:
        if parts:
            raw = "".join(p for p, _ in parts)
            text = " ".join(entities.unescape(raw).split())
            if text:
                out.append((text, sum(len(p) for p, linked in parts if linked), holder))
            parts.clear()

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            if not parts:
                holder = here
                while holder.tag not in BLOCK and holder.parent:
                    holder = holder.parent
            parts.append((text, here.link))
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK:
                flush()
            e = here
            while e.parent and e.tag != tag:
                e = e.parent
            if e.parent:
                here = e.parent
            continue
        if tag in RAW:
            if not m["rest"].endswith("/"):
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else n
            continue
        if tag == "br":
            parts.append((" ", here.link))
            continue
        if tag in BLOCK:
            flush()
            gone = CLOSES.get(tag)
            if gone:
                e = here
                while e.parent and e.tag not in gone and (e.tag not in FENCE):
                    e = e.parent
                if e.parent and e.tag in gone:
                    here = e.parent
        if tag in VOID:
            continue
        number += 1
        e = _Element(tag, number, here)
        _mark(e, tag, m["rest"])
        here = e
    flush()
    return out


def _distance(a: _Element, b: _Element) -> int:
    """Steps between two elements in the tree."""
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def look(text: str, linked: int, e: _Element) -> list[float]:
    """A block's FEATURES: nothing of its container but how deep it lies."""
    words = text.count(" ") + 1
    marks = text.count(",") + text.count(".") + text.count(";")
    return [
        1.0, min(1.0, words / FULL_WORDS), float(text[-1] in ".!?…:;\"'”»)"), min(1.0, 5 * marks / words), min(1.0, linked / len(text)),
        float(e.tag in HEADINGS), float(e.tag == "li"), float(e.tag in ("p", "blockquote", "pre")), min(1.0, e.depth / 20),
    ]


def prices(found: list[tuple[str, int, _Element]], weights: np.ndarray = USUAL) -> list[float]:
    """Each block's log odds of content."""
    if not found:
        return []
    own = np.clip(np.array([look(*b) for b in found]) @ weights, LEAST, MOST)
    place = {2: IN_CONTENT, 1: NAMED_CONTENT, 0: 0.0, -1: IN_BOILERPLATE, -2: IN_BOILERPLATE}
    return [float(x) + place[b[2].place] for x, b in zip(own, found, strict=True)]


def ties(found: list[tuple[str, int, _Element]]) -> list[tuple[int, int, float]]:
    """Smoothness edges between blocks next to each other, and between blocks that follow each other under one parent."""
    edges, last = [], {}
    for i, (_, _, e) in enumerate(found):
        if i:
            before = found[i - 1][2]
            steps = _distance(before, e) + BORDER * ((before.place > 0) != (e.place > 0) or (before.place < 0) != (e.place < 0))
            edges.append((i - 1, i, TIE / max(2, steps) ** POWER))
        parent = e.parent.number if e.parent else -1
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, SIDE if found[last[parent]][2].place == e.place else 0.0))
        last[parent] = i
    return edges


def main_text(page: str | None, weights: np.ndarray = USUAL) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b[0] for b, keep in zip(found, min_cut(prices(found, weights), ties(found)), strict=True) if keep)


LOOKS = T.StructType([T.StructField("looks", T.ArrayType(T.DoubleType())), T.StructField("content", T.DoubleType())])


def _labelled_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How blocks look that stand in content or boilerplate by tag, LABELLED of a page at most."""
    for pdf in batches:
        rows = []
        for page in pdf["_text"]:
            some = [b for b in blocks(page or "") if b[2].by_tag]
            rows += [(look(*b), float(b[2].by_tag > 0)) for b in some[:: max(1, -(-len(some) // LABELLED))]]
        yield pd.DataFrame(rows, columns=LOOKS.names)


def fitted(pages: DataFrame, id_col: str, html_col: str) -> np.ndarray:
    """The classifier's weights, from a bounded sample of the pages; both labels count alike in all."""
    ids = sampled_ids(pages, id_col, SAMPLE)
    got = texts_of(pages, ids, id_col, html_col).select("_text").mapInPandas(_labelled_blocks, LOOKS).toPandas()
    if not len(got) or got["content"].nunique() < 2:
        return USUAL
    x, y = np.array(got["looks"].to_list()), got["content"].to_numpy()
    order = np.lexsort((*x.T, y))  # rows arrive in any order: sorted, they give the same fit each time
    x, y = x[order], y[order]
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    return logistic(x, y, RIDGE * len(x), around=USUAL, weight=share)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    weights = fitted(pages, id_col, html_col)

    @F.pandas_udf(T.StringType())
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            yield pd.Series([main_text(p, weights) for p in found], dtype=object)

    rows = pages.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(url_col)).alias("_url"), text_of(quoted(html_col)).alias("text"))
    return rows.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))

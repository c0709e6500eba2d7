"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each with the path of tags from the root.  For
every path of the page the text length and the punctuation of its nodes are
added up; the ratios of both to the number of nodes are smoothed along the
page (a Gaussian over neighbouring nodes), fused by their product, and paths
over a share of the page's mean are content.  The article is the smallest
container that holds all text of the content paths, or the outermost article
or main around it: everything inside it in page order, but for what a page
carries beside its text (navigation, headers, footers, asides, forms, adverts,
notices, comments of readers).

Tags, and class, id or role values that say as a whole (also as all parts of a
slug: ``site-footer``, not ``has-sidebar``) what is beside the text, drop an
element; headings are never dropped by their names, and paragraphs and other
parts of a text not by names that may as well say what they are about (``MAYBE``).  Names, forms, asides and
headers are loose signs: on a page without an article or main outside of them,
one that holds most of the content paths' text is a wrapper and stays.  A main
is never beside the text, whatever is around it, unless it is hidden.

Thresholds alone cannot give whole articles: short paragraphs, headings and
captions have paths below any share that keeps menus out.  So the paths that
pass choose the stretch of the page, and what is inside it stays.

Each page is worked on alone: no shuffle.  Paths are interned and every walk
up the tree ends where an earlier one came by, so the time grows with the page
and not with its depth, and a badly closed page only concerns its own task.

Edge cases: a null or empty page gives the empty text; unclosed tags are closed
by their parents, end tags without a start are skipped, a page that is cut off
keeps what it has; quotes in unquoted values are part of them, a quote that is
never closed is one too, so tags end where browsers end them; character references without a semicolon are decoded as
browsers do.  Repeated rows are each extracted; an empty table stays empty.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "canvas", "video", "audio")
#: Elements that flow within a line; all others begin a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never part of an article's text.
ASIDE = frozenset("nav footer button select option menu dialog".split())
#: Elements that are beside the text unless most of it is in them.
LOOSE = frozenset("aside form fieldset header".split())
#: Words in class, id or role that say the same, and those for comments of readers.
BESIDE = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side-bar aside footer masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices popup modal newsletter subscribe subscription signup login search social share sharing related recommended widget pagination pager toolbar contentinfo complementary skip-link".split()
)
#: Those of them that a part of a text may have for what it is about.
MAYBE = frozenset("related notice notices share sharing search social recommended widget banner menu sponsor promotion subscription aside".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Words that go with them in a slug.
WITH = frozenset("site page main post posts article articles top bottom left right header primary secondary list item items link links box bar block area section container wrapper wrap inner outer button buttons form text body title author meta content thread reply".split())
HEADING = re.compile("h[1-6]$")
#: Elements within a text: what holds all of it is at least what is around them.
PARTS = INLINE | frozenset("p li ul ol dl dt dd blockquote pre figure figcaption h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
#: Elements that end tags of what is inside cannot cross.
SCOPE = frozenset("article aside body div footer header html main nav section table td th".split())

#: An attribute's value ends at its quote; without quotes, or with one that is never closed, at white space or the tag's end.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
TAG = re.compile(rf"<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+{VALUE})?+)*+)(>|\Z)|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z]?\Z)\S*\Z", re.S)
ATTRIBUTE = re.compile(rf"(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+({VALUE}))?+")
NAMES = frozenset("class id role aria-label".split())
#: Attributes that can matter.
SOME = re.compile(r"class|id|role|aria|style|hidden", re.I)
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？]")
SPACES = re.compile(r"\s+")
ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}

SIGMA = 1.0
#: A path is content from this share of the page's mean fused ratio.
SHARE = 0.5


class Element:
    __slots__ = ("tag", "parent", "path", "sign", "hidden", "out", "loose", "article", "depth", "masthead")

    def __init__(self, tag: str, parent: Element | None, path: int, sign: str = ""):
        self.tag, self.parent, self.path, self.sign = tag, parent, path, sign
        self.hidden = sign == "hidden" or bool(parent and parent.hidden)
        up = None if tag == "main" else parent
        self.out = self.hidden or sign == "out" or bool(up and up.out)
        #: The outermost loose sign; what is inside goes with it.
        self.loose: Element | None = (up and up.loose) or (self if sign == "loose" else None)
        self.article = tag in ("article", "main") or (parent.article if parent else False)
        self.depth = parent.depth + 1 if parent else 0
        #: In an article's own header, where only headings belong to the text.
        self.masthead = tag == "header" and sign != "loose" or bool(parent and parent.masthead and not HEADING.match(tag))


def decided(e: Element | None, known: dict[Element, bool], rule: Callable[[Element, bool], bool]) -> bool:
    """``rule`` of an element and of what it says of its parent, from the root down; each element is asked once."""
    chain = []
    while e is not None and e not in known:
        chain.append(e)
        e = e.parent
    value = e is not None and known[e]
    for x in reversed(chain):
        value = known[x] = rule(x, value)
    return value


def named(token: str, words: frozenset[str]) -> bool:
    """Whether a class, id or role is one of ``words``, alone or in a slug without other words."""
    if token in words:
        return True
    parts = re.split(r"[-_]+", token.strip("-_"))
    return len(parts) > 1 and not words.isdisjoint(parts) and all(p in BESIDE or p in COMMENTS or p in WITH or p.isdigit() for p in parts)


def sign_of(tag: str, attributes: str, in_article: bool) -> str:
    """``hidden``; ``out`` for what is always beside the text; ``loose`` for what mostly is; else empty."""
    tokens: list[str] = []
    if attributes and SOME.search(attributes):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
                return "hidden"
            if name in NAMES:
                tokens += ["-".join(value.lower().split())] if name == "aria-label" else value.lower().split()
    if tag in ASIDE:
        return "out"
    if tag not in ("html", "body", "article", "main") and not HEADING.match(tag):
        if any(named(t, COMMENTS) for t in tokens):
            return "out"
        names = BESIDE - MAYBE if tag in PARTS else BESIDE
        if tag in LOOSE and not (tag == "header" and in_article) or any(named(t, names) for t in tokens):
            return "loose"
    return ""


def nodes(page: str) -> list[tuple[Element, int, str]]:
    """Text nodes in page order: element, number of the block, raw text."""
    root = Element("#", None, 0)
    at, stack, out, block = 0, [root], [], 0
    paths: dict[tuple[int, str], int] = {}
    opened: dict[str, int] = {}

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    def text(end: int) -> None:
        if end > at:
            out.append((stack[-1], block, page[at:end]))

    pos = 0
    while m := TAG.search(page, pos):
        tag = m[3]
        if tag is None:  # a comment, a declaration or a tag that is cut off
            text(m.start())
            at = pos = m.end()
            continue
        tag = tag.lower()
        text(m.start())
        at = pos = m.end()
        if tag == "br":
            out.append((stack[-1], block, " "))
            continue
        if tag not in INLINE:
            block += 1
        if m[2]:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag in VOID:
            continue
        if tag in ENDS:
            end = ENDS[tag].search(page, pos)
            at = pos = end.end() if end else len(page)
            continue
        if tag in CLOSES_P and (opened.get("p") or tag in ("li", "dd", "dt") and opened.get(tag)):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or tag == stack[k].tag and tag in ("li", "dd", "dt"):
                    close(k)
                    break
                if stack[k].tag in SCOPE or stack[k].tag in ("ul", "ol", "dl"):
                    break
        up = stack[-1]
        if m[4].endswith("/") and tag not in INLINE and tag not in SCOPE:
            continue
        stack.append(Element(tag, up, paths.setdefault((up.path, tag), len(paths) + 1), sign_of(tag, m[4], up.article)))
        opened[tag] = opened.get(tag, 0) + 1
    text(len(page))
    return out


def content_paths(own: list[tuple[Element, int, str]]) -> set[int]:
    """Paths whose fused, smoothed ratio of text and punctuation is high."""
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for e, _, t in own:
        length[e.path] = length.get(e.path, 0) + len(t)
        marks[e.path] = marks.get(e.path, 0) + len(PUNCTUATION.findall(t))
        count[e.path] = count.get(e.path, 0) + 1
    if not own:
        return set()
    paths = [e.path for e, _, _ in own]
    ratio = np.array([[length[p] / count[p], (1 + marks[p]) / count[p]] for p in paths])
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    smooth = np.stack([np.convolve(np.pad(c, reach, "edge"), kernel / kernel.sum(), "valid") for c in ratio.T])
    fused = smooth[0] * smooth[1]
    best: dict[int, list[float]] = {}
    for p, f in zip(paths, fused):
        best.setdefault(p, []).append(f)
    means = {p: float(np.mean(f)) for p, f in best.items()}
    limit = SHARE * float(np.mean(fused))
    return {p for p, f in means.items() if f >= limit}


def around(held: list[Element]) -> Element | None:
    """The smallest container of all of ``held``; the outermost article or main around it, if there is one."""
    box = None
    below: set[Element] = set()
    for e in held:
        box = box or e
        while e is not box and e not in below:
            if e.depth > box.depth:
                below.add(e)
                e = e.parent
            else:
                below.add(box)
                box = box.parent
    while box is not None and box.tag in PARTS:
        box = box.parent
    up = box
    while up is not None:
        if up.tag in ("article", "main"):
            box = up
        up = up.parent
    return box


def wrappers(own: list[tuple[Element, int, str]]) -> set[Element]:
    """Elements with a loose sign that hold most of the content paths' text, on a page without an article or main outside of such."""
    solid = [x for x in own if x[2] != " "]
    if all(e.loose is None for e, _, _ in solid) or any(e.article and e.loose is None for e, _, _ in solid):
        return set()
    chosen = content_paths(solid)
    weight: dict[Element, int] = {}
    total = 0
    for e, _, t in solid:
        if e.path in chosen:
            total += len(t)
            weight[e] = weight.get(e, 0) + len(t)
    every = dict.fromkeys(weight)
    for e in list(weight):
        while e.parent is not None and e.parent not in every:
            e = e.parent
            every[e] = None
    for e in sorted(every, key=lambda x: -x.depth):
        if e.parent is not None:
            weight[e.parent] = weight.get(e.parent, 0) + weight[e]
    return {e for e in every if e.sign == "loose" and 2 * weight[e] > total}


def extract(page: str | None) -> str:
    own = [(e, b, t) for e, b, t in nodes(page or "") if not e.out and not e.masthead and (t == " " or not t.isspace())]
    kept = wrappers(own)
    known: dict[Element, bool] = {}
    # beside the text: below a loose sign that isn't kept; a main ends the way up
    beside = lambda x, up: x.tag != "main" and (up or x.sign == "loose" and x not in kept)
    own = [x for x in own if x[0].loose is None or not decided(x[0], known, beside)]
    solid = [x for x in own if x[2] != " "]
    chosen = content_paths(solid)
    box = around([e for e, _, _ in solid if e.path in chosen])
    if box is None:
        return ""
    parts: list[list[str]] = []
    last = None
    within: dict[Element, bool] = {}
    for e, b, t in own:
        if not decided(e, within, lambda x, up: up or x is box):
            continue
        if b != last:
            parts.append([])
            last = b
        parts[-1].append(t)
    clean = (SPACES.sub(" ", html.unescape("".join(p))).strip() for p in parts)
    return " ".join(p for p in clean if p)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))

"""Main text of web pages from flat text blocks.

A page is cut at its block elements into a flat list of text blocks. What describes a block is its number of words and the
share of its text that is linked, the same of the block before and after it, and some marks of its surroundings: whether an
element around it names itself article, menu, footer, advert, comments and the like, by its tag or its class. A decision
tree, trained by Spark on the labelled table of html_labelled.py, then says which blocks belong to the main text. A task
reads pages one at a time and applies the tree to all blocks of a batch together; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import chunks
from assaykit.llm.html_labelled import LAYOUTS, SCALES
from assaykit.llm.repeats import table_of

#: Elements that end a block, elements without text of their own, and such whose content isn't markup.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
    hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button head""".split()
)
SILENT_TAGS = frozenset("template svg math canvas audio video object applet datalist".split())
RAW_TAGS = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS, LISTS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("ul ol menu dir dl table".split())
#: Elements that the next block element ends, and items that the next item of a list or table ends.
ENDED_BY_ANY = HEADINGS | {"p"}
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
#: What elements call themselves: surely not the main text; not the main text unless an element within says so; the main text.
NEVER_TAGS, RARELY_TAGS, MAIN_TAGS = frozenset("nav footer aside dialog menu button select datalist".split()), frozenset("header search".split()), frozenset("article main".split())
NEVER = re.compile(r"\b(ads?|adv|advert\w*|adsbygoogle|sponsor\w*|comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|nav\w*|breadcrumbs?|footers?)\b")
RARELY = re.compile(
    r"\b(alert|announcement|banner|copyright|dialog|legal|login|masthead|menu\w*|modal|newsletter|notices?|notification|overlay|pager|pagination|popup|promo\w*|recommend\w*|related|search|share|sharing|sidebar|sidenav|signup|skip|social|subscribe|subscription|teasers?|toolbar|topbar|trending|widgets?)\b"
)
MAIN = re.compile(r"\b(article\w*|blog|content|entry|main\w*|post|posts|prose|story|text)\b")
HEADER = re.compile(r"\b(header|hdr)\b")
#: Words of notices, and headings that open the readers' part.
NOTICE = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)|\bsubscribe\b|\bnewsletter\b|\bsign up\b|\blog ?in\b|^advert|^sponsored|share this|leave a (?:reply|comment)", re.I)
READERS = re.compile(r"^(?:\d+ )?(?:comments?|responses?|replies|leave a (?:reply|comment)|reader comments)\b", re.I)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[\W\d_]+")
#: A comment, a declaration, or a tag; quotes count behind = only, and what is never closed goes to the end.
TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)""",
    re.S,
)
#: Bounds of the tree, which the small table asks for.
DEPTH, LEAST_ROWS = 8, 6


class Block(NamedTuple):
    """A text block; near: 1 if the nearest element that says so is of the main text, -1 if not, 0 without any."""

    text: str
    words: int
    linked: float
    near: int
    never: bool
    form: bool
    heading: bool
    item: bool
    readers: bool


class Around(NamedTuple):
    """An open element and what holds within it."""

    tag: str
    near: int = 0
    never: bool = False
    form: bool = False
    silent: bool = False


FEATURES = ("words", "linked", "words before", "linked before", "words after", "linked after", "near", "never", "form", "heading", "item", "notice", "readers")


def unescaped(text: str) -> str:
    """Character references decoded; numbers beyond any character give the replacement character."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = re.sub(r"&#0{7,}(?=\d)", "&#", text)
        text = re.sub(r"&#[1-9]\d{7,};?", "�", text)
    return html.unescape(text)


def _within(outer: Around, tag: str, attributes: str) -> Around:
    names = ""
    if attributes and tag not in ("html", "body"):
        names = " ".join(CAMEL.sub(" ", x.strip("\"'")) for x in NAMES.findall(attributes)).lower()
    never = outer.never or tag in NEVER_TAGS or bool(names and NEVER.search(names))
    main = tag in MAIN_TAGS or bool(names and MAIN.search(names))
    if names and RARELY.search(names):
        near = -1
    elif tag in RARELY_TAGS or names and HEADER.search(names):
        near = outer.near or -1  # the article has a header too
    else:
        near = 1 if main else outer.near
    return Around(tag, near, never, outer.form or tag == "form", outer.silent or tag in SILENT_TAGS or tag == "head")


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; white space within a block is one space, and blocks without text go."""
    out: list[Block] = []
    stack, opened = [Around("")], Counter()
    pieces: list[tuple[str, bool]] = []
    linked = readers = False

    def flush() -> None:
        nonlocal readers
        if not pieces:
            return
        text = " ".join(unescaped("".join(p for p, _ in pieces)).split())
        if text:
            size = [sum(len(p) - p.count(" ") for p, link in pieces if link or not only) for only in (True, False)]
            here = stack[-1]
            heading = any(x.tag in HEADINGS for x in stack[-3:])
            readers = readers or bool(heading and READERS.search(text))
            out.append(Block(text, text.count(" ") + 1, size[0] / max(1, size[1]), here.near, here.never, here.form, heading, any(x.tag == "li" for x in stack[-3:]), readers))
        pieces.clear()

    def close(tag: str) -> None:
        if opened[tag]:
            while stack[-1].tag != tag:
                opened[stack.pop().tag] -= 1
            opened[stack.pop().tag] -= 1

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not stack[-1].silent:
            pieces.append((text, linked))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK_TAGS or tag in SILENT_TAGS:
                flush()
                linked = False
                close(tag)
            elif tag == "a":
                linked = False
        elif tag in RAW_TAGS:
            ending = re.compile(f"</{re.escape(tag)}(?![a-zA-Z0-9])", re.I).search(page, at)
            at = ending.start() if ending else end
        elif tag == "br":
            pieces.append((" ", linked))
        elif tag == "a":
            linked = "href" in m[3].lower()
        elif tag in BLOCK_TAGS or tag in SILENT_TAGS:
            flush()
            if stack[-1].tag in ENDED_BY_ANY:
                close(stack[-1].tag)
            if tag == "body":
                close("head")
            for name in ENDED_BY.get(tag, ()):
                # an item ends the one before it in its list
                near = next((x.tag for x in stack[:-8:-1] if x.tag in LISTS or x.tag == name), "")
                if near == name:
                    close(name)
            if tag not in EMPTY_TAGS:
                stack.append(_within(stack[-1], tag, m[3]))
                opened[tag] += 1
    flush()
    # a form around the whole page says nothing
    words = sum(b.words for b in out)
    if out and 2 * sum(b.words for b in out if b.form) > words:
        out = [b._replace(form=False) for b in out]
    return out


def features(of_page: Sequence[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    own = np.array([(b.words, b.linked) for b in of_page], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1]])[: len(own)], np.vstack([own[1:], edge])[: len(own)]
    marks = np.array([(b.near, b.never, b.form, b.heading, b.item, bool(NOTICE.search(b.text)), b.readers) for b in of_page], float).reshape(-1, 7)
    return np.hstack([own, before, after, marks])


def labelled_rows(layouts: Iterable[str] = LAYOUTS, scales: Sequence[float] = SCALES) -> list[tuple[float, list[float]]]:
    """(label, features) of each block of the labelled layouts."""
    rows = []
    for layout, scale in ((x, s) for x in layouts for s in scales):
        words = lambda m: " ".join([m[2], *["word"] * (max(1, round(int(m[1]) * scale)) - len(m[2].split()))]).strip()  # noqa: B023, E731
        found = blocks(re.sub(r"\{(\d+):?([^}]*)\}", words, layout))
        labels = [b.text[0] for b in found]
        found = [b._replace(text=b.text[1:]) for b in found]
        rows += [(float(label == "+"), x.tolist()) for label, x in zip(labels, features(found), strict=True)]
    return rows


class Tree(NamedTuple):
    """A binary tree: a node's feature (-1: a leaf), threshold, children and prediction."""

    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def keeps(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while len(x) and (self.feature[node] >= 0).any():
            inner = self.feature[node] >= 0
            low = x[np.arange(len(x)), np.maximum(self.feature[node], 0)] <= self.threshold[node]
            node = np.where(inner, np.where(low, self.below[node], self.above[node]), node)
        return self.value[node] > 0.5


def trained(spark: SparkSession, layouts: Iterable[str] = LAYOUTS, depth: int = DEPTH, least_rows: int = LEAST_ROWS) -> Tree:
    """A decision tree fitted by Spark to the labelled layouts, which are all the rows it sees."""
    rows = [(label, Vectors.dense(x)) for label, x in labelled_rows(layouts)]
    frame = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least_rows, maxBins=64, seed=1).fit(frame)
    nodes: list[list[float]] = []

    def add(node) -> int:
        k = len(nodes)
        nodes.append([-1, 0.0, 0, 0, node.prediction()])
        if node.toString().startswith("Internal"):
            split = node.split()
            nodes[k][:2] = split.featureIndex(), split.threshold()
            nodes[k][2] = add(node.leftChild())
            nodes[k][3] = add(node.rightChild())
        return k

    add(model._call_java("rootNode"))
    feature, threshold, below, above, value = map(np.array, zip(*nodes, strict=True))
    return Tree(feature.astype(int), threshold, below.astype(int), above.astype(int), value)


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_texts(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each row of pages, its blocks joined by an empty line.

    A null html, or one without main text, gives an empty text. Rows that repeat give a row each; page_id and url are passed
    on, nulls too. Pages of any length are read whole, also when cut off within a tag or reference; tags that are never
    closed or opened do no harm. Other columns are ignored; an empty table gives an empty result.
    """
    tree = tree or trained(pages.sparkSession)

    def run(batches):
        for batch in chunks(batches, "html"):
            of_page = [blocks(x or "") for x in batch.column("html").to_pylist()]
            keep = tree.keeps(np.vstack([features(b) for b in of_page]))
            texts, start = [], 0
            for b in of_page:
                texts.append("\n\n".join(x.text for x, k in zip(b, keep[start : start + len(b)], strict=True) if k))
                start += len(b)
            yield table_of(list(zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), texts, map(len, texts), strict=True)), TEXTS)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

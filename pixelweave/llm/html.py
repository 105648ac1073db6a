"""Main text of web pages: boosted trees over the nodes of the document tree, and a hierarchical decoder.

A scanner builds the tree of block elements; text between their tags makes the blocks, inline elements only count. Each node has
features of its subtree's density, its attribute tokens, its depth and its siblings. Trees boosted on pages made from random templates, whose
main text is known, give each node the chance that its subtree holds main text. The decoder takes the most likely
choice in which a node holds main text exactly if one of its children does, so that no choice contradicts another.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import in_blocks, table
from pixelweave.llm.pagemaker import FAMILIES, made_page

#: Pages that the trees are fitted on, trees, levels of a tree, bins of a feature.
PAGES, TREES, LEVELS, BINS = 1200, 60, 4, 32
#: Inside of a tag up to its end; a quote that never ends counts as a sign.
INSIDE = r"(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^>]*\Z))*"
#: Comments and elements whose inside isn't text. Scripts and styles that never end reach to the page's end; of others only the tag is left out then.
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style)\b{INSIDE}>.*?(?:</\1\s*>|\Z)|<(noscript|template|textarea|iframe|title|select)\b{INSIDE}>.*?</\2\s*>"
    rf"|<svg\b{INSIDE}(?<!/)>.*?</svg\s*>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<inside>{INSIDE})>",
    re.S | re.I,
)
TAG_BEGIN = re.compile(r"</?[a-zA-Z]|<!")
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
#: Elements whose tags part blocks.
BLOCKS = frozenset(
    "html body article aside nav header footer main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "form fieldset figure figcaption blockquote pre address details summary dialog center hr hgroup menu legend option".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the second kind.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("form",)}
TAGS = "html body article aside nav header footer main section div p h1 h2 h3 h4 ul ol li table td form figure blockquote pre address dl".split()
#: Attribute tokens by what they tell of.
TOKENS = {
    "main": "article main content post entry story body text page blog prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs skip toc",
    "head": "header head masthead logo top branding hero",
    "foot": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside widget rail column secondary complementary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "share": "share sharing social follow facebook twitter like",
    "talk": "comment comments reply replies respond discussion disqus thread feedback reviews",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning message",
    "form": "newsletter subscribe signup login search form register contact",
    "more": "related recommended recommendations more popular trending latest recent also teaser links",
}
GROUP = {word: i for i, words in enumerate(TOKENS.values()) for word in words.split()}
TAG = {tag: i for i, tag in enumerate(TAGS)}
ABOVE = [TAG[t] for t in ("article", "aside", "nav", "header", "footer", "main", "form", "ul", "li")]
PLAIN = 20


class Node:
    __slots__ = ("tag", "parent", "kids", "groups", "runs", "chars", "words", "links", "marks", "tags", "paragraphs", "blocks", "begin", "end", "depth", "place", "text", "order")

    def __init__(self, tag: str, parent: Node | None, groups: frozenset[int], begin: int):
        self.tag, self.parent, self.groups, self.begin = tag, parent, groups, begin
        self.kids: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.place = len(parent.kids) if parent else 0
        self.chars = self.words = self.links = self.marks = self.tags = self.paragraphs = self.blocks = 0
        self.text = ""
        self.end = begin
        if parent:
            parent.kids.append(self)


def parse(page: str) -> list[Node]:
    """The page's block elements and, as nodes of their own with tag "", its runs of text, parents first."""
    root = Node("", None, frozenset(), 0)
    nodes, node = [root], root
    stack: list[str] = []  # inline elements are not kept: only links count
    pieces: list[str] = []
    linked = link = at = seen = 0

    def flush() -> None:
        nonlocal pieces, linked, seen
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            pieces = []
            if text:
                run = Node("", node, frozenset(), seen)
                run.text, run.chars, run.words = text, len(text), text.count(" ") + 1
                run.links = min(linked, run.chars)
                run.marks = text.count(",") + text.count(".") + text.count(";") + text.count("?") + text.count("!")
                seen += run.chars
                nodes.append(run)
        linked = 0

    for m in MARKUP.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if link:
                linked += len(piece)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        node.tags += 1
        if name not in BLOCKS:
            if name == "a":
                link = 0 if m["end"] else 1
            elif name == "br":
                pieces.append(" ")
            continue
        flush()
        if m["end"]:
            up = node
            while up is not root and up.tag != name and not (name == "p" and up.tag != "p"):
                up = up.parent
            if up.tag == name and up is not root:
                node = up.parent
            link = 0
            continue
        if name != "p" or node.tag == "p":
            if node.tag == "p":
                node = node.parent
        for closed in ENDS.get(name, ()):
            up = node
            while up is not root and up.tag != closed and up.tag not in FENCES[name]:
                up = up.parent
            if up.tag == closed:
                node = up.parent
        if name in EMPTY:
            continue
        found: set[int] = set()
        if "=" in m["inside"]:
            for a in ATTRIBUTE.finditer(m["inside"]):
                for word in WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", a[1] or a[2] or a[3] or "").lower()):
                    if (g := GROUP.get(word)) is not None:
                        found.add(g)
        node = Node(name, node, frozenset(found), seen)
        nodes.append(node)
    if at < len(page):
        begun = TAG_BEGIN.search(page, at)  # a tag that never ends is markup, not text
        pieces.append(page[at : begun.start()] if begun else page[at:])
    flush()
    for x in reversed(nodes):
        x.end = max(x.end, x.begin + x.chars)
        if x.parent:
            up = x.parent
            up.chars += x.chars
            up.words += x.words
            up.links += x.links
            up.marks += x.marks
            up.tags += x.tags + 1
            up.blocks += x.blocks + (x.tag != "")
            up.paragraphs += x.paragraphs + (x.tag == "p")
            up.end = max(up.end, x.end)
    return nodes


WIDTH = PLAIN + len(TAGS) + 2 * len(TOKENS) + len(ABOVE) + len(TAGS)


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node; a run takes its element's tag and tokens."""
    out = np.zeros((len(nodes), WIDTH), np.float32)
    whole = max(1, nodes[0].chars)
    t0, g0 = PLAIN, PLAIN + len(TAGS)
    a0, b0 = g0 + len(TOKENS), g0 + 2 * len(TOKENS)
    p0 = b0 + len(ABOVE)
    log = math.log1p
    for i, x in enumerate(nodes):
        x.order = i
        up = x.parent
        own = up if x.tag == "" and up else x
        siblings = len(up.kids) if up else 1
        words, chars = max(1, x.words), max(1, x.chars)
        out[i, :PLAIN] = (
            x.depth, x.place, siblings, siblings - x.place, log(x.chars), log(x.words), x.links / chars, 100 * x.tags / chars, log(x.paragraphs), log(x.blocks),
            x.marks / words, x.chars / whole, x.chars / max(1, up.chars if up else whole), x.words / max(1, x.paragraphs), x.begin / whole, x.end / whole,
            x.tag == "", log(up.chars) if up else 0.0, up.links / max(1, up.chars) if up else 0.0, log(up.paragraphs) if up else 0.0,
        )
        if (t := TAG.get(own.tag)) is not None:
            out[i, t0 + t] = 1
        for g in own.groups:
            out[i, g0 + g] = 1
        if own.parent:
            j = own.parent.order
            out[i, a0:b0] = np.maximum(out[j, a0:b0], out[j, g0:a0])
            out[i, b0:p0] = out[j, b0:p0]
            for k, t in enumerate(ABOVE):
                if out[j, t0 + t]:
                    out[i, b0 + k] = 1
            if (t := TAG.get(own.parent.tag)) is not None:
                out[i, p0 + t] = 1
    return out


class Forest:
    """Trees boosted on the logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rate: float = 0.2):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self.binned(x)
        self.trees, n = [], len(y)
        useful = [f for f in range(x.shape[1]) if binned[f].max() > 1]
        pairs = [f for f in range(x.shape[1]) if binned[f].min() == 0 and binned[f].max() == 1]
        ones = np.ascontiguousarray(binned[pairs].T, np.float32)  # features of two bins are summed up together
        logit = np.zeros(n)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-logit))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            which, level = [], []
            for depth in range(LEVELS):
                leaves = 1 << depth
                best = (np.full(leaves, 1e-6), np.zeros(leaves, np.int64), np.full(leaves, BINS, np.int64))
                if pairs:
                    spread = np.zeros((2 * leaves, n), np.float32)
                    spread[at, np.arange(n)], spread[leaves + at, np.arange(n)] = g, h
                    total, high = spread.sum(axis=1, keepdims=True), spread @ ones
                    (ga, ha), (a, b) = (total[:leaves], total[leaves:]), (total[:leaves] - high[:leaves], total[leaves:] - high[leaves:])
                    gain = a**2 / (b + 1) + (ga - a) ** 2 / (ha - b + 1) - ga**2 / (ha + 1)
                    gain[(b < 2) | (ha - b < 2)] = 0
                    f = gain.argmax(axis=1)
                    top = gain[np.arange(leaves), f]
                    better = top > best[0]
                    for store, value in zip(best, (top, np.array(pairs)[f], np.zeros(leaves, np.int64))):
                        store[better] = value[better]
                for f in useful:
                    cell = at * BINS + binned[f]
                    a = np.bincount(cell, weights=g, minlength=leaves * BINS).reshape(leaves, BINS).cumsum(axis=1)
                    b = np.bincount(cell, weights=h, minlength=leaves * BINS).reshape(leaves, BINS).cumsum(axis=1)
                    ga, ha = a[:, -1:], b[:, -1:]
                    gain = a**2 / (b + 1) + (ga - a) ** 2 / (ha - b + 1) - ga**2 / (ha + 1)
                    gain[(b < 2) | (ha - b < 2)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(leaves), k]
                    better = top > best[0]
                    for store, value in zip(best, (top, np.full(leaves, f), k)):
                        store[better] = value[better]
                which.append(best[1])
                level.append(best[2])
                at = 2 * at + (binned[best[1][at], np.arange(n)] > best[2][at])
            total = 1 << LEVELS
            value = rate * np.bincount(at, weights=g, minlength=total) / (np.bincount(at, weights=h, minlength=total) + 1)
            logit += value[at]
            self.trees.append((which, level, value))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], np.uint8).reshape(x.shape[1], len(x))

    def logits(self, x: np.ndarray) -> np.ndarray:
        binned, out, every = self.binned(x), np.zeros(len(x)), np.arange(len(x))
        for which, level, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for f, k in zip(which, level):
                at = 2 * at + (binned[f[at], every] > k[at])
            out += value[at]
        return out


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """The most likely choice in which a node is chosen exactly if it is a chosen run or has a chosen child."""
    n = len(nodes)
    drop = [0.0] * n  # nothing in the subtree, against even odds
    keep = [0.0] * n
    yes = [float(min(30, -math.log1p(math.exp(-max(-30.0, min(30.0, v)))))) for v in logits]
    no = [float(-math.log1p(math.exp(max(-30.0, min(30.0, v))))) for v in logits]
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag == "" and i:
            drop[i], keep[i] = no[i], yes[i]
            continue
        drop[i] = no[i] + sum(drop[k.order] for k in x.kids)
        if not x.chars:
            keep[i] = -math.inf
            continue
        gains = [keep[k.order] - drop[k.order] for k in x.kids]
        chosen = sum(g for g in gains if g > 0) if max(gains) > 0 else max(gains)
        keep[i] = yes[i] + sum(drop[k.order] for k in x.kids) + chosen
    out = [False] * n
    out[0] = n > 1 and keep[0] > drop[0]
    for i, x in enumerate(nodes):
        if out[i] and x.kids:
            gains = [keep[k.order] - drop[k.order] for k in x.kids]
            for k, g in zip(x.kids, gains):
                out[k.order] = g > 0
            if max(gains) <= 0:
                out[x.kids[gains.index(max(gains))].order] = True
    return out


@functools.cache
def forest(pages: int = PAGES, seed: int = 11, families: tuple[str, ...] = tuple(FAMILIES)) -> Forest:
    """Trees fitted on made pages of some families."""
    r, rows, marks = random.Random(seed), [], []
    for _ in range(pages):
        page, main = made_page(r, families)
        nodes = parse(page)
        rows.append(features(nodes))
        own = [x.tag == "" and x.text in main for x in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            if own[i]:
                own[nodes[i].parent.order] = True
        marks.append(own)
    return Forest(np.concatenate(rows), np.concatenate(marks).astype(float))


def extract(pages: list[str | None], trees: Forest) -> list[list[str]]:
    """Main blocks of each page, in order."""
    parsed = [parse(page or "") for page in pages]
    if not parsed:
        return []
    logits = trees.logits(np.concatenate([features(nodes) for nodes in parsed]))
    out, at = [], 0
    for nodes in parsed:
        chosen = decode(nodes, logits[at : at + len(nodes)])
        at += len(nodes)
        out.append([x.text for x, c in zip(nodes, chosen) if c and x.tag == "" and x.text])
    return out


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page.

    One row per input row: the id and url columns, text (blocks in page order joined by a line break; empty if there are none) and n_chars (code
    points). A null or empty page has no text. Pages may be cut off anywhere; a tag that never ends is left out. Repeated rows give
    repeated results; no rows give none; other columns are dropped. The trees are fitted on made pages at a fixed seed, so reruns agree.
    """
    trees = forest()
    given = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))

    def work(columns: list[pa.Array]) -> list:
        found = ["\n".join(x) for x in extract(columns[2].to_pylist(), trees)]
        return [columns[0], columns[1], found, [len(x) for x in found]]

    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    found = given.mapInArrow(in_blocks(work, schema, weigh=2, most=1_000_000), "id long, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))

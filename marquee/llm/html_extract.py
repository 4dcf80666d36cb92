"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a binary variable, content or not. A potential joins each element to its parent, and one per
element comes from what is seen of it (tag, class words, length of its text, share of linked text, paragraphs and text of its own). All are counted on
labelled pages. Sum-product messages pass from the leaves up and from the root down and give each element's marginal;
the text of the elements whose marginal is at least a half is the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import training_pages

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
SKIPPED = frozenset("head script style noscript template iframe svg math select button textarea object audio video canvas title label".split())
#: All that may stand in a head; anything else ends it.
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes an open element of these names first, up to the nearest of the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: What ends a tag, or begins a quoted value in it.
TAG_END = re.compile(r">|=\s*([\"'])")
#: One whole attribute, from its name to the end of its value, quoted or bare; what stands inside a value is never a name.
ATTR = re.compile(r"([^\s\"'>/][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?|\"[^\"]*\"|'[^']*'")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"[ \t\n\r\f\v   　]+")
#: Elements that say nothing by their names: without class words, their own text and paragraphs tell most.
FRAME = frozenset(("#root", "html", "body", "div", "form"))
#: Bounds of the classes of text lengths and of shares of linked text.
LENGTHS, LINKED = (1, 25, 80, 300, 1200), (0.05, 0.35, 0.75)
#: From this chance on that a page has any content, its elements are judged as those of a page that has some.
LEAST_ANY = 0.15


class Page:
    """A page as parallel lists in document order; element 0 is the root. A text belongs to its element."""

    def __init__(self, source: str, labelled: bool = True):
        self.labelled = labelled  # otherwise data-y is an attribute of the page's own
        self.tag, self.parent, self.words, self.label, self.skip = ["#root"], [-1], [()], [None], [False]
        self.texts: list[tuple[int, int, str]] = []  # element, block, text
        self.block = 0
        self._parse(source)

    def _open(self, tag: str, parent: int, attrs: str) -> int:
        words, label, skip, given = [], self.label[parent], self.skip[parent] or tag in SKIPPED, {""}
        if attrs and not attrs.isspace():
            for m in ATTR.finditer(attrs):
                name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
                if name in given:  # of repeated attributes the first counts
                    continue
                given.add(name)
                if name in ("class", "id", "role"):
                    words += WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
                elif name == "data-y" and self.labelled:
                    label = int(value)
                elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
                    skip = True
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(tuple(dict.fromkeys(words)))
        self.label.append(label)
        self.skip.append(skip)
        return len(self.tag) - 1

    def _say(self, element: int, text: str) -> None:
        if text and not self.skip[element]:
            self.texts.append((element, self.block, html.unescape(text) if "&" in text else text))

    def _parse(self, source: str) -> None:
        stack, at, size, opened = [0], 0, len(source), Counter()

        def close(k: int) -> None:
            opened.subtract(self.tag[e] for e in stack[k:])
            del stack[k:]

        while at < size:
            m = TOKEN.search(source, at)
            text = source[at : m.start() if m else size]
            if self.tag[stack[-1]] == "head" and text and not text.isspace():
                close(len(stack) - 1)
            self._say(stack[-1], text)
            if m is None:
                break
            at = m.end()
            if not m[2]:
                continue
            tag, begin, at = m[2].lower(), at, size
            end = size
            for part in TAG_END.finditer(source, begin):
                if part.start() < begin:  # inside a quoted value
                    continue
                if part[1] is None:
                    end, at = part.start(), part.end()
                    break
                begin = source.find(part[1], part.end()) + 1
                if not begin:  # a quote that nothing closes
                    begin = part.end()
            attrs = source[m.end() : end]
            if m[1]:
                if opened[tag] > 0:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag))
                if tag in BLOCKS:
                    self.block += 1
                continue
            if opened["head"] > 0 and tag not in IN_HEAD:
                close(next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == "head"))
            if tag == "br":
                self._say(stack[-1], "\n")
            if tag in BLOCKS:
                self.block += 1
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    name = self.tag[stack[k]]
                    if name == "p":
                        close(k)
                        break
                    if name in BLOCKS:
                        break
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name in ends:
                        close(k)
                        break
                    if name in stops:
                        break
            element = self._open(tag, stack[-1], attrs)
            if tag in VOID or attrs.endswith("/") and tag not in BLOCKS and tag not in RAW:
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                self._say(element, source[at : end.start() if end else size])
                at = end.end() if end else size
                continue
            stack.append(element)
            opened[tag] += 1

    def seen(self) -> list[tuple[str, ...]]:
        """What is observed of each element, as feature names."""
        n = len(self.tag)
        total, linked, in_link, own, paragraphs = np.zeros(n), np.zeros(n), [False] * n, [0] * n, [0] * n
        for k in range(1, n):
            in_link[k] = self.tag[k] == "a" or in_link[self.parent[k]]
            paragraphs[self.parent[k]] += self.tag[k] == "p"
        for k, _, text in self.texts:
            total[k] += len(text)
            own[k] += len(text.strip())
            linked[k] += len(text) * in_link[k]
        for k in range(n - 1, 0, -1):
            total[self.parent[k]] += total[k]
            linked[self.parent[k]] += linked[k]
        size = np.searchsorted(LENGTHS, total, side="right")
        share = np.searchsorted(LINKED, linked / np.maximum(total, 1), side="right")
        block = [t in BLOCKS or t in FRAME for t in self.tag]  # what stands inside a line goes with it, but for its class words
        own_seen = lambda k: (f"tag {self.tag[k]}", f"size {size[k]}", f"linked {share[k]}") if block[k] else ()
        return [(*own_seen(k), *([f"frame {min(2, paragraphs[k])} {own[k] > 0}"] if self.tag[k] in FRAME and not self.words[k] else []), *[f"word {w}" for w in self.words[k]]) for k in range(n)]


class TreeModel:
    """Potentials counted on labelled pages, with ``smooth`` added to each count; block and inline children have their own."""

    def __init__(self, pages: list[str], smooth: float = 0.5):
        edge, root, counts, of = np.full((2, 2, 2), smooth), np.full(2, smooth), Counter(), np.zeros(2)
        names: set[str] = set()
        for source in pages:
            page = Page(source)
            label = [int(y or 0) for y in page.label]
            label[0] = max([0, *(y for y, p in zip(label, page.parent, strict=True) if p == 0)])  # the root is what it holds
            root[label[0]] += 1
            for k, features in enumerate(page.seen()):
                if k:
                    edge[int(page.tag[k] in BLOCKS), label[page.parent[k]], label[k]] += 1
                of[label[k]] += 1
                for f in features:
                    counts[f, label[k]] += 1
                    names.add(f)
        self.root, self.edge = np.log(root / root.sum()), np.log(edge / edge.sum(2, keepdims=True))
        self.log = {f: tuple(math.log((counts[f, y] + smooth) / (of[y] + 2 * smooth)) for y in (0, 1)) for f in names}

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each element, by one pass of messages up and one down."""
        return self.chances(page)[0]

    def chances(self, page: Page) -> tuple[list[float], float]:
        """P(content) of each element, and the chance that any element is content."""
        n, parent = len(page.tag), page.parent
        edges = [tuple(np.ravel(x).tolist()) for x in self.edge]
        edge = [edges[t in BLOCKS] for t in page.tag]
        get = self.log.get
        a0, a1, up0, up1 = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        for k, features in enumerate(page.seen()):
            for f in features:
                if (x := get(f)) is not None:
                    a0[k] += x[0]
                    a1[k] += x[1]
        nothing = self.root[0] + sum(a0) + sum(e[0] for e in edge[1:])  # logarithm of the weight of a page without content
        for k in range(n - 1, 0, -1):
            e00, e01, e10, e11 = edge[k]
            up0[k], up1[k] = _add(e00 + a0[k], e01 + a1[k]), _add(e10 + a0[k], e11 + a1[k])
            a0[parent[k]] += up0[k]
            a1[parent[k]] += up1[k]
        b0, b1 = a0, a1  # beliefs from below; from here on with what comes from above
        b0[0] += self.root[0]
        b1[0] += self.root[1]
        some = -math.expm1(min(0.0, nothing - _add(b0[0], b1[0])))
        for k in range(1, n):
            e00, e01, e10, e11 = edge[k]
            p0, p1 = b0[parent[k]] - up0[k], b1[parent[k]] - up1[k]
            m0, m1 = _add(p0 + e00, p1 + e10), _add(p0 + e01, p1 + e11)
            top = max(m0, m1)
            b0[k] += m0 - top
            b1[k] += m1 - top
        return [1 / (1 + math.exp(min(700.0, max(-700.0, x - y)))) for x, y in zip(b0, b1, strict=True)], some

    def extract(self, source: str | None) -> str:
        page = Page(source or "", labelled=False)
        if not page.texts:
            return ""
        (content, some), blocks = self.chances(page), {}
        bar = 0.5 * some if some >= LEAST_ANY else 0.5  # of those pages that have content at all, most call it content
        for k, block, text in page.texts:
            if content[k] >= bar:
                blocks.setdefault(block, []).append(text)
        joined = (SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
        return "\n\n".join(t for t in joined if t)


def _add(x: float, y: float) -> float:
    """Logarithm of the sum of two numbers given by their logarithms."""
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x)) if x - y < 40 else x


def extract_main_text(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    ``labelled`` holds training pages whose elements say ``data-y="1"`` (content) or ``data-y="0"``, inherited by what
    is inside; a small generated set by default. Null or empty html gives an empty text, as does a page without content.
    Repeated pages each give a row; an empty table gives an empty result; other columns are ignored. Malformed html is
    read as far as it goes; nothing is cut, however long the page.
    """
    model = TreeModel(training_pages() if labelled is None else labelled)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))

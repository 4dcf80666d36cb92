"""Rows out of HTML pages: anchors, titles and visible text, parsed per Arrow batch with the standard library."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages whose texts a task holds at a time.
PAGES = 100
SKIPPED = frozenset(("script", "style", "nav", "footer", "header", "iframe"))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.anchors, self.parts, self.heading, self._href, self._text, self._skip, self._in_heading = [], [], [], None, [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self._skip += 1
        if tag == "a":
            self._href, self._text = dict(attrs).get("href"), []
        self._in_heading = self._in_heading or tag == "h1"

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self._skip = max(0, self._skip - 1)
        if tag == "a" and self._href is not None:
            self.anchors.append((self._href, " ".join("".join(self._text).split())))
            self._href = None
        if tag == "h1":
            self._in_heading = False

    def handle_data(self, data):
        if self._href is not None:
            self._text.append(data)
        if self._in_heading:
            self.heading.append(data)
        if not self._skip:
            self.parts.append(data)


def _read(source: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(source or "")
    reader.close()
    return reader


def absolute(base: str, link: str) -> str | None:
    """The link as an absolute http address without fragment; null for scripts and other schemes."""
    try:
        joined = urldefrag(urljoin(base, link.strip()))[0]
    except ValueError:
        return None
    return joined if joined.startswith(("http://", "https://")) else None


def absolute_links(base: str, link: str) -> Column:
    """``absolute`` of two columns, in Arrow batches."""

    def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
        return pd.Series([absolute(b or "", x or "") for b, x in zip(base, link, strict=True)], dtype=object)

    return F.pandas_udf(resolve, "string")(base, link)


def anchors(pages: DataFrame) -> DataFrame:
    """One row per anchor of each page: page_id, ord, href (absolute or null), text."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                ids, urls, pages_ = batch.slice(start, PAGES).columns
                out = [(i.as_py(), k, absolute(u.as_py() or "", href), text) for i, u, h in zip(ids, urls, pages_, strict=True) for k, (href, text) in enumerate(_read(h.as_py()).anchors)]
                columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["page_id", "ord", "href", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(parse, "page_id long, ord int, href string, text string")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, heading (first h1) and visible text without scripts, styles and page furniture, white space collapsed."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):  # so many pages' texts at a time, and one page's parts
                some, heads, texts = batch.slice(start, PAGES), [], []
                for page in some.column(1):
                    told = _read(page.as_py())
                    heads.append(" ".join("".join(told.heading).split()))
                    texts.append(" ".join("".join(told.parts).split()))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(heads, pa.string()), pa.array(texts, pa.string())], ["page_id", "heading", "text"])

    return pages.select("page_id", F.col("html")).mapInArrow(parse, "page_id long, heading string, text string")

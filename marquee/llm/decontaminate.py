"""Benchmark decontamination: Wu-Manber search for many word patterns at once.

Patterns are the windows of the benchmark's items. The scan looks at the block of two words at the end of its current
window: the shift table says how far the window may move on because no pattern has that block nearer to its end. Where
the shift is nought, the bucket of the patterns that end with the block is compared word by word with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, BLOCK = 10, 2
#: Words of patterns that one pass holds; a larger benchmark is searched in several passes over the documents.
MAX_PATTERN_WORDS = 4_000_000

_KEPT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) < window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class WuManber:
    """Shift table and buckets for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length = len(next(iter(patterns)))
        self.block = min(BLOCK, self.length)
        self.free = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[int]]] = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, self.length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.free), self.length - end)
            self.bucket.setdefault(pattern[-self.block :], {})[pattern] = owners

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Starts of occurrences and the items whose windows they are."""
        end, most, shift, block, free = self.length, len(words), self.shift.get, self.block, self.free
        while end <= most:
            key = tuple(words[end - block : end])
            step = shift(key, free)
            if step:
                end += step
                continue
            if (owners := self.bucket[key].get(tuple(words[end - self.length : end]))) is not None:
                yield end - self.length, owners
            end += 1


def _tables(items: list[tuple[str | None, list[bytes]]], window: int) -> tuple[list[WuManber], list[str]]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for k, (_, words) in enumerate(items):
        for w in windows_of(words, window):
            owners = by_length.setdefault(len(w), {}).setdefault(w, [])
            if not owners or owners[-1] != k:
                owners.append(k)
    return [WuManber(p) for p in by_length.values()], [i for i, _ in items]


def _passes(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in lists of at most ``limit`` pattern words (or one item), read one partition after another."""
    held, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = words_of(text)
        cost = WINDOW * len(words)
        if held and size + cost > limit:
            yield held
            held, size = [], 0
        if words and item is not None:
            held.append((item, words))
            size += cost
    yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_pattern_words: int = MAX_PATTERN_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits (array<start, end>), and
    the columns named in ``keep``, unless they have one of these names.

    A word is hit inside any occurrence of a window of ``window`` words of an item; an item of fewer words, but not
    none, is one window. Null texts have no words; items without words or id have no windows; repeated items count once
    per distinct item_id. Repeated documents each give a row; empty tables give no hits or no rows; other columns are
    ignored. What is broadcast is at most ``max_pattern_words`` pattern words (or one item): a larger benchmark is
    searched in several passes, whose hits are joined by row number, as the input is a plain scan or a stored table.
    """
    parts = list(_passes(benchmark, max_pattern_words))
    if not any(len(p) for p in parts):
        parts = [[]]
    own = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits")
    kept = [c for c in keep if c not in own and c != "text"]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in kept]
    )
    carried = [(n, t) for n, t in rows.dtypes if n.startswith("_keep_") or n == "_text" and "text" in keep]

    def found(items: list, carry: bool) -> DataFrame:
        head = [("row", "long"), ("doc_id", "long"), *(carried if carry else [])]
        shape = ", ".join(f"`{n}` {t}" for n, t in head) + ", n_words long, hits array<struct<start:long,end:long>>, items array<string>"
        return rows.mapInArrow(_search(items, window, [n for n, _ in head]), shape)

    whole = found(parts[0], True)
    if len(parts) > 1:
        rest = whole.select("row", "hits", "items")
        for items in parts[1:]:
            rest = rest.unionByName(found(items, False).select("row", "hits", "items"))
        merged = rest.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        merge = lambda runs, x: F.when(
            (F.size(runs) > 0) & (x["start"] <= F.element_at(runs, -1)["end"]),
            F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(F.element_at(runs, -1)["start"].alias("start"), F.greatest(F.element_at(runs, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(runs, F.array(x)))
        merged = merged.withColumn("hits", F.aggregate(F.array_sort("hits"), F.array().cast("array<struct<start:long,end:long>>"), merge))
        whole = whole.drop("hits", "items").join(merged, "row")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return whole.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "hits",
        *[F.col("_text" if c == "text" else f"_keep_{c}").alias(c) for c in [*kept, *(["text"] if "text" in keep else [])]],
    )


def _search(items: list[tuple[str | None, list[bytes]]], window: int, head: list[str]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = _tables(items, window)
        for batch in batches:
            n_words, hits, found = [], [], []
            for text in batch.column("_text"):
                words = words_of(text.as_py())
                runs: list[list[int]] = []
                owners: set[int] = set()
                spans = []
                for table in tables:
                    for start, who in table.find(words):
                        spans.append((start, start + table.length))
                        owners.update(who)
                for start, end in sorted(spans):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(end, runs[-1][1])
                    else:
                        runs.append([start, end])
                n_words.append(len(words))
                hits.append([{"start": s, "end": e} for s, e in runs])
                found.append(sorted({names[k] for k in owners}))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in head), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(found, pa.list_(pa.string()))],
                [*head, "n_words", "hits", "items"],
            )

    return search

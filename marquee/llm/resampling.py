"""Importance resampling of documents towards the distribution of a target set.

Hashed counts of word runs in documents and in the target give each bucket a gain; a document's weight is the sum of its
features' gains, read from one array. Noise by document turns the highest scores into a draw without replacement. Every
partition of eligible rows is a sorted run, cut at the borders of score ranges. The runs of a range meet in one
tournament tree, which reads their blocks in order and stops when the draw is complete.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import words_of
from .scratch import shuffle_partitions, stored

BUCKETS, RUN = 10_000, 3
#: Words that are counted at once, bytes of distinct words that a task holds, and lengths whose shifts are in one table.
AT_ONCE, HELD, SHORT = 200_000, 32 << 20, 64
#: Drawn rows that one tournament gets.
PER_RANGE = 250_000


class Checksums:
    """The crc32 of runs of words, put together from those of the words.

    crc32(a + b) is crc32(a) moved on by the length of b, exclusive-or crc32(b), and moving on is linear: it is looked
    up byte by byte. A run therefore costs a few array reads instead of one more pass over its letters.
    """

    def __init__(self):
        one = np.array([[zlib.crc32(b"\0", v << 8 * k ^ 0xFFFFFFFF) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for v in range(256)] for k in range(4)], np.uint32)
        self.moves = [one]  # by 1, 2, 4, ... bytes
        tables = [(np.arange(256, dtype=np.uint32) << np.uint32(8 * np.arange(4)[:, None])).astype(np.uint32)]
        for _ in range(SHORT):
            tables.append(self.look_up(one, tables[-1]))
        self.short = np.stack(tables)

    @staticmethod
    def look_up(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]

    def moved(self, crc: np.ndarray, by: int) -> np.ndarray:
        k = 0
        while by >> k:
            if k == len(self.moves):
                self.moves.append(self.look_up(self.moves[-1], self.moves[-1]))
            if by >> k & 1:
                crc = self.look_up(self.moves[k], crc)
            k += 1
        return crc

    def joined(self, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        flat, base = self.short.ravel(), np.minimum(size, SHORT) << 10
        out = flat[base + (left & 255)] ^ flat[base + 256 + (left >> 8 & 255)] ^ flat[base + 512 + (left >> 16 & 255)] ^ flat[base + 768 + (left >> 24)]
        for n in np.unique(size[size > SHORT]):
            at = np.flatnonzero(size == n)
            out[at] = self.moved(left[at], int(n))
        return out ^ right


class Words(dict):
    """Numbers of distinct words, with the checksum of the word, that of a space and the word, and the latter's length."""

    def __init__(self):
        self.crc, self.after, self.size, self.held = array("I"), array("I"), array("q"), 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.crc)
        self.crc.append(zlib.crc32(word))
        self.after.append(zlib.crc32(b" " + word))
        self.size.append(len(word) + 1)
        self.held += len(word) + 100
        return n


class Features:
    """Buckets of the runs of one to three words of many texts at once."""

    def __init__(self, buckets: int = BUCKETS):
        self.sums, self.words, self.buckets = Checksums(), Words(), buckets

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words of each text, and for runs of 1, 2 and 3 words the bucket at each place and whether the run is in one text."""
        if self.words.held > HELD:
            self.words = Words()
        counts = np.array([len(t) for t in texts], np.int64)
        ids = np.fromiter((n for t in texts for n in map(self.words.__getitem__, t)), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(texts)), counts)
        crc, after, size = (np.frombuffer(x, d)[ids] if len(ids) else np.zeros(0, d) for x, d in ((self.words.crc, np.uint32), (self.words.after, np.uint32), (self.words.size, np.int64)))
        out, at = [], crc
        for run in range(1, RUN + 1):
            if run > 1:
                at = self.sums.joined(at[:-1], after[run - 1 :], size[run - 1 :]) if len(at) else at
            out.append(((at % self.buckets).astype(np.int64), owner[: len(at)] == owner[len(owner) - len(at) :]))
        return counts, out


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Rows from the given one on, with their words, some 200,000 words at once or one text."""
    start, held, size = 0, [], 0
    for k, text in enumerate(batch.column(column)):
        held.append(words_of(text.as_py()))
        size += len(held[-1])
        if size >= AT_ONCE:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


def feature_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket: an array of a fixed size, summed by Spark from one of each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _parts(batch, "text"):
                for at, inside in features.of(texts)[1]:
                    total += np.bincount(at[inside], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.array([math.floor(1000 * math.log(x)) for x in (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words, n_features, weight and score of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gain))
        for batch in batches:
            words, weights = [], []
            for _, texts in _parts(batch, "text"):
                counts, runs = features.of(texts)
                by_place = np.zeros(int(counts.sum()) + 1, np.int64)
                for at, inside in runs:
                    by_place[1 : len(at) + 1] += np.where(inside, gain[at], 0)
                ends = np.cumsum(counts)
                total = np.cumsum(by_place)
                words.append(counts)
                weights.append(total[ends] - total[ends - counts])
            n, weight = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (words, weights))
            luck = np.array([noise(i.as_py(), seed) for i in batch.column("doc_id")], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *map(pa.array, (n, sum(np.maximum(n - k, 0) for k in range(RUN)), weight, weight + luck))],
                ["row", "doc_id", "n_words", "n_features", "weight", "score"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "row long, doc_id long, n_words long, n_features long, weight long, score long")


class Tournament:
    """A tree of matches over the heads of sorted sequences; sequences may join at any time and leave when they end."""

    def __init__(self):
        self.size, self.free = 1, [0]
        self.heads: list = [None, None]  # winners of the inner nodes, then the leaves: (key, leaf)
        self.rest: list[Iterator | None] = [None]

    def join(self, keys: Iterator) -> None:
        if not self.free:
            old = self.heads[self.size :]
            self.free = list(range(self.size, 2 * self.size))
            self.rest += [None] * self.size
            self.size *= 2
            self.heads = [None] * self.size + old + [None] * (self.size // 2)
            for node in range(self.size - 1, 0, -1):
                self._play(node)
        leaf = self.free.pop()
        self.rest[leaf] = keys
        self._advance(leaf)

    def _play(self, node: int) -> None:
        left, right = self.heads[2 * node], self.heads[2 * node + 1]
        self.heads[node] = right if left is None or right is not None and right[0] < left[0] else left

    def _advance(self, leaf: int) -> None:
        key = next(self.rest[leaf], None)
        node = self.size + leaf
        self.heads[node] = None if key is None else (key, leaf)
        if key is None:
            self.rest[leaf] = None
            self.free.append(leaf)
        while node > 1:
            node //= 2
            self._play(node)

    def best(self):
        return self.heads[1][0] if self.heads[1] else None

    def pop(self):
        key, leaf = self.heads[1]
        self._advance(leaf)
        return key


_LISTS = ("score", "doc_id", "row", "n_features", "weight")
_BLOCK = "range int, head_score long, head_none boolean, head_id long, head_row long, n long, " + ", ".join(f"{c} array<long>" for c in _LISTS)


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]


def _blocks(eligible: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Each partition's rows as a sorted run, in blocks that do not cross the borders of ranges."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(-cuts, -batch.column("score").to_numpy(), "left")
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            rows = []
            for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
                lists = {c: batch.column(c).slice(a, b - a).to_pylist() for c in _LISTS}
                rows.append({"range": int(at[a]), "head_score": lists["score"][0], "head_none": lists["doc_id"][0] is None, "head_id": lists["doc_id"][0], "head_row": lists["row"][0], "n": int(b - a)} | lists)
            kinds = [("range", pa.int32()), ("head_score", pa.int64()), ("head_none", pa.bool_()), ("head_id", pa.int64()), ("head_row", pa.int64()), ("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in _LISTS)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return eligible.sortWithinPartitions(*_order()).select(*_LISTS).mapInArrow(pack, _BLOCK)


def _entries(block: dict) -> Iterator[tuple]:
    for s, i, r, n, w in zip(*(block[c] for c in _LISTS), strict=True):
        yield (-s, i is None, i or 0, r), i, n, w, s


def _merge(plan: dict[int, tuple[int, int]]):
    """Rows of each range in order, with ranks from the range's first one on, as many as the plan says."""
    shape = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_features", "weight", "score", "rank", "row")])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.slice(k, 1).to_pylist()[0]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = blocks(batches)
        ahead, out = next(source, None), []
        while ahead is not None:
            here, tree = ahead["range"], Tournament()
            rank, left = plan[here]
            while True:
                while ahead is not None and ahead["range"] == here:
                    best = tree.best()
                    if best is not None and best[0] < (-ahead["head_score"], ahead["head_none"], ahead["head_id"] or 0, ahead["head_row"]):
                        break
                    if left:
                        tree.join(_entries(ahead))
                    ahead = next(source, None)
                if not left or tree.best() is None:
                    break
                key, doc, n, w, s = tree.pop()
                out.append((doc, n, w, s, rank, key[-1]))
                rank, left = rank + 1, left - 1
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=shape)
                    out = []
            while ahead is not None and ahead["range"] == here:
                ahead = next(source, None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=shape)

    return merge


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, per_range: int = PER_RANGE, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank (1, 2, 3 ... in the order of the draw, null if not drawn).

    Of the rows with ``least_words`` words, ``percent`` in a hundred are drawn, rounded down: the highest scores, ties to
    the smaller doc_id (null last), then to the earlier row. Null and empty texts have no features, weight 0, and are
    never drawn; a null id has the noise of the empty id. Repeated rows and ids are rows of their own. An empty target
    or table is counted as nought; other columns are ignored, whatever their names. The driver gets one count for each
    bucket, one for each range of scores, and the last row drawn.
    """
    spark = docs.sparkSession
    gain = gains(feature_counts(docs, text_col, buckets), feature_counts(target, target_col, buckets))
    rows = stored(scored(docs, gain, seed, id_col, text_col), "scored")
    eligible, columns = rows.where(F.col("n_words") >= least_words), ["doc_id", "n_features", "weight", "score"]
    draw = percent * eligible.count() // 100
    if not draw:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    ranges = max(math.ceil(draw / per_range), min(shuffle_partitions(spark), math.ceil(draw / 1000)))
    shares = [1 - percent / 100 * k / ranges for k in range(1, ranges + 1)]
    cuts = np.unique(eligible.agg(F.percentile_approx("score", shares, max(10_000, 50 * ranges))).first()[0])[::-1]
    runs = stored(_blocks(eligible, cuts), "sorted-runs")
    plan, rank = {}, 1
    for at, n in sorted(tuple(r) for r in runs.groupBy("range").agg(F.sum("n")).collect()):
        if rank <= draw:
            plan[at] = (rank, min(n, draw + 1 - rank))
            rank += n
    heads = ["range", F.desc("head_score"), "head_none", "head_id", "head_row"]
    drawn = runs.where(F.col("range") <= max(plan)).repartition(shuffle_partitions(spark), "range").sortWithinPartitions(*heads).mapInArrow(_merge(plan), "doc_id long, n_features long, weight long, score long, rank long, row long")
    drawn = stored(drawn, "drawn")
    last = drawn.where(F.col("rank") == draw).first()
    after_id = F.lit(False) if last.doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") > last.doc_id)
    tie = F.col("doc_id").eqNullSafe(F.lit(last.doc_id)) & (F.col("row") > last.row)
    later = (F.col("score") < last.score) | (F.col("score") == last.score) & (F.coalesce(after_id, F.lit(False)) | tie)
    rest = rows.where((F.col("n_words") < least_words) | later).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*columns, "rank").unionByName(rest)

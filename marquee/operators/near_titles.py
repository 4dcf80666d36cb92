"""Pairs of similar titles: all pairs of a key are compared, but few by more than one word of parities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from ..functions.blocks import coded, matched
from ..sources.tables import spread
from ..sources.versions import kept

#: Words of 64 slots that hold the parities of letters, of all of them, those before a place and those from there on; a key's titles meet in blocks of so many.
SIGNS, PLACE, BLOCK = 4, 24, 20_000
#: Pairs that are gathered before their other parities are compared, and letters of as many titles as are matched at once.
PAIRS, LETTERS = 8192, 400_000


def parities(tokens: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each row ``SIGNS`` words: the parities of how many of its tokens are held in each slot."""
    mixed = tokens * np.uint64(0x9E3779B97F4A7C15)
    slot = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    bit = np.where(held, np.uint64(1) << (slot & np.uint64(63)), np.uint64(0))
    word = slot >> np.uint64(6) & np.uint64(SIGNS - 1)
    return np.stack([np.bitwise_xor.reduce(np.where(word == k, bit, np.uint64(0)), axis=1) for k in range(SIGNS)], axis=1)


def signed(titles: list[str]) -> np.ndarray:
    """Parities of all letters, of the first ``PLACE`` and of the others; the second of two equal ones is another than the first."""
    letters, lengths = coded(titles)
    letters = letters.T

    def part(start: int, end: int) -> np.ndarray:
        own, turn = letters[:, start:end], np.zeros(letters[:, start:end].shape, np.uint64)
        for k in range(1, own.shape[1]):
            turn[:, k] = (own[:, :k] == own[:, k : k + 1]).sum(axis=1)
        return parities(own.astype(np.uint64) << np.uint64(32) | turn, np.arange(start, start + own.shape[1]) < lengths[:, None])

    width = letters.shape[1]
    return np.concatenate([part(0, width), part(0, PLACE), part(PLACE, max(width, PLACE))], axis=1)


def most_outside(length: int, others: np.ndarray, threshold: float) -> np.ndarray:
    """How many letters of two titles may stand outside matching blocks; below zero if their lengths rule a match out."""
    both = length + others
    most = np.floor(both * (1 - threshold) + 0.000001).astype(np.int64)
    most -= (most + both) % 2
    return np.where(2 * np.minimum(length, others) >= both * threshold - 0.000001, most, -1)


def alike(own: np.ndarray, own_lengths: np.ndarray, other: np.ndarray, other_lengths: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs that lengths and parities leave, some thousands at a time; each pair once if both sides are the ``same``."""
    count = len(other)
    whole = np.concatenate([np.bitwise_xor.reduce(other[:, :SIGNS], axis=1), np.zeros(-count % 8, np.uint64)])
    folded = np.bitwise_xor.reduce(own[:, :SIGNS], axis=1)
    limits = {n: most_outside(n, other_lengths, threshold) for n in np.unique(own_lengths).tolist()}
    least = {n: np.pad(np.clip(x, 0, 255).astype(np.uint8), (0, -count % 8)) for n, x in limits.items()}
    apart, bits, ok = np.empty_like(whole), np.empty(len(whole), np.uint8), np.empty(len(whole), bool)
    eight = np.arange(8)
    left, right, n = [], [], 0

    def second() -> tuple[np.ndarray, np.ndarray]:
        rows, at = np.repeat([r for r, _ in left], [len(x) for _, x in left]), np.concatenate(right)
        differ = np.bitwise_count(own[rows] ^ other[at]).reshape(-1, 3, SIGNS).sum(axis=2, dtype=np.int64)
        most, gap = np.empty(len(at), np.int64), np.abs(own_lengths[rows] - other_lengths[at])
        for length, limit in limits.items():
            mine = own_lengths[rows] == length
            most[mine] = limit[at[mine]]
        near = (differ[:, 0] <= most) & (differ[:, 1] <= most + gap) & (differ[:, 2] <= most)
        return rows[near], at[near]

    for k, length in enumerate(own_lengths.tolist()):
        s = (k + 1) // 8 * 8 if same else 0
        np.bitwise_xor(whole[s:], folded[k], out=apart[s:])
        np.bitwise_count(apart[s:], out=bits[s:])
        np.less_equal(bits[s:], least[length][s:], out=ok[s:])
        some = np.flatnonzero(ok[s:].view(np.uint64))  # eight at a time
        if len(some):
            at = (s + 8 * some[:, None] + eight).ravel()
            at = at[ok[at] & (at < count) & (at > (k if same else -1))]
            left.append((k, at))
            right.append(at)
            n += len(at)
        if n > PAIRS:
            yield second()
            left, right, n = [], [], 0
    if n:
        yield second()


def ratios(titles: list[str], others: list[str]) -> np.ndarray:
    """Twice the letters in matching blocks over the letters of both."""
    (a, n), (b, m) = coded(titles), coded(others)
    return 2.0 * matched(a, b, n, m) / (n + m)


def near_titles(titles: DataFrame, key: list[str], threshold: float = 0.88) -> DataFrame:
    """key, title, other, ratio: distinct titles of a key whose matching-block ratio reaches the threshold, title < other.

    Of two such titles a part of ``threshold`` stands in matching blocks. Each character outside them is one deletion or
    insertion, which changes the letters by one (counted with repetition). So their parities in a fixed number of slots
    differ in no more slots than that. Letters before a place differ by its deletions and insertions and by how far they
    shift the rest: twice the more frequent of the two at most; the letters from there on by no more than all of them.
    The titles of a key are dealt into blocks; each two blocks meet in a group of their own, where parities are compared,
    first those of all letters folded into one word, and matching blocks are looked for in the few pairs that are left. A
    group holds two blocks and some thousands of pairs; what leaves it is similar. Null titles are in no pair.
    """
    distinct = kept(titles.where("title is not null").select(*key, "title").distinct(), "near-titles")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("title").to_pylist()
            step = max(1, LETTERS // max(map(len, texts), default=1))
            for k in range(0, len(texts), step):
                some = batch.slice(k, step)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([r.tobytes() for r in signed(texts[k : k + step])], pa.binary())], [*some.schema.names, "signs"])

    blocks = distinct.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = spread(distinct, "title").mapInArrow(sign, StructType([*distinct.schema.fields, StructField("signs", BinaryType())]))
    dealt = dealt.join(blocks, key) if key else dealt.crossJoin(blocks)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("title"), F.col("blocks")).cast("int")).withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    places = [F.least("block", "meets").alias("low"), F.greatest("block", "meets").alias("high")]
    groups = spread(dealt.select(*key, *places, "block", "title", "signs"), *key, "low", "high")

    def meet(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        low, high, block = group[-2].as_py(), group[-1].as_py(), table.column("block").to_numpy()
        texts = table.column("title").to_pylist()
        signs = np.frombuffer(b"".join(table.column("signs").to_pylist()), np.uint64).reshape(len(texts), -1)
        lengths = np.array([len(t) for t in texts], np.int64)
        own, other = np.flatnonzero(block == low), np.flatnonzero(block == high)
        step = max(1, LETTERS // max(1, int(lengths.max())))
        for left, right in alike(signs[own], lengths[own], signs[other], lengths[other], threshold, low == high):
            for k in range(0, len(left), step):
                pairs = [sorted((texts[i], texts[j])) for i, j in zip(own[left[k : k + step]].tolist(), other[right[k : k + step]].tolist(), strict=True)]
                title, also = [p[0] for p in pairs], [p[1] for p in pairs]
                found = ratios(title, also)
                near = pa.array(found >= threshold)
                columns = [pa.array(title, pa.string()).filter(near), pa.array(also, pa.string()).filter(near), pa.array(found).filter(near)]
                yield pa.RecordBatch.from_arrays([*[pa.repeat(g, len(columns[0])) for g in group[:-2]], *columns], [*key, "title", "other", "ratio"])

    shape = StructType([*distinct.schema.fields, StructField("other", StringType()), StructField("ratio", DoubleType())])
    return kept(groups.groupBy(*key, "low", "high").applyInArrow(meet, shape), "near-pairs")

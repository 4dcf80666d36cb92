"""Keys that occur more than once, in arrays of a fixed size, and connected components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, shuffle_partitions, small_batches, stored

#: Most bits of a broadcast bitmap (128 MiB). Beyond some 10^8 keys more keys pass than need to; results stay the same.
MAX_BITS = 30
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def bits_for(keys: float) -> int:
    """Bits that leave a key alone in its slot with a chance of some nine in ten, as far as the fixed size allows."""
    return int(min(MAX_BITS, max(16, np.ceil(np.log2(10 * max(keys, 1))))))


def slots_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * _PRIME >> np.uint64(64 - bits)).astype(np.int64)


#: Slots are dealt out in so many ranges, however many there are, so that rows grow with the input alone.
RANGES = 512


def packed(slots: list[np.ndarray], bits: int, most: int | None = 2) -> pa.RecordBatch:
    """Rows (range, low) of a buffer of documents: the sorted slots of each range as differences of seven bits a byte.

    ``slots`` has the distinct slots of each document. A slot of several documents is given ``most`` times, or as often
    as it occurs where that is None.
    """
    slot, n = np.unique(np.concatenate(slots), return_counts=True) if slots else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    slot = np.repeat(slot, n if most is None else np.minimum(n, most))
    width = (1 << bits) // RANGES
    group = slot // width
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(slot) else np.zeros(0, np.int64)
    step = np.diff(slot, prepend=0)
    step[first] = slot[first] % width
    size = np.ones(len(step), np.int64)
    for k in range(1, 5):
        size += step >= 1 << 7 * k
    end = np.cumsum(size)
    code = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        has = size > k
        more = size[has] > k + 1
        code[(end - size)[has] + k] = (step[has] >> 7 * k & 127) | more.astype(np.int64) << 7
    offsets = pa.array(np.concatenate([(end - size)[first], [len(code)]]).astype(np.int32))
    low = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets.buffers()[1], pa.py_buffer(code.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(group[first].astype(np.int32)), low], ["range", "low"])


def unpacked(low: pa.Scalar) -> np.ndarray:
    """The sorted slots of one row, counted from the start of its range."""
    code = np.frombuffer(low.as_buffer(), np.uint8)
    last = np.flatnonzero(code < 128)
    start = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(code)) - np.repeat(start, last + 1 - start)
    return np.cumsum(np.add.reduceat((code & 127).astype(np.int64) << 7 * place, start))


PACKED = "range int, low binary"


def marked_slots(slots: DataFrame, bits: int, least: int = 2) -> Broadcast:
    """Broadcast bitmap of the slots (below 2^bits) that occur at least once, or twice, in rows as ``packed`` gives them."""
    width = (1 << bits) // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if group not in met:
                    met[group] = np.zeros((2, width), bool)
                once, twice = met[group]
                at = unpacked(low)
                twice[at[1:][at[1:] == at[:-1]]] = True
                twice[at[once[at]]] = True
                once[at] = True
        for group, marks in met.items():
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([np.packbits(marks[least - 1], bitorder="little").tobytes()])], ["range", "low"])

    ranges = slots.repartition(shuffle_partitions(slots.sparkSession), "range").mapInArrow(count, PACKED)
    out = np.zeros((1 << bits) // 8, np.uint8)
    with small_batches(slots.sparkSession):
        parts = ranges.toLocalIterator()  # at most 2^bits / 8 bytes in all
    for row in parts:
        out[row.range * width // 8 : (row.range + 1) * width // 8] = np.frombuffer(row.low, np.uint8)
    return slots.sparkSession.sparkContext.broadcast(out)


class Frequencies:
    """What is known of the number of documents of each key: whether its slot has several, and the logarithm's class.

    The class, 0 to 15, is that of the fullest of sixteen neighbouring slots, less what each slot has on average. Keys
    that share slots only seem more frequent than they are.
    """

    def __init__(self, bits: int):
        self.bits, self.repeated, self.classes = bits, np.zeros((1 << bits) // 8, np.uint8), np.zeros((1 << bits) // 32, np.uint8)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key: whether it may occur in several documents, and its class."""
        slot = slots_of(keys, self.bits)
        often = is_repeated(self.repeated, slot)
        return often, np.where(often, self.classes[slot >> 5] >> (slot >> 2 & 4).astype(np.uint8) & 15, 0)


def frequencies(slots: DataFrame, bits: int, total: int, limit: float) -> tuple[Broadcast, int]:
    """Broadcast ``Frequencies`` of rows as ``packed`` gives them, and the sum of squares of the counts from 2 to ``limit``."""
    width, mean = (1 << bits) // RANGES, total >> bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                np.add.at(met.setdefault(group, np.zeros(width, np.uint32)), unpacked(low), 1)
        for group, n in met.items():
            most = n.reshape(-1, 16).max(1).astype(np.int64) - mean
            kind = np.minimum(15, np.ceil(np.log2(np.maximum(most, 1)))).astype(np.uint8)
            squares = int((n[(n > 1) & (n < limit)].astype(np.int64) ** 2).sum())
            columns = [pa.array([group], pa.int32()), pa.array([np.packbits(n > 1, bitorder="little").tobytes()]), pa.array([(kind[::2] | kind[1::2] << 4).tobytes()]), pa.array([squares])]
            yield pa.RecordBatch.from_arrays(columns, ["range", "low", "kind", "squares"])

    ranges = slots.repartition(shuffle_partitions(slots.sparkSession), "range").mapInArrow(count, f"{PACKED}, kind binary, squares long")
    out, squares = Frequencies(bits), 0
    with small_batches(slots.sparkSession):
        parts = ranges.toLocalIterator()  # at most 2^bits / 8 + 2^bits / 32 bytes in all
    for row in parts:
        for whole, part in ((out.repeated, row.low), (out.classes, row.kind)):
            whole[row.range * len(part) : (row.range + 1) * len(part)] = np.frombuffer(part, np.uint8)
        squares += row.squares
    return slots.sparkSession.sparkContext.broadcast(out), squares


def is_repeated(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for links a, b; nodes without links are absent.

    Minima pass along links, and labels are replaced by their own labels, until nothing changes. Each round is a stored
    table, of which only the last is kept; only whether a label changed comes to the driver.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    label = last = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("near"))
        least = stored(label.join(near, label.node == near.a, "left").select("node", F.least("component", "near").alias("next"), "component"), "near-labels")
        jump = least.select(F.col("node").alias("via"), F.col("next").alias("far"))
        new = least.join(jump, F.col("next") == F.col("via"), "left").select("node", F.least("next", "far").alias("next"), F.col("component").alias("before"))
        new = stored(new, "jumped-labels")
        dropped(last)
        dropped(least)
        changed = new.where("next <> before").limit(1).count()
        label, last = new.select("node", F.col("next").alias("component")), new
        if not changed:
            dropped(both)
            return label

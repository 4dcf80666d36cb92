"""Removal of byte strings of ``WINDOW`` bytes that a document with a smaller id has too.

Only suffixes that start at an anchor are sorted: the least gram of a window is its anchor, and the windows of one anchor
are a stretch. Equal windows lie alike about equal anchors, so a suffix at its anchor with what stands before it stands
for all windows of its stretch, and suffixes of different grams need not meet.

1. Stretches whose gram stands in one document only are put aside, by a bitmap of a fixed size.
2. The others meet by the hash of the whole stretch. All but those of the smallest id are done: their windows go.
3. Grams of which different stretches are left, and the stretches themselves, are marked in two more bitmaps. Each task
   sorts the marked suffixes of its documents and front-codes them into one run for each range of gram names; each
   range's runs are merged by a loser tree, and the lengths that neighbours share tell which windows are equal.
4. Grams with very many different stretches, as at the borders of a common passage, give way to the windows' hashes, so
   that no task gathers the surroundings of a common passage.

A full bitmap lets more stretches through, and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .repeats import PACKED, bits_for, is_repeated, marked_slots, packed, slots_of
from .scratch import dropped, shuffle_partitions, steady, stored, swept
from .substring_dedup import NO_ID, first_in_buffer, numbered
from .suffix_runs import NAME, front_coded, merged
from .windows import gram_hashes, stretches

WINDOW, GRAM = 50, 24
#: A gram gives way if it has at least this share of all different stretches, or ``MOST`` of them, but never with fewer than ``COMMON``.
COMMON, SHARE, MOST = 200, 1 / 2000, 100_000
#: Bytes of text that one task holds at a time.
BUFFER = 6_000_000
#: Rows that a task hands over at a time.
ROWS = 50_000
#: Keys whose slots a task holds at a time.
KEYS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _buffers(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(row, id, bytes) of documents, some ``most`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        for row, number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            held.append((row, number, bytes_of(text.as_py())))
            size += len(held[-1][2])
            if size > most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _marked(keys: DataFrame) -> tuple[object, int]:
    """Broadcast bitmap of a column of 64-bit keys, and its bits."""
    bits = bits_for(keys.count())

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:  # many keys at a time, as each range is a row
            held.append(slots_of(batch.column(0).to_numpy().view(np.uint64), bits))
            size += len(held[-1])
            if size > KEYS:
                yield packed(held, bits, 1)
                held, size = [], 0
        if held:
            yield packed(held, bits, 1)

    return marked_slots(keys.mapInArrow(slots, PACKED), bits, least=1), bits


def _of(name: np.ndarray, number: np.ndarray) -> np.ndarray:
    """64-bit name of a stretch of a document."""
    return (name ^ number.view(np.uint64) * _MIX) * _MIX


def _runs(later: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """row, start, stop of the stretches ``later``, those that follow each other as one."""
    at = np.flatnonzero(later)
    if not len(at):
        return [row[:0], start[:0], stop[:0]]
    new = np.concatenate([[True], (row[at[1:]] != row[at[:-1]]) | (start[at[1:]] != stop[at[:-1]])])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
    return [row[at[new]], start[at[new]], stop[at[last]]]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, common: int = COMMON) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array<start, end> removed, in bytes).

    Texts are UTF-8 bytes; null is empty. A byte goes if a string of ``window`` bytes that covers it also starts in a
    row with a smaller id. Null ids count as larger than all others; rows of the same id, null or not, are not smaller
    than each other, so repeated rows keep their bytes. Shorter texts stay whole. An empty table gives an empty result;
    other columns are ignored. Stretches are compared as 64-bit hashes, and so is what stands before an anchor. Rows are
    numbered in their partitions; an input with a shuffle is stored first.
    """
    if not 0 < gram <= window <= 120:
        raise ValueError("a gram is no longer than a window, and a window at most 120 bytes")  # lengths in runs are single bytes
    spark, rows = docs.sparkSession, numbered(steady(docs), id_col, text_col)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    bits = bits_for(total.bytes * 2 / (window - gram + 2))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _buffers(batches, BUFFER):
            yield packed([np.unique(slots_of(stretches(data, window, gram, named=False).key, bits)) for _, _, data in held], bits)

    grams = marked_slots(rows.mapInArrow(slots, PACKED), bits)

    def passing(held: list[tuple[int, int, np.ndarray]], use) -> list[np.ndarray]:
        """name, key, id, row, start, stop, anchor of the stretches of a buffer that ``use`` lets through."""
        out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
        for row, number, data in held:
            found = stretches(data, window, gram)
            at = use(found, number)
            for column, x in zip(out, (found.name[at], found.key[at], np.full(len(at), number), np.full(len(at), row), found.begin[at], found.end[at], found.anchor[at]), strict=True):
                column.append(x)
        return [np.concatenate(x) for x in out]

    names = ["name", "key", "id", "row", "start", "stop"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches that are left of a buffer, and (without name, key and id) runs of those that are settled in it."""
        for held in _buffers(batches, BUFFER):
            name, key, number, row, start, stop, _ = passing(held, lambda found, _: np.flatnonzero(is_repeated(grams.value, slots_of(found.key, bits))))
            if not len(name):
                continue
            order, least = first_in_buffer(name, number)
            later = np.empty(len(name), bool)
            later[order] = ~least
            spans = _runs(later, row, start, stop)
            settled = pa.RecordBatch.from_arrays([*[pa.nulls(len(spans[0]), pa.int64())] * 3, *map(pa.array, spans)], names)
            for part in (pa.RecordBatch.from_arrays([*(pa.array(x[~later].view(np.int64)) for x in (name, key, number, row, start, stop))], names), settled):
                for k in range(0, part.num_rows, ROWS):
                    yield part.slice(k, ROWS)

    met = stored(rows.mapInArrow(meet, ", ".join(f"{n} long" for n in names)), "stretches")
    # (at most one row of each id and buffer for a stretch, however common it is)
    named = met.where("name is not null").withColumn("later", F.col("id") > F.min("id").over(W.partitionBy("name")))
    kept = lambda c: F.when(~F.col("later"), F.col(c)).alias(c)
    gone = lambda c: F.when(F.col("later"), F.col(c)).alias(c)
    settled = named.select("later", *map(kept, ("name", "key", "id")), *map(gone, ("row", "start", "stop"))).union(met.where("name is null").select(F.lit(True), "name", "key", "id", "row", "start", "stop"))
    settled = stored(settled, "settled-stretches")
    dropped(met)
    swept(spark)
    left = settled.where("not later")
    count = stored(left.groupBy("key").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n"), "open-grams")
    most = max(common, min(MOST, SHARE * (count.agg(F.sum("n").alias("n")).first().n or 0)))
    often = spark.sparkContext.broadcast(np.sort(count.where(F.col("n") >= most).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)))  # at most 2,000 rows, or a hundred thousandth of all stretches
    open_grams, gram_bits = _marked(count.select("key"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_of(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()).view(np.int64))], ["of"])

    open_stretches, name_bits = _marked(left.select("name", "id").mapInArrow(of, "of long"))
    ranges = 4 * shuffle_partitions(spark)
    width = (1 << 64) // ranges + 1
    shape = "part int, shared binary, tail binary, length binary, before binary, ids array<long>, rows array<long>, starts array<long>, stops array<long>, anchors array<long>, name long, id long, row long, start long, stop long"
    fields = [x.split()[0] for x in shape.split(", ")]

    def to_sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A front-coded run for each range of names; windows of common grams in rows of their own, by their hash."""

        def use(found, number: int) -> np.ndarray:
            at = np.flatnonzero(is_repeated(open_grams.value, slots_of(found.key, gram_bits)))
            return at[is_repeated(open_stretches.value, slots_of(_of(found.name[at], np.full(len(at), number)), name_bits))]

        for held in _buffers(batches, BUFFER):
            name, key, *rest = passing(held, use)
            if not len(name):
                continue
            order, least = first_in_buffer(name, rest[0])
            at = order[least]
            text = {row: data.tobytes() for row, _, data in held}
            way = np.isin(key[at], often.value)
            yield from _sorted_runs(key[at[~way]], [x[at[~way]] for x in rest], text, window, width, fields)
            yield from _bare_windows([x[at[way]] for x in rest], text, window, fields)

    swept(spark)
    sent = stored(rows.mapInArrow(to_sort, shape), "suffix-runs")
    spans = "row long, start long, stop long"

    def compare(runs: pa.Table) -> pa.Table:
        return pa.table([pa.array(x) for x in _equal_windows(runs, window, gram)], names=["row", "start", "stop"])

    compared = sent.where("part is not null").groupBy("part").applyInArrow(compare, spans)
    bare = sent.where("name is not null").withColumn("later", F.col("id") > F.min("id").over(W.partitionBy("name"))).where("later")
    parts = [settled.where("later"), sent.where("part is null and name is null"), bare]
    for part in parts:
        compared = compared.union(part.select("row", "start", "stop"))
    hits = stored(compared.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("hits")), "hits")
    for table in (settled, sent, count):
        dropped(table)
    swept(spark)
    touched, row_bits = _marked(hits.select("row"))

    def hit(row: pa.Array) -> np.ndarray:
        return is_repeated(touched.value, slots_of(row.to_numpy().view(np.uint64), row_bits))

    @F.arrow_udf("boolean")
    def may_be_hit(row: pa.Array) -> pa.Array:
        return pa.array(hit(row))

    remove, result = _remover(window), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(~hit(batch.column("row"))))
            none = pa.nulls(part.num_rows, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield from remove(iter([pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), none], ["id", "text", "hits"])]))

    # only texts that may lose bytes are sent
    done = rows.where(may_be_hit("row")).join(hits, "row", "left").select("id", "text", "hits").mapInArrow(remove, result).union(rows.mapInArrow(whole, result))
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def _batch(fields: list[str], n: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), **dict.fromkeys(("shared", "tail", "length", "before"), pa.binary()), **dict.fromkeys(("ids", "rows", "starts", "stops", "anchors"), pa.list_(pa.int64()))}
    return pa.RecordBatch.from_arrays([columns[f] if f in columns else pa.nulls(n, kinds.get(f, pa.int64())) for f in fields], fields)


def _sorted_runs(key: np.ndarray, rest: list[np.ndarray], text: dict[int, bytes], window: int, width: int, fields: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch for each range of names: its suffixes, sorted and front-coded, with what stands before their anchors, backwards."""
    number, row, start, stop, anchor = rest
    strings = [k.to_bytes(NAME, "big") + text[r][p : e + window - 1] for k, r, p, e in zip(key.tolist(), row.tolist(), anchor.tolist(), stop.tolist(), strict=True)]
    order = sorted(range(len(strings)), key=strings.__getitem__)
    part = [k // width for k in key[order].tolist()]
    edge = [k for k in range(len(part)) if not k or part[k] != part[k - 1]] + [len(part)]
    for a, b in zip(edge, edge[1:], strict=False):
        at = order[a:b]
        shared, tail = front_coded([strings[k] for k in at])
        length = np.array([len(strings[k]) for k in at], np.uint8)
        before = b"".join(text[r][s:p][::-1] for r, s, p in zip(row[at].tolist(), start[at].tolist(), anchor[at].tolist(), strict=True))
        blobs = {n: pa.array([x], pa.binary()) for n, x in (("shared", shared.tobytes()), ("tail", tail), ("length", length.tobytes()), ("before", before))}
        lists = {n: pa.array([x[at]], pa.list_(pa.int64())) for n, x in (("ids", number), ("rows", row), ("starts", start), ("stops", stop), ("anchors", anchor))}
        yield _batch(fields, 1, part=pa.array([part[a]], pa.int32()), **blobs, **lists)


def _bare_windows(rest: list[np.ndarray], text: dict[int, bytes], window: int, fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Windows of the stretches by their hashes; without them, runs of those that have a smaller id in the buffer."""
    if not len(rest[0]):
        return
    number, row, start, stop, _ = (x[np.lexsort((rest[2], rest[1]))] for x in rest)
    size = stop - start
    hashes = np.concatenate([gram_hashes(np.frombuffer(text[r], np.uint8, e + window - 1 - s, s), window)[0] for r, s, e in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)])
    of = np.repeat(np.arange(len(size)), size)
    at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    order, least = first_in_buffer(hashes, number[of])
    later = np.empty(len(of), bool)
    later[order] = ~least
    own = [pa.array(x[~later]) for x in (hashes.view(np.int64), number[of], row[of], at, at + 1)]
    yield _batch(fields, len(own[0]), **dict(zip(("name", "id", "row", "start", "stop"), own, strict=True)))
    spans = [pa.array(x) for x in _runs(later, row[of], at, at + 1)]
    yield _batch(fields, len(spans[0]), **dict(zip(("row", "start", "stop"), spans, strict=True)))


def _equal_windows(table: pa.Table, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (row, start, stop) that a stretch of a smaller id in one of the runs of suffixes has too."""
    blob = lambda c: [np.frombuffer(x.as_buffer(), np.uint8) for x in table[c]]
    column = lambda c: pa.compute.list_flatten(table[c].combine_chunks()).to_numpy()
    runs, share = merged([(x, t.tobytes(), n) for x, t, n in zip(blob("shared"), blob("tail"), blob("length"), strict=True)])
    # the merged order as places in the runs laid end to end
    at = np.argsort(np.argsort(runs, kind="stable"))
    number, row, start, stop, anchor = (column(c)[at] for c in ("ids", "rows", "starts", "stops", "anchors"))
    before, reach = np.concatenate(blob("before")), anchor - start
    ahead = column("anchors") - column("starts")
    first = (np.cumsum(ahead) - ahead)[at]
    left, found = np.zeros(len(at), np.uint64), np.zeros((len(at), window - gram + 1), bool)
    for i in range(window - gram + 1):  # windows that start i bytes before their anchors
        if i:
            has = reach >= i
            left[has] = (left[has] ^ before[first[has] + i - 1].astype(np.uint64) + np.uint64(1)) * _MIX
            left[has] ^= left[has] >> np.uint64(29)
        right = np.cumsum(share < NAME + window - i)
        k = np.flatnonzero((reach >= i) & (anchor - stop < i))
        if len(k) < 2:
            continue
        same = right[k[1:]] == right[k[:-1]]
        k = k[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if not len(k):
            continue
        k = k[np.lexsort((number[k], left[k], right[k]))]
        new = np.concatenate([[True], (right[k[1:]] != right[k[:-1]]) | (left[k[1:]] != left[k[:-1]])])
        found[k, i] = number[k] > number[k[new]][np.cumsum(new) - 1]
    edge = np.diff(np.pad(found[:, ::-1], ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (which, begin), end = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    base = anchor[which] - (window - gram)
    return row[which], base + begin, base + end


def _remover(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for text, found in zip(batch.column("text"), batch.column("hits"), strict=True):
                data, spans = bytes_of(text.as_py()), np.zeros((0, 2), np.int64)
                if found.is_valid:
                    start, stop = (found.values.field(k).to_numpy() for k in (0, 1))
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, stop + window - 1, -1)
                    mask = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    spans, data = turn.reshape(-1, 2), data[~mask]
                gone = int((spans[:, 1] - spans[:, 0]).sum())
                values = (len(data) + gone, gone, len(spans), hashlib.sha256(data.tobytes()).hexdigest(), [{"start": a, "end": b} for a, b in spans.tolist()])
                for column, x in zip(out, values, strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return remove

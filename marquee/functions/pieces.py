"""Substrings of texts that may be among many pieces, by a table of bits that stays small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits a piece, the most bits in all, and letters of a text that are looked at at once.
BITS, MOST_BITS, SLICE = 64, 1 << 26, 1 << 18
BUCKET = 4096 * 8  # bits of one of Spark's bitmaps
FACTOR, PROBES = 0x9E3779B97F4A7C15, (1, 2)


def runs(letters: np.ndarray, length: int) -> list[np.ndarray]:
    """Numbers of all runs of 1, 2, 4, ... letters, ``length`` at most."""
    out, factor = [letters.astype(np.uint64) + np.uint64(1)], FACTOR
    while 2 ** len(out) <= length:
        width = 2 ** (len(out) - 1)
        out.append(out[-1][:-width] * np.uint64(factor) + out[-1][width:])
        factor = factor * factor % 2**64
    return out


def numbers(by_width: list[np.ndarray], length: int, at: np.ndarray) -> np.ndarray:
    """Numbers of the runs of ``length`` letters at these places, made of shorter ones, the longest first."""
    out, done = np.zeros(len(at), np.uint64), 0
    for k in range(length.bit_length() - 1, -1, -1):
        if length >> k & 1:
            out = out * np.uint64(pow(FACTOR, 2**k, 2**64)) + by_width[k][at + done]
            done += 2**k
    return out


def slots(found: np.ndarray, mark: int, bits: int) -> np.ndarray:
    return ((found * np.uint64((0xBF58476D1CE4E5B9 + 2 * mark) % 2**64)) >> np.uint64(65 - bits.bit_length())).view(np.int64)


def marked(by_width: list[np.ndarray], length: int, at: np.ndarray, bits: int) -> list[np.ndarray]:
    found = numbers(by_width, length, at)
    return [slots(found, 8 * length + p, bits) for p in PROBES]


def letters_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gate(found: np.ndarray, k: int, probe: int, bits: int) -> np.ndarray:
    """Slots of runs of 2 ** k letters, with which pieces of as many or more start."""
    return slots(found, 512 + 8 * k + probe, bits)


def bit_table(pieces: DataFrame, bits: int) -> np.ndarray:
    """Bytes of ``bits`` bits: each piece sets two by its longest start of 1, 2, 4, ... letters and two by itself."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(1, np.int64)
        for batch in batches:
            out = [np.empty(0, np.int64)]
            for piece in batch.column(0).to_pylist():
                by_width = runs(letters_of(piece), len(piece))
                out += [*(gate(by_width[-1][:1], len(by_width) - 1, p, bits) for p in PROBES), *marked(by_width, len(piece), first, bits)]
            yield pa.RecordBatch.from_pydict({"slot": np.concatenate(out)})

    maps = pieces.select("piece").mapInArrow(places, "slot long").groupBy(F.expr(f"slot div {BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BUCKET).alias("bitmap"))
    table = np.zeros(bits // 8, np.uint8)
    for row in maps.collect():
        table[row.bucket * BUCKET // 8 : (row.bucket + 1) * BUCKET // 8] = np.frombuffer(row.bitmap, np.uint8)
    return table


def candidates(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """id, piece: distinct substrings of the texts (id, text) among which are all that are pieces; few others.

    ``pieces`` are neither null nor empty. A task holds 64 to 128 bytes for each of them, 64 MB at most: with more pieces
    than a million, more of what comes out is no piece.
    """
    number, lengths = pieces.count(), sorted(r[0] for r in pieces.select(F.length("piece")).distinct().collect())
    bits = min(MOST_BITS, max(BUCKET, 1 << (BITS * number).bit_length()))
    shared = texts.sparkSession.sparkContext.broadcast(bit_table(pieces, bits))

    def among(text: str, table: np.ndarray) -> set[str]:
        every, out = letters_of(text), set()
        for start in range(0, len(every), SLICE):
            part = every[start : start + SLICE + lengths[-1] - 1]
            by_width = runs(part, min(lengths[-1], len(part)))
            for k in sorted({n.bit_length() - 1 for n in lengths if n <= len(part)}):
                starts = np.flatnonzero(table[gate(by_width[k], k, PROBES[0], bits)])
                for probe in PROBES[1:]:
                    starts = starts[table[gate(by_width[k][starts], k, probe, bits)]]
                for length in (n for n in lengths if n >> k == 1):
                    at = starts[starts <= len(part) - length]
                    if not len(at):
                        continue
                    ok = np.logical_and.reduce([table[x] for x in marked(by_width, length, at, bits)])
                    out.update(text[i : i + length] for i in (at[ok] + start).tolist())
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value, bitorder="little").view(bool)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                some = batch.slice(start, 100)
                sets = [among(t.as_py() or "", table) for t in some.column(1)]
                ids = some.column(0).take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x for found in sets for x in found], pa.string())], ["id", "piece"])

    shape = texts.select("id").schema.add("piece", "string")
    return texts.select("id", "text").mapInArrow(search, shape)

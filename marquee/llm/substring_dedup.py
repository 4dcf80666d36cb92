"""Removal of word windows that a document with a smaller id has too.

Every window of ``WINDOW`` words has a key, the least hash of its shorter word grams, which long stretches of windows
share. First the keys of all documents are counted in a bitmap of a fixed size, which is broadcast. Only windows whose
key may occur twice go on, by their hash, to find the smallest id that has them; what was met within one buffer of
documents is settled there, so that a window in very many documents is one row per buffer. At last the windows found
are marked in their documents. A full bitmap lets more windows through, and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .repeats import PACKED, bits_for, is_repeated, marked_slots, packed, slots_of
from .windows import covered, keys_and_hashes

WINDOW, GRAM = 13, 5
#: Windows that one task holds at a time to settle them among themselves.
BUFFER = 1_000_000
NO_ID = (1 << 63) - 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id (the largest long where it is null) and text."""
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(F.monotonically_increasing_id().alias("row"), number.alias("id"), F.col(text_col).cast("string").alias("text"))


def first_in_buffer(key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, number), and whether each entry's number is the smallest of its key."""
    order = np.lexsort((number, key))
    key, number = key[order], number[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return order, number == number[new][np.cumsum(new) - 1]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by spaces).

    Words are what ASCII white space separates, unchanged. A word goes if a window of ``window`` words that covers it
    also starts in a row with a smaller id. Null texts have no words. Null ids count as larger than all others; rows of
    the same id, null or not, are not smaller than each other, so repeated rows keep their words. Texts of fewer words
    than a window stay whole. An empty table gives an empty result; other columns are ignored. Windows are compared as
    64-bit hashes. The input must be a plain scan or a stored table, since rows are numbered in their partitions.
    """
    spark, rows = docs.sparkSession, numbered(docs, id_col, text_col)
    units = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = bits_for(units / 6 * 2 / (window - gram + 2))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                yield packed([np.unique(slots_of(np.unique(keys_and_hashes(hashed(words_of(t.as_py())), window, gram)[0]), bits)) for t in batch.column(0).slice(start, 1000)], bits)

    bitmap = marked_slots(rows.select("text").mapInArrow(slots, PACKED), bits)

    def settle(held: list[tuple[np.ndarray, np.ndarray, int, int]]) -> pa.RecordBatch:
        hashes, place = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        of = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
        row, number = (np.array([x[k] for x in held], np.int64)[of] for k in (2, 3))
        order, least = first_in_buffer(hashes, number)
        found = np.empty(len(order), bool)
        found[order] = ~least
        key = np.where(found, row, hashes.view(np.int64))  # what is settled needs no other rows of its window
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.array(place.astype(np.int32)), pa.array(number), pa.array(found)], ["key", "row", "place", "id", "found"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row, number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                key, hashes = keys_and_hashes(hashed(words_of(text.as_py())), window, gram)
                place = np.flatnonzero(is_repeated(bitmap.value, slots_of(key, bits)))
                if len(place):
                    held.append((hashes[place], place, row, number))
                    size += len(place)
                if size > BUFFER:
                    yield settle(held)
                    held, size = [], 0
        if held:
            yield settle(held)

    met = rows.mapInArrow(candidates, "key long, row long, place int, id long, found boolean")
    least = F.min("id").over(W.partitionBy("key", "found"))
    hits = met.withColumn("least", least).where("found or id > least").groupBy("row").agg(F.collect_list("place").alias("places"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for text, found in zip(batch.column("text"), batch.column("places"), strict=True):
                words = words_of(text.as_py())
                gone = 0
                if found.is_valid:
                    mask = covered(found.values.to_numpy(), window, len(words))
                    gone = int(mask.sum())
                    kept = b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m])
                else:
                    kept = b" ".join(words)
                for column, x in zip(out, (len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    done = rows.join(hits, "row", "left").select("id", "text", "places").mapInArrow(remove, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")

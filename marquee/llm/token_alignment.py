"""Alignment of two tokenizers' tokens by byte ranges, with corpus-wide counts of linked id pairs.

Both tokenizers cut a text before a single space that stands between two other characters, so that each distinct chunk
between such cuts is tokenized and aligned once per task. Ends are running sums of token lengths, groups are the ranges
between ends that both have, and links are made by repeating each token of the first side once for every token of the
second that it overlaps.

A block is some hundred documents of one task: its distinct pairs with their counts, and for each document how often it
has each of them. Pairs are summed in two salted shuffles and come back to the blocks that hold them, whose tasks sum up
their documents. No task and no broadcast holds all pairs or chunks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

MARK = "▁"
#: Both tokenizers end a token before such a space, whatever stands around it.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Distinct chunks that a task holds (a long one counts for several), and letters of texts that are cut at once.
HELD, AT_ONCE = 300_000, 1_000_000
#: Documents, and entries of documents by pair, of one block. Salts of the first sum of pairs.
DOCUMENTS, ENTRIES, SALTS = 500, 1_000_000, 16
#: Pair ids: the first side's id times this, plus the second side's.
STEP = 1 << 31


def byte_letters() -> dict[str, int]:
    """The byte for each letter of a byte-level vocabulary: printable Latin-1 letters are themselves, others count up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and the bytes of each of their tokens."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_file(first), SentencePieceProcessor(model_file=second)
        self.first.encode_special_tokens = True
        letters, self.bytes = byte_letters(), ([], [])
        for k in range(self.first.get_vocab_size()):
            token = self.first.id_to_token(k) or ""
            self.bytes[0].append(bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode())
        for k in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(k)
            self.bytes[1].append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(k) else piece.replace(MARK, " ").encode())
        self.sizes = tuple(np.array(list(map(len, b)), np.int64) for b in self.bytes)

    def ids(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Of chunks that begin with a space, which the second tokenizer adds by itself."""
        return [e.ids for e in self.first.encode_batch(chunks, add_special_tokens=False)], self.second.encode([c[1:] for c in chunks], num_threads=1)


def align(sizes: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each token on either side, the ends of the groups, and the positions of linked tokens on either side."""
    ends_a, ends_b = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    first = np.searchsorted(ends_b, ends_a - sizes[0][a], "right")
    counts = np.searchsorted(ends_b, ends_a, "left") + 1 - first
    link_a = np.repeat(np.arange(len(a)), counts)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    return np.searchsorted(cuts, ends_a, "left"), np.searchsorted(cuts, ends_b, "left"), cuts, link_a, link_b


class Chunks(dict):
    """Numbers of distinct chunks; arrays by number hold token, group and link counts and the chunk's links."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.held = tokenizers, 0
        self.groups: list[str | None] = []
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(0, np.int64) for _ in range(4))
        self.pairs = np.zeros(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        ids = self.tokenizers.ids(chunks)
        good = [self._whole(c, x, y) for c, x, y in zip(chunks, *ids, strict=True)]
        kept = [[x for x, g in zip(side, good, strict=True) if g] for side in ids]
        n_a, n_b = (np.array(list(map(len, side)), np.int64) for side in kept)
        a, b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(kept, (n_a, n_b), strict=True))
        group_a, group_b, cuts, link_a, link_b = align(self.tokenizers.sizes, a, b)
        of_a = np.repeat(np.arange(len(n_a)), n_a)
        last = np.cumsum(n_a) - 1
        n_groups = np.diff(group_a[last] + 1, prepend=0)
        n_links = np.bincount(of_a[link_a], minlength=len(n_a))
        sides = []
        for side, group in ((a, group_a), (b, group_b)):
            names, ends = list(map(str, side.tolist())), np.searchsorted(group, np.arange(len(cuts)), "right").tolist()
            sides.append([",".join(names[x:y]) for x, y in zip([0, *ends], ends)])  # noqa: B905
        texts = ["|".join(x) for x in zip(*sides, strict=True)]
        at, counted = 0, np.zeros((4, len(chunks)), np.int64)
        where = np.flatnonzero(good)
        counted[:, where] = n_a, n_b, n_groups, n_links
        for chunk, whole, n in zip(chunks, good, counted[2].tolist(), strict=True):
            self[chunk] = len(self.groups)
            self.groups.append(";".join(texts[at : at + n]) if whole else None)
            at += n
            self.held += 1 + len(chunk) // 100
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.concatenate([x, y]) for x, y in zip((self.n_a, self.n_b, self.n_groups, self.n_links), counted, strict=True))
        self.pairs = np.concatenate([self.pairs, a[link_a] * STEP + b[link_b]])

    def _whole(self, chunk: str, a: list[int], b: list[int]) -> bool:
        raw, (first, second) = chunk.encode("utf-8", "surrogatepass"), self.tokenizers.bytes
        return b"".join([first[x] for x in a]) == raw and b"".join([second[x] for x in b]) == raw

    def of(self, texts: list[str]) -> list[np.ndarray | None]:
        """Numbers of each text's chunks in order, or None if a token's bytes are not the text's."""
        cut = [[" " + c for c in CUT.split(t)] if t else [] for t in texts]
        if fresh := {c for chunks in cut for c in chunks if c not in self}:
            self.learn(list(fresh))
        found = [list(map(self.__getitem__, chunks)) for chunks in cut]
        return [None if not k or any(self.groups[x] is None for x in set(k)) else np.array(k, np.int64) for k in found]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


class Block:
    """Documents of one task whose pairs are counted together."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, k: np.ndarray | None, chunks: Chunks, ends: np.ndarray) -> None:
        """A document by its chunks; ``ends`` are those of the chunks' links."""
        if k is None:
            self.docs.append((doc_id, 0, 0, 0, 0, ""))
            self.entries.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            return
        each, times = np.unique(k, return_counts=True)
        links = _ranges(ends[each] - chunks.n_links[each], chunks.n_links[each])
        pairs, place = np.unique(chunks.pairs[links], return_inverse=True)
        n = np.bincount(place, np.repeat(times, chunks.n_links[each]), len(pairs)).astype(np.int64)
        groups = ";".join(map(chunks.groups.__getitem__, k.tolist()))
        self.docs.append((doc_id, *(int(x[k].sum()) for x in (chunks.n_a, chunks.n_b, chunks.n_groups, chunks.n_links)), hashlib.sha256(groups.encode()).hexdigest()))
        self.entries.append((pairs, n))
        self.size += len(pairs)

    def full(self) -> bool:
        return len(self.docs) >= DOCUMENTS or self.size >= ENTRIES

    def row(self) -> dict:
        """Documents, for each document the numbers of its pairs and how often it has them, and the block's pairs with their counts."""
        every, at = np.unique(np.concatenate([p for p, _ in self.entries]), return_inverse=True)
        n = np.concatenate([n for _, n in self.entries])
        columns = [list(c) for c in zip(*self.docs, strict=True)]
        return dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), columns, strict=True)) | {
            "sizes": [len(p) for p, _ in self.entries], "at": at.astype(np.int32), "times": n.astype(np.int32), "a": (every // STEP).astype(np.int32), "b": (every % STEP).astype(np.int32), "n": np.bincount(at, n, len(every)).astype(np.int64),
        }


_LONGS = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
_BLOCK = [*((c, pa.list_(pa.int64())) for c in _LONGS), ("groups_sha256", pa.list_(pa.string())), *((c, pa.list_(pa.int32())) for c in ("sizes", "at", "times", "a", "b")), ("n", pa.list_(pa.int64()))]
_BLOCK_SQL = ", ".join(f"{c} array<{'long' if k.value_type == pa.int64() else 'int' if k.value_type == pa.int32() else 'string'}>" for c, k in _BLOCK)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of some rows at once, or of one long row."""
    ids, texts, held = [], [], 0
    for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
        ids.append(i.as_py())
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= AT_ONCE:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def blocks(docs: DataFrame, first: str, second: str, id_col: str, text_col: str) -> DataFrame:
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, block = Chunks(tokenizers := Tokenizers(first, second)), Block()
        out = lambda: pa.RecordBatch.from_pylist([block.row()], pa.schema(_BLOCK))
        for batch in batches:
            for ids, texts in _parts(batch):
                if chunks.held > HELD:
                    chunks = Chunks(tokenizers)
                found = chunks.of(texts)
                ends = np.cumsum(chunks.n_links)
                for i, k in zip(ids, found, strict=True):
                    block.add(i, k, chunks, ends)
                    if block.full():
                        yield out()
                        block = Block()
        if block.docs:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(tokenize, _BLOCK_SQL).withColumn("block", F.monotonically_increasing_id()), "alignment-blocks")


def pair_counts(found: DataFrame, salts: int = SALTS) -> DataFrame:
    """a, b, count and whether it is the highest of b, from the blocks' pairs: summed by pair and salt, then by pair."""
    salted = found.withColumn("salt", F.pmod("block", F.lit(salts))).groupBy("a", "b", "salt").agg(F.sum("n").alias("n"))
    counts = stored(salted.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of the second vocabulary
    return stored(counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def _answers(table: pa.Table, pairs: pa.Table) -> pa.Table:
    """Rows of one block's documents, from its row and the corpus-wide counts of its pairs by their number in the block."""
    row = {c: table.column(c).combine_chunks() for c in table.schema.names}
    values = lambda c: row[c].flatten().to_numpy(zero_copy_only=False)
    n = len(row["a"].flatten())
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = pairs.column("k").to_numpy()
    count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    places, times, ends = values("at"), values("times").astype(np.int64), np.cumsum(values("sizes"))
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[places] * times)])[ends], prepend=0)
    columns = {c: row[c].flatten() for c in (*_LONGS, "groups_sha256")} | {"n_best": pa.array(total(best)), "count_sum": pa.array(total(count))}
    return pa.table([columns[c.split()[0]] for c in RESULT.split(", ")], names=[c.split()[0] for c in RESULT.split(", ")])


def align_tokens(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The first tokenizer (a tokenizers file, byte level) gets a space and the text, the second (a sentencepiece model) the
    text, to which it adds the space; strings of special tokens are plain text. A text is aligned if either side's token
    bytes, joined, are the space and the text; otherwise, as for null and empty texts, it has no tokens, noughts and an
    empty groups_sha256. Repeated rows and ids are rows of their own whose links all count; an empty table gives an empty
    result; other columns are ignored. A task holds one block of documents, or one document, and a bounded table of chunks.
    """
    whole = blocks(docs, first, second, id_col, text_col)
    found = whole.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("k", "x")).select("block", "k", "x.a", "x.b", "x.n")
    known = found.drop("n").join(pair_counts(found), ["a", "b"]).select(F.col("block").alias("of_block"), "k", "count", "best")
    return whole.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_answers, RESULT)

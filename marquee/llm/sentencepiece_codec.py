"""SentencePiece encoding and decoding with tables of distinct chunks.

No piece of the vocabulary has a white-space marker behind another character, so no merge crosses from a word into the
marker of the next one. A text therefore falls into chunks (markers, then a word) that can be segmented one by one.
Each task keeps a table of the distinct chunks that it has met, segments each once, and joins the ids back by position.
The table is emptied when it holds ``max_chunks``, which bounds a task's memory and changes no result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Documented bound of a task's chunk table, and the longest chunk that is kept in it.
MAX_CHUNKS, MAX_KEPT = 200_000, 64


def load(model: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing or sp.encode(" a") == sp.encode("a"):
        raise ValueError("pieces of this model cross white-space markers, or it drops white space; chunks don't hold")
    return sp


class ChunkTable:
    """Ids, their decimal form and the decoded form of each distinct chunk."""

    def __init__(self, model: str, max_chunks: int = MAX_CHUNKS):
        self.sp, self.most, self.seen = load(model), max_chunks, {}
        self.mark = self.sp.piece_to_id(MARK)

    def add(self, chunks: list[str]) -> None:
        # the library puts one marker in front of what it is given; a lone marker is given as nothing and has its own id
        for chunk, ids in zip(chunks, self.sp.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1), strict=True):
            ids = ids or [self.mark]
            self.seen[chunk] = (len(ids), ",".join(map(str, ids)), " " + self.sp.decode(ids))

    def rows(self, text: str) -> list[tuple[int, str, str]]:
        if not text:
            return []
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        if len(self.seen) > self.most:
            self.seen.clear()
        if fresh := set(chunks).difference(self.seen):
            self.add(list(fresh))
        out = list(map(self.seen.__getitem__, chunks))
        for c in fresh:
            if len(c) > MAX_KEPT:
                del self.seen[c]
        return out


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_decode(docs: DataFrame, model: str, keep: bool = False, text_col: str = "text", max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; with ``keep`` also ids (array<int>) and decoded.

    Null and empty texts have no ids and decode to the empty text. White space other than U+0020 is part of its chunk.
    Repeated rows and ids each give a row of their own; an empty table gives an empty result; other columns are ignored.
    A text has at most one row in memory with its ids, so very long texts are bounded by one row's size.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model, max_chunks)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part, out = batch.slice(start, 500), {k: [] for k in ("n", "i", "d", "ids", "text")}
                for text in part.column(1):
                    rows = table.rows(text.as_py() or "")
                    ids, decoded = ",".join([r[1] for r in rows]), "".join([r[2] for r in rows])[1:]
                    out["n"].append(sum([r[0] for r in rows]))
                    out["i"].append(_digest(ids))
                    out["d"].append(_digest(decoded))
                    if keep:
                        out["ids"].append(np.fromstring(ids, np.int32, sep=","))
                        out["text"].append(decoded)
                columns = [part.column(0), pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()), pa.array(out["d"], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["text"], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, schema)

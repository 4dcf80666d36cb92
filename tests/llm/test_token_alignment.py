"""Alignment of tokens against brute force over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from marquee.llm import token_alignment as T
from marquee.llm.scratch import stored
from marquee.llm.token_alignment import align_tokens, byte_letters

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "a  b", "  a b  ", " \n x y", "x▁ y z", "▁", "<|endoftext|> a <s> b </s> <0x41>", "a b 　c", "日本語 テキスト　x 中", "😀 é é ñ", "a\tb c\n d", "it's 12 3a .. , x don't 'S",
    "​ a", "x ​ y", "a\x00 b", "a\x1c b \x85 c", "ﬁ ½ ①", "word " * 30_000, "x" * 5000, "ab " * 300, "Ünïcödé " * 9, "the the the", "<unk> <0x0A>", "a\r\n b",
]


def brute(rows):
    first, second, letters = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND), byte_letters()
    first.encode_special_tokens = True
    bytes_a = lambda k: bytes(letters[c] for c in first.id_to_token(k)) if k != 50256 else b"<|endoftext|>"
    bytes_b = lambda k: bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode()
    out, count = [], Counter()
    for i, text in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        raw = [[bytes_a(k) for k in a], [bytes_b(k) for k in b]]
        if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
            out.append((i, 0, 0, 0, [], ""))
            continue
        ends = [[], []]
        for side, r in zip(ends, raw, strict=True):
            for x in r:
                side.append((side[-1] if side else 0) + len(x))
        links, p, q = [], 0, 0
        while p < len(a):
            links.append((a[p], b[q]))
            at_a, at_b = ends[0][p], ends[1][q]
            p, q = p + (at_a <= at_b), q + (at_b <= at_a)
        cuts, groups, was = sorted(set(ends[0]) & set(ends[1])), [], 0
        at = [{e: k + 1 for k, e in enumerate(side)} for side in ends]
        last = (0, 0)
        for c in cuts:
            here = (at[0][c], at[1][c])
            groups.append(f"{','.join(map(str, a[last[0] : here[0]]))}|{','.join(map(str, b[last[1] : here[1]]))}")
            last, was = here, c
        assert was == ends[0][-1]
        count.update(links)
        out.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(i, a, b, g, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), h) for i, a, b, g, links, h in out]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = [*some, *ODD, *(" ".join(rng.choices(["the", "é", "zq", "12", "\n", "", "don't", "日本"], k=rng.randint(1, 40))) for _ in range(100))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, some[0]), (3, some[0]), (None, some[1])] + [(9000 + k, some[2]) for k in range(40)]
    rng.shuffle(rows)
    return rows


def same(found, expected):
    key = lambda r: tuple((x is None, x) for x in r)
    found = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in found.collect()]
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_align(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("own") for c in ("a", "b", "n", "block", "count", "best", "k", "x")})
    same(align_tokens(stored(docs, "alignment-rows"), FIRST, SECOND), brute(rows))


def test_odd_rows_alone(spark):
    for text in (None, "", "x▁ y z", " ", "a"):
        same(align_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), FIRST, SECOND), brute([(1, text)]))
    assert align_tokens(spark.createDataFrame([], "doc_id long, text string"), FIRST, SECOND).collect() == []


def test_small_bounds_of_a_task():
    """The table of chunks and the blocks change no chunk's ids: a text by its chunks is the text as a whole."""
    chunks = T.Chunks(T.Tokenizers(FIRST, SECOND))
    texts = [t for t in ODD if t]
    whole = chunks.tokenizers.ids([" " + t for t in texts])
    for text, a, b, k in zip(texts, *whole, chunks.of(texts), strict=True):
        if k is not None:
            sides = [[int(x) for g in ";".join(chunks.groups[n] for n in k).split(";") for x in g.split("|")[s].split(",")] for s in (0, 1)]
            assert sides == [a, b], text
        else:
            assert "▁" in text

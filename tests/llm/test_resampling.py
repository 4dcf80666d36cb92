"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marquee.llm.resampling import Features, Tournament, resample
from marquee.llm.scratch import stored


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected(rows, target, percent, least):
    s, t = (Counter(f for text in texts for f in features(text)) for texts in ([x for _, x in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000) / ((s[b] + 1.0) * (t.total() + 10000))))
    out = []
    for k, (i, text) in enumerate(rows):
        f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, k])
    able = sorted((r for r in out if len(words(rows[r[-1]][1])) >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[-1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeéZ", k=rng.randint(1, 5))) for _ in range(80)] + ["日本", "x" * 300]
    line = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=n))
    out = [(k, line(rng.randint(0, 60))) for k in range(300)]
    copy = line(40)
    out += [(1000 + k, copy) for k in range(60)] + [(2000, copy)] * 25 + [(None, copy)] * 25 + [(None, None), (3000, None), (3001, ""), (3002, "word " * 30_000)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("percent", "per_range"), [(5, 250_000), (40, 7), (100, 50), (0, 5)])
def test_resample(spark, rows, percent, per_range):
    target = ["".join(words(rows[k][1])[:1] or ["b"]) + " abc de abc" for k in range(20)] + [None]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({c: F.lit("own") for c in ("row", "score", "rank", "n", "range", "weight")}), "resampling-rows")
    found = resample(docs.repartitionByRange(5, F.col("text")) if percent == 100 else docs, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string"), percent=percent, per_range=per_range)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected(rows, target, percent, 20), key=key)


def test_resample_empty(spark):
    none, some = (spark.createDataFrame(r, "doc_id long, text string") for r in ([], [(1, "a b " * 20), (2, "b " * 20)]))
    assert resample(none, some).collect() == []
    assert {r.doc_id: r.rank for r in resample(some, none, percent=50).collect()}.keys() == {1, 2}


def test_tournament_of_joining_sequences():
    rng, tree, waiting, out = random.Random(1), Tournament(), [], []
    for _ in range(40):
        waiting.append(sorted((rng.randint(0, 99),) for _ in range(rng.randint(0, 9))))
    waiting.sort()
    everything = sorted(x for w in waiting for x in w)
    while waiting or tree.best():
        while waiting and (not waiting[0] or tree.best() is None or waiting[0][0] <= tree.best()[0]):
            tree.join(((x,) for x in waiting.pop(0)))
        if tree.best():
            out.append(tree.pop()[0])
    assert out == everything


def test_checksums_of_long_words():
    rng = random.Random(2)
    text = [bytes(rng.choices(range(256), k=n)) for n in (1, 63, 64, 65, 1000, 70_000, 2)]
    for n, (at, inside) in enumerate(Features().of([text, text[:1], []])[1], 1):
        assert at[inside].tolist() == [zlib.crc32(b" ".join(t[i : i + n])) % 10000 for t in (text, text[:1]) for i in range(len(t) - n + 1)]

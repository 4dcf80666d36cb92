"""Toxicity: subword embeddings averaged over a text into a linear softmax, trained jointly in numpy.

A text is its bag of character n-grams of words (over UTF-8, with word ends), each with the number of its occurrences,
hashed into ``BUCKETS`` rows of an embedding. Embedding and softmax are fitted together on a bounded sample of labelled
rows, so an unseen misspelling gets its vector from the n-grams that it shares with known words. Whole texts of the sample
stay on the executors; the driver gets counts by bucket, and of each text its telling n-grams.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

GRAMS, BUCKETS, DIM = (3, 4, 5, 6), 1 << 16, 4
#: Documented bounds of the training sample: rows of each class. Their texts are taken whole.
MAX_TOXIC, MAX_CLEAN = 1200, 1800
#: An n-gram is trained if its share of toxic texts is so many standard errors, and so many times, above the clean share.
TELLING_Z, TELLING_RATIO = 3.0, 4.0
#: Averages are over an n-gram count of ``PAD`` more, which holds very short texts back, and are multiplied by ``SCALE``.
PAD, SCALE, PASSAGES = 200, 200.0, 3
EPOCHS, RATE, DECAY = 150, 0.1, 1e-5
THRESHOLD = 0.7

_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the text's words, and how often each occurs; n-grams may begin or end with the space beside their word."""
    words = Counter((text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split())
    found, often = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if words:
        distinct = sorted(words)
        raw = np.frombuffer(b" " + b" ".join(distinct) + b" ", np.uint8)
        inner, key = raw != 0x20, raw.astype(np.uint64)
        times = np.array([words[w] for w in distinct] + [0], np.int64)[np.cumsum(~inner) - 1]  # of the word that begins here or is here
        ok = np.ones(len(raw), bool)  # no space strictly inside
        for n in range(2, GRAMS[-1] + 1):
            if len(raw) < n:
                break
            key = key[:-1] * np.uint64(0x100000001B3) + raw[n - 1 :]
            ok = ok[:-1] if n == 2 else ok[:-1] & inner[n - 2 : len(raw) - 1]
            if n >= GRAMS[0]:
                found.append((((key[ok] + np.uint64(n)) * _MIX) >> np.uint64(48)).astype(np.int64))
                often.append(times[: len(ok)][ok])
    return np.concatenate(found), np.concatenate(often)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets in order, and the occurrences in each."""
    buckets, often = grams(text)
    distinct, at = np.unique(buckets, return_inverse=True)
    return distinct, np.bincount(at, often, len(distinct)).astype(np.int64)


def passages(text: str | None, seed: int) -> list[str]:
    """Passages of a clean text, which are clean too."""
    words, rng, out = (text or "").split(), np.random.default_rng([7, seed % (1 << 64)]), []
    for _ in range(PASSAGES):
        size = int(rng.integers(3, 40))
        at = int(rng.integers(0, max(1, len(words) - size)))
        out.append(" ".join(words[at : at + size]))
    return out


def _telling(in_toxic: np.ndarray, in_clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Buckets that are in many more of the toxic texts; the others keep a vector of noughts, so that they add no noise."""
    share = (in_toxic + in_clean + 1) / (n_toxic + n_clean + 2)
    z = (in_toxic / n_toxic - in_clean / n_clean) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    return (z >= TELLING_Z) & ((in_toxic + 0.5) / n_toxic >= TELLING_RATIO * (in_clean + 0.5) / n_clean)


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], toxic: list[int], telling: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Train embedding and softmax; returns each bucket's part of the log-odds of an average, and the bias.

    A bag is its telling buckets, their occurrences, and the occurrences of all its n-grams.
    """
    y = np.asarray(toxic, np.int64)
    rng = np.random.default_rng(7)
    index = np.concatenate([b for b, _, _ in bags])
    value = np.concatenate([c * (SCALE / (PAD + total)) for _, c, total in bags])
    rows = np.concatenate([np.full(len(b), k) for k, (b, _, _) in enumerate(bags)])
    n = len(y)
    p = {"e": rng.normal(0, 0.01, (BUCKETS, DIM)), "w": rng.normal(0, 0.5, (DIM, 2)), "b": np.zeros(2)}
    p["e"][~telling] = 0
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))[:, None] / n
    for step in range(1, epochs + 1):
        mean = np.stack([np.bincount(rows, value * p["e"][index, j], n) for j in range(DIM)], 1)
        logits = mean @ p["w"] + p["b"]
        odds = np.exp(logits - logits.max(1, keepdims=True))
        err = (odds / odds.sum(1, keepdims=True) - np.eye(2)[y]) * weight
        back = err @ p["w"].T
        grad = {"w": mean.T @ err + DECAY * p["w"], "b": err.sum(0), "e": np.stack([np.bincount(index, value * back[rows, j], BUCKETS) for j in range(DIM)], 1) + DECAY * p["e"]}
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)
    return SCALE * (p["e"] @ (p["w"][:, 1] - p["w"][:, 0])), float(p["b"][1] - p["b"][0])


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """The bounded sample: labelled rows that aren't held out, of each class those with the smallest hash of their id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out("doc_id")).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").withColumn("order", F.xxhash64("doc_id"))
    bounded = known.where("toxic > 0").orderBy("order", "doc_id").limit(max_toxic).union(known.where("toxic <= 0").orderBy("order", "doc_id").limit(max_clean))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked = bounded.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    # of several texts of one id always the same one
    one = F.min(F.struct(F.xxhash64("text").alias("order"), "text", "toxic")).alias("one")
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.toxic")


def train(sample: DataFrame) -> tuple[np.ndarray, float]:
    """The model of a sample (doc_id, text, toxic), which is read twice: for the telling buckets, then for the bags.

    With fewer than two classes there is nothing to tell apart: the parts are nought and the bias gives a smoothed share.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros((2, BUCKETS), np.int64), [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n[y] += 1
                seen[y, bag(text.as_py())[0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n, pa.int64()), pa.array(seen.tolist(), pa.list_(pa.int64()))], ["toxic", "n", "seen"])

    n, seen = [0, 0], np.zeros((2, BUCKETS), np.int64)
    for r in sample.select("text", "toxic").coalesce(8).mapInArrow(count, "toxic int, n long, seen array<long>").where("n > 0").toLocalIterator():
        n[r.toxic] += r.n
        seen[r.toxic] += np.array(r.seen, np.int64)
    if not all(n):
        share = (n[1] + 1) / (sum(n) + 2)
        return np.zeros(BUCKETS), float(np.log(share / (1 - share))) if sum(n) else -2.0
    telling = _telling(seen[1], seen[0], n[1], n[0])

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                for k, t in enumerate([text] if y else [text, *passages(text, id_)]):
                    b, c = bag(t)
                    out.append((id_, k, y, b[telling[b]].tolist(), c[telling[b]].tolist(), int(c.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names) if out else pa.RecordBatch.from_pylist([], pa.schema(list(zip(names, types, strict=True))))

    names, types = ["doc_id", "k", "toxic", "b", "c", "total"], [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
    # bounded by MAX_TOXIC + MAX_CLEAN, and by the telling buckets
    bags = sorted(sample.select("doc_id", "text", "toxic").mapInArrow(shorten, "doc_id long, k int, toxic int, b array<int>, c array<long>, total long").collect(), key=lambda r: (r.k > 0, r.doc_id, r.k))
    return fit([(np.array(r.b, np.int64), np.array(r.c, np.int64), r.total) for r in bags], [r.toxic for r in bags], telling)


def held_out(column: str):
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the columns named in ``keep`` (these four names stay the operator's).

    Scores depend on the text alone. Null and empty texts, and texts without words, get the score of an empty bag.
    Repeated labels of an id count once, as toxic if any is; null labels don't count. Repeated rows each get a row;
    without labels all scores are one constant below the threshold. Whole texts are scored, however long.
    """
    parts, bias = train(stored(training_rows(docs, labels), "toxicity-sample"))
    model = docs.sparkSession.sparkContext.broadcast((parts.astype(np.float64), bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            out = []
            for text in batch.column("_text"):
                at, often = grams(text.as_py())
                out.append(bias + weights[at] @ often / (PAD + often.sum()))
            odds = pa.array(1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -500, 500))))
            held = range(batch.num_columns - ("text" not in keep))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in held), odds], [*(batch.schema.names[k] for k in held), "score"])

    head = docs.select(F.col("doc_id").cast("long").alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep if c != "text"], F.col("text").cast("string").alias("_text"))
    shape = ", ".join(f"`{n}` {t}" for n, t in head.dtypes if n != "_text" or "text" in keep) + ", score double"
    scored = head.mapInArrow(score, shape)
    kept = [F.col("_text" if c == "text" else f"_keep_{c}").alias(c) for c in keep if c not in ("doc_id", "held_out", "score", "predicted")]
    return scored.select(F.col("_id").alias("doc_id"), held_out("_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *kept)

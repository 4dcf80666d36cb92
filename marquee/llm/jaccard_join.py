"""Exact Jaccard self-join of word-shingle sets: size-aware, heavy and light.

Documents of the same set are one node. Shingles have one global order: rare ones first, by the logarithm of a count of
documents in an array of a fixed size, then by hash; shared slots of the array only make the order less good. A pair of
the wanted similarity with overlap ``o`` shares at least k shingles within the first ``size - o + k`` of either set. Light (small) sets therefore enumerate the
subsets of k = 2 shingles of that part and meet in them; heavy (large) sets put its single shingles (k = 1) into
inverted lists that are scanned, where the place of the last common shingle bounds the overlap. The boundary between
them is where enumerating subsets begins to cost more than scanning lists, by the measured mean length of a list. All
candidates are verified on the whole sets.

Lists in which nobody looks up, or all of one component, are left out, and what is left out does not come back. Each
list first links its members to one head. Then lists are dealt into small buckets, each time
into others, and each node's likeliest partner in its buckets is verified; so a large group of near copies that link with
some of each other only becomes one component without all its pairs. All pairs that are still across components are
scanned last, and only those pass whose places in the lists and whose parities leave room for the wanted overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .repeats import PACKED, Frequencies, bits_for, components, frequencies, is_repeated, marked_slots, packed, slots_of
from .scratch import dropped, steady, stored

SHINGLE = 5
#: Similarity as a ratio of whole numbers, 80 / 100.
NUM, DEN = 80, 100
#: Lists of shingles of more than this share of all documents do not count in the mean length; they come last in the order.
SHARE = 0.001
#: Shingles whose slots a task holds at a time.
BUFFER = 1_500_000
#: Longs of the parity that rides along with the lists of a bucket round, and with those whose pairs are all scanned.
SHORT_SIGNS, SIGNS = 2, 8
#: Least bits of a number of a slot of the parity.
SIGN_BITS = 9
#: Rounds that verify the likeliest crossing pair of each row before all that are left.
BEST_ROUNDS = 1
#: Rounds in which the members of each list meet those of the same bucket of it, and mean number of members of a bucket.
BUCKET_ROUNDS, BUCKET = 2, 8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; one of the whole text if it has fewer words, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * _A + h[k : k + n])
    return np.unique(out)


def least_overlap(size: int, num: int, den: int) -> tuple[int, int]:
    """Overlap that a set needs with any partner, and with partners that are no smaller."""
    return -(-num * size // den), -(-2 * num * size // (num + den))


def keys_of(tokens: np.ndarray, often: np.ndarray, boundary: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of an ordered set that may be in others: key, place (-1 for a subset), whether partners that are no smaller look it up.

    ``often`` tells which tokens may be in other sets.
    """
    s = len(tokens)
    any_overlap, larger_overlap = least_overlap(s, num, den)
    key, place, index = [], [], []
    if s <= boundary and any_overlap >= 2:
        part = tokens[: s - any_overlap + 2][often[: s - any_overlap + 2]]
        i, j = np.triu_indices(len(part), 1)
        key.append(mixed(np.minimum(part[i], part[j]) * _A + np.maximum(part[i], part[j])))
        place.append(np.full(len(i), -1))
        index.append(np.ones(len(i), bool))
    if any_overlap < 2 or s * den >= (boundary + 1) * num:
        at = np.flatnonzero(often[: s - any_overlap + 1])
        key.append(tokens[at])
        place.append(at)
        index.append(at < s - larger_overlap + 1)
    return np.concatenate(key), np.concatenate(place), np.concatenate(index)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def parity(tokens: np.ndarray) -> np.ndarray:
    """Parity of the set's number of tokens in each of some one to two slots per token (32,768 at most), one bit each.

    Two sets differ in at least as many tokens as their parities differ in slots. Slots are the highest bits of a hash,
    so that the exclusive-or of neighbouring slots gives the parity of half as many.
    """
    bits = min(15, max(SIGN_BITS, len(tokens).bit_length()))
    return np.packbits(np.bincount((mixed(tokens) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1)


def least_difference(x: bytes, y: bytes) -> int:
    a, b = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[::2] ^ a[1::2]
    return int((a ^ b).sum())


def _texts(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored node and text of the nodes in ``pairs``. A bitmap of their rows keeps most other texts out of the shuffle."""
    wanted = stored(nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node").select("node", "row"), "candidate-rows")
    bits = bits_for(wanted.count())

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed([slots_of(batch.column(0).to_numpy().view(np.uint64), bits)], bits)

    bitmap = marked_slots(wanted.select("row").mapInArrow(slots, PACKED), bits, least=1)

    @F.arrow_udf("boolean")
    def may_be_wanted(row: pa.Array) -> pa.Array:
        return pa.array(is_repeated(bitmap.value, slots_of(row.to_numpy().view(np.uint64), bits)))

    return stored(docs.select("row", "text").where(may_be_wanted("row")).join(wanted, "row").select("node", "text"), "candidate-texts")


def _not_too_different(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose parities leave room for the similarity, and the share of both sets that may be common by them.

    Of sets that link, at most the rest is not common.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("pa", "pb"))
            both = batch.column("sa").to_numpy() + batch.column("sb").to_numpy()
            differ = np.fromiter((least_difference(p, q) for p, q in zip(x, y, strict=True)), np.int64, len(x))
            pairs = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(1 - differ / both)], ["a", "b", "share"])
            yield pairs.filter(pa.array(differ <= both * (den - num) // (den + num)))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").cast("long").alias(f"s{x}"), F.col("parity").alias(f"p{x}"))
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long, share double"), "likely-pairs")


def _verified(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough, stored."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for a, ta, b, tb in zip(*(batch.column(k) for k in range(4)), strict=True):
                sets = []
                for row, text in ((a.as_py(), ta), (b.as_py(), tb)):
                    if row not in seen:
                        if len(seen) > 200:
                            seen.clear()
                        seen[row] = shingles(text.as_py())
                    sets.append(seen[row])
                x, y = sets
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "ta", "b", "tb")
    return stored(both.mapInArrow(check, "a long, b long"), "verified-links")


def _shingle_counts(rows: DataFrame, num: int, den: int) -> tuple[Broadcast, int]:
    """Broadcast ``Frequencies`` of all shingles, and the boundary between light and heavy sets."""
    total = rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    expected = total.bytes // 6  # words of five letters and a space
    bits = bits_for(expected)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(slots_of(shingles(text.as_py()), bits))
                size += len(held[-1])
                if size > BUFFER:
                    yield packed(held, bits, None)
                    held, size = [], 0
        yield packed(held, bits, None)

    counts, squares = frequencies(rows.select("text").mapInArrow(slots, PACKED), bits, expected, max(16, SHARE * total.docs))
    # a set with a prefix of p shingles has p (p + 1) / 2 subsets, or p lists of the mean length to be scanned
    return counts, int(2 * (1 + squares / max(1, expected)) * den / (den - num))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """(documents: row, id, node, size; membership: node, component) over rows of ``docs``. Equal sets are one node."""
    rows = _numbered(steady(docs), id_col, text_col)
    counts, boundary = _shingle_counts(rows, num, den)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each document, and the keys of each set that is new to this task."""
        known: Frequencies = counts.value
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part, own, out = batch.slice(start, 1000), [[], [], []], [[], [], [], [], []]
                for text in part.column(2):
                    tokens = shingles(text.as_py())
                    node = xxhash.xxh3_64_intdigest(tokens.tobytes())
                    for column, x in zip(own, (node, len(tokens), parity(tokens).tobytes()), strict=True):
                        column.append(x)
                    if not len(tokens) or node in seen:
                        continue
                    seen.add(node)
                    often, kind = known.look_up(tokens)
                    order = np.argsort(kind, kind="stable")  # they come sorted by hash
                    key, place, index = keys_of(tokens[order], often[order], boundary, num, den)
                    for column, x in zip(out, (key.view(np.int64), np.full(len(key), node, np.uint64).view(np.int64), np.full(len(key), len(tokens), np.int32), place.astype(np.int32), index), strict=True):
                        column.append(x)
                n, arrays = part.num_rows, [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.int32, np.int32, bool), strict=True)]
                node = np.array(own[0], np.uint64).view(np.int64)
                none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.bool_())]
                yield pa.RecordBatch.from_arrays([none[0], pa.array(node), pa.array(own[1], pa.int32()), none[1], none[2], part.column(0), part.column(1), pa.array(own[2], pa.binary())], names)
                m = len(arrays[0])
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names)

    names = ["key", "node", "size", "place", "index", "row", "id", "parity"]
    found = stored(rows.mapInArrow(shared, "key long, node long, size int, place int, index boolean, row long, id long, parity binary"), "inverted-lists")
    members, lists = found.where("row is not null"), found.where("row is null").select("key", "node", "size", "place", "index")
    nodes = stored(members.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("parity").alias("parity")), "nodes")

    # star round: each list links its members to one head, where a good part of the looked-up keys agree
    end = F.struct("node", "size")
    heads = lists.groupBy("key").agg(F.min(end).alias("lo"), F.max(end).alias("hi"), F.max("index").alias("looked_up"))
    wide = stored(lists.join(stored(heads.where("looked_up and lo.node < hi.node").drop("looked_up"), "list-heads"), "key"), "wide-lists")
    nodes = stored(nodes.join(wide.select("node").distinct(), "node", "left_semi"), "list-nodes")
    stars = _not_too_different(_likely_stars(wide, num, den), nodes, num, den)
    texts = _texts(stars, nodes, rows)
    links = _verified(stars, texts, num, den)
    dropped(texts)
    label = components(links)

    # (a pair whose rows also follow the same key is met there already)
    before = F.when(F.col("place") >= 0, F.lag("key").over(W.partitionBy("node").orderBy("place", "key"))).alias("before")
    once = wide.select("key", "node", "size", "place", "index").repartition("node").distinct()
    spread = _across(once.select("*", before), label)
    dropped(wide)
    # bucket rounds: each node's likeliest pair with a member of another component in a small part of a list
    for turn in range(BUCKET_ROUNDS):
        signs = [f"p{k}" for k in range(SHORT_SIGNS)]
        bucket = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / BUCKET))
        dealt = stored(spread.join(_signed(nodes, signs), "node").withColumn("bucket", bucket), "list-buckets")
        likely = _not_too_different(_crossing(dealt, ["key", "bucket"], signs, num, den), nodes, num, den)
        likely = stored(_best(likely), "bucket-pairs")
        dropped(dealt)
        if not likely.limit(1).count():
            continue
        texts = _texts(likely, nodes, rows)
        links = stored(links.union(_verified(likely, texts, num, den)), "links-so-far")
        dropped(texts)
        label = components(links)
        last, spread = spread, _across(spread, label)
        dropped(last)

    # last round: all pairs across components, in the lists that reach over several
    signs = [f"p{k}" for k in range(SIGNS)]
    signed = stored(spread.join(_signed(nodes, signs), "node"), "signed-lists")
    dropped(spread)
    pairs = _crossing(signed, ["key"], signs, num, den, once=True)
    pairs = _not_too_different(stored(pairs, "crossing-pairs"), nodes, num, den)
    dropped(signed)
    texts = _texts(pairs, nodes, rows)
    for turn in range(BEST_ROUNDS + 1):
        # a few rounds verify each node's likeliest pair only, which joins most groups; the last one verifies all that still cross
        now = pairs.select("a", "b")
        if turn < BEST_ROUNDS:
            now = stored(_best(pairs).select("a", "b"), "likeliest-pairs")
        new = _verified(now, texts, num, den)
        if new.limit(1).count():
            links = stored(links.union(new), "links-so-far")
            label = components(links)
        if turn < BEST_ROUNDS:
            names_of = [label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b")]
            open_pairs = pairs.join(now.withColumn("done", F.lit(True)), ["a", "b"], "left").where("done is null").drop("done")
            half = stored(open_pairs.join(names_of[0], "a", "left"), "half-labelled-pairs")
            pairs = stored(half.join(names_of[1], "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "share"), "pairs-left")
            dropped(half)
    dropped(texts)
    return members.select("row", "id", "node", "size"), label


def _across(lists: DataFrame, label: DataFrame) -> DataFrame:
    """Stored: the lists that reach over several components and are looked up, with each member's component and each list's number ``n`` of members."""
    labelled = stored(lists.drop("component", "n").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled-lists")
    ends = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.max("index").alias("looked_up"))
    spread = stored(labelled.join(stored(ends.where("looked_up and lo < hi").select("key", "n"), "wide-keys"), "key"), "open-lists")
    dropped(labelled)
    return spread


def _crossing(lists: DataFrame, by: list[str], signs: list[str], num: int, den: int, once: bool = False) -> DataFrame:
    """The pairs (a, b) across components that meet in ``by`` and may be similar enough; ``once`` if what shares a key always meets."""
    small = lists.where("index").select(*by, *[F.col(c).alias(f"s_{c}") for c in ("node", "size", "place", "component", "before", *signs)])
    overlap = F.ceil((F.col("size") + F.col("s_size")) * num / (num + den))
    room = F.least(F.col("size") - F.col("place"), F.col("s_size") - F.col("s_place")) + F.least("place", "s_place") >= overlap
    first = F.coalesce(F.col("before") != F.col("s_before"), F.lit(True)) if once else F.lit(True)
    parted = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"s_{c}"))) for c in signs)
    differ = parted <= F.floor((F.col("size") + F.col("s_size")) * (den - num) / (den + num))
    crossing = F.expr("component <> s_component and (s_size < size or (s_size = size and s_node < node))") & (F.col("s_size") * den >= F.col("size") * num)
    for c in by:
        crossing = (lists[c] == small[c]) & crossing
    return lists.join(small, crossing & first & ((F.col("place") < 0) | room) & differ).select(F.col("node").alias("a"), F.col("s_node").alias("b")).distinct()


def _best(pairs: DataFrame) -> DataFrame:
    """The likeliest of the pairs (a, b, share) of each node on either side."""
    best = [pairs.groupBy(x).agg(F.max(F.struct("share", "a", "b")).alias("best")).select("best.a", "best.b", "best.share") for x in ("a", "b")]
    return best[0].union(best[1]).distinct()


def _likely_stars(wide: DataFrame, num: int, den: int) -> DataFrame:
    """Stored pairs of each node with the head of a list with which it has most keys in common."""
    head = F.when(F.col("lo.node") != F.col("node"), F.col("lo")).otherwise(F.col("hi"))
    pairs = wide.select("key", "node", "size", head["node"].alias("head"), head["size"].alias("head_size")).distinct()
    shared = (
        pairs.where(F.least("size", "head_size") * den >= F.greatest("size", "head_size") * num).groupBy("head", "node", "size").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") * 4 >= F.least("size", F.ceil(F.col("size") * (1 - num / den))))
    )
    best = shared.groupBy(F.col("node").alias("b")).agg(F.max(F.struct("n", "head")).alias("best"))
    return stored(best.select(F.col("best.head").alias("a"), "b"), "star-pairs")


def _signed(nodes: DataFrame, signs: list[str]) -> DataFrame:
    """Nodes with their parities, folded to as many longs as ``signs``, a power of two."""
    slots = 64 * len(signs)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(signs)), np.int64)
            for k, whole in enumerate(batch.column(1)):
                bit = np.unpackbits(np.frombuffer(whole.as_buffer(), np.uint8)).reshape(slots, -1).sum(1) & 1
                out[k] = np.packbits(bit).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k]) for k in range(len(signs)))], ["node", *signs])

    return nodes.select("node", "parity").mapInArrow(fold, "node long, " + ", ".join(f"{c} long" for c in signs))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """row of the one document of each component that stays: the smallest id, null ids last, then the first row."""
    members, label = jaccard_links(docs, id_col, text_col, num, den)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    # texts without words have no set, and each of them is alone
    alone = members.where("size = 0").select("row")
    by_node = members.where("size > 0").groupBy("node").agg(least).join(label, "node", "left")
    return alone.union(by_node.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("best").alias("best")).select("best.row"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are lower-cased in A-Z; two rows link when ``den`` times the intersection of their sets of five-word shingles
    is at least ``num`` times the union. Null texts and texts without words have no set and link with nothing; a text of
    fewer than five words is one shingle. component_id is the smallest id reachable (null ids count last). Repeated rows
    link with each other. An empty table gives an empty result; other columns are ignored. Shingles are compared as
    64-bit hashes, and so are whole sets. Rows are numbered in their partitions; an input with a shuffle is stored first.
    """
    members, label = jaccard_links(docs, id_col, text_col, num, den)
    by_node = stored(members.where("size > 0").groupBy("node").agg(F.min("id").alias("least")).join(label, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "node-ids")
    least = stored(by_node.join(by_node.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id"), "component-ids")
    named = members.where("size > 0").join(least, "node").select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), "component_id")
    return named.union(members.where("size = 0").select("id", F.col("size").cast("long"), "id"))

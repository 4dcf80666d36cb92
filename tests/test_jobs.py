"""The daily job when batches fail or come twice, relocation by brute force, and processors on odd orders."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.functions.temporal import as_of
from marquee.operators.relocation import relocate
from marquee.operators.store import messaging_targets
from marquee.sources.tables import notices, targets
from marquee.sources.versions import TableSet, fresh
from marquee.streaming.daily import job

SF = "/root/testdata/sf0.001"
NAMES = ("notices", "coverage", "pending", "log")


def state(tables):
    return {n: sorted(map(str, tables.read(n).collect())) for n in NAMES}


def test_a_failed_and_a_repeated_batch_leave_the_same_state(spark, monkeypatch):
    n = notices(spark, SF).withColumns({"ord": F.col("id"), "rejected": F.col("id") % 10 == 0})
    parts = [n.where("id % 2 = 0"), n.where("id % 2 = 1").unionByName(n.where("id % 6 = 0").withColumn("deadline", F.lit("1999-01-01")))]
    plain, broken = (TableSet(spark, fresh(spark, "daily-test")) for _ in range(2))
    for k, part in enumerate(parts):
        job(plain, targets(spark, SF), as_of())(part, k)
    job(broken, targets(spark, SF), as_of())(parts[0], 0)
    before = state(broken)

    class Lost(Exception):
        pass

    real = TableSet.commit

    def dies(self, version, states):
        def fail(read):
            read("coverage").collect()  # two tables are written by now
            raise Lost

        return real(self, version, states | {"pending": fail})

    monkeypatch.setattr(TableSet, "commit", dies)
    with pytest.raises(Lost):
        job(broken, targets(spark, SF), as_of())(parts[1], 1)
    assert state(broken) == before and broken.versions() == [0]
    monkeypatch.setattr(TableSet, "commit", real)
    for _ in range(2):  # the next attempt, and one more after it was done
        job(broken, targets(spark, SF), as_of())(parts[1], 1)
        assert state(broken) == state(plain) and broken.versions() == [0, 1]
    assert {r.batch: (r.found, r.new, r.updated) for r in broken.read("log").collect()}[1][2] > 0


def test_table_set(spark):
    tables = TableSet(spark, fresh(spark, "table-set"))
    assert tables.read("a") is None
    assert tables.commit(0, {"a": lambda read: spark.range(3), "b": lambda read: read("a").where("id > 0")})
    assert not tables.commit(0, {"a": lambda read: spark.range(9)}) and tables.read("a").count() == 3 and tables.read("b").count() == 2
    assert tables.read("a", before=0) is None and tables.read("a", before=5).count() == 3


def test_relocation(spark):
    rng = random.Random(3)
    items = [(k, f"u{rng.randint(0, 20)}") for k in range(60)]
    pages = [(f"u{k}", rng.choice([None, None, "2026"]), rng.choice([None, 0.0, 1.0, 2.5])) for k in range(15)]
    candidates = [(k, p, f"u{rng.randint(0, 20)}", rng.random() < 0.8, float(rng.randint(-2, 3)), rng.choice([None, None, "s"])) for k in range(60) for p in range(rng.randint(0, 7))]
    known, expected = {u: (d, s) for u, d, s in pages}, set()
    for i, own in items:
        tried = set()
        for place, (_, _, url, usable, score, snippet) in enumerate(sorted((c for c in candidates if c[0] == i and c[4] >= 0), key=lambda c: (-c[4], c[1]))[:4], 1):
            if url in tried or url == own or not usable:
                tried.add(url)
                continue
            tried.add(url)
            deadline, page_score = known.get(url, (None, None))
            if deadline or page_score is not None and page_score >= score:
                expected.add((i, url, deadline, place))
                break
            if snippet:
                expected.add((i, url, snippet, place))
                break
    found = relocate(
        spark.createDataFrame(items, "id long, url string"), spark.createDataFrame(candidates, "id long, position int, url string, usable boolean, score double, snippet_deadline string"), spark.createDataFrame(pages, "url string, deadline string, page_score double")
    )
    assert {(r.id, r.url, r.deadline, r.wave) for r in found.collect()} == expected and len({w for *_, w in expected}) > 2


def test_messaging_targets(spark):
    rows = lambda *names: spark.createDataFrame([(n, "c") for n in names], "university string, college string")
    none = rows("x").limit(0)
    every = rows("a", "b", "d", "e", "f")
    left = lambda *a: sorted(r.university for r in messaging_targets(every, *a).collect())
    assert left(rows("a", "a"), rows("b"), rows("d", "e", "a"), rows("e")) == ["d"]
    assert left(none, none, none, none) == left(none, none, None, none) == ["a", "b", "d", "e", "f"]  # nobody waits: all are wanted

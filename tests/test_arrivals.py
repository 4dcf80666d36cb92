"""Substring joins against brute force, and saves of odd rows."""

import itertools

from pyspark.sql import functions as F

from marquee.operators.arrivals import save_notices, still_waiting
from marquee.operators.occurrences import occurrences

SHAPE = "id long, url string, title string, university string, college string, college_type string, event_type string, status string, source string, publish_date string, deadline string, event_time string, event_format string, summary string, updated_at timestamp"


def test_occurrences(spark):
    words = ["ab", "abc", "a", "summer camp notice", "camp notice", "notice", "zz", "", None]
    texts = [("k" if n % 2 else "m", n, a + b) for n, (a, b) in enumerate(itertools.product(["ab", "xsummer camp notice", "notic", ""], ["c", "e", "camp notice 2026"]))] + [("k", 99, None), ("k", 98, "")]
    needles = [(k, w) for k in "km" for w in words] * 2
    found = occurrences(spark.createDataFrame(needles, "g string, needle string"), spark.createDataFrame(texts, "g string, n long, text string"), "n", ["g"])
    expected = sorted((n, k, w) for k, n, t in texts for w in words if w and t and w in t)
    assert sorted(map(tuple, found.select("n", "g", "needle").collect())) == expected
    none = spark.createDataFrame([], "g string, needle string")
    assert occurrences(none, spark.createDataFrame(texts, "g string, n long, text string"), "n", ["g"]).isEmpty()


def test_save_of_odd_rows(spark):
    base = {"title": "T", "university": "U", "college": "C", "college_type": "law", "event_type": "camp", "status": "active", "source": "official"}
    row = lambda **k: tuple((base | k).get(c.split()[0]) for c in SHAPE.split(", "))
    stored = spark.createDataFrame([row(id=1, url="https://a/1", source="manual entry", deadline="2026-06-01 17:00:00", summary="long"), row(id=2, url="https://a/2", title=None), row(id=3, url="https://a/3", title="Another one of 2026 that is long enough", college="D")], SHAPE)
    more = SHAPE.replace("id long", "ord long") + ", original_url string"
    new = lambda **k: tuple((base | k).get(c.split()[0]) for c in more.split(", "))
    arrived = spark.createDataFrame([
        new(ord=10, url="https://a/1", source=None, deadline="2026-06-01 23:59:59", summary="x"), new(ord=11, url="https://a/1", title="second of one address"), new(ord=12, url="https://b/9", original_url="https://a/2", title="Now named", summary=""),
        new(ord=13, url="https://b/8", title="(again) Another one of 2026 that is", college="D"), new(ord=14, url="https://n1.example/x", title=None, university="", college=None), new(ord=15, url="https://zz/x", title="", university=None, college=""),
        new(ord=16, url=None, title="no address"),
    ], more)
    targets = spark.createDataFrame([(1, "U1", "C1", "foreign_lang", "n1.example"), (2, "U2", "C2", "law", "")], "ord long, university string, college string, college_type string, domain string")
    saved = save_notices(stored, arrived, targets, F.lit("2026-01-01").cast("timestamp"), F.col("url").isNotNull()).cache()
    found = {r.id: r for r in saved.collect()}
    assert {k: r.change for k, r in found.items()} == {1: "kept", 2: "updated", 3: "updated", 14: "inserted", 15: "inserted"}
    assert (found[1].deadline, found[1].summary, found[1].source, found[1].touched) == ("2026-06-01 17:00:00", "long", "manual entry", True)
    assert (found[2].url, found[2].title) == ("https://b/9", "Now named") and found[3].url == "https://b/8"
    assert tuple(found[14][c] for c in ("university", "college", "college_type")) == ("U1", "C1", "foreign_lang") and found[15].university == "未知"
    waiting = spark.createDataFrame([("U", "C", "law"), ("U1", "C1", "foreign_lang"), ("U2", "C2", "law")], "university string, college string, college_type string")
    assert [tuple(r) for r in still_waiting(waiting, saved).collect()] == [("U2", "C2", "law")]

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marquee.functions.html import absolute, anchors, page_texts
from marquee.functions.similarity import similarity
from marquee.functions.temporal import merged_datetime, next_check, normalise_datetime, parse_datetime
from marquee.operators.store import attribute, collapse_prefixes, upsert_matched, upsert_notices
from marquee.sources.versions import VersionedTable, fresh


def values(spark, texts, make):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(make(F.col("t"))).collect()]


def test_parse_datetime(spark):
    texts = ["2026-7-5", "2026-07-05 09:30", "2026-07-05 09:30:10", "2026-07-05 24:00:00", "late July", "", None]
    found = values(spark, texts, lambda c: F.date_format(parse_datetime(c), "yyyy-MM-dd HH:mm:ss"))
    assert found == ["2026-07-05 00:00:00", "2026-07-05 09:30:00", "2026-07-05 09:30:10", "2026-07-05 00:00:00", None, None, None]


def test_normalise_datetime(spark):
    texts = ["2026-7-5 noon 18:00", "7/5 3pm", "2026.7.5 24:00", "2026-13-5 8:05", "2026-07-05", "none"]
    found = values(spark, texts, lambda c: normalise_datetime(c, F.lit(2025), deadline=True))
    assert found == ["2026-07-05 12:00:00", "2025-07-05 15:00:00", "2026-07-05 23:59:59", "2026-13-05 08:05:00", "2026-07-05 23:59:59", None]


def test_merge_and_next_check(spark):
    assert values(spark, ["2026-01-01 00:00:00"], lambda c: merged_datetime(c, F.lit("2026-01-01 08:00:00"))) == ["2026-01-01 08:00:00"]
    assert values(spark, ["2026-01-01 08:00:00"], lambda c: merged_datetime(c, F.lit("2026-01-02"))) == ["2026-01-01 08:00:00"]
    at = lambda c: F.date_format(next_check(c.cast("timestamp")), "yyyy-MM-dd HH:mm")
    assert values(spark, ["2026-06-30 10:00:00", "2026-07-01 10:00:00", "2026-08-20 10:00:00", "2026-08-21 10:00:00"], at) == ["2026-07-01 00:00", "2026-07-02 10:00", "2026-08-21 10:00", "2027-07-01 00:00"]


def test_similarity(spark):
    assert [round(r[0], 3) for r in spark.createDataFrame([("abcd", "abxd"), (None, "")], "a string, b string").select(similarity("a", "b")).collect()] == [0.75, 1.0]


@pytest.mark.parametrize(("link", "expected"), [("../b#x", "http://h/b"), ("javascript:x()", None), ("mailto:a@b", None), ("//k/c", "http://k/c")])
def test_absolute(link, expected):
    assert absolute("http://h/a/i", link) == expected


def test_pages(spark):
    rows = [(1, "http://h/", "<h1>T &amp; U</h1><nav>menu</nav><a href='x'> one  <b>two</b></a><script>var a='<p>';</script>"), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [tuple(r) for r in anchors(pages).collect()] == [(1, 0, "http://h/x", "one two")]
    assert {r.page_id: (r.heading, r.text) for r in page_texts(pages).collect()} == {1: ("T & U", "T & U one two"), 2: ("", "")}


SHAPE = "ord long, id long, url string, title string, university string, college string, college_type string, status string, event_type string, publish_date string, deadline string, event_time string, event_format string, source string, summary string, updated_at timestamp"


def notice(ord_, url, title, **more):
    row = {"ord": ord_, "id": ord_, "url": url, "title": title, "university": "U", "college": "C", "college_type": "law", "status": "active", "event_type": "camp", "source": "official"}
    return tuple((row | more).get(c.split()[0]) for c in SHAPE.split(", "))


def test_upsert_is_idempotent(spark):
    stored = spark.createDataFrame([notice(1, "a", "old", summary="long text"), notice(2, "b", "same")], SHAPE).drop("ord")
    arrived = spark.createDataFrame([notice(8, "a", "new", summary="short", deadline="2026-01-01"), notice(9, "a", "ignored"), notice(10, "c", "fresh")], SHAPE)
    once = upsert_notices(stored, arrived, F.lit("2026-01-01").cast("timestamp"))
    found = {r.url: (r.id, r.title, r.deadline, r.summary, r.change) for r in once.collect()}
    assert found == {"a": (1, "new", "2026-01-01", "long text", "updated"), "b": (2, "same", None, None, "kept"), "c": (10, "fresh", None, None, "inserted")}
    again = upsert_notices(once.drop("change").select(*stored.columns), arrived, F.lit("2026-02-02").cast("timestamp"))
    assert {r.change for r in again.collect()} == {"kept"}


def test_prefix_fold_is_not_transitive(spark):
    rows = [(1, "U", "C", "abcdef"), (2, "U", "C", "xx abcdef yy"), (3, "U", "C", "yy"), (4, "U", "C", None), (5, "U", "D", "abcdef")]
    kept = collapse_prefixes(spark.createDataFrame(rows, "ord long, university string, college string, title string"))
    assert sorted(r.ord for r in kept.collect()) == [1, 3, 4, 5]


def test_attribution_prefers_first_of_equals(spark):
    texts = spark.createDataFrame([(1, "NATION_12 BUILDING notice"), (2, "nothing")], "id long, title string")
    targets = spark.createDataFrame([(5, "NATION_1", "BUILDING", "law"), (2, "NATION_12", "BUILDING", "law"), (1, "NATION_12", "MACHINERY", "foreign_lang")], "ord long, university string, college string, college_type string")
    assert [tuple(r) for r in attribute(texts, targets, "title", "id").collect()] == [(1, "NATION_12", "BUILDING", 17)]


def test_versions(spark):
    table = VersionedTable(spark, fresh(spark, "t"))
    assert table.read() is None
    assert table.write(spark.range(3)) == 1 and table.write(table.read().where("id > 0")) == 2
    assert table.read().count() == 2 and table.read(1).count() == 3


def test_rest_without_llm():
    import subprocess
    import sys

    code = "import sys; import marquee.plans.registry; assert not [m for m in sys.modules if m.startswith('marquee.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True)
    blocked = "import sys; sys.modules['marquee.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 150 and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", blocked], check=True, cwd=Path(__file__).parent.parent)


def test_similar_titles_against_brute_force(spark):
    """All pairs of distinct titles of a college, not only neighbours."""
    from difflib import SequenceMatcher

    from marquee.functions.similarity import similarity

    texts = ["a notice of the school", "a notice of the schools", "the notice of a school", "x", "a list", "a lists"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "a string, b string")
    found = {(r.a, r.b): round(r.ratio, 6) for r in pairs.select("a", "b", similarity("a", "b").alias("ratio")).collect()}
    assert found == {(a, b): round(SequenceMatcher(None, a, b).ratio(), 6) for a in texts for b in texts if a < b}
    for (a, b), ratio in found.items():
        assert ratio <= 2 * min(len(a), len(b)) / (len(a) + len(b)) + 1e-6


def test_domain_rules(spark):
    from marquee.functions import classify as C
    from marquee.functions.domain import DOMAIN, SOURCES

    rows = [
        ("某大学法学院2026年优秀大学生夏令营招生通知", "camp", "active", "用户补全"), ("某大学预推免拟录取名单", "camp", "active", "微信公众号（x）"), ("某大学夏令营优秀营员", "camp", "active", ""), ("高中生夏令营圆满落幕", "camp", "active", "eeban/1"), ("附件：申请表", "预推免", "active", "全网检索")
    ]
    t = spark.createDataFrame(rows, "title string, event_type string, status string, source string").withColumn("n", F.monotonically_increasing_id()).orderBy("n")
    assert [r[0] for r in t.select(C.slot(DOMAIN)).collect()] == ["camp_notice", "pre_result", "camp_result", "camp_notice", "pre_notice"]
    assert [r[0] for r in t.select(C.canonical_source(SOURCES)).collect()] == ["用户补全", "微信公众号", "学院官网", "forum", "全网检索"]
    reasons = [r[0] for r in t.select(C.noise_reason(F.col("title"), F.lit(None), F.lit("https://x"), DOMAIN)).collect()]
    assert reasons == [None, "exclude:拟录取名单", None, "blacklist:高中生", "attachment_form"]


def test_three_way_merge_with_url_conflict(spark):
    """A moved row takes the new url from another row, which goes; unknown arrivals are inserted once."""
    shape = "id long, url string, university string, college string, title string, deadline string, summary string, updated_at timestamp"
    stored = spark.createDataFrame([(1, "a", "u", "c", "long title of the first notice", None, "xx", None), (2, "b", "u", "c", "another notice", "2026", None, None), (3, "z", "u", "d", "", None, None, None)], shape)
    arrived = spark.createDataFrame(
        [(10, "b", "a", "u", "c", "first title", "2027", "x"), (11, "n", None, "u", "d", "a title without a match", None, None), (12, "n", None, "u", "d", "a title without a match", None, None), (13, "m", None, "u", "c", "long title of the first notice, revised", None, None)],
        "ord long, url string, original_url string, university string, college string, title string, deadline string, summary string",
    )
    found = {r.id: (r.url, r.title, r.deadline, r.summary, r.change) for r in upsert_matched(stored, arrived, F.lit("2026-01-01").cast("timestamp")).collect()}
    # the arrival 10 is row 2 by its url, which counts before its original url
    assert found == {1: ("m", "long title of the first notice, revised", None, "xx", "updated"), 2: ("b", "first title", "2027", "x", "updated"), 3: ("z", "", None, None, "kept"), 11: ("n", "a title without a match", None, None, "inserted")}
    moved = spark.createDataFrame([(10, "b2", "a", "u", "c", "t", None, None)], arrived.schema)
    taken = stored.union(spark.createDataFrame([(4, "b2", "u", "x", "owner of the url", None, None, None)], shape).where("id = 4"))
    # by its url it would be row 4: a url that is there always counts first
    assert {r.id: r.change for r in upsert_matched(taken, moved, F.lit("2026-01-01").cast("timestamp")).collect()} == {1: "kept", 2: "kept", 3: "kept", 4: "updated"}

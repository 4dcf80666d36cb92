"""Small cases of what failed on larger tables only."""

import glob

import duckdb
import pyarrow as pa

from marquee.functions import html
from marquee.operators.occurrences import occurrences
from marquee.plans import registry
from marquee.sources.files import write_files
from marquee.sources.versions import fresh, shared_dir
from marquee.streaming import jobs


def oracle_rows(folder, name, tables):
    base = duckdb.connect()
    for t in tables:
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(base.sql(registry.SQL[name]).fetchall(), key=repr)


def test_yes_and_no_end_at_letters_beyond_ascii(spark):
    texts = ["den in\u00f6auen", "in\u00df", "\u0131n", "in\u017f", "of\u00e9 in_", "x\u00e4of", "inn off", None, "\ufb01 of", "IN"]
    root = fresh(spark, "odd-conversations")
    spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    found = sorted(map(tuple, registry.QUERIES["str_11_yes_no"](spark, root).collect()), key=repr)
    assert found == oracle_rows(root.removeprefix("file:"), "str_11_yes_no", ["conversations"]) and {v for *_, v in found} == {True, False, None}


def test_pieces_of_one_row_are_asked_in_their_order(spark):
    rows = [(0, "worthless stupid notice of a day"), (1, "other text"), (4, "both stupid and worthless"), (5, "worthless, then stupid"), (7, "the last")]
    root = fresh(spark, "odd-documents")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    found = registry.QUERIES["st_08_learned_pieces"](spark, root).select("id", "part", "rejected", "piece")
    assert sorted(map(tuple, found.collect()), key=repr) == oracle_rows(root.removeprefix("file:"), "st_08_learned_pieces", ["documents"])


def test_all_pieces_stay_in_force(spark, monkeypatch):
    """Pieces beyond a number that was in force once (``NEWEST``), found in texts that are read a slice at a time too."""
    monkeypatch.setattr(jobs, "NEWEST", 5, raising=False)
    try:
        from marquee.functions import pieces
    except ImportError:
        pieces = None
    heads = [f"{k * 7919 % 1009:03d} heading of its own no. {k}" for k in range(60)]
    rows = [(k, heads[k] if k < 45 else "y" * (k * 13) + heads[(k * 29) % 60] + " \u00e9\u65e5\U0001f600 " + heads[(k * 31) % 60][:20]) for k in range(180)] + [(180, None), (181, ""), (182, "short"), (183, "x" * 300)]
    root = fresh(spark, "many-pieces")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    expected = oracle_rows(root.removeprefix("file:"), "st_08_learned_pieces", ["documents"])
    for width in (1 << 18, 50):
        if pieces:
            monkeypatch.setattr(pieces, "SLICE", width)
        found = registry.QUERIES["st_08_learned_pieces"](spark, root).select("id", "part", "rejected", "piece")
        assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert len({r[3] for r in expected}) > 5


class Held:
    """A table of one batch, which hands it to a function of batches and keeps what comes back."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *columns):
        return self

    def mapInArrow(self, function, shape):
        return list(function(iter([self.batch])))


def test_pages_of_a_batch_are_read_a_few_at_a_time(spark):
    n = 2 * html.PAGES + 5
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["https://x/"] * n, "html": ["<h1>a</h1> <p>b</p><a href=c>d</a>"] * n})
    texts = html.page_texts(Held(pages.select(["page_id", "html"])))
    assert [b.num_rows for b in texts] == [html.PAGES, html.PAGES, 5] and sum((b.column(2).to_pylist() for b in texts), []) == ["a bd"] * n
    assert [b.num_rows for b in html.anchors(Held(pages))] == [html.PAGES, html.PAGES, 5]


def test_files_of_a_batch_are_written_one_by_one(tmp_path):
    files = pa.RecordBatch.from_pydict({"name": ["a", "b"], "content": [b"12", b"3"]})
    done = write_files(Held(files), f"file://{tmp_path}/out")
    assert done[0].to_pydict() == {"name": ["a", "b"], "bytes": [2, 1]} and (tmp_path / "out" / "a").read_bytes() == b"12"


def test_runs_arrive_in_as_many_files_as_there_are_tasks(spark):
    rows = spark.range(4_000).selectExpr("id", "concat('a title of kind ', id % 7, ' and its number ', id) AS title").repartition(4)
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/arriving-notices-*"))
    assert jobs.learned_rules(spark, rows).count() == 4_000
    new = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/arriving-notices-*")) - before
    assert len(glob.glob(f"{new.pop()}/*.parquet")) > 4  # one task no longer writes a whole part


def test_few_needles_are_looked_for_in_place(spark):
    texts = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(["abcdefghijkl", "xabcx", "", None, "bcdefghij ab", "the ab"])], "id long, k long, text string")
    needles = spark.createDataFrame([(0, "abc"), (0, "bcdefghij"), (1, "ab"), (1, ""), (0, None), (0, "abc")], "k long, needle string")
    for key in ([], ["k"]):
        plain, dealt = (occurrences(needles, texts, "id", key, few=n) for n in (64, 0))
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect())) != []
        assert "Generate" not in plain._jdf.queryExecution().executedPlan().toString()


def test_equal_notices_are_read_once(spark):
    """Orders of few days are notices of few texts; times are read out of each text once."""
    root = fresh(spark, "repeated-orders")
    spark.range(600).selectExpr("id AS o_orderkey", "CASE WHEN id < 590 THEN date'1996-02-27' + cast(id div 4 % 3 AS int) END AS o_orderdate").write.parquet(f"{root}/orders.parquet")
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/told-texts-*"))
    found = registry.QUERIES["date_11_item_times"](spark, root).where("id < 590").collect()
    assert sorted(map(tuple, found), key=repr) == [r for r in oracle_rows(root.removeprefix("file:"), "date_11_item_times", ["orders"]) if r[0] < 590]
    new = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/told-texts-*")) - before
    # three days in three ways and one that tells no time but its day of publication; the text of unknown days is empty
    assert spark.read.parquet(new.pop()).count() == 3 * 4 + 1

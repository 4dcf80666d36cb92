"""Attachments, side files and feeds that are damaged, missing or odd."""

from pyspark.sql import functions as F

from marquee.plans.files import docx, xlsx, zipped
from marquee.sources import files
from marquee.sources.files import attachment_text, attachments, docx_text, feed_files, side_files, suffix_of, write_files, xlsx_text
from marquee.sources.versions import fresh


def test_documents():
    data = docx([" a\nb ", "", "\t", "c & <d>"], [["x", "", "y\nz"], ["", " "], ["é"]])
    assert docx_text(data) == "a\nb\nc & <d>\nx | y\nz\né"
    assert docx_text(docx([], [])) == ""


def test_sheets():
    data = xlsx([[["a", 1, 2.5, None, True, " in place "], [], [None]], [["a", 1e20, -3, "b<"]], [["r"]] * 300])
    assert xlsx_text(data, 2) == "a | 1 | 2.5 | True | in place\na | 1e+20 | -3 | b<\nr\nr"
    assert xlsx_text(data).count("r") == 201 and xlsx_text(xlsx([])) == ""  # 200 rows, and the r of True


def test_formats():
    data = docx(["text"], [])
    assert suffix_of("https://h/A/B.DOCX?x=1#y") == ".docx" and suffix_of("https://h/a.html") == suffix_of(None) == ""
    assert attachment_text(data, "a.docx") == "text"
    for content, name in ((data, "a.doc"), (data, "a.xlsx"), (data, "a"), (data[:-30], "a.docx"), (b"", "a.docx"), (None, "a.docx"), (b"%PDF-1.4", "a.docx"), (zipped({"word/document.xml": "<x>"}), "a.docx"), (zipped({"word/document.xml": "<x/>"}), "a.docx"), (data, None)):
        assert attachment_text(content, name) == ""


def test_folder_of_attachments(spark, monkeypatch):
    root = fresh(spark, "test-attachments")
    long = "a text of thirty letters, or more: 6 月 5 日"
    rows = [("a.docx", docx([long], [])), ("b.docx", docx(["short"], [])), ("c.txt", b"plain"), ("d.xlsx", xlsx([[[long]]])), ("e.docx", docx([long], []) + b" " * 5000)]
    write_files(spark.createDataFrame(rows, "name string, content binary"), root).collect()
    monkeypatch.setattr(files, "MOST_BYTES", 4000)
    found = {r.path.rpartition("/")[2]: r.text for r in attachments(spark, root).collect()}
    clean = "a text of thirty letters, or more: 6月5日"
    assert found == {"a.docx": clean, "b.docx": "", "c.txt": "", "d.xlsx": clean}


def test_side_files(spark):
    root = fresh(spark, "test-side")
    rows = [("a.json", '{"x": 1, "é": {"y": [null]}}'), ("cut.json", '{"x": 1'), ("list.json", "[1]"), ("empty.json", ""), ("bytes.json", None)]
    contents = [(n, bytearray(b"\xff\xfe") if t is None else bytearray(t.encode())) for n, t in rows]
    write_files(spark.createDataFrame(contents, "name string, content binary"), root).collect()
    paths = [f"{root}/{n}" for n, _ in rows] + [f"{root}/none.json"]
    assert sorted((r.key, r.value) for r in side_files(spark, paths).collect()) == [("x", "1"), ("é", '{"y": [null]}')]
    assert [(r.key, r.value) for r in side_files(spark, paths, "é").collect()] == [("y", "[null]")]
    assert side_files(spark, paths[-1:]).collect() == []


def test_feeds(spark):
    root = fresh(spark, "test-feeds")
    texts = {
        "rss.xml": "<rss><channel><title>c</title><item><title> a &amp; b </title><link>l</link><description>&lt;p&gt;x</description><pubDate>never</pubDate></item><item><title>no link</title></item></channel></rss>",
        "atom.xml": '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link href="h"/></entry><entry><title></title><link href="h"/></entry></feed>', "none.xml": "nothing",
    }
    write_files(spark.createDataFrame([(n, bytearray(t.encode())) for n, t in texts.items()], "name string, content binary"), root).collect()
    assert sorted((r.title, r.link, r.summary, r.sent_at) for r in feed_files(spark, root).collect()) == [("a & b", "l", " x", None), ("t", "h", "", None)]
    assert feed_files(spark, root).where(F.col("file").endswith("none.xml")).count() == 0

"""Attachments, side files and feeds that are written from the tables and read back, with the SQL that knows their contents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from ..sources.files import attachments, feed_files, one_by_one, side_files, write_files
from ..sources.tables import read, spread
from ..sources.versions import fresh

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def docx(paragraphs: list[str], table: list[list[str]]) -> bytes:
    run = lambda t: "<w:r>" + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in t.split("\n")) + "</w:r>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in row) + "</w:tr>" for row in table)
    body = "".join(f"<w:p>{run(p)}</w:p>" for p in paragraphs) + (f"<w:tbl>{rows}</w:tbl>" if rows else "")
    return zipped({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:sectPr/></w:body></w:document>'})


def xlsx(sheets: list[list[list]]) -> bytes:
    """Sheets of rows of texts (kept once, in the table of shared strings, or in place where they begin with a blank), numbers and nothing."""
    shared: dict[str, int] = {}

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if not isinstance(v, str):
            return f"<c><v>{v!r}</v></c>"
        if v.startswith(" "):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        return f'<c t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {f"xl/worksheets/s{k}.xml": f"<worksheet {space}><sheetData>{''.join(f'<row>{"".join(map(cell, r))}</row>' for r in rows)}</sheetData></worksheet>" for k, rows in enumerate(sheets)}
    parts["xl/sharedStrings.xml"] = f"<sst {space}>{''.join(f'<si><t>{escape(s)}</t></si>' for s in shared)}</sst>"
    # sheets stand in the workbook in the reverse order of their files' names
    parts["xl/workbook.xml"] = f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{"".join(f"""<sheet name="s{k}" sheetId="{k + 1}" r:id="r{k}"/>""" for k in range(len(sheets)))}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>""" for k in reversed(range(len(sheets))))}</Relationships>'
    return zipped(parts)


_SPACED = "regexp_replace(" * 6 + "{}" + r", '([0-9])[\s]+([0-9])', '\1\2', 'g')" * 6
_TRIM = r"regexp_replace({}, '^[\s]+|[\s]+$', '', 'g')"

_VALID = r"regexp_replace(text, '[^\x09\x0A\x20-\x{D7FF}]', '', 'g')"


@query("src_11_documents", rf"""WITH d AS (SELECT doc_id // 20 AS part, doc_id, lang, {_TRIM.format(_VALID)} AS t FROM documents),
    g AS (SELECT part, string_agg(t, chr(10) ORDER BY doc_id) FILTER (t <> '') || chr(10) || string_agg(doc_id || ' | ' || lang, chr(10) ORDER BY doc_id) AS raw FROM d GROUP BY part)
    SELECT part, {_SPACED.format('raw')} AS text FROM g""")
def src_11_documents(spark, sf_dir):
    """Word files of twenty documents each, with a table of their languages: paragraphs, then rows."""
    d = read(spark, sf_dir, "documents").select(F.expr("doc_id div 20").alias("part"), "doc_id", "lang", F.regexp_replace("text", r"[^\x09\x0A\x20-\x{D7FF}]", "").alias("text"))
    groups = spread(d, "part").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang", "text"))).alias("rows"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in one_by_one(batch):
                content = docx([p for r in rows for p in (r["text"], " ")], [[str(r["doc_id"]), r["lang"], "\n"] for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array([f"p{part}.docx"]), pa.array([content])], ["name", "content"])

    root = fresh(spark, "attachments")
    written = write_files(groups.mapInArrow(make, "name string, content binary"), root)
    written.write.format("noop").mode("overwrite").save()
    return attachments(spark, root).select(F.regexp_extract("path", r"/p(\d+)\.docx$", 1).cast("long").alias("part"), "text")


@query("src_11_sheets", r"""WITH o AS (SELECT o_orderkey // 400 AS part, o_orderkey AS k, o_orderstatus AS s, o_totalprice AS t, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderkey // 400 ORDER BY o_orderkey) AS n FROM orders),
    g AS (SELECT part, 'key | status | total' || chr(10) || string_agg(k || ' | ' || s || ' | ' || t::VARCHAR || ' | ' || trim(p) || ' | ' || CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END, chr(10) ORDER BY k) FILTER (n < 200) || chr(10) || 'last sheet | ' || max(n) AS text FROM o GROUP BY part)
    SELECT part, part % 3 AS kind, CASE WHEN part % 3 > 0 THEN '' ELSE text END AS text FROM g""")
def src_11_sheets(spark, sf_dir):
    """Workbooks of two sheets, of which 200 rows each are read; beside them old formats, PDF magic and cut files, which give no text."""
    o = read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 400").alias("part"), F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").alias("row"))
    groups = spread(o, "part").groupBy("part").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in one_by_one(batch):
                table = [[r["o_orderkey"], r["o_orderstatus"], r["o_totalprice"], " " + r["o_orderpriority"], None, r["o_orderkey"] % 2 == 0] for r in rows]
                content = xlsx([[["key", "status", None, "total"], *table], [["last sheet", len(rows)], []]])
                if part % 3 == 1:
                    content = b"%PDF-" + content
                ending = ("xlsx", "xlsx", "xls")[part % 3] if part % 2 else ("XLSX", "xlsx", "xlsx")[part % 3]
                yield pa.RecordBatch.from_arrays([pa.array([f"p{part}.{ending}"]), pa.array([content[: len(content) // 2] if part % 6 == 2 else content])], ["name", "content"])

    root = fresh(spark, "attachments")
    write_files(groups.mapInArrow(make, "name string, content binary"), root).write.format("noop").mode("overwrite").save()
    part = F.regexp_extract("path", r"/p(\d+)\.\w+$", 1).cast("long")
    return attachments(spark, root).select(part.alias("part"), (part % 3).alias("kind"), "text")


@query("src_05_side_files", """SELECT file, key, value FROM (SELECT event_type || '-' || event_id % 5 AS file, event_id::VARCHAR AS key, props->>'$.k' AS value, event_id % 5 AS kind FROM events) WHERE kind < 3
    UNION ALL SELECT event_type || '-3', (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::VARCHAR, event_id::VARCHAR FROM events WHERE event_id % 5 = 3""")
def src_05(spark, sf_dir):
    """Side files made from the event log: objects by key and lists below a field; a cut file, one that is no object and one that is missing give nothing."""
    e = read(spark, sf_dir, "events").select("event_type", "event_id", (F.col("event_id") % 5).alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    groups = e.groupBy("event_type", "kind").agg(F.array_sort(F.collect_list(F.struct("event_id", "k"))).alias("rows"))
    entries = F.map_from_entries(F.transform("rows", lambda r: F.struct(r["event_id"].cast("string"), r["k"])))
    text = F.when(F.col("kind") < 3, F.to_json(F.struct(entries.alias("details")))).when(F.col("kind") == 3, F.to_json(F.struct(F.transform("rows", lambda r: r["event_id"]).alias("details")))).otherwise(F.concat(F.lit('{"details": '), F.to_json(entries)))
    root = fresh(spark, "side-files")
    write_files(groups.select(F.concat("event_type", F.lit("-"), F.col("kind").cast("string"), F.lit(".json")).alias("name"), F.encode(text, "UTF-8").alias("content")), root).write.format("noop").mode("overwrite").save()
    kinds = [r[0] for r in groups.select("event_type").distinct().collect()]  # a handful of kinds
    rows = side_files(spark, [f"{root}/{t}-{k}.json" for t in kinds for k in range(6)], field="details")
    return rows.select(F.regexp_extract("file", r"/([^/]+)\.json$", 1).alias("file"), "key", "value")


@query("src_09_feed_files", r"""SELECT kind, title, link, summary, sent_at FROM (SELECT 'rss' AS kind, 'order ' || o_orderkey AS title, 'https://x.example.org/' || o_orderkey AS link, ' bold ' || ' & ' || o_orderpriority AS summary, strftime(o_orderdate, '%Y-%m-%d') || ' 02:00:00' AS sent_at FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 > 0 AND o_orderkey % 9 > 0
    UNION ALL SELECT 'atom', 'order ' || o_orderkey, 'https://x.example.org/' || o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'only content' ELSE 'text of ' || o_orderpriority END, NULL FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 7 > 0 AND o_orderkey % 9 > 0)""")
def src_09(spark, sf_dir):
    """RSS and Atom files of some hundred orders each: entries without title or link go, and so does a file that is no XML."""
    o = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("string"))
    entry = F.expr(r"""CASE WHEN o_orderkey % 2 = 0 THEN concat('<item><title>\n ', IF(o_orderkey % 7 = 0, ' ', concat('order ', k)), '</title><link>', IF(o_orderkey % 9 = 0, ' ', concat('\nhttps://x.example.org/', k)), '</link><description><![CDATA[<b>bold</b> & ', o_orderpriority, ']]></description><pubDate>', date_format(o_orderdate, "EEE, d MMM yyyy '10:00:00 +0800'"), '</pubDate></item>')
        ELSE concat('<entry><title type="text">', IF(o_orderkey % 7 = 0, '', concat('order ', k)), '</title><link rel="alternate" href="', IF(o_orderkey % 9 = 0, '', concat('https://x.example.org/', k)), '"/>', IF(o_orderkey % 5 = 0, '<content>only content</content>', concat('<summary>text of ', o_orderpriority, '</summary>')), '</entry>') END""")
    groups = o.select((F.col("o_orderkey") % 2).alias("atom"), F.expr("o_orderkey div 500").alias("part"), entry.alias("entry")).groupBy("atom", "part").agg(F.array_join(F.array_sort(F.collect_list("entry")), "\n").alias("entries"))
    text = F.when(F.col("atom") == 1, F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>\n'), "entries", F.lit("\n</feed>"))).otherwise(F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title><link>https://x</link>\n'), "entries", F.lit("\n</channel></rss>")))
    name = F.concat(F.when(F.col("atom") == 1, "atom").otherwise("rss"), F.lit("-"), F.col("part").cast("string"), F.lit(".xml"))
    more = spark.createDataFrame([("broken.xml", bytearray(b"not a feed <item"))], "name string, content binary")
    root = fresh(spark, "feeds")
    write_files(groups.select(name.alias("name"), F.encode(text, "UTF-8").alias("content")).unionByName(more), root).write.format("noop").mode("overwrite").save()
    return feed_files(spark, root).select(F.regexp_extract("file", r"/(\w+)-\d+\.xml", 1).alias("kind"), "title", "link", "summary", "sent_at")

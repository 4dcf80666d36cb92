"""Files of other formats as tables: attachments, keyed JSON side files, and feeds."""

from __future__ import annotations

import io
import json
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.announced import compact, feed_date

# Attachments by their ending, the largest one that is read, the shortest text that counts, rows of a sheet.
SUFFIXES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx")
MOST_BYTES, LEAST_TEXT, SHEET_ROWS = 8_000_000, 30, 200

_W, _S = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _runs(element: ElementTree.Element) -> str:
    """Text of a paragraph: its runs, with tabs and line breaks."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in element.iter())


def docx_text(data: bytes) -> str:
    """Paragraphs of the body, then its tables row by row with bars, all without surrounding white space and empty ones."""
    with zipfile.ZipFile(io.BytesIO(data)) as package, package.open("word/document.xml") as part:
        body = ElementTree.parse(part).getroot().find(f"{_W}body")
    lines = [_runs(p).strip() for p in body.findall(f"{_W}p")]
    for row in (r for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
        cells = ("\n".join(map(_runs, c.findall(f"{_W}p"))).strip() for c in row.findall(f"{_W}tc"))
        lines.append(" | ".join(filter(None, cells)))
    return "\n".join(filter(None, lines))


def _value(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, value = cell.get("t", "n"), cell.findtext(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return str(value == "1")
    if kind != "n":
        return value
    return str(float(value)) if any(c in value for c in ".eE") else str(int(value))


def xlsx_text(data: bytes, most: int = SHEET_ROWS) -> str:
    """The first rows of each sheet in the workbook's order, cells apart by bars; the rest of a sheet is never parsed. Dates are their numbers."""
    lines = []
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        names = set(package.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with package.open("xl/sharedStrings.xml") as part:
                shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.parse(part).getroot().findall(f"{_S}si")]
        with package.open("xl/workbook.xml") as book, package.open("xl/_rels/workbook.xml.rels") as links:
            targets = {x.get("Id"): x.get("Target") for x in ElementTree.parse(links).getroot()}
            sheets = [targets[x.get(_R)] for x in ElementTree.parse(book).getroot().iter(f"{_S}sheet")]
        for sheet in sheets:
            with package.open(posixpath.normpath(posixpath.join("xl", sheet)).lstrip("/") if not sheet.startswith("/") else sheet[1:]) as part:
                seen = 0
                for _, element in ElementTree.iterparse(part):
                    if element.tag == f"{_S}row":
                        lines.append(" | ".join(filter(None, (_value(c, shared).strip() for c in element.iter(f"{_S}c")))))
                        element.clear()
                        seen += 1
                        if seen == most:
                            break
    return "\n".join(filter(None, lines))


def suffix_of(name: str | None) -> str:
    path = urlsplit(name or "").path.lower()
    return next((s for s in SUFFIXES if path.endswith(s)), "")


def attachment_text(data: bytes | None, name: str | None) -> str:
    """Text of an attachment by its ending and its first bytes; empty for what is damaged or has another format.

    PDF needs a library that is not there, and the old binary formats have none: both give no text.
    """
    read = {".docx": docx_text, ".xlsx": xlsx_text}.get(suffix_of(name))
    if not data or not read or data[:5] == b"%PDF-":
        return ""
    try:
        return read(data)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, AttributeError, EOFError, OSError):
        return ""


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the attachments below a folder; files beyond 8 MB are never read, and texts of fewer than 30 letters are empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MOST_BYTES)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file's text at a time
                name = batch.column(0)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([attachment_text(batch.column(1)[k].as_py(), name)])], ["path", "raw"])

    rows = files.select("path", "content").mapInArrow(extract, "path string, raw string")
    return rows.select("path", F.when(F.length(F.trim("raw")) >= LEAST_TEXT, compact(F.col("raw"))).otherwise("").alias("text"))


def one_by_one(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch as Python values, one at a time, since each may be as long as a file."""
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in batch.columns)


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write column ``content`` of each row under its ``name`` below ``root``; returns name and bytes. A task that is run again writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for name, content in one_by_one(batch):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(content)
                names.append(name)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return rows.select("name", "content").mapInArrow(write, "name string, bytes long")


class SideFiles(DataSource):
    """Keyed JSON files as rows (file, key, value); ``format("side_files")`` with option ``paths``, a JSON list.

    A file that is missing or cut, or is no object, gives no rows, as if it were empty. Values are JSON again. With option
    ``field`` the rows are those of that field of the object: an object by its keys, a list by its positions.
    """

    @classmethod
    def name(cls) -> str:
        return "side_files"

    def schema(self) -> str:
        return "file string, key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _SideFileReader(json.loads(self.options["paths"]), self.options.get("field"))


class _SideFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _SideFileReader(DataSourceReader):
    def __init__(self, paths: list[str], field: str | None):
        self.paths, self.field = paths, field

    def partitions(self) -> list[InputPartition]:
        return [_SideFile(p) for p in self.paths]

    def read(self, partition: _SideFile) -> Iterator[tuple[str, str, str]]:
        try:
            system, name = fs.FileSystem.from_uri(partition.path)
            with system.open_input_stream(name) as stream:
                held = json.loads(stream.read())
        except (OSError, ValueError):
            return
        if self.field is not None:
            held = held.get(self.field) if isinstance(held, dict) else None
        for key, value in held.items() if isinstance(held, dict) else enumerate(held if self.field and isinstance(held, list) else ()):
            yield partition.path, str(key), json.dumps(value, ensure_ascii=False)


def side_files(spark: SparkSession, paths: list[str], field: str | None = None) -> DataFrame:
    spark.dataSource.register(SideFiles)
    reader = spark.read.format("side_files").option("paths", json.dumps(paths))
    return (reader.option("field", field) if field is not None else reader).load()


def _stripped(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """file, title, link, summary, sent_at of the entries of RSS and Atom files below a path.

    An Atom link is the address in its attribute, an RSS link its text. Tags in a summary become blanks; entries without
    title or link go; a date that can't be read is null. Files that are no XML give no rows.
    """
    link = "link struct<_VALUE: string, _href: string>"
    read = lambda tag, shape: spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").option("mode", "DROPMALFORMED").schema(shape).load(path).withColumn("file", F.input_file_name())
    rss = read("item", f"title string, {link}, description string, pubDate string").select("file", "title", "link", F.col("description").alias("summary"), F.date_format(feed_date(F.col("pubDate")), "yyyy-MM-dd HH:mm:ss").alias("sent_at"))
    atom = read("entry", f"title string, {link}, summary string, content string").select("file", "title", "link", F.coalesce("summary", "content").alias("summary"), F.lit(None).cast("string").alias("sent_at"))
    rows = rss.unionByName(atom).withColumns({"title": _stripped("title"), "link": F.coalesce(F.nullif(F.col("link._href"), F.lit("")), _stripped("link._VALUE"))})
    return rows.where("title <> '' and link <> ''").select("file", "title", "link", F.regexp_replace(_stripped("summary"), "<[^>]+>", " ").alias("summary"), "sent_at")

"""Web archives in ZIP packages: one writer per task, and a reader that fetches byte ranges only.

A package holds ``archive/data.warc.gz`` (one gzip member a record) and ``indexes/index.cdxj``, both stored without
compression, so that a record is a byte range of the package. The reader takes the end record, the ZIP64 records and the
central directory from the package's end, finds the stored members, reads the index in pieces, and hands spans of
neighbouring records to tasks, which read each span at once. Nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shuffle_partitions, steady, stored

#: Shortest payload that is stored once only. Bytes and records of one package, of a span, and of one batch of results.
LEAST, PACKAGE, RECORDS, SPAN, BATCH = 100, 64 << 20, 100_000, 4 << 20, 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(headers: dict[str, str | None], payload: bytes | None, size: int) -> bytes:
    """A WARC record of an HTTP answer with ``size`` bytes, as one gzip member; a revisit has no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in headers.items() if v is not None), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and full payload length of a record; raises ValueError where it is cut or damaged."""
    try:
        raw = zlib.decompress(member, 31)
    except zlib.error as error:
        raise ValueError(f"damaged record: {error}") from error
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    length = int(headers.get("Content-Length", -1))
    if not version.startswith("WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^Content-Length: *(\d+)", http)[1])
    if headers["WARC-Type"] == "response" and (len(payload) != size or f"sha256:{hashlib.sha256(payload).hexdigest()}" != headers["WARC-Payload-Digest"]):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not have its length or digest")
    return headers, payload, size


class Package:
    """One package that is being written; ``close`` gives its row of the list of packages."""

    def __init__(self, root: str):
        self.system, base = fs.FileSystem.from_uri(root)
        self.system.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.path, self.out = f"{root}/{name}", self.system.open_output_stream(f"{base}/{name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data, self.bytes, self.index = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), 0, []

    def add(self, member: bytes, url: str | None) -> None:
        self.data.write(member)
        self.index.append(f"{_line(url or '-').replace(' ', '%20')} 19700101000000 " + json.dumps({"filename": DATA.rpartition("/")[2], "offset": str(self.bytes), "length": str(len(member))}))
        self.bytes += len(member)

    def full(self) -> bool:
        return self.bytes >= PACKAGE or len(self.index) >= RECORDS

    def close(self) -> dict:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{line}\n" for line in sorted(self.index)))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return {"path": self.path, "bytes": size, "records": len(self.index)}


def write_archives(pages: DataFrame, root: str, least: int = LEAST) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the list of packages: path, bytes, records.

    Of rows with equal payloads of at least ``least`` bytes that with the smallest page_id (null last), then the earliest
    row, is the response; the others are revisits without payload. A null html is an empty payload; a null url or page_id
    is a record without that header; control characters of a url are percent-encoded. Repeated rows are records of their
    own; an empty table gives an empty list; other columns are ignored. A package gets its name from the attempt that
    wrote it, and the list, a stored table, names those of the attempts that counted: a lost task leaves files that
    nothing names. ``root`` must be a folder that pyarrow's file systems reach on every executor.
    """
    pages = steady(pages)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("digest"))
    # what can't be a copy has a key of its own, so that no task gets all short payloads
    rows = rows.withColumn("key", F.when(F.col("size") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string"))))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), "row")).alias("first")
    groups = rows.where(F.col("size") >= least).groupBy("key").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    marked = rows.join(stored(groups, "equal-payloads"), "key", "left").withColumn("again", F.col("first.row").isNotNull() & (F.col("first.row") != F.col("row")))
    marked = marked.select("row", "page_id", "url", "size", "digest", "again", F.when(~F.col("again"), F.encode("html", "UTF-8")).alias("payload"), F.col("first.row").alias("of_row"), F.col("first.id").alias("of_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        name = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{root}#{n}')}>"
        text = lambda v: None if v is None else str(v)
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                headers = {
                    "WARC-Type": "revisit" if r["again"] else "response", "WARC-Record-ID": name(r["row"]), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": r["url"], "WARC-Page-ID": text(r["page_id"]), "WARC-Payload-Digest": f"sha256:{r['digest']}",
                }
                if r["again"]:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(r["of_row"]), "WARC-Refers-To-Page-ID": text(r["of_id"])}
                package = package or Package(root)
                package.add(record(headers, r["payload"], r["size"]), r["url"])
                if package.full():
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return stored(marked.mapInArrow(write, "path string, bytes long, records long"), "packages")


@dataclass
class Member:
    name: str
    method: int
    size: int
    at: int


class Ranges:
    """Byte ranges of one file."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or len(got := self.file.read_at(n, at)) != n:
            raise ValueError(f"no {n} bytes at {at}: the package is cut")
        return got

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def _wide(extra: bytes, size: int, packed: int, at: int) -> tuple[int, int, int]:
    """Sizes and offset with what the ZIP64 field says of those that are too large for 32 bits."""
    values = [size, packed, at]
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<HH", extra)
        if kind == 1:
            field = extra[4 : 4 + n]
            for k, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    (values[k],), field = struct.unpack_from("<Q", field), field[8:]
        extra = extra[4 + n :]
    return values[0], values[1], values[2]


def members(ranges: Ranges, piece: int = 1 << 20) -> Iterator[Member]:
    """The entries of the central directory, which is read in pieces."""
    tail_at = max(0, ranges.size - 22 - 0xFFFF)
    tail = ranges.read(tail_at, ranges.size - tail_at)
    at = len(tail)
    while True:  # a comment may contain the mark: the record's own length must reach the end
        at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP package")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        mark, _, wide_at, _ = struct.unpack("<4sIQI", ranges.read(end - 20, 20))
        wide = ranges.read(wide_at, 56)
        if mark != b"PK\6\7" or wide[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record where it must be")
        entries, length, start = struct.unpack_from("<QQQ", wide, 32)
    held, done, seen = b"", 0, 0
    while seen < entries:
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            if done >= length:
                raise ValueError("the central directory is cut")
            held += ranges.read(start + done, min(piece, length - done))
            done += min(piece, length - done)
        if held[:4] != b"PK\1\2":
            raise ValueError("not an entry of a central directory")
        method, packed, size = struct.unpack_from("<H", held, 10)[0], *struct.unpack_from("<II", held, 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", held, 28)
        name = held[46 : 46 + n_name].decode()
        size, packed, at = _wide(held[46 + n_name : 46 + n_name + n_extra], size, packed, struct.unpack_from("<I", held, 42)[0])
        yield Member(name, method, packed, at)
        held, seen = held[46 + n_name + n_extra + n_comment :], seen + 1


def data_start(ranges: Ranges, member: Member) -> int:
    if member.method:
        raise ValueError(f"{member.name} is compressed: its records are no byte ranges")
    head = ranges.read(member.at, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"no local header of {member.name}")
    return member.at + 30 + sum(struct.unpack_from("<HH", head, 26))


def _pieces(ranges: Ranges, at: int, size: int, piece: int = 1 << 20) -> Iterator[bytes]:
    for start in range(0, size, piece):
        yield ranges.read(at + start, min(piece, size - start))


def _indexed(ranges: Ranges, at: int, size: int) -> Iterator[tuple[str, int, int]]:
    """File, offset and length of each line of an index."""
    rest = b""
    for piece in _pieces(ranges, at, size):
        *lines, rest = (rest + piece).split(b"\n")
        for line in lines:
            if b"{" in line:
                found = json.loads(line[line.index(b" {") + 1 :])
                yield found["filename"], int(found["offset"]), int(found["length"])


def _walked(ranges: Ranges, at: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member, for an archive without an index: it is read once from its start."""
    begin = done = 0
    inflate = zlib.decompressobj(31)
    for piece in _pieces(ranges, at, size):
        while piece:
            inflate.decompress(piece)
            done += len(piece) - len(inflate.unused_data)
            piece = inflate.unused_data
            if not inflate.eof:
                break
            yield begin, done - begin
            begin, inflate = done, zlib.decompressobj(31)
    if begin != done:
        raise ValueError("the last record is cut")


def locate(path: str) -> Iterator[tuple[int, int]]:
    """Offset and length, within the package, of each record of its archives."""
    with Ranges(path) as ranges:
        found = {m.name: m for m in members(ranges)}
        starts = {n: data_start(ranges, m) for n, m in found.items() if n.startswith("archive/") and n.endswith(".warc.gz")}
        known = set()
        for name, member in found.items():
            if name.startswith("indexes/") and name.endswith((".cdx", ".cdxj")):
                for file, offset, length in _indexed(ranges, data_start(ranges, member), member.size):
                    known.add(file)
                    yield starts[f"archive/{file}"] + offset, length
        for name, start in starts.items():
            if name.removeprefix("archive/") not in known:
                yield from ((start + offset, length) for offset, length in _walked(ranges, start, found[name].size))


def read_archives(packages: DataFrame, payloads: bool = True, span: int = SPAN) -> DataFrame:
    """Every record of the packages in column ``path``: page_id, url, record_type, record_id, refers_id (of the record that
    a revisit stands for), refers_to (that record's page_id), payload_bytes and payload_digest of the full payload, and
    with ``payloads`` the payload, which is null for revisits (see ``resolved``).

    Headers that a record lacks are null. A damaged package, a compressed archive member or a payload that does not have
    its digest raises ValueError. A package without records or an empty list gives no rows; a path that is listed twice
    is read twice; other columns are ignored. A task holds one span of records, or one record.
    """
    shape = "page_id long, url string, record_type string, record_id string, refers_id string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_id", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *[("payload", pa.binary())] * payloads])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out = []
                for at, n in sorted(locate(path)):
                    if out and at <= out[-1]["at"] + out[-1]["bytes"] and at + n - out[-1]["at"] <= span:
                        out[-1]["cuts"].append(at - out[-1]["at"])
                        out[-1]["bytes"] = at + n - out[-1]["at"]
                    else:
                        out.append({"path": path, "at": at, "bytes": n, "cuts": [0]})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("cuts", pa.list_(pa.int64()))]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: None if v is None else int(v)
        out, held = [], 0
        for batch in batches:
            for path, at, n, cuts in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "bytes", "cuts")), strict=True):
                with Ranges(path) as ranges:
                    block = ranges.read(at, n)
                for a, b in zip(cuts, [*cuts[1:], n], strict=True):
                    h, payload, size = parsed(block[a:b])
                    out.append(
                        {"page_id": number(h.get("WARC-Page-ID")), "url": h.get("WARC-Target-URI"), "record_type": h["WARC-Type"], "record_id": h["WARC-Record-ID"], "refers_id": h.get("WARC-Refers-To"), "refers_to": number(h.get("WARC-Refers-To-Page-ID")), "payload_bytes": size, "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha256:")}
                        | ({"payload": payload if h["WARC-Type"] == "response" else None} if payloads else {})
                    )
                    held += 300 + len(payload) * payloads
                    if held >= BATCH:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, kinds)

    listed = packages.select(F.col("path").cast("string").alias("path")).mapInArrow(spans, "path string, at long, bytes long, cuts array<long>")
    return listed.repartition(shuffle_partitions(packages.sparkSession), "path", "at").mapInArrow(read, shape)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with the payloads of revisits, which are those of the records that they stand for."""
    records = stored(records, "records")
    wanted = records.where("record_type = 'revisit'").drop("payload")
    of = records.where("record_type = 'response'").select(F.col("record_id").alias("of"), "payload").join(wanted.select(F.col("refers_id").alias("of")).distinct(), "of", "left_semi")
    found = wanted.join(stored(of, "revisited"), F.col("refers_id") == F.col("of"), "left").drop("of")
    return records.where("record_type <> 'revisit'").unionByName(found.select(*records.columns))

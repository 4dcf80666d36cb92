"""Web archives in ZIP packages: round trips, the standard library's reading of them, and damaged packages."""

import gzip
import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from marquee.llm import warc
from marquee.llm.scratch import shared_dir, stored
from marquee.llm.warc import DATA, INDEX, Ranges, data_start, locate, members, parsed, read_archives, record, resolved, write_archives


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    body = lambda n: "<p>" + "".join(rng.choices("abc é日\r\n", k=n)) + "</p>"
    copy, other = body(200), "x" * 100
    out = [(k, f"https://h/{k}", body(rng.randint(0, 300))) for k in range(60)]
    out += [(100 + k, f"https://copy/{k} b", copy) for k in range(30)] + [(90, None, copy), (None, "https://none", copy)]
    out += [(200, "a\r\nWARC-Type: x", None), (201, "", ""), (202, "s", "x" * 99), (203, "s", "x" * 99), (204, "s", other), (204, "s", other), (300, "long", "word " * 100_000), (301, "é", "\r\n\r\nWARC/1.1\r\n" * 20)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def pages(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4, "url")
    return stored(table.withColumns({c: F.lit("own") for c in ("row", "key", "first", "size", "digest", "again", "payload")}), "warc-pages")


@pytest.fixture(scope="module")
def packages(spark, pages):
    return write_archives(pages, f"{shared_dir(spark)}/warc-test")


def test_round_trip(rows, packages):
    full = [(p or "").encode() for _, _, p in rows]
    first = {}
    for (i, _, _), p in zip(rows, full, strict=True):
        if len(p) >= 100:
            first[p] = min(first.get(p, (True, 0)), (i is None, i or 0))
    response = {p: 0 for p in full}
    found, every = read_archives(packages), []
    for r in found.collect():
        p = next(p for p in response if hashlib.sha256(p).hexdigest() == r.payload_digest)
        every.append((r.page_id, r.url, p))
        assert r.payload_bytes == len(p) and r.payload == (p if r.record_type == "response" else None)
        if len(p) < 100:
            assert (r.record_type, r.refers_to) == ("response", None)
        else:
            response[p] += r.record_type == "response"
            assert r.refers_to == (first[p][1] if r.record_type == "revisit" else None)
            assert r.record_type == "revisit" or r.page_id == first[p][1]
    assert all(n == (len(p) >= 100) for p, n in response.items())
    urls = {"a\r\nWARC-Type: x": "a%0D%0AWARC-Type: x"}
    assert sorted(every, key=repr) == sorted(((i, urls.get(u, u), p) for (i, u, _), p in zip(rows, full, strict=True)), key=repr)
    assert sorted((r.page_id, bytes(r.payload)) for r in resolved(found).where("page_id is not null").collect()) == sorted((i, p) for (i, _, _), p in zip(rows, full, strict=True) if i is not None)


def test_no_rows(spark, pages):
    none = write_archives(pages.limit(0), f"{shared_dir(spark)}/warc-none")
    assert none.collect() == [] and read_archives(none).collect() == []


def test_others_can_read_packages(packages, rows):
    """The standard library opens the packages, and their archives are plain series of gzip members."""
    seen = 0
    for r in packages.collect():
        with zipfile.ZipFile(r.path) as z:
            assert z.testzip() is None
            seen += gzip.decompress(z.read(DATA)).count(b"WARC-Record-ID: ")
            assert len(z.read(INDEX).splitlines()) == r.records
    assert seen == len(rows)


def package(tmp_path, n=300, comment=b"", index=True, method=zipfile.ZIP_STORED):
    parts = [record({"WARC-Type": "response", "WARC-Record-ID": f"<{k}>", "WARC-Payload-Digest": f"sha256:{hashlib.sha256(b'p' * k).hexdigest()}"}, b"p" * k, k) for k in range(n)]
    out, at = io.BytesIO(), 0
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = comment
        for k in range(20):
            z.writestr(f"pages/{k}.jsonl", b"x" * k)
        z.writestr(DATA, b"".join(parts))
        if index:
            lines = []
            for p in parts:
                lines.append(f'k 1 {{"filename": "data.warc.gz", "offset": "{at}", "length": "{len(p)}"}}')
                at += len(p)
            z.writestr(INDEX, "\n".join(lines) + "\n")
    path = tmp_path / "a.wacz"
    path.write_bytes(out.getvalue())
    return str(path), parts


@pytest.mark.parametrize("comment", [b"", b"PK\5\6" * 9, b"z" * 65_535])
@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("index", [True, False])
def test_directories(tmp_path, monkeypatch, comment, wide, index):
    if wide:  # every size, offset and count goes to ZIP64 fields and records
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    plain, parts = package(tmp_path, index=index)
    (tmp_path / "other").mkdir()
    path, _ = package(tmp_path / "other", comment=comment, index=index)  # the standard library can't read a comment with the mark
    with zipfile.ZipFile(plain) as z, Ranges(path) as ranges:
        for piece in (50, 1 << 20):
            assert [(m.name, m.size) for m in members(ranges, piece)] == [(i.filename, i.compress_size) for i in z.infolist()]
        for m in members(ranges):
            assert ranges.read(data_start(ranges, m), m.size) == z.read(m.name)
        assert [ranges.read(at, n) for at, n in locate(path)] == parts


def test_damaged(tmp_path):
    path, parts = package(tmp_path, 3)
    whole = open(path, "rb").read()
    for bad in (b"", whole[:-30], whole[200:], b"PK\5\6" + b"\0" * 10):
        other = tmp_path / "bad.wacz"
        other.write_bytes(bad)
        with pytest.raises(ValueError):
            list(locate(str(other)))
    with pytest.raises(ValueError, match="compressed"):
        list(locate(package(tmp_path, 3, method=zipfile.ZIP_DEFLATED)[0]))
    with pytest.raises(ValueError):
        parsed(parts[2][:-9])
    with pytest.raises(ValueError, match="digest"):
        parsed(record({"WARC-Type": "response", "WARC-Record-ID": "<1>", "WARC-Payload-Digest": "sha256:0"}, b"p", 1))


def test_many_packages(spark, pages, rows, monkeypatch):
    """Records beyond a package's bounds go to the next one; spans of any size give the same rows."""
    copies = pages.unionByName(pages).unionByName(pages)
    packages = write_archives(stored(copies.coalesce(1), "warc-copies"), f"{shared_dir(spark)}/warc-many")
    sizes = {r.records for r in packages.collect()}
    assert sizes and sum(r.records for r in packages.collect()) == 3 * len(rows)
    whole = [tuple(r) for r in read_archives(packages, payloads=False).orderBy("record_id").collect()]
    assert [tuple(r) for r in read_archives(packages, payloads=False, span=100).orderBy("record_id").collect()] == whole
    assert len({r[3] for r in whole}) == len(whole) == 3 * len(rows)


def test_full_package(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 2)
    p = warc.Package(str(tmp_path))
    for _ in range(2):
        assert not p.full()
        p.add(record({"WARC-Type": "response", "WARC-Record-ID": "<1>", "WARC-Payload-Digest": "sha256:" + hashlib.sha256(b"").hexdigest()}, b"", 0), "u v")
    assert p.full() and len(list(locate(p.close()["path"]))) == 2

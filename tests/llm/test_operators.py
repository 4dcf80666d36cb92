"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from marquee.llm import jaccard_join as J
from marquee.llm.decontaminate import decontaminate
from marquee.llm.exact_dedup import exact_dedup
from marquee.llm.html_extract import Page, TreeModel, extract_main_text
from marquee.llm.labelled_pages import training_pages
from marquee.llm.license_scan import TEMPLATES, license_scan, shingles_of
from marquee.llm.repeats import RANGES, components, packed, unpacked
from marquee.llm.scratch import stored
from marquee.llm.sentencepiece_codec import encode_decode
from marquee.llm.sharding import CommitConflict, ShardStore, shard
from marquee.llm.substring_dedup import substring_dedup
from marquee.llm.suffix_dedup import suffix_dedup
from marquee.llm.suffix_runs import common, front_coded, merged
from marquee.llm.toxicity import toxicity, training_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Extra columns that clash with names which the operators use inside.
CLASH = ("row", "id", "key", "n", "pos", "occ", "name", "score", "hits", "found", "_text", "component", "run_")


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(60)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    passage, base = line(30), line(120)
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One  one"), (5, "a b c d"), (6, "A b\nc d")]
    out += [(10 + k, line(rng.randint(5, 60))) for k in range(12)]
    out += [(30, passage), (31, line(20) + " " + passage + " " + line(5)), (32, passage + "\n" + line(9)), (33, line(3) + " " + passage.upper())]
    for k in range(8):  # near copies of one text, some below the threshold
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = "zz" + str(k)
        out.append((40 + k, " ".join(w)))
    out += [(60, "日本語 テキスト　x " * 3), (61, "😀 é " * 40), (62, line(30)), (62, line(30))]
    out += [(70, base), (71, base.replace(" ", "\n")), (72, base + " "), (None, base), (80, "x" * 9000), (81, "x" * 9000), (82, "ab " * 4000)]
    return [*out, out[20], out[3]]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return stored(table.withColumns({c: F.lit("clash") for c in CLASH}), "test-docs")


@pytest.fixture(scope="module")
def none(spark, docs):
    return stored(docs.limit(0), "test-empty")


def bag(found):
    return sorted(map(tuple, found), key=repr)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_exact_dedup(docs, rows, none):
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    order = lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0)
    best = {x: min((k for k in range(len(rows)) if norm[k] == x), key=order) for x in set(norm)}
    expected = [(i, rows[best[x]][0], norm.count(x), sha(x)) for (i, _), x in zip(rows, norm, strict=True)]
    for block in (4096, 7):  # small blocks need many rounds
        found = exact_dedup(docs, block=block).collect()
        assert bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == bag(expected)
        assert sum(r.kept for r in found) == len(best)
        assert all(r.keep_id == r.doc_id for r in found if r.kept)
    assert exact_dedup(none).collect() == []


def test_codec(docs, rows, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = [(i, len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids)), ids) for i, t in rows]
    found = encode_decode(docs, MODEL, keep=True, max_chunks=50).collect()
    assert bag((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in found) == bag(expected)
    assert all(sha(r.decoded) == r.decoded_sha256 for r in found)
    assert encode_decode(none, MODEL).collect() == []


def shingle_sets(rows):
    out = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_jaccard_join(docs, rows, none):
    sets = shingle_sets(rows)
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    expected = [(rows[k][0], len(sets[k]), least[group[k]]) for k in range(len(rows))]
    assert bag(J.jaccard_join(docs).collect()) == bag(expected)
    assert J.jaccard_join(none).collect() == []


def test_subset_keys_lose_no_pair():
    rng = random.Random(1)
    for boundary in (0, 6, 40):
        for _ in range(400):
            a = set(rng.sample(range(80), rng.randint(1, 45)))
            b = set(rng.sample(sorted(a), max(1, len(a) - rng.randint(0, 5)))) | set(rng.sample(range(80), rng.randint(0, 5)))
            if 100 * len(a & b) < 80 * len(a | b):
                continue
            x, y = sorted((a, b), key=len)
            small, large = (J.keys_of(np.array(sorted(s), np.uint64), np.ones(len(s), bool), boundary, 80, 100) for s in (x, y))
            assert set(small[0][small[2]].tolist()) & set(large[0].tolist())


def test_parity_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        common, own = rng.integers(0, 1 << 62, rng.integers(1, 3000)), [rng.integers(0, 1 << 62, rng.integers(0, 400)) for _ in range(2)]
        a, b = (np.unique(np.concatenate([common, x]).astype(np.uint64)) for x in own)
        assert J.least_difference(J.parity(a).tobytes(), J.parity(b).tobytes()) <= len(np.setxor1d(a, b))


def test_substring_dedup(docs, rows, none):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    number = [i if i is not None else 1 << 62 for i, _ in rows]
    least = {}
    for n, w in zip(number, words, strict=True):
        for s in range(len(w) - 12):
            k = tuple(w[s : s + 13])
            least[k] = min(n, least.get(k, n))
    expected = []
    for (i, _), n, w in zip(rows, number, words, strict=True):
        gone = {j for s in range(len(w) - 12) if least[tuple(w[s : s + 13])] < n for j in range(s, s + 13)}
        expected.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    found = substring_dedup(docs).collect()
    assert bag((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == bag(expected)
    assert all(sha(r.kept) == r.kept_sha256 for r in found) and any(r.n_removed for r in found)
    assert substring_dedup(none).collect() == []


def test_suffix_dedup(docs, rows, none):
    data = [(t or "").encode() for _, t in rows]
    number = [i if i is not None else 1 << 62 for i, _ in rows]
    least = {}
    for n, b in zip(number, data, strict=True):
        for s in range(len(b) - 49):
            k = b[s : s + 50]
            least[k] = min(n, least.get(k, n))
    expected = []
    for (i, _), n, b in zip(rows, number, data, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if least[b[s : s + 50]] < n:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(1 for s in range(len(b)) if gone[s] and not (s and gone[s - 1]))
        expected.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    for common in (1000, 2):  # with few different stretches a gram gives way to its windows' hashes
        found = suffix_dedup(docs, common=common).collect()
        assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == bag(expected)
    assert suffix_dedup(none).collect() == []


def test_suffix_runs_merge():
    rng = random.Random(0)
    for _ in range(200):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
        order, shared = merged([(*front_coded(r), np.array([len(x) for x in r], int)) for r in runs])
        feeds = [iter(r) for r in runs]
        out = [next(feeds[k]) for k in order]
        assert out == sorted(x for r in runs for x in r)
        assert shared.tolist() == [0] * bool(out) + [common(x, y, 0) for x, y in zip(out, out[1:], strict=False)]


def test_packed_slots():
    rng = np.random.default_rng(0)
    for bits, n in ((16, 0), (16, 100), (20, 30_000), (30, 1000)):
        parts = [np.unique(rng.integers(0, 1 << bits, n)) for _ in range(4)]
        batch = packed(parts, bits, None)
        found = [unpacked(low) + group * ((1 << bits) // RANGES) for group, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
        assert np.array_equal(np.concatenate([*found, np.zeros(0, np.int64)]), np.sort(np.concatenate(parts)))


def test_decontaminate(spark, docs, rows, none):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(1, rows[20][1]), (2, "one"), (3, None), (4, "--"), (10, rows[25][1]), (10, rows[25][1]), (None, rows[26][1]), (11, "A B c"), (12, "nowhere at all")]
    windows = [(str(i), tuple(w[s : s + 10])) for i, t in items if i is not None and (w := find(t)) for s in range(max(1, len(w) - 9))]
    expected = []
    for i, t in rows:
        w = find(t)
        hit, met = set(), set()
        for item, p in windows:
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    met.add(item)
        expected.append((i, len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    for limit in (10**6, 50):  # the second in several passes
        found = decontaminate(docs, benchmark, max_pattern_words=limit).drop("hits").collect()
        assert bag(found) == bag(expected)
    assert decontaminate(none, benchmark).collect() == []
    assert not any(r.contaminated for r in decontaminate(docs, benchmark.limit(0)).collect())


def test_html_extraction(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy now</div><article><h1>Head &amp; more</h1><p>First <b>bold</b>\n  text&nbsp;here, long enough to read."
        "<p>Second<br>line<script>var t='</p>';</script></p></article><aside class='sidebar'><p>side</p></aside><section id='comments'><div class='comment'><p>reader says</p></div></section><footer>&copy; x</footer></body>"
    )
    shape = "page_id long, url string, html string, text string"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p", "x"), (5, "u", "<nav>only menu</nav>", "x"), (1, "u", page, "x"), (6, "u", "<body><article>" + "<p>Deep words stand here.</p>" * 3000 + "</article>", "x")]
    found = {r.page_id: r for r in extract_main_text(spark.createDataFrame(rows, shape)).collect()}
    assert found[1].text == "Head & more\n\nFirst bold text here, long enough to read.\n\nSecond line"
    assert [found[k].text for k in (2, 3, 5)] == ["", "", ""] and found[1].n_chars == len(found[1].text)
    assert found[6].text.count("Deep") == 3000
    assert extract_main_text(spark.createDataFrame([], shape)).collect() == []


def test_html_attributes_are_read_whole(spark):
    """Only an attribute's name hides an element, never what stands inside a value; a page's own data-y is no label."""
    body = "<article{}><h1>Head of it</h1><p>A first <a{}>linked name</a> stands here, long enough to be read as text.</p><p>And a second one after it.</p></article>"
    shown = "Head of it\n\nA first linked name stands here, long enough to be read as text.\n\nAnd a second one after it."
    same = [
        (' style="overflow:hidden"', ""), (' title="the hidden truth"', ""), ("", ' href="/a/hidden/b"'), ("", " href=/a/hidden/b"), (" title='x aria-hidden=true y'", ' rel="x hidden"'), (' data-y="12.5"', ' data-y="0"'),
        (' data-x="true" aria-hidden="false"', " data-hidden"), (' title="class=hidden id=hidden"', ""), (" title = 'a \"hidden\" b'", ""),
    ]
    gone = [" hidden", " HIDDEN=''", ' id="x"hidden', ' title="a"  hidden="until-found"', " aria-hidden=true", " aria-hidden = 'TRUE'", ' data-y="1" hidden']
    pages = ['<html><body><div style="overflow:hidden">' + body.format("", "") + "</div></body></html>", *["<html><body>" + body.format(*x) + "</body></html>" for x in same], *["<html><body>" + body.format(x, "") + "</body></html>" for x in gone]]
    found = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert [found[k] for k in range(len(pages))] == [shown] * (1 + len(same)) + [""] * len(gone)


def test_html_shapes():
    """Omitted end tags, forms that wrap the page, text without markup, comments inside the article; and pages in linear time."""
    body = "<p>A first paragraph stands here, long enough to be read as text.</p><p>And a second one after it.</p>"
    text, line = "A first paragraph stands here, long enough to be read as text.\n\nAnd a second one after it.", "Just a bare line of text without any markup at all."
    same = [
        f"<html><head><title>t</title><body><article>{body}</article></body></html>", f"<html><head><title>t</title><article>{body}</article></html>", f"<form action=x><nav><a href=1>menu</a></nav><article>{body}</article><footer>c</footer></form>",
        f"<html><body><form id='aspnetForm'><div class='content'>{body}</div><input></form></body></html>", body, f"<html><body>{body}</body></html>", f"<html><body><div>{body}</div></body></html>",
        f"<html><body><article>{body}<div class='comments'><p>reader one says this</p><p>reader two</p></div></article></body></html>", f"<body><article>{body}<section id='reader-comments'><h3>Comments</h3><div><p>reader one says this and more</p></div></section></article>",
        f"<body><form class='search'><label>Find</label><input><button>Go</button></form><article>{body}</article>", f"<body><article>{body}<form class='newsletter'><p>Subscribe to our letter</p><input></form></article>",
    ]
    model = TreeModel(training_pages())
    assert [model.extract(x) for x in same] == [text] * len(same)
    assert [model.extract(x) for x in (line, f"<html><body>{line}</body></html>", "<nav>only menu</nav>")] == [line, line, ""]
    began = time.monotonic()
    for odd in ('<a "' * 20000, '<a x="' * 20000, "<div>" * 50000 + "</b>" * 50000, "<a x='" + "<p>" * 50000):
        model.extract(odd)
    assert time.monotonic() - began < 20


def test_html_articles_against_brute_force():
    """On the given pages the main text is the article, cut at its block tags."""
    import duckdb

    from marquee.llm.html_extract import BLOCKS, SPACE

    block, model = "</?(?:" + "|".join(sorted(BLOCKS, key=len, reverse=True)) + r")(?=[\s/>])[^>]*>", TreeModel(training_pages())
    for (page,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' where html is not null").fetchall():
        found = re.search(r"<article\b[^>]*>(.*?)</article>", page, re.S)
        x = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", found[1] if found else "", flags=re.S)
        x = re.sub("<[^>]*>", "", re.sub(r"<br\s*/?>", " ", re.sub(block, "\0", x)))
        assert model.extract(page) == "\n\n".join(y for y in (SPACE.sub(" ", html.unescape(z)).strip() for z in x.split("\0")) if y)


def test_html_model_on_held_out_pages():
    model, right, total = TreeModel(training_pages()), 0, 0
    for source in training_pages(60, seed=77):
        page = Page(source)
        content = model.marginals(page)
        for k in {k for k, _, _ in page.texts}:
            total += 1
            right += (content[k] >= 0.5) == bool(page.label[k])
    assert right / total > 0.95


def test_marginals_equal_enumeration():
    import itertools

    model = TreeModel(training_pages(20))
    page = Page("<div><p>some <a>words</a></p><ul><li>x</ul></div>")
    seen, n, weight, share = page.seen(), len(page.tag), 0.0, np.zeros(len(page.tag))
    from marquee.llm.html_extract import BLOCKS

    for y in itertools.product((0, 1), repeat=n):
        log = model.root[y[0]] + sum(model.log[f][y[k]] for k in range(n) for f in seen[k] if f in model.log)
        log += sum(model.edge[int(page.tag[k] in BLOCKS), y[page.parent[k]], y[k]] for k in range(1, n))
        weight += np.exp(log)
        share += np.exp(log) * np.array(y)
    assert np.allclose(model.marginals(page), share / weight)


def test_toxicity(spark, none):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(900):
        w, toxic = rng.choices(words, k=rng.randint(20, 80)), k % 3 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = "vilify" + rng.choice(("", "s", "ed", "x" * (k % 5)))
        rows.append((k, " ".join(w), "clash", 1.0))
        labels.append((k, int(toxic)))
    rows += [(2000, None, None, None), (2001, "", None, None), (2002, "...", None, None), (None, "plain text", None, None), (5, rows[5][1], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame([*labels, (1, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    found = toxicity(docs, known, keep=("text", "lang")).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == labels[r.doc_id][1] for r in held if r.doc_id < 900) > 0.95 * sum(r.doc_id < 900 for r in held)
    assert not any(r.predicted for r in found if r.doc_id is None or r.doc_id >= 2000)
    assert len({r.score for r in found if r.doc_id in (2000, 2001, 2002)}) == 1
    assert not any(r.predicted for r in toxicity(docs, known.limit(0)).collect())
    assert toxicity(none, known).collect() == []


def test_toxicity_of_long_texts(spark):
    """Insults count as often as they are said, also in texts of 20,000 words, and long labelled texts are trained on."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(6000)]
    insults = ["vilify" + end for end in ("", "s", "ed", "ing")]
    rows, labels = [], []
    for k in range(360):
        w, toxic = rng.choices(words, k=rng.choice((40, 400, 1500, 2500))), k % 3 == 0
        for _ in range(len(w) // 25 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(insults)
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    for k, share in ((1000, 0), (1001, 25)):
        w = rng.choices(words, k=20_000)
        for _ in range(20_000 // share if share else 0):
            w[rng.randrange(len(w))] = rng.choice(insults)
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # labels of absent documents take no places, long documents do
    known = spark.createDataFrame([*labels, *[(5000 + k, k % 2) for k in range(4000)]], "doc_id long, toxic int")
    sample = training_rows(docs, known)
    assert {r.doc_id for r in sample.collect()} == {k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1}
    found = {r.doc_id: r.predicted for r in toxicity(docs, known).collect()}
    assert found[1001] == 1 and found[1000] == 0
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(found[k] == labels[k][1] for k in held) > 0.95 * len(held)


def test_license_scan(spark, none):
    notice = "This work is licensed under the GNU General Public License, version 3."
    grant = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    edited = notice.replace("version 3", "version 2")
    rows = [(1, "a b " * 500 + notice + " c d" * 900), (2, None), (3, ""), (4, "Released under\nthe  MIT License."), (5, edited), (6, "x " * 37 + grant + " y" * 21), (7, "licensed under the"), (8, "plain words " * 50), (4, "Released under\nthe  MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h", "s", "one", "words", "m")})
    found = bag((r.doc_id, r.template, r.n_shared) for r in license_scan(docs).collect())
    n = len(shingles_of(notice))
    assert found == bag([(1, "GPL-3.0", n), (4, "MIT", 1), (4, "MIT", 1), (5, "GPL-3.0", n - 1), (6, "BSD-grant", len(shingles_of(grant)))])
    assert license_scan(none).collect() == []


def test_license_scan_at_every_offset(spark):
    """Long notices with changed words, at all eight offsets to the windows, against brute force over all regions."""
    rng = random.Random(8)
    long = [t for t in TEMPLATES.values() if len(shingles_of(t)) > 8]
    assert min(len(shingles_of(t)) for t in long) == 10
    rows = []
    for text in long:
        n = len(text.split())
        edits = [{k} for k in range(n)] + [set(rng.sample(range(n), 2)) for _ in range(20)] + [set()]
        for offset in range(8):
            for edit in 2 * edits:
                words = [f"edit{rng.randrange(10**6)}" if k in edit else w for k, w in enumerate(text.split())]
                before, after = ([f"w{rng.randrange(10**6)}" for _ in range(size)] for size in (8 * rng.randrange(4) + offset, rng.randrange(30)))
                rows.append((len(rows), " ".join([*before, *words, *after])))
    expected = []
    for id_, text in rows:
        own = shingles_of(text)
        for name, template in TEMPLATES.items():
            want = set(shingles_of(template))
            n = len(want)
            most = max(len(want & set(own[k : k + 2 * n])) for k in range(0, len(own), n))
            if 5 * most >= 4 * n:
                expected.append((id_, name, most))
    assert len(expected) > 1500
    found = license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert bag((r.doc_id, r.template, r.n_shared) for r in found.collect()) == bag(expected)


def test_sharding(spark, docs, rows, none, tmp_path):
    whole = shard(docs, str(tmp_path / "a"), arrivals=8)
    assert bag((r.doc_id, r.text) for r in whole.collect()) == bag(rows) and set(CLASH) < set(whole.columns)
    assert shard(none, str(tmp_path / "b")).collect() == []
    clash = stored(docs.withColumns({"run": F.lit("own run"), "_arrival": F.lit("own")}), "clash")
    whole = shard(clash, str(tmp_path / "d"))
    assert set(whole.columns) == {*docs.columns, "run", "_arrival", "_run"} and whole.where("run = 'own run' and _arrival = 'own' and _run like 'a%'").count() == len(rows)
    store = ShardStore(spark, str(tmp_path / "c"))
    for k in range(9):
        store.append(spark.range(100).withColumn("batch", F.lit(k)), "batch")
    assert [r["name"] for r in store.runs()] == ["a0000-a0003", "a0004-a0007", "a0008"]
    assert store.read().count() == 900 and store.read(1).count() == 100
    with pytest.raises(CommitConflict):
        store.commit(1, [])
    store.vacuum()
    assert store.read().count() == 900 and len(store.versions()) == 1
    # two writers merge the same tier: the second takes the first one's runs and leaves no files
    other, mine = ShardStore(spark, str(tmp_path / "e")), ShardStore(spark, str(tmp_path / "e"))
    mine.compact = lambda: None
    for k in range(4):
        mine.append(spark.range(10).withColumn("batch", F.lit(k)), "batch")
    change = mine._change

    def late(edit):
        mine._change = change
        other.compact()
        return change(edit)

    mine._change = late
    ShardStore.compact(mine)
    assert len(mine.runs()) == 1 and mine.read().count() == 40


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(40, 30), (50, 50)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {**{k: 0 for k in range(21)}, 30: 30, 40: 30}


def test_license_scan_of_edited_notices(spark):
    """Long notices with words changed, at every offset: what has four fifths of the shingles is found, nothing else, as by brute force."""
    rng, rows = random.Random(4), []
    long = {n: t for n, t in TEMPLATES.items() if len(shingles_of(t)) > 8}
    for k in range(400):
        name = rng.choice(sorted(long))
        words = re.findall("[A-Za-z0-9]+", long[name])
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(["filler"] * (k % 8) + ["begin"] + words + ["end"] * 3)))
    expected = set()
    for k, text in rows:
        own = shingles_of(text)
        for name, template in TEMPLATES.items():
            wanted = set(shingles_of(template))
            n = len(wanted)
            if any(5 * len(wanted & set(own[r : r + 2 * n])) >= 4 * n for r in range(0, max(1, len(own)), n)):
                expected.add((k, name))
    found = {(r.doc_id, r.template) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= expected and len(found) >= 0.97 * len(expected)

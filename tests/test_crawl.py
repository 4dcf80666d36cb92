"""Frontier expansion, the ordered fold, learned pieces and near titles against brute force."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marquee.functions.automaton import first_piece
from marquee.operators.frontier import expand
from marquee.operators.near_titles import near_titles
from marquee.operators.store import collapse_prefixes
from marquee.plans import registry
from marquee.streaming.jobs import learned_pieces


@pytest.mark.parametrize(("seed", "width", "length"), [(1, 3, 6), (2, 2, 9), (3, 12, 30)])
def test_fold_in_rounds_is_the_fold_in_order(spark, seed, width, length):
    rng = random.Random(seed)
    rows = [(k, "u", f"c{k % 3}", "".join(rng.choices("ab c", k=rng.randint(0, length)))) for k in range(240)] + [(900, "u", "c0", None), (901, None, None, "aaa"), (902, None, None, "aaa")]
    expected, stay = [], {}
    for k, u, c, title in rows:
        if u is None:
            continue
        held = stay.setdefault(c, [])
        if not title or not any(title[:width] in t or t[:width] in title for t in held):
            expected.append(k)
            if title:
                held.append(title)
    found = collapse_prefixes(spark.createDataFrame(rows, "ord long, university string, college string, title string").where("university is not null"), width)
    assert sorted(r.ord for r in found.collect()) == expected


def crawl(seeds, pages, links, budget, width, depth):
    out = []
    for seed, home in seeds:
        asked, visited = [home], []
        for level in range(depth + 1):
            first, live = None, []
            for place, url in enumerate(asked, 1):
                ok, is_list, is_detail = pages.get(url, (False, False, False))
                counts = ok and first is None
                out.append((seed, url, level, place, ok, is_list and counts, is_detail and counts))
                visited.append(url)
                if ok:
                    live.append((place, url))
                if counts and is_list:
                    first = place
            best = {}
            for place, url in live:
                for at, position, target, score in links:
                    if at == url and score > 0 and target not in visited:
                        best[target] = min(best.get(target, (0, 0, 0)), (-score, place, position))
            if first is not None:
                break
            asked = [t for _, t in sorted((v, t) for t, v in best.items())][: min(width, budget - len(visited))]
    return sorted(out)


@pytest.mark.parametrize(("budget", "width", "depth"), [(5, 3, 1), (5, 3, 4), (12, 2, 5), (1, 3, 3)])
def test_expand(spark, budget, width, depth):
    rng = random.Random(budget * 10 + depth)
    pages = {u: (rng.random() < 0.8, rng.random() < 0.15, rng.random() < 0.3) for u in range(40)}
    links = list({(a, k): (a, k, rng.randint(0, 45), rng.randint(0, 3)) for a in range(40) for k in range(rng.randint(0, 6))}.values())
    seeds = [(f"s{k}", rng.randint(0, 45)) for k in range(25)]
    found = expand(
        spark.createDataFrame(seeds, "seed string, url long"), spark.createDataFrame([(u, *v) for u, v in pages.items()], "url long, ok boolean, is_list boolean, is_detail boolean"),
        spark.createDataFrame(links, "url long, position int, target long, score int"), budget, width, depth,
    )
    assert sorted(map(tuple, found.collect())) == crawl(seeds, pages, links, budget, width, depth)
    most = Counter(r[0] for r in found.collect())
    assert max(most.values()) <= max(1, budget)


def similar(rows, threshold=0.88):
    by, out = {}, set()
    for key, title in rows:
        if title is not None:
            by.setdefault(key, set()).add(title)
    for key, titles in by.items():
        for a in titles:
            for b in titles:
                if a < b and (ratio := SequenceMatcher(None, a, b, autojunk=False).ratio()) >= threshold:
                    out.add((key, a, b, round(ratio, 6)))
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.88, 0.95])
def test_near_titles(spark, threshold):
    rng = random.Random(7)
    rows = [(1, None), (1, ""), (1, "a"), (1, "aa"), (1, "aaa"), (1, "aaaa"), (1, "ab" * 20), (1, "ab" * 21), (2, "a" * 40), (2, "a" * 41), (2, "a" * 48)]
    for k in range(60):
        base = "".join(rng.choices("abcdefé ", k=rng.randint(3, 48)))
        for _ in range(4):
            edit = list(base)
            for _ in range(rng.randint(0, 5)):
                edit[rng.randrange(len(edit))] = rng.choice(["", "x", "ab", "q"])
            rows.append((k % 3, "".join(edit)))
    found = near_titles(spark.createDataFrame(rows, "board int, title string"), ["board"], threshold)
    assert {(r.board, r.title, r.other, round(r.ratio, 6)) for r in found.collect()} == similar(rows, threshold)


def test_near_title_queries(spark):
    sf = "/root/testdata/sf0.001"
    from marquee.sources.tables import notices

    titles = {((r.university, r.college), r.title) for r in notices(spark, sf).collect()}
    found = registry.QUERIES["str_07_similarity"](spark, sf).collect()
    assert found and {((r.university, r.college), r.title, r.other, r.ratio) for r in found} == similar(titles)
    import re

    titles = {(r.source, re.sub(r"\s+", "", re.sub(r"20\d{2}", "", r.text))[:48]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = registry.QUERIES["str_07_document_titles"](spark, sf).collect()
    assert {(r.source, r.title, r.other, r.ratio) for r in found} == similar(titles)


def test_first_piece(spark):
    pieces = ["she", "", "he", "hers", "he", "é日", "x" * 30]
    texts = ["ushers", "", None, "the", "日é日", "y" + "x" * 31, "her she"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    for held in (pieces, [], [""]):
        assert [r[0] for r in rows.select(first_piece(F.col("t"), held)).collect()] == [next((k for k, p in enumerate(held) if p and p in (t or "")), None) for t in texts]


def test_learned_pieces_in_order(spark):
    """The rules after each run are those of one pass over its rows in order."""
    rng = random.Random(9)
    heads = ["".join(rng.choices("abcdef", k=16)) for _ in range(4)]
    rows = [(k, rng.choice(heads) + rng.choice(["", "zzzzzzzz", "yyyyyyyyy", "zzzzzzzzq", str(k)]), rng.choice(["bad", "fine"]), "text " + rng.choice(heads) + rng.choice(["", "zzzzzzzz", " bad"]), k % 2 == 0) for k in range(120)] + [(200, "abc", "", "abc", True), (201, None, None, None, True)]
    frame = spark.createDataFrame(rows, "id long, title string, snippet string, text string, taught boolean")
    found = {r.id: (r.part, r.rejected) for r in learned_pieces(spark, [frame.where(f"id % 3 = {k}") for k in range(3)], ("bad",)).collect()}
    pieces, sigs, expected = set(), set(), {}
    for part in range(3):
        mine = [r for r in rows if r[0] % 3 == part]
        for i, _, _, text, _ in mine:
            expected[i] = (part, any(p in (text or "") for p in pieces))
        for i, title, snippet, _, teaches in mine:
            title, snippet = title or "", snippet or ""
            if teaches and title[:40] not in sigs:
                sigs.add(title[:40])
                for piece in (title[:24], title[:16]):
                    if len(piece) >= 6 and piece not in pieces:
                        pieces.add(piece)
                        break
                if "bad" in title or "bad" in snippet:
                    pieces.add("bad")
    assert found == expected and any(v for _, v in found.values())

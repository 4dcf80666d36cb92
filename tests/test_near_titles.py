"""Titles that share pairs of letters without being similar are ruled out before they become pairs."""

import random
from difflib import SequenceMatcher

import pytest

from marquee.operators import near_titles as module

from .test_crawl import similar


def test_unlike_titles_are_no_pairs(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for _ in range(150):
        title = "".join(rng.choice(["an", "the", "ing", "tion", "ou", "er"]) for _ in range(30))[:48]
        rows += [(0, title), (0, title[:20] + "x" + title[21:])]
    made, kept = {}, module.kept
    monkeypatch.setattr(module, "kept", lambda df, name: made.setdefault(name, kept(df, name)))
    monkeypatch.setattr(module, "BLOCK", 20)
    found = module.near_titles(spark.createDataFrame(rows, "board int, title string"), ["board"]).collect()
    assert {(r.board, r.title, r.other, round(r.ratio, 6)) for r in found} == similar(set(rows))
    assert made["near-pairs"].count() < len(rows) * len(rows) // 20  # a tenth of all pairs


def test_titles_are_not_dealt_by_their_letters(spark, monkeypatch):
    """Titles of the commonest letters meet in blocks, each pair once; what leaves the groups is similar."""
    rng = random.Random(11)
    rows = [(k % 2, "".join(rng.choices("abc", [8, 1, 1], k=rng.randint(30, 48)))) for k in range(120)] + [(None, "aaaa"), (None, "aaaab"), (3, "\U0001f600" * 20), (3, "\U0001f600" * 21), (3, "")]
    made, kept = {}, module.kept
    monkeypatch.setattr(module, "kept", lambda df, name: made.setdefault(name, kept(df, name)))
    monkeypatch.setattr(module, "BLOCK", 25)
    found = module.near_titles(spark.createDataFrame(rows, "board int, title string"), ["board"]).collect()
    assert {(r.board, r.title, r.other, round(r.ratio, 6)) for r in found} == similar({r for r in rows if r[0] is not None}) and len(found) == len(set(found)) > 1
    assert "near-tokens" not in made and made["near-pairs"].count() == len(found)


def test_blocks_of_many_pairs_are_those_of_difflib():
    blocks = pytest.importorskip("marquee.functions.blocks")
    rng, pairs = random.Random(1), [("", ""), ("", "a"), ("ab" * 200, "ba" * 190), ("\U0001f600a", "a\U0001f600a"), ("￿￾", "￿￾b")]
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefgh é日"])
        a = "".join(rng.choices(letters, k=rng.randint(0, 48)))
        b = list(a if rng.random() < 0.7 else rng.choices(letters, k=rng.randint(0, 48)))
        for _ in range(rng.randint(0, 6)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(["", "q", "ab", "a"])
        pairs.append((a, "".join(b)) if rng.random() < 0.5 else ("".join(b), a))
    for some in (pairs, pairs[5:]):
        (a, n), (b, m) = (blocks.coded([p[k] for p in some]) for k in (0, 1))
        assert blocks.matched(a, b, n, m).tolist() == [sum(s.size for s in SequenceMatcher(None, *p, autojunk=False).get_matching_blocks()) for p in some]

"""Large groups of near copies that link with some of each other only."""

import random

import pytest

from marquee.llm import jaccard_join
from marquee.llm.jaccard_join import shingles


def near_copies(n: int) -> list[tuple[int, str]]:
    """Copies with three words of their own each: two are similar if a place of these is the same, and nearly so if not."""
    rng, rows = random.Random(7), []
    for k in range(n):
        words = [f"w{i}" for i in range(229)]
        for place in rng.sample(range(2, 229, 4), 3):
            words[place] = f"x{k}y{place}"
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("n", [300])
def test_pairs_of_a_group_stay_few(spark, monkeypatch, n):
    made, stored = {}, jaccard_join.stored

    def counted(df, name):
        out = stored(df, name)
        if name in ("bucket-pairs", "crossing-pairs"):
            made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    rows = near_copies(n)
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, least = [set(shingles(text).tolist()) for _, text in rows], list(range(n))
    for _ in range(n):
        before = list(least)
        for a in range(n):
            for b in range(a):
                if least[a] != least[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    assert found == dict(enumerate(least))
    assert sum(made.values()) < 8 * n


def least_reachable(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets, least = {k: set(shingles(text).tolist()) for k, text in rows}, {k: k for k, _ in rows}
    links = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_closed_lists_do_not_come_back(spark, monkeypatch):
    """Lists of one component, or in which nobody looks up, are not labelled again in each round, and no list takes parities along there."""
    made, stored = {"labelled-lists": [], "open-lists": []}, jaccard_join.stored

    def counted(df, name):
        out = stored(df, name)
        if name in made:
            keys = out.groupBy("key").agg({"index": "max"}).where("not `max(index)`")
            made[name].append((out.count(), keys.count(), [c for c in out.columns if c.startswith("p") and c != "place"]))
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    rows = near_copies(60)
    for k in range(150):
        words = [f"c{k}w{i}" for i in range(80)]
        rows += [(1000 + k, " ".join(words)), (2000 + k, " ".join(words[:-1] + ["end"]))]
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == least_reachable(rows)
    first, *later = made["labelled-lists"]
    assert later and all(2 * n < first[0] for n, _, _ in later)
    assert all(unasked == 0 for tables in made.values() for _, unasked, _ in tables)
    assert all(not signs for tables in made.values() for _, _, signs in tables)

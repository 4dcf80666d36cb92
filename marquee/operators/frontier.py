"""Bounded best-first expansion of a link graph, for all seeds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.versions import kept
from .store import first_per_key


def expand(seeds: DataFrame, pages: DataFrame, links: DataFrame, budget: int = 5, width: int = 3, depth: int = 1) -> DataFrame:
    """seed, url, level, place, ok, is_list, is_detail: what each seed's crawl asks for, in the order in which it does.

    ``seeds`` has seed and url (its home page), ``pages`` url, ok, is_list and is_detail, ``links`` url, position, target
    and score. A request for a page that is missing or not ok counts against the budget all the same. A level asks for the
    best targets of the pages that the level before got: highest score, then the earlier page, then the earlier link; at
    most ``width``, and what is left of ``budget``; never a target without a score or one that was asked for before. A
    seed is done at the level at which it meets a list page; pages that come after that one in the level don't count
    (``place`` stays, is_list and is_detail are false).

    Each level is one join of the frontier of all seeds with the links, and a stored table. A seed has at most ``budget``
    requests, so rows that meet in one window are the links of at most ``width`` pages.
    """
    asked = seeds.select("seed", "url", F.lit(0).alias("level"), F.lit(1).alias("place"))
    visited, levels = None, []
    for level in range(depth + 1):
        got = asked.join(pages.select("url", "ok", "is_list", "is_detail"), "url", "left").select("seed", "url", "level", "place", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("ok", "is_list", "is_detail")])
        got = kept(got, f"frontier-{level}")
        first = got.where("ok and is_list").groupBy("seed").agg(F.min("place").alias("first"))
        counted = F.col("ok") & (F.col("place") <= F.coalesce("first", F.col("place")))
        levels.append(got.join(first, "seed", "left").select("seed", "url", "level", "place", "ok", *[(F.col(c) & counted).alias(c) for c in ("is_list", "is_detail")]))
        visited = got.select("seed", "url") if visited is None else visited.unionByName(got.select("seed", "url"))
        if level == depth:
            break
        left = visited.groupBy("seed").agg((F.lit(budget) - F.count(F.lit(1))).alias("left"))
        live = got.where("ok").join(first, "seed", "left_anti").select("seed", "url", F.col("place").alias("of"))
        found = live.join(links.where("score > 0"), "url").select("seed", F.col("target").alias("url"), "score", "of", "position")
        found = first_per_key(found.join(visited, ["seed", "url"], "left_anti"), ["seed", "url"], [F.desc("score"), "of", "position"])
        ranked = found.withColumn("place", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("score"), "of", "position")))
        asked = ranked.join(left, "seed").where((F.col("place") <= width) & (F.col("place") <= F.col("left"))).select("seed", "url", F.lit(level + 1).alias("level"), "place")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out

"""Better pages for notices, looked for in ranked waves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.versions import kept


def relocate(items: DataFrame, candidates: DataFrame, pages: DataFrame, most: int = 4) -> DataFrame:
    """id, url, deadline, wave: the first candidate page of each item that is better than what it has; items without one are absent.

    ``items`` has id and url, ``candidates`` id, position, url, usable, score and snippet_deadline, ``pages`` url, deadline
    and page_score. The ``most`` best candidates with a score of at least 0 are tried, the earlier position first on ties;
    the item's own url, one that was tried before and one that is not usable use up their place. A page is taken if it
    has a deadline, or scores no less than its candidate did; else the candidate's snippet is taken if it has a deadline.

    Wave k joins the candidates at place k of the items that are still open with the pages, so pages that nobody needs
    are not read into it; an item has one candidate a wave.
    """
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "position"))
    ranked = candidates.where("score >= 0").withColumn("place", place).where(F.col("place") <= most)
    again = F.row_number().over(W.partitionBy("id", "url").orderBy("place")) > 1
    ranked = kept(ranked.withColumn("again", again).where("usable and not again").select("id", "place", "url", "score", "snippet_deadline"), "ranked-candidates")
    open_items, found = items.select("id", F.col("url").alias("own")), None
    for wave in range(1, most + 1):
        asked = ranked.where(F.col("place") == wave).join(open_items, "id").where("url <> own")
        tried = asked.join(pages.select("url", "deadline", "page_score"), "url", "left")
        better = F.col("deadline").isNotNull() | (F.col("page_score") >= F.col("score"))
        taken = tried.where(F.coalesce(better, F.lit(False)) | F.col("snippet_deadline").isNotNull())
        taken = kept(taken.select("id", "url", F.when(F.coalesce(better, F.lit(False)), F.col("deadline")).otherwise(F.col("snippet_deadline")).alias("deadline"), F.lit(wave).alias("wave")), f"wave-{wave}")
        found = taken if found is None else found.unionByName(taken)
        open_items = open_items.join(taken.select("id"), "id", "left_anti")
    return found

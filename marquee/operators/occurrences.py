"""Which of many strings stand in which of many texts, as equi-joins on rare substrings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import kept

#: Needles of a key that every text of the key is compared with; looking for one costs less than dealing a text's substrings.
FEW = 64


def grams(text: Column, size: Column) -> Column:
    """Distinct substrings of that length."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def occurrences(needles: DataFrame, texts: DataFrame, name: str, key: Sequence[str] = (), gram: int = 8, few: int = FEW) -> DataFrame:
    """name, key, needle: the needles that stand anywhere in the texts of their key.

    ``needles`` has the key and ``needle``, ``texts`` the key, ``name`` and ``text``. A needle is looked up by the rarest of
    its substrings of ``gram`` characters (a shorter one by itself), and only texts that share it are compared. Where no key
    has more than ``few`` needles, all of a key's are looked for in each of its texts instead. Null and empty needles stand
    nowhere, null texts hold nothing.
    """
    key = list(key)
    asked = kept(needles.where("needle <> ''").select(*key, "needle").distinct(), "needles")
    if (asked.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= few:
        pairs = texts.join(asked, key) if key else texts.crossJoin(F.broadcast(asked))
        return pairs.where(F.col("text").contains(F.col("needle"))).select(name, *key, "needle")
    asked = asked.withColumn("size", F.least(F.length("needle"), F.lit(gram)))
    parts = asked.select(*key, "needle", F.explode(grams(F.col("needle"), F.col("size"))).alias("gram"))
    sizes = asked.select("size").distinct()  # at most ``gram`` rows
    every = texts.join(F.broadcast(sizes), F.length("text") >= F.col("size")).select(name, *key, "text", F.explode(grams(F.col("text"), F.col("size"))).alias("gram"))
    shared = every.join(parts.select(*key, "gram").distinct(), [*key, "gram"], "left_semi")
    common = shared.groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = parts.join(common, [*key, "gram"], "left").groupBy(*key, "needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return shared.join(rarest, [*key, "gram"]).where(F.col("text").contains(F.col("needle"))).select(name, *key, "needle")

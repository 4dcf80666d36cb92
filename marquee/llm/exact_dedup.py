"""Exact dedup by deterministic block naming, in DataFrame functions only.

A normalised text is cut into blocks of a fixed number of code points. Equal blocks are brought together by sorting and
get one integer name, the smallest occurrence number among them; then adjacent pairs of names are named in the same way,
again and again, until one name is left for each document. Names are never hashes: two documents have the same number
of blocks and the same last name exactly if their normalised texts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import shuffle_partitions, stored

WHITE = r"[\x20\x09-\x0D]+"


def _named(rows: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Replace ``keys`` by ``name``; ``at`` is a struct whose first field is the occurrence number.

    Equal keys first meet within one of ``salts`` salts, then the (at most ``salts``) local names of a key meet, so no
    task gets all occurrences of a frequent key. Both branches read the whole struct: one exchange serves both.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("at.occ"), F.lit(salts)))
    local = salted.withColumn("first", F.min("at").over(W.partitionBy(*keys, "salt")))
    names = (
        local.where(F.col("at") == F.col("first"))
        .select(*keys, F.col("first.occ").alias("local"))
        .withColumn("name", F.min("local").over(W.partitionBy(*keys)))
        .select("local", "name")
    )
    return local.select("at", F.col("first.occ").alias("local")).join(names, "local").select("at.*", "name")


def block_names(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """One row per block: row, pos, occ, name, blocks (of the document); id, chars and sha with the first block only."""
    raw = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("raw"),
    ).select("row", "id", F.length("raw").alias("chars"), F.regexp_replace("raw", WHITE, "").alias("norm"))
    cut = raw.select(
        "row",
        "id",
        "chars",
        F.sha2("norm", 256).alias("sha"),
        F.when(F.col("norm") == "", F.array(F.lit("")))
        .otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
        .alias("parts"),
    ).select("*", F.size("parts").alias("blocks"), F.posexplode("parts").alias("pos", "part"))

    def first(c: str) -> Column:
        return F.when(F.col("pos") == 0, F.col(c)).alias(c)

    at = F.struct(F.monotonically_increasing_id().alias("occ"), "row", "pos", "blocks", first("id"), first("chars"), first("sha"))
    return _named(cut.select("part", at.alias("at")), ["part"], shuffle_partitions(docs.sparkSession))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """One row per document: row, id, chars, sha, blocks, name."""
    names = stored(block_names(docs, id_col, text_col, block), "block-names")
    most = names.agg(F.max("blocks")).first()[0] or 1
    columns, done, width = ["row", "id", "chars", "sha", "blocks", "name"], None, 1
    while True:
        whole = names.where(F.col("blocks") <= width).select(*columns)
        done = whole if done is None else done.union(whole)
        if width >= most:
            return done
        pairs = (
            names.where(F.col("blocks") > width)
            .groupBy("row", F.shiftright("pos", 1).alias("pair"))
            .agg(F.min(F.struct("pos", "name", "occ", "blocks", "id", "chars", "sha")).alias("l"), F.max(F.struct("pos", "name")).alias("r"))
            .select(
                F.col("l.name").alias("left"),
                F.when(F.col("r.pos") > F.col("l.pos"), F.col("r.name")).otherwise(F.lit(-1)).alias("right"),
                F.struct("l.occ", "row", F.col("pair").alias("pos"), "l.blocks", "l.id", "l.chars", "l.sha").alias("at"),
            )
        )
        names = stored(_named(pairs, ["left", "right"], shuffle_partitions(docs.sparkSession)), "pair-names")
        width *= 2


def with_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """``exact_dedup`` with the number of each row, as monotonically_increasing_id gives it for ``docs``."""
    ids = identities(docs, id_col, text_col, block)
    best = F.struct((-F.col("chars")).alias("fewer"), F.col("id").isNull().alias("none"), "id", "row")
    groups = stored(ids.groupBy("blocks", "name").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")), "identity-groups")
    return ids.join(groups, ["blocks", "name"]).select(
        "row", F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space. Of equal texts the one with the most code points
    stays, then the smallest id (null ids last), then the first row. A null text counts as empty, and all empty texts
    are equal. Repeated rows, also with the same id, are rows of one group of which one is kept. An empty table gives an
    empty result. Other columns are ignored, whatever their names. The input must be a plain scan or a stored table,
    since rows are numbered in their partitions.
    """
    return with_groups(docs, id_col, text_col, block).drop("row")

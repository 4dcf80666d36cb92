"""Cleaning of a training corpus in five stages, each one operator over all rows that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.decontaminate import decontaminate
from marquee.llm.exact_dedup import with_groups
from marquee.llm.jaccard_join import representatives
from marquee.llm.queries import piece_model, table
from marquee.llm.scratch import steady, stored
from marquee.llm.sentencepiece_codec import encode_decode
from marquee.llm.toxicity import toxicity


def _free(docs: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` with these row numbers."""
    number = _free(docs, "row")
    return docs.withColumn(number, F.monotonically_increasing_id()).join(rows.select(F.col("row").alias(number)), number).drop(number)


def _passed(docs: DataFrame, decide: Callable[[DataFrame, tuple[str, ...]], DataFrame], verdict: str) -> DataFrame:
    """The rows for which ``verdict`` holds after ``decide``; columns of any name come through, since they ride in one struct."""
    whole = _free(docs, "whole")
    rest = [c for c in docs.columns if c != "text"]
    carried = docs.select(F.col("doc_id"), F.col("text"), F.struct(*rest).alias(whole))
    found = decide(carried, (whole, "text")).where(verdict)
    return found.select(*[F.col("text") if c == "text" else F.col(f"`{whole}`.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject. Null and empty texts have a score too; repeated rows and ids are judged alike; an empty table stays empty."""
    return _passed(docs, lambda d, keep: toxicity(d, table(spark, sf_dir, "labels"), keep=keep), "predicted = 0")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts without white space: the longest, then the smallest id (null last), then the first row. Null texts count as empty and so as equal."""
    docs = steady(docs)
    return _rows(docs, with_groups(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts, the smallest id (null last); null texts and texts without words are like no others and all stay."""
    docs = steady(docs)
    return _rows(docs, representatives(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark. Null and empty texts have none and stay; an empty benchmark keeps all rows."""
    return _passed(docs, lambda d, keep: decontaminate(d, table(spark, sf_dir, "benchmark"), keep=keep), "not contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text of every row, in columns of the operator's own; null texts are empty."""
    return encode_decode(docs, piece_model(), keep=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

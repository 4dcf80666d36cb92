"""The daily job: what arrives goes into notices, coverage, pending targets and the log under one version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import store as S
from ..sources.versions import TableSet, fresh


def job(tables: TableSet, targets: DataFrame, at: Column) -> Callable[[DataFrame, int], None]:
    """The work of one micro-batch of arrivals (columns of notices, ord, rejected). Nothing of it is seen unless all of it is."""
    spark = tables.spark

    def run(batch: DataFrame, number: int) -> None:
        found = batch.where("not rejected").drop("rejected")
        stored = tables.read("notices", before=number)
        stored = spark.createDataFrame([], found.drop("ord").schema) if stored is None else stored.drop("change")
        keys = ["university", "college", "college_type"]

        def coverage(read):
            return S.coverage_upsert(read("notices").withColumn("slot", C.slot()).select(*S.KEY, F.col("id").alias("announcement_id"), F.col("updated_at").alias("touched_at")))

        def log(read):
            counts = read("notices").agg(F.count_if(F.col("change") == "inserted").alias("new"), F.count_if(F.col("change") == "updated").alias("updated"))
            one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
            for df, name in ((found, "found"), (read("coverage"), "covered"), (read("pending"), "pending")):
                counts = counts.join(one(df, name), F.lit(True), "left")
            row = counts.select(F.lit(number).cast("long").alias("batch"), "found", "new", "updated", "covered", "pending")
            before = tables.read("log", before=number)
            return row if before is None else before.unionByName(row)

        tables.commit(number, {
            "notices": lambda read: S.upsert_notices(stored, found, at),
            "coverage": coverage,
            "pending": lambda read: targets.join(read("coverage").select(*keys).distinct(), keys, "left_anti"),
            "log": log,
        })

    return run


def daily_runs(spark: SparkSession, parts: list[DataFrame], targets: DataFrame, at: Column) -> TableSet:
    """One scheduled run for each part that has arrived; the tables after all of them."""
    inbox, root = fresh(spark, "daily-inbox"), fresh(spark, "daily-tables")
    tables = TableSet(spark, root)
    for part in parts:
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(part.schema).parquet(inbox)
        stream.writeStream.foreachBatch(job(tables, targets, at)).option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return tables

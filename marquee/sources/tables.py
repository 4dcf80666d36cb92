"""Source tables, and the announcement tables that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys over all tasks: a few packed files are read by a few tasks, too few for work that is heavy for each row."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notice per order. Nation is a dimension of 25 rows; customers join by their key."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    base = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    day = lambda days: f"date_format(o_orderdate + INTERVAL {days} DAY, 'yyyy-MM-dd')"
    return base.selectExpr(
        "o_orderkey AS id",
        "concat(n_name, ' ', c_mktsegment, ' ', cast(year(o_orderdate) + 28 AS string), CASE WHEN o_orderkey % 5 <> 0 THEN ' recruitment notice' ELSE ' result list' END) AS title",
        "concat('https://n', n_nationkey, '.example.org/info/', o_custkey, '/', o_orderkey, '.htm') AS url",
        "n_name AS university",
        "c_mktsegment AS college",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'law' ELSE 'foreign_lang' END AS college_type",
        "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'ended' ELSE 'excellent_list' END AS status",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'pre' ELSE 'camp' END AS event_type",
        f"CASE WHEN o_orderkey % 7 <> 0 THEN {day(-30)} END AS publish_date",
        f"CASE o_orderkey % 6 WHEN 0 THEN concat({day(20)}, ' 18:30:00') WHEN 1 THEN concat({day(20)}, ' 09:15') WHEN 2 THEN {day(20)} WHEN 3 THEN date_format(o_orderdate + INTERVAL 20 DAY, 'y-M-d') WHEN 4 THEN 'late July' END AS deadline",
        f"CASE WHEN o_orderkey % 3 <> 0 THEN {day(40)} END AS event_time",
        "CASE WHEN o_orderkey % 11 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'offline' ELSE 'both' END END AS event_format",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN ' ' WHEN '2' THEN 'search' WHEN '3' THEN 'forum/law' WHEN '4' THEN 'my WeiXin feed' ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'manual entry' ELSE 'submit form' END END AS source",
        "CASE WHEN o_orderkey % 13 <> 0 THEN concat('summary of ', o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '\n---more---\nquota: 5' ELSE '' END) END AS summary",
        "o_orderdate AS created_at",
        "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 1000) AS updated_at",
    )


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).selectExpr(
        "c_custkey AS ord", "n_name AS university", "c_mktsegment AS college", "CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'law' ELSE 'foreign_lang' END AS college_type",
        "n_name AS province", "r_name AS region", "CASE c_custkey % 4 WHEN 0 THEN array('985', '211', 'dual') WHEN 1 THEN array('211', 'dual') WHEN 2 THEN array('dual') ELSE array() END AS tags",
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    base = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_nationkey", "n_name", "c_mktsegment").agg(F.min("c_custkey").alias("ord"))
    return base.selectExpr(
        "ord", "n_name AS university", "c_mktsegment AS college", "CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'law' ELSE 'foreign_lang' END AS college_type",
        "CASE WHEN n_nationkey % 9 = 0 THEN '' ELSE concat('https://n', n_nationkey, '.example.org') END AS base_url",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "CASE WHEN user_id % 2 = 0 THEN 'summer_camp' ELSE 'pre_admission' END AS board", "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' ELSE 'success' END AS status",
        "ts AS started_at", "CASE WHEN event_type <> 'signup' THEN ts + make_dt_interval(0, 0, 0, cast(floor(value) AS int)) END AS finished_at",
        "CASE WHEN event_type = 'click' THEN cast(floor(value) AS bigint) ELSE 0 END AS found",
    )


def fail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id AS ann_id", "CASE WHEN event_type IN ('click', 'error') THEN 'fail' WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'signup' THEN 'clear' ELSE 'fail' END AS op",
        "CASE WHEN event_type = 'error' THEN 'no_content' WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'http' END AS failure_type",
    )


def forum_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads: the first turn's first 60 characters are the title, all turns in order the text."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return turns.select("conv_id", F.substring(F.col("turns")[0]["text"], 1, 60).alias("title"), F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("text"))

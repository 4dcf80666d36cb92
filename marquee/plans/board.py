"""Read side: board listings, statistics, directory, filters and orders of notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.rules import CATEGORIES
from ..functions.temporal import as_of, parse_datetime
from ..sources.tables import directory, fail_events, notices, read, runs, targets
from .ctes import DIRECTORY, FAILS, NOTICES, RUNS, TARGETS, sql

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).withColumns({"effective": C.effective_status(as_of()), "category": C.canonical_source(), "slot": C.slot()})


@query("board_active", sql("SELECT id, title, url, university, college, college_type, effective AS status, deadline, category AS source FROM labelled WHERE slot LIKE 'camp%' AND effective = 'active'", NOTICES))
def board_active(spark, sf_dir):
    """Active camp notices; statuses and sources as they are shown. Deadline order is sort_02."""
    rows = listed(spark, sf_dir).where(F.col("slot").startswith("camp") & (F.col("effective") == "active"))
    return rows.select("id", "title", "url", "university", "college", "college_type", F.col("effective").alias("status"), "deadline", F.col("category").alias("source"))


@query("src_01_notice_scan", sql("SELECT university, college_type, count(*) AS n FROM notices GROUP BY ALL", NOTICES))
def src_01(spark, sf_dir):
    return notices(spark, sf_dir).groupBy("university", "college_type").agg(F.count(F.lit(1)).alias("n"))


@query("src_02_keyed_scan", sql("SELECT t.university, t.college, n.id, n.url FROM targets t JOIN notices n USING (university, college) WHERE t.college_type = 'law' AND n.status IN ('active', 'ended')", NOTICES, TARGETS))
def src_02(spark, sf_dir):
    keys = targets(spark, sf_dir).where("college_type = 'law'").select("university", "college")
    return notices(spark, sf_dir).where(F.col("status").isin("active", "ended")).join(keys, ["university", "college"]).select("university", "college", "id", "url")


@query("proj_01_output_view", sql("SELECT id, title, url, university, college, college_type, effective AS status, event_type, publish_date, deadline, event_time, event_format, category AS source, category AS source_category, summary, slot FROM labelled", NOTICES))
def proj_01(spark, sf_dir):
    columns = ["id", "title", "url", "university", "college", "college_type", F.col("effective").alias("status"), "event_type", "publish_date", "deadline", "event_time", "event_format"]
    return listed(spark, sf_dir).select(*columns, F.col("category").alias("source"), F.col("category").alias("source_category"), "summary", "slot")


@query("proj_02_pending_view", sql("SELECT university, college, 'pending' AS status, CASE WHEN base_url = '' THEN 'domain_failure' ELSE 'not_published' END AS pending_kind, university || ' ' || college || ' (' || CASE college_type WHEN 'law' THEN 'Law' ELSE 'Languages' END || ') not yet published' AS title FROM targets", TARGETS))
def proj_02(spark, sf_dir):
    label = F.create_map(F.lit("law"), F.lit("Law"), F.lit("foreign_lang"), F.lit("Languages"))
    title = F.concat(F.concat_ws(" ", "university", "college"), F.lit(" ("), label[F.col("college_type")], F.lit(") not yet published"))
    return targets(spark, sf_dir).select("university", "college", F.lit("pending").alias("status"), F.when(F.col("base_url") == "", "domain_failure").otherwise("not_published").alias("pending_kind"), title.alias("title"))


@query("proj_03_slot", sql("SELECT id, slot FROM labelled", NOTICES))
def proj_03(spark, sf_dir):
    return notices(spark, sf_dir).select("id", C.slot().alias("slot"))


@query("proj_04_effective_status", sql("SELECT id, effective FROM labelled", NOTICES))
def proj_04(spark, sf_dir):
    return notices(spark, sf_dir).select("id", C.effective_status(as_of()).alias("effective"))


@query("proj_05_canonical_source", sql("SELECT id, source, category FROM labelled", NOTICES))
def proj_05(spark, sf_dir):
    return notices(spark, sf_dir).select("id", "source", C.canonical_source().alias("category"))


@query("proj_06_detected_status", sql("SELECT id, CASE WHEN title LIKE '%result list%' OR title LIKE '%excellent%' THEN 'excellent_list' WHEN title LIKE '%closed%' OR title LIKE '%ended%' THEN 'ended' WHEN deadline_ts < TIMESTAMP '1998-04-01' THEN 'ended' ELSE 'active' END AS detected FROM notices", NOTICES))
def proj_06(spark, sf_dir):
    return notices(spark, sf_dir).select("id", C.detected_status(as_of()).alias("detected"))


@query("proj_07_event_type", "SELECT doc_id, CASE WHEN text LIKE '%pre%' THEN 'pre' WHEN text LIKE '%summer%' THEN 'school' WHEN text LIKE '%open%' THEN 'open_day' WHEN text LIKE '%excel%' THEN 'excellent' ELSE 'camp' END AS event_type FROM documents")
def proj_07(spark, sf_dir):
    words = (("pre", "pre"), ("summer", "school"), ("open", "open_day"), ("excel", "excellent"))
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(*[F.when(C.text("text").contains(w), F.lit(kind)) for w, kind in words], F.lit("camp")).alias("event_type"))


@query("proj_08_tier", sql("SELECT university, arg_max(tier, ord) AS tier FROM directory WHERE tier IS NOT NULL GROUP BY university", DIRECTORY))
def proj_08(spark, sf_dir):
    return directory(spark, sf_dir).withColumn("tier", C.tier(F.col("tags"))).where("tier is not null").groupBy("university").agg(F.max_by("tier", "ord").alias("tier"))


@query("proj_09_region", "SELECT n_name AS province, CASE r_name WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'north' ELSE 'other' END AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def proj_09(spark, sf_dir):
    named = F.create_map(F.lit("ASIA"), F.lit("east"), F.lit("EUROPE"), F.lit("north"))
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("province"), F.coalesce(named[F.col("r_name")], F.lit("other")).alias("region"))


@query("proj_10_missing_fields", sql("SELECT id, concat_ws(',', CASE WHEN publish_date IS NULL THEN 'publish_date' END, CASE WHEN deadline IS NULL THEN 'deadline' END, CASE WHEN event_time IS NULL THEN 'event_time' END, CASE WHEN event_format IS NULL THEN 'event_format' END) AS missing FROM notices", NOTICES))
def proj_10(spark, sf_dir):
    return notices(spark, sf_dir).select("id", F.array_join(C.missing_fields(), ",").alias("missing"))


@query("proj_11_confidence", sql("SELECT id, deadline IS NOT NULL AND event_time IS NOT NULL AND event_format IS NOT NULL AS core, filled = 4 AS complete, filled / 4.0::DOUBLE AS confidence FROM labelled", NOTICES))
def proj_11(spark, sf_dir):
    f = C.filled()
    return notices(spark, sf_dir).select("id", (f[1] & f[2] & f[3]).alias("core"), (f[0] & f[1] & f[2] & f[3]).alias("complete"), C.confidence().cast("double").alias("confidence"))


@query("proj_18_composite_keys", sql("SELECT id, university || '|' || college || '|' || college_type AS key3, left(regexp_replace(regexp_replace(title, '20[0-9][0-9]', '', 'g'), '\\s+', '', 'g'), 48) AS title_key, sha256(url)[1:24] AS cache_key FROM notices", NOTICES))
def proj_18(spark, sf_dir):
    title = F.regexp_replace(F.regexp_replace("title", r"20\d\d", ""), r"\s+", "")
    return notices(spark, sf_dir).select("id", F.concat_ws("|", "university", "college", "college_type").alias("key3"), F.substring(title, 1, 48).alias("title_key"), F.substring(F.sha2("url", 256), 1, 24).alias("cache_key"))


@query("proj_19_countdown", sql("SELECT id, days, CASE WHEN days < 0 THEN 'closed' WHEN days = 0 THEN 'today' WHEN days <= 3 THEN 'urgent' ELSE 'normal' END AS label FROM (SELECT id, ceil((epoch(deadline_ts) - epoch(TIMESTAMP '1998-04-01')) / 86400)::BIGINT AS days FROM notices WHERE deadline_ts IS NOT NULL)", NOTICES))
def proj_19(spark, sf_dir):
    at = parse_datetime(F.col("deadline"))
    days = F.ceil((F.unix_timestamp(at) - F.unix_timestamp(as_of())) / 86400)
    rows = notices(spark, sf_dir).where(at.isNotNull()).select("id", days.cast("long").alias("days"))
    return rows.select("id", "days", F.when(F.col("days") < 0, "closed").when(F.col("days") == 0, "today").when(F.col("days") <= 3, "urgent").otherwise("normal").alias("label"))


@query("proj_20_display", sql("SELECT id, coalesce(CASE WHEN length(deadline) = 10 AND deadline_ts IS NOT NULL THEN deadline || ' 00:00:00' WHEN length(deadline) = 16 THEN deadline || ':00' ELSE deadline END, '-') AS shown FROM notices", NOTICES))
def proj_20(spark, sf_dir):
    d = F.col("deadline")
    shown = F.when(d.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & (F.length(d) == 10), F.concat(d, F.lit(" 00:00:00"))).when(d.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d$"), F.concat(d, F.lit(":00"))).otherwise(d)
    return notices(spark, sf_dir).select("id", F.coalesce(shown, F.lit("-")).alias("shown"))


@query("pred_01_filter_set", sql("SELECT id FROM notices WHERE college_type = 'law' AND university IN ('NATION_1', 'NATION_2', 'NATION_3') AND (title LIKE '%2024%' OR university LIKE '%2024%' OR college LIKE '%2024%')", NOTICES))
def pred_01(spark, sf_dir):
    found = F.col("title").contains("2024") | F.col("university").contains("2024") | F.col("college").contains("2024")
    return notices(spark, sf_dir).where((F.col("college_type") == "law") & F.col("university").isin("NATION_1", "NATION_2", "NATION_3") & found).select("id")


@query("pred_02_board", sql("SELECT id FROM labelled WHERE slot LIKE 'pre%'", NOTICES))
def pred_02(spark, sf_dir):
    return notices(spark, sf_dir).where(C.board() == "pre_admission").select("id")


@query("pred_03_year_gate", sql("""SELECT id FROM (SELECT *, regexp_extract(title, '(20[0-9][0-9])', 1)::INT AS ty, CASE WHEN substr(publish_date, 1, 4)::INT BETWEEN 2023 AND 2026 THEN substr(publish_date, 1, 4)::INT END AS py,
    CASE WHEN TRY_CAST(substr(deadline, 1, 4) AS INT) BETWEEN 2023 AND 2026 THEN substr(deadline, 1, 4)::INT END AS dy FROM notices) WHERE ty >= 2024 AND greatest(ty, py, dy) >= 2024""", NOTICES))
def pred_03(spark, sf_dir):
    return notices(spark, sf_dir).where(C.year_ok(2024, 2026)).select("id")


@query("pred_04_tier_filter", sql("SELECT n.id FROM notices n WHERE university IN (SELECT university FROM (SELECT university, arg_max(tier, ord) AS tier FROM directory WHERE tier IS NOT NULL GROUP BY university) WHERE tier = '985')", NOTICES, DIRECTORY))
def pred_04(spark, sf_dir):
    best = QUERIES["proj_08_tier"](spark, sf_dir).where("tier = '985'")
    return notices(spark, sf_dir).join(best, "university", "left_semi").select("id")


@query("pred_05_effective_filter", sql("SELECT id FROM labelled WHERE effective = 'ended'", NOTICES))
def pred_05(spark, sf_dir):
    return notices(spark, sf_dir).where(C.effective_status(as_of()) == "ended").select("id")


@query("pred_06_source_filter", sql("SELECT id FROM labelled WHERE category = 'messaging'", NOTICES))
def pred_06(spark, sf_dir):
    return notices(spark, sf_dir).where(C.canonical_source() == "messaging").select("id")


@query("pred_18_manual_guard", sql("SELECT id, source LIKE '%manual%' OR id % 50 = 0 AS manual FROM notices", NOTICES))
def pred_18(spark, sf_dir):
    keys = notices(spark, sf_dir).where("id % 50 = 0").select("id").withColumn("listed", F.lit(True))
    return notices(spark, sf_dir).join(keys, "id", "left").select("id", (C.is_manual() | F.coalesce("listed", F.lit(False))).alias("manual"))


@query("pred_21_directory_filter", sql("SELECT ord, university, college FROM directory WHERE college_type = 'law' AND list_contains(tags, '211') AND region = 'ASIA' AND (lower(university) LIKE '%nation_1%' OR lower(college) LIKE '%nation_1%' OR province LIKE '%nation_1%')", DIRECTORY))
def pred_21(spark, sf_dir):
    term = "nation_1"
    found = F.lower("university").contains(term) | F.lower("college").contains(term) | F.col("province").contains(term)
    return directory(spark, sf_dir).where((F.col("college_type") == "law") & F.array_contains("tags", "211") & (F.col("region") == "ASIA") & found).select("ord", "university", "college")


@query("agg_01_board_stats", sql("""SELECT count(*) AS total, count(*) FILTER (effective = 'active') AS active, count(*) FILTER (effective = 'ended') AS ended, count(*) FILTER (effective = 'excellent_list') AS excellent_list,
    count(*) FILTER (college_type = 'law') AS law, count(*) FILTER (college_type = 'foreign_lang') AS foreign_lang, count(DISTINCT CASE WHEN university <> 'NATION_0' THEN university END) AS universities,
    (SELECT strftime(max(finished_at), '%Y-%m-%d %H:%M:%S') FROM runs WHERE board = 'summer_camp' AND status = 'success') AS last_run FROM labelled WHERE slot LIKE 'camp%'""", NOTICES, RUNS))
def agg_01(spark, sf_dir):
    """One row: conditional counts of a board, and its newest successful run; the joined side has exactly one row."""
    if_ = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    stats = listed(spark, sf_dir).where(F.col("slot").startswith("camp")).agg(
        F.count(F.lit(1)).alias("total"), if_("effective", "active"), if_("effective", "ended"), if_("effective", "excellent_list"), if_("college_type", "law"), if_("college_type", "foreign_lang"),
        F.countDistinct(F.when(F.col("university") != "NATION_0", F.col("university"))).alias("universities"),
    )
    last = runs(spark, sf_dir).where("board = 'summer_camp' AND status = 'success'").agg(F.date_format(F.max("finished_at"), "yyyy-MM-dd HH:mm:ss").alias("last_run"))
    return stats.join(F.broadcast(last), F.lit(True), "left")


@query("agg_02_source_histogram", sql("SELECT c.category, count(l.id) AS n FROM (VALUES ('official'), ('search'), ('messaging'), ('forum'), ('submit'), ('manual')) c(category) LEFT JOIN labelled l ON l.category = c.category GROUP BY 1", NOTICES))
def agg_02(spark, sf_dir):
    counts = notices(spark, sf_dir).groupBy(C.canonical_source().alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(c,) for c in CATEGORIES], "category string").join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("agg_03_directory_summary", sql("SELECT count(*) AS total, count(*) FILTER (college_type = 'law') AS law, count(DISTINCT university) AS universities, count(DISTINCT province) AS provinces, count(*) FILTER (list_contains(tags, '985')) AS n985, count(*) FILTER (list_contains(tags, '211')) AS n211, count(*) FILTER (list_contains(tags, 'dual')) AS dual FROM directory", DIRECTORY))
def agg_03(spark, sf_dir):
    tag = lambda t, name: F.count_if(F.array_contains("tags", t)).alias(name)
    return directory(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("college_type") == "law").alias("law"), F.countDistinct("university").alias("universities"), F.countDistinct("province").alias("provinces"), tag("985", "n985"), tag("211", "n211"), tag("dual", "dual"))


@query("agg_04_region_rollup", sql("SELECT region, province, count(*) AS n, grouping(region, province) AS level FROM directory GROUP BY ROLLUP (region, province)", DIRECTORY))
def agg_04(spark, sf_dir):
    return directory(spark, sf_dir).rollup("region", "province").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


@query("agg_05_filtered_totals", sql("SELECT region, count(*) AS total, count(*) FILTER (college_type = 'law') AS filtered_total, count(DISTINCT university) AS universities FROM directory GROUP BY region", DIRECTORY))
def agg_05(spark, sf_dir):
    return directory(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("college_type") == "law").alias("filtered_total"), F.countDistinct("university").alias("universities"))


@query("json_03_nested_directory", sql("SELECT region, count(*) AS provinces, sum(n)::BIGINT AS rows FROM (SELECT region, province, count(*) AS n FROM directory GROUP BY ALL) GROUP BY region", DIRECTORY))
def json_03(spark, sf_dir):
    tree = nested_directory(directory(spark, sf_dir))
    return tree.select("region", F.size("provinces").cast("long").alias("provinces"), F.aggregate("provinces", F.lit(0).cast("long"), lambda a, p: a + p["count"]).alias("rows"))


def nested_directory(rows: DataFrame) -> DataFrame:
    """region → provinces → rows, each level sorted and counted. A province's rows are one value: directories are small."""
    province = rows.groupBy("region", "province").agg(F.array_sort(F.collect_list(F.struct("university", "college", "college_type"))).alias("rows"), F.count(F.lit(1)).alias("count"))
    return province.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("province", "count", "rows"))).alias("provinces"))


@query("agg_06_group_report", sql("SELECT failure_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, failure_type) AS place FROM fails WHERE op = 'fail' GROUP BY failure_type", FAILS))
def agg_06(spark, sf_dir):
    counts = fail_events(spark, sf_dir).where("op = 'fail'").groupBy("failure_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "failure_type")).cast("long"))


@query("agg_09_probe_report", "SELECT split_part(split_part(url, '://', 2), '.', -1)[1:3] AS kind, count(*) AS total, count(*) FILTER (length(html) > 4000) AS large, count(DISTINCT CASE WHEN url LIKE 'https%' THEN split_part(split_part(url, '://', 2), '/', 1) END) AS secure_hosts FROM pages GROUP BY 1")
def agg_09(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("host", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)))
    kind = F.substring(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("."), F.lit(-1)), 1, 3)
    return p.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.length("html") > 4000).alias("large"), F.countDistinct(F.when(F.col("url").startswith("https"), F.col("host"))).alias("secure_hosts"))


@query("agg_12_table_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'nation', count(*) FROM nation")
def agg_12(spark, sf_dir):
    parts = [read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("orders", "customer", "nation")]
    return parts[0].union(parts[1]).union(parts[2])


@query("agg_13_last_match_map", sql("SELECT university, college_type, arg_max(college, ord) AS college FROM directory GROUP BY ALL", DIRECTORY))
def agg_13(spark, sf_dir):
    return directory(spark, sf_dir).groupBy("university", "college_type").agg(F.max_by("college", "ord").alias("college"))


@query("sort_01_updated", sql("SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM notices WHERE university = 'NATION_7' QUALIFY place <= 100", NOTICES))
def sort_01(spark, sf_dir):
    """Newest first. A top-k report: the order is that of the first hundred rows."""
    top = notices(spark, sf_dir).where("university = 'NATION_7'").orderBy(F.desc("updated_at"), "id").limit(100)
    return top.select("id", F.row_number().over(W.orderBy(F.desc("updated_at"), "id")).cast("long").alias("place"))


@query("sort_02_deadline_order", sql("SELECT id, row_number() OVER (ORDER BY deadline IS NULL, deadline_ts ASC NULLS LAST, updated_at DESC, id) AS place FROM labelled WHERE slot LIKE 'camp%' AND effective = 'active' QUALIFY place <= 200", NOTICES))
def sort_02(spark, sf_dir):
    order = [F.col("deadline").isNull(), parse_datetime(F.col("deadline")).asc_nulls_last(), F.desc("updated_at"), F.col("id")]
    top = listed(spark, sf_dir).where(F.col("slot").startswith("camp") & (F.col("effective") == "active")).orderBy(*order).limit(200)
    return top.select("id", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


@query("sort_03_incomplete_queue", sql("SELECT id, row_number() OVER (ORDER BY NOT (source LIKE '%manual%'), id) AS place FROM labelled WHERE filled < 4 QUALIFY place <= 30", NOTICES))
def sort_03(spark, sf_dir):
    order = [~C.is_manual(), F.col("id")]
    top = notices(spark, sf_dir).where(C.confidence() < 1).orderBy(*order).limit(30)
    return top.select("id", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


@query("sort_05_label_order", sql("SELECT university, college, row_number() OVER (ORDER BY university, college) AS place FROM targets", TARGETS))
def sort_05(spark, sf_dir):
    """Places in one order without a task that holds all rows: a place within the university, after the rows of those before it."""
    t = targets(spark, sf_dir).select("university", "college")
    sizes = t.groupBy("university").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.select("university", (F.sum("n").over(W.orderBy("university")) - F.col("n")).alias("ahead"))  # one row per university
    own = F.row_number().over(W.partitionBy("university").orderBy("college"))
    return t.withColumn("own", own).join(ahead, "university").select("university", "college", (F.col("ahead") + F.col("own")).alias("place"))


@query("sort_07_region_order", "SELECT r_name AS region, CASE r_name WHEN 'ASIA' THEN 1 WHEN 'EUROPE' THEN 2 WHEN 'AFRICA' THEN 3 ELSE 0 END::BIGINT AS place FROM region")
def sort_07(spark, sf_dir):
    order = F.array(F.lit("ASIA"), F.lit("EUROPE"), F.lit("AFRICA"))
    return read(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.array_position(order, F.col("r_name")).cast("long").alias("place"))


@query("set_05_distinct", sql("SELECT DISTINCT university, college_type FROM directory", DIRECTORY))
def set_05(spark, sf_dir):
    return directory(spark, sf_dir).select("university", "college_type").distinct()


@query("api_01_incomplete", sql("SELECT id, university, filled FROM labelled WHERE filled < 3 AND source NOT LIKE '%manual%'", NOTICES))
def api_01(spark, sf_dir):
    return notices(spark, sf_dir).where((C.confidence() < 0.75) & ~C.is_manual()).select("id", "university", (C.confidence() * 4).cast("int").alias("filled"))


@query("date_01_parse", sql("SELECT id, strftime(deadline_ts, '%Y-%m-%d %H:%M:%S') AS moment FROM notices", NOTICES))
def date_01(spark, sf_dir):
    return notices(spark, sf_dir).select("id", F.date_format(parse_datetime(F.col("deadline")), "yyyy-MM-dd HH:mm:ss").alias("moment"))

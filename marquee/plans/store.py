"""Write side and joins, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.rules import RuleSet
from ..functions.temporal import as_of, next_check, parse_datetime
from ..operators import arrivals as Saves
from ..operators import store as S
from ..sources.tables import directory, fail_events, notices, read, runs, targets
from .board import listed
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


COVERED = "covered AS (SELECT DISTINCT university, college FROM notices WHERE id % 2 = 0 AND university <> 'NATION_3')"
PENDING = "pending AS (SELECT t.* FROM targets t ANTI JOIN covered c USING (university, college))"


def covered(spark, sf_dir):
    return notices(spark, sf_dir).where("id % 2 = 0 and university <> 'NATION_3'").select("university", "college").distinct()


def pending(spark, sf_dir):
    return targets(spark, sf_dir).join(covered(spark, sf_dir), ["university", "college"], "left_anti")


def arrivals(spark, sf_dir):
    """Every fifth notice once more with a later deadline, and every fiftieth under a new url."""
    n = notices(spark, sf_dir)
    again = n.where("id % 5 = 0").withColumns({"deadline": F.when(F.col("id") % 2 == 0, F.lit("1999-01-01")).otherwise(F.col("deadline")), "summary": F.concat(C.text("summary"), F.when(F.col("id") % 3 == 0, " more").otherwise(""))})
    fresh = n.where("id % 50 = 0").withColumns({"url": F.concat("url", F.lit("l")), "id": F.col("id") + 100_000_000})
    return again.unionByName(fresh).withColumn("ord", F.col("id"))


@query("snk_01_upsert", sql("""SELECT id, url, coalesce(title, '') AS title, deadline, summary, change FROM (
    SELECT id, url, title, CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN '1999-01-01' ELSE deadline END AS deadline, CASE WHEN id % 5 = 0 AND id % 3 = 0 THEN coalesce(summary, '') || ' more' ELSE summary END AS summary,
        CASE WHEN id % 5 = 0 AND ((id % 2 = 0 AND deadline IS DISTINCT FROM '1999-01-01') OR id % 3 = 0) THEN 'updated' ELSE 'kept' END AS change FROM notices
    UNION ALL SELECT id + 100000000, url || 'l', title, deadline, summary, 'inserted' FROM notices WHERE id % 50 = 0)""", NOTICES))
def snk_01(spark, sf_dir):
    return S.upsert_notices(notices(spark, sf_dir), arrivals(spark, sf_dir), as_of()).select("id", "url", C.text("title").alias("title"), "deadline", "summary", "change")


#: Rows that reach every branch of a save; two thirds of the notices are stored, the others are new.
INCOMING = """incoming AS (SELECT id AS ord, id, CASE id % 10 WHEN 1 THEN 'ftp://x/' || id WHEN 5 THEN url || '?moved' WHEN 7 THEN url || '?other' WHEN 9 THEN CASE WHEN id % 3 = 0 THEN 'https://elsewhere.net/' || id ELSE url END ELSE url END AS url,
    CASE WHEN id % 10 = 5 THEN url END AS original_url, id % 10 = 0 AS rejected, CASE id % 10 WHEN 2 THEN 'Old 2019 recruitment notice' WHEN 3 THEN title || ' by a clown' WHEN 6 THEN 'Fresh recruitment notice 2026' WHEN 7 THEN title || ' (revised)' WHEN 8 THEN university || '外国语学院2026 recruitment notice' ELSE title END AS title,
    CASE WHEN id % 10 IN (4, 9) AND id % 3 = 0 THEN '' ELSE university END AS university, CASE WHEN id % 10 IN (4, 9) AND id % 3 = 0 THEN '' WHEN id % 10 = 8 THEN '法学院' ELSE college END AS college, college_type, status, event_type, publish_date,
    CASE WHEN id % 10 IN (4, 5) THEN '2026-07-01' ELSE deadline END AS deadline, event_time, event_format, source, CASE WHEN id % 2 = 0 THEN coalesce(summary, '') || ' more' ELSE summary END AS summary FROM notices WHERE id % 3 <> 2)"""
_SAVED = """passed AS (SELECT * FROM incoming WHERE id % 10 NOT IN (0, 1, 2, 3, 8) AND regexp_extract(title, '(20[0-9][0-9])', 1)::INT >= 2024),
    matched AS (SELECT *, CASE WHEN id % 3 = 1 AND id % 10 <> 7 THEN id WHEN university <> '' THEN (SELECT min(n.id) FROM notices n WHERE n.id % 3 <> 0 AND n.university = p.university AND n.college = p.college AND (contains(n.title, p.title[1:24]) OR contains(p.title, n.title[1:24]))) END AS target FROM passed p),
    folded AS (SELECT target, arg_max(url, ord) AS url, arg_max(title, ord) AS title, arg_max(status, ord) AS status, arg_max(source, ord) FILTER (source <> '') AS source, arg_max(deadline, ord) FILTER (deadline <> '') AS deadline, arg_max(event_time, ord) FILTER (event_time <> '') AS event_time,
        arg_max(event_format, ord) FILTER (event_format <> '') AS event_format, arg_max(publish_date, ord) FILTER (publish_date <> '') AS publish_date, arg_max(summary, length(coalesce(summary, ''))::BIGINT * 1000000000 - ord) AS summary FROM matched WHERE target IS NOT NULL GROUP BY target),
    by_domain AS (SELECT regexp_extract(base_url, '//(.*)', 1) AS domain, arg_min(university, ord) AS university, arg_min(college, ord) AS college, arg_min(college_type, ord) AS college_type FROM targets WHERE base_url <> '' GROUP BY 1),
    by_title AS (SELECT university, arg_min(college, ord) AS college, arg_min(college_type, ord) AS college_type, min(ord) AS o FROM targets GROUP BY 1),
    fresh AS (SELECT m.ord AS id, m.url, m.title, CASE WHEN m.university <> '' THEN m.university ELSE coalesce(d.university, t.university, '未知') END AS university, CASE WHEN m.university <> '' THEN m.college ELSE coalesce(d.college, t.college, '未知') END AS college,
        CASE WHEN m.university <> '' THEN m.college_type ELSE coalesce(d.college_type, t.college_type, 'law') END AS college_type, m.event_type, m.status, m.deadline, m.summary FROM matched m LEFT JOIN by_domain d ON regexp_extract(m.url, '//([^/]+)', 1) = d.domain LEFT JOIN by_title t ON d.domain IS NULL AND contains(m.title, t.university)
        WHERE target IS NULL QUALIFY row_number() OVER (PARTITION BY m.ord ORDER BY t.o) = 1),
    saved AS (SELECT n.id, coalesce(f.url, n.url) AS url, coalesce(f.title, n.title) AS title, n.university, n.college, n.college_type, n.event_type, coalesce(f.status, n.status) AS status, coalesce(f.deadline, n.deadline) AS deadline, CASE WHEN length(coalesce(f.summary, '')) > length(coalesce(n.summary, '')) THEN f.summary ELSE n.summary END AS summary,
        CASE WHEN f.target IS NOT NULL AND (f.url <> n.url OR f.title <> n.title OR f.status <> n.status OR coalesce(f.source, n.source) <> n.source OR coalesce(f.deadline, n.deadline) IS DISTINCT FROM n.deadline OR coalesce(f.event_time, n.event_time) IS DISTINCT FROM n.event_time OR coalesce(f.event_format, n.event_format) IS DISTINCT FROM n.event_format
            OR coalesce(f.publish_date, n.publish_date) IS DISTINCT FROM n.publish_date OR length(coalesce(f.summary, '')) > length(coalesce(n.summary, ''))) THEN 'updated' ELSE 'kept' END AS change, f.target IS NOT NULL AS touched FROM notices n LEFT JOIN folded f ON f.target = n.id WHERE n.id % 3 <> 0
        UNION ALL SELECT *, 'inserted', true FROM fresh)"""


def incoming(spark, sf_dir):
    n = notices(spark, sf_dir)
    n.createOrReplaceTempView("_save_notices")
    return spark.sql(INCOMING.removeprefix("incoming AS (").removesuffix(")").replace("FROM notices", "FROM _save_notices"))


def saved(spark, sf_dir):
    places = targets(spark, sf_dir).withColumn("domain", F.regexp_extract("base_url", "//(.*)", 1))
    return Saves.save_notices(notices(spark, sf_dir).where("id % 3 <> 0"), incoming(spark, sf_dir), places, as_of(), Saves.gate(2024, 2026, RuleSet(whitelist=("recruitment", "list"), pre_whitelist=("recruitment", "list"), camp=("camp",))))


@query("snk_01_save", sql("SELECT id, url, title, university, college, college_type, status, deadline, summary, change, touched FROM saved", NOTICES, TARGETS, INCOMING, _SAVED))
def snk_01_save(spark, sf_dir):
    """A save as a whole: gate, owners of unknown rows, three ways to find a stored row, merges in order, inserts."""
    return saved(spark, sf_dir).select("id", "url", "title", "university", "college", "college_type", "status", "deadline", "summary", "change", "touched")


@query("snk_01_save_covered", sql("""SELECT university, college, college_type, CASE WHEN event_type = 'pre' OR title LIKE '%pre%' THEN CASE WHEN title LIKE '%result%' AND title LIKE '%list%' THEN 'pre_result' ELSE 'pre_notice' END WHEN status = 'excellent_list' OR title LIKE '%result list%' THEN 'camp_result' ELSE 'camp_notice' END AS slot,
    max(id) AS announcement_id FROM saved WHERE touched GROUP BY ALL""", NOTICES, TARGETS, INCOMING, _SAVED))
def snk_01_save_covered(spark, sf_dir):
    """What a save fills: the slots of the notices that it touched."""
    return Saves.covered_by(saved(spark, sf_dir), as_of()).select(*S.KEY, "announcement_id")


@query("snk_01b_batch_exact", sql("SELECT url, min(id) AS id FROM (SELECT id, regexp_replace(url, '/[0-9]+\\.htm$', '') AS url FROM notices) GROUP BY url", NOTICES))
def snk_01b(spark, sf_dir):
    rows = notices(spark, sf_dir).select("id", F.regexp_replace("url", r"/[0-9]+\.htm$", "").alias("url"))
    return S.first_per_key(rows, ["url"], ["id"]).select("url", "id")


@query("snk_01b_batch_prefix", sql("SELECT id AS ord, university, college, title FROM notices QUALIFY row_number() OVER (PARTITION BY university, college, title[1:24] ORDER BY id) = 1", NOTICES))
def snk_01b_prefix(spark, sf_dir):
    return S.collapse_prefixes(notices(spark, sf_dir).withColumn("ord", F.col("id")))


@query("snk_03_target_writer", sql("SELECT university, college, count(id) AS items, CASE WHEN count(id) = 0 THEN 'pending' ELSE 'covered' END AS state FROM targets t LEFT JOIN notices n USING (university, college) GROUP BY university, college", NOTICES, TARGETS))
def snk_03(spark, sf_dir):
    items = notices(spark, sf_dir).groupBy("university", "college").agg(F.count("id").alias("items"))
    joined = targets(spark, sf_dir).join(items, ["university", "college"], "left").withColumn("items", F.coalesce("items", F.lit(0).cast("long")))
    return joined.select("university", "college", "items", F.when(F.col("items") == 0, "pending").otherwise("covered").alias("state"))


@query("snk_04_coverage_upsert", sql("SELECT university, college, college_type, slot, arg_max(id, (updated_at, id)) FILTER (id % 3 <> 0) AS announcement_id, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM labelled GROUP BY ALL", NOTICES))
def snk_04(spark, sf_dir):
    parts = listed(spark, sf_dir).select(*S.KEY, F.when(F.col("id") % 3 != 0, F.col("id")).alias("announcement_id"), F.col("updated_at").alias("touched_at"))
    return S.coverage_upsert(parts).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("snk_05_coverage_sync", sql("""SELECT university, college, college_type, slot, max(CASE WHEN own THEN id END) IS NOT NULL AS known, strftime(max(moment), '%Y-%m-%d %H:%M:%S') AS updated_at FROM (
    SELECT university, college, college_type, slot, id, true AS own, updated_at AS moment FROM labelled UNION ALL SELECT university, college, college_type, 'camp_notice', NULL, false, TIMESTAMP '1998-04-01' FROM pending
    UNION ALL SELECT university, college, college_type, replace(slot, '_notice', '_result'), NULL, false, updated_at FROM labelled WHERE slot LIKE '%notice') GROUP BY ALL""", NOTICES, TARGETS, COVERED, PENDING))
def snk_05(spark, sf_dir):
    waiting = pending(spark, sf_dir).select("university", "college", "college_type", F.lit("camp_notice").alias("slot"), as_of().alias("touched_at"))
    out = S.coverage_sync(listed(spark, sf_dir).withColumn("updated_at", F.col("updated_at").cast("timestamp")), waiting)
    return out.select(*S.KEY, F.col("announcement_id").isNotNull().alias("known"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("snk_06_pending_upsert", sql("SELECT university, college, college_type, (CASE WHEN ord % 2 = 0 THEN 4 ELSE 1 END)::BIGINT AS search_count, CASE WHEN base_url = '' THEN 'domain_failure' ELSE 'not_published' END AS pending_kind FROM targets", TARGETS))
def snk_06(spark, sf_dir):
    t = targets(spark, sf_dir)
    held = t.where("ord % 2 = 0").select("university", "college", "college_type", F.lit(3).cast("long").alias("search_count"), F.lit("watching").alias("pending_kind"))
    return S.pending_upsert(held, t)


@query("snk_07_pending_delete", sql("SELECT university, college FROM pending ANTI JOIN (SELECT DISTINCT university, college FROM labelled WHERE slot IN ('camp_notice', 'pre_notice') AND college <> 'BUILDING') USING (university, college)", NOTICES, TARGETS, COVERED, PENDING))
def snk_07(spark, sf_dir):
    done = listed(spark, sf_dir).where(F.col("slot").isin("camp_notice", "pre_notice") & (F.col("college") != "BUILDING")).select("university", "college").distinct()
    return pending(spark, sf_dir).join(done, ["university", "college"], "left_anti").select("university", "college")


@query("snk_08_range_delete", sql("SELECT id FROM labelled WHERE NOT (slot = 'camp_result' AND university IN ('NATION_1', 'NATION_2'))", NOTICES))
def snk_08(spark, sf_dir):
    return listed(spark, sf_dir).where(~((F.col("slot") == "camp_result") & F.col("university").isin("NATION_1", "NATION_2"))).select("id")


@query("snk_09_purge_stale", sql("SELECT id FROM notices WHERE source LIKE '%manual%' OR regexp_extract(title, '(20[0-9][0-9])', 1)::INT >= 2024", NOTICES))
def snk_09(spark, sf_dir):
    return notices(spark, sf_dir).where(C.is_manual() | C.year_ok(2024, 2026)).select("id")


@query("snk_11_ageing", sql("SELECT id, CASE WHEN status = 'active' AND deadline_ts < TIMESTAMP '1998-04-01' THEN 'ended' ELSE status END AS status FROM notices", NOTICES))
def snk_11(spark, sf_dir):
    past = (F.col("status") == "active") & (parse_datetime(F.col("deadline")) < as_of())
    return notices(spark, sf_dir).select("id", F.when(past, "ended").otherwise(F.col("status")).alias("status"))


@query("snk_12_source_labels", sql("SELECT count(*) AS total, count(*) FILTER (source <> category) AS changed FROM labelled", NOTICES))
def snk_12(spark, sf_dir):
    return listed(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("source") != F.col("category")).alias("changed"))


@query("snk_13_ring_buffer", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def snk_13(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return read(spark, sf_dir, "events").withColumn("n", n).where("n <= 5").select("user_id", "event_id")


@query("snk_15_snapshot", sql("SELECT university, college, college_type, id, (filled + CASE WHEN source LIKE '%manual%' THEN 5 ELSE 0 END) AS score FROM labelled QUALIFY row_number() OVER (PARTITION BY university, college, college_type ORDER BY filled + CASE WHEN source LIKE '%manual%' THEN 5 ELSE 0 END DESC, id) = 1", NOTICES))
def snk_15(spark, sf_dir):
    return S.snapshot(notices(spark, sf_dir)).select("university", "college", "college_type", "id", "score")


@query("snk_16_restore", sql("SELECT id, CASE WHEN id % 4 = 0 THEN coalesce(deadline, '1999-09-09') ELSE deadline END AS deadline FROM notices WHERE id % 7 <> 0 UNION ALL SELECT id, coalesce(deadline, '1999-09-09') FROM notices WHERE id % 7 = 0 AND id % 4 = 0", NOTICES))
def snk_16(spark, sf_dir):
    n = notices(spark, sf_dir).select("id", "deadline")
    saved = n.where("id % 4 = 0").select("id", F.coalesce("deadline", F.lit("1999-09-09")).alias("saved"))
    return n.where("id % 7 <> 0").join(saved, "id", "full").select("id", F.coalesce("deadline", "saved").alias("deadline"))


@query("snk_16b_guard", sql("SELECT id, CASE WHEN source LIKE '%manual%' AND NOT coalesce(deadline, '') LIKE '%23:59:59%' THEN deadline ELSE '1999-01-01 23:59:59' END AS deadline FROM notices", NOTICES))
def snk_16b(spark, sf_dir):
    return notices(spark, sf_dir).select("id", S.guarded(F.col("deadline"), F.lit("1999-01-01 23:59:59"), C.is_manual()).alias("deadline"))


@query("snk_17_manual_patch", sql("SELECT id, CASE WHEN id % 10 = 0 THEN 'patched ' || id ELSE title END AS title, CASE WHEN id % 10 = 0 THEN 'manual' ELSE source END AS source FROM notices", NOTICES))
def snk_17(spark, sf_dir):
    n = notices(spark, sf_dir)
    patch = n.where("id % 10 = 0").select("id", F.concat(F.lit("  patched "), "id", F.lit(" ")).alias("p_title"), F.lit(" ").alias("p_college"))
    joined = n.join(patch, "id", "left")
    return joined.select("id", F.coalesce(F.nullif(F.trim("p_title"), F.lit("")), "title").alias("title"), F.when(F.col("p_title").isNotNull(), "manual").otherwise(F.col("source")).alias("source"))


@query("snk_18_pending_report", sql("SELECT CASE WHEN base_url = '' THEN 'domain_failure' ELSE 'not_published' END AS kind, count(*) AS n FROM targets GROUP BY 1", TARGETS))
def snk_18(spark, sf_dir):
    return targets(spark, sf_dir).groupBy(F.when(F.col("base_url") == "", "domain_failure").otherwise("not_published").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("snk_20_config_merge", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM nation")
def snk_20(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    both = n.where("id % 2 = 0").withColumns({"origin": F.lit("old"), "rank": F.lit(0)}).unionByName(n.withColumns({"origin": F.lit("new"), "rank": F.lit(1)}))
    return S.first_per_key(both, ["id"], ["rank"]).select("id", "origin")


@query("join_01_uncovered", sql("SELECT university, college FROM pending", NOTICES, TARGETS, COVERED, PENDING))
def join_01(spark, sf_dir):
    return pending(spark, sf_dir).select("university", "college")


@query("join_02_multi_anti", sql("SELECT t.university, t.college FROM targets t ANTI JOIN (SELECT DISTINCT university, college FROM labelled WHERE category = 'official') o USING (university, college)", NOTICES, TARGETS))
def join_02(spark, sf_dir):
    official = listed(spark, sf_dir).where("category = 'official'").select("university", "college").distinct()
    return targets(spark, sf_dir).join(official, ["university", "college"], "left_anti").select("university", "college")


@query("join_03_schedule", sql("SELECT t.university, t.college, coalesce(p.ord, -1) AS pending_ord FROM targets t LEFT JOIN pending p USING (university, college)", NOTICES, TARGETS, COVERED, PENDING))
def join_03(spark, sf_dir):
    p = pending(spark, sf_dir).select("university", "college", F.col("ord").alias("p"))
    return targets(spark, sf_dir).join(p, ["university", "college"], "left").select("university", "college", F.coalesce("p", F.lit(-1).cast("long")).alias("pending_ord"))


ATTRIBUTION = """scored AS (SELECT n.id, t.university, t.college, t.ord, 5 + CASE WHEN contains(n.title, t.college) THEN 8 WHEN length(t.college) >= 4 AND contains(n.title, substr(t.college, 1, 2)) THEN 3 ELSE 0 END
    + CASE WHEN regexp_matches(n.title, 'BUILDING|FURNITURE') THEN CASE WHEN t.college_type = 'law' THEN 4 ELSE -6 END ELSE 0 END + CASE WHEN regexp_matches(n.title, 'MACHINERY|AUTOMOBILE|HOUSEHOLD') THEN CASE WHEN t.college_type = 'law' THEN -6 ELSE 4 END ELSE 0 END AS score
    FROM notices n JOIN targets t ON contains(n.title, t.university))"""


@query("join_05_attribution", sql("SELECT id, university, college, score FROM scored WHERE score >= 9 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1", NOTICES, TARGETS, ATTRIBUTION))
def join_05(spark, sf_dir):
    return S.attribute(notices(spark, sf_dir), targets(spark, sf_dir), "title", "id")


@query("join_07_enrichment", sql("""SELECT d.ord, coalesce(e.s_name, f.s_name) AS site FROM directory d
    LEFT JOIN (SELECT n_name AS university, c AS college, arg_max(s_name, s_suppkey) AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT 'BUILDING' AS c) WHERE s_suppkey % 2 = 0 GROUP BY ALL) e USING (university, college)
    LEFT JOIN (SELECT n_name AS university, arg_max(s_name, s_suppkey) AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) f USING (university)""", DIRECTORY))
def join_07(spark, sf_dir):
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    sites = s.join(n, s.s_nationkey == n.n_nationkey).withColumn("university", F.col("n_name"))
    exact = sites.where("s_suppkey % 2 = 0").groupBy("university").agg(F.max_by("s_name", "s_suppkey").alias("e")).withColumn("college", F.lit("BUILDING"))
    fallback = sites.groupBy("university").agg(F.max_by("s_name", "s_suppkey").alias("f"))
    return directory(spark, sf_dir).join(exact, ["university", "college"], "left").join(fallback, "university", "left").select("ord", F.coalesce("e", "f").alias("site"))


@query("join_08_registry", sql("SELECT n_name AS university, list_sort(list(DISTINCT college)) AS colleges FROM nation JOIN directory ON n_name = university WHERE college_type = 'law' GROUP BY n_name", DIRECTORY))
def join_08(spark, sf_dir):
    grouped = directory(spark, sf_dir).where("college_type = 'law'").groupBy("university").agg(F.array_sort(F.collect_set("college")).alias("colleges"))
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("university")).join(grouped, "university", "left").where(F.size("colleges") > 0)


@query("join_11_known_urls", sql("SELECT id FROM notices ANTI JOIN (SELECT url FROM notices WHERE id % 3 = 0) k USING (url)", NOTICES))
def join_11(spark, sf_dir):
    n = notices(spark, sf_dir)
    return n.join(n.where("id % 3 = 0").select("url"), "url", "left_anti").select("id")


@query("join_12_target_lookup", sql("SELECT id, ord FROM notices JOIN targets USING (university, college)", NOTICES, TARGETS))
def join_12(spark, sf_dir):
    return notices(spark, sf_dir).join(targets(spark, sf_dir).select("university", "college", "ord"), ["university", "college"]).select("id", "ord")


@query("join_13_url_conflict", sql("SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY regexp_replace(url, '/[0-9]+\\.htm$', '')) AS n FROM notices) WHERE n > 1", NOTICES))
def join_13(spark, sf_dir):
    """Rows whose address another row has too (addresses cut to the publisher's folder, so that some are equal)."""
    n = notices(spark, sf_dir).select("id", F.regexp_replace("url", r"/[0-9]+\.htm$", "").alias("url"))
    shared = n.groupBy("url").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("url")
    return n.join(shared, "url", "left_semi").select("id")


@query("join_14_calendar", "SELECT n_name AS university, CASE WHEN n_nationkey % 5 = 0 THEN '06-15' ELSE '07-01' END AS start, '08-20' AS finish FROM nation")
def join_14(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    own = n.where("n_nationkey % 5 = 0").select("n_name", F.lit("06-15").alias("own"))
    return n.join(own, "n_name", "left").select(F.col("n_name").alias("university"), F.coalesce("own", F.lit("07-01")).alias("start"), F.lit("08-20").alias("finish"))


@query("set_01_source_union", sql("SELECT url, arg_min(src, rank) AS src FROM (SELECT url, 'search' AS src, 0 AS rank FROM notices WHERE id % 2 = 0 UNION ALL SELECT url, 'official', 1 FROM notices WHERE id % 3 = 0 OR id % 2 <> 0) GROUP BY url", NOTICES))
def set_01(spark, sf_dir):
    n = notices(spark, sf_dir)
    both = n.where("id % 2 = 0").select("url", F.lit("search").alias("src"), F.lit(0).alias("rank")).unionByName(n.where("id % 3 = 0 or id % 2 <> 0").select("url", F.lit("official").alias("src"), F.lit(1).alias("rank")))
    return both.groupBy("url").agg(F.min_by("src", "rank").alias("src"))


@query("set_03_difference", sql("SELECT university, college FROM targets EXCEPT SELECT university, college FROM covered", NOTICES, TARGETS, COVERED))
def set_03(spark, sf_dir):
    return targets(spark, sf_dir).select("university", "college").subtract(covered(spark, sf_dir))


@query("set_04_membership_union", sql("SELECT university FROM notices WHERE status = 'active' UNION SELECT university FROM notices WHERE college_type = 'law'", NOTICES))
def set_04(spark, sf_dir):
    n = notices(spark, sf_dir)
    return n.where("status = 'active'").select("university").union(n.where("college_type = 'law'").select("university")).distinct()


@query("win_02_topn_per_target", sql("SELECT university, college, id FROM labelled QUALIFY row_number() OVER (PARTITION BY university, college ORDER BY filled DESC, id) <= 3", NOTICES))
def win_02(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("university", "college").orderBy(F.desc(C.confidence()), "id"))
    return notices(spark, sf_dir).withColumn("place", place).where("place <= 3").select("university", "college", "id")


@query("win_03_first_success", sql("SELECT university, min(id) AS id FROM notices WHERE deadline IS NOT NULL AND event_time IS NOT NULL GROUP BY university", NOTICES))
def win_03(spark, sf_dir):
    return notices(spark, sf_dir).where("deadline is not null and event_time is not null").groupBy("university").agg(F.min("id").alias("id"))


@query("win_05_running_counts", sql("SELECT id, sum(found) OVER (PARTITION BY board ORDER BY started_at, id)::BIGINT AS so_far FROM runs", RUNS))
def win_05(spark, sf_dir):
    """Running totals by days: what all days before found, and the running total within the day, so that no task holds a board."""
    r = runs(spark, sf_dir).select("id", "board", "found", "started_at", F.to_date("started_at").alias("day"))
    days = r.groupBy("board", "day").agg(F.sum("found").alias("n"))
    ahead = days.select("board", "day", (F.sum("n").over(W.partitionBy("board").orderBy("day")) - F.col("n")).alias("ahead"))
    own = F.sum("found").over(W.partitionBy("board", "day").orderBy("started_at", "id").rowsBetween(W.unboundedPreceding, 0))
    return r.withColumn("own", own).join(ahead, ["board", "day"]).select("id", (F.col("own") + F.col("ahead")).alias("so_far"))


@query("win_06_batches", sql("SELECT university, college, (row_number() OVER (PARTITION BY university ORDER BY ord) - 1) // 3 AS batch FROM targets", TARGETS))
def win_06(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("university").orderBy("ord")) - 1
    return targets(spark, sf_dir).select("university", "college", F.floor(n / 3).cast("long").alias("batch"))


@query("win_07_latest_run", sql("SELECT board, arg_max(id, (finished_at, id)) AS id FROM runs WHERE status = 'success' GROUP BY board", RUNS))
def win_07(spark, sf_dir):
    return runs(spark, sf_dir).where("status = 'success'").groupBy("board").agg(F.max_by("id", F.struct("finished_at", "id")).alias("id"))


@query("agg_08_empty_streak", sql("SELECT board, count(*) FILTER (later = 0) AS streak FROM (SELECT board, sum((found > 0)::INT) OVER (PARTITION BY board ORDER BY started_at DESC, id DESC) AS later FROM runs) GROUP BY board", RUNS))
def agg_08(spark, sf_dir):
    """Runs after the newest one that had finds."""
    r = runs(spark, sf_dir).withColumn("moment", F.struct("started_at", "id"))
    last = r.groupBy("board").agg(F.max(F.when(F.col("found") > 0, F.col("moment"))).alias("last"))
    return r.join(last, "board").groupBy("board").agg(F.count_if(F.col("last").isNull() | (F.col("moment") > F.col("last"))).alias("streak"))


@query("agg_07_alerts", sql("SELECT 'needs_manual' AS alert, n FROM (SELECT count(*) AS n FROM (SELECT ann_id FROM fails WHERE op = 'fail' GROUP BY ann_id HAVING count(*) >= 2)) WHERE n >= 10", FAILS))
def agg_07(spark, sf_dir):
    many = fail_events(spark, sf_dir).where("op = 'fail'").groupBy("ann_id").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    return many.agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select(F.lit("needs_manual").alias("alert"), "n")


@query("agg_10_quota", "SELECT strftime(ts, '%Y-%m-%d') AS day, isoyear(ts)::INT AS iso_year, weekofyear(ts)::INT AS iso_week, count(*) AS n FROM events GROUP BY ALL")
def agg_10(spark, sf_dir):
    keys = [F.date_format("ts", "yyyy-MM-dd").alias("day"), F.expr("extract(YEAROFWEEK FROM ts)").cast("int").alias("iso_year"), F.weekofyear("ts").alias("iso_week")]
    return read(spark, sf_dir, "events").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("date_13_window", sql("SELECT id, (month(started_at) * 100 + day(started_at)) BETWEEN 115 AND 120 AS inside FROM runs", RUNS))
def date_13(spark, sf_dir):
    from ..functions.temporal import window_dates

    first, last = window_dates(F.col("started_at"), "01-15", "01-20")
    return runs(spark, sf_dir).select("id", F.to_date("started_at").between(first, last).alias("inside"))


@query("date_14_next_check", sql("SELECT id, strftime(CASE WHEN started_at::DATE < DATE '2024-01-15' THEN TIMESTAMP '2024-01-15' WHEN started_at::DATE > DATE '2024-01-20' THEN TIMESTAMP '2025-01-15' ELSE started_at + INTERVAL 2 DAY END, '%Y-%m-%d %H:%M:%S') AS next FROM runs WHERE year(started_at) = 2024", RUNS))
def date_14(spark, sf_dir):
    at = F.col("started_at")
    return runs(spark, sf_dir).where(F.year(at) == 2024).select("id", F.date_format(next_check(at, "01-15", "01-20", 2), "yyyy-MM-dd HH:mm:ss").alias("next"))


@query("udf_04_model_merge", sql("SELECT id, CASE WHEN deadline IS NULL THEN '1999-01-01 00:00:00' WHEN length(deadline) < 19 THEN '1999-01-01 00:00:00' ELSE deadline END AS deadline, coalesce(event_time, 'soon') AS event_time FROM notices", NOTICES))
def udf_04(spark, sf_dir):
    rows = notices(spark, sf_dir).withColumns({"m_deadline": F.lit("1999-01-01 00:00:00"), "m_event_time": F.lit("soon"), "m_event_format": F.lit("both")})
    return S.enriched(rows).select("id", "deadline", "event_time")


@query("st_02_seen_keys", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def st_02(spark, sf_dir):
    return S.first_per_key(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("st_03_ttl_batch", "SELECT user_id, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7200 SECOND AS alive FROM events GROUP BY user_id")
def st_03(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).join(F.broadcast(now), F.lit(True)).select("user_id", (F.col("last") >= F.col("now") - F.expr("INTERVAL 7200 SECOND")).alias("alive"))


@query("st_05_run_state", sql("SELECT board, arg_max(status, (started_at, id)) AS status FROM runs GROUP BY board", RUNS))
def st_05(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("board").agg(F.max_by("status", F.struct("started_at", "id")).alias("status"))


@query("st_06_budget", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 15 AND epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)) <= 86400 * 20")
def st_06(spark, sf_dir):
    w = W.partitionBy("user_id")
    n, spent = F.row_number().over(w.orderBy("ts", "event_id")), F.col("ts").cast("timestamp").cast("double") - F.min("ts").over(w).cast("timestamp").cast("double")
    return read(spark, sf_dir, "events").select("event_id", n.alias("n"), spent.alias("spent")).where(f"n <= 15 and spent <= {86400 * 20}").select("event_id")


@query("st_07_rate_quota", "SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) <= 50 AS allowed FROM events")
def st_07(spark, sf_dir):
    n = F.row_number().over(W.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").select("event_id", (n <= 50).alias("allowed"))


@query("st_09_event_windows", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_09(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")

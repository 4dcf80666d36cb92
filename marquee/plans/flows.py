"""Parsers of result pages, model calls behind a stub, and whole flows as compositions, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import matching as M
from ..functions.html import anchors
from ..functions.similarity import similarity
from ..functions.temporal import as_of, parse_datetime
from ..operators import store as S
from ..sources.tables import forum_posts, notices, read, runs, targets
from ..streaming import jobs
from .board import listed
from .ctes import NOTICES, RUNS, TARGETS, sql
from .store import COVERED, PENDING, arrivals, pending

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def boxes(html: Column, pattern: str, names: tuple[str, ...]) -> Column:
    """All matches of a pattern as an array of structs, one field for each group."""
    groups = [F.regexp_extract_all(html, F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)]
    return F.arrays_zip(*groups)


@query("parse_03_search_results", "SELECT o_orderkey AS id, k, 'https://r.example.org/' || o_orderkey || '/' || k AS url, 'result ' || k || ' of ' || o_orderkey AS title, CASE WHEN k % 2 = 0 THEN 'about ' || o_orderpriority ELSE '' END AS snippet FROM orders, range(3) r(k)")
def parse_03(spark, sf_dir):
    """Boxes of a result page: link, title without tags, and the snippet if there is one."""
    page = F.expr("""concat('<ol>', array_join(transform(sequence(0, 2), k -> concat('<li class="b_algo"><h2><a href="https://r.example.org/', o_orderkey, '/', k, '">result <b>', k, '</b> of ', o_orderkey, '</a></h2>', IF(k % 2 = 0, concat('<p>about ', o_orderpriority, '</p>'), ''), '</li>')), ''), '</ol>')""")
    found = boxes(page, r'<li class="b_algo"><h2><a href="([^"]+)">(.*?)</a></h2>(?:<p>(.*?)</p>)?', ("url", "title", "snippet"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(found).alias("k", "x"))
    return rows.select("id", F.col("k").cast("long").alias("k"), "x.url", F.regexp_replace("x.title", "<[^>]+>", "").alias("title"), "x.snippet")


@query("parse_04_message_results", "SELECT o_orderkey AS id, 'https://mp.example.org/s/' || o_orderkey AS url, 'post ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders WHERE o_orderkey % 3 > 0")
def parse_04(spark, sf_dir):
    """Boxes of a message search: link, title, snippet and the time as seconds since 1970; boxes without a link are no rows."""
    page = F.expr("""concat('<div class="txt-box"><h3><a href="', IF(o_orderkey % 3 > 0, concat('https://mp.example.org/s/', o_orderkey), ''), '">post ', o_orderkey, '</a></h3><span>', unix_timestamp(o_orderdate), '</span></div>')""")
    found = boxes(page, r'<div class="txt-box"><h3><a href="([^"]+)">(.*?)</a></h3><span>(\d+)</span>', ("url", "title", "at"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(found).alias("x"))
    return rows.select("id", "x.url", "x.title", F.date_format(F.timestamp_seconds(F.col("x.at").cast("long")), "yyyy-MM-dd").alias("posted"))


@query("parse_06_best_detail")
def parse_06(spark, sf_dir):
    """Without SQL (similarity): of a listing's links the one most like the wanted title; taken from a score of 2, or if it is the only one."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    wanted = p.select("page_id", F.substring(F.regexp_extract("html", "<title>(.*?)</title>", 1), 1, 40).alias("wanted"))
    rows = anchors(p).where("href is not null and length(text) > 0").join(wanted, "page_id")
    score = F.when(F.col("wanted").contains(F.substring("text", 1, 8)), 2.0).otherwise(0.0) + F.when(F.col("text").rlike(r"20\d\d"), 0.5).otherwise(0.0) + similarity("wanted", "text")
    best = rows.withColumn("score", score).groupBy("page_id").agg(F.max_by(F.struct("href", "text", "score"), F.struct("score", -F.col("ord"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.where((F.col("b.score") >= 2) | (F.col("n") == 1)).select("page_id", "b.href", F.round("b.score", 6).alias("score"))


_LINK = r'<a href="(/[^"]*)">([^<]*)</a>'


@query("parse_07_hinted_links", f"""WITH a AS (SELECT page_id, root || unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS text, unnest(range(len(regexp_extract_all(html, '{_LINK}')))) AS k
    FROM (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM pages)), s AS (SELECT *, contains(lower(text), 'the')::INT + contains(lower(text), 'er')::INT + contains(lower(text), 'in')::INT AS score FROM a)
    SELECT page_id, href, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, k) <= 3""")
def parse_07(spark, sf_dir):
    """A page's links to its own host that its hints speak for, best first, three at most (a limit of the operator)."""
    p = read(spark, sf_dir, "pages")
    root = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    rows = p.select("page_id", root.alias("root"), F.posexplode(boxes(F.col("html"), _LINK, ("path", "text"))).alias("k", "x"))
    score = sum((F.lower("x.text").contains(w).cast("int") for w in ("the", "er", "in")), F.lit(0))
    place = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "k"))
    return rows.withColumn("score", score).where("score > 0").withColumn("place", place).where("place <= 3").select("page_id", F.concat("root", "x.path").alias("href"), "score")


@query("src_10_forum_threads", "SELECT conv_id, title FROM (SELECT conv_id, arg_min(text, turn)[1:60] AS title FROM conversations GROUP BY conv_id) WHERE conv_id % 4 > 0 AND length(title) >= 8 QUALIFY row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id DESC) <= 40")
def src_10(spark, sf_dir):
    """Threads of each board that are not known yet and pass the title gate, the newest ones up to the board's limit."""
    posts = forum_posts(spark, sf_dir)
    seen = posts.where("conv_id % 4 = 0").select("conv_id")
    place = F.row_number().over(W.partitionBy(F.col("conv_id") % 3).orderBy(F.desc("conv_id")))
    return posts.join(seen, "conv_id", "left_anti").where("length(title) >= 8").withColumn("place", place).where("place <= 40").select("conv_id", "title")


@query("src_15_portal_lists", sql("""SELECT ord, h, p FROM targets, range(3) a(h), range(6) b(p) WHERE (ord * 7 + h * 131 + p * 29) % 600 > 300 QUALIFY row_number() OVER (PARTITION BY ord ORDER BY h, p) = 1""", TARGETS))
def src_15(spark, sf_dir):
    """Of each target's candidate hosts and paths the first whose page is a list of more than 300 characters."""
    tries = targets(spark, sf_dir).select("ord", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("h")).select("ord", "h", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("p"))
    found = tries.where((F.col("ord") * 7 + F.col("h") * 131 + F.col("p") * 29) % 600 > 300)
    return found.groupBy("ord").agg(F.min(F.struct("h", "p")).alias("x")).select("ord", F.col("x.h").cast("long").alias("h"), F.col("x.p").cast("long").alias("p"))


@query("src_16_message_article", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'js ' WHEN 1 THEN 'og ' WHEN 2 THEN 'head ' ELSE '' END || CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey::VARCHAR ELSE '' END AS title,
    CASE o_orderkey % 4 WHEN 3 THEN '' WHEN 0 THEN 'a description of twenty letters ' || o_orderkey ELSE 'the content of ' || o_orderkey END AS body FROM orders""")
def src_16(spark, sf_dir):
    """Title: script variable, og:title, heading. Body: description of 20 characters or more, else the content block; none on a blocked page."""
    html = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN concat('<script>var msg_title = "js ', o_orderkey, '"; var msg_desc = "a description of twenty letters ', o_orderkey, '";</script><h1>x</h1>')
        WHEN 1 THEN concat('<meta property="og:title" content="og ', o_orderkey, '"><script>var msg_desc = "short";</script><div id="js_content">the content of ', o_orderkey, '</div>')
        WHEN 2 THEN concat('<h1 class="t"> head ', o_orderkey, ' </h1><div id="js_content">the <b>content</b> of ', o_orderkey, '</div>') ELSE '<h1>environment abnormal</h1>' END""")
    got = lambda p: F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit(""))
    blocked, desc = F.col("html").contains("environment abnormal"), got('var msg_desc = "([^"]*)"')
    title = F.coalesce(got('var msg_title = "([^"]*)"'), got('property="og:title" content="([^"]*)"'), got("<h1[^>]*>(.*?)</h1>"))
    body = F.coalesce(F.when(F.length(desc) >= 20, desc), F.regexp_replace(got('<div id="js_content">(.*?)</div>'), "<[^>]+>", ""))
    clear = lambda c: F.when(blocked, "").otherwise(F.coalesce(c, F.lit("")))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), html.alias("html")).select("id", clear(title).alias("title"), clear(body).alias("body"))


def verdict(answer: Column) -> Column:
    """True or false for an answer that says YES or NO, null for one that says neither or both."""
    yes, no = F.upper(answer).rlike(r"\bYES\b"), F.upper(answer).rlike(r"\bNO\b")
    return F.when(yes & ~no, True).when(no & ~yes, False)


@query("udf_02_relevance_policy", """SELECT conv_id, turn, NOT (conv_id % 5 = 1 AND length(text) >= 40) AS keep_notice, length(text) >= 8 AND (conv_id % 5 IN (0, 3) OR conv_id % 5 = 1 AND contains(text, 'the')) AS keep_thread FROM conversations""")
def udf_02(spark, sf_dir):
    """What a model's answer decides: notices stay unless it clearly says NO; threads go unless it says YES, fails, or their title looks official."""
    answer = F.expr("CASE conv_id % 5 WHEN 0 THEN 'YES.' WHEN 1 THEN 'no, because' WHEN 2 THEN 'maybe' WHEN 4 THEN 'yes and no' END")
    said, failed, text = verdict(answer), answer.isNull(), F.col("text")
    notice = (F.length(text) < 40) | failed | F.coalesce(said, F.lit(True))
    thread = (F.length(text) >= 8) & (failed | F.coalesce(said, F.lit(False)) | (F.coalesce(~said, F.lit(False)) & text.contains("the")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", notice.alias("keep_notice"), thread.alias("keep_thread"))


def cached_calls(rows: DataFrame, cache: DataFrame, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (key, text) with the cached value of their key, else with that of one call per new key. ``call`` adds ``value`` to (key, text)."""
    known = rows.select("key").distinct().join(cache, "key")
    new = call(rows.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))).select("key", "value")
    values = known.select("key", "value", F.lit("cache").alias("origin")).union(new.select("key", "value", F.lit("model").alias("origin")))
    return rows.join(values, "key", "left")


@query("udf_03_cached_extraction", "SELECT doc_id, reverse(text[1:12]) AS value, CASE WHEN bool_or(doc_id % 3 = 0) OVER (PARTITION BY text) THEN 'cache' ELSE 'model' END AS origin FROM documents")
def udf_03(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.substring(F.sha2("text", 256), 1, 24).alias("key"))
    stub = lambda rows: rows.withColumn("value", F.reverse(F.substring("text", 1, 12)))
    cache = stub(d.where("doc_id % 3 = 0")).select("key", "value").distinct()
    return cached_calls(d, cache, stub).select("doc_id", "value", "origin")


@query("udf_05_links_of_both", """SELECT page_id, len(list_distinct(list_concat(regexp_extract_all(html, 'href="([^"]+)"', 1), CASE WHEN page_id % 2 = 0 THEN ['https://model.example.org/' || page_id] ELSE []::VARCHAR[] END))) AS n FROM pages""")
def udf_05(spark, sf_dir):
    """Links found by pattern, then those that only the model names."""
    told = F.when(F.col("page_id") % 2 == 0, M.url_array(F.concat(F.lit('links: ["https://model.example.org/'), "page_id", F.lit('#a"]')))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "pages").select("page_id", F.size(F.array_distinct(F.concat(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)), told))).cast("long").alias("n"))


@query("udf_06_enrichment", sql("""SELECT id, CASE WHEN source LIKE '%manual%' OR filled = 4 OR id % 19 = 0 THEN event_time ELSE coalesce(event_time, 'model time') END AS event_time, source LIKE '%manual%' OR filled = 4 OR id % 19 = 0 AS skipped
    FROM labelled WHERE source LIKE '%manual%' OR filled = 4 OR id % 19 = 0 OR id % 23 <> 0""", NOTICES))
def udf_06(spark, sf_dir):
    """Manual and complete rows and those that wait for a person are skipped; rejected ones go; the others get what is missing."""
    n = notices(spark, sf_dir).withColumns({"needs_manual": F.col("id") % 19 == 0, "relevant": F.col("id") % 23 != 0})
    skipped = C.is_manual() | (C.confidence() == 1) | F.col("needs_manual")
    return n.where(skipped | F.col("relevant")).select("id", F.when(skipped, F.col("event_time")).otherwise(F.coalesce("event_time", F.lit("model time"))).alias("event_time"), skipped.alias("skipped"))


QUERIES["st_01_incremental_runs"] = jobs.incremental_runs
SQL["st_01_incremental_runs"] = "SELECT CASE WHEN event_id % 3 > 0 THEN 1 ELSE 2 END::INT AS run, count(*) AS n FROM events GROUP BY 1"
QUERIES["st_08_learned_rules"] = lambda spark, sf_dir: jobs.learned_rules(spark, notices(spark, sf_dir))
SQL["st_08_learned_rules"] = sql(
    """SELECT id, EXISTS (SELECT 1 FROM taught t WHERE t.part < b.part AND t.prefix = b.title[1:24]) AS rejected FROM parts b""", NOTICES, "parts AS (SELECT id, title, id * 4 // (SELECT max(id) + 1 FROM notices) AS part FROM notices)", "taught AS (SELECT DISTINCT title[1:24] AS prefix, part FROM parts WHERE id % 200 = 0)"
)


@query("pipe_01_discovery_stages", sql("SELECT university, college, id, stage::INT AS stage FROM (SELECT *, CASE WHEN id % 11 = 0 THEN 0 WHEN id % 3 = 0 THEN 1 ELSE 2 END AS stage FROM notices) QUALIFY stage = min(stage) OVER (PARTITION BY university, college)", NOTICES))
def pipe_01(spark, sf_dir):
    """Seeds, then search, then crawl: a target's later stages count only if the earlier ones found nothing."""
    items = notices(spark, sf_dir).select("university", "college", "id", F.when(F.col("id") % 11 == 0, 0).when(F.col("id") % 3 == 0, 1).otherwise(2).alias("stage"))
    first = items.groupBy("university", "college").agg(F.min("stage").alias("stage"))
    return items.join(first, ["university", "college", "stage"]).select("university", "college", "id", "stage")


_GATES = "CASE WHEN id % 29 = 0 THEN 'bad_url' WHEN id % 13 = 0 THEN 'not_official' WHEN title NOT LIKE '%recruitment%' THEN 'noise' WHEN id % 7 = 0 THEN 'stale' ELSE 'ok' END"


def gated(rows: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """The code of the first gate that a row does not pass, ``ok`` for the others."""
    return rows.withColumn("code", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates], F.lit("ok")))


@query("pipe_02_search_verify", sql(f"SELECT id, {_GATES} AS code FROM notices", NOTICES))
def pipe_02(spark, sf_dir):
    """Hits of a search through their gates: address, official source, title, year."""
    n = notices(spark, sf_dir).withColumn("url", F.when(F.col("id") % 29 == 0, "javascript:void(0)").when(F.col("id") % 13 == 0, "https://blog.example.net/1").otherwise(F.col("url")))
    source = M.official_source(F.col("url"), F.col("title"), F.col("summary"), F.col("university"), F.col("college"), C.host(F.col("url")), (".example.org",), "weixin", ("recruitment",))
    gates = [("bad_url", F.col("url").rlike("^https?://")), ("not_official", source["ok"]), ("noise", F.col("title").contains("recruitment")), ("stale", F.col("publish_date").isNotNull())]
    return gated(n, gates).select("id", "code")


@query("pipe_08_submission", sql("SELECT id, CASE WHEN id % 31 = 0 THEN 'missing_college' WHEN id % 29 = 0 THEN 'bad_url' WHEN id % 5 = 0 THEN 'noise' WHEN id % 3 = 0 THEN 'known' ELSE 'ok' END AS code FROM notices", NOTICES))
def pipe_08(spark, sf_dir):
    """Submitted links: the fields, the address, the title, and whether the row is there already; only ``ok`` rows go on to the upsert."""
    n = notices(spark, sf_dir)
    sent = n.withColumns({"url": F.when(F.col("id") % 29 == 0, "ftp://x").otherwise(F.col("url")), "college": F.when(F.col("id") % 31 == 0, " ").otherwise(F.col("college"))})
    known = n.where("id % 3 = 0").select("url", F.lit(True).alias("known"))
    gates = [("missing_college", F.trim("college") != ""), ("bad_url", F.col("url").rlike("^https?://")), ("noise", F.col("title").contains("recruitment")), ("known", F.col("known").isNull())]
    return gated(sent.join(known, "url", "left"), gates).select("id", "code")


@query("pipe_07_crawl_run", sql("""SELECT (SELECT count(*) FROM notices WHERE NOT (source LIKE '%manual%' OR regexp_extract(title, '(20[0-9][0-9])', 1)::INT >= 2024)) AS purged, (SELECT count(*) FROM pending) AS planned,
    (SELECT count(*) FROM notices WHERE id % 50 = 0) AS inserted, (SELECT count(*) FROM notices WHERE id % 5 = 0 AND ((id % 2 = 0 AND deadline IS DISTINCT FROM '1999-01-01') OR id % 3 = 0)) AS updated,
    (SELECT count(*) FROM notices WHERE status = 'active' AND deadline_ts < TIMESTAMP '1998-04-01') AS aged""", NOTICES, TARGETS, COVERED, PENDING))
def pipe_07(spark, sf_dir):
    """One run as a log row: rows purged, targets planned, rows inserted and updated by what was found, rows that aged."""
    n = notices(spark, sf_dir)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    saved = S.upsert_notices(n, arrivals(spark, sf_dir), as_of()).agg(F.count_if(F.col("change") == "inserted").alias("inserted"), F.count_if(F.col("change") == "updated").alias("updated"))
    log = one(n.where(~(C.is_manual() | C.year_ok(2024, 2026))), "purged").join(one(pending(spark, sf_dir), "planned"), F.lit(True), "left").join(saved, F.lit(True), "left")
    return log.join(one(n.where((F.col("status") == "active") & (parse_datetime(F.col("deadline")) < as_of())), "aged"), F.lit(True), "left")


@query("pipe_09_governance", sql("SELECT university, college, CASE WHEN base_url <> '' THEN 'not_published' WHEN ord % 2 = 0 THEN 'watching' ELSE 'domain_failure' END AS kind FROM targets", TARGETS))
def pipe_09(spark, sf_dir):
    """Targets without a homepage are watched if one of their alias hosts answers; the probes are a table."""
    t = targets(spark, sf_dir).withColumn("alias", F.explode_outer(M.alias_hosts(F.concat(F.lit("https://www."), F.lower(F.replace("university", F.lit("_"), F.lit(""))), F.lit(".edu.cn")), F.col("college_type"))))
    answered = t.where("ord % 2 = 0 and base_url = ''").groupBy("ord").agg(F.min("alias").alias("found"))
    kind = F.when(F.col("base_url") != "", "not_published").when(F.col("found").isNotNull(), "watching").otherwise("domain_failure")
    return targets(spark, sf_dir).join(answered, "ord", "left").select("university", "college", kind.alias("kind"))


@query("pipe_10_full_refresh", sql("""SELECT university, college, college_type, count(*) AS before, 1::BIGINT AS kept FROM notices GROUP BY ALL""", NOTICES))
def pipe_10(spark, sf_dir):
    """Snapshot, clear, restore, report: what was there, and what the restored snapshot holds for each college."""
    n, key = notices(spark, sf_dir), ["university", "college", "college_type"]
    restored = S.snapshot(n).groupBy(*key).agg(F.count(F.lit(1)).alias("kept"))
    return n.groupBy(*key).agg(F.count(F.lit(1)).alias("before")).join(restored, key, "left").select(*key, "before", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))


@query("api_01_announcements", sql("SELECT id, effective AS status FROM labelled WHERE slot LIKE 'camp%' AND effective = 'active' AND college_type = 'law' AND category = 'official' AND (title ILIKE '%nation_1%' OR university ILIKE '%nation_1%' OR college ILIKE '%nation_1%')", NOTICES))
def api_01_announcements(spark, sf_dir):
    """The list endpoint with its filters: board, status, type, source, and a search text in which % and _ are wildcards."""
    search = "%nation_1%"
    found = F.col("title").ilike(search) | F.col("university").ilike(search) | F.col("college").ilike(search)
    rows = listed(spark, sf_dir).where(F.col("slot").startswith("camp") & (F.col("effective") == "active") & (F.col("college_type") == "law") & (F.col("category") == "official") & found)
    return rows.select("id", F.col("effective").alias("status"))


@query("api_01_crawl_status", sql("SELECT board, arg_max(status, (started_at, id)) AS status, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS started_at FROM runs GROUP BY board", RUNS))
def api_01_status(spark, sf_dir):
    last = runs(spark, sf_dir).groupBy("board").agg(F.max_by("status", F.struct("started_at", "id")).alias("status"), F.max("started_at").alias("started_at"))
    return last.select("board", "status", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query("api_02_trigger", sql("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'invalid_tier' WHEN c_custkey % 2 = 1 AND EXISTS (SELECT 1 FROM runs WHERE status = 'running' AND board = 'pre_admission') THEN 'running' ELSE 'started' END AS code FROM customer", RUNS))
def api_02(spark, sf_dir):
    """Requests to crawl: an unknown tier is refused, and so is a board that is being crawled."""
    board = F.when(F.col("c_custkey") % 2 == 1, "pre_admission").otherwise("spring_camp").alias("board")
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), board, F.when(F.col("c_custkey") % 4 == 0, "top").otherwise("985").alias("tier"))
    busy = runs(spark, sf_dir).where("status = 'running'").select("board", F.lit(True).alias("busy")).distinct()
    return gated(asked.join(busy, "board", "left"), [("invalid_tier", F.col("tier").isin("985", "211", "dual")), ("running", F.col("busy").isNull())]).select("id", F.when(F.col("code") == "ok", "started").otherwise(F.col("code")).alias("code"))

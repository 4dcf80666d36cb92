"""Whose an announcement is and where it stands: addresses, colleges, links, attributions and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import matching as M
from ..functions.announced import model_datetime
from ..functions.temporal import as_of
from ..operators import store as S
from ..sources.tables import directory, notices, read, runs, targets
from .announce import TEXTS, lines
from .board import listed
from .ctes import DIRECTORY, NOTICES, RUNS, TARGETS, sql

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


SITES = """sites AS (SELECT s_suppkey AS ord, n_name AS university, CASE WHEN s_suppkey % 2 = 0 THEN 'law' ELSE 'foreign_lang' END AS college_type, ['BUILDING', 'MACHINERY', 'FURNITURE', 'AUTOMOBILE'][s_suppkey % 4 + 1] AS college,
    'https://' || CASE s_suppkey % 3 WHEN 0 THEN 'www.' WHEN 1 THEN 'fxy.' ELSE 'wyxy.' END || 'n' || n_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '.edu.cn/' ELSE '.example.org' END AS homepage FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def sites(spark, sf_dir):
    """The registry of college sites."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).selectExpr(
        "s_suppkey AS ord", "n_name AS university", "CASE WHEN s_suppkey % 2 = 0 THEN 'law' ELSE 'foreign_lang' END AS college_type", "element_at(array('BUILDING', 'MACHINERY', 'FURNITURE', 'AUTOMOBILE'), cast(s_suppkey % 4 + 1 AS int)) AS college",
        "concat('https://', CASE s_suppkey % 3 WHEN 0 THEN 'www.' WHEN 1 THEN 'fxy.' ELSE 'wyxy.' END, 'n', n_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN '.edu.cn/' ELSE '.example.org' END) AS homepage",
    )


@query("proj_12_candidate_urls", sql("""SELECT ord, array_to_string(list_concat(CASE WHEN ord % 5 = 0 THEN [b || '/found'] ELSE []::VARCHAR[] END, CASE WHEN ord % 3 = 0 THEN [b || '/manual', b || '/news'] ELSE []::VARCHAR[] END,
    list_filter([b, b || '/news', b || '/tzgg', b || '/info', b || '/notice', b || '/xwzx', b || '/list.htm', b || '/news/tzgg/index.htm'], lambda x: ord % 3 <> 0 OR x <> b || '/news')), ' ') AS urls FROM (SELECT ord, rtrim(homepage, '/') AS b FROM sites)""", SITES))
def proj_12(spark, sf_dir):
    none, base = F.array().cast("array<string>"), F.rtrim("homepage", F.lit("/"))
    manual = F.when(F.col("ord") % 3 == 0, F.array(F.concat(base, F.lit("/manual")), F.concat(base, F.lit("/news")))).otherwise(none)
    found = F.when(F.col("ord") % 5 == 0, F.array(F.concat(base, F.lit("/found")))).otherwise(none)
    paths = ("/news", "/tzgg", "/info", "/notice", "/xwzx", "/list.htm", "/news/tzgg/index.htm")
    return sites(spark, sf_dir).select("ord", F.array_join(M.candidate_urls(F.col("homepage"), paths, manual, found), " ").alias("urls"))


_POOL = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("proj_13_alias_hosts", sql(f"""SELECT ord, array_to_string(list_transform(list_filter(CASE WHEN college_type = 'law' THEN {_POOL(M.LAW_ALIASES)} ELSE {_POOL(M.LANGUAGE_ALIASES)} END, lambda a: a <> split_part(h, '.', 1)),
    lambda a: a || '.' || CASE WHEN h LIKE '%.edu.cn' THEN array_to_string(string_split(h, '.')[-3:], '.') ELSE array_to_string(string_split(h, '.')[-2:], '.') END)[1:6], ' ') AS hosts
    FROM (SELECT *, replace(regexp_extract(homepage, '^https://([^/]+)', 1), 'www.', '') AS h FROM sites)""", SITES))
def proj_13(spark, sf_dir):
    return sites(spark, sf_dir).select("ord", F.array_join(M.alias_hosts(F.col("homepage"), F.col("college_type")), " ").alias("hosts"))


@query("proj_14_search_queries", sql("""SELECT ord, array_to_string(list_transform(['"' || university || '" "' || college || '" camp', '"' || university || '" "' || college || '" notice', university || ' ' || college || ' camp', university || ' ' || college || ' notice',
    'site:' || h || ' camp', 'site:' || h || ' notice', 'site:' || r || ' camp', 'site:' || r || ' notice'], lambda q: q || ' -school -training')[1:CASE WHEN h = r THEN 6 ELSE 7 END], '; ') AS queries FROM (SELECT *, CASE WHEN h LIKE '%.edu.cn'
    THEN array_to_string(string_split(h, '.')[-3:], '.') ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS r FROM (SELECT *, replace(regexp_extract(homepage, '^https://([^/]+)', 1), 'www.', '') AS h FROM sites))""", SITES))
def proj_14(spark, sf_dir):
    h = C.host(F.col("homepage"))
    made = M.search_queries(F.col("university"), F.col("college"), F.array(h, M.registered_suffix(h)), ("camp", "notice"), ("school", "training"), 7)
    return sites(spark, sf_dir).select("ord", F.array_join(made, "; ").alias("queries"))


@query("proj_15_payload_fields", sql("""SELECT id, iso1 || ' 00:00:00' AS publish_date, CASE WHEN id % 3 > 0 THEN iso2 || ' 09:05:00' END AS deadline, CASE WHEN id % 5 = 0 THEN NULL ELSE year(d3) || '年' || month(d3) || '月' || day(d3) || '日' ||
    CASE WHEN id % 5 < 3 THEN '至' || year(d4) || '年' || month(d4) || '月' || day(d4) || '日' ELSE '' END END AS event_time, CASE id % 4 WHEN 0 THEN 'online' WHEN 1 THEN 'both' WHEN 2 THEN 'offline' END AS event_format FROM lines""", TEXTS))
def proj_15(spark, sf_dir):
    """Fields of a model's answer, a JSON object with alias keys: the first key that is there counts."""
    day = lambda d, c: F.when(c, F.date_format(d, "yyyy.M.d"))
    i = F.col("id")
    start, end = day("d3", i % 5 != 0), day("d4", (i % 5 != 0) & (i % 5 < 3))
    payload = F.to_json(F.struct(
        F.date_format("d1", "yyyy年M月d日").alias("publish_date"), F.when(i % 3 > 0, F.concat(F.date_format("d2", "yyyy-M-d"), F.lit(" 9:05"))).alias("deadline"), F.when(i % 2 == 0, start).alias("event_start"), F.when(i % 2 == 1, start).alias("camp_start"),
        F.when(i % 2 == 1, end).alias("event_end"), F.when(i % 2 == 0, end).alias("camp_end"), F.expr("CASE id % 4 WHEN 0 THEN '线上' WHEN 1 THEN '线上线下结合' WHEN 2 THEN '线下' END").alias("format"),
    ))
    keys = ("publish_date", "deadline", "event_start", "camp_start", "event_end", "camp_end", "event_format", "format")
    p = lines(spark, sf_dir).select("id", F.from_json(payload, ", ".join(f"{k} string" for k in keys)).alias("p")).select("id", "p.*")
    local = lambda t: F.date_format(F.to_date(F.substring(t, 1, 10)), "yyyy年M月d日")
    first, last = model_datetime(F.coalesce("event_start", "camp_start")), model_datetime(F.coalesce("event_end", "camp_end"))
    form = F.coalesce("event_format", "format")
    kind = F.when(form.rlike("混合|结合|线上.*线下|线下.*线上"), "both").when(form.contains("线上"), "online").when(form.contains("线下"), "offline")
    return p.select("id", model_datetime(F.col("publish_date")).alias("publish_date"), model_datetime(F.col("deadline")).alias("deadline"), F.when(first.isNotNull(), F.concat_ws("至", local(first), local(last))).alias("event_time"), kind.alias("event_format"))


@query("proj_17_institutions", sql("""SELECT d.ord, coalesce(e.homepage, t.homepage, '') AS homepage, coalesce(m.university IS NOT NULL, false) OR c.university IS NOT NULL AS monitored FROM directory d
    LEFT JOIN (SELECT university, college, college_type, arg_min(homepage, ord) AS homepage FROM sites GROUP BY ALL) e USING (university, college, college_type)
    LEFT JOIN (SELECT university, college_type, arg_min(homepage, ord) AS homepage, arg_min(college, ord) AS named FROM sites GROUP BY ALL) t ON d.university = t.university AND d.college_type = t.college_type
    LEFT JOIN (SELECT university, college, college_type FROM targets WHERE ord % 2 = 0) m ON d.university = m.university AND d.college = m.college AND d.college_type = m.college_type
    LEFT JOIN (SELECT university, college, college_type FROM targets WHERE ord % 2 = 0) c ON e.homepage IS NULL AND d.university = c.university AND t.named = c.college AND d.college_type = c.college_type""", DIRECTORY, TARGETS, SITES))
def proj_17(spark, sf_dir):
    """Directory rows with the homepage of their own college, else of one of their type, and whether either name is a target."""
    s, d, key = sites(spark, sf_dir), directory(spark, sf_dir), ["university", "college_type"]
    exact = s.groupBy(*key, "college").agg(F.min_by("homepage", "ord").alias("own"))
    by_type = s.groupBy(*key).agg(F.min_by("homepage", "ord").alias("near"), F.min_by("college", "ord").alias("named"))
    watched = targets(spark, sf_dir).where("ord % 2 = 0").select(*key, "college").distinct()
    rows = d.join(exact, [*key, "college"], "left").join(by_type, key, "left").withColumn("canonical", F.when(F.col("own").isNull(), F.col("named")))
    rows = rows.join(watched.withColumn("m", F.lit(True)), [*key, "college"], "left").join(watched.select(*key, F.col("college").alias("canonical"), F.lit(True).alias("c")), [*key, "canonical"], "left")
    return rows.select("ord", F.coalesce("own", "near", F.lit("")).alias("homepage"), F.coalesce("m", "c", F.lit(False)).alias("monitored"))


COLLEGES = ("法学院", "外国语学院", "经济学院", "国际法学院", "英语学院", "未知")
NAMED = f"""named AS (SELECT c_custkey AS id, n_name || '大学' AS university, {_POOL(COLLEGES)}[c_custkey % 6 + 1] AS college,
    n_name || '大学' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE {_POOL(COLLEGES)}[c_custkey // 6 % 5 + 1] END || '2026年夏令营' || CASE WHEN c_custkey % 11 = 0 THEN '法学' ELSE '' END AS title FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def named(spark, sf_dir):
    """Titles that name one college, for targets that expect another."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    pool = "array(" + ", ".join(f"'{x}'" for x in COLLEGES) + ")"
    rows = c.join(n, c.c_nationkey == n.n_nationkey).selectExpr("c_custkey AS id", "concat(n_name, '大学') AS university", f"element_at({pool}, cast(c_custkey % 6 + 1 AS int)) AS college", f"IF(c_custkey % 7 = 0, '', element_at({pool}, cast(c_custkey div 6 % 5 + 1 AS int))) AS spoken")
    return rows.selectExpr("id", "university", "college", "concat(university, spoken, '2026年夏令营', IF(id % 11 = 0, '法学', '')) AS title")


@query("pred_08_college_mismatch", sql("""SELECT id, college <> '未知' AND NOT contains(title, college) AND NOT (length(replace(college, '学院', '')) >= 2 AND contains(title, replace(college, '学院', ''))) AND spoken NOT IN ('', '法学院') AND NOT contains(spoken, college) AND NOT contains(college, spoken)
    AND NOT (college LIKE '%法学院' AND contains(spoken, '法学')) AND NOT (college LIKE '%外国语%' AND regexp_matches(spoken, '外语|外国语|外文|英语')) AS mismatch FROM (SELECT *, CASE WHEN id % 7 = 0 THEN '' ELSE """ + _POOL(COLLEGES) + """[id // 6 % 5 + 1] END AS spoken FROM named)""", NAMED))
def pred_08(spark, sf_dir):
    return named(spark, sf_dir).select("id", M.college_mismatch(F.col("title"), F.col("university"), F.col("college")).alias("mismatch"))


@query("pred_27_college_in_title", sql(f"""SELECT id, contains(title, college) AND length(college) >= 3 OR contains(title, regexp_replace(college, '学院|系|部', '', 'g')) OR len(list_filter({_POOL(M.FAMILIES)}, lambda f: contains(college, f) AND contains(title, f))) > 0 AS named FROM named""", NAMED))
def pred_27(spark, sf_dir):
    return named(spark, sf_dir).select("id", M.college_in_title(F.col("title"), F.col("college")).alias("named"))


@query("pred_11_subject_relevance", sql("""SELECT id, contains(title, 'recruitment') AND (category = 'messaging' OR CASE WHEN college_type = 'law' THEN regexp_matches(title, 'BUILDING|FURNITURE') ELSE regexp_matches(title, 'MACHINERY|AUTOMOBILE|HOUSEHOLD') END) AS relevant FROM labelled""", NOTICES))
def pred_11(spark, sf_dir):
    return listed(spark, sf_dir).select("id", C.subject_relevant(F.col("title"), F.col("college_type"), F.col("category") == "messaging", ("recruitment",)).alias("relevant"))


_URLS = "CASE id % 6 WHEN 0 THEN 'https://mp.weixin.example.org/s/' || id WHEN 1 THEN 'https://other.example.org/about/' || id WHEN 2 THEN 'https://other.example.org/notice/' || id WHEN 3 THEN 'https://x.com/notice/1' ELSE url END"


@query("pred_15_official_source", sql("SELECT id, id % 6 <> 3 AND (id % 6 <> 1 OR contains(title, 'recruitment')) AS ok, CASE id % 6 WHEN 0 THEN 'messaging' WHEN 1 THEN CASE WHEN contains(title, 'recruitment') THEN 'university' ELSE '' END WHEN 2 THEN 'university' WHEN 3 THEN '' ELSE 'college' END AS label FROM notices", NOTICES))
def pred_15(spark, sf_dir):
    n = notices(spark, sf_dir).withColumn("target_host", C.host(F.col("url"))).withColumn("url", F.expr(_URLS))
    got = M.official_source(F.col("url"), F.col("title"), F.lit(None).cast("string"), F.col("university"), F.col("college"), F.col("target_host"), (".example.org",), "weixin", ("recruitment",))
    return n.select("id", got.alias("v")).select("id", "v.ok", "v.label")


@query("pred_20_schedule_gate", sql("""SELECT university, college, CASE ord % 5 WHEN 1 THEN false WHEN 2 THEN ord % 2 = 0 WHEN 3 THEN false WHEN 4 THEN true ELSE true END AS crawl FROM targets""", TARGETS))
def pred_20(spark, sf_dir):
    """No pending row: crawl; a failed domain: never; waiting ones when their time has come and the window is open."""
    t = targets(spark, sf_dir)
    moment = F.expr("CASE WHEN ord % 2 = 0 THEN timestamp'1998-03-01' ELSE timestamp'1998-05-01' END")
    kind = F.expr("CASE ord % 5 WHEN 1 THEN 'domain_failure' WHEN 2 THEN 'watching' WHEN 3 THEN 'not_published' WHEN 4 THEN 'manual' END")
    held = t.select("university", "college", kind.alias("kind"), moment.alias("next_check"), F.when(F.col("ord") % 5 == 2, "03-01").otherwise("07-01").alias("start"), F.lit("08-20").alias("end")).where("kind is not null")
    at = as_of()
    date = lambda c: F.make_date(F.year(at), F.substring(c, 1, 2).cast("int"), F.substring(c, 4, 2).cast("int"))
    open_ = (at >= F.coalesce("next_check", at)) & F.to_date(at).between(date("start"), date("end"))
    crawl = F.when(F.col("kind").isNull(), True).when(F.col("kind") == "domain_failure", False).when(F.col("kind").isin("watching", "not_published"), open_).otherwise(True)
    return t.join(held, ["university", "college"], "left").select("university", "college", crawl.alias("crawl"))


_H = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '')"


@query("pred_24_college_subdomain", f"SELECT page_id, h <> 'example.com' AND NOT (h LIKE 'news.%' AND contains(h, 'example.com')) AND length(split_part(h, '.', 1)) >= 2 AND split_part(h, '.', 1) NOT IN ('www', 'news', 'english') AS own FROM (SELECT page_id, {_H} AS h FROM pages)")
def pred_24(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", M.college_subdomain(F.col("url"), F.lit("example.com")).alias("own"))


BOARD_NAMES = "boards AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN n_name || ' law' WHEN 1 THEN n_name || ' test' WHEN 2 THEN n_name ELSE 'x' END AS name, s_suppkey % 4 AS kind, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query("pred_26_board_prefilter", sql("SELECT id, kind IN (0, 2) AND (kind = 0 OR n_name IN ('NATION_3', 'NATION_4')) AS included, CASE WHEN kind < 3 THEN n_name END AS university FROM boards", BOARD_NAMES))
def pred_26(spark, sf_dir):
    """Boards that are not skipped by name and have a priority name or name a subject; the longest university that they name."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    boards = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("id"), F.expr("CASE s_suppkey % 4 WHEN 0 THEN concat(n_name, ' law') WHEN 1 THEN concat(n_name, ' test') WHEN 2 THEN n_name ELSE 'x' END").alias("name"))
    passed = (F.length("name") >= 2) & ~F.col("name").contains("test") & (F.col("name").isin("NATION_3", "NATION_4") | F.col("name").contains("law"))
    longest = boards.join(n.select("n_name"), F.col("name").contains(F.col("n_name")), "left").groupBy("id").agg(F.max_by("n_name", F.length("n_name")).alias("university"))
    return boards.select("id", passed.alias("included")).join(longest, "id")


@query("url_01_absolute", f"""WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
    SELECT page_id, href, CASE WHEN regexp_matches(href, '^https?://') THEN regexp_replace(href, '#.*', '') WHEN href LIKE '/%' THEN root || regexp_replace(href, '#.*', '') END AS link FROM a WHERE href LIKE '/%' OR href LIKE 'http%'""")
def url_01(spark, sf_dir):
    """Links as absolute addresses without fragments, resolved as the standard library does it."""
    from ..functions.html import absolute_links

    p = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).where("href like '/%' or href like 'http%'")
    return p.select("page_id", "href", absolute_links("url", "href").alias("link"))


@query("url_04_best_link", """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'https://a.edu.cn/notice/77' WHEN 1 THEN 'https://mp.weixin.example.org/s/9' WHEN 2 THEN 'https://forum.example.org/thread-' || c_custkey ELSE '' END AS url,
    CASE c_custkey % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'messaging' WHEN 2 THEN 'forum' ELSE '' END AS source FROM customer""")
def url_04(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    links = F.expr("CASE c_custkey % 4 WHEN 0 THEN array('https://mp.weixin.example.org/s/1', 'https://b.edu.cn/x', 'https://a.edu.cn/notice/77', 'https://c.edu.cn/list') WHEN 1 THEN array('https://shop.example.com/1', 'https://mp.weixin.example.org/s/9') ELSE array('https://shop.example.com/1') END")
    thread = F.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("https://forum.example.org/thread-"), "c_custkey")).otherwise("https://forum.example.org/home")
    best = M.best_link(links, r"\.(edu|ac)\.cn", "mp.weixin", thread, "forum.example.org")
    return c.select(F.col("c_custkey").alias("id"), best.alias("b")).select("id", "b.url", "b.source")


_WORDS = ("the", "ing", "en", "de", "er", "tion")


@query("str_06_key_paragraphs", f"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), p AS (SELECT doc_id, trim(p) AS p, k FROM (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.;])\\s*', '\\1' || chr(1), 'g'), chr(1))) AS p,
        unnest(range(len(string_split(regexp_replace(t, '([.;])\\s*', '\\1' || chr(1), 'g'), chr(1))))) AS k FROM t WHERE length(t) > 3000)),
    s AS (SELECT *, {' + '.join(f"contains(p, '{w}')::INT" for w in _WORDS)} AS s FROM p WHERE length(p) >= 6),
    o AS (SELECT *, sum(length(p)) OVER w - length(p) AS before, row_number() OVER w AS r FROM s WHERE s > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY s DESC, length(p) DESC, k ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT doc_id, min(r) AS last FROM o WHERE before + length(p) > 3000 OR (before + length(p) >= 1500 AND s >= 2) GROUP BY doc_id),
    g AS (SELECT o.doc_id, string_agg(CASE WHEN before + length(p) > 3000 THEN p[1:(3000 - before)::INT] ELSE p END, chr(10) ORDER BY r) FILTER (before + length(p) <= 3000 OR 3000 - before > 80) AS picked FROM o LEFT JOIN e USING (doc_id) WHERE r <= coalesce(last, r) GROUP BY o.doc_id)
    SELECT t.doc_id, CASE WHEN length(t) <= 3000 THEN t ELSE coalesce(picked, t)[1:3000] END AS passages FROM t LEFT JOIN g USING (doc_id)""")
def str_06(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", M.key_paragraphs(F.col("text"), _WORDS).alias("passages"))


@query("json_02_url_array", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['https://a.example.org/' || event_id, 'http://b.example.org/x'] ELSE []::VARCHAR[] END AS urls FROM events")
def json_02(spark, sf_dir):
    raw = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('```json\n["https://a.example.org/', event_id, '#top", "ftp://x", "http://b.example.org/x"]\n```') WHEN 1 THEN 'none found' WHEN 2 THEN '["broken' ELSE '{"a": []}' END""")
    return read(spark, sf_dir, "events").select("event_id", M.url_array(raw).alias("urls"))


@query("src_03_schema_repair", sql("SELECT id, CASE WHEN status = 'running' THEN 'error' ELSE status END AS status, CASE WHEN id % 2 = 0 THEN 'old' ELSE '' END AS tier, found FROM runs", RUNS))
def src_03(spark, sf_dir):
    """Rows of an older schema get the missing columns with defaults; runs that never ended are marked as errors on start."""
    r = runs(spark, sf_dir).select("id", "status", "found")
    both = r.where("id % 2 = 0").withColumn("tier", F.lit("old")).unionByName(r.where("id % 2 <> 0"), allowMissingColumns=True)
    return both.select("id", F.when(F.col("status") == "running", "error").otherwise(F.col("status")).alias("status"), F.coalesce("tier", F.lit("")).alias("tier"), "found")


@query("src_04_directory", sql("SELECT ord, university, region, len(tags) AS n_tags, rtrim('https://' || lower(university) || '.example.org/', '/') AS homepage FROM directory", DIRECTORY))
def src_04(spark, sf_dir):
    """The literal directory: tags from comma-separated text (none for empty text), homepages without a last slash, regions by lookup."""
    d = directory(spark, sf_dir)
    flat = d.select("ord", "university", F.array_join("tags", ",").alias("tags"), F.concat(F.lit("https://"), F.lower("university"), F.lit(".example.org/")).alias("homepage"))
    tags = F.when(F.col("tags") == "", F.array().cast("array<string>")).otherwise(F.split("tags", ","))
    lookup = d.groupBy("university").agg(F.min("region").alias("region"))
    return flat.join(lookup, "university", "left").select("ord", "university", "region", F.size(tags).cast("long").alias("n_tags"), F.rtrim("homepage", F.lit("/")).alias("homepage"))


@query("src_05_side_files", "SELECT event_id, CASE WHEN event_id % 10 > 0 THEN json_extract(props, '$.k')::BIGINT ELSE -1 END AS k FROM events")
def src_05(spark, sf_dir):
    """JSON side files, some of them cut short or missing: those give the default."""
    raw = F.expr("CASE WHEN event_id % 20 = 0 THEN substring(props, 1, 3) WHEN event_id % 10 > 0 THEN props END")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(raw, "k long")["k"], F.lit(-1).cast("long")).alias("k"))


@query("src_06_list_pages", f"""WITH p AS (SELECT {_H} AS host, min(page_id) AS page_id FROM pages WHERE length(html) >= 500 GROUP BY 1) SELECT host, page_id, len(regexp_extract_all(html, '<a[\\s>]')) AS anchors FROM p JOIN pages USING (page_id)""")
def src_06(spark, sf_dir):
    """The first candidate page of each host that has 500 characters or more, and its anchors."""
    from ..functions.html import anchors

    p = read(spark, sf_dir, "pages").withColumn("host", C.host(F.col("url")))
    chosen = p.where(F.length("html") >= 500).groupBy("host").agg(F.min("page_id").alias("page_id"))
    count = anchors(p.join(chosen.select("page_id"), "page_id")).groupBy("page_id").agg(F.count(F.lit(1)).alias("anchors"))
    return chosen.join(count, "page_id", "left").select("host", "page_id", F.coalesce("anchors", F.lit(0).cast("long")).alias("anchors"))


@query("src_13_redirects", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '#.*', '') || '?final' ELSE regexp_replace(url, '#.*', '') END AS final_url FROM pages")
def src_13(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    known = p.where("page_id % 3 = 0").select("url", F.concat(F.substring_index("url", "#", 1), F.lit("?final")).alias("final")).distinct()
    keyed = p.withColumn("asked", F.when(F.col("page_id") % 3 == 0, F.col("url")))
    return keyed.join(known.withColumnRenamed("url", "asked"), "asked", "left").select("page_id", F.coalesce("final", F.substring_index("url", "#", 1)).alias("final_url"))


@query("sort_06_locale")
def sort_06(spark, sf_dir):
    """Rows only: nations in the collation of the locale."""
    return read(spark, sf_dir, "nation").orderBy(F.expr("n_name collate zh"), "n_nationkey").select("n_nationkey", "n_name")


@query("snk_10_purge_invalid", sql("SELECT id, CASE WHEN source LIKE '%manual%' THEN '' WHEN id % 17 = 0 THEN 'url' WHEN id % 5 = 0 THEN 'title' ELSE '' END AS reason FROM notices", NOTICES))
def snk_10(spark, sf_dir):
    """Why a row goes: a bad address, another college in its title, a title that the gate refuses; manual rows stay."""
    n = notices(spark, sf_dir).withColumn("url", F.when(F.col("id") % 17 == 0, "ftp://x").otherwise(F.col("url")))
    gate = F.col("title").contains("recruitment")
    reason = F.when(C.is_manual(), "").when(~F.col("url").rlike("^https?://"), "url").when(M.college_mismatch(F.col("title"), F.col("university"), F.col("college")), "mismatch").when(~gate, "title").otherwise("")
    return n.select("id", reason.alias("reason"))


@query("snk_14_json_files", sql("SELECT university, college, ord FROM targets", TARGETS))
def snk_14(spark, sf_dir):
    """A table as JSON files in the shared folder, and read again."""
    from ..sources.versions import fresh

    path = fresh(spark, "json")
    t = targets(spark, sf_dir).select("university", "college", "ord")
    t.write.json(path)
    return spark.read.schema(t.schema).json(path)


@query("snk_19_homepage_override", sql("""SELECT ord, CASE WHEN ord % 6 = 0 THEN 'root' WHEN ord % 3 = 0 THEN 'blocked' WHEN ord % 4 = 1 THEN 'not http' WHEN ord % 3 = 1 THEN 'ok' ELSE 'subdomain' END AS verdict FROM sites""", SITES))
def snk_19(spark, sf_dir):
    root = F.regexp_extract("homepage", r"(n\d+\.(?:edu\.cn|example\.org))", 1)
    url = F.expr("CASE WHEN ord % 6 = 3 THEN replace(homepage, 'www.', 'zsb.') WHEN ord % 4 = 1 AND ord % 3 <> 0 THEN replace(homepage, 'https', 'ftp') ELSE homepage END")
    return sites(spark, sf_dir).select("ord", M.homepage_verdict(url, root, ("zsb", "zs", "www"), ("fxy", "law")).alias("verdict"))


FEED = """feed AS (SELECT n.id, t.university, t.college, t.ord, CASE WHEN contains(n.title, t.university) THEN 5 ELSE 0 END + CASE WHEN contains(n.title, t.college) OR contains(n.title, substr(t.college, 1, 2)) THEN 4 ELSE 0 END
    + CASE WHEN t.college_type = 'law' AND regexp_matches(n.title, 'BUILDING|FURNITURE') OR t.college_type = 'foreign_lang' AND regexp_matches(n.title, 'MACHINERY|AUTOMOBILE|HOUSEHOLD') THEN 2 ELSE 0 END AS score FROM notices n, targets t WHERE contains(n.title, 'notice'))"""


@query("join_06_feed_attribution", sql("SELECT id, university, college, score FROM feed WHERE score >= 7 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1", NOTICES, TARGETS, FEED))
def join_06(spark, sf_dir):
    """Best target of a feed's rows that name a topic: university (+5), college or its first two characters (+4), subject (+2)."""
    return S.attribute_feed(notices(spark, sf_dir).where(F.col("title").contains("notice")), targets(spark, sf_dir), "title", "id")


@query("join_09_domain_attribution", sql("""SELECT id, coalesce(d.university, t.university, '') AS university, coalesce(d.college, t.college, '') AS college FROM (SELECT id, title, CASE WHEN id % 2 = 0 THEN replace(url, '.example.org', '.elsewhere.net') ELSE url END AS url FROM notices) n
    LEFT JOIN (SELECT regexp_extract(base_url, '//(.*)', 1) AS domain, arg_min(university, ord) AS university, arg_min(college, ord) AS college FROM targets WHERE base_url <> '' GROUP BY 1) d ON regexp_extract(n.url, '//([^/]+)', 1) = d.domain
    LEFT JOIN (SELECT university, arg_min(college, ord) AS college, min(ord) AS o FROM targets GROUP BY 1) t ON d.domain IS NULL AND contains(n.title, t.university)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY t.o) = 1""", NOTICES, TARGETS))
def join_09(spark, sf_dir):
    """Rows of unknown origin: the first target whose domain the address contains, else the first university in the title."""
    n = notices(spark, sf_dir).select("id", "title", F.when(F.col("id") % 2 == 0, F.replace("url", F.lit(".example.org"), F.lit(".elsewhere.net"))).otherwise(F.col("url")).alias("url"))
    return S.attribute_by_domain(n, targets(spark, sf_dir).withColumn("domain", F.regexp_extract("base_url", "//(.*)", 1)))


ARRIVED = """arrived AS (SELECT id AS ord, university, college, title || CASE WHEN id % 10 = 3 THEN ' (revised)' ELSE '' END AS title, CASE id % 10 WHEN 1 THEN url WHEN 2 THEN url || '?moved' WHEN 3 THEN url || '?new' WHEN 4 THEN url || '?x' ELSE url END AS url,
    CASE WHEN id % 10 = 2 THEN url END AS original_url, id FROM notices WHERE id % 10 IN (1, 2, 3, 4) AND id % 3 = 0), first_of AS (SELECT university, college, title[1:24] AS prefix, min(id) AS id FROM notices GROUP BY ALL)"""


@query("join_10_match_existing", sql("""SELECT ord, CASE WHEN id % 10 = 1 THEN id WHEN id % 10 = 2 THEN id ELSE (SELECT min(n.id) FROM notices n WHERE n.university = a.university AND n.college = a.college AND (contains(n.title, a.title[1:24]) OR contains(a.title, n.title[1:24]))) END AS id,
    CASE WHEN id % 10 = 1 THEN 'url' WHEN id % 10 = 2 THEN 'original_url' ELSE 'title' END AS leg FROM arrived a""", NOTICES, ARRIVED))
def join_10(spark, sf_dir):
    """Which stored row an arrival is: by url, else by original url, else the first one of its college whose title begins alike."""
    n = notices(spark, sf_dir)
    return S.match_existing(n, moved_arrivals(n))


def moved_arrivals(n):
    k = F.col("id") % 10
    new_url = F.when(k == 2, F.concat("url", F.lit("?moved"))).when(k == 3, F.concat("url", F.lit("?new"))).when(k == 4, F.concat("url", F.lit("?x"))).otherwise(F.col("url"))
    return n.where(k.isin(1, 2, 3, 4) & (F.col("id") % 3 == 0)).select(
        F.col("id").alias("ord"), "university", "college", F.concat("title", F.when(k == 3, " (revised)").otherwise("")).alias("title"), new_url.alias("url"), F.when(k == 2, F.col("url")).alias("original_url"), "deadline", "summary"
    )


@query("snk_01_three_way", sql("""SELECT n.id, coalesce(a.url, n.url) AS url, coalesce(a.title, n.title) AS title, CASE WHEN a.url IS NOT NULL AND (a.url <> n.url OR a.title <> n.title OR coalesce(a.deadline, n.deadline) IS DISTINCT FROM n.deadline
    OR length(coalesce(a.summary, '')) > length(coalesce(n.summary, ''))) THEN 'updated' ELSE 'kept' END AS change FROM notices n LEFT JOIN (SELECT x.*, CASE WHEN id % 10 <= 2 THEN id ELSE (SELECT min(o.id) FROM notices o WHERE o.university = x.university
    AND o.college = x.college AND (contains(o.title, x.title[1:24]) OR contains(x.title, o.title[1:24]))) END AS target, FROM (SELECT v.*, n2.deadline, n2.summary FROM arrived v JOIN notices n2 ON n2.id = v.id) x QUALIFY row_number() OVER (PARTITION BY target ORDER BY ord) = 1) a ON a.target = n.id""", NOTICES, ARRIVED))
def snk_01_three_way(spark, sf_dir):
    """All rows after arrivals under new addresses and titles were merged into the rows that they are."""
    n = notices(spark, sf_dir)
    return S.upsert_matched(n, moved_arrivals(n), as_of()).select("id", "url", "title", "change")

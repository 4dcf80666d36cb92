"""Crawls over a graph of pages, folds in order, learned rules and near-duplicate titles, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import any_word
from ..operators import store as S
from ..functions.temporal import as_of
from ..operators.frontier import expand
from ..operators.relocation import relocate
from ..sources.tables import notices, read, targets
from ..streaming import jobs
from ..streaming.daily import daily_runs
from .board import listed
from .ctes import NOTICES, TARGETS, sql

QUERIES: dict = {}
SQL: dict = {}

#: Words of links that are worth following, of items of a list page, and of detail pages.
HINTS, TOPICS, DETAILS = ("the", "er", "in"), ("tion", "eau"), ("ing", "ment")
_LINK = r'<a href="(/[^"]*)">([^<]*)</a>'


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def site_graph(spark, sf_dir):
    """Hosts as seeds, pages with what they are, and links to pages of the same host.

    Links of the table lead nowhere, so link number k of a host's page number n leads to its page number n + k * k + 1,
    counted round. A list page has an item of eight characters or more with a topic word.
    """
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    p = read(spark, sf_dir, "pages").select("page_id", host.alias("seed"), "html")
    texts = F.regexp_extract_all("html", F.lit(_LINK), F.lit(2))
    item = F.exists(texts, lambda t: (F.length(t) >= 8) & any_word(t, TOPICS))
    head = F.substring("html", 1, 8000)
    p = p.withColumns({"at": F.row_number().over(W.partitionBy("seed").orderBy("page_id")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy("seed"))})
    pages = p.select("seed", F.col("page_id").alias("url"), (F.length("html") >= 200).alias("ok"), item.alias("is_list"), (head.contains(DETAILS[0]) & head.contains(DETAILS[1])).alias("is_detail"))
    found = p.select("seed", "page_id", "at", "n", F.posexplode(texts).alias("position", "text"))
    score = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in HINTS), F.lit(0))
    led = found.select("seed", F.col("page_id").alias("url"), "position", ((F.col("at") + F.col("position") * F.col("position") + 1) % F.col("n")).alias("at"), score.alias("score"))
    links = led.join(p.select("seed", "at", F.col("page_id").alias("target")), ["seed", "at"]).select("url", "position", "target", "score")
    return p.where("at = 0").select("seed", F.col("page_id").alias("url")), pages, links


_GRAPH = rf"""RECURSIVE p AS (SELECT page_id, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS seed, regexp_extract_all(html, '{_LINK}', 2) AS texts FROM pages),
    q AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY page_id) - 1 AS nr, count(*) OVER (PARTITION BY seed) AS n FROM p),
    g AS (SELECT seed, page_id, nr, length(html) >= 200 AS ok, len(list_filter(texts, lambda t: length(t) >= 8 AND (contains(t, '{TOPICS[0]}') OR contains(t, '{TOPICS[1]}')))) > 0 AS is_list,
        contains(html[1:8000], '{DETAILS[0]}') AND contains(html[1:8000], '{DETAILS[1]}') AS is_detail FROM q),
    l AS (SELECT seed, page_id, k, (nr + k * k + 1) % n AS nr, {' + '.join(f"contains(lower(texts[k + 1]), '{w}')::INT" for w in HINTS)} AS score FROM q, range(len(texts)) r(k)),
    links AS (SELECT l.seed, l.page_id, k, g.page_id AS target, score FROM l JOIN g USING (seed, nr) WHERE score > 0),
    crawl AS (SELECT seed, 0 AS level, [page_id] AS asked, [page_id] AS visited FROM g WHERE nr = 0
        UNION ALL
        SELECT c.seed, level + 1, asked2, list_concat(visited, asked2) FROM (
            SELECT seed, level, visited, list(target ORDER BY score DESC, place, k)[1:least(3, 5 - len(visited))] AS asked2 FROM (
                SELECT r.seed, r.level, r.visited, target, s.score, place, k FROM (
                    SELECT seed, level, visited, unnest(asked) AS page_id, unnest(range(len(asked))) AS place FROM crawl r0
                    WHERE level < 2 AND NOT EXISTS (SELECT 1 FROM g WHERE list_contains(r0.asked, g.page_id) AND g.ok AND g.is_list)) r
                JOIN g o ON o.page_id = r.page_id AND o.ok JOIN links s ON s.page_id = r.page_id WHERE NOT list_contains(r.visited, target)
                QUALIFY row_number() OVER (PARTITION BY r.seed, target ORDER BY s.score DESC, place, k) = 1) GROUP BY seed, level, visited) c WHERE len(asked2) > 0),
    steps AS (SELECT seed, level, page_id, place, ok, is_list, is_detail, min(CASE WHEN ok AND is_list THEN place END) OVER (PARTITION BY seed, level) AS first
        FROM (SELECT seed, level, unnest(asked) AS page_id, unnest(range(1, len(asked) + 1)) AS place FROM crawl) JOIN g USING (seed, page_id))"""


@query("pipe_03_focus_crawl", f"WITH {_GRAPH} SELECT seed, page_id, level, place::INT AS place, ok, ok AND is_list AND place <= coalesce(first, place) AS is_list, ok AND is_detail AND place <= coalesce(first, place) AS is_detail FROM steps")
def pipe_03(spark, sf_dir):
    """What the crawl of each host asks for: its home page, then the best links of three at a time, five requests in all."""
    seeds, pages, links = site_graph(spark, sf_dir)
    return expand(seeds, pages.drop("seed"), links, depth=2).withColumnRenamed("url", "page_id")


@query("pipe_03_focus_results", rf"""WITH {_GRAPH}, c AS (SELECT seed, page_id, level, place, ok AND is_list AND place <= coalesce(first, place) AS is_list, ok AND is_detail AND place <= coalesce(first, place) AS is_detail FROM steps),
    lists AS (SELECT seed, page_id FROM c WHERE is_list QUALIFY row_number() OVER (PARTITION BY seed ORDER BY level, place) = 1),
    items AS (SELECT seed, page_id, t AS title, k FROM lists JOIN q USING (seed, page_id), (SELECT unnest(texts) AS t, unnest(range(len(texts))) AS k) WHERE length(t) >= 8 AND (contains(t, '{TOPICS[0]}') OR contains(t, '{TOPICS[1]}')) QUALIFY row_number() OVER (PARTITION BY seed, t ORDER BY k) = 1),
    details AS (SELECT c.seed, c.page_id, regexp_extract(html, '<h1>([^<]*)', 1) AS title FROM (SELECT * FROM c WHERE is_detail QUALIFY row_number() OVER (PARTITION BY seed ORDER BY level, place) <= 2) c JOIN q USING (page_id) ANTI JOIN lists USING (page_id))
    SELECT seed, 'item' AS kind, page_id, title FROM items UNION ALL SELECT seed, 'detail', page_id, title FROM details WHERE title <> ''""")
def pipe_03_results(spark, sf_dir):
    """Items of the first list page, and up to two detail pages that are not that page, with their headings."""
    seeds, pages, links = site_graph(spark, sf_dir)
    got = expand(seeds, pages.drop("seed"), links, depth=2)
    html = read(spark, sf_dir, "pages").select(F.col("page_id").alias("url"), "html")
    order = ["level", "place"]
    first = S.first_per_key(got.where("is_list"), ["seed"], order).select("seed", "url")
    texts = F.regexp_extract_all("html", F.lit(_LINK), F.lit(2))
    items = first.join(html, "url").select("seed", "url", F.explode(F.array_distinct(texts)).alias("title")).where((F.length("title") >= 8) & any_word(F.col("title"), TOPICS))
    place = F.row_number().over(W.partitionBy("seed").orderBy(*order))
    details = got.where("is_detail").withColumn("n", place).where("n <= 2").join(first, ["seed", "url"], "left_anti").join(html, "url").select("seed", "url", F.regexp_extract("html", "<h1>([^<]*)", 1).alias("title")).where("title <> ''")
    out = items.withColumn("kind", F.lit("item")).unionByName(details.withColumn("kind", F.lit("detail")))
    return out.select("seed", "kind", F.col("url").alias("page_id"), "title")


_TITLE = "CASE id % 7 WHEN 0 THEN concat('again: ', title) WHEN 1 THEN {left} WHEN 2 THEN concat('xx ', title, ' yy', id % 5) WHEN 3 THEN concat('yy', id % 5) WHEN 4 THEN concat(title, ' ', id % 11) WHEN 5 THEN concat('no. ', id % 23, ' of the year') ELSE title END"


@query("snk_01b_ordered_fold", sql(f""", t AS (SELECT university, college, {_TITLE.format(left='title[1:12]')} AS title, id AS ord FROM notices),
    d AS (SELECT university, college, title, min(ord) AS ord FROM t GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY university, college ORDER BY ord) AS k FROM d),
    f AS (SELECT university, college, 0::BIGINT AS k, []::VARCHAR[] AS stay FROM (SELECT DISTINCT university, college FROM d)
        UNION ALL SELECT f.university, f.college, n.k, CASE WHEN len(list_filter(stay, lambda x: contains(x, n.title[1:24]) OR contains(n.title, x[1:24]))) > 0 THEN stay ELSE list_append(stay, n.title) END FROM f JOIN n ON n.university = f.university AND n.college = f.college AND n.k = f.k + 1)
    SELECT ord, university, college, title FROM d JOIN (SELECT university, college, arg_max(stay, k) AS stay FROM f GROUP BY ALL) USING (university, college) WHERE list_contains(stay, title)""", NOTICES).replace("WITH ", "WITH RECURSIVE ", 1))
def snk_01b_fold(spark, sf_dir):
    """Titles that contain one another's starts either way, some only by way of a title that goes."""
    rows = notices(spark, sf_dir).selectExpr("university", "college", f"{_TITLE.format(left='left(title, 12)')} AS title", "id AS ord")
    return S.collapse_prefixes(rows)


CUES = ("worthless", "stupid", "disgusting")
_PARTS = "least(3, doc_id * 4 // ((SELECT max(doc_id) FROM documents) + 1))"


@query("st_08_learned_pieces", f"""WITH d AS (SELECT doc_id AS id, {_PARTS}::INT AS part, text, trim(text[1:60]) AS title, text[1:300] AS snippet, doc_id % 9 = 0 AS taught FROM documents),
    told AS (SELECT * FROM d WHERE taught QUALIFY row_number() OVER (PARTITION BY title[1:40] ORDER BY id) = 1),
    turns AS (SELECT *, row_number() OVER (PARTITION BY title[1:24] ORDER BY id) AS turn FROM told),
    pieces AS (SELECT title[1:24] AS piece, part, id FROM turns WHERE turn = 1 AND length(title) >= 6 UNION ALL SELECT title[1:16], part, id FROM turns WHERE turn = 2 AND length(title) >= 6
        UNION ALL SELECT c, part, id FROM told, (SELECT unnest({list(CUES)}) AS c) WHERE contains(title, c) OR contains(snippet, c)),
    rules AS (SELECT piece, arg_min(part, id) AS part, min(id) AS id FROM pieces GROUP BY piece),
    hits AS (SELECT d.id, arg_min(piece, (r.part, r.id, piece)) AS piece FROM d JOIN rules r ON r.part < d.part AND contains(d.text, piece) GROUP BY d.id)
    SELECT id, d.part, piece IS NOT NULL AS rejected, piece FROM d LEFT JOIN hits USING (id)""")
def st_08_pieces(spark, sf_dir):
    """Whole texts of four runs, judged by the 24- or 16-letter starts and the cue words of what earlier runs saw rejected."""
    d = read(spark, sf_dir, "documents")
    most = d.agg(F.max("doc_id")).first()[0] or 0
    rows = d.select(F.col("doc_id").alias("id"), F.trim(F.substring("text", 1, 60)).alias("title"), F.substring("text", 1, 300).alias("snippet"), "text", (F.col("doc_id") % 9 == 0).alias("taught"))
    part = F.least(F.lit(3), F.floor(F.col("id") * 4 / (most + 1)))
    return jobs.learned_pieces(spark, [rows.where(part == k) for k in range(4)], CUES)


@query("pipe_06_daily_job", sql(""", a AS (SELECT *, id % 3 AS run FROM labelled WHERE id % 10 <> 0),
    c AS (SELECT r AS batch, (SELECT count(*) FROM a WHERE run = r OR r = 1 AND run = 0 AND id % 2 = 0) AS found, (SELECT count(*) FROM a WHERE run = r) AS new, (SELECT count(*) FROM a WHERE r = 1 AND run = 0 AND id % 2 = 0) AS updated,
        (SELECT count(DISTINCT (university, college, college_type, slot)) FROM a WHERE run <= r) AS covered, (SELECT count(*) FROM targets t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.run <= r AND a.university = t.university AND a.college = t.college)) AS pending FROM range(3) x(r))
    SELECT batch, found, new, updated, covered, pending FROM c""", NOTICES, TARGETS))
def pipe_06(spark, sf_dir):
    """Three daily runs over what has arrived, of which the second brings rows again; rejected rows are never stored. The log of the last version."""
    n = notices(spark, sf_dir).withColumns({"ord": F.col("id"), "rejected": F.col("id") % 10 == 0})
    again = n.where("id % 3 = 0 and id % 2 = 0").withColumn("deadline", F.lit("1999-01-01"))
    parts = [n.where("id % 3 = 0"), n.where("id % 3 = 1").unionByName(again), n.where("id % 3 = 2")]
    return daily_runs(spark, parts, targets(spark, sf_dir), as_of()).read("log")


@query("pipe_04_relocation", sql(""", i AS (SELECT id, url FROM notices WHERE deadline IS NULL), m AS (SELECT max(id) + 1 AS m FROM notices),
    c AS (SELECT i.id, i.url AS own, j, CASE j WHEN 3 THEN i.id WHEN 4 THEN (i.id * 7) % m ELSE (i.id * 7 + j * 131) % m END AS cid, (i.id + j * 5) % 9 - 2 AS score FROM i, m, range(6) r(j)),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, j) AS place FROM c WHERE score >= 0),
    t AS (SELECT r.*, n.url, n.deadline, (cid * 3) % 7 AS page_score, CASE WHEN (cid + j) % 5 = 0 THEN '1998-09-09' END AS snippet, row_number() OVER (PARTITION BY r.id, cid ORDER BY place) AS turn FROM r LEFT JOIN notices n ON n.id = cid WHERE place <= 4),
    ok AS (SELECT *, deadline IS NOT NULL OR page_score >= score AS better FROM t WHERE turn = 1 AND cid % 11 <> 0 AND url IS NOT NULL AND url <> own)
    SELECT id, url, CASE WHEN better THEN deadline ELSE snippet END AS deadline, place::INT AS wave FROM ok WHERE better OR snippet IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1""", NOTICES))
def pipe_04(spark, sf_dir):
    """Notices without a deadline: the four best of six candidates in waves, among them the notice itself and one that comes twice."""
    n = notices(spark, sf_dir)
    most = n.agg((F.max("id") + 1).alias("m")).first()["m"] or 1
    items = n.where("deadline is null").select("id", "url")
    c = items.select("id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j")).selectExpr("id", "j", f"CASE j WHEN 3 THEN id WHEN 4 THEN (id * 7) % {most} ELSE (id * 7 + j * 131) % {most} END AS cid", "(id + j * 5) % 9 - 2 AS score")
    known = n.select(F.col("id").alias("cid"), "url")
    candidates = c.join(known, "cid").selectExpr("id", "j AS position", "url", "cid % 11 <> 0 AS usable", "score", "IF((cid + j) % 5 = 0, '1998-09-09', NULL) AS snippet_deadline")
    return relocate(items, candidates, n.select("url", "deadline", ((F.col("id") * 3) % 7).alias("page_score")))


@query("join_02_messaging_targets", sql(""", t AS (SELECT *, college_type = 'law' AS law FROM targets), official AS (SELECT DISTINCT university, college FROM labelled WHERE category = 'official' AND slot = 'camp_notice' AND id % 500 = 1),
    hits AS (SELECT DISTINCT university, college FROM notices WHERE id % 700 = 3), messaging AS (SELECT DISTINCT university, college FROM labelled WHERE category = 'messaging' AND slot = 'camp_notice' AND id % 300 = 2),
    waiting AS (SELECT university, college FROM targets WHERE ord % 3 > 0), today AS (SELECT DISTINCT university, college FROM notices WHERE id % 900 = 7)
    SELECT university, college FROM t ANTI JOIN official USING (university, college) ANTI JOIN hits USING (university, college) ANTI JOIN messaging USING (university, college) SEMI JOIN waiting USING (university, college) ANTI JOIN today USING (university, college)""", NOTICES, TARGETS))
def join_02_messaging(spark, sf_dir):
    """Targets to search for messages: not on an official site, in the store or this run, no message yet, waiting, and not searched today."""
    rows = listed(spark, sf_dir)
    camp = rows.where("slot = 'camp_notice'")
    return S.messaging_targets(
        targets(spark, sf_dir), camp.where("category = 'official' and id % 500 = 1").unionByName(rows.where("id % 700 = 3")), camp.where("category = 'messaging' and id % 300 = 2"),
        targets(spark, sf_dir).where("ord % 3 > 0"), rows.where("id % 900 = 7"),
    ).select("university", "college")

"""Pages read as trees, by table functions in lateral joins, with the SQL that knows what was written into the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dom import CONTENT, TABLES
from ..functions.similarity import register_functions
from ..sources.tables import read, spread

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


#: A customer's orders as a list page: rows of a list, a table and bare blocks, a menu, links twice, short titles and scripts.
_ROW = """CASE o_orderkey % 4 WHEN 0 THEN concat('<li class=x><span>', day, '</span><A title="t" HREF=\\'/info/', o_orderkey, '.htm#top\\'>Notice of <b>order ', o_orderkey, '</b></A>')
    WHEN 1 THEN concat('<table><tr><td><a href="../info/', o_orderkey, '.htm">Notice of <i>order ', o_orderkey, '</i></a><td>', day, '</table>')
    WHEN 2 THEN concat('<div><p>on ', day, '<p><a target="_blank" href="http://other.example.org/', o_orderkey, '">Notice of order &#35;', o_orderkey, '</a><a href="/info/', o_orderkey, '.htm">short</a></div>')
    ELSE concat('<div><a href="javascript:open(', o_orderkey, ')">Notice that is a script</a><script>var a="<a href=/no>Notice in a script</a>"</script></div><a href="/info/', o_orderkey, '.htm">Notice of order <!-- no -->', o_orderkey, '</a>') END"""


@query("parse_01_list_items", """WITH r AS (SELECT o_custkey AS page, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
    SELECT page, n::INT AS position, CASE k % 4 WHEN 2 THEN 'Notice of order #' || k WHEN 3 THEN 'Notice of order' || k ELSE 'Notice oforder ' || k END AS title,
        CASE WHEN k % 4 = 2 THEN 'http://other.example.org/' || k ELSE 'https://c' || page || '.example.org/info/' || k || '.htm' END AS url,
        CASE k % 4 WHEN 0 THEN day || ' Notice of order ' || k WHEN 1 THEN 'Notice of order ' || k || ' ' || day WHEN 2 THEN 'on ' || day || ' Notice of order #' || k || ' short' ELSE 'Notice of order' || k END AS context FROM r""")
def parse_01(spark, sf_dir):
    """Anchors of list pages with what stands round them, as SQL with a lateral join."""
    register_functions(spark)
    rows = spread(read(spark, sf_dir, "orders").selectExpr("o_custkey AS page", "o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS day"), "page").selectExpr("page", "o_orderkey", f"{_ROW} AS part")
    # rows of lists stand in lists of their own, so that a bare anchor after one is in none
    parts = rows.withColumn("part", F.when(F.col("part").startswith("<li"), F.concat(F.lit("<ul>"), "part", F.lit("</ul>"))).otherwise(F.col("part")))
    pages = parts.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "part"))), lambda x: x["part"]), "\n").alias("rows"))
    html = F.concat(F.lit('<html><body><nav><ul><li><a href="/">Home</a></ul></nav>'), "rows", F.lit("<a>Notice without an address</a></body></html>"))
    return spark.sql(
        "SELECT page, i.* FROM {pages} p, LATERAL list_items(p.html, p.base) i", pages=pages.select("page", html.alias("html"), F.concat(F.lit("https://c"), F.col("page").cast("string"), F.lit(".example.org/news/")).alias("base"))
    )


#: A document in the places where a notice's text may stand, one after another, and in pages without any of them.
_BODY = "replace(replace({text}, '&', '&amp;'), '<', '&lt;')"
_PLACES = "CASE doc_id % 20 " + " ".join(
    f"WHEN {k} THEN concat('<div id=\"other\"><div class=\"text\">too short</div><{'section' if s[0] in '.#' else s} ', '{f'class=\"a {s[1:]} b\"' if s[0] == '.' else f'id=\"{s[1:]}\"' if s[0] == '#' else ''}', '><nav>menu</nav><p>', body, '</p><script>x < y</script></div>')" for k, s in enumerate(CONTENT)
) + """ WHEN 12 THEN concat('<div><div><h2>A heading of the page</h2></div><p>', body, '</p></div>') WHEN 13 THEN concat('<article><h1>A heading of the page</h1><p>', body, '</p></article><p>not this</p>')
    WHEN 14 THEN concat('<p>', body, '</p><table><tr><th>name</th><td> day </td></tr><tr><td></td></tr><tr><td>a<br>b</td><td>c</td></tr></table>') WHEN 15 THEN concat('<p>', body, '</p><footer>gone</footer>') ELSE '<div class="content">short</div>' END"""  # fmt: skip


@query("parse_02_page_parts", rf"""WITH d AS (SELECT doc_id, doc_id % 20 AS k, CASE WHEN doc_id % 20 = 16 THEN regexp_replace(text, '<', '', 'g') ELSE regexp_replace(text, '^[\s]+|[\s]+$', '', 'g') END AS t FROM documents),
    b AS (SELECT doc_id, k, t, CASE WHEN k < 12 AND k <> 10 AND length(t) >= 80 OR k = 13 AND length('A heading of the page ' || t) >= 80 THEN CASE WHEN k = 13 THEN 'A heading of the page ' || t ELSE t END WHEN k = 16 THEN t
        WHEN k < 12 THEN 'too short' || ' ' || t WHEN k = 12 THEN 'A heading of the page ' || t WHEN k = 13 THEN 'A heading of the page ' || t || ' not this' WHEN k = 14 THEN t || ' name day a b c' WHEN k = 15 THEN t ELSE 'short' END AS w FROM d),
    p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(w[1:12000], '[。\n]'), lambda x: regexp_replace(x, '^[\s]+|[\s]+$', '', 'g')), lambda x: length(x) >= 6 AND NOT contains(x, 'ICP')) AS parts FROM b)
    SELECT doc_id, CASE WHEN k = 16 AND (length(t) < 80 OR length(text) < 50) THEN '' ELSE text END || CASE WHEN k = 14 THEN '{TABLES}name | day' || chr(10) || 'a b | c' ELSE '' END AS body
    FROM (SELECT *, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '。') ELSE w[1:12000] END AS text FROM p)""")
def parse_02(spark, sf_dir):
    """Texts of notices out of each known place, round headings, out of bodies with tables, and out of plain texts."""
    register_functions(spark)
    d = spread(read(spark, sf_dir, "documents"), "doc_id").selectExpr("doc_id", "text", f"{_BODY.format(text='text')} AS body")
    padding = "<!-- " + "filling " * 25 + "-->"
    html = F.expr(f"CASE WHEN doc_id % 20 = 16 THEN replace(text, '<', '') ELSE concat('<html><head><title>t</title></head><body>{padding}', {_PLACES}, '</body></html>') END")
    about = F.when(F.col("doc_id") % 2 == 0, "某大学夏令营").otherwise("a page")
    return spark.sql("SELECT doc_id, p.body FROM {docs} d, LATERAL page_parts(d.html, d.about) p", docs=d.select("doc_id", html.alias("html"), about.alias("about")))


@query("parse_05_title_choice", """SELECT id, CASE WHEN id % 5 = 0 AND id > 9 THEN '夏令营 ' || id WHEN len(c) = 0 THEN '' ELSE list_sort(list_transform(c, lambda t: {'n': -length(t), 't': t}))[1].t END AS title FROM (
    SELECT o_orderkey AS id, list_filter([CASE WHEN id % 3 = 0 THEN 'an open graph title of order ' || id END, CASE WHEN id % 4 = 0 THEN 'the heading:' || o_orderpriority || 'of ' || id END, CASE WHEN id % 7 = 0 THEN 'the page of ' || id END], lambda t: t IS NOT NULL) AS c FROM orders)""")
def parse_05(spark, sf_dir):
    """Headings, og:title and the title element: a topical one, else the longest; what has fewer than six letters is none."""
    register_functions(spark)
    html = F.expr("""concat('<head><title>', IF(o_orderkey % 7 = 0, concat('the page of ', o_orderkey), 'x'), ' | site - more</title>', IF(o_orderkey % 3 = 0, concat('<meta content="an open graph title of order ', o_orderkey, '" property=og:title>'), ''), '</head><h1>h</h1>',
        IF(o_orderkey % 4 = 0, concat('<div class="news title"> the heading: <b>', o_orderpriority, '</b> of ', o_orderkey, '</div>'), ''), IF(o_orderkey % 5 = 0, concat('<div class=article><h3>夏令营 ', o_orderkey, '</h3></div>'), ''))""")
    return spark.sql("SELECT id, p.title FROM {pages} d, LATERAL page_parts(d.html, '') p", pages=spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").select(F.col("o_orderkey").alias("id"), html.alias("html")))


#: Result pages with one box of each kind, whose attributes and tags stand in no fixed order.
_RESULTS = """concat('<body id="b_results"><ol><li data-x="1" class="first b_algo"><h2><a class=l href="https://a.example.org/', k, '#frag">First <b>result</b> ', k, '</a></h2><div class="b_caption"><p>about ', o, '</p></div></li></ol>',
    '<div class="result c"><h3>see <a href="https://b.example.org/', k, '">Second result ', k, '</a></h3><p></p></div>', '<div class="c-container"><div class="c-abstract">third ', o, '</div><h3><a href="https://c.example.org/', k, '">Third result ', k, '</a></h3></div>',
    '<div class="result-op"><h3><a href="https://a.example.org/', k, '">First result again</a></h3></div><div class="result"><h3><a href="/local">A local result</a></h3><h3><a href="https://d.example.org/', k, '">few</a></h3></div></body>')"""


@query("parse_03_result_boxes", """SELECT o_orderkey AS id, k::INT AS position, CASE k WHEN 0 THEN 'Firstresult' || o_orderkey WHEN 1 THEN 'Second result ' || o_orderkey ELSE 'Third result ' || o_orderkey END AS title,
    'https://' || ['a', 'b', 'c'][k + 1] || '.example.org/' || o_orderkey AS url, CASE k WHEN 0 THEN 'about ' || o_orderpriority WHEN 2 THEN 'third ' || o_orderpriority END AS snippet FROM orders, range(3) r(k)""")
def parse_03(spark, sf_dir):
    """Five kinds of result boxes: titles, addresses without fragment, each once, and the box's snippet if it has one."""
    register_functions(spark)
    pages = spread(read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey AS k", "o_orderpriority AS o"), "id").selectExpr("id", f"{_RESULTS} AS html")
    return spark.sql("SELECT id, b.* FROM {pages} d, LATERAL result_boxes(d.html) b", pages=pages)

"""Dates and passages of announcement texts. The oracle knows the dates from which the texts were made, not the patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import announced as A
from ..functions import classify as C
from ..functions.similarity import register_functions
from ..functions.temporal import as_of
from ..operators.once import once_per_text
from ..sources.tables import read, spread
from .ctes import sql

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _local(d: str, year: bool = True) -> str:
    return f"concat({f'year({d}), ' if year else ''}{chr(39)}{'年' if year else ''}{chr(39)}, month({d}), '月', day({d}), '日')"


TEXT = f"""CASE id % 8
    WHEN 0 THEN concat(year(d1), '年夏令营通知。报名系统', {_local('d1', False)}, '开放，', {_local('d2', False)}, '关闭。') WHEN 1 THEN concat(year(d1), '年推免工作。报名时间：', {_local('d1')}, '至', {_local('d2', False)}, '。')
    WHEN 2 THEN concat('请于', {_local('d2')}, ' 17:30前完成网上报名。') WHEN 3 THEN concat('发布时间：', iso1, '。即日起至', {_local('d2')}, '中午12点接受申请。') WHEN 4 THEN concat(year(d1), '年推免。报名截止时间：', {_local('d2', False)}, '。')
    WHEN 5 THEN concat('报名截止时间：', {_local('d2')}, '24:00。') WHEN 6 THEN concat('发布时间：', year(d1), '/', month(d1), '/', day(d1), ' 更新。活动时间：', {_local('d3')}, '至', day(d4), '日。') ELSE concat('学院简介，', year(d1), '届毕业生。') END"""
TEXTS = f"""dated AS (SELECT o_orderkey AS id, d1, d1 + INTERVAL 20 DAY AS d2, d1 + INTERVAL 40 DAY AS d3, d1 + INTERVAL 43 DAY AS d4, strftime(d1, '%Y-%m-%d') AS iso1, strftime(d1 + INTERVAL 20 DAY, '%Y-%m-%d') AS iso2,
        year(d1)::VARCHAR || strftime(d1 + INTERVAL 20 DAY, '-%m-%d') AS same_year2 FROM (SELECT o_orderkey, o_orderdate + INTERVAL 28 YEAR AS d1 FROM orders)),
    lines AS (SELECT *, {TEXT} AS text FROM dated)"""


def lines(spark, sf_dir):
    """Orders as announcements, with dates written in eight ways (28 years later, which keeps leap days)."""
    base = spread(read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "add_months(o_orderdate, 336) AS d1"), "id")
    base = base.selectExpr("id", "d1", "date_add(d1, 20) AS d2", "date_add(d1, 40) AS d3", "date_add(d1, 43) AS d4", "date_format(d1, 'yyyy-MM-dd') AS iso1", "date_format(date_add(d1, 20), 'yyyy-MM-dd') AS iso2")
    return base.withColumn("text", F.expr(TEXT))


@query("date_03_reference_year", sql("SELECT id, CASE id % 8 WHEN 7 THEN 1998 WHEN 2 THEN year(d2) WHEN 3 THEN greatest(year(d1), year(d2)) WHEN 5 THEN year(d2) WHEN 6 THEN greatest(year(d1), year(d3)) ELSE year(d1) END::INT AS ref_year FROM lines", TEXTS))
def date_03(spark, sf_dir):
    return lines(spark, sf_dir).select("id", A.reference_year(F.col("text"), as_of()).alias("ref_year"))


@query("date_05_url_date", sql("SELECT id, CASE WHEN id % 4 < 3 THEN iso1 || ' 00:00:00' END AS url_date FROM lines", TEXTS))
def date_05(spark, sf_dir):
    forms = "CASE id % 4 WHEN 0 THEN date_format(d1, 'yyyyMMdd') WHEN 1 THEN date_format(d1, 'yyyy/MMdd') WHEN 2 THEN date_format(d1, 'yyyy-MM-dd') ELSE 'info' END"
    return lines(spark, sf_dir).select("id", A.date_of_url(F.concat(F.lit("https://x.example.org/a/"), F.expr(forms), F.lit("/1.htm"))).alias("url_date"))


@query("date_06_period", sql("SELECT id, CASE WHEN id % 8 = 1 THEN iso1 || ' 00:00:00' END AS opens, CASE WHEN id % 8 = 1 THEN same_year2 || ' 23:59:59' END AS closes FROM lines", TEXTS))
def date_06(spark, sf_dir):
    period = A.registration_period(F.col("text"), as_of())
    return lines(spark, sf_dir).select("id", period.alias("p")).select("id", F.col("p.start").alias("opens"), F.col("p.end").alias("closes"))


@query("date_07_open", sql("SELECT id, CASE WHEN id % 8 IN (0, 1, 3) THEN iso1 || ' 00:00:00' END AS opens FROM lines", TEXTS))
def date_07(spark, sf_dir):
    return lines(spark, sf_dir).select("id", A.opens(F.col("text"), as_of()).alias("opens"))


@query("date_08_deadline", sql("""SELECT id, CASE id % 8 WHEN 0 THEN same_year2 || ' 23:59:59' WHEN 1 THEN same_year2 || ' 23:59:59' WHEN 2 THEN iso2 || ' 17:30:00' WHEN 3 THEN iso2 || ' 12:00:00' WHEN 4 THEN same_year2 || ' 23:59:59'
    WHEN 5 THEN iso2 || ' 23:59:59' END AS deadline FROM lines""", TEXTS))
def date_08(spark, sf_dir):
    return lines(spark, sf_dir).select("id", A.deadline(F.col("text"), as_of()).alias("deadline"))


@query("date_09_publish", sql("SELECT id, CASE WHEN id % 8 IN (3, 6) THEN iso1 || ' 00:00:00' END AS published, CASE WHEN id % 8 IN (0, 1, 3, 6) THEN iso1 || ' 00:00:00' ELSE strftime(d3, '%Y-%m-%d') || ' 00:00:00' END AS resolved FROM lines", TEXTS))
def date_09(spark, sf_dir):
    url = F.date_format("d3", "'https://x.example.org/'yyyy-MM-dd'.htm'")
    return lines(spark, sf_dir).select("id", A.published(F.col("text"), as_of()).alias("published"), A.resolved_publish_date(F.col("text"), url, as_of()).alias("resolved"))


@query("date_10_event_time", sql("SELECT id, CASE WHEN id % 8 = 6 THEN year(d3)::VARCHAR || '年' || month(d3)::VARCHAR || '月' || day(d3)::VARCHAR || '日至' || day(d4)::VARCHAR || '日' END AS event_time FROM lines", TEXTS))
def date_10(spark, sf_dir):
    return lines(spark, sf_dir).select("id", A.event_time(F.col("text")).alias("event_time"))


def _short(d: str) -> str:
    return _local(d, False)


def _month(d: str) -> str:
    return f"concat(year({d}), '年', month({d}), '月')"


#: One text for each phrase that tells an opening, a deadline or an event, and what it tells, in SQL for both sides.
_START, _END, _SAME = "iso1 || ' 00:00:00'", "iso2 || ' 23:59:59'", "same_year2 || ' 23:59:59'"
OPEN_FORMS = (
    (f"concat('网上报名开始时间：', {_local('d1')}, '，')", _START), (f"concat('报名系统开通时间为', {_local('d1')}, ' 8:30')", "iso1 || ' 08:30:00'"), (f"concat('开始网上填报时间：', {_local('d1')})", _START),
    (f"concat('自', {_local('d1')}, '起接受网上报名')", _START), (f"concat('可从', {_local('d1')}, '开始')", _START), (f"concat('开放时间：', {_local('d1')})", _START), (f"concat(year(d1), '年安排，', {_short('d1')}, ' 开放')", _START),
    (f"concat('报名时间：', {_local('d2')}, '。申请时间：', {_local('d1')}, '。')", _START), (f"concat('填报时间为', {_local('d2')}, '，报名时间为', {_local('d1')})", _START), (f"concat('填报时间为', {_local('d1')})", _START),
    (f"concat('接收推免生时间：', {_local('d1')})", _START), (f"concat({_local('d1')}, '至', {_short('d2')}, '期间进行网上填报')", _START), ("'请留意后续通知'", "NULL"),
)
DEADLINE_FORMS = (
    (f"concat('网上报名截止日期：', {_local('d2')})", _END), (f"concat('系统关闭时间为', {_local('d2')}, ' 18:00')", "iso2 || ' 18:00:00'"), (f"concat(year(d1), '年安排，', {_short('d2')}, ' 关闭')", _SAME), (f"concat('停止网上报名时间：', {_local('d2')})", _END),
    (f"concat('请于', {_local('d2')}, '前完成网上报名')", _END), (f"concat(year(d1), '年安排：请于 ', {_short('d2')}, ' 17:00 之前登录')", "same_year2 || ' 17:00:00'"), (f"concat('截止日期：', {_local('d2')}, '止')", _END), (f"concat('截止时间', {_local('d2')})", _END),
    (f"concat('报名日期：', {_local('d1')}, '至', {_short('d2')})", "iso1 || ' 23:59:59'"), (f"concat('文件须于 ', {_local('d2')}, ' 前寄至学院')", _END), (f"concat({_local('d2')}, '前将材料寄至学院')", _END), (f"concat('扫描件各位于', {_local('d2')}, '之前发到邮箱')", _END),
    (f"concat({_local('d1')}, '至', {_short('d2')}, '截止')", "iso1 || ' 23:59:59'"), (f"concat('网上填报', {_local('d1')}, '至', {_short('d2')}, '。')", _SAME), (f"concat('即日起至', {_local('d2')}, '下午5点')", "iso2 || ' 17:00:00'"),
    (f"concat(year(d1) + 1, '年入学。填报', {_local('d1')}, '至', {_short('d2')}, '。')", "(year(d1) + 1)::VARCHAR || strftime(d2, '-%m-%d 23:59:59')"), ("'请留意后续通知'", "NULL"),
)
EVENT_FORMS = (
    (f"concat('开营时间：', {_local('d3')}, '至', {_local('d4')})", f"concat({_local('d3')}, '至', {_local('d4')})"), (f"concat('食宿自理。', {_local('d3')}, '至', day(d4), '日')", f"concat({_local('d3')}, '至', day(d4), '日')"),
    (f"concat('活动时间：', {_local('d3')}, '至', day(d4), '，')", f"concat({_local('d3')}, '至', day(d4))"), (f"concat('拟定于', {_local('d3')}, '至', day(d4), '日')", f"concat({_local('d3')}, '至', day(d4), '日')"),
    (f"concat('将于', {_short('d3')}, '至', {_short('d4')}, '举办')", f"concat({_short('d3')}, '至', {_short('d4')})"), (f"concat('夏令营定于', {_local('d3')}, '到', {_short('d4')})", f"concat({_local('d3')}, '到', {_short('d4')})"),
    (f"concat('举办时间：', {_local('d3')}, '-', {_short('d4')})", f"concat({_local('d3')}, '-', {_short('d4')})"), (f"concat('开营时间：', {_short('d3')}, '至', {_short('d4')})", f"concat({_short('d3')}, '至', {_short('d4')})"),
    (f"concat('营期：', {_local('d3')}, '至', {_short('d4')})", f"concat({_local('d3')}, '至', {_short('d4')})"), (f"concat({_local('d3')}, '至', {_short('d4')}, '在校内，欢迎参加夏令营')", f"concat({_local('d3')}, '至', {_short('d4')})"),
    (f"concat('先报到，', {_short('d3')}, '至', {_short('d4')}, '为入营')", f"concat({_short('d3')}, '至', {_short('d4')})"), (f"concat({_local('d3')}, '，夏令营活动。')", _local("d3")), ("'夏令营定于七月下旬在校内。'", "'七月下旬在校内'"),
    (f"concat('日程安排如下，时间：', {_short('d3')}, '，地点')", _short("d3")), (f"concat({_short('d3')}, '线上开营')", _short("d3")), (f"concat('活动时间：', {_month('d3')}, '中旬为期三天')", f"concat({_month('d3')}, '中旬为期三天')"),
    (f"concat('一、活动时间为', {_month('d3')}, '上旬')", f"concat({_month('d3')}, '上旬')"), (f"concat('拟于', {_month('d3')}, '下旬举办')", f"concat({_month('d3')}, '下旬')"), (f"concat('初定', {_month('d3')}, '上旬，举行')", f"concat({_month('d3')}, '上旬')"),
    (f"concat('请登录报名系统，', {_short('d3')}, '至', {_short('d4')}, '开放')", "NULL"),
)


def _cases(forms: tuple, part: int) -> str:
    return f"CASE id % {len(forms)} " + " ".join(f"WHEN {k} THEN {f[part]}" for k, f in enumerate(forms)) + " END"


def _formed(spark, sf_dir, forms: tuple):
    return lines(spark, sf_dir).select("id", F.expr(_cases(forms, 0)).alias("text"))


@query("date_07_open_forms", sql(f"SELECT id, {_cases(OPEN_FORMS, 1)} AS opens FROM dated", TEXTS))
def date_07_forms(spark, sf_dir):
    """Every phrase of an opening, and two texts in which the order of the phrases decides."""
    return _formed(spark, sf_dir, OPEN_FORMS).select("id", A.opens(F.col("text"), as_of()).alias("opens"))


@query("date_08_deadline_forms", sql(f"SELECT id, {_cases(DEADLINE_FORMS, 1)} AS deadline FROM dated", TEXTS))
def date_08_forms(spark, sf_dir):
    """Every phrase of a deadline; a short end of a range takes the latest year that the text names."""
    return _formed(spark, sf_dir, DEADLINE_FORMS).select("id", A.deadline(F.col("text"), as_of()).alias("deadline"))


@query("date_10_event_forms", sql(f"SELECT id, {_cases(EVENT_FORMS, 1)} AS event_time FROM dated", TEXTS))
def date_10_forms(spark, sf_dir):
    """Every form of an event's time, and a sentence about the registration, which is none."""
    return _formed(spark, sf_dir, EVENT_FORMS).select("id", A.event_time(F.col("text")).alias("event_time"))


#: Pages that tell their date in an element, in a meta tag, at their beginning, in their text only or in their address only.
_DATED_PAGE = f"""CASE id % 7 WHEN 0 THEN concat('<h1>n</h1><p class="meta time">发布时间：', {_local('d1')}, ' 8:05</p><meta name=date content=', iso2, '>')
    WHEN 1 THEN concat('<span class="time">no date</span><div class="left pubtime"> on <b>', iso1, '</b></div><p>更新时间：', {_local('d2')}, '</p>') WHEN 2 THEN concat('<head><meta content="', iso1, '" name="PubDate"><meta name="keywords" content="', iso2, '"></head><p>text</p>')
    WHEN 3 THEN concat('<script>var t = "发布时间：', iso2, '"</script><p>发文日期：', {_local('d1')}, '</p><p>', repeat('x ', 2000), '</p>') WHEN 4 THEN concat('<p>', repeat('x ', 2000), '发布时间：', iso2, '</p>') WHEN 5 THEN '<p>no date at all</p>' END"""


@query("date_09_page_publish", sql("""SELECT id, CASE id % 7 WHEN 0 THEN iso1 || ' 08:05:00' WHEN 5 THEN strftime(d3, '%Y-%m-%d 00:00:00') WHEN 6 THEN strftime(d3, '%Y-%m-%d 00:00:00') ELSE iso1 || ' 00:00:00' END AS published FROM dated""", TEXTS))
def date_09_page(spark, sf_dir):
    """Publish dates out of pages: elements, meta tags, the first 2,000 letters; then the text, then the address."""
    register_functions(spark)
    rows = lines(spark, sf_dir).selectExpr("id", f"{_DATED_PAGE} AS html", "IF(id % 7 = 4, concat('发布时间：', iso1), 'text') AS text", "date_format(d3, \"'https://x.example.org/'yyyy/MMdd'/1.htm'\") AS url")
    told = spark.sql("SELECT d.*, p.places FROM {rows} d, LATERAL page_dates(d.html) p", rows=rows)
    return told.select("id", A.resolved_publish_date(F.col("text"), F.col("url"), as_of(), F.col("places")).alias("published"))


@query("date_05_url_year", sql("SELECT id, CASE WHEN id % 5 < 4 THEN year(d1) END::INT AS url_year FROM dated", TEXTS))
def date_05_year(spark, sf_dir):
    forms = "CASE id % 5 WHEN 0 THEN date_format(d1, 'yyyyMMdd') WHEN 1 THEN date_format(d1, 'yyyy/MMdd') WHEN 2 THEN date_format(d1, 'yyyy-MM-dd') WHEN 3 THEN date_format(d1, 'yyyy/MM') ELSE date_format(d1, 'yyyy') END"
    return lines(spark, sf_dir).select("id", A.year_of_url(F.concat(F.lit("https://x.example.org/a/"), F.expr(forms), F.lit("/1.htm"))).alias("url_year"))


#: A notice's own part, far behind the page's heading, which tells other dates; stored fields of every precision.
_ITEM = f"""concat('发布时间：', {_local('d3')}, '。', repeat('校园新闻', 40), CASE id % 4 WHEN 0 THEN concat('网上报名开始时间：', {_local('d1')}, ' 9:00，报名截止时间：', {_local('d2')}, ' 17:00。活动时间：', {_local('d3')}, '至', day(d4), '日，线上与线下同步。')
    WHEN 1 THEN concat('报名时间：', {_local('d1')}, '至', {_short('d2')}, '。夏令营以 线 上 形式开展。') WHEN 2 THEN concat('报名截止时间：', {_local('d2')}, '，报到地点另告。') ELSE '本通知无时间。' END)"""


@query("date_11_item_times", sql("""SELECT id, CASE id % 4 WHEN 0 THEN CASE WHEN id % 3 = 0 THEN iso2 || ' 08:00:00' ELSE iso1 || ' 09:00:00' END WHEN 1 THEN CASE WHEN id % 3 = 0 THEN iso2 || ' 08:00:00' ELSE iso1 || ' 00:00:00' END ELSE CASE WHEN id % 3 = 0 THEN iso2 || ' 08:00:00' ELSE strftime(d3, '%Y-%m-%d 00:00:00') END END AS publish_date,
    CASE WHEN id % 5 = 0 THEN '2001-01-01 10:00:00' WHEN id % 4 = 0 THEN iso2 || ' 17:00:00' WHEN id % 4 = 1 THEN same_year2 || ' 23:59:59' WHEN id % 4 = 2 THEN iso2 || ' 23:59:59' WHEN id % 5 = 1 THEN '2001-01-01 00:00:00' END AS deadline,
    CASE WHEN id % 2 = 1 THEN 'stored' WHEN id % 4 = 0 THEN event_time END AS event_time, CASE id % 4 WHEN 0 THEN '线上线下' WHEN 1 THEN '线上' WHEN 2 THEN '线下' END AS event_format, CASE WHEN id % 5 = 0 OR id % 4 = 3 AND id % 5 = 1 THEN 'ended' ELSE 'active' END AS status
    FROM (SELECT *, concat(year(d3), '年', month(d3), '月', day(d3), '日至', day(d4), '日') AS event_time FROM dated)""", TEXTS))
def date_11_item(spark, sf_dir):
    """Times of a notice out of its own part and its whole text, merged with what is stored, and the status after that."""
    rows = lines(spark, sf_dir).selectExpr(
        "id", f"{_ITEM} AS text", "IF(id % 3 = 0, concat(iso2, ' 08:00:00'), '') AS publish_date", "CASE id % 5 WHEN 0 THEN '2001-01-01 10:00:00' WHEN 1 THEN '2001-01-01 00:00:00' END AS deadline", "IF(id % 2 = 1, 'stored', '') AS event_time", "CAST(NULL AS string) AS event_format", "'a notice' AS title",
    )
    told = once_per_text(rows, lambda t: A.item_times(t, F.lit("https://x.example.org/info"), as_of()), "told")
    fields = A.merged_times({f: F.col(f) for f in C.FIELDS}, F.col("told"))
    return told.select("id", "title", *[c.alias(f) for f, c in fields.items()]).select("id", *C.FIELDS, C.detected_status(as_of("2010-01-01 00:00:00")).alias("status"))


@query("date_12_model_datetime", sql("SELECT id, CASE id % 4 WHEN 0 THEN iso1 || ' 09:05:00' WHEN 1 THEN iso1 || ' 00:00:00' WHEN 2 THEN 'late July' END AS value FROM lines", TEXTS))
def date_12(spark, sf_dir):
    raw = F.expr(f"CASE id % 4 WHEN 0 THEN concat({_local('d1')}, ' 9:05') WHEN 1 THEN date_format(d1, 'yyyy.M.d') WHEN 2 THEN 'late July' ELSE '未知' END")
    return lines(spark, sf_dir).select("id", A.model_datetime(raw).alias("value"))


@query("date_15_feed_date", sql("SELECT id, CASE WHEN id % 5 > 0 THEN iso1 || ' 02:00:00' END AS sent_at FROM lines", TEXTS))
def date_15(spark, sf_dir):
    raw = F.when(F.col("id") % 5 > 0, F.date_format("d1", "EEE, d MMM yyyy '10:00:00 +0800'")).otherwise("yesterday")
    return lines(spark, sf_dir).select("id", F.date_format(A.feed_date(raw), "yyyy-MM-dd HH:mm:ss").alias("sent_at"))


@query("str_02_compact", sql("SELECT id, regexp_replace(replace(text, '日 ', '日'), '([0-9])([^0-9年月日:：/-])', '\\1 \\2', 'g') AS text FROM lines", TEXTS))
def str_02(spark, sf_dir):
    return lines(spark, sf_dir).select("id", A.compact(F.regexp_replace("text", r"(\d)", "$1 ")).alias("text"))


@query("str_03_focus", sql("""SELECT id, CASE WHEN a IS NULL THEN long_ ELSE substr(long_, strpos(long_, a) - 80, 6080) END AS focus FROM (SELECT id, repeat('甲', 100) || replace(text, '日 ', '日') AS long_,
    CASE id % 8 WHEN 0 THEN '报名系统' WHEN 1 THEN '报名时间' WHEN 2 THEN '网上报名' WHEN 6 THEN '活动时间' END AS a FROM lines)""", TEXTS))
def str_03(spark, sf_dir):
    return lines(spark, sf_dir).select("id", A.focused(F.concat(F.lit("甲" * 100), "text")).alias("focus"))


@query("src_09_feed_rows", sql("""SELECT id, 'notice ' || id AS title, 'https://x.example.org/' || id AS link, ' new  text ' || id AS summary, iso1 || ' 02:00:00' AS sent_at FROM lines WHERE id % 7 > 0 AND id % 9 > 0""", TEXTS))
def src_09(spark, sf_dir):
    """Items of a feed, one XML element per row: rows without title or link go, tags in the summary become blanks."""
    item = F.expr(r"""concat('<item><title>', if(id % 7 = 0, ' ', concat(' notice ', id)), '</title><link>', if(id % 9 = 0, '', concat('https://x.example.org/', id)), '</link><description>&lt;b&gt;new&lt;/b&gt; text ', id,
        '</description><pubDate>', date_format(d1, "EEE, d MMM yyyy '10:00:00 +0800'"), '</pubDate></item>')""")
    rows = lines(spark, sf_dir).select("id", F.from_xml(item, "title string, link string, description string, pubDate string", {"ignoreSurroundingSpaces": "false"}).alias("x"))
    rows = rows.select("id", F.trim("x.title").alias("title"), F.trim("x.link").alias("link"), F.regexp_replace(F.trim("x.description"), "<[^>]+>", " ").alias("summary"), F.date_format(A.feed_date(F.col("x.pubDate")), "yyyy-MM-dd HH:mm:ss").alias("sent_at"))
    return rows.where("title <> '' and link <> ''")

"""Dates in announcement texts: registration opening and deadline, publish date and event time, as column expressions.

Dates stay text (``YYYY-MM-DD HH:MM:SS``), zero-padded and not validated. Null texts count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import merged_datetime

# Forms of dates and clocks, and the phrases around them, in the language of the announcements.
CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?"
DAY = r"\d{1,2}[月\-/.]\d{1,2}[日号]?"
FULL_DAY = r"\d{4}[年\-/.]" + DAY
ANY_DAY = r"(?:\d{4}[年\-/.])?" + DAY
AT = rf"(?:\s*{CLOCK})?"
FULL = rf"({FULL_DAY}{AT})"
ANY = rf"({ANY_DAY}{AT})"
TO = r"(?:至|到|—|~|-)"
IS = r"[为：:\s]*"
THIRD = r"(?:上旬|中旬|下旬|中下旬)"
OPEN_CLOSE = rf"{ANY}\s*开放[，,]\s*{ANY}\s*关闭"
FROM_NOW = rf"(?:报名时间{IS})?即日起\s*(?:至\s*)?{ANY}"
TIME_RANGE = rf"(?:报名|申请)时间{IS}{ANY}\s*{TO}\s*{ANY}"
EXPLICIT = rf"报名截止时间{IS}{ANY}(?:\s*24[:：]00)?"
REGISTRATION = rf"(?:网上)?(?:报名|填报|申请)(?:时间|日期)?{IS}{FULL}\s*{TO}\s*{ANY}"
# Phrases in the order in which they are tried. The first group is the date.
OPENS = (
    rf"(?:网上)?(?:报名|填报|申请)(?:开始|开放)(?:时间|日期)?{IS}{FULL}",
    rf"(?:系统|报名系统)(?:开放|开启|开通)(?:时间|日期)?{IS}{FULL}",
    rf"(?:开放|开始)(?:网上)?(?:报名|填报)(?:时间|日期)?{IS}{FULL}",
    rf"自{FULL}(?:起|开始)",
    rf"(?:于|从){FULL}(?:起|开始)",
    rf"开放时间{IS}{FULL}",
    rf"{ANY}\s*开放",
    rf"申请时间{IS}{FULL}",
    rf"报名时间{IS}{FULL}",
    rf"填报时间{IS}{FULL}",
    rf"接收(?:推免生|申请)(?:时间|报名)?{IS}{FULL}",
    rf"{FULL}\s*{TO}\s*{ANY}(?:期间|内)?(?:进行)?(?:网上)?(?:报名|申请|填报|接收)",
)
# Likewise. Two of them give the start of a range, as the rules say.
DEADLINES = (
    rf"(?:网上)?(?:报名|填报|申请)(?:截止(?:时间|日期)?|截至|结束){IS}{FULL}",
    rf"(?:系统|报名系统)(?:关闭|截止)(?:时间|日期)?{IS}{FULL}",
    rf"{ANY}\s*关闭",
    rf"(?:停止|暂停)(?:网上)?(?:报名|填报)(?:时间)?{IS}{FULL}",
    rf"(?:请于|在){FULL}(?:前|之前)(?:完成)?(?:网上)?(?:报名|填报|提交)",
    rf"(?:请于|在)\s*{ANY}\s*(?:前|之前)",
    rf"截止(?:时间|日期){IS}{FULL}",
    rf"截止时间{IS}{FULL}",
    rf"报名(?:时间|日期)?{IS}{FULL}\s*{TO}\s*{ANY}",
    rf"于\s*{FULL}\s*(?:前|之前)\s*(?:发送|提交|邮寄|寄至|送达|完成|将|通过)",
    rf"{FULL}\s*(?:前|之前)\s*(?:发送|提交|邮寄|寄至|送达|完成|将材料|将申请)",
    rf"(?:材料|申请(?:材料)?|扫描件).*?于\s*{FULL}\s*(?:前|之前)",
    rf"{FULL}\s*{TO}\s*{ANY}(?:截止|结束|为止|前截止)",
)
PUBLISHED = (rf"发布(?:时间|日期){IS}{FULL}", rf"发文(?:时间|日期){IS}{FULL}", rf"更新时间{IS}{FULL}", rf"时间[：:\s]*(\d{{4}}-\d{{2}}-\d{{2}}(?:\s+{CLOCK})?)")
LAST_DAY = rf"({FULL_DAY})\s*$"
SPAN = rf"{FULL_DAY}\s*{TO}\s*{ANY_DAY}{AT}"
LOOSE_SPAN = rf"{FULL_DAY}\s*{TO}\s*(?:\d{{4}}[年\-/.])?\d{{1,2}}[月\-/.]?\d{{1,2}}[日号]?{AT}"
SHORT_SPAN = rf"{DAY}\s*{TO}\s*{DAY}"
DAYS = rf"\d{{4}}[年\-/.]\d{{1,2}}月\d{{1,2}}日\s*{TO}\s*\d{{1,2}}日"
THIRD_OF_MONTH = rf"\d{{4}}[年\-/.]\d{{1,2}}月{THIRD}"
UNDATED = r"(?:夏令营|活动|开营)(?:举办)?(?:时间为|定于|于)"
# When an event takes place, in the order in which the forms are tried.
EVENTS = (
    rf"开营时间{IS}({LOOSE_SPAN})",
    rf"({DAYS})",
    rf"活动时间[\s：:]*({DAYS}?)",
    rf"拟定于\s*({DAYS})",
    rf"将于\s*(\d{{1,2}}[月\-/.]\d{{1,2}}日\s*{TO}\s*\d{{1,2}}(?:月)?\d{{1,2}}日)\s*举办",
    rf"(?:夏令营|入营|研学)(?:活动)?(?:举办)?(?:时间为|定于|于|安排在)[：:\s]*({SPAN})",
    rf"(?:举办|活动|开营|夏令营)(?:时间为|时间{IS}|定于|于)({SPAN})",
    rf"开营时间{IS}({SHORT_SPAN})",
    rf"营期{IS}({FULL_DAY}\s*{TO}\s*{ANY_DAY})",
    rf"({SPAN})(?=.{{0,30}}(?:夏令营|开营|入营|活动))",
    rf"({SHORT_SPAN})(?=.{{0,30}}(?:夏令营|开营|入营|活动))",
    rf"({FULL_DAY})(?=.{{0,24}}(?:举办|开营|进行|开营式|活动安排|夏令营活动))",
    rf"{UNDATED}[：:\s]*([^。；\n]{{4,40}})",
    rf"(?:夏令营安排|活动安排|日程安排).*?时间[：:\s]*({DAY})",
    rf"({DAY})[：:\s]*(?:夏令营)?(?:线上)?开营",
    rf"活动时间{IS}({THIRD_OF_MONTH}[^。；\n]*)",
    rf"(?:一、)?活动时间{IS}({THIRD_OF_MONTH})",
    rf"拟于\s*({THIRD_OF_MONTH})",
    rf"({THIRD_OF_MONTH})(?=.{{0,30}}(?:举办|举行|夏令营|开营))",
)
# How an event is held, as phrases, and the words that tell it near a word of an event.
BOTH_WAYS = r"线上.{0,12}线下|线下.{0,12}线上|线上线下|线上与线下|线下与线上|同步(?:进行|开展)|混合(?:模式|形式)?(?:举办)?"
ONLINE = (
    r"线上(?:举办|进行|开展|开营|夏令营|活动|形式|方式|参与|参加)?|在线(?:举办|进行|开展)|网络(?:远程)?(?:举办|进行|开营)|"
    r"远程(?:举办|开营|进行)|腾讯会议|zoom|钉钉|以线上|会议号|会议链接|腾讯会议号|线上平台"
)
OFFLINE = (
    r"线下(?:举办|进行|开展|开营|夏令营|活动|形式|方式|参与|参加)?|现场(?:举办|参加|开营|进行)|到校(?:参加|举办)|来校(?:参加|举办)|实地(?:举办|参加)|线下开营|举办形式为现场|形式为现场|入营报到|报到地点|举办地点|活动地址|校区|教学楼|酒店|"
    r"参观走访|交通费报销|提供.*食宿|食宿(?:安排|提供)|校内餐饮|住宿费.*自理|往返交通"
)
HOSTING, HOSTED, CAMP = "举办|拟定于|将于|开营式|日程|食宿", "线下举办", "开营|夏令营|入营|活动"
REGISTER, STRONG = "报名|登录|填报|申请|系统|yzbm|研究生招生", ("登录", "报名系统", "yzbm", "网上报名", "填报")
SYSTEM, ARRIVAL = "登录|报名系统|yzbm|填报|申请系统", "开营|进校|入营|活动安排|夏令营活动"
STOPS = ("，", "。", "；", ";", "报名", "请于", "材料", "截止", "采用", "将", "举行", "填报")
NO_TIME = "发布时间|点击|分享|下载|附件|作者|来源|浏览|字号|上一篇|下一篇"
ANCHORS = ("申请时间", "报名时间", "网上报名", "报名系统", "填报时间", "活动时间", "开营时间", "夏令营安排", "夏令营", "入营时间", "招生简章")
SECTION, TOPICAL = "(?=[一二三四五六七八九十百]+[、．.])", "夏令营|报名|开营|填报|申请|截止|入营|暑期|优营"
CLOSED_UP = ("开营", "报名", "截止", "申请", "举办", "活动", "填报", "发布", "拟于", "将于")


def held(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The trimmed group of the first match; null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, f"(?U){pattern}", group)), F.lit(""))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?U){pattern}")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def reference_year(text: Column, at: Column) -> Column:
    """The latest 20xx that does not name a cohort, else the year of ``at``."""
    years = F.transform(F.regexp_extract_all(held(text), F.lit(r"(?U)(20\d{2})(?!\s?届)"), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(F.array_max(years), F.year(at))


def normalised(raw: Column, year: Column, deadline: bool = False) -> Column:
    """A date with its clock, noon, morning or afternoon hour; without any of them a deadline ends its day."""

    def date(r: Column) -> Column:
        full, short = r"(\d{4})[年\-/.](\d{1,2})[月\-/.](\d{1,2})", r"(\d{1,2})[月\-/.](\d{1,2})"
        has_full, two = has(r, full), lambda x: F.lpad(x, 2, "0")
        part = [F.when(has_full, F.regexp_extract(r, full, k + 1)).otherwise(F.regexp_extract(r, short, k)) for k in (1, 2)]
        day = F.concat_ws("-", F.when(has_full, F.regexp_extract(r, full, 1)).otherwise(year.cast("string")), two(part[0]), two(part[1]))
        hour, clock = found(r, r"(\d{1,2})\s*点"), [F.regexp_extract(r, r"(\d{1,2}):(\d{2})(?::(\d{2}))?", k) for k in (1, 2, 3)]
        point, no_clock = has(r, "点"), clock[0] == ""
        late = F.coalesce(hour, F.lit("12")).cast("int")
        o_clock = lambda h: F.concat(two(h.cast("string")), F.lit(":00:00"))
        time = (
            F.when(has(r, "中午|午间"), "12:00:00").when(has(r, "下午") & point & no_clock, o_clock(F.when(late < 12, late + 12).otherwise(late))).when(has(r, "上午") & point & no_clock, o_clock(F.coalesce(hour, F.lit("9"))))
            .when(point & no_clock, o_clock(F.coalesce(hour, F.lit("12")))).when((clock[0] == "24") & (clock[1] == "00") & clock[2].isin("", "00"), "23:59:59")
            .when(~no_clock, F.concat_ws(":", two(clock[0]), clock[1], F.when(clock[2] != "", clock[2]).otherwise("00"))).otherwise("23:59:59" if deadline else "00:00:00")
        )
        return F.when(has(r, short), F.concat_ws(" ", day, time))

    return bound(raw, date)


def qualified(raw: Column, tail: Column) -> Column:
    """The date with what its tail says of noon, morning, afternoon or 24:00, if it does not say so itself."""
    noon, half, hour = "中午|午间", F.regexp_extract(tail, r"(?U)(上午|下午)\s*(\d{1,2})点", 1), F.regexp_extract(tail, r"(?U)(上午|下午)\s*(\d{1,2})点", 2)
    return (
        F.when(has(tail, noon) & ~has(raw, noon), F.concat(raw, F.lit(" 中午"), F.coalesce(found(tail, r"(\d{1,2})点"), F.lit("12")), F.lit("点")))
        .when((half != "") & ~raw.contains(half), F.concat(raw, F.lit(" "), half, hour, F.lit("点"))).when(has(tail, "24[:：]00") & ~raw.contains("24"), F.concat(raw, F.lit(" 24:00"))).otherwise(raw)
    )


def _ended(text: Column, pattern: str, group: int, after: int, year: Column) -> Column:
    """The date that ends a phrase, with the qualifier within the characters after it."""
    tailed = rf"{pattern}([\s\S]{{0,{after}}})"
    raw, tail = found(text, tailed, group), F.regexp_extract(text, f"(?U){tailed}", group + 1)
    return F.when(raw.isNotNull(), normalised(qualified(raw, tail), year, True))


def registration_period(text: Column, at: Column) -> Column:
    """(start, end) of the range of dates that most clearly belongs to the registration; the first of equals.

    The 35 characters before a range may not speak of an event; 40 before and 120 after it must speak of registration.
    """
    year, whole = reference_year(text, at), held(text)
    ranges = F.regexp_extract_all(whole, F.lit(rf"(?U){ANY_DAY}{AT}\s*{TO}\s*{ANY_DAY}{AT}"), F.lit(0))

    def step(best: Column, match: Column) -> Column:
        place = F.position(match, whole, best["next"])
        end = place + F.length(match)
        cut = lambda a, b: F.substring(whole, F.greatest(F.lit(1), a), b - F.greatest(F.lit(1), a))
        before, window = cut(place - 35, place), cut(place - 40, end + 120)
        fits = ~has(before, HOSTING) & ~window.contains(HOSTED) & has(window, REGISTER)
        score = sum((F.when(window.contains(w), 5).otherwise(0) for w in STRONG), F.lit(0))
        better = fits & (score > best["score"])
        return F.struct(
            end.cast("int").alias("next"), F.when(better, score).otherwise(best["score"]).alias("score"), F.when(better, match).otherwise(best["range"]).alias("range"), F.when(better, cut(end, end + 20)).otherwise(best["tail"]).alias("tail")
        )

    none = F.lit(None).cast("string")
    best = F.aggregate(ranges, F.struct(F.lit(1).alias("next"), F.lit(-1).alias("score"), none.alias("range"), none.alias("tail")), step)
    ends = rf"{ANY}\s*{TO}\s*{ANY}"
    return bound(best, lambda b: F.struct(normalised(found(b["range"], ends, 1), year).alias("start"), normalised(qualified(found(b["range"], ends, 2), b["tail"]), year, True).alias("end")))


def first_date(text: Column, patterns: tuple[str, ...], year: Column, deadline: bool = False) -> Column:
    return normalised(F.coalesce(*[found(text, p) for p in patterns]), year, deadline)


def published(text: Column, at: Column) -> Column:
    """Publish date: after its labels (headings like 发布时间 2026/6/1 among them), else a date that ends the text."""
    whole = held(text)
    year = reference_year(whole, at)
    return F.coalesce(first_date(whole, PUBLISHED, year), normalised(found(F.right(F.trim(whole), F.lit(80)), LAST_DAY), year))


def opens(text: Column, at: Column) -> Column:
    """Opening of the registration: pair, publish date if from now on, time range, phrases, best period."""
    whole = held(text)
    year = reference_year(whole, at)
    pair, span = normalised(found(whole, OPEN_CLOSE, 1), year), normalised(found(whole, TIME_RANGE, 1), year)
    return F.coalesce(pair, F.when(has(whole, FROM_NOW), published(whole, at)), span, first_date(whole, OPENS, year), registration_period(whole, at)["start"])


def deadline(text: Column, at: Column) -> Column:
    """Deadline: pair, explicit, end of a time range, from now until, phrases, end of a registration range, best period."""
    whole = held(text)
    year = reference_year(whole, at)
    explicit = rf"{EXPLICIT}([\s\S]{{0,20}})"
    raw, said = found(whole, explicit, 1), F.regexp_extract(whole, f"(?U){explicit}", 0)
    exact = F.when(raw.isNotNull(), normalised(qualified(raw, said), year, True))
    return F.coalesce(
        normalised(found(whole, OPEN_CLOSE, 2), year, True), exact, _ended(whole, TIME_RANGE, 2, 20, year), _ended(whole, FROM_NOW, 1, 30, year), first_date(whole, DEADLINES, year, True),
        normalised(found(whole, REGISTRATION, 2), year, True), registration_period(whole, at)["end"],
    )


def resolved_publish_date(text: Column, url: Column, at: Column, places: Column | None = None) -> Column:
    """Opening of the registration, else its range's start, the publish date told by ``places``, by the text, by the url.

    ``places`` are texts of a page in the order in which they are asked (``dom.PageDates``); null ones tell nothing.
    """
    year = reference_year(text, at)
    told = [] if places is None else [F.get(F.filter(F.transform(F.coalesce(places, F.array().cast("array<string>")), lambda x: published(x, at)), lambda d: d.isNotNull()), F.lit(0))]
    return F.coalesce(opens(text, at), normalised(found(held(text), REGISTRATION, 1), year), *told, published(text, at), date_of_url(url))


# Dates in paths, in the order in which they are tried.
PATHS = (r"/(\d{4})(\d{2})(\d{2})/", r"/(\d{4})/(\d{2})(\d{2})/", r"/(\d{4})-(\d{2})-(\d{2})")
MONTH_PATH = r"/(\d{4})/(\d{2})/"


def date_of_url(url: Column) -> Column:
    """The date in a path: /YYYYMMDD/, /YYYY/MMDD/ or /YYYY-MM-DD; not checked."""
    return F.coalesce(*[F.when(url.rlike(f), F.concat(F.concat_ws("-", *[F.regexp_extract(url, f, k) for k in (1, 2, 3)]), F.lit(" 00:00:00"))) for f in PATHS])


def year_of_url(url: Column) -> Column:
    """The year in a path, of a date or of /YYYY/MM/; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, f, 1), F.lit("")) for f in (*PATHS, MONTH_PATH)]).cast("int")


def event_format(text: Column) -> Column:
    """线上线下, 线上 or 线下 by the phrases of a text, its white space left out; null if it tells none."""
    whole = F.regexp_replace(held(text), r"(?U)\s+", "")
    ways = bound(whole, lambda t: F.struct(has(t, BOTH_WAYS).alias("both"), has(t, ONLINE).alias("online"), has(t, OFFLINE).alias("offline")))
    return bound(ways, lambda w: F.when(w["both"] | (w["online"] & w["offline"]), "线上线下").when(w["online"], "线上").when(w["offline"], "线下"))


def item_times(text: Column, url: Column, at: Column, places: Column | None = None) -> Column:
    """What a text tells of one notice: a struct of publish_date, deadline, event_time and event_format.

    The focused text is asked first, then the whole; what either finds after being focused once more is merged, the more
    precise date winning, so that a notice's own part of a long page comes before the rest.
    """

    def told(ts: Column) -> Column:
        again = ts[0] != ts[1]
        # (what is the same as the text before it tells nothing more)
        dates = F.transform(ts, lambda t, k: F.when((k == 1) | ((k == 0) & again) | ((k == 2) & (ts[1] != ts[2])), F.struct(resolved_publish_date(t, url, at, places).alias("publish_date"), deadline(t, at).alias("deadline"))))
        merged = bound(dates, lambda d: F.struct(*[merged_datetime(F.coalesce(d[0][f], d[1][f]), F.coalesce(d[1][f], d[2][f])).alias(f) for f in ("publish_date", "deadline")]))
        when = F.coalesce(F.when(again, event_time(ts[0])), event_time(ts[1]), event_time(ts[2]))
        return bound(merged, lambda m: F.struct(m["publish_date"].alias("publish_date"), m["deadline"].alias("deadline"), when.alias("event_time"), F.coalesce(event_format(ts[2]), event_format(ts[1])).alias("event_format")))

    return bound(bound(held(text), lambda t: bound(focused(t), lambda f: F.array(focused(f), f, t))), told)


def merged_times(old: dict[str, Column], told: Column) -> dict[str, Column]:
    """The four fields of a stored notice with what its text tells: more precise dates win, the others only fill gaps."""
    dates = {f: merged_datetime(F.nullif(old[f], F.lit("")), told[f]) for f in ("publish_date", "deadline")}
    return dates | {f: F.coalesce(F.nullif(old[f], F.lit("")), told[f]) for f in ("event_time", "event_format")}


def _cleaned(raw: Column) -> Column:
    """An event time without leading punctuation and notes in brackets, cut at the first stop word; empty if it tells no time."""
    dated = r"\d{1,2}[月\-/.]|至|到|\d{4}-\d{2}-\d{2}|\d{4}年|上旬|中旬|下旬"
    tidy = F.regexp_replace(F.trim(F.regexp_replace(raw, r"(?U)\s+", " ")), r"^[：:，,\s]+", "")
    tidy = F.trim(F.regexp_replace(tidy, r"[（(][^）)]*(?:另行通知|待定|以.*为准)[^）)]*[）)]", ""))

    def cut(t: Column) -> Column:
        places = F.filter(F.transform(F.array(*map(F.lit, STOPS)), lambda s: F.position(s, t)), lambda p: p > 1)
        return F.when(F.size(places) > 0, F.left(t, F.array_min(places) - 1)).otherwise(t)

    ok = lambda t: ~has(t, NO_TIME) & (~t.contains("报名") | has(t, "夏令营|开营")) & has(t, dated)
    return bound(bound(tidy, cut), lambda t: F.when(ok(t), F.left(t, F.lit(80))).otherwise(""))


def event_time(text: Column) -> Column:
    """When the event takes place: the first phrase of the first sentence that has one, else of the whole text."""
    whole = held(text)

    def times(t: Column) -> Column:
        raw = F.filter(F.array(*[F.regexp_extract(t, f"(?U){p}", 1) for p in EVENTS]), lambda x: x != "")
        return F.filter(F.transform(raw, _cleaned), lambda x: F.length(x) >= 4)

    # forms have a digit, all but one; a sentence is read only as long as none before it has told a time
    own = F.filter(F.split(whole, r"[。；\n]"), lambda s: has(s, rf"\d|{UNDATED}") & ~(has(s, SYSTEM) & ~has(s, ARRIVAL)))
    by_sentence = F.aggregate(own, F.lit(None).cast("string"), lambda told, s: F.coalesce(told, F.get(times(s), F.lit(0))))
    return F.coalesce(by_sentence, F.get(F.filter(times(whole), lambda x: ~F.left(x, F.lit(20)).contains("报名")), F.lit(0)))


def compact(text: Column) -> Column:
    """Text without the blanks that tear dates and phrases apart."""
    whole = out = held(text)
    for pattern, by in ((r"(\d)\s+(?=\d)", "$1"), (r"(\d)\s+(?=[年月日:：\-/])", "$1"), (r"([年月日时分秒])\s+", "$1"), (r"(\d)\s+(?=\d)", "$1"), (rf"({'|'.join(CLOSED_UP)})\s+", "$1"), (r"(拟|将)\s+于", "$1于"), (r"至\s+(\d)", "至$1")):
        out = F.regexp_replace(out, f"(?U){pattern}", by)
    return F.when(has(whole, r"\s"), out).otherwise(whole)


def focused(text: Column) -> Column:
    """From 80 characters before the first anchor (by priority) 6,080 characters, else the topical sections, else all."""

    def focus(t: Column) -> Column:
        at = lambda a: F.greatest(F.lit(1), F.position(F.lit(a), t) - 80)
        near = F.coalesce(*[F.when(t.contains(a), F.substring(t, at(a), F.position(F.lit(a), t) + 6000 - at(a))) for a in ANCHORS])
        parts = F.filter(F.split(t, SECTION), lambda p: has(p, TOPICAL))
        return F.coalesce(near, F.nullif(F.array_join(parts, "\n"), F.lit("")), t)

    return bound(compact(text), focus)


def model_datetime(value: Column) -> Column:
    """A date as a model writes it, padded; other text of eight characters or more as it is, else null."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(held(value)), "[年月./]", "-"), "[日号]", ""), r"(?U)\s+", " ")
    form, two = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:\s*(\d{1,2}):(\d{2})(?::(\d{2}))?)?", lambda x: F.lpad(x, 2, "0")

    def pad(s: Column) -> Column:
        g = [F.regexp_extract(s, form, k) for k in range(1, 7)]
        time = F.when(g[3] != "", F.concat_ws(":", two(g[3]), g[4], F.when(g[5] != "", g[5]).otherwise("00"))).otherwise("00:00:00")
        return F.when(g[0] != "", F.concat_ws(" ", F.concat_ws("-", g[0], two(g[1]), two(g[2])), time)).when(F.length(s) >= 8, s)

    return F.when(~held(value).isin("", "未知", "null", "None", "无"), bound(plain, pad))


def feed_date(value: Column) -> Column:
    """Timestamp of an RFC 822 date; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(held(value), r"^\s*[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def any_of(checks: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, checks, F.lit(False))

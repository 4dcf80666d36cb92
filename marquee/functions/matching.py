"""Whose announcement a text or address is: hosts, aliases, colleges named in titles, official sources; as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import classify as C
from .announced import bound
from .rules import any_word

# First labels of hosts that colleges use, and paths of notice lists.
LAW_ALIASES = ("fxy", "lf", "lawschool", "wenfa", "zfxy", "faxue")
LANGUAGE_ALIASES = ("wyxy", "flc", "fld", "wwxy", "wgy", "sfs", "foreign", "wy", "sis", "fl", "sfl", "waiyu", "cfl", "dfll")
NOTICE_PATHS = ("tzgg", "xwzx", "notice", "info", "list", "news", "gg", "announcement", "zsgz", "yjs", "graduate", "postgraduate", "xygg", "gonggao", "article", "content", "show")
FAMILIES = ("法学院", "外国语", "外语", "外文", "法学", "法律", "英语学院", "翻译")
COLLEGE = r"([一-鿿]{2,14}学院)"
KEY_WORDS = ("截止", "报名", "申请", "开放", "举办", "夏令营", "预推免", "线上", "线下", "混合", "腾讯会议", "Zoom", "报到", "活动时间")


def registered_suffix(host: Column) -> Column:
    """The last two labels of a host, three under edu.cn and ac.cn."""
    return F.when(host.rlike(r"\.(edu|ac)\.cn$"), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def alias_hosts(homepage: Column, college_type: Column, limit: int = 6) -> Column:
    """Hosts that a college may also have: its type's first labels before the registered suffix, without its present host."""
    host = C.host(homepage)
    pool = F.when(college_type == "law", F.array(*map(F.lit, LAW_ALIASES))).otherwise(F.array(*map(F.lit, LANGUAGE_ALIASES)))
    made = F.transform(F.filter(pool, lambda a: a != F.substring_index(host, ".", 1)), lambda a: F.concat_ws(".", a, registered_suffix(host)))
    usable = homepage.rlike("^https?://") & host.contains(".")
    return F.when(usable, F.slice(F.array_except(made, F.array(host)), 1, limit)).otherwise(F.array().cast("array<string>"))


def candidate_urls(homepage: Column, paths: tuple[str, ...], manual: Column, discovered: Column) -> Column:
    """Addresses to try, each once: discovered ones, manual ones, then the homepage's usual paths."""
    base = F.rtrim(homepage, F.lit("/"))
    return F.array_distinct(F.concat(discovered, manual, F.transform(F.array(*map(F.lit, ("", *paths))), lambda p: F.concat(base, p))))


def search_queries(university: Column, college: Column, hosts: Column, topics: tuple[str, ...], without: tuple[str, ...], limit: int) -> Column:
    """Search phrases: quoted and plain names, then each host, with every topic; unwanted words are excluded once, at the end."""
    minus = " ".join(f"-{w}" for w in without)
    names = F.array(F.concat(F.lit('"'), university, F.lit('" "'), college, F.lit('"')), F.concat_ws(" ", university, college))
    heads = F.concat(names, F.transform(hosts, lambda h: F.concat(F.lit("site:"), h)))
    made = F.flatten(F.transform(heads, lambda h: F.transform(F.array(*map(F.lit, topics)), lambda t: F.concat_ws(" ", h, t, F.lit(minus)))))
    return F.slice(F.array_distinct(made), 1, limit)


def college_mismatch(title: Column, university: Column, college: Column, unknown: str = "未知") -> Column:
    """Whether the title names another college right after the university; a family of the same subject is no mismatch."""
    t, own, uni = C.text(title), C.text(college), C.text(university)
    start = F.when((uni != "") & t.contains(uni), F.position(uni, t) + F.length(uni)).otherwise(F.lit(1))
    named = F.regexp_extract(F.substring(t, start, F.lit(32)), COLLEGE, 1)
    short = F.replace(own, F.lit("学院"), F.lit(""))
    spoken = lambda n: (n == own) | n.contains(own) | own.contains(n) | (own.endswith("法学院") & n.contains("法学")) | (own.rlike("外国语|外语") & n.rlike("外语|外国语|外文|英语"))
    waived = own.isin("", unknown) | t.contains(own) | ((F.length(short) >= 2) & t.contains(short))
    return bound(named, lambda n: ~waived & (n != "") & ~spoken(n))


def college_in_title(title: Column, college: Column) -> Column:
    """Whether the title names the college: in full, by a fragment of its family, or by its short form of two characters or more."""
    t, own = C.text(title), C.text(college)
    family = F.exists(F.array(*map(F.lit, FAMILIES)), lambda f: own.contains(f) & t.contains(f))
    short = F.regexp_replace(own, "学院|系|部", "")
    return ((F.length(own) >= 3) & t.contains(own)) | family | ((F.length(short) >= 2) & t.contains(short))


def official_source(url: Column, title: Column, summary: Column, university: Column, college: Column, target_host: Column, suffixes: tuple[str, ...], messaging: str, topics: tuple[str, ...]) -> Column:
    """(ok, label) of an address: an official host, and the target's own, or a text that names the university on a notice page."""
    h, both = C.host(url), F.concat_ws(" ", C.text(title), C.text(summary))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    is_messaging = h.contains(messaging)
    official = is_messaging | h.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    named, own = both.contains(university), (h == target_host) | h.endswith(F.concat(F.lit("."), target_host))
    reached = own | (named & (any_word(path, NOTICE_PATHS) | any_word(title, topics)))
    ok = url.rlike("^http") & official & F.when(is_messaging, named | both.contains(college)).otherwise(reached)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok & is_messaging, "messaging").when(ok & own, "college").when(ok, "university").otherwise("").alias("label"))


def college_subdomain(url: Column, root: Column) -> Column:
    """Whether a host below the university's root is a college's, not the root, its news or a general first label."""
    h = C.host(url)
    first = F.substring_index(h, ".", 1)
    return (root == "") | ((h != root) & ~(h.startswith("news.") & h.contains(root)) & (F.length(first) >= 2) & ~first.isin("www", "news", "english"))


def homepage_verdict(url: Column, root: Column, blocked: tuple[str, ...], markers: tuple[str, ...]) -> Column:
    """Why a homepage is refused, or ``ok`` (its first label names a college) or ``subdomain``."""
    h = F.coalesce(C.host(url), F.lit(""))
    first = F.substring_index(h, ".", 1)
    return (
        F.when(~url.rlike("^http"), "not http").when(h == "", "no host").when((root != "") & (h == root), "root").when(first.isin(*blocked), "blocked").when(h.startswith("news.") & (root != "") & h.contains(root), "news")
        .when(any_word(first, markers), "ok").when((root != "") & h.endswith(root) & (F.length(first) >= 3), "subdomain").otherwise("no college")
    )


def key_paragraphs(text: Column, words: tuple[str, ...], limit: int = 3000, enough: int = 1500) -> Column:
    """The passages with most key words, longer ones first, within ``limit`` characters; short texts stay whole.

    It stops at ``enough`` characters if the passage has two words; a passage beyond the limit is cut if 80 are left.
    """
    whole = F.trim(F.regexp_replace(C.text(text), r"(?U)\s+", " "))

    def pick(t: Column) -> Column:
        score = lambda p: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: p.contains(w)))
        parts = F.filter(F.transform(F.split(t, r"(?<=[。！？；;.])\s*"), lambda p: F.trim(p)), lambda p: F.length(p) >= 6)
        rated = F.filter(F.transform(parts, lambda p, k: F.struct((-score(p)).alias("s"), (-F.length(p)).alias("l"), k.alias("k"), p.alias("p"))), lambda x: x["s"] < 0)

        def step(acc: Column, x: Column) -> Column:
            size = -x["l"]
            over, left = acc["n"] + size > limit, F.lit(limit) - acc["n"]
            taken = F.when(acc["done"], acc["out"]).when(over & (left <= 80), acc["out"]).otherwise(F.array_append(acc["out"], F.when(over, F.left(x["p"], left)).otherwise(x["p"])))
            n = F.when(acc["done"] | over, acc["n"]).otherwise(acc["n"] + size)
            return F.struct(n.alias("n"), (acc["done"] | over | ((n >= min(enough, limit)) & (x["s"] <= -2))).alias("done"), taken.alias("out"))

        start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))
        picked = F.aggregate(F.array_sort(rated), start, step, lambda acc: acc["out"])
        return bound(picked, lambda x: F.when(F.size(x) > 0, F.left(F.array_join(x, "\n"), F.lit(limit))).otherwise(F.left(t, F.lit(limit))))

    return bound(whole, lambda t: F.when(F.length(t) <= limit, t).otherwise(pick(t)))


def url_array(raw: Column) -> Column:
    """Http addresses without fragments from a model's answer: what stands between its outermost brackets, as a JSON array."""
    inner = F.regexp_extract(C.text(raw), r"(?s)(\[.*\])", 1)
    urls = F.filter(F.coalesce(F.from_json(inner, "array<string>"), F.array().cast("array<string>")), lambda u: u.rlike("^https?://[^/]+"))
    return F.transform(urls, lambda u: F.trim(F.substring_index(u, "#", 1)))


def best_link(links: Column, official: str, messaging: str, thread: Column, thread_host: str) -> Column:
    """(url, source) of a post: its best official link, else a messaging article, else the thread itself, else nothing."""
    score = lambda u: F.when(u.rlike(r"/[0-9]+"), 6).otherwise(0) + F.when(any_word(F.lower(u), NOTICE_PATHS), 4).otherwise(0)
    ranked = lambda keep: F.get(F.array_sort(F.transform(F.filter(links, keep), lambda u, k: F.struct((-score(u)).alias("s"), k.alias("k"), u.alias("u")))), F.lit(0))["u"]
    own, posts = ranked(lambda u: u.rlike(official) & ~u.contains(messaging)), ranked(lambda u: u.contains(messaging) & u.contains("/s"))
    is_thread = thread.contains(thread_host) & thread.rlike(r"/thread-\d+")
    return F.struct(F.coalesce(own, posts, F.when(is_thread, thread), F.lit("")).alias("url"), F.when(own.isNotNull(), "official").when(posts.isNotNull(), "messaging").when(is_thread, "forum").otherwise("").alias("source"))

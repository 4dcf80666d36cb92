"""Derived columns and predicates of notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import FIXTURE, LABELS, RuleSet, SourceLabels, any_word, first_word
from .temporal import parse_datetime


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def slot(rules: RuleSet = FIXTURE) -> Column:
    """One of four: pre_notice, pre_result, camp_notice, camp_result."""
    pre = any_word(F.col("title"), rules.pre) | F.col("event_type").isin(*rules.pre)
    confirmed = any_word(F.col("title"), rules.result) & any_word(F.col("title"), rules.confirm)
    return (
        F.when(pre & confirmed, "pre_result").when(pre, "pre_notice").when((F.col("status") == "excellent_list") | any_word(F.col("title"), rules.excellent), "camp_result").otherwise("camp_notice")
    )


def board() -> Column:
    return F.when(slot().startswith("pre"), "pre_admission").otherwise("summer_camp")


def effective_status(at: Column) -> Column:
    """excellent_list stays; a past deadline has ended; else the stored status if it is known."""
    known = F.col("status").isin("active", "ended")
    return F.when(F.col("status") == "excellent_list", "excellent_list").when(parse_datetime(F.col("deadline")) < at, "ended").when(known, F.col("status")).otherwise("active")


def canonical_source(labels: SourceLabels = LABELS) -> Column:
    s = F.trim(text("source"))
    forum = s.startswith(labels.forum[0]) | s.startswith(labels.forum[1])
    return (
        F.when(s == "", labels.official).when(s.contains(labels.manual), labels.manual).when(s.contains(labels.submit), labels.submit).when(s == labels.search, labels.search)
        .when(s.startswith(labels.messaging) | F.lower(s).contains("weixin"), labels.messaging).when(forum, "forum").otherwise(labels.official)
    )


def is_manual() -> Column:
    return text("source").contains(LABELS.manual)


def detected_status(at: Column, rules: RuleSet = FIXTURE) -> Column:
    """From title and deadline: excellent words, then ended words, then a past deadline, else active."""
    return F.when(any_word(F.col("title"), rules.excellent), "excellent_list").when(any_word(F.col("title"), rules.ended), "ended").when(parse_datetime(F.col("deadline")) < at, "ended").otherwise("active")


def title_years() -> Column:
    return F.transform(F.regexp_extract_all("title", F.lit(r"(20\d{2})"), F.lit(1)), lambda y: y.cast("int"))


def year_ok(least: int, as_of_year: int, rules: RuleSet = FIXTURE) -> Column:
    """Whether the newest year of title, publish date and deadline is recent enough."""
    inside = [F.expr(f"try_cast(substring({c}, 1, 4) AS int)") for c in ("publish_date", "deadline")]
    others = F.array_compact(F.array(*[F.when(y.between(least - 1, least + 2), y) for y in inside]))
    newest, titles = F.array_max(F.concat(title_years(), others)), title_years()
    return F.when(F.array_max(titles) < least, False).when(newest.isNull(), any_word(F.col("title"), rules.topics) & F.lit(as_of_year >= least)).otherwise(newest >= least)


def tier(tags: Column) -> Column:
    return F.when(F.array_contains(tags, "985"), "985").when(F.array_contains(tags, "211"), "211").when(F.array_contains(tags, "dual"), "dual")


FIELDS = ("publish_date", "deadline", "event_time", "event_format")


def filled() -> list[Column]:
    return [text(f) != "" for f in FIELDS]


def missing_fields(labels: tuple[str, ...] = FIELDS) -> Column:
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in zip(labels, filled(), strict=True)]))


def confidence() -> Column:
    return sum((ok.cast("int") for ok in filled()), F.lit(0)) / F.lit(4.0)


def noise_reason(title: Column, summary: Column, url: Column, rules: RuleSet = FIXTURE, phase: str = "notice", pre_board: bool = False) -> Column:
    """Why a title is rejected, by the first rule of the cascade that holds; null if it is accepted."""
    both = F.trim(F.concat_ws(" ", text(title), text(summary)))
    waived = any_word(both, rules.waiver)
    hit = lambda words, where, name: F.concat(F.lit(f"{name}:"), first_word(where, words))
    form = text(title).startswith(rules.form_start) | (any_word(title, rules.form_hints) & ~any_word(title, rules.document_marks))
    steps = [
        hit(rules.learned, both, "bad_pattern"),
        hit(rules.bad_urls, url, "bad_url"),
        F.when(~waived, hit(rules.blacklist, both, "blacklist")),
        hit(rules.exclude, title, "exclude"),
        F.when(any_word(both, rules.recap) & ~waived, "high_school_or_recap"),
        F.when(form, "attachment_form"),
        F.when(any_word(both, rules.foreign) & ~waived, "international_program"),
        F.when(any_word(both, rules.outbound), "outbound_news"),
    ]
    if phase != "result":
        steps.append(F.when(~any_word(both, rules.pre_whitelist if pre_board else rules.whitelist), "no_whitelist"))
        steps.append(F.when(any_word(title, rules.camp) & ~any_word(title, rules.intent) & any_word(title, rules.activity), "camp_activity_news"))
    return F.coalesce(*steps)


def subject_relevant(title: Column, college_type: Column, waived: Column, topics: tuple[str, ...], rules: RuleSet = FIXTURE) -> Column:
    """A topic or an excellent word, and a word of the college's subject, which messaging sources need not have."""
    topical = any_word(title, topics) | any_word(title, rules.excellent[1:])
    return topical & (waived | F.when(college_type == "law", any_word(title, rules.law)).otherwise(any_word(title, rules.language)))


def host(url: Column) -> Column:
    """Host in lower case without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def url_key(url: Column) -> Column:
    """Host and path without the last slash, the key by which pages are the same."""
    return F.concat(host(url), F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", ""))

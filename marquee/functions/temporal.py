"""Dates that are kept as text: parsing, padding, windows. Every clock is the explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AS_OF = "1998-04-01 00:00:00"


def as_of(at: str = AS_OF) -> Column:
    return F.lit(at).cast("timestamp")


def parse_datetime(text: Column) -> Column:
    """Timestamp of the first 19, 16 or 10 characters, whichever form fits first; null if none does."""
    forms = ((19, "yyyy-M-d H:m:s"), (16, "yyyy-M-d H:m"), (10, "yyyy-M-d"))
    return F.coalesce(*[F.try_to_timestamp(F.substring(text, 1, n), F.lit(form)) for n, form in forms])


def first_plain_date(text: Column, separators: str = r"[-./]") -> Column:
    """The first year-month-day of a text, zero-padded; null without one."""
    pattern = rf"(20\d{{2}}){separators}(\d{{1,2}}){separators}(\d{{1,2}})"
    part = [F.regexp_extract(text, pattern, k) for k in (1, 2, 3)]
    return F.when(part[0] != "", F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")))


def normalise_datetime(text: Column, reference_year: Column, deadline: bool = False) -> Column:
    """``Y-M-D`` or ``M-D`` with a clock, noon, am or pm words, as padded text that is not validated.

    Noon comes before anything else; 24:00 is the last second of the day; without a clock a deadline ends its day.
    """
    full, short = r"(20\d{2})[-./](\d{1,2})[-./](\d{1,2})", r"(?:^|[^\d])(\d{1,2})[-./](\d{1,2})(?:[^\d]|$)"
    has = F.regexp_extract(text, full, 1) != ""
    year = F.when(has, F.regexp_extract(text, full, 1)).otherwise(reference_year.cast("string"))
    month = F.when(has, F.regexp_extract(text, full, 2)).otherwise(F.regexp_extract(text, short, 1))
    day = F.when(has, F.regexp_extract(text, full, 3)).otherwise(F.regexp_extract(text, short, 2))
    clock = [F.regexp_extract(text, r"(\d{1,2}):(\d{2})(?::(\d{2}))?", k) for k in (1, 2, 3)]
    half = F.try_to_number(F.regexp_extract(text, r"(?i)(\d{1,2})\s*(am|pm)\b", 1), F.lit("99")).cast("int")
    pm = F.lower(F.regexp_extract(text, r"(?i)(\d{1,2})\s*(am|pm)\b", 2))
    time = (
        F.when(text.rlike(r"(?i)\bnoon\b"), "12:00:00")
        .when(half.isNotNull(), F.concat(F.lpad(F.when((pm == "pm") & (half < 12), half + 12).otherwise(half).cast("string"), 2, "0"), F.lit(":00:00")))
        .when(clock[0] == "24", "23:59:59")
        .when(clock[0] != "", F.concat_ws(":", F.lpad(clock[0], 2, "0"), clock[1], F.when(clock[2] != "", clock[2]).otherwise("00")))
        .otherwise("23:59:59" if deadline else "00:00:00")
    )
    return F.when(month != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), time))


def window_dates(at: Column, start: str, end: str) -> tuple[Column, Column]:
    """Dates of a ``MM-DD`` window in the year of ``at``."""
    year = F.year(at)
    return tuple(F.make_date(year, F.lit(int(x[:2])), F.lit(int(x[3:]))) for x in (start, end))


def next_check(at: Column, start: str = "07-01", end: str = "08-20", interval: int = 1) -> Column:
    """Before the window its start, after it next year's start, inside it some days on; ends included."""
    first, last = window_dates(at, start, end)
    day = F.to_date(at)
    return F.when(day < first, first.cast("timestamp")).when(day > last, F.add_months(first, 12).cast("timestamp")).otherwise(at + F.make_interval(days=F.lit(max(1, interval))))


def merged_datetime(old: Column, new: Column) -> Column:
    """The more precise of two texts: not midnight before midnight, then the longer new one, else the old one."""
    return (
        F.when(new.isNull(), old).when(old.isNull(), new).when(old.endswith("00:00:00") & ~new.endswith("00:00:00"), new).when(F.length(new) > F.length(old), new).otherwise(old)
    )

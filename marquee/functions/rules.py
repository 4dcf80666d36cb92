"""Rules as data: keyword lists, and the columns that they make."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text contains any of the words; null counts as empty."""
    held = F.coalesce(text, F.lit(""))
    out = F.lit(False)
    for w in words:
        out = out | held.contains(w)
    return out


def first_word(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the words, in their order, that the text contains; null if none."""
    held = F.coalesce(text, F.lit(""))
    return F.coalesce(*[F.when(held.contains(w), F.lit(w)) for w in words]) if words else F.lit(None).cast("string")


def count_words(text: Column, words: tuple[str, ...]) -> Column:
    held = F.coalesce(text, F.lit(""))
    return sum((held.contains(w).cast("int") for w in words), F.lit(0))


@dataclass(frozen=True)
class RuleSet:
    """Word lists of one domain. The defaults fit the derived tables."""

    pre: tuple[str, ...] = ("pre",)
    result: tuple[str, ...] = ("result", "outcome")
    confirm: tuple[str, ...] = ("list", "final")
    excellent: tuple[str, ...] = ("result list", "excellent")
    ended: tuple[str, ...] = ("closed", "ended")
    topics: tuple[str, ...] = ("notice", "list")
    whitelist: tuple[str, ...] = ("tion", "ing")
    pre_whitelist: tuple[str, ...] = ("ment", "heit")
    learned: tuple[str, ...] = ("idiot", "Copyright")
    bad_urls: tuple[str, ...] = ("/es/", "ref=x")
    blacklist: tuple[str, ...] = ("clown", "moron", "scum")
    waiver: tuple[str, ...] = ("there", "leur")
    exclude: tuple[str, ...] = ("Licensed", "And re")
    recap: tuple[str, ...] = ("loser", "trash")
    form_start: str = "An"
    form_hints: tuple[str, ...] = (" | ", "e-mail")
    document_marks: tuple[str, ...] = ("the", "der")
    foreign: tuple[str, ...] = ("worthless", "stupid")
    outbound: tuple[str, ...] = ("pathetic", "disgusting")
    camp: tuple[str, ...] = ("Th", "Er")
    intent: tuple[str, ...] = ("with", "und")
    activity: tuple[str, ...] = ("ea", "ver")
    law: tuple[str, ...] = ("BUILDING", "FURNITURE")
    language: tuple[str, ...] = ("MACHINERY", "AUTOMOBILE", "HOUSEHOLD")


@dataclass(frozen=True)
class SourceLabels:
    """Labels of the six source categories, and what leads to them."""

    manual: str = "manual"
    submit: str = "submit"
    search: str = "search"
    messaging: str = "messaging"
    forum: tuple[str, ...] = ("forum", "board:")
    official: str = "official"


FIXTURE = RuleSet()
LABELS = SourceLabels()
CATEGORIES = ("official", "search", "messaging", "forum", "submit", "manual")

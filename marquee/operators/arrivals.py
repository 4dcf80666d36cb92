"""What a crawl brought, saved whole: gate, owner, match, merge and what follows for coverage and waiting targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import matching as M
from ..functions.rules import FIXTURE, RuleSet
from ..sources.versions import kept
from .store import FILLED, KEY, REPLACED, attribute_by_domain, coverage_upsert, first_per_key, guarded, match_existing

UNKNOWN = ("未知", "未知", "law")


def gate(least_year: int, as_of_year: int, rules: RuleSet = FIXTURE) -> Column:
    """Whether an arrival may be saved: not rejected by the model, a web address, a recent year, a title that no rule refuses."""
    pre = C.board() == "pre_admission"
    noise = F.when(pre, C.noise_reason(F.col("title"), F.col("summary"), F.col("url"), rules, pre_board=True)).otherwise(C.noise_reason(F.col("title"), F.col("summary"), F.col("url"), rules))
    return ~F.coalesce("rejected", F.lit(False)) & F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)) & C.year_ok(least_year, as_of_year, rules) & noise.isNull()


def owned(arrived: DataFrame, targets: DataFrame) -> DataFrame:
    """Arrivals with a university, college and college_type: their own, else by domain or title, else unknown ones.

    ``targets`` has ord, university, college, college_type and domain. Rows whose title names another college go.
    """
    own = C.text("university") != ""
    found = attribute_by_domain(arrived.where(~own).select(F.col("ord").alias("id"), "title", "url"), targets).where("university <> ''")
    types = targets.groupBy("university", "college").agg(F.min_by("college_type", "ord").alias("f_type"))
    found = kept(found.join(types, ["university", "college"]).select(F.col("id").alias("ord"), F.col("university").alias("f_university"), F.col("college").alias("f_college"), "f_type"), "save-owners")
    named = arrived.join(found, "ord", "left")
    fields = ("university", "college", "college_type")
    values = [F.when(own & (C.text(c) != ""), F.col(c)).when(~own & F.col(f).isNotNull(), F.col(f)).otherwise(u) for c, f, u in zip(fields, ("f_university", "f_college", "f_type"), UNKNOWN, strict=True)]
    out = named.select(*[c for c in arrived.columns if c not in fields], *[v.alias(c) for c, v in zip(fields, values, strict=True)])
    return out.where(~M.college_mismatch(F.col("title"), F.col("university"), F.col("college")))


def save_notices(stored: DataFrame, arrived: DataFrame, targets: DataFrame, at: Column, accepted: Column) -> DataFrame:
    """All rows after a save: the stored columns, ``change`` (inserted, updated, kept) and ``touched`` (an arrival is this row).

    Of arrivals with one url the first (by ``ord``) counts; those that ``accepted`` does not hold for, and those that name
    another college, go. A stored row is found by url, original url or title (``match_existing``, by the arrival's own
    college only). Several arrivals that are one row are merged in their order: the last value that is there counts, and
    the longest summary, the first of equals. What is there replaces what is stored, a summary only if it is longer;
    manual rows keep precise times. A row takes its arrival's url; no other stored row can have it, as urls are matched
    first. Arrivals that are no row are inserted with their ``ord`` as id.
    """
    passed = kept(first_per_key(arrived.where(accepted), ["url"], ["ord"]), "save-passed")
    rows = owned(passed, targets)
    met = kept(match_existing(stored, passed.select("ord", "url", "original_url", "university", "college", "title")).select("ord", "id"), "save-met")
    rows = rows.drop("id").join(met, "ord", "left").withColumn("fresh", F.when(F.col("id").isNull(), F.col("ord")))
    last = lambda c: F.max_by(c, F.when(C.text(c) != "", F.col("ord")))
    longest = F.max_by("summary", F.struct(F.length(C.text("summary")), -F.col("ord")))
    first = lambda c: F.min_by(c, F.struct("ord"))
    owner = ("university", "college", "college_type", "event_type")
    new = kept(rows.groupBy("id", "fresh").agg(*[last(c).alias(f"n_{c}") for c in ("url", *REPLACED, *FILLED)], longest.alias("n_summary"), *[first(c).alias(f"n_{c}") for c in owner]), "save-rows")
    both = stored.join(new.where("fresh is null").drop("fresh"), "id", "left")
    manual, touched = C.is_manual(), F.col("n_url").isNotNull()
    value = {c: F.col(f"n_{c}") for c in ("url", *REPLACED)} | {c: guarded(F.col(c), F.col(f"n_{c}"), manual) for c in FILLED}
    take = {c: touched & (C.text(v) != "") & ~F.col(c).eqNullSafe(v) for c, v in value.items()}
    take["summary"], value["summary"] = touched & (F.length(C.text("n_summary")) > F.length(C.text("summary"))), F.col("n_summary")
    changed = F.lit(False)
    for t in take.values():
        changed = changed | t
    merged = {c: F.when(take[c], value[c]).otherwise(F.col(c)) for c in take} | {"updated_at": F.when(changed, at).otherwise(F.col("updated_at"))}
    old = both.select(*[merged.get(c, F.col(c)).alias(c) for c in stored.columns], F.when(changed, "updated").otherwise("kept").alias("change"), touched.alias("touched"))
    made = {"id": F.col("fresh"), "created_at": at, "updated_at": at} | {c: F.col(f"n_{c}") for c in (*take, *owner)}
    inserted = new.where("fresh is not null").select(*[made.get(c, F.lit(None)).cast(stored.schema[c].dataType).alias(c) for c in stored.columns], F.lit("inserted").alias("change"), F.lit(True).alias("touched"))
    return old.unionByName(inserted)


def covered_by(saved: DataFrame, at: Column) -> DataFrame:
    """Coverage rows of the touched notices: each fills the slot of its college."""
    return coverage_upsert(saved.where("touched").select(*KEY[:3], C.slot().alias("slot"), F.col("id").alias("announcement_id"), at.alias("touched_at")))


def still_waiting(waiting: DataFrame, saved: DataFrame) -> DataFrame:
    """Waiting targets without those whose college a touched notice belongs to."""
    return waiting.join(saved.where("touched").select(*KEY[:3]).distinct(), KEY[:3], "left_anti")

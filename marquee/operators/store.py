"""Write side: new states of the notice, coverage and pending tables, as declarative plans.

Each function returns a whole new state, since plain Parquet cannot change rows; ``marquee.sources.versions`` commits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.temporal import merged_datetime
from ..sources.versions import kept
from .occurrences import occurrences

KEY = ["university", "college", "college_type", "slot"]
REPLACED = ("status", "title", "source")
FILLED = ("deadline", "event_time", "event_format", "publish_date")


def first_per_key(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert_notices(stored: DataFrame, arrived: DataFrame, at: Column) -> DataFrame:
    """Arrivals by url: values that are there replace the old ones, a summary only if it is longer; unknown urls are inserted.

    Of several arrivals with one url the first (by ``ord``) counts. ``updated_at`` changes only with another value.
    event_type, university and college of a stored row never change.
    """
    new = first_per_key(arrived, ["url"], ["ord"]).select("url", *[F.col(c).alias(f"n_{c}") for c in arrived.columns if c != "url"])
    both = stored.join(new, "url", "full")
    is_new, met = F.col("id").isNull(), F.col("n_id").isNotNull()
    changed = F.lit(False)
    out = {}
    for c in REPLACED:
        take = met & ~is_new & (F.coalesce(F.col(f"n_{c}"), F.lit("")) != "") & ~F.col(c).eqNullSafe(F.col(f"n_{c}"))
        out[c], changed = F.when(is_new | take, F.col(f"n_{c}")).otherwise(F.col(c)), changed | take
    for c in FILLED:
        take = met & ~is_new & F.col(f"n_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"n_{c}"))
        out[c], changed = F.when(is_new | take, F.col(f"n_{c}")).otherwise(F.col(c)), changed | take
    longer = met & ~is_new & (F.length(C.text("n_summary")) > F.length(C.text("summary")))
    out["summary"], changed = F.when(is_new | longer, F.col("n_summary")).otherwise(F.col("summary")), changed | longer
    for c in ("id", "university", "college", "college_type", "event_type"):
        out[c] = F.coalesce(F.col(c), F.col(f"n_{c}"))
    out["change"] = F.when(is_new, "inserted").when(changed, "updated").otherwise("kept")
    out["updated_at"] = F.when(is_new | changed, at).otherwise(F.col("updated_at"))
    return both.select("url", *[v.alias(k) for k, v in out.items()])


def contained_starts(titles: DataFrame, key: list[str], width: int, gram: int = 8) -> DataFrame:
    """ord, start: which starts of a college's titles stand anywhere in which of its titles."""
    starts = titles.select(*key, F.left("title", F.lit(width)).alias("needle"))
    return occurrences(starts, titles.select("ord", *key, F.col("title").alias("text")), "ord", key, gram).withColumnRenamed("needle", "start")


def collapse_prefixes(arrived: DataFrame, width: int = 24, key: tuple[str, ...] = ("university", "college")) -> DataFrame:
    """In-batch fold: a row goes if its title's start stands in an earlier title that stays, or that one's start in it.

    Of equal titles of a college the first row (by ``ord``) stays. The rest of the rule depends on the order of rows and is
    not transitive, so it is settled in rounds: a row stays once no earlier row that is still open or stays is in conflict
    with it, and goes once one that stays is. Conflicts are kept as pairs of a title and a start that stands in it, never
    as pairs of titles, and each round takes minima per start and per title; the first open row is settled in each round.
    Null and empty titles all stay.
    """
    key = list(key)
    titled = arrived.select("ord", *key, "title").where("title <> ''")
    distinct = kept(titled.groupBy(*key, "title").agg(F.min("ord").alias("ord")), "fold-titles")
    whole = arrived.where("coalesce(title, '') = ''").select("ord", *key, "title")
    held = kept(contained_starts(distinct, key, width), "fold-conflicts")
    own = distinct.select("ord", *key, F.left("title", F.lit(width)).alias("start"))
    state = distinct.select("ord", F.lit(None).cast("boolean").alias("stays"))
    while True:
        least = lambda name: [F.min(F.when(ok, F.col("ord"))).alias(f"{name}_{k}") for k, ok in (("open", F.coalesce("stays", F.lit(True))), ("stays", F.col("stays")))]
        now = state.where("coalesce(stays, true)")
        by_start = own.join(now, "ord").groupBy(*key, "start").agg(*least("owner"))
        by_title = held.join(now, "ord").groupBy(*key, "start").agg(*least("holder"))
        owners = held.join(by_start, [*key, "start"]).groupBy("ord").agg(F.min("owner_open").alias("owner_open"), F.min("owner_stays").alias("owner_stays"))
        holders = own.join(by_title, [*key, "start"]).select("ord", "holder_open", "holder_stays")
        rows = state.where("stays is null").join(owners, "ord", "left").join(holders, "ord", "left")
        before = lambda k: (F.coalesce(f"owner_{k}", "ord") < F.col("ord")) | (F.coalesce(f"holder_{k}", "ord") < F.col("ord"))
        settled = rows.select("ord", F.when(before("stays"), False).when(~before("open"), True).alias("stays"))
        state = kept(state.where("stays is not null").unionByName(settled), "fold-state")
        if state.where("stays is null").isEmpty():
            return distinct.join(state.where("stays"), "ord", "left_semi").select("ord", *key, "title").unionByName(whole)


def messaging_targets(targets: DataFrame, official: DataFrame, messages: DataFrame, waiting: DataFrame | None, searched: DataFrame) -> DataFrame:
    """Targets worth a search for messages: four conditions in turn, each a join on (university, college).

    Those with an official notice go, then those with a message, those that do not wait (if only waiting ones are
    wanted and any wait at all), and those that were searched today.
    """
    key = ["university", "college"]
    left = targets.join(official.select(*key).distinct(), key, "left_anti").join(messages.select(*key).distinct(), key, "left_anti")
    if waiting is not None and not waiting.isEmpty():
        left = left.join(waiting.select(*key).distinct(), key, "left_semi")
    return left.join(searched.select(*key).distinct(), key, "left_anti")


def coverage_upsert(parts: DataFrame) -> DataFrame:
    """One row per key: the newest time, and the last known announcement id, which some rows do not have. Idempotent."""
    known = F.max_by("announcement_id", F.when(F.col("announcement_id").isNotNull(), F.struct("touched_at", "announcement_id")))
    return parts.groupBy(*KEY).agg(known.alias("announcement_id"), F.max("touched_at").alias("updated_at"))


def coverage_sync(listed: DataFrame, pending: DataFrame) -> DataFrame:
    """Three rules: notices fill their slot, pending keys are renewed, and a notice slot renews its result slot."""
    own = listed.select(*KEY, F.col("id").alias("announcement_id"), F.col("updated_at").alias("touched_at"))
    none = F.lit(None).cast("long").alias("announcement_id")
    waiting = pending.select(*KEY, none, "touched_at")
    later = own.where(F.col("slot").endswith("_notice")).select("university", "college", "college_type", F.regexp_replace("slot", "_notice$", "_result").alias("slot"), none, "touched_at")
    return coverage_upsert(own.unionByName(waiting).unionByName(later))


def pending_upsert(stored: DataFrame, failed: DataFrame) -> DataFrame:
    """Search counts grow by one per failed search; the kind is that of the newest one."""
    all_rows = stored.select("university", "college", "college_type", "search_count", "pending_kind", F.lit(0).alias("turn")).unionByName(
        failed.select("university", "college", "college_type", F.lit(1).cast("long").alias("search_count"), F.when(C.text("base_url") == "", "domain_failure").otherwise("not_published").alias("pending_kind"), F.lit(1).alias("turn"))
    )
    return all_rows.groupBy("university", "college", "college_type").agg(F.sum("search_count").alias("search_count"), F.max_by("pending_kind", F.struct("turn", "pending_kind")).alias("pending_kind"))


def snapshot_score() -> Column:
    return sum((ok.cast("int") for ok in C.filled()), F.lit(0)) + F.when(C.is_manual(), 5).otherwise(0)


def snapshot(rows: DataFrame) -> DataFrame:
    """The best row of each college: filled fields, manual rows first, the smallest id on ties."""
    return first_per_key(rows.withColumn("score", snapshot_score()), ["university", "college", "college_type"], [F.desc("score"), "id"])


def guarded(old: Column, new: Column, manual: Column) -> Column:
    """Manual rows keep a value that is not in the new row, and an explicit time where the new one is only the end of a day."""
    return F.when(manual & (new.isNull() | (new.contains("23:59:59") & ~F.coalesce(old, F.lit("")).contains("23:59:59"))), old).otherwise(new)


def enriched(rows: DataFrame) -> DataFrame:
    """Fill nulls from what a model found (m_ columns), and take the more precise dates."""
    return rows.withColumns({"deadline": merged_datetime(F.col("deadline"), F.col("m_deadline")), "event_time": F.coalesce("event_time", "m_event_time"), "event_format": F.coalesce("event_format", "m_event_format")})


def attribute(texts: DataFrame, dimension: DataFrame, text_col: str, id_col: str, threshold: int = 9) -> DataFrame:
    """Best target for each text: university in it (+5), college in it (+8) or its first two characters (+3), topic (+4 or -6).

    The first target (by ord) wins ties. A text is compared with the distinct universities first, then with the targets of
    those it names; the planner broadcasts the directory while it is small.
    """
    t = F.col(text_col)
    universities = dimension.select("university").distinct()
    named = texts.select(id_col, text_col).join(universities, t.contains(F.col("university"))).join(dimension, "university")
    law, language = t.contains("BUILDING") | t.contains("FURNITURE"), t.contains("MACHINERY") | t.contains("AUTOMOBILE") | t.contains("HOUSEHOLD")
    is_law = F.col("college_type") == "law"
    score = (
        F.lit(5) + F.when(t.contains(F.col("college")), 8).when((F.length("college") >= 4) & t.contains(F.substring("college", 1, 2)), 3).otherwise(0)
        + F.when(law & is_law, 4).otherwise(0) + F.when(language & ~is_law, 4).otherwise(0) + F.when(law & ~is_law, -6).otherwise(0) + F.when(language & is_law, -6).otherwise(0)
    )
    scored = named.withColumn("score", score).where(F.col("score") >= threshold)
    best = F.max_by(F.struct("university", "college"), F.struct("score", -F.col("ord"))).alias("best")
    return scored.groupBy(id_col).agg(best, F.max("score").alias("score")).select(id_col, "best.university", "best.college", "score")


def attribute_feed(texts: DataFrame, targets: DataFrame, text_col: str, id_col: str, threshold: int = 7) -> DataFrame:
    """Best target for each text; the university may be missing: university (+5), college or its first two characters (+4), topic (+2).

    From a threshold of 7 on the university must be named, so that texts meet the targets of the universities in them only;
    below it every text is compared with every target.
    """
    t = F.col(text_col)
    law, language = t.contains("BUILDING") | t.contains("FURNITURE"), t.contains("MACHINERY") | t.contains("AUTOMOBILE") | t.contains("HOUSEHOLD")
    own = ((F.col("college_type") == "law") & law) | ((F.col("college_type") == "foreign_lang") & language)
    college = t.contains(F.col("college")) | t.contains(F.substring("college", 1, 2))
    score = F.when(t.contains(F.col("university")), 5).otherwise(0) + F.when(college, 4).otherwise(0) + F.when(own, 2).otherwise(0)
    asked = texts.select(id_col, text_col)
    if threshold >= 7:
        named = occurrences(targets.select(F.col("university").alias("needle")), asked.select(id_col, t.alias("text")), id_col)
        pairs = asked.join(named, id_col).join(targets, F.col("needle") == F.col("university")).where(score >= threshold)
    else:
        pairs = asked.join(targets, score >= threshold)
    scored = pairs.withColumn("score", score)
    best = F.max_by(F.struct("university", "college"), F.struct("score", -F.col("ord"))).alias("best")
    return scored.groupBy(id_col).agg(best, F.max("score").alias("score")).select(id_col, "best.university", "best.college", "score")


def attribute_by_domain(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """id, university, college: of the first target whose domain the url contains, else of the first one whose university the title contains.

    ``targets`` has domain (empty if unknown) and ord, which breaks ties; both are empty where nothing fits.
    """
    first = lambda keys, name: targets.groupBy(*keys).agg(F.min_by(F.struct("university", "college"), "ord").alias(name), F.min("ord").alias(f"{name}_ord"))
    domains = first([F.col("domain").alias("needle")], "by_domain").where("needle <> ''")
    named = first([F.col("university").alias("needle")], "by_title").where("needle <> ''")

    def best(texts: DataFrame, needles: DataFrame, name: str) -> DataFrame:
        return occurrences(needles, texts, "id").join(needles, "needle").groupBy("id").agg(F.min_by(name, f"{name}_ord").alias(name))

    met = rows.select("id", "title").join(best(rows.select("id", F.col("url").alias("text")), domains, "by_domain"), "id", "left")
    rest = best(met.where("by_domain is null").select("id", F.col("title").alias("text")), named, "by_title")
    chosen = F.coalesce("by_domain", "by_title")
    return met.join(rest, "id", "left").select("id", F.coalesce(chosen["university"], F.lit("")).alias("university"), F.coalesce(chosen["college"], F.lit("")).alias("college"))


def match_existing(stored: DataFrame, arrived: DataFrame, width: int = 24) -> DataFrame:
    """ord, id, leg: the stored row that an arrival is, by url, else by original url, else by its college and the start of its title.

    Either title may contain the other's first ``width`` characters; the smallest id wins. Distinct titles of a college
    meet by rare substrings of those starts, not as pairs. Arrivals without any match are absent.
    """
    by_url = arrived.join(stored.select("url", F.col("id").alias("m1")), "url").groupBy("ord").agg(F.min("m1").alias("m1"))
    moved = arrived.where("original_url <> url").join(stored.select(F.col("url").alias("original_url"), F.col("id").alias("m2")), "original_url").groupBy("ord").agg(F.min("m2").alias("m2"))
    found = arrived.join(by_url, "ord", "left").join(moved, "ord", "left")
    key = ["university", "college"]
    titles = stored.where("title <> ''").groupBy(*key, F.col("title").alias("s_title")).agg(F.min("id").alias("s_id"))
    asked = found.where("m1 is null and m2 is null and title <> ''").select("ord", *key, "title")
    new = asked.select(*key, "title", F.left("title", F.lit(width)).alias("needle")).distinct()
    of_asked = titles.join(asked.select(*key).distinct(), key, "left_semi")
    starts = of_asked.groupBy(*key, F.left("s_title", F.lit(width)).alias("needle")).agg(F.min("s_id").alias("s_id"))
    in_stored = occurrences(new, of_asked.select(*key, "s_id", F.col("s_title").alias("text")), "s_id", key).groupBy(*key, "needle").agg(F.min("s_id").alias("a"))
    in_asked = occurrences(starts, new.select(*key, "title", F.col("title").alias("text")), "title", key).join(starts, [*key, "needle"]).groupBy(*key, "title").agg(F.min("s_id").alias("b"))
    by_title = new.join(in_stored, [*key, "needle"], "left").join(in_asked, [*key, "title"], "left").select(*key, "title", F.least("a", "b").alias("m3")).where("m3 is not null")
    out = found.join(asked.join(by_title, [*key, "title"]).select("ord", "m3"), "ord", "left")
    leg = F.when(F.col("m1").isNotNull(), "url").when(F.col("m2").isNotNull(), "original_url").when(F.col("m3").isNotNull(), "title")
    return out.select("ord", F.coalesce("m1", "m2", "m3").alias("id"), leg.alias("leg")).where("id is not null")


def upsert_matched(stored: DataFrame, arrived: DataFrame, at: Column) -> DataFrame:
    """id, url, title, deadline, summary, updated_at, change of all rows after arrivals were found by ``match_existing``.

    Of several arrivals that are one stored row the first (by ``ord``) counts. The row takes the arrival's url; another
    stored row that has this url goes. Titles and deadlines that are there replace the old ones, a summary only if it is
    longer. Arrivals that are no stored row are inserted, one for each url, with their ``ord`` as id.
    """
    columns = ["url", "title", "deadline", "summary"]
    met = match_existing(stored, arrived)
    new = first_per_key(arrived.join(met, "ord"), ["id"], ["ord"]).select("id", *[F.col(c).alias(f"n_{c}") for c in columns])
    taken = new.select(F.col("n_url").alias("url"), F.col("id").alias("owner"))
    gone = stored.join(taken, "url").where("id <> owner").select("id").distinct()
    rows = stored.join(gone, "id", "left_anti").join(new, "id", "left")
    longer = F.length(C.text("n_summary")) > F.length(C.text("summary"))
    take = {c: (C.text(f"n_{c}") != "") & ~F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in ("url", "title", "deadline")} | {"summary": longer}
    changed = take["url"] | take["title"] | take["deadline"] | take["summary"]
    kept = rows.select("id", *[F.when(t, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c, t in take.items()], F.when(changed, at).otherwise(F.col("updated_at")).alias("updated_at"), F.when(changed, "updated").otherwise("kept").alias("change"))
    fresh = first_per_key(arrived.join(met, "ord", "left_anti"), ["url"], ["ord"])
    return kept.unionByName(fresh.select(F.col("ord").alias("id"), *columns, at.alias("updated_at"), F.lit("inserted").alias("change")))

"""Change detection, alerts, delivery queues, upserts and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statutory.functions.text import list_key, mapped
from statutory.operators.listing import matches_criteria

TRACKED = ("title", "status", "status_date", "subject")
# The event that each change type raises, and the delays between attempts in seconds.
EVENT_TYPES = {
    "created": "bill.created", "status_changed": "bill.status_changed", "updated": "bill.updated",
    "text_added": "bill.text_added", "action_added": "bill.action_added",
}
RETRY_DELAYS = (60, 300, 900, 3600, 7200, 14400, 28800, 57600)
MAX_ATTEMPTS = len(RETRY_DELAYS) + 1
BREAKER_FAILURES = 5
#: Searches without jurisdiction and status are broadcast up to this number (about 200 bytes each).
LOOSE_SEARCHES = 10_000


def compared(rows: DataFrame, fields: tuple[str, ...] = TRACKED) -> DataFrame:
    """id and the tracked fields as text; lists sorted, fields that are missing null."""
    def text(name: str) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast("string")
        if rows.schema[name].dataType.typeName() == "array":
            return list_key(name)
        return F.col(name).cast("string")

    return rows.select("id", *[text(f).alias(f) for f in fields])


def detect_changes(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = TRACKED) -> DataFrame:
    """One created event per new row, else one event per field that differs; nulls compare as values."""
    before = compared(old, fields).select(F.col("id").alias("id"), F.lit(True).alias("_known"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = compared(new, fields).join(before, "id", "left")
    events = [F.when(F.col("_known").isNull(), F.struct(F.lit("created").alias("change_type"), *[F.lit(None).cast("string").alias(c) for c in ("field_name", "old_value", "new_value")]))]
    for f in fields:
        kind = "status_changed" if f == "status" else "updated"
        differs = F.col("_known").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}"))
        events.append(F.when(differs, F.struct(F.lit(kind).alias("change_type"), F.lit(f).alias("field_name"), F.col(f"_{f}").alias("old_value"), F.col(f).alias("new_value"))))
    return joined.select(F.col("id").alias("bill_id"), F.explode(F.array_compact(F.array(*events))).alias("e")).select("bill_id", "e.*")


def _by_grams(searches: DataFrame, bills: DataFrame) -> DataFrame:
    """Searches (s) for a word with the bills (b) whose title holds it, by an equi join on parts of both.

    A search asks with the three letters of its word that fewest titles hold, or with the
    first letter of a shorter word; titles are listed by all their letters and threes.
    """
    letters = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, 1))
    threes = lambda c: F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3))).otherwise(F.array().cast("array<string>"))
    title, word = F.lower("b.title"), F.lower("s.query")
    held = bills.where(F.length(title) > 0).select("b", F.explode(F.array_distinct(F.concat(letters(title), threes(title)))).alias("part"))
    holders = held.groupBy("part").agg(F.count("*").alias("n"))
    asked = searches.select("s", F.explode(F.when(F.length(word) >= 3, F.array_distinct(threes(word))).otherwise(F.array(F.substring(word, 1, 1)))).alias("part"))
    rarest = asked.join(holders, "part").groupBy("s.id").agg(F.min_by(F.struct("s", "part"), F.struct("n", "part")).alias("r"))
    return rarest.select("r.s", "r.part").join(held, "part").where(matches_criteria()).select("s", "b")


def matching_bills(searches: DataFrame, bills: DataFrame, loose_searches: int = LOOSE_SEARCHES) -> DataFrame:
    """Searches with the bills that meet them.

    Searches with a jurisdiction meet the bills by an equi join on it, those with a status
    only by one on that. Searches for a word in all bills are broadcast up to loose_searches,
    and beyond it meet the bills by parts of the word. Searches without any condition hold
    for every bill.
    """
    b = bills.select(F.struct("id", "jurisdiction_id", "status", "title", "identifier").alias("b"))
    s = searches.select(F.struct("id", "org_id", "jurisdiction_id", "status", "query", "event_types", "alerts_enabled").alias("s"))
    keyed = s.where("s.jurisdiction_id is not null").join(b, (F.col("s.jurisdiction_id") == F.col("b.jurisdiction_id")) & matches_criteria())
    by_status = s.where("s.jurisdiction_id is null and s.status is not null").join(b, (F.col("s.status") == F.col("b.status")) & matches_criteria())
    rest = s.where("s.jurisdiction_id is null and s.status is null")
    if rest.limit(loose_searches + 1).count() <= loose_searches:
        loose = b.join(F.broadcast(rest), matches_criteria()).select("s", "b")
    else:
        every = b.join(rest.where("coalesce(s.query, '') = ''"), matches_criteria()).select("s", "b")
        loose = every.unionByName(_by_grams(rest.where("s.query <> ''"), b))
    columns = [F.col("s.id").alias("search_id"), F.col("s.event_types").alias("event_types"), F.col("s.alerts_enabled").alias("alerts_enabled"), F.col("b.id").alias("bill_id"), F.col("b.title").alias("title"), F.col("b.identifier").alias("identifier"), F.col("b.jurisdiction_id").alias("jurisdiction_id")]
    return keyed.select(*columns).unionByName(by_status.select(*columns)).unionByName(loose.select(*columns))


def alert_matches(changes: DataFrame, searches: DataFrame, bills: DataFrame) -> DataFrame:
    """Changes of bills that meet a search with alerts on and a subscription to the event.

    Changes are reduced to the bills they touch before the searches are matched.
    """
    kind = F.coalesce(mapped(F.col("change_type"), EVENT_TYPES), F.lit("bill.updated"))
    typed = changes.withColumn("event_type", kind)
    touched = bills.join(typed.select(F.col("bill_id").alias("id")).distinct(), "id", "left_semi")
    met = matching_bills(searches.where("alerts_enabled"), touched)
    return typed.join(met, "bill_id").where(F.array_contains("event_types", F.col("event_type")))


def payload() -> Column:
    return F.to_json(F.struct(
        "event_type", "bill_id", "identifier", "jurisdiction_id", "title", F.struct("change_type").alias("change_summary"),
        F.concat(F.lit("/api/v1/bills/"), F.col("bill_id")).alias("detail_url"),
    ))


def due_deliveries(deliveries: DataFrame, now: str, n: int = 50, key: str = "id") -> DataFrame:
    """Queued and failed deliveries that are due, oldest first."""
    open_ = deliveries.where(F.col("status").isin("queued", "failed") & (F.col("attempted_at") <= F.lit(now).cast("timestamp_ntz")))
    return open_.orderBy("attempted_at", F.col(key).cast("long")).limit(n)


def retry_schedule(deliveries: DataFrame) -> DataFrame:
    """What a failed attempt leads to: the next delay with a jitter of up to a fifth that is the same in every run, or dead letter."""
    count = F.col("attempt_count") + 1
    delay = F.element_at(F.array(*map(F.lit, RETRY_DELAYS)), F.least(count, F.lit(len(RETRY_DELAYS))))
    digest = F.conv(F.substring(F.sha2(F.concat_ws(":", "id", count.cast("string")), 256), 1, 8), 16, 10).cast("long")
    span = F.floor(delay * 4 / 10)
    jitter = F.pmod(digest, span) - F.floor(delay * 2 / 10)
    dead = count >= MAX_ATTEMPTS
    return deliveries.select("id", count.alias("attempt_count"), F.when(dead, "dead_letter").otherwise("failed").alias("status"), F.when(~dead, (delay + jitter).cast("long")).alias("delay_s"))


def run_summaries(deliveries: DataFrame, parts: int | None = None) -> DataFrame:
    """Per endpoint and range of its attempts, in order: what is needed to join the ranges' runs of failures.

    at (the place of the range), first and last (failures before the first and after the
    last success), longest (run inside) and whole (no success at all). Ranges are cut by
    endpoint, time and id, so an endpoint of very many attempts is many tasks.
    """
    ended = deliveries.where(F.col("status") != "queued").select("endpoint_id", "attempted_at", F.col("id").cast("long").alias("n"), (F.col("status") != "delivered").alias("failed"))
    keys = ["endpoint_id", "attempted_at", "n"]
    dealt = ended.repartitionByRange(*([parts] if parts else []), *keys).withColumn("at", F.spark_partition_id())
    order = Window.partitionBy("endpoint_id", "at").orderBy("attempted_at", "n")
    runs = dealt.withColumn("run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy("endpoint_id", "at", "run").agg(F.count(F.when(F.col("failed"), 1)).alias("size"))
    return sizes.groupBy("endpoint_id", "at").agg(
        F.coalesce(F.max(F.when(F.col("run") == 0, F.col("size"))), F.lit(0)).alias("first"), F.max_by("size", "run").alias("last"), F.max("size").alias("longest"), (F.max("run") == 0).alias("whole")
    )


def circuit_breaker(deliveries: DataFrame, threshold: int = BREAKER_FAILURES, parts: int | None = None) -> DataFrame:
    """Per endpoint: the longest run of failed attempts, the current one, and whether it is disabled.

    A run is counted from the last success; attempts are in the order of time and id. Ranges
    of attempts are summed up apart, and an endpoint's summaries, as few as the ranges, are
    joined in order.
    """
    listed = run_summaries(deliveries, parts).groupBy("endpoint_id").agg(F.array_sort(F.collect_list(F.struct("at", "first", "last", "longest", "whole"))).alias("ranges"))

    def joined(state: Column, part: Column) -> Column:
        reaching = state["current"] + part["first"]
        return F.struct(
            F.greatest(state["longest"], part["longest"], reaching).alias("longest"),
            F.when(part["whole"], reaching).otherwise(part["last"]).alias("current"),
        )

    start = F.struct(F.lit(0).cast("long").alias("longest"), F.lit(0).cast("long").alias("current"))
    out = listed.select("endpoint_id", F.aggregate("ranges", start, joined).alias("r")).select("endpoint_id", "r.longest", "r.current")
    return out.withColumn("disabled", F.col("longest") >= threshold)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], keep_old_values: bool = False) -> DataFrame:
    """The new snapshot: rows of old, with the listed columns of new where keys meet, and the rows only new has.

    With keep_old_values a null in new does not overwrite. Keys of new are made unique first,
    a null key is a key of its own.
    """
    fresh = new.dropDuplicates(keys).withColumn("_new", F.lit(True))
    fresh = fresh.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns], "_new")
    before = old.withColumn("_old", F.lit(True))
    met = before.join(fresh, [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys], "full")

    def column(name: str) -> Column:
        theirs, ours = F.col(f"_n_{name}"), F.col(name)
        if name not in update:
            return F.when(F.col("_old"), ours).otherwise(theirs)
        changed = F.coalesce(theirs, ours) if keep_old_values else theirs
        return F.when(F.col("_old") & F.col("_new").isNull(), ours).otherwise(changed)

    return met.select(*[column(c).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks, one per key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work that no cached result covers."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")

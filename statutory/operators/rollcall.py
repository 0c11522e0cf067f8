"""Roll-call analytics: point-in-time parties, exact reconciliation, windows and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statutory.operators.aggregates import option_counts
from statutory.operators.quality import complete_events, reconcile
from statutory.operators.sinks import shared_folder
from statutory.operators.windows import hash_order, top_per_group


#: Spans are broadcast up to this number (some 60 bytes each), and joined by person and year beyond it.
BROADCAST_SPANS = 200_000


def in_span(day: str = "vote_date") -> Column:
    """A day lies in a span from start_date up to, but not on, end_date (null: open)."""
    return (F.col("start_date") <= F.col(day)) & (F.col("end_date").isNull() | (F.col(day) < F.col("end_date")))


def party_asof(votes: DataFrame, spans: DataFrame, how: str = "inner", broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """Votes (person_id, vote_date) with the party of the span that covers the day.

    Up to broadcast_spans spans go to the votes. More are dealt to the years they cover and
    meet the votes by an equi join on person and year, the exact range as its residual; so a
    person of many spans is compared with those of the year only.
    """
    right = spans.select(F.col("person_id").alias("_person"), "party", "start_date", "end_date")
    if spans.count() <= broadcast_spans:
        return votes.join(F.broadcast(right), (F.col("person_id") == F.col("_person")) & in_span(), how).drop("_person", "start_date", "end_date")
    dated = votes.withColumn("_year", F.year("vote_date"))
    most = votes.agg(F.year(F.max("vote_date")).alias("_most"), F.year(F.min("vote_date")).alias("_least"))  # open spans end with the last vote
    last = F.least(F.coalesce(F.year("end_date"), F.col("_most")), F.col("_most"))
    first = F.greatest(F.year("start_date"), F.col("_least"))
    dealt = right.crossJoin(F.broadcast(most)).where(first <= last).withColumn("_span_year", F.explode(F.sequence(first, last))).drop("_most", "_least")
    met = (F.col("person_id") == F.col("_person")) & (F.col("_year") == F.col("_span_year")) & in_span()
    return dated.join(dealt, met, how).drop("_person", "_year", "_span_year", "start_date", "end_date")


def dated_votes(records: DataFrame, events: DataFrame) -> DataFrame:
    return records.join(events.select(F.col("id").alias("vote_event_id"), "vote_date", "chamber", "bill_id"), "vote_event_id")


def with_congress(events: DataFrame, bills: DataFrame) -> DataFrame:
    """Events with the congress (session) of their bill."""
    return events.join(bills.select(F.col("id").alias("bill_id"), F.regexp_extract("session_id", r"-(\d+)$", 1).cast("int").alias("congress"), "session_id"), "bill_id")


def party_eligible(records: DataFrame, events: DataFrame, spans: DataFrame) -> DataFrame:
    """Complete events in which every voter has exactly one covering span."""
    whole = complete_events(events, records)
    votes = dated_votes(records, whole).select("vote_event_id", "person_id", "vote_date")
    spanned = party_asof(votes, spans, "left").groupBy("vote_event_id", "person_id").agg(F.count("party").alias("n"))
    bad = spanned.where("n <> 1").select(F.col("vote_event_id").alias("id")).distinct()
    return whole.join(bad, "id", "left_anti")


def party_breakdown(records: DataFrame, events: DataFrame, spans: DataFrame) -> DataFrame:
    """Votes by party on eligible events; parties with at least two voters."""
    eligible = party_eligible(records, events, spans)
    counts = option_counts(party_asof(dated_votes(records, eligible), spans), ["vote_event_id", "party"])
    return counts.where("total >= 2")


def party_majority(breakdown: DataFrame) -> DataFrame:
    """The side of a strict majority of yea and nay votes; a tie has none."""
    return breakdown.withColumn("side", F.when(F.col("yea") > F.col("nay"), "yea").when(F.col("nay") > F.col("yea"), "nay"))


def crossed_party(records: DataFrame, events: DataFrame, spans: DataFrame) -> DataFrame:
    """Members on the minority side of their party, as a sorted list by event and party."""
    sides = party_majority(party_breakdown(records, events, spans)).where("side is not null").select("vote_event_id", "party", "side")
    votes = party_asof(dated_votes(records, events), spans).where("option in ('yea', 'nay')")
    crossed = votes.join(sides, ["vote_event_id", "party"]).groupBy("vote_event_id", "party").agg(
        F.array_sort(F.collect_set(F.when(F.col("option") != F.col("side"), F.col("person_id")))).alias("members")
    )
    return crossed


def ended_sessions(sessions: DataFrame, today: str) -> DataFrame:
    return sessions.where(F.col("end_date") < F.lit(today).cast("date")).select(F.col("id").alias("session_id"))


def closest_by_margin(events: DataFrame, bills: DataFrame, sessions: DataFrame, today: str, k: int = 5) -> DataFrame:
    """The k events with the smallest margin of each ended congress and chamber; ties by id."""
    known = with_congress(events.where("yes_count is not null and no_count is not null"), bills).join(F.broadcast(ended_sessions(sessions, today)), "session_id", "left_semi")
    margin = known.withColumn("margin", F.abs(F.col("yes_count") - F.col("no_count")))
    return top_per_group(margin, ["congress", "chamber"], ["margin", "id"], k, rank="rank").select("congress", "chamber", "id", "margin", "rank")


def complete_windows(events: DataFrame, records: DataFrame, bills: DataFrame) -> DataFrame:
    """Congress and chamber windows in which every event is complete."""
    verdicts = with_congress(reconcile(events, records), bills)
    return verdicts.groupBy("congress", "chamber").agg(F.bool_and(F.col("verdict") == "complete").alias("whole"), F.count("*").alias("events")).where("whole").drop("whole")


def window_votes(events: DataFrame, records: DataFrame, bills: DataFrame) -> DataFrame:
    """Votes of complete windows, with congress and chamber."""
    whole = complete_windows(events, records, bills).select("congress", "chamber")
    inside = with_congress(events, bills).join(F.broadcast(whole), ["congress", "chamber"], "left_semi")
    return records.join(inside.select(F.col("id").alias("vote_event_id"), "congress", "chamber"), "vote_event_id")


def member_summary(votes: DataFrame) -> DataFrame:
    return option_counts(votes, ["congress", "chamber", "person_id"]).drop("total")


def event_places(votes: DataFrame, keys: list[str], buckets: int = 64) -> DataFrame:
    """A place for every event of the votes: keys, bucket and block name 64 events at most, bit is the place among them.

    Events are numbered inside buckets of their keys, so no task numbers all events of one key.
    """
    events = votes.select(*keys, "vote_event_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("vote_event_id"), F.lit(buckets)).cast("int"))
    place = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("vote_event_id")) - 1
    return events.withColumn("block", F.floor(place / F.lit(64)).cast("int")).withColumn("bit", F.pmod(place, F.lit(64)))


def vote_bits(votes: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """Per member and block of events, the events of its yea and of its nay votes as the bits of two longs."""
    bit = F.expr("shiftleft(1L, bit)")
    placed = votes.where("option in ('yea', 'nay')").join(places, [*keys, "vote_event_id"])
    either = {side: F.bit_or(F.when(F.col("option") == side, bit).otherwise(F.lit(0).cast("long"))).alias(side) for side in ("yea", "nay")}
    return placed.groupBy(*keys, "bucket", "block", "person_id").agg(*either.values())


def _bits_of(bits: DataFrame, end: str, keep: list[str]) -> DataFrame:
    return bits.select(*keep, F.col("person_id").alias(end), F.col("yea").alias(f"yea_{end}"), F.col("nay").alias(f"nay_{end}"))


def _pairs(rows: DataFrame, group: list[str]) -> float:
    """How many pairs the members of all groups make."""
    n = F.count("*").cast("double")
    return rows.groupBy(*group).agg((n * (n - 1) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0.0


def dense(votes: DataFrame, bits: DataFrame, block: list[str]) -> bool:
    """Whether members make fewer pairs per block of events than per event.

    They do where most of them vote each time, up to 64 times fewer; where few do, the
    members of a block make many pairs that never met.
    """
    return _pairs(bits, block) <= _pairs(votes.where("option in ('yea', 'nay')"), ["vote_event_id"])


def pairwise_agreement(votes: DataFrame, keys: list[str], bitmaps: bool | None = None) -> DataFrame:
    """Per pair of members a < b: events where both said yea or nay, and where they agree.

    votes has one row for each event and person. With bitmaps members meet per block of 64
    events, and two ANDs count what they share, so a pair is a row per block and not per
    event; without, they meet per event. By default what makes fewer pairs is counted first.
    The votes that count are written to the shared folder once, as they are read three times.
    """
    folder = shared_folder(votes.sparkSession)
    votes.where("option in ('yea', 'nay')").select(*keys, "vote_event_id", "person_id", "option").write.parquet(folder)
    votes = votes.sparkSession.read.parquet(folder)
    bits = vote_bits(votes, event_places(votes, keys), keys)
    block = [*keys, "bucket", "block"]
    if dense(votes, bits, block) if bitmaps is None else bitmaps:
        pairs = _bits_of(bits, "a", block).join(_bits_of(bits, "b", block), block).where("a < b")
        met = pairs.select(*keys, "a", "b", F.expr("bit_count((yea_a | nay_a) & (yea_b | nay_b))").alias("met"), F.expr("bit_count(yea_a & yea_b) + bit_count(nay_a & nay_b)").alias("agreed"))
        return met.where("met > 0").groupBy(*keys, "a", "b").agg(F.sum("met").alias("shared"), F.sum("agreed").alias("agreements"))
    said = F.sort_array(F.collect_list(F.struct("person_id", "option")))
    events = votes.where("option in ('yea', 'nay')").groupBy(*keys, "vote_event_id").agg(said.alias("said"))
    each = events.select(*keys, "said", F.posexplode("said").alias("place", "one"))
    after = F.slice("said", F.col("place") + 2, F.size("said"))
    others = lambda same: F.transform(F.filter(after, lambda x: (x["person_id"] > F.col("one.person_id")) & ((x["option"] == F.col("one.option")) == same)), lambda x: x["person_id"])
    # a member is sent once for each event, with the others as two lists; its pairs are counted where it is
    met = each.select(*keys, F.col("one.person_id").alias("a"), others(True).alias("alike"), others(False).alias("apart")).where("size(alike) + size(apart) > 0").repartition(*keys, "a")
    single = met.select(*keys, "a", F.size("alike").alias("n"), F.posexplode(F.concat("alike", "apart")).alias("place", "b"))
    return single.groupBy(*keys, "a", "b").agg(F.count("*").alias("shared"), F.count(F.when(F.col("place") < F.col("n"), 1)).alias("agreements"))


def same_party_pairs(members: DataFrame, least: int) -> DataFrame:
    """Pairs a < b of one chamber and party with at least so many votes each."""
    active = members.where(F.col("nvotes") >= least)
    a = active.select("chamber", "party", F.col("person_id").alias("a"))
    b = active.select("chamber", "party", F.col("person_id").alias("b"))
    return a.join(b, ["chamber", "party"]).where("a < b")


def disagreements(votes: DataFrame, pairs: DataFrame, bitmaps: bool | None = None) -> DataFrame:
    """Events on which the two of a pair voted yea and nay, as a sorted list; an empty one is kept.

    Only votes of the pairs' members are read. With bitmaps a pair meets its members' bits
    block by block, and only bits that differ become events again; without, members meet per
    event. By default what makes fewer pairs is used.
    """
    asked = pairs.select("a", "b").distinct()
    members = asked.select(F.col("a").alias("person_id")).union(asked.select(F.col("b").alias("person_id"))).distinct()
    held = votes.join(members, "person_id", "left_semi")
    places = event_places(held, [])
    bits = vote_bits(held, places, [])
    block = ["bucket", "block"]
    if dense(held, bits, block) if bitmaps is None else bitmaps:
        met = asked.join(_bits_of(bits, "a", block), "a").join(_bits_of(bits, "b", block), ["b", *block])
        apart = met.select("a", "b", *block, F.expr("(yea_a & nay_b) | (nay_a & yea_b)").alias("apart")).where("apart <> 0")
        single = apart.select("a", "b", *block, F.explode(F.expr("filter(sequence(0, 63), i -> getbit(apart, i) = 1)")).alias("bit")).join(places, [*block, "bit"])
    else:
        said = held.where("option in ('yea', 'nay')")
        a = said.select("vote_event_id", F.col("person_id").alias("a"), F.col("option").alias("oa"))
        b = said.select("vote_event_id", F.col("person_id").alias("b"), F.col("option").alias("ob"))
        single = a.join(b, "vote_event_id").where("a < b and oa <> ob").join(asked, ["a", "b"], "left_semi")
    lists = single.groupBy("a", "b").agg(F.array_sort(F.collect_set("vote_event_id")).alias("events"))
    return pairs.join(lists, ["a", "b"], "left").withColumn("events", F.coalesce("events", F.array().cast("array<string>")))


def single_rollcall_bills(events: DataFrame) -> DataFrame:
    return events.groupBy("bill_id").agg(F.count("*").alias("n"), F.min("id").alias("vote_event_id")).where("n = 1").drop("n")


def cosponsor_against(sponsorships: DataFrame, records: DataFrame, events: DataFrame) -> DataFrame:
    """For bills with one roll call and a voting cosponsor: the cosponsors who said nay, sorted; an empty list is kept."""
    single = single_rollcall_bills(events)
    cosponsors = sponsorships.where("classification <> 'primary'").select("bill_id", "person_id").distinct()
    votes = single.join(records, "vote_event_id").join(cosponsors, ["bill_id", "person_id"], "left_semi")
    return votes.groupBy("bill_id", "vote_event_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("option") == "nay", F.col("person_id")))).alias("members"), F.count("*").alias("voting_cosponsors")
    )


def no_link(records: DataFrame, events: DataFrame, bills: DataFrame) -> DataFrame:
    """Members of one congress and the next congresses in which they have no vote, while others have."""
    active = records.join(with_congress(events, bills).select(F.col("id").alias("vote_event_id"), "congress"), "vote_event_id").select("person_id", "congress").distinct()
    congresses = active.select("congress").distinct()  # one row per congress
    every = active.select("person_id").distinct().crossJoin(F.broadcast(congresses))
    return every.join(active, ["person_id", "congress"], "left_anti")


def party_at_vote(records: DataFrame, events: DataFrame, spans: DataFrame) -> DataFrame:
    """The party of each vote whose day exactly one party covers."""
    covered = party_asof(dated_votes(records, events), spans)
    found = covered.groupBy("vote_event_id", "person_id").agg(F.count_distinct("party").alias("n"), F.min("party").alias("party"))
    return found.where("n = 1").drop("n")


def party_switchers(records: DataFrame, events: DataFrame, spans: DataFrame) -> DataFrame:
    """Persons and years: how many parties the year's votes span; switcher if the person ever has several."""
    votes = party_asof(dated_votes(records, events), spans)
    ever = spans.groupBy("person_id").agg(F.count_distinct("party").alias("parties"))
    years = votes.groupBy("person_id", F.year("vote_date").alias("year")).agg(F.count_distinct("party").alias("year_parties"))
    out = years.join(ever, "person_id")
    return out.withColumn("label", F.when(F.col("year_parties") > 1, "spanning").when(F.col("parties") > 1, "switcher").otherwise("control"))


def absent_keys(events: DataFrame, n_answerable: int, prefix: str = "x") -> DataFrame:
    """max(3, n/4) made-up ids that no event has, in their order."""
    n = max(3, n_answerable // 4)
    made = events.sparkSession.range(1, 4 * n + 1).select(F.format_string(f"{prefix}%06d", "id").alias("id"))
    return made.join(events.select("id"), "id", "left_anti").orderBy("id").limit(n)


def sample_instances(rows: DataFrame, ids: list[str], seed: int, n: int) -> DataFrame:
    return rows.orderBy(hash_order(seed, *ids), *ids).limit(n)

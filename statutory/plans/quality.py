"""Reconciliation and data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.operators import quality as Q
from statutory.operators import windows as W
from statutory.plans.registry import query
from statutory.plans.views import Tables

_VERDICTS = """
r AS (SELECT vote_event_id, count(*) FILTER (WHERE option = 'yea') AS y, count(*) FILTER (WHERE option = 'nay') AS n, count(*) FILTER (WHERE option IN ('present', 'not_voting')) AS o FROM v_vote_records GROUP BY 1),
verdicts AS (SELECT e.*, CASE WHEN coalesce(y, 0) > yes_count OR coalesce(n, 0) > no_count OR coalesce(o, 0) > other_count THEN 'over'
  WHEN yes_count IS NULL OR no_count IS NULL OR other_count IS NULL THEN 'missing'
  WHEN coalesce(y, 0) = yes_count AND coalesce(n, 0) = no_count AND coalesce(o, 0) = other_count THEN 'complete' ELSE 'under' END AS verdict
  FROM v_vote_events e LEFT JOIN r ON r.vote_event_id = e.id)"""


@query("reconcile_events", f"WITH {_VERDICTS} SELECT id, verdict FROM verdicts")
def reconcile_events(t: Tables) -> DataFrame:
    return Q.reconcile(t.vote_events, t.vote_records).select("id", "verdict")


_CASTS = "SELECT vote_event_id AS event, person_id AS member, CASE WHEN CAST(person_id AS BIGINT) % 41 = 0 THEN NULL ELSE option END AS option, 1 AS place FROM v_vote_records UNION ALL SELECT vote_event_id, person_id, 'present', 2 FROM v_vote_records WHERE CAST(person_id AS BIGINT) % 3 = 0"


@query("resolve_casts", f"""WITH c AS ({_CASTS}), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event, member ORDER BY place) AS k FROM c) x WHERE k = 1),
f AS (SELECT event, count(*) AS casts, count(*) FILTER (WHERE CAST(member AS BIGINT) % 7 <> 0) AS resolved, count(*) FILTER (WHERE CAST(member AS BIGINT) % 7 = 0) AS dropped,
count(*) FILTER (WHERE option IS NULL) AS u, count(*) FILTER (WHERE option = 'yea') AS y, count(*) FILTER (WHERE option = 'nay') AS n, count(*) FILTER (WHERE option IN ('present', 'not_voting')) AS o FROM once GROUP BY 1)
SELECT event, casts, resolved, dropped, u > 0 OR NOT (y IS NOT DISTINCT FROM yes_count AND n IS NOT DISTINCT FROM no_count AND o IS NOT DISTINCT FROM other_count) AS quarantined FROM f JOIN v_vote_events e ON e.id = f.event""")
def resolve_casts(t: Tables) -> DataFrame:
    """Casts with some unknown options and repeated members, against a map that lacks some members."""
    records = t.vote_records
    lost = F.when(F.col("person_id").cast("long") % 41 != 0, F.col("option"))
    casts = records.select(F.col("vote_event_id").alias("event"), F.col("person_id").alias("member"), lost.alias("option"), F.lit(1).alias("place"))
    again = records.where(F.col("person_id").cast("long") % 3 == 0).select("vote_event_id", "person_id", F.lit("present"), F.lit(2))
    members = t.people.where(F.col("id").cast("long") % 7 != 0).select(F.col("id").alias("member"), F.col("id").alias("person_id"))
    stored = t.vote_events.select(F.col("id").alias("event"), "yes_count", "no_count", "other_count")
    return Q.resolve_casts(casts.union(again), members, stored)


@query("member_map", "SELECT key, CASE WHEN max(CASE WHEN id = key THEN id END) IS NOT NULL THEN max(CASE WHEN id = key THEN id END) ELSE min(id) END AS id FROM (SELECT id, CAST(CAST(id AS BIGINT) % 60 AS VARCHAR) AS key FROM v_people) x GROUP BY key HAVING max(CASE WHEN id = key THEN id END) IS NOT NULL OR count(DISTINCT id) = 1")
def member_map(t: Tables) -> DataFrame:
    return Q.member_map(t.people.select("id", (F.col("id").cast("long") % 60).cast("string").alias("key")))


@query("span_disjoint", "SELECT person_id, start_date, end_date FROM (SELECT *, lead(start_date) OVER (PARTITION BY person_id ORDER BY start_date, end_date, party) AS nxt FROM (SELECT person_id, party, start_date, CASE WHEN CAST(person_id AS BIGINT) % 6 = 0 THEN end_date + INTERVAL 10 DAY ELSE end_date END AS end_date FROM v_party_spans) s) x WHERE nxt < end_date OR nxt = start_date")
def span_disjoint(t: Tables) -> DataFrame:
    """Spans, some of them made too long: those are found."""
    longer = F.when(F.col("person_id").cast("long") % 6 == 0, F.date_add("end_date", 10)).otherwise(F.col("end_date"))
    return W.overlapping_spans(t.party_spans.withColumn("end_date", longer)).select("person_id", "start_date", F.col("end_date").cast("timestamp_ntz").alias("end_date"))


@query("skip_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN result IS NULL THEN 'no_result' WHEN NOT regexp_full_match(b.identifier, 'HR\\d+') THEN 'not_a_bill' WHEN b.status = 'failed' THEN 'failed' ELSE 'ok' END AS reason FROM v_vote_events e JOIN v_bills b ON b.id = e.bill_id) x GROUP BY 1")
def skip_reasons(t: Tables) -> DataFrame:
    rows = t.vote_events.join(t.bills.select(F.col("id").alias("bill_id"), "identifier", "status"), "bill_id")
    gated = Q.first_reason(rows, [("no_result", F.col("result").isNull()), ("not_a_bill", ~F.col("identifier").rlike(r"^HR\d+$")), ("failed", F.col("status") == "failed")])
    return gated.groupBy("reason").agg(F.count("*").alias("n"))


@query("text_coverage", "SELECT b.session_id, count(DISTINCT b.id) AS bills, count(DISTINCT t.bill_id) AS with_text, round(100.0 * count(DISTINCT t.bill_id) / count(DISTINCT b.id), 1) AS percent FROM v_bills b LEFT JOIN v_bill_texts t ON t.bill_id = b.id GROUP BY 1")
def text_coverage(t: Tables) -> DataFrame:
    held = t.bill_texts.select("bill_id").distinct().withColumn("held", F.lit(1))
    joined = t.bills.select("session_id", F.col("id").alias("bill_id")).distinct().join(held, "bill_id", "left")
    return joined.groupBy("session_id").agg(
        F.count("*").alias("bills"), F.count("held").alias("with_text"), F.round(100.0 * F.count("held") / F.count("*"), 1).alias("percent")
    )


@query("run_metrics", "SELECT CAST(year(e.vote_date) - 1885 AS INT) AS congress, e.chamber, count(*) AS casts, count(*) FILTER (WHERE CAST(person_id AS BIGINT) % 7 <> 0) AS resolved, count(DISTINCT CASE WHEN CAST(person_id AS BIGINT) % 7 = 0 THEN person_id END) AS unresolved_ids, round(CAST(count(*) FILTER (WHERE CAST(person_id AS BIGINT) % 7 <> 0) AS DOUBLE) / count(*), 4) AS rate FROM v_vote_records r JOIN v_vote_events e ON e.id = r.vote_event_id GROUP BY 1, 2")
def run_metrics(t: Tables) -> DataFrame:
    known = t.people.where(F.col("id").cast("long") % 7 != 0).select(F.col("id").alias("person_id"), F.lit(True).alias("known"))
    events = t.vote_events.select(F.col("id").alias("vote_event_id"), "chamber", (F.year("vote_date") - 1885).alias("congress"))
    rows = t.vote_records.join(events, "vote_event_id").join(known, "person_id", "left")
    return rows.groupBy("congress", "chamber").agg(
        F.count("*").alias("casts"), F.count("known").alias("resolved"),
        F.count_distinct(F.when(F.col("known").isNull(), F.col("person_id"))).alias("unresolved_ids"), F.round(F.count("known") / F.count("*"), 4).alias("rate"),
    )


@query("fingerprint", "SELECT 'bills' AS name, count(*) AS n, max(introduced_date) AS latest FROM v_bills UNION ALL SELECT 'vote_events', count(*), max(vote_date) FROM v_vote_events UNION ALL SELECT 'bill_actions', count(*), max(action_date) FROM v_bill_actions UNION ALL SELECT 'bill_texts', count(*), max(version_date) FROM v_bill_texts")
def fingerprint(t: Tables) -> DataFrame:
    out = None
    for name, rows, date in (("bills", t.bills, "introduced_date"), ("vote_events", t.vote_events, "vote_date"), ("bill_actions", t.bill_actions, "action_date"), ("bill_texts", t.bill_texts, "version_date")):
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.max(date).alias("latest"))
        out = one if out is None else out.unionByName(one)
    return out


@query("gap_bills", "SELECT s.id FROM (SELECT id, identifier, session_id FROM v_bills) s WHERE CAST(s.id AS BIGINT) % 5 = 1 AND CAST(s.id AS BIGINT) % 3 = 1")
def gap_bills(t: Tables) -> DataFrame:
    """Source bills that a store, which lacks some keys and some ids, knows by neither."""
    n = F.col("id").cast("long")
    by_key = t.bills.where(n % 5 != 1).select("session_id", "identifier")
    by_id = t.bills.where(n % 3 != 1).select("id")
    return t.bills.join(by_key, ["session_id", "identifier"], "left_anti").join(by_id, "id", "left_anti").select("id")


@query("missing_rolls", "WITH r AS (SELECT chamber, CAST(CAST(substr(id, 2) AS BIGINT) % 1000 AS INT) AS roll FROM v_vote_events WHERE CAST(substr(id, 2) AS BIGINT) % 13 <> 0) SELECT x.chamber, x.roll, CASE WHEN x.roll % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM (SELECT chamber, unnest(generate_series(1, max(roll))) AS roll FROM r GROUP BY 1) x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.chamber = x.chamber AND r.roll = x.roll)")
def missing_rolls(t: Tables) -> DataFrame:
    number = F.expr("cast(substr(id, 2) as bigint)")
    rows = t.vote_events.where(number % 13 != 0).select("chamber", (number % 1000).cast("int").alias("roll"))
    return Q.missing_numbers(rows, ["chamber"], "roll").withColumn("category", F.when(F.col("roll") % 2 == 0, "even").otherwise("odd"))


@query("compare_sources", "WITH theirs AS (SELECT vote_event_id, person_id, CASE WHEN CAST(person_id AS BIGINT) % 9 = 0 THEN 'present' ELSE option END AS option FROM v_vote_records), ours AS (SELECT * FROM v_vote_records WHERE CAST(person_id AS BIGINT) % 4 <> 0) SELECT t.vote_event_id, count(*) FILTER (WHERE o.option IS NOT NULL AND o.option = t.option) AS matched, count(*) FILTER (WHERE o.option IS NOT NULL AND o.option <> t.option) AS mismatched, count(*) FILTER (WHERE o.option IS NULL) AS unresolved FROM theirs t LEFT JOIN ours o ON o.vote_event_id = t.vote_event_id AND o.person_id = t.person_id GROUP BY 1")
def compare_sources(t: Tables) -> DataFrame:
    n = F.col("person_id").cast("long")
    theirs = t.vote_records.withColumn("option", F.when(n % 9 == 0, "present").otherwise(F.col("option")))
    return Q.compare_casts(t.vote_records.where(n % 4 != 0), theirs)


@query("recount_pairs", "SELECT option, count(*) AS n FROM v_vote_records WHERE false GROUP BY 1")
def recount_pairs(t: Tables) -> DataFrame:
    """Rows in which a join and an independent recount of it differ: none."""
    joined = t.vote_records.join(t.vote_events.select(F.col("id").alias("vote_event_id")), "vote_event_id").groupBy("option").agg(F.count("*").alias("n"))
    recount = t.vote_records.join(t.vote_events.select(F.col("id").alias("vote_event_id")), "vote_event_id", "left_semi").groupBy("option").agg(F.count("*").alias("n"))
    return joined.exceptAll(recount).union(recount.exceptAll(joined))


#: Instances by the last digit of their event: grader, refusal, gold as JSON, and the rule that it breaks.
_GOLDS = (
    ("exact", False, '"yea"', None),
    ("exact", True, '"not_in_the_data"', None),
    ("exact", True, '"yea"', "refusal"),
    ("exact", False, '""', "empty"),
    ("exact", False, '"not_in_the_data"', "empty"),
    ("fields", False, '{"a": 1, "b": "x"}', None),
    ("fields", False, '{"a": 1, "b": true}', "fields"),
    ("set_match", False, "[]", None),
    ("set_match", False, '"yea"', "set"),
    ("exact_int", False, "true", "int"),
)
_RULE = " ".join(f"WHEN {i} THEN '{rule}'" for i, (*_, rule) in enumerate(_GOLDS) if rule)


@query("validate_gold", f"SELECT template_id, CASE event_id % 10 {_RULE} ELSE CASE WHEN template_id = 'purchase_vote_lookup' AND event_id % 10 IN (5, 7) THEN 'option' ELSE 'valid' END END AS rule, count(*) AS n FROM (SELECT event_id, CASE WHEN event_type = 'purchase' AND event_id % 10 IN (0, 5, 7) THEN 'purchase_vote_lookup' ELSE event_type END AS template_id FROM events) x GROUP BY 1, 2")
def validate_gold(t: Tables) -> DataFrame:
    """Rules that gold answers break, by template; three of ten purchases are vote lookups."""
    from statutory.operators.grading import gold_violation

    digit = F.col("event_id") % 10
    pick = lambda i: F.element_at(F.array(*[F.lit(row[i]) for row in _GOLDS]), (digit + 1).cast("int"))
    lookup = (F.col("event_type") == "purchase") & digit.isin(0, 5, 7)
    made = t.events.select(F.when(lookup, "purchase_vote_lookup").otherwise(F.col("event_type")).alias("template_id"), pick(0).alias("grader"), pick(1).alias("is_refusal"), pick(2).alias("gold"))
    return made.groupBy("template_id", F.coalesce(gold_violation(), F.lit("valid")).alias("rule")).agg(F.count("*").alias("n"))


@query("name_collisions", "SELECT vote_event_id, name, count(DISTINCT person_id) AS n FROM (SELECT r.vote_event_id, r.person_id, substr(p.name, 1, 21) AS name FROM v_vote_records r JOIN v_people p ON p.id = r.person_id) x GROUP BY 1, 2 HAVING count(DISTINCT person_id) > 1")
def name_collisions(t: Tables) -> DataFrame:
    """With names cut short, so that some collide."""
    return Q.name_collisions(t.vote_records, t.people.withColumn("name", F.substring("name", 1, 21)))


_NAMES = """m AS (SELECT DISTINCT year(e.vote_date) - 1885 AS congress, e.chamber, r.person_id, CASE CAST(r.person_id AS BIGINT) % 6
    WHEN 0 THEN 'Rep. ' || split_part(c, ' ', 1) || ', ' || split_part(c, ' ', 2) || ' [X-YY]' WHEN 1 THEN split_part(c, ' ', 2) || 'son ' || split_part(c, ' ', 1)
    WHEN 2 THEN split_part(c, ' ', 2) WHEN 3 THEN 'Sen. ' || substr(c, 1, 4) WHEN 4 THEN substr(c, 3, 2) ELSE c END AS name
  FROM v_vote_records r JOIN v_vote_events e ON e.id = r.vote_event_id JOIN (SELECT CAST(p_partkey AS VARCHAR) AS id, regexp_replace(p_name, '[^A-Za-z ]', '', 'g') AS c FROM part) p ON p.id = r.person_id),
t AS (SELECT *, lower(name) AS low, list_filter(string_split_regex(trim(replace(lower(regexp_replace(regexp_replace(name, '\\[.*?\\]', ' ', 'g'), '^\\s*\\w+\\.\\s+', ' ')), ',', ' ')), '\\s+'), lambda x: regexp_full_match(x, '[a-z]+')) AS tokens FROM m)"""


@query("window_collisions", f"WITH {_NAMES} SELECT CAST(a.congress AS INT) AS congress, a.chamber, a.person_id, count(DISTINCT b.person_id) AS n FROM t a JOIN t b ON a.congress = b.congress AND a.chamber = b.chamber AND a.person_id <> b.person_id WHERE len(a.tokens) > 0 AND len(list_filter(a.tokens, lambda x: NOT contains(b.low, x))) = 0 GROUP BY 1, 2, 3")
def window_collisions(t: Tables) -> DataFrame:
    """With the words of part names as the names of members, some cut, turned or lengthened."""
    words = F.regexp_replace("p_name", "[^A-Za-z ]", "")
    first, second = (F.coalesce(F.get(F.split(words, " "), F.lit(i)), F.lit("")) for i in (0, 1))
    kind = F.col("p_partkey") % 6
    name = (
        F.when(kind == 0, F.concat(F.lit("Rep. "), first, F.lit(", "), second, F.lit(" [X-YY]"))).when(kind == 1, F.concat(second, F.lit("son "), first))
        .when(kind == 2, second).when(kind == 3, F.concat(F.lit("Sen. "), F.substring(words, 1, 4))).when(kind == 4, F.substring(words, 3, 2)).otherwise(words)
    )
    people = t.part.select(F.col("p_partkey").cast("string").alias("person_id"), name.alias("name"))
    events = t.vote_events.select(F.col("id").alias("vote_event_id"), "chamber", (F.year("vote_date") - 1885).alias("congress"))
    members = t.vote_records.join(events, "vote_event_id").select("congress", "chamber", "person_id").distinct().join(people, "person_id")
    return Q.window_collisions(members)


@query("invalid_refs", "SELECT bill_id, id AS ref FROM v_bill_texts t WHERE NOT EXISTS (SELECT 1 FROM v_bills b WHERE b.id = t.bill_id)")
def invalid_refs(t: Tables) -> DataFrame:
    return t.bill_texts.join(t.bills.select(F.col("id").alias("bill_id")), "bill_id", "left_anti").select("bill_id", F.col("id").alias("ref"))



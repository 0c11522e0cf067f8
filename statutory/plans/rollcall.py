"""Roll-call queries over the whole vote corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.operators import rollcall as R
from statutory.operators import windows as W
from statutory.plans.aggregates import _PIVOT
from statutory.plans.quality import _VERDICTS
from statutory.plans.registry import query
from statutory.plans.views import Tables

TODAY = "2001-06-01"

_SPAN = "s.person_id = {v}.person_id AND s.start_date <= e.vote_date AND (s.end_date IS NULL OR e.vote_date < s.end_date)"
_ASOF = "v_vote_records r JOIN v_vote_events e ON e.id = r.vote_event_id JOIN v_party_spans s ON " + _SPAN.format(v="r")
_ELIGIBLE = _VERDICTS + """,
bad AS (SELECT DISTINCT id FROM (SELECT e.id, r.person_id, count(s.party) AS n FROM verdicts e JOIN v_vote_records r ON r.vote_event_id = e.id LEFT JOIN v_party_spans s ON """ + _SPAN.format(v="r") + """ WHERE verdict = 'complete' GROUP BY 1, 2) x WHERE n <> 1),
eligible AS (SELECT * FROM verdicts WHERE verdict = 'complete' AND id NOT IN (SELECT id FROM bad)),
breakdown AS (SELECT vote_event_id, party, """ + _PIVOT + """ FROM v_vote_records r JOIN eligible e ON e.id = r.vote_event_id JOIN v_party_spans s ON """ + _SPAN.format(v="r") + """ GROUP BY 1, 2 HAVING count(*) >= 2),
sides AS (SELECT *, CASE WHEN yea > nay THEN 'yea' WHEN nay > yea THEN 'nay' END AS side FROM breakdown)"""
_WINDOWS = _VERDICTS + """,
wv AS (SELECT v.*, CAST(split_part(b.session_id, '-', 2) AS INT) AS congress FROM verdicts v JOIN v_bills b ON b.id = v.bill_id),
whole AS (SELECT congress, chamber, count(*) AS events FROM wv GROUP BY 1, 2 HAVING bool_and(verdict = 'complete')),
votes AS (SELECT r.*, wv.congress, wv.chamber FROM v_vote_records r JOIN wv ON wv.id = r.vote_event_id JOIN whole w ON w.congress = wv.congress AND w.chamber = wv.chamber)"""
_PAIRS = "SELECT a.congress, a.chamber, a.person_id AS a, b.person_id AS b, count(*) AS shared, count(*) FILTER (WHERE a.option = b.option) AS agreements FROM votes a JOIN votes b ON a.vote_event_id = b.vote_event_id AND a.person_id < b.person_id WHERE a.option IN ('yea', 'nay') AND b.option IN ('yea', 'nay') GROUP BY 1, 2, 3, 4"


@query("party_asof", f"SELECT r.vote_event_id, r.person_id, s.party FROM {_ASOF}")
def party_asof(t: Tables) -> DataFrame:
    return R.party_asof(R.dated_votes(t.vote_records, t.vote_events), t.party_spans).select("vote_event_id", "person_id", "party")


@query("vote_event_detail", "SELECT vote_event_id, person_id, name, option, party FROM (SELECT r.vote_event_id, r.person_id, p.name, r.option, s.party, row_number() OVER (PARTITION BY r.vote_event_id, r.person_id ORDER BY s.start_date NULLS FIRST, s.party NULLS FIRST) AS n FROM v_vote_records r JOIN v_vote_events e ON e.id = r.vote_event_id LEFT JOIN v_people p ON p.id = r.person_id LEFT JOIN v_party_spans s ON " + _SPAN.format(v="r") + ") x WHERE n = 1")
def vote_event_detail(t: Tables) -> DataFrame:
    people = t.people.select(F.col("id").alias("person_id"), "name")
    votes = R.dated_votes(t.vote_records, t.vote_events).join(people, "person_id", "left")
    spans = t.party_spans.select(F.col("person_id").alias("_p"), "party", "start_date", "end_date")
    joined = votes.join(spans, (F.col("person_id") == F.col("_p")) & R.in_span(), "left")
    return W.top_per_group(joined, ["vote_event_id", "person_id"], [F.asc_nulls_first("start_date"), F.asc_nulls_first("party")]).select("vote_event_id", "person_id", "name", "option", "party")


@query("party_eligible", f"WITH {_ELIGIBLE} SELECT id FROM eligible")
def party_eligible(t: Tables) -> DataFrame:
    return R.party_eligible(t.vote_records, t.vote_events, t.party_spans).select("id")


@query("pairwise_agreement", f"WITH {_WINDOWS} {_PAIRS}")
def pairwise_agreement(t: Tables) -> DataFrame:
    return R.pairwise_agreement(R.window_votes(t.vote_events, t.vote_records, t.bills), ["congress", "chamber"])


@query("vote_lookup", "SELECT r.vote_event_id, r.person_id, p.name, r.option FROM v_vote_records r JOIN v_people p ON p.id = r.person_id")
def vote_lookup(t: Tables) -> DataFrame:
    return t.vote_records.join(t.people.select(F.col("id").alias("person_id"), "name"), "person_id").select("vote_event_id", "person_id", "name", "option")


@query("tally", "SELECT id, yes_count AS yea, no_count AS nay, yes_count - no_count AS margin, result FROM v_vote_events WHERE yes_count IS NOT NULL AND no_count IS NOT NULL AND other_count IS NOT NULL AND result IS NOT NULL")
def tally(t: Tables) -> DataFrame:
    known = t.vote_events.dropna(subset=["yes_count", "no_count", "other_count", "result"])
    return known.select("id", F.col("yes_count").alias("yea"), F.col("no_count").alias("nay"), (F.col("yes_count") - F.col("no_count")).alias("margin"), "result")


@query("closest_by_margin", f"SELECT congress, chamber, id, margin, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY congress, chamber ORDER BY margin, id) AS n FROM (SELECT CAST(split_part(b.session_id, '-', 2) AS INT) AS congress, e.chamber, e.id, abs(yes_count - no_count) AS margin FROM v_vote_events e JOIN v_bills b ON b.id = e.bill_id JOIN v_sessions s ON s.id = b.session_id WHERE s.end_date < DATE '{TODAY}' AND yes_count IS NOT NULL AND no_count IS NOT NULL) x) y WHERE n <= 5")
def closest_by_margin(t: Tables) -> DataFrame:
    return R.closest_by_margin(t.vote_events, t.bills, t.sessions, TODAY)


@query("complete_windows", f"WITH {_WINDOWS} SELECT * FROM whole")
def complete_windows(t: Tables) -> DataFrame:
    return R.complete_windows(t.vote_events, t.vote_records, t.bills)


@query("member_summary", f"WITH {_WINDOWS} SELECT congress, chamber, person_id, count(*) FILTER (WHERE option = 'yea') AS yea, count(*) FILTER (WHERE option = 'nay') AS nay, count(*) FILTER (WHERE option IN ('present', 'not_voting')) AS other FROM votes GROUP BY 1, 2, 3")
def member_summary(t: Tables) -> DataFrame:
    return R.member_summary(R.window_votes(t.vote_events, t.vote_records, t.bills))


@query("party_breakdown", f"WITH {_ELIGIBLE} SELECT * FROM breakdown")
def party_breakdown(t: Tables) -> DataFrame:
    return R.party_breakdown(t.vote_records, t.vote_events, t.party_spans)


@query("party_majority", f"WITH {_ELIGIBLE} SELECT vote_event_id, party, side FROM sides")
def party_majority(t: Tables) -> DataFrame:
    return R.party_majority(party_breakdown(t)).select("vote_event_id", "party", "side")


@query("party_defection", f"WITH {_ELIGIBLE} SELECT vote_event_id, party, least(yea, nay) AS defections FROM sides WHERE side IS NOT NULL")
def party_defection(t: Tables) -> DataFrame:
    return R.party_majority(party_breakdown(t)).where("side is not null").select("vote_event_id", "party", F.least("yea", "nay").alias("defections"))


@query("crossed_party", f"WITH {_ELIGIBLE} SELECT r.vote_event_id, s.party, coalesce(list_sort(list(DISTINCT r.person_id) FILTER (WHERE r.option <> d.side)), []) AS members FROM {_ASOF} JOIN sides d ON d.vote_event_id = r.vote_event_id AND d.party = s.party WHERE d.side IS NOT NULL AND r.option IN ('yea', 'nay') GROUP BY 1, 2")
def crossed_party(t: Tables) -> DataFrame:
    return R.crossed_party(t.vote_records, t.vote_events, t.party_spans)


@query("cite_event", "SELECT s.bill_id, s.vote_event_id FROM (SELECT bill_id, min(id) AS vote_event_id FROM v_vote_events GROUP BY 1 HAVING count(*) = 1) s WHERE EXISTS (SELECT 1 FROM v_vote_records r WHERE r.vote_event_id = s.vote_event_id)")
def cite_event(t: Tables) -> DataFrame:
    return R.single_rollcall_bills(t.vote_events).join(t.vote_records, "vote_event_id", "left_semi").select("bill_id", "vote_event_id")


@query("no_link", "WITH a AS (SELECT DISTINCT r.person_id, CAST(split_part(b.session_id, '-', 2) AS INT) AS congress FROM v_vote_records r JOIN v_vote_events e ON e.id = r.vote_event_id JOIN v_bills b ON b.id = e.bill_id) SELECT p.person_id, c.congress FROM (SELECT DISTINCT person_id FROM a) p, (SELECT DISTINCT congress FROM a) c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.person_id = p.person_id AND a.congress = c.congress)")
def no_link(t: Tables) -> DataFrame:
    return R.no_link(t.vote_records, t.vote_events, t.bills)


@query("cosponsor_against", "WITH s AS (SELECT bill_id, min(id) AS vote_event_id FROM v_vote_events GROUP BY 1 HAVING count(*) = 1) SELECT s.bill_id, s.vote_event_id, coalesce(list_sort(list(DISTINCT r.person_id) FILTER (WHERE r.option = 'nay')), []) AS members, count(*) AS voting_cosponsors FROM s JOIN v_vote_records r ON r.vote_event_id = s.vote_event_id WHERE EXISTS (SELECT 1 FROM v_sponsorships c WHERE c.bill_id = s.bill_id AND c.person_id = r.person_id AND c.classification <> 'primary') GROUP BY 1, 2")
def cosponsor_against(t: Tables) -> DataFrame:
    return R.cosponsor_against(t.sponsorships, t.vote_records, t.vote_events)


def _members(t: Tables) -> DataFrame:
    return R.party_asof(R.dated_votes(t.vote_records, t.vote_events), t.party_spans).groupBy("person_id", "party", "chamber").agg(F.count("*").alias("nvotes"))


_MEMBERS = f"m AS (SELECT r.person_id, s.party, e.chamber, count(*) AS nvotes FROM {_ASOF} GROUP BY 1, 2, 3), p AS (SELECT x.chamber, x.party, x.person_id AS a, y.person_id AS b FROM m x JOIN m y ON x.chamber = y.chamber AND x.party = y.party AND x.person_id < y.person_id WHERE x.nvotes >= 5 AND y.nvotes >= 5)"


@query("same_party_pairs", f"WITH {_MEMBERS} SELECT * FROM p")
def same_party_pairs(t: Tables) -> DataFrame:
    return R.same_party_pairs(_members(t), 5)


@query("covoting_disagree", f"WITH {_MEMBERS}, q AS (SELECT DISTINCT a, b FROM p), d AS (SELECT x.person_id AS a, y.person_id AS b, list_sort(list(DISTINCT x.vote_event_id)) AS events FROM v_vote_records x JOIN v_vote_records y ON x.vote_event_id = y.vote_event_id AND x.person_id < y.person_id AND x.option <> y.option WHERE x.option IN ('yea', 'nay') AND y.option IN ('yea', 'nay') GROUP BY 1, 2) SELECT q.a, q.b, coalesce(d.events, []) AS events FROM q LEFT JOIN d ON d.a = q.a AND d.b = q.b")
def covoting_disagree(t: Tables) -> DataFrame:
    return R.disagreements(t.vote_records, R.same_party_pairs(_members(t), 5).select("a", "b").distinct())


@query("party_at_vote", f"SELECT r.vote_event_id, r.person_id, min(s.party) AS party FROM {_ASOF} GROUP BY 1, 2 HAVING count(DISTINCT s.party) = 1")
def party_at_vote(t: Tables) -> DataFrame:
    return R.party_at_vote(t.vote_records, t.vote_events, t.party_spans)


@query("party_switchers", f"WITH y AS (SELECT r.person_id, CAST(year(e.vote_date) AS INT) AS year, count(DISTINCT s.party) AS year_parties FROM {_ASOF} GROUP BY 1, 2), p AS (SELECT person_id, count(DISTINCT party) AS parties FROM v_party_spans GROUP BY 1) SELECT y.person_id, year, year_parties, parties, CASE WHEN year_parties > 1 THEN 'spanning' WHEN parties > 1 THEN 'switcher' ELSE 'control' END AS label FROM y JOIN p ON p.person_id = y.person_id")
def party_switchers(t: Tables) -> DataFrame:
    return R.party_switchers(t.vote_records, t.vote_events, t.party_spans)


@query("absent_keys", "WITH m AS (SELECT 'e' || CAST(i AS VARCHAR) AS id, i FROM unnest(generate_series(1, 4 * greatest(3, CAST((SELECT count(*) FROM v_vote_events) // 4 AS BIGINT)) + 8)) AS g(i)) SELECT id FROM m WHERE id NOT IN (SELECT id FROM v_vote_events)")
def absent_keys(t: Tables) -> DataFrame:
    """Every number up to the size of the corpus for which no event exists."""
    events = t.vote_events.select("id")
    n = events.agg((4 * F.greatest(F.lit(3), F.floor(F.count("*") / 4)) + 8).alias("n"))
    made = n.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("k")).select(F.concat(F.lit("e"), F.col("k").cast("string")).alias("id"))
    return made.join(events, "id", "left_anti")


@query("pinned_window", f"WITH {_WINDOWS}, one AS (SELECT * FROM votes WHERE congress = 111 AND chamber = 'house') SELECT person_id, count(*) FILTER (WHERE option = 'yea') AS yea, count(*) FILTER (WHERE option = 'nay') AS nay, count(*) FILTER (WHERE option IN ('present', 'not_voting')) AS other FROM one GROUP BY 1")
def pinned_window(t: Tables) -> DataFrame:
    return member_summary(t).where("congress = 111 and chamber = 'house'").drop("congress", "chamber")


@query("trivial_share", f"WITH {_ELIGIBLE} SELECT 'defection' AS kind, count(*) AS n, avg(CASE WHEN least(yea, nay) = 0 THEN 1.0 ELSE 0.0 END) AS share FROM sides WHERE side IS NOT NULL")
def trivial_share(t: Tables) -> DataFrame:
    return party_defection(t).agg(F.lit("defection").alias("kind"), F.count("*").alias("n"), F.avg(F.when(F.col("defections") == 0, 1.0).otherwise(0.0)).alias("share"))


@query("gate_funnel", f"WITH {_ELIGIBLE} SELECT (SELECT count(*) FROM v_vote_events) AS events, (SELECT count(*) FROM verdicts WHERE verdict = 'complete') AS complete, (SELECT count(*) FROM eligible) AS eligible")
def gate_funnel(t: Tables) -> DataFrame:
    from statutory.operators.quality import reconcile

    verdicts = reconcile(t.vote_events, t.vote_records).select("id", "verdict")
    marked = verdicts.join(party_eligible(t).withColumn("ok", F.lit(True)), "id", "left")
    return marked.agg(F.count("*").alias("events"), F.count(F.when(F.col("verdict") == "complete", 1)).alias("complete"), F.count("ok").alias("eligible"))


@query("set_gates", f"WITH {_VERDICTS}, done AS (SELECT e.id FROM v_vote_events e JOIN v_bills b ON b.id = e.bill_id JOIN v_sessions s ON s.id = b.session_id WHERE s.end_date < DATE '{TODAY}') SELECT id FROM done WHERE id IN (SELECT id FROM verdicts WHERE verdict = 'complete') AND id NOT IN (SELECT id FROM v_vote_events WHERE result IS NULL)")
def set_gates(t: Tables) -> DataFrame:
    from statutory.operators.quality import complete_events

    done = R.with_congress(t.vote_events, t.bills).join(F.broadcast(R.ended_sessions(t.sessions, TODAY)), "session_id", "left_semi").select("id")
    return done.intersect(complete_events(t.vote_events, t.vote_records).select("id")).subtract(t.vote_events.where("result is null").select("id"))


@query("cosponsored_no_vote", "SELECT DISTINCT s.bill_id, s.person_id FROM v_sponsorships s JOIN v_vote_events e ON e.bill_id = s.bill_id WHERE NOT EXISTS (SELECT 1 FROM v_vote_records r WHERE r.vote_event_id = e.id AND r.person_id = s.person_id)")
def cosponsored_no_vote(t: Tables) -> DataFrame:
    events = t.vote_events.select("bill_id", F.col("id").alias("vote_event_id"))
    return t.sponsorships.join(events, "bill_id").join(t.vote_records, ["vote_event_id", "person_id"], "left_anti").select("bill_id", "person_id").distinct()


@query("single_rollcall_bills", "SELECT id, title FROM v_bills WHERE id IN (SELECT bill_id FROM v_vote_events GROUP BY 1 HAVING count(*) = 1)")
def single_rollcall_bills(t: Tables) -> DataFrame:
    return t.bills.join(R.single_rollcall_bills(t.vote_events).select(F.col("bill_id").alias("id")), "id", "left_semi").select("id", "title")


@query("cosponsor_nay", "SELECT DISTINCT e.bill_id, r.person_id FROM v_sponsorships s JOIN v_vote_events e ON e.bill_id = s.bill_id JOIN v_vote_records r ON r.vote_event_id = e.id AND r.person_id = s.person_id WHERE r.option = 'nay'")
def cosponsor_nay(t: Tables) -> DataFrame:
    events = t.vote_events.select("bill_id", F.col("id").alias("vote_event_id"))
    nays = t.vote_records.where("option = 'nay'").join(events, "vote_event_id")
    return t.sponsorships.join(nays, ["bill_id", "person_id"]).select("bill_id", "person_id").distinct()


@query("distinct_keys", "SELECT DISTINCT chamber, result FROM v_vote_events")
def distinct_keys(t: Tables) -> DataFrame:
    return t.vote_events.select("chamber", "result").distinct()



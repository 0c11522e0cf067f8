"""Trend, count and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statutory.functions import text as T
from statutory.operators import aggregates as A
from statutory.operators import grading as G
from statutory.plans.registry import query
from statutory.plans.scalars import _status_sql
from statutory.plans.views import Tables


def bill_counts(t: Tables, dimension: str, period: str = "month") -> DataFrame:
    bills = t.bills
    if dimension in ("subject", "classification"):
        bills = bills.withColumn(dimension, F.explode(dimension))
    column = F.coalesce(dimension, F.lit("unknown")) if dimension == "status" else F.col(dimension)
    return A.count_by_period(bills, "created_at", column, period)


_COUNTS = "SELECT CAST(date_trunc('{p}', created_at) AS DATE) AS period, {d} AS dimension, count(*) AS count FROM {f} GROUP BY 1, 2"


@query("trend_bills", " UNION ALL ".join(
    f"SELECT '{name}' AS kind, * FROM (" + _COUNTS.format(p=p, d=d, f=f) + ") x"
    for name, p, d, f in (
        ("jurisdiction_id", "month", "jurisdiction_id", "v_bills"),
        ("status", "quarter", "coalesce(status, 'unknown')", "v_bills"),
        ("subject", "year", "subject", "(SELECT created_at, unnest(subject) AS subject FROM v_bills) b"),
        ("classification", "year", "classification", "(SELECT created_at, unnest(classification) AS classification FROM v_bills) b"),
    )
))
def trend_bills(t: Tables) -> DataFrame:
    """The four groupings of bills in one scan and one aggregate."""
    return A.counts_by_kind(t.bills, "created_at", {
        "jurisdiction_id": ("month", F.array("jurisdiction_id")),
        "status": ("quarter", F.array(F.coalesce("status", F.lit("unknown")))),
        "subject": ("year", F.col("subject")),
        "classification": ("year", F.col("classification")),
    })


@query("trend_actions", "SELECT CAST(date_trunc('month', action_date) AS DATE) AS period, dimension, count(*) AS count FROM (SELECT action_date, unnest(classification) AS dimension FROM v_bill_actions) a GROUP BY 1, 2")
def trend_actions(t: Tables) -> DataFrame:
    actions = t.bill_actions.withColumn("kind", F.explode("classification"))
    return A.count_by_period(actions, "action_date", F.col("kind"))


@query("trend_topics", "WITH c AS (" + _COUNTS.format(p="quarter", d="subject", f="(SELECT created_at, unnest(subject) AS subject FROM v_bills) b") + ") SELECT period, dimension, count, round(100.0 * count / sum(count) OVER (PARTITION BY period), 1) AS share FROM c")
def trend_topics(t: Tables) -> DataFrame:
    return A.with_share(bill_counts(t, "subject", "quarter"))


@query("top_n_other", "WITH c AS (" + _COUNTS.format(p="month", d="jurisdiction_id", f="v_bills") + "), top AS (SELECT dimension FROM c GROUP BY dimension ORDER BY sum(count) DESC, dimension LIMIT 5) SELECT period, CASE WHEN dimension IN (SELECT dimension FROM top) THEN dimension ELSE 'Other' END AS dimension, CAST(sum(count) AS BIGINT) AS count FROM c GROUP BY 1, 2")
def top_n_other(t: Tables) -> DataFrame:
    return A.fold_top(bill_counts(t, "jurisdiction_id"), 5)


@query("jurisdiction_stats", """
WITH b AS (SELECT * FROM v_bills), s AS (SELECT jurisdiction_id, unnest(subject) AS key FROM b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction_id ORDER BY n DESC, key) AS r FROM (SELECT jurisdiction_id, key, count(*) AS n FROM s GROUP BY 1, 2))
SELECT jurisdiction_id, 'total' AS kind, 'bills' AS key, count(*) AS n FROM b GROUP BY 1
UNION ALL SELECT jurisdiction_id, 'status', coalesce(status, 'unknown'), count(*) FROM b GROUP BY 1, 3
UNION ALL SELECT jurisdiction_id, 'session', session_id, count(*) FROM b GROUP BY 1, 3
UNION ALL SELECT jurisdiction_id, 'subject', key, n FROM ranked WHERE r <= 15""")
def jurisdiction_stats(t: Tables) -> DataFrame:
    """All kinds of counts from one scan and one aggregate."""
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    single = F.array(key("total", F.lit("bills")), key("status", F.coalesce("status", F.lit("unknown"))), key("session", F.col("session_id")))
    subjects = F.coalesce(F.transform("subject", lambda x: key("subject", x)), F.array())
    counts = t.bills.select("jurisdiction_id", F.explode(F.concat(single, subjects)).alias("k")).groupBy("jurisdiction_id", "k.kind", "k.key").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("jurisdiction_id", "kind").orderBy(F.desc("n"), "key"))
    return counts.withColumn("rank", rank).where("kind <> 'subject' or rank <= 15").drop("rank")


@query("person_stats", """
WITH s AS (SELECT person_id, count(*) FILTER (WHERE classification = 'primary') AS p, count(*) FILTER (WHERE classification <> 'primary') AS o FROM v_sponsorships GROUP BY 1),
v AS (SELECT person_id, count(*) AS n FROM v_vote_records GROUP BY 1),
e AS (SELECT jurisdiction_id, count(*) AS n FROM v_vote_events e JOIN v_bills b ON b.id = e.bill_id GROUP BY 1)
SELECT id AS person_id, coalesce(p, 0) AS primary_count, coalesce(o, 0) AS other_count, coalesce(v.n, 0) AS votes,
       CASE WHEN e.n > 0 THEN round(CAST(coalesce(v.n, 0) AS DOUBLE) / e.n, 4) END AS participation
FROM v_people p LEFT JOIN s ON s.person_id = p.id LEFT JOIN v ON v.person_id = p.id LEFT JOIN e ON e.jurisdiction_id = p.current_jurisdiction_id""")
def person_stats(t: Tables) -> DataFrame:
    return A.person_stats(t.people, t.sponsorships, t.vote_records, t.vote_events, t.bills)


@query("status_totals", "WITH d AS (SELECT id, status, attempted_at FROM v_deliveries) SELECT 'total' AS kind, status AS key, count(*) AS n FROM d GROUP BY status UNION ALL SELECT 'latest', id, 1 FROM (SELECT id FROM d ORDER BY attempted_at DESC, CAST(id AS BIGINT) DESC LIMIT 10) l")
def status_totals(t: Tables) -> DataFrame:
    totals = t.deliveries.groupBy(F.lit("total").alias("kind"), F.col("status").alias("key")).agg(F.count("*").alias("n"))
    latest = t.deliveries.orderBy(F.desc("attempted_at"), F.col("id").cast("long").desc()).limit(10)
    return totals.union(latest.select(F.lit("latest"), "id", F.lit(1).cast("long")))


@query("cosponsor_counts", "SELECT s.bill_id, count(DISTINCT s.person_id) AS sponsors, count(DISTINCT CASE WHEN s.classification <> 'primary' THEN s.person_id END) AS cosponsors, count(DISTINCT CASE WHEN s.classification <> 'primary' AND p.party = 'D' THEN s.person_id END) AS democrats FROM v_sponsorships s JOIN v_people p ON p.id = s.person_id GROUP BY 1")
def cosponsor_counts(t: Tables) -> DataFrame:
    from statutory.operators.predict import cosponsor_counts as counts

    return counts(t.sponsorships, t.people)


@query("action_span", "SELECT bill_id, count(*) AS actions, min(action_date) AS first_date, max(action_date) AS last_date FROM v_bill_actions GROUP BY 1")
def action_span(t: Tables) -> DataFrame:
    return t.bill_actions.groupBy("bill_id").agg(F.count("*").alias("actions"), F.min("action_date").alias("first_date"), F.max("action_date").alias("last_date"))


@query("having_counts", "SELECT bill_id, count(*) AS n FROM v_vote_events GROUP BY 1 HAVING count(*) > 1")
def having_counts(t: Tables) -> DataFrame:
    return t.vote_events.groupBy("bill_id").agg(F.count("*").alias("n")).where("n > 1")


@query("best_status", "WITH s AS (SELECT bill_id, action_order, " + _status_sql("description") + " AS status FROM v_bill_actions), r AS (SELECT *, CASE " + " ".join(f"WHEN status = '{k}' THEN {v}" for k, v in T.STATUS_RANKS.items()) + " END AS rank FROM s) SELECT bill_id, status FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY rank DESC, action_order, status DESC) AS n FROM r) x WHERE n = 1")
def best_status(t: Tables) -> DataFrame:
    return A.best_status(t.bill_actions, T.norm_status("description"))


@query("introduced_backfill", "SELECT b.id, coalesce(CASE WHEN CAST(b.id AS BIGINT) % 2 = 0 THEN b.introduced_date END, a.d) AS introduced_date FROM v_bills b LEFT JOIN (SELECT bill_id, min(action_date) AS d FROM v_bill_actions GROUP BY 1) a ON a.bill_id = b.id")
def introduced_backfill(t: Tables) -> DataFrame:
    first = t.bill_actions.groupBy(F.col("bill_id").alias("id")).agg(F.min("action_date").alias("first_action"))
    known = F.when(F.col("id").cast("long") % 2 == 0, F.col("introduced_date"))
    return t.bills.join(first, "id", "left").select("id", F.coalesce(known, "first_action").alias("introduced_date"))


_PIVOT = "count(*) FILTER (WHERE option = 'yea') AS yea, count(*) FILTER (WHERE option = 'nay') AS nay, count(*) FILTER (WHERE option IN ('present', 'not_voting')) AS other, count(*) AS total"


@query("option_pivot", f"SELECT vote_event_id, {_PIVOT} FROM v_vote_records GROUP BY 1")
def option_pivot(t: Tables) -> DataFrame:
    return A.option_counts(t.vote_records, ["vote_event_id"])


_SUMMARY = "count(*) AS n, min(m) AS min, max(m) AS max, avg(m) AS mean, quantile_cont(m, 0.5) AS median, count(*) FILTER (WHERE m = 0) AS zeros, CAST(count(*) FILTER (WHERE m = 0) AS DOUBLE) / count(*) AS zero_share"


@query("int_summary", f"SELECT chamber, {_SUMMARY} FROM (SELECT chamber, yes_count - no_count AS m FROM v_vote_events) x WHERE m IS NOT NULL GROUP BY 1")
def int_summary(t: Tables) -> DataFrame:
    return A.int_summary(t.vote_events.withColumn("m", F.col("yes_count") - F.col("no_count")), ["chamber"], "m")


@query("characterize", f"WITH o AS (SELECT 'option' AS shape, option AS value, count(*) AS n, CAST(NULL AS DOUBLE) AS median FROM v_vote_records GROUP BY 2), s AS (SELECT vote_event_id, count(*) AS m FROM v_vote_records WHERE option = 'nay' GROUP BY 1) SELECT * FROM o UNION ALL SELECT 'set', 'size', count(*), quantile_cont(m, 0.5) FROM s UNION ALL SELECT 'field', 'yea', count(*), quantile_cont(y, 0.5) FROM (SELECT count(*) FILTER (WHERE option = 'yea') AS y FROM v_vote_records GROUP BY vote_event_id) f")
def characterize(t: Tables) -> DataFrame:
    records = t.vote_records
    options = records.groupBy(F.lit("option").alias("shape"), F.col("option").alias("value")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("median"))
    sizes = records.where("option = 'nay'").groupBy("vote_event_id").agg(F.count("*").alias("m"))
    fields = A.option_counts(records, ["vote_event_id"])
    row = lambda shape, value, rows, c: rows.agg(F.lit(shape).alias("shape"), F.lit(value).alias("value"), F.count("*").alias("n"), F.percentile(c, 0.5).alias("median"))
    return options.union(row("set", "size", sizes, "m")).union(row("field", "yea", fields, "yea"))


@query("top_members", "SELECT person_id, count(*) AS n FROM v_vote_records GROUP BY 1 ORDER BY n DESC, person_id LIMIT 10")
def top_members(t: Tables) -> DataFrame:
    return t.vote_records.groupBy("person_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person_id").limit(10)


@query("cost_totals", "SELECT model, template_id, count(*) AS runs, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(coalesce(cost, input_tokens * CASE model WHEN 'small' THEN 3e-6 ELSE 15e-6 END + output_tokens * CASE model WHEN 'small' THEN 15e-6 ELSE 75e-6 END)), 4) AS cost FROM v_traces GROUP BY 1, 2")
def cost_totals(t: Tables) -> DataFrame:
    return G.rollout_costs(t.traces).groupBy("model", "template_id").agg(
        F.count("*").alias("runs"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("usable_cost"), 4).alias("cost")
    )


@query("last_updated", "SELECT change_type, max(created_at) AS last_updated FROM v_change_events GROUP BY 1")
def last_updated(t: Tables) -> DataFrame:
    return t.change_events.groupBy("change_type").agg(F.max("created_at").alias("last_updated"))


@query("list_key", "SELECT id, array_to_string(list_sort(subject), ',') AS key FROM v_bills")
def list_key(t: Tables) -> DataFrame:
    return t.bills.select("id", T.list_key("subject").alias("key"))

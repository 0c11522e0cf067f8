"""Change tracking, alerts, queues and table maintenance over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.operators import changes as C
from statutory.operators import sinks as K
from statutory.plans.listing import _MATCH
from statutory.plans.registry import query
from statutory.plans.views import Tables


def _old(t: Tables) -> DataFrame:
    return t.bills.where(F.col("id").cast("long") % 5 != 0)


def _new(t: Tables) -> DataFrame:
    """Bills as a later run has them: some titles, statuses and subject orders changed, one date lost."""
    n = F.col("id").cast("long")
    return t.bills.withColumns({
        "title": F.when(n % 7 == 0, F.concat("title", F.lit(" (amended)"))).otherwise(F.col("title")),
        "status": F.when(n % 11 == 0, "enacted").otherwise(F.col("status")),
        "status_date": F.when(n % 13 != 0, F.col("status_date")),
        "subject": F.reverse("subject"),
    })


_NEW = "SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN title || ' (amended)' ELSE title END AS title, CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN 'enacted' ELSE status END AS status, CASE WHEN CAST(id AS BIGINT) % 13 <> 0 THEN status_date END AS status_date, list_reverse(subject) AS subject) FROM v_bills"
_OLD = "SELECT * FROM v_bills WHERE CAST(id AS BIGINT) % 5 <> 0"
_DIFF = f"""WITH n AS ({_NEW}), o AS ({_OLD}),
j AS (SELECT n.id, o.id IS NULL AS fresh, o.title AS t0, n.title AS t1, o.status AS s0, n.status AS s1, CAST(o.status_date AS VARCHAR) AS d0, CAST(n.status_date AS VARCHAR) AS d1, array_to_string(list_sort(o.subject), ',') AS b0, array_to_string(list_sort(n.subject), ',') AS b1 FROM n LEFT JOIN o ON o.id = n.id)
SELECT id AS bill_id, 'created' AS change_type, NULL AS field_name, NULL AS old_value, NULL AS new_value FROM j WHERE fresh
UNION ALL SELECT id, 'updated', 'title', t0, t1 FROM j WHERE NOT fresh AND t0 IS DISTINCT FROM t1
UNION ALL SELECT id, 'status_changed', 'status', s0, s1 FROM j WHERE NOT fresh AND s0 IS DISTINCT FROM s1
UNION ALL SELECT id, 'updated', 'status_date', d0, d1 FROM j WHERE NOT fresh AND d0 IS DISTINCT FROM d1
UNION ALL SELECT id, 'updated', 'subject', b0, b1 FROM j WHERE NOT fresh AND b0 IS DISTINCT FROM b1"""


@query("detect_changes", _DIFF)
def detect_changes(t: Tables) -> DataFrame:
    return C.detect_changes(_old(t), _new(t))


@query("old_values", f"WITH o AS ({_OLD}) SELECT b.id, o.title, o.status FROM v_bills b LEFT JOIN o ON o.id = b.id")
def old_values(t: Tables) -> DataFrame:
    return t.bills.select("id").join(_old(t).select("id", "title", "status"), "id", "left")


_ALERTS = "SELECT c.event_id, s.id AS search_id, c.bill_id, CASE c.change_type WHEN 'created' THEN 'bill.created' WHEN 'status_changed' THEN 'bill.status_changed' WHEN 'text_added' THEN 'bill.text_added' WHEN 'action_added' THEN 'bill.action_added' ELSE 'bill.updated' END AS event_type, b.title FROM v_change_events c JOIN v_bills b ON b.id = c.bill_id JOIN v_saved_searches s ON " + _MATCH + " WHERE s.alerts_enabled AND list_contains(s.event_types, CASE c.change_type WHEN 'created' THEN 'bill.created' WHEN 'status_changed' THEN 'bill.status_changed' WHEN 'text_added' THEN 'bill.text_added' WHEN 'action_added' THEN 'bill.action_added' ELSE 'bill.updated' END)"


@query("alert_matches", f"SELECT event_id, search_id, event_type FROM ({_ALERTS}) a")
def alert_matches(t: Tables) -> DataFrame:
    return C.alert_matches(t.change_events, t.saved_searches, t.bills).select("event_id", "search_id", "event_type")


@query("alert_payloads", f"SELECT event_id, search_id, event_type || '|' || bill_id || '|' || title AS digest FROM ({_ALERTS}) a")
def alert_payloads(t: Tables) -> DataFrame:
    """Payloads, read back from their JSON."""
    made = C.alert_matches(t.change_events, t.saved_searches, t.bills).select("event_id", "search_id", C.payload().alias("payload"))
    part = lambda p: F.get_json_object("payload", f"$.{p}")
    return made.select("event_id", "search_id", F.concat_ws("|", part("event_type"), part("bill_id"), part("title")).alias("digest"))


@query("due_deliveries", "SELECT id, attempted_at FROM v_deliveries WHERE status IN ('queued', 'failed') AND attempted_at <= TIMESTAMP '2024-06-01' ORDER BY attempted_at, CAST(id AS BIGINT) LIMIT 50")
def due_deliveries(t: Tables) -> DataFrame:
    return C.due_deliveries(t.deliveries, "2024-06-01").select("id", "attempted_at")


_DELAY = "list_extract([60, 300, 900, 3600, 7200, 14400, 28800, 57600], CAST(least(attempt_count + 1, 8) AS INT))"


@query("retry_schedule", f"SELECT id, CAST(attempt_count + 1 AS INT) AS attempt_count, CASE WHEN attempt_count + 1 >= 9 THEN 'dead_letter' ELSE 'failed' END AS status, CASE WHEN attempt_count + 1 < 9 THEN CAST(d + CAST('0x' || substr(sha256(id || ':' || CAST(attempt_count + 1 AS VARCHAR)), 1, 8) AS BIGINT) % CAST(d * 4 // 10 AS BIGINT) - d * 2 // 10 AS BIGINT) END AS delay_s FROM (SELECT *, {_DELAY} AS d FROM v_deliveries WHERE status = 'failed') x")
def retry_schedule(t: Tables) -> DataFrame:
    return C.retry_schedule(t.deliveries.where("status = 'failed'"))


@query("circuit_breaker", "WITH e AS (SELECT *, sum(CASE WHEN status = 'delivered' THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint_id ORDER BY attempted_at, CAST(id AS BIGINT) ROWS UNBOUNDED PRECEDING) AS run FROM v_deliveries WHERE status <> 'queued'), s AS (SELECT endpoint_id, run, count(*) FILTER (WHERE status <> 'delivered') AS n FROM e GROUP BY 1, 2) SELECT endpoint_id, max(n) AS longest, arg_max(n, run) AS current, max(n) >= 5 AS disabled FROM s GROUP BY 1")
def circuit_breaker(t: Tables) -> DataFrame:
    return C.circuit_breaker(t.deliveries)


@query("analysis_pending", "SELECT DISTINCT least(bill_id_a, bill_id_b) AS a, greatest(bill_id_a, bill_id_b) AS b FROM v_bill_similarities WHERE similarity_score > 0.5 AND (CAST(least(bill_id_a, bill_id_b) AS BIGINT) % 3 <> 0)")
def analysis_pending(t: Tables) -> DataFrame:
    """Pairs, whatever their order, that no cached analysis covers."""
    pairs = t.bill_similarities.where("similarity_score > 0.5").select(F.least("bill_id_a", "bill_id_b").alias("a"), F.greatest("bill_id_a", "bill_id_b").alias("b")).distinct()
    done = pairs.where(F.col("a").cast("long") % 3 == 0)
    return C.pending(pairs, done, ["a", "b"])


@query("upsert_merge", f"WITH o AS ({_OLD}), n AS (SELECT * FROM ({_NEW}) y WHERE CAST(id AS BIGINT) % 4 <> 1) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.identifier ELSE o.identifier END AS identifier, CASE WHEN n.id IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NULL THEN o.status_date ELSE n.status_date END AS status_date FROM o FULL JOIN n ON n.id = o.id")
def upsert_merge(t: Tables) -> DataFrame:
    columns = ["id", "identifier", "title", "status_date"]
    new = _new(t).where(F.col("id").cast("long") % 4 != 1).select(*columns)
    return C.upsert(_old(t).select(*columns), new, ["id"], ["title", "status_date"])


@query("upsert_coalesce", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.status_date ELSE coalesce(n.status_date, o.status_date) END AS status_date FROM o FULL JOIN n ON n.id = o.id")
def upsert_coalesce(t: Tables) -> DataFrame:
    return C.upsert(_old(t).select("id", "status_date"), _new(t).select("id", "status_date"), ["id"], ["status_date"], keep_old_values=True)


@query("insert_ignore", "SELECT bill_id, person_id FROM (SELECT DISTINCT bill_id, person_id FROM v_sponsorships) x")
def insert_ignore(t: Tables) -> DataFrame:
    keys = ["bill_id", "person_id"]
    rows = t.sponsorships.select(*keys)
    old = rows.where(F.col("person_id").cast("long") % 3 == 0).distinct()
    return C.insert_ignore(old, rows, keys)


@query("export_csv", "SELECT id, identifier, title, coalesce(array_to_string(subject, '; '), '') AS subject FROM v_bills WHERE status = 'enacted' ORDER BY created_at DESC, id LIMIT 5000")
def export_csv(t: Tables) -> DataFrame:
    return K.bill_export(t.bills.where("status = 'enacted'"))


@query("export_brief", "SELECT b.id AS bill_id, '# ' || b.identifier || chr(10) || b.title || chr(10) || chr(10) || '## Sponsors' || chr(10) || coalesce((SELECT string_agg('- ' || p.name || ' (' || s.classification || ')', chr(10) ORDER BY s.classification, p.name, s.person_id) FROM v_sponsorships s JOIN v_people p ON p.id = s.person_id WHERE s.bill_id = b.id), '') || chr(10) || chr(10) || '## History' || chr(10) || coalesce((SELECT string_agg('- ' || CAST(a.action_date AS VARCHAR) || ': ' || a.description, chr(10) ORDER BY a.action_date, a.action_order, a.description) FROM v_bill_actions a WHERE a.bill_id = b.id), '') AS brief FROM v_bills b")
def export_brief(t: Tables) -> DataFrame:
    return K.bill_briefs(t.bills, t.sponsorships, t.people, t.bill_actions)


@query("export_trend", "SELECT CAST(date_trunc('year', introduced_date) AS DATE) AS period, status, count(*) AS count FROM v_bills WHERE status IS NOT NULL GROUP BY 1, 2")
def export_trend(t: Tables) -> DataFrame:
    """Chosen columns of a trend, written as CSV to the shared folder and read back."""
    from statutory.operators.aggregates import count_by_period

    counts = count_by_period(t.bills.where("status is not null"), "introduced_date", F.col("status"), "year").withColumnRenamed("dimension", "status")
    return K.through_csv(counts.select("period", "status", "count"))


@query("export_traces", "SELECT template_id, instance_id, array_to_string(list_sort(list(DISTINCT answer)), ',') AS answers FROM v_traces GROUP BY 1, 2")
def export_traces(t: Tables) -> DataFrame:
    """Sets as sorted lists, written as JSON lines and read back."""
    rows = t.traces.groupBy("template_id", "instance_id").agg(F.array_sort(F.collect_set("answer")).alias("answers"))
    return K.through_json(rows).select("template_id", "instance_id", F.array_join("answers", ",").alias("answers"))


@query("rebuild_slice", "SELECT session_id, id, CASE WHEN session_id = 'us-111' THEN title || '!' ELSE title END AS title FROM v_bills")
def rebuild_slice(t: Tables) -> DataFrame:
    """A table by session, of which one session is written anew."""
    columns = t.bills.select("id", "title", "session_id")
    fresh = columns.where("session_id = 'us-111'").withColumn("title", F.concat("title", F.lit("!")))
    return K.rebuilt(columns, fresh, "session_id").select("session_id", "id", "title")


@query("replace_table", "SELECT person_id, party, start_date, end_date FROM v_party_spans")
def replace_table(t: Tables) -> DataFrame:
    """Spans, written only if none overlap."""
    from statutory.operators.windows import overlapping_spans

    return K.replaced(t.party_spans, overlapping_spans)

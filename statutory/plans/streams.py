"""Streams over the change events, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.operators.keyed import KeyedTable
from statutory.operators.sinks import shared_folder
from statutory.plans.changes import _ALERTS
from statutory.plans.registry import query
from statutory.plans.views import Tables
from statutory.streaming import jobs


@query("stream_trend", "SELECT CAST(created_at AS DATE) AS day, change_type AS dimension, count(*) AS count FROM v_change_events GROUP BY 1, 2")
def stream_trend(t: Tables) -> DataFrame:
    """Updates of every window; the last one of each is what a batch job counts."""
    stream = jobs.trend(jobs.replay(t.change_events, 3), "created_at", "change_type", "1 day", "3650 days")
    found = jobs.drain(stream, mode="update")
    return found.groupBy(F.to_date("period").alias("day"), "dimension").agg(F.max_by("count", "batch").alias("count"))


@query("stream_changes", "SELECT bill_id, event_id, old_value, new_value FROM (SELECT bill_id, event_id, lag(change_type) OVER (PARTITION BY bill_id ORDER BY created_at, event_id) AS old_value, change_type AS new_value FROM v_change_events) x WHERE old_value IS DISTINCT FROM new_value")
def stream_changes(t: Tables) -> DataFrame:
    stream = jobs.changes(jobs.replay(t.change_events), "bill_id", ["created_at", "event_id"], "change_type")
    return jobs.drain(stream).drop("batch")


@query("stream_alerts", f"SELECT event_id, search_id, event_type FROM ({_ALERTS}) a")
def stream_alerts(t: Tables) -> DataFrame:
    out = shared_folder(t.spark)
    batch = jobs.alert_batch(t.saved_searches, t.bills, out)
    return jobs.drain(jobs.replay(t.change_events, 2), batch, out=out).select("event_id", "search_id", "event_type")


@query("stream_upsert", "SELECT event_id, bill_id FROM v_change_events")
def stream_upsert(t: Tables) -> DataFrame:
    """Every event comes twice and is kept once."""
    rows = t.change_events.select("event_id", "bill_id", "created_at")
    stream = jobs.once_per_key(jobs.replay(rows.union(rows), 3), "created_at", ["event_id"], "3650 days")
    table = KeyedTable(t.spark, shared_folder(t.spark), stream.select("event_id", "bill_id").schema.toDDL(), ["event_id"])
    jobs.run_to_end(stream.select("event_id", "bill_id"), jobs.upsert_batch(table, 2))
    return table.read()

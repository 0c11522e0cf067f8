"""Hearings, regulations, reports, workspaces and collections, derived from the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statutory.operators import listing as L
from statutory.operators import sinks as K
from statutory.plans.registry import query
from statutory.plans.views import Tables
from statutory.sources import formats as S


def _hearings(t: Tables) -> tuple[DataFrame, DataFrame]:
    """One hearing for every bill and its successor by id."""
    n = F.col("id").cast("long")
    refs = F.array("id", (n + 1).cast("string"))
    made = F.to_json(F.struct(F.concat(F.lit("h"), "id").alias("id"), F.lit("Rules").alias("committee"), F.lit("H").alias("chamber"), "title", F.col("introduced_date").cast("string").alias("date"), refs.alias("bills")))
    return S.hearings(t.bills.select(made.alias("json")), t.bills.select("id", F.col("id").alias("congress_bill_id")))


@query("hearings_for_bill", "WITH l AS (SELECT 'h' || a.id AS id, b.id AS bill_id, a.introduced_date AS d FROM v_bills a JOIN v_bills b ON CAST(b.id AS BIGINT) IN (CAST(a.id AS BIGINT), CAST(a.id AS BIGINT) + 1)) SELECT bill_id, id, CAST(row_number() OVER (PARTITION BY bill_id ORDER BY d DESC NULLS LAST, id) AS INT) AS rank FROM l")
def hearings_for_bill(t: Tables) -> DataFrame:
    rows, links = _hearings(t)
    return L.hearings_for_bill(rows, links).select("bill_id", "id", "rank")


def _documents(t: Tables) -> DataFrame:
    agency = F.struct(F.concat(F.lit("Agency of "), "jurisdiction_id").alias("name"))
    made = F.struct(F.col("id").alias("document_number"), F.lit("Rule").alias("type"), "title", F.col("introduced_date").cast("string").alias("publication_date"), F.array(agency).alias("agencies"))
    return S.regulatory(t.bills.select(F.to_json(made).alias("json")))


@query("list_regulatory", "SELECT id, introduced_date AS publication_date FROM v_bills WHERE contains('agency of ' || jurisdiction_id, 'of j1') ORDER BY introduced_date DESC, id LIMIT 200")
def list_regulatory(t: Tables) -> DataFrame:
    return L.list_regulatory(_documents(t), agency="OF J1", kind="rule").select("id", "publication_date").limit(200)


@query("list_reports", "SELECT id, title FROM v_bills WHERE contains(lower(title), 'machinery') AND CAST(id AS BIGINT) % 2 = 0 ORDER BY introduced_date DESC NULLS LAST, id LIMIT 100")
def list_reports(t: Tables) -> DataFrame:
    rows = t.bills.select(
        "id", "title", F.lit("").alias("summary"), F.array(F.when(F.col("id").cast("long") % 2 == 0, "A. Writer").otherwise("B. Writer")).alias("authors"),
        F.col("subject").alias("topics"), F.array("id").alias("related_bill_ids"), F.col("introduced_date").alias("publication_date"),
    )
    return L.list_reports(rows, author="a. writer", text="MACHINERY").select("id", "title").limit(100)


@query("precedent_insights", "WITH s AS (SELECT bill_id, arg_max(props, struct_pack(a := created_at, b := props)) AS summary FROM v_change_events WHERE value > 3 AND props IS NOT NULL GROUP BY 1) SELECT b.jurisdiction_id AS workspace_id, CAST(row_number() OVER (PARTITION BY b.jurisdiction_id ORDER BY CAST(b.id AS BIGINT)) AS INT) AS position, b.id AS bill_id, b.identifier, s.summary FROM v_bills b LEFT JOIN s ON s.bill_id = b.id WHERE b.status = 'enacted'")
def precedent_insights(t: Tables) -> DataFrame:
    """Enacted bills of a jurisdiction as its precedents, with their latest summary."""
    place = F.row_number().over(Window.partitionBy("jurisdiction_id").orderBy(F.col("id").cast("long")))
    precedents = t.bills.where("status = 'enacted'").select(F.col("jurisdiction_id").alias("workspace_id"), place.alias("position"), F.col("id").alias("bill_id"))
    held = t.change_events.where("value > 3 and props is not null")
    summaries = held.groupBy("bill_id").agg(F.max_by("props", F.struct("created_at", "props")).alias("summary"))
    scores = t.bills.where("1 = 0").select(F.col("id").alias("bill_id"), F.lit(0.0).alias("score"))
    out = L.precedent_insights(precedents, t.bills, summaries, scores)
    return out.select("workspace_id", "position", "bill_id", "identifier", "summary")


@query("export_workspace", "SELECT j.id, '# ' || j.name || coalesce(chr(10) || chr(10) || (SELECT string_agg('## ' || b.identifier || chr(10) || chr(10) || b.title, chr(10) || chr(10) ORDER BY CAST(b.id AS BIGINT)) FROM v_bills b WHERE b.jurisdiction_id = j.id AND b.status = 'failed'), '') AS markdown FROM v_jurisdictions j")
def export_workspace(t: Tables) -> DataFrame:
    """A jurisdiction as a workspace, its failed bills as sections."""
    sections = t.bills.where("status = 'failed'").select(F.col("jurisdiction_id").alias("workspace_id"), F.col("id").cast("long").alias("position"), F.col("identifier").alias("heading"), F.col("title").alias("markdown"))
    return K.workspace_markdown(t.jurisdictions.select("id", F.col("name").alias("title")), sections)


@query("export_collection", "SELECT s.id AS collection_id, '# ' || s.id || chr(10) || chr(10) || '## Bills' || chr(10) || coalesce((SELECT string_agg('- ' || b.identifier || ': ' || b.title, chr(10) ORDER BY b.identifier, b.title) FROM v_bills b WHERE b.status = 'enacted' AND b.jurisdiction_id = 'j' || substr(s.id, 2)), '') || chr(10) || chr(10) || '## Artifacts' || chr(10) || coalesce((SELECT string_agg('### ' || id || chr(10) || props, chr(10) || chr(10) ORDER BY n) FROM (SELECT CAST(event_id AS VARCHAR) AS id, coalesce(props, '') AS props, CAST(bill_id AS BIGINT) % 25 AS c, row_number() OVER (PARTITION BY CAST(bill_id AS BIGINT) % 25 ORDER BY created_at DESC, event_id DESC) AS n FROM v_change_events) e WHERE e.c = CAST(substr(s.id, 2) AS BIGINT) AND n <= 10), '') AS markdown FROM v_saved_searches s")
def export_collection(t: Tables) -> DataFrame:
    """A saved search as a collection: enacted bills of its jurisdiction, and change events as artifacts."""
    collections = t.saved_searches.select("id", F.col("id").alias("name"))
    key = F.concat(F.lit("s"), F.expr("substr(jurisdiction_id, 2)"))
    items = t.bills.where("status = 'enacted'").select(key.alias("collection_id"), F.col("id").alias("bill_id"), F.lit(None).cast("string").alias("notes"))
    artifacts = t.change_events.select(
        F.concat(F.lit("s"), (F.col("bill_id").cast("long") % 25).cast("string")).alias("collection_id"), F.col("event_id").alias("id"), "created_at",
        F.col("event_id").cast("string").alias("title"), F.coalesce("props", F.lit("")).alias("markdown"),
    )
    return K.collection_brief(collections, items, t.bills, artifacts)

"""The legislative tables as SQL views over the base tables.

One text per view, which runs unchanged in Spark SQL and in DuckDB. `Tables` gives the
views and the base tables as DataFrames; `with_views` puts the views that a DuckDB text
reads before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations", "labels", "benchmark")

VIEWS: dict[str, str] = {
    "v_jurisdictions": """
SELECT 'j' || CAST(n_nationkey AS STRING) AS id, n_name AS name,
       CASE WHEN n_regionkey = 1 THEN 'country' ELSE 'state' END AS classification,
       substr(n_name, 1, 2) AS abbreviation
FROM nation""",
    "v_sessions": """
SELECT 'us-' || CAST(year(o_orderdate) - 1885 AS STRING) AS id,
       CAST(year(o_orderdate) - 1885 AS STRING) AS identifier,
       CAST(min(o_orderdate) AS DATE) AS start_date,
       CASE WHEN year(o_orderdate) < 2001 THEN CAST(max(o_orderdate) AS DATE) END AS end_date
FROM orders GROUP BY year(o_orderdate)""",
    "v_bills": """
SELECT CAST(o_orderkey AS STRING) AS id, 'j' || CAST(c_nationkey AS STRING) AS jurisdiction_id,
       'us-' || CAST(year(o_orderdate) - 1885 AS STRING) AS session_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'HR' ELSE 'S' END || CAST(o_orderkey AS STRING) AS identifier,
       'An act to authorize ' || lower(c_mktsegment) || ' (' || substr(o_orderpriority, 3) || ')' AS title,
       CASE o_orderkey % 8 WHEN 0 THEN 'introduced' WHEN 1 THEN 'in_committee' WHEN 2 THEN 'passed_lower'
            WHEN 3 THEN 'passed_upper' WHEN 4 THEN 'enacted' WHEN 5 THEN 'failed' WHEN 6 THEN 'other' END AS status,
       CASE WHEN o_orderkey % 10 <> 9 THEN CAST(o_orderdate AS DATE) END AS status_date,
       CAST(o_orderdate AS DATE) AS introduced_date,
       CASE WHEN o_orderkey % 13 <> 0
            THEN split(lower(c_mktsegment) || ',' || lower(substr(o_orderpriority, 3)), ',') END AS subject,
       split(CASE WHEN o_orderkey % 3 = 0 THEN 'resolution' ELSE 'bill' END, ',') AS classification,
       CAST(CAST(o_orderdate AS DATE) + (o_orderkey % 40) * INTERVAL '1' DAY AS TIMESTAMP) AS created_at
FROM orders JOIN customer ON c_custkey = o_custkey""",
    "v_people": """
SELECT CAST(s_suppkey AS STRING) AS id, 'Rep. ' || s_name || ' [X-' || CAST(s_nationkey AS STRING) || ']' AS name,
       CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'R' ELSE 'D' END
            WHEN s_suppkey % 2 = 0 THEN 'D' WHEN s_suppkey % 9 = 1 THEN 'ID' ELSE 'R' END AS party,
       'j' || CAST(s_nationkey AS STRING) AS current_jurisdiction_id,
       CASE WHEN s_suppkey % 3 = 0 THEN 'upper' ELSE 'lower' END AS current_chamber
FROM supplier""",
    "v_party_spans": """
SELECT CAST(s_suppkey AS STRING) AS person_id,
       CASE WHEN s_suppkey % 2 = 0 THEN 'D' WHEN s_suppkey % 9 = 1 THEN 'I' ELSE 'R' END AS party,
       DATE '1990-01-01' AS start_date,
       CASE WHEN s_suppkey % 5 = 0 THEN DATE '1998-03-15' WHEN s_suppkey % 37 = 36 THEN DATE '2000-01-01'
            ELSE DATE '2003-01-01' END AS end_date
FROM supplier
UNION ALL
SELECT CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 2 = 0 THEN 'R' ELSE 'D' END,
       DATE '1998-03-15', DATE '2003-01-01'
FROM supplier WHERE s_suppkey % 5 = 0""",
    "v_vote_records": """
SELECT 'e' || CAST(l_partkey AS STRING) AS vote_event_id, CAST(l_suppkey AS STRING) AS person_id,
       min(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 1 THEN 'present'
                WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 'not_voting'
                WHEN l_quantity <= 20 THEN 'nay' ELSE 'yea' END) AS option
FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "v_vote_events": """
SELECT 'e' || CAST(p_partkey AS STRING) AS id, CAST(o_orderkey AS STRING) AS bill_id,
       CAST(CAST(o_orderdate AS DATE) + ((p_partkey * 37) % 120) * INTERVAL '1' DAY AS DATE) AS vote_date,
       CASE WHEN p_partkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber,
       p_name AS motion_text,
       CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN y > n THEN 'Passed' ELSE 'Failed' END AS result,
       CASE WHEN year(o_orderdate) IN (1997, 2000) AND p_partkey % 19 = 0 THEN NULL
            WHEN year(o_orderdate) IN (1997, 2000) AND p_partkey % 17 = 0 THEN y - 1 ELSE y END AS yes_count,
       CASE WHEN year(o_orderdate) IN (1997, 2000) AND p_partkey % 23 = 0 THEN n + 2 ELSE n END AS no_count,
       o AS other_count
FROM part
JOIN orders ON o_orderkey = CASE WHEN p_partkey % 3 = 2 THEN p_partkey - 1 ELSE p_partkey END
JOIN (SELECT vote_event_id, count(CASE WHEN option = 'yea' THEN 1 END) AS y,
             count(CASE WHEN option = 'nay' THEN 1 END) AS n,
             count(CASE WHEN option IN ('present', 'not_voting') THEN 1 END) AS o
      FROM v_vote_records GROUP BY vote_event_id) t
  ON t.vote_event_id = 'e' || CAST(p_partkey AS STRING)""",
    "v_sponsorships": """
SELECT DISTINCT CAST(l_orderkey AS STRING) AS bill_id, CAST(l_suppkey AS STRING) AS person_id,
       CASE WHEN l_linenumber = 1 THEN 'primary' WHEN l_linenumber % 2 = 0 THEN 'cosponsor'
            ELSE 'original-cosponsor' END AS classification
FROM lineitem""",
    "v_bill_actions": """
SELECT CAST(l_orderkey AS STRING) AS bill_id, CAST(l_shipdate AS DATE) AS action_date,
       CASE l_linenumber WHEN 1 THEN 'Introduced in House' WHEN 2 THEN 'Referred to the Committee on ' || l_returnflag
            WHEN 3 THEN 'Passed House' WHEN 4 THEN 'Passed Senate' WHEN 5 THEN 'Became Public Law'
            ELSE 'Failed in committee' END AS description,
       CASE WHEN l_linenumber <> 6 THEN split(lower(l_returnflag) || ',' || lower(l_linestatus), ',') END AS classification,
       CASE WHEN l_partkey % 3 = 0 THEN 'upper' WHEN l_partkey % 3 = 1 THEN 'lower' END AS chamber,
       l_linenumber AS action_order
FROM lineitem""",
    "v_bill_texts": """
SELECT CAST(doc_id AS STRING) AS id, CAST(doc_id - doc_id % 2 AS STRING) AS bill_id,
       CASE WHEN doc_id % 2 = 0 THEN 'Introduced' ELSE 'Engrossed' END AS version_name,
       CAST(DATE '2024-01-01' + (doc_id % 365) * INTERVAL '1' DAY AS DATE) AS version_date,
       text AS content_text, lang, source
FROM documents""",
    "v_bill_embeddings": """
SELECT CAST(vec_id AS STRING) AS bill_id, embedding, 'j' || CAST(label AS STRING) AS jurisdiction_id
FROM embeddings""",
    "v_change_events": """
SELECT event_id, CAST(user_id AS STRING) AS bill_id, ts AS created_at,
       CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'status_changed' WHEN 'view' THEN 'updated'
            WHEN 'click' THEN 'text_added' ELSE 'action_added' END AS change_type, value, props
FROM events""",
    "v_bill_similarities": """
SELECT CAST(l_partkey AS STRING) AS bill_id_a, CAST(l_orderkey AS STRING) AS bill_id_b,
       'semantic' AS similarity_type, max(l_quantity / 50) AS similarity_score
FROM lineitem WHERE l_partkey < l_orderkey AND l_linenumber = 1 GROUP BY l_partkey, l_orderkey""",
    "v_saved_searches": """
SELECT 's' || CAST(n_nationkey AS STRING) AS id, n_regionkey AS org_id, n_nationkey % 4 <> 3 AS alerts_enabled,
       CASE WHEN n_nationkey % 3 = 0 THEN 'j' || CAST(n_nationkey AS STRING) END AS jurisdiction_id,
       CASE WHEN n_nationkey % 2 = 0 THEN 'enacted' END AS status,
       CASE WHEN n_nationkey % 5 = 1 THEN 'MACHINERY' END AS query,
       split(CASE WHEN n_nationkey % 2 = 0 THEN 'bill.created,bill.status_changed' ELSE 'bill.updated' END, ',') AS event_types
FROM nation""",
    "v_deliveries": """
SELECT CAST(event_id AS STRING) AS id, 'w' || CAST(user_id % 20 AS STRING) AS endpoint_id, ts AS attempted_at,
       CASE WHEN event_id % 7 = 0 THEN 'delivered' WHEN event_id % 11 = 0 THEN 'queued' WHEN event_id % 31 = 0 THEN 'dead_letter'
            ELSE 'failed' END AS status,
       CAST(event_id % 10 AS INT) AS attempt_count
FROM events""",
    "v_traces": """
SELECT event_type AS template_id, CAST(user_id AS STRING) AS instance_id,
       CASE WHEN event_id % 2 = 0 THEN 'small' ELSE 'large' END AS model,
       CASE WHEN event_id % 3 = 0 THEN 'web' ELSE 'ours' END AS surface,
       event_id % 29 = 0 AS is_refusal,
       CASE WHEN event_id % 17 = 0 THEN 'agent_infra' WHEN event_id % 13 = 0 THEN 'timeout' ELSE 'success' END AS result_subtype,
       CASE WHEN event_id % 19 = 0 THEN 'not_in_the_data' WHEN value > 8 THEN 'yea' ELSE 'nay' END AS answer,
       CASE WHEN event_id % 29 = 0 THEN 'not_in_the_data' WHEN event_id % 5 = 0 THEN 'nay' ELSE 'yea' END AS gold,
       CASE WHEN event_id % 23 <> 0 THEN value END AS cost, event_id * 3 AS input_tokens, event_id AS output_tokens
FROM events""",
}

_READ = re.compile(r"\b(?:FROM|JOIN|,)\s+(" + "|".join([*VIEWS, *BASE]) + r")\b", re.I)


class Tables:
    """Base tables and views of one data folder; `tables.bills` is the view v_bills, `tables.orders` the base table."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if f"v_{name}" in VIEWS:
            return self._view(f"v_{name}")
        raise AttributeError(name)

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        reads = set(_READ.findall(text))
        frames = {r: self._view(r) if r in VIEWS else getattr(self, r) for r in reads}
        return self.spark.sql(_READ.sub(lambda m: m[0][: -len(m[1])] + "{" + m[1] + "}", text), **frames)


def with_views(sql: str) -> str:
    """The text with the definitions of the views that it reads, in their order."""
    needed: set[str] = set()
    todo = set(re.findall(r"\bv_\w+", sql))
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= set(re.findall(r"\bv_\w+", VIEWS[name])) - needed
    if not needed:
        return sql
    parts = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in needed)
    body = sql.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            return f"{opening}{parts}, {body[len(opening):]}"
    return f"WITH {parts} {body}"

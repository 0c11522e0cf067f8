"""Raw formats: views rendered to the sources' files and parsed back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutory.operators.sinks import shared_folder
from statutory.plans.registry import query
from statutory.plans.views import Tables
from statutory.sources import formats as S


def _escaped(c: str) -> Column:
    return F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def _number(c: str) -> Column:
    return F.regexp_extract(c, r"(\d+)$", 1)


@query("src_bill_xml", "SELECT identifier, 118 AS congress, title, introduced_date, coalesce(array_to_string(subject, ','), '') AS subjects, (SELECT count(*) FROM v_bill_actions a WHERE a.bill_id = b.id) AS actions FROM v_bills b")
def src_bill_xml(t: Tables) -> DataFrame:
    actions = t.bill_actions.groupBy(F.col("bill_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<item><actionDate>"), F.col("action_date").cast("string"), F.lit("</actionDate><text>"), F.col("description"), F.lit("</text></item>")))), "").alias("items"))
    bills = t.bills.join(actions, "id", "left")
    kind, number = F.regexp_extract("identifier", r"^([A-Z]+)", 1), _number("identifier")
    odd = F.col("id").cast("long") % 2 == 1
    head = F.when(odd, F.concat(_tag("billType", kind), _tag("billNumber", number))).otherwise(F.concat(_tag("type", kind), _tag("number", number)))
    subjects = F.array_join(F.transform(F.coalesce("subject", F.array().cast("array<string>")), lambda s: F.concat(F.lit("<item><name>"), s, F.lit("</name></item>"))), "")
    xml = F.concat(F.lit("<bill>"), head, _tag("congress", F.lit("118")), _tag("title", _escaped("title")), _tag("introducedDate", F.col("introduced_date").cast("string")), _tag("subjects", subjects), _tag("actions", F.coalesce("items", F.lit(""))), F.lit("</bill>"))
    parsed = S.bill_status(bills.select(xml.alias("xml")))
    return parsed.select("identifier", "congress", "title", "introduced_date", F.array_join("subject", ",").alias("subjects"), F.size("actions").cast("long").alias("actions"))


_SAID = "CASE option WHEN 'yea' THEN 'Aye' WHEN 'nay' THEN 'No' WHEN 'present' THEN 'Present' ELSE 'Not Voting' END"
_CASTS = "SELECT CAST(substr(r.vote_event_id, 2) AS INT) AS {n}, e.vote_date, r.person_id AS member, r.option FROM v_vote_records r JOIN v_vote_events e ON e.id = r.vote_event_id WHERE e.chamber = '{c}'"


def _roll_calls(t: Tables, chamber: str, cast) -> DataFrame:
    events = t.vote_events.where(F.col("chamber") == chamber).select(F.col("id").alias("vote_event_id"), "vote_date")
    return t.vote_records.join(events, "vote_event_id").groupBy("vote_event_id", "vote_date").agg(F.array_join(F.collect_list(cast), "").alias("casts"))


@query("src_house_xml", _CASTS.format(n="roll", c="house"))
def src_house_xml(t: Tables) -> DataFrame:
    cast = F.concat(F.lit('<recorded-vote><legislator name-id="'), "person_id", F.lit('">X</legislator><vote>'), F.expr(_SAID), F.lit("</vote></recorded-vote>"))
    rolls = _roll_calls(t, "house", cast)
    meta = F.concat(_tag("congress", F.lit("118")), _tag("rollcall-num", F.expr("substr(vote_event_id, 2)")), _tag("legis-num", F.lit("H R 1")), _tag("action-date", F.date_format("vote_date", "d-MMM-yyyy")), _tag("vote-result", F.lit("Passed")))
    xml = F.concat(F.lit("<rollcall-vote>"), _tag("vote-metadata", meta), _tag("vote-data", F.col("casts")), F.lit("</rollcall-vote>"))
    return S.house_votes(rolls.select(xml.alias("xml"))).select("roll", "vote_date", "member", "option")


@query("src_senate_xml", _CASTS.format(n="number", c="senate"))
def src_senate_xml(t: Tables) -> DataFrame:
    said = F.expr("CASE option WHEN 'yea' THEN 'Yea' WHEN 'nay' THEN 'Nay' WHEN 'present' THEN 'Present' ELSE 'Absent' END")
    cast = F.concat(F.lit("<member><lis_member_id>"), "person_id", F.lit("</lis_member_id><vote_cast>"), said, F.lit("</vote_cast></member>"))
    rolls = _roll_calls(t, "senate", cast)
    xml = F.concat(F.lit("<roll_call_vote>"), _tag("congress", F.lit("118")), _tag("session", F.lit("1")), _tag("vote_number", F.expr("substr(vote_event_id, 2)")), _tag("vote_date", F.date_format("vote_date", "MMMM d, yyyy',  10:00 AM'")), _tag("vote_result", F.lit("Passed")), _tag("members", F.col("casts")), F.lit("</roll_call_vote>"))
    return S.senate_votes(rolls.select(xml.alias("xml"))).select("number", "vote_date", "member", "option")


def _zipped(rows: DataFrame) -> DataFrame:
    """One ZIP per Arrow batch of rows (name, body)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                for name, body in zip(frame["name"], frame["body"], strict=True):
                    archive.writestr(name, body)
            yield pd.DataFrame({"content": [held.getvalue()]})

    return rows.select("name", "body").mapInPandas(run, "content binary")


@query("src_text_zip", "SELECT 119 AS congress, 'hr' AS doc_class, id AS number, 'Introduced in House' AS version_name, 'Sec. 1.' || chr(10) || title || chr(10) || '(a) In' || chr(10) || 'general' || chr(10) || id AS text FROM v_bills WHERE CAST(id AS BIGINT) % 3 <> 0")
def src_text_zip(t: Tables) -> DataFrame:
    """Bills as packages of XML in ZIPs; every third is another version and is left out."""
    version = F.when(F.col("id").cast("long") % 3 == 0, "rih").otherwise("ih")
    opening = "<bill xmlns:dc='d'><metadata><dc:date>2025-01-01</dc:date></metadata><section><enum> Sec. \t1.</enum><header>"
    body = F.concat(F.lit(opening), _escaped("title"), F.lit("</header>\n  <text>(a) In \n<em>general</em> </text><meta>"), "id", F.lit("</meta></section></bill>"))
    return S.text_zips(_zipped(t.bills.select(F.concat(F.lit("BILLS-119hr"), "id", version, F.lit(".xml")).alias("name"), body.alias("body"))))


@query("src_bill_zip", "SELECT CAST(id AS BIGINT) AS bill_id, identifier, 'ca' AS state, title, CAST(CAST(id AS BIGINT) % 7 AS VARCHAR) AS status_code, CAST(7 AS BIGINT) AS session_id FROM v_bills WHERE CAST(id AS BIGINT) % 4 <> 0")
def src_bill_zip(t: Tables) -> DataFrame:
    n = F.col("id").cast("long")
    state = F.when(n % 4 != 0, "CA")
    bill = F.struct(n.alias("bill_id"), F.lower("identifier").alias("number"), state.alias("state"), "title", (n % 7).cast("int").alias("status"), F.struct(F.lit(7).alias("session_id")).alias("session"))
    return S.bill_zips(_zipped(t.bills.select(F.concat("id", F.lit(".json")).alias("name"), F.to_json(F.struct(bill.alias("bill"))).alias("body"))))


@query("src_regulatory", "SELECT id, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'proposed_rule' ELSE 'other kind' END AS document_type, title, introduced_date AS publication_date, jurisdiction_id AS agencies, CAST(1 AS BIGINT) AS n_cfr FROM v_bills")
def src_regulatory(t: Tables) -> DataFrame:
    n = F.col("id").cast("long") % 3
    made = F.struct(
        F.col("id").alias("document_number"), F.when(n == 0, "Rule").when(n == 1, "Proposed Rule").otherwise("Other Kind").alias("type"), "title", F.col("introduced_date").cast("string").alias("publication_date"),
        F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("jurisdiction_id").alias("raw_name")), F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("raw_name"))).alias("agencies"),
        F.array(F.struct(F.lit(40).alias("title"), F.lit("52").alias("part")), F.struct(F.lit(41).alias("title"), F.lit(None).cast("string").alias("part"))).alias("cfr_references"),
    )
    out = S.regulatory(t.bills.select(F.to_json(made).alias("json")))
    return out.select("id", "document_type", "title", "publication_date", F.array_join("agency_names", ",").alias("agencies"), F.size("cfr_references").cast("long").alias("n_cfr"))


@query("src_reports", "SELECT id, title, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'A. Writer' ELSE 'B. Writer' END AS authors, introduced_date AS publication_date, CAST(introduced_date + INTERVAL 30 DAY AS DATE) AS updated_date FROM v_bills")
def src_reports(t: Tables) -> DataFrame:
    """Reports whose authors are strings in one half and objects in the other."""
    day = lambda n: F.concat(F.lit('{"date": "'), F.date_add("introduced_date", n).cast("string"), F.lit('"}'))
    authors = F.when(F.col("id").cast("long") % 2 == 0, F.lit('["A. Writer"]')).otherwise(F.lit('[{"name": "B. Writer"}]'))
    made = F.concat(F.lit('{"id": "'), "id", F.lit('", "title": "'), "title", F.lit('", "authors": '), authors, F.lit(', "topics": [], "versions": ['), day(30), F.lit(", "), day(0), F.lit("]}"))
    out = S.reports(t.bills.select(made.alias("json")))
    return out.select("id", "title", F.array_join("authors", ",").alias("authors"), "publication_date", "updated_date")


@query("src_hearings", "SELECT 'h' || id AS hearing_id, id AS bill_id FROM v_bills")
def src_hearings(t: Tables) -> DataFrame:
    """Hearings, each on one known bill (named twice) and one unknown one: the links."""
    committee = F.when(F.col("id").cast("long") % 2 == 0, F.lit('"Rules"')).otherwise(F.lit('{"name": "Rules"}'))
    made = F.concat(F.lit('{"id": "h'), "id", F.lit('", "committee": '), committee, F.lit(', "chamber": "S", "congress": 118, "date": "2024-02-01", "bills": ["b'), "id", F.lit('", "b'), "id", F.lit('", "none"]}'))
    bills = t.bills.select("id", F.concat(F.lit("b"), "id").alias("congress_bill_id"))
    return S.hearings(t.bills.select(made.alias("json")), bills)[1]


@query("list_hearings", "SELECT 'h' || id AS id, 'house' AS chamber, introduced_date AS hearing_date FROM v_bills WHERE status = 'enacted' AND introduced_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' ORDER BY hearing_date DESC NULLS LAST, id LIMIT 500")
def list_hearings(t: Tables) -> DataFrame:
    from statutory.operators import listing as L

    made = F.to_json(F.struct(F.concat(F.lit("h"), "id").alias("id"), F.struct(F.coalesce("status", F.lit("none")).alias("name")).alias("committee"), F.lit("H").alias("chamber"), "title", F.col("introduced_date").cast("string").alias("date"), F.array("id").alias("bills")))
    bills = t.bills.select("id", F.col("id").alias("congress_bill_id"))
    rows, links = S.hearings(t.bills.select(made.alias("json")), bills)
    found = L.list_hearings(rows, links, committee="ENACTED", chamber="house", start="1996-01-01", end="1996-12-31")
    return found.select("id", "chamber", "hearing_date").limit(500)


@query("src_state_bills", "SELECT 'state:' || id AS id, identifier, 'enacted' AS status, CAST(2 AS BIGINT) AS versions, CAST(1 AS BIGINT) AS sponsors FROM v_bills")
def src_state_bills(t: Tables) -> DataFrame:
    day = F.col("introduced_date").cast("string")
    made = F.struct(
        F.concat(F.lit("state:"), "id").alias("id"), "identifier", "title", F.col("session_id").alias("session"), "subject",
        F.array(F.struct(F.lit("Introduced").alias("note"), day.alias("date")), F.struct(F.lit("Enrolled").alias("note"), day.alias("date"))).alias("versions"),
        F.array(F.struct(F.lit("Introduced").alias("description"), day.alias("date")), F.struct(F.lit("Signed by the governor").alias("description"), day.alias("date"))).alias("actions"),
        F.array(F.struct(F.lit("Q").alias("name"), F.lit("primary").alias("classification"))).alias("sponsorships"),
    )
    bills, versions, sponsors = S.state_bills(t.bills.select(F.to_json(made).alias("json")))
    count = lambda rows, name: rows.groupBy(F.col("bill_id").alias("id")).agg(F.count("*").alias(name))
    return bills.join(count(versions, "versions"), "id").join(count(sponsors, "sponsors"), "id").select("id", "identifier", "status", "versions", "sponsors")


@query("src_federal_bills", "SELECT 118 AS congress, identifier, title, 'in_committee' AS status, introduced_date AS status_date FROM v_bills")
def src_federal_bills(t: Tables) -> DataFrame:
    action = F.struct(F.col("introduced_date").cast("string").alias("actionDate"), F.lit("Referred to the Committee on Rules").alias("text"))
    bill = F.struct(F.lit(118).alias("congress"), _number("identifier").alias("number"), F.lower(F.regexp_extract("identifier", r"^([A-Z]+)", 1)).alias("type"), "title", action.alias("latestAction"))
    page = F.floor(F.col("id").cast("long") / 4000)  # files of bounded size, however many bills a session has
    return S.federal_bills(t.bills.groupBy("session_id", page.alias("page")).agg(F.to_json(F.struct(F.collect_list(bill).alias("bills"))).alias("json")))


def _legislators(t: Tables) -> DataFrame:
    term = F.struct(F.lit("rep").alias("type"), F.col("start_date").cast("string").alias("start"), F.col("end_date").cast("string").alias("end"), F.col("party"), F.lit("OH").alias("state"))
    people = t.party_spans.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("start_date", term.alias("t")))).alias("x"))
    terms = F.transform("x", lambda x: x["t"])
    made = F.struct(F.struct(F.col("person_id").alias("bioguide")).alias("id"), F.struct(F.lit("A").alias("first"), F.col("person_id").alias("last")).alias("name"), terms.alias("terms"))
    return people.select(F.to_json(made).alias("json"))


@query("src_terms", "SELECT person_id, party, start_date, end_date FROM v_party_spans")
def src_terms(t: Tables) -> DataFrame:
    return S.legislator_terms(_legislators(t))


@query("src_members", "SELECT person_id AS id, 'A ' || person_id AS name, arg_max(party, start_date) AS party, 'lower' AS chamber, 'OH' AS state FROM v_party_spans GROUP BY 1")
def src_members(t: Tables) -> DataFrame:
    return S.current_members(_legislators(t))


@query("src_traces", "SELECT template_id, count(*) AS n FROM v_traces GROUP BY 1")
def src_traces(t: Tables) -> DataFrame:
    """Runs written in two sets of files and read from the list of both."""
    rows = t.traces.select("template_id", "instance_id", "model", F.lit("c").alias("contract_hash"), F.lit("d").alias("content_hash"), F.lit("f").alias("fingerprint"))
    paths = []
    for model in ("small", "large"):
        paths.append(shared_folder(t.spark))
        rows.where(F.col("model") == model).write.json(paths[-1])
    schema = ", ".join(f"{c} string" for c in rows.columns)
    return S.traces(t.spark, paths, schema).groupBy("template_id").agg(F.count("*").alias("n"))

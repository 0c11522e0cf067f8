"""Raw files of the sources as tables: XML, JSON, ZIP and JSON lines.

Every reader takes landed text or bytes in a DataFrame, or a path that Spark lists, and
gives typed rows; what cannot be parsed gives no row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statutory.functions.text import norm_status, parse_date, vote_option, vote_ref

_BILL = """struct<number:string,billNumber:string,type:string,billType:string,congress:string,title:string,introducedDate:string,
subjects:struct<item:array<struct<name:string>>>,sponsors:struct<item:array<struct<bioguideId:string,fullName:string>>>,
cosponsors:struct<item:array<struct<bioguideId:string,fullName:string>>>,actions:struct<item:array<struct<actionDate:string,text:string>>>>""".replace("\n", "")

_HOUSE = """struct<`vote-metadata`:struct<congress:string,`rollcall-num`:string,`legis-num`:string,`action-date`:string,`vote-result`:string>,
`vote-data`:struct<`recorded-vote`:array<struct<legislator:struct<`_name-id`:string,_VALUE:string>,vote:string>>>>""".replace("\n", "")

_SENATE = """struct<congress:string,session:string,vote_number:string,vote_date:string,vote_result:string,document:struct<document_name:string>,
members:struct<member:array<struct<lis_member_id:string,vote_cast:string>>>>""".replace("\n", "")


def _xml(column: str, schema: str) -> Column:
    return F.from_xml(F.col(column), schema, {"mode": "PERMISSIVE"})


def bill_status(files: DataFrame, column: str = "xml") -> DataFrame:
    """One row per bill with its subjects, sponsors, cosponsors and actions; both tag spellings of number and type."""
    b = files.withColumn("b", _xml(column, _BILL))
    number, kind = F.coalesce("b.number", "b.billNumber"), F.coalesce("b.type", "b.billType")
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<bioguideId:string,fullName:string>>")), lambda x: x["bioguideId"])
    return b.where(number.isNotNull() & kind.isNotNull()).select(
        F.upper(F.concat(kind, number)).alias("identifier"), F.col("b.congress").try_cast("int").alias("congress"), F.col("b.title").alias("title"),
        F.try_to_date("b.introducedDate", "yyyy-MM-dd").alias("introduced_date"),
        F.transform(F.coalesce("b.subjects.item", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]).alias("subject"),
        names(F.col("b.sponsors.item")).alias("sponsors"), names(F.col("b.cosponsors.item")).alias("cosponsors"),
        F.coalesce("b.actions.item", F.array().cast("array<struct<actionDate:string,text:string>>")).alias("actions"),
    )


def bill_actions(bills: DataFrame) -> DataFrame:
    """The actions of parsed bills as rows, with their place."""
    return bills.select("identifier", F.posexplode("actions").alias("action_order", "a")).select(
        "identifier", "action_order", F.try_to_date("a.actionDate", "yyyy-MM-dd").alias("action_date"), F.col("a.text").alias("description"), norm_status("a.text").alias("status")
    )


def house_votes(files: DataFrame, column: str = "xml") -> DataFrame:
    """Casts of House roll calls; a file without numbers gives no row."""
    v = files.withColumn("v", _xml(column, _HOUSE)).select(F.col("v.`vote-metadata`").alias("m"), F.explode("v.`vote-data`.`recorded-vote`").alias("c"))
    roll = F.col("m.`rollcall-num`").try_cast("int")
    return v.where(roll.isNotNull() & F.col("m.congress").try_cast("int").isNotNull()).select(
        F.col("m.congress").try_cast("int").alias("congress"), roll.alias("roll"), vote_ref("m.`legis-num`").alias("ref"), parse_date("m.`action-date`").alias("vote_date"),
        F.col("m.`vote-result`").alias("result"), F.col("c.legislator.`_name-id`").alias("member"), vote_option("c.vote").alias("option"),
    )


def senate_votes(files: DataFrame, column: str = "xml") -> DataFrame:
    """Casts of Senate roll calls by their id there; absent is not voting."""
    v = files.withColumn("v", _xml(column, _SENATE)).select("v.*").select("congress", "session", "vote_number", "vote_date", "vote_result", F.col("document.document_name").alias("doc"), F.explode("members.member").alias("c"))
    cast = F.when(F.lower(F.trim("c.vote_cast")) == "absent", "not_voting").otherwise(vote_option("c.vote_cast"))
    return v.where(F.col("vote_number").try_cast("int").isNotNull()).select(
        F.col("congress").try_cast("int").alias("congress"), F.col("session").try_cast("int").alias("session"), F.col("vote_number").try_cast("int").alias("number"),
        vote_ref("doc").alias("ref"), parse_date("vote_date").alias("vote_date"), F.col("vote_result").alias("result"), F.col("c.lis_member_id").alias("member"), cast.alias("option"),
    )


def _members(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Names and bytes of a ZIP's files; none for what is no ZIP."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in archive.namelist():
                if not name.endswith("/"):
                    yield name, archive.read(name)
    except zipfile.BadZipFile:
        return


_PACKAGE = re.compile(r"bills-(\d+)([a-z]+)(\d+)([a-z]+)(?:\.xml)?$", re.I)
INTRODUCED = {"ih": "Introduced in House", "is": "Introduced in Senate"}


def _text_of(xml: bytes) -> str | None:
    """The text of a bill without its metadata: every text node a line of its own, blanks in it made one; null if it isn't XML."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    for parent in list(root.iter()):
        for child in list(parent):
            if child.tag.rsplit("}", 1)[-1] == "metadata":
                parent.remove(child)
    nodes = (node.strip() for node in root.itertext())
    return re.sub(r"[ \t]+", " ", "\n".join(node for node in nodes if node))


def text_zips(files: DataFrame) -> DataFrame:
    """Introduced versions of bill texts from ZIPs of XML (path, content): congress, doc_class, number, version, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for content in frame["content"]:
                for name, data in _members(content):
                    found = _PACKAGE.search(name.rsplit("/", 1)[-1])
                    if found and found[4].lower() in INTRODUCED and (text := _text_of(data)):
                        out.append((int(found[1]), found[2].lower(), found[3], INTRODUCED[found[4].lower()], text))
            yield pd.DataFrame(out, columns=["congress", "doc_class", "number", "version_name", "text"])

    return files.select("content").mapInPandas(run, "congress int, doc_class string, number string, version_name string, text string")


def bill_zips(files: DataFrame) -> DataFrame:
    """Bills from ZIPs of JSON; without an id, a number or a state there is no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [data.decode("utf-8", "replace") for content in frame["content"] for name, data in _members(content) if name.endswith(".json")]
            yield pd.DataFrame({"value": out}, dtype=object)

    raw = files.select("content").mapInPandas(run, "value string").withColumn("b", F.from_json("value", "bill struct<bill_id:long,number:string,state:string,title:string,status:int,session:struct<session_id:long>>"))
    b = raw.select("b.bill.*")
    return b.where("bill_id is not null and number is not null and state is not null").select(
        "bill_id", F.upper("number").alias("identifier"), F.lower("state").alias("state"), "title", F.col("status").cast("string").alias("status_code"), F.col("session.session_id").alias("session_id")
    )


# Document types of the regulatory source.
DOCUMENT_TYPES = {"Rule": "rule", "Proposed Rule": "proposed_rule", "Notice": "notice", "Presidential Document": "presidential_document"}


def regulatory(files: DataFrame, column: str = "json") -> DataFrame:
    """Regulatory documents: canonical type, agency names without blanks, CFR references."""
    from statutory.functions.text import mapped

    d = files.withColumn("d", F.from_json(column, "document_number string, type string, title string, publication_date string, agencies array<struct<name:string,raw_name:string>>, topics array<string>, cfr_references array<struct<title:int,part:string>>")).select("d.*")
    names = F.filter(F.transform("agencies", lambda a: F.coalesce(a["name"], a["raw_name"])), lambda n: n.isNotNull() & (n != ""))
    return d.where("document_number is not null").select(
        F.col("document_number").alias("id"), F.coalesce(mapped(F.col("type"), DOCUMENT_TYPES), F.lower("type")).alias("document_type"), "title", parse_date("publication_date").alias("publication_date"),
        names.alias("agency_names"), "topics", F.filter("cfr_references", lambda r: r["part"].isNotNull()).alias("cfr_references"),
    )


def reports(files: DataFrame, column: str = "json") -> DataFrame:
    """Research reports: authors and topics as strings or objects, first and latest date from the versions."""
    v = F.try_parse_json(column)
    text = lambda path: F.try_variant_get(v, path, "string")

    def names(path: str, key: str) -> Column:
        items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
        return F.filter(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, f"$.{key}", "string"), F.try_variant_get(x, "$", "string"))), lambda n: n.isNotNull())

    dates = F.filter(F.transform(F.try_variant_get(v, "$.versions", "array<variant>"), lambda x: parse_date(F.try_variant_get(x, "$.date", "string"))), lambda d: d.isNotNull())
    return files.select(text("$.id").alias("id"), text("$.title").alias("title"), names("$.authors", "name").alias("authors"), names("$.topics", "topic").alias("topics"), F.array_min(dates).alias("publication_date"), F.array_max(dates).alias("updated_date")).where("id is not null")


def hearings(files: DataFrame, bills: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Hearings (the committee as a string or an object), and their links to bills by congress_bill_id."""
    from statutory.functions.text import norm_chamber

    v = F.try_parse_json(column)
    text = lambda path: F.try_variant_get(v, path, "string")
    committee = F.coalesce(text("$.committee.name"), text("$.committee"))
    rows = files.select(
        text("$.id").alias("id"), committee.alias("committee"), norm_chamber(text("$.chamber")).alias("chamber"), text("$.title").alias("title"),
        parse_date(text("$.date")).alias("hearing_date"), text("$.congress").try_cast("int").alias("congress"), F.try_variant_get(v, "$.bills", "array<string>").alias("refs"),
    ).where("id is not null")
    links = rows.select(F.col("id").alias("hearing_id"), F.explode(F.array_distinct("refs")).alias("congress_bill_id")).join(bills.select("congress_bill_id", F.col("id").alias("bill_id")), "congress_bill_id")
    return rows.drop("refs"), links.select("hearing_id", "bill_id").distinct()


def state_bills(files: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """State bills with their versions and sponsorships, as three tables."""
    schema = "id string, identifier string, title string, session string, subject array<string>, versions array<struct<note:string,date:string>>, actions array<struct<description:string,date:string>>, sponsorships array<struct<name:string,classification:string>>"
    b = files.withColumn("b", F.from_json(column, schema)).select("b.*").where("id is not null")
    bills = b.select("id", "identifier", "title", "session", F.coalesce("subject", F.array().cast("array<string>")).alias("subject"), norm_status(F.element_at("actions", -1)["description"]).alias("status"))
    versions = b.select(F.col("id").alias("bill_id"), F.explode("versions").alias("x")).select("bill_id", F.col("x.note").alias("version_name"), parse_date("x.date").alias("version_date"))
    sponsors = b.select(F.col("id").alias("bill_id"), F.explode("sponsorships").alias("x")).select("bill_id", "x.name", "x.classification")
    return bills, versions, sponsors


def federal_bills(files: DataFrame, column: str = "json") -> DataFrame:
    """The bills of a federal list; the text of the latest action sets the status."""
    schema = "bills array<struct<congress:int,number:string,type:string,title:string,latestAction:struct<actionDate:string,text:string>>>"
    b = files.select(F.explode(F.from_json(column, schema)["bills"]).alias("b")).select("b.*").where("number is not null and type is not null")
    return b.select("congress", F.upper(F.concat("type", "number")).alias("identifier"), "title", norm_status("latestAction.text").alias("status"), parse_date("latestAction.actionDate").alias("status_date"))


_TERMS = "array<struct<type:string,start:string,end:string,party:string,state:string,party_affiliations:array<struct<start:string,end:string,party:string>>>>"


def legislator_terms(files: DataFrame, column: str = "json") -> DataFrame:
    """Terms of legislators; a list of affiliations stands in for its term."""
    b = files.withColumn("b", F.from_json(column, f"id struct<bioguide:string>, terms {_TERMS}")).select("b.id.bioguide", F.explode("b.terms").alias("t"))
    own = F.array(F.struct(F.col("t.start"), F.col("t.end"), F.col("t.party")))
    parts = F.when(F.size("t.party_affiliations") > 0, F.col("t.party_affiliations")).otherwise(own)
    return b.where("bioguide is not null").select("bioguide", F.explode(parts).alias("p")).select(F.col("bioguide").alias("person_id"), F.substring("p.party", 1, 1).alias("party"), parse_date("p.start").alias("start_date"), parse_date("p.end").alias("end_date"))


def current_members(files: DataFrame, column: str = "json") -> DataFrame:
    """Members with party, chamber and state of their last term."""
    b = files.withColumn("b", F.from_json(column, f"id struct<bioguide:string>, name struct<first:string,last:string,official_full:string>, terms {_TERMS}")).select("b.*")
    last = F.element_at("terms", -1)
    chamber = F.when(last["type"] == "sen", "upper").when(last["type"] == "rep", "lower")
    return b.where("id.bioguide is not null and size(terms) > 0").select(F.col("id.bioguide").alias("id"), F.coalesce("name.official_full", F.concat_ws(" ", "name.first", "name.last")).alias("name"), last["party"].alias("party"), chamber.alias("chamber"), last["state"].alias("state"))


def traces(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Runs from an explicit list of JSON-lines files; ValueError if their contracts differ."""
    rows = spark.read.schema(schema).json(paths)
    if rows.select("contract_hash", "content_hash", "fingerprint").distinct().limit(2).count() > 1:
        raise ValueError("runs of different contracts, contents or data")
    return rows

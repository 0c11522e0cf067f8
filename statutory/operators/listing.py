"""Filtered lists, pages and nested details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statutory.functions.text import contains_folded


def page(rows: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page after a total order, each row with the total of all rows.

    The total is one aggregate beside the page, so only offset + limit rows per task are
    sorted out; deep pages are better filtered on the last key.
    """
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def filter_bills(bills: DataFrame, jurisdiction: str | None = None, status: str | None = None, subject: str | None = None, text: str | None = None) -> DataFrame:
    """The conditions that are given, all of them."""
    if jurisdiction is not None:
        bills = bills.where(F.col("jurisdiction_id") == jurisdiction)
    if status is not None:
        bills = bills.where(F.col("status") == status)
    if subject is not None:
        bills = bills.where(F.array_contains("subject", subject))
    if text is not None:
        bills = bills.where(contains_folded("title", text))
    return bills


def date_range(rows: DataFrame, column: str, start: str, end: str, longest_days: int = 1095) -> DataFrame:
    """Both ends inclusive; on timestamps the end is its midnight. Reversed or longer ranges are an error."""
    from datetime import date

    days = (date.fromisoformat(end) - date.fromisoformat(start)).days
    if days < 0 or days > longest_days:
        raise ValueError(f"range of {days} days")
    kind = rows.schema[column].dataType.simpleString()
    return rows.where((F.col(column) >= F.lit(start).cast(kind)) & (F.col(column) <= F.lit(end).cast(kind)))


def find_people(people: DataFrame, tokens: list[str]) -> DataFrame:
    """People whose name holds every token, in any order."""
    return people.where(F.forall(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower("name"), F.lower(t))))


def matches_criteria(searches: str = "s", bill: str = "b") -> Column:
    """A bill meets a saved search: criteria that are null hold for every bill."""
    s, b = (lambda c: F.col(f"{searches}.{c}")), (lambda c: F.col(f"{bill}.{c}"))
    equal = lambda c: s(c).isNull() | F.coalesce(s(c) == b(c), F.lit(False))
    title = s("query").isNull() | F.coalesce(F.contains(F.lower(b("title")), F.lower(s("query"))), F.lit(False))
    return equal("jurisdiction_id") & equal("status") & title


def list_hearings(hearings: DataFrame, links: DataFrame, committee: str | None = None, chamber: str | None = None, congress: int | None = None, bill_id: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Hearings under the given conditions, latest first, those without a date last."""
    out = hearings
    if committee is not None:
        out = out.where(contains_folded("committee", committee) | contains_folded("title", committee))
    if chamber is not None:
        out = out.where(F.col("chamber") == chamber)
    if congress is not None:
        out = out.where(F.col("congress") == congress)
    if bill_id is not None:
        out = out.join(links.where(F.col("bill_id") == bill_id).select(F.col("hearing_id").alias("id")), "id", "left_semi")
    if start is not None:
        out = out.where(F.col("hearing_date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("hearing_date") <= F.lit(end).cast("date"))
    return out.orderBy(F.desc_nulls_last("hearing_date"), "id")


def hearings_for_bill(hearings: DataFrame, links: DataFrame) -> DataFrame:
    """Every bill with its hearings, latest first by rank."""
    joined = links.join(hearings, links["hearing_id"] == hearings["id"]).drop("hearing_id")
    order = Window.partitionBy("bill_id").orderBy(F.desc_nulls_last("hearing_date"), "id")
    return joined.withColumn("rank", F.row_number().over(order))


def list_regulatory(documents: DataFrame, agency: str | None = None, kind: str | None = None) -> DataFrame:
    """Documents of an agency (part of any name, ignoring case) and type, latest first."""
    out = documents
    if agency is not None:
        out = out.where(F.exists("agency_names", lambda a: F.contains(F.lower(a), F.lit(agency.lower()))))
    if kind is not None:
        out = out.where(F.col("document_type") == kind)
    return out.orderBy(F.desc_nulls_last("publication_date"), "id")


def list_reports(reports: DataFrame, topic: str | None = None, author: str | None = None, bill_id: str | None = None, text: str | None = None) -> DataFrame:
    """Reports by topic, author, related bill, and title or summary; latest first, ties by id."""
    out = reports
    for column, value in (("topics", topic), ("authors", author)):
        if value is not None:
            part = F.lit(value.lower())
            out = out.where(F.exists(column, lambda a: F.contains(F.lower(a), part)))  # noqa: B023
    if bill_id is not None:
        out = out.where(F.array_contains("related_bill_ids", bill_id))
    if text is not None:
        out = out.where(contains_folded("title", text) | contains_folded("summary", text))
    return out.orderBy(F.desc_nulls_last("publication_date"), "id")


def nested(rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """The rows of each key as a sorted list of structs, so that joining it adds no rows."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def bill_detail(bills: DataFrame, texts: DataFrame, actions: DataFrame, sponsorships: DataFrame, people: DataFrame) -> DataFrame:
    """Every bill with its texts, actions and sponsors as lists (empty where there are none)."""
    sponsors = sponsorships.join(people.select(F.col("id").alias("person_id"), "name"), "person_id", "left")
    children = {
        "texts": nested(texts, "bill_id", ["version_date", "id", "version_name"], "texts"),
        "actions": nested(actions, "bill_id", ["action_order", "action_date", "description"], "actions"),
        "sponsors": nested(sponsors, "bill_id", ["classification", "person_id", "name"], "sponsors"),
    }
    out = bills.select(F.col("id").alias("bill_id"), "identifier", "title")
    for name, rows in children.items():
        out = out.join(rows, "bill_id", "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out


def precedent_insights(precedents: DataFrame, bills: DataFrame, summaries: DataFrame, scores: DataFrame) -> DataFrame:
    """The bills of a workspace in their order, with their latest summary and score (null where there is none)."""
    out = precedents.join(bills.select(F.col("id").alias("bill_id"), "identifier", "title"), "bill_id", "left")
    out = out.join(summaries, "bill_id", "left").join(scores, "bill_id", "left")
    return out.orderBy("workspace_id", "position")

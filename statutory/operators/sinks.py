"""Exports and table maintenance; files go to the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statutory.functions.text import csv_guard


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session has one of its own where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="statutory-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def bill_export(bills: DataFrame, limit: int = 5000) -> DataFrame:
    """The newest bills, lists joined by "; ", cells guarded against formulas."""
    cell = lambda c: csv_guard(F.coalesce(c, F.lit("")))
    rows = bills.orderBy(F.desc("created_at"), "id").limit(limit)
    return rows.select("id", cell("identifier").alias("identifier"), cell("title").alias("title"), cell(F.array_join("subject", "; ")).alias("subject"))


def bill_briefs(bills: DataFrame, sponsorships: DataFrame, people: DataFrame, actions: DataFrame) -> DataFrame:
    """One markdown brief per bill: header, sponsors, history."""
    named = sponsorships.join(people.select(F.col("id").alias("person_id"), "name"), "person_id")
    sponsors = named.groupBy(F.col("bill_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("classification", "name", "person_id"))).alias("s"))
    history = actions.groupBy(F.col("bill_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("action_date", "action_order", "description"))).alias("h"))
    joined = bills.join(sponsors, "id", "left").join(history, "id", "left")
    who = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["name"], F.lit(" ("), x["classification"], F.lit(")"))), "\n")
    what = F.array_join(F.transform("h", lambda x: F.concat(F.lit("- "), x["action_date"].cast("string"), F.lit(": "), x["description"])), "\n")
    text = F.concat(F.lit("# "), "identifier", F.lit("\n"), "title", F.lit("\n\n## Sponsors\n"), F.coalesce(who, F.lit("")), F.lit("\n\n## History\n"), F.coalesce(what, F.lit("")))
    return joined.select(F.col("id").alias("bill_id"), text.alias("brief"))


def workspace_markdown(workspaces: DataFrame, sections: DataFrame) -> DataFrame:
    """Workspaces as markdown, sections by position; sections without text keep their heading."""
    body = sections.groupBy("workspace_id").agg(F.array_sort(F.collect_list(F.struct("position", "heading", F.coalesce("markdown", F.lit("")).alias("markdown")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("## "), p["heading"], F.lit("\n\n"), p["markdown"])), "\n\n")
    joined = workspaces.join(body, workspaces["id"] == body["workspace_id"], "left")
    return joined.select(workspaces["id"], F.concat(F.lit("# "), "title", F.when(F.col("parts").isNotNull(), F.concat(F.lit("\n\n"), text)).otherwise("")).alias("markdown"))


def collection_brief(collections: DataFrame, items: DataFrame, bills: DataFrame, artifacts: DataFrame, latest: int = 10) -> DataFrame:
    """Collections as briefs: their bills with notes, and the latest artifacts."""
    from statutory.operators.windows import top_per_group

    noted = items.join(bills.select(F.col("id").alias("bill_id"), "identifier", "title"), "bill_id", "left")
    listed = noted.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct("identifier", "title", F.coalesce("notes", F.lit("")).alias("notes")))).alias("items"))
    recent = top_per_group(artifacts, ["collection_id"], [F.desc("created_at"), F.desc("id")], latest, rank="rank")
    made = recent.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "markdown"))).alias("made"))
    joined = collections.withColumnRenamed("id", "collection_id").join(listed, "collection_id", "left").join(made, "collection_id", "left")
    bill_lines = F.array_join(F.transform("items", lambda i: F.concat(F.lit("- "), i["identifier"], F.lit(": "), i["title"], F.when(i["notes"] != "", F.concat(F.lit(" - "), i["notes"])).otherwise(""))), "\n")
    parts = F.array_join(F.transform("made", lambda a: F.concat(F.lit("### "), a["title"], F.lit("\n"), a["markdown"])), "\n\n")
    text = F.concat(F.lit("# "), "name", F.lit("\n\n## Bills\n"), F.coalesce(bill_lines, F.lit("")), F.lit("\n\n## Artifacts\n"), F.coalesce(parts, F.lit("")))
    return joined.select("collection_id", text.alias("markdown"))


def through_csv(rows: DataFrame) -> DataFrame:
    """Write with a header, and read the files back with the same schema."""
    path = shared_folder(rows.sparkSession)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return rows.sparkSession.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


def through_json(rows: DataFrame) -> DataFrame:
    path = shared_folder(rows.sparkSession)
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def rebuilt(rows: DataFrame, fresh: DataFrame, by: str, path: str | None = None) -> DataFrame:
    """A table partitioned by a column, of which the partitions of fresh are then replaced and the others left."""
    spark = rows.sparkSession
    path = path or shared_folder(spark)
    rows.repartition(by).write.partitionBy(by).parquet(path)
    fresh.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def replaced(rows: DataFrame, anomalies: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """Overwrite a table with rows, only if the check finds none; ValueError otherwise."""
    if anomalies(rows).limit(1).count():
        raise ValueError("the rows have anomalies; the table was left as it was")
    path = path or shared_folder(rows.sparkSession)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    """One file line per row would break texts with line breaks, so they are written as JSON strings."""
    rows.select(F.to_json(F.struct(column)).alias("value")).write.mode("overwrite").text(path)

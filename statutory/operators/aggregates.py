"""Counts, shares and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statutory.functions.text import STATUS_RANKS, int_bucket, mapped

BUCKETS = ("<0", "0", "1", "2-5", "6-10", "11-25", "26+")


def count_by_period(rows: DataFrame, date: str, dimension: Column, period: str = "month") -> DataFrame:
    """Rows per period and dimension; rows without a date are left out."""
    start = F.to_date(F.date_trunc(period, F.col(date).cast("timestamp")))
    return rows.where(F.col(date).isNotNull()).groupBy(start.alias("period"), dimension.alias("dimension")).agg(F.count("*").alias("count"))


def counts_by_kind(rows: DataFrame, date: str, kinds: dict[str, tuple[str, Column]]) -> DataFrame:
    """Rows per kind, period and dimension, for several kinds (name: period and an array of dimensions) in one scan."""
    at = F.col(date).cast("timestamp")

    def of(name: str, period: str, dimensions: Column) -> Column:
        start = F.to_date(F.date_trunc(period, at))
        return F.transform(dimensions, lambda x: F.struct(F.lit(name).alias("kind"), start.alias("period"), x.alias("dimension")))

    found = F.concat(*[F.coalesce(of(name, *how), F.array()) for name, how in kinds.items()])
    keys = rows.where(F.col(date).isNotNull()).select(F.explode(found).alias("key")).select("key.*")
    return keys.groupBy("kind", "period", "dimension").agg(F.count("*").alias("count"))


def with_share(counts: DataFrame) -> DataFrame:
    """Percent of the period's total, one decimal."""
    total = F.sum("count").over(Window.partitionBy("period"))
    return counts.withColumn("share", F.round(100.0 * F.col("count") / total, 1))


def fold_top(counts: DataFrame, n: int) -> DataFrame:
    """Keep the n dimensions with the largest totals (ties by name), the others become Other per period.

    The dimensions are ranked on their totals, one row each; the window over them has no
    partition but only sees that aggregate, limited to n rows before it is broadcast.
    """
    totals = counts.groupBy("dimension").agg(F.sum("count").alias("total"))
    top = totals.orderBy(F.desc("total"), "dimension").limit(n).select("dimension", F.lit(True).alias("_top"))
    kept = counts.join(F.broadcast(top), "dimension", "left")
    name = F.when(F.col("_top"), F.col("dimension")).otherwise("Other")
    return kept.groupBy("period", name.alias("dimension")).agg(F.sum("count").alias("count"))


def bucket_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows per magnitude bucket, zero where there are none."""
    found = rows.where(F.col(column).isNotNull()).groupBy(int_bucket(column).alias("bucket")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket"))
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def int_summary(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """n, min, max, mean, exact median, zero count and share, by keys; nulls are left out."""
    c = F.col(column)
    return rows.where(c.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.avg(c).alias("mean"),
        F.percentile(c, 0.5).alias("median"),
        F.count(F.when(c == 0, 1)).alias("zeros"),
        (F.count(F.when(c == 0, 1)) / F.count("*")).alias("zero_share"),
    )


def best_status(actions: DataFrame, status: Column) -> DataFrame:
    """The furthest status over a bill's actions; of equal ranks the earlier action's."""
    ranked = actions.select("bill_id", status.alias("status"), "action_order")
    rank = mapped(F.col("status"), STATUS_RANKS)
    return ranked.groupBy("bill_id").agg(F.max_by("status", F.struct(rank, -F.col("action_order"), "status")).alias("status"))


def option_counts(records: DataFrame, keys: list[str]) -> DataFrame:
    """Votes by option in fixed columns, zero where there are none."""
    count = lambda *o: F.count(F.when(F.col("option").isin(*o), 1))
    return records.groupBy(*keys).agg(
        count("yea").alias("yea"), count("nay").alias("nay"), count("present", "not_voting").alias("other"), F.count("*").alias("total")
    )


def person_stats(people: DataFrame, sponsorships: DataFrame, records: DataFrame, events: DataFrame, bills: DataFrame) -> DataFrame:
    """Primary and other sponsorships, votes, and votes over events of the person's jurisdiction (null if it has none)."""
    sponsored = sponsorships.groupBy("person_id").agg(
        F.count(F.when(F.col("classification") == "primary", 1)).alias("primary_count"),
        F.count(F.when(F.col("classification") != "primary", 1)).alias("other_count"),
    )
    votes = records.groupBy("person_id").agg(F.count("*").alias("votes"))
    held = events.join(bills.select(F.col("id").alias("bill_id"), "jurisdiction_id"), "bill_id").groupBy("jurisdiction_id").agg(F.count("*").alias("events"))
    out = people.select(F.col("id").alias("person_id"), F.col("current_jurisdiction_id").alias("jurisdiction_id"))
    out = out.join(sponsored, "person_id", "left").join(votes, "person_id", "left").join(held, "jurisdiction_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "person_id", zero("primary_count"), zero("other_count"), zero("votes"),
        F.when(F.col("events") > 0, F.round(F.coalesce("votes", F.lit(0)) / F.col("events"), 4)).alias("participation"),
    )

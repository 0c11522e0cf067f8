"""Orders inside groups: first and last versions, samples, pairs, spans, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column | str], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of every group; Spark drops the others before the shuffle."""
    out = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def first_text(texts: DataFrame, chars: int = 5000) -> DataFrame:
    """The first text of every bill by date and id, cut to so many characters."""
    held = texts.where(F.coalesce("content_text", F.lit("")) != "")
    return top_per_group(held, ["bill_id"], ["version_date", "id"]).select("bill_id", F.substring("content_text", 1, chars).alias("text"))


def version_pair(texts: DataFrame) -> DataFrame:
    """The oldest and the newest version with text of every bill that has two."""
    held = texts.where(F.coalesce("content_text", F.lit("")) != "").withColumn("_o", F.struct("version_date", "id"))
    out = held.groupBy("bill_id").agg(F.count("*").alias("n"), F.min_by("id", "_o").alias("oldest"), F.max_by("id", "_o").alias("newest"))
    return out.where("n >= 2").select("bill_id", "oldest", "newest")


def hash_order(seed: int | str, *ids: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]), 256)


def hash_sample(rows: DataFrame, seed: int | str, ids: list[str], n: int) -> DataFrame:
    """The n rows that come first in the order of a seeded hash: a sample that is the same in every run."""
    return rows.orderBy(hash_order(seed, *ids), *ids).limit(n)


def disjoint_pairs(rows: DataFrame, keys: list[str], member: str, seed: int | str) -> DataFrame:
    """Neighbours in hash order as pairs, inside every group; one left over has no pair."""
    order = Window.partitionBy(*keys).orderBy(hash_order(seed, member), member)
    numbered = rows.select(*keys, member).distinct().withColumn("_n", F.row_number().over(order) - 1)
    pairs = numbered.groupBy(*keys, F.floor(F.col("_n") / 2).alias("pair")).agg(F.count("*").alias("_c"), F.min(member).alias("a"), F.max(member).alias("b"))
    return pairs.where("_c = 2").drop("_c")


def round_robin(rows: DataFrame, person: str, item: str, seed: int | str, n: int) -> DataFrame:
    """One item of each person before any second one; n in all."""
    depth = F.row_number().over(Window.partitionBy(person).orderBy(hash_order(seed, item), item))
    return rows.withColumn("depth", depth).where(F.col("depth") <= n).orderBy("depth", person, item).limit(n)


def balanced_pools(rows: DataFrame, pool: str, item: str, seed: int | str, n: int) -> DataFrame:
    """n items of the two pools (pool: true or false), half of each, a deficit filled from the other; true first."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(pool).orderBy(hash_order(seed, item), item))).where(F.col("_r") <= n)
    sizes = rows.agg(F.count(F.when(F.col(pool), 1)).alias("_yes"), F.count(F.when(~F.col(pool), 1)).alias("_no"))
    ranked = ranked.crossJoin(F.broadcast(sizes))  # one row of sizes
    half_yes, half_no = F.lit(n - n // 2), F.lit(n // 2)
    yes = F.least("_yes", F.greatest(half_yes, F.lit(n) - F.col("_no")))
    no = F.least("_no", F.greatest(half_no, F.lit(n) - F.col("_yes")))
    return ranked.where(F.col("_r") <= F.when(F.col(pool), yes).otherwise(no)).drop("_r", "_yes", "_no")


def trim_history(turns: DataFrame, budget: int) -> DataFrame:
    """The first message of each conversation and its newest ones while they fit into the budget of characters."""
    w = Window.partitionBy("conv_id")
    size = F.coalesce(F.length("text"), F.lit(0))
    first = turns.withColumn("_first", F.row_number().over(w.orderBy("turn")) == 1)
    used = F.sum(F.when(F.col("_first"), 0).otherwise(size)).over(w.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    lead = F.sum(F.when(F.col("_first"), size).otherwise(0)).over(w)
    return first.withColumn("_used", used + lead).where(F.col("_first") | (F.col("_used") <= budget)).drop("_first", "_used")


def build_spans(terms: DataFrame) -> DataFrame:
    """Terms (start, end inclusive) as spans without overlap: a span ends where the next starts, or the day after its end."""
    after = F.lead("start_date").over(Window.partitionBy("person_id").orderBy("start_date"))
    return terms.withColumn("end_date", F.least(after, F.date_add("end_date", 1)))


def overlapping_spans(spans: DataFrame) -> DataFrame:
    """Spans that share a start with, or reach into, the next span of their person: must be none."""
    after = F.lead("start_date").over(Window.partitionBy("person_id").orderBy("start_date", "end_date", "party"))
    return spans.withColumn("next_start", after).where("next_start < end_date or next_start = start_date")


def unique_slugs(rows: DataFrame, title: str, order: str) -> DataFrame:
    """A slug for every row, all different: as if they were given out one by one in `order`.

    A row takes its title's slug if that is free, and the slug with the least free number
    from 2 on otherwise. A slug such as a_2 may be the title of one row and the numbered
    slug of another, whichever comes first. Only slugs that are another title's slug with a
    number, or have such a one, and of which some title comes twice, can meet; those of one
    stem are walked row by row, in order, with nothing kept but the slugs given out. All
    others are numbered by their rank. Rows of one title and order are told apart by chance.
    """
    from statutory.functions.text import slug

    number = r"_([2-9]|[1-9]\d+)"
    based = rows.withColumn("_slug", slug(title))
    titles = based.groupBy("_slug").agg(F.count("*").alias("_m"))
    shorter = titles.withColumn("_short", F.regexp_replace("_slug", f"{number}$", "")).where("_short <> _slug")
    pairs = shorter.join(titles.select(F.col("_slug").alias("_short"), F.col("_m").alias("_short_m")), "_short")
    ends = pairs.select("_slug", "_m").union(pairs.select("_short", "_short_m")).distinct().withColumn("_stem", F.regexp_replace("_slug", f"({number})+$", ""))
    twice = ends.groupBy("_stem").agg(F.max("_m").alias("_most")).where("_most > 1").select("_stem")
    marked = based.join(ends.join(twice, "_stem").select("_slug", "_stem"), "_slug", "left")
    ranked = marked.withColumn("_twin", F.row_number().over(Window.partitionBy("_slug").orderBy(order)))
    meeting = ranked.where("_stem is not null").select("_stem", "_slug", "_twin", F.col(order).alias("_order"))
    ordered = meeting.repartition("_stem").sortWithinPartitions("_stem", "_order", "_slug", "_twin").select("_stem", "_slug", "_twin")
    given = ordered.mapInPandas(_give_slugs, "_slug string, _twin int, _given string")
    own = F.when(F.col("_twin") > 1, F.concat_ws("_", "_slug", F.col("_twin").cast("string"))).otherwise(F.col("_slug"))
    return ranked.join(given, ["_slug", "_twin"], "left").withColumn("slug", F.coalesce("_given", own)).drop("_slug", "_stem", "_twin", "_given")


def _give_slugs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slugs in order; rows come sorted by stem, whose rows may lie in several frames."""
    stem, free, used = None, {}, set()
    for frame in frames:
        found = []
        for own, base in zip(frame["_stem"], frame["_slug"], strict=True):
            if own != stem:
                stem, free, used = own, {}, set()
            if base in used:
                number = free.get(base, 2)
                while f"{base}_{number}" in used:
                    number += 1
                free[base] = number + 1
                base = f"{base}_{number}"
            used.add(base)
            found.append(base)
        yield frame[["_slug", "_twin"]].assign(_given=found)

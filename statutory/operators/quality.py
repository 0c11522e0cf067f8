"""Reconciliation and data-quality operators."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statutory.functions.text import core_name_tokens


def recorded_counts(records: DataFrame) -> DataFrame:
    """Resolved votes of every event in the three stored buckets."""
    count = lambda *o: F.count(F.when(F.col("option").isin(*o), 1))
    return records.groupBy(F.col("vote_event_id").alias("id")).agg(
        count("yea").alias("yeas"), count("nay").alias("nays"), count("present", "not_voting").alias("others")
    )


def reconcile(events: DataFrame, records: DataFrame) -> DataFrame:
    """Events with verdict: over (any bucket has more votes than stored), missing (a stored count is null), complete (all equal), under."""
    counts = recorded_counts(records)
    joined = events.join(counts, "id", "left")
    pairs = [(F.coalesce(c, F.lit(0)), F.col(s)) for c, s in (("yeas", "yes_count"), ("nays", "no_count"), ("others", "other_count"))]
    over = F.coalesce(pairs[0][0] > pairs[0][1], F.lit(False)) | F.coalesce(pairs[1][0] > pairs[1][1], F.lit(False)) | F.coalesce(pairs[2][0] > pairs[2][1], F.lit(False))
    missing = pairs[0][1].isNull() | pairs[1][1].isNull() | pairs[2][1].isNull()
    equal = (pairs[0][0] == pairs[0][1]) & (pairs[1][0] == pairs[1][1]) & (pairs[2][0] == pairs[2][1])
    return joined.select(*events.columns, F.when(over, "over").when(missing, "missing").when(equal, "complete").otherwise("under").alias("verdict"))


def complete_events(events: DataFrame, records: DataFrame) -> DataFrame:
    return reconcile(events, records).where("verdict = 'complete'").drop("verdict")


def resolve_casts(casts: DataFrame, members: DataFrame, stored: DataFrame) -> DataFrame:
    """Per event: casts, resolved and dropped ones, and whether it is set aside.

    casts: event, member, option (null: unknown), place. Of repeated members the first counts.
    An event is set aside if an option is unknown or its counts differ from the stored ones.
    """
    first = F.row_number().over(Window.partitionBy("event", "member").orderBy("place"))
    once = casts.withColumn("_n", first).where("_n = 1").join(members.select("member", "person_id"), "member", "left")
    count = lambda c: F.count(F.when(c, 1))
    found = once.groupBy("event").agg(
        F.count("*").alias("casts"),
        count(F.col("person_id").isNotNull()).alias("resolved"),
        count(F.col("person_id").isNull()).alias("dropped"),
        count(F.col("option").isNull()).alias("unknown"),
        count(F.col("option") == "yea").alias("y"),
        count(F.col("option") == "nay").alias("n"),
        count(F.col("option").isin("present", "not_voting")).alias("o"),
    )
    same = F.col("y").eqNullSafe(F.col("yes_count")) & F.col("n").eqNullSafe(F.col("no_count")) & F.col("o").eqNullSafe(F.col("other_count"))
    joined = found.join(stored, "event")
    return joined.select("event", "casts", "resolved", "dropped", ((F.col("unknown") > 0) | ~same).alias("quarantined"))


def member_map(rows: DataFrame) -> DataFrame:
    """One id per key: the canonical row's (id = key), else the only row's; keys with several others are excluded."""
    found = rows.groupBy("key").agg(
        F.max(F.when(F.col("id") == F.col("key"), F.col("id"))).alias("canonical"), F.count_distinct("id").alias("n"), F.min("id").alias("lone")
    )
    return found.withColumn("id", F.when(F.col("canonical").isNotNull(), F.col("canonical")).when(F.col("n") == 1, F.col("lone"))).where("id is not null").select("key", "id")


def first_reason(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """The first reason to skip that holds for a row, or ok."""
    out = F.when(reasons[0][1], reasons[0][0])
    for name, test in reasons[1:]:
        out = out.when(test, name)
    return rows.withColumn("reason", out.otherwise("ok"))


def missing_numbers(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Numbers from 1 to the largest of every group that do not occur in it."""
    every = rows.groupBy(*keys).agg(F.max(number).alias("_max")).select(*keys, F.explode(F.sequence(F.lit(1), F.col("_max").cast("int"))).alias(number))
    return every.join(rows.select(*keys, F.col(number).cast("int").alias(number)).distinct(), [*keys, number], "left_anti")


def name_collisions(records: DataFrame, people: DataFrame) -> DataFrame:
    """Names that several voters of an event share."""
    named = records.join(people.select(F.col("id").alias("person_id"), "name"), "person_id")
    return named.groupBy("vote_event_id", "name").agg(F.count_distinct("person_id").alias("n")).where("n > 1")


def _trigrams(text: Column) -> Column:
    return F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, 3))).otherwise(F.array().cast("array<string>"))


def window_collisions(members: DataFrame) -> DataFrame:
    """Members of a window whose name tokens are all substrings of another member's name there, and n, how many such others.

    members: window columns congress and chamber, person_id and name. Members of one name are
    one row with their number. Candidates come from an index of the names' trigrams and
    letters: a name asks with the one of its tokens' that fewest names of the window hold,
    and every name with all tokens holds that one too. Candidates are tested on the
    lower-case names. Names without tokens collide with none.
    """
    window = ["congress", "chamber"]
    named = members.select(*window, "person_id", F.lower("name").alias("low"), core_name_tokens("name").alias("tokens")).distinct()
    grams = lambda text: F.array_union(_trigrams(text), F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, 1)))
    names = named.where(F.length("low") > 0).groupBy(*window, "low").agg(F.count_distinct("person_id").alias("persons"))
    held = names.select(*window, F.col("low").alias("other"), "persons", F.explode(F.array_distinct(grams(F.col("low")))).alias("gram"))
    rare = held.groupBy(*window, "gram").agg(F.count("*").alias("holders"))
    asked = named.where(F.size("tokens") > 0).select(*window, "low", "tokens").distinct()
    asks = asked.select(*window, "low", "tokens", F.explode(F.array_distinct(F.flatten(F.transform("tokens", grams)))).alias("gram"))
    best = asks.join(rare, [*window, "gram"]).groupBy(*window, "low", "tokens").agg(F.min(F.struct("holders", "gram")).alias("best"))
    met = best.select(*window, "low", "tokens", F.col("best.gram").alias("gram")).join(held, [*window, "gram"])
    hit = met.where(F.forall("tokens", lambda t: F.contains(F.col("other"), t))).groupBy(*window, "low", "tokens").agg(F.sum("persons").alias("persons"))
    found = named.join(hit, [*window, "low", "tokens"]).groupBy(*window, "person_id").agg(F.max(F.col("persons") - 1).alias("n"))  # all but the member
    return found.where("n > 0")


def compare_casts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Casts of two sources by event and person: matched, mismatched or unresolved (only theirs), counted by event."""
    joined = theirs.select("vote_event_id", "person_id", F.col("option").alias("their")).join(ours.select("vote_event_id", "person_id", F.col("option").alias("our")), ["vote_event_id", "person_id"], "left")
    kind = F.when(F.col("our").isNull(), "unresolved").when(F.col("our") == F.col("their"), "matched").otherwise("mismatched")
    count = lambda k: F.count(F.when(kind == k, 1)).alias(k)
    return joined.groupBy("vote_event_id").agg(count("matched"), count("mismatched"), count("unresolved"))


# Words and what they are swapped for, in the order in which they are tried.
SWAPS = (
    ("shall not", "may not"), ("may not", "shall not"), (" shall ", " may "), ("Secretary", "Director"), ("annually", "quarterly"), ("biennially", "annually"),
    ("not less than", "not more than"), ("not more than", "not less than"), ("each", "every"),
)
#: Words before the first quote, words of a quote and quotes of a text; words and characters at a quote's head that are not edited.
LEAD_WORDS, QUOTE_WORDS, QUOTES, HEAD_WORDS, HEAD_CHARS = 70, 34, 4, 5, 25


def altered(quote: str, text: str) -> str | None:
    """The quote with one edit after its head, so that text doesn't hold it; null if no edit does that.

    Numbers of up to four digits are raised by one, the first that serves; else the first
    word of SWAPS that serves is swapped.
    """
    words = quote.split(" ")
    raised = (" ".join([*words[:i], str(int(w) + 1), *words[i + 1 :]]) for i, w in enumerate(words) if i >= HEAD_WORDS and re.fullmatch(r"[0-9]{1,4}", w))
    places = ((quote.find(old, HEAD_CHARS), old, new) for old, new in SWAPS)
    swapped = (quote[:at] + new + quote[at + len(old) :] for at, old, new in places if at >= 0)
    return next((x for x in itertools.chain(raised, swapped) if x not in text), None)


def altered_quotes(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Quotes at even distances behind the lead of every text, each with an altered copy that the text does not hold.

    Returns id_col, k (the quote's number from 0), quote and altered (null where no edit
    works). White space counts as one blank. Texts that are null or no longer than lead and
    quote give no row.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text in zip(frame[id_col], frame[text_col], strict=True):
                words = (text or "").split()
                usable = len(words) - LEAD_WORDS - QUOTE_WORDS
                if usable <= 0:
                    continue
                whole = " ".join(words)
                for k in range(QUOTES):
                    start = LEAD_WORDS + usable * k // QUOTES
                    quote = " ".join(words[start : start + QUOTE_WORDS])
                    out.append((key, k, quote, altered(quote, whole)))
            yield pd.DataFrame(out, columns=[id_col, "k", "quote", "altered"])

    return documents.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, k int, quote string, altered string")

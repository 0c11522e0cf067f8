"""What is kept over batches: keyed tables, stream state that expires, runs over ranges, spans by year."""

from __future__ import annotations

import datetime as dt
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from statutory.operators import changes, rollcall
from statutory.operators.keyed import KeyedTable
from statutory.streaming import jobs

D = dt.datetime


# --- keyed tables


@pytest.mark.parametrize("wins", ["first", "last"])
def test_keyed_table(spark, tmp_path, wins):
    rng = random.Random(1)
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", ["k"], wins, buckets=5)
    assert table.read().collect() == []
    held: dict = {}
    for number in range(6):
        rows = {rng.choice([None, *"abcdefghij"]): rng.randrange(1000) for _ in range(5)}
        batch = spark.createDataFrame(list(rows.items()), "k string, v long")
        table.add(batch, number)
        table.add(batch, number)  # run again
        for k, v in rows.items():
            if wins == "last" or k not in held:
                held[k] = v
        if number in (2, 4):
            table.compact()
            table.compact()  # nothing new
        if number == 4:
            table.vacuum()
        assert {r.k: r.v for r in table.read().collect()} == held
    asked = spark.createDataFrame([("a",), (None,), ("zz",)], "k string")
    assert {r.k: r.v for r in table.read(asked).collect()} == {k: v for k, v in held.items() if k in ("a", None)}


def test_a_batch_reads_no_earlier_one(spark, tmp_path):
    """Later batches are written although the files of all earlier ones are out of reach."""
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", ["k"])
    for number in range(3):
        table.add(spark.createDataFrame([("a", number)], "k string, v long"), number)
    (tmp_path / "t" / "batches").rename(tmp_path / "away")
    table.add(spark.createDataFrame([("b", 9)], "k string, v long"), 3)
    for folder in (tmp_path / "away").iterdir():
        folder.rename(tmp_path / "t" / "batches" / folder.name)
    assert {r.k: r.v for r in table.read().collect()} == {"a": 0, "b": 9}


def test_reading_keys_opens_their_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", ["k"])
    table.add(spark.createDataFrame([(f"k{i}", i) for i in range(300)], "k string, v long"), 0)
    table.compact()
    one = table.read(spark.createDataFrame([("k7",)], "k string"))
    files = [set(x.inputFiles()) for x in (one, table.read())]
    assert [r.v for r in one.collect()] == [7] and len({f.split("bucket=")[1].split("/")[0] for f in files[1]}) > 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


# --- streams


def in_order(spark, folder, parts, schema):
    """A stream that reads one part for each batch, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={i}")
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def test_late_rows_are_dropped(spark, tmp_path):
    parts = [[(D(2024, 1, 10), "x")], [(D(2024, 1, 10, 5), "x")], [(D(2024, 1, 1), "late"), (D(2024, 1, 9, 23), "x"), (D(2024, 1, 20), "x")]]
    stream = jobs.trend(in_order(spark, tmp_path, parts, "at timestamp, kind string"), "at", "kind", "1 day", "2 days")
    found = jobs.drain(stream, mode="update").groupBy("period", "dimension").agg(F.max("count").alias("n")).collect()
    assert {(r.period.day, r.dimension, r.n) for r in found} == {(10, "x", 2), (9, "x", 1), (20, "x", 1)}  # the row of nine days is gone


def test_silent_keys_are_forgotten(spark, tmp_path):
    """b is silent for more than five days, so its next row is a first one; a isn't; a row beyond the delay is dropped."""
    parts = [
        [(D(2024, 1, 1), 1, "a", "x"), (D(2024, 1, 1), 2, "b", "x")],
        [(D(2024, 1, 5), 3, "a", "y")],
        [(D(2024, 1, 9), 4, "a", "y")],
        [(D(2024, 1, 9, 12), 5, "b", "x"), (D(2024, 1, 2), 6, "a", "late")],
        [(D(2024, 1, 10), 7, "a", None), (D(2024, 1, 10), 8, "b", "z")],
    ]
    stream = in_order(spark, tmp_path, parts, "at timestamp, seq int, bill string, value string")
    found = jobs.drain(jobs.changes(stream, "bill", ["at", "seq"], "value", "1 day", 5)).collect()
    assert {(r.bill, r.seq, r.old_value, r.new_value) for r in found} == {("a", 1, None, "x"), ("b", 2, None, "x"), ("a", 3, "x", "y"), ("b", 5, None, "x"), ("a", 7, "y", None), ("b", 8, "x", "z")}


# --- runs of failures


def walked(rows):
    out = {}
    for endpoint, group in itertools.groupby(sorted(r for r in rows if r[3] != "queued"), key=lambda r: r[0]):
        longest = current = 0
        for _, _, _, status in group:
            current = 0 if status == "delivered" else current + 1
            longest = max(longest, current)
        out[endpoint] = (longest, current, longest >= 5)
    return out


@pytest.mark.parametrize(("seed", "parts"), [(0, 1), (1, 4), (2, 13), (3, 60)])
def test_runs_over_ranges(spark, seed, parts):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        endpoint = rng.choice(["hot", "hot", "hot", "e1", "e2"])
        chance = 0.97 if endpoint == "e1" else 0.6
        rows.append((endpoint, D(2024, 1, 1) + dt.timedelta(hours=rng.randrange(300)), i, rng.choice(["failed", "dead_letter"]) if rng.random() < chance else rng.choice(["delivered", "queued"])))
    rows += [("never", D(2024, 1, 1), 1000 + i, "failed") for i in range(7)] + [("always", D(2024, 1, 1), 2000, "delivered")]
    made = spark.createDataFrame([(e, t, str(i), s) for e, t, i, s in rows], "endpoint_id string, attempted_at timestamp, id string, status string")
    got = {r.endpoint_id: (r.longest, r.current, r.disabled) for r in changes.circuit_breaker(made, 5, parts).collect()}
    assert got == walked(rows)
    if parts > 1:
        assert changes.run_summaries(made, parts).where("endpoint_id = 'hot'").count() > 1


# --- spans


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spans_by_year_equal_broadcast_spans(spark, how):
    rng = random.Random(5)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(4000))
    votes = [(f"v{i}", rng.choice(["p1", "p2", "p3", None, "none"]), rng.choice([day(), day(), day(), None])) for i in range(300)]
    spans = []
    for p in ("p1", "p2", "p3", None):
        cuts = sorted({day() for _ in range(6)} | {dt.date(1995, 5, 5)})
        spans += [(p, rng.choice("DRI"), a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
    spans += [("p1", "X", dt.date(2005, 1, 1), dt.date(2005, 1, 1)), ("p2", "Y", dt.date(2030, 1, 1), None), ("p2", "Z", None, None), ("p3", "O", dt.date(2001, 12, 31), dt.date(2002, 1, 1))]
    v = spark.createDataFrame(votes, "id string, person_id string, vote_date date")
    s = spark.createDataFrame(spans, "person_id string, party string, start_date date, end_date date")
    both = [sorted((tuple(r) for r in rollcall.party_asof(v, s, how, n).collect()), key=str) for n in (10**6, 0)]
    assert both[0] == both[1] and len(both[0]) > 100
    none = votes[:0]
    assert rollcall.party_asof(spark.createDataFrame(none, v.schema), s, how, 0).collect() == []

"""The kept keyword index against scoring all documents."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from statutory.operators import postings, search


def made(n, seed=4):
    rng = random.Random(seed)
    rows = [(f"d{i:04d}", " ".join(rng.choice(["tax", "water", "road", "school"]) if rng.random() < 0.2 else f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randrange(60)))) for i in range(n)]
    return [*rows, ("e1", None), ("e2", ""), ("e3", "tax"), ("e4", "tax tax tax"), ("e5", "Tax, TAX! tax?")]


QUERIES = [("q1", "tax"), ("q2", "water road w7"), ("q3", "the and of"), ("q4", "unknownword"), ("q5", None), ("q6", "school school w1 w2 w3 w4"), ("q7", "")]


@pytest.mark.parametrize("range_rows", [1024, 16])
def test_search_equals_scoring_everything(spark, tmp_path, monkeypatch, range_rows):
    monkeypatch.setattr(postings, "RANGE_ROWS", range_rows)
    documents = spark.createDataFrame(made(500), "id string, document string")
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    index = postings.PostingsIndex(spark, str(tmp_path / "index"))
    assert index.batches() == set()
    for number, part in enumerate((F.col("id") < "d0200", F.col("id").between("d0200", "d0399"), F.col("id") > "d0399")):
        index.append(documents.where(part), number)
    index.append(documents, 1)  # tried again: nothing is added
    index.append(documents, 9)
    (spark.read.parquet(f"{index.path}/stats").where("batch <> 9")).coalesce(1).write.parquet(f"{index.path}/kept")  # as if it had failed before its end
    shutil.rmtree(f"{index.path}/stats")
    shutil.move(f"{index.path}/kept", f"{index.path}/stats")
    assert index.batches() == {0, 1, 2}
    for k in (1, 10, 1000):
        want = search.bm25(documents, queries, k).collect()
        got = index.search(queries, k).collect()
        assert {(r.query_id, r.id, r["rank"], round(r.score, 9)) for r in got} == {(r.query_id, r.id, r["rank"], round(r.score, 9)) for r in want}
        assert len(got) == len(want) and {r.query_id for r in got} == {"q1", "q2", "q6"}


def test_search_reads_its_buckets_and_skips_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_ROWS", 16)
    about = [(f"b{i}", "tax road " * 6 + f"w{i}") for i in range(8)]  # a few documents are about the query
    documents = spark.createDataFrame([*made(2000), *about], "id string, document string")
    index = postings.PostingsIndex(spark, str(tmp_path / "index"))
    index.append(documents, 0)
    terms = spark.createDataFrame([("tax",), ("road",)], "term string")
    read, every = index.read(terms).select("bucket").distinct().count(), index.blocks().select("bucket").distinct().count()
    assert read <= 2 < every
    plan = index.read(terms)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    scored = []
    score = postings.PostingsIndex._score
    monkeypatch.setattr(postings.PostingsIndex, "_score", staticmethod(lambda w, b, r: scored.append(r.count()) or score(w, b, r)))
    queries = spark.createDataFrame([("q", "tax road")], "query_id string, query string")
    assert index.search(queries, 5).count() == 5
    ranges = index.blocks().select("range").distinct().count()
    assert sum(scored) <= ranges / 2


def test_index_without_documents(spark, tmp_path):
    index = postings.PostingsIndex(spark, str(tmp_path / "index"))
    index.append(spark.createDataFrame([], "id string, document string"), 0)
    assert index.search(spark.createDataFrame(QUERIES, "query_id string, query string"), 5).collect() == []

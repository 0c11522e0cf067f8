"""The neighbour index: recall and share of scored pairs against exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from statutory.operators import neighbours, search
from statutory.plans import catalog
from statutory.plans.views import Tables


def measured(rows, k, least):
    """Recall against exact search in other kinds, and the share of all pairs that were scored."""
    held = rows.select("bill_id", "kind", "unit")
    index = neighbours.fit_index(held, k, least)
    found = neighbours.nearest_in_cells(index, held, held, k, least).toPandas()
    local = held.toPandas()
    unit, kinds, names = np.stack(local["unit"]), local["kind"].to_numpy(), local["bill_id"].to_numpy()
    place = {x: i for i, x in enumerate(names)}
    scores = unit @ unit.T
    scores[kinds[:, None] == kinds[None, :]] = -2
    best = np.argsort(-scores, 1)[:, :k]
    exact = {(i, j) for i, row in enumerate(best.tolist()) for j in row if scores[i, j] > least}
    hits = found.dropna(subset=["held_id"])
    got = {(place[a], place[b]) for a, b in zip(hits["asked_id"], hits["held_id"], strict=True)}
    assert all(abs(scores[place[a], place[b]] - s) < 1e-9 and s > least for a, b, s in zip(hits["asked_id"], hits["held_id"], hits["score"], strict=True))
    return index, len(exact & got) / max(len(exact), 1)


def scored(index, rows):
    """Pairs whose exact score was computed: those of probed cells with close codes, of other kinds."""
    local = rows.toPandas()
    unit, kinds = np.stack(local["unit"]), local["kind"].to_numpy()
    own, probed, codes = index.cells(unit, 1)[:, 0], index.cells(unit, index.probes), index.codes(unit)
    n = 0
    for i in range(len(unit)):
        close = np.isin(own, probed[i]) & (kinds != kinds[i]) & (np.bitwise_count(codes ^ codes[i]).sum(1) <= index.differing)
        n += int(close.sum())
    return n / (len(unit) * (len(unit) - 1))


def test_recall_and_pruning_on_bills(spark):
    vectors = search.unit(Tables(spark, "/root/testdata/sf0.1").bill_embeddings).select("bill_id", F.col("jurisdiction_id").alias("kind"), "unit")
    index, recall = measured(vectors, 5, 0.25)
    share = scored(index, vectors)
    print("recall", recall, "share", share, "probes", index.probes, "of", len(index.centres))
    assert recall >= 0.9 and share <= 0.1


def test_cells_prune_where_vectors_form_groups(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    made = centres[rng.integers(0, 40, 1500)] + 0.25 * rng.normal(size=(1500, 24))
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, f"k{i % 7}", v.tolist()) for i, v in enumerate(made)], "bill_id long, kind string, unit array<double>")
    index, recall = measured(rows, 5, 0.5)
    assert recall >= 0.9 and scored(index, rows) <= 0.1
    assert index.probes <= len(index.centres) // 4


@pytest.mark.parametrize("part_rows", [4096, 7])
def test_parts_change_nothing(spark, part_rows):
    """One cell that holds all rows is met in parts; with every bit allowed the search is exact."""
    rng = np.random.default_rng(5)
    made = rng.normal(size=(60, 6))
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, f"k{i % 3}", v.tolist()) for i, v in enumerate(made)], "bill_id long, kind string, unit array<double>")
    index = neighbours.NeighbourIndex(made[:1], rng.normal(size=(6, 256)), 1, 256)
    found = neighbours.nearest_in_cells(index, rows, rows, 60, 0.1, part_rows).where("held_id is not null").collect()
    scores = made @ made.T
    assert {(r.asked_id, r.held_id) for r in found} == {(i, j) for i in range(60) for j in range(60) if i % 3 != j % 3 and scores[i, j] > 0.1}
    assert len(found) == len({(r.asked_id, r.held_id) for r in found})


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "bill_id long, jurisdiction_id string, embedding array<double>")
    assert search.similar_bills_lsh(none, 5, 0.25).collect() == []
    zeros = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "b", [0.0, 0.0])], "bill_id long, jurisdiction_id string, embedding array<double>")
    assert search.similar_bills_lsh(zeros, 5, 0.25).collect() == []


def test_both_ways_find_similar_bills(spark):
    rng = np.random.default_rng(6)
    made = rng.normal(size=(80, 4))
    rows = spark.createDataFrame([(f"b{i}", f"k{i % 5}", v.tolist()) for i, v in enumerate(made)], "bill_id string, jurisdiction_id string, embedding array<double>")
    exact, indexed = ({tuple(r)[:2] for r in search.similar(rows, 3, 0.5, exact_rows=n).select("bill_id", "similar_id").collect()} for n in (1000, 10))
    assert exact and len(exact & indexed) >= 0.9 * len(exact)


def test_a_row_that_asks_meets_a_block_once(spark):
    """However many cells it probes, a row is sent to each block of cells once, and not to each cell."""
    rng = np.random.default_rng(8)
    made = rng.normal(size=(60, 6))
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, f"k{i % 3}", v.tolist()) for i, v in enumerate(made)], "bill_id long, kind string, unit array<double>")
    index = neighbours.NeighbourIndex(made[:50], rng.normal(size=(6, 256)), 50, 256)
    found = neighbours.nearest_in_cells(index, rows, rows, 3, 2.0).collect()
    assert sorted((r.asked_id, r.held_id, r.tested) for r in found) == [(i, None, 40) for i in range(60)]


def test_no_neighbours_without_a_jurisdiction(spark):
    rows = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [1.0, 0.1]), ("c", None, [1.0, 0.0])], "bill_id string, jurisdiction_id string, embedding array<double>")
    for find in (search.similar_bills, search.similar_bills_lsh):
        assert {(r.bill_id, r.similar_id) for r in find(rows, 3, 0.5).collect()} == {("a", "b"), ("b", "a")}


@pytest.mark.parametrize("name", ["diffusion", "similar_fallback"])
def test_queries_with_sql_are_exact_at_any_size(spark, monkeypatch, name):
    """Their SQL compares all pairs, so an index that misses some is not used however many vectors there are."""
    monkeypatch.setattr(search, "similar", None)
    monkeypatch.setattr(search, "similar_bills_lsh", None)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_copies_beyond_k_are_ranked_by_id(spark):
    """Far more equal vectors than are asked for, in blocks smaller than their number: the smallest ids are found."""
    rows = spark.createDataFrame([(f"b{i:03d}", f"k{i % 2}", [1.0, 2.0]) for i in range(700)], "bill_id string, jurisdiction_id string, embedding array<double>")
    for block_rows in (None, 50):
        got = {(r.bill_id, r.similar_id) for r in search.similar_bills(rows, 2, 0.5, block_rows).collect()}
        assert got == {(f"b{i:03d}", f"b{j:03d}") for i in range(700) for j in ((1, 3) if i % 2 == 0 else (0, 2))}


def test_blocks_are_of_bytes(spark):
    """65,536 vectors of 64 entries make a block, and fewer of longer ones."""
    assert search._block_rows(1000, 64_000) == 65_536 and search._block_rows(1000, 1_536_000) == 2_730 and search._block_rows(0, None) == 1

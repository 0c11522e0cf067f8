"""Training sets, models, resamples and nearest vectors: literal cases, tolerances and recall."""

import datetime as dt
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from statutory.functions import text as T
from statutory.operators import grading, predict, quality, search
from statutory.plans.views import Tables

D = dt.date


@pytest.fixture(scope="module")
def frame(spark):
    """Seven bills of which three count: the others are foreign, undated, of another class, of an open session."""
    bills = [
        ("1", "us", "us-110", "HR1", "A bill to reauthorize a Post Office", "enacted", D(2007, 2, 1), ["bill"]),
        ("2", "us", "us-110", "S2", None, "introduced", D(2008, 2, 1), ["bill"]),
        ("3", "us-ca", "us-110", "HR3", "x", "enacted", D(2007, 2, 1), ["bill"]),
        ("4", "us", "us-110", "HR4", "x", "enacted", None, ["bill"]),
        ("5", "us", "us-110", "HR5", "x", "enacted", D(2007, 2, 1), ["resolution"]),
        ("6", "us", "us-119", "HR6", "x", "enacted", D(2025, 2, 1), ["bill"]),
        ("7", "us", "us-110", "HR7", "To designate, appropriate and extend", "vetoed", D(2007, 2, 1), ["bill"]),
        ("8", "us", "us-110", "HR8", "x", "other", D(2007, 2, 1), ["bill"]),
    ]
    made = spark.createDataFrame(bills, "id string, jurisdiction_id string, session_id string, identifier string, title string, status string, introduced_date date, classification array<string>")
    sessions = spark.createDataFrame([("us-110", D(2007, 1, 1), D(2008, 12, 31)), ("us-119", D(2025, 1, 1), D(2027, 1, 1))], "id string, start_date date, end_date date")
    people = spark.createDataFrame([("p", "D"), ("q", "R"), ("r", "D"), ("t", None)], "id string, party string")
    sponsors = [("1", "p", "primary"), ("1", "q", "cosponsor"), ("1", "r", "cosponsor"), ("1", "t", "cosponsor"), ("1", "q", "original-cosponsor"), ("2", "p", "original-cosponsor"), ("7", "q", "cosponsor")]
    actions = spark.createDataFrame([("1", D(2007, 2, 1)), ("1", D(2007, 3, 1))], "bill_id string, action_date date")
    return predict.training_frame(made, sessions, spark.createDataFrame(sponsors, "bill_id string, person_id string, classification string"), people, actions, "2026-01-01")


def test_training_frame(frame):
    got = {r.bill_id: (r.cosponsor_count, r.bipartisan_cosponsor_count, r.action_count, r.label) for r in frame.collect()}
    assert got == {"1": (3, 1, 2, 1), "2": (0, 0, 0, 0), "7": (0, 0, 0, 1)}  # without a primary sponsor there are no cosponsors


def test_features(frame):
    got = {r.bill_id: r for r in predict.with_features(frame).collect()}
    assert {i: (r.passage_keyword_count, r.title_has_authoriz, r.title_length, r.title_word_count) for i, r in got.items()} == {"1": (3, 1, 35, 7), "2": (0, 0, 0, 0), "7": (2, 0, 36, 5)}
    one = got["1"]
    assert (one.days_active, one.congress_number, one.is_house_bill, got["2"].is_senate_bill) == (28, 110, 1, 1)
    assert one.actions_per_day == pytest.approx(2 / 28) and one.session_position == pytest.approx(31 / 730) and one.days_remaining == 699
    assert one.action_x_cosponsor == pytest.approx(np.log1p(2) * np.log1p(3)) and one.early_bill_x_actions == pytest.approx((1 - 31 / 730) * np.log1p(2))


@pytest.fixture(scope="module")
def labelled(spark):
    """Rows whose label follows their actions and cosponsors, with noise in both."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        label = int(rng.random() < 0.3)
        rows.append((f"b{i}", float(rng.normal(2 * label, 1)), float(rng.normal(label, 1)), float(rng.random()), float(rng.normal()), label))
    made = spark.createDataFrame(rows, "bill_id string, log_action_count double, log_cosponsor_count double, session_position double, noise double, label int")
    rest = [c for c in predict.FEATURES if c not in made.columns]
    return made.select("*", *[F.lit(0.0).alias(c) for c in rest]).cache()


def test_folds_are_stratified(labelled):
    found = predict.with_fold(labelled, 7).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in found if r.label == label]
        assert len(sizes) == 7 and max(sizes) - min(sizes) <= sum(sizes) / 7
    assert predict.FOLDS == 7


def test_models_rank_what_they_can_know(labelled, tmp_path):
    train, rest = labelled.where("hash(bill_id) % 3 <> 0"), labelled.where("hash(bill_id) % 3 = 0")
    one = rest.withColumn("all", F.lit(1))
    model = predict.train_logistic(train, ("log_action_count", "log_cosponsor_count", "noise"))
    scored = predict.score(model, one)
    assert predict.auroc(scored, ["all"]).first().auroc > 0.9
    factors = predict.key_factors(model, ("log_action_count", "log_cosponsor_count", "noise"), rest, 1).groupBy("feature").count().orderBy(F.desc("count")).first()
    assert factors.feature == "log_action_count"
    stack = predict.train_stack(train, folds=3, rounds=40, trees=20, depth=5, patience=15)
    scored = predict.score_stack(stack, one)
    assert predict.auroc(scored, ["all"]).first().auroc > 0.88
    predict.save_stack(stack, str(tmp_path / "stack"))
    again = predict.score_stack(predict.load_stack(str(tmp_path / "stack"), 3), one)
    assert {r.bill_id: r.p for r in again.collect()} == {r.bill_id: r.p for r in scored.collect()}
    factors = predict.key_factors(stack[1], predict.META, predict.with_meta(stack, rest), 2).collect()
    assert {r.feature for r in factors} <= set(predict.META) and len(factors) == 2 * rest.count()


def test_folds_are_fitted_in_few_jobs(spark, labelled):
    """The whole stack, of 2,000 rounds at most and 200 trees, is fitted in tens of jobs, not in one for every level of every tree."""
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("stack", "whole stack")
    models, layer = predict.train_stack(labelled)
    spark.sparkContext.setJobGroup("none", "")
    assert len(jobs.getJobIdsForGroup("stack")) < 250
    assert len(models.pairs) == 7 and all(len(forest) == 200 and len(boosted) >= 1 for boosted, forest in models.pairs)
    again, _ = predict.train_stack(labelled.repartition(9))
    assert all(np.array_equal(a.value, b.value) for x, y in zip(models.pairs, again.pairs, strict=True) for a, b in zip(x, y, strict=True))


def test_both_ways_to_fit_rank_alike(labelled):
    train, rest = labelled.where("hash(bill_id) % 3 <> 0"), labelled.where("hash(bill_id) % 3 = 0").withColumn("all", F.lit(1))
    found = []
    for fold_rows in (predict.FOLD_ROWS, 0):
        stack = predict.train_stack(train, folds=2, rounds=20, trees=15, depth=4, patience=10, fold_rows=fold_rows)
        found.append(predict.auroc(predict.score_stack(stack, rest), ["all"]).first().auroc)
    assert abs(found[0] - found[1]) < 0.03 and min(found) > 0.88


def test_boosting_ends_after_its_best_round(labelled):
    """Few trees are kept where the held-out loss soon rises, and all of them give the scores of a fit of that many rounds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["log_action_count", "noise"], outputCol="features").transform(labelled.withColumn("weight", F.lit(1.0)))
    inside, outside = data.where("hash(bill_id) % 2 = 0").cache(), data.where("hash(bill_id) % 2 <> 0").cache()
    cut = predict._boosted(inside, outside, "label", 60, 10)
    full = GBTClassifier(labelCol="label", weightCol="weight", maxIter=60, maxDepth=6, stepSize=predict.RATE, subsamplingRate=0.7, featureSubsetStrategy="0.7", minInstancesPerNode=10, seed=1).fit(inside)
    losses = full.evaluateEachIteration(outside)
    assert cut.getNumTrees == losses.index(min(losses)) + 1
    kept = cut.evaluateEachIteration(outside)
    assert kept == pytest.approx(losses[: len(kept)])


def test_bootstrap_agrees_with_resampling(spark):
    rng = np.random.default_rng(3)
    a, b = rng.gamma(4, 1, 120), rng.gamma(4, 0.25, 120)
    costs = spark.createDataFrame([("x", str(i), float(p), float(q)) for i, (p, q) in enumerate(zip(a, b, strict=True))] + [("x", "n", None, 1.0), ("y", "1", 1.0, 0.0)], "k string, instance_id string, cost_a double, cost_b double")
    got = {r.k: r for r in grading.bootstrap_ratio(costs, ["k"]).collect()}
    draws = rng.integers(0, 120, (10_000, 120))
    want = np.percentile(a[draws].mean(1) / b[draws].mean(1), [2.5, 50, 97.5])
    assert set(got) == {"x"}
    assert [got["x"].low, got["x"].median, got["x"].high] == pytest.approx(want, rel=0.02)


def test_resampled_sums(spark):
    """Every replicate of every group, whatever the tasks; counts are Poisson distributed and rows are drawn apart."""
    rows = spark.createDataFrame([(f"k{i % 300}" if i % 2 else None, i * 7919, 1.0, float(i % 3)) for i in range(1200)], "k string, _row long, cost_a double, cost_b double")
    key = lambda df: {(r.k, r.replicate): (round(r.a, 6), round(r.b, 6)) for r in df.groupBy("k", "replicate").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    one, many = (key(grading.resampled_sums(rows.repartition(n), ["k"], 301)) for n in (1, 5))
    assert one == many and len(one) == 151 * 301
    counts = np.array([a for (k, _), (a, _) in one.items() if k is None])  # 600 draws each
    assert abs(counts.mean() - 600) < 8 and abs(counts.var() / 600 - 1) < 0.35
    single = np.array([r.a for r in grading.resampled_sums(rows.limit(1), ["k"], 20_000).collect()])
    assert np.bincount(single.astype(int), minlength=4)[:4] / 20_000 == pytest.approx(np.exp(-1) / np.array([1, 1, 2, 6]), abs=0.015)


def test_mcnemar_of_many_pairs(spark):
    """Exact for all small counts, and for tens of thousands of discordant pairs in no more than seconds."""
    pairs = [(b, c) for b in range(25) for c in range(25)] + [(17_200, 16_900), (30_000, 30_000), (500, 40_000), (0, 2_000)]
    start = time.perf_counter()
    got = {(r.b, r.c): r.p for r in spark.createDataFrame(pairs, "b long, c long").withColumn("p", grading.mcnemar()).collect()}
    assert time.perf_counter() - start < 60
    for b, c in pairs:
        n, term, total = b + c, 1, 0
        for i in range(min(b, c) + 1):
            total += term
            term = term * (n - i) // (i + 1)
        assert got[b, c] == pytest.approx(float(min(Fraction(1), Fraction(2 * total, 2**n))), rel=1e-11, abs=1e-300)


def test_drift(spark):
    mark = "<MODEL_DRIFT requested=m-1 served={}>"
    cases = [("['m-1']", True), ("['m-1-20250101', '<synthetic>']", True), ("['m']", True), ("['m-12']", False), ("['m-1', 'n']", False), ("[]", True), ("[m-1]", False), ("['m-1'", False)]
    rows = [(i, mark.format(served), ["sandbox_infra"] if i == 1 else None) for i, (served, _) in enumerate(cases)] + [(99, "m-1", None), (98, None, None)]
    got = {r.id: (r.benign, r.restored) for r in grading.drift_triage(spark.createDataFrame(rows, "id int, raw string, error_kinds array<string>")).collect()}
    assert [got[i][0] for i in range(len(cases))] == [x for _, x in cases] and not got[99][0] and not got[98][0]
    assert got[0][1] == "success" and got[1][1] == "sandbox_infra" and got[3][1] is None


def test_gold(spark):
    cases = [
        (False, "x_vote_lookup", "exact", '"yea"', None), (False, "x_vote_lookup", "exact", '"maybe"', "option"), (False, "x_vote_lookup", "exact", "3", "option"), (False, "t", "exact", "3", None),
        (True, "t", "exact", '"not_in_the_data"', None), (True, "t", "exact", "3", "refusal"), (True, "t", "exact", None, "refusal"), (False, "t", "exact", None, "empty"), (False, "t", "exact", '""', "empty"),
        (False, "t", "fields", "{}", "fields"), (False, "t", "fields", '{"a": null}', "fields"), (False, "t", "fields", '{"a": 1.5}', "fields"), (False, "t", "fields", '{"a": "x", "b": 2}', None), (False, "t", "fields", "[1]", "fields"),
        (False, "t", "set_match", "[]", None), (False, "t", "set_match", "{}", "set"), (False, "t", "exact_int", "0", None), (False, "t", "exact_int", "true", "int"), (False, "t", "exact_int", '"1"', "int"),
    ]
    made = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, is_refusal boolean, template_id string, grader string, gold string")
    got = {r.i: r.rule for r in made.select("i", grading.gold_violation().alias("rule")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[4] for c in cases]


def test_references_by_the_grammar(spark):
    rules = "HR1; h. j. res. 2, H.Con.Res.3 H.Res. 4 sec. S. 5, S 6, S.J.Res 7; P.L. 1-2, Public  Law 3–4, Section 8 s.9"
    found = spark.range(1).select(T.references_in_rules(F.lit(rules)).alias("a"), T.references_in_reports(F.lit("H.R.1, HR 2 S.Con.Res. 3 S. 4 H.Res. 5 H.R. 1")).alias("b")).first()
    assert found.a == ["HCONRES 3", "HJRES 2", "HR 1", "PL 1-2", "PL 3-4", "S 6", "S 9", "SJRES 7"]
    assert found.b == ["HR 1", "SCONRES 3", "S 4", "HRES 5"]


def test_blocks_give_what_the_broadcast_gives(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    vectors = t.bill_embeddings.select("bill_id", "embedding")
    asked = vectors.where("cast(bill_id as long) % 20 = 0").withColumnRenamed("bill_id", "query_id")
    key = lambda df: {(r.query_id, r.id, r.rank): round(r.score, 9) for r in df.collect()}
    assert key(search.vector_search(vectors, asked, 5)) == key(search.vector_search(vectors, asked, 5, broadcast_bytes=0))
    whole, parts = (search.similar_bills(t.bill_embeddings, 5, 0.25, n) for n in (4096, 37))
    assert {tuple(r)[:2] for r in whole.collect()} == {tuple(r)[:2] for r in parts.collect()}


def test_recall_of_hashed_neighbours(spark):
    """Of the exact neighbours in other jurisdictions of every twentieth bill, the index finds nine in ten at least."""
    vectors = Tables(spark, "/root/testdata/sf0.1").bill_embeddings
    asked = vectors.where("cast(bill_id as long) % 20 = 0").select(F.col("bill_id").alias("query_id"), "embedding")
    home = vectors.select(F.col("bill_id").alias("id"), F.col("jurisdiction_id").alias("there"))
    exact = search.vector_search(vectors, asked, 11).where("id <> query_id and score > 0.25").where("rank <= 6").join(home, "id")
    exact = exact.join(vectors.select(F.col("bill_id").alias("query_id"), "jurisdiction_id"), "query_id").where("there <> jurisdiction_id")
    found = search.similar_bills_lsh(vectors, 10, 0.25).select(F.col("bill_id").alias("query_id"), F.col("similar_id").alias("id"))
    n, met = exact.count(), exact.join(found, ["query_id", "id"], "left_semi").count()
    print("recall", met, n)
    assert n > 100 and met >= 0.9 * n

"""Pair analytics by bitmaps against the votes themselves."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from statutory.operators import rollcall


def made(rng, events=150, people=12):
    return [(w, f"e{w}{i}", f"p{p}", rng.choice(["yea", "nay", "nay", "present", "not_voting"])) for w in ("x", "y") for i in range(events) for p in range(people) if rng.random() < 0.7]


@pytest.mark.parametrize("bitmaps", [True, False, None])
def test_agreement_counts(spark, bitmaps):
    rows = made(random.Random(2))
    votes = spark.createDataFrame(rows, "w string, vote_event_id string, person_id string, option string")
    got = {(r.w, r.a, r.b): (r.shared, r.agreements) for r in rollcall.pairwise_agreement(votes, ["w"], bitmaps).collect()}
    said = {(w, e, p): o for w, e, p, o in rows if o in ("yea", "nay")}
    want = {}
    for w in ("x", "y"):
        for a, b in combinations(sorted({p for _, _, p, _ in rows}), 2):
            both = [(said[w, e, a], said[w, e, b]) for e in {e for v, e, _ in said if v == w} if (w, e, a) in said and (w, e, b) in said]
            if both:
                want[w, a, b] = (len(both), sum(x == y for x, y in both))
    assert got == want


def test_every_bit_is_used(spark):
    """One bucket of more than two blocks: the sign bit of a long is an event like any other."""
    rows = [("x", f"e{i:03d}", p, "yea" if p == "a" or i % 3 else "nay") for i in range(150) for p in "ab"]
    votes = spark.createDataFrame(rows, "w string, vote_event_id string, person_id string, option string")
    places = rollcall.event_places(votes, ["w"], buckets=1)
    assert sorted({(r.block, r.bit) for r in places.collect()}) == [(i // 64, i % 64) for i in range(150)]
    bits = {(r.person_id, r.block): (r.yea, r.nay) for r in rollcall.vote_bits(votes, places, ["w"]).collect()}
    assert bits["a", 0] == (-1, 0) and bits["b", 2][1] == sum(1 << i % 64 for i in range(128, 150) if i % 3 == 0)
    pairs = spark.createDataFrame([("a", "b"), ("a", "z")], "a string, b string")
    for bitmaps in (True, False, None):
        got = {(r.a, r.b): r.events for r in rollcall.disagreements(votes, pairs, bitmaps).collect()}
        assert got == {("a", "b"): [f"e{i:03d}" for i in range(0, 150, 3)], ("a", "z"): []}


def test_bitmaps_are_used_where_most_members_vote(spark):
    full = [(f"e{i}", f"p{p}", "yea") for i in range(100) for p in range(20)]
    thin = [(f"e{i}", f"p{p}", "yea") for i in range(100) for p in (i % 20, (i + 1) % 20)]
    for rows, want in ((full, True), (thin, False)):
        votes = spark.createDataFrame(rows, "vote_event_id string, person_id string, option string")
        bits = rollcall.vote_bits(votes, rollcall.event_places(votes, []), [])
        assert rollcall.dense(votes, bits, ["bucket", "block"]) == want


def test_pairs_without_votes(spark):
    none = spark.createDataFrame([], "w string, vote_event_id string, person_id string, option string")
    assert rollcall.pairwise_agreement(none, ["w"]).collect() == []


def test_a_member_is_sent_once_for_each_event(spark):
    """Where members meet per event, what is shuffled is a row for each vote, not for each pair."""
    rows = [("x", f"e{i}", f"p{j}", "yea" if (i + j) % 3 else "nay") for i in range(12) for j in range(30)]
    votes = spark.createDataFrame(rows, "w string, vote_event_id string, person_id string, option string")
    found = rollcall.pairwise_agreement(votes, ["w"], False)
    assert found.count() == 30 * 29 // 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression [w" in plan

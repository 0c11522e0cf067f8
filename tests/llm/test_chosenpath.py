"""The set similarity join against all pairs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from statutory.llm import chosenpath
from statutory.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return None
    return frozenset([tuple(words)] if len(words) < 4 else zip(words, words[1:], words[2:], words[3:]))


def expected(rows):
    holders = defaultdict(list)
    for doc, text in rows:
        holders[shingle_set(text)].append(doc)
    found = [s for s in holders if s is not None]
    group = list(range(len(found)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    by_shingle = defaultdict(list)
    for i, own in enumerate(found):
        for j, shared in Counter(j for x in own for j in by_shingle[x]).items():
            if 100 * shared >= 80 * (len(own) + len(found[j]) - shared):
                group[root(i)] = root(j)
        for x in own:
            by_shingle[x].append(i)
    least = {}
    for i, s in enumerate(found):
        for doc in holders[s]:
            if doc is not None:
                least[root(i)] = min(least.get(root(i), doc), doc)
    place = {s: i for i, s in enumerate(found)}
    result = []
    for doc, text in rows:
        own = shingle_set(text)
        component = doc if own is None else least.get(root(place[own]))
        result.append((doc, len(own or ()), component, doc is not None and doc == component))
    return sorted(result, key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return words


@pytest.fixture(scope="module")
def rows():
    """Groups of near-copies around one text and in chains, close to the threshold on both sides, and awkward rows."""
    rng = random.Random(3)
    texts = []
    for size, length, edits in ((60, 120, 3), (60, 120, 7), (30, 40, 1), (40, 400, 10)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        texts += [" ".join(edited(rng, base, rng.randrange(edits + 1))) for _ in range(size)]
        chain = base
        for _ in range(size // 3):
            chain = edited(rng, chain, edits // 2 + 1)
            texts.append(" ".join(chain))
    licence = " ".join(f"licence{i}" for i in range(30))
    texts += [f"{licence} {' '.join(f'x{rng.randrange(10**6)}' for _ in range(rng.randrange(5, 60)))}" for _ in range(50)]
    made = [*enumerate(texts), (1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two three"), (1004, "ONE  two\nthree"), (1005, "one two three four"), (1006, "a b c d e f g h"), (1007, "a b c d e f g")]
    made += [(2000, texts[0]), (2000, texts[0]), (2001, texts[0].upper()), (None, texts[1]), (None, "lone text without any id here"), (None, "lone text without any id here")]
    made += [(1008, "Ünï cödé ß 漢字 text here"), (1009, "ünï cödé ß 漢字 text here")]
    return made


@pytest.mark.parametrize("small", [False, True])
def test_all_pairs(spark, rows, monkeypatch, small):
    """Whatever the sizes are at which nodes branch, are dealt in parts, and rows are joined."""
    if small:
        for name, value in {"NODE_ROWS": 8, "LARGEST_NODE": 16, "DEPTH": 2, "LEADER_ROWS": 10, "BROADCAST_ROWS": 0}.items():
            monkeypatch.setattr(chosenpath, name, value)
    made = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in ("row", "key", "n", "sig", "id", "node", "cluster")])
    got = sorted((tuple(r) for r in chosenpath.near_duplicate_sets(made).collect()), key=str)
    assert got == expected(rows)


def test_the_smallest_table(spark):
    rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    assert sorted((tuple(r) for r in QUERIES["op13_chosenpath"](spark, FOLDER).collect()), key=str) == expected(rows)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(7)
    texts = [b"".join(rng.choice([b"a", b"B", b" ", b"  ", b"\n", b"cd", "é".encode()]) for _ in range(rng.randrange(120))) for _ in range(200)]
    whole = [chosenpath.shingles(t).tolist() for t in texts]
    assert [len(w) for w in whole] == [len(shingle_set(t.decode()) or ()) for t in texts]
    monkeypatch.setattr(chosenpath, "PART_BYTES", 5)
    assert [chosenpath.shingles(t).tolist() for t in texts] == whole


def test_nothing(spark):
    for rows in ([], [(1, None), (2, "")]):
        got = chosenpath.near_duplicate_sets(spark.createDataFrame(rows, "doc_id long, text string"))
        assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert sorted(tuple(r) for r in got.collect()) == [(i, 0, i, True) for i, _ in rows]


def test_spanning_links_connect_what_is_near():
    rng = np.random.default_rng(4)
    places = rng.integers(0, 400, 150)
    links = chosenpath.spanning(len(places), lambda x, rest: np.abs(places[rest] - places[x]) <= 2, [3, 4])
    group = list(range(len(places)))
    group[4] = 3

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links.tolist():
        assert abs(places[a] - places[b]) <= 2 and root(a) != root(b)
        group[root(a)] = root(b)
    assert all(root(a) == root(b) for a in range(150) for b in range(150) if abs(places[a] - places[b]) <= 2)

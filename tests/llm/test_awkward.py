"""Awkward rows, brute force over whole small tables, and what must not depend on size."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statutory.llm import chat, language, lines, media, packing, repeats, simhash, toxicity
from statutory.llm.queries import QUERIES
from tests.llm.test_llm_operators import removed, repeated_words, words

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("score", "fp", "key", "media", "piece", "length", "bucket", "carried", "first", "mask", "linked", "root", "n_bytes", "lang_pred", "held_out")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- toxicity


def uncut(emissions, transitions):
    """Marginals of the second state by sums over both states in logarithms, one place after the other."""
    n, e = len(emissions), np.stack([np.zeros(len(emissions)), emissions], 1)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = e[0]
    for t in range(1, n):
        ahead[t] = [np.logaddexp(*(ahead[t - 1] + transitions[:, j])) + e[t, j] for j in (0, 1)]
    for t in range(n - 2, -1, -1):
        back[t] = [np.logaddexp(*(transitions[j] + e[t + 1] + back[t + 1])) for j in (0, 1)]
    return np.exp(ahead + back - np.logaddexp(*ahead[-1]))[:, 1]


@pytest.mark.parametrize("alone", [1, 12, 100])
def test_chains_are_not_cut(alone, monkeypatch):
    monkeypatch.setattr(toxicity, "ALONE", alone)
    rng = np.random.default_rng(0)
    sticky = np.array([[2.0, -2.0], [-2.0, 2.0]])
    lengths = [0, 1, 200, 1000, 128, 129, 0, 256, *rng.integers(1, 400, 30).tolist()]
    parts = [rng.normal(size=n) * 0.1 for n in lengths]
    parts[2][:] = 0
    parts[2][127] = 3.0  # what stands at one place is felt at the next, wherever it is
    found = np.split(toxicity.forward_backward(lengths, np.concatenate(parts), sticky)[0], np.cumsum(lengths)[:-1])
    for got, own in zip(found, parts, strict=True):
        assert not len(own) or np.allclose(got, uncut(own, sticky), atol=1e-9)
    assert found[2][128] == pytest.approx(found[2][126], abs=1e-6) and found[2][128] > 0.9


def test_toxicity_of_a_very_long_text(spark):
    rng = random.Random(2)
    rows = [(i, f"{words(rng, 60)} {'scum ' * (i % 4 == 0)}{words(rng, 60)}", int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, words(rng, 300_000)), (501, words(rng, 300_000) + " scum"), (501, words(rng, 300_000) + " scum")], "doc_id long, text string")
    model = toxicity.train_on(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), F.lit(True))
    got = Counter((r.doc_id, r.predicted) for r in toxicity.score_documents(docs, model).where("doc_id >= 500").collect())
    assert got == Counter({(500, 0): 1, (501, 1): 2})


# --- line dedup


def test_recall_of_line_dedup(spark):
    """What alignment of every pair of texts would delete, first holders found as here, is deleted."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r.n_removed for r in QUERIES["op3_lines"](spark, FOLDER).collect()}
    text_of: dict[str, int] = {}
    for r in rows:
        if r.text and r.text not in text_of:
            text_of[r.text] = r.doc_id
    import re

    count = re.compile(r"\S+")
    split = {i: [x.strip(" ") for x in t.split("\n")] for t, i in text_of.items()}
    sizes = {i: [len(count.findall(x)) for x in own] for i, own in split.items()}
    want = {}
    for b, own in split.items():
        gone: set[int] = set()
        for a, other in split.items():
            if a < b and set(other) & set(own):
                gone |= set(lines.common_blocks(other, own, sizes[b]))
        want[b] = len(gone)
    total = sum(want.values())
    missed = sum(max(0, n - got[i]) for i, n in want.items())
    print("lines", total, "missed", missed)
    assert total > 20 and missed <= 0.02 * total
    assert all(got[i] <= n for i, n in want.items())


def test_heavy_lines_are_joined_in_parts(spark, monkeypatch):
    rows = [(i, f"one line that every text of these has\nown {i} stands here as well") for i in range(90)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    want = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs).collect()}
    for limit in (200_000, 0):  # broadcast, and not
        monkeypatch.setattr(lines, "HEAVY_TEXTS", 7)
        monkeypatch.setattr(lines, "BROADCAST_LINES", limit)
        assert {r.doc_id: r.n_removed for r in lines.dedup_lines(docs).collect()} == want
    assert want[0] == 0 and all(want[i] == 1 for i in range(1, 90)) and want[100] == want[101] == 0


def test_line_dedup_of_nothing(nothing):
    assert lines.dedup_lines(nothing).count() == 0 and lines.with_deduped_text(nothing).count() == 0


# --- packing


def test_fitted_patterns_beat_best_fit_on_large_counts():
    """At ten times the counts most sequences come from the fit, and no more sequences are needed."""
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(1024, rng.lognormal(5.5, 1, 200_000).astype(int) + 1), minlength=1025)
    plan, plain = packing.plan(counts), packing.best_fit(counts, 1024)
    rows = packing.patterns(counts, 1024)
    fitted = np.floor(packing.fit(counts, rows)).sum()
    assert fitted > 0.5 * sum(t for _, t in plan)
    assert sum(t for _, t in plan) <= 1.001 * sum(t for _, t in plain)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_ranks_in_many_parts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", broadcast)
    rng = random.Random(3)
    rows = [(i if i % 9 else None, words(rng, 40)) for i in range(60)] + [(7, "same"), (7, "same"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x"))
    found = packing.pack(docs).collect()
    assert len(found) == len(rows)
    places: dict[int, list] = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert sorted(own) == [(a, n) for a, n in zip(itertools.accumulate([0, *[n for _, n in sorted(own)]]), [n for _, n in sorted(own)], strict=False)]


# --- media


def test_media_of_awkward_rows(spark, nothing):
    assert media.media_features(media.with_media(nothing)).count() == 0
    rows = [(1, None), (2, ""), (3, "x" * 700_000), (4, "ü" * 96), (4, "ü" * 96), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    got = media.media_features(media.with_media(docs)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes) for r in got) == Counter([(1, 0, 192), (2, 0, 192), (3, 700_000, 700_032), (4, 192, 192), (4, 192, 192), (None, 1, 192)])
    stored = media.with_media(docs).withColumn("media", F.lit(b"no image"))
    assert all(r.payload_bytes is None and r.media_bytes == 8 for r in media.media_features(stored).collect())


def test_cosine_hash_by_its_definition():
    """The sums of the transform written out, on an image of the grid's size."""
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (32, 32, 3), dtype=np.uint8)
    gray = image.astype(float).sum(2)
    low = [round(sum(gray[y, x] * np.cos(np.pi / 32 * (y + 0.5) * u) * np.cos(np.pi / 32 * (x + 0.5) * v) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    bits = [k > 0 and x > np.median(low[1:]) for k, x in enumerate(low)]
    assert media.cosine_hash(image) == np.packbits(bits).tobytes()


# --- repeats


def test_repeats_of_the_smallest_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = QUERIES["op7_repeats"](spark, FOLDER).collect()
    assert Counter(tuple(r)[:5] for r in found) == removed(rows, repeats.LENGTH)
    assert Counter((r.doc_id, r.n_repeated_words) for r in found) == repeated_words(rows, repeats.WORDS)


# --- chat


def test_a_conversation_named_null(spark):
    rows = [("null", 0, "user", "a"), (None, 0, "user", "b"), ("=null", 0, "user", "c"), ("-1", 0, "user", "d")]
    made = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    for c in ("tree", "node", "parent", "score", "rank", "path", "place", "turns", "formatted", "loss"):
        made = made.withColumn(c, F.lit("clash"))
    got = {r.conv_id: r.formatted for r in chat.format_conversations(made).collect()}
    assert got == {"null": "<s>[user]a</s>", None: "<s>[user]b</s>", "=null": "<s>[user]c</s>", "-1": "<s>[user]d</s>"}
    report = {r.conv_id: r.n_turns for r in chat.chat_report(chat.with_control_conversation(made)).collect()}
    assert report == {"null": 1, None: 1, "=null": 1, "-1": 3}


def test_ties_and_long_conversations(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 1.0), ("t", 3, 1, 1.0)] + [("v", i, i - 1 if i else None, None) for i in range(300)]
    found = chat.paths(spark.createDataFrame(rows, "tree string, node int, parent int, score double"))
    best = {r.tree: (r.leaf, len(r.path)) for r in chat.best_paths(found).collect()}
    assert best == {"t": (2, 2), "v": (299, 300)}
    long = spark.createDataFrame([(1, 0, "assistant", "<x]" * 100_000)], "conv_id long, turn long, role string, text string")
    report = chat.chat_report(long).first()
    assert (report.loss_chars, report.formatted_chars) == (300_000, 1_000_000 + 18)


# --- language


def longest(sample, text, at):
    """Length of the longest beginning of text[at:] that the sample holds."""
    n = 0
    while at + n < len(text) and text[at : at + n + 1] in sample:
        n += 1
    return n


def test_language_by_brute_force(monkeypatch):
    """Predictions follow from phrases that are counted by plain substring search."""
    rng = random.Random(6)
    stems = {"aa": ["tion", "the", "ing"], "bb": ["lich", "sch", "the"], "cc": ["que", "eau", "ing"]}
    make = lambda x, n: " ".join("".join(rng.choices(stems[x], k=rng.randrange(1, 4))) for _ in range(n))
    samples = {x: [make(x, 30) for _ in range(10)] for x in stems}
    model = language.LanguageModel(samples)
    kept = {x: " " + " ".join(t for i, t in enumerate(samples[x]) if i % 5 != 4) + " " for x in stems}

    def phrases(sample, text):
        at = n = 0
        while at < len(text):
            at += max(1, longest(sample, text, at))
            n += 1
        return n

    texts = [make(rng.choice(list(stems)), rng.randrange(1, 40)) + rng.choice(["", " ÉTÉ", " 12 !?", "\nxx"]) for _ in range(60)] + ["", "é", "zz zz"]
    own = [" " + " ".join(w.decode() for w in language.words_of(t)) + " " for t in texts]
    want = np.array([[phrases(kept[x], t) for x in model.languages] for t in own])
    for alone in (1, 12, 1000):
        monkeypatch.setattr(language, "ALONE", alone)
        counts, chars = model.phrases(texts)
        assert (counts == want).all() and chars.tolist() == [len(t) for t in own]
    costs = want / np.array([len(t) for t in own])[:, None] / np.array(model.norms)
    assert [x for x, _ in model.predict_all(texts)] == [model.languages[int(np.argmin(c))] if t else "und" for t, c in zip(texts, costs, strict=True)]


def test_language_of_awkward_rows(spark, nothing):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    assert language.identify_languages(nothing, held).count() == 0
    rng = random.Random(7)
    rows = [(i, words(rng, 30) if i % 2 else " ".join(rng.choices(["été", "où", "château"], k=30)), "en" if i % 2 else "fr", "s", 1) for i in range(80)]
    rows += [(900, "été où " * 200_000, None, "s", 1), (901, "été", None, "s", 1), (901, "été", None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    got = Counter((r.doc_id, r.lang_pred) for r in language.identify_languages(docs, held).where("doc_id >= 900").collect())
    assert got == Counter({(900, "fr"): 1, (901, "fr"): 2})


def test_a_tie_of_languages_goes_to_the_first():
    same = ["the same text for both of them"] * 6
    assert language.LanguageModel({"b": same, "a": same}).predict_all(["the text"])[0][0] == "a"


# --- SimHash


def test_simhash_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one_per_group(nothing).count() == 0


def test_finer_masks_hold_every_link():
    rng = random.Random(9)
    mask = (1 << 21) - 1
    for _ in range(3):
        finer = simhash.finer_masks(mask)
        for _ in range(200):
            a = rng.getrandbits(64)
            free = [b for b in range(64) if not mask >> b & 1]
            b = a ^ sum(1 << k for k in rng.sample(free, 4))
            assert any(a & m == b & m for m in finer)
        assert all(m & mask == mask and m != mask for m in finer)
        mask = finer[0]


# --- pipeline


def test_pipeline_with_awkward_rows(spark, tmp_path):
    """Nulls, repeated ids, clashing columns and unique texts without an id go through every stage."""
    rng = random.Random(11)
    rows = [(i, words(rng, 80, 10**6), "en", "s", 1) for i in range(40)]
    rows += [(None, words(rng, 80, 10**6), None, None, None), (None, rows[3][1], "en", "s", 1), (41, rows[4][1], "en", "s", 1), (5, rows[5][1], "en", "s", 1), (5, words(rng, 80, 10**6), "en", "s", 1)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (52, words(rng, 200_000, 10**6), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path)).cache()
        assert after.columns == docs.columns, name
        docs = after
    kept = Counter((r.doc_id, r.text[:40] if r.text else r.text) for r in docs.collect())
    texts = Counter(t for _, t in kept.elements())
    assert kept[(None, rows[40][1][:40])] == 1 and (7, rows[7][1][:40]) not in kept
    assert all(texts[rows[i][1][:40]] == 1 for i in range(40) if i != 7)  # one of every group, whatever its id
    assert (52, rows[-1][1][:40]) in kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_special_token_is_one_id(spark):
    docs = spark.createDataFrame([(1, "<|endoftext|> x")], "doc_id long, text string")
    found = packing.pack(docs).first()
    assert (found.length, found.ids_crc32) == (3, zlib.crc32(np.array([50256, 2124, 2], "<u4").tobytes()))

"""Alignment of two tokenizers against a walk over both token lists."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import accumulate

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

import public_tokenizers
from statutory.llm import alignment
from statutory.llm.queries import QUERIES
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"
BITS = ("a", "b", " ", "  ", "\n", "\t", " \n", "▁", "<|endoftext|>", "</s>", "<s>", "<0x41>", "é", "漢字", "'s", "12", "\0", "😀", "\r\n", "\x85", "\x1c", "\xa0", "hello", "world", " the ")


def letters() -> dict[str, int]:
    """The bytes that a byte-level vocabulary prints as letters."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}


@pytest.fixture(scope="module")
def tokens():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = letters()

    def of(text):
        ids = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        parts = [bytes(known[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        return (ids, parts) if all(b"".join(p) == f" {text}".encode() for p in parts) else None

    return of


def expected(rows, tokens):
    found, counts = [], Counter()
    for doc, text in rows:
        pair = tokens(text) if text else None
        if pair is None:
            found.append((doc, None))
            continue
        (a, b), (x, y) = pair
        ends = [list(accumulate(map(len, p))) for p in (x, y)]
        links, groups, i, j, from_a, from_b = [], [], 0, 0, 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            left, right = ends[0][i], ends[1][j]
            i, j = i + (left <= right), j + (right <= left)
            if left == right:
                groups.append(",".join(map(str, a[from_a:i])) + "|" + ",".join(map(str, b[from_b:j])))
                from_a, from_b = i, j
        found.append((doc, (len(a), len(b), groups, links)))
        counts.update(set(links))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    result = []
    for doc, held in found:
        if held is None:
            result.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = held
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            result.append((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(result, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    odd = ["".join(rng.choice(BITS) for _ in range(rng.randrange(15))) for _ in range(1500)]
    return [*enumerate(odd), (None, "the same"), (None, "the same"), (7, "the same"), (5000, None), (5001, ""), (5002, "ab cd " * 1000), (5003, "\n" * 500), (5004, "x" * 5000)]


@pytest.mark.parametrize("hot_pairs", [200_000, 40, 0])
def test_alignment_of_awkward_texts(spark, rows, tokens, hot_pairs):
    made = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in ("row", "pairs", "pair", "n", "best", "n_a")])
    got = [tuple(r) for r in alignment.alignment_report(made, hot_pairs=hot_pairs).collect()]
    assert sorted(got, key=str) == expected(rows, tokens)


def test_alignment_of_the_smallest_table(spark, tokens):
    rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    got = [tuple(r) for r in QUERIES["op11_alignment"](spark, FOLDER).collect()]
    assert sorted(got, key=str) == expected(rows, tokens)


def test_white_space_is_judged_alike_at_any_length(monkeypatch, rows):
    texts = [*(t for _, t in rows if t), " a", "a ", "a b", "a\x1cb", "a\x85\x85b", "a\xa0", "\n", " "]
    short = [alignment.lone_blanks(t) for t in texts]
    monkeypatch.setattr(alignment, "PART_CHARS", 0)
    assert [alignment.lone_blanks(t) for t in texts] == short and any(short) and not all(short)


def test_alignment_of_nothing(spark):
    got = alignment.alignment_report(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.collect() == []


def test_parts_and_forgotten_chunks_change_nothing(monkeypatch, rows):
    """Long texts are worked off in parts, and chunks are forgotten; the results are those of whole texts."""
    texts = [t for _, t in rows if t]

    def aligned():
        both = alignment.Tokenizers(*alignment.tokenizer_paths())
        docs = alignment.Documents(both, len(texts))
        for i, text in enumerate(texts):
            docs.add(i, text)
        docs.flush()
        pairs = [p.tolist() for p in docs.pairs], [t.tolist() for t in docs.times]
        kept = [not x for x in docs.altered]
        return [[x for x, k in zip(held, kept, strict=True) if k] for held in (*docs.counts.tolist(), [d and d.hexdigest() for d in docs.digest], *pairs)]

    whole = aligned()
    for name, value in (("PART_CHARS", 12), ("ALIGN_CHARS", 300), ("CACHE_CHUNKS", 20)):
        monkeypatch.setattr(alignment, name, value)
    assert aligned() == whole

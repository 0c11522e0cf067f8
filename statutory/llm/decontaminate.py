"""Benchmark decontamination with suffix arrays of the training text.

Each task sorts the suffixes of the documents it holds (a shard) and binary-searches the
suffixes of every benchmark item in that array. A shard's array only holds suffixes whose
first words open some benchmark window, since no other suffix can be found; this leaves
nothing out and keeps the array small. What a search meets is compared word by word, so
matches are as long as the texts agree. Documents are never shuffled.

The benchmark is the stated query set. It goes to the tasks in blocks of about BLOCK_CHARS
characters, whole items each; every further block is one more pass over the rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutory.llm.common import WORD_BYTES, row_field, same_rows, slices, utf8

WINDOW = 13
BLOCK_CHARS = 4_000_000
#: Leading words by which suffixes are admitted to a shard's array.
SEED = 3

_STATE = "hits array<struct<start:long,end:long>>, items array<string>, longest long, matches array<struct<item:string,item_pos:long,doc_pos:long,words:long>>"


class BenchmarkBlock:
    """The words of one block of benchmark items as one array of numbers, and where its windows start."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        self.names: list[str | None] = []
        parts, sizes = [], []
        for name, text in items:
            words = (text or "").encode().translate(WORD_BYTES).split()
            if words:
                self.names.append(name)
                sizes.append(len(words))
                parts.append(np.array([number.setdefault(w, len(number) + 1) for w in words], np.uint32))
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        self.packed = self.words.astype(">u4").tobytes()  # bytes of equal order, to search with
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.begins = self.ends - np.array(sizes, np.int64)
        #: by the number of leading words that are looked up: the hashes of these, sorted, with the windows' starts
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own = np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64))
        place = np.arange(len(self.words)) - self.begins[own]
        length = np.array(sizes, np.int64)[own]
        opens = place <= np.maximum(length - window, 0)
        for n in range(1, SEED + 1):
            starts = np.flatnonzero(opens & (np.minimum(np.minimum(length, window), SEED) == n))
            if len(starts):
                keys = _seed_keys(self.words, starts, n)
                order = np.argsort(keys, kind="stable")
                self.seeds[n] = keys[order], starts[order]


def _seed_keys(ids: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """A number for the n words from each place on; different words may share one."""
    keys = ids[places].astype(np.uint64)
    for k in range(1, n):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[places + k]
    return keys


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def search_shard(texts: list[bytes], block: BenchmarkBlock) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """Per text its number of words and its verbatim matches (item, place in item, place in text, words).

    A match is a longest run of words that covers at least one window of the item. Every
    suffix of an item that opens a window is searched in the sorted suffixes of the texts;
    what it meets is followed word by word to the end of the common prefix, from the place
    on where the words before differ.
    """
    counts, parts = [], []
    for text in texts:
        words = text.translate(WORD_BYTES).split()
        counts.append(len(words))
        parts.append(np.fromiter(map(block.vocabulary.get, words, repeat(0)), np.uint32, len(words)))  # 0: in no item
        parts.append(np.zeros(1, np.uint32))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    ends = np.cumsum(np.array(counts, np.int64) + 1) - 1
    begins = ends - np.array(counts, np.int64)
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    admitted, searched = [], []
    for n, (keys, starts) in block.seeds.items():
        first = np.zeros(len(block.vocabulary) + 1, bool)
        first[block.words[starts]] = True
        places = np.flatnonzero(first[ids[: max(0, len(ids) - n + 1)]])
        own = _seed_keys(ids, places, n)
        known = keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own
        admitted.append(places[known])
        low, high = (np.searchsorted(keys, np.unique(own[known]), side) for side in ("left", "right"))
        searched += [int(x) for i, j in zip(low.tolist(), high.tolist(), strict=True) for x in starts[i:j]]
    if not searched:
        return list(zip(counts, found, strict=True))
    raw, width = ids.astype(">u4").tobytes(), 4 * block.window
    array = sorted((raw[4 * p : 4 * p + width], p) for p in np.unique(np.concatenate(admitted)).tolist())  # the shard's suffix array
    keys, sorted_places = [k for k, _ in array], np.array([p for _, p in array], np.int64)
    before = np.where(sorted_places > 0, ids[sorted_places - 1], 0)
    for start in searched:
        item = int(np.searchsorted(block.ends, start, "right"))
        begin, end = int(block.begins[item]), int(block.ends[item])
        suffix = block.packed[4 * start : 4 * min(start + block.window, end)]
        low, high = bisect_left(keys, suffix), bisect_left(keys, suffix + b"\xff\xff\xff\xff")  # no word has that number
        places = sorted_places[low:high]
        if start > begin:  # the others are parts of a longer match, which another suffix of the item meets
            places = places[before[low:high] != block.words[start - 1]]
        for p in places.tolist():
            doc = int(np.searchsorted(ends, p, "right"))
            most = min(end - start, int(ends[doc]) - p)
            differs = np.flatnonzero(ids[p : p + most] != block.words[start : start + most])
            found[doc].append((item, start - begin, p - int(begins[doc]), int(differs[0]) if len(differs) else most))
    return list(zip(counts, found, strict=True))


def _with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of rows that travel as one struct beside them, without a copy."""
    for batch in batches:
        if "text" in batch.schema.names:
            yield batch
        else:
            yield pa.RecordBatch.from_arrays([*batch.columns, row_field(batch, "row", "text")], names=[*batch.schema.names, "text"])


def _pass(block: BenchmarkBlock, keep: list[str], first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(_with_text(batches), "text"):
            state = None if first else [batch.column(c).to_pylist() for c in ("hits", "items", "matches")]
            n_words, hits, items, longest, matches = [], [], [], [], []
            for i, (n, found) in enumerate(search_shard(utf8(batch, "text"), block)):
                spans = [(p, p + size) for _, _, p, size in found]
                names = {block.names[x] for x, *_ in found if block.names[x] is not None}
                lines = [{"item": block.names[x], "item_pos": a, "doc_pos": p, "words": s} for x, a, p, s in found]
                if state:
                    spans += [(s["start"], s["end"]) for s in state[0][i]]
                    names |= set(state[1][i])
                    lines = state[2][i] + lines
                n_words.append(n)
                hits.append([{"start": a, "end": b} for a, b in _merge(spans)])
                items.append(sorted(names))
                longest.append(max((x["words"] for x in lines), default=0))
                matches.append(sorted(lines, key=lambda x: (x["doc_pos"], x["item"] or "", x["item_pos"])))
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            line = pa.struct([("item", pa.string()), ("item_pos", pa.int64()), ("doc_pos", pa.int64()), ("words", pa.int64())])
            yield same_rows(batch, keep, {
                "n_words": pa.array(n_words, pa.int64()),
                "hits": pa.array(hits, pa.list_(span)),
                "items": pa.array(items, pa.list_(pa.string())),
                "longest": pa.array(longest, pa.int64()),
                "matches": pa.array(matches, pa.list_(line)),
            })

    return run


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Iterator[BenchmarkBlock]:
    """The benchmark in blocks of about block_chars characters, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else items
        yield BenchmarkBlock(((r.item_id, r.text) for r in part.toLocalIterator()), window)


def benchmark_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Verbatim matches of benchmark items in every document, one row per document row.

    Words are maximal runs of ASCII digits, ASCII letters (case folded) and non-ASCII
    characters. An item matches where `window` consecutive words of it occur; an item of
    fewer words matches as a whole, one without words never.

    Returns doc_id, text, n_words, hits (disjoint word ranges [start, end)), items (sorted
    ids of matching items), longest (words of the longest match) and matches (item, place
    in item and in document, words). Null or empty text has no words and no matches.
    Repeated rows give repeated results; items with a null id count as hits but are not
    listed; other columns of the inputs are ignored; an empty benchmark gives no matches.
    """
    out = documents.select("doc_id", "text")
    for k, block in enumerate(benchmark_blocks(benchmark, window, block_chars)):
        out = out.mapInArrow(
            _pass(block, ["doc_id", "text"], k == 0),
            f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text string, n_words long, {_STATE}",
        )
    return out


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def is_contaminated(share: int = 20) -> Column:
    """At least one word in `share` lies in an occurrence of a benchmark window."""
    return (n_hit() > 0) & (n_hit() * share >= F.col("n_words"))


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: word counts, hit words, matching items (count and digest) and the decision."""
    found = benchmark_matches(documents, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns, unchanged.

    One pass over the rows without a shuffle. Clashing column names do no harm, as the row
    is packed into one struct. Null and empty texts stay; repeated rows stay or go alike; an
    empty benchmark removes nothing; no rows give no rows.
    """
    out = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    kind = out.schema["row"].dataType.simpleString()
    for k, block in enumerate(benchmark_blocks(benchmark)):
        out = out.mapInArrow(_pass(block, ["row"], k == 0), f"row {kind}, n_words long, {_STATE}")
    return out.where(~is_contaminated()).select("row.*")



_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CONTAMINATION_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS g(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS g(i) WHERE len(w) >= n
), hit AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
runs AS (
  SELECT doc_id, max(n + i - low) AS longest FROM (
    SELECT doc_id, item, shift, i, n, min(i) OVER (PARTITION BY doc_id, item, shift, grp) AS low FROM (
      SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, shift ORDER BY i) AS grp FROM (
        SELECT DISTINCT h.doc_id, h.item, h.n, h.i, h.i - p.j AS shift FROM hit h
        JOIN dw ON dw.doc_id = h.doc_id AND dw.i = h.i AND dw.n = h.n
        JOIN (SELECT item, least(len(w), {WINDOW}) AS n, i AS j, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS win
              FROM b, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS g(i) WHERE len(w) > 0) p
          ON p.item = h.item AND p.n = h.n AND p.win = dw.win))) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN runs USING (doc_id)
"""

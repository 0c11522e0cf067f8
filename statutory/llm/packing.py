"""Sequence packing with patterns fitted by non-negative least squares.

Texts become tokens beside the rows, and only the lengths travel. The histogram of piece
lengths has one bin per length, so it is bounded by the sequence length, whatever the
number of documents. On it: patterns of one to three lengths that fill a sequence are
enumerated, their repeat counts are fitted to the histogram by non-negative least squares
and rounded, and what is left over is packed best-fit, longest first. The result is a short
list of (pattern, repeats). Pieces find their place in it by their rank among the pieces of
their length; ranks come from counts per (length, part), so no length meets in one task.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statutory.llm.common import materialize, same_rows, slices

CAPACITY = 1024
END_ID = 2
#: Chunks after which a Python worker forgets those that it has not met since as many were new.
CACHE_CHUNKS = 120_000
#: Pieces of one length that meet in one task for their ranks; the parts of a length grow with their number.
RANK_ROWS = 20_000
#: Counts of parts are broadcast up to this number of rows, and joined by a shuffle beyond it.
BROADCAST_COUNTS = 1_000_000
#: The vocabulary's token that is met inside texts, fixed by its file.
SPECIAL = "<|endoftext|>"


def tokenizer_path() -> str:
    """The file of byte_bpe_50k's vocabulary as ranks; it gives the ids that byte_bpe_50k.json gives, in a third of the time."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit words.

    The pattern never joins what lies on both sides of a lone space or line break, so such
    texts are encoded chunk by chunk, and the ids of chunks that were met before are looked
    up. New chunks of a text are encoded together and parted where a token opens a chunk.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        import public_tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        # the special token's id follows the ranks; it is met in texts, as the other library does by default
        self._bpe = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
        self._opens = np.zeros(len(ranks) + 1, bool)
        self._opens[[i for x, i in ranks.items() if x[:1] == b" " or x == b"\n"]] = True
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._bpe.encode(text, allowed_special="all"), "<u4")

    def _learn(self, chunks: set[str]) -> None:
        """Make sure that the ids of chunks are known; those not met for long are forgotten."""
        if len(self._known) > CACHE_CHUNKS:
            self._known, self._older = {}, self._known
        new = []
        for chunk in chunks.difference(self._known):
            if chunk in self._older:
                self._known[chunk] = self._older[chunk]
            else:
                new.append(chunk)
        framed = [c if c[0] == "\n" else f" {c}" for c in new]
        ids = self._ids("".join(framed))
        begins = np.flatnonzero(self._opens[ids])
        if len(begins) == len(new) and (not len(new) or begins[0] == 0):
            data, cuts = ids.tobytes(), [*(4 * begins).tolist(), 4 * len(ids)]
            self._known.update((c, data[i:j]) for c, i, j in zip(new, cuts, cuts[1:], strict=False))
        else:
            self._known.update((c, self._ids(f).tobytes()) for c, f in zip(new, framed, strict=True))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.split()
        if len(text) - len("".join(words)) != len(words) - 1 or SPECIAL in text:  # white space side by side, or at an end
            return self._ids(text).tobytes()
        chunks = ("\n" + text).replace("\n", " \n").split(" ")[1:]  # the first one is read as after a line break
        try:
            found = b"".join(map(self._known.__getitem__, chunks))
        except KeyError:
            self._learn(set(chunks))
            found = b"".join(map(self._known.__getitem__, chunks))
        return found[4:]  # without that line break


def _piece_batches(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(path)
        for batch in slices(batches, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = min(capacity, (n - at - 1) % capacity + 1)
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            docs = batch.take(pa.array(row, pa.int64()))
            yield same_rows(docs, ["doc_id"], {
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            })

    return run


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; only the first of several may be short."""
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_piece_batches(path, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of one to three present lengths that fill a sequence, as rows of three lengths (0: none)."""
    here = np.flatnonzero(counts)
    here = here[here > 0]
    present = np.zeros(capacity + 1, bool)
    present[here] = True
    rows = [np.array([[capacity, 0, 0]])] if present[capacity] else []
    pairs = here[(here <= capacity // 2) & present[capacity - here]]
    rows.append(np.stack([capacity - pairs, pairs, 0 * pairs], 1))
    a, b = np.meshgrid(here, here, indexing="ij")
    c = capacity - a - b
    fits = (a >= b) & (b >= c) & (c > 0)
    a, b, c = a[fits], b[fits], c[fits]
    there = present[c]
    rows.append(np.stack([a[there], b[there], c[there]], 1))
    return np.concatenate(rows).astype(np.int64)


def fit(counts: np.ndarray, rows: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeats x of the patterns that minimise |A x - counts|², by projected gradients with momentum."""
    if not len(rows):
        return np.zeros(0)
    target = counts.astype(float)
    target[0] = 0

    def image(x: np.ndarray) -> np.ndarray:
        out = np.bincount(rows.reshape(-1), np.repeat(x, 3), len(counts))
        out[0] = 0
        return out

    x = v = np.full(len(rows), target.sum() / (3 * len(rows)))
    probe = np.ones(len(rows))
    for _ in range(30):  # the largest eigenvalue bounds the step
        probe = image(probe)[rows].sum(1)
        norm = np.linalg.norm(probe)
        probe /= norm
    t = 1.0
    for _ in range(rounds):
        gradient = (image(v) - target)[rows].sum(1)
        after = np.maximum(0, v - gradient / norm)
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = after + (t - 1) / u * (after - x)
        x, t = after, u
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in their order in a sequence) with repeats that use every counted piece once."""
    left = counts.astype(np.int64).copy()
    rows = patterns(left, capacity)
    x = fit(left, rows)
    out: list[tuple[tuple[int, ...], int]] = []
    whole = np.floor(x + 1e-9).astype(np.int64)
    for k in np.argsort(-whole, kind="stable").tolist():
        if not whole[k]:
            break
        need = Counter(r for r in rows[k].tolist() if r)
        times = min([int(whole[k]), *(int(left[r]) // m for r, m in need.items())])
        if times > 0:
            out.append((tuple(sorted(need.elements(), reverse=True)), times))
            for r, m in need.items():
                left[r] -= m * times
    return out + best_fit(left, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal pieces move together."""
    bins: dict[int, list[list]] = defaultdict(list)  # by free room: [lengths, repeats]
    rooms: list[int] = []
    for length in range(len(counts) - 1, 0, -1):
        n = int(counts[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = max(1, min(capacity // length, n))
                full = n // each
                new = [((length,) * each, full)] + ([((length,) * (n % each), 1)] if n % each else [])
                n = 0
                for lengths, times in new:
                    room = capacity - sum(lengths)
                    if room not in rooms:
                        insort(rooms, room)
                    bins[room].append([lengths, times])
                continue
            room = rooms[at]
            lengths, times = bins[room].pop()
            used = min(n, times)
            if times > used:
                bins[room].append([lengths, times - used])
            if not bins[room]:
                rooms.remove(room)
            if room - length not in rooms:
                insort(rooms, room - length)
            bins[room - length].append([(*lengths, length), used])
            n -= used
    return [(lengths, times) for group in bins.values() for lengths, times in group]


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every row of found its sequence_id and offset.

    found has doc_id, piece, start, ids_crc32 and a length from 1 to capacity, never null. Rows
    that are equal in all of these are placed each for itself, in any order; null ids come
    first among their length; no rows give no rows.
    """
    found = materialize(found)
    totals = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    parts = F.array(*[F.lit(-(-totals.get(i, 1) // RANK_ROWS)).cast("long") for i in range(capacity + 1)])
    dealt = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.element_at(parts, (F.col("length") + 1).cast("int"))))
    counts = materialize(dealt.groupBy("length", "_bucket").count())
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in totals.items():
        histogram[length] = n
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by length: first rank, first sequence, offset
    next_rank, next_id = np.zeros(capacity + 1, np.int64), 0
    for lengths, times in plan(histogram, capacity):
        offset = 0
        for length in lengths:
            slots[length].append((int(next_rank[length]), next_id, offset))
            next_rank[length] += times
            offset += length
        next_id += times
    before = counts.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).drop("count")
    few = sum(-(-n // RANK_ROWS) for n in totals.values()) <= BROADCAST_COUNTS
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("_rank", own.cast("long") - 1).join(F.broadcast(before) if few else before, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_bucket")
    kinds = ranked.drop("length", "_rank").schema
    names = [*kinds.names, "length"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)
    lookup = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in slots.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length).tolist():
                rows = np.flatnonzero(length == one)
                low, base, shift = lookup[one]
                slot = np.searchsorted(low, rank[rows], "right") - 1
                sequence[rows] = base[slot] + rank[rows] - low[slot]
                offset[rows] = shift[slot]
            yield same_rows(batch, names, {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return ranked.select(*names, "_rank").mapInArrow(assign, f"{fields}, length long, sequence_id long, offset long")


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    A document is its ids and then end_id; one that is longer than a sequence is cut into
    full pieces, of which the first may be shorter. Returns a row per piece: doc_id, piece,
    start, ids_crc32, length, sequence_id and offset (gapless from 0 in every sequence).
    Null and empty texts are one end_id; repeated rows are packed as often as they occur,
    also without an id; other columns are ignored; no rows give no rows.
    """
    found = pieces(documents, path or tokenizer_path(), capacity, end_id)
    return place(found, capacity)

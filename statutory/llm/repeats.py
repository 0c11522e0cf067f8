"""Byte-exact removal of long passages that repeat anywhere in the corpus.

Sampled suffixes are sorted and named, the suffixes between them are decided from the
names, and adjacent prefixes are compared. The sample is not taken by residues of the
position but by content: a suffix is sampled if the hash of its first items is the least of
some window, so that every passage of the wanted length holds a sample whose place in it
depends on nothing but the passage, and equal passages have equal samples at equal places.

Passages are looked for in two units at once: of LENGTH bytes, which are removed, and of
WORDS words (between ASCII white space), which are only counted, as prose of so many words
may be shorter. A sample of bytes is one of about 170, a sample of words one of 22.

1. Samples: per document the sampled places with the range of starts that each decides,
   and the name (hash) of the text that those starts cover, its context. Samples whose gram
   occurs once are dropped.
2. Names: samples are grouped by their gram. A context that occurs twice is repeated as a
   whole, and so are all starts that it decides.
3. Remaining starts: where a gram has several contexts, one copy of each is cut from its
   document, every start in it gets the name of its passage, and equal names are found after
   a sort. The contexts of a gram meet in one task if they are few; of very many, the names
   are counted over all tasks.
4. The repeated starts return to their documents, which drop the bytes they cover.

Texts are compressed where they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.llm.common import SLICE_BYTES, materialize, same_rows, slices, utf8

LENGTH = 400
GRAM = 64
#: The same in words.
WORDS, WORD_GRAM = 51, 8
#: Starts of a text that are sampled at once; PLACE_BITS hold a place among them.
CHUNK_STARTS = 1 << 20
PLACE_BITS = 21
#: Contexts of a gram up to which they are compared in one task; of more, the names of all starts are counted.
GROUP_CONTEXTS = 8000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _bytes_table() -> np.ndarray:
    """A random word for each byte value, the same in every task."""
    digest = b"".join(hashlib.sha256(b"byte %d" % b).digest()[:8] for b in range(256))
    return np.frombuffer(digest, "<u8")


_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool = False) -> np.ndarray:
    """_BASE (or its inverse) to the powers 0 to n - 1, modulo 2 ** 64."""
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        have = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            have[filled : filled + step] = have[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        if size <= 1 << 23:
            _powers[name] = have
    return have[:n]


def _sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of every run of symbols (a word of 64 bits for each item) follows."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _power(len(symbols)), out=out[1:])
    return out


def byte_symbols(text: bytes) -> np.ndarray:
    return _bytes_table()[np.frombuffer(text, np.uint8)]


#: White space of ASCII, which parts words.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends."""
    edge = np.diff(np.concatenate([[True], _SPACE[np.frombuffer(text, np.uint8)], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_symbols(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of the words, a stretch of the text at a time."""
    out, i = [np.zeros(0, np.uint64)], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_STARTS, "right")))
        base = int(starts[i])
        sums = _sums(byte_symbols(text[base : int(ends[j - 1])]))
        out.append(_hashes(sums, starts[i:j] - base, ends[i:j] - base))
        i = j
    return np.concatenate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of symbols[start:end], also by the length."""
    raw = (sums[ends] - sums[starts]) * _power(len(sums), inverse=True)[starts]
    return _mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _grams(sums: np.ndarray, size: int) -> np.ndarray:
    return _mix((sums[size:] - sums[:-size]) * _power(len(sums) - size, inverse=True))


def samples(symbols: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First start that each sampled place decides, how many more it decides, its gram and its context's name.

    A place is sampled by a start if its gram is the least of the start's window, the first
    of equal ones; grams are ordered by their higher bits, beside which the place stands.
    """
    sums = _sums(symbols)
    grams = _grams(sums, gram)
    window = length - gram + 1
    n = len(grams) - window + 1  # starts of passages
    # the least of every window, by running minima from both sides of blocks
    size = -(-len(grams) // window) * window
    ordered = np.full(size, _MASK, np.uint64)
    ordered[: len(grams)] = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    blocks = ordered.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(back[:n], ahead[window - 1 : window - 1 + n])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], n) - 1
    at = place[first]
    context = _mix(_hashes(sums, first, last + length) + (at - first).astype(np.uint64))
    return _collapsed(first, last - first, grams[at], context)


def _collapsed(first: np.ndarray, more: np.ndarray, grams: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring samples that are all alike, as two samples: the first one, and one for all starts of the others.

    Texts of one character or of a short period are such runs, which would have a sample for
    each period. Two samples of a context are enough to know that it occurs more than once;
    the first one of a text is never the longer one.
    """
    like = np.zeros(len(first), bool)  # as the one before
    like[1:] = (context[1:] == context[:-1]) & (grams[1:] == grams[:-1]) & (more[1:] == more[:-1])
    second = like & ~np.concatenate([[False], like[:-1]])
    ends = np.append(np.flatnonzero(~like)[1:], len(first)) - 1  # of all runs
    more = more.copy()
    of = np.cumsum(~like)[second] - 1
    more[second] = first[ends[of]] + more[ends[of]] - first[second]
    keep = ~like | second
    return first[keep], more[keep], grams[keep], context[keep]


#: What sets the names of the two units apart.
_UNIT = (np.uint64(0), np.uint64(0x5851F42D4C957F2D))


def _places(first: np.ndarray, more: np.ndarray, words: bool) -> np.ndarray:
    """A sample's first start, how many more it decides, and its unit, in one number."""
    return first << (PLACE_BITS + 1) | more << 1 | int(words)


def _read_place(place: int) -> tuple[int, int, bool]:
    return place >> (PLACE_BITS + 1), place >> 1 & (1 << PLACE_BITS) - 1, bool(place & 1)


def _sample_batches(length: int, gram: int, words: int):
    def of(symbols: np.ndarray, size: int, width: int, unit: int) -> Iterator[tuple[np.ndarray, ...]]:
        for at in range(0, len(symbols) - size + 1, CHUNK_STARTS):
            first, more, grams, context = samples(symbols[at : at + CHUNK_STARTS + size - 1], size, width)
            yield _places(first + at, more, bool(unit)), (grams ^ _UNIT[unit]).view(np.int64), (context ^ _UNIT[unit]).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), utf8(batch, "text"), strict=True)
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for k1, k2, text in keys:
                found = [x for at in range(0, len(text) - length + 1, CHUNK_STARTS) for x in of_bytes(text, at)]
                found += of(word_symbols(text, *word_bounds(text)), words, min(WORD_GRAM, words), 1)
                for place, grams, context in found:
                    n = len(place)
                    for column, values in zip(out, (np.full(n, k1), np.full(n, k2, np.int32), place, grams, context), strict=True):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["k1", "k2", "place", "gram", "context"])

    def of_bytes(text: bytes, at: int) -> Iterator[tuple[np.ndarray, ...]]:
        for place, grams, context in of(byte_symbols(text[at : at + CHUNK_STARTS + length - 1]), length, gram, 0):
            yield place + (at << (PLACE_BITS + 1)), grams, context

    return run


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        press = zstandard.ZstdCompressor(level=1).compress
        yield same_rows(batch, ["doc_id", "k1", "k2"], {"packed": pa.array([press(t) for t in utf8(batch, "text")], pa.binary())})


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in batch.column("packed").to_pylist()]


def _cut_batches(length: int, words: int):
    """Cut the wanted contexts: a row with the text for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", SLICE_BYTES // 4):
            gram, context, once, unit, piece = [], [], [], [], []
            rows = batch.filter(batch.column("cuts").is_valid())
            for text, wanted in zip(_texts(rows), rows.column("cuts").to_pylist(), strict=True):
                bounds = None
                for cut in wanted:
                    first, more, of_words = _read_place(cut["place"])
                    if of_words:
                        bounds = bounds or word_bounds(text)
                        piece.append(text[bounds[0][first] : bounds[1][first + more + words - 1]])
                    else:
                        piece.append(text[first : first + more + length])
                    gram.append(cut["gram"])
                    context.append(cut["context"])
                    once.append(cut["once"])
                    unit.append(of_words)
            if gram:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram, pa.int64()), pa.array(context, pa.int64()), pa.array(once, pa.bool_()), pa.array(unit, pa.bool_()), pa.array(piece, pa.binary())],
                    names=["gram", "context", "once", "words", "piece"],
                )

    return run


def _name_batches(length: int, words: int):
    """The name of the passage at every start of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "piece", SLICE_BYTES // 4):
            names = passage_names(batch.column("piece").to_pylist(), batch.column("words").to_pylist(), length, words)
            sizes = [len(x) for x in names]
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            starts = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(names).view(np.int64)), batch.column("context").take(rows), pa.array(starts), batch.column("once").take(rows)],
                names=["name", "context", "start", "once"],
            )

    return run


def passage_names(pieces: list[bytes], units: list[bool], length: int, words: int) -> list[np.ndarray]:
    """By piece, the name of the passage of so many bytes (or words, by its unit) at every start; all pieces at once."""
    out = [np.zeros(0, np.uint64)] * len(pieces)
    for unit in (False, True):
        own = [i for i, u in enumerate(units) if u == unit]
        if not own:
            continue
        sizes = np.array([len(pieces[i]) for i in own], np.int64)
        if unit:
            text, size = b" ".join([pieces[i] for i in own]), words
            bounds = word_bounds(text)
            symbols = word_symbols(text, *bounds)
            ends = np.searchsorted(bounds[0], np.cumsum(sizes + 1))
        else:
            size = length
            symbols = byte_symbols(b"".join([pieces[i] for i in own]))
            ends = np.cumsum(sizes)
        begins = np.concatenate([[0], ends[:-1]])
        starts = np.maximum(ends - begins - size + 1, 0)
        cuts = np.cumsum(starts)
        at = np.arange(int(cuts[-1])) + np.repeat(begins - (cuts - starts), starts)
        names = _hashes(_sums(symbols), at, at + size) ^ _UNIT[unit]
        for i, part in zip(own, np.split(names, cuts[:-1]), strict=True):
            out[i] = part
    return out


def _compare_batches(length: int, words: int):
    """Repeated starts of the contexts that occur once; rows come sorted by gram, of at most GROUP_CONTEXTS contexts each."""

    def search(group: list[tuple]) -> tuple[np.ndarray, ...] | None:
        """Contexts with the first and the last start of their repeated stretches."""
        if len(group) < 2:
            return None
        sizes = np.array([len(names) for *_, names in group])
        _, number, counts = np.unique(np.concatenate([names for *_, names in group]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(group)), sizes)
        at = np.flatnonzero((counts[number] > 1) & np.array([once for _, _, once, _ in group])[owner])
        if not len(at):
            return None
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0))
        low, high = at[np.concatenate([[0], breaks + 1])], at[np.append(breaks, len(at) - 1)]
        begins = np.cumsum(sizes) - sizes
        context = np.array([context for _, context, *_ in group])
        return context[owner[low]], low - begins[owner[low]], high - begins[owner[low]]

    def pack(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        context, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(context, pa.int64()), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["context", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in slices(batches, "piece", SLICE_BYTES // 4):
            found = []
            names = passage_names(batch.column("piece").to_pylist(), batch.column("words").to_pylist(), length, words)
            for row in zip(*[batch.column(i).to_pylist() for i in range(3)], names, strict=True):
                if group and group[0][0] != row[0]:
                    found.append(search(group))
                    group = []
                group.append(row)
            if found := [x for x in found if x]:
                yield pack(found)
        if last := search(group):
            yield pack([last])

    return run


def _merged(spans: Iterator[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _remove_batches(length: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", SLICE_BYTES // 4):
            n_bytes, n_removed, spans, kept, repeated = [], [], [], [], []
            for text, hits in zip(_texts(batch), batch.column("hits").to_pylist(), strict=True):
                gone = _merged((h["low"], h["high"] + length) for h in hits or () if not h["words"])
                again = _merged((h["low"], h["high"] + words) for h in hits or () if h["words"])
                at, left = 0, []
                for low, high in gone:
                    left.append(text[at:low])
                    at = high
                left.append(text[at:])
                kept.append(b"".join(left))
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(kept[-1]))
                spans.append([{"start": a, "end": b} for a, b in gone])
                repeated.append(sum(b - a for a, b in again))
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield same_rows(batch, ["doc_id"], {
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(span)),
                "kept": pa.array(kept, pa.binary()),
                "n_repeated_words": pa.array(repeated, pa.int64()),
            })

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = WORDS) -> DataFrame:
    """Drop every byte covered by a passage of `length` bytes that also starts anywhere else.

    Passages are judged on the input, so all copies go, the first one too; they may overlap
    and may lie in the same document, but never cross documents.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed byte ranges [start, end)), kept
    (the remaining bytes, which may end inside a character) and n_repeated_words (words that
    lie in a run of `words` words, equal byte by byte whatever parts them, that also starts
    anywhere else; nothing is removed for these). Null texts are empty; texts that are too
    short are kept; a repeated row is a copy like any other, with or without an id; other
    columns are ignored.

    A document is known by a 64-bit hash of its id and text and by its length.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.octet_length("text").alias("k2"))
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    packed = rows.mapInArrow(_pack_batches, f"doc_id {doc_type}, k1 long, k2 int, packed binary")
    found = rows.select("k1", "k2", "text").mapInArrow(_sample_batches(length, gram, words), "k1 long, k2 int, place long, gram long, context long")
    found = materialize(found)
    again = materialize(found.groupBy("gram").count().where("count > 1").select("gram"))
    found = materialize(found.join(again, "gram", "left_semi"))
    contexts = found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("copy"))
    grams = contexts.groupBy("gram").agg(F.count("*").alias("m"))
    contexts = materialize(contexts.join(grams, "gram"))

    def cut(wanted: DataFrame) -> DataFrame:
        cuts = wanted.groupBy(F.col("copy.k1").alias("k1"), F.col("copy.k2").alias("k2")).agg(
            F.collect_list(F.struct("copy.place", "gram", "context", (F.col("n") == 1).alias("once"))).alias("cuts")
        )
        # all joins with the texts have the same left side and columns, which are shuffled once and used again
        return packed.join(cuts, ["k1", "k2"], "left").select("doc_id", "packed", "cuts").mapInArrow(_cut_batches(length, words), "gram long, context long, once boolean, words boolean, piece binary")

    small = cut(contexts.where((F.col("m") > 1) & (F.col("m") <= GROUP_CONTEXTS)))
    part = small.repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare_batches(length, words), "context long, low int, high int")
    large = contexts.where((F.col("m") > 1) & (F.col("m") > GROUP_CONTEXTS))
    if not large.isEmpty():  # no task holds such a group: names are counted before they are shuffled
        named = cut(large).mapInArrow(_name_batches(length, words), "name long, context long, start int, once boolean")
        twice = named.groupBy("name").count().where("count > 1").select("name")
        part = part.union(named.where("once").join(twice, "name").select("context", F.col("start").alias("low"), F.col("start").alias("high")))
    first = F.shiftright("place", PLACE_BITS + 1)
    more = F.shiftright("place", 1).bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))
    whole = contexts.where("n > 1").select("context", F.lit(0).alias("low"), F.lit(-1).alias("high"))  # all starts that a sample decides
    unit = F.col("place").bitwiseAND(F.lit(1).cast("long")) == 1
    hits = found.select("k1", "k2", "place", "context").join(whole.union(part), "context").groupBy("k1", "k2").agg(
        F.collect_set(F.struct((first + F.col("low")).alias("low"), (first + F.when(F.col("high") < 0, more).otherwise(F.col("high"))).alias("high"), unit.alias("words"))).alias("hits")
    )
    return packed.join(hits, ["k1", "k2"], "left").select("doc_id", "packed", "hits").mapInArrow(
        _remove_batches(length, words),
        f"doc_id {doc_type}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, n_repeated_words long",
    )


def repeat_report(documents: DataFrame) -> DataFrame:
    """Counts and the digest of what is left for every document, and the words in repeated runs of over 50."""
    return remove_repeats(documents).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_words"
    )

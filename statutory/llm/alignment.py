"""Alignment of two tokenizers over the same bytes.

A batch of texts becomes two tables of tokens with their first bytes. pandas.merge_asof,
keyed by document, finds for the start of every token the token of the other side that
covers it; the union of both directions holds every pair of tokens that overlap, as of two
overlapping tokens one starts inside the other. Where both sides start together a group
begins. Long texts are worked off in parts cut where both tokenizers have to part anyway.

How many documents hold a pair of ids linked is a count over the corpus. Documents keep
their distinct pairs and how often they link; counts come from one aggregate, combined
before it is shuffled. The most frequent pairs are a table of bounded size and are looked up
beside the rows; all others are joined by a shuffle, where none of them can be hot.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path
from re import compile as pattern
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.llm.common import slices, stored

#: Chunks after which a Python worker forgets those that it has not met since as many were new.
CACHE_CHUNKS = 200_000
#: Characters of a text that are encoded at once; a part ends at the next blank after a word.
PART_CHARS = 1 << 20
#: Characters of texts that are aligned at once.
ALIGN_CHARS = 1 << 20
#: Pairs of ids whose counts every task holds (17 bytes each); the others are joined by a shuffle.
HOT_PAIRS = 200_000
#: Stands for the ids of a chunk that a tokenizer doesn't give back byte for byte.
ALTERED = 0xFFFF

#: A blank after what no library takes for white space: no token of either side lies across its front.
CUT = pattern(r"\S(?= [\s\S])")


#: White space side by side or at an end of a text.
UNLONE = pattern(r"\s(?:\s|\Z)|\A\s")


def lone_blanks(text: str) -> bool:
    """Whether white space in the text stands alone and between words; long texts are searched, as their words would fill the memory."""
    if len(text) > PART_CHARS:
        return UNLONE.search(text) is None
    words = text.split()
    return bool(words) and len(text) - len("".join(words)) == len(words) - 1


class Side:
    """One tokenizer: the ids of chunks, and the bytes of ids.

    A chunk is a word with the lone blank or line break before it. Neither tokenizer joins
    bytes across the front of such a chunk, so a text's ids are those of its chunks.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        if len(pieces) >= ALTERED:
            raise ValueError("ids have to fit into 16 bits")
        self.pieces = pieces
        self.sizes = np.array([len(x) for x in pieces] + [0] * (ALTERED + 1 - len(pieces)), np.int64)
        self._opens = np.array([x[:1] in (b" ", b"\n") for x in pieces], bool)
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with white space, as they stand inside a longer text."""
        raise NotImplementedError

    def checked(self, texts: list[str]) -> list[bytes]:
        """The ids as 16-bit words, or ALTERED alone if they don't join to the text."""
        found = []
        for text, ids in zip(texts, self.encode(texts), strict=True):
            same = b"".join(map(self.pieces.__getitem__, ids)) == text.encode()
            found.append(np.array(ids if same else [ALTERED], "<u2").tobytes())
        return found

    def ids(self, part: list[str] | str) -> np.ndarray:
        """The ids of a part: of chunks that were learnt, or of a text as it is."""
        return np.frombuffer(self.checked([part])[0] if isinstance(part, str) else b"".join(map(self._known.__getitem__, part)), "<u2")

    def learn(self, chunks: set[str]) -> None:
        """Make sure that the ids of chunks are known; those not met for long are forgotten."""
        if len(self._known) > CACHE_CHUNKS:
            self._known, self._older = {}, self._known
        new = []
        for chunk in chunks.difference(self._known):
            if chunk in self._older:
                self._known[chunk] = self._older[chunk]
            else:
                new.append(chunk)
        framed = [c if c[:1] == "\n" else f" {c}" for c in new]
        joined = "".join(framed)
        ids = np.array(self.encode([joined])[0], "<u2")  # together, and parted where a token opens a chunk
        begins = np.flatnonzero(self._opens[ids])
        if len(begins) == len(new) and b"".join(map(self.pieces.__getitem__, ids.tolist())) == joined.encode():
            data, cuts = ids.tobytes(), [*(2 * begins).tolist(), 2 * len(ids)]
            self._known.update((c, data[i:j]) for c, i, j in zip(new, cuts, cuts[1:], strict=False))
        else:
            self._known.update(zip(new, self.checked(framed), strict=True))


class ByteLevel(Side):
    """Byte-level pairs by a file of ranks; special tokens' strings are plain text."""

    def __init__(self, path: str) -> None:
        import public_tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self._bpe = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        super().__init__(sorted(ranks, key=ranks.__getitem__))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._bpe.encode_ordinary(x) for x in texts]


class Pieces(Side):
    """Pieces with byte fallback, after a blank that the model puts in front."""

    def __init__(self, path: str) -> None:
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self._model.get_piece_size()
        named = [self._model.id_to_piece(i) for i in range(size)]
        if any(" " in p.lstrip("▁").replace("▁", " ") or ("\n" in p and p != "\n") for p in named):
            raise ValueError("a piece lies across the front of a word")
        super().__init__([bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)])
        self._frame = self._model.encode("a")

    def encode(self, texts: list[str]) -> list[list[int]]:
        # a blank in front is the model's own; before a line break stands a word that is taken away again
        blank = [x[:1] == " " for x in texts]
        found = self._model.encode([x[1:] if b else f"a{x}" for x, b in zip(texts, blank, strict=True)], num_threads=1)
        return [ids if b else ids[len(self._frame) :] for ids, b in zip(found, blank, strict=True)]


class Tokenizers:
    """Both sides and the printed forms of their ids, one of each in a worker process."""

    _loaded: dict[tuple[str, str], Tokenizers] = {}

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.n_a, self.n_b = len(self.a.pieces), len(self.b.pieces)
        if self.n_a * self.n_b > 1 << 31:
            raise ValueError("pairs of ids have to fit into 31 bits")
        a, b = ([b"%d" % i for i in range(n)] for n in (self.n_a, self.n_b))
        #: In a group, then at its front; first the ids of A, then those of B.
        self.printed = np.array([b"," + x for x in a] + [b";" + x for x in a] + [b"," + x for x in b] + [b"|" + x for x in b], object)

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Tokenizers:
        if (path_a, path_b) not in cls._loaded:
            cls._loaded[path_a, path_b] = cls(path_a, path_b)
        return cls._loaded[path_a, path_b]

    def parts(self, text: str) -> Iterator[list[str] | str]:
        """A blank and the text, part by part, as chunks or as it is; both sides end a token at the end of every part."""
        if lone_blanks(text):
            at = 0
            while at < len(text):
                cut = text.find(" ", at + PART_CHARS)
                end = len(text) if cut < 0 else cut
                yield text[at:end].replace("\n", " \n").split(" ")  # each is read as after a blank or line break
                at = end + 1
        else:
            text, at = f" {text}", 0
            while at < len(text):
                cut = CUT.search(text, at + PART_CHARS)
                end = cut.end() if cut else len(text)
                yield text[at:end]
                at = end


def align(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Overlaps and groups of the tokens of several documents.

    doc has the documents of the tokens of a and b (two arrays, both rising), a and b the
    tokens' first bytes, counted through all documents. Returns the places in a and b of
    the two tokens of every overlap, and for every token whether a group begins with it.
    """
    left = pd.DataFrame({"doc": doc[0], "at": a}, copy=False)
    right = pd.DataFrame({"doc": doc[1], "at": b}, copy=False)
    of_a = pd.merge_asof(left, right.assign(b=np.arange(len(b))), on="at", by="doc")["b"].to_numpy(np.int64)
    of_b = pd.merge_asof(right, left.assign(a=np.arange(len(a))), on="at", by="doc")["a"].to_numpy(np.int64)
    front_a, front_b = b[of_a] == a, a[of_b] == b
    more = np.flatnonzero(~front_b)  # a pair that starts together is found in both directions
    return {"a": np.concatenate([np.arange(len(a)), of_b[more]]), "b": np.concatenate([of_a, more]), "front_a": front_a, "front_b": front_b}


def _runs(*sizes: int) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


class Documents:
    """What is known of the documents of a batch; their parts are aligned some at a time."""

    def __init__(self, both: Tokenizers, n: int) -> None:
        self.both = both
        self.counts = np.zeros((4, n), np.int64)  # tokens of a, of b, groups, links
        self.pairs: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.times: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.digest: list[Any] = [None] * n
        self.altered = np.zeros(n, bool)
        self._held: list[tuple[int, list[str] | str]] = []
        self._chars = 0

    def add(self, doc: int, text: str) -> None:
        for part in self.both.parts(text):
            self._held.append((doc, part))
            self._chars += min(len(text), PART_CHARS)
            if self._chars >= ALIGN_CHARS:
                self.flush()

    def _ids(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Document and ids of what is held, without the parts that a tokenizer altered."""
        chunks = set().union(*(part for _, part in self._held if not isinstance(part, str)))
        found = []
        for side in (self.both.a, self.both.b):
            side.learn(chunks)
        for doc, part in self._held:
            a, b = self.both.a.ids(part), self.both.b.ids(part)
            if (a == ALTERED).any() or (b == ALTERED).any():
                self.altered[doc] = True
            else:
                found.append((doc, a, b))
        self._held, self._chars = [], 0
        return found

    def flush(self) -> None:
        """Align what is held."""
        held = self._ids()
        if not held:
            return
        docs = np.array([d for d, _, _ in held])
        a, b = (np.concatenate([x[k] for x in held]).astype(np.int64) for k in (1, 2))
        part_a, part_b = (_runs(*[len(x[k]) for x in held]) for k in (1, 2))
        end_a, end_b = np.cumsum(self.both.a.sizes[a]), np.cumsum(self.both.b.sizes[b])
        found = align((part_a, part_b), end_a - self.both.a.sizes[a], end_b - self.both.b.sizes[b])
        part = part_a[found["a"]]
        n = len(docs)
        for row, parts in enumerate((part_a, part_b, part_a[found["front_a"]], part)):
            np.add.at(self.counts[row], docs, np.bincount(parts, minlength=n))

        # groups in order, the ids of A before those of B
        first_a, first_b = np.flatnonzero(found["front_a"]), np.flatnonzero(found["front_b"])
        group_a, group_b = np.cumsum(found["front_a"]) - 1, np.cumsum(found["front_b"])
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + first_b[group_a]] = a + self.both.n_a * found["front_a"]
        order[np.arange(len(b)) + np.append(first_a, len(a))[group_b]] = b + 2 * self.both.n_a + self.both.n_b * found["front_b"]
        printed = self.both.printed[order].tolist()
        ends = np.cumsum(np.bincount(part_a, minlength=n) + np.bincount(part_b, minlength=n)).tolist()
        for doc, (start, end) in zip(docs.tolist(), pairwise([0, *ends]), strict=True):
            text = b"".join(printed[start:end])
            if self.digest[doc] is None:
                self.digest[doc], text = hashlib.sha256(), text[1:]
            self.digest[doc].update(text)

        keys, times = np.unique((docs[part] << 31) + a[found["a"]] * self.both.n_b + b[found["b"]], return_counts=True)
        which = np.unique(docs)
        cuts = np.searchsorted(keys, which << 31).tolist() + [len(keys)]
        for doc, (start, end) in zip(which.tolist(), pairwise(cuts), strict=True):
            own, count = keys[start:end] - (doc << 31), times[start:end]
            if len(self.pairs[doc]):
                own, at = np.unique(np.concatenate([self.pairs[doc], own]), return_inverse=True)
                count = np.bincount(at, np.concatenate([self.times[doc], count])).astype(np.int64)
            self.pairs[doc], self.times[doc] = own, count


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32))


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(path_a: str, path_b: str):
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers.of(path_a, path_b)
        for batch in slices(batches, "text"):
            docs = Documents(both, batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    docs.add(i, text)
            docs.flush()
            keep = [j if not docs.altered[j] else None for j in range(batch.num_rows)]  # an altered text has no tokens at all
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [pa.array(np.where(docs.altered, 0, x)) for x in docs.counts]
                + [pa.array(["" if j is None or docs.digest[j] is None else docs.digest[j].hexdigest() for j in keep])]
                + [_lists([none if j is None else held[j] for j in keep]) for held in (docs.pairs, docs.times)],
                names=["doc_id", *COUNTS, "groups_sha256", "pairs", "times"],
            )

    return aligned


def tokenizer_paths() -> tuple[str, str]:
    """The files of the byte-level side (its vocabulary as ranks, which gives the same ids) and of the side of pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def align_documents(documents: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Every row's doc_id, COUNTS, groups_sha256, and its distinct pairs of linked ids (a * ids of B + b) with how often each is linked.

    Null and empty texts, and texts that either tokenizer doesn't give back byte for byte,
    have no tokens: zeros, an empty digest and no pairs. Repeated rows are repeated, null
    ids stay; other columns are ignored; an empty table gives an empty result.
    """
    docs = documents.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs array<int>, times array<int>"
    return docs.mapInArrow(_aligned(*(paths or tokenizer_paths())), schema)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """For every pair: n, the documents that hold it linked, and best, whether no pair of its A id has more."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    of_a = F.floor(F.col("pair") / F.lit(n_b)).cast("int")
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))  # one row for each id of A
    return counts.withColumn("a", of_a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(pair: np.ndarray, n: np.ndarray, best: np.ndarray):
    """Sums over the links whose pairs are known; the other pairs are left in the rows."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("pairs", "times"))
            row = _runs(*np.diff(batch.column("pairs").offsets.to_numpy()).tolist())
            at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            known = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            links, at = times[known], at[known]
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row[known], links * best[at])
            np.add.at(sums[1], row[known], links * n[at])
            cuts = np.searchsorted(row[~known], np.arange(batch.num_rows + 1)).astype(np.int32)
            rest = [pa.ListArray.from_arrays(cuts, x[~known].astype(np.int32)) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, sums), *rest], names=["row", "n_best", "count_sum", "pairs", "times"])

    return look_up


def alignment_report(documents: DataFrame, paths: tuple[str, str] | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Alignment of both tokenizers' tokens for every document row.

    Returns doc_id, n_a and n_b (tokens), n_groups, n_links (overlaps), n_best (links whose
    count is the highest of their A id, ties included), count_sum (the sum of the links'
    counts) and groups_sha256. A pair's count is the number of rows that hold it linked.
    Rows without tokens have zeros and an empty digest, as align_documents says; repeated
    rows count and appear as often as they stand; an empty table gives an empty result.
    """
    paths = paths or tokenizer_paths()
    n_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    aligned = stored(align_documents(documents, paths).withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(aligned, n_b))
    hot = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).toPandas().sort_values("pair")  # of bounded size
    known = _looked_up(hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(np.int64))
    sums = stored(aligned.select("row", "pairs", "times").mapInArrow(known, "row long, n_best long, count_sum long, pairs array<int>, times array<int>"))
    rest = sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.*").withColumnRenamed("pairs", "pair")
    priced = rest.join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    summed = sums.select("row", "n_best", "count_sum").unionByName(priced).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(summed, "row").select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")

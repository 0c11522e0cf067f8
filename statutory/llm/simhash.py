"""SimHash near-duplicates, linked with pivot distance tables.

Fingerprints are 64 bits wide and are computed beside the text. Only distinct fingerprints
are compared. Two of them that differ in at most four bits agree in two of six blocks of
bits at least, so one row per pair of blocks brings every link together in some bucket.
Inside a bucket every fingerprint has its row of a pivot table: its Hamming distances to
fixed reference fingerprints. By the triangle inequality a pair whose distances to any
pivot differ by more than four is no link; the pairs that survive are verified.

A bucket that is larger than `bucket_rows` is split by blocks of its remaining bits, of
which one agrees for every link inside it, as often as it takes. Links leave a bucket as a spanning forest: once a fingerprint is
reached it needs no further partner, so a large group of copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutory.llm.common import materialize, same_rows, slices, utf8
from statutory.llm.components import components

WORDS = 4
SEED = 42
MAX_BITS = 4
#: Bits of the six blocks, from the lowest.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
BUCKET_ROWS = 2000
PIVOTS = 16
#: Buckets of up to this many rows are compared together, step by step.
SMALL = 32
#: Keys of large buckets are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_BUCKETS = 100_000
#: Buckets that leave so many bits open hold at most 2 ** FREE_BITS fingerprints and are not split.
FREE_BITS = 22
#: Tasks over which the fingerprints of one component are spread.
SALTS = 32


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a text; a bit is set if more than half of the shingle hashes have it."""
    tokens = text.lower().split()  # of bytes: folds A-Z only and parts at space and \t to \r only
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        prints = np.array([fingerprint(t) for t in utf8(batch, "text")], np.uint64).view(np.int64)
        yield same_rows(batch, ["doc_id"], {"fp": pa.array(prints)})


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) for every row; null text is empty and gives 0."""
    docs = documents.select("doc_id", "text")
    return docs.mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every task."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(n)], np.uint64)


def spanning_links(prints: np.ndarray, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS) -> list[tuple[int, int]]:
    """Links (places in prints) that connect whatever links of at most max_bits connect."""
    rest = np.arange(len(prints))
    distances = np.bitwise_count(prints[:, None] ^ pivots(n_pivots)[None, :]).astype(np.int8)
    links: list[tuple[int, int]] = []
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = np.ones(len(rest), bool)
            for k in range(n_pivots):  # discard by maximum coordinate difference
                at = np.flatnonzero(near)
                if len(at) < 16:
                    break
                near[at] = np.abs(distances[rest[at], k] - distances[x, k]) <= max_bits
            at = np.flatnonzero(near)
            at = at[np.bitwise_count(prints[rest[at]] ^ prints[x]) <= max_bits]  # verify survivors
            if len(at):
                found = rest[at].tolist()
                links += [(x, y) for y in found]
                reached += found
                rest = np.delete(rest, at)
    return links


def _near_pairs(prints: np.ndarray, keys: np.ndarray, sizes: np.ndarray, max_bits: int, n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside buckets of at most SMALL rows, all buckets of sorted keys at once."""
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    prints, keys = prints[small], keys[small]
    distances = np.bitwise_count(prints[:, None] ^ pivots(n_pivots)[None, :]).astype(np.int8)
    left, right = [], []
    for step in range(1, SMALL):
        at = np.flatnonzero(keys[:-step] == keys[step:])
        if not len(at):
            break
        for k in range(n_pivots):  # discard by maximum coordinate difference
            at = at[np.abs(distances[at, k] - distances[at + step, k]) <= max_bits]
        at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= max_bits]  # verify survivors
        left.append(prints[at])
        right.append(prints[at + step])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every bucket; rows come sorted by bucket, whose rows may lie in several batches."""

    def search(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        sizes = np.diff(starts, append=len(keys))
        a, b = _near_pairs(prints, keys, np.repeat(sizes, sizes), MAX_BITS, PIVOTS)
        left, right = [a], [b]
        for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            part = prints[start : start + size]
            links = np.array(spanning_links(part), np.int64).reshape(-1, 2)
            left.append(part[links[:, 0]])
            right.append(part[links[:, 1]])
        both = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
        return pa.RecordBatch.from_arrays(both, names=["a", "b"])

    held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        held_keys = np.concatenate([held_keys, batch.column("bucket").to_numpy()])
        held = np.concatenate([held, batch.column("fp").to_numpy().view(np.uint64)])
        last = int(np.searchsorted(held_keys, held_keys[-1]))
        if last:
            yield search(held_keys[:last], held[:last])
            held_keys, held = held_keys[last:], held[last:]
    if len(held):
        yield search(held_keys, held)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer_masks(mask: int, parts: int = MAX_BITS + 1) -> list[int]:
    """The mask with one more of `parts` equal blocks of the bits it leaves out; every link inside a bucket agrees in one."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def fingerprint_links(prints: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links a, b between the distinct fingerprints in column fp that connect what links within MAX_BITS connect.

    A bucket is a mask of bits and what a fingerprint has there. Buckets of more than
    bucket_rows are split by finer masks, again and again, until none is so large or their
    masks leave out at most FREE_BITS bits, which bounds the distinct fingerprints in one.
    """
    spark = prints.sparkSession
    blocks = [((1 << n) - 1) << at for at, n in BLOCKS]
    masks = sorted({a | b for a, b in combinations(blocks, 2)}, key=int.bit_count)
    rows = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask"))
    part = F.col("fp").bitwiseAND(F.col("mask"))
    small: DataFrame | None = None
    while True:
        rows = rows.select("fp", "mask", part.alias("part"))
        large = materialize(rows.groupBy("mask", "part").count().where(F.col("count") > bucket_rows).select("mask", "part", F.lit(True).alias("large")))
        n = large.count() if masks[0].bit_count() < 64 - FREE_BITS else 0
        if n:
            rows = rows.join(F.broadcast(large) if n <= BROADCAST_BUCKETS else large, ["mask", "part"], "left")
        done = rows.where("large is null").select("fp", "mask", "part") if n else rows
        small = done if small is None else small.unionByName(done)
        if not n:
            break
        pairs = [(_signed(m), _signed(x)) for m in masks for x in finer_masks(m)]  # 15 x 5 on the first turn
        finer = spark.createDataFrame(pairs, "mask long, finer long")
        masks = sorted({x for m in masks for x in finer_masks(m)}, key=int.bit_count)  # the first leaves out most
        rows = materialize(rows.where("large").join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask")))
    found = small.select("fp", F.xxhash64("mask", "part").alias("bucket"))  # buckets of one hash are compared together
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links, "a long, b long")


def _names(least: DataFrame, roots: DataFrame) -> DataFrame:
    """fp and component_id of the fingerprints that have a link.

    A component may hold a large share of all fingerprints: its names are written SALTS
    times, so that its fingerprints look them up in as many tasks.
    """
    linked = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
    names = linked.join(least.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    return own.join(salted, ["root", "salt"]).select(F.col("node").alias("fp"), "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Fingerprint and component of every document row.

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id
    reachable over links of at most MAX_BITS differing bits. Null and empty texts have the
    fingerprint zero, which links like any other. Repeated rows are repeated; rows with a
    null id belong to their component but never name it (a component of null ids only has a
    null component_id); other columns are ignored; an empty table gives an empty result.
    """
    docs = materialize(fingerprints(documents))
    least = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(fingerprint_links(least.select("fp")))
    linked = _names(least, roots).withColumn("linked", F.lit(True))
    member = least.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    return docs.join(member, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _row_key() -> Column:
    """Names a row by its id and text, both null-safe."""
    return F.concat(*[F.coalesce(F.unhex(F.md5(F.col(c).cast("string"))), F.lit("-").cast("binary")) for c in ("doc_id", "text")])


def keep_one_per_group(documents: DataFrame) -> DataFrame:
    """One row of each group of near-copies, with all columns.

    It is the row with the smallest id, null ids last; of several texts of that id, one that
    belongs to the group. Rows without an id stand for themselves, so a text that only they
    hold stays once. Rows that repeat id and text are one row.
    """
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), _row_key().alias("row"))
    kept = near_duplicates(documents.select(name.alias("doc_id"), "text")).select(F.col("component_id.row").alias("_row")).distinct()
    return documents.withColumn("_row", _row_key()).join(kept, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")

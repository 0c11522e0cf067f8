"""A neighbour index over unit vectors: cells around centres, and sign codes inside them.

Fitting draws a bounded sample (the smallest hashes of the ids), finds centres on it and
measures, on the sample's own nearest neighbours, how many cells a search has to probe and
how many code bits may differ so that the wanted share of them is found. Indexing assigns
every row to its nearest cell. A search meets only the rows of its probed cells, of these
only those whose codes are close are scored, and scores are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the fitted sample, and those of them that ask for their neighbours in it.
SAMPLE_ROWS = 8_000
ASKING_ROWS = 400
#: Centres are at most so many; every task holds them.
MOST_CELLS = 4_096
#: Bits of a code.
BITS = 512
ROUNDS = 10
#: Rows of a block of cells, and of those asking in it, that meet in one task.
PART_ROWS = 16_384
SEED = 11


@dataclass(frozen=True)
class NeighbourIndex:
    """Centres, planes of the codes' bits, cells to probe, and the bits that may differ."""

    centres: np.ndarray
    planes: np.ndarray
    probes: int
    differing: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Signs of the projections, packed into 64-bit words."""
        return np.packbits(vectors @ self.planes > 0, axis=1).view(np.uint64)

    def cells(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of every vector, the nearest first."""
        scores = vectors @ self.centres.T
        if n >= len(self.centres):
            return np.argsort(-scores, 1, kind="stable")
        best = np.argpartition(-scores, n - 1, 1)[:, :n]
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, 1), 1, kind="stable"), 1)


def _centres(sample: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; cells that lose all rows keep their centre."""
    centres = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def fit_index(vectors: DataFrame, k: int, least: float, recall: float = 0.95, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> NeighbourIndex:
    """Fit on at most sample_rows of vectors (bill_id, unit) for the k best neighbours above a score.

    The sample's neighbours are no nearer than those in all rows, so what is measured on
    them holds for all rows. Cells are twice the root of the number of rows by default.
    Without rows there is one cell without content.
    """
    total = vectors.count()
    drawn = vectors.orderBy(F.xxhash64("bill_id"), "bill_id").limit(sample_rows).select("unit").toPandas()  # of bounded size
    rng = np.random.default_rng(SEED)
    if not len(drawn):
        return NeighbourIndex(np.zeros((1, 1)), np.zeros((1, BITS)), 1, BITS)
    sample = np.stack(drawn["unit"].to_numpy())
    planes = rng.normal(size=(sample.shape[1], BITS))
    wanted = cells or min(MOST_CELLS, int(2 * total**0.5))
    index = NeighbourIndex(_centres(sample, max(1, min(wanted, len(sample))), rng), planes, 1, BITS)
    asking = np.arange(min(ASKING_ROWS, len(sample)))
    scores = sample[asking] @ sample.T
    scores[asking, asking] = -2
    best = np.argsort(-scores, 1, kind="stable")[:, :k]
    near = np.take_along_axis(scores, best, 1) > least
    if not near.any():
        return index
    order = index.cells(sample[asking], len(index.centres))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
    own = index.cells(sample, 1)[:, 0]
    ranks = np.take_along_axis(rank, own[best], 1)[near]
    codes = index.codes(sample)
    apart = np.bitwise_count(codes[asking][:, None] ^ codes[best]).sum(2)[near]
    each = recall**0.5
    return NeighbourIndex(index.centres, planes, int(np.quantile(ranks, each, method="higher")) + 1, int(np.quantile(apart, each, method="higher")))


def pieces(vectors: DataFrame, rows: int, part_rows: int) -> int:
    """Parts of about part_rows, or so many that pairs of parts keep every core busy."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-rows // part_rows), min(math.isqrt(2 * cores) + 1, -(-rows // 512)))


def matrix(unit: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column of lists, a row each."""
    flat = unit.combine_chunks() if isinstance(unit, pa.ChunkedArray) else unit
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def codes_of(column: pa.ChunkedArray) -> np.ndarray:
    """A number for every distinct value; nulls have -1."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def places_of(names: pa.ChunkedArray) -> np.ndarray:
    """The place of every name in their order."""
    place = np.empty(len(names), np.int64)
    place[pc.array_sort_indices(names.combine_chunks()).to_numpy()] = np.arange(len(names))
    return place


def ranked(rows: np.ndarray, scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best scores of every row, equal ones by place."""
    order = np.lexsort((places, -np.round(scores, 9), rows))
    found = rows[order]
    return order[np.arange(len(found)) - np.searchsorted(found, found) < k]


def dots(a: np.ndarray, rows: np.ndarray, b: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact scores of pairs of rows, some at a time."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), 1 << 15):
        part = slice(i, i + (1 << 15))
        out[part] = np.einsum("ij,ij->i", a[rows[part]], b[columns[part]])
    return out


def allotted(sizes: dict[int, int], part_rows: int) -> dict[int, tuple[int, int]]:
    """The first block of every cell and how many it has: small cells share one, large ones have several."""
    out, block, filled = {}, 0, 0
    for cell, n in sorted(sizes.items()):
        if filled and filled + n > part_rows:
            block, filled = block + 1, 0
        out[cell] = block, max(1, -(-n // part_rows))
        block, filled = (block, filled + n) if n <= part_rows else (block + out[cell][1], 0)
    return out


def nearest_in_cells(index: NeighbourIndex, asked: DataFrame, held: DataFrame, k: int, least: float, part_rows: int = PART_ROWS) -> DataFrame:
    """asked_id, held_id, score and tested of the k nearest rows of held, per block of cells.

    asked and held have bill_id, kind and unit; rows of the same id or the same kind are no
    neighbours. Held rows lie in blocks of about part_rows: small cells share one, large ones
    are dealt to several. A row that asks is sent to every block with a cell that it probes,
    once and without its codes, and meets the rows of the probed cells there; those that ask
    are dealt in parts too, so a task is bounded whatever share of the rows a cell holds and
    however many cells are probed. tested is the number of rows of the block that were scored;
    where none is above least, held_id and score are null.
    """
    id_type, kind_type = (held.schema[c].dataType.simpleString() for c in ("bill_id", "kind"))
    shape = f"bill_id {id_type}, kind {kind_type}, unit array<double>"

    def assign(probes: int, column: str, made: Callable[[np.ndarray], pa.Array], form: str) -> Callable[[DataFrame], DataFrame]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                    found = made(index.cells(matrix(batch.column("unit")), probes))
                    yield pa.RecordBatch.from_arrays([*batch.columns, found], names=["bill_id", "kind", "unit", column])

        return lambda rows: rows.select("bill_id", "kind", "unit").mapInArrow(add, f"{shape}, {column} {form}")

    counted = assign(1, "cell", lambda cells: pa.array(cells[:, 0].astype(np.int32)), "int")(held).groupBy("cell").count()
    sizes = {r[0]: r[1] for r in counted.collect()}  # a row for each cell
    total, n_asked = sum(sizes.values()), asked.count()
    a_parts = pieces(asked, n_asked, part_rows)
    blocks = allotted(sizes, max(1, -(-total // pieces(held, total, part_rows))))
    first = np.full(len(index.centres), -1)
    several = np.ones(len(index.centres), np.int64)
    for cell, (block, n) in blocks.items():
        first[cell], several[cell] = block, n
    n_blocks = int((first + several).max()) if blocks else 1

    def reached(cells: np.ndarray) -> pa.Array:
        """The blocks of the cells of every row."""
        met = np.zeros((len(cells), n_blocks + 1), np.int32)  # starts and ends of the cells' ranges of blocks
        at = np.repeat(np.arange(len(cells)), cells.shape[1])
        held_cells = first[cells.ravel()] >= 0
        np.add.at(met, (at[held_cells], first[cells.ravel()][held_cells]), 1)
        np.add.at(met, (at[held_cells], (first + several)[cells.ravel()][held_cells]), -1)
        rows, found = np.nonzero(met.cumsum(1)[:, :-1] > 0)
        offsets = np.searchsorted(rows, np.arange(len(cells) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.astype(np.int32)))

    def own(cells: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * 2), pa.array(np.stack([first[cells[:, 0]], several[cells[:, 0]]], 1).ravel().astype(np.int32)))

    ours = assign(index.probes, "blocks", reached, "array<int>")(asked).withColumn("a", F.pmod(F.xxhash64("bill_id"), F.lit(a_parts)).cast("int"))
    ours = ours.withColumn("h", F.explode("blocks")).select("a", "h", F.lit(0).alias("side"), F.col("bill_id").alias("id"), "kind", "unit")
    theirs = assign(1, "block", own, "array<int>")(held).withColumn("h", (F.col("block")[0] + F.pmod(F.xxhash64("bill_id"), F.col("block")[1])).cast("int"))
    theirs = theirs.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a_parts - 1)))).select("a", "h", F.lit(1).alias("side"), F.col("bill_id").alias("id"), "kind", "unit")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        unit, kinds, ids, ids_table = matrix(table.column("unit")), codes_of(table.column("kind")), codes_of(table.column("id")), table.column("id")
        places = places_of(ids_table)
        codes, cell = index.codes(unit), index.cells(unit[right], 1)[:, 0] if len(right) else right
        cells = [right[cell == c] for c in np.unique(cell)]
        out: list[tuple[np.ndarray, ...]] = []
        for some in (left[i : i + 1024] for i in range(0, len(left) if len(right) else 0, 1024)):
            probed = np.zeros((len(some), len(index.centres)), bool)
            np.put_along_axis(probed, index.cells(unit[some], index.probes), True, 1)
            found: list[tuple[np.ndarray, ...]] = []
            tested = np.zeros(len(table), np.int64)
            for c, members in zip(np.unique(cell), cells, strict=True):
                asking = some[probed[:, c]]
                for them in (members[i : i + 2048] for i in range(0, len(members), 2048)):
                    apart = np.zeros((len(asking), len(them)), np.uint16)
                    for word in range(codes.shape[1]):
                        apart += np.bitwise_count(codes[asking, word][:, None] ^ codes[them, word])
                    close = (apart <= index.differing) & (ids[asking][:, None] != ids[them]) & (kinds[asking][:, None] != kinds[them])
                    rows, columns = np.nonzero(close)
                    tested[asking] += close.sum(1)
                    scores = dots(unit, asking[rows], unit, them[columns])
                    above = scores > least
                    found.append((asking[rows[above]], them[columns[above]], scores[above]))
            rows, columns, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            best = ranked(rows, scores, places[columns], k)
            lacking = np.setdiff1d(some, rows)
            none = np.full(len(lacking), -1)
            out.append((np.concatenate([rows[best], lacking]), np.concatenate([columns[best], none]), np.concatenate([scores[best], none]), tested[np.concatenate([rows[best], lacking])]))
        made = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 4
        empty = made[1] < 0
        names = ids_table.combine_chunks()
        return pa.table({
            "asked_id": names.take(pa.array(made[0], pa.int64())), "held_id": names.take(pa.array(made[1], pa.int64(), mask=empty)),
            "score": pa.array(made[2].astype(float), mask=empty), "tested": pa.array(made[3], pa.int64()),
        })

    kind = lambda side: side.schema["bill_id"].dataType.simpleString()
    both = ours.unionByName(theirs).repartition(a_parts * n_blocks, "a", "h")
    return both.groupBy("a", "h").applyInArrow(compare, f"asked_id {kind(asked)}, held_id {kind(held)}, score double, tested long")

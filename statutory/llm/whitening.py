"""Embedding whitening: the covariance is gathered by Spark, its eigenvectors are refined.

Entries become integers, which are centred on integers near their means, so the sums of
products are exact and equal in any order of tasks. The driver holds one matrix of d x d
numbers for vectors of d entries, whatever the number of rows. It takes the eigenvectors of
that matrix in 32 bits and corrects them by the iterations of Ogita and Aishima, which are
products of matrices in extended precision. Eigenvalues too close for the correction form
clusters; each is solved once more on the small block that its vectors span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.llm.common import stored

#: Components that are returned.
COMPONENTS = 32
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Integers of 64-bit floats are exact below this.
EXACT = 1 << 53
#: Rows that a task holds at once.
SLICE_ROWS = 8192
#: Corrections after which the eigenvectors have to have settled.
MAX_STEPS = 60
#: The precision above doubles that this machine's numpy has.
High = np.longdouble

Partial = tuple[int, np.ndarray, np.ndarray]


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every length of the usable vectors of a batch: the length, their rows, and 64 times their entries, rounded down."""
    column = batch.column(1)
    lengths = np.where(np.asarray(column.is_null()), 0, np.diff(column.offsets.to_numpy()))
    first = column.offsets.to_numpy()[:-1]
    entries = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    for length in np.unique(lengths[lengths > 0]).tolist():
        of = np.flatnonzero(lengths == length)
        for at in range(0, len(of), SLICE_ROWS):
            rows = of[at : at + SLICE_ROWS]
            found = entries[first[rows, None] + np.arange(length)]
            with np.errstate(invalid="ignore", over="ignore"):
                found = np.floor(found * SCALE)
                good = (np.abs(found) < EXACT // 2).all(1)
            if good.any():
                yield length, rows[good], found[good]


def _integers(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch and their integer vectors, where these have the length."""
    for found, rows, scaled in _vectors(batch):
        if found == length:
            yield rows, scaled.astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for length, rows, scaled in _vectors(batch):
            n, so_far = totals.get(length, (0, np.zeros(length, object)))
            totals[length] = n + len(rows), so_far + (scaled.astype(np.int64).sum(0) + SHIFT * len(rows))
    for length, (n, s) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([length]), pa.array([n]), pa.array([s.tolist()], pa.list_(pa.decimal128(38)))], names=["d", "n", "s"])


def exact_products(z: np.ndarray) -> np.ndarray:
    """The sums of products of every two columns of whole numbers, as Python's numbers."""
    most = int(np.abs(z).max(initial=1))
    rows = EXACT // (most * most)
    if not rows:  # squares beyond 53 bits
        z = z.astype(object)
        return z.T @ z
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), rows):
        part = z[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def _products_of(centre: np.ndarray):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)), object)
        for batch in batches:
            for _, x in _integers(batch, len(centre)):
                total += exact_products(x - centre)
        for i, row in enumerate(total.tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([row[i:]], pa.list_(pa.decimal128(38)))], names=["i", "p"])

    return products


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision.

    Starts from the eigenvectors of the matrix in 32 bits. Every step measures how far they
    are from orthogonal (r) and from diagonalising (s), and adds the first-order correction.
    Where two eigenvalues lie closer than the error of that measure, the correction is
    undefined: such clusters are parted by an eigenproblem of their own, centred on their
    mean so that their differences keep all their digits, and corrected further.
    A matrix of zeros has the unit vectors.
    """
    n = len(a)
    size = High(np.abs(a).max()) if n else High(0)
    if size == 0:
        return np.zeros(n, High), np.eye(n, dtype=High)
    a = a.astype(High) / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(High)
    norm, one = np.sqrt((a * a).sum()), np.eye(n, dtype=High)
    eps = np.finfo(High).eps
    last = np.inf
    for _ in range(MAX_STEPS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        unsure = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        unsure = max(unsure, 4 * n * eps * norm)
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > unsure
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        change = float(np.abs(e).max())
        order = np.argsort(values, kind="stable")
        close = np.flatnonzero(np.diff(values[order]) <= unsure)
        if change < 1e-3:
            for group in np.split(order, np.setdiff1d(np.arange(n - 1), close) + 1):
                if len(group) > 1:
                    part = x[:, group]
                    block = part.T @ (a @ part) - values[group].mean() * (part.T @ part)
                    scale = np.abs(block).max()
                    if scale > 0:
                        turn = np.linalg.eigh((block / scale).astype(np.float64))[1]
                        x[:, group] = part @ turn.astype(High)
        if change <= 64 * eps or (change < 1e-15 and change >= last):
            break
        last = change
    for _ in range(2):  # whatever the last correction did to it, the basis is orthogonal
        x = x + x @ (one - x.T @ x) / 2
    values = ((a @ x) * x).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


def _whitener(centre: np.ndarray, shift: np.ndarray, turn: np.ndarray):
    def whiten(x: np.ndarray) -> np.ndarray:
        return ((x - centre).astype(np.float64) - shift) @ turn

    return whiten


def _deviation(x: np.ndarray, n: int, s: np.ndarray, centre: np.ndarray, rest: np.ndarray) -> list[int | None]:
    """Sums over dimensions of (n * x - s) ** 2, exact; null beyond a long."""
    z = x - centre
    bound = (float(np.abs(z).max(initial=0)) * n + float(np.abs(rest.astype(float)).max(initial=0))) ** 2 * x.shape[1]
    if bound < 2**62:
        y = n * z - rest.astype(np.int64)
        return (y * y).sum(1).tolist()
    y = n * z.astype(object) - rest
    return [v if v < 1 << 63 else None for v in (y * y).sum(1).tolist()]


def whiten_embeddings(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector on the first principal components.

    Returns id_col, component (from 1, by falling eigenvalue), n (vectors used), deviation
    (the sum over dimensions of (n * x - S) ** 2 with S the sums of the integer entries x),
    whitened, explained (the eigenvalue's share of the trace) and identity_error (the largest
    entry of the whitened covariance minus the identity, one value). Vectors that are null
    or empty, or that hold null or non-finite entries, are left out, and so are those
    shorter than the longest, whose last entries are missing, and those with entries of 2 ** 46
    and more, whose integers wouldn't be exact. Repeated rows are repeated, null ids stay.
    Where an eigenvalue is nothing but rounding (fewer vectors than dimensions, equal
    vectors), whitened is null and the component doesn't count for identity_error. A
    deviation beyond a long is null. No usable vectors give no rows; other columns are
    ignored.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    sums = stored(vectors.mapInArrow(_sums, "d long, n long, s array<decimal(38,0)>"))
    d = sums.agg(F.max("d")).first()[0]
    if d is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    sums = sums.where(F.col("d") == d)
    n = int(sums.agg(F.sum("n")).first()[0])
    found = sums.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # d rows
    s = np.array([int(r.v) for r in sorted(found)], object)
    centre_exact = np.array([(2 * v + n) // (2 * n) for v in s], object)
    centre = centre_exact.astype(np.int64)
    rest = s - n * centre_exact  # sums of the centred entries, at most n / 2 each

    parts = vectors.mapInArrow(_products_of(centre), "i long, p array<decimal(38,0)>")
    added = parts.select("i", F.posexplode("p").alias("k", "p")).groupBy("i", "k").agg(F.sum("p").alias("p"))
    products = np.zeros((d, d), object)
    for r in added.collect():  # one for each two dimensions
        products[r.i, r.i + r.k] = products[r.i + r.k, r.i] = int(r.p)
    whole = n * products - np.outer(rest, rest)  # n * n times the covariance, exact
    covariance = np.array([[High(str(v)) for v in row] for row in whole.tolist()], High) / High(str(n * n))
    values, directions = eigen(covariance)
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(d)])
    trace = np.trace(covariance)
    k = min(components, d)
    real = values[:k] > max(d * float(np.finfo(np.float64).eps) * float(trace), 0.0)
    spread = np.sqrt(np.where(real, values[:k], 1))
    turn = np.where(real, directions[:, :k] / spread, 0).astype(np.float64)
    shift = np.array([float(High(str(v)) / High(n)) for v in rest])
    explained = np.where(real, values[:k] / np.where(trace > 0, trace, 1), 0).astype(np.float64)
    whiten = _whitener(centre, shift, turn)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in _integers(batch, d):
                y = whiten(x)
                total[:k] += y.T @ y
                total[k] += y.sum(0)
        for i, row in enumerate(total.tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([row], pa.list_(pa.float64()))], names=["i", "v"])

    spanned = np.zeros((k + 1, k))
    measured = vectors.mapInArrow(spans, "i long, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    for r in measured.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # one for each two components
        spanned[r.i, r.j] = r.v / n
    unit = spanned[:k] - np.outer(spanned[k], spanned[k]) - np.eye(k)  # the means are 0 but for rounding
    error = float(np.abs(unit[np.ix_(real, real)]).max(initial=0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _integers(batch, d):
                y = whiten(x)
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        pa.array(_deviation(x, n, s, centre, rest), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(y.ravel(), mask=np.tile(~real, m)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(rows, schema).withColumnRenamed("id", id_col)

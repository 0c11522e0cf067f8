"""Boosted trees and forests for two classes, a fold of a bounded training set in each task.

Features are binned by quantiles that Spark takes over all rows. A tree is grown level by
level from sums per node, feature and bin. With a target of 0 and 1 the split that takes most
from the variance takes most from the Gini impurity too, so both kinds of trees share it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Bins of a feature; rows whose sums are taken at a time.
BINS, BLOCK = 32, 1 << 16
#: How the parts of Trees are kept.
KINDS = {"starts": np.int64, "feature": np.int8, "last": np.uint8, "child": np.int32, "value": np.float32}
COLUMNS = ", ".join(f"{c} binary" for c in KINDS)
#: Trees of a forest that one task grows.
GROWN = 50
#: Share of rows and of features that a boosted tree sees, its depth, and the fewest rows of a leaf.
SHARE, BOOSTED_DEPTH, LEAST_ROWS = 0.7, 6, 10


@dataclass(frozen=True)
class Trees:
    """The nodes of all trees, from starts[i] on those of tree i: the feature (-1: a leaf), the last bin that goes left, the left child (the right one follows), and the value."""

    starts: np.ndarray
    feature: np.ndarray
    last: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def sums(self, bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of the trees' values for every row of bins."""
        out, rows = np.zeros(len(bins)), np.arange(len(bins))
        for start, end, weight in zip(self.starts[:-1], self.starts[1:], weights, strict=True):
            feature, last, child, value = (x[start:end] for x in (self.feature, self.last, self.child, self.value))
            out += weight * value[_leaves(feature, last, child, bins, rows)]
        return out


def _leaves(feature: np.ndarray, last: np.ndarray, child: np.ndarray, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    node = np.zeros(len(bins), np.int64)
    moving = rows
    while len(moving):
        split = feature[node[moving]]
        moving, split = moving[split >= 0], split[split >= 0]
        at = node[moving]
        node[moving] = child[at] + (bins[moving, split] > last[at])
    return node


@dataclass(frozen=True)
class Folds:
    """The boosted trees and the forest of every fold, the ends of their bins, and the weight of a boosting round."""

    pairs: list[tuple[Trees, Trees]]
    edges: list[np.ndarray]
    rate: float


def boosted_weights(n: int, rate: float) -> np.ndarray:
    return np.concatenate([[1.0], np.full(max(0, n - 1), rate)])[:n]


def _grown(bins: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: int, n_features: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One tree: feature, last bin, left child and value of its nodes."""
    size = 2 ** (depth + 1) - 1
    feature, last, child, value = np.full(size, -1, np.int8), np.zeros(size, np.uint8), np.zeros(size, np.int32), np.zeros(size, np.float32)
    used = 1
    rows, nodes = np.flatnonzero(weight), np.array([0])
    at = np.zeros(len(rows), np.int64)  # the place of a row's node among the nodes of the level
    for level in range(depth + 1):
        w, s = (np.bincount(at, x[rows], len(nodes)) for x in (weight, weight * target))
        value[nodes] = s / w
        if level == depth:
            break
        chosen = rng.random((len(nodes), bins.shape[1])).argsort(1)[:, :n_features]
        sums = np.zeros((3, len(nodes) * n_features * BINS))
        for i in range(0, len(rows), BLOCK):
            some, own = rows[i : i + BLOCK], at[i : i + BLOCK]
            place = ((own[:, None] * n_features + np.arange(n_features)) * BINS + np.take_along_axis(bins[some], chosen[own], 1)).ravel()
            for total, x in zip(sums, (weight[some], weight[some] * target[some], None if least <= 1 else np.ones(len(some))), strict=True):
                if x is not None:
                    total += np.bincount(place, np.repeat(x, n_features), len(total))
        left = sums.reshape(3, len(nodes), n_features, BINS).cumsum(3)
        whole = left[:, :, :, -1:]
        right = whole - left
        allowed = (left[0] > 1e-9) & (right[0] > 1e-9)
        if least > 1:
            allowed &= (left[2] >= least) & (right[2] >= least)
        with np.errstate(all="ignore"):
            gain = np.where(allowed, left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0], -1).reshape(len(nodes), -1)
        best = gain.argmax(1)
        splits = gain[np.arange(len(nodes)), best] > 1e-12
        if not splits.any():
            break
        by, upto = chosen[np.arange(len(nodes)), best // BINS], best % BINS
        feature[nodes[splits]], last[nodes[splits]] = by[splits], upto[splits]
        stays = splits[at]
        rows, at = rows[stays], at[stays]
        number = np.cumsum(splits) - 1
        at = 2 * number[at] + (bins[rows, by[at]] > upto[at])
        child[nodes[splits]] = used + 2 * np.arange(splits.sum())
        nodes = np.arange(used, used + 2 * splits.sum())
        used += len(nodes)
    return feature[:used], last[:used], child[:used], value[:used]


def _stacked(grown: list[tuple[np.ndarray, ...]]) -> Trees:
    starts = np.cumsum([0, *(len(x[0]) for x in grown)]).astype(np.int64)
    return Trees(starts, *(np.concatenate(x) for x in zip(*grown, strict=True)))


def boosted(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, held: np.ndarray, rounds: int, patience: int, rate: float, seed: int) -> Trees:
    """Trees on the rows that are not held out, up to the round after which the held-out log loss has not fallen for `patience` rounds."""
    rng, sign = np.random.default_rng(seed), 2.0 * label - 1
    score, grown, losses = np.zeros(len(label)), [], []
    every, n_features = np.arange(len(label)), math.ceil(SHARE * bins.shape[1])
    while len(grown) < rounds and (not losses or len(losses) - 1 - int(np.argmin(losses)) < patience):
        target = sign if not grown else 4 * sign / (1 + np.exp(2 * sign * score))
        seen = weight * ~held * (rng.random(len(label)) < SHARE)
        if not seen.any():
            continue
        tree = _grown(bins, target, seen, BOOSTED_DEPTH, LEAST_ROWS, n_features, rng)
        score += (rate if grown else 1.0) * tree[3][_leaves(*tree[:3], bins, every)]
        grown.append(tree)
        losses.append(float(np.sum(weight[held] * 2 * np.logaddexp(0, -2 * sign[held] * score[held]))))
    return _stacked(grown[: int(np.argmin(losses)) + 1])


def forest(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, n: int, depth: int, seed: list[int]) -> Trees:
    """n trees on resampled rows, each node split by one of as many features as the root of their number."""
    rng = np.random.default_rng(seed)
    n_features = math.ceil(math.sqrt(bins.shape[1]))
    grown: list[tuple[np.ndarray, ...]] = []
    while len(grown) < n:
        drawn = weight * rng.poisson(1, len(label))
        if drawn.any():
            grown.append(_grown(bins, label.astype(float), drawn, depth, 1, n_features, rng))
    return _stacked(grown)


def quantiles(frame: DataFrame, features: tuple[str, ...]) -> list[np.ndarray]:
    """At most 31 ends of bins for every feature."""
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    row = frame.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f) for f in features]).first()
    return [np.unique(np.array(row[f] or [], float)) for f in features]


def binned(batch: pa.RecordBatch | pa.Table, features: tuple[str, ...], edges: list[np.ndarray]) -> np.ndarray:
    """The bins of the rows; missing values lie in the last one."""
    columns = (pc.fill_null(batch.column(f).cast(pa.float64()), float("nan")) for f in features)
    return np.stack([np.searchsorted(e, c.to_numpy()).astype(np.uint8) for e, c in zip(edges, columns, strict=True)], 1)


def fit_folds(frame: DataFrame, features: tuple[str, ...], label: str, folds: int, rounds: int, trees: int, depth: int, patience: int, rate: float) -> Folds:
    """Boosted trees and a forest for every fold of a frame (bill_id, features, label, weight, fold).

    A fold's boosted trees are one task, and every GROWN trees of its forest are one; each
    gets the rows as bins, in the order of their ids.
    """
    edges = quantiles(frame, features)
    pieces = 1 + -(-trees // GROWN)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [x.tobytes() for x in binned(batch, features, edges)]
            yield pa.RecordBatch.from_arrays([batch.column("bill_id"), batch.column("label").cast(pa.int32()), batch.column("weight"), batch.column("fold"), pa.array(bins, pa.binary())], names=["id", "label", "weight", "fold", "bins"])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        k, piece = divmod(key[0].as_py(), pieces)
        table = table.sort_by("id")
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(len(table), -1)
        y, weight, held = table.column("label").to_numpy(), table.column("weight").to_numpy(), table.column("fold").to_numpy() == k
        if not weight[~held].any():
            raise ValueError(f"no rows to train on beside fold {k}")
        if piece == 0:
            found = boosted(bins, y, weight, held, rounds, patience, rate, 1)
        else:
            found = forest(bins[~held], y[~held], weight[~held], min(GROWN, trees - GROWN * (piece - 1)), depth, [1 + k, piece])
        return pa.table({"unit": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([getattr(found, c).tobytes()], pa.binary()) for c in KINDS}})

    rows = frame.select("bill_id", F.col(label).alias("label"), F.col("weight").cast("double").alias("weight"), F.col("fold").cast("int").alias("fold"), *features)
    id_type = frame.schema["bill_id"].dataType.simpleString()
    dealt = rows.mapInArrow(put, f"id {id_type}, label int, weight double, fold int, bins binary").withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(folds * pieces - 1))))
    found = dealt.repartition(folds * pieces, "unit").groupBy("unit").applyInArrow(fit, f"unit int, {COLUMNS}")
    made = {r.unit: _read(r) for r in found.collect()}
    return Folds([(made[k * pieces], _joined([made[k * pieces + i] for i in range(1, pieces)])) for k in range(folds)], edges, rate)


def _read(row: Row) -> Trees:
    return Trees(*(np.frombuffer(row[c], kind) for c, kind in KINDS.items()))


def _joined(parts: list[Trees]) -> Trees:
    before = np.cumsum([0, *(p.starts[-1] for p in parts)])
    starts = np.concatenate([[0], *(p.starts[1:] + n for p, n in zip(parts, before, strict=False))])
    return Trees(starts, *(np.concatenate([getattr(p, c) for p in parts]) for c in list(KINDS)[1:]))


def with_scores(data: DataFrame, features: tuple[str, ...], models: Folds, fold: str | None = None) -> DataFrame:
    """Adds gbt and forest: the means of all folds' scores, or with fold those of the models that did not see the row."""

    def scores(pair: tuple[Trees, Trees], bins: np.ndarray) -> np.ndarray:
        n = [len(x) for x in pair]
        return np.stack([1 / (1 + np.exp(-2 * pair[0].sums(bins, boosted_weights(n[0], models.rate)))), pair[1].sums(bins, np.full(n[1], 1 / n[1]))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(batch, features, models.edges)
            if fold is None:
                found = sum(scores(pair, bins) for pair in models.pairs) / len(models.pairs)
            else:
                own, found = batch.column(fold).to_numpy(), np.zeros((2, len(bins)))
                for k in np.unique(own):
                    found[:, own == k] = scores(models.pairs[k], bins[own == k])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=[*batch.schema.names, "gbt", "forest"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields)
    return data.mapInArrow(add, f"{types}, gbt double, forest double")


def save(spark: SparkSession, models: Folds, path: str) -> None:
    ends = [e.tolist() for e in models.edges]
    rows = [(k, i, *(bytearray(getattr(t, c).tobytes()) for c in KINDS), ends, models.rate) for k, pair in enumerate(models.pairs) for i, t in enumerate(pair)]
    spark.createDataFrame(rows, f"fold int, kind int, {COLUMNS}, edges array<array<double>>, rate double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Folds:
    rows = {(r.fold, r.kind): r for r in spark.read.parquet(path).collect()}
    pairs = [tuple(_read(r) for r in (rows[k, 0], rows[k, 1])) for k in range(len(rows) // 2)]
    return Folds(pairs, [np.array(e, float) for e in rows[0, 0].edges], rows[0, 0].rate)

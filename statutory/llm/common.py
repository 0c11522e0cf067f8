"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task holds at once, except where one text alone is longer.
SLICE_BYTES = 4 << 20

#: 256-byte table: A-Z to a-z, other ASCII than a-z and 0-9 to a space, bytes of non-ASCII characters kept.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage.

    The folder is the one that the cluster names in spark.checkpoint.dir. Without one, a
    local session takes a temporary folder, as in tests; a cluster raises, as its executors
    would each write to a disk of their own.
    """
    spark = df.sparkSession
    _shared_folder(spark)
    return df.checkpoint()


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """As materialize, but as compressed Parquet, of which later steps read the columns they need.

    The table is deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    place = f"{_shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def id_hash_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece stay within limit bytes (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def row_field(batch: pa.RecordBatch, row: str, field: str) -> pa.Array:
    """A field of a struct column."""
    return pc.struct_field(batch.column(row), field)


def row_slices(batches: Iterator[pa.RecordBatch], row: str, field: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """As slices, by the sizes of a text in a struct column."""
    for batch in batches:
        sized = pa.RecordBatch.from_arrays([batch.column(row), row_field(batch, row, field)], names=[row, "_sized"])
        for part in slices(iter([sized]), "_sized", limit):
            yield pa.RecordBatch.from_arrays([part.column(row)], schema=batch.schema)


_warm: dict[str, Any] = {}


def only_warm(kind: str, model: Any, forget: Callable[[Any], None]) -> Any:
    """The model; what an earlier one of its kind has come to remember in this Python worker is forgotten."""
    earlier = _warm.get(kind)
    if earlier is not model:
        if earlier is not None:
            forget(earlier)
        _warm[kind] = model
    return model


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null gives no bytes."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def same_rows(batch: pa.RecordBatch, keep: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of batch with new ones beside them."""
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in keep] + list(more.values()), names=keep + list(more)
    )

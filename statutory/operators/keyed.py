"""A table by key that batches are added to: buckets by key, files by batch, and compaction.

A batch is written as files of its own below its number and reads nothing, however many
came before; running it again replaces its files. Which row of a key holds is settled when
the table is read: the row of the first batch (insert, ignore what comes again) or of the
last (update). Reading some keys opens their buckets only. Compaction merges the batches of
every bucket into one version and moves on the number up to which batches are in it, so the
files of a bucket stay few; the manifest of a version is written last and makes it count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 32


class KeyedTable:
    """Rows of a schema in a folder, one for each value of keys. Null is a key like any other."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], wins: str = "first", buckets: int = BUCKETS) -> None:
        if wins not in ("first", "last"):
            raise ValueError("the first or the last batch wins")
        self.spark, self.path, self.schema, self.keys, self.wins, self.buckets = spark, path.rstrip("/"), schema, keys, wins, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _numbers(self, folder: str, name: str) -> list[int]:
        """The numbers in the names of the folders below one that are whole."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        whole = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(place) if s.getPath().getName().startswith(f"{name}=") and whole(s.getPath()))

    def _winners(self, rows: DataFrame) -> DataFrame:
        order = F.col("_batch") if self.wins == "first" else F.col("_batch").desc()
        return rows.withColumn("_at", F.row_number().over(Window.partitionBy("bucket", *self.keys).orderBy(order))).where("_at = 1").drop("_at")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Write a batch; of several rows of one key in it one stays."""
        fresh = rows.dropDuplicates(self.keys).withColumn("bucket", self._bucket())
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batches/batch={batch}")

    def _compacted(self) -> tuple[int, int]:
        """The last version and the last batch in it; -1 and -1 before the first compaction."""
        versions = self._numbers("manifest", "version")
        if not versions:
            return -1, -1
        row = self.spark.read.schema("upto long").parquet(f"{self.path}/manifest/version={versions[-1]}").first()
        return versions[-1], row["upto"]

    def _held(self, buckets: list[int] | None) -> DataFrame | None:
        """Rows with _batch and bucket: the last version, and the batches after it."""
        version, upto = self._compacted()
        found: list[DataFrame] = []
        if version >= 0:
            found.append(self.spark.read.schema(f"{self.schema}, _batch long, bucket int").parquet(f"{self.path}/base/version={version}"))
        batches = [n for n in self._numbers("batches", "batch") if n > upto]
        if batches:
            reader = self.spark.read.schema(f"{self.schema}, bucket int, batch long").option("basePath", f"{self.path}/batches")
            found.append(reader.parquet(*[f"{self.path}/batches/batch={n}" for n in batches]).withColumnRenamed("batch", "_batch"))
        if not found:
            return None
        every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return every if buckets is None else every.where(F.col("bucket").isin(buckets))

    def read(self, of: DataFrame | None = None) -> DataFrame:
        """The row of every key, or of the keys in `of`, whose buckets alone are opened."""
        buckets = None if of is None else [r[0] for r in of.select(self._bucket().alias("b")).distinct().collect()]  # at most self.buckets
        held = self._held(buckets)
        if held is None:
            return self.spark.createDataFrame([], self.schema)
        rows = self._winners(held).drop("_batch", "bucket")
        if of is None:
            return rows
        asked = of.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        return rows.join(asked, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys], "left_semi")

    def compact(self) -> None:
        """Merge all whole batches into a new version. Readers of the last one still find their files."""
        batches, (version, upto) = self._numbers("batches", "batch"), self._compacted()
        held = self._held(None)
        if held is None or not batches or batches[-1] <= upto:
            return
        rows = self._winners(held)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/version={version + 1}")
        done = self.spark.range(1).select(F.lit(batches[-1]).cast("long").alias("upto"))
        done.write.mode("overwrite").parquet(f"{self.path}/manifest/version={version + 1}")

    def vacuum(self) -> None:
        """Delete the files that the last version has replaced; no reader may be under way."""
        version, upto = self._compacted()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        old = [f"base/version={n}" for n in self._numbers("base", "version") if n < version] + [f"batches/batch={n}" for n in self._numbers("batches", "batch") if n <= upto]
        for folder in old:
            place = path(f"{self.path}/{folder}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

"""A keyword index that is kept: postings bucketed by term, in blocks with bounds, appended to by batch.

Documents are dealt into ranges of about RANGE_ROWS, by classes of their length and then by
hash, and a range has the same documents for every term. A block is a term's postings in a
range: ids, term frequencies and lengths as arrays, with the highest frequency and the
least length beside them. Any document of the range scores at most what these two give,
summed over the terms of a query, so a search reads the bounds first, scores each query's
best ranges, and then only ranges whose bound reaches the k-th best score found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statutory.operators.search import B, K1, tokens
from statutory.operators.windows import top_per_group

BUCKETS = 64
RANGE_ROWS = 1024
#: Ranges that are scored first for every query.
FIRST_RANGES = 4

_BLOCK = "range long, term string, n int, max_tf int, min_length int, ids array<{id}>, tfs array<int>, lengths array<int>, batch int, bucket int"
_STATS = "batch int, n_docs long, total_length long, id_type string"


class PostingsIndex:
    """The index in a folder; every batch of documents (id, document) adds files and rewrites none."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def stats(self) -> DataFrame:
        return self.spark.read.schema(_STATS).parquet(f"{self.path}/stats")

    def blocks(self) -> DataFrame:
        id_type = self.stats().first()["id_type"]
        return self.spark.read.schema(_BLOCK.format(id=id_type)).parquet(f"{self.path}/postings")

    def append(self, documents: DataFrame, batch: int) -> None:
        """Add documents, whose ids are new to the index, as a batch of a number of its own; texts are tokenized once.

        A batch whose number is there already changes nothing, and one that failed half-way replaces its files, so a
        batch that is tried again isn't added twice. The row of statistics comes last and makes the batch count;
        searches see a batch whole or not at all.
        """
        if batch in self.batches():
            return
        words = documents.select("id", tokens("document").alias("words"))
        lengths = words.select("id", F.explode_outer("words").alias("term"), F.size("words").alias("length"))
        counted = lengths.groupBy("id", "term", "length").agg(F.count("*").cast("int").alias("tf"))
        place = f"{self.path}/counted/batch={batch}"
        counted.write.mode("overwrite").parquet(place)
        counted = self.spark.read.schema(counted.schema).parquet(place)
        docs = counted.select("id", "length").distinct()
        of_length = F.floor(4 * F.log2(F.lit(1) + F.greatest("length", F.lit(0)))).cast("int")  # some dozen classes
        parts = docs.groupBy(of_length.alias("class")).agg(F.ceil(F.count("*") / F.lit(RANGE_ROWS)).alias("parts"))
        numbered = counted.where("term is not null").withColumn("class", of_length).join(F.broadcast(parts), "class")
        where = F.shiftleft(F.lit(batch).cast("long"), 40) + F.shiftleft(F.col("class").cast("long"), 32) + F.pmod(F.xxhash64("id"), F.col("parts"))
        rows = numbered.select(where.alias("range"), "term", F.struct("id", "tf", "length").alias("p"))
        blocks = rows.groupBy("range", "term").agg(F.array_sort(F.collect_list("p")).alias("p"))
        id_type = documents.schema["id"].dataType.simpleString()
        columns = blocks.select(
            "range", "term", F.size("p").alias("n"), F.array_max("p.tf").alias("max_tf"), F.array_min("p.length").alias("min_length"),
            F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"), F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        )
        sorted_ = columns.repartition("bucket").sortWithinPartitions("bucket", "term")
        sorted_.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        totals = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.greatest("length", F.lit(0)).cast("long")), F.lit(0)).alias("total_length"))
        row = totals.select(F.lit(batch).alias("batch"), "n_docs", "total_length", F.lit(id_type).alias("id_type"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/stats")
        used = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        used.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(used, True)

    def batches(self) -> set[int]:
        """Numbers of the batches in the index; a folder without an index has none."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stats")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return set()
        return {r["batch"] for r in self.stats().select("batch").collect()}  # one row a batch

    def read(self, terms: DataFrame) -> DataFrame:
        """Blocks of the buckets of terms (column term), of whole batches only."""
        wanted = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # BUCKETS at most
        return self.blocks().where(F.col("bucket").isin(wanted) & F.col("batch").isin(*self.batches()))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best documents of every query (query_id, query): query_id, id, score, rank. Ties go to the smaller id.

        Equal to search.bm25 over all documents of the index. Queries without a known term
        have no rows.
        """
        asked = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
        blocks = self.read(asked)
        totals = self.stats().agg(F.sum("n_docs").alias("n_docs"), (F.sum("total_length") / F.sum("n_docs")).alias("mean_length"))
        bounds = blocks.select("term", "range", "n", "max_tf", "min_length")
        df = bounds.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(totals))  # one row of totals
        weighted = asked.join(df, "term").withColumn("idf", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        weighted = weighted.select("query_id", "term", "idf", "mean_length")
        most = weighted.join(bounds, "term").groupBy("query_id", "range").agg(F.sum(F.col("idf") * _part("max_tf", "min_length")).alias("bound"))
        first = top_per_group(most, ["query_id"], [F.desc("bound"), "range"], FIRST_RANGES, rank="at").select("query_id", "range")
        found = self._score(weighted, blocks, first)
        reached = top_per_group(found, ["query_id"], [F.desc("score")], k, rank="at").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        least = F.when(F.col("n") >= k, F.col("least"))
        open_ = most.join(first, ["query_id", "range"], "left_anti").join(reached, "query_id", "left").where(least.isNull() | (F.col("bound") >= least - 1e-6))
        scores = found.unionByName(self._score(weighted, blocks, open_.select("query_id", "range"))).where("score > 0")
        return top_per_group(scores, ["query_id"], [F.round("score", 9).desc(), "id"], k, rank="rank")

    @staticmethod
    def _score(weighted: DataFrame, blocks: DataFrame, ranges: DataFrame) -> DataFrame:
        """query_id, id and score of the documents in ranges (query_id, range)."""
        met = weighted.join(ranges, "query_id").join(blocks.select("term", "range", "ids", "tfs", "lengths"), ["term", "range"])
        single = met.select("query_id", "idf", "mean_length", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"))).alias("p"))
        scored = single.select("query_id", F.col("p.id").alias("id"), (F.col("idf") * _part("p.tf", "p.length")).alias("part"))
        return scored.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def _part(tf: str, length: str) -> Column:
    """A term's share of a score but for idf; grows with tf and falls with length."""
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.col("mean_length")))

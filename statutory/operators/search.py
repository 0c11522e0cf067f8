"""Keyword, vector and fused search, similar bills and their spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statutory.operators.neighbours import codes_of, dots, fit_index, matrix, nearest_in_cells, pieces, places_of, ranked
from statutory.operators.windows import first_text, top_per_group

K1, B = 1.5, 0.75
# English words that carry no meaning alone.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no",
    "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to",
    "was", "will", "with",
)
#: Query vectors up to so many bytes together are broadcast; more meet the rows in blocks of BLOCK_BYTES.
BROADCAST_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
#: Similar bills are compared exactly up to this number of vectors, and found by an index beyond it.
EXACT_ROWS = 50_000
RRF = 60


def corpus(bills: DataFrame, texts: DataFrame, chars: int = 5000) -> DataFrame:
    """One document per bill: its title and its first text."""
    joined = bills.select("id", "title", "jurisdiction_id").join(first_text(texts, chars).withColumnRenamed("bill_id", "id"), "id", "left")
    return joined.select("id", "jurisdiction_id", F.concat_ws(" ", "title", "text").alias("document"))


def tokens(text: str | Column) -> Column:
    """Lower-case words of two characters or more, without stop words."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    words = F.regexp_extract_all(low, F.lit(r"(?U)(\w\w+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def inverted_index(documents: DataFrame) -> DataFrame:
    """term, id, tf, doc_length and df of every posting; tf is combined before the shuffle."""
    words = documents.select("id", tokens("document").alias("words"))
    lengths = words.select("id", F.size("words").alias("doc_length"))
    postings = words.select("id", F.explode("words").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return postings.join(df, "term").join(lengths, "id")


def bm25(documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best documents of every query: query_id, id, score, rank. Ties go to the smaller id.

    Only postings of query terms are counted: the terms, which are as few as the queries
    say, go to the documents before anything is shuffled.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
    wanted = asked.select("term").distinct()
    words = documents.select("id", tokens("document").alias("words"))
    stats = words.agg(F.count("*").alias("n_docs"), F.avg(F.coalesce(F.size("words"), F.lit(0))).alias("mean_length"))  # a null document has no words
    found = words.select("id", F.size("words").alias("doc_length"), F.explode("words").alias("term")).join(wanted, "term")
    postings = found.groupBy("term", "id", "doc_length").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    joined = asked.join(postings.join(df, "term"), "term").crossJoin(F.broadcast(stats))  # one row of totals
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_length") / F.col("mean_length")))
    scores = joined.groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    return top_per_group(scores, ["query_id"], [F.round("score", 9).desc(), "id"], k, rank="rank")


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors of length one; zero vectors are left out, as they are similar to none."""
    as_doubles = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(as_doubles, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn("_norm", norm).where("_norm > 0").withColumn("unit", F.transform(as_doubles, lambda x: x / F.col("_norm"))).drop("_norm", "embedding")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k nearest bills of every query vector by cosine; queries are a stated set that meets all rows.

    A set of up to broadcast_bytes (8 for each entry) goes to the rows; a larger one meets them in blocks.
    """
    asked = unit(queries.select("query_id", "embedding"))
    if (asked.agg(F.sum(F.size("unit"))).first()[0] or 0) * 8 > broadcast_bytes:
        found = _nearest_in_blocks(asked.withColumnRenamed("query_id", "asked_id"), unit(vectors).withColumnRenamed("bill_id", "held_id"), k)
        scored = found.select(F.col("asked_id").alias("query_id"), F.col("held_id").alias("id"), "score")
    else:
        pairs = unit(vectors).crossJoin(F.broadcast(asked.withColumnRenamed("unit", "asked")))
        scored = pairs.select("query_id", F.col("bill_id").alias("id"), dot("unit", "asked").alias("score"))
    return top_per_group(scored, ["query_id"], [F.round("score", 9).desc(), "id"], k, rank="rank")


def _block_rows(rows: int, numbers: int | None) -> int:
    """Rows of a block of BLOCK_BYTES, by how many numbers all rows have."""
    return max(1, BLOCK_BYTES * rows // (8 * (numbers or 1)) if rows else 1)


def _nearest_in_blocks(asked: DataFrame, held: DataFrame | None, k: int, least: float = -2.0, group: str | None = None, block_rows: int | None = None) -> DataFrame:
    """asked_id, held_id and score of the k nearest held vectors (column unit) of every asked one, per block of held ones.

    Both sides are dealt into blocks of about block_rows (by default of BLOCK_BYTES), and each
    pair of blocks is one group, so what a task holds is bounded at any size; the work inside
    is a matrix product. Without held the asked ones are compared with each other: two blocks
    meet once for both directions, so a row is sent once for each block. With group, rows of
    the same group or the same id are no neighbours.
    """
    import numpy as np
    import pyarrow as pa

    alone = held is None
    sides = [asked] if alone else [asked, held]
    sizes = [side.agg(F.count("*"), F.sum(F.size("unit"))).first() for side in sides]
    parts = [pieces(side, n, block_rows or _block_rows(n, numbers)) for side, (n, numbers) in zip(sides, sizes, strict=True)]
    names = ("asked_id", "held_id")

    def dealt(i: int) -> DataFrame:
        own = F.pmod(F.xxhash64(names[i]), F.lit(parts[i])).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(parts[-1 - i] - 1)))
        rows = sides[i].select(F.col(names[i]).alias("id"), F.col(group).alias("kind") if group else F.lit(None).cast("string").alias("kind"), "unit", own.alias("own")).withColumn("other", other)
        if alone:
            return rows.select("id", "kind", "unit", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("h"), (F.col("own") > F.col("other")).cast("int").alias("side"))
        return rows.select("id", "kind", "unit", *[F.col(c).alias(x) for c, x in zip(("own", "other"), "ah" if i == 0 else "ha", strict=True)], F.lit(i).alias("side"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        side, unit = table.column("side").to_numpy(), matrix(table.column("unit"))
        ids, kinds, places = codes_of(table.column("id")), codes_of(table.column("kind")), places_of(table.column("id"))
        low = unit.astype(np.float32)
        slack = 1.2e-7 * (unit.shape[1] + 4)  # more than single precision can be wrong by
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        itself = alone and key[0].as_py() == key[1].as_py()
        ways = [(left, left)] if itself else [(left, right), (right, left)] if alone else [(left, right)]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for ours, theirs in ways:
            step = max(1, min(256, (8 << 20) // (4 * max(1, len(theirs)))))
            matched = low[theirs].T
            for start in range(0, len(ours) if len(theirs) else 0, step):
                some = ours[start : start + step]
                scores = low[some] @ matched
                if group:
                    scores[(kinds[some][:, None] == kinds[theirs]) | (ids[some][:, None] == ids[theirs])] = -4
                floor = np.full(len(some), max(least - slack, -3))
                width = 64 if len(theirs) >= 128 * k else 1
                if len(theirs) > k:  # k groups of scores have a greatest one of at least this, so the k-th best has
                    greatest = scores[:, : len(theirs) // width * width].reshape(len(some), -1, width).max(2)
                    floor = np.maximum(floor, np.partition(greatest, -k, axis=1)[:, -k] - 2 * slack - 1e-8)  # all that tie with the k-th best are ranked
                rows, columns = np.nonzero(scores >= floor[:, None])
                exact = dots(unit, some[rows], unit, theirs[columns])
                above = exact > least
                rows, columns, exact = some[rows[above]], theirs[columns[above]], exact[above]
                best = ranked(rows, exact, places[columns], k)
                out.append((rows[best], columns[best], exact[best]))
        rows, columns, exact = (np.concatenate(x) for x in zip(*out, strict=True))
        found = table.column("id").combine_chunks()
        return pa.table({"asked_id": found.take(pa.array(rows)), "held_id": found.take(pa.array(columns)), "score": exact})

    both = dealt(0) if alone else dealt(0).unionByName(dealt(1))
    kind = lambda side, c: side.schema[c].dataType.simpleString()
    groups = parts[0] * (parts[0] + 1) // 2 if alone else parts[0] * parts[1]
    spread = both.repartition(groups, "a", "h").groupBy("a", "h")
    return spread.applyInArrow(compare, f"asked_id {kind(asked, 'asked_id')}, held_id {kind(sides[-1], names[len(sides) - 1])}, score double")


def similar_bills(vectors: DataFrame, k: int, least: float, block_rows: int | None = None) -> DataFrame:
    """The k nearest bills of other jurisdictions of every bill above a score, by exact comparison in blocks.

    Every bill is asked for, so the comparison is quadratic by definition; similar_bills_lsh
    scores only what an index leaves. Bills without a jurisdiction are not known to be of another.
    """
    rows = unit(vectors.where("bill_id is not null and jurisdiction_id is not null")).select(F.col("bill_id").alias("asked_id"), "jurisdiction_id", "unit")
    found = _nearest_in_blocks(rows, None, k, least, "jurisdiction_id", block_rows)
    pairs = found.select(F.col("asked_id").alias("bill_id"), F.col("held_id").alias("similar_id"), "score")
    return top_per_group(pairs, ["bill_id"], [F.round("score", 9).desc(), "similar_id"], k, rank="rank")


def similar_bills_lsh(vectors: DataFrame, k: int, least: float, recall: float = 0.95) -> DataFrame:
    """As similar_bills, from a neighbour index fitted to find at least the given share of them; scores are exact."""
    rows = unit(vectors.where("bill_id is not null and jurisdiction_id is not null")).select("bill_id", F.col("jurisdiction_id").alias("kind"), "unit")
    index = fit_index(rows, k, least, recall)
    found = nearest_in_cells(index, rows, rows, k, least).where("held_id is not null")
    pairs = found.select(F.col("asked_id").alias("bill_id"), F.col("held_id").alias("similar_id"), "score")
    return top_per_group(pairs, ["bill_id"], [F.round("score", 9).desc(), "similar_id"], k, rank="rank")


def similar(vectors: DataFrame, k: int, least: float, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """similar_bills up to exact_rows vectors, and by the neighbour index beyond them."""
    return (similar_bills if vectors.count() <= exact_rows else similar_bills_lsh)(vectors, k, least)


def symmetric(pairs: DataFrame) -> DataFrame:
    """Pairs from both of their ends."""
    back = pairs.select(F.col("bill_id_b").alias("bill_id_a"), F.col("bill_id_a").alias("bill_id_b"), "similarity_score")
    return pairs.select("bill_id_a", "bill_id_b", "similarity_score").union(back)


def with_fallback(found: DataFrame, bills: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """found, and for bills without any the best stored pairs."""
    lacking = bills.select("bill_id").join(found.select("bill_id").distinct(), "bill_id", "left_anti")
    stored = symmetric(pairs).select(F.col("bill_id_a").alias("bill_id"), F.col("bill_id_b").alias("similar_id"), F.col("similarity_score").alias("score"))
    best = top_per_group(stored.join(lacking, "bill_id", "left_semi").groupBy("bill_id", "similar_id").agg(F.max("score").alias("score")), ["bill_id"], [F.desc("score"), "similar_id"], k, rank="rank")
    return found.select("bill_id", "similar_id", "score", "rank").unionByName(best)


def rrf_fuse(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank)."""
    every = lists[0].select("query_id", "id", "rank")
    for one in lists[1:]:
        every = every.unionByName(one.select("query_id", "id", "rank"))
    fused = every.groupBy("query_id", "id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"))
    return top_per_group(fused, ["query_id"], [F.round("score", 12).desc(), "id"], k, rank="rank")


def rerank(rows: DataFrame) -> DataFrame:
    """Ranks without gaps after a filter."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def hybrid_search(documents: DataFrame, vectors: DataFrame, text_queries: DataFrame, vector_queries: DataFrame, k: int, jurisdictions: list[str] | None = None) -> DataFrame:
    """2k candidates of either kind, the keyword list filtered after its cut, fused per query if both lists exist."""
    words = bm25(documents, text_queries, 2 * k)
    if jurisdictions is not None:
        allowed = documents.where(F.col("jurisdiction_id").isin(*jurisdictions)).select("id")
        words = rerank(words.join(allowed, "id", "left_semi"))
        vectors = vectors.where(F.col("jurisdiction_id").isin(*jurisdictions))
    near = vector_search(vectors, vector_queries, 2 * k)
    return rrf_fuse([words, near], k)


def diffusion(similar: DataFrame, bills: DataFrame) -> DataFrame:
    """Per bill: its similar bills elsewhere, number of jurisdictions, first and last date."""
    dated = bills.select(F.col("id").alias("similar_id"), "jurisdiction_id", "introduced_date")
    return similar.join(dated, "similar_id").groupBy("bill_id").agg(
        F.count("*").alias("bills"), F.count_distinct("jurisdiction_id").alias("jurisdictions"), F.min("introduced_date").alias("first_date"), F.max("introduced_date").alias("last_date")
    )


def context_pack(rows: DataFrame, key: str, order: list[str], text: Column, header: str, chars: int) -> DataFrame:
    """One prompt context per key: a header and the first characters of each text, in order."""
    part = F.substring(text, 1, chars).alias("part")
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, part))).alias("parts"))
    return lists.select(key, F.concat(F.lit(header), F.array_join(F.transform("parts", lambda p: p["part"]), "\n---\n")).alias("context"))

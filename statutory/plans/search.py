"""Search, similarity and diffusion over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.functions.text import content_hash, contains_folded
from statutory.operators import search as S
from statutory.operators.postings import PostingsIndex
from statutory.operators.sinks import shared_folder
from statutory.plans.registry import query
from statutory.plans.views import Tables

_FIRST = "(SELECT bill_id, substr(arg_min(content_text, struct_pack(a := version_date, b := id)), 1, 5000) AS text FROM v_bill_texts WHERE coalesce(content_text, '') <> '' GROUP BY 1)"
_DOCS = f"docs AS (SELECT b.id, b.jurisdiction_id, b.title || coalesce(' ' || x.text, '') AS document FROM v_bills b LEFT JOIN {_FIRST} x ON x.bill_id = b.id)"
_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_INDEX = _DOCS + f""",
words AS (SELECT id, list_filter(regexp_extract_all(lower(document), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w FROM docs),
postings AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM words) x GROUP BY 1, 2),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_length FROM words)"""
_QUERIES = "q AS (SELECT 'q' || n_nationkey AS query_id, CASE n_nationkey % 3 WHEN 0 THEN 'Machinery HIGH' WHEN 1 THEN 'automobile not specified' ELSE 'furniture the and' END AS query FROM nation)"


def _queries(t: Tables) -> DataFrame:
    k = F.col("n_nationkey") % 3
    text = F.when(k == 0, "Machinery HIGH").when(k == 1, "automobile not specified").otherwise("furniture the and")
    return t.nation.select(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("query_id"), text.alias("query"))


def _vector_queries(t: Tables) -> DataFrame:
    """Every twentieth vector asks."""
    asked = t.bill_embeddings.where(F.col("bill_id").cast("long") % 20 == 0)
    return asked.select(F.concat(F.lit("q"), (F.col("bill_id").cast("long") / 20).cast("long").cast("string")).alias("query_id"), "embedding")


_BM25 = _INDEX + f""", {_QUERIES},
scores AS (SELECT query_id, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words.w) / mean_length))) AS score
  FROM q JOIN postings p ON list_contains(string_split(regexp_replace(lower(query), '\\bnot\\b|\\bthe\\b|\\band\\b', '', 'g'), ' '), p.term) JOIN freq USING (term) JOIN words USING (id), stats GROUP BY 1, 2)"""


@query("search_corpus", f"WITH {_DOCS} SELECT * FROM docs")
def search_corpus(t: Tables) -> DataFrame:
    return S.corpus(t.bills, t.bill_texts)


@query("inverted_index", f"WITH {_INDEX} SELECT p.term, p.id, p.tf, f.df, len(w.w) AS doc_length FROM postings p JOIN freq f ON f.term = p.term JOIN words w ON w.id = p.id")
def inverted_index(t: Tables) -> DataFrame:
    return S.inverted_index(S.corpus(t.bills, t.bill_texts))


@query("bm25_search", f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM scores) x WHERE n <= 50")
def bm25_search(t: Tables) -> DataFrame:
    return S.bm25(S.corpus(t.bills, t.bill_texts), _queries(t), 50).select("query_id", "id", F.round("score", 6).alias("score"))


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, id, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM scores WHERE score > 0) x WHERE n <= 5")
def bm25_topk(t: Tables) -> DataFrame:
    return S.bm25(S.corpus(t.bills, t.bill_texts), _queries(t), 5).select("query_id", "id", "rank")


def _index(t: Tables) -> PostingsIndex:
    """An index of all bills, in two batches: the earlier half of the jurisdictions first."""
    documents = S.corpus(t.bills, t.bill_texts)
    index = PostingsIndex(t.spark, shared_folder(t.spark))
    early = F.coalesce(F.col("jurisdiction_id") < "j2", F.lit(False))
    index.append(documents.where(early), 1)
    index.append(documents.where(~early), 2)
    return index


@query("bm25_index", f"WITH {_BM25} SELECT query_id, id, CAST(n AS INT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM scores) x WHERE n <= 50")
def bm25_index(t: Tables) -> DataFrame:
    """bm25_search from a kept index, of which only the terms' buckets are read."""
    return _index(t).search(_queries(t), 50).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("keyword_fallback", "SELECT id, 1.0 AS score FROM v_bills WHERE jurisdiction_id = 'j1' AND contains(lower(title), 'build') ORDER BY id LIMIT 100")
def keyword_fallback(t: Tables) -> DataFrame:
    found = t.bills.where("jurisdiction_id = 'j1'").where(contains_folded("title", "BUILD"))
    return found.select("id", F.lit(1.0).alias("score")).orderBy("id").limit(100)


_UNIT = "u AS (SELECT bill_id, jurisdiction_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM v_bill_embeddings) z)"
_NEAR = _UNIT + ", near AS (SELECT 'q' || CAST(CAST(a.bill_id AS BIGINT) // 20 AS VARCHAR) AS query_id, b.bill_id AS id, list_inner_product(a.u, b.u) AS score FROM u a, u b WHERE CAST(a.bill_id AS BIGINT) % 20 = 0)"


@query("vector_search", f"WITH {_NEAR} SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM near) x WHERE n <= 10")
def vector_search(t: Tables) -> DataFrame:
    found = S.vector_search(t.bill_embeddings.select("bill_id", "embedding"), _vector_queries(t), 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


_SIMILAR = _UNIT + ", sim AS (SELECT a.bill_id, b.bill_id AS similar_id, list_inner_product(a.u, b.u) AS score FROM u a JOIN u b ON a.bill_id <> b.bill_id AND a.jurisdiction_id <> b.jurisdiction_id), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY round(score, 9) DESC, similar_id) AS n FROM sim WHERE score > 0.25) x WHERE n <= 5)"


def _similar(t: Tables) -> DataFrame:
    return S.similar_bills(t.bill_embeddings, 5, 0.25)


@query("similar_bills", f"WITH {_SIMILAR} SELECT bill_id, similar_id, round(score, 6) AS score FROM best")
def similar_bills(t: Tables) -> DataFrame:
    return _similar(t).select("bill_id", "similar_id", F.round("score", 6).alias("score"))


@query("similar_lsh")
def similar_lsh(t: Tables) -> DataFrame:
    """The same from the neighbour index."""
    return S.similar_bills_lsh(t.bill_embeddings, 5, 0.25)


_PAIRS = "(SELECT bill_id_a AS a, bill_id_b AS b, similarity_score AS s FROM v_bill_similarities UNION ALL SELECT bill_id_b, bill_id_a, similarity_score FROM v_bill_similarities)"


@query("similar_symmetric", f"SELECT a AS bill_id, count(*) AS n, max(s) AS best FROM {_PAIRS} p GROUP BY 1")
def similar_symmetric(t: Tables) -> DataFrame:
    return S.symmetric(t.bill_similarities).groupBy(F.col("bill_id_a").alias("bill_id")).agg(F.count("*").alias("n"), F.max("similarity_score").alias("best"))


@query("similar_fallback", f"WITH {_SIMILAR}, lack AS (SELECT DISTINCT bill_id FROM v_bill_embeddings WHERE bill_id NOT IN (SELECT bill_id FROM best)), st AS (SELECT a AS bill_id, b AS similar_id, max(s) AS score FROM {_PAIRS} p WHERE a IN (SELECT bill_id FROM lack) GROUP BY 1, 2) SELECT bill_id, similar_id, round(score, 6) AS score FROM best UNION ALL SELECT bill_id, similar_id, round(score, 6) FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY score DESC, similar_id) AS n FROM st) x WHERE n <= 5")
def similar_fallback(t: Tables) -> DataFrame:
    found = S.with_fallback(_similar(t), t.bill_embeddings.select("bill_id"), t.bill_similarities, 5)
    return found.select("bill_id", "similar_id", F.round("score", 6).alias("score"))


@query("rrf_fuse", "WITH a AS (SELECT chamber AS query_id, id, row_number() OVER (PARTITION BY chamber ORDER BY yes_count DESC NULLS LAST, id) AS rank FROM v_vote_events), b AS (SELECT chamber AS query_id, id, row_number() OVER (PARTITION BY chamber ORDER BY no_count DESC NULLS LAST, id) AS rank FROM v_vote_events), f AS (SELECT query_id, id, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x GROUP BY 1, 2) SELECT query_id, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS n FROM f) y WHERE n <= 100")
def rrf_fuse(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    ranked = lambda c: t.vote_events.select(F.col("chamber").alias("query_id"), "id", F.row_number().over(Window.partitionBy("chamber").orderBy(F.desc_nulls_last(c), "id")).alias("rank"))
    return S.rrf_fuse([ranked("yes_count"), ranked("no_count")], 100).select("query_id", "id", F.round("score", 9).alias("score"))


@query("hybrid_search", f"""WITH {_BM25}, {_NEAR},
kw AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM scores) x WHERE n <= 20 AND id IN (SELECT id FROM docs WHERE jurisdiction_id IN ('j1', 'j2', 'j3', 'j5', 'j8'))),
nr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM near WHERE id IN (SELECT bill_id FROM v_bill_embeddings WHERE jurisdiction_id IN ('j1', 'j2', 'j3', 'j5', 'j8'))),
f AS (SELECT query_id, id, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM nr WHERE rank <= 20) x GROUP BY 1, 2)
SELECT query_id, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS n FROM f) y WHERE n <= 10""")
def hybrid_search(t: Tables) -> DataFrame:
    found = S.hybrid_search(S.corpus(t.bills, t.bill_texts), t.bill_embeddings, _queries(t), _vector_queries(t), 10, ["j1", "j2", "j3", "j5", "j8"])
    return found.select("query_id", "id", F.round("score", 9).alias("score"))


@query("ranked_lookup", f"WITH {_BM25} SELECT query_id, CAST(n AS INT) AS rank, x.id, b.title FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM scores) x JOIN v_bills b ON b.id = x.id WHERE n <= 10")
def ranked_lookup(t: Tables) -> DataFrame:
    found = S.bm25(S.corpus(t.bills, t.bill_texts), _queries(t), 10).select("query_id", "rank", "id")
    return found.join(t.bills.select("id", "title"), "id").select("query_id", "rank", "id", "title")


@query("embed_pending", f"WITH {_DOCS} SELECT d.id, sha256(d.document) AS content_hash FROM docs d WHERE d.id NOT IN (SELECT bill_id FROM v_bill_embeddings)")
def embed_pending(t: Tables) -> DataFrame:
    known = t.bill_embeddings.select(F.col("bill_id").alias("id"))
    return S.corpus(t.bills, t.bill_texts).join(known, "id", "left_anti").select("id", content_hash("document").alias("content_hash"))


@query("diffusion", f"WITH {_SIMILAR} SELECT best.bill_id, count(*) AS bills, count(DISTINCT b.jurisdiction_id) AS jurisdictions, min(b.introduced_date) AS first_date, max(b.introduced_date) AS last_date FROM best JOIN v_bills b ON b.id = best.similar_id GROUP BY 1")
def diffusion(t: Tables) -> DataFrame:
    return S.diffusion(_similar(t), t.bills)


@query("context_pack", "SELECT bill_id, 'Versions:' || chr(10) || string_agg(substr(content_text, 1, 300), chr(10) || '---' || chr(10) ORDER BY version_date, id) AS context FROM v_bill_texts GROUP BY 1")
def context_pack(t: Tables) -> DataFrame:
    return S.context_pack(t.bill_texts, "bill_id", ["version_date", "id"], F.col("content_text"), "Versions:\n", 300)

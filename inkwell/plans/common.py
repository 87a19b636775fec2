"""Inputs that several queries share, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.postings import PostingsIndex
from ..sources.store import shared_dir
from ..sources.tables import load

TOKENS_SQL = r"regexp_extract_all({0}, '[一-鿿]+|[a-zA-Z0-9_.\-/^²³₀-₉]+|[+\-*/=()\[\]{{}}]')"


def tok(c: str) -> str:
    return TOKENS_SQL.format(c)


def corpus(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def stored_bm25(spark, d, queries, top_k=None):
    """BM25+ of queries over the corpus' stored index, which the first search after the documents were written makes."""
    index = PostingsIndex.of(spark, f"{shared_dir(spark)}/postings/v1", f"{d}/documents.parquet", corpus(spark, d))
    return R.bm25_stored(index, queries, top_k)


def questions(spark, d):
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")


def vector_queries(spark, d):
    return load(spark, d, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))


def question_vectors(spark, d):
    """A benchmark item's vector is that of the row of its number."""
    return load(spark, d, "embeddings").join(questions(spark, d), F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("q"))


BM25_SQL = f"""
tk AS (SELECT doc_id, unnest({tok('text')}) AS term FROM documents),
dl AS (SELECT doc_id, len({tok('text')}) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT term, doc_id, count(*) AS tf FROM tk GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY ALL),
q AS (SELECT query_id, qt.term, qf, ln((n + 1) / df) AS idf, avgdl FROM qt JOIN df USING (term), st),
qb AS (SELECT query_id, sum(idf * qf) AS base FROM q GROUP BY ALL),
sc AS (SELECT query_id, tf.doc_id AS chunk_id, round(any_value(base) + sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM q JOIN tf USING (term) JOIN dl USING (doc_id) JOIN qb USING (query_id) GROUP BY query_id, tf.doc_id),
lx AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)
"""

_DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def cos_sql(a: str, b: str) -> str:
    return f"round({_DOT.format(a, b)} / (sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)})), 6)"


#: The vector list of each question, over all vectors.
VECTOR_SQL = f"""
vs AS (SELECT b.item_id AS query_id, r.vec_id AS chunk_id, {cos_sql('r.embedding', 'e.embedding')} AS score
       FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id, embeddings r),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs)
"""
HYBRID_SQL = f"""
{BM25_SQL}, {VECTOR_SQL},
l8 AS (SELECT * FROM lx WHERE rank <= 8), v8 AS (SELECT * FROM vr WHERE rank <= 8),
fu AS (SELECT coalesce(l8.query_id, v8.query_id) AS query_id, coalesce(l8.chunk_id, v8.chunk_id) AS chunk_id, l8.rank AS l_rank, v8.rank AS v_rank,
              l8.score AS l_score, v8.score AS v_score, round(coalesce(1.0 / (60 + l8.rank), 0) + coalesce(1.0 / (60 + v8.rank), 0), 9) AS rrf,
              concat_ws('+', CASE WHEN l8.rank IS NOT NULL THEN 'bm25' END, CASE WHEN v8.rank IS NOT NULL THEN 'vector' END) AS origins
       FROM l8 FULL JOIN v8 ON l8.query_id = v8.query_id AND l8.chunk_id = v8.chunk_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, l_rank NULLS LAST, v_rank NULLS LAST, chunk_id) AS rank FROM fu)
"""

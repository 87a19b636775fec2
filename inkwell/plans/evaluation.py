"""Queries of retrieval and answer evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import retrieval as R
from ..registry import query
from ..sources.tables import load
from .common import BM25_SQL, corpus, cos_sql, questions, stored_bm25, vector_queries, vectors

# Single-relevant run: the label of each near vector, the query's own label expected.
_RUN = f"""run AS (SELECT query_id AS question_id, label AS document_id, rank, q_label FROM (
 SELECT q.vec_id AS query_id, q.label AS q_label, r.vec_id AS chunk_id, r.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {cos_sql('r.embedding', 'q.embedding')} DESC, r.vec_id) AS rank
 FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0) WHERE rank BETWEEN 2 AND 9)"""
_SINGLE = f"""{_RUN}, per AS (SELECT question_id, coalesce(min(CASE WHEN document_id = q_label THEN rank - 1 END), 0) AS first_rank,
 round(coalesce(1.0 / min(CASE WHEN document_id = q_label THEN rank - 1 END), 0), 4) AS rr, {', '.join(f"CAST(count(*) FILTER (document_id = q_label AND rank - 1 <= {k}) > 0 AS DOUBLE) AS recall_{k}, round(count(*) FILTER (document_id = q_label AND rank - 1 <= {k}) / {k}.0::DOUBLE, 4) AS precision_{k}" for k in (1, 3, 5))}
 FROM run GROUP BY question_id)"""


def _single(spark, d):
    """The eight nearest other vectors of every fiftieth; the vector itself is rank 1 and left out."""
    q = vector_queries(spark, d)
    near = R.vector_topk(vectors(spark, d), q, 9).filter("rank >= 2").join(vectors(spark, d).select("chunk_id", "label"), "chunk_id")
    runs = near.select(F.col("query_id").alias("question_id"), (F.col("rank") - 1).alias("rank"), F.col("label").alias("document_id"))
    return M.single_relevant(runs, q.select(F.col("query_id").alias("question_id"), F.col("q_label").alias("document_id")))


@query("recall_at_k", f"WITH {_SINGLE} SELECT question_id, recall_1, recall_3, recall_5 FROM per")
def recall_at_k(spark, d):
    return _single(spark, d).select("question_id", "recall_1", "recall_3", "recall_5")


@query("precision_at_k", f"WITH {_SINGLE} SELECT question_id, precision_1, precision_3, precision_5 FROM per")
def precision_at_k(spark, d):
    return _single(spark, d).select("question_id", "precision_1", "precision_3", "precision_5")


@query("mrr", f"WITH {_SINGLE} SELECT question_id, first_rank, rr FROM per")
def mrr(spark, d):
    return _single(spark, d).select("question_id", "first_rank", "rr")


_MEANS = ("recall_1", "recall_3", "recall_5", "precision_1", "precision_3", "precision_5", "rr")


@query("eval_summary", f"WITH {_SINGLE} SELECT count(*) AS n, {', '.join(f'round(coalesce(avg({c}), 0), 4) AS {c}' for c in _MEANS)} FROM per")
def eval_summary(spark, d):
    return M.means(_single(spark, d), _MEANS)


# Multi-relevant run: the best chunks of each passage, the documents that hold it expected.
_MULTI = f"""{BM25_SQL}, qr AS (SELECT item_id AS question_id, doc_id AS document_id FROM benchmark b JOIN documents c ON contains(c.text, b.text)),
ne AS (SELECT question_id, count(DISTINCT document_id) AS n_expected FROM qr GROUP BY ALL),
fo AS (SELECT l.query_id AS question_id, l.chunk_id AS document_id, l.rank FROM lx l JOIN qr ON qr.question_id = l.query_id AND qr.document_id = l.chunk_id WHERE l.rank <= 10),
per AS (SELECT question_id, n_expected, coalesce(min(rank), 0) AS first_rank, round(coalesce(1.0 / min(rank), 0), 4) AS rr,
 {', '.join(f"round(count(DISTINCT CASE WHEN rank <= {k} THEN document_id END)::DOUBLE / n_expected, 4) AS coverage_{k}, CAST(count(DISTINCT CASE WHEN rank <= {k} THEN document_id END) = n_expected AS DOUBLE) AS all_docs_{k}" for k in (3, 5))}
 FROM ne LEFT JOIN fo USING (question_id) GROUP BY question_id, n_expected)"""


def _multi(spark, d):
    q = questions(spark, d)
    runs = stored_bm25(spark, d, q, 10).select(F.col("query_id").alias("question_id"), F.col("chunk_id").alias("document_id"), "rank")
    holds = R.holding(load(spark, d, "documents").select("doc_id", "text"), q.withColumnRenamed("text", "passage"))
    return M.multi_relevant(runs, holds.select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("document_id")))


@query("doc_coverage", f"WITH {_MULTI} SELECT question_id, coverage_3, coverage_5 FROM per")
def doc_coverage(spark, d):
    return _multi(spark, d).select("question_id", "coverage_3", "coverage_5")


@query("all_docs", f"WITH {_MULTI} SELECT question_id, n_expected, all_docs_3, all_docs_5 FROM per")
def all_docs(spark, d):
    return _multi(spark, d).select("question_id", "n_expected", "all_docs_3", "all_docs_5")


@query("mrr_any", f"WITH {_MULTI} SELECT question_id, first_rank, rr FROM per")
def mrr_any(spark, d):
    return _multi(spark, d).select("question_id", "first_rank", "rr")


_REL = ("coverage_3", "coverage_5", "all_docs_3", "all_docs_5", "rr")


@query("relational_summary", f"WITH {_MULTI} SELECT count(*) AS n, {', '.join(f'round(coalesce(avg({c}), 0), 4) AS {c}' for c in _REL)} FROM per")
def relational_summary(spark, d):
    return M.means(_multi(spark, d), _REL)


@query("doc_ranking", f"WITH {BM25_SQL}, f AS (SELECT query_id, source, min(rank) AS first FROM lx JOIN documents ON doc_id = chunk_id WHERE rank <= 10 GROUP BY ALL) SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM f")
def doc_ranking(spark, d):
    """Sources of a run in order of first occurrence."""
    src = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    first = stored_bm25(spark, d, questions(spark, d), 10).join(src, "chunk_id").groupBy("query_id", "source").agg(F.min("rank").alias("first"))
    return first.select("query_id", "source", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).alias("place"))


# Graded answers: score 0, 1 or 2 of a labelled document, null without a label; hit: the source is even.
_GRADES = "g AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS score, d.n_chars % 2 = 0 AS hit FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def _grades(spark, d):
    docs, labels = load(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2 == 0).alias("hit")), load(spark, d, "labels")
    score = F.when(F.col("quality").isNull(), None).when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return docs.join(labels, "doc_id", "left").select("doc_id", score.alias("score"), "hit")


@query("groundedness", f"WITH {_GRADES} SELECT count(score) AS n, count(*) FILTER (score = 0) AS n0, count(*) FILTER (score = 1) AS n1, count(*) FILTER (score = 2) AS n2, round(avg(score), 4) AS mean_score, round(avg(CASE WHEN score IS NOT NULL THEN CAST(score = 2 AS DOUBLE) END), 4) AS fully, round(avg(CASE WHEN score IS NOT NULL THEN CAST(score >= 1 AS DOUBLE) END), 4) AS grounded FROM g")
def groundedness(spark, d):
    s = F.col("score")
    return _grades(spark, d).agg(F.count("score").alias("n"), *[F.count_if(s == k).alias(f"n{k}") for k in (0, 1, 2)], F.round(F.avg("score"), 4).alias("mean_score"), M.share(s == 2).alias("fully"), M.share(s >= 1).alias("grounded"))


@query("groundedness_cross", f"WITH {_GRADES}, b AS (SELECT * FROM (VALUES (true), (false)) t(hit)) SELECT b.hit, count(score) AS n, round(coalesce(avg(score), 0), 4) AS mean_score, round(coalesce(avg(CAST(score >= 1 AS DOUBLE)), 0), 4) AS grounded FROM b LEFT JOIN (SELECT * FROM g WHERE score IS NOT NULL) g ON g.hit = b.hit GROUP BY b.hit")
def groundedness_cross(spark, d):
    """Both buckets stand, even if one is empty."""
    buckets = spark.createDataFrame([(True,), (False,)], "hit boolean")
    g = _grades(spark, d).filter("score is not null")
    return buckets.join(g, "hit", "left").groupBy("hit").agg(F.count("score").alias("n"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("mean_score"), F.coalesce(M.share(F.col("score") >= 1), F.lit(0.0)).alias("grounded"))


# Claims: turns of a conversation, the verdict by length.
_CLAIMS = "c AS (SELECT conv_id, turn, role, CASE length(text) % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'partial' WHEN 2 THEN 'unsupported' ELSE 'unclear' END AS verdict FROM conversations), cl AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c WHERE role = 'assistant'), f AS (SELECT v.conv_id, avg(CASE verdict WHEN 'supported' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) FILTER (k IS NOT NULL) AS faithfulness FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN (SELECT * FROM cl WHERE k <= 8) cl USING (conv_id) GROUP BY v.conv_id)"


def _faithfulness(spark, d):
    c = load(spark, d, "conversations")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    claims = c.filter("role = 'assistant'").withColumn("k", k).filter("k <= 8")
    r = F.length("text") % 4
    weight = F.when(r == 0, 1.0).when(r == 1, 0.5).otherwise(0.0)
    return c.select("conv_id").distinct().join(claims.select("conv_id", weight.alias("w")), "conv_id", "left").groupBy("conv_id").agg(F.avg("w").alias("faithfulness"))


@query("faithfulness", f"WITH {_CLAIMS} SELECT conv_id, round(faithfulness, 4) AS faithfulness FROM f")
def faithfulness(spark, d):
    """Supported claims count 1, partly supported 0.5; null without claims."""
    return _faithfulness(spark, d).select("conv_id", F.round("faithfulness", 4).alias("faithfulness"))


@query("faithfulness_summary", f"WITH {_CLAIMS} SELECT conv_id % 2 = 0 AS hit, count(faithfulness) AS n, round(avg(faithfulness), 4) AS mean_f, round(avg(CAST(faithfulness >= 0.9 AS DOUBLE)), 4) AS high, round(avg(CAST(faithfulness >= 0.7 AS DOUBLE)), 4) AS fair, count(*) FILTER (faithfulness < 0.7) AS n_low FROM f GROUP BY ALL")
def faithfulness_summary(spark, d):
    f = F.col("faithfulness")
    return _faithfulness(spark, d).groupBy((F.col("conv_id") % 2 == 0).alias("hit")).agg(F.count(f).alias("n"), F.round(F.avg(f), 4).alias("mean_f"), M.share(f >= 0.9).alias("high"), M.share(f >= 0.7).alias("fair"), F.count_if(f < 0.7).alias("n_low"))


@query("ab_summary", "SELECT CASE WHEN event_id % 2 = 0 THEN 'off' ELSE 'on' END AS path, count(*) AS n, round(avg(CAST(value > 50 AS DOUBLE)), 4) AS accuracy, round(avg(least(value, 100) / 100), 4) AS faithfulness, count(*) FILTER (event_type = 'error') AS n_errors, count(DISTINCT event_type) AS n_reasons FROM events GROUP BY ALL")
def ab_summary(spark, d):
    e = load(spark, d, "events")
    v = F.col("value")
    return e.groupBy(F.when(F.col("event_id") % 2 == 0, "off").otherwise("on").alias("path")).agg(F.count(F.lit(1)).alias("n"), M.share(v > 50).alias("accuracy"), F.round(F.avg(F.least(v, F.lit(100)) / 100), 4).alias("faithfulness"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.countDistinct("event_type").alias("n_reasons"))


_REACT = f"""{_MULTI}, k AS (SELECT n.question_id, n.n_expected, count(DISTINCT CASE WHEN rank <= 1 THEN document_id END) AS single, count(DISTINCT CASE WHEN rank <= 5 THEN document_id END) AS agent FROM ne n LEFT JOIN fo USING (question_id) GROUP BY ALL)"""


@query("react_summary", f"WITH {_REACT} SELECT count(*) AS n, round(avg(CAST(agent = n_expected AS DOUBLE)), 4) AS closure, CAST(sum(greatest(agent - single, 0)) AS BIGINT) AS recovered, CAST(sum(n_expected - agent) AS BIGINT) AS residual FROM k")
def react_summary(spark, d):
    """A first answer against five: what is closed, recovered and left over."""
    q = questions(spark, d)
    runs = stored_bm25(spark, d, q, 10).select(F.col("query_id").alias("question_id"), F.col("chunk_id").alias("document_id"), "rank")
    holds = R.holding(load(spark, d, "documents").select("doc_id", "text"), q.withColumnRenamed("text", "passage")).select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("document_id"))
    j = holds.join(runs, ["question_id", "document_id"], "left")
    per = j.groupBy("question_id").agg(F.countDistinct("document_id").alias("e"), F.countDistinct(F.when(F.col("rank") <= 1, F.col("document_id"))).alias("s"), F.countDistinct(F.when(F.col("rank") <= 5, F.col("document_id"))).alias("a"))
    return per.agg(F.count(F.lit(1)).alias("n"), M.share(F.col("a") == F.col("e")).alias("closure"), F.sum(F.greatest(F.col("a") - F.col("s"), F.lit(0))).alias("recovered"), F.sum(F.col("e") - F.col("a")).alias("residual"))


_GRID = "(VALUES (20), (40), (60), (80)) g(rrf_k)"


@query("sensitivity", f"""WITH {BM25_SQL}, s AS (SELECT g.rrf_k, query_id, sum(1.0::DOUBLE / (g.rrf_k + rank)) AS total FROM lx, {_GRID} WHERE rank <= 8 GROUP BY ALL), m AS (SELECT rrf_k, round(avg(total), 6) AS mean_total FROM s GROUP BY ALL)
SELECT rrf_k::BIGINT AS rrf_k, mean_total, round(mean_total - (SELECT mean_total FROM m WHERE rrf_k = 60), 6) AS delta, mean_total = (SELECT max(mean_total) FROM m) AS best FROM m""")
def sensitivity(spark, d):
    """A parameter grid beside the runs: mean, change against the current value, best."""
    grid = spark.createDataFrame([(20,), (40,), (60,), (80,)], "rrf_k long")
    runs = stored_bm25(spark, d, questions(spark, d), 8).crossJoin(F.broadcast(grid))
    per = runs.groupBy("rrf_k", "query_id").agg(F.sum(1.0 / (F.col("rrf_k") + F.col("rank"))).alias("total"))
    m = per.groupBy("rrf_k").agg(F.round(F.avg("total"), 6).alias("mean_total"))
    w = Window.partitionBy(F.lit(1))
    return m.select("rrf_k", "mean_total", F.round(F.col("mean_total") - F.max(F.when(F.col("rrf_k") == 60, F.col("mean_total"))).over(w), 6).alias("delta"), (F.col("mean_total") == F.max("mean_total").over(w)).alias("best"))


@query("variant_delta", "WITH s AS (SELECT event_type, year(ts) * 100 + month(ts) AS ym, round(avg(value), 4) AS m FROM events GROUP BY ALL), f AS (SELECT event_type, min_by(m, ym) AS before, max_by(m, ym) AS after FROM s GROUP BY ALL) SELECT event_type, before, after, round(after - before, 4) AS delta FROM f")
def variant_delta(spark, d):
    """First and last summary of each variant, side by side."""
    s = load(spark, d, "events").groupBy("event_type", (F.year("ts") * 100 + F.month("ts")).alias("ym")).agg(F.round(F.avg("value"), 4).alias("m"))
    f = s.groupBy("event_type").agg(F.min_by("m", "ym").alias("before"), F.max_by("m", "ym").alias("after"))
    return f.select("event_type", "before", "after", F.round(F.col("after") - F.col("before"), 4).alias("delta"))


@query("latency_stats", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), l AS (SELECT event_type, list_sort(list(value)) AS v FROM r WHERE k <= 500 GROUP BY event_type) SELECT event_type, len(v) AS n, round(list_avg(v), 4) AS mean_v, v[least(len(v), CAST(floor(len(v) * 0.5) AS BIGINT) + 1)] AS p50, v[least(len(v), CAST(floor(len(v) * 0.95) AS BIGINT) + 1)] AS p95, v[1] AS min_v, v[len(v)] AS max_v FROM l")
def latency_stats(spark, d):
    """Over the last 500 samples of each name."""
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    last = load(spark, d, "events").withColumn("k", k).filter("k <= 500")
    return last.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean_v"), M.indexed_percentile("value", 0.5).alias("p50"), M.indexed_percentile("value", 0.95).alias("p95"), F.min("value").alias("min_v"), F.max("value").alias("max_v"))


@query("counters", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def counters(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("review_sheet", "SELECT d.doc_id, concat_ws(' | ', 'doc ' || d.doc_id, 'source ' || d.source, 'quality ' || l.quality, substr(replace(d.text, chr(10), ' '), 1, 160)) AS section FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def review_sheet(spark, d):
    j = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id")
    return j.select("doc_id", F.concat_ws(" | ", F.concat(F.lit("doc "), "doc_id"), F.concat(F.lit("source "), "source"), F.concat(F.lit("quality "), "quality"), F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 160)).alias("section"))

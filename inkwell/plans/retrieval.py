"""Queries of the retrieval algebra over documents, benchmark items and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.postings import PostingsIndex
from ..registry import query
from ..sources.store import shared_dir
from ..sources.tables import load
from .common import BM25_SQL, HYBRID_SQL, VECTOR_SQL, corpus, cos_sql, question_vectors, questions, stored_bm25, tok, vector_queries, vectors


@query("tokenize", f"SELECT doc_id, len({tok('text')}) AS n_tokens, md5(array_to_string({tok('text')}, ' ')) AS tokens_md5 FROM documents")
def tokenize(spark, d):
    t = T.tokenize(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query("query_tokens", f"SELECT item_id, array_to_string({tok('text')}, ' ') AS tokens FROM benchmark")
def query_tokens(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("tokens"))


@query("postings", f"SELECT term, doc_id AS chunk_id, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY ALL")
def postings(spark, d):
    return R.postings(corpus(spark, d))


_CHANGED = "SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN upper(text) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3 AND doc_id % 20 <> 14"


@query("postings_changed", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, (SELECT count(*) FROM ({_CHANGED})) AS n, (SELECT CAST(sum(len({tok('text')})) AS BIGINT) FROM ({_CHANGED})) AS tokens FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM ({_CHANGED})) GROUP BY term")
def postings_changed(spark, d):
    """Terms of an index after documents were replaced, taken out and merged, with the sizes that it keeps."""
    docs, at = corpus(spark, d), f"{shared_dir(spark)}/postings/changed-{uuid.uuid4().hex}"
    k = F.col("chunk_id")
    index = PostingsIndex.create(spark, at, docs)
    index.upsert(docs.filter(k % 10 == 4).withColumn("text", T.upper_each(F.col("text")))).delete(docs.filter(k % 10 == 3))
    index.merge().delete(docs.filter(k % 20 == 14))
    sizes = index.statistics().select("n", F.round(F.col("n") * F.col("avgdl")).cast("long").alias("tokens"))
    return index.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(sizes))  # one row


@query("term_df", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY ALL")
def term_df(spark, d):
    return R.postings(corpus(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, chunk_id, score, rank FROM lx WHERE rank <= 10")
def bm25_topk(spark, d):
    return stored_bm25(spark, d, questions(spark, d), 10)


@query("bm25_filtered", f"WITH {BM25_SQL} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lx JOIN documents ON doc_id = chunk_id WHERE rank <= 32 AND lang = 'en' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 8")
def bm25_filtered(spark, d):
    """The filter comes after a cut to four times k of the whole corpus."""
    pool = stored_bm25(spark, d, questions(spark, d), 32).drop("rank")
    english = load(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    return R.top(pool.join(english, "chunk_id", "left_semi").select("query_id", "chunk_id", "score"), 8)


_TOPK = f"SELECT q.vec_id AS query_id, r.vec_id AS chunk_id, {cos_sql('r.embedding', 'q.embedding')} AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0"


@query("vector_topk", f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({_TOPK}) QUALIFY rank <= 8")
def vector_topk(spark, d):
    return R.vector_topk(vectors(spark, d), vector_queries(spark, d), 8)


@query("vector_topk_legacy", f"SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({_TOPK})) WHERE rank <= 5")
def vector_topk_legacy(spark, d):
    return R.vector_topk(vectors(spark, d), vector_queries(spark, d), 5).select("query_id", "chunk_id")


@query("filtered_search", f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS chunk_id, {cos_sql('r.embedding', 'q.embedding')} AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND r.label IN (1, 3, 5)) QUALIFY rank <= 8")
def filtered_search(spark, d):
    """The filter goes to the scan, before anything is scored."""
    return R.vector_topk(vectors(spark, d).filter(F.col("label").isin(1, 3, 5)), vector_queries(spark, d), 8)


def _hybrid(spark, d):
    lexical = stored_bm25(spark, d, questions(spark, d), R.POOL)
    vector = R.vector_topk(vectors(spark, d), question_vectors(spark, d), R.POOL)
    return R.rrf(lexical, vector)


@query("rrf_fusion", f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, rrf, origins, rank FROM fr")
def rrf_fusion(spark, d):
    return _hybrid(spark, d).select("query_id", "chunk_id", "rrf", "origins", "rank")


@query("hybrid_search", f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, l_score, v_score, rrf, rank FROM fr WHERE rank <= 10")
def hybrid_search(spark, d):
    return _hybrid(spark, d).filter("rank <= 10").select("query_id", "chunk_id", "l_score", "v_score", "rrf", "rank")


#: Questions that reach the rules for ideographs take the place of some of the conversations': of each, what the rules give.
ASKED = (
    {"text": "Go 全局变量的可见性是什么", "terms": ("Go", "全局", "局变", "变量", "可见", "见性"), "phrases": 5, "anchors": 0, "more": " 可见性 公有 私有 大写 小写 包内 包外"},
    {"text": "请问张三丰的学号", "terms": ("请问", "问张", "张三", "三丰", "学号"), "phrases": 4, "anchors": 1, "more": ""},
    {"text": "标识符如何命名", "terms": ("标识", "识符", "符如", "何命", "命名"), "phrases": 3, "anchors": 0, "more": " 命名规则 名称 类型 变量"},
)


def _asked(spark, d):
    """The users' turns; of every seven conversations, three ask one of ASKED."""
    k = F.col("conv_id") % 7
    text = F.when(k == 0, ASKED[0]["text"]).when(k == 1, ASKED[1]["text"]).when(k == 2, ASKED[2]["text"]).otherwise(F.col("text"))
    return load(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", text.alias("text"))


def _asked_sql(member, other: str) -> str:
    return "CASE conv_id % 7 " + " ".join(f"WHEN {i} THEN {member(a)}" for i, a in enumerate(ASKED)) + f" ELSE {other} END"


_CONV_Q = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"


@query("expand_query_rules", f"""SELECT conv_id, turn, {_asked_sql(lambda a: f"'{a['text']}{a['more']}'", 'text')} AS expanded FROM ({_CONV_Q})""")
def expand_query_rules(spark, d):
    return _asked(spark, d).select("conv_id", "turn", T.expand_question(F.col("text")).alias("expanded"))


_TERMS = f"list_filter(list_distinct({tok('text')}), lambda t: length(t) >= 2)"
_TERM_LIST = _asked_sql(lambda a: str(list(a["terms"])), _TERMS)


@query("query_features", f"""SELECT conv_id, turn, len({_TERM_LIST}) AS n_terms, array_to_string(list_sort({_TERM_LIST}), ' ') AS terms, CAST({_asked_sql(lambda a: str(a['phrases']), '0')} AS BIGINT) AS n_phrases, CAST({_asked_sql(lambda a: str(a['anchors']), '0')} AS BIGINT) AS n_anchors FROM ({_CONV_Q})""")
def query_features(spark, d):
    c = F.col("text")
    terms = T.query_terms(c)
    return _asked(spark, d).select("conv_id", "turn", F.size(terms).cast("long").alias("n_terms"), F.array_join(F.array_sort(terms), " ").alias("terms"), F.size(T.query_phrases(c)).cast("long").alias("n_phrases"), F.size(T.query_anchors(c)).cast("long").alias("n_anchors"))


@query("lexical_hits", f"WITH {BM25_SQL} SELECT query_id, chunk_id, len(list_filter(list_filter(list_distinct({tok('b.text')}), lambda t: length(t) >= 2), lambda t: contains(c.text, t))) AS hits FROM lx JOIN benchmark b ON item_id = query_id JOIN documents c ON doc_id = chunk_id WHERE rank <= 10")
def lexical_hits(spark, d):
    pool = stored_bm25(spark, d, questions(spark, d), 10)
    q = questions(spark, d).select("query_id", F.col("text").alias("question"))
    return pool.join(corpus(spark, d), "chunk_id").join(q, "query_id").select("query_id", "chunk_id", F.size(F.filter(T.query_terms(F.col("question")), lambda t: F.instr(F.col("text"), t) > 0)).cast("long").alias("hits"))


_REL_SQL = f"""{HYBRID_SQL},
tot AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM fr),
ft AS (SELECT tot.*, b.text AS question, c.text AS content, c.source AS document_id, list_filter(list_distinct({tok('b.text')}), lambda t: length(t) >= 2) AS terms FROM tot JOIN benchmark b ON item_id = query_id JOIN documents c ON c.doc_id = chunk_id),
rl AS (SELECT *, round(round(greatest(0.0, least(0.95, 0.65 * greatest(0.0, least(1.0, (coalesce(v_score, -1.0) + 1) / 2)) + 0.25 * least(1.0, len(list_filter(terms, lambda t: contains(content, t)))::DOUBLE / greatest(1, len(terms))) + 0.10 * (1 - (rank - 1)::DOUBLE / greatest(1, total - 1)))), 9), 4) AS relevance FROM ft)
"""


def _relevance(spark, d):
    q = questions(spark, d).select("query_id", F.col("text").alias("question"))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("document_id"))
    return R.relevance(_hybrid(spark, d).join(docs, "chunk_id").join(q, "query_id"))


@query("relevance_rerank", f"WITH {_REL_SQL.replace('FROM tot JOIN', 'FROM (SELECT fr.*, count(*) OVER (PARTITION BY query_id) AS total FROM fr JOIN documents ON doc_id = chunk_id) tot JOIN')} SELECT query_id, chunk_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rrf DESC, chunk_id) AS place FROM rl")
def relevance_rerank(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), F.col("rrf").desc(), "chunk_id")
    return _relevance(spark, d).select("query_id", "chunk_id", "relevance", F.row_number().over(w).alias("place"))


_FED_SQL = _REL_SQL.replace("FROM tot JOIN", "FROM (SELECT fr.*, count(*) OVER (PARTITION BY query_id) AS total FROM fr JOIN documents ON doc_id = chunk_id) tot JOIN") + """,
dv AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY relevance DESC, rrf DESC, chunk_id) AS k FROM rl),
fd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rrf DESC, chunk_id) AS place FROM dv WHERE k <= 2 QUALIFY place <= 5)
"""


def _federated(spark, d, k=5):
    order = [F.col("relevance").desc(), F.col("rrf").desc(), F.col("chunk_id")]
    return R.diversify(_relevance(spark, d), k, 2, ("query_id",), "document_id", order)


@query("federated_search", f"WITH {_FED_SQL} SELECT query_id, place, chunk_id, document_id, relevance, origins FROM fd")
def federated_search(spark, d):
    return _federated(spark, d).select("query_id", "place", "chunk_id", "document_id", "relevance", "origins")


@query("diversity_topk", f"""WITH s AS ({_TOPK}), j AS (SELECT s.*, label FROM s JOIN embeddings ON vec_id = chunk_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, chunk_id) AS n FROM j)
SELECT query_id, chunk_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM k WHERE n <= 2 QUALIFY place <= 8""")
def diversity_topk(spark, d):
    q = vector_queries(spark, d)
    scored = R.scored(vectors(spark, d).withColumnRenamed("label", "group"), q, 8, cap=2).withColumnRenamed("group", "label")
    return R.diversify(scored, 8, 2, ("query_id",), "label").select("query_id", "chunk_id", "label", "score", "place")


@query("used_documents", f"WITH {_FED_SQL} SELECT query_id, document_id, min(place) AS first_place, max(relevance) AS best, count(*) AS n FROM fd GROUP BY ALL")
def used_documents(spark, d):
    return _federated(spark, d).groupBy("query_id", "document_id").agg(F.min("place").alias("first_place"), F.max("relevance").alias("best"), F.count(F.lit(1)).alias("n"))


@query("merge_queries", f"WITH {HYBRID_SQL} SELECT query_id // 4 AS topic, chunk_id, max(rrf) AS score, count(*) AS n FROM fr GROUP BY ALL")
def merge_queries(spark, d):
    hits = _hybrid(spark, d).withColumn("topic", F.floor(F.col("query_id") / 4).cast("long"))
    return hits.groupBy("topic", "chunk_id").agg(F.max("rrf").alias("score"), F.count(F.lit(1)).alias("n"))


@query("evidence_accumulate", f"WITH {HYBRID_SQL}, m AS (SELECT query_id // 4 AS topic, chunk_id, max(rrf) AS score FROM fr GROUP BY ALL) SELECT topic, chunk_id, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, chunk_id) AS place FROM m QUALIFY place <= 10")
def evidence_accumulate(spark, d):
    hits = _hybrid(spark, d).select(F.floor(F.col("query_id") / 4).cast("long").alias("topic"), "chunk_id", F.col("rrf").alias("score"))
    return R.top(R.merge_best(hits, ("topic", "chunk_id")), 10, by="topic").withColumnRenamed("rank", "place")


@query("near_dup_pairs", f"""WITH {BM25_SQL}, p AS (SELECT query_id, chunk_id, rank, regexp_replace(substr(text, 1, 800), '[ \\t\\n\\r\\v\\f]+', '', 'g') AS s FROM lx JOIN documents ON doc_id = chunk_id WHERE rank <= 10)
SELECT a.query_id, a.chunk_id AS kept_id, b.chunk_id AS dup_id FROM p a JOIN p b ON a.query_id = b.query_id AND a.rank < b.rank WHERE a.s <> '' AND b.s <> '' AND
least(length(a.s), length(b.s))::DOUBLE / greatest(length(a.s), length(b.s)) >= 0.9 AND CASE WHEN length(a.s) <= length(b.s) THEN contains(b.s, a.s) ELSE contains(a.s, b.s) END""")
def near_dup_pairs(spark, d):
    """Among the ten best of a query, one compact text within the other and nine tenths of its length."""
    pool = stored_bm25(spark, d, questions(spark, d), 10).join(corpus(spark, d), "chunk_id")
    p = pool.select("query_id", "chunk_id", "rank", F.regexp_replace(F.substring("text", 1, 800), r"[ \t\n\r\x0b\f]+", "").alias("s")).filter("s != ''")
    a, b = p.toDF("query_id", "kept_id", "ra", "sa"), p.toDF("query_id", "dup_id", "rb", "sb")
    la, lb = F.length("sa"), F.length("sb")
    inside = F.when(la <= lb, F.instr(F.col("sb"), F.col("sa")) > 0).otherwise(F.instr(F.col("sa"), F.col("sb")) > 0)
    return a.join(b, "query_id").filter((F.col("ra") < F.col("rb")) & (F.least(la, lb) / F.greatest(la, lb) >= 0.9) & inside).select("query_id", "kept_id", "dup_id")


_EST = "CASE WHEN coalesce(length({0}), 0) = 0 THEN 0 ELSE greatest(1, length(regexp_replace({0}, '[^一-鿿]', '', 'g')) + (length({0}) - length(regexp_replace({0}, '[^一-鿿]', '', 'g'))) // 4) END"


@query("estimate_tokens", f"SELECT doc_id, {_EST.format('text')} AS tokens FROM documents")
def estimate_tokens(spark, d):
    return load(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("evidence_budget", f"""WITH {BM25_SQL}, p AS (SELECT query_id, chunk_id, rank, {_EST.format('text')} AS tokens FROM lx JOIN documents ON doc_id = chunk_id WHERE rank <= 5),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM p) SELECT query_id, chunk_id, rank, tokens, CAST(used AS BIGINT) AS used FROM r WHERE rank = 1 OR used <= 600""")
def evidence_budget(spark, d):
    pool = stored_bm25(spark, d, questions(spark, d), 5).join(corpus(spark, d), "chunk_id")
    items = pool.select("query_id", "chunk_id", "rank", T.estimate_tokens(F.col("text")).alias("tokens"))
    return R.within_budget(items, 600)


@query("evidence_status", f"WITH {_FED_SQL} SELECT b.item_id AS query_id, CASE WHEN max(relevance) IS NULL THEN 'none' WHEN max(relevance) < 0.4 THEN 'weak' ELSE 'sufficient' END AS status FROM benchmark b LEFT JOIN fd ON fd.query_id = b.item_id GROUP BY b.item_id")
def evidence_status(spark, d):
    best = questions(spark, d).select("query_id").join(_federated(spark, d), "query_id", "left").groupBy("query_id").agg(F.max("relevance").alias("m"))
    return best.select("query_id", F.when(F.col("m").isNull(), "none").when(F.col("m") < 0.4, "weak").otherwise("sufficient").alias("status"))


@query("probe_escalate", f"WITH {BM25_SQL} SELECT item_id AS query_id, count(doc_id) AS n_hits, CASE WHEN count(doc_id) = 0 THEN 'all' ELSE 'selected' END AS scope FROM benchmark LEFT JOIN (SELECT query_id, doc_id FROM lx JOIN documents ON doc_id = chunk_id WHERE rank <= 8 AND source IN ('src1', 'src2', 'src3')) ON query_id = item_id GROUP BY item_id")
def probe_escalate(spark, d):
    """A selected scope without a hit gives way to all documents."""
    scope = load(spark, d, "documents").filter(F.col("source").isin("src1", "src2", "src3")).select(F.col("doc_id").alias("chunk_id"))
    found = stored_bm25(spark, d, questions(spark, d), 8).join(scope, "chunk_id", "left_semi")
    n = questions(spark, d).select("query_id").join(found, "query_id", "left").groupBy("query_id").agg(F.count("chunk_id").alias("n_hits"))
    return n.withColumn("scope", F.when(F.col("n_hits") == 0, "all").otherwise("selected"))


@query("parent_context", f"""WITH {_FED_SQL}, p AS (SELECT query_id, place, chunk_id, document_id, row_number() OVER (PARTITION BY query_id, document_id ORDER BY place) AS k, content FROM fd)
SELECT query_id, place, chunk_id, k = 1 AS with_parent, CASE WHEN k = 1 THEN length(substr(content, 1, 4000)) ELSE 0 END AS parent_chars FROM p""")
def parent_context(spark, d):
    """A parent's text goes with its first hit only, 4000 characters of it at most."""
    k = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("place"))
    p = _federated(spark, d).withColumn("k", k)
    return p.select("query_id", "place", "chunk_id", (F.col("k") == 1).alias("with_parent"), F.when(F.col("k") == 1, F.length(F.substring("content", 1, 4000))).otherwise(0).alias("parent_chars"))


@query("score_breakdown", f"""WITH {BM25_SQL}, {VECTOR_SQL} SELECT vs.query_id, vs.chunk_id, vs.score AS v_score, coalesce(sc.score, 0.0) AS l_score FROM vs LEFT JOIN sc ON sc.query_id = vs.query_id AND sc.chunk_id = vs.chunk_id""")
def score_breakdown(spark, d):
    """All scores of a question, without a cut: vector and lexical side by side."""
    q = question_vectors(spark, d)
    v = R.against(vectors(spark, d), q).select("query_id", "chunk_id", F.round(R.cosine("v", "q"), 6).alias("v_score"))
    lexical = stored_bm25(spark, d, questions(spark, d)).select("query_id", "chunk_id", F.col("score").alias("l"))
    return v.join(lexical, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "v_score", F.coalesce("l", F.lit(0.0)).alias("l_score"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents"


@query("parse_expansion", f"""WITH l AS ({_LINES}), c AS (SELECT doc_id, pos, trim(regexp_replace(trim(line, ' ' || chr(9)), '^[ \\t]*(?:[-*][ \\t]*|[0-9]+[.)][ \\t]*|子问题[0-9]*[ \\t]*[:：][ \\t]*)', ''), ' ' || chr(9)) AS item FROM l),
f AS (SELECT doc_id, item, min(pos) AS pos FROM c WHERE item <> '' AND item <> '无' AND length(item) <= 60 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM f) SELECT doc_id, k, item FROM r WHERE k <= 3""")
def parse_expansion(spark, d):
    """At most three distinct items of a list of lines, without bullets and numbers, of 60 characters at most."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")
    item = bare(F.regexp_replace(bare(F.col("line")), r"^[ \t]*(?:[-*][ \t]*|[0-9]+[.)][ \t]*|子问题[0-9]*[ \t]*[:：][ \t]*)", ""))
    items = lines.withColumn("item", item).filter("item != '' and item != '无' and length(item) <= 60").groupBy("doc_id", "item").agg(F.min("pos").alias("pos"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return items.withColumn("k", k).filter("k <= 3").select("doc_id", "k", "item")


_ANSWER = "SELECT a.conv_id, a.turn, a.text AS raw, u.text AS base FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'"


@query("rewrite_guard", f"WITH p AS ({_ANSWER}), s AS (SELECT *, trim(raw, ' ' || chr(10) || chr(9) || '\"`''') AS r FROM p) SELECT conv_id, turn, CASE WHEN r = '' OR length(r) > 3 * length(base) THEN base ELSE r END AS rewritten FROM s")
def rewrite_guard(spark, d):
    """A rewrite without quotes around it, or the question if it is empty or over three times as long."""
    c = load(spark, d, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("base"))
    p = c.filter("role = 'assistant'").join(u, ["conv_id", "turn"])
    r = F.regexp_replace("text", "^[ \n\t\"`']+|[ \n\t\"`']+\\z", "")
    return p.select("conv_id", "turn", F.when((r == "") | (F.length(r) > 3 * F.length("base")), F.col("base")).otherwise(r).alias("rewritten"))


@query("json_extract", "SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_extract(spark, d):
    """Members of the objects in props, as text."""
    m = F.from_json("props", "map<string,string>")
    return load(spark, d, "events").select("event_id", F.explode(m).alias("key", "value"))


@query("review_preview", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
p AS (SELECT doc_id, pos, substr(line, 1, 300) AS part FROM l WHERE trim(line) <> ''), c AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM p)
SELECT doc_id, string_agg(part, chr(10) ORDER BY pos) AS preview, count(*) AS n_blocks FROM c WHERE used <= 1500 GROUP BY doc_id""")
def review_preview(spark, d):
    """The first 300 characters of each block, as many blocks as stay within 1500."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter("trim(line) != ''")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p = lines.withColumn("part", F.substring("line", 1, 300)).withColumn("used", F.sum(F.length("part")).over(w)).filter("used <= 1500")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])
    return p.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("preview"), F.count(F.lit(1)).alias("n_blocks"))


@query("review_outcome", "SELECT doc_id, CASE WHEN l.doc_id % 11 = 0 THEN 'approved' WHEN quality = 0 OR toxic = 1 THEN 'rejected' ELSE 'pending' END AS status FROM labels l")
def review_outcome(spark, d):
    """An administrator's decision stands; else unapproved or unsafe content is rejected."""
    by_admin = F.col("doc_id") % 11 == 0
    return load(spark, d, "labels").select("doc_id", F.when(by_admin, "approved").when((F.col("quality") == 0) | (F.col("toxic") == 1), "rejected").otherwise("pending").alias("status"))


# The whole search over questions and texts that reach its rules: expansion, phrases and the heading's intent.
_ADDED = {0: " 可见性", 1: " 变量 命名规则"}  # by doc_id % 10, after the text
_BEFORE = {0: "可见性 ", 1: "标识符 "}  # by item_id % 3, before the question
_SETTINGS = ({"setting": 0}, {"setting": 1, "rrf_k": 10, "w_vector": 0.4, "w_term": 0.4, "w_rank": 0.2})
_pairs = lambda c: f"replace(replace(replace({c}, '可见性', '可见 见性'), '标识符', '标识 识符'), '命名规则', '命名 名规 规则')"  # noqa: E731 - as pairs of ideographs
_SWEEP_SQL = f"""WITH docs2 AS (SELECT doc_id, source, text || CASE doc_id % 10 WHEN 0 THEN '{_ADDED[0]}' WHEN 1 THEN '{_ADDED[1]}' ELSE '' END AS text, CASE WHEN doc_id % 4 = 0 THEN '可见性 > ' ELSE '' END || lang AS heading FROM documents),
ask2 AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN '{_BEFORE[0]}' WHEN 1 THEN '{_BEFORE[1]}' ELSE '' END || text AS question, CASE item_id % 3 WHEN 0 THEN '{_BEFORE[0]}' WHEN 1 THEN '{_BEFORE[1]}' ELSE '' END || text || CASE item_id % 3 WHEN 1 THEN ' 命名规则 名称 类型 变量' ELSE '' END AS text FROM benchmark),
{BM25_SQL.replace(tok('text'), tok(_pairs('text'))).replace('FROM documents', 'FROM docs2').replace('FROM benchmark', 'FROM ask2')}, {VECTOR_SQL.replace('embeddings r)', '(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM docs2)) r)')},
st2 AS (SELECT * FROM (VALUES (0, 60, 0.65::DOUBLE, 0.25::DOUBLE, 0.10::DOUBLE), (1, 10, 0.4, 0.4, 0.2)) v(setting, rrf_k, wv, wt, wr)),
f0 AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS l_rank, b.rank AS v_rank, b.score AS v_score FROM (SELECT * FROM lx WHERE rank <= 8) a FULL JOIN (SELECT * FROM vr WHERE rank <= 8) b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
f1 AS (SELECT f0.*, st2.*, round(coalesce(1.0::DOUBLE / (rrf_k + l_rank), 0) + coalesce(1.0::DOUBLE / (rrf_k + v_rank), 0), 9) AS rrf FROM f0, st2),
f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, setting ORDER BY rrf DESC, l_rank NULLS LAST, v_rank NULLS LAST, chunk_id) AS rank, count(*) OVER (PARTITION BY query_id, setting) AS total FROM f1),
f3 AS (SELECT f2.*, d.source AS document_id, d.text AS content, round(rrf + CASE WHEN contains(a.text, '可见性') AND contains(heading, '可见性') THEN 0.012 ELSE 0 END, 9) AS boosted, list_filter(list_distinct({tok(_pairs('a.question'))}), lambda t: length(t) >= 2) AS terms,
CASE item_id % 3 WHEN 0 THEN ['可见性'] WHEN 1 THEN ['标识符', '命名规', '名规则'] ELSE []::VARCHAR[] END AS phrases, greatest(0.0, least(1.0, (coalesce(v_score, -1.0) + 1) / 2)) AS v FROM f2 JOIN docs2 d ON d.doc_id = chunk_id JOIN ask2 a ON item_id = query_id),
f4 AS (SELECT *, least(1.0, len(list_filter(terms, lambda t: contains(content, t)))::DOUBLE / greatest(1, len(terms))) AS tr, least(1.0, len(list_filter(phrases, lambda t: contains(content, t)))::DOUBLE / greatest(1, len(phrases))) AS pr FROM f3),
f5 AS (SELECT *, round(round(greatest(0.0, least(0.95, wv * v + wt * tr + wr * (1 - (rank - 1)::DOUBLE / greatest(1, total - 1)) + CASE WHEN pr > 0 THEN 0.06 * least(1.0, v * pr) ELSE 0 END)), 9), 4) AS relevance FROM f4),
f6 AS (SELECT *, row_number() OVER (PARTITION BY query_id, setting, document_id ORDER BY relevance DESC, boosted DESC, rank) AS n FROM f5)
SELECT query_id, setting, row_number() OVER (PARTITION BY query_id, setting ORDER BY relevance DESC, boosted DESC, rank) AS place, chunk_id, document_id, relevance, boosted AS rrf FROM f6 WHERE n <= 2 QUALIFY place <= 5"""


@query("federated_sweep", _SWEEP_SQL)
def federated_sweep(spark, d):
    """The whole search by two settings of its parameters, with questions that are expanded and headings that match."""
    added = F.when(F.col("doc_id") % 10 == 0, _ADDED[0]).when(F.col("doc_id") % 10 == 1, _ADDED[1]).otherwise("")
    heading = F.concat(F.when(F.col("doc_id") % 4 == 0, "可见性 > ").otherwise(""), F.col("lang"))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.concat("text", added).alias("text"), heading.alias("heading"))
    before = F.when(F.col("query_id") % 3 == 0, _BEFORE[0]).when(F.col("query_id") % 3 == 1, _BEFORE[1]).otherwise("")
    asked = questions(spark, d).withColumn("text", F.concat(before, F.col("text"))).join(question_vectors(spark, d), "query_id", "left")
    found = R.federated(docs.join(vectors(spark, d).select("chunk_id", "v"), "chunk_id", "left"), asked, list(_SETTINGS))
    return found.select("query_id", "setting", "place", "chunk_id", "document_id", "relevance", "rrf")


@query("evidence_render", f"""WITH RECURSIVE {BM25_SQL}, p AS (SELECT query_id, chunk_id, rank, substr(text, 1, 800) AS t, regexp_replace(substr(text, 1, 800), '[ \\t\\n\\r\\v\\f]+', '', 'g') AS s FROM lx JOIN documents ON doc_id = chunk_id WHERE rank <= 5),
near AS (SELECT b.query_id, b.rank, list(a.rank) AS earlier FROM p a JOIN p b ON a.query_id = b.query_id AND a.rank < b.rank WHERE a.s <> '' AND b.s <> '' AND least(length(a.s), length(b.s))::DOUBLE / greatest(length(a.s), length(b.s)) >= 0.9 AND CASE WHEN length(a.s) <= length(b.s) THEN contains(b.s, a.s) ELSE contains(a.s, b.s) END GROUP BY ALL),
kept AS (SELECT query_id, 1::BIGINT AS rank, [1::BIGINT] AS have FROM p WHERE rank = 1 UNION ALL
SELECT k.query_id, k.rank + 1, CASE WHEN list_has_any(k.have, coalesce(n.earlier, []::BIGINT[])) THEN k.have ELSE list_append(k.have, k.rank + 1) END FROM kept k JOIN p ON p.query_id = k.query_id AND p.rank = k.rank + 1 LEFT JOIN near n ON n.query_id = p.query_id AND n.rank = p.rank),
few AS (SELECT p.query_id, p.chunk_id, p.rank, {_EST.format('p.t')} AS tokens FROM p JOIN (SELECT query_id, max_by(have, rank) AS have FROM kept GROUP BY query_id) h ON h.query_id = p.query_id AND list_contains(h.have, p.rank)),
run AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM few)
SELECT query_id, place, chunk_id, tokens, used FROM run WHERE place = 1 OR used <= 500""")
def evidence_render(spark, d):
    """Evidence of each question: five best, near repeats out, then a budget of tokens."""
    hits = stored_bm25(spark, d, questions(spark, d), 5).drop("rank").join(corpus(spark, d), "chunk_id")
    return R.evidence(hits, 5, 500).select("query_id", "place", "chunk_id", "tokens", "used")


# Answers of models, made by rule from the turns of conversations; the SQL states what each must give.
_TURNS = "SELECT conv_id, turn, role, text, left(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), 20) AS w FROM conversations"


def _turns(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", "text", F.left(F.regexp_replace("text", "[^A-Za-z]+", " "), F.lit(20)).alias("w"))


@query("rewrite_pairs", f"""SELECT conv_id, turn, CASE WHEN length(trim(CASE WHEN turn % 6 = 1 THEN '"' || w || '"' ELSE w END)) = 0 THEN text WHEN length(r) > 3 * length(text) OR r = '' THEN text ELSE r END AS rewritten
FROM (SELECT *, CASE turn % 6 WHEN 1 THEN '"' || trim(w) || '"' WHEN 5 THEN trim(w) || '」' ELSE trim(w) END AS r FROM ({_TURNS}))""")
def rewrite_pairs(spark, d):
    """Rewrites in fences, pairs of quotes, two pairs, unlike pairs: one pair that matches is taken off."""
    t, w = F.col("turn") % 6, F.col("w")
    raw = F.when(t == 0, F.concat(F.lit("```"), w, F.lit("```"))).when(t == 1, F.concat(F.lit(" '\""), F.trim(w), F.lit("\"'\n"))).when(t == 2, F.concat(F.lit("「"), w, F.lit("」"))).when(t == 3, F.concat(F.lit("“ "), w, F.lit("”"))).when(t == 4, F.concat(F.lit("\n"), w)).otherwise(F.concat(F.trim(w), F.lit("」")))
    return _turns(spark, d).select("conv_id", "turn", T.rewritten(raw, F.col("text")).alias("rewritten"))


@query("expansion_items", f"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(w) <> base THEN trim(w) END, 'two ' || turn, 'three', '-5'], lambda x: x IS NOT NULL AND x <> '')[:3], '|') AS items FROM (SELECT *, trim(left(replace(text, chr(10), ' '), 40)) AS base FROM ({_TURNS}))""")
def expansion_items(spark, d):
    """Lists with bullets, numbers, blanks, repeats, the question itself, an item that is too long, and one too many."""
    w, base = F.trim("w"), F.trim(F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(40)))
    raw = F.concat_ws("\n", F.concat(F.lit("- "), w), F.lit("无"), base, F.concat(F.lit("2. two "), F.col("turn").cast("string")), F.lit("  "), F.concat(F.lit("子问题3：two "), F.col("turn").cast("string")), F.lit("x" * 61), F.lit("* three"), F.lit("--5"))
    return _turns(spark, d).select("conv_id", "turn", F.array_join(T.listed_items(raw, base), "|").alias("items"))


@query("verdict_json", f"""SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN '{{"vague": true, "n": ' || turn || '}}' WHEN 1 THEN '{{"vague": false}}' WHEN 2 THEN '{{"Vague": {{"a": 1}}}}' END AS object, CASE turn % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 5 THEN true END AS vague FROM ({_TURNS})""")
def verdict_json(spark, d):
    """Answers that are JSON, JSON in a fence or in prose, a list, no JSON, and a bare verdict in broken JSON."""
    t = F.col("turn") % 6
    raw = F.when(t == 0, F.concat(F.lit('{"vague": true, "n": '), F.col("turn").cast("string"), F.lit("}"))).when(t == 1, '```json\n{"vague": false}\n```').when(t == 2, 'So: {"Vague": {"a": 1}} as said.').when(t == 3, "[1, 2]").when(t == 4, "none").otherwise('{"VAGUE" : TRUE, oops')
    return _turns(spark, d).select("conv_id", "turn", T.lenient_object(raw).alias("object"), T.verdict(raw).alias("vague"))

"""Retrieval algebra: inverted index, BM25+, exact vector search, fusion, reranking, diversity, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import nearest
from .postings import PostingsIndex

K1, B, DELTA = 1.5, 0.75, 1.0
RRF_K, POOL = 60, 8
HEADING_BOOST, EVIDENCE_CHARS = 0.012, 800
#: Queries that are broadcast to the vectors: at most so many rows, else they are dealt by blocks.
BROADCAST_ROWS = 4096
#: Rows of query and term that are sent to the postings at most, some 60 bytes each; beyond that both sides are dealt by term.
BROADCAST_TERMS = 500_000
#: Pairs of query and chunk that a task scores, about; chunks of a task at least, however many the queries.
TASK_PAIRS, TASK_CHUNKS = 500_000, 64


def postings(corpus: DataFrame) -> DataFrame:
    """term, chunk_id, tf of corpus(chunk_id, text): one pass, combined before the shuffle."""
    return corpus.select("chunk_id", F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def document_lengths(corpus: DataFrame) -> DataFrame:
    return corpus.select("chunk_id", F.size(T.tokenize(F.col("text"))).cast("long").alias("dl"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(T.query_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def bm25(corpus: DataFrame, queries: DataFrame, top_k: int | None = None) -> DataFrame:
    """query_id, chunk_id, score and rank of matched chunks by BM25+ over queries(query_id, text), without an index.

    Only postings of query terms are counted: the terms' table joins before the aggregation, so the shuffle
    carries the matches of the queries, not the corpus. Repeated query tokens count repeatedly."""
    terms = _asked(queries)
    few, parts = _plan(terms, corpus.count())
    # a generator of one row: a text is cut into tokens once, not anew for their number
    tokens = corpus.select("chunk_id", F.inline(F.array(F.struct(T.tokenize(F.col("text")).alias("tokens")))))
    matched = tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(terms.select("term").distinct(), "term").repartition(parts, "chunk_id")
    tf = matched.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    stats = corpus.select(T.token_count(F.col("text")).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    # it reads the columns that the scores read, so that both share one exchange of the matches
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(F.col("tf") + F.col("dl")).alias("_most")).filter("_most > 0")
    return _gains(terms.join(_idf(df, stats), "term"), tf, top_k, few, parts)


def bm25_stored(index: PostingsIndex, queries: DataFrame, top_k: int | None = None) -> DataFrame:
    """bm25() over the chunks of a stored index: it reads the buckets of the queries' terms, and no text.

    The postings of the terms are dealt by chunk to as many tasks as keep the pairs of each bounded, where sums are made and cut
    to the best; so neither pairs nor sums are dealt anew. The terms with their weights are sent there while they are few, which
    is counted first. Beyond that postings and terms are dealt by term, and what met by chunk."""
    terms = _asked(queries)
    few, parts = _plan(terms, index.state["chunks"])
    tf = index.postings(terms.select("term").distinct())
    q = terms.join(_idf(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), index.statistics()), "term")
    return _gains(q, tf.repartition(parts, "chunk_id") if few else tf, top_k, few, parts)


def _plan(terms: DataFrame, chunks: int) -> tuple[bool, int]:
    """Whether terms(query_id, term, ..) are few, and the tasks that chunks are dealt to for so many queries."""
    n, queries = terms.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    most, cores = -(-chunks // TASK_CHUNKS), terms.sparkSession.sparkContext.defaultParallelism
    return n <= BROADCAST_TERMS, max(min(-(-chunks * queries // TASK_PAIRS), most), min(cores, most), 1)


def _idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(stats)).select("term", F.log((F.col("n") + 1) / F.col("df")).alias("idf"), "avgdl")


def _gains(q: DataFrame, tf: DataFrame, top_k: int | None, few: bool, parts: int) -> DataFrame:
    """Scores of q(query_id, term, qf, idf, avgdl), which is sent to postings that are dealt by chunk if it has few rows."""
    base = q.groupBy("query_id").agg(F.sum(F.col("idf") * F.col("qf") * DELTA).alias("base"))
    gain = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    met = tf.join(F.broadcast(q), "term") if few else q.join(tf, "term").repartition(parts, "chunk_id")
    score = met.groupBy("query_id", "chunk_id").agg(F.sum(gain).alias("gain")).join(F.broadcast(base) if few else base, "query_id")
    score = score.select("query_id", "chunk_id", F.round(F.col("base") + F.col("gain"), 6).alias("score"))
    return top(score, top_k) if top_k else score


def holding(texts: DataFrame, passages: DataFrame, key="doc_id") -> DataFrame:
    """Pairs of texts(key, text, ..) and passages(.., passage) of which the text contains the passage.

    Words of a passage but the first and last stand whole in a text that contains it: pairs meet by the longest two
    neighbours of these, keys alone and without the text, which is fetched for what has met and searched. Passages of under
    four words have none and are searched for in all texts, sent along while they are few. Keys may repeat or be null."""
    words = lambda c: F.split(c, r"\s+")
    pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    w = words(F.col("passage"))
    inner = F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))
    both = F.slice(pairs(inner), 1, F.greatest(F.size(inner) - 1, F.lit(0)))
    keyed = passages.withColumn("_pair", F.array_max(F.transform(both, lambda g: F.struct(F.length(g).alias("n"), g.alias("g"))))["g"])
    long = keyed.filter("_pair is not null")
    each = texts.select(F.col(key).alias("_key"), F.explode(F.array_distinct(pairs(words(F.col("text"))))).alias("_pair"))
    met = each.join(long.select("_pair").distinct(), "_pair").distinct().join(long, "_pair").drop("_pair")
    contains = F.instr(F.col("text"), F.col("passage")) > 0
    found = texts.join(met, F.col(key).eqNullSafe(F.col("_key"))).filter(contains).drop("_key")
    short = texts.join(keyed.filter("_pair is null").drop("_pair"), contains)
    return found.unionByName(short)


def top(scored: DataFrame, k: int, by="query_id", score="score", key="chunk_id") -> DataFrame:
    """The k best of each query with their rank, ties to the smaller key; cut within tasks before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dot(a, b) -> Column:
    d = lambda x: F.col(x).cast("array<double>") if isinstance(x, str) else x.cast("array<double>")
    return F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Not a number where a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, float("nan")).otherwise(dot(a, b) / norms)


def against(rows: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """Every row of rows(chunk_id, ..) with every one of a stated query set, queries(query_id, ..).

    Up to `most` queries (BROADCAST_ROWS), counted first, go to the rows where they stand. Beyond, both sides are dealt to cells of a block
    of so many queries and a part of the rows, in one plan: rows are copied once a block, queries once a part."""
    n, most = queries.count(), most or BROADCAST_ROWS
    if n <= most:
        return rows.crossJoin(F.broadcast(queries))
    blocks, parts = -(-n // most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    r = rows.withColumn("_part", own("chunk_id", parts)).withColumn("_block", all_of(blocks))
    q = queries.withColumn("_block", own("query_id", blocks)).withColumn("_part", all_of(parts))
    return r.join(q, ["_block", "_part"]).drop("_block", "_part")


def scored(rows: DataFrame, queries: DataFrame, k: int, most: int | None = None, cap: int | None = None) -> DataFrame:
    """query_id, chunk_id, score and, where rows have one, group: cosines of queries(query_id, q) with rows(chunk_id, v), exact.

    Of all pairs those stay that can be among a query's first k, at most cap of a group. Vectors are counted and looked at
    first; cells of both sides are compared by matrix products (`nearest`). Those that are null, zero, not finite, or not as long
    as the longest go with all others by the column expression."""
    most = most or BROADCAST_ROWS
    facts = lambda df, c: df.agg(F.count(F.lit(1)), F.max(F.size(c)), F.count_if(~_plain(c)), F.min(F.size(c))).first()
    (n, dim, odd, least), (nq, q_dim, q_odd, q_least) = facts(rows, "v"), facts(queries, "q")
    if not n or not nq:
        dim = 0
    group = [c for c in rows.columns if c == "group"]
    pairs = lambda a, b: against(a, b, most).select("query_id", "chunk_id", *group, F.round(cosine("v", "q"), 6).alias("score"))
    if (dim or 0) <= 0:
        return pairs(rows, queries)
    fits = lambda c: _plain(c) & (F.size(c) == dim)
    mixed, q_mixed = odd or least != dim, q_odd or q_least != dim or q_dim != dim
    r, q = (rows.filter(fits("v")) if mixed else rows), (queries.filter(fits("q")) if q_mixed else queries)
    out = nearest.cells(r.select("chunk_id", "v", *group), q.select("query_id", "q"), k, n, dim, nq, most, cap)
    if mixed:
        out = out.unionByName(pairs(rows.filter(~fits("v")), queries))
    if q_mixed:
        out = out.unionByName(pairs(r, queries.filter(~fits("q"))))
    return out


def _plain(c: str) -> Column:
    """Whether the square of the vector's length is a positive number."""
    n = dot(c, c)
    return F.coalesce((n > 0) & (n < float("inf")), F.lit(False))


def vector_topk(rows: DataFrame, queries: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: cosine of queries(query_id, q) with rows(chunk_id, v), exact.

    A stated query set against all rows; each cell cuts to its k best before the shuffle."""
    return top(scored(rows.select("chunk_id", "v"), queries, k, most), k)


def rrf(lexical: DataFrame, vector: DataFrame, k: int | str = RRF_K, by=("query_id",)) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: score, origins, the raw scores and the fused rank.

    k may be one of `by`, the columns that tell lists apart. Ties keep the order of first sight: the lexical list's, then
    the vector list's."""
    k = F.col(k) if isinstance(k, str) else F.lit(k)
    a = lexical.select(*by, "chunk_id", F.col("rank").alias("l_rank"), F.col("score").alias("l_score"))
    b = vector.select(*by, "chunk_id", F.col("rank").alias("v_rank"), F.col("score").alias("v_score"))
    both = a.join(b, [*by, "chunk_id"], "full")
    one = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    both = both.withColumn("rrf", F.round(one("l_rank") + one("v_rank"), 9)).withColumn("origins", F.concat_ws("+", F.when(F.col("l_rank").isNotNull(), "bm25"), F.when(F.col("v_rank").isNotNull(), "vector")))
    w = Window.partitionBy(*by).orderBy(F.col("rrf").desc(), F.col("l_rank").asc_nulls_last(), F.col("v_rank").asc_nulls_last(), "chunk_id")
    return both.withColumn("rank", F.row_number().over(w))


def relevance(hits: DataFrame, w_vector: float | str = 0.65, w_term: float | str = 0.25, w_rank: float | str = 0.10, by=("query_id",)) -> DataFrame:
    """hits(query_id, question, content, v_score, rank) with the display score: similarity, share of terms, place.

    An entity that is asked about and found outweighs them. Weights may be columns. The phrases of a column `searched`,
    where there is one, count like the question's own."""
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    terms, phrases, anchors = (f(F.col("question")) for f in (T.query_terms, T.query_phrases, T.query_anchors))
    if "searched" in hits.columns:
        phrases = F.array_union(phrases, T.query_phrases(F.col("searched")))
    w_vector, w_term, w_rank = (F.col(w) if isinstance(w, str) else F.lit(w) for w in (w_vector, w_term, w_rank))
    ratio = lambda found, asked: F.least(F.lit(1.0), found / F.greatest(F.lit(1), F.size(asked)))
    t = ratio(T.hits(terms, F.col("content")), terms)
    p = ratio(T.hits(phrases, T.compact(F.col("content"))), phrases)
    e = ratio(T.hits(anchors, T.compact(F.col("content"))), anchors)
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce("v_score", F.lit(-1.0)) + 1) / 2))
    place = 1 - (F.col("rank") - 1) / F.greatest(F.lit(1), total - 1)
    plain = w_vector * v + w_term * t + w_rank * place + F.when(p > 0, 0.06 * F.least(F.lit(1.0), v * p)).otherwise(0.0)
    plain = F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.95), plain)), 9), 4)  # the last bits depend on the order of sums
    entity = F.round(F.least(F.lit(0.99), 0.82 + 0.10 * t + 0.06 * p), 4)
    return hits.withColumn("relevance", F.when((F.size(anchors) > 0) & (e > 0), entity).otherwise(plain))


def diversify(ranked: DataFrame, k: int, cap: int = 2, by=("query_id",), doc="document_id", order=None) -> DataFrame:
    """The first k of each query with at most `cap` of a document: two ranked cuts give what the greedy walk does."""
    order = order or [F.col("score").desc(), F.col("chunk_id")]
    per_doc = F.row_number().over(Window.partitionBy(*by, doc).orderBy(*order))
    few = ranked.withColumn("_d", per_doc).filter(F.col("_d") <= cap).drop("_d")
    return few.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


#: The parameters of a federated search by default: one row for each setting that is tried.
SETTING = {"setting": 0, "rrf_k": RRF_K, "w_vector": 0.65, "w_term": 0.25, "w_rank": 0.10}


def federated(chunks: DataFrame, questions: DataFrame, settings: list[dict] | None = None, top_k: int = 5, cap: int = 2, documents: DataFrame | None = None) -> DataFrame:
    """The whole search: chunks(chunk_id, document_id, text, heading, v), questions(query_id, text, q).

    Questions are expanded for recall; both lists are cut to POOL, fused, a heading that shares the question's intent
    adds HEADING_BOOST to the fused score, and what is shown goes by relevance to the question as asked, at most `cap` of
    a document. documents(document_id) narrows the search: vectors before the cut, texts after one to four times POOL.
    The lists are made once and meet every one of `settings`, rows like SETTING, so that a sweep costs no new search."""
    spark = chunks.sparkSession
    rows = [SETTING | s for s in settings or [SETTING]]
    grid = spark.createDataFrame([tuple(float(r[c]) if c[0] == "w" else int(r[c]) for c in SETTING) for r in rows], "setting long, rrf_k long, w_vector double, w_term double, w_rank double")
    asked = questions.select("query_id", F.col("text").alias("question"), T.expand_question(F.col("text")).alias("searched"), "q")
    corpus, rows_ = chunks.select("chunk_id", "text"), chunks.select("chunk_id", "document_id", "v").filter("v is not null")
    terms = asked.select("query_id", F.col("searched").alias("text"))
    if documents is None:
        lexical = bm25(corpus, terms, POOL)
    else:
        within = chunks.join(documents.select("document_id").distinct(), "document_id", "left_semi").select("chunk_id")
        lexical = top(bm25(corpus, terms, 4 * POOL).drop("rank").join(within, "chunk_id", "left_semi"), POOL)
        rows_ = rows_.join(within, "chunk_id", "left_semi")
    vector = vector_topk(rows_.select("chunk_id", "v"), asked.select("query_id", "q").filter("q is not null"), POOL)
    by = ("query_id", *SETTING)
    each = lambda hits: hits.crossJoin(F.broadcast(grid))  # noqa: E731 - as many rows as settings are stated
    fused = rrf(each(lexical), each(vector), "rrf_k", by)
    texts = chunks.select("chunk_id", "document_id", F.col("text").alias("content"), "heading")
    hits = fused.join(texts, "chunk_id").join(asked.drop("q"), "query_id")
    meant = F.coalesce(F.col("searched").contains(T.INTENT) & F.col("heading").contains(T.INTENT), F.lit(False))
    hits = relevance(hits.withColumn("rrf", F.round(F.col("rrf") + F.when(meant, HEADING_BOOST).otherwise(0.0), 9)), "w_vector", "w_term", "w_rank", by)
    order = [F.col("relevance").desc(), F.col("rrf").desc(), F.col("rank")]
    return diversify(hits, top_k, cap, by, "document_id", order)


def distinct_evidence(items: DataFrame, by="query_id", order="rank", text="text", key="chunk_id") -> DataFrame:
    """Items without those that nearly repeat an earlier one that is kept: of the compact texts one holds the other and
    has at most a ninth more characters. Blank texts repeat nothing. For lists cut to a few items a query."""
    item = F.struct(F.col(order).alias("o"), F.col(key).alias("k"), T.compact(F.col(text)).alias("s"))
    short, long = lambda a, b: F.least(F.length(a), F.length(b)), lambda a, b: F.greatest(F.length(a), F.length(b))
    repeats = lambda a, b: (a != "") & (b != "") & (short(a, b) / long(a, b) >= 0.9) & F.when(F.length(a) <= F.length(b), F.instr(b, a) > 0).otherwise(F.instr(a, b) > 0)
    none = F.array().cast(f"array<struct<o:{dict(items.dtypes)[order]},k:{dict(items.dtypes)[key]},s:string>>")
    kept = F.aggregate(F.array_sort(F.collect_list(item)), none, lambda have, x: F.when(F.exists(have, lambda y: repeats(x["s"], y["s"])), have).otherwise(F.array_append(have, x)))
    chosen = items.groupBy(by).agg(kept.alias("_kept")).select(by, F.explode("_kept.k").alias(key))
    return items.join(chosen, [by, key], "left_semi")


def evidence(items: DataFrame, limit: int = 5, budget: int = 3000, by="query_id", score="score", key="chunk_id") -> DataFrame:
    """The evidence that is shown: the `limit` best items, without near repeats, as long as their tokens stay within the
    budget, numbered in `place`. Of a text its first EVIDENCE_CHARS characters are shown, compared and counted."""
    best = top(items, limit, by, score, key).withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, EVIDENCE_CHARS))
    few = distinct_evidence(best, by, key=key).withColumn("tokens", T.estimate_tokens(F.col("text")))
    return within_budget(few, budget, by).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("rank")))


def merge_best(hits: DataFrame, by=("query_id", "chunk_id")) -> DataFrame:
    """Of hits of several calls, the best score of each chunk."""
    return hits.groupBy(*by).agg(F.max("score").alias("score"))


def within_budget(items: DataFrame, budget: int, by="query_id", order="rank", tokens="tokens") -> DataFrame:
    """The prefix of each query's items whose tokens stay within the budget; the first always."""
    w = Window.partitionBy(by).orderBy(order)
    run = items.withColumn("used", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    fits = (F.col("_n") == 1) | (F.col("used") <= budget)
    run = run.withColumn("_ok", F.min(fits.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter("_ok = 1").drop("_n", "_ok")

"""Queries of visibility, uploads, members and profiles.

Labels stand for uploads: toxic ones are rejected, good ones approved, others pending. Users are those of events.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import documents as D
from ..registry import query
from ..sources.tables import load

_STATUS = "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'pending' END"
_UP = f"up AS (SELECT doc_id AS document_id, doc_id % 50 AS uploader, {_STATUS} AS status, doc_id * 60 AS created_at FROM labels)"


def _uploads(spark, d):
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("pending")
    return load(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 50).alias("uploader"), status.alias("status"), (F.col("doc_id") * 60).alias("created_at"))


@query("visible_documents", f"WITH {_UP} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT document_id FROM up EXCEPT SELECT document_id FROM up WHERE status = 'approved')")
def visible_documents(spark, d):
    """Without a ledger row visible; with one only if approved."""
    up = _uploads(spark, d)
    hidden = up.select("document_id").distinct().join(up.filter("status = 'approved'").select("document_id"), "document_id", "left_anti")
    return load(spark, d, "documents").select("doc_id").join(hidden, F.col("doc_id") == F.col("document_id"), "left_anti")


@query("upload_ledger", f"WITH {_UP} SELECT u.document_id, u.uploader, u.status, d.source, row_number() OVER (PARTITION BY u.uploader ORDER BY created_at DESC, u.document_id DESC) AS place FROM up u LEFT JOIN documents d ON d.doc_id = u.document_id")
def upload_ledger(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source")
    w = Window.partitionBy("uploader").orderBy(F.col("created_at").desc(), F.col("document_id").desc())
    return _uploads(spark, d).join(docs, "document_id", "left").select("document_id", "uploader", "status", "source", F.row_number().over(w).alias("place"))


_PRIORITY = "CASE status WHEN 'approved' THEN 3 WHEN 'rejected' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END"


@query("dedup_by_hash", f"WITH {_UP} SELECT sha256(text) AS content_hash, doc_id, status FROM documents JOIN up ON document_id = doc_id WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY {_PRIORITY} DESC, doc_id) = 1")
def dedup_by_hash(spark, d):
    """Of documents of one content the best status; of equal ones the first. Empty contents never match."""
    p = F.when(F.col("status") == "approved", 3).when(F.col("status") == "rejected", 2).when(F.col("status") == "pending", 1).otherwise(0)
    docs = load(spark, d, "documents").filter("text != ''").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    j = docs.join(_uploads(spark, d), F.col("doc_id") == F.col("document_id"))
    return D.latest(j, ["content_hash"], [p.desc(), F.col("doc_id")]).select("content_hash", "doc_id", "status")


@query("members", "SELECT DISTINCT user_id % 8 AS class_id, user_id FROM events")
def members(spark, d):
    """Joining twice leaves one row."""
    return load(spark, d, "events").select((F.col("user_id") % 8).alias("class_id"), "user_id").distinct()


_POINTS = "e AS (SELECT user_id, event_type, min(event_id) AS k FROM events GROUP BY ALL)"


@query("weak_point_union", f"WITH {_POINTS} SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS weak_points, count(*) AS n FROM e GROUP BY user_id")
def weak_point_union(spark, d):
    """Points in order of first sight, each once: first sights first, so that a list holds no repeats."""
    first = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("k"))
    return first.groupBy("user_id").agg(D.joined("k", "event_type", ",").alias("weak_points"), F.count(F.lit(1)).alias("n"))


@query("needs_onboarding", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 90)")
def needs_onboarding(spark, d):
    e = load(spark, d, "events")
    return e.select("user_id").distinct().join(e.filter("event_type = 'signup' and value > 90").select("user_id").distinct(), "user_id", "left_anti")


@query("style_consensus", "WITH r AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), a AS (SELECT user_id, max(event_type) FILTER (k <= 2) AS style, count(DISTINCT event_type) FILTER (k <= 2) AS n_styles, count(*) FILTER (k <= 2) AS n, max(event_type) FILTER (k = 3) AS current FROM r GROUP BY user_id) SELECT user_id, CASE WHEN n = 2 AND n_styles = 1 AND style IS DISTINCT FROM current THEN style END AS new_style FROM a")
def style_consensus(spark, d):
    """Two equal signals in a row, other than the style so far, change it."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    r = load(spark, d, "events").withColumn("k", k).filter("k <= 3")
    two = F.when(F.col("k") <= 2, F.col("event_type"))
    a = r.groupBy("user_id").agg(F.max(two).alias("style"), F.countDistinct(two).alias("n_styles"), F.count(two).alias("n"), F.max(F.when(F.col("k") == 3, F.col("event_type"))).alias("current"))
    return a.select("user_id", F.when((F.col("n") == 2) & (F.col("n_styles") == 1) & ~F.col("style").eqNullSafe(F.col("current")), F.col("style")).alias("new_style"))


@query("cascade_delete", "SELECT conv_id, count(*) AS n_messages FROM conversations WHERE conv_id % 4 <> 1 GROUP BY conv_id")
def cascade_delete(spark, d):
    """What is left of messages once some owners are gone."""
    gone = load(spark, d, "conversations").select("conv_id").distinct().filter("conv_id % 4 = 1")
    return load(spark, d, "conversations").join(gone, "conv_id", "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))


@query("document_tasks", "SELECT d.doc_id, CAST(t.event_id AS VARCHAR) AS event_id, t.event_type AS status FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) t ON t.user_id = d.doc_id AND t.k = 1")
def document_tasks(spark, d):
    """Documents with their last task, if they have one."""
    last = D.latest(load(spark, d, "events"), ["user_id"], [F.col("event_id").desc()]).select(F.col("user_id").alias("doc_id"), F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("status"))
    return load(spark, d, "documents").select("doc_id").join(last, "doc_id", "left")

"""Batch twins of the streaming operators, and the streams themselves run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import documents as D
from ..registry import query
from ..sources.store import shared_dir
from ..sources.tables import load
from ..streaming import ops as S
from ..streaming import tasks as K

_STATUS = "CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PENDING' ELSE 'RUNNING' END"


def _tasks(spark, d, events=None):
    e = load(spark, d, "events") if events is None else events
    s = F.when(F.col("event_type") == "purchase", "SUCCEEDED").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "PENDING").otherwise("RUNNING")
    return e.select(F.col("user_id").alias("task_id"), "event_id", "ts", s.alias("status"), "value")


@query("task_latest", f"SELECT user_id AS task_id, event_id, {_STATUS} AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def task_latest(spark, d):
    return D.latest(_tasks(spark, d), ["task_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("task_id", "event_id", "status")


@query("task_errors", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'DOWNLOAD_FAILED' WHEN 1 THEN 'PARSE_FAILED' WHEN 2 THEN 'REVIEW_FAILED' WHEN 3 THEN 'INDEXING_FAILED' ELSE 'UNKNOWN' END AS error_code, substr(props, 1, 500) AS error_message FROM events WHERE event_type = 'error'")
def task_errors(spark, d):
    k = F.col("event_id") % 6
    stage = F.when(k == 0, "DOWNLOAD").when(k == 1, "PARSING").when(k == 2, "REVIEW").when(k == 3, "INDEXING").otherwise("OCR")
    return load(spark, d, "events").filter("event_type = 'error'").select("event_id", S.error_code(stage).alias("error_code"), F.substring("props", 1, 500).alias("error_message"))


_STAGES = list(K.STAGE_PROGRESS)
_KIND = "CASE WHEN event_id % 12 = 0 THEN 'SUCCEEDED' WHEN event_id % 36 = 1 THEN 'REJECTED' WHEN event_id % 12 IN (1, 2) THEN 'FAILED' WHEN event_id % 12 IN (3, 4, 5) THEN 'RETRY' ELSE 'STAGE' END"
_IN = "s.status = 'PENDING' AND e.kind"
_BACK = "s.status = 'FAILED' AND e.kind = 'RETRY'"


@query("staged_tasks", f"""WITH RECURSIVE ev AS (SELECT user_id AS task_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k, {_KIND} AS kind, {_STAGES!r}[event_id % {len(_STAGES)} + 1] AS stage, props AS error FROM events),
st AS (SELECT DISTINCT task_id, 0::BIGINT AS k, 'PENDING' AS status, '' AS stage, 0::BIGINT AS progress, NULL::VARCHAR AS error_code, '' AS error_message, 0::BIGINT AS retry_count, 0::BIGINT AS refused, NULL::BIGINT AS event_id FROM ev
UNION ALL SELECT s.task_id, e.k, CASE WHEN {_IN} IN ('SUCCEEDED', 'REJECTED', 'FAILED') THEN e.kind WHEN {_BACK} THEN 'PENDING' ELSE s.status END,
CASE WHEN {_IN} = 'STAGE' THEN e.stage WHEN {_IN} = 'SUCCEEDED' THEN 'DONE' WHEN {_IN} = 'REJECTED' THEN 'REVIEW' WHEN {_BACK} THEN '' ELSE s.stage END,
CASE WHEN {_IN} = 'STAGE' THEN CASE e.stage {' '.join(f"WHEN '{k}' THEN {v}" for k, v in K.STAGE_PROGRESS.items())} END WHEN {_IN} IN ('SUCCEEDED', 'REJECTED') THEN 100 WHEN {_BACK} THEN 0 ELSE s.progress END,
CASE WHEN {_IN} = 'FAILED' THEN CASE s.stage {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ERROR_CODES.items())} ELSE 'UNKNOWN' END ELSE s.error_code END,
CASE WHEN {_IN} = 'FAILED' THEN substr(coalesce(e.error, ''), 1, 500) WHEN {_IN} IN ('STAGE', 'SUCCEEDED', 'REJECTED') OR {_BACK} THEN '' ELSE s.error_message END,
s.retry_count + CAST({_BACK} AS BIGINT), s.refused + CASE WHEN {_BACK} OR {_IN} <> 'RETRY' THEN 0 ELSE 1 END, e.event_id FROM st s JOIN ev e ON e.task_id = s.task_id AND e.k = s.k + 1)
SELECT task_id, status, stage, progress, error_code, error_message, retry_count, refused, event_id FROM st QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY k DESC) = 1""")
def staged_tasks(spark, d):
    """The life of each task (a user's events): stages, progress, coded errors, retries of failed tasks alone, and what was refused."""
    k = F.col("event_id")
    kind = F.when(k % 12 == 0, "SUCCEEDED").when(k % 36 == 1, "REJECTED").when((k % 12).isin(1, 2), "FAILED").when((k % 12).isin(3, 4, 5), "RETRY").otherwise("STAGE")
    stage = F.get(F.array(*map(F.lit, _STAGES)), (k % len(_STAGES)).cast("int"))
    e = load(spark, d, "events").select(F.col("user_id").alias("task_id"), "event_id", "ts", kind.alias("kind"), stage.alias("stage"), F.col("props").alias("error"))
    return K.staged_tasks(e).drop("at")


@query("task_counts", f"SELECT {_STATUS} AS status, count(*) AS n, count(*) FILTER ({_STATUS} IN ('SUCCEEDED', 'FAILED', 'REJECTED')) AS n_done FROM events GROUP BY ALL")
def task_counts(spark, d):
    return _tasks(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(*S.TERMINAL)).alias("n_done"))


@query("rate_limit", "SELECT user_id, CAST(time_bucket(INTERVAL '1 day', ts) AS VARCHAR) AS start, count(*) AS n, greatest(count(*) - 3, 0) AS rejected FROM events GROUP BY user_id, time_bucket(INTERVAL '1 day', ts)")
def rate_limit(spark, d):
    """Windows of a day and three requests: these users are slow."""
    return S.limit_windows(load(spark, d, "events"), "1 day", 3).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "rejected")


@query("rejected_requests", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 day', ts) ORDER BY ts, event_id) > 3")
def rejected_requests(spark, d):
    w = Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return load(spark, d, "events").withColumn("k", F.row_number().over(w)).filter("k > 3").select("user_id", "event_id")


@query("upload_first_sights", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE text <> '' GROUP BY ALL")
def upload_first_sights(spark, d):
    return load(spark, d, "documents").filter("text != ''").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"))


@query("session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1 hour' THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, d):
    """An extension: sessions that an hour's pause ends."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("ingest_batch")
def ingest_batch(spark, d):
    """Documents as a stream into a folder, in batches until all are in; the rows of the folder."""
    at = _folder(spark)
    schema = load(spark, d, "documents").schema
    S.ingest(S.read_folder(spark, f"{d}/documents.parquet", schema), f"{at}/sink", f"{at}/checkpoint", lambda b: b.select("doc_id", "source", F.length("text").alias("n")))
    return spark.read.parquet(f"{at}/sink").select("doc_id", "source", "n")

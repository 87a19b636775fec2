"""Queries of members, surveys, reviews, uploads and erased users. Events and labels stand for what users did."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as G
from ..registry import query
from ..sources.tables import load

_USERS = "us AS (SELECT DISTINCT user_id, CASE WHEN user_id % 5 = 0 THEN 'teacher' ELSE 'member' END AS role FROM events)"


def _users(spark, d):
    return load(spark, d, "events").select("user_id").distinct().withColumn("role", F.when(F.col("user_id") % 5 == 0, "teacher").otherwise("member"))


_JOINS = "CASE event_type WHEN 'error' THEN 'leave' WHEN 'view' THEN 'look' ELSE 'join' END"


@query("class_members", f"""WITH {_USERS}, e AS (SELECT event_id % 3 AS class_id, user_id, {_JOINS} AS action, event_id AS seq FROM events WHERE user_id % 11 <> 7),
s AS (SELECT *, max(seq) FILTER (action = 'leave') OVER (PARTITION BY class_id, user_id) AS last_left FROM e) SELECT class_id, user_id, min(seq) AS joined_at FROM s WHERE action = 'join' AND (last_left IS NULL OR seq > last_left) GROUP BY class_id, user_id""")
def class_members(spark, d):
    """Who is in a class once all events are taken in: joined, not left since, and known."""
    kind = F.col("event_type")
    action = F.when(kind == "error", "leave").when(kind == "view", "look").otherwise("join")
    e = load(spark, d, "events").select((F.col("event_id") % 3).alias("class_id"), "user_id", action.alias("action"), F.col("event_id").alias("seq"))
    return G.memberships(e, _users(spark, d).filter("user_id % 11 <> 7"))


@query("survey_statuses", f"""WITH {_USERS}, s AS (SELECT event_id AS seq, e.user_id, role, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS k FROM events e LEFT JOIN (SELECT * FROM us WHERE user_id % 13 <> 3) u ON u.user_id = e.user_id WHERE event_type = 'signup')
SELECT seq, user_id, CASE WHEN role IS DISTINCT FROM 'member' THEN 'forbidden' WHEN k = 1 THEN 'accepted' ELSE 'conflict' END AS status FROM s""")
def survey_statuses(spark, d):
    """A member's first survey is taken; later ones, those of teachers and of unknown users are not."""
    s = load(spark, d, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("seq"), "user_id")
    return G.judged_surveys(s, _users(spark, d).filter("user_id % 13 <> 3")).select("seq", "user_id", "status")


@query("onboarding_users", f"WITH {_USERS} SELECT user_id, role, role = 'member' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 50) AS needs_onboarding FROM us")
def onboarding_users(spark, d):
    return G.onboarding(_users(spark, d), load(spark, d, "events").filter("event_type = 'signup' and value > 50"))


@query("review_ledger", """WITH r AS (SELECT doc_id AS document_id, doc_id % 11 = 0 AS by_admin, doc_id % 13 <> 5 AS has_review, quality = 1 AS approved, CASE WHEN doc_id % 7 <> 2 THEN toxic = 1 ELSE false END AS injected, CASE doc_id % 3 WHEN 0 THEN repeat('x', 600) WHEN 1 THEN '' END AS reason FROM labels),
b AS (SELECT *, has_review AND (NOT approved OR injected) AS bad FROM r)
SELECT document_id, CASE WHEN by_admin THEN 'approved' WHEN NOT has_review THEN 'pending' WHEN bad THEN 'rejected' ELSE 'approved' END AS status, CASE WHEN bad AND NOT by_admin THEN left(coalesce(nullif(reason, ''), CASE WHEN injected THEN '检测到提示词注入风险' ELSE '校验未通过' END), 500) END AS review_note,
CASE WHEN by_admin THEN 'admin' WHEN has_review THEN 'agent' END AS reviewed_by, CASE WHEN bad THEN 'REJECTED' END AS task_status FROM b""")
def review_ledger(spark, d):
    """Uploads after their reviews: administrators' decisions stay, an injected prompt rejects, some have no review."""
    labels, k = load(spark, d, "labels").withColumnRenamed("doc_id", "document_id"), F.col("document_id")
    admin = k % 11 == 0
    uploads = labels.select("document_id", F.when(admin, "approved").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("review_note"), F.when(admin, "admin").alias("reviewed_by"))
    reason = F.when(k % 3 == 0, "  " + "x" * 600).when(k % 3 == 1, " \n")
    reviews = labels.filter(k % 13 != 5).select("document_id", (F.col("quality") == 1).alias("approved"), F.when(k % 7 != 2, F.col("toxic") == 1).alias("prompt_injection"), reason.alias("reason"))
    return G.reviewed(uploads, reviews)


@query("upload_listing", f"""SELECT l.doc_id AS document_id, 'u' || u.user_id AS username, CASE WHEN l.doc_id % 4 <> 0 THEN source || '/' || l.doc_id END AS filename, coalesce(length(text) > 400, false) AS indexed
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN (SELECT DISTINCT user_id FROM events) u ON u.user_id = l.doc_id % 50""")
def upload_listing(spark, d):
    """Uploads with the names of their users and files, where known, and whether any chunk of them is indexed."""
    docs = load(spark, d, "documents").withColumnRenamed("doc_id", "document_id")
    uploads = load(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 50).alias("uploader"))
    users = _users(spark, d).select("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"))
    files = docs.filter("document_id % 4 <> 0").select("document_id", F.concat("source", F.lit("/"), F.col("document_id").cast("string")).alias("filename"))
    return G.upload_listing(uploads, users, files, docs.filter("length(text) > 400")).select("document_id", "username", "filename", "indexed")


_OF_USER = "(SELECT DISTINCT conv_id AS conversation_id, conv_id % 40 AS user_id FROM conversations)"


@query("erased_users", f"""WITH c AS (SELECT * FROM {_OF_USER} WHERE user_id % 4 <> 1), m AS (SELECT conv_id AS conversation_id, conv_id * 1000 + turn AS message_id, role FROM conversations WHERE conv_id IN (SELECT conversation_id FROM c)),
n AS (SELECT user_id FROM events WHERE user_id % 4 <> 1)
SELECT 'conversations' AS name, count(*) AS n, CAST(sum(conversation_id) AS BIGINT) AS ids FROM c UNION ALL SELECT 'messages', count(*), CAST(sum(message_id) AS BIGINT) FROM m UNION ALL SELECT 'traces', count(*), CAST(sum(message_id) AS BIGINT) FROM m WHERE role = 'assistant'
UNION ALL SELECT 'memories', count(*), CAST(sum(user_id) AS BIGINT) FROM n UNION ALL SELECT 'users', count(DISTINCT user_id), CAST(sum(DISTINCT user_id) AS BIGINT) FROM n UNION ALL SELECT 'uploads', count(*), CAST(sum(doc_id) AS BIGINT) FROM labels""")
def erased_users(spark, d):
    """Rows and ids that each table holds once a quarter of the users are erased with all that hangs on them."""
    turns = load(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role")
    tables = {
        "users": _users(spark, d),
        "memories": load(spark, d, "events").select("user_id"),
        "conversations": turns.select("conversation_id").distinct().withColumn("user_id", F.col("conversation_id") % 40),
        "messages": turns.select("conversation_id", "message_id"),
        "traces": turns.filter("role = 'assistant'").select("message_id"),
        "uploads": load(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 50).alias("user_id")),
    }
    gone = spark.range(40).select(F.col("id").alias("user_id")).union(_users(spark, d).select("user_id")).filter("user_id % 4 = 1")
    ids = {"users": "user_id", "memories": "user_id", "conversations": "conversation_id", "messages": "message_id", "traces": "message_id", "uploads": "document_id"}
    out = None
    for name, t in G.erased(tables, gone).items():
        one = t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(ids[name]).alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out

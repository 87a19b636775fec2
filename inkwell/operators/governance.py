"""Members, surveys, reviews, uploads and erasure of users, as joins and windows over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Notes of a rejection that gives no reason, and how long a note may be.
INJECTION_NOTE, REJECTED_NOTE, NOTE_CHARS = "检测到提示词注入风险", "校验未通过", 500
#: What a user's erasure takes: tables by user, and the chain from conversations to traces. Uploads stay.
OWNED = ("users", "profiles", "surveys", "memories", "members")
CHAIN = (("conversations", "user_id"), ("messages", "conversation_id"), ("traces", "message_id"))


def memberships(events: DataFrame, users: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """class_id, user_id, joined_at of the members that events(class_id, user_id, action, seq) leave; action: join or leave.

    Joining again while a member changes nothing, leaving twice neither; who joins after leaving is a member since then.
    Other actions and null ids are passed over; with users(user_id) or classes(class_id), so are those that do not exist."""
    e = events.filter(F.col("action").isin("join", "leave") & F.col("seq").isNotNull())
    for table, key in ((users, "user_id"), (classes, "class_id")):
        e = e.filter(F.col(key).isNotNull()) if table is None else e.join(table.select(key), key, "left_semi")
    pair, joins = ["class_id", "user_id"], F.col("action") == "join"
    left = e.groupBy(*pair).agg(F.max(F.when(~joins, F.col("seq"))).alias("_left"))  # combined before the shuffle
    since = e.filter(joins).join(left, pair).filter(F.col("_left").isNull() | (F.col("seq") > F.col("_left")))
    return since.groupBy(*pair).agg(F.min("seq").alias("joined_at"))


def judged_surveys(submissions: DataFrame, users: DataFrame) -> DataFrame:
    """submissions(user_id, seq, ..) with status: accepted (a member's first, by seq), conflict (a later one), forbidden (who is
    no member, or not known). users(user_id, role), one row a user."""
    j = submissions.join(users.select("user_id", "role"), "user_id", "left")
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("seq")) == 1
    return j.withColumn("status", F.when(~F.col("role").eqNullSafe("member"), "forbidden").when(first, "accepted").otherwise("conflict")).drop("role")


def onboarding(users: DataFrame, surveys: DataFrame) -> DataFrame:
    """users(user_id, role) with needs_onboarding: a member without a row in surveys(user_id)."""
    done = surveys.select("user_id").filter("user_id is not null").distinct().withColumn("_done", F.lit(True))
    return users.join(done, "user_id", "left").withColumn("needs_onboarding", F.col("role").eqNullSafe("member") & F.col("_done").isNull()).drop("_done")


def reviewed(uploads: DataFrame, reviews: DataFrame) -> DataFrame:
    """uploads(document_id, status, review_note, reviewed_by) after reviews(document_id, approved, prompt_injection, reason),
    one row a document, with task_status of the document's task: REJECTED, or null where ingestion goes on.

    A review that does not approve, or finds an injected prompt, rejects. What an administrator decided stays, though the
    task is rejected all the same. Uploads without a review stay as they are."""
    r = reviews.select("document_id", ~F.coalesce("approved", F.lit(False)) | F.coalesce("prompt_injection", F.lit(False)), F.coalesce("prompt_injection", F.lit(False)), "reason").toDF("document_id", "_bad", "_injected", "_reason")
    note = F.left(F.coalesce(F.nullif(T.strip(F.col("_reason")), F.lit("")), F.when(F.col("_injected"), INJECTION_NOTE).otherwise(REJECTED_NOTE)), F.lit(NOTE_CHARS))
    changes = F.col("_bad").isNotNull() & ~F.col("reviewed_by").eqNullSafe("admin")
    j = uploads.join(r, "document_id", "left")
    return j.select(
        "document_id",
        F.when(changes, F.when(F.col("_bad"), "rejected").otherwise("approved")).otherwise(F.col("status")).alias("status"),
        F.when(changes & F.col("_bad"), note).otherwise(F.col("review_note")).alias("review_note"),
        F.when(changes, "agent").otherwise(F.col("reviewed_by")).alias("reviewed_by"),
        F.when(F.col("_bad"), "REJECTED").alias("task_status"),
    )


def upload_listing(uploads: DataFrame, users: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """uploads(document_id, uploader, ..) with username of users(user_id, username), filename of documents(document_id,
    filename), both null where there is none, and indexed: whether chunks(document_id) holds any of the document."""
    held = chunks.select("document_id").distinct().withColumn("_held", F.lit(True))
    named = uploads.join(users.select(F.col("user_id").alias("uploader"), "username"), "uploader", "left").join(documents.select("document_id", "filename"), "document_id", "left")
    return named.join(held, "document_id", "left").withColumn("indexed", F.col("_held").isNotNull()).drop("_held")


def erased(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """What tables hold once the users of gone(user_id) are erased: rows of OWNED tables by user_id; their conversations, the
    messages of these and the traces of those, along CHAIN. Every other table, uploads among them, stays whole; rows without an
    owner stay. conversations, messages and traces go by conversation_id, message_id of the table before."""
    gone = gone.select("user_id").distinct()
    left = {name: t.join(gone, "user_id", "left_anti") if name in OWNED else t for name, t in tables.items()}
    lost = gone
    for (name, owner), own in zip(CHAIN, ("conversation_id", "message_id", None)):
        if name not in tables:
            break
        left[name] = tables[name].join(lost, owner, "left_anti")
        lost = tables[name].join(lost, owner, "left_semi").select(own).distinct() if own else None
    return left

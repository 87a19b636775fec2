"""Members, surveys, reviews, uploads and erased users."""

from inkwell.operators import governance as G


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_membership_is_idempotent(spark):
    schema = "class_id int, user_id int, action string, seq int"
    e = spark.createDataFrame([(1, 1, "join", 1), (1, 1, "join", 5), (1, 2, "join", 1), (1, 2, "leave", 2), (1, 2, "leave", 3), (1, 3, "join", 1), (1, 3, "leave", 2), (1, 3, "join", 4), (1, 3, "join", 9), (2, 1, "look", 1), (2, 4, "leave", 1), (None, 1, "join", 1), (2, 1, "join", None)], schema)
    assert rows(G.memberships(e), "class_id", "user_id", "joined_at") == [(1, 1, 1), (1, 3, 4)]
    assert rows(G.memberships(e.union(e)), "class_id", "user_id", "joined_at") == [(1, 1, 1), (1, 3, 4)]
    known = spark.createDataFrame([(3,), (None,)], "user_id int")
    assert rows(G.memberships(e, known), "user_id") == [(3,)]
    assert G.memberships(e, known, spark.createDataFrame([(2,)], "class_id int")).count() == 0
    assert G.memberships(e.limit(0)).count() == 0


def test_surveys_are_taken_once(spark):
    users = spark.createDataFrame([(1, "member"), (2, "teacher"), (3, None)], "user_id int, role string")
    s = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 1, "c"), (3, 1, "d"), (9, 1, "e")], "user_id int, seq int, role_note string")
    j = G.judged_surveys(s, users)
    assert j.columns == ["user_id", "seq", "role_note", "status"]
    assert rows(j, "user_id", "seq", "status") == [(1, 2, "accepted"), (1, 5, "conflict"), (2, 1, "forbidden"), (3, 1, "forbidden"), (9, 1, "forbidden")]
    assert rows(G.onboarding(users, s.filter("user_id <> 1")), "user_id", "needs_onboarding") == [(1, True), (2, False), (3, False)]
    assert rows(G.onboarding(users, j.filter("status = 'accepted'")), "user_id", "needs_onboarding") == [(1, False), (2, False), (3, False)]


def test_administrators_decide_and_injected_prompts_reject(spark):
    up = spark.createDataFrame([(i, "approved" if i == 5 else "pending", None, "admin" if i == 5 else None) for i in range(1, 8)], "document_id int, status string, review_note string, reviewed_by string")
    rv = spark.createDataFrame([(1, True, None, "fine"), (2, True, True, "  "), (3, False, False, None), (4, None, True, " why "), (5, False, True, "x"), (6, False, False, "y" * 700)], "document_id int, approved boolean, prompt_injection boolean, reason string")
    got = rows(G.reviewed(up, rv), "document_id", "status", "review_note", "reviewed_by", "task_status")
    assert got == [
        (1, "approved", None, "agent", None),
        (2, "rejected", G.INJECTION_NOTE, "agent", "REJECTED"),
        (3, "rejected", G.REJECTED_NOTE, "agent", "REJECTED"),
        (4, "rejected", "why", "agent", "REJECTED"),
        (5, "approved", None, "admin", "REJECTED"),
        (6, "rejected", "y" * 500, "agent", "REJECTED"),
        (7, "pending", None, None, None),
    ]


def test_listing_keeps_uploads_without_user_or_file(spark):
    up = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "document_id string, uploader int")
    users = spark.createDataFrame([(1, "ann")], "user_id int, username string")
    docs = spark.createDataFrame([("a", "a.md")], "document_id string, filename string")
    chunks = spark.createDataFrame([("a",), ("a",), ("c",)], "document_id string")
    assert rows(G.upload_listing(up, users, docs, chunks), "document_id", "username", "filename", "indexed") == [("a", "ann", "a.md", True), ("b", None, None, False), ("c", None, None, True)]


def test_erasure_follows_the_chain_and_keeps_uploads(spark):
    t = {
        "users": spark.createDataFrame([(1,), (2,)], "user_id int"),
        "members": spark.createDataFrame([(1, 7), (2, 7), (None, 7)], "user_id int, class_id int"),
        "conversations": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "conversation_id int, user_id int"),
        "messages": spark.createDataFrame([(100, 10), (101, 11), (102, 12), (103, None)], "message_id int, conversation_id int"),
        "traces": spark.createDataFrame([(5, 100), (6, 101), (7, None)], "trace_id int, message_id int"),
        "uploads": spark.createDataFrame([(1,), (2,)], "user_id int"),
    }
    gone = spark.createDataFrame([(1,), (1,), (99,), (None,)], "user_id int")
    left = G.erased(t, gone)
    assert set(left) == set(t)
    assert rows(left["users"], "user_id") == [(2,)] and rows(left["members"], "user_id") == [(2,), (None,)]
    assert rows(left["conversations"], "conversation_id") == [(11,), (12,)]
    assert rows(left["messages"], "message_id") == [(101,), (102,), (103,)]
    assert rows(left["traces"], "trace_id") == [(6,), (7,)] and left["uploads"].count() == 2
    again = G.erased(left, gone)
    assert {k: v.count() for k, v in again.items()} == {k: v.count() for k, v in left.items()}
    assert set(G.erased({"users": t["users"], "messages": t["messages"]}, gone)) == {"users", "messages"}

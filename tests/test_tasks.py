"""Staged tasks and folds: the stream in pieces ends where the batch and the rules in plain Python do."""

import datetime
import os
import random
import shutil
import tempfile
import time

from inkwell.streaming import tasks as K

EVENTS = "task_id long, event_id long, ts timestamp, kind string, stage string, error string"


def pieces(spark, parts, schema, make, mode, seconds=90):
    """Rows of each batch, in order."""
    source, got = tempfile.mkdtemp(), []
    df = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    for k, rows in enumerate(parts):
        tmp = tempfile.mkdtemp() + "/x"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(tmp)
        for f in os.listdir(tmp):
            if f.endswith(".parquet"):
                shutil.move(f"{tmp}/{f}", f"{source}/{k:03d}.parquet")
                os.utime(f"{source}/{k:03d}.parquet", (time.time() - 1000 + k, time.time() - 1000 + k))
    q = df.writeStream.foreachBatch(lambda b, n: got.append([r.asDict() for r in b.collect()])).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start()
    q.awaitTermination(seconds)
    q.stop()
    return [x for b in got for x in b]


def event(i, task, at, kind, stage=None, error=None):
    return (task, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at), kind, stage, error)


def test_life_of_a_task(spark):
    rows = [event(1, 7, 0, "CREATED"), event(2, 7, 1, "STAGE", "PARSING"), event(3, 7, 2, "RETRY"), event(4, 7, 3, "FAILED", None, "x" * 900), event(5, 7, 4, "SUCCEEDED"), event(6, 7, 5, "RETRY"), event(7, 7, 6, "STAGE", "INDEXING"), event(8, 7, 7, "SUCCEEDED"), event(9, 7, 8, "RETRY"), event(1, 8, 0, "STAGE", "REVIEW"), event(2, 8, 1, "REJECTED")]
    of = lambda n: {r["task_id"]: r for r in K.staged_tasks(spark.createDataFrame(rows[:n], EVENTS)).collect()}
    failed = of(4)[7]
    assert (failed["status"], failed["error_code"], len(failed["error_message"]), failed["progress"], failed["refused"]) == ("FAILED", "PARSE_FAILED", 500, 5, 1)
    again = of(6)[7]
    assert (again["status"], again["stage"], again["progress"], again["retry_count"], again["refused"]) == ("PENDING", "", 0, 1, 2)
    end = of(len(rows))
    assert (end[7]["status"], end[7]["stage"], end[7]["progress"], end[7]["retry_count"], end[7]["refused"]) == ("SUCCEEDED", "DONE", 100, 1, 3)
    assert (end[8]["status"], end[8]["progress"]) == ("REJECTED", 100)


def test_a_stream_in_pieces_ends_as_the_batch(spark):
    rnd = random.Random(1)
    rows = [event(i, rnd.randint(1, 6), i, rnd.choice(["STAGE"] * 4 + ["FAILED", "RETRY", "RETRY", "SUCCEEDED", "REJECTED", "CREATED"]), rnd.choice(list(K.STAGE_PROGRESS)), "why") for i in range(120)]
    rows += [(None, 1, None, "STAGE", None, None), (1, 500, None, "FAILED", None, None)]
    got = {r["task_id"]: r for r in pieces(spark, [rows[:40], rows[40:90], rows[90:]], EVENTS, K.staged_tasks, "update")}
    want = {r["task_id"]: r.asDict() for r in K.staged_tasks(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == want and len(want) == 6


def test_a_stuck_task_times_out_and_can_be_tried_anew(spark):
    parts = [[event(1, 1, 0, "STAGE", "OCR"), event(1, 2, 0, "SUCCEEDED")], [event(2, 3, 4000, "CREATED")], [event(3, 3, 4001, "STAGE", "PARSING")], [event(4, 3, 4002, "SUCCEEDED"), event(9, 1, 4002, "RETRY")]]
    got = pieces(spark, parts, EVENTS, lambda e: K.staged_tasks(e, patience=600, late="1 second"), "update")
    one = [(r["status"], r["error_code"], r["retry_count"]) for r in got if r["task_id"] == 1]
    assert one[:2] == [("PENDING", None, 0), ("FAILED", "TIMEOUT", 0)] and one[2] == ("PENDING", "TIMEOUT", 1)
    assert [r["status"] for r in got if r["task_id"] == 2] == ["SUCCEEDED"]


MESSAGES = "conv_id long, place long, role string, content string"


def test_folds_of_a_stream(spark):
    rows = [(1, i, "system" if i == 2 else "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(20)] + [(2, i, "user", f"n{i}") for i in range(5)] + [(None, 0, "user", "x"), (3, 0, None, None)]
    make = lambda m: K.fold_conversations(m, 6, 3)
    whole = [r.asDict() for r in make(spark.createDataFrame(rows, MESSAGES)).collect()]
    assert [(r["conv_id"], r["fold"], r["first_place"], r["last_place"], r["n_folded"]) for r in whole] == [(1, 1, 0, 16, 16)]
    assert whole[0]["folded"].split("\n")[:3] == ["user: m0", "assistant: m1", "assistant: m3"]
    got = pieces(spark, [rows[:5], rows[5:10], rows[10:]], MESSAGES, make, "append")
    # 10 messages: all but the last 3 and the system's go; then 1 + 3 + 10 are there
    assert [(r["conv_id"], r["fold"], r["first_place"], r["last_place"], r["n_folded"]) for r in got] == [(1, 1, 0, 6, 6), (1, 2, 7, 16, 10)]


def test_state_that_lives_for_a_time(spark):
    got = pieces(spark, [[(1, i, "user", "x") for i in range(9)]], MESSAGES, lambda m: K.fold_conversations(m, 6, 3, ttl=3600), "append", 15)
    assert [r["n_folded"] for r in got] == [6]

"""Streams end where their batch twins do."""

import pytest

from inkwell.plans import evaluation, streams
from inkwell.sources.tables import load
from inkwell.streaming import ops as S

SF = "/root/testdata/sf0.001"


def to_the_end(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture()
def events(spark):
    return S.read_folder(spark, f"{SF}/events.parquet", load(spark, SF, "events").schema)


def test_rate_windows(spark, events):
    got = to_the_end(spark, S.limit_windows(events, "1 day", 3), "limits", "complete")
    want = S.limit_windows(load(spark, SF, "events"), "1 day", 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_task_states(spark, events):
    got = to_the_end(spark, S.task_states(streams._tasks(spark, SF, events)), "tasks", "update")
    want = {x["task_id"]: (x["event_id"], x["status"]) for x in streams.task_latest(spark, SF).collect()}
    assert {x["task_id"]: (x["event_id"], x["status"]) for x in got.collect()} == want


def test_latency(spark, events):
    got = {x["event_type"]: x for x in to_the_end(spark, S.latency(events), "latency", "update").collect()}
    for x in evaluation.latency_stats(spark, SF).collect():
        y = got[x["event_type"]]
        assert (x["n"], x["p50"], x["p95"], x["max_v"]) == (y["n"], y["p50"], y["p95"], y["max_v"])


def test_first_sights(spark):
    d = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:02", "b")], "ts string, content_hash string")
    path = S.__file__ and spark.conf.get("spark.sql.warehouse.dir")
    import tempfile

    path = tempfile.mkdtemp() + "/x"
    d.write.parquet(path)
    got = to_the_end(spark, S.first_sights(S.read_folder(spark, path, d.schema)), "sights", "append")
    assert sorted(x["content_hash"] for x in got.collect()) == ["a", "b"]


def test_ingest_runs_once(spark, tmp_path):
    schema = load(spark, SF, "documents").schema
    for _ in range(2):
        S.ingest(S.read_folder(spark, f"{SF}/documents.parquet", schema), str(tmp_path / "sink"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "sink")).count() == load(spark, SF, "documents").count()

"""The stored index: equal to a scan of the texts, through upserts, deletes, merges, failures and reopening."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from inkwell.operators import retrieval as R
from inkwell.operators.postings import MERGE_FROM, PostingsIndex
from inkwell.sources import store

SCHEMA = "chunk_id long, text string"


@pytest.fixture()
def at(spark):
    return f"{store.shared_dir(spark)}/postings-test-{uuid.uuid4().hex}"


def chunks(spark, seed, ids):
    rnd = random.Random(seed)
    return {i: " ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee", "变量可见", "x+y"]) for _ in range(rnd.randint(0, 12))) for i in ids}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), SCHEMA)


def agree(spark, index, texts):
    asked = spark.createDataFrame([(0, "aa bb bb zz"), (1, "变量 dd"), (2, "nothing here"), (3, "")], "query_id long, text string")
    got, want = (sorted(map(str, x.collect())) for x in (R.bm25_stored(index, asked, 5), R.bm25(frame(spark, texts), asked, 5)))
    assert got == want
    plain = sorted(map(str, R.postings(frame(spark, texts)).collect()))
    assert plain == sorted(map(str, index.postings().select("term", "chunk_id", "tf").collect()))
    assert {r["chunk_id"] for r in index.chunks().collect()} == set(texts)


def test_upserts_deletes_and_merges(spark, at):
    texts = chunks(spark, 1, range(40))
    index = PostingsIndex.create(spark, at, frame(spark, texts))
    agree(spark, index, texts)
    new = chunks(spark, 2, [*range(30, 50), 100])
    texts |= new
    index.upsert(frame(spark, new))
    agree(spark, index, texts)
    index.delete(spark.createDataFrame([(i,) for i in (0, 1, 35, 100, 999)], "chunk_id long"))
    texts = {i: t for i, t in texts.items() if i not in (0, 1, 35, 100)}
    agree(spark, index, texts)
    again = chunks(spark, 3, [0, 35])  # come back after they went
    texts |= again
    index.upsert(frame(spark, again))
    agree(spark, index, texts)
    index.merge()  # the first segment stays
    assert [x["id"] for x in index.state["segments"]][0] == 1 and len(index.state["segments"]) == 2
    agree(spark, index, texts)
    index.merge(everything=True)
    assert len(index.state["segments"]) == 1 and store.names(spark, f"{at}/terms") == [f"segment={index.state['segments'][0]['id']}"]
    agree(spark, PostingsIndex(spark, at), texts)


def test_merges_by_itself(spark, at):
    texts = chunks(spark, 4, range(6))
    index = PostingsIndex.create(spark, at, frame(spark, texts))
    for k in range(MERGE_FROM):
        new = chunks(spark, 5 + k, [k, 10 + k])
        texts |= new
        index.upsert(frame(spark, new))
    assert len(index.state["segments"]) < MERGE_FROM
    agree(spark, index, texts)


def test_a_call_that_fails_changes_nothing(spark, at):
    texts = chunks(spark, 6, range(10))
    index = PostingsIndex.create(spark, at, frame(spark, texts))
    with pytest.raises(ValueError):
        index.upsert(frame(spark, {3: "aa"}).union(frame(spark, {3: "bb"})))
    agree(spark, PostingsIndex(spark, at), texts)
    index.upsert(frame(spark, {3: "aa"}))  # takes the place of what the failed call left
    agree(spark, PostingsIndex(spark, at), texts | {3: "aa"})


def test_of_two_writers_one_fails(spark, at):
    texts = chunks(spark, 7, range(10))
    a = PostingsIndex.create(spark, at, frame(spark, texts))
    b = PostingsIndex(spark, at)
    a.upsert(frame(spark, {50: "aa bb"}))
    with pytest.raises(Exception, match="[Ee]xist"):
        b.delete(spark.createDataFrame([(1,)], "chunk_id long"))


def test_null_texts_and_ids_and_an_empty_table(spark, at):
    index = PostingsIndex.create(spark, at, spark.createDataFrame([(1, None), (2, ""), (None, "aa"), (3, "aa")], SCHEMA))
    assert tuple(index.statistics().first()) == (3, 1 / 3)
    agree(spark, index, {1: "", 2: "", 3: "aa"})
    none = PostingsIndex.create(spark, f"{at}-none", spark.createDataFrame([], SCHEMA))
    assert none.postings().count() == 0 and R.bm25_stored(none, spark.createDataFrame([(0, "aa")], "query_id long, text string"), 3).count() == 0


def test_a_search_reads_its_buckets_and_no_text(spark, at):
    index = PostingsIndex.create(spark, at, frame(spark, chunks(spark, 8, range(50))), buckets=16)
    plan = R.bm25_stored(index, spark.createDataFrame([(0, "aa")], "query_id long, text string"), 3)
    files = {f.split("bucket=")[1].split("/")[0] for f in index.postings(spark.createDataFrame([("aa",)], "term string")).inputFiles() if "bucket=" in f}
    assert "bucket" in plan._jdf.queryExecution().executedPlan().toString() and "text" not in index.postings().columns
    read = index.postings(spark.createDataFrame([("aa",)], "term string")).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 1 < len(files)


def test_one_index_for_the_same_files(spark, at, tmp_path):
    frame(spark, {1: "aa"}).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    a, b = (PostingsIndex.of(spark, at, f"{tmp_path}/t", df) for _ in range(2))
    assert a.path == b.path
    frame(spark, {1: "bb"}).write.mode("overwrite").parquet(f"{tmp_path}/t")
    c = PostingsIndex.of(spark, at, f"{tmp_path}/t", spark.read.parquet(f"{tmp_path}/t"))
    assert c.path != a.path and [r["term"] for r in c.postings().collect()] == ["bb"]


def test_postings_are_counted_before_the_exchange_and_dealt_to_small_tasks(spark, at, monkeypatch):
    from inkwell.operators import postings as P

    texts = chunks(spark, 9, range(60))
    plan = P._counted(frame(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan  # nothing that grows with a task's tokens
    monkeypatch.setattr(P, "TASK_TOKENS", 2)
    index = PostingsIndex.create(spark, at, frame(spark, texts), buckets=2)
    assert len([f for f in index.postings().inputFiles() if "bucket=" in f]) > 2 * P.SALTS
    agree(spark, index, texts)


def test_pairs_of_a_task_are_bounded(spark, at, monkeypatch):
    texts = chunks(spark, 10, range(60))
    index = PostingsIndex.create(spark, at, frame(spark, texts))
    asked = spark.createDataFrame([(i, "aa bb") for i in range(20)], "query_id long, text string")
    monkeypatch.setattr(R, "TASK_PAIRS", 100)
    monkeypatch.setattr(R, "TASK_CHUNKS", 2)
    scores = R.bm25_stored(index, asked)
    assert scores.rdd.getNumPartitions() == 12  # 60 chunks and 20 queries: 1,200 pairs
    for few in (500_000, 1):
        monkeypatch.setattr(R, "BROADCAST_TERMS", few)
        agree(spark, index, texts)

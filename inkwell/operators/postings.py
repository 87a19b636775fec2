"""Postings as a stored index: segments of a bucketed table, with upsert, delete and merge.

A segment holds the postings of the chunks that one call brought, partitioned by a hash of the term and sorted by term, so
that a query opens the buckets of its terms and nothing else; and the chunks with their lengths, those taken out without one.
Segments are never changed: a chunk that comes again or goes is listed as dead in the segments that held it. What is valid
stands in a manifest, with the corpus' size and length; the next manifest is written once all else is, so readers see the
index before or after a call, a call that fails leaves it as it was, and of two writers at a time one fails.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import store

#: Bytes of text of a bucket, about; buckets at most; files of a bucket by chunk at least, since frequent terms fill theirs.
BUCKET_BYTES, MOST_BUCKETS, SALTS = 64 << 20, 4096, 4
#: Tokens whose postings one task sorts and writes, about, and the bytes of text files that hold one.
TASK_TOKENS, TOKEN_BYTES = 1_000_000, 4
#: Bytes of a table that one task reads.
SPLIT_BYTES = 128 << 20
#: Segments from which an upsert or delete merges the smaller ones.
MERGE_FROM = 8
_TERMS = "term string, chunk_id {0}, tf long, dl long"


class PostingsIndex:
    """An index at a path. chunks have chunk_id and text; a null text is an empty one, rows without a chunk_id are left out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = [n for n in store.names(spark, f"{path}/manifest") if n.endswith(".json")]
        if not found:
            raise FileNotFoundError(f"no index at {path}")
        self.state = json.loads(store.read_text(spark, f"{path}/manifest/{found[-1]}"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, chunks: DataFrame, buckets: int | None = None) -> "PostingsIndex":
        """A new index of chunks; the number of buckets follows from their bytes and stays."""
        n = buckets or max(8, min(MOST_BUCKETS, _bytes(chunks) // BUCKET_BYTES))
        state = {"version": 0, "buckets": n, "id": chunks.schema["chunk_id"].dataType.simpleString(), "next": 1, "segments": [], "chunks": 0, "tokens": 0}
        store.write_new(spark, f"{path}/manifest/{0:09d}.json", json.dumps(state))
        return cls(spark, path).upsert(chunks)

    @classmethod
    def of(cls, spark: SparkSession, path: str, table: str, chunks: DataFrame) -> "PostingsIndex":
        """The index of chunks, columns of the table's files: made at path if it isn't there for these files. Of two that make it at a
        time one is kept."""
        home = f"{path}-{store.fingerprint(spark, table)[:32]}"
        if not store.names(spark, f"{home}/manifest"):
            own = f"{home}-{spark.sparkContext.applicationId}"
            store.delete(spark, own)
            cls.create(spark, own, chunks)
            if not store.move(spark, own, home):
                store.delete(spark, own)
        return cls(spark, home)

    # --- reading ---

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """term, chunk_id, tf, dl (the chunk's length in tokens) of all chunks, or of the distinct terms of terms(term)."""
        segments = [s["id"] for s in self.state["segments"]]
        rows = self._read("terms", segments, _TERMS.format(self.state["id"]) + ", segment int, bucket int")
        if terms is not None:
            hit = [r[0] for r in terms.select(self._bucket()).distinct().collect()]  # a number a bucket at most
            rows = rows.filter(F.col("bucket").isin(hit)).join(terms, "term", "left_semi")
        return self._alive(rows, segments).select("term", "chunk_id", "tf", "dl")

    def chunks(self) -> DataFrame:
        """chunk_id and dl of all chunks."""
        segments = [s["id"] for s in self.state["segments"]]
        rows = self._read("chunks", segments, f"chunk_id {self.state['id']}, dl long, segment int").filter("dl IS NOT NULL")
        return self._alive(rows, segments).select("chunk_id", "dl")

    def statistics(self) -> DataFrame:
        """One row: n chunks, avgdl tokens a chunk. It is kept, not counted."""
        n, tokens = self.state["chunks"], self.state["tokens"]
        return self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(tokens / n if n else None).cast("double").alias("avgdl"))

    def _bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.state["buckets"])).cast("int").alias("bucket")

    def _read(self, kind: str, segments: list[int], schema: str) -> DataFrame:
        at = [f"{self.path}/{kind}/segment={s}" for s in segments]
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _alive(self, rows: DataFrame, segments: list[int]) -> DataFrame:
        """rows without those of chunks that later segments replaced or took out."""
        ids = {s["id"] for s in self.state["segments"] if s["dead"]}
        if not ids:
            return rows
        dead = self._read("dead", sorted(ids), f"chunk_id {self.state['id']}, held int, segment int").select("chunk_id", F.col("held").alias("segment"))
        return rows.join(dead.filter(F.col("segment").isin(segments)), ["chunk_id", "segment"], "left_anti")

    # --- writing ---

    def upsert(self, chunks: DataFrame) -> "PostingsIndex":
        """Take chunks in; those whose id is there already are replaced. An id that comes twice in one call is an error."""
        rows = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")).filter("chunk_id IS NOT NULL")
        tasks = self.spark.sparkContext.defaultParallelism
        if _bytes(chunks) < tasks * SPLIT_BYTES:
            rows = rows.repartition(tasks, "chunk_id")  # a small file is read by one task, which would cut all its tokens
        return self._add(rows, _bytes(chunks) // TOKEN_BYTES)

    def delete(self, ids: DataFrame) -> "PostingsIndex":
        """Take chunks out, by ids(chunk_id); ids that aren't there do nothing."""
        return self._add(ids.select("chunk_id").filter("chunk_id IS NOT NULL").distinct().withColumn("text", F.lit(None).cast("string")))

    def _add(self, rows: DataFrame, tokens: int = 0) -> "PostingsIndex":
        """Take in rows(chunk_id, text), with about so many tokens; those without a text go."""
        s, state = self.state["next"], dict(self.state)
        self._write_terms(_counted(rows).withColumn("bucket", self._bucket()), s, tokens)
        length = F.when(F.col("text").isNotNull(), T.token_count(F.col("text")))
        rows.select("chunk_id", length.alias("dl")).write.mode("overwrite").parquet(f"{self.path}/chunks/segment={s}")
        new = self._read("chunks", [s], f"chunk_id {state['id']}, dl long, segment int")
        n, distinct, there, total = new.agg(F.count("*"), F.count_distinct("chunk_id"), F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if n != distinct:
            raise ValueError("a chunk_id comes twice")
        dead = gone = 0
        if state["segments"]:
            segments = [x["id"] for x in state["segments"]]
            held = self._read("chunks", segments, f"chunk_id {state['id']}, dl long, segment int").filter("dl IS NOT NULL")
            old = self._alive(held, segments).join(new.select("chunk_id"), "chunk_id", "left_semi")
            old.select("chunk_id", F.col("segment").alias("held"), "dl").write.mode("overwrite").parquet(f"{self.path}/dead/segment={s}")
            dead, gone = self.spark.read.parquet(f"{self.path}/dead/segment={s}").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        state |= {"next": s + 1, "segments": [*state["segments"], {"id": s, "chunks": there, "dead": dead}], "chunks": state["chunks"] + there - dead, "tokens": state["tokens"] + total - gone}
        self._publish(state)
        return self.merge() if len(self.state["segments"]) >= MERGE_FROM else self

    def _write_terms(self, rows: DataFrame, s: int, tokens: int) -> None:
        """Postings with their bucket as a segment: a task sorts and writes one part, by chunk, of one bucket."""
        n = self.state["buckets"]
        salts = max(SALTS, -(-tokens // (n * TASK_TOKENS)))
        part = F.col("bucket") * salts + F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int")
        dealt = rows.select("term", "chunk_id", "tf", "dl", "bucket").repartitionById(n * salts, part).sortWithinPartitions("bucket", "term", "chunk_id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms/segment={s}")

    def merge(self, everything: bool = False) -> "PostingsIndex":
        """Make one segment of the smaller ones, those that are not half of all chunks, or of all; then delete what they were.

        Each chunk is thus rewritten a number of times that grows with the logarithm of the corpus."""
        state = dict(self.state)
        old = [x for x in state["segments"] if everything or 2 * x["chunks"] <= max(1, state["chunks"])]
        if len(old) < 2 and not (everything and old and (old[0]["dead"] or len(state["segments"]) > 1)):
            return self
        s, ids, rest = state["next"], [x["id"] for x in old], [x for x in state["segments"] if x not in old]
        live = self._alive(self._read("terms", ids, _TERMS.format(state["id"]) + ", segment int, bucket int"), ids)
        self._write_terms(live, s, state["tokens"])
        held = self._read("chunks", ids, f"chunk_id {state['id']}, dl long, segment int").filter("dl IS NOT NULL")
        self._alive(held, ids).select("chunk_id", "dl").write.mode("overwrite").parquet(f"{self.path}/chunks/segment={s}")
        n = self._read("chunks", [s], f"chunk_id {state['id']}, dl long, segment int").count()
        # what they replaced in segments that stay is dead there still
        kept = [x["id"] for x in rest]
        dead = 0
        if kept and any(x["dead"] for x in old):
            rows = self._read("dead", [x["id"] for x in old if x["dead"]], f"chunk_id {state['id']}, held int, dl long, segment int").filter(F.col("held").isin(kept))
            rows.select("chunk_id", "held", "dl").write.mode("overwrite").parquet(f"{self.path}/dead/segment={s}")
            dead = self.spark.read.parquet(f"{self.path}/dead/segment={s}").count()
        self._publish(state | {"next": s + 1, "segments": [*rest, {"id": s, "chunks": n, "dead": dead}]})
        for kind in ("terms", "chunks", "dead"):
            for x in ids:
                store.delete(self.spark, f"{self.path}/{kind}/segment={x}")
        return self

    def _publish(self, state: dict) -> None:
        version = self.state["version"] + 1
        store.write_new(self.spark, f"{self.path}/manifest/{version:09d}.json", json.dumps(state | {"version": version}))
        self.state = state | {"version": version}


def _counted(rows: DataFrame) -> DataFrame:
    """term, chunk_id, tf, dl of rows(chunk_id, text): a text's tokens are sorted and counted where it stands, before any exchange."""
    inner = lambda name, e: F.inline(F.array(F.struct(e.alias(name))))  # noqa: E731 - a generator of one row: computed once
    tokens = rows.filter("text IS NOT NULL").select("chunk_id", inner("tokens", F.sort_array(T.tokenize(F.col("text"))))).filter(F.size("tokens") > 0)
    first = F.filter(F.sequence(F.lit(1), F.size("tokens")), lambda i: (i == 1) | (F.get("tokens", i - 1) != F.get("tokens", i - 2)))
    firsts = tokens.select("chunk_id", "tokens", inner("firsts", first))
    nexts = F.concat(F.slice("firsts", 2, F.size("firsts")), F.array(F.size("tokens") + 1))
    terms = F.zip_with("firsts", nexts, lambda a, b: F.struct(F.get("tokens", a - 1).alias("term"), (b - a).cast("long").alias("tf")))
    return firsts.select("chunk_id", F.size("tokens").cast("long").alias("dl"), F.inline(terms))


def _bytes(df: DataFrame) -> int:
    """Size of a table by its plan's statistics, those of its files; counted, where the plan knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

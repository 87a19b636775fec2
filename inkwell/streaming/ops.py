"""Structured Streaming operators: task states, rate limits, counters, windows, first sights and bounded samples.

Each takes a streaming or batch DataFrame alike where its operations allow it. Event times are TIMESTAMP: NTZ columns
are cast, since watermarks need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Error codes by stage.
ERROR_CODES = {"DOWNLOAD": "DOWNLOAD_FAILED", "PARSING": "PARSE_FAILED", "REVIEW": "REVIEW_FAILED", "INDEXING": "INDEXING_FAILED"}
TERMINAL = ("SUCCEEDED", "FAILED", "REJECTED")
KEPT_SAMPLES = 500


def read_folder(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file by its folder and name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def error_code(stage):
    out = F.lit("UNKNOWN")
    for s, code in ERROR_CODES.items():
        out = F.when(stage == s, code).otherwise(out)
    return out


def limit_windows(requests: DataFrame, per: str = "60 seconds", most: int = 12, late: str = "10 minutes") -> DataFrame:
    """user_id, start, n and rejected of each tumbling window: what is over the limit is rejected."""
    r = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    if r.isStreaming:
        r = r.withWatermark("ts", late)
    return r.groupBy("user_id", F.window("ts", per)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("window.start").alias("start"), "n", F.greatest(F.col("n") - most, F.lit(0)).alias("rejected"))


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def first_sights(uploads: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Uploads whose content was not seen before within the watermark."""
    return uploads.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])


def _latest_state(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    best = state.get if state.exists else None
    retries = best[2] if best else 0
    for pdf in rows:
        for r in pdf.sort_values(["ts", "event_id"]).itertuples():
            if best is None or (r.ts.value, r.event_id) > (best[0], best[1]):
                retries += int(best is not None and best[3] == "FAILED" and r.status == "PENDING")
                best = (r.ts.value, int(r.event_id), retries, r.status)
    state.update(best)
    yield pd.DataFrame({"task_id": [key[0]], "event_id": [best[1]], "status": [best[3]], "retries": [best[2]]})


def task_states(events: DataFrame) -> DataFrame:
    """The latest state of each task and how often it was tried anew, as updates; state is one tuple a task.

    events: task_id, event_id, ts, status."""
    out = "task_id long, event_id long, status string, retries long"
    e = events.select("task_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "status")
    return e.groupBy("task_id").applyInPandasWithState(_latest_state, out, "at long, event_id long, retries long, status string", "update", "NoTimeout")


def _last_samples(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    kept = list(zip(*state.get)) if state.exists else []
    for pdf in rows:
        kept += [(r.ts.value, int(r.event_id), float(r.value)) for r in pdf.itertuples()]
        kept = sorted(kept)[-KEPT_SAMPLES:]
    state.update(tuple(map(list, zip(*kept))))
    v = sorted(x for *_, x in kept)
    n = len(v)
    at = lambda q: v[min(n - 1, int(n * q))]
    yield pd.DataFrame({"event_type": [key[0]], "n": [n], "mean_v": [sum(v) / n], "p50": [at(0.5)], "p95": [at(0.95)], "min_v": [v[0]], "max_v": [v[-1]]})


def latency(events: DataFrame) -> DataFrame:
    """Statistics of the last samples of each name, as updates; state is those samples."""
    out = "event_type string, n long, mean_v double, p50 double, p95 double, min_v double, max_v double"
    e = events.select("event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return e.groupBy("event_type").applyInPandasWithState(_last_samples, out, "ts array<long>, id array<long>, v array<double>", "update", "NoTimeout")


def ingest(stream: DataFrame, sink: str, checkpoint: str, transform=lambda batch: batch, key: str = "document_id") -> None:
    """Take what is there, batch by batch, into a Parquet folder by batch number: a batch that is run again
    overwrites what it wrote before, so each row is stored once."""

    def store(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""State machines over streams, by transformWithState: staged tasks with time-outs, and the folding of long conversations.

Both also run over a batch, where state lives for the run: that is their twin. They choose the RocksDB state store, the only
one that holds such state. Per key the state is a row, or the messages since the last fold, so it does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ops import ERROR_CODES

# Progress that a task has reached when a stage begins, and the length of an error's text.
STAGE_PROGRESS = {"DOWNLOAD": 0, "PARSING": 5, "OCR": 40, "CHUNKING": 60, "EMBEDDING": 75, "INDEXING": 90, "REVIEW": 100}
ERROR_CHARS = 500
# Messages over which a conversation is folded, messages that stay as they are.
FOLD_OVER, FOLD_KEEP = 14, 8

_TASK = "status string, stage string, progress long, error_code string, error_message string, retry_count long, refused long, event_id long, at long"
_MESSAGE = "place long, role string, content string"


def stateful(spark: SparkSession) -> None:
    """Choose the state store that transformWithState needs, for what starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.streams.active  # a session without a stream yet has no coordinator of state stores, which a batch needs as well


def advance(task: dict | None, event) -> dict:
    """The task after an event: CREATED, STAGE (stage), SUCCEEDED, REJECTED, FAILED (error) or RETRY.

    A stage keeps the task PENDING and sets its progress. An error is coded by the stage it came in, its text cut. Only a
    FAILED task is tried anew: it loses stage, progress and error text, and its count goes up. What doesn't fit the status is refused and counted."""
    t = dict(task) if task else {"status": "PENDING", "stage": "", "progress": 0, "error_code": None, "error_message": "", "retry_count": 0, "refused": 0}
    kind, open_ = event.kind, t["status"] == "PENDING"
    if kind == "STAGE" and open_:
        t |= {"stage": event.stage, "progress": STAGE_PROGRESS.get(event.stage, t["progress"]), "error_message": ""}
    elif kind == "SUCCEEDED" and open_:
        t |= {"status": kind, "stage": "DONE", "progress": 100, "error_message": ""}
    elif kind == "REJECTED" and open_:
        t |= {"status": kind, "stage": "REVIEW", "progress": 100, "error_message": ""}
    elif kind in ("FAILED", "TIMEOUT") and open_:
        code = "TIMEOUT" if kind == "TIMEOUT" else ERROR_CODES.get(t["stage"], "UNKNOWN")
        t |= {"status": "FAILED", "error_code": code, "error_message": (event.error or "")[:ERROR_CHARS]}
    elif kind == "RETRY" and t["status"] == "FAILED":
        t |= {"status": "PENDING", "stage": "", "progress": 0, "error_message": "", "retry_count": t["retry_count"] + 1}
    elif kind != "CREATED" or task:
        t["refused"] += 1
    return t | {"event_id": event.event_id, "at": event.at}


class _Tasks(StatefulProcessor):
    def __init__(self, patience_ms: int | None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.task = handle, handle.getValueState("task", _TASK)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        task = self.task.get()
        task = dict(zip(_FIELDS, task)) if task else None
        for event in sorted(rows, key=lambda r: (r.at, r.event_id)):
            if task is None or (event.at, event.event_id) > (task["at"], task["event_id"]):  # older ones came too late
                task = advance(task, event)
        yield from self._keep(key, task)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        task = dict(zip(_FIELDS, self.task.get()))
        if task["status"] == "PENDING":
            late = Row(kind="TIMEOUT", stage=None, error=f"no event for {self.patience // 1000} s", event_id=task["event_id"], at=task["at"])
            yield from self._keep(key, advance(task, late))

    def _keep(self, key, task: dict) -> Iterator[Row]:
        self.task.update(tuple(task[f] for f in _FIELDS))
        if self.patience is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if task["status"] == "PENDING":
                self.handle.registerTimer(task["at"] + self.patience)
        yield Row(task_id=key[0], **{f: task[f] for f in _FIELDS})

    def close(self) -> None:
        pass


_FIELDS = [c.split()[0] for c in _TASK.split(", ")]


def staged_tasks(events: DataFrame, patience: int | None = None, late: str = "10 minutes") -> DataFrame:
    """State of each task after its events, as updates: task_id, status, stage, progress, error_code, error_message, retry_count,
    refused, event_id (the last one), at (its time in milliseconds).

    events: task_id, event_id, ts, kind, stage, error. With patience (seconds) a PENDING task is FAILED, code TIMEOUT, once the
    watermark is that far past its last event. Events older than a task's last one are left out; so are those without a task or time."""
    stateful(events.sparkSession)
    ts = F.col("ts").cast("timestamp")
    e = events.filter("task_id IS NOT NULL AND ts IS NOT NULL").select("task_id", "event_id", "kind", "stage", "error", F.unix_millis(ts).alias("at"), ts.alias("ts"))
    if e.isStreaming and patience is not None:
        e = e.withWatermark("ts", late)
    timed = "EventTime" if e.isStreaming and patience is not None else "None"
    kind = e.schema["task_id"].dataType.simpleString()
    return e.groupBy("task_id").transformWithState(statefulProcessor=_Tasks(patience * 1000 if timed == "EventTime" else None), outputStructType=f"task_id {kind}, {_TASK}", outputMode="Update", timeMode=timed)


class _Fold(StatefulProcessor):
    def __init__(self, over: int, keep: int, ttl_ms: int | None):
        self.over, self.kept, self.ttl = over, keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", _MESSAGE, self.ttl)
        self.folds = handle.getValueState("folds", "n long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(m) for m in self.messages.get()] if self.messages.exists() else []
        n = self.folds.get()[0] if self.folds.exists() else 0
        held = sorted(held + [(r.place, r.role, r.content) for r in rows])
        old = [m for m in held[: -self.kept] if m[1] != "system"] if len(held) > self.over else []
        if old:
            n += 1
            held = [m for m in held[: -self.kept] if m[1] == "system"] + held[-self.kept :]
            self.folds.update((n,))
            yield Row(conv_id=key[0], fold=n, first_place=old[0][0], last_place=old[-1][0], n_folded=len(old), folded="\n".join(f"{r}: {c}" for _, r, c in old))
        self.messages.put(held)

    def close(self) -> None:
        pass


def fold_conversations(messages: DataFrame, over: int = FOLD_OVER, keep: int = FOLD_KEEP, ttl: int | None = None) -> DataFrame:
    """What of each conversation is to be summed up: conv_id, fold (its number), first_place, last_place, n_folded, folded (role: text, a line each).

    messages: conv_id, place, role, content. A conversation of over `over` messages keeps the last `keep`; older ones, but for the
    system's, leave the state as one fold. Folding is anew after each batch of a stream. State that is not touched for ttl seconds goes."""
    stateful(messages.sparkSession)
    m = messages.filter("conv_id IS NOT NULL").select("conv_id", F.col("place").cast("long").alias("place"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    kind = m.schema["conv_id"].dataType.simpleString()
    timed = ttl is not None and m.isStreaming
    return m.groupBy("conv_id").transformWithState(statefulProcessor=_Fold(over, keep, ttl * 1000 if timed else None), outputStructType=f"conv_id {kind}, fold long, first_place long, last_place long, n_folded long, folded string", outputMode="Append", timeMode="ProcessingTime" if timed else "None")

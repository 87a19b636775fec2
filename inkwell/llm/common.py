"""Helpers shared by the operators: shared-folder tables, words and Arrow columns."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Java pattern of a word: a run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch on its way to Python, about: what a worker holds of its input at a time.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets one of its own; on a
    cluster, whose machines share no temporary folder, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: a short lineage that
    survives lost executors, and one computation however often it is read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkwell_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in the store that its path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    path = getattr(df, "_inkwell_path", None)
    if path:
        delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished steps now, not whenever the driver
    happens to collect garbage: they would be kept beside the tables that replaced them."""
    gc.collect()
    spark._jvm.System.gc()


_MEMOS: list["Memo"] = []


class Memo(dict):
    """make(key) for keys that recur. At the limit the entries become the older generation, which keys that
    are asked for again leave for the new one: so memory is bounded, and what is frequent stays, until the task ends."""

    def __init__(self, make: Callable, limit: int):
        self.make, self.limit, self.older = make, limit, {}
        _MEMOS.append(self)

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, key):
        found = self.older[key] if key in self.older else self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def _trim() -> None:
    """Empty this worker's memos and give its free memory back: it serves other tasks later, beside other workers."""
    for m in _MEMOS:
        m.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def keep_heap() -> None:
    """Let this worker keep up to 32 MB of free heap and take arrays of up to 4 MB from it: those of a training step come
    and go a thousand times a second, and new pages for each cost a third of its time."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
    except AttributeError:  # another C library
        pass


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded bytes, whose workers give free memory back."""

    def trimmed(batches):
        gc.disable()  # rows are built without cycles, and looking for them takes a tenth of the time
        try:
            yield from run(batches)
        finally:
            gc.enable()
            _trim()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(trimmed, schema)


def text_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of each text, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def text_strings(column: pa.Array) -> list:
    """Each text as str, None for null; bytes that are not UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in text_bytes(column)]

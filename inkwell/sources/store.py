"""The shared folder: where tables that outlive a query stand, and small files beside them."""

from __future__ import annotations

import hashlib
import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets one of its own; on a cluster,
    whose machines share no temporary folder, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Whether path now stands at to; not, if something stood there."""
    fs, p = _at(spark, path)
    _, q = _at(spark, to)
    return not fs.exists(q) and bool(fs.rename(p, q))


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    source = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that does not exist; one that does is an error."""
    fs, p = _at(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files: another one as soon as the table is written anew."""
    fs, p = _at(spark, path)
    files = fs.listStatus(p)
    return hashlib.sha256("\n".join(sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in files)).encode()).hexdigest()

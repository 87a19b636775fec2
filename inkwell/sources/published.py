"""Tables that are published: written beside what is read, verified, then switched to by a manifest.

A table's rows stand in buckets of their key; a manifest names the folder of each bucket. publish() writes all
buckets anew, sync() only those of documents whose stored and wanted row counts differ. The manifest is written last,
under a number that must be new: a step that fails before it changes nothing for readers, and of two writers one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store

BUCKETS = 64


class VerificationError(ValueError):
    """What was written isn't what was to be written; the table is as it was."""


class Published:
    def __init__(self, spark: SparkSession, path: str, key: str = "document_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[int, dict]:
        """Number and content of the manifest that holds; 0 and no buckets before the first."""
        found = store.names(self.spark, f"{self.path}/manifest")
        if not found:
            return 0, {"buckets": {}, "schema": None}
        return int(found[-1].split(".")[0]), json.loads(store.read_text(self.spark, f"{self.path}/manifest/{found[-1]}"))

    def _switch(self, number: int, state: dict) -> None:
        store.write_new(self.spark, f"{self.path}/manifest/{number + 1:09d}.json", json.dumps(state))

    def _at(self, state: dict, only=None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.path}/data/{folder}/_bucket={b}" for b, folder in state["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows of the table as it is now; an error before the first publish."""
        state = self.manifest()[1]
        if state["schema"] is None:
            raise FileNotFoundError(f"nothing is published at {self.path}")
        return self._at(state)

    def _write(self, rows: DataFrame) -> str:
        """The folder of rows, written by bucket; large buckets become several files."""
        folder = uuid.uuid4().hex
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        return folder

    def _written(self, folder: str) -> dict:
        return {n.split("=")[1]: folder for n in store.names(self.spark, f"{self.path}/data/{folder}") if n.startswith("_bucket=")}

    def counts(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n"))

    def _verify(self, rows: DataFrame, expected: DataFrame, vector: str | None, dims: int | None) -> None:
        """rows have the expected(key, n) of each key and no other, and vectors of dims components."""
        want = expected.select(F.col(self.key).alias("_key"), F.col("n").alias("_want"))
        j = self.counts(rows).join(want, F.col(self.key) == F.col("_key"), "full_outer")
        wrong = j.filter(~F.col("n").eqNullSafe(F.col("_want"))).agg(F.count(F.lit(1)), F.min(F.coalesce(self.key, "_key"))).first()
        if wrong[0]:
            raise VerificationError(f"{wrong[0]} keys have other row counts than expected, the first is {wrong[1]}")
        if vector and (n := rows.filter(F.coalesce(F.size(vector), F.lit(-1)) != dims).count()):
            raise VerificationError(f"{n} vectors have not {dims} components")

    def _staged(self, rows: DataFrame, schema: StructType, expected: DataFrame, vector=None, dims=None) -> dict:
        """Buckets of rows once they are written and verified; what fails is deleted."""
        folder = self._write(rows)
        try:
            found = self._written(folder)
            self._verify(self._at({"schema": schema.jsonValue(), "buckets": found}), expected, vector, dims)
        except BaseException:
            store.delete(self.spark, f"{self.path}/data/{folder}")
            raise
        return found

    def publish(self, rows: DataFrame, expected: DataFrame, vector: str | None = None, dims: int | None = None) -> None:
        """Make rows the table, if they have the expected(key, n) row counts, and vectors of dims components where a
        column is named. Else VerificationError, and the table stays as it was."""
        number, _ = self.manifest()
        self._switch(number, {"schema": rows.schema.jsonValue(), "buckets": self._staged(rows, rows.schema, expected, vector, dims)})

    def stale(self, fresh: DataFrame) -> DataFrame:
        """key, n of the documents in fresh whose stored row count is another."""
        stored = self.counts(self.read()).select(F.col(self.key).alias("_key"), F.col("n").alias("_n"))
        j = self.counts(fresh).join(stored, F.col(self.key) == F.col("_key"), "left")
        return j.filter(~F.col("n").eqNullSafe(F.col("_n"))).select(self.key, "n")

    def sync(self, fresh: DataFrame, batch: int = 16) -> int:
        """Replace the rows of stale documents by those in fresh; the number of these documents. Buckets without one are
        not read or written; the others go `batch` at a time, each batch verified and switched to by itself, so a
        run that was cut off goes on where it stopped, and a second run changes nothing."""
        number, state = self.manifest()
        schema = StructType.fromJson(state["schema"])
        todo = f"{self.path}/stale/{uuid.uuid4().hex}"
        self.stale(fresh).withColumn("_bucket", self._bucket()).write.parquet(todo)
        stale = self.spark.read.parquet(todo)
        per = {r["_bucket"]: r["count"] for r in stale.groupBy("_bucket").count().collect()}  # a row a bucket
        fresh = fresh.select(*schema.names)
        for i in range(0, len(per), batch):
            only = sorted(per)[i : i + batch]
            gone, old = stale.filter(F.col("_bucket").isin(only)), self._at(state, set(only))
            kept = old.join(gone, self.key, "left_anti")
            expected = self.counts(kept).unionByName(gone.select(self.key, "n"))
            found = self._staged(kept.unionByName(fresh.join(gone, self.key, "left_semi")), schema, expected)
            state = {**state, "buckets": {**{b: f for b, f in state["buckets"].items() if int(b) not in only}, **found}}
            self._switch(number, state)
            number += 1
        store.delete(self.spark, todo)
        return sum(per.values())

    def vacuum(self) -> None:
        """Delete the folders that the manifest doesn't name, once no one reads or writes an earlier state."""
        named = set(self.manifest()[1]["buckets"].values())
        for folder in store.names(self.spark, f"{self.path}/data"):
            if folder not in named:
                store.delete(self.spark, f"{self.path}/data/{folder}")

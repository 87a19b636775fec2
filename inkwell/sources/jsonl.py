"""JSON lines with a quarantine, and appending that goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def examined(lines: DataFrame, schema: str, key: str = "id", filled=(), at_least: dict | None = None) -> DataFrame:
    """lines(value) with a column for each member in schema, and faults: empty where a line is good. Blank lines are left out.

    Faults, in this order: not_json; no_<key> (missing, null or blank); blank_<c> of columns in `filled`;
    few_<c> and repeated_<c> of arrays in at_least with fewer entries than asked, or with equal ones;
    duplicate_<key>: of each line of a key that several lines have. Other columns of lines stay."""
    fields = StructType.fromDDL(schema)
    j = lines.filter(T.strip(F.col("value")) != "").withColumn("_j", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    torn = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull()
    x = j.select(*lines.columns, torn.alias("_torn"), *[F.when(~torn, F.col(f"_j.`{n}`")).alias(n) for n in fields.names])
    blank = lambda c: F.coalesce(T.strip(F.col(c).cast("string")), F.lit("")) == ""
    again = x.filter(~blank(key)).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    x = x.join(again, F.col(key) == F.col("_key"), "left")
    found = [F.when(blank(key), f"no_{key}")]
    found += [F.when(blank(c), f"blank_{c}") for c in filled]
    for c, n in (at_least or {}).items():
        found += [F.when(F.coalesce(F.size(c), F.lit(-1)) < n, f"few_{c}"), F.when(F.size(F.array_distinct(c)) < F.size(c), f"repeated_{c}")]
    found.append(F.when(F.col("_n").isNotNull(), f"duplicate_{key}"))
    faults = F.when(F.col("_torn"), F.array(F.lit("not_json"))).otherwise(F.array_compact(F.array(*found)))
    return x.select(*lines.columns, *fields.names, faults.alias("faults"))


def read(spark: SparkSession, path: str, schema: str, **rules) -> tuple[DataFrame, DataFrame]:
    """(good rows of the schema, quarantine: path, value, faults) of JSON lines files; rules as of examined()."""
    found = examined(spark.read.text(path).withColumn("path", F.col("_metadata.file_path")), schema, **rules)
    good = found.filter(F.size("faults") == 0).select(*StructType.fromDDL(schema).names)
    return good, found.filter(F.size("faults") > 0).select("path", "value", "faults")


def append_missing(spark: SparkSession, path: str, rows: DataFrame, key: str = "id") -> DataFrame:
    """Append the rows whose key isn't in the JSON lines at path yet, and return all: a run that was cut off is run again.
    Files are committed whole, so a task that dies leaves no half of a line."""
    from .store import names

    new = rows
    if any(n.startswith("part-") for n in names(spark, path)):
        new = rows.join(spark.read.schema(rows.schema).json(path).select(key).distinct(), key, "left_anti").select(*rows.columns)
    new.write.mode("append").json(path)
    return spark.read.schema(rows.schema).json(path)

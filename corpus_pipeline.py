"""From documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import WORD, cut, drop_cut, table
from inkwell.llm.jaccard import jaccard_join
from inkwell.llm.mixing import mix
from inkwell.llm.packing import pack
from inkwell.llm.quality import fit_field, quality
from inkwell.llm.secrets import find_secrets_in

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, a hash of each row that is never null; rows with the same key are equal in all columns."""
    return docs.select(*COLUMNS, F.xxhash64(*[x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]).alias("_key"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line field keep: rows as they are, repeated ones each. Null and
    empty texts have no words, so they go; an empty table stays empty; columns past those of documents are left out, here as in
    all stages."""
    field = fit_field(docs, table(spark, sf_dir, "labels"))
    return quality(docs, field, keep=COLUMNS).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 5-word shingles at a Jaccard of 0.8: that of the least id, null last.
    Rows that repeat an id and rows without one are documents of their own; texts without words link with nothing and all stay."""
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = keyed(docs.filter(worded))
    groups = jaccard_join(rows, id_col="_key", n=5, num=8, den=10).result().select(F.col("doc_id").alias("_key"), "component_id")
    ids = rows.select("_key", "doc_id").join(groups.distinct(), "_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first")
    firsts = ids.groupBy("component_id").agg(first).select(F.col("first._key").alias("_key"))
    kept = rows.dropDuplicates(["_key"]).join(firsts, "_key", "left_semi").select(*COLUMNS)
    return kept.unionByName(docs.filter(~worded).select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span masked and n_chars of the text as it is now: row by row, so repeated rows stay
    equal. A null text stays null, with n_chars 0; an empty table stays empty."""
    return find_secrets_in(docs.select(*COLUMNS)).select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.coalesce(F.length("redacted"), F.lit(0)).cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; equal rows as often as it takes them together. A null source is a source of its
    own, a null text has size 0; an empty table stays empty."""
    rows = keyed(docs)
    copies = mix(rows, id_col="_key").groupBy("_key").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    taken = rows.dropDuplicates(["_key"]).join(copies, "_key")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids, of every row: a null text has its end id alone, repeated rows are
    packed each, an empty table has no pieces."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("packing", sequence_packing),
]

#: SQL can't express the line field, the lexer, the cube method or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the table of documents; what each keeps is written before the next reads it, and deleted after."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name.split()[0])
        drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)

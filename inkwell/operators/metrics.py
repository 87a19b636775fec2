"""Metrics of ranked lists and graded answers, as one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def single_relevant(runs: DataFrame, qrels: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Per question: first_rank (0: none), rr, and recall and precision at each k.

    runs(question_id, rank, document_id), qrels(question_id, document_id): one document each. Precision divides by
    k even if fewer were returned. Ratios are rounded to 4 places."""
    j = qrels.select("question_id", F.col("document_id").alias("expected")).join(runs, "question_id", "left")
    right = F.col("document_id") == F.col("expected")
    first = F.min(F.when(right, F.col("rank")))
    cols = [F.coalesce(first, F.lit(0)).alias("first_rank"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 4).alias("rr")]
    for k in ks:
        found = F.count(F.when(right & (F.col("rank") <= k), 1))
        cols += [(found > 0).cast("double").alias(f"recall_{k}"), F.round(found / k, 4).alias(f"precision_{k}")]
    return j.groupBy("question_id").agg(*cols)


def multi_relevant(runs: DataFrame, qrels: DataFrame, ks=(3, 5)) -> DataFrame:
    """Per question with one expected document or more: first_rank, rr, and coverage and all-found at each k."""
    n = qrels.groupBy("question_id").agg(F.countDistinct("document_id").alias("n_expected"))
    found = runs.join(qrels, ["question_id", "document_id"], "left_semi")
    j = n.join(found, "question_id", "left")
    cols = [F.coalesce(F.min("rank"), F.lit(0)).alias("first_rank"), F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 4).alias("rr")]
    for k in ks:
        hit = F.countDistinct(F.when(F.col("rank") <= k, F.col("document_id")))
        cols += [F.round(hit / F.col("n_expected"), 4).alias(f"coverage_{k}"), (hit == F.col("n_expected")).cast("double").alias(f"all_docs_{k}")]
    return j.groupBy("question_id", "n_expected").agg(*cols)


def means(per_question: DataFrame, columns, by=()) -> DataFrame:
    """The mean of each column, rounded to 4 places; 0 of no rows."""
    return per_question.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in columns])


def share(condition: Column) -> Column:
    """Share of rows of a group that hold a condition, rounded to 4 places."""
    return F.round(F.avg(condition.cast("double")), 4)


def indexed_percentile(values: str, q: float) -> Column:
    """sorted[min(n - 1, int(n * q))] of a group's values: no interpolation."""
    s = F.array_sort(F.collect_list(values))
    return F.element_at(s, F.least(F.size(s), F.floor(F.size(s) * F.lit(q)).cast("int") + 1))

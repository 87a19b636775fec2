"""Comparisons of runs: grids of parameters, two ways to answer, single pass against agent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sweep(runs: DataFrame, qrels: DataFrame, grid: DataFrame) -> DataFrame:
    """dimension, value, recall_1, recall_3, mrr, delta, is_best and best_is_current for each row of grid.

    runs(dimension, value, question_id, document_id, rank), qrels(question_id, document_id): one relevant document a
    question; grid(dimension, value, position, is_current). A question without its document counts 0, and so does
    a setting without runs. delta: recall_1 less that of the dimension's current value; best: greatest recall_1, then
    mrr, then the first of the grid."""
    n = qrels.select("question_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    hit = runs.join(qrels, ["question_id", "document_id"]).groupBy("dimension", "value", "question_id").agg(F.min("rank").alias("r"))
    per = hit.groupBy("dimension", "value").agg(F.count_if(F.col("r") <= 1).alias("a"), F.count_if(F.col("r") <= 3).alias("b"), F.sum(1.0 / F.col("r")).alias("c"))
    all_of = F.broadcast(n)  # one row
    mean = lambda c: F.coalesce(F.round(F.try_divide(F.coalesce(c, F.lit(0)), "n"), 4), F.lit(0.0))
    s = grid.join(per, ["dimension", "value"], "left").join(all_of).select("dimension", "value", "position", "is_current", mean("a").alias("recall_1"), mean("b").alias("recall_3"), mean("c").alias("mrr"))
    of = Window.partitionBy("dimension")
    best = F.row_number().over(of.orderBy(F.col("recall_1").desc(), F.col("mrr").desc(), "position")) == 1
    s = s.withColumn("is_best", best).withColumn("delta", F.round(F.col("recall_1") - F.max(F.when(F.col("is_current"), F.col("recall_1"))).over(of), 4))
    return s.withColumn("best_is_current", F.bool_or(F.col("is_best") & F.col("is_current")).over(of)).drop("position", "is_current")


def clarification(records: DataFrame) -> DataFrame:
    """Per path: questions, accuracy and faithfulness (mean of those judged, and how many are), answerable ones and their
    rate, the share of questions whose gate was triggered, and reasons: how many questions have each, as a map.

    records(path, question_id, accuracy, faithfulness, answerable, gate_triggered, gate_reason); a null reason is "none"."""
    n = F.count(F.lit(1))
    rate = lambda c: F.round(F.count_if(c) / n, 4)
    out = records.groupBy("path").agg(n.alias("questions"), F.round(F.avg("accuracy"), 4).alias("accuracy_mean"), F.count("accuracy").alias("accuracy_judged"), F.round(F.avg("faithfulness"), 4).alias("faithfulness_mean"), F.count("faithfulness").alias("faithfulness_judged"), F.count_if("answerable").alias("answerable"), rate(F.col("answerable")).alias("answerable_rate"), rate(F.col("gate_triggered")).alias("clarification_rate"))
    per = records.groupBy("path", F.coalesce("gate_reason", F.lit("none")).alias("reason")).agg(n.alias("n"))
    reasons = per.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    return out.join(reasons, "path")


def attribution(expected: DataFrame, single: DataFrame, agent: DataFrame) -> DataFrame:
    """Per question of expected: documents found by the single pass and by the agent (n_single, n_agent), recovered by
    the agent alone, residual that neither found, n_extra that the agent found besides, and whether it found all.

    All three: question_id, document_id; repeated rows count once. The sets meet in a full outer join, so documents that only
    one of them holds stay to be counted."""
    key = ["question_id", "document_id"]
    mark = lambda d, name: d.select(*key).distinct().withColumn(name, F.lit(True))
    j = mark(expected, "e").join(mark(single, "s"), key, "full_outer").join(mark(agent, "a"), key, "full_outer")
    e, s, a = (F.coalesce(c, F.lit(False)) for c in ("e", "s", "a"))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("document_id"))))
    out = j.groupBy("question_id").agg(F.count_if(e).alias("n_expected"), F.count_if(e & s).alias("n_single"), F.count_if(e & a).alias("n_agent"), listed(e & ~s & a).alias("recovered"), listed(e & ~s & ~a).alias("residual"), F.count_if(~e & a).alias("n_extra"))
    return out.filter("n_expected > 0").withColumn("evidence_all", F.col("n_agent") == F.col("n_expected"))


def attribution_totals(per_question: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: n, closure (share of questions with all evidence), n_closed, recovered, residual, mean tool calls.
    calls(question_id, tool_calls); a question without a row made none."""
    j = per_question.join(calls, "question_id", "left")
    share = lambda c, places: F.coalesce(F.round(F.avg(c), places), F.lit(0.0))
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return j.agg(F.count(F.lit(1)).alias("n"), share(F.col("evidence_all").cast("double"), 4).alias("closure"), F.count_if("evidence_all").alias("n_closed"), size("recovered").alias("recovered"), size("residual").alias("residual"), share(F.coalesce("tool_calls", F.lit(0)), 2).alias("mean_tool_calls"))


#: What a summary of a variant's runs holds.
MEASURES = ("recall_1", "recall_3", "mrr", "precision_1", "precision_3")


def summaries(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """variant and MEASURES, means over all questions of qrels(question_id, document_id), of runs(variant, question_id,
    document_id, rank). Recall counts questions with a hit; a question that a variant did not answer counts 0."""
    n = F.broadcast(qrels.select("question_id").distinct().agg(F.count(F.lit(1)).alias("n")))  # one row
    hits = runs.join(qrels.distinct(), ["question_id", "document_id"])
    per = hits.groupBy("variant", "question_id").agg(F.min("rank").alias("r"), F.count_if(F.col("rank") <= 1).alias("p1"), F.count_if(F.col("rank") <= 3).alias("p3"))
    sums = per.groupBy("variant").agg(F.count_if(F.col("r") <= 1).alias("recall_1"), F.count_if(F.col("r") <= 3).alias("recall_3"), F.sum(1.0 / F.col("r")).alias("mrr"), F.sum("p1").alias("precision_1"), (F.sum("p3") / 3).alias("precision_3"))
    all_of = runs.select("variant").distinct().join(sums, "variant", "left").join(n)
    return all_of.select("variant", *[F.coalesce(F.round(F.try_divide(F.coalesce(m, F.lit(0)), "n"), 4), F.lit(0.0)).alias(m) for m in MEASURES])


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """variant, and before, after and delta of each of MEASURES, of the variants that both before and after hold."""
    name = lambda d, when: d.select("variant", *[F.col(m).alias(f"{m}_{when}") for m in MEASURES])
    j = name(before, "before").join(name(after, "after"), "variant")
    return j.select("variant", *[c for m in MEASURES for c in (f"{m}_before", f"{m}_after", F.round(F.col(f"{m}_after") - F.col(f"{m}_before"), 4).alias(f"{m}_delta"))])

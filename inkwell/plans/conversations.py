"""Queries of conversations: order, history, folding, listings and traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import retrieval as R
from ..registry import query
from ..sources.tables import load


def _messages(spark, d):
    return load(spark, d, "conversations")


@query("message_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn) AS place FROM conversations")
def message_order(spark, d):
    """By time (pairs of turns share one), user before assistant before others."""
    role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    w = Window.partitionBy("conv_id").orderBy(F.floor(F.col("turn") / 2), role, "turn")
    return _messages(spark, d).select("conv_id", "turn", F.row_number().over(w).alias("place"))


@query("recent_messages", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def recent_messages(spark, d):
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return _messages(spark, d).withColumn("k", k).filter("k <= 4").select("conv_id", "turn", "role")


@query("history_budget", "WITH m AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens FROM conversations WHERE trim(text) <> ''), r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM m) SELECT conv_id, turn, tokens, CAST(used AS BIGINT) AS used FROM r WHERE k = 1 OR used <= 120")
def history_budget(spark, d):
    """The newest messages within a token budget; the newest always, blank ones never."""
    m = _messages(spark, d).filter("trim(text) != ''").select("conv_id", "turn", (-F.col("turn")).alias("rank"), T.estimate_tokens(F.col("text")).alias("tokens"))
    return R.within_budget(m, 120, by="conv_id").select("conv_id", "turn", "tokens", "used")


@query("fold_candidates", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, count(*) AS n_folded, string_agg(role || ': ' || substr(text, 1, 40), chr(10) ORDER BY turn) AS folded FROM r WHERE n > 4 AND k > 2 AND role <> 'system' GROUP BY conv_id")
def fold_candidates(spark, d):
    """Of conversations over a length, what lies before the last messages, to be summed up; thresholds fit these short ones."""
    w = Window.partitionBy("conv_id")
    r = _messages(spark, d).withColumn("k", F.row_number().over(w.orderBy(F.col("turn").desc()))).withColumn("n", F.count(F.lit(1)).over(w))
    old = r.filter("n > 4 and k > 2 and role != 'system'").withColumn("part", F.concat("role", F.lit(": "), F.substring("text", 1, 40)))
    return old.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_folded"), D.joined("turn", "part", "\n").alias("folded"))


@query("conversation_list", "SELECT conv_id, count(*) AS n_messages, substr(max_by(text, turn), 1, 60) AS preview FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def conversation_list(spark, d):
    return _messages(spark, d).filter("role != 'system'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.substring(F.max_by("text", "turn"), 1, 60).alias("preview"))


@query("conversation_traces", "SELECT m.conv_id, m.turn, e.event_id, e.event_type AS tool, row_number() OVER (PARTITION BY m.conv_id, m.turn ORDER BY e.event_id) AS step FROM conversations m JOIN events e ON e.user_id = m.conv_id AND e.event_id % 8 = m.turn WHERE m.role = 'assistant'")
def conversation_traces(spark, d):
    """Answers with their tool steps in order."""
    m = _messages(spark, d).filter("role = 'assistant'").select("conv_id", "turn")
    e = load(spark, d, "events").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 8).alias("turn"), "event_id", F.col("event_type").alias("tool"))
    w = Window.partitionBy("conv_id", "turn").orderBy("event_id")
    return m.join(e, ["conv_id", "turn"]).withColumn("step", F.row_number().over(w))


@query("token_usage", "SELECT role, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS generated FROM conversations GROUP BY role")
def token_usage(spark, d):
    return _messages(spark, d).groupBy("role").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.when(F.col("role") == "assistant", F.floor(F.length("text") / 4)).otherwise(0)).alias("generated"))

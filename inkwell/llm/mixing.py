"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times and one copy more
of some, each with inclusion probability r - floor(r). Which ones is decided by balanced
sampling: a flight moves the probabilities along directions that keep both the number of
documents and the number of words, until each but a few is 0 or 1. It runs in blocks of a
bounded number of documents; what is left of a block flies again with the rest of other blocks,
level by level, until one block is left in each source, where a landing over all roundings of
its last probabilities picks that with the least error.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Documents of a block, at most some percent over: what one task holds at a time.
BLOCK = 16_384
_SPARE = 2  # what a flight with two constraints leaves at most


def word_count(text):
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n_docs, source_size and target of each source of sizes(source, size).

    Sources by code point, null last, weigh weights, repeating; their targets are share of all
    sizes by weight, but none over most times its source's size: what is over goes to the others
    by weight. That is a water level: sources with the least size for their weight are full first.
    One row a source meets in one task, never a row a document.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(listed) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(F.lit(0))
    per = (
        per.withColumn("total", F.sum("source_size").over(all_of) * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    # the level if this source and all later ones are not full; it falls with each source taken as full that is not, so the most that holds is right
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    open_level = F.when(level * F.col("weight") <= F.col("cap"), level)
    per = per.withColumn("level", F.max(open_level).over(all_of))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def fly(p: list[float], s: list[int]) -> list[float]:
    """Cube flight in place: moves p within [0, 1], keeping sum(p) and sum(p * s), until at most two are
    strictly between. At each step three open units move along their null vector to the nearer
    face (of two equally near, the forward one), so equal inputs give equal results."""
    eps = 1e-9
    open_: list[int] = []
    for i in range(len(p)):
        if p[i] < eps or p[i] > 1 - eps:
            p[i] = round(p[i])
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        # null vector of the rows (1, 1, 1) and (s_a, s_b, s_c)
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = down = float("inf")
        for j, d in zip(open_, u):
            if d > 0:
                up, down = min(up, (1 - p[j]) / d), min(down, p[j] / d)
            elif d < 0:
                up, down = min(up, p[j] / -d), min(down, (1 - p[j]) / -d)
        step = up if up <= down else -down
        for j, d in zip(open_, u):
            p[j] += step * d
            if p[j] < eps or p[j] > 1 - eps:
                p[j] = float(round(p[j]))
        open_ = [j for j in open_ if 0 < p[j] < 1]
    return p


def settle(p: list[float], s: list[int], rows: list[int]) -> list[float]:
    """The end of a flight, in place: of two open units one lends the other words until one is 0 or 1, so that sum(p * s) stays and at
    most one is left. One long unit takes many short ones, so the number of documents may drift by some; of two
    directions that is taken which brings it back."""
    eps, drift = 1e-9, 0.0
    open_: list[int] = []
    for i in rows:
        if not 0 < p[i] < 1:
            continue
        if not s[i]:
            drift += round(p[i]) - p[i]
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        if len(open_) < 2:
            continue
        a, b = open_
        steps = [min((1 - p[a]) / s[b], p[b] / s[a]), -min(p[a] / s[b], (1 - p[b]) / s[a])]
        step = min(steps, key=lambda t: abs(drift + t * (s[b] - s[a])))
        drift += step * (s[b] - s[a])
        p[a] += step * s[b]
        p[b] -= step * s[a]
        for j in (a, b):
            if p[j] < eps or p[j] > 1 - eps:
                p[j] = float(round(p[j]))
        open_ = [j for j in open_ if 0 < p[j] < 1]
    return p


def short_tail(s: list[int]) -> int:
    """Of sizes in falling order, where the shortest begin that hold twice the words of the longest: half of them at most."""
    k, words = len(s), 0
    while k > (len(s) + 1) // 2 and words < 2 * s[0]:
        k -= 1
        words += s[k]
    return k


def land(p: list[float], s: list[int]) -> list[float]:
    """The rounding of the last open units with the least error in words, then in documents."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    n, words = sum(p[i] for i in open_), sum(p[i] * s[i] for i in open_)
    best = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda x: (abs(sum(v * s[i] for v, i in zip(x, open_)) - words), abs(sum(x) - n), x))
    for i, v in zip(open_, best):
        p[i] = v
    return p


def make_up(p: list[float], s: list[int], words: float) -> list[float]:
    """The end of the landing, in place: where it misses `words`, documents are taken or left, the longest that fits into what is
    missing first, until none fits. s falls; so does what is missed, to less than the shortest document that could mend it."""
    missed = sum(x * y for x, y in zip(p, s)) - words
    side = float(missed > 0)
    for i, size in enumerate(s):
        if p[i] == side and 0 < size <= abs(missed) + min(size / 2, 0.5):
            p[i] = 1 - side
            missed += size if not side else -size
    return p


def _flight(last: bool):
    def block(t: pa.Table) -> pa.Table:
        # long documents first; what their flight leaves is settled against the shortest, so what is left at the end is one of these
        t = t.sort_by([("_size", "descending"), ("_h", "ascending"), ("_id", "ascending")])
        p, s = t.column("_p").to_pylist(), t.column("_size").to_pylist()
        words = sum(x * y for x, y in zip(p, s))
        k = short_tail(s)
        p[:k] = fly(p[:k], s[:k])
        p = settle(p, s, list(range(len(p))))
        if last:
            p = make_up(land(p, s), s, words)
        return t.set_column(t.schema.get_field_index("_p"), "_p", pa.array(p, pa.float64()))

    return block


def mix(docs: DataFrame, *, id_col="doc_id", size=None, source_col="source", weights=(5, 2, 1), share=1.5, most=2.0, block=BLOCK) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, copies (0 to ceil(most)) and taken.

    size: a column of whole numbers; the words of text by default. Empty tables give no rows;
    null texts have size 0 and documents of size 0 are taken 0 words, in whatever copies; a null
    source is a source; rows that are equal in id, source and size are interchangeable, and
    which of them is taken is left open. Other columns are ignored.
    """
    size = word_count(F.col("text")) if size is None else size
    sizes = cut(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).alias("source"), size.alias("size")), "mix-sizes")
    targets = cut(source_targets(sizes, weights, share, most), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.select(
        "_id", "source", "size", "source_size", "target",
        F.floor(ratio).alias("_base"), (ratio - F.floor(ratio)).alias("_p0"),
        F.xxhash64("_id", "size").alias("_h"), F.ceil(F.col("n_docs") / block).alias("_blocks"),
    ).withColumn("_block", F.pmod(F.xxhash64("_h"), F.col("_blocks")))
    sure = rows.filter(F.col("_p0") < 1e-9)
    most_blocks = rows.select(F.max("_blocks")).first()[0] or 0
    schema = "_id long, source string, _size long, source_size long, target double, _base long, _h long, _block long, _p double"
    todo = rows.filter(F.col("_p0") >= 1e-9).select("_id", "source", F.col("size").alias("_size"), "source_size", "target", F.col("_base").cast("long"), "_h", F.col("_block").cast("long"), F.col("_p0").alias("_p"))
    done = sure.select("_id", "source", F.col("size").alias("_size"), "source_size", "target", F.col("_base").cast("long"), F.lit(0.0).alias("_p"))
    while True:
        last = most_blocks <= 1
        flown = cut(todo.groupBy("source", "_block").applyInArrow(_flight(last), schema), "mix-flight")
        settled = (F.col("_p") == 0) | (F.col("_p") == 1)
        done = done.unionByName(flown.filter(settled).select(*done.columns))
        if last:
            break
        fan_in = block // _SPARE
        most_blocks = -(-most_blocks // fan_in)
        todo = flown.filter(~settled).withColumn("_block", F.floor(F.col("_block") / fan_in).cast("long"))
    copies = (F.col("_base") + F.col("_p").cast("long")).alias("copies")
    return done.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source", "source_size", "target", copies, (copies * F.col("_size")).alias("taken"))


def op1(spark, sf_dir):
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "copies", "taken")

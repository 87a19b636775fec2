"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, mapped

#: Nodes that a task holds at a time, at most a batch over.
HELD = 400_000


def _forest(batches):
    """Spanning star forests of a partition's edges, each of at most some HELD nodes: fewer rows, the same components."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[p]
        return x

    def flush():
        rows = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        for k in range(0, len(rows), 100_000):
            part = np.array(rows[k : k + 100_000], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
        if len(parent) > HELD:
            yield from flush()
    yield from flush()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of each node that has an edge (u, v), u != v.

    A round costs two shuffles of the edges left; the table is cut after each, so that the
    lineage stays short. The number of rounds grows with the logarithm of the longest path."""
    now = cut(edges.select("u", "v").transform(mapped, _forest, "u long, v long").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # now every edge points from the greater node to the lesser
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        nxt = cut(small, "edges")
        state = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_cut(now)
        now = nxt
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

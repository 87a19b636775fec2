"""Approximate nearest neighbours by learned partitions.

On a bounded sample: a graph of nearest neighbours, a balanced partition of it, and a small network that
learns, from a vector, how its neighbours are spread over the parts. Every row is indexed in its most
probable part; a query goes to its most probable parts, and more where they hold too few rows; their rows are ranked by
exact inner products. How many parts those are is measured, not assumed: rows that the network was not fitted on are
queries, their true neighbours are found among all rows of the index, and the fewest parts are taken that hold the wanted share of these.
Small parts are searched in bundles, large ones are split into cells and many queries into blocks, so that a task
holds a bounded number of both and a query returns few lists.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mapped, table

#: Rows the index is fitted on, at most: those of the smallest hash of the id.
SAMPLE = 6144
#: Rows of the sample that are queries of the measurement instead, at most, and one in how many.
HELD_OUT, HELD_OUT_IN = 256, 8
#: Bound of the number of parts, which is the square root of that of rows: two parts or more from 64 rows on. Rows of a
#: cell and queries of a block, on average.
MOST_PARTS, LEAST_SPLIT = 192, 64
CELL, QUERY_BLOCK = 16_384, 8192
GRAPH_K, HIDDEN, WANTED = 12, 64, 0.93


def usable(vector):
    """Not null, no null or non-finite component, and not all zero."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row by inner product, in blocks."""
    out = np.empty((len(x), k), dtype=np.int64)
    for s in range(0, len(x), 512):
        p = x[s : s + 512] @ x.T
        p[np.arange(len(p)), np.arange(s, s + len(p))] = -np.inf
        out[s : s + 512] = np.argpartition(-p, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, near: np.ndarray, m: int, sweeps: int = 8, slack: float = 1.05) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between: halves along principal directions to start, then
    sweeps in which a row moves to the part of most of its neighbours that has room."""
    n = len(x)
    part = np.zeros(n, dtype=np.int64)
    todo, label = [(np.arange(n), m)], 0
    while todo:
        rows, k = todo.pop()
        if k == 1 or len(rows) < 2:
            part[rows] = label
            label += 1
            continue
        y = x[rows] - x[rows].mean(axis=0)
        v = np.linalg.svd(y.T @ y)[0][:, 0]
        order = rows[np.argsort(y @ v, kind="stable")]
        at = len(order) * (k // 2) // k
        todo += [(order[:at], k // 2), (order[at:], k - k // 2)]
    room = int(np.ceil(slack * n / m))
    size = np.bincount(part, minlength=m)
    for _ in range(sweeps):
        moved = 0
        for i in range(n):
            votes = np.bincount(part[near[i]], minlength=m)
            own = part[i]
            votes[size >= room] = np.where(np.arange(m)[size >= room] == own, votes[size >= room], -1)
            best = int(np.argmax(votes))
            if votes[best] > votes[own]:
                size[own] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer: probabilities of the parts of a vector."""

    def __init__(self, w1, b1, w2, b2):
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def fit(cls, x: np.ndarray, near: np.ndarray, part: np.ndarray, m: int, epochs: int = 12, rate: float = 3e-3) -> "Router":
        g = np.random.default_rng(3)
        n, d = x.shape
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        want = np.zeros((n, m))
        for j in range(near.shape[1]):
            want[np.arange(n), part[near[:, j]]] += 1
        want[np.arange(n), part] += 1
        want /= want.sum(axis=1, keepdims=True)
        p = [g.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), g.normal(0, HIDDEN**-0.5, (HIDDEN, m)), np.zeros(m)]
        mean, square, t = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
        for _ in range(epochs):
            for rows in np.array_split(g.permutation(n), max(1, n // 256)):
                a = x[rows]
                h = np.maximum(a @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                q = np.exp(z - z.max(axis=1, keepdims=True))
                dz = (q / q.sum(axis=1, keepdims=True) - want[rows]) / len(rows)
                dh = (dz @ p[2].T) * (h > 0)
                t += 1
                for k, grad in enumerate((a.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                    mean[k] = 0.9 * mean[k] + 0.1 * grad
                    square[k] = 0.999 * square[k] + 0.001 * grad**2
                    p[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
        return cls(*p)


class LearnedPartitions:
    """parts, router (none for one part), probes: parts a query is sent to, recall: the share of true neighbours that these
    held in the measurement (None before)."""

    def __init__(self, parts: int, router: Router | None, probes: int = 1):
        self.parts, self.router, self.probes, self.recall = parts, router, probes, None

    @classmethod
    def fit(cls, x: np.ndarray, parts: int) -> "LearnedPartitions":
        if len(x) < LEAST_SPLIT or parts < 2:
            return cls(1, None)
        parts = max(2, min(parts, len(x) // 24))
        x = x / np.abs(x).max()  # products of very long vectors would overflow; their order stays
        near = graph(x, min(GRAPH_K, len(x) - 1))
        part = balanced_partition(x, near, parts)
        return cls(parts, Router.fit(x, near, part, parts), parts)

    def measure(self, queries: np.ndarray, true: list[list[int]], wanted: float) -> None:
        """Set probes to the fewest that hold `wanted` of the queries' true neighbours, given by their parts."""
        if not self.router or not sum(map(len, true)):
            return
        rank = np.argsort(np.argsort(-self.router.logits(queries), axis=1, kind="stable"), axis=1, kind="stable")
        needed = np.concatenate([rank[i, parts] for i, parts in enumerate(true) if parts])
        share = np.cumsum(np.bincount(needed, minlength=self.parts)) / len(needed)
        self.probes = int(np.searchsorted(share, wanted)) + 1
        self.recall = float(share[self.probes - 1])

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.router.logits(x).argmax(axis=1) if self.router else np.zeros(len(x), dtype=np.int64)

    def routes(self, x: np.ndarray, held: np.ndarray, least: int) -> list[np.ndarray]:
        """Parts of each query, most probable first: probes of them, and on until they hold `least` rows."""
        if not self.router:
            return [np.zeros(1, dtype=np.int64)] * len(x)
        order = np.argsort(-self.router.logits(x), axis=1, kind="stable")
        enough = (np.cumsum(held[order], axis=1) < least).sum(axis=1) + 1
        return [row[: max(self.probes, int(e))] for row, e in zip(order, enough)]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 1))


def _rank(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not rows.num_rows or not queries.num_rows:
            return empty
        c, ids = _matrix(rows.column("v")), rows.column("vec_id").to_numpy()
        q, qids = _matrix(queries.column("v")), queries.column("vec_id").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        c, ids, part = c[by_id], ids[by_id], rows.column("part").to_numpy()[by_id]
        ways = queries.column("ways").to_pylist()
        longest, outs = np.linalg.norm(c, axis=1).max(), []
        for s in range(0, len(q), 256):
            with np.errstate(over="ignore", invalid="ignore"):  # products may overflow: such rows are candidates, too
                p = q[s : s + 256] @ c.T
                error = 1e-12 * np.linalg.norm(q[s : s + 256], axis=1) * longest
            p[np.isnan(p)] = np.inf
            routed = np.zeros((len(p), int(part.max()) + 1), dtype=bool)
            for i, w in enumerate(ways[s : s + 256]):
                routed[i, [x for x in w if x < routed.shape[1]]] = True
            may = routed[:, part] & (qids[s : s + 256, None] != ids[None, :])
            p[~may] = -np.inf
            take = min(k, p.shape[1])
            bound = np.partition(p, p.shape[1] - take, axis=1)[:, p.shape[1] - take]
            for i, low in enumerate(bound):
                least = low - error[i]
                at = np.flatnonzero(may[i] & (p[i] >= least) if np.isfinite(least) else may[i])
                score = np.zeros(len(at))
                with np.errstate(over="ignore", invalid="ignore"):
                    for j in range(c.shape[1]):  # in order of components: equal vectors get equal scores
                        score += q[s + i, j] * c[at, j]
                top = np.lexsort((ids[at], -score))[:k]
                outs.append((np.full(len(top), qids[s + i]), ids[at][top], score[top]))
        return pa.table({n: pa.array(np.concatenate(x)) for n, x in zip(("query_id", "vec_id", "score"), zip(*outs))})

    return run


def _nearest(queries: np.ndarray, ids: np.ndarray, k: int):
    """The k nearest rows of each query in a partition: query's number, score, part."""

    def run(batches):
        best: list = [[] for _ in queries]
        for b in batches:
            with np.errstate(over="ignore", invalid="ignore"):
                p = np.nan_to_num(queries @ _matrix(b.column(1)).T, nan=np.finfo(float).max)
            p[ids[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
            at = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
            part = b.column(2).to_numpy()
            for i, a in enumerate(at):
                best[i] = sorted(best[i] + [(float(p[i, j]), int(part[j])) for j in a if np.isfinite(p[i, j])], reverse=True)[:k]
        rows = [(i, *x) for i, found in enumerate(best) for x in found]
        if rows:
            q, score, part = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score, pa.float64()), pa.array(part, pa.int32())], ["q", "score", "part"])

    return run


def build_index(rows: DataFrame, *, k: int = 20, sample: int = SAMPLE, part_rows: int | None = None, wanted: float = WANTED):
    """(index, table of vec_id, v and part) of rows(vec_id, v), all of one length; (None, None) for an empty table.

    Fitted on at most `sample` rows, less those held out. Parts have part_rows rows each where that is given."""
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not few:
        return None, None
    n = rows.count()
    parts = min(MOST_PARTS, max(2, n // part_rows if part_rows else math.isqrt(n))) if n >= LEAST_SPLIT else 1
    x = np.array([r["v"] for r in few])
    out = np.arange(len(few)) % HELD_OUT_IN == 0 if parts > 1 else np.zeros(len(few), dtype=bool)
    out[np.flatnonzero(out)[HELD_OUT:]] = False
    index = LearnedPartitions.fit(x[~out], parts)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(index.home(_matrix(b.column(1))), pa.int32())], ["vec_id", "v", "part"])

    placed = cut(rows.transform(mapped, place, "vec_id long, v array<double>, part int"), "indexed")
    if index.router:
        ids = np.array([r["vec_id"] for r in few])[out]
        found = placed.select("vec_id", "v", "part").transform(mapped, _nearest(x[out], ids, k), "q int, score double, part int")
        best = found.withColumn("_k", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "part"))).filter(F.col("_k") <= k)
        true: list[list[int]] = [[] for _ in ids]
        for r in best.collect():  # k rows a held-out query
            true[r["q"]].append(r["part"])
        index.measure(x[out], true, wanted)
    return index, placed


def search(rows: DataFrame, queries: DataFrame, *, k: int = 20, sample: int = SAMPLE, part_rows: int | None = None, wanted: float = WANTED) -> DataFrame:
    """query_id, rank, vec_id, score: of each query its k nearest rows found, by inner product, without the row of its
    own id; ties to the smaller id. rows and queries: vec_id, embedding; other columns are left out, whatever their names.

    Vectors that are null, zero, or hold null or non-finite components take no part. A product is defined for vectors of one
    length: where there are several, each has an index of its own, and queries meet rows of their length. Sums that overflow are
    scores as they come, a sum that is no number last. Fewer rows than k are all found. Rows that repeat an id are rows of their own;
    of queries that repeat an id the one of the least vector is asked. Empty tables give no rows. A fit sees at most `sample` rows; every row is indexed."""
    clean = lambda d: d.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows, queries = clean(rows), clean(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # a row a length
    found = [_search(rows.filter(F.size("v") == n), queries.filter(F.size("v") == n), k, sample, part_rows, wanted) for n in lengths]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema)


def _search(rows: DataFrame, queries: DataFrame, k: int, sample: int, part_rows: int | None, wanted: float) -> DataFrame:
    """search() of rows and queries (vec_id, v) of one length."""
    index, placed = build_index(rows, k=k, sample=sample, part_rows=part_rows, wanted=wanted)
    held = np.zeros(index.parts, dtype=np.int64)
    for r in placed.groupBy("part").count().collect():  # one row a part
        held[r["part"]] = r["count"]
    # parts next to each other are searched together, up to a cell's rows: a query gets one list of each such bundle
    bundle, size = np.zeros(index.parts, dtype=np.int64), [0]
    for p in range(index.parts):
        if size[-1] and size[-1] + held[p] > CELL:
            size.append(0)
        bundle[p] = len(size) - 1
        size[-1] += int(held[p])
    cells = np.maximum(1, -(-np.array(size) // CELL))

    def route(batches):
        for b in batches:
            found = [(i, int(g), w[bundle[w] == g]) for i, w in enumerate(index.routes(_matrix(b.column(1)), held, k + 1)) for g in np.unique(bundle[w])]
            take = pa.array([i for i, *_ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([g for _, g, _ in found], pa.int32()), pa.array([w for *_, w in found], pa.list_(pa.int32()))], ["vec_id", "v", "bundle", "ways"])

    routed = cut(queries.transform(mapped, route, "vec_id long, v array<double>, bundle int, ways array<int>"), "routed")
    asked = np.zeros(len(size), dtype=np.int64)
    for r in routed.groupBy("bundle").count().collect():  # one row a bundle
        asked[r["bundle"]] = r["count"]
    blocks = np.maximum(1, -(-asked // QUERY_BLOCK))
    at = lambda a, i: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in a]), F.col(i) + 1)
    hash_ = F.xxhash64("vec_id")
    c = placed.withColumn("bundle", at(bundle, "part").cast("int"))
    c = c.withColumn("cell", F.pmod(hash_, at(cells, "bundle"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), at(blocks, "bundle") - 1)))
    q = routed.withColumn("block", F.pmod(hash_, at(blocks, "bundle"))).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), at(cells, "bundle") - 1)))
    key = ["bundle", "cell", "block"]
    found = c.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(_rank(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0))

"""Exact nearest neighbours of a stated query set: rows and queries are dealt to cells, each cell is compared by matrix products.

A product only chooses candidates, by a margin far above its rounding; their cosines are then summed component by
component and rounded half up to six digits, as the column expression does, so ranks and ties are those of the expression.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a cell at most, components of its rows at most, and scores that are held at once.
CELL_ROWS, CELL_COMPONENTS, SCORES = 1 << 15, 1 << 21, 1 << 22
#: Rows below which a cell isn't cut further for the sake of more tasks.
LEAST_ROWS = 4096
#: What candidates may lack: two roundings to six digits, and more.
MARGIN = 2e-6
#: Groups that each get a bound of their own.
BOUNDED_GROUPS = 64


def cells(rows: DataFrame, queries: DataFrame, k: int, n: int, dim: int, n_queries: int, most: int, cap: int | None = None) -> DataFrame:
    """query_id, chunk_id, score (cosine, six digits) and, where rows have one, group: of each query the best k of each cell,
    at most cap of a group, ties to the smaller chunk_id.

    rows(chunk_id, v[, group]) and queries(query_id, q) hold n and n_queries vectors of dim finite components, none zero; a
    cell has at most about `most` queries and CELL_ROWS rows, so a task's memory doesn't depend on the tables."""
    parts = max(-(-n // CELL_ROWS), -(-n * dim // CELL_COMPONENTS), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)), 1)
    blocks = max(-(-n_queries // most), -(-n_queries * dim // CELL_COMPONENTS), 1)
    own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    keys = ["_block", "_part"]
    r = rows.withColumn("_part", own("chunk_id", parts)).withColumn("_block", all_of(blocks)).repartition(parts * blocks, *keys)
    q = queries.withColumn("_block", own("query_id", blocks)).withColumn("_part", all_of(parts)).repartition(parts * blocks, *keys)
    grouped = "group" in rows.columns
    kinds = dict(queries.dtypes) | dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["query_id", "chunk_id", *(["group"] if grouped else [])]) + ", score double"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        qi, ri, score = best(_matrix(b["q"], dim), *_sorted(a, grouped, dim), k, cap)
        a = a.take(pc.sort_indices(a["chunk_id"], null_placement="at_start"))
        columns = {"query_id": b["query_id"].take(pa.array(qi)), "chunk_id": a["chunk_id"].take(pa.array(ri))}
        if grouped:
            columns["group"] = a["group"].take(pa.array(ri))
        return pa.table(columns | {"score": pa.array(score)})

    return r.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, schema)


def _matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as columns of double components."""
    flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in vectors.chunks]
    return np.concatenate([np.empty(0), *flat]).reshape(-1, dim).T.copy()


def _sorted(a: pa.Table, grouped: bool, dim: int):
    """Vectors by ascending id, as columns, and the groups' codes, or none."""
    order = pc.sort_indices(a["chunk_id"], null_placement="at_start")
    codes = None
    if grouped:
        found = a["group"].take(order).combine_chunks()
        codes = pc.dictionary_encode(found, null_encoding="encode").indices.to_numpy(zero_copy_only=False) if len(found) else np.empty(0, int)
    return _matrix(a["v"], dim)[:, order.to_numpy()], codes


def _norms(columns: np.ndarray) -> np.ndarray:
    s = np.zeros(columns.shape[1])
    for x in columns:
        s += x * x
    return np.sqrt(s)


def _micro(score: np.ndarray) -> np.ndarray:
    """Scores in millionths, rounded half up by their decimals."""
    y = score * 1e6
    out = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(score[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _bound(s: np.ndarray, k: int) -> np.ndarray:
    """A number for each line of s that at least k of its scores reach: the k-th of the maxima of disjoint columns."""
    n = s.shape[1]
    if n < k:
        return np.full(len(s), -np.inf)
    g = max(k, min(n, 1024))
    w = n // g
    maxima = s[:, : w * g].reshape(len(s), w, g).max(axis=1)
    return np.partition(maxima, g - k, axis=1)[:, g - k]


def _bounds(s: np.ndarray, starts: np.ndarray, k: int, cap: int) -> np.ndarray:
    """For each line and column of s the score without which a column can't be among the k best, at most cap of a group;
    groups are stretches of columns."""
    ends = np.append(starts[1:], s.shape[1])
    all_of = np.full(len(s), -np.inf)
    if len(starts) >= k:
        maxima = np.maximum.reduceat(s, starts, axis=1)
        all_of = np.partition(maxima, len(starts) - k, axis=1)[:, len(starts) - k]
    if len(starts) > BOUNDED_GROUPS:
        return all_of[:, None]
    each = np.stack([np.maximum(all_of, _bound(s[:, a:b], cap)) for a, b in zip(starts, ends)], axis=1)
    return np.repeat(each, ends - starts, axis=1)


def _firsts(keys: list[np.ndarray], k: int) -> np.ndarray:
    """Which of the sorted lines are among the first k with their keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(new, at, 0)) < k


def best(q: np.ndarray, r: np.ndarray, codes: np.ndarray | None, k: int, cap: int | None):
    """Numbers of queries and rows, and scores, of the k best rows of each query; vectors are columns, rows ascend by id."""
    n = r.shape[1]
    none = np.empty(0, np.int64)
    if not n or not q.shape[1]:
        return none, none, np.empty(0)
    at = np.argsort(codes, kind="stable") if cap else np.arange(n)
    r = r[:, at] if cap else r
    group = codes[at] if cap else None
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if cap else None
    rn, qn = _norms(r), _norms(q)
    unit_r, unit_q = r / rn, (q / qn).T.copy()
    found = []
    step = max(1, SCORES // n)
    for lo in range(0, q.shape[1], step):
        s = unit_q[lo : lo + step] @ unit_r
        least = _bounds(s, starts, k, cap) if cap else _bound(s, k)[:, None]
        qi, ri = np.nonzero(s >= least - MARGIN)
        qi += lo
        score = np.empty(len(qi))
        for a in range(0, len(qi), 1 << 18):
            i, j = qi[a : a + (1 << 18)], ri[a : a + (1 << 18)]
            dot = np.zeros(len(i))
            for x, y in zip(q, r):
                dot += y[j] * x[i]
            score[a : a + (1 << 18)] = dot / (rn[j] * qn[i])
        score = _micro(score)
        if cap:
            order = np.lexsort((at[ri], -score, group[ri], qi))
            order = order[_firsts([qi[order], group[ri[order]]], cap)]
            qi, ri, score = qi[order], ri[order], score[order]
        order = np.lexsort((at[ri], -score, qi))
        order = order[_firsts([qi[order]], k)]
        found.append((qi[order], at[ri[order]], score[order] / 1e6 + 0.0))
    return tuple(np.concatenate(x) for x in zip(*found))

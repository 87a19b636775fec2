"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

Plain prefix doubling would sort a pair of ranks for every byte of the corpus, many times its size. Here only
anchors take part: in each window of `length` bytes the k-byte string of least hash, its
leftmost if tied. Equal windows have their anchor at the same offset, so a window recurs if and only if
an equal one has an equal anchor, and all windows of one anchor (a run of offsets) go together as long as they can.

The first rank of a run of windows is that of its anchor's k bytes. Each round then doubles the string: a
position's new rank is that of the pair (its own rank, the string of as many bytes at that offset), k, 2k, 4k bytes and
on, by Spark's sorted aggregation and join. The string grows to the right where all windows of the run hold that, else
to the left, which parts a run by offsets in a few at most. A pair that only one position has is unique, and its
windows are done; so is a run all of whose bytes recur with the same offsets: it is past the threshold, all its windows
recur. A rank names its string: it is made of the least position that has it. When the next doubling would leave the
window, the pairs' second part is what else all windows of a shorter run of offsets share: length - step + 1 bytes in all, and
at last `length`, when each window stands alone. A run that is done stays on as one witness while runs that
are not share its rank. So each round sorts fewer positions, by longer strings, until each is unique or has the full length.

Strings of a pair's second part stand as 64-bit hashes, and so do ranks: 128 bits to compare by in each round.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, mapped, release, table, text_bytes

U = np.uint64
#: Window starts handled at a time; bits of a place in the order of anchors.
SEGMENT = 1 << 20
_PLACE = 21
ANCHOR, STEP = 50, 32


def _mixed(x):
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=1)
def _tables(n: int):
    """A random value of each byte, and powers of an odd base and of its inverse mod 2^64."""
    values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    base = 0x9E3779B97F4A7C15
    power, inverse = np.empty(n, dtype=U), np.empty(n, dtype=U)
    for out, x in ((power, base), (inverse, pow(base, -1, 1 << 64))):
        out[0] = 1
        done = 1
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * U(pow(x, done, 1 << 64))
            done += k
    return values, power, inverse


class Hashes:
    """Hashes of any part of a byte buffer, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        values, power, self.inverse = _tables(2 * SEGMENT + 4096)
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(values[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start, stop):
        return _mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def all_of(self, k: int):
        return _mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(U).max, dtype=U)
    full[:n] = x
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(texts, length: int, k: int):
    """Of a list of byte strings: doc, anchor, least and greatest offset of its windows, hash of its k bytes,
    hash of all bytes its windows cover. A long string comes in segments, which may part a run in two."""
    parts, size = [], 0

    def flush():
        data = np.frombuffer(b"".join(p for *_, p in parts), dtype=np.uint8)
        hashes = Hashes(data)
        grams = hashes.all_of(k)
        places = np.arange(len(grams), dtype=U)
        order = ((grams >> U(_PLACE)) << U(_PLACE)) | places
        at = (_least(order, length - k + 1) & U((1 << _PLACE) - 1)).astype(np.int64)
        offsets = np.cumsum([0] + [len(p) for *_, p in parts])
        first, last = offsets[:-1], offsets[1:] - length
        fits = last >= first
        first, last = first[fits], last[fits]
        bound = np.zeros(len(at) + 1, dtype=np.int8)
        bound[first] += 1
        bound[last + 1] -= 1
        valid = np.cumsum(bound[:-1], dtype=np.int8) > 0
        new = valid.copy()
        new[1:] &= at[1:] != at[:-1]
        new[first] = True
        lo = np.flatnonzero(new)
        ends = valid.copy()
        ends[:-1] &= new[1:] | ~valid[1:]
        hi = np.flatnonzero(ends)
        a = at[lo]
        part = np.searchsorted(offsets, lo, side="right") - 1
        shift = np.array([s for _, s, _ in parts], dtype=np.int64)[part] - offsets[part]
        doc = np.array([d for d, *_ in parts], dtype=np.int64)[part]
        return doc, a + shift, a - hi, a - lo, grams[a], hashes.of(lo, hi + length)

    for d, text in enumerate(texts):
        for s in range(0, max(0, len(text) - length + 1), SEGMENT):
            piece = text[s : s + SEGMENT + length - 1]
            if parts and size + len(piece) > SEGMENT + 4096:
                yield flush()
                parts, size = [], 0
            parts.append((d, s, piece))
            size += len(piece)
    if parts:
        yield flush()


def _signed(x):
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _first_ranks(length, k):
    def run(batches):
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for doc, a, lo, hi, gram, span in anchors([x or b"" for x in text_bytes(b.column(2))], length, k):
                yield pa.RecordBatch.from_arrays([pa.array(k1[doc]), pa.array(k2[doc]), pa.array(a), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16)), _signed(gram), _signed(span)], ["k1", "k2", "a", "lo", "hi", "rank", "span"])

    return run


def _contexts(length):
    """The bytes around each anchor that is left: those that its windows cover."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for k1, k2, text, left in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), b.column(3).to_pylist()):
                for x in left:
                    for o, v in zip(out, (k1, k2, x["a"], x["lo"], x["hi"], x["rank"], x["done"], text[x["a"] - x["hi"] : x["a"] - x["lo"] + length])):
                        o.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], ["k1", "k2", "a", "lo", "hi", "rank", "done", "context"])

    return run


def ladder(length: int, k: int):
    """Ranges of offsets (from, to), each with its cores: for k, 2k, 4k bytes and on, as long as three such strings fit in a
    window, how far before the anchor the string starts. All windows of the range hold all its cores."""
    rungs, h = [(0, length - k, [0])], k
    while 3 * h <= length:
        out = []
        for lo, hi, cores in rungs:
            edge = length + cores[-1] - 2 * h  # the greatest offset whose window holds the string doubled to the right
            if lo <= edge:
                out.append((lo, min(hi, edge), [*cores, cores[-1]]))
            if hi > edge:
                out.append((max(lo, edge + 1), hi, [*cores, cores[-1] + h]))
        rungs, h = out, 2 * h
    return rungs


def _pairs(length, k):
    """Runs of each context cut at the ladder's ranges: the string at each doubling's offset, and the hash of all bytes
    that the run's windows cover."""
    rungs = ladder(length, k)
    n = len(rungs[0][2]) - 1

    def run(batches):
        for b in batches:
            ctx = b.column(7).to_pylist()
            for s in range(0, len(ctx), 1024):
                part = b.slice(s, 1024)
                k1, k2, a, lo, hi, rank = (part.column(i).to_numpy() for i in range(6))
                done = part.column(6).to_numpy(zero_copy_only=False)
                lo, hi = lo.astype(np.int64), hi.astype(np.int64)
                some = ctx[s : s + 1024]
                at = np.cumsum([0] + [len(c) for c in some])[:-1] + hi  # the anchor's place
                hashes = Hashes(np.frombuffer(b"".join(some), dtype=np.uint8))
                for j, (f, t, cores) in enumerate(rungs):
                    i = np.flatnonzero((lo <= t) & (hi >= f))
                    first, last = np.maximum(lo[i], f), np.minimum(hi[i], t)
                    names, h = [], k
                    for c, after in zip(cores, cores[1:]):
                        start = at[i] - c + h if after == c else at[i] - after
                        names.append(_signed(hashes.of(start, start + h)))
                        h *= 2
                    span = _signed(hashes.of(at[i] - last, at[i] - first + length))
                    yield pa.RecordBatch.from_arrays([*[pa.array(x[i]) for x in (k1, k2, a)], pa.array(first.astype(np.int16)), pa.array(last.astype(np.int16)), pa.array(rank[i]), pa.array(np.full(len(i), j, dtype=np.int16)), *names, span, pa.array(done[i])], ["k1", "k2", "a", "lo", "hi", "rank", "rung", *[f"n{r}" for r in range(n)], "span", "done"])

    schema = "k1 long, k2 long, a long, lo short, hi short, rank long, rung short, " + "".join(f"n{r} long, " for r in range(n)) + "span long, done boolean"
    return n, run, schema


def _next_ranks(length, step):
    """Runs of offsets (from, to) of each context cut at multiples of step, with the hash of what all windows of
    the cell share and that of all that the run's windows cover."""

    def run(batches):
        for b in batches:
            k1, k2, a, high, lo, hi, rank, done, ctx = (b.column(i).to_pylist() for i in range(9))
            data = b"".join(ctx)
            for s in range(0, len(ctx), 1024):
                e = min(len(ctx), s + 1024)
                starts = np.cumsum([0] + [len(c) for c in ctx[s:e]])
                hashes = Hashes(np.frombuffer(b"".join(ctx[s:e]), dtype=np.uint8))
                i, cell = [], []
                for j in range(s, e):
                    cells = range(lo[j] // step, hi[j] // step + 1)
                    i += [j] * len(cells)
                    cell += cells
                if not i:
                    continue
                i, cell = np.array(i), np.array(cell, dtype=np.int64)
                f, t = np.maximum(np.array(lo)[i], cell * step), np.minimum(np.array(hi)[i], cell * step + step - 1)
                at = starts[i - s] + np.array(high)[i]  # the anchor's place
                core = hashes.of(at - cell * step, at - (cell * step + step - 1) + length)
                span = hashes.of(at - t, at - f + length)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.array(x, dtype=np.int64)[i]) for x in (k1, k2, a)], pa.array(f.astype(np.int16)), pa.array(t.astype(np.int16)), pa.array(np.array(rank, dtype=np.int64)[i]), pa.array(cell.astype(np.int16)), _signed(core), _signed(span), pa.array(np.array(done, dtype=bool)[i])], ["k1", "k2", "a", "lo", "hi", "rank", "cell", "core", "span", "done"])
            del data

    return run


def _round(rows: DataFrame, group: list[str], keep: list[str] = ()):
    """One reranking: (runs that recur whole, runs to rank anew, the table of both). rows: k1, k2, a, lo, hi, span, done, group
    and keep; the rank of those left is made of the least position of their group."""
    cls = [*group, "lo", "hi", "span"]
    classes = rows.groupBy(*cls).agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("done")).cast("long")).alias("u"), F.min(F.struct("k1", "k2", "a")).alias("w"))
    groups = classes.groupBy(*group).agg(F.sum("n").alias("all_n"), F.sum(((F.col("n") == 1) & (F.col("u") == 1)).cast("long")).alias("open_n"), F.min("w").alias("least")).filter("all_n > 1")
    live = classes.join(groups, group).filter("(n > 1 and (u > 0 or open_n > 0)) or open_n > 0")
    live = live.withColumn("new_rank", F.xxhash64("least.k1", "least.k2", "least.a", *[c for c in group if c in ("rung", "cell")]) if len(group) > 1 else F.col("rank")).drop("least")
    witness = (F.col("n") > 1) & (F.col("w.k1") == F.col("k1")) & (F.col("w.k2") == F.col("k2")) & (F.col("w.a") == F.col("a"))
    seen = rows.join(live, cls).select(
        "k1", "k2", "a", "lo", "hi", F.col("new_rank").alias("rank"), *keep, (F.col("done") | (F.col("n") > 1)).alias("done"),
        ((F.col("n") > 1) & ~F.col("done")).alias("whole"), ((F.col("open_n") > 0) & ((F.col("n") == 1) | witness)).alias("left"),
    )
    seen = cut(seen.filter(F.col("whole") | F.col("left")), "ranks")
    whole = seen.filter("whole").select("k1", "k2", (F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo")).alias("e"))
    return whole, seen.filter("left").drop("whole", "left"), seen


def repeated_windows(base: DataFrame, length: int, k: int = ANCHOR, step: int = STEP) -> DataFrame:
    """k1, k2 and runs (s, e) of each text with any: windows that start at s to e recur. base: k1, k2, text."""
    spark = base.sparkSession
    first = cut(base.transform(mapped, _first_ranks(length, k), "k1 long, k2 long, a long, lo short, hi short, rank long, span long"), "anchors")
    whole, left, seen = _round(first.withColumn("done", F.lit(False)), ["rank"])
    drop_cut(first)
    release(spark)
    per_doc = left.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "lo", "hi", "rank", "done")).alias("left"))
    contexts = cut(base.join(per_doc, ["k1", "k2"]).select("k1", "k2", "text", "left").transform(mapped, _contexts(length), "k1 long, k2 long, a long, lo short, hi short, rank long, done boolean, context binary"), "contexts")
    release(spark)
    found, tables = whole, [seen]
    doublings, run, schema = _pairs(length, k)
    left = pairs = cut(contexts.transform(mapped, run, schema), "pairs")
    for r in range(doublings):
        ahead = [f"n{x}" for x in range(r + 1, doublings)]
        if ahead:
            ahead += ["rung", "span"]
        whole, left, seen = _round(left, ["rank", "rung", f"n{r}"], ahead)
        found = found.unionByName(whole)
        tables.append(seen)
        release(spark)
    drop_cut(pairs)
    around = contexts.select("k1", "k2", "a", F.col("lo").alias("low"), F.col("hi").alias("high"), "context")
    held = lambda left: left.select("k1", "k2", "a", "lo", "hi", "rank", "done").distinct().join(around, ["k1", "k2", "a"]).filter("lo >= low and hi <= high").select("k1", "k2", "a", "high", "lo", "hi", "rank", "done", "context")
    runs = held(left)
    for width in (step, 1):
        schema = "k1 long, k2 long, a long, lo short, hi short, rank long, cell short, core long, span long, done boolean"
        ranked = cut(runs.transform(mapped, _next_ranks(length, width), schema), "runs")
        if width == 1:
            drop_cut(contexts)
        release(spark)
        whole, left, seen = _round(ranked, ["rank", "cell", "core"])
        drop_cut(ranked)
        found = found.unionByName(whole)
        tables.append(seen)
        if width > 1:
            runs = held(left)
    runs = cut(found.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("runs")), "repeats")
    for t in tables:
        drop_cut(t)
    release(spark)
    return runs


def _strip(length):
    def run(batches):
        for b in batches:
            rows = []
            for text, runs in zip(text_bytes(b.column(1)), b.column(2).to_pylist()):
                text = text or b""
                kept, removed, spans, at = [], 0, 0, 0
                for s, e in sorted((x["s"], x["e"] + length) for x in runs or ()):
                    if s > at or not spans:
                        kept.append(text[at:s])
                        spans += 1
                        at = s
                    if e > at:
                        removed += e - at
                        at = e
                kept.append(text[at:])
                rest = b"".join(kept)
                rows.append((len(text), removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def strip_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", length: int = 400) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and kept_text, without every byte that a string of
    `length` bytes covers which starts anywhere else too.

    An empty table gives no rows; a null id is an id like any other; other columns are left out, whatever their names.
    A null text is empty; shorter texts lose nothing. Equal rows are occurrences of their own, and so lose all
    their bytes if they have `length`. kept_text has U+FFFD where a cut parts a character; the hash is of the bytes."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(F.xxhash64(docs[id_col].cast("long"), text).alias("k1"), F.xxhash64(text, F.lit("k2"), docs[id_col].cast("long")).alias("k2"), docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    runs = repeated_windows(base.select("k1", "k2", "text"), length)
    return base.join(runs, ["k1", "k2"], "left").select("doc_id", "text", "runs").transform(mapped, _strip(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def op4(spark, sf_dir):
    return strip_repeats(table(spark, sf_dir, "documents")).drop("kept_text")

"""Sum-of-squares online packing of tokenised documents into sequences.

Each partition of the input is one packer. A document's ids are cut at the window length; its
full windows are sequences already, its remainder goes to the fill level whose choice leaves
the least sum over levels of the squared number of partly filled windows there. At the end of
a partition the windows still open are emptied in order into full ones, and the ids of the last
one are cut into runs of falling powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import mapped, text_strings

WINDOW = 1024
END = 0


class SumOfSquares:
    """count[h]: open windows filled to h. place() gives the level to fill, 0 for a new window."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.at: list[list] = [[] for _ in range(window + 1)]

    def level(self, size: int) -> int:
        """Of levels h with an open window and room: the change of the sum of squares is
        2 * (count[h + size] - count[h]) + 2, less if it closes the window; a new one changes it by
        2 * count[size] + 1. Ties go to the fullest level, so that windows close early."""
        n, w = self.count, self.window
        change = 2 * (n[size:] - n[: w - size + 1]) + 2
        change[w - size] = 1 - 2 * n[w - size]
        change[0] = 2 * n[size] + 1 if size < w else 0
        can = n[: w - size + 1] > 0
        can[0] = True
        change = np.where(can, change, np.iinfo(np.int64).max)
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def place(self, size: int, make):
        h = self.level(size)
        bin_ = self.at[h].pop() if h else make()
        if h:
            self.count[h] -= 1
        if h + size < self.window:
            self.count[h + size] += 1
            self.at[h + size].append(bin_)
        return bin_

    def left(self):
        return [b for level in self.at for b in level]


def pack_stream(docs, window: int = WINDOW):
    """docs: (key, ids) pairs; yields (key, start, ids, doc_tokens, sequence, offset) of each piece.

    Sequences count from 0 without gaps. Open windows hold their pieces until they are full:
    the packer's memory is its open windows, which the rule keeps few."""
    rule, made = SumOfSquares(window), 0

    def emit(pieces):
        nonlocal made
        at = 0
        for key, start, ids, n in pieces:
            yield key, start, ids, n, made, at
            at += len(ids)
        made += 1

    for key, ids in docs:
        n, whole = len(ids), len(ids) // window * window
        for k in range(0, whole, window):
            yield from emit([(key, k, ids[k : k + window], n)])
        if n > whole:
            bin_ = rule.place(n - whole, list)
            bin_.append((key, whole, ids[whole:].copy(), n))  # a view would hold all ids of the document
            if sum(len(x[2]) for x in bin_) == window:
                yield from emit(bin_)
    pieces, room = [], window
    rest = rule.left()
    total = sum(len(x[2]) for b in rest for x in b)
    widths = [window] * (total // window) + [1 << k for k in range(window.bit_length() - 1, -1, -1) if (total % window) >> k & 1]
    widths = iter(widths)
    room = next(widths, 0)
    for bin_ in rest:
        for key, start, ids, n in bin_:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                pieces.append((key, start, part, n))
                start += len(part)
                room -= len(part)
                if not room:
                    yield from emit(pieces)
                    pieces, room = [], next(widths, 0)


def pack(docs: DataFrame, *, id_col="doc_id", text_col="text", tokenizer=None, window=WINDOW, end=END, with_ids=True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (or only ids_crc32), doc_tokens, sequence_id, offset.

    An empty table gives no rows; other columns are left out, whatever their names. A null text is empty and still has the end id. Rows that repeat an id are documents of their
    own. sequence_id is the partition's number times 2^32 and the packer's count, unique over
    the table. No shuffle: a lost task packs its partition again, to the same result."""
    schema = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        from .subwords import encoder

        enc, base = encoder(tokenizer), TaskContext.get().partitionId() << 32
        tail = np.array([end], dtype="<u2").tobytes()

        texts = ((key, text or "") for b in batches for key, text in zip(b.column(0).to_pylist(), text_strings(b.column(1))))
        source = ((key, np.frombuffer(ids + tail, dtype="<u2")) for key, ids in enc.encode_all(texts))
        rows = []

        def batch():
            cols = list(zip(*[(k, s, len(i), zlib.crc32(i.astype("<u4").tobytes()), n, base + q, o) for k, s, i, n, q, o in rows]))
            arrays = [pa.array(c, pa.int64()) for c in cols]
            if with_ids:
                offsets = np.cumsum([0] + [len(i) for _, _, i, *_ in rows])
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([i for _, _, i, *_ in rows]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, [*names, "ids"][: len(arrays)])

        for row in pack_stream(source, window):
            rows.append(row)
            if len(rows) >= 4096:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).transform(mapped, run, schema)


def op5(spark, sf_dir):
    from .common import table

    return pack(table(spark, sf_dir, "documents"), with_ids=False)

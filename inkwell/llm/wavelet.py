"""Token ids as a wavelet matrix per shard: succinct bit-planes with rank and select.

A shard is one file: its documents' ids and token counts, and a bit-plane for each bit of a symbol, most
significant first. A plane is cut into blocks that are compressed alone, with their offsets, and its
directory stands beside them as it is used: ones before each 4096 bits, ones from there before each
512, and the place of every 4096th one and zero. So opening a shard reads its header; access, rank (counting)
and select (occurrence lookup) unpack one or two blocks a plane, and nothing is rebuilt. Shards lie in
the shared folder as one-row Parquet files, which any store that Spark writes can hold.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mapped, release, text_strings

MAGIC = b"WMX2"
#: Tokens of a shard, at most one document over: what one task holds at a time.
SHARD_TOKENS = 2_000_000
END = 0
#: Bits between entries of the fine and the coarse directory and between select samples; bits of a compressed block.
_FINE, _COARSE, _SAMPLE, _BLOCK = 512, 4096, 4096, 1 << 16
#: Blocks that an opened shard keeps unpacked.
_HELD = 1024


def _plane(one: np.ndarray, ones_at: np.ndarray, zeros_at: np.ndarray, squeeze) -> list[bytes]:
    """The parts of a plane's section: zeros, coarse, fine, samples of ones and zeros, offsets of blocks, blocks."""
    n = len(one)
    bits = np.zeros(-(-max(n, 1) // _COARSE) * _COARSE // 8, dtype=np.uint8)
    packed = np.packbits(one, bitorder="little")
    bits[: len(packed)] = packed
    ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, _FINE // 64).sum(axis=1, dtype=np.uint32)
    ones = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
    coarse = ones[:: _COARSE // _FINE]
    fine = (ones[:-1] - np.repeat(coarse[:-1], _COARSE // _FINE)).astype("<u2")
    blocks = [squeeze(packed[s : s + _BLOCK // 8].tobytes()) for s in range(0, len(packed), _BLOCK // 8)]
    offsets = np.cumsum([0] + [len(x) for x in blocks])
    return [struct.pack("<Q", len(zeros_at)), *[np.ascontiguousarray(x, dtype=t).tobytes() for x, t in ((coarse, "<u4"), (fine, "<u2"), (ones_at[::_SAMPLE], "<u4"), (zeros_at[::_SAMPLE], "<u4"), (offsets, "<u4"))], b"".join(blocks)]


def _planes(ids: np.ndarray, depth: int, squeeze) -> list[bytes]:
    parts, x = [], ids
    for k in range(depth - 1, -1, -1):
        one = (x & x.dtype.type(1 << k)) != 0
        ones_at, zeros_at = np.flatnonzero(one), np.flatnonzero(~one)
        parts += _plane(one, ones_at, zeros_at, squeeze)
        if k:
            x = np.concatenate([x.take(zeros_at), x.take(ones_at)])
    return parts


_PARTS = 7  # of a plane's section


class WaveletMatrix:
    """A shard's planes, as they stand in its file. access(i): the symbol at i, or those of an array of places;
    rank(symbol, i): occurrences before i; select(symbol, k): place of the k-th (from 0)."""

    def __init__(self, parts: list, n: int, depth: int):
        self.n, self.depth = n, depth
        self.zeros, self.coarse, self.fine, self.samples, self.blocks = [], [], [], [], []
        for k in range(depth):
            zeros, coarse, fine, ones_at, zeros_at, offsets, data = parts[k * _PARTS : (k + 1) * _PARTS]
            self.zeros.append(struct.unpack("<Q", zeros)[0])
            self.coarse.append(np.frombuffer(coarse, "<u4"))
            self.fine.append(np.frombuffer(fine, "<u2"))
            self.samples.append((np.frombuffer(zeros_at, "<u4"), np.frombuffer(ones_at, "<u4")))
            self.blocks.append((np.frombuffer(offsets, "<u4"), data))
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.unpacked = 0  # blocks so far
        self._unzip = zstandard.ZstdDecompressor().decompress

    @classmethod
    def build(cls, ids: np.ndarray, depth: int | None = None) -> "WaveletMatrix":
        ids, depth = _symbols(ids, depth)
        return cls(_planes(ids, depth, zstandard.ZstdCompressor(level=1).compress), len(ids), depth)

    def _block(self, level: int, b: int) -> np.ndarray:
        """Packed bits of a block, little bit order."""
        found = self.held.get((level, b))
        if found is None:
            if len(self.held) >= _HELD:
                self.held.pop(next(iter(self.held)))
            offsets, data = self.blocks[level]
            found = self.held[level, b] = np.frombuffer(self._unzip(data[offsets[b] : offsets[b + 1]]), np.uint8)
            self.unpacked += 1
        return found

    def decode(self) -> np.ndarray:
        """All symbols in order: access to every place at once. The ranks of all places of a plane in a row are its stable
        partition, which is undone from the last plane up; the directory's count of zeros must agree with it."""
        out = np.zeros(self.n, dtype=np.uint32 if self.depth > 16 else np.uint16)
        for k in range(self.depth):
            level = self.depth - 1 - k
            offsets, data = self.blocks[level]
            packed = b"".join(self._unzip(data[offsets[b] : offsets[b + 1]]) for b in range(len(offsets) - 1))
            one = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            if self.n - int(np.count_nonzero(one)) != z:
                raise ValueError("the shard's directory does not fit its planes")
            if k:
                up = np.empty_like(out)
                up[~one], up[one] = out[:z], out[z:]
                out = up
            out |= one.astype(out.dtype) << out.dtype.type(k)
        return out

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i: two entries of the directory and at most 512 bits."""
        f = i // _FINE
        if f >= len(self.fine[level]):
            return int(self.coarse[level][-1])
        found = int(self.coarse[level][i // _COARSE]) + int(self.fine[level][f])
        rest = i - f * _FINE
        if rest:
            at = f * _FINE % _BLOCK // 8
            p = self._block(level, i // _BLOCK)[at : at + (rest + 7) // 8]
            found += int(np.unpackbits(p, count=min(rest, 8 * len(p)), bitorder="little").sum())
        return found

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // _BLOCK)[i % _BLOCK >> 3]) >> (i & 7) & 1

    def access(self, i):
        if isinstance(i, np.ndarray):
            return np.array([self.access(int(x)) for x in i], dtype=np.int64)
        symbol = 0
        for level in range(self.depth):
            bit, ones = self._bit(level, i), self._ones(level, i)
            symbol = symbol << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return symbol

    def _range(self, symbol: int, i: int, j: int) -> tuple[int, int]:
        for level in range(self.depth):
            a, b = self._ones(level, i), self._ones(level, j)
            i, j = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (self.depth - 1 - level) & 1 else (i - a, j - b)
        return i, j

    def rank(self, symbol: int, i: int) -> int:
        return self.count(symbol, 0, i)

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        if symbol >> self.depth:
            return 0
        a, b = self._range(symbol, start, self.n if stop is None else stop)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th bit of that kind in a plane: between two samples, then by the directory."""
        samples = self.samples[level][bit]
        s = k // _SAMPLE
        lo = int(samples[s]) // _FINE
        hi = int(samples[s + 1]) // _FINE if s + 1 < len(samples) else len(self.fine[level]) - 1
        f = np.arange(lo, hi + 1)
        before = self.coarse[level][f * _FINE // _COARSE].astype(np.int64) + self.fine[level][f]
        if not bit:
            before = f * _FINE - before
        f = lo + int(np.searchsorted(before, k, side="right")) - 1
        at = f * _FINE % _BLOCK // 8
        bits = np.unpackbits(self._block(level, f * _FINE // _BLOCK)[at : at + _FINE // 8], bitorder="little")
        return f * _FINE + int(np.flatnonzero(bits == bit)[k - int(before[f - lo])])

    def select(self, symbol: int, k: int) -> int:
        if k < 0 or k >= self.count(symbol):
            raise IndexError("no such occurrence")
        i = self._range(symbol, 0, self.n)[0] + k
        for level in range(self.depth - 1, -1, -1):
            bit = symbol >> (self.depth - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]


def _symbols(ids: np.ndarray, depth: int | None) -> tuple[np.ndarray, int]:
    most = int(np.max(ids)) if len(ids) else 0
    return np.asarray(ids, dtype=np.uint32 if most > 65535 else np.uint16), depth or max(1, most.bit_length())


def to_blob(doc_ids, counts, ids: np.ndarray, depth: int | None = None) -> bytes:
    """MAGIC, n documents, n tokens, depth; the length of each part; the parts: ids of documents (int64, with a mask
    byte each for null) and token counts (uint32), zstd each, then those of the planes."""
    zip_ = zstandard.ZstdCompressor(level=1).compress
    ids, depth = _symbols(ids, depth)
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    parts = [zip_(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()), zip_(null.tobytes()), zip_(np.asarray(counts, dtype="<u4").tobytes()), *_planes(ids, depth, zip_)]
    return b"".join([MAGIC, struct.pack("<QQI", len(null), len(ids), depth), struct.pack(f"<{len(parts)}Q", *map(len, parts)), *parts])


def from_blob(blob: bytes):
    """(doc ids, token counts, WaveletMatrix), of which only the former two are unpacked."""
    if blob[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    n_docs, n, depth = struct.unpack_from("<QQI", blob, 4)
    sizes = struct.unpack_from(f"<{3 + _PARTS * depth}Q", blob, 24)
    at, parts, view = 24 + 8 * len(sizes), [], memoryview(blob)
    for size in sizes:
        parts.append(view[at : at + size])
        at += size
    ids, null, counts = map(zstandard.ZstdDecompressor().decompress, parts[:3])
    ids = np.frombuffer(ids, "<i8").tolist()
    return [None if null[i] else ids[i] for i in range(n_docs)], np.frombuffer(counts, "<u4"), WaveletMatrix(parts[3:], n, depth)


def write_shards(docs: DataFrame, *, id_col="doc_id", text_col="text", tokenizer=None, end=END, shard_tokens=SHARD_TOKENS) -> DataFrame:
    """Encode every document in ascending id order and write the shards; one row a shard:
    part, shard (in order), n_docs, n_tokens, blob. Null ids come first; of equal ids the lesser text.

    A null text is empty and has the end id alone; an empty table gives no shards; texts are encoded whole, and one
    longer than a shard has a shard of its own. Other columns of docs are left out, whatever their names."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    # bounds of the ranges from the ids alone: a range exchange would read the texts twice, once to sample
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [k / n_parts for k in range(1, n_parts)]
    bounds = sorted(set(rows.stat.approxQuantile("_id", steps, 0.2 / n_parts))) if steps else []
    bounds = [int(b) for b in bounds]
    part = F.lit(0)
    if bounds:
        edges = F.array(*[F.lit(b).cast("long") for b in bounds])
        part = F.coalesce(F.size(F.filter(edges, lambda b: b <= F.col("_id"))), F.lit(0))
    dealt = rows.withColumn("_part", part.cast("int")).repartitionById(len(bounds) + 1, F.col("_part")).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")

    def run(batches):
        from .subwords import encoder

        enc, shard = encoder(tokenizer), 0
        tail = np.array([end], dtype="<u2").tobytes()
        ids, parts, total, where = [], [], 0, 0

        def flush():
            counts = [len(p) // 2 for p in parts]
            blob = to_blob(ids, counts, np.frombuffer(b"".join(parts), dtype="<u2"))
            return pa.RecordBatch.from_arrays([pa.array([where], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64()), pa.array([blob], pa.binary())], ["part", "shard", "n_docs", "n_tokens", "blob"])

        rows = (((key, place), text or "") for b in batches for key, text, place in zip(b.column(0).to_pylist(), text_strings(b.column(1)), b.column(2).to_pylist()))
        for (key, where), p in enc.encode_all(rows):
            ids.append(key)
            parts.append(p + tail)
            total += len(p) // 2 + 1
            if total >= shard_tokens:
                yield flush()
                ids, parts, total, shard = [], [], 0, shard + 1
        if ids:
            yield flush()

    out = cut(mapped(dealt, run, "part int, shard int, n_docs long, n_tokens long, blob binary"), "wavelet")
    release(spark)
    return out


def read_shards(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the shards' files: its id, start (ids before it in all shards), n_tokens, ids_crc32.

    The last ids of some 64 documents a shard are looked up by access as well, through the file's directory, and must be those of
    the whole read; a file that doesn't fit raises. No shards give no rows."""
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", "n_tokens").withColumn("first", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))  # one row a shard

    def run(batches):
        for b in batches:
            for part, shard, blob in zip(*[c.to_pylist() for c in b.columns]):
                ids, counts, wm = from_blob(blob)
                tokens = wm.decode().astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                begins = ends - counts
                last = ends[:: max(1, len(ends) // 64)] - 1
                if (wm.access(last) != tokens[last]).any():
                    raise ValueError("the shard's directory does not fit its planes")
                crc = [zlib.crc32(tokens[a:z].tobytes()) for a, z in zip(begins.tolist(), ends.tolist())]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "shard", id_col, "begin", "n_tokens", "ids_crc32"])

    docs = mapped(shards.select("part", "shard", "blob"), run, f"part int, shard int, {id_col} long, begin long, n_tokens long, ids_crc32 long")
    return docs.join(starts.drop("n_tokens"), ["part", "shard"]).select(id_col, (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op8(spark, sf_dir):
    from .common import table

    return read_shards(write_shards(table(spark, sf_dir, "documents")))

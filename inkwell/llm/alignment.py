"""Cross-tokenizer alignment with each distinct segment tokenised and aligned once.

Texts are split before runs of white space, at places where no entry of either vocabulary goes on: so no
merge of either tokenizer crosses them, and a text's tokens are those of its segments in a row. Blocks of
documents become codes into a list of their distinct segments; the distinct segments of all blocks are
tokenised and aligned; what became of each is joined back to the blocks, where documents are composed. Links are
counted from segments and how often these occur, never from the texts again.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _trim, cut, drop_cut, mapped, release, table, text_bytes

#: Bytes of text of a block, at most one document over: what a task holds of it at a time, some ten times as much in all.
BLOCK_BYTES = 16 << 20
#: Share of all blocks that hold a segment which is sent to every task, and bytes that it has at most.
HOT_SHARE, HOT_BYTES = 0.25, 64
NOT_HOT = (1 << 32) - 1
#: What is known of a segment, from which its other counts follow (no groups: no tokens); counts of a document.
FACTS = ["n_a", "n_best", "count_sum", "groups"]
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
#: White space that a segment may begin with, if the vocabularies allow it.
SPACES = " \t\n\v\f\r"
#: Fixed value of the second tokenizer's files: its space.
META = "▁"
_DOCS = "block long, doc_ids array<long>, sizes array<int>, codes binary, segs array<string>, counts array<long>"


class SegmentAligner:
    """Two tokenizers, the split that both allow, and the alignment of a segment."""

    def __init__(self, byte_bpe: str | None = None, piece_bpe: str | None = None):
        import public_tokenizers
        import sentencepiece

        from .subwords import BYTE_CHARS, encoder

        self.a = encoder(byte_bpe).tokenizer
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe or public_tokenizers.path("piece_bpe_32k.model"))
        byte_of = {chr(c): b for b, c in BYTE_CHARS.items()}
        n_a = self.a.get_vocab_size()
        tokens = [self.a.id_to_token(i) for i in range(n_a)]
        self.a_bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(pieces)]
        if self.b.encode(" a  b \n") != self.b.encode(" a") + self.b.encode("\n " + " b \n")[2:]:
            raise ValueError("the piece model changes white space")
        self.breaks = self._breaks([p for i, p in enumerate(pieces) if not self.b.is_byte(i)])
        inner = re.escape(self.breaks)
        self.segments = re.compile(rf"\s+\S*(?:(?![{inner}])\s+\S*)*").findall
        self.space = self.b.encode("\n")[0]
        if pieces[self.space] != META or any("\n" in p and len(p) > 1 for p in pieces):
            raise ValueError("the piece model merges line feeds")

    def _breaks(self, pieces: list[str]) -> str:
        """White space before which both split: no entry of either vocabulary holds it after anything but white space."""
        entries = [t.decode("utf-8", "replace") for t in self.a_bytes] + [p.replace(META, " ") for p in pieces]
        found = "".join(w for w in SPACES if not any(re.search(r"\S" + re.escape(w), e) for e in entries if w in e))
        if " " not in found:
            raise ValueError("the vocabularies merge across spaces")
        return found

    def split(self, text: str) -> list[str]:
        """Segments of a space and the text; each begins with white space."""
        return self.segments(" " + text)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each segment by either tokenizer, as within a text that it is part of."""
        first = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        # the piece model puts a space before what it is given
        plain = [len(s) > 1 and s[0] == " " for s in segments]
        second = self.b.encode([s[1:] if p else "\n" + s for s, p in zip(segments, plain)], num_threads=1)
        return first, [x if p else x[2:] for x, p in zip(second, plain)]

    def align(self, segment: bytes, a: list[int], b: list[int]) -> tuple[int, str, list[int]]:
        """(ids by the first, groups as text, linked pairs); none where either's bytes differ from the segment's."""
        bytes_a, bytes_b = self.a_bytes, self.b_bytes
        if b"".join([bytes_a[x] for x in a]) != segment or b"".join([bytes_b[x] for x in b]) != segment:
            return 0, "", []
        i = j = at_a = at_b = from_i = from_j = 0
        groups, links = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(bytes_a[a[i]])
                i += 1
            else:
                at_b += len(bytes_b[b[j]])
                j += 1
            if at_a == at_b:
                groups.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
                links.append(a[i - 1] << 32 | b[j - 1])
                from_i, from_j = i, j
        return len(a), ";".join(groups), links


_ALIGNERS: dict = {}


def aligner(byte_bpe: str | None = None, piece_bpe: str | None = None) -> SegmentAligner:
    """One per Python worker and pair of files."""
    if (byte_bpe, piece_bpe) not in _ALIGNERS:
        _ALIGNERS[byte_bpe, piece_bpe] = SegmentAligner(byte_bpe, piece_bpe)
    return _ALIGNERS[byte_bpe, piece_bpe]


class _Codes(dict):
    def __missing__(self, key):
        self[key] = found = len(self)
        return found


def _pack(codes: array) -> bytes:
    """Codes byte plane by byte plane, under zstd: high bytes are nearly always zero."""
    planes = np.frombuffer(codes, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(docs: DataFrame, id_col: str, text_col: str, files: tuple, block_bytes: int) -> DataFrame:
    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))

    def run(batches):
        split = aligner(*files).split
        ids, sizes, codes, known, held, n = [], [], array("I"), _Codes(), 0, 0
        part = TaskContext.get().partitionId()

        def flush():
            segs = list(known)
            counts = np.bincount(np.frombuffer(codes, dtype=np.uint32), minlength=len(segs))
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([_pack(codes)], pa.binary()), pa.array([segs], pa.list_(pa.string())), pa.array([counts.astype(np.int64)], pa.list_(pa.int64()))],
                ["block", "doc_ids", "sizes", "codes", "segs", "counts"],
            )

        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                try:
                    text = raw.decode() if raw else ""
                except UnicodeDecodeError:  # no text that a tokenizer could give back
                    text = ""
                found = split(text) if text else []
                codes.extend(map(known.__getitem__, found))
                ids.append(key)
                sizes.append(len(found))
                held += len(raw or b"") + 64
                if held >= block_bytes:
                    yield flush()
                    ids, sizes, codes, known, held, n = [], [], array("I"), _Codes(), 0, n + 1
        if ids:
            yield flush()

    return cut(mapped(rows, run, _DOCS), "blocks", "zstd")


def align_tokens(docs: DataFrame, *, id_col="doc_id", text_col="text", byte_bpe=None, piece_bpe=None, block_bytes=BLOCK_BYTES, hot_share=HOT_SHARE) -> DataFrame:
    """Per document, of a space and its text under both tokenizers: id_col, n_a, n_b (tokens), n_groups (parts between byte
    offsets where tokens of both end), n_links (pairs of tokens that end together), n_best (links whose
    count is the highest of any with their second id), count_sum (of the links' counts) and groups (text of ids `a1,a2|b1;a3|b2`). A
    pair of ids counts as often as links of all documents hold it.

    A null or empty text, or one whose tokens by either don't give its bytes back, has no tokens: zeros, groups '', and adds
    to no count. Repeated rows have a row each and count each; ties for the highest all count as best. An empty table gives no rows;
    other columns are left out, whatever their names. Texts are taken whole: a task holds a block (16 MB of texts, or one
    longer text). Segments of at most HOT_BYTES bytes that hot_share of all blocks hold are sent to every task: together they
    have at most 1 / hot_share times the bytes of a mean block. All others come back by a join with the blocks that hold them."""
    spark, files = docs.sparkSession, (byte_bpe, piece_bpe)
    blocks = _blocks(docs, id_col, text_col, files, block_bytes)
    each = blocks.select("block", F.posexplode(F.arrays_zip("segs", "counts")).alias("at", "x")).select("block", "at", F.col("x.segs").alias("seg"), F.col("x.counts").alias("n"))

    def run(batches):
        own = aligner(*files)
        for b in batches:
            segs, raw = b.column(0).to_pylist(), text_bytes(b.column(0))
            rows = [own.align(*x) for x in zip(raw, *own.encode(segs))]
            n_a, groups, links = zip(*rows) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_a, pa.int64()), pa.array(groups, pa.string()), pa.array(links, pa.list_(pa.int64()))], ["seg", "n", "held", "n_a", "groups", "links"])

    distinct = each.groupBy("seg").agg(F.sum("n").alias("n"), F.count("*").alias("held"))
    aligned = cut(mapped(distinct, run, "seg string, n long, held long, n_a long, groups string, links array<long>"), "aligned", "zstd")
    release(spark)
    pairs = cut(_pair_counts(blocks, each, aligned), "pairs")
    second = F.expr("pair & 4294967295")
    highest = pairs.groupBy(second.alias("b")).agg(F.max("count").alias("highest"))
    ranked = pairs.withColumn("b", second).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    kept = ("held", "n_a", "groups")
    ones = aligned.select("seg", *kept, F.explode_outer("links").alias("pair")).join(ranked, "pair", "left")
    sums = ones.groupBy("seg").agg(*[F.first(c).alias(c) for c in kept], F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    known = cut(sums, "known", "zstd")
    for x in (aligned, pairs):
        drop_cut(x)
    release(spark)

    n_blocks = blocks.select("block").count()
    hot = known.filter((F.col("held") >= hot_share * n_blocks) & (F.octet_length("seg") <= HOT_BYTES))
    sent = spark.sparkContext.broadcast(_ipc(hot.select("seg", *FACTS).toArrow()))
    seg_of_hot = F.broadcast(hot.select("seg"))
    cold = known.join(seg_of_hot, "seg", "left_anti").select("seg", *FACTS)
    back = each.drop("n").join(seg_of_hot, "seg", "left_anti").join(cold, "seg").select(F.col("block").alias("of"), "at", *FACTS)
    schema = "block long, doc_ids array<long>, sizes array<int>, codes binary, hot binary"

    def places(batches):
        index = None
        for b in batches:
            index = index or {x: i for i, x in enumerate(_table(sent.value).column("seg").to_pylist())}
            for k, segs in enumerate(b.column(4).to_pylist()):
                at = array("I", [index.get(x, NOT_HOT) for x in segs])
                yield pa.RecordBatch.from_arrays([*[c.slice(k, 1) for c in b.columns[:4]], pa.array([_pack(at)], pa.binary())], ["block", "doc_ids", "sizes", "codes", "hot"])

    held = mapped(blocks.select("block", "doc_ids", "sizes", "codes", "segs"), places, schema)

    def compose(block: pa.Table, facts: pa.Table) -> pa.Table:
        ids, sizes, codes, at = (block.column(c)[0].as_py() for c in ("doc_ids", "sizes", "codes", "hot"))
        sizes, codes, at = np.array(sizes, dtype=np.int64), _unpack(codes), _unpack(at).astype(np.int64)
        everywhere = _table(sent.value)
        mine = pa.concat_tables([everywhere.select(FACTS).take(pa.array(at[at != NOT_HOT])), facts.select(FACTS)])
        place = np.empty(len(at), dtype=np.int32)
        place[np.flatnonzero(at != NOT_HOT)] = np.arange(len(mine) - len(facts))
        place[facts.column("at").to_numpy()] = np.arange(len(mine) - len(facts), len(mine))
        row = place[codes]
        ends = np.cumsum(sizes)
        text = mine.column("groups")
        some = pc.not_equal(text, "").to_numpy()
        known = {c: mine.column(c).fill_null(0).to_numpy() for c in FACTS[:3]}
        known["n_groups"] = known["n_links"] = some + pc.count_substring(text, ";").to_numpy().astype(np.int64)
        known["n_b"] = pc.count_substring(text, ",").to_numpy() + 2 * known["n_groups"] - known["n_a"]  # a list of n ids has n - 1 commas
        whole = ~_any(~some[row], sizes) & (sizes > 0)
        out = [pa.array(ids, pa.int64())]
        for c in COUNTS:
            total = np.concatenate([[0], np.cumsum(known[c][row])])
            out.append(pa.array(np.where(whole, total[ends] - total[ends - sizes], 0), pa.int64()))
        texts = text.to_pylist()
        out.append(pa.array([";".join([texts[r] for r in row[z - n : z].tolist()]) if w else "" for z, n, w in zip(ends.tolist(), sizes.tolist(), whole.tolist())], pa.string()))
        made = pa.table(out, names=[id_col, *COUNTS, "groups"])
        _trim()
        return made

    return held.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(compose, f"{id_col} long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups string")


def _pair_counts(blocks: DataFrame, each: DataFrame, aligned: DataFrame) -> DataFrame:
    """How many links of all documents hold each pair of ids: segments' links, as often as documents with tokens hold the segment."""
    broken = each.join(aligned.filter("groups = ''").select("seg"), "seg").groupBy("block").agg(F.collect_set("at").alias("broken"))

    def lost(batches):
        for b in batches:
            for sizes, packed, segs, bad in zip(*[c.to_pylist() for c in b.columns]):
                codes = _unpack(packed)
                off = np.zeros(len(segs), dtype=bool)
                off[bad] = True
                out = np.repeat(_any(off[codes], np.array(sizes)), sizes)
                n = np.bincount(codes[out], minlength=len(segs))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([segs[i] for i in at.tolist()], pa.string()), pa.array(-n[at], pa.int64())], ["seg", "n"])

    minus = mapped(blocks.join(broken, "block").select("sizes", "codes", "segs", "broken"), lost, "seg string, n long")
    off = minus.groupBy("seg").agg(F.sum("n").alias("off"))
    linked = aligned.filter("groups <> ''").select("seg", "n", "links").join(off, "seg", "left").select((F.col("n") + F.coalesce("off", F.lit(0))).alias("n"), F.explode("links").alias("pair"))
    return linked.groupBy("pair").agg(F.sum("n").alias("count"))


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _table(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_all()


def _any(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether any flag of each stretch of the given sizes is set."""
    total = np.concatenate([[0], np.cumsum(flags)])
    ends = np.cumsum(sizes)
    return total[ends] > total[ends - sizes]


def op13(spark, sf_dir):
    made = align_tokens(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))

"""N-gram Jaccard join in size-banded tiles with bitmap signatures.

Two sets of a Jaccard of t or more differ in few elements, at most d for sets of a size band. If the
hash range of elements is cut into more than d parts, two such sets agree in one part at
least, whole. So each set gets a key a part, of all its elements there; sets with the same key form
a tile of the band. Tiles of one set, almost all, end there. In the others, a set's parity bitmap
(bit h mod B flips with each element of hash h) bounds the overlap from above: sets differ in at
least as many elements as their bitmaps in bits. What passes is settled by intersecting the
sorted arrays of element hashes.

Equal sets are one class from the start. Each set is first tested against one hub, the first set of
the most of its tiles; what that connects needs no further test. Tiles that still hold several
components are tested in blocks: first a forest of the pairs that may link, then, of the tiles that hold
several components even so, all pairs across them. So no pairs are listed within a group of copies,
and no link between components is missed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, drop_cut, mapped, release, table, text_bytes
from .graph import components

U = np.uint64
#: Ratio of a band's bounds; sets of a tile's block.
BAND, BLOCK = 1.45, 1024
#: Words of a memo's generation, whose hash a worker remembers; classes a task remembers having seen, likewise.
MEMO, RECENT = 100_000, 50_000
_MUL = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = x + U(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_WORDS = Memo(xxhash.xxh3_64_intdigest, MEMO)


class Recent:
    """new(x) is False for what a task has met lately: repeats that stand far apart pass, and bound its memory."""

    def __init__(self):
        self.now, self.older = set(), set()

    def new(self, x) -> bool:
        if x in self.now or x in self.older:
            return False
        if len(self.now) >= RECENT:
            self.now, self.older = set(), self.now
        self.now.add(x)
        return True


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=U)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=U, count=len(words))
    k = min(n, len(words))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = mixed(out * _MUL + h[i : len(h) - k + 1 + i])
    return np.unique(mixed(out, k))


@functools.lru_cache(maxsize=None)
def bands(num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(least size, next band's least, parts, spare parts) of each band. parts exceed by 1 + spare
    what two linked sets can differ in, of which the lesser lies in the band."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low + 1, int(low * BAND))
        top = (high - 1) + den * (high - 1) // num
        d = max(s - 2 * -(-num * s // (num + den)) for s in range(max(2, top - 2 * den), top + 1))
        spare = (1 + (d + 1) // 8) if d else 0
        out.append((low, high, max(0, d) + 1 + spare if d > 0 else 0, spare))
        low = high
    return out


def bands_of(size: int, num: int, den: int) -> list[int]:
    """The band of a set's size, and the one below where lesser sets may link with it."""
    table = bands(num, den)
    lo, hi = 0, len(table) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if table[mid][0] <= size else (lo, mid - 1)
    return [lo, lo - 1] if lo and den * (table[lo][0] - 1) // num >= size else [lo]


def keys_of(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Tile keys of a set. An empty part gives a key only in sets with more empty parts than are
    spare: two linked sets agree in 1 + spare parts, so where all of these are empty both sets have that many."""
    total = np.concatenate([np.zeros(1, dtype=U), np.cumsum(mixed(h, 7))])
    out = []
    for band in bands_of(len(h), num, den):
        m, spare = bands(num, den)[band][2:]
        if not m:
            continue
        edges = (np.arange(m + 1, dtype=U) << U(32)) // U(m)
        at = np.searchsorted(h >> U(32), edges)
        at[-1] = len(h)
        part = total[at[1:]] - total[at[:-1]]
        key = mixed(part + mixed(np.arange(m, dtype=U) + U(band << 40), 11), 13)
        full = at[1:] > at[:-1]
        out.append(key if (~full).sum() > spare else key[full])
    return np.concatenate(out) if out else np.empty(0, dtype=U)


def class_of(h: np.ndarray) -> int:
    return int(np.add.reduce(mixed(h, 3)) ^ mixed(np.array([len(h)], dtype=U), 5)[0])


def bitmap(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Parity bitmap of a power of two of bits, twice the band's sizes or more."""
    high = bands(num, den)[bands_of(len(h), num, den)[0]][1]
    bits = min(1 << 20, max(256, 1 << (2 * high - 1).bit_length()))
    odd = np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(n, num, den):
    def run(batches):
        seen = Recent()
        for b in batches:
            size, cls, keys = [], [], []
            for text in text_bytes(b.column(1)):
                h = shingles(text or b"", n)
                size.append(len(h))
                c = class_of(h) if len(h) else None
                cls.append(None if c is None else c - (1 << 64) if c >> 63 else c)
                keys.append(keys_of(h, num, den).view(np.int64) if c is not None and seen.new(c) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "c", "keys"])

    return run


def _tiles(batches):
    """Rows (key, c) sorted: those of keys with two classes or more, with the key's first class as hub."""
    last_key = last_c = hub = None
    alone = True
    for b in batches:
        key, c = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
        if len(key) and last_key is not None and key[0] == last_key and c[0] == last_c:
            new[0] = False
        key, c = key[new], c[new]
        if not len(key):
            continue
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        goes_on = last_key is not None and key[0] == last_key
        first[0] = not goes_on
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        hubs = np.where(start >= 0, c[np.maximum(start, 0)], hub if goes_on else 0)
        follows = ~first
        live_hub = np.zeros(len(key), dtype=bool)
        live_hub[:-1] = first[:-1] & ~first[1:]
        take = follows | live_hub
        ks, cs, hs = key[take], c[take], hubs[take]
        if goes_on and alone:
            ks, cs, hs = np.concatenate([[last_key], ks]), np.concatenate([[hub], cs]), np.concatenate([[hub], hs])
        if len(ks):
            yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(cs), pa.array(hs)], ["key", "c", "hub"])
        last_key, last_c, hub, alone = int(key[-1]), int(c[-1]), int(hubs[-1]), bool(first[-1])


def _arrays(n, num, den):
    def run(batches):
        seen = Recent()
        for b in batches:
            c, size, arr, bits = [], [], [], []
            for want, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                h = shingles(text or b"", n)
                own = class_of(h) if len(h) else None
                if own is None or want is not None and own != want % (1 << 64) or not seen.new(own):
                    continue  # another row with the same id, or one more with the same text
                c.append(own - (1 << 64) if own >> 63 else own)
                size.append(len(h))
                arr.append(h.tobytes())
                bits.append(bitmap(h, num, den).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(size, pa.int64()), pa.array(arr, pa.binary()), pa.array(bits, pa.binary())], ["c", "size", "arr", "bits"])

    return run


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union, of sorted distinct arrays."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    inter = int((a[at] == b).sum()) if len(a) else 0
    return den * inter >= num * (len(a) + len(b) - inter)


def _bounded(num, den):
    """Pairs that their sizes and bitmaps let pass."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y, p, q in zip(*[b.column(k).to_pylist() for k in (2, 3, 4, 5)]):
                p, q = np.frombuffer(p, U), np.frombuffer(q, U)
                words = min(len(p), len(q))
                most = (x + y - int(np.bitwise_count(folded(p, words) ^ folded(q, words)).sum())) // 2
                ok.append(den * most >= num * (x + y - most))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])

    return run


def _exact(num, den):
    def run(batches):
        for b in batches:
            ok = pa.array([linked(np.frombuffer(x, U), np.frombuffer(y, U), num, den) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])

    return run


def _block_pairs(num, den, forest):
    """Rows (key, p, q, blk, c, comp, size, bits) sorted by tile block pair: pairs across components that the bitmaps let pass.

    forest: only pairs that join what the pairs before have not joined in the block pair, at most one a set, in
    place of all: most of what the bitmaps let pass does link, and then the others are in one component already."""

    def test(rows):
        _, p, q, blk, c, comp, size, bits = rows
        words = min(map(len, bits)) // 8
        m = np.stack([folded(np.frombuffer(x, U), words) for x in bits])
        c, comp, size, blk = np.array(c), np.array(comp), np.array(size), np.array(blk)
        left = np.flatnonzero(blk == p[0])
        right = np.flatnonzero(blk == q[0])
        us, vs = [], []
        for i in left:
            j = right[right > i] if p[0] == q[0] else right
            j = j[comp[j] != comp[i]]
            if not len(j):
                continue
            most = (size[i] + size[j] - np.bitwise_count(m[j] ^ m[i]).sum(axis=1, dtype=np.int64)) // 2
            j = j[den * most >= num * (size[i] + size[j] - most)]
            if forest:
                taken = []
                while len(j):
                    taken.append(j[0])
                    comp[comp == comp[j[0]]] = comp[i]
                    j = j[comp[j] != comp[i]]
                j = np.array(taken, dtype=np.int64)
            us.append(np.minimum(c[j], c[i]))
            vs.append(np.maximum(c[j], c[i]))
        return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64),) * 2

    def run(batches):
        held: list[list] = [[] for _ in range(8)]
        outs: list = []
        now = None

        def flush():
            u, v = (np.concatenate(x) for x in zip(*outs))
            e = np.unique(np.stack([u, v], axis=1), axis=0) if len(u) else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])

        for b in batches:
            for row in zip(*[x.to_pylist() for x in b.columns]):
                if row[:3] != now and now is not None:
                    outs.append(test(held))
                    held = [[] for _ in range(8)]
                    if sum(len(x[0]) for x in outs) > 200_000 or len(outs) > 2000:
                        yield flush()
                        outs = []
                now = row[:3]
                for h, x in zip(held, row):
                    h.append(x)
        if now is not None:
            outs.append(test(held))
            yield flush()

    return run


class JaccardJoin:
    """docs: doc_id, n_shingles, c (class, null for empty sets); classes: c, rep (smallest doc_id, null without any);
    links: u, v (classes, verified; enough of them to connect each component); members: c, component."""

    def __init__(self, docs, classes, links, members):
        self.docs, self.classes, self.links, self.members = docs, classes, links, members

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id (smallest doc_id of the component). The table of classes is
        joined to the documents, whose hot classes Spark may split; empty sets aren't joined at all."""
        comp = self.classes.join(self.members, "c", "left").withColumn("component", F.coalesce("component", "c"))
        least = comp.groupBy("component").agg(F.min("rep").alias("component_id"))
        of_class = comp.join(least, "component").select("c", "component_id")
        full = self.docs.filter("c is not null").join(of_class, "c").select("doc_id", "n_shingles", "component_id")
        return full.unionByName(self.docs.filter("c is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def jaccard_join(docs: DataFrame, *, id_col="doc_id", text_col="text", n=5, num=8, den=10) -> JaccardJoin:
    """Components of documents whose sets of n-word shingles have den * intersection >= num * union.

    An empty table gives no rows; other columns are left out, whatever their names. Null and empty texts have empty sets, which link with nothing. Rows that repeat an id are
    documents of their own, and count under that id. Rows without an id link as any others; only where all
    of a component have none is its component_id null. Texts of any length are taken whole."""
    spark = docs.sparkSession
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sets = cut(base.transform(mapped, _sets(n, num, den), "doc_id long, n_shingles long, c long, keys array<long>"), "sets")
    own = sets.select("doc_id", "n_shingles", "c")
    classes = cut(own.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("rep")), "classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = sets.filter("keys is not null").select(F.explode("keys").alias("key"), "c")
    live = cut(keyed.repartition(parts, "key").sortWithinPartitions("key", "c").transform(mapped, _tiles, "key long, c long, hub long"), "tiles")
    release(spark)
    own = cut(own, "sizes")
    drop_cut(sets)
    wanted = live.select("c").distinct().join(classes, "c").select("c", "rep")
    texts = base.join(wanted, base["doc_id"] == wanted["rep"]).select("c", "text")
    kinds = "c long, size long, arr binary, bits binary"
    found = texts.transform(mapped, _arrays(n, num, den), kinds)
    if classes.filter("rep is null").head(1):  # classes without an id: by the class of each text
        nameless = base.filter("doc_id is null").select(F.lit(None).cast("long").alias("c"), "text").distinct().transform(mapped, _arrays(n, num, den), kinds)
        found = found.unionByName(nameless.join(wanted.filter("rep is null").select("c"), "c", "left_semi").dropDuplicates(["c"]))
    arrays = cut(found, "arrays")
    release(spark)
    signs = arrays.select("c", "size", "bits")

    def bounded(pairs):
        both = pairs.join(signs.toDF("u", "su", "p"), "u").join(signs.toDF("v", "sv", "q"), "v").filter(den * F.least("su", "sv") >= num * F.greatest("su", "sv"))
        return both.select("u", "v", "su", "sv", "p", "q").transform(mapped, _bounded(num, den), "u long, v long").distinct()

    def exact(pairs):
        left, right = arrays.select(F.col("c").alias("u"), F.col("arr").alias("x")), arrays.select(F.col("c").alias("v"), F.col("arr").alias("y"))
        out = cut(pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").transform(mapped, _exact(num, den), "u long, v long").distinct(), "links")
        release(spark)
        return out

    # each set's hub of the most common tiles first
    shared = live.filter("c != hub").groupBy(F.col("hub").alias("u"), F.col("c").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    stars = cut(bounded(shared.select("u", "v")).join(shared, ["u", "v"]), "stars")
    release(spark)
    near = stars.groupBy("v").agg(F.max_by("u", F.struct("n", "u")).alias("u")).select("u", "v")
    links = exact(near)

    def joined(known):
        return cut(components(known).select(F.col("node").alias("c"), "component"), "members")

    def tile_pairs(members, forest):
        """Pairs of the tiles that hold several components."""
        placed = live.join(members, "c", "left").select("key", "c", F.coalesce("component", "c").alias("comp"))
        tiles = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("sig")).filter("lo != hi")
        tiles = tiles.groupBy("n", "sig").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).alias("nb"))  # tiles of the same sets once
        rows = placed.join(tiles, "key").withColumn("blk", F.pmod(F.xxhash64("c"), "nb")).join(signs, "c")
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        rows = rows.select("key", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "blk", "c", "comp", "size", "bits")
        pairs = rows.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q").transform(mapped, _block_pairs(num, den, forest), "u long, v long").distinct()
        return cut(pairs, "pairs")

    # then the tiles that still hold several components: a forest of what may link, and at last all that is left
    members = joined(links)
    for forest in (True, False):
        pairs = tile_pairs(members, forest)
        if pairs.head(1):
            links = links.unionByName(exact(pairs))
            members = joined(links)
    return JaccardJoin(own, classes, links, members)


def op9(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"), n=4, num=85, den=100).result()

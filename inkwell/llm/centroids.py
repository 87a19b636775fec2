"""Language identification by nearest centroid: normalised TF-IDF vectors of letter n-grams against several centroids per
language, by cosine, with rejection by distance.

Letters in lower case, a space for all between two words, make n-grams of one to three characters, each an entry of a hashed
vector. Document frequencies come from all labelled documents; the centroids from a bounded sample of them, each
language's clustered by spherical k-means in a task of its own. A centroid's radius is a high quantile of
its members' distances; a text beyond that of the nearest centroid is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _trim, mapped, table, text_strings

#: Entries of a vector; longest n-gram; characters of a text that are looked at together.
BITS, LONGEST, PIECE = 15, 3, 1 << 20
#: Labelled documents that centroids are clustered from at most, shared among the languages; centroids of a language at most.
MAX_LABELLED, CLUSTERS = 2048, 4
#: Languages at most: their centroids (128 KB each) are sent to every task.
MAX_LANGUAGES = 256
#: Quantile of a centroid's members' distances that is its radius, and what it is widened by.
RADIUS_QUANTILE, RADIUS_SLACK = 0.99, 1.1
UNKNOWN = "und"
#: One odd factor a place of an n-gram, for multiplicative hashing.
_FACTORS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)
_LETTER: list = []


def _letters() -> np.ndarray:
    """Which code points are letters, for this worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Entries and counts of the n-grams of a text; none if it has no letter.

    Pieces of PIECE characters are counted one by one with what stands before them, so that a long text takes bounded memory."""
    size = 1 << BITS
    total = np.zeros(size, dtype=np.int64)
    carry = np.array([32], dtype=np.uint32)
    some = False
    for s in range(0, len(text or ""), PIECE):
        c = np.frombuffer(text[s : s + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        letter = _letters()[c]
        gap = ~letter
        gap[1:] &= gap[:-1]
        gap[0] = not letter[0] and carry[-1] == 32
        c[~letter] = 32
        c = c[~gap]
        some = some or bool(letter.any())
        total += _count(carry, c)
        carry = np.concatenate([carry, c])[-(LONGEST - 1) :]
    if not some:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if carry[-1] != 32:
        total += _count(carry, np.array([32], dtype=np.uint32))
    at = np.flatnonzero(total)
    return at, total[at]


def _count(carry: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Counts of the n-grams that end in c; of single characters letters only."""
    x = np.concatenate([carry, c])
    h, parts = x * _FACTORS[0], []
    for n in range(1, LONGEST + 1):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> 15)) * _FACTORS[1] + x[n - 1 :] * _FACTORS[n - 1]
        ends = h[max(0, len(carry) - n + 1) :]
        parts.append(ends[c != 32] if n == 1 else ends)
    h = np.concatenate(parts)
    h ^= h >> 16
    h *= _FACTORS[2]
    return np.bincount(h >> (32 - BITS), minlength=1 << BITS)


def vector(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Weights of the entries, (1 + ln count) times the entry's idf, of length 1."""
    w = (1.0 + np.log(counts[1])) * idf[counts[0]]
    return (w / max(np.sqrt(w @ w), 1e-300)).astype(np.float32)


def cluster(rows: list[tuple[np.ndarray, np.ndarray]], k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, radii) of sparse unit vectors by spherical k-means. Starts: the first row, then the row farthest from all
    starts so far, so that equal rows give equal centroids; clusters that lose their members go."""
    dense = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
    for i, (at, w) in enumerate(rows):
        dense[i, at] = w
    starts, near = [0], dense @ dense[0]
    while len(starts) < min(k, len(rows)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        starts.append(far)
        near = np.maximum(near, dense @ dense[far])
    centres, of = dense[starts], None
    for _ in range(rounds):
        now = np.argmax(dense @ centres.T, axis=1)
        if of is not None and (now == of).all():
            break
        of = now
        centres = np.stack([dense[of == c].mean(axis=0) for c in np.unique(of)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
    cos = dense @ centres.T
    of = np.argmax(cos, axis=1)
    away = 1.0 - cos[np.arange(len(rows)), of]
    radii = [float(np.quantile(away[of == c], RADIUS_QUANTILE)) if (of == c).any() else 0.0 for c in range(len(centres))]
    return centres, np.minimum(1.0, np.array(radii) * RADIUS_SLACK + 1e-6)


class Centroids:
    """classify(text) gives (language, cosine, distance, rejected); None for the language where a text has no letter."""

    def __init__(self, idf: np.ndarray, languages: list[str], centres: np.ndarray, radii: np.ndarray):
        order = sorted(range(len(languages)), key=lambda i: languages[i].encode("utf-8", "surrogatepass"))
        self.idf, self.languages = idf, [languages[i] for i in order]
        self.by_entry = np.ascontiguousarray(centres[order].T) if order else np.zeros((1 << BITS, 0), np.float32)
        self.radii = np.asarray(radii)[order] if order else np.zeros(0)

    def classify(self, text: str | None) -> tuple:
        counts = ngram_counts(text)
        if not len(counts[0]) or not self.languages:
            return None, 0.0, 1.0, True
        cos = vector(counts, self.idf) @ self.by_entry[counts[0]]
        best = int(np.argmax(cos))  # ties: the first language by code point
        score = min(1.0, max(0.0, float(cos[best])))
        return self.languages[best], score, 1.0 - score, 1.0 - score > self.radii[best]


def fit_centroids(labelled: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", max_labelled=MAX_LABELLED, clusters=CLUSTERS) -> Centroids:
    """Centroids of labelled documents (rows without a language or a letter teach nothing).

    Document frequencies are counted over all of them, each task sending one vector. The centroids come from
    max_labelled // languages (8 at least) documents a language, those of the smallest hash of id and language; of rows that share both,
    the least text. Driver and tasks get centroids, 128 KB each, and no texts; over MAX_LANGUAGES languages are an error."""
    rows = labelled.select(labelled[id_col].cast("string").alias("_i"), labelled[text_col].cast("string").alias("_t"), labelled[lang_col].cast("string").alias("_l")).filter("_l IS NOT NULL")

    def frequencies(batches):
        df, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for b in batches:
            for text in text_strings(b.column(0)):
                at, _ = ngram_counts(text)
                df[at] += 1
                n += bool(len(at))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << BITS), pa.int32()), pa.array(np.concatenate([[n], df]))], ["entry", "df"])

    counted = dict(rows.select("_t").transform(mapped, frequencies, "entry int, df long").groupBy("entry").agg(F.sum("df")).collect())  # 2 ** BITS + 1 numbers
    n = counted.pop(-1, 0)
    df = np.array([counted.get(e, 0) for e in range(1 << BITS)], dtype=np.float64)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    languages = [r[0] for r in rows.select("_l").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not languages:
        return Centroids(idf, [], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    quota = max(8, max_labelled // len(languages))
    place = F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_i"))
    few = rows.filter(F.col("_i").isNotNull()).select("_i", "_l", F.xxhash64("_i", "_l").alias("_h")).withColumn("_r", place).filter(F.col("_r") <= quota).select("_i", "_l").distinct()
    once = rows.join(F.broadcast(few), ["_i", "_l"]).groupBy("_i", "_l").agg(F.min("_t").alias("_t"))  # few: quota rows a language

    def group(t: pa.Table) -> pa.Table:
        texts = [x for _, x in sorted(zip(t.column("_i").to_pylist(), text_strings(t.column("_t"))), key=lambda p: p[0])]
        made = [(c[0], vector(c, idf)) for c in map(ngram_counts, texts) if len(c[0])]
        centres, radii = cluster(made, clusters) if made else (np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
        _trim()
        lang = t.column("_l")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(radii), pa.string()), "c": pa.array(np.arange(len(radii)), pa.int64()), "radius": pa.array(radii, pa.float64()), "centre": pa.array([x.tobytes() for x in centres], pa.binary())})

    got = sorted(once.groupBy("_l").applyInArrow(group, "lang string, c long, radius double, centre binary").collect(), key=lambda r: (r["lang"], r["c"]))
    centres = np.stack([np.frombuffer(bytes(r["centre"]), np.float32) for r in got]) if got else np.zeros((0, 1 << BITS), np.float32)
    return Centroids(idf, [r["lang"] for r in got], centres, np.array([r["radius"] for r in got]))


def predict_language(docs: DataFrame, centroids: Centroids, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: its id, lang_pred, score (cosine to the nearest centroid, 0 to 1), distance (1 - score) and rejected
    (beyond the centroid's radius).

    lang_pred is the language of the nearest centroid, of a rejected text too: its few or foreign n-grams make it
    doubtful, which the caller may act on. A text that is null, empty or has no letter is "und", score 0, rejected, as is any text
    where nothing was learned. Of languages equally near the first by code point. Rows are independent, so repeated
    ids have a row each; whole texts count, in pieces of bounded memory; other columns are left out, whatever their names. No shuffle."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((centroids.idf, centroids.languages, centroids.by_entry, centroids.radii))
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))

    def run(batches):
        idf, languages, by_entry, radii = sent.value
        own = Centroids(idf, [], None, None)
        own.languages, own.by_entry, own.radii = languages, by_entry, radii
        for b in batches:
            out = list(zip(*[own.classify(x) for x in text_strings(b.column(1))])) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x or UNKNOWN for x in out[0]], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.bool_())], [id_col, "lang_pred", "score", "distance", "rejected"])

    return source.transform(mapped, run, f"`{id_col}` {source.schema['_id'].dataType.simpleString()}, lang_pred string, score double, distance double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Whether a document may not teach: crc32 of its id's decimal digits leaves 1 by 3. One without an id is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    centroids = fit_centroids(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return predict_language(docs, centroids).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "distance", "rejected")

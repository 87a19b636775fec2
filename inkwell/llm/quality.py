"""Quality rules by line sequence labelling with a linear-chain conditional random field.

Each line with a word has indicator features; Viterbi decoding marks it content or boilerplate,
and a document is kept where enough of its word characters stand in content lines.
The field is trained here, on a bounded sample of labelled documents: a good document's lines
are content; a bad one's start as boilerplate and are decoded anew after each fit, so that its
sound lines move over.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table, text_bytes

#: Labelled documents that the field is fitted on at most, those of the smallest hash of the id.
MAX_LABELLED = 1500
#: Lines of a sequence that the field is fitted on, a longer document being several; documents' share of content that keeps them.
FIT_LINES, KEEP_SHARE = 48, 0.5
#: Fixed values of the contract: characters that are symbols, bounds of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
_SYMBOL_DROP = bytes(set(range(256)) - set(SYMBOLS))
_SPACES = b" \t\n\r\x0b\x0c"
_MARKUP = re.compile(rb"[#*$%&|<>{}\[\]!=_~^\\/]")
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_NOT_UPPER, _NOT_DIGIT = bytes(set(range(256)) - set(_UPPER)), bytes(set(range(256)) - set(_DIGIT))
_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_NOT_LETTER = bytes(set(range(256)) - set(_ASCII_LETTERS))
#: Feature bins: upper edges of each measure of a line.
EDGES = {"words": (2, 5, 12, 40), "markup": (0.001, 0.1, 0.4, 0.8), "upper": (0.02, 0.3, 0.7), "digit": (0.001, 0.15, 0.4), "repeat": (0.05, 0.35, 0.6, 0.8), "length": (2.5, 7.5, 12), "again": (0.5,), "end": (0.5,)}
_OFFSET = np.cumsum([0] + [len(e) + 1 for e in EDGES.values()])
N_FEATURES = int(_OFFSET[-1])


def line_measures(line: bytes, words: list[bytes], again: bool) -> tuple:
    n = len(words)
    size = max(1, len(line) - n + 1)
    letters = len(line.translate(None, _NOT_LETTER))
    return (n, len(_MARKUP.findall(line)) / n, len(line.translate(None, _NOT_UPPER)) / max(1, letters), len(line.translate(None, _NOT_DIGIT)) / size, 1 - len(set(words)) / n, size / n, float(again), float(line.rstrip(_SPACES)[-1:] in (b".", b"?", b":", b",", b";")))


def featurise(measures: np.ndarray) -> np.ndarray:
    """Indices of the active indicator of each measure, one column a measure."""
    cols = [np.searchsorted(np.asarray(edges), measures[:, k], side="right") + _OFFSET[k] for k, edges in enumerate(EDGES.values())]
    return np.stack(cols, axis=1)


class LineField:
    """States 0 boilerplate, 1 content; weights w[feature, state], t[from, to], start[state]."""

    def __init__(self, w=None, t=None, start=None):
        self.w = np.zeros((N_FEATURES, 2)) if w is None else np.asarray(w)
        self.t = np.zeros((2, 2)) if t is None else np.asarray(t)
        self.start = np.zeros(2) if start is None else np.asarray(start)

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi; of two equally likely paths the one with content."""
        e = self.w[features].sum(axis=1).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = e[0][0] + self.start[0], e[0][1] + self.start[1]
        back = []
        for x, y in e[1:]:
            a0, a1, b0, b1 = a + t00, b + t10, a + t01, b + t11
            back.append((int(a1 >= a0), int(b1 >= b0)))
            a, b = max(a0, a1) + x, max(b0, b1) + y
        s = int(b >= a)
        path = [s]
        for step in reversed(back):
            s = step[s]
            path.append(s)
        return np.array(path[::-1], dtype=np.int8)

    def fit(self, docs: list[np.ndarray], tags: list[np.ndarray], steps: int = 60, rate: float = 0.3, decay: float = 1e-3):
        """Maximum likelihood with a weight penalty, by Adam over forward-backward marginals."""
        n, m = len(docs), max(map(len, docs))
        f = np.zeros((n, m, len(EDGES)), dtype=np.int64)
        y, mask = np.zeros((n, m), dtype=np.int64), np.zeros((n, m), dtype=bool)
        for i, (d, g) in enumerate(zip(docs, tags)):
            f[i, : len(d)], y[i, : len(d)], mask[i, : len(d)] = d, g, True
        one = np.eye(2)[y] * mask[..., None]
        pair = np.einsum("ija,ijb->ab", one[:, :-1], one[:, 1:])
        theta = np.concatenate([self.w.ravel(), self.t.ravel(), self.start])
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            w, t, start = theta[: 2 * N_FEATURES].reshape(-1, 2), theta[2 * N_FEATURES : -2].reshape(2, 2), theta[-2:]
            e = w[f].sum(axis=2)
            alpha, beta = np.zeros((n, m, 2)), np.zeros((n, m, 2))
            alpha[:, 0] = e[:, 0] + start
            for j in range(1, m):
                alpha[:, j] = np.where(mask[:, j, None], np.logaddexp(alpha[:, j - 1, 0, None] + t[0], alpha[:, j - 1, 1, None] + t[1]) + e[:, j], alpha[:, j - 1])
            for j in range(m - 2, -1, -1):
                nxt = e[:, j + 1] + beta[:, j + 1]
                beta[:, j] = np.where(mask[:, j + 1, None], np.logaddexp(t[:, 0] + nxt[:, 0, None], t[:, 1] + nxt[:, 1, None]), 0.0)
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            marginal = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            gap = one - marginal
            gw = np.stack([np.bincount(f.ravel(), weights=np.repeat(gap[..., s].ravel(), len(EDGES)), minlength=N_FEATURES) for s in (0, 1)], axis=1)
            joint = np.exp(alpha[:, :-1, :, None] + t[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            grad = np.concatenate([gw.ravel(), (pair - joint.sum(axis=(0, 1))).ravel(), gap[:, 0].sum(axis=0)]) / n - decay * theta
            mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
            theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.w, self.t, self.start = theta[: 2 * N_FEATURES].reshape(-1, 2), theta[2 * N_FEATURES : -2].reshape(2, 2), theta[-2:]
        return self


def lines_of(text: bytes):
    """(line, words, again) of each \\n-split line with a word; again: equal to an earlier one."""
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if words := line.split():
            yield line, words, line in seen
            seen.add(line)


def features_of(text: bytes) -> np.ndarray:
    """Features of all lines of a text that have a word."""
    ms = [line_measures(*q) for q in lines_of(text)]
    return featurise(np.array(ms)) if ms else np.empty((0, len(EDGES)), dtype=np.int64)


def train_on(good: list[np.ndarray], bad: list[np.ndarray], rounds: int = 2, fit_lines: int = FIT_LINES) -> LineField:
    """Field fitted on all lines' features of documents of either label. Without documents of both, a field that keeps everything."""
    good, bad = ([d[s : s + fit_lines] for d in docs for s in range(0, len(d), fit_lines)] for docs in (good, bad))
    if not good or not bad:
        return LineField(start=np.array([0.0, 1.0]))
    field, docs = LineField(), good + bad
    tags = [np.full(len(d), int(i < len(good))) for i, d in enumerate(docs)]
    for k in range(rounds):
        field.fit(docs, tags, steps=60 if not k else 30)
        for i in range(len(good), len(docs)):
            path = field.decode(docs[i])
            tags[i] = path if (path == 0).any() else np.zeros(len(path), dtype=np.int64)
    return field


def train(good: list[bytes], bad: list[bytes], rounds: int = 2) -> LineField:
    """train_on of texts."""
    of = lambda texts: [d for d in map(features_of, texts) if len(d)]
    return train_on(of(good), of(bad), rounds)


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    code = a[:-1] * len(ids) + a[1:]
    if len(ids) > 1 << 20:
        code = np.unique(code, return_inverse=True)[1]
    code = code[:-1] * len(ids) + a[2:]
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def judge(text: bytes, field: LineField, keep_share: float = KEEP_SHARE) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept)."""
    words, ms, weight, dups = [], [], [], 0
    for line, ws, again in lines_of(text):
        words += ws
        dups += again
        ms.append(line_measures(line, ws, again))
        weight.append(len(line))
    n = len(words)
    continuation = len(text) - len(text.decode("utf-8", "replace")) if not text.isascii() else 0
    chars = len(text) - continuation - sum(map(text.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    symbols = len(text.translate(None, _SYMBOL_DROP))
    repeats = repeat_words(words)
    failed = n < LEAST_WORDS or 100 * repeats > 50 * n
    share = 0.0
    if ms:
        w = np.array(weight, dtype=np.float64)
        share = float((w * field.decode(featurise(np.array(ms)))).sum() / w.sum())
    return n, chars, symbols, dups, repeats, failed, share, not failed and share >= keep_share


def fit_field(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", max_labelled=MAX_LABELLED) -> LineField:
    """Field fitted on at most max_labelled labelled documents, whole. The same tables give the same field.

    Of rows that repeat a labelled id the least text counts, once. The driver gets the lines' features,
    a byte each, and no texts; they are made where the documents are."""
    few = labels.filter(F.col("quality").isNotNull()).select(F.col(id_col).alias("_l"), F.col("quality").cast("int").alias("_q")).groupBy("_l").agg(F.min("_q").alias("_q")).orderBy(F.xxhash64("_l"), "_l").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_t")).join(F.broadcast(few), F.col("_i") == F.col("_l"))
    once = rows.groupBy("_i", "_q").agg(F.min("_t").alias("_t")).select("_i", "_q", "_t")

    def run(batches):
        for b in batches:
            feats = [features_of(x or b"").astype(np.uint8).tobytes() for x in text_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(feats, pa.binary())], ["i", "q", "f"])

    kind = once.schema["_i"].dataType.simpleString()
    got = sorted(once.transform(mapped, run, f"i {kind}, q int, f binary").collect(), key=lambda r: r["i"])
    of = lambda q: [np.frombuffer(bytes(r["f"]), np.uint8).astype(np.int64).reshape(-1, len(EDGES)) for r in got if r["q"] == q]
    return train_on(of(1), of(0))


def quality(docs: DataFrame, field: LineField, *, id_col="doc_id", text_col="text", keep=(), keep_share=KEEP_SHARE) -> DataFrame:
    """Per document: its measures, base_failed, content_share and kept; and the columns named in keep, unchanged.

    A null or empty text has no words: it fails the base rules. Columns in keep that are named like a result
    give way to it. No shuffle; rows are independent, so repeated ids are documents of their own. The whole text counts, whatever its length."""
    w, t, start = field.w, field.t, field.start
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    cols = [id_col, *[c for c in keep if c != id_col and c not in names]]
    source = docs.select(docs[text_col].cast("string").alias("_inkwell_text"), *[docs[c] for c in cols])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[1:]) + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"

    def run(batches):
        own = LineField(w, t, start)
        for b in batches:
            rows = list(zip(*[judge(x or b"", own, keep_share) for x in text_bytes(b.column(0))])) or [()] * 8
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(r, k) for r, k in zip(rows, types)]], [*cols, *names])

    return source.transform(mapped, run, schema)


def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit_field(docs, table(spark, sf_dir, "labels")))

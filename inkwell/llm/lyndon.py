"""Periodic runs of words by Lyndon arrays over an ordered alphabet, in linear time.

Words are only compared with each other: no ranks, no suffix structures, no hashes. One pass from left to
right keeps a stack of suffixes, each smaller than all between it and the next, and finds for every word the next
smaller suffix, whose distance is its longest Lyndon word, with the number of words that the two share. A pass in either
order finds a Lyndon root of every run at an edge of this array. How far two suffixes agree is seldom looked
up in the words: inside the stretch that an earlier pair was found to share, the pair as far apart in the
earlier copy has been compared already, and its extension is taken over; where it reaches the
end of that stretch, matching goes on from there; and of two suffixes below each other on the stack the lesser extension decides.
So no word is matched again, and the words read grow with the length alone.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, mapped, table, text_bytes

#: Fixed values of the contract: least exponent and least length, in words, of a run.
LEAST_EXPONENT, LEAST_LENGTH = 4, 6
#: Words compared at once while two suffixes agree.
_STRIDE = 32


def _agree(words: list, a: int, b: int) -> int:
    """First place from b on, a < b, where the words differ from those at a on; the length of the list at most."""
    n = len(words)
    while b + _STRIDE <= n and words[a : a + _STRIDE] == words[b : b + _STRIDE]:
        a, b = a + _STRIDE, b + _STRIDE
    while b < n and words[a] == words[b]:
        a, b = a + 1, b + 1
    return b


def lyndon_edges(words: list, up: bool = True, least: int = 1, agree=_agree) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """For each place the place of the next smaller suffix (the length, if none), in ascending or descending order of
    words, a suffix that is a prefix of another being smaller; how many words both share; and the
    edges (i, j) whose suffixes share more than least * (j - i) words."""
    n = len(words)
    after, shared = [n] * n, [0] * n  # next smaller suffix, words in common
    before, common = [-1] * n, [0] * n  # previous smaller suffix, words in common
    stack: list[int] = []
    roots = []
    begin = end = shift = 0  # words[begin:end] == words[begin - shift : end - shift]
    for j in range(n):
        y, last, known = words[j], -1, 0
        while stack:
            t = stack[-1]
            x = words[t]
            if x != y:
                m, stop = 0, (x < y) is up
            else:
                m = -1
                if last >= 0 and common[last] != known:  # t and j agree with last unequally far
                    stop = common[last] < known
                    m = common[last] if stop else known
                elif j < end and t >= begin:
                    s, k = t - shift, j - shift
                    if after[s] == k:
                        m, stop = shared[s], False
                    elif before[k] == s:
                        m, stop = common[k], True
                    if j + m >= end:  # as far as the stretch goes
                        known, m = max(known, end - j), -1
                if m < 0:
                    b = agree(words, t + known, j + known)
                    m = b - j
                    stop = b < n and (words[t + m] < words[b]) is up
                    if b >= end:
                        begin, end, shift = j, b, j - t
            if stop:
                before[j], common[j] = t, m
                break
            after[t], shared[t] = j, m
            if m > least * (j - t):
                roots.append((t, j))
            last, known = t, m
            stack.pop()
        stack.append(j)
    return after, shared, roots


def word_runs(words: list, least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least that length and exponent (2 or more), by start, then period.

    A run is the stretch around a Lyndon root, an edge (i, j) of the array of one of the two orders, that agrees with itself j - i
    words on. Only its leftmost root is extended to the left, by less than a period."""
    if least_exponent < 2:
        raise ValueError("a run holds its period twice")
    found = []
    for up in (True, False):
        after, shared, roots = lyndon_edges(words, up, least_exponent - 2)
        for i, j in roots:
            p = j - i
            if i >= p and after[i - p] == i and shared[i - p] >= p:
                continue  # there is a root before this one
            start = i
            while start and words[start - 1] == words[start + p - 1]:
                start -= 1
            length = j + shared[i] - start
            if length >= max(least_length, least_exponent * p):
                found.append((start, length, p))
    found.sort()
    return [r for k, r in enumerate(found) if not k or r != found[k - 1]]


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that repeat a run's first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone) if not g]


def find_runs(docs: DataFrame, *, id_col="doc_id", text_col="text", least_exponent=LEAST_EXPONENT, least_length=LEAST_LENGTH) -> DataFrame:
    """Per document: its id, n_words, runs (array of start, length and period, by start, then period; words are numbered
    from 0) and collapsed, the words that repeat no run's first period, joined by one space.

    A null or empty text has no words, no runs and an empty collapsed text. Rows are independent: repeated ids and texts
    have a row each, an empty table has none; no shuffle. Runs may overlap, and equal ones count once. Other columns of
    docs are left out, whatever their names. The whole text counts: a task holds a text's words, some 100 bytes each
    with the arrays, so a text of 100 MB takes about 2 GB."""
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            sizes, runs, texts = [], [], []
            for text in text_bytes(b.column(1)):
                words = (text or b"").split()
                found = word_runs(words, least_exponent, least_length)
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(collapse(words, found)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], [id_col, "n_words", "runs", "collapsed"])

    return source.transform(mapped, run, f"`{id_col}` {source.schema['_id'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_run(doc_id: Column, text: Column) -> Column:
    """The contract's input: for one id in ten (crc32 of its decimal digits) the words from one on repeat with a
    period, both of which the id and the number of words give. Other texts, and those without an id, stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    spin = lambda a, p: lambda words: F.array_join(F.transform(words, lambda w, i: F.when(i < a(words), w).otherwise(F.get(words, (a(words) + (i - a(words)) % p(words)).cast("int")))), " ")
    first = lambda words: g % F.size(words)
    period = lambda words: F.lit(1) + F.floor((F.size(words) - first(words)) / (F.lit(3) + g % 8))
    # an array of one list of words, so that the list is made once and not for each of its words
    spun = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), spin(first, period)), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(WORD), spun).otherwise(text)


def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    runs = find_runs(docs.select("doc_id", with_planted_run(F.col("doc_id"), F.col("text")).alias("text")))
    r, found = F.col("longest"), F.col("runs")
    order = lambda x, y: F.when(x.length != y.length, F.when(x.length > y.length, -1).otherwise(1)).when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1)).otherwise(F.when(x.period < y.period, -1).when(x.period > y.period, 1).otherwise(0))
    lines = F.transform(found, lambda x: F.concat(F.concat_ws(",", x.start.cast("string"), x.length.cast("string"), x.period.cast("string")), F.lit("\n")))
    return runs.withColumn("longest", F.get(F.array_sort(found, order), F.lit(0))).select(
        "doc_id", F.size(found).cast("long").alias("n_runs"), r.start.alias("start"), r.length.alias("length"), r.period.alias("period"),
        F.floor(F.lit(1000) * r.length / r.period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))

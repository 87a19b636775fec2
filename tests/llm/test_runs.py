"""Runs by Lyndon arrays: against all periods of all stretches, the work done, and the query's digests."""

import hashlib
import random
import zlib

import pytest

from inkwell.llm.lyndon import collapse, find_runs, lyndon_edges, op12, word_runs

from .test_operators import docs


def brute(words, exponent, length):
    n, out = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            size = i + p - start
            piece = words[start : start + size]
            if i > start and size >= max(length, exponent * p) and not any(piece[q:] == piece[:-q] for q in range(1, p)):
                out.add((start, size, p))
            i += i == start
    return sorted(out)


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(3000):
        n, k = rnd.randint(0, 36), rnd.randint(1, 3)
        w = [rnd.choice("abc"[:k]) for _ in range(n)]
        if n and rnd.random() < 0.5:
            a = rnd.randrange(n)
            p = rnd.randint(1, max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for exponent, length in ((2, 2), (3, 3), (4, 6)):
            assert word_runs(w, exponent, length) == brute(w, exponent, length)


def test_edges_are_next_smaller_suffixes():
    rnd = random.Random(6)
    for _ in range(300):
        w = [rnd.choice("ab") for _ in range(rnd.randint(1, 25))]
        for up in (True, False):
            key = [[ord(c) if up else -ord(c) for c in w[i:]] for i in range(len(w))]
            after, shared, _ = lyndon_edges(w, up)
            for i in range(len(w)):
                j = next((j for j in range(i + 1, len(w)) if key[j] < key[i]), len(w))
                assert after[i] == j
                if j < len(w):
                    same = next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)
                    assert shared[i] == same


@pytest.mark.parametrize("make", ["fibonacci", "thue", "one", "two", "random", "period", "nested", "cubes"])
def test_no_word_is_matched_again(make):
    rnd, n, read = random.Random(7), 20_000, [0]
    fib, thue, cubes = ["a", "ab"], "a", "a"
    while len(fib[-1]) < n:
        fib.append(fib[-1] + fib[-2])
    while len(thue) < n:
        thue += thue.translate(str.maketrans("ab", "ba"))
    while len(cubes) < n:
        cubes = cubes * 4 + chr(98 + len(cubes) % 3)
    text = {"fibonacci": fib[-1], "thue": thue, "one": "a" * n, "two": "ab" * (n // 2), "random": "".join(rnd.choice("ab") for _ in range(n)), "period": "".join(rnd.choice("abc") for _ in range(n // 10)) * 10, "nested": "".join("a" * k + "b" for k in range(200)), "cubes": cubes}[make]

    def agree(words, a, b):
        start = b
        while b < len(words) and words[a] == words[b]:
            a, b = a + 1, b + 1
        read[0] += b - start + 1
        return b

    for up in (True, False):
        read[0] = 0
        lyndon_edges(list(text), up, 1, agree)
        assert read[0] <= 4 * len(text)


def test_collapse_keeps_the_first_period():
    words = "x a b a b a b a b y".split()
    runs = word_runs(words)
    assert runs == [(1, 8, 2)] and collapse(words, runs) == ["x", "a", "b", "y"]
    assert word_runs("a a a a a".split()) == [] and word_runs("a a a a a a".split()) == [(0, 6, 1)]


def test_operator_nulls_repeats_long_and_clashing(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a b " * 9, "s"), (1, "a b " * 9, "s"), (2, None, "s"), (3, "", "s"), (None, "a", "s"), (4, "w " * 200_000, "s"), (5, "a b a b\ta b\na b", None)]
    d = docs(spark, rows)
    for x in (d, d.withColumn("n_words", F.lit("x")).withColumn("runs", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("_text", F.lit("q"))):
        got = [(r["doc_id"], r["n_words"], [tuple(q) for q in r["runs"]], r["collapsed"]) for r in find_runs(x).collect()]
        assert sorted(got, key=str) == sorted([(1, 18, [(0, 18, 2)], "a b")] * 2 + [(2, 0, [], ""), (3, 0, [], ""), (None, 1, [], "a"), (4, 200_000, [(0, 200_000, 1)], "w"), (5, 8, [(0, 8, 2)], "a b")], key=str)
    assert find_runs(docs(spark, [])).count() == 0


def test_query_against_the_contract(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["a", "b", "é", "the"]) for _ in range(rnd.randint(0, 60))), "s") for i in range(300)] + [(1000, None, "s"), (-7, "x y", "s")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op12(spark, str(tmp_path)).collect()}
    planted = 0
    for key, text, _ in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute(w, 4, 6)
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(((-size, s, q) for s, size, q in runs), default=None)
        r = got[key]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == ((best[1], -best[0], best[2]) if best else (None, None, None))
        assert r["exponent_milli"] == (1000 * -best[0] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest()
    assert planted > 10 and len(got) == len(rows)

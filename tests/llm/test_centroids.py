"""Nearest centroids: held-out accuracy, several centroids a language, rejection, hostile inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm.centroids import cluster, fit_centroids, ngram_counts, op11, predict_language, vector

from .test_operators import docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op11(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held) > 100
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) < 0.05 * len(got)


def test_ngrams_are_those_of_lower_case_letters_in_words():
    plain = lambda t: sorted(zip(*[x.tolist() for x in ngram_counts(t)]))
    assert plain("Ab, c") == plain(" aB-C!") == plain("ab c") != plain("abc")
    assert sum(n for _, n in plain("ab c")) == 3 + 5 + 4  # letters; pairs and triples of " ab c ", those of the leading space aside
    for t in (None, "", "12 34 .", "\n"):
        assert plain(t) == []
    assert plain("日本") and plain("É") == plain("é")


def test_pieces_count_like_a_whole(monkeypatch):
    from inkwell.llm import centroids

    rnd = random.Random(2)
    t = "".join(rnd.choice("ab É.\n1ß") for _ in range(500))
    whole = ngram_counts(t)
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(centroids, "PIECE", size)
        assert all((x == y).all() for x, y in zip(ngram_counts(t), whole))


def test_clusters_of_a_language_with_two_kinds_of_text():
    idf = np.ones(1 << 15)
    rows = [(c[0], vector(c, idf)) for c in (ngram_counts(t) for t in ["kata mata sata " * 5, "kata sata " * 5, "oeiu ueio " * 5, "oeiu eiou " * 5])]
    centres, radii = cluster(rows, 2)
    assert len(centres) == 2 and np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-5)
    first = [int(np.argmax([c[at] @ w for c in centres])) for at, w in rows]
    assert first[0] == first[1] != first[2] == first[3]
    assert len(cluster(rows[:1] * 5, 3)[0]) == 1  # equal rows: one centroid


def labelled(spark):
    rnd = random.Random(4)
    of = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(60))
    return docs(spark, [(i, of("abcde" if i % 2 else "mnopq"), "s") for i in range(80)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "xx").otherwise("yy"))


def test_rejection_ties_nulls_and_clashing_columns(spark):
    d = labelled(spark)
    c = fit_centroids(d.union(d.limit(5)).union(spark.createDataFrame([(900, None, "zz", "s", 0), (901, "12", "zz", "s", 2), (None, "abc", "xx", "s", 3), (902, "abc", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")))
    assert c.languages == sorted(c.languages) and set(c.languages) == {"xx", "yy"}  # zz has no letters to learn from
    rows = [(1, "abca bcde", "s"), (1, "abca bcde", "s"), (2, None, "s"), (3, " ", "s"), (None, "mnop opqm", "s"), (4, "zzzz rrrr vvvv " * 40, "s"), (5, "ab cd " * 100_000, "s")]
    x = docs(spark, rows)
    a, b = [predict_language(q, c) for q in (x, x.withColumn("lang_pred", F.lit(1)).withColumn("_id", F.lit(1)).withColumn("_text", F.lit("q")))]
    got = sorted(map(tuple, a.collect()), key=str)
    assert got == sorted(map(tuple, b.collect()), key=str) and len(got) == 7
    by = {r[0]: r for r in got}
    assert by[1][1] == "xx" and by[None][1] == "yy" and by[5][1] == "xx"
    assert by[2][1:4] == by[3][1:4] == ("und", 0.0, 1.0)
    assert by[4][4] and by[4][1] in ("xx", "yy")
    assert predict_language(docs(spark, []), c).count() == 0
    nothing = fit_centroids(d.limit(0))
    assert {r["lang_pred"] for r in predict_language(x, nothing).collect()} == {"und"}


def test_too_many_languages_are_an_error(spark):
    d = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        fit_centroids(d)

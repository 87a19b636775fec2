"""Hostile, empty, repeated and clashing inputs of the operators, and what their methods promise about work and files."""

import random
import re
import time

import numpy as np
import pytest

from .test_operators import corpus, docs, long_text, words

CLASH = ["n_words", "kept", "size", "taken", "source_size", "target", "copies", "n_bytes", "n_removed", "spans", "n_tokens", "score", "start", "length", "ids_crc32", "n_shingles", "component_id", "k1", "k2", "c", "rep", "key", "part", "_id", "_h", "_text", "_inkwell_text", "_t", "_i"]


def clashing(d):
    for c in CLASH:
        d = d.withColumn(c, __import__("pyspark").sql.functions.lit("x"))
    return d


def operators():
    from inkwell.llm import jaccard, language, mixing, packing, quality, secrets, suffix, wavelet

    return {
        "mix": lambda d: mixing.mix(d),
        "quality": lambda d: quality.quality(d, quality.train([], []), keep=[c for c in d.columns if c in ("kept", "n_words", "lang")]),
        "strip": lambda d: suffix.strip_repeats(d),
        "pack": lambda d: packing.pack(d, with_ids=False),
        "secrets": lambda d: secrets.find_secrets(d),
        "shards": lambda d: wavelet.read_shards(wavelet.write_shards(d)),
        "jaccard": lambda d: jaccard.jaccard_join(d).result(),
        "scores": lambda d: language.score_texts(d),
    }


@pytest.mark.parametrize("name", ["mix", "quality", "strip", "pack", "secrets", "shards", "jaccard", "scores"])
def test_clashing_columns_nulls_repeats_and_empty_tables(spark, name):
    rows = corpus(21, 30) + [(None, "null id with some words " * 9, None), (None, None, None), (3, "one", None), (77, "w " * 3000, "a")]
    plain, f = docs(spark, rows).coalesce(1), operators()[name]
    a, b = f(plain), f(clashing(plain))
    assert len(set(a.columns)) == len(a.columns) and sorted(a.columns) == sorted(b.columns)
    same = [c for c in a.columns if c not in ("sequence_id",)]
    got = sorted(map(str, a.select(*same).collect()))
    assert got == sorted(map(str, b.select(*same).collect()))
    assert len(got) >= len(rows)
    assert f(docs(spark, [])).count() == 0


# --- secrets ---


def test_lexer_is_linear_and_bounded():
    from inkwell.llm.secrets import scan

    began = time.time()
    bomb = 'password = "Ab3$xyzw"\n' + "password = password + password\n" * 60
    assert any(k == 3 or k == 0 for *_, k in scan(bomb)[1])
    for text in ("a=" * 300_000, "x " * 200_000 + "= '", "k = 'v' " * 60_000, '="' * 150_000, "<a>b</a>" * 40_000, "=" * 300_000, "a:b," * 100_000, "n" * 400_000 + " = 'Ab3$xyzw9'"):
        scan(text)
    assert time.time() - began < 60


def test_names_of_any_length_and_markup():
    from inkwell.llm.secrets import lexed_spans, name_before

    value = "Zx9$kLm2Qw"
    for text in (f'password_{"a" * 300} = "{value}"', f'"api_key{" " * 3}" : "{value}"', f"<password>{value}</password>", f'<add key="client_secret" value="{value}"/>', f'# token = "{value}"', f'secret = """{value}"""', f"$pwd   =   '{value}'"):
        assert any(text[a:b] == value for a, b, _ in lexed_spans(text)), text
    assert lexed_spans('password_length = "Zx9$kLm2Qw"') == [] == lexed_spans('title = "Zx9$kLm2Qw"')
    assert name_before("a\nname\t = 1", 8) == "name" and name_before("\n = 1", 2) is None


def test_base_spans_against_a_plain_scanner():
    from inkwell.llm.secrets import scan

    r = random.Random(8)
    bits = ["password", "PASSWD", "api_key", "apikey", "token", "secret", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "Zz9", "\n", "x", "é", "-", "A" * 9]

    def plain(t):
        out, i = [], 0
        while i < len(t):  # assign
            m = re.match(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", t[i:], re.I | re.A)
            n = 0
            if m:
                j = i + m.end()
                while j + n < len(t) and (t[j + n] in "+/_.=-" or t[j + n].isascii() and t[j + n].isalnum()):
                    n += 1
            if m and n:
                if n >= 8:
                    out.append((i, j + n, 0))
                i = j + n
            else:
                i += 1
        for kind, head, chars, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), (2, "", "0123456789abcdef", 32)):
            i = 0
            while i < len(t):
                j = i + len(head)
                if t.startswith(head, i) and j < len(t) and t[j] in chars:
                    while j < len(t) and t[j] in chars:
                        j += 1
                    if j - i >= least:
                        out.append((i, j, kind))
                    i = j
                else:
                    i += 1
        return sorted(out, key=lambda x: (x[0], x[2]))

    for _ in range(1500):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        base, spans = scan(t)
        assert base == plain(t), t
        assert set(base) <= set(spans)


# --- wavelet shards ---


def test_shards_are_read_through_their_directory():
    from inkwell.llm.wavelet import WaveletMatrix, from_blob, to_blob

    g = np.random.default_rng(4)
    ids = g.choice(50_000, 300_000, p=(w := 1 / np.arange(1, 50_001)) / w.sum())
    keys, counts, wm = from_blob(to_blob([1, None], [200_000, 100_000], ids))
    assert keys == [1, None] and counts.tolist() == [200_000, 100_000] and wm.unpacked == 0
    assert wm.access(123_456) == ids[123_456] and 0 < wm.unpacked <= 2 * wm.depth  # one block a plane, of five
    for s in (0, 1, 7, 49_000, int(ids[-1])):
        places = np.flatnonzero(ids == s)
        assert wm.count(s) == len(places) and wm.rank(s, 150_001) == (places < 150_001).sum()
        for k in {0, len(places) // 2, len(places) - 1} if len(places) else ():
            assert wm.select(s, k) == places[k]
        with pytest.raises(IndexError):
            wm.select(s, len(places))
    assert (wm.decode() == ids).all() and wm.count(1 << 20) == 0
    for n in (0, 1, 511, 512, 513, 4096, 65_536, 65_537):
        x = ids[:n]
        m = WaveletMatrix.build(x)
        assert (m.decode() == x).all() and all(m.access(i) == x[i] for i in range(0, n, max(1, n // 50)))
    wm.zeros[0] += 1
    with pytest.raises(ValueError):
        wm.decode()


# --- neighbours ---


def test_learned_partitions_at_their_defaults(spark):
    """Vectors without structure: what the held-out queries measure holds for others."""
    from pyspark.sql import functions as F

    from inkwell.llm.neighbours import build_index, search

    x = np.random.default_rng(6).normal(size=(700, 24))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("part", F.lit(1))
    index, _ = build_index(d.select("vec_id", F.col("embedding").alias("v")))
    assert index.parts > 10 and index.probes < index.parts and index.recall >= 0.9
    got = search(d, d.filter("vec_id % 20 = 0").unionByName(d.filter("vec_id = 0"))).collect()
    assert len(got) == 35 * 20
    hit = 0
    for q in range(0, 700, 20):
        p = x @ x[q]
        p[q] = -np.inf
        hit += len(set(np.argsort(-p)[:20]) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit / len(got) >= 0.88
    assert build_index(d.filter("vec_id < 40").select("vec_id", F.col("embedding").alias("v")))[0].parts == 1


# --- urls ---


def test_url_filter_with_clashing_columns(spark):
    from inkwell.llm.urls import filter_urls

    rows = [("http://a.b.Example.com/Ads/1?q", "2024-02-01", "p", "u"), ("http://a.b.Example.com/ads/1", "2024-02-01", "p", "u"), (None, "2024-02-01", "p", "u"), ("http://x.org", None, "p", "u")]
    c = spark.createDataFrame(rows, "url string, fetched_at string, pattern string, _url string")
    e = spark.createDataFrame([("EXAMPLE.com/x", "add", "2024-01-01", "s"), ("a.b.example.com/Ads", "add", "2024-01-01", "s"), ("org", "add", "2024-01-01", "t"), ("Org", "remove", "2024-01-05", "t")], "pattern string, action string, at string, category string")
    out = filter_urls(c, e)
    assert out.columns == ["url", "fetched_at", "_url", "listed", "pattern", "category", "since"]
    assert sorted((r["url"] or "", r["listed"], r["pattern"]) for r in out.collect()) == [("", False, None), ("http://a.b.Example.com/Ads/1?q", True, "a.b.example.com/Ads"), ("http://a.b.Example.com/ads/1", False, None), ("http://x.org", False, None)]
    assert filter_urls(c.filter("false"), e).count() == 0 and filter_urls(c, e.filter("false")).filter("listed").count() == 0


# --- quality ---


def test_field_is_fitted_on_whole_documents_once_an_id(spark):
    from inkwell.llm.quality import LineField, features_of, fit_field, train_on

    good = "\n".join("the quick river went over old stones and on to the sea." for _ in range(150))
    bad = "\n".join(["word and more words in a line here."] * 100 + ["*** CLICK | HERE *** $$$"] * 100)
    rows = [(i, good, "a") for i in range(20)] + [(i, bad, "a") for i in range(20, 40)] + [(5, good, "a")] * 30 + [(99, None, "a")]
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)] + [(99, 0, 0)], "doc_id long, quality int, toxic int")
    field = fit_field(docs(spark, rows), labels)
    same = fit_field(docs(spark, rows).repartition(5), labels)
    assert (field.w == same.w).all() and (field.t == same.t).all()
    want = train_on([features_of(good.encode())] * 20, [features_of(bad.encode())] * 20)
    assert np.allclose(field.w, want.w)
    path = field.decode(features_of(bad.encode()))
    assert path[-50:].mean() < 0.5  # lines past the 48th were learned
    assert isinstance(fit_field(docs(spark, []), labels), LineField)


# --- near duplicates ---


def test_repeated_rows_and_ids_that_are_null(spark):
    from inkwell.llm.jaccard import jaccard_join

    base = [f"t{i}" for i in range(60)]
    near = base[:-1] + ["other"]
    rows = [(1, " ".join(base), "a")] * 200 + [(2, " ".join(near), "a")] * 200 + [(None, " ".join(base + ["x"]), "a"), (9, long_text(20_000), "a"), (None, None, None), (7, "", None)]
    began = time.time()
    got = jaccard_join(docs(spark, rows)).result().collect()
    assert len(got) == len(rows) and time.time() - began < 60
    assert {r["component_id"] for r in got if r["n_shingles"] and r["doc_id"] != 9} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (7, 9)} == {7, 9}


# --- mixing ---


def test_sources_come_near_their_targets_with_long_documents(spark):
    from inkwell.llm.mixing import mix

    r = random.Random(5)
    rows = [(i, "w " * (r.choice([5, 20, 60]) if i % 40 else 3000), r.choice("abc")) for i in range(900)]
    got = mix(docs(spark, rows)).collect()
    for s in "abc":
        mine = [x for x in got if x["source"] == s]
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 60, s
    assert sum(x["size"] for x in got) == sum(len(words(t)) for _, t, _ in rows)


# --- scores ---


def test_gradient_of_the_feed_forward_layer_and_lessons():
    from inkwell.llm import language as L

    g = np.random.default_rng(2)
    rows, target, weight = g.integers(0, 50, (3, L.WINDOW)), g.integers(0, 9, (3, L.WINDOW)), np.ones((3, L.WINDOW))
    base = [x.astype(np.float64) for x in L.Attention().w]

    def loss(k=None, i=None, h=0.0):
        m = L.Attention()
        m.w, m.mask = [x.copy() for x in base], m.mask.astype(np.float64)
        if k is not None:
            m.w[k][i] += h
        seen = [np.zeros_like(x) for x in base]
        return m.step(rows, target, weight, 0.0, seen), seen

    seen = loss()[1]
    for k in (7, 8, 9):
        i = np.unravel_index(np.argmax(seen[k]), seen[k].shape)
        slope = (loss(k, i, 1e-5)[0] - loss(k, i, -1e-5)[0]) / 2e-5
        assert abs(slope) == pytest.approx(seen[k][i] ** 0.5, rel=1e-3)
    counts = np.array([1, 31, 32, 33, 100])
    ids = g.integers(0, 900, counts.sum())
    inputs, asked = L.lessons(ids, counts)
    assert (asked[asked >= 0] == ids).all() and (asked >= 0).sum() == len(ids)
    at = 0
    for n in counts:
        own = ids[at : at + n]
        k = -(-n // L.WINDOW)
        mine, inputs = inputs[:k].ravel(), inputs[k:]
        assert mine[0] == L.TOKENIZER_END and (mine[1:n] == own[:-1]).all()
        at += n


def test_score_is_that_of_a_plain_forward_pass():
    """Each id once, from the half window before its stretch and what stands between, place by place."""
    from inkwell.llm import language as L

    g = np.random.default_rng(3)
    ids = g.integers(0, 3000, 75)
    v = L.Vocabulary(g.integers(0, 50, L.TOKENIZER_END + 1).astype(float), g.integers(0, 2, L.TOKENIZER_END + 1).astype(bool))
    m = L.Attention(seed=5)
    emb, pos, wq, wk, wv, out, bias, w1, b1, w2 = (x.astype(np.float64) for x in m.w)
    half, want = L.WINDOW // 2, []
    before = np.concatenate([np.full(half + 1, L.TOKENIZER_END), ids])
    for t in range(len(ids)):
        first = t // half * half  # the window's first scored id
        seq = v.row[before[first : first + half + 1 + t - first]]  # half a window of context, then up to the id before t
        x = emb[seq] + pos[: len(seq)]
        a = np.exp(x[-1] @ wq @ (x @ wk).T / np.sqrt(L.WIDTH))
        h = emb[seq[-1]] + a @ (emb[seq] @ wv) / a.sum()
        z = (h + np.maximum(h @ w1 + b1, 0) @ w2) @ out + bias
        want.append(z[v.cls[ids[t]]] - np.log(np.exp(z).sum()))
    inputs, slot, _ = L.windows(ids, np.array([len(ids)]))
    asked = np.zeros(len(inputs) * half, dtype=np.int64)
    asked[slot] = v.cls[ids]
    got = m.log_prob_of(v.row[inputs], asked, m.tables(), half, False)[slot]
    assert np.allclose(got, want, atol=1e-4)


# --- shared helpers ---


def test_a_cluster_needs_a_shared_folder():
    from inkwell.llm.common import shared_dir

    class Conf(dict):
        set = dict.__setitem__

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_memo_is_bounded_and_keeps_what_recurs():
    from inkwell.llm.common import Memo

    made = []
    m = Memo(lambda k: made.append(k) or k * 2, 10)
    for i in range(1000):
        assert m[i] == i * 2 and m["hot"] == "hothot"
        assert len(m) + len(m.older) <= 20
    assert made.count("hot") == 1


def test_long_constants_are_followed():
    import random

    from inkwell.llm.secrets import MOST_TEXT, Value, lexed_spans, literal_score

    g = random.Random(5)
    word = lambda n: "".join(g.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    for n in (1000, 1024, 1025, 1100, 50_000):
        text = f'a = "{word(n)}"\npassword = a + "xY9$kkQ2zz"\n'
        at = text.index("xY9")
        assert lexed_spans(text) == [(5, 5 + n, 3), (at, at + 10, 3)], n
        assert lexed_spans(f'a = "{word(n)}"\ndb_password = a\n') == [(5, 5 + n, 3)]
    long = word(MOST_TEXT + 500)
    assert abs(Value([long], []).score() - literal_score(long)) < 1e-9
    assert abs(Value([long[:700], Value([long[700:]], [])], []).score() - literal_score(long)) < 1e-9
    assert Value([long, " "], []).score() == 0 and Value(["changeme", long], []).score() == 0


def test_chains_of_names_stay_linear():
    import time

    from inkwell.llm.secrets import lexed_spans

    def seconds(text):
        t = time.process_time()
        assert lexed_spans(text)
        return time.process_time() - t

    chain = lambda n: 'v0 = "aB3$xx9q"\n' + "".join(f'password_{i} = v{i}\nv{i + 1} = v{i} + "k{i}Z"\n' for i in range(n))
    twice = lambda n: 'v0 = "aB3$xx9qLm"\n' + "".join(f"v{i + 1} = v{i} + v{i}\n" for i in range(n)) + f"password = v{n}\n"
    for make, n in ((chain, 2000), (twice, 4000)):
        few, many = seconds(make(n)), seconds(make(4 * n))
        assert many < 10 * few + 0.2, (few, many)


def test_neighbours_of_several_lengths_and_of_overflowing_products(spark):
    from inkwell.llm.neighbours import search

    rows = [(i, [1e200 * (i + 1), 1.0]) for i in range(5)] + [(100 + i, [float(i + 1), 2.0, 3.0]) for i in range(20)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in search(d, d.filter("vec_id in (0, 100)"), k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[0] == [(1, float("inf")), (2, float("inf")), (3, float("inf"))]
    assert got[100] == [(119, 33.0), (118, 32.0), (117, 31.0)]

"""Alignment by distinct segments: against whole texts, one by one."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.llm.alignment import align_tokens, aligner, op13

from .test_operators import docs

ALPHABET = list(" \n\t\r\x0b\x0c　\xa0\x1c\x85 ") + ["  ", " \n", "\r\n"] + list("aeTz09.,;:!?'\"()}{") + ["the", "'s", "ing", " le", " }", "é", "日本", "語", "😀", "ﬁ", "▁", "<s>", "<|endoftext|>", "\x00", "<unk>", "<0x41>"]


def hostile(n, seed=3):
    rnd = random.Random(seed)
    return [None, "", " ", "\n", "  ", "a", "<s>"] + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 30))) for _ in range(n)]


def ends(ids, of):
    out, at = {}, 0
    for k, x in enumerate(ids):
        at += len(of[x])
        out[at] = k
    return out


def brute(texts):
    """From the whole text's tokens: (n_a, n_b, groups, links) each, then counts over all."""
    t = aligner()
    rows, count = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b, raw = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text), (" " + text).encode()
        if b"".join(t.a_bytes[x] for x in a) != raw or b"".join(t.b_bytes[x] for x in b) != raw:
            rows.append(None)
            continue
        ea, eb = ends(a, t.a_bytes), ends(b, t.b_bytes)
        groups, links, i, j = [], [], 0, 0
        for e in sorted(ea.keys() & eb.keys()):
            groups.append(",".join(map(str, a[i : ea[e] + 1])) + "|" + ",".join(map(str, b[j : eb[e] + 1])))
            links.append((a[ea[e]], b[eb[e]]))
            i, j = ea[e] + 1, eb[e] + 1
        count.update(links)
        rows.append((len(a), len(b), groups, links))
    best = {}
    for (_, y), c in count.items():
        best[y] = max(best.get(y, 0), c)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(count[x] == best[x[1]] for x in r[3]), sum(count[x] for x in r[3]), ";".join(r[2])) for r in rows]


def test_segments_encode_like_the_whole_text():
    t = aligner()
    assert " " in t.breaks and "\n" in t.breaks and "\r" not in t.breaks  # the piece model has entries like ";\r"
    for text in hostile(2000, 9):
        if text and "▁" not in text:
            s = t.split(text)
            assert "".join(s) == " " + text
            a, b = t.encode(s)
            assert sum(a, []) == t.a.encode(" " + text, add_special_tokens=False).ids
            assert sum(b, []) == t.b.encode(text)


@pytest.mark.parametrize("block_bytes", [8 << 20, 2000])
def test_equals_brute_force_for_any_blocks(spark, block_bytes):
    texts = hostile(700)
    got = {r[0]: tuple(r)[1:] for r in align_tokens(docs(spark, [(i, x, "s") for i, x in enumerate(texts)]).repartition(3), block_bytes=block_bytes).collect()}
    want = brute(texts)
    assert got == dict(enumerate(want))
    assert 100 < sum(w[0] > 0 for w in want) < len(want) - 100


def test_documents_without_tokens_add_to_no_count(spark):
    texts = ["the cat", "the cat ▁", "the\xa0cat the"]
    got = {r[0]: tuple(r)[1:] for r in align_tokens(docs(spark, [(i, x, "s") for i, x in enumerate(texts)])).collect()}
    assert got == dict(enumerate(brute(texts))) and got[1] == (0, 0, 0, 0, 0, 0, "")


def test_repeats_null_ids_long_texts_and_clashing_columns(spark):
    rows = [(1, "one two", "s"), (1, "one two", "s"), (None, "one", "s"), (2, None, "s"), (3, "x" * 30_000 + " " + "word " * 30_000, "s")]
    d = docs(spark, rows)
    clash = d.withColumn("n_a", F.lit("x")).withColumn("block", F.lit(1)).withColumn("seg", F.lit("s")).withColumn("groups", F.lit(0)).withColumn("_id", F.lit(0)).withColumn("at", F.lit(0))
    a, b = (sorted(map(tuple, align_tokens(x).collect()), key=str) for x in (d, clash))
    assert a == b == sorted([(k, *w) for (k, _, _), w in zip(rows, brute([x for _, x, _ in rows]))], key=str)
    assert align_tokens(docs(spark, [])).count() == 0


def test_query_digest(spark, tmp_path):
    docs(spark, [(1, "one two", "s"), (2, None, "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op13(spark, str(tmp_path)).collect()}
    assert got[1]["groups_sha256"] == hashlib.sha256(brute(["one two"])[0][6].encode()).hexdigest() and got[2]["groups_sha256"] == ""

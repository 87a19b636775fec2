"""Texts encoded together: the library's ids, for any white space and any size of a stretch, with few calls of the model."""

import random

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import subwords as S

SOME = ["a", "the", "é", "日本", " ", "  ", "\n", "\n\n", "'s", "don't", "x1", "$$$", "\t", "\r", "\x85", "ß!", "it.", "\xa0", "😀", ".\n", "é###", "İ", " \n", "  c", "<|endoftext|>", "9$", "ª*"]


@pytest.mark.parametrize("together, placed", [(1, 1), (3000, 200), (S.TOGETHER, S.PLACED)])
def test_texts_encoded_together_have_the_librarys_ids(monkeypatch, together, placed):
    monkeypatch.setattr(S, "TOGETHER", together)
    monkeypatch.setattr(S, "PLACED", placed)
    r = random.Random(5)
    texts = ["", "", "\nx"] + ["".join(r.choice(SOME) + r.choice(["", "", " ", "\n"]) for _ in range(r.randint(0, 30))) for _ in range(600)] + ["", "q " * 300]
    e = S.SubwordEncoder()
    got = list(e.encode_all((i, t) for i, t in enumerate(texts)))
    assert [i for i, _ in got] == list(range(len(texts)))
    want = [x.ids for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(p, "<u2").tolist() for _, p in got] == want
    assert list(e.encode_all([])) == [] and list(e.encode_all([(1, ""), (2, "")])) == [(1, b""), (2, b"")]


def test_new_chunks_of_shards_share_calls_of_the_model():
    e = S.SubwordEncoder()
    calls, model = [], e.by_model
    e.by_model = lambda s: calls.append(s) or model(s)
    texts = [f"start{chr(97 + i)} " + " ".join(f"q{i}x{j}" for j in range(64)) for i in range(20)]
    assert len(list(e.encode_all(enumerate(texts * 2)))) == 40
    assert len(calls) <= 64 * 20 // 32 + 2 * len(texts) + 2


def test_packing_encodes_new_chunks_together(monkeypatch):
    from inkwell.llm import packing

    class Rows:  # stands for a table: the rows of one task
        def __getitem__(self, name):
            return self

        cast = select = lambda self, *a: self

        def transform(self, f, run, schema):
            return list(run([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])]))

    e = S.SubwordEncoder()
    calls, model = [], e.by_model
    e.by_model = lambda s: calls.append(s) or model(s)
    monkeypatch.setattr(S, "encoder", lambda path: e)
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda self: 0})())}))
    texts = [f"start{chr(97 + i)} " + " ".join(f"q{i}x{j}" for j in range(64)) for i in range(20)]
    pieces = [r for b in packing.pack(Rows()) for r in b.to_pylist()]
    assert sum(r["length"] for r in pieces) == sum(len(x.ids) + 1 for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
    assert len(calls) <= 64 * 20 // 32 + 2 * len(texts) + 2

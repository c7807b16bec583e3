"""The conditional random field: marginals against enumeration, slabs, spans, edges, and accuracy on rows held out."""

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tidebook.llm import toxicity as tx
from tidebook.llm.common import crc_bucket
from tidebook.llm.queries import op2_toxicity


def buffers(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def random_crf(seed):
    rng = np.random.default_rng(seed)
    return {"weights": rng.normal(size=1 << tx.TABLE_BITS), "step": rng.normal(size=(2, 2)), "start": rng.normal(size=2), "top": np.array([1.0, 1.0, -1.0])}


def test_marginals_equal_enumeration():
    crf = random_crf(3)
    tokens = tx.Tokens(*buffers(["one two three. Four five", "", "six", "... !", "a b c d e f"]))
    s, p = tx.emissions(crf["weights"], tokens), tx.marginals(crf, tokens)
    assert len(tokens.first) == 4
    for first, n in zip(tokens.first, tokens.length, strict=True):
        weight = {}
        for path in product((0, 1), repeat=int(n)):
            w = crf["start"][path[0]] + sum(crf["step"][a, b] for a, b in zip(path, path[1:], strict=False)) + sum(s[first + i] for i, x in enumerate(path) if x)
            weight[path] = np.exp(w)
        total = sum(weight.values())
        for i in range(n):
            assert np.isclose(p[first + i], sum(w for path, w in weight.items() if path[i]) / total)


def test_slabs_do_not_change_scores(monkeypatch):
    crf, rng = random_crf(4), np.random.default_rng(1)
    texts = [" ".join("abcdefgh"[rng.integers(8)] * int(rng.integers(1, 5)) + "..!"[rng.integers(3)] * int(rng.integers(2)) for _ in range(n)) for n in (0, 3, 50, 400, 9, 700)]
    whole, spans = tx.assess(crf, *buffers(texts))
    monkeypatch.setattr(tx, "SLAB", 300)
    parts, cut_spans = tx.assess(crf, *buffers(texts))
    assert np.allclose(whole, parts) and spans == cut_spans


def teach():
    rng = np.random.default_rng(0)
    word = lambda: "".join("abcdefé"[i] for i in rng.integers(0, 7, 4))
    texts, labels = [], []
    for i in range(300):
        words = [word() for _ in range(20)]
        if i % 3 == 0:
            words[rng.integers(20)] = "vile" + word()[:2]
            words[rng.integers(20)] = "vile" + word()[:2]
        texts.append(" ".join(words).encode())
        labels.append(i % 3 == 0)
    return tx.train(texts, np.array(labels, np.float32))


def test_spans_and_unseen_forms():
    crf = teach()
    text = "été bcda vilezz. abcd"
    score, spans = tx.assess(crf, *buffers([text, "abcd bcda", "", "VILEqq aaaa bbbb"]))
    assert [text[s:e] for s, e, _ in spans[0]] == ["vilezz"] and not spans[1] and not spans[2]
    assert score[0] > 0.5 > score[1] and score[3] > 0.5 and score[2] < 0.3


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (None, None, "s"), (2, "", "s"), (1, "a b", "s")], "doc_id long, text string, spans string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tx.with_spans(docs, tx.fit(docs, none, F.lit(True))).collect()] == [0.0] * 4
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    assert [r.score for r in tx.with_spans(docs, tx.fit(docs, one, F.lit(True))).collect()] == [1.0] * 4
    assert tx.with_spans(docs.limit(0), None).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = op2_toxicity(spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "score", "predicted").collect()
    bad, fine = [[r for r in rows if r.toxic == k] for k in (1, 0)]
    assert len(bad) > 50 and np.mean([r.predicted for r in bad]) >= 0.85 and np.mean([r.predicted for r in fine]) <= 0.05
    assert out.filter(crc_bucket("doc_id", 4) == 2).filter("not held_out").isEmpty()

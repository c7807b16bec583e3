"""The convolutional network: slopes, slabs, edges, and accuracy on rows held out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import quality as q
from tidebook.llm.common import crc_bucket
from tidebook.llm.queries import op10_quality_classifier


def padded(texts):
    return q.Padded(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def test_slopes_equal_differences():
    net = {k: v.astype(np.float64) + 0.03 * (v == 0) for k, v in q.fresh(1).items()}
    texts = [b"short", b"", bytes(range(256)) * 2, b"nd nd nd nd " * 20, b"x" * 127]
    labels = np.array([1, 0, 1, 0, 1.0])
    slopes, _ = q.gradients(net, padded(texts), labels)
    rng = np.random.default_rng(0)
    for name in net:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in net[name].shape)
            keep, losses = net[name][at], []
            for step in (1e-4, -1e-4):
                net[name][at] = keep + step
                losses.append(q.gradients(net, padded(texts), labels)[1])
            net[name][at] = keep
            assert slopes[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, abs=2e-3)


def test_slabs_do_not_change_scores(monkeypatch):
    net, rng = q.fresh(2), np.random.default_rng(2)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 5, 63, 64, 65, 500, 3000, 4096, 5001)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = q.probabilities(net, data, offsets)
    alone = [q.probabilities(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    monkeypatch.setattr(q, "SLAB", 1024)
    assert np.allclose(whole, alone, atol=1e-5) and np.allclose(whole, q.probabilities(net, data, offsets), atol=1e-5)


def test_edges(spark):
    rows = [(1, "fine text here", "a"), (None, None, "b"), (2, "", "c"), (1, "fine text here", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.p for r in q.with_score(docs, q.fit(docs, none, F.lit(True)), "p").collect()] == [0.5] * 4
    some = spark.createDataFrame([(1, 1), (2, None), (7, 0), (None, 0)], "doc_id long, quality int")
    net = q.fit(docs, some, F.lit(True))
    scored = {(r.doc_id, r.text): r.p for r in q.with_score(docs, net, "p").collect()}
    assert all(0 <= p <= 1 for p in scored.values()) and scored[(None, None)] == scored[(2, "")]
    kept = q.keep_good(docs, net, 0.0)
    assert kept.columns == docs.columns and kept.count() == 4
    assert q.keep_good(docs.limit(0), net).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = op10_quality_classifier(spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    good, bad = [[r for r in rows if r.quality == k] for k in (1, 0)]
    assert len(rows) > 50 and np.mean([r.predicted for r in good]) >= 0.97
    assert np.mean([a.score > b.score for a in good for b in bad]) >= 0.95
    assert out.filter(crc_bucket("doc_id", 5) == 0).filter("not held_out").isEmpty()

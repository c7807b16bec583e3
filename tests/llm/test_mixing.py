"""Windows, shares and the stream's order, against a plain scheduler over whole streams."""

import random
from collections import Counter
from fractions import Fraction

from tidebook.llm import mixing as mx
from tidebook.llm.queries import op4_pfair_mixing


def test_every_block_runs_in_its_window():
    rng = random.Random(1)
    for _ in range(40):
        weights = {f"s{i}": rng.randrange(1, 30) for i in range(rng.randrange(1, 9))}
        total, done = sum(weights.values()), Counter()
        for k, i, slot in mx.period(weights):
            assert i == done[k] and i * total // weights[k] <= slot < -(-(i + 1) * total // weights[k])
            done[k] += 1
            assert all(abs(Fraction(w * (slot + 1), total) - done[s]) < 1 for s, w in weights.items())
        assert done == weights


def test_whole_weights():
    got = mx.whole_weights({"a": 1.0, "b": 98.9, "c": 0.1}, 100)
    assert sum(got.values()) == 100 and min(got.values()) >= 1 and got["b"] > 90
    assert mx.whole_weights({str(i): 1.0 for i in range(300)}, 100) == {str(i): 2 for i in range(300)}


def test_weights_follow_their_targets():
    for shares in ({"hot": 1 / 3} | {f"s{i}": 2 / 3 / 999 for i in range(999)}, {"a": 0.6, "b": 0.3995, "c": 0.0005}, {"a": 1.0}):
        grain = mx.fine_grain(shares, 5000)
        got = mx.whole_weights(shares, grain)
        assert sum(got.values()) == grain >= 5000
        assert all(abs(got[k] - v / sum(shares.values()) * grain) < 1 for k, v in shares.items())


def plain(rows, weights, block):
    """Block by block: at each slot the released block due first; exhausted sources idle."""
    total, left, done, out, slot = sum(weights.values()), {k: -(-sum(s == k for _, s in rows) // block) for k in weights}, Counter(), [], 0
    virtual = Counter()
    while any(done[k] < left[k] for k in weights):
        ready = [(-(-(virtual[k] + 1) * total // w), k or "") for k, w in weights.items() if virtual[k] * total // w <= slot]
        _, k = min(ready)
        k = next(x for x in weights if (x or "") == k)
        if done[k] < left[k]:
            out.append((k, done[k], slot))
            done[k] += 1
        virtual[k] += 1
        slot += 1
    return out


def test_stream_equals_plain_scheduler(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(400)] + [(7, "a"), (None, "b"), (None, None)]
    docs = spark.createDataFrame([(i, s, "x") for i, s in rows], "doc_id long, source string, slot string").repartition(5)
    given = {"a": 3, "b": 2, "c": 1, None: 1, "absent": 9}
    out = mx.mix(docs, given, block=4, grain=7).collect()
    assert sorted((r.doc_id or -1, r.source or "") for r in out) == sorted((i or -1, s or "") for i, s in rows)
    assert sorted(r.seq for r in out) == list(range(len(rows)))
    whole = mx.whole_weights({"": 1, "=a": 3, "=b": 2, "=c": 1}, 7)
    weights = {None: whole[""], "a": whole["=a"], "b": whole["=b"], "c": whole["=c"]}
    out.sort(key=lambda r: r.seq)
    stream = list(dict.fromkeys((r.source, r.block, r.slot) for r in out))
    assert stream == plain(rows, weights, 4)
    assert all(r.release <= r.slot < r.due for r in out)
    held = [r.in_mix for r in out]
    assert held == sorted(held, reverse=True) and len({r.source for r in out if not r.in_mix}) <= 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, "s", "t", 0), (1, "s", "t", 0), (None, None, None, None)], "doc_id long, source string, text string, seq int")
    assert mx.mix(docs).count() == 3 and mx.mix(docs.limit(0)).count() == 0
    kept = mx.keep_mix(docs)
    assert kept.columns == docs.columns and kept.count() >= 2
    assert mx.keep_mix(docs.filter("source = 's'")).count() == 2


def test_no_document_goes_and_the_order_is_the_mix(spark):
    """One source with a third of the rows, 20 equal others: everything stays, and the stream holds the weights while sources last."""
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 20}", f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame([*rows, (None, "hot", "n"), (3, "hot", "t3")], "doc_id long, source string, text string").repartition(5)
    kept = mx.keep_mix(docs).collect()
    assert Counter(kept) == Counter(docs.collect())
    order = [r.doc_id for r in kept]
    want = {r.doc_id: r.mix_seq for r in mx.with_place(docs).filter("doc_id is not null").collect()}
    assert order[-1] is None and order[:-1] == sorted(order[:-1], key=want.get)
    counts = Counter(r.source for r in docs.collect())
    share = counts["hot"] ** 0.7 / sum(n**0.7 for n in counts.values())
    assert all(abs(sum(r.source == "hot" for r in kept[:n]) - share * n) < 2 * 16 for n in (400, 800, 1600))


def test_query(spark, sf):
    out = op4_pfair_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()
    assert sorted((r.doc_id, r.source) for r in out) == sorted((r.doc_id, r.source) for r in docs)
    assert all(r.release <= r.slot < r.due for r in out)

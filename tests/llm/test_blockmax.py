"""The k best against scoring every pair of rows in Python's integers."""

from math import floor, isfinite

import numpy as np
import pytest

from tidebook.llm import blockmax as bm
from tidebook.llm.queries import op12_exact_top_k

SHAPE = "vec_id long, embedding array<double>, row int, score string"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def plain(rows, k=10, scale=1024, every=100):
    hold = lambda x: min(HIGH, max(LOW, x))
    whole = lambda x: hold(floor(x * scale)) if isfinite(x * scale) else (HIGH if x > 0 else LOW)
    kept = [(i, [whole(float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(kept):
        if q is not None and q % every == 0:
            found = [(-hold(sum(x * y for x, y in zip(a, b, strict=False))), i is None, i or 0) for j, (i, b) in enumerate(kept) if j != at]
            out += [(q, rank, None if nil else i, -s) for rank, (s, nil, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(out):
    return sorted((tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def made(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 9, "x") for i, v in rows], SHAPE).repartition(parts)


@pytest.mark.parametrize("options", [{}, {"block": 3, "segment": 2, "chunk": 2, "anchors": 3}, {"k": 1, "block": 1, "segment": 5}])
def test_ties_copies_and_odd_rows(spark, options):
    rng = np.random.default_rng(6)
    rows = [(i * 7, [float(x) for x in rng.integers(-2, 3, 6) / 1024]) for i in range(300)]
    rows += [(5000 + i, rows[0][1]) for i in range(150)]  # a third are copies, all tied
    rows += [(0, rows[3][1]), (700, rows[5][1]), (700, rows[5][1]), (None, rows[0][1]), (None, rows[5][1])]
    rows += [(9000 + i, v) for i, v in enumerate([None, [], [0.5], [1.0] * 9, [float("nan")], [float("inf")], [None, 1.0], [-0.0] * 6])]
    rows += [(9100, [0.25, -0.25]), (9200, []), (9300, None)]
    want = plain(rows, k=options.get("k", 10))
    assert got(bm.top_k(made(spark, rows), **options)) == want


@pytest.mark.parametrize("size", [1e5, 1e9, 1e16, 1e300])
def test_large_components(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i * 20, [float(x) for x in rng.normal(size=5) * size]) for i in range(60)] + [(2000, [-size] * 5), (2010, [0.1] * 5)]
    assert got(bm.top_k(made(spark, rows), block=4, segment=3)) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8])
def test_few_rows(spark, n):
    rows = [(i * 100, [1.0 + i, 2.0]) for i in range(n)]
    assert got(bm.top_k(made(spark, rows))) == plain(rows)


def test_blocks_are_pruned():
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(8, 16))
    v = [(c + rng.normal(size=16) / 50) * 100 for c in centre for _ in range(32)]
    import pandas as pd

    docs = pd.DataFrame({"row": range(256), "id": range(256), "block": np.arange(256) // 32, "v": [x.astype(np.int64) for x in v]})
    seg, scored = bm.Segment(docs), []
    held = bm.held
    try:
        bm.held = lambda m: scored.append(m.shape) or held(m)
        bm.search(seg, np.array([0]), seg.forward[0, :1], 10, bm.no_floor(1))
    finally:
        bm.held = held
    assert len(scored) - 1 <= 2  # of 8 blocks


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, np.floor(np.array(r.embedding, np.float64) * 1024)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = []
    for at in np.nonzero(ids % 100 == 0)[0]:
        s = m @ m[at]
        best = [j for j in np.lexsort((ids, -s)) if j != at][:10]
        want += [(int(ids[at]), rank, int(ids[j]), int(s[j])) for rank, j in enumerate(best, 1)]
    assert got(op12_exact_top_k(spark, sf)) == sorted(want, key=str)

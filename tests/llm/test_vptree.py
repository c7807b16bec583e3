"""Clusters against plain Python integers that compare every vector with every centroid."""

import hashlib
from math import floor, isfinite

import numpy as np
import pytest

from tidebook.llm import vptree as vp
from tidebook.llm.queries import op13_centroid_clustering

SHAPE = "vec_id long, embedding array<double>, cluster int, v string"


def plain(rows, clusters=16, rounds=3, scale=64, width=64):
    low, high = -(1 << 63), (1 << 63) - 1
    whole = lambda x: min(high, max(low, floor(x * scale) if isfinite(x * scale) else (high if x > 0 else low)))
    kept = [(k, [whole(float(x)) for x in v]) for k, v in rows if v is not None and len(v) == width and all(x is not None and isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    start = sorted((sha(f"1:{'null' if k is None else k}"), v) for k, v in kept)
    cents = [v for _, v in start[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for j in set(found):
            mine = [v for (_, v), f in zip(kept, found, strict=True) if f == j]
            cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(k, *near(v)) for k, v in kept]
    inertia = {j: min(high, sum(min(d, high) for _, d, i in last if i == j)) for _, _, j in last}
    total = min(high, sum(min(d, high) for _, d, _ in last))
    names = [sha(",".join(map(str, c))) for c in cents]
    return sorted(((k, j, min(d, high), inertia[j], total, names[j]) for k, d, j in last), key=str)


def got(out):
    return sorted((tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def made(spark, rows, parts=4):
    return spark.createDataFrame([(k, v, 3, "x") for k, v in rows], SHAPE).repartition(parts)


def test_random_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 64) / 64]) for i in range(150)]
    rows += [(200 + i, [float(x) for x in rng.normal(size=64) / 8]) for i in range(200)]
    rows += [(500 + i, rows[0][1]) for i in range(180)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    rows += [(900 + i, v) for i, v in enumerate([None, [], [0.0] * 63, [0.0] * 65, [float("nan")] + [0.0] * 63, [float("inf")] + [0.0] * 63, [None] + [0.0] * 63])]
    assert got(vp.report(made(spark, rows))) == plain(rows)


@pytest.mark.parametrize("size", [1e4, 3e6, 1e12, 1e18, 1e300])
def test_large_components(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64) * size]) for i in range(40)] + [(50, [0.1] * 64), (51, [-size] * 64)]
    assert got(vp.report(made(spark, rows))) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_rows(spark, n):
    rows = [(i, [float(i % 3)] * 64) for i in range(n)]
    assert got(vp.report(made(spark, rows))) == plain(rows)


def test_tree_finds_what_comparing_all_finds():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 16, 60):
        for spread in (2, 1000):
            cents, v = rng.integers(-spread, spread, (k, 5)), rng.integers(-spread, spread, (500, 5))
            cents[-1] = cents[0]
            all_d = ((v[:, None] - cents[None]) ** 2).sum(axis=2)
            number, best = vp.Tree(cents).nearest(v)
            assert (number == all_d.argmin(axis=1)).all() and (best == all_d.min(axis=1)).all()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(op13_centroid_clustering(spark, sf)) == plain(rows)

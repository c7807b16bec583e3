"""Links and components against comparing all pairs in double precision."""

import numpy as np
import pytest

from tidebook.llm import pivots as pv
from tidebook.llm.queries import op9_embedding_near_dedup


def brute(rows, threshold=0.95):
    """(id, links, component) per row, and all linked pairs."""
    ok = [v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    at = [i for i, x in enumerate(ok) if x]
    unit = np.array([rows[i][1] for i in at], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = at[a], at[b]
        links[a] += 1
        links[b] += 1
        root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(k, low.get(find(i), k))
    return sorted((k, links[i], low[find(i)]) for i, (k, _) in enumerate(rows))


def cloud(seed, groups=12, each=25, noise=0.05, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 8))
    near = [c + noise * rng.normal(size=8) for c in centres for _ in range(each)]
    return [(i, [float(x) for x in v]) for i, v in enumerate([*near, *rng.normal(size=(n, 8))])]


@pytest.mark.parametrize("part", [512, 20])
def test_recall_and_counts(spark, part):
    rows = cloud(3)
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [-0.0] * 8]
    rows += [(2000 + i, v) for i, v in enumerate(odd)]
    vectors = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string").repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pv.near_duplicates(vectors, part=part).collect())
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) >= 0.9
    assert all(g[1:] == (0, g[0]) for g in got if g[0] >= 2000)
    assert all(g[1] >= 30 and g[2] == 0 for g in got if 1000 <= g[0] < 2000)


def test_edges(spark):
    shape = "vec_id long, embedding array<float>"
    assert pv.near_duplicates(spark.createDataFrame([], shape)).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.0]), (5, [0.0, 1.0]), (6, None)]
    out = pv.near_duplicates(spark.createDataFrame(rows, shape)).collect()
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    assert got == [(-1, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (5, 0, 5, True), (6, 0, 6, True)]


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    unit = np.array([v for _, v in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = dict(zip([i for i, _ in rows], (unit @ unit.T >= 0.95).sum(axis=1) - 1, strict=True))
    got = {r.vec_id: r.n_links for r in op9_embedding_near_dedup(spark, sf).collect()}
    assert got.keys() == links.keys() and all(got[i] <= links[i] for i in got)
    assert sum(got.values()) >= 0.9 * sum(links.values())

"""Order statistics against sorted lists."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import ranks as RK

WANTS = {"p50": ("linear", 0.5), "p99": ("linear", 0.99), "i95": ("index", 0.95), "up": ("upper", 0.5), "q1": ("exclusive", 0.25), "q3": ("exclusive", 0.75)}


def plain(v):
    v = sorted(v)
    n = len(v)
    q = statistics.quantiles(v, n=4) if n > 1 else [v[0]] * 3
    return (n, np.quantile(v, 0.5), np.quantile(v, 0.99), v[min(n - 1, math.floor(n * 0.95))], v[n // 2], q[0], q[2])


@pytest.mark.parametrize("bins", [64, 4096])
def test_quantiles_of_odd_groups(spark, bins):
    rng = random.Random(1)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 50, "heavy": [1.0] * 300 + [2.0, 1e9], "wide": [rng.uniform(-1e6, 1e6) for _ in range(400)],
        "tails": [10.0 ** rng.randint(-20, 20) * rng.choice([1, -1]) for _ in range(200)], "edge": [-1.7e300, 0.0, 1.7e300, 5e-324, 1.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("two", None), ("empty", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: tuple(r)[1:] for r in RK.quantiles(df, ["g"], "v", WANTS, bins).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(plain(vs), rel=1e-9, abs=1e-300), g


def test_many_distinct_values(spark):
    n = 2_000_000
    df = spark.range(n).select(F.lit("all").alias("g"), ((F.col("id") * 1_000_003) % n).cast("double").alias("v"))
    wants = spark.createDataFrame([("all", r) for r in (0, 1, n // 3, n - 1, n)], "g string, rank long")
    assert {(r.rank, r.value) for r in RK.select_ranks(df, ["g"], "v", wants).collect()} == {(r, float(r)) for r in (0, 1, n // 3, n - 1)}


def test_latency_summary_scans_the_ticks_once(spark, sf):
    from tidebook.plans import feeds as P

    assert not [f for f in P.latency_summary(spark, sf).inputFiles() if "events.parquet" in f]

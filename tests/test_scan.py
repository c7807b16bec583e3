"""Sliced scans against a plain-Python model, with one key holding most of the rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidebook.operators.results import max_drawdown
from tidebook.operators.scan import Running, global_rank, running, trailing, with_halo


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(900):
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        out.append((key, i * 7 + rng.randrange(5), None if rng.random() < 0.2 else rng.randrange(-50, 50), i))
    return out


@pytest.mark.parametrize("width", [50, 1000, 10**6])
def test_running_matches_model(spark, rows, width):
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint, id bigint")
    v = F.col("v")
    outs = [Running("s", "sum", v), Running("mx", "max", v), Running("mn", "min", v), Running("n", "count", v), Running("prev", "prev", v), Running("last", "last", v), Running("first", "first", v), Running("before", "sum", v, exclusive=True), Running("any", "any", v > 40)]
    got = {r.id: r for r in running(df, ["k"], ["t", "id"], F.floor(F.col("t") / width), outs).collect()}
    seen = {}
    for k, t, x, i in sorted(rows, key=lambda r: (r[1], r[3])):
        h = seen.setdefault(k, [])
        known = [y for y in h if y is not None]
        r = got[i]
        assert r.prev == (h[-1] if h else None)
        assert r.before == (sum(known) if known else None)
        h.append(x)
        known = [y for y in h if y is not None]
        assert r.n == len(known)
        assert (r.s, r.mx, r.mn) == ((sum(known), max(known), min(known)) if known else (None, None, None))
        assert (r.last, r.first) == ((known[-1], known[0]) if known else (None, None))
        assert r.any == any(y > 40 for y in known)


def test_halo_gives_whole_trailing_ranges(spark, rows):
    from pyspark.sql import Window

    df = spark.createDataFrame(rows, "k string, t bigint, v bigint, id bigint")
    w = Window.partitionBy("k", "__slice").orderBy("t").rangeBetween(-60, 0)
    got = {r.id: r.n for r in with_halo(df, F.col("t"), 100, 60).withColumn("n", F.count(F.lit(1)).over(w)).filter("not __halo").collect()}
    assert len(got) == len(rows)
    for k, t, _, i in rows:
        assert got[i] == sum(1 for r in rows if r[0] == k and t - 60 <= r[1] <= t)


@pytest.mark.parametrize("width", [40, 1000, 10**6])
def test_trailing_sums_match_model(spark, rows, width):
    data = [*rows, *[(k, t, 3, 1000 + i) for k, t, _, i in rows[::3]], *[(None, t, 1, 2000 + i) for _, t, _, i in rows[::9]], ("hot", None, 5, 3000), ("hot", None, 6, 3001)]
    df = spark.createDataFrame([(k, t, v or 0, i) for k, t, v, i in data], "k string, t bigint, v bigint, id bigint")
    got = {r.id: (r.n, r.s, r.old) for r in trailing(df, ["k"], "t", width, {"n": (F.lit(1), 60, 0), "s": (F.col("v"), 60, 0), "old": (F.lit(1), 60, 20)}).collect()}
    assert len(got) == len(data)
    for k, t, _, i in data:
        mine = [(r[1], r[2] or 0) for r in data if r[0] == k]
        near = [(a, v) for a, v in mine if a == t or None not in (a, t) and t - 60 <= a <= t]
        assert got[i] == (len(near), sum(v for _, v in near), sum(t is not None and a <= t - 20 for a, _ in near))


def test_dense_silence_costs_no_more_a_row(spark, monkeypatch):
    """A range that holds every row: a frame that is read anew for each row adds up 8e10 values here."""
    from tidebook.plans import quality as Q

    n = 400_000
    tape = F.when(F.col("id") % 4 > 0, F.array()).otherwise(F.array(F.lit("print")))
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit("hot").alias("series"), (F.col("id") * 17_000).alias("ts_us"), tape.alias("tape"))
    monkeypatch.setattr(Q, "ticks", lambda *_: df)
    began = time.monotonic()
    r = Q.rolling_silence(spark, "").agg(F.count("*").alias("n"), F.count_if("alert").alias("alerts"), F.max_by("empty_rate", "event_id").alias("rate")).first()
    assert (r.n, r.alerts, r.rate) == (n, n - -(-6_000_000_000 // 17_000), 0.75) and time.monotonic() - began < 30


def test_global_rank(spark, rows):
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint, id bigint")
    got = {r.id: r.pos for r in global_rank(df, ["t", "id"], F.floor(F.col("t") / 90), "pos").collect()}
    want = {r[3]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[3])), 1)}
    assert got == want


def test_drawdown(spark, rows):
    data = [(k, t, float(v or 0), i) for k, t, v, i in rows]
    df = spark.createDataFrame(data, "k string, t bigint, v double, id bigint")
    got = {r.k: r.max_drawdown for r in max_drawdown(df, ["k"], ["t", "id"], "v", F.floor(F.col("t") / 100)).collect()}
    for k in got:
        cum = peak = dd = 0.0
        for r in sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[3])):
            cum += r[2]
            peak = max(peak, cum)
            dd = max(dd, peak - cum)
        assert got[k] == pytest.approx(dd)

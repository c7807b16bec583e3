"""Shocks and their first moves against a plain-Python model, and what a row costs where rows are dense."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidebook.operators.shocks import MOVE, QUOTES, first_moves, rising_edges

REACH, WITHIN = 60, 25
DDL = "event_id bigint, series string, ts_us bigint, price double, " + ", ".join(f"{q} double" for q in QUOTES)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out, at = [], 0
    for i in range(1500):
        at += rng.choice((0, 1, 3, 9, 9, 400 if i % 50 == 0 else 2))
        series = rng.choice(("hot", "hot", "hot", "b", None))
        price = None if i % 90 == 7 else 100 + rng.randrange(97) * 0.5
        out.append((i, series, at, price, *[None if rng.random() < 0.2 else 0.5 + rng.choice((-10, -5, 0, 0, 0, 5, 9)) / 1000 for _ in QUOTES]))
    return out


def test_edges_and_moves_match_model(spark, rows):
    want, edges = {}, {}
    for series in ("hot", "b", None):
        mine = [r for r in rows if r[1] == series]
        was = False
        for r in mine:
            base = next(x[3] for x in mine if r[2] - REACH <= x[2])
            hot = None if base is None or r[3] is None else abs((r[3] - base) / base) >= 0.2
            if hot and was is False:
                far = lambda b: any(x is not None and y is not None and abs(x - y) >= MOVE for x, y in zip(b[4:], r[4:]))  # noqa: B023, E731
                edges[r[0]] = (r[3] - base) / base
                want[r[0]] = next((b[2] for b in mine if r[2] < b[2] <= r[2] + WITHIN and far(b)), None) if series else None
            was = hot
    df = spark.createDataFrame(rows, DDL)
    s = rising_edges(df.select("event_id", "series", "ts_us", "price"), REACH, 0.2)
    assert {r.event_id: r.drift for r in s.collect()} == edges
    got = {r.event_id: r.r_us for r in first_moves(s, df, WITHIN).collect()}
    assert got == want and len(want) > 100 and None in want.values() and len(set(want.values())) > 50


def test_dense_shocks_without_a_move_cost_no_more_a_row(spark, monkeypatch):
    """Every range holds the rows before and behind of a whole hour: read anew for each row they would be 5e10 prices, and 1e10 pairs."""
    from tidebook.plans import feeds as P

    n = 400_000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit("hot").alias("series"), (F.col("id") * 3000).alias("ts_us"), *[F.lit(0.5).alias(q) for q in QUOTES[:4]])
    monkeypatch.setattr(P, "ticks", lambda *_: df)
    began = time.monotonic()
    r = P.shock_reaction(spark, "").agg(F.count("*").alias("n"), F.count("reaction_ms").alias("moved")).first()
    assert r.n > 50_000 and r.moved == 0 and time.monotonic() - began < 45


def test_dense_latencies_cost_no_more_a_row(spark, monkeypatch):
    """All shocks wait for one move near the end; before, a frame was read anew for each row and each shock met all rows behind it."""
    from tidebook.plans import feeds as P

    n, at = 400_000, 399_000
    quote = F.when(F.col("id") < at, 0.5).otherwise(0.6)
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit("hot").alias("series"), (F.col("id") * 3000).alias("ts_us"), *[quote.alias(q) for q in QUOTES[:4]])
    monkeypatch.setattr(P, "ticks", lambda *_: df)
    began = time.monotonic()
    got = {r.series: r for r in P.latency_summary(spark, "").collect()}
    assert time.monotonic() - began < 90
    hot = [i * 31 % 97 * 0.5 >= 20 for i in range(n)]  # against the first row's price of 100
    edges = [i for i in range(1, n) if hot[i] and not hot[i - 1]]
    ms = sorted(3 * (at - i) for i in edges if i < at)
    for r in (got["hot"], got[None]):
        assert (r.shocks, r.reactions, r.min_ms, r.p95_ms) == (len(edges), len(ms), ms[0], ms[int(len(ms) * 0.95)])
        assert r.mean_ms == pytest.approx(sum(ms) / len(ms), abs=0.1)

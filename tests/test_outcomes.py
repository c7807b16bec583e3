"""Hand-built windows through the outcome chain, and every rung of the settlement ladder."""

import pytest
from pyspark.sql import functions as F

from tidebook.operators import outcomes as O

LEVELS = "array<struct<price:double,size:double>>"
DDL = (
    "cid string, series string, slug string, duration int, day string, ts double, ts_us bigint, line_no bigint, start_ts double, end_ts double, up_token string, dn_token string, "
    f"up_bid double, up_ask double, dn_bid double, dn_ask double, up_bids {LEVELS}, dn_bids {LEVELS}, tape array<struct<asset:string,price:double,size:double>>, touch_pair double"
)


def window(cid, quotes, prints=None):
    """One 300 s window, one tick every 10 s from second 1; quotes are (up_bid, up_ask, dn_bid, dn_ask)."""
    rows = []
    for i, q in enumerate(quotes):
        ts = 1000.0 + 1 + 10 * i
        tape = [("U" if s == "u" else "D", p, 1.0) for s, p in (prints or {}).get(i, [])]
        ladder = lambda b: [] if b is None else [(b, 50.0)]
        rows.append((cid, "s", "s-up-or-down-5m", 300, "1970-01-01", ts, int(ts * 1e6), i, 1000.0, 1300.0, "U", "D", *q, ladder(q[0]), ladder(q[2]), tape, None))
    return rows


FLAT = (0.49, 0.51, 0.49, 0.51)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, DDL)
    return {r.cid: r for r in O.outcomes(df, [O.Quote(**kw)]).collect()}


def test_terminal_events(spark):
    falling = [FLAT, FLAT] + [(0.41, 0.43, 0.57, 0.59)] * 10
    rows = (
        window("quiet", [FLAT] * 28)
        + window("pair", [FLAT] * 28, {2: [("u", 0.48)], 4: [("d", 0.48)]})
        + window("stop", falling, {1: [("u", 0.48)]})
        + window("dead", [FLAT] * 29, {2: [("u", 0.48)]})
        + window("late", [FLAT] * 28 + [FLAT], {28: [("u", 0.48)]})
    )
    r = run(spark, rows)
    assert {k: v.kind for k, v in r.items()} == {"quiet": "no_fill", "pair": "pair", "stop": "stop", "dead": "dead_zone", "late": "no_fill"}
    assert r["pair"].pair_cost == 0.96 and r["pair"].pnl == 4.0 and r["pair"].fees == 0.0
    assert r["stop"].entry == 0.48 and r["stop"].exit_price == 0.41 and r["stop"].pnl == pytest.approx(-7.0)
    assert r["stop"].exit_ts == 1021.0  # the first tick after the fill whose excursion reaches the threshold
    assert r["dead"].exit_ts == 1271.0 and r["dead"].exit_price == 0.49
    assert r["dead"].fees == pytest.approx(0.07 * 0.49 * 0.51 * 100, abs=1e-4)


def test_round_trip_latches_the_stop(spark):
    dip = (0.41, 0.43, 0.57, 0.59)
    no_bid = (None, 0.43, 0.57, 0.59)
    quotes = [FLAT, FLAT, no_bid, FLAT] + [dip] * 20
    got = run(spark, window("w", quotes, {1: [("u", 0.48)]}), policy="hold")
    # the crossing tick has no bid and the next tick is calm again, so the later dip no longer stops
    assert got["w"].kind == "settle"


def test_chase_completes_the_pair(spark):
    quotes = [FLAT, FLAT] + [(0.47, 0.49, 0.50, 0.505)] * 26
    rows = window("w", quotes, {1: [("u", 0.48)]})
    assert run(spark, rows, thr=0.5)["w"].kind == "dead_zone"
    r = run(spark, rows, thr=0.5, max_pair=1.0)["w"]
    assert r.kind == "pair" and r.rd > 0.48 and r.pair_cost <= 1.0


def test_gates(spark):
    rows = window("w", [FLAT] * 20)
    assert run(spark, rows)["w"].placed_elapsed == 1.0
    assert run(spark, rows, delay=60.0)["w"].placed_elapsed == 61.0
    assert run(spark, rows, delay=60.0, delay_pct=0.5)["w"].placed_elapsed == 151.0
    assert not run(spark, rows, queue_gate=10.0)["w"].entered
    assert not run(spark, rows, touch_gate=1.0)["w"].entered
    assert not run(spark, rows, lo=0.1, hi=0.3)["w"].entered


def test_dead_zone_mid_is_the_first_known(spark, monkeypatch):
    from tidebook.plans import outcomes as P
    from tidebook.plans import results as R

    quotes = [FLAT] * 27 + [(None, None, 0.49, 0.51), (0.41, 0.43, 0.57, 0.59), (0.31, 0.33, 0.67, 0.69)]
    df = spark.createDataFrame(window("w", quotes, {2: [("u", 0.48)]}), DDL)
    monkeypatch.setattr(P, "ticks", lambda *_: df)
    r = P.lab_timeline(spark, "").first()
    assert (r.outcome, r.held, r.dz_mid, r.dz_bid) == ("naked", "up", 0.42, None)
    b = R.naked_leg_buckets(spark, "").first()
    assert (b.bucket, b.n, b.mean_leg_price) == (0.4, 1, 0.42)


QUOTES = ("up_bid", "up_ask", "dn_bid", "dn_ask")


@pytest.mark.parametrize(
    "last,lat,source,value",
    [
        ((0.3, None, None, 0.8), (0.3, None, None, 0.8), "direct_bid", 0.3),
        ((None, 0.4, 0.5, 0.8), (0.25, 0.4, 0.5, 0.8), "complement_ask", 0.2),
        ((None, 0.4, 0.5, None), (0.25, 0.4, 0.5, None), "latched_bid", 0.25),
        ((None, 0.4, 0.5, None), (None, 0.4, 0.5, 0.9), "latched_complement_ask", 0.1),
        ((None, 0.8, 0.1, None), (None, 0.8, 0.1, None), "redeemed", 1.0),
        ((None, 0.3, 0.1, None), (None, 0.3, 0.1, None), "redeemed", 0.0),
        ((None, None, None, None), (None, None, None, None), "unresolved", None),
        ((0.0, None, None, 0.8), (None, None, None, 0.8), "complement_ask", 0.2),
    ],
)
def test_settlement_ladder(spark, last, lat, source, value):
    cols = ", ".join([*(f"last_{q} double" for q in QUOTES), *(f"lat_{q} double" for q in QUOTES)])
    df = spark.createDataFrame([(*last, *lat)], cols)
    r = df.select(O.settlement_ladder(F.lit("up"), F.lit(0.4)).alias("s")).first().s
    assert r.source == source and r.value == (None if value is None else pytest.approx(value))


def test_ticks_meet_each_price_once_and_then_its_configurations(spark):
    ticks = spark.createDataFrame([("w", None, 1, 0.5), ("w", "s", 2, 0.7), ("v", "s", 3, 0.9)], "cid string, series string, at bigint, x double")
    state = spark.createDataFrame([("w", None, 0.4, "a"), ("w", None, 0.4, "b"), ("w", "s", 0.6, "a"), ("v", "s", 0.95, "a")], "cid string, series string, price double, config_id string")
    j = O.meet(ticks, state, ["price"], {"over": F.round(F.col("x") - F.col("price"), 3)}, F.col("over") > 0, ["cid", "series"])
    assert {(r.cid, r.series, r.at, r.config_id, r.over) for r in j.collect()} == {("w", None, 1, "a", 0.1), ("w", None, 1, "b", 0.1), ("w", "s", 2, "a", 0.1)}


def test_thresholds_follow_the_description_of_each_tick(spark):
    """A window whose series changes keeps the threshold of the series that the tick names, and ladders are judged before prices."""
    quotes = [FLAT] * 3 + [(0.43, 0.45, 0.55, 0.57)] * 20
    rows = window("w", quotes, {1: [("u", 0.48)]})
    df = spark.createDataFrame(rows, DDL)
    table = (("zzz", 0.5), ("default_5m", 0.03), ("default_15m", 0.03))
    out = {r.config_id: r.kind for r in O.outcomes(df, [O.Quote(), O.Quote(config_id="table", thr_by_slug=table), O.Quote(config_id="far", thr=0.4)]).collect()}
    assert out["table"] == "stop" and out["far"] != "stop"


def test_a_leg_without_a_mid_is_filed_as_in_the_sql(spark, monkeypatch):
    import duckdb

    from tidebook.plans import outcomes as P
    from tidebook.plans import results as R

    df = spark.createDataFrame(window("w", [FLAT] * 27 + [(None, None, 0.49, 0.51)] * 3, {2: [("u", 0.48)]}), DDL)
    monkeypatch.setattr(P, "ticks", lambda *_: df)
    b = R.naked_leg_buckets(spark, "").first()
    lab = "WITH lab AS (SELECT 'naked' AS outcome, NULL::DOUBLE AS dz_mid, NULL::DOUBLE AS dz_bid, NULL::DOUBLE AS close_value, NULL::DOUBLE AS hold_value, NULL::BOOLEAN AS won)"
    sql = duckdb.connect().execute(lab + R._BK.removeprefix(P.LAB_SQL) + "SELECT bucket, n, mean_leg_price FROM bk").fetchone()
    assert (b.bucket, b.n, b.mean_leg_price) == sql == (0.95, 1, None)


def test_buckets_hold_the_distributions_of_legs_valued_both_ways(spark, monkeypatch):
    import statistics

    from tidebook.plans import outcomes as P
    from tidebook.plans import results as R

    up, down = (0.60, 0.62, 0.49, 0.51), (0.09, 0.11, 0.89, 0.91)
    legs = {"a": ((0.40, 0.44), up), "b": ((0.41, 0.43), down), "c": ((0.405, 0.435), down), "d": ((0.39, 0.45), FLAT), "e": ((None, 0.425), up)}
    rows = [r for cid, (quote, last) in legs.items() for r in window(cid, [FLAT] * 27 + [(*quote, 0.57, 0.59), last], {2: [("u", 0.48)]})]
    df = spark.createDataFrame(rows, DDL)
    monkeypatch.setattr(P, "ticks", lambda *_: df)
    (b,) = R.naked_leg_buckets(spark, "").collect()
    assert (b.bucket, b.n, b.n_valued, b.n_no_mid, b.mean_bid_minus_mid) == (0.4, 5, 3, 0, -0.015)
    values = {"close": [round((x - 0.48) * 100 - 7 * x * (1 - x), 4) for x in (0.40, 0.41, 0.405)], "hold": [52.0, -48.0, -48.0]}
    for name, v in values.items():
        q = statistics.quantiles(v, n=4)
        want = {"mean": statistics.fmean(v), "median": statistics.median(v), "std": statistics.pstdev(v), "p25": q[0], "p75": q[2]}
        assert {k: b[f"valued_{name}_{k}"] for k in want} == {k: pytest.approx(x, abs=1.01e-4) for k, x in want.items()}

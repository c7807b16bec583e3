import pytest
from pyspark.sql import functions as F

from tidebook.functions import book as B
from tidebook.functions import text as X
from tidebook.functions.num import as_price, round_dp


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def d(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize("bid,ask,want", [(0.30, 0.32, 0.31), (0.30, None, 0.305), (None, 0.32, 0.315), (None, None, None), (0.998, None, 1.0)])
def test_mid(spark, bid, ask, want):
    got = one(spark, m=B.mid(d(bid), d(ask))).m
    assert got == (None if want is None else pytest.approx(want, abs=1e-12))


def test_two_sided_mid_needs_four_quotes(spark):
    r = one(spark, a=B.two_sided_mid(d(0.4), d(0.42), d(0.58), d(0.6)), b=B.two_sided_mid(d(0.4), d(None), d(0.58), d(0.6)), c=B.two_sided_mid_default(d(None), d(None), d(0.6), d(0.62)))
    assert (r.a, r.b, r.c) == (0.41, None, 0.445)


def test_taker_fee(spark):
    r = one(spark, z=B.taker_fee(d(0.0)), o=B.taker_fee(d(1.0)), n=B.taker_fee(d(None)), h=B.taker_fee(d(0.5)))
    assert (r.z, r.o, r.n, r.h) == (0.0, 0.0, 0.0, pytest.approx(0.0175))


@pytest.mark.parametrize("mids,want", [([0.31, 0.77], "oscillating"), ([0.5, 0.91, 0.62], "monotonic"), ([0.22, 0.44], "monotonic"), ([0.51, 0.487], "flat"), ([], "no_data")])
def test_classify(spark, mids, want):
    hi, lo = (max(mids), min(mids)) if mids else (None, None)
    assert one(spark, c=B.classify_path(d(hi), d(lo))).c == want


def test_queue_ahead_unknown_is_not_zero(spark):
    t = "array<struct<price:double,size:double>>"
    book = F.array(F.struct(d(0.4).alias("price"), d(10.0).alias("size")), F.struct(d(0.3).alias("price"), d(5.0).alias("size")))
    bad = F.array(F.struct(d(None).alias("price"), d(10.0).alias("size")))
    r = one(spark, none=B.queue_ahead(F.lit(None).cast(t), d(0.3)), empty=B.queue_ahead(F.array().cast(t), d(0.3)), all=B.queue_ahead(book, d(0.3)), top=B.queue_ahead(book, d(0.35)), zero=B.queue_ahead(book, d(0.5)), bad=B.queue_ahead(bad, d(0.1)))
    assert (r.none, r.empty, r.all, r.top, r.zero, r.bad) == (None, None, 15.0, 10.0, 0.0, None)


def test_clamps_never_invent_a_price(spark):
    r = one(spark, p=B.clamp_prob(d(None)), m=B.clamp_mark(d(None)), r=B.resting_up(d(None), 0.02))
    assert (r.p, r.m, r.r) == (None, None, None)


def test_chase_rules(spark):
    r = one(spark, cap=B.chase_cap(0.98, d(0.47)), neg=B.chase_cap(0.5, d(0.9)), c0=B.chase_ceiling(d(0.45), d(0.51), d(0.0)), c1=B.chase_ceiling(d(0.45), d(0.51), d(1.0)), ch=B.chase_ceiling(d(0.45), d(0.51), d(0.5)), p=B.chase_progress(d(5.0), d(0.0), d(10.0)))
    assert r.cap == pytest.approx(0.51) and r.neg == pytest.approx(-0.4)
    assert (r.c0, r.c1, r.ch, r.p) == (pytest.approx(0.45), pytest.approx(0.51), pytest.approx(0.48), 0.5)


def test_excursion_equality(spark):
    assert one(spark, e=round_dp(d(0.45) - d(0.40), 6) >= 0.05).e


def test_dead_zone(spark):
    r = one(spark, a=B.in_dead_zone(d(30.0), d(300.0), 0.1), b=B.in_dead_zone(d(30.1), d(300.0), 0.1), off=B.in_dead_zone(d(30.0), d(300.0), 0.0), end=B.in_dead_zone(d(0.0), d(300.0), 0.0), sec=B.in_dead_zone(d(59.0), d(300.0), 60.0, "sec"))
    assert (r.a, r.b, r.off, r.end, r.sec) == (True, False, False, True, True)


def test_fill_predicate(spark):
    tape = F.array(F.struct(F.lit("U").alias("asset"), d(0.451).alias("price"), d(1.0).alias("size")))
    t, no = F.lit("U"), F.lit(False)
    r = one(
        spark, printed=B.fill_predicate(d(0.45), d(0.9), tape, t, 0.001, no), touch=B.fill_predicate(d(0.40), d(0.40), tape, t, 0.001, no), through=B.fill_predicate(d(0.40), d(0.399), tape, t, 0.001, no),
        placed=B.fill_predicate(d(0.40), d(0.40), tape, t, 0.001, F.lit(True)), unknown=B.fill_predicate(d(None), d(0.1), tape, t, 0.001, no),
    )
    assert (r.printed, r.touch, r.through, r.placed, r.unknown) == (True, False, True, True, False)


def test_exit_threshold_order(spark):
    table = [("btc", 0.03), ("eth-5m", 0.07), ("default_5m", 0.06)]
    f = lambda s, d_: B.exit_threshold(F.lit(s), F.lit(s), F.lit(d_), table)
    r = one(spark, exact=f("eth-5m", 300), sub=f("btc-5m", 300), default=f("sol", 300), none=f("sol", 900))
    assert (r.exact, r.sub, r.default, r.none) == (0.07, 0.03, 0.06, 0.05)


def test_as_price(spark):
    r = one(spark, nan=as_price(d(float("nan"))), inf=as_price(d(float("inf"))), txt=as_price(F.lit("junk")), ok=as_price(F.lit("0.5")))
    assert (r.nan, r.inf, r.txt, r.ok) == (None, None, None, 0.5)


def test_print_timestamps(spark):
    r = one(spark, s=X.parse_print_ts(F.lit("1725000000")), ms=X.parse_print_ts(F.lit("1725000000000")), us=X.parse_print_ts(F.lit("1725000000000000")), iso=X.parse_print_ts(F.lit("2024-08-30T06:40:00Z")), bad=X.parse_print_ts(F.lit("x")))
    assert (r.s, r.ms, r.us, r.iso, r.bad) == (1725000000.0,) * 4 + (None,)


def test_selection_validation():
    assert X.validate_selection(["BTC "], ["300"], ["btc-5m"], [300]) == (["btc"], [300])
    for tokens, durations in ((["nope"], []), ([], [60]), ([], ["x"]), (["b" * 65], []), (["b"] * 33, [])):
        with pytest.raises(ValueError):
            X.validate_selection(tokens, durations, ["btc-5m"], [300])

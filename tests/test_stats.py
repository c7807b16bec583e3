import statistics
import zlib

import pytest
from pyspark.sql import functions as F

from tidebook.functions.text import stable_seed
from tidebook.operators import stats as ST
from tidebook.operators import sweeps as SW
from tidebook.operators.outcomes import Quote
from tidebook.operators.windows import index_quantile, upper_middle


def test_stable_seed(spark):
    r = spark.range(1).select(stable_seed(F.lit("offset=0.02")).alias("s")).first()
    assert r.s == zlib.crc32(b"offset=0.02") & 0xFFFF


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [1.0, 2.0, 3.0, 4.0], [5.0, 5.0, 7.0, 9.0, 1.0, 2.0, 2.0]])
def test_order_statistics(spark, values):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    r = df.agg(upper_middle("v").alias("um"), index_quantile("v", 0.95).alias("p95")).first()
    s = sorted(values)
    assert r.um == s[len(s) // 2]
    assert r.p95 == s[min(len(s) - 1, int(len(s) * 0.95))]
    q = ST.exclusive_quartiles(ST.value_counts(df, ["k"], "v"), ["k"]).first()
    if len(values) == 1:
        assert (q.q1, q.q3) == (values[0], values[0])
    else:
        want = statistics.quantiles(values, n=4)
        assert (q.q1, q.q2, q.q3) == tuple(pytest.approx(x) for x in want)


def test_permutation_keeps_the_label_counts(spark):
    df = spark.createDataFrame([(f"c{i}", "up" if i % 3 else "down") for i in range(40)], "cid string, w string")
    p = ST.permute_labels(df, "cid", "w", 5, 1)
    counts = {(r.perm, r.w): r["count"] for r in p.groupBy("perm", "w").count().collect()}
    assert all(counts[i, "down"] == 14 and counts[i, "up"] == 26 for i in range(5))
    assert p.groupBy("perm", "cid").count().filter("count <> 1").count() == 0
    assert p.groupBy("cid").agg(F.count_distinct("w").alias("n")).filter("n > 1").count() > 0


def test_no_settled_window_leaves_no_null_distribution(spark, monkeypatch):
    from tidebook.plans import stats as P

    ddl = "config_id string, cid string, pnl double, fees double, held string, winner string, kind string"
    rows = [(k, w, v, 0.0, None, None, "pair") for k, w, v in (("a", "w1", 1.0), ("a", "w2", 2.0), ("b", "w1", 2.5), ("b", "w2", 0.25))]
    monkeypatch.setattr(P, "sweep_outcomes", lambda *_: spark.createDataFrame(rows, ddl))
    assert tuple(P.permutation_null(spark, "").first()) == ("a", 3.0, 0, 0.0, 0.0, None, None, None)
    legs = [(k, w, 50.0 if held == won else -50.0, 0.0, held, won, "settle") for k, held in (("a", "up"), ("b", "down")) for w, won in (("w1", "up"), ("w2", "down"))]
    monkeypatch.setattr(P, "sweep_outcomes", lambda *_: spark.createDataFrame(rows + legs, ddl))
    r = P.permutation_null(spark, "").first()
    assert (r.best_config, r.best_observed, r.settled_windows, r.p_family, r.p_single, r.null_median) == ("a", 3.0, 2, 1.0, 1.0, 3.0)


def test_bootstrap_small_inputs(spark):
    df = spark.createDataFrame([("a", 2.0)], "id string, v double")
    r = ST.bootstrap_ci(df, "v", "id", 50).first()
    assert (r.n, r["mean"], r.lo, r.hi) == (1, 2.0, 2.0, 2.0)
    e = ST.bootstrap_ci(df.limit(0), "v", "id", 50).first()
    assert e["mean"] is None and e.lo is None


def test_allocation(spark):
    cells = [("s", d, c, n) for d in range(6) for c, n in (("x", 20 + d), ("y", 2))] + [("t", 0, "x", 3)]
    df = spark.createDataFrame(cells, "series string, day int, class string, size bigint")
    a = ST.allocate(df, ["series"], ["series", "day", "class"], 60, 30).collect()
    assert all(1 <= r.keep <= r["size"] for r in a)
    assert sum(r.keep for r in a) == 60
    assert sum(r.keep for r in a if r.series == "s") >= 30


def test_grids():
    base = Quote()
    grid = SW.deduplicate(SW.ofat(base))
    assert grid[0].config_id == "Baseline" and len({q.key() for q in grid}) == len(grid)
    assert all(q.config_id == "Baseline" or q.config_id.startswith("offset=") for q in SW.only(grid, ["offset"]))
    assert len(SW.deduplicate([*grid, *grid])) == len(grid)
    axes = {"offset": (0.01, 0.02, 0.03), "thr": (0.05, 0.1, 0.15)}
    full = SW.ofat(base, structural=True)
    assert {q.config_id.split("=")[0] for q in full} == {"Baseline", *SW.AXES, *SW.STRUCTURAL}
    units = {(q.dead_zone_unit, q.dead_zone) for q in SW.only(full, ["dead_zone"])}
    assert units == {("pct", v) for v in (0.0, 0.05, 0.10, 0.15, 0.20, 0.30)} | {("sec", v) for v in (0.0, 15.0, 30.0, 60.0, 90.0, 120.0)}
    assert len(SW.deduplicate(SW.ofat(base, {k: SW.AXES[k] for k in ("entry_delay", "late_entry")}))) == 1 + 5 + 4  # 10% and 20% are on both
    assert dict(SW.thresholds(0.10, base, True)) == {"btc-up-or-down-5m": 0.07, "sol-up-or-down-5m": 0.09, "btc-up-or-down-15m": 0.11, "sol-up-or-down-15m": 0.11, "default_15m": 0.11, "default_5m": 0.10}
    assert dict(SW.thresholds(0.06, base, False))["btc-up-or-down-5m"] == 0.05 and dict(SW.thresholds(0.06, base, False))["default_15m"] == base.thr
    short, long = SW.sampled(base, axes, 3), SW.sampled(base, axes, 6)
    assert long[: len(short)] == short and len({q.key() for q in long}) == 7
    assert all(sorted(SW.drawn(i, n, 7) for i in range(n)) == list(range(n)) for n in (1, 2, 3, 64, 97))
    wide = {k: tuple(round(0.01 + i * 1e-5, 5) for i in range(1000)) for k in ("offset", "reversal", "thr")}  # 10**9 points
    many = SW.sampled(base, wide, 1000)
    assert len({q.key() for q in many}) == 1001 and SW.sampled(base, wide, 10) == many[:11]
    assert len(SW.sampled(base, {"offset": (0.02, 0.03)}, 10)) == 2  # all there is besides the base
    with pytest.raises(ValueError):
        Quote(policy="wait")
    with pytest.raises(ValueError):
        Quote(lo=0.9, hi=0.1)


def test_bootstrap_of_few_rows_and_clusters(spark):
    few = spark.createDataFrame([(f"r{i}", float(v), f"c{i % 2}") for i, v in enumerate((1, 2, 6))], "id string, v double, k string")
    r = ST.bootstrap_ci(few, "v", "id", 400).first()
    assert r.n == 3 and r.lo is not None and r.hi is not None and r.lo <= r["mean"] <= r.hi
    k = ST.cluster_bootstrap_ci(few, "v", "k", 400).first()
    assert k.clusters == 2 and k.lo is not None and k.hi is not None and k.lo <= k.hi
    assert ST.bootstrap_ci(few.limit(0), "v", "id", 50).first().n == 0


def test_windows_alike_are_counted_together(spark):
    df = spark.createDataFrame([("b", "x", "up"), ("b", "y", "down"), ("a", "y", "down"), ("a", "x", "up"), ("c", "x", "up"), ("d", "x", None)], "cid string, config_id string, held string")
    assert {tuple(r) for r in ST.alike(df, "cid", ["config_id", "held"]).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}

"""Volume printed since an order, and the nearest reference read, against comparing all pairs."""

import random

import pytest

from tidebook.operators import recon as RC
from tidebook.operators.prints import printed_since


@pytest.mark.parametrize("slice_us", [50, 10_000_000])
def test_printed_since_each_order(spark, slice_us):
    rng = random.Random(2)
    prints = [(f"t{rng.randint(0, 2)}", rng.randint(400, 420) / 1000, rng.randint(0, 2000), float(rng.randint(1, 9))) for _ in range(800)]
    orders = [(f"o{i}", f"t{rng.randint(0, 3)}", rng.randint(398, 421) / 1000, rng.choice([p[2] for p in prints])) for i in range(120)]
    orders += [("a", "t0", 0.41, 0), ("b", "t0", 0.41, 1000)]  # one price, two times
    want = {o: sum(s for t, p, us, s in prints if t == token and abs(p - price) <= 0.001 + 1e-9 and us >= at) for o, token, price, at in orders}
    got = printed_since(spark.createDataFrame(orders, "order_id string, token string, price double, placed_us long"), spark.createDataFrame(prints, "token string, price double, ts_us long, size double"), slice_us)
    assert {r.order_id: r.printed for r in got.collect()} == want and want["a"] > want["b"]


@pytest.mark.parametrize("slice_lines", [20, 1_000_000])
def test_nearest_reference_on_either_side(spark, slice_lines):
    rng = random.Random(3)
    rows = []
    for n in range(600):
        ws = rng.random() < 0.5
        rx = 0 if rng.random() < 0.05 else 1_000_000_000 + n * 100_000 + rng.randint(-1_500_000, 1_500_000)
        bid = rng.choice([0.4, 0.401, 0.5, None])
        rows.append(("ws" if ws else "rest", f"t{rng.randint(0, 3)}", "s", rx, n, n, "book" if ws else None, bid, 0.6, rng.choice([bid, None]) if ws else None, None))
    df = spark.createDataFrame(rows, "type string, token string, series string, rx_us long, line long, event_id long, ev_type string, bb double, ba double, decl_bb double, decl_ba double")
    got = {r.line: (r.ref.rx if r.ref else None, r.ref.bb if r.ref else None, r.reason) for r in RC.nearest_reference(df, 0.5, slice_lines).collect()}
    after = 0
    for kind, token, _, rx, line, *_, bb, ba, decl, _ in rows:
        if kind != "ws":
            continue
        above = [r for r in rows[:line] if r[0] == "rest" and r[1] == token]
        ref = None if not above else above[-1] if rx <= 0 else min(above, key=lambda r: abs(r[3] - rx))
        if ref and rx > 0 and abs(ref[3] - rx) > 500_000:
            ref = None
        reason = "no_snapshot" if not above else "outside_freshness_window" if not ref else None
        if ref and decl is not None and ref[7] is not None and abs(decl - ref[7]) > RC.EDGE:
            reason = "guard_reject"
        assert got[line] == ((ref[3], ref[7], reason) if ref else (None, None, reason))
        after += bool(ref and rx > 0 and ref[3] > rx)
    assert after > 20


def test_dense_reads_are_passed_through_once(spark):
    rng = random.Random(4)
    rows = [("t", 0, rng.random() < 0.5, 1_000_000 + rng.randint(0, 300) * 1000, line) for line in range(3000)]
    df = spark.createDataFrame([(*r, r[4] / 1e4, None) for r in rows], "token string, k long, is_read boolean, rx_us long, line long, bb double, ba double")
    got = {r.line: (r.n_rx, r.n_bb) for r in RC.nearest_above(df, 2000).collect()}
    want, reads = {}, []
    for _, _, is_read, rx, line in rows:
        if is_read:
            reads.append((rx, line))
            continue
        d, n = min(((abs(x - rx), at) for x, at in reads), default=(9999, 0))
        want[line] = (rows[n][3], n / 1e4) if d <= 2000 else (None, None)
    assert got == want

"""Recorded socket messages against a plain reading of them, book state that ends, and late rows over several batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidebook.streaming import batches as BA
from tidebook.streaming import jobs as J
from tidebook.streaming.frames import parse_frames
from tidebook.streaming.run import drain

BASE = 1_700_000_000_000_000


def number(x, top=None):
    try:
        x = float(x)
    except (TypeError, ValueError):
        return None
    return x if 0 <= x < float("inf") and (top is None or x <= top) else None


def entries(message):
    """(kind, token, price, size, side, bid, ask, bids, asks) of one message."""
    out = []
    for m in message if isinstance(message, list) else [message]:
        token = (m.get("asset_id") or m.get("token_id") or "").strip()
        kind, quote = m.get("event_type"), lambda x: number(x, 1)
        if kind == "book" and token:
            side = lambda k: [(quote(x["price"]), number(x["size"])) for x in m.get(k) or [] if quote(x["price"]) is not None and (number(x["size"]) or 0) > 0]  # noqa: B023, E731
            out.append((kind, token, None, None, None, None, None, side("bids"), side("asks")))
        elif kind == "price_change":
            for x in m.get("price_changes") or m.get("changes") or []:
                own, price, size = (x.get("asset_id") or token).strip(), quote(x.get("price")), number(x.get("size") or 0)
                if own and price is not None and size is not None:
                    side = "b" if (x.get("side") or "BUY").upper() in ("BUY", "BID") else "a"
                    out.append((kind, own, price, size, side, quote(x.get("best_bid")), quote(x.get("best_ask")), [], []))
        elif kind == "best_bid_ask" and token:
            out.append((kind, token, None, None, None, quote(m.get("best_bid")), quote(m.get("best_ask")), [], []))
    return out


def messages(n, seed):
    rng = random.Random(seed)
    price = lambda: rng.choice([f"{rng.randint(1, 99) / 100}"] * 6 + ["1.5", "NaN", "x", "-0.1", "Infinity", None])
    size = lambda: rng.choice([str(rng.randint(0, 5)), "0", "7.5", "NaN", "-1", None, "3"])
    levels = lambda: [{"price": price() or "0.5", "size": size() or "1"} for _ in range(rng.randint(0, 6))]
    change = lambda: {k: v for k, v in {"asset_id": rng.choice(["U", "D", None]), "price": price(), "size": size(), "side": rng.choice(["BUY", "SELL", "bid", "ASK", None]), "best_bid": price(), "best_ask": price()}.items() if v is not None}
    book = lambda: {"event_type": "book", rng.choice(["asset_id", "token_id"]): rng.choice(["U", "D"]), "bids": levels(), "asks": levels()}
    kinds = [
        lambda: [book(), book()], book, lambda: {"event_type": "price_change", "price_changes": [change() for _ in range(rng.randint(0, 5))]},
        lambda: {"event_type": "price_change", "asset_id": "U", "changes": [change() for _ in range(2)]}, lambda: {"event_type": "best_bid_ask", "asset_id": "D", "best_bid": price(), "best_ask": price()}, lambda: {"event_type": "tick_size_change", "asset_id": "U"},
    ]
    return [rng.choice(kinds)() for _ in range(n)]


def books(found, ttl_us=None):
    """Top, depth and provenance after each entry, from dictionaries."""
    state, out = {}, []
    for i, us, (kind, token, price, size, side, bid, ask, bids, asks) in found:
        s = state.get(token)
        if s is None or (ttl_us and us - s["us"] > ttl_us):
            s = state[token] = {"b": {}, "a": {}, "kind": None, "bid": None, "us": us}
        s["us"] = max(us, s["us"])
        if kind == "book":
            s.update(b=dict(bids), a=dict(asks))
        elif kind == "price_change":
            (s[side].__setitem__(price, size) if size > 0 else s[side].pop(price, None))
            s["b"] = {p: z for p, z in s["b"].items() if bid is None or p <= bid}
            s["a"] = {p: z for p, z in s["a"].items() if ask is None or p >= ask}
        s.update(kind=kind, bid=bid)
        out.append((i, token, max(s["b"], default=None), min(s["a"], default=None), len(s["b"]), len(s["a"]), s["kind"], s["bid"]))
    return out


def written(spark, path, sent, us):
    rows = [(i, i, us(i), json.dumps(m)) for i, m in enumerate(sent)]
    df = spark.createDataFrame(rows, "event_id long, line_no long, ts_us long, value string").withColumn("at", F.timestamp_micros("ts_us"))
    each = -(-len(rows) // 5)
    for k in range(5):
        df.filter((F.col("event_id") >= k * each) & (F.col("event_id") < (k + 1) * each)).coalesce(1).write.parquet(f"{path}/{k}.parquet")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@pytest.mark.parametrize("ttl_s", [10_000_000, 30])
def test_raw_messages_over_batches(spark, tmp_path, ttl_s):
    sent = messages(400, 1)
    us = lambda i: BASE + (i + 100 * (i // 37)) * 1_000_000
    stream = parse_frames(written(spark, str(tmp_path), sent, us))
    got = drain(J.book_state(stream, ttl_s * 1000), "raw").collect()
    want = books([(i, us(i), e) for i, m in enumerate(sent) for e in entries(m)], ttl_s * 1_000_000)
    told = [(r.event_id, r.token, r.best_bid, r.best_ask, r.n_bids, r.n_asks, r.last_kind, r.decl_bb) for r in got]
    assert sorted(told, key=str) == sorted(want, key=str)


def test_idle_state_is_gone(spark, tmp_path):
    """After the timer a token's rows are no longer in the state store, and its next frame starts afresh."""
    snapshot = {"event_type": "book", "asset_id": "U", "bids": [{"price": "0.4", "size": "1"}], "asks": []}
    change = {"event_type": "price_change", "price_changes": [{"asset_id": "U", "price": "0.3", "size": "2", "side": "BUY"}]}
    other = {"event_type": "best_bid_ask", "asset_id": "D", "best_bid": "0.1", "best_ask": "0.2"}
    sent = [snapshot, other, other, other, change]
    us = lambda i: BASE + i * 3_600_000_000
    out = drain(J.book_state(parse_frames(written(spark, str(tmp_path), sent, us)), 3_600_000), "idle").orderBy("event_id").collect()
    assert [(r.token, r.best_bid, r.n_bids) for r in out if r.token == "U"] == [("U", 0.4, 1), ("U", 0.3, 1)]


def test_late_rows_and_reappearing_windows(spark, tmp_path):
    minute = 60_000_000
    rows = [(i, f"w{i // 10}", "s", BASE + i * minute, (BASE + (i // 10 * 10 + 10) * minute) / 1e6) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, cid string, series string, ts_us long, end_ts double")
    order = [range(0, 20), range(20, 38), [5, 38, 39], [27, *range(40, 50)]]
    for k, ids in enumerate(order):
        df.filter(F.col("event_id").isin(list(ids))).coalesce(1).write.parquet(f"{tmp_path}/{k}.parquet")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    want, top = [], None
    for k, ids in enumerate(order):
        for i in ids:
            mark = None if top is None else top - 10 * minute
            late, closed = mark is not None and rows[i][3] < mark, mark is not None and rows[i][4] * 1e6 <= mark
            want += [(i, k, late, closed)] if late or closed else []
        top = max([rows[i][3] for i in ids] + ([top] if top else []))
    got = BA.late_rows(stream).collect()
    assert sorted((r.event_id, r.batch, r.late, r.reappeared) for r in got) == sorted(want) and len(want) == 2


def test_one_symbol_is_many_tasks(spark, tmp_path):
    """A symbol that holds all rows is scanned by slices, and a symbol that went quiet leaves the state."""
    rows = [(i, "all", BASE + i * 30_000_000, "A" if i % 7 else "B", 100.0 + i % 13) for i in range(2000)]
    rows[3] = (3, "gone", BASE, "A", 5.0)
    df = spark.createDataFrame(rows, "event_id long, series string, ts_us long, feed string, price double")
    for k in range(4):
        df.filter((F.col("event_id") >= k * 500) & (F.col("event_id") < k * 500 + 500)).coalesce(1).write.parquet(f"{tmp_path}/{k}.parquet")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    got = {r.event_id: (r.primary_price, r.secondary_price, r.used, r.baseline) for r in BA.spot_merge(stream, 20_000_000).collect()}
    state = {}
    for i, series, us, feed, price in rows:
        s = state.setdefault(series, {"A": None, "B": None, "us": None, "day": None, "base": None})
        s[feed] = price
        if feed == "A":
            s["us"] = us
        if s["day"] != us // 86_400_000_000:
            s.update(day=us // 86_400_000_000, base=price)
        fresh = s["us"] is not None and us - s["us"] <= 20_000_000
        assert got[i] == (s["A"], s["B"], "primary" if fresh else "secondary" if s["B"] is not None else None, s["base"])
    assert len(got) == 2000

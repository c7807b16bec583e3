"""Multi-batch streams against single-batch runs and plain-Python models."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.plans.feeds import RANGE_US, REACT_US
from tidebook.sources.derived import load, ticks
from tidebook.streaming import batches as BA
from tidebook.streaming import jobs as J
from tidebook.streaming.processors import ShockProcessor
from tidebook.streaming.run import drain, tick_stream


@pytest.fixture(scope="module")
def split(spark, sf, tmp_path_factory):
    """The event table as four time-ordered files, read one file per micro-batch."""
    out = str(tmp_path_factory.mktemp("events"))
    e = load(spark, sf, "events")
    for i in range(4):
        path = f"{out}/events_{i}.parquet"
        e.filter((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250)).coalesce(1).write.parquet(path)
    return out + "/*"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def stream(spark, split):
    return tick_stream(spark, split, glob="*.parquet", max_files=1)


def test_book_state_across_batches(spark, sf, split):
    cols = ("event_id", "best_bid", "best_ask", "n_bids", "n_asks", "last_kind")
    one = drain(J.book_state(J.frames(tick_stream(spark, sf))), "t")
    many = drain(J.book_state(J.frames(stream(spark, split))), "t")
    assert rows(one, *cols) == rows(many, *cols)


def test_window_close_across_batches(spark, sf, split):
    cols = ("cid", "snaps", "start_mid", "close_mid", "class")
    assert rows(drain(J.window_close(tick_stream(spark, sf)), "t"), *cols) == rows(drain(J.window_close(stream(spark, split)), "t"), *cols)


def test_shock_detector_model(spark, sf, split):
    got = drain(J.shock_detector(stream(spark, split), 0.2, RANGE_US, REACT_US), "t")
    t = ticks(spark, sf).select("series", "event_id", "ts_us", "up_bid", "up_ask", "dn_bid", "dn_ask").orderBy("ts_us").collect()
    want = []
    for series in {r.series for r in t}:
        recent, pend, hot_before = [], None, False
        for r in (r for r in t if r.series == series):
            price = 100 + (r.event_id * 31) % 97 * 0.5
            mid = None if r.up_bid is None or r.up_ask is None else (r.up_bid + r.up_ask) / 2.0
            q = [r.up_bid, r.up_ask, r.dn_bid, r.dn_ask, mid]
            recent = [x for x in recent if r.ts_us - x[0] <= RANGE_US] + [(r.ts_us, price)]
            if pend:
                dt = r.ts_us - pend[1]
                moved = dt <= REACT_US and any(a is not None and b is not None and abs(a - b) >= 0.01 - 1e-9 for a, b in zip(q, pend[2]))
                if moved or dt > REACT_US:
                    want.append((pend[0], moved))
                    pend = None
                    continue
            drift = (price - recent[0][1]) / recent[0][1] if len(recent) > 1 else 0.0
            hot = abs(drift) >= 0.2
            if hot and not hot_before and pend is None and mid is not None:
                hot_before, pend = True, (r.event_id, r.ts_us, q)
            elif not hot:
                hot_before = False
    final = {r.shock_id: r.reacted for r in got.collect()}
    model = dict(want)
    # a timer may also close a shock whose series has no further row before the stream ends
    assert {k: final.get(k) for k in model} == model
    assert all(not final[k] for k in final.keys() - model.keys())


def test_dense_shocks_cost_no_more_a_row():
    class Held(list):
        exists = lambda self: bool(self)
        get = lambda self: list(self)

        def put(self, rows):
            self[:] = rows

        update = put

        def __getattr__(self, name):
            return {"getListState": lambda *_: recent, "getValueState": lambda *_: Held(), "listTimers": list, "registerTimer": lambda *_: None}[name]

    recent, p = Held(), ShockProcessor(0.2, RANGE_US, REACT_US)
    p.init(Held())
    n = 20_000
    quotes = dict.fromkeys(ShockProcessor.QUOTES, 0.5)
    rows = pd.DataFrame({"ts_us": [i * 1000 for i in range(n)] + [RANGE_US + 10_000_000], "event_id": range(n + 1), "price": [100.0] * n + [110.0], **quotes})
    began = time.process_time()
    out = pd.concat(p.handleInputRows(("s",), iter([rows]), None))
    assert time.process_time() - began < 4 and out.empty
    assert recent[0] == (10_000_000, 100.0) and len(recent) == n + 1 - 10_000


def test_silence_and_sessions_across_batches(spark, sf, split):
    for job, cols in ((J.silence_alert, ("series", "end_at", "n", "empty_rate")), (J.session_segments, ("series", "start_at", "end_at", "n"))):
        assert rows(drain(job(tick_stream(spark, sf)), "t"), *cols) == rows(drain(job(stream(spark, split)), "t"), *cols)


def test_authority_and_spot_across_batches(spark, sf, split):
    a = lambda s: drain(J.source_authority(s, 600_000_000, 1_200_000_000), "t")
    assert rows(a(tick_stream(spark, sf)), "event_id", "authoritative") == rows(a(stream(spark, split)), "event_id", "authoritative")
    m = lambda s: BA.spot_merge(J.spot(s), 1_800_000_000)
    assert rows(m(tick_stream(spark, sf)), "event_id", "used", "baseline") == rows(m(stream(spark, split)), "event_id", "used", "baseline")


def test_late_rows_derive_only_what_they_read(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(BA, "fold", lambda stream, *_: seen.extend(stream.columns))
    BA.late_rows(ticks(spark, sf))
    assert set(seen) == {"event_id", "cid", "series", "ts_us", "end_ts"}

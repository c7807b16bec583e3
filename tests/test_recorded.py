"""Recorded JSON lines through the whole chain: reading, closing, outcomes, sweeps, and odd stamps."""

import json

import pytest
from pyspark.sql import functions as F

from tidebook import session
from tidebook.operators import outcomes as O
from tidebook.operators import sweeps as S
from tidebook.operators import windows as W
from tidebook.sources import ticks as T
from tidebook.streaming import jobs as J
from tidebook.streaming.run import drain


def line(cid, start, length, at, bid, ask, **more):
    def book(b, a, token):
        return {"token_id": token, "bids": {str(b): 40.0}, "asks": {str(a): 40.0}, "best_bid": b, "best_ask": a, "malformed": 0}

    body = {
        "ts": start + at, "series": f"coin-{length}", "duration": length, "label": "x", "cid": cid, "slug": f"coin-up-or-down-{length}", "start_ts": start, "end_ts": start + length,
        "up_book": book(bid, ask, f"{cid}u"), "down_book": book(round(1 - ask, 3), round(1 - bid, 3), f"{cid}d"), "tape_delta": [], "mid": (bid + ask) / 2, "touch_pair": 1.02, "err": None,
    }
    return json.dumps({**body, **more})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("days")
    base = 1_700_000_000.0
    for day in (1, 2):
        rows = []
        for w, length in enumerate((300, 900, 43200, 86400)):
            cid, start = f"w{day}{length}", base + day * 100_000 + w
            for k in range(60):
                bid = round(0.5 + 0.002 * (k % 30) - 0.001 * k, 3)
                rows.append(line(cid, start, length, k * length / 60, bid, round(bid + 0.02, 3)))
        rows[7:7] = ["", "{bad", line("absurd", base, 300, 1, 0.5, 0.52, ts=1e300), line("late", base, 300, 41 * 3600, 0.5, 0.52)]
        (out / f"ticks_2023-11-1{day}.jsonl").write_text("\n".join(rows) + "\n")
    return str(out)


def test_files_to_outcomes_and_sweep(spark, folder):
    silver = T.to_silver(T.read_ticks(spark, folder, glob=T.DAY_FILES))
    rows = silver.select("file", "line_no", "cid", "ts_us").collect()
    assert len({(r.file, r.line_no) for r in rows}) == len(rows) == 2 * 242
    assert all(r.ts_us is None for r in rows if r.cid == "absurd")
    by_file = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        by_file.setdefault(r.file, []).append(r)
    assert all([r.ts_us for r in own if r.cid == "w1300"] == sorted(r.ts_us for r in own if r.cid == "w1300") for own in by_file.values())
    assert W.finalize(silver).filter("cid like 'w%'").count() == 8
    out = {r.cid: r for r in O.outcomes(silver).collect()}
    assert {f"w{d}{n}" for d in (1, 2) for n in (300, 900, 43200, 86400)} <= set(out) and "late" in out
    assert out["w1300"].kind == out["w2300"].kind and out["w1300"].placed_ts is not None
    assert S.run_sweep(silver, [O.Quote(), O.Quote(config_id="wide", offset=0.03)]).count() > 0


def test_large_line_numbers_keep_their_order(spark):
    rows = [("c", 5, n) for n in (67108863, 67108864, 2**62, 1)]
    rows += [("c", sign * t, n) for sign in (1, -1) for t in (2**58, 2**46 - 1, 2**46, 2**46 + 1, 6) for n in (3, 9)]
    df = spark.createDataFrame(rows, "cid string, ts_us long, line_no long").withColumn("start_ts", F.lit(0.0))
    df = O.with_position(df)
    assert [(r.ts_us, r.line_no) for r in df.orderBy("at").collect()] == sorted((t, n) for _, t, n in rows)
    back = df.withColumn("start_us", O.start_us()).select("ts_us", O.seconds("at").alias("s")).collect()
    assert all(r.s == pytest.approx(r.ts_us / 1e6) for r in back)


def test_windows_of_any_length_close(spark, folder, tmp_path):
    silver = T.to_silver(T.read_ticks(spark, folder, glob=T.DAY_FILES)).filter("cid like 'w%'").withColumn("at", F.timestamp_micros("ts_us"))
    late = silver.filter("cid = 'w1300'").limit(1)
    for i, part in enumerate((silver.filter("cid like 'w1%'"), silver.filter("cid like 'w2%'"), late)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(silver.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    closed = drain(J.window_close(stream), "any-length").collect()
    assert {r.cid for r in closed if not r.reopened} >= {"w1300", "w1900", "w143200", "w186400", "w2300", "w2900", "w243200"}
    assert all(r.snaps == 60 for r in closed if not r.reopened)


def test_shared_folder_is_demanded_on_a_cluster(spark, monkeypatch):
    class Conf:
        def __init__(self, **kw):
            self.kw = kw

        def get(self, key, default=None):
            return self.kw.get(key, default)

        def set(self, key, value):
            self.kw[key] = value

    class Session:
        pass

    one = Session()
    one.conf = Conf(**{"spark.master": "spark://host:7077"})
    with pytest.raises(RuntimeError):
        session.shared_dir(one)
    one.conf = Conf(**{"spark.master": "yarn", "spark.checkpoint.dir": "s3a://x/y"})
    assert session.shared_dir(one) == "s3a://x/y"
    one.conf = Conf(**{"spark.master": "local[4]"})
    assert session.shared_dir(one).startswith("/tmp/")


def test_day_files_are_compressed_and_in_order(spark, sf):
    from tidebook.plans.bronze import bronze_path

    lines = T.read_lines(spark, bronze_path(spark, sf)).select("file", "line", F.get_json_object("value", "$.ts").cast("double").alias("ts")).collect()
    assert lines and all(r.file.endswith(".txt.gz") for r in lines)
    places = sorted((r.file.split("piece=")[0], r.file.split("piece=")[1][:12], r.line, r.ts) for r in lines if r.ts is not None)
    assert len({x[:2] for x in places}) == len({r.file for r in lines})
    # lines follow their numbers, which every 53rd event puts behind the next two
    assert sum(a[3] > b[3] for a, b in zip(places, places[1:]) if a[0] == b[0]) <= 0.05 * len(places)

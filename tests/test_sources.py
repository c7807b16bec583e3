import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidebook.operators import recon as RC
from tidebook.sources import feeds as FD
from tidebook.sources import sinks
from tidebook.sources import ticks as S


def tick(cid="c1", ts=10.0, **kw):
    book = {"token_id": "u", "bids": {"0.4": 5, "0.39": 2}, "asks": {"0.42": 1}, "best_bid": 0.4, "best_ask": 0.42}
    base = {"ts": ts, "series": "s", "duration": 300, "cid": cid, "slug": "s-up-or-down-5m-1", "start_ts": 0.0, "end_ts": 300.0, "up_book": book, "down_book": dict(book, token_id="d"), "tape_delta": [], "mid": 0.41}
    return json.dumps({**base, **kw})


@pytest.fixture()
def folder(tmp_path):
    a = tmp_path / "ticks_2024-01-01.jsonl"
    a.write_text("\n".join([tick(), "", "{bad", "[1]", tick(ts=12.0, mid=None)]) + "\n")
    with open(tmp_path / "ticks_2024-01-02.jsonl.gz", "wb") as f:  # two members appended
        f.write(gzip.compress((tick("c2", 20.0) + "\n").encode()))
        f.write(gzip.compress((tick("c1", 30.0).replace("0.41", "NaN") + "\n").encode()))
    (tmp_path / "notes.txt").write_text("ignored")
    return str(tmp_path)


def test_read_ticks_skips_bad_lines_and_reads_gzip_members(spark, folder):
    df = S.to_silver(S.read_ticks(spark, folder, glob=S.DAY_FILES))
    rows = {(r.cid, r.ts): r for r in df.collect()}
    assert sorted(rows) == [("c1", 10.0), ("c1", 12.0), ("c1", 30.0), ("c2", 20.0)]
    assert rows["c1", 30.0].mid is None  # NaN is unknown
    assert rows["c1", 10.0].up_token == "u" and [x.price for x in rows["c1", 10.0].up_bids] == [0.4, 0.39]


def test_audited_lines(spark, folder):
    p = S.parse_lines(S.read_lines(spark, [folder + "/ticks_2024-01-01.jsonl"]))
    states = {r.state: r["count"] for r in p.groupBy("state").count().collect()}
    assert states == {"valid": 2, "empty": 1, "corrupt": 2}


def test_bad_source_type(spark):
    with pytest.raises(TypeError):
        S.read_ticks(spark, [1])


def test_prefilter_keeps_undecidable_lines(spark):
    lines = spark.createDataFrame([(tick(series="btc"),), (tick(series="eth"),), ('{"x": 1}',)], "value string")
    assert S.raw_prefilter(lines, ["btc"]).count() == 2


def test_bucketed_table_needs_no_exchange(spark, sf, tmp_path):
    from tidebook.sources.derived import ticks

    t = ticks(spark, sf).select("cid", "ts_us", "mid")
    sinks.write_bucketed(t, "silver_ticks", 4)
    plan = spark.table("silver_ticks").groupBy("cid").agg(F.max("mid"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE silver_ticks")


def test_normalise_levels(spark):
    raw = F.array(*[F.struct(F.lit(p).alias("price"), F.lit(s).alias("size")) for p, s in (("0.40004", "5"), ("x", "1"), ("0.4", "9"), ("0.3", "2"))])
    m, bad = FD.normalise_levels(raw)
    r = spark.range(1).select(m.alias("m"), bad.alias("bad")).first()
    assert r.m == {0.4: 9.0, 0.3: 2.0} and r.bad == 1


@pytest.mark.parametrize("gap,want", [(0.0, "exact"), (0.55 - 0.549, "sub_tick"), (0.002, "1_3_ticks"), (0.004, ">3_ticks"), (None, None)])
def test_gap_buckets(spark, gap, want):
    assert spark.range(1).select(RC.gap_bucket(F.lit(gap).cast("double")).alias("b")).first().b == want

"""Places of lines in many and split files against a plain read, and file reports against plain loops."""

import gzip
import json
import os
import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tests.test_recorded import line
from tidebook.operators import quality as Q
from tidebook.sources import ticks as T

GATES = Q.Gates(max_gap=6.0, max_delay=5.0, max_snap_interval=3.0)


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def plain(folder):
    """(name, line, line_no, value) of all files in path order."""
    out, n = [], 0
    for name in sorted(os.listdir(folder)):
        with (gzip.open if name.endswith(".gz") else open)(f"{folder}/{name}", "rt", encoding="utf-8") as f:
            for i, text in enumerate(f, 1):
                out.append((name, i, n, text.rstrip("\n")))
                n += 1
    return out


@pytest.mark.parametrize("partitions", [8, 200])
def test_fifty_files_and_a_split_one(spark, tmp_path, small_splits, partitions):
    rng = random.Random(3)
    folder = tmp_path / "a b%20ü"
    folder.mkdir()
    for i in range(50):
        text = "".join(f"{i}-{k} {'x' * rng.randint(0, 60)}\n" * (rng.random() < 0.9) or "\n" for k in range(rng.choice([0, 1, 7, 40])))
        (folder / f"ticks_2024-01-{i % 28 + 1:02d}_{i:02d}.jsonl").write_text(text)
    big = [f"big {k} {'é' * rng.randint(0, 90)}" for k in range(2000)]
    (folder / "ticks_2024-01-15_big.jsonl").write_text("\n".join(big))
    with gzip.open(folder / "ticks_2024-02-01.jsonl.gz", "wt") as f:
        f.write("\n".join(big[:300]))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        lines = T.read_lines(spark, str(folder))
        assert lines.rdd.getNumPartitions() > 50
        got = [(r.file.rsplit("/", 1)[1], r.line, r.line_no, r.value) for r in lines.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == plain(folder)
    listed = {r.file.rsplit("/", 1)[1]: r.size_bytes for r in T.list_files(spark, str(folder)).collect()}
    assert listed == {n: size for n in os.listdir(folder) if (size := os.path.getsize(folder / n))}


def test_uncounted_split_is_an_error(spark, tmp_path, small_splits):
    (tmp_path / "ticks_2024-01-01.jsonl").write_text("".join(f"{k} {'x' * 50}\n" for k in range(400)))
    lines = T.read_lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    # the plan keeps the splits it was made with or says that they are others; it never numbers silently
    try:
        got = [r.line_no for r in lines.orderBy("line_no").collect()]
    except SparkRuntimeException as e:
        assert "not counted" in str(e)
    else:
        assert got == list(range(400))


def report(folder):
    """What the reports must say, by loops over the lines of each file."""
    out = {}
    for name in sorted(os.listdir(folder)):
        seen, r = {}, {"raw": 0, "empty": 0, "corrupt": 0, "valid": 0, "err": 0, "missing": {}, "series": {}, "issues": [], "gaps": 0, "rev": 0, "trades": 0}
        for n, text in enumerate(open(f"{folder}/{name}"), 1):
            r["raw"] += 1
            if not text.strip():
                r["empty"] += 1
                continue
            try:
                t = json.loads(text)
            except ValueError:
                r["corrupt"] += 1
                r["issues"].append((n, "corrupt", text.strip()[:120]))
                continue
            r["valid"] += 1
            r["err"] += bool(t.get("err"))
            for k in ("ts", "cid", "series", "duration", "start_ts", "end_ts", "up_book", "down_book"):
                if t.get(k) is None:
                    r["missing"][k] = r["missing"].get(k, 0) + 1
                    r["issues"].append((n, "issue", f"absent.{k}"))
            if t.get("mid") is not None and t["mid"] > 1.01:
                r["issues"].append((n, "issue", "mid.range"))
            for side, b in (("up", t.get("up_book")), ("down", t.get("down_book"))):
                if b is None:
                    r["issues"] += [(n, "issue", f"{side}.bid.ladder"), (n, "issue", f"{side}.ask.ladder")]
                elif b["best_bid"] >= b["best_ask"]:
                    r["issues"].append((n, "issue", f"{side}.crossed"))
            if t.get("series"):
                r["series"][t["series"]] = r["series"].get(t["series"], 0) + 1
                r["trades"] += len(t["tape_delta"]) if t.get("duration") else 0
            if t.get("cid") and t.get("ts") is not None:
                key = (t.get("series") or "", t["cid"])
                if key in seen:
                    r["rev"] += t["ts"] < seen[key]
                    r["gaps"] += t["ts"] - seen[key] > 6
                seen[key] = t["ts"]
        r["windows"] = len(seen)
        out[name] = r
    return out


def test_reports_by_file(spark, tmp_path, small_splits):
    rng = random.Random(4)
    for i in range(6):
        rows = []
        for k in range(rng.choice([0, 5, 150, 400])):
            bid = round(rng.uniform(0.1, 0.8), 3)
            more = rng.choice([{}, {}, {"mid": 1.5}, {"err": "x"}, {"duration": None}, {"series": None}, {"up_book": None}, {"cid": None}, {"tape_delta": [{"asset": "a", "price": 0.5, "size": 2.0}]}])
            at = k * 2 + rng.choice([0, 0, 0, 9, -5])
            ask = bid + rng.choice([0.02, 0.02, 0.02, -0.01])
            good = json.dumps({**json.loads(line(f"w{k % 3}", 1_700_000_000.0, 300, at, bid, ask)), **more})
            rows.append(rng.choice(["", "{bad", *[good] * 8]))
        (tmp_path / f"ticks_2024-01-0{i + 1}.jsonl").write_text("".join(r + "\n" for r in rows))
    checked = Q.checked_lines(T.parse_lines(T.read_lines(spark, str(tmp_path))), T.silver_columns(), ["file"])
    got = Q.verify_report(checked, GATES, ["file"], T.list_files(spark, str(tmp_path)).select("file", "size_bytes"))
    rows = {r.file.rsplit("/", 1)[1]: r for r in got.collect()}
    want = {k: v for k, v in report(str(tmp_path)).items() if v["raw"]}
    assert rows.keys() == want.keys()
    for name, w in want.items():
        r = rows[name]
        assert (r.raw_lines, r.empty_lines, r.corrupt_lines, r.valid_ticks, r.collector_errors) == (w["raw"], w["empty"], w["corrupt"], w["valid"], w["err"])
        assert (r.missing_fields, r.series_counts, r.tape_entries, r.windows_count) == (w["missing"], w["series"], w["trades"], w["windows"])
        assert (r.sampling_gaps, r.time_reversals, r.schema_errors) == (w["gaps"], w["rev"], sum(t == "issue" for _, t, _ in w["issues"]))
        assert [tuple(x) for x in r.sample_issues or []] == w["issues"][:20]
        assert r.status == ("FAIL" if w["corrupt"] or r.schema_errors > (w["valid"] * 0.05 or 1) else r.status)
        assert r.readiness_level == "INSUFFICIENT" and len(r.readiness) == 10


def test_day_of_many_files_keeps_line_order(spark, tmp_path, small_splits):
    rows = [line("w", 1_700_000_000.0, 300, k, 0.5, 0.52) for k in range(290)]
    for i in range(29):
        (tmp_path / f"ticks_2023-11-14_{i:02d}.jsonl").write_text("".join(r + "\n" for r in rows[i * 10 : i * 10 + 10]))
    silver = T.to_silver(T.read_ticks(spark, str(tmp_path)))
    assert [r.ts for r in silver.orderBy("line_no").collect()] == [1_700_000_000.0 + k for k in range(290)]
    first = silver.agg(F.min_by("ts", "line_no").alias("f"), F.max_by("ts", "line_no").alias("l")).first()
    assert (first.f, first.l) == (1_700_000_000.0, 1_700_000_289.0)

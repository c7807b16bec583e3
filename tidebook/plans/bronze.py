"""Queries over recorded JSON lines written from the tick view, with blank and broken lines mixed in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.num import round_dp
from ..operators import quality as Q
from ..operators import windows as W
from ..session import scratch_path, shared_table
from ..sources import sinks
from ..sources import ticks as S
from ..sources.derived import load, ticks, ticks_from_events
from .quality import GATES, LOOSE_OK, LOOSE_SQL, loose_passed
from .features import WINDOWS_SQL
from .registry import query
from .sqltext import R, T, day_of

c = F.col
_PATHS: dict[tuple[str, str], str] = {}

_OK = "event_id%173<>0 AND event_id%179<>0"
VT = T.rstrip() + f", v AS (SELECT * FROM ticks WHERE {_OK})\n"


def bronze_path(spark, sf) -> str:
    """JSON-line day files written once per application; range-partitioned so a huge day is many files.

    Events are dealt to their files, and only then projected to ticks and lines, which are many times as wide.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PATHS:
        e = load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("event", F.struct("*"))
        placed = ticks_from_events(e, "event").select("event.*", X.day_key(c("ts")).alias("file_day"), "line_no")
        dealt = ticks_from_events(sinks.in_files(placed, "file_day", "line_no"), "file_day", "piece")
        w = S.to_wire(dealt.withColumnRenamed("file_day", "dealt_day"), "dealt_day", "piece")
        value = F.when(c("event_id") % 173 == 0, "").when(c("event_id") % 179 == 0, "{bad").otherwise(F.to_json("tick"))
        path = scratch_path(spark, "bronze")
        sinks.write_lines(w.drop("file_day").withColumnRenamed("dealt_day", "file_day").withColumn("value", value), path, "file_day")
        _PATHS[key] = path
    return _PATHS[key]


def silver(spark, sf):
    return S.to_silver(S.read_ticks(spark, bronze_path(spark, sf)))


def parsed_lines(spark, sf):
    return S.parse_lines(S.read_lines(spark, bronze_path(spark, sf)))


@query(
    "read_ticks",
    VT + "SELECT cid, ts, series, duration, slug, start_ts, end_ts, up_bid, up_ask, dn_bid, dn_ask, mid, touch_pair, err, len(tape) AS prints, up_token, dn_token, ts_us, el_ms, day FROM v",
)
def read_ticks(spark, sf):
    return silver(spark, sf).select(
        "cid", "ts", "series", "duration", "slug", "start_ts", "end_ts", "up_bid", "up_ask", "dn_bid", "dn_ask", "mid", "touch_pair", "err",
        F.size("tape").alias("prints"), "up_token", "dn_token", "ts_us", "el_ms", "day",
    )


@query(
    "read_ticks_audited",
    T + f"SELECT {day_of('ts')} AS file_day, CASE WHEN event_id%173=0 THEN 'empty' WHEN event_id%179=0 THEN 'corrupt' ELSE 'valid' END AS state, count(*) AS lines FROM ticks GROUP BY 1,2",
)
def read_ticks_audited(spark, sf):
    return parsed_lines(spark, sf).groupBy("file_day", "state").agg(F.count(F.lit(1)).alias("lines"))


@query("raw_prefilter", VT + "SELECT series, count(*) AS ticks, round(sum(up_bid),6) AS s FROM v WHERE contains(series,'pur') OR contains(series,'view') GROUP BY 1")
def raw_prefilter(spark, sf):
    """Lines of other series are dropped on text alone; only survivors reach the JSON parser."""
    kept = S.raw_prefilter(S.read_lines(spark, bronze_path(spark, sf)), ["pur", "view"])
    t = S.to_silver(S.parse_lines(kept).filter(c("state") == "valid").select("tick.*"))
    return t.groupBy("series").agg(F.count(F.lit(1)).alias("ticks"), F.round(F.sum("up_bid"), 6).alias("s"))


@query("discover_day_files", T + f"SELECT {day_of('ts')} AS day, count(*) AS lines FROM ticks GROUP BY 1 ORDER BY 1")
def discover_day_files(spark, sf):
    lines = S.read_lines(spark, bronze_path(spark, sf)).filter(c("file_day") != "")
    return lines.groupBy(c("file_day").alias("day")).agg(F.count(F.lit(1)).alias("lines")).orderBy("day")


@query("append_day_sink", T + "SELECT day, series, count(*) AS ticks, min(ts_us) AS first_us FROM ticks GROUP BY 1,2")
def append_day_sink(spark, sf):
    """Two appends into one day-partitioned table; the read prunes partitions and columns."""
    t = ticks(spark, sf).select("day", "series", "ts_us", "line_no")
    path = scratch_path(spark, "days")
    sinks.append_day(t.filter(c("line_no") % 2 == 0), path)
    sinks.append_day(t.filter(c("line_no") % 2 == 1), path, compression="zstd")
    back = spark.read.schema("series string, ts_us bigint, line_no bigint, day string").parquet(path)
    return back.groupBy("day", "series").agg(F.count(F.lit(1)).alias("ticks"), F.min("ts_us").alias("first_us"))


@query("verbatim_copy_sink", LOOSE_SQL + f"SELECT start_day, cid, count(*) AS lines FROM (SELECT t.day AS start_day, t.cid FROM ticks t WHERE {_OK} AND cid IN (SELECT cid FROM gates WHERE {LOOSE_OK})) GROUP BY 1,2")
def verbatim_copy_sink(spark, sf):
    """Raw lines of windows that passed, copied unchanged under their window's start day."""
    p = parsed_lines(spark, sf).filter(c("state") == "valid")
    lines = p.select("value", c("tick.cid").alias("cid"), X.day_key(c("tick.start_ts")).alias("start_day"))
    path = scratch_path(spark, "pristine")
    sinks.copy_verbatim(lines, loose_passed(spark, sf), path)
    # the day is read off the path, so an empty result is an empty table rather than a missing column
    back = spark.read.option("recursiveFileLookup", "true").text(path)
    return back.groupBy(F.regexp_extract("_metadata.file_path", S.DAY_PATTERN, 1).alias("start_day"), F.get_json_object("value", "$.cid").alias("cid")).agg(F.count(F.lit(1)).alias("lines"))


@query("windows_sink", WINDOWS_SQL + "SELECT cid, series, snaps, start_mid, close_mid, class, touch_pair_median FROM windows")
def windows_sink(spark, sf):
    t = ticks(spark, sf)
    w = W.finalize(t)
    path = scratch_path(spark, "windows")
    sinks.write_windows(w, W.series_summary(w, W.series_dim(t)), path)
    schema = "cid string, series string, snaps bigint, start_mid double, close_mid double, class string, touch_pair_median double"
    return spark.read.schema(schema).json(f"{path}/windows")


def checked(spark, sf):
    """Every line classified and checked in one parse; written once per application and read by all reports."""
    def build():
        return Q.checked_lines(parsed_lines(spark, sf), S.silver_columns(), ["file", "file_day"])

    return shared_table(spark, sf, "checked", build)


def _report(spark, sf):
    """Reports by day, over all files of it."""
    return Q.verify_report(checked(spark, sf), GATES, ["file_day"])


_PIECE = "lpad(CAST(line_no//50000 AS VARCHAR),12,'0')"


def _rep_sql(key, by):
    """The report by ``key``; ``by`` gives its columns in a row of ticks."""
    gap = f"lag(ts_us) OVER (PARTITION BY {key}, cid ORDER BY line_no)"
    return VT.rstrip() + f""",
al AS (SELECT *, {by} FROM ticks), va AS (SELECT * FROM al WHERE {_OK}),
ln AS (SELECT {key}, count(*) AS raw_lines, count(*) FILTER (WHERE event_id%173=0) AS empty_lines, count(*) FILTER (WHERE event_id%179=0 AND event_id%173<>0) AS corrupt_lines FROM al GROUP BY ALL),
tc AS (SELECT {key}, count(*) AS valid_ticks, CAST(sum((CASE WHEN mid<-0.01 OR mid>1.01 THEN 1 ELSE 0 END)+(CASE WHEN touch_pair<0.5 OR touch_pair>1.5 THEN 1 ELSE 0 END)+(CASE WHEN up_bid>=up_ask THEN 1 ELSE 0 END)
  +(CASE WHEN dn_bid>=dn_ask THEN 1 ELSE 0 END)+len(list_filter(tape, lambda z: z.size<=0))) AS BIGINT) AS schema_errors, CAST(sum((CASE WHEN up_bid>=up_ask THEN 1 ELSE 0 END)+(CASE WHEN dn_bid>=dn_ask THEN 1 ELSE 0 END)) AS BIGINT) AS crossed_books,
  CAST(0 AS BIGINT) AS book_anomalies, count(*) FILTER (WHERE err IS NOT NULL) AS collector_errors, CAST(sum(len(tape)) AS BIGINT) AS tape_entries FROM va GROUP BY ALL),
gp AS (SELECT *, (ts_us-{gap})/1e6 AS gap FROM va),
wi AS (SELECT {key}, cid, any_value(start_ts) AS s, any_value(end_ts) AS e, arg_min(ts, line_no) AS f, arg_max(ts, line_no) AS l, count(*) FILTER (WHERE gap>5400) AS g, count(*) FILTER (WHERE gap<0) AS r FROM gp GROUP BY ALL),
wc AS (SELECT {key}, count(*) AS windows_count, CAST(sum(g) AS BIGINT) AS sampling_gaps, count(*) FILTER (WHERE greatest(0.0e0,f-s)>1500) AS late_starts, count(*) FILTER (WHERE greatest(0.0e0,e-l)>1500) AS early_cutoffs,
  CAST(sum(r) AS BIGINT) AS time_reversals, array_to_string(list_sort(list(DISTINCT {day_of('f')})),',') AS time_blocks FROM wi GROUP BY ALL),
rep0 AS (SELECT * FROM ln LEFT JOIN tc USING ({key}) LEFT JOIN wc USING ({key})),
rep AS (SELECT *, CASE WHEN corrupt_lines>0 OR schema_errors>valid_ticks*0.05e0 THEN 'FAIL' WHEN crossed_books+sampling_gaps+late_starts+early_cutoffs+collector_errors+time_reversals>0 THEN 'WARN' ELSE 'PASS' END AS status FROM rep0)
"""


_REP = _rep_sql("file_day", f"{day_of('ts')} AS file_day")
_BY_FILE = "file_day, piece"
_COUNTS = "raw_lines, empty_lines, corrupt_lines, valid_ticks, schema_errors, crossed_books, book_anomalies, collector_errors, tape_entries, windows_count, sampling_gaps, late_starts, early_cutoffs, time_reversals, status"
_FILES_SQL = _rep_sql(_BY_FILE, f"{day_of('ts')} AS file_day, {_PIECE} AS piece") + f""",
pl AS (SELECT *, row_number() OVER (PARTITION BY {_BY_FILE} ORDER BY line_no) AS line FROM al),
ev AS (SELECT {_BY_FILE}, line, unnest(CASE WHEN event_id%173=0 THEN [] WHEN event_id%179=0 THEN ['corrupt {{bad'] ELSE list_concat(list_filter(['issue '||CASE WHEN mid<-0.01 OR mid>1.01 THEN 'mid.range' END,
  'issue '||CASE WHEN touch_pair<0.5 OR touch_pair>1.5 THEN 'touch_pair.range' END, 'issue '||CASE WHEN up_bid>=up_ask THEN 'up.crossed' END, 'issue '||CASE WHEN dn_bid>=dn_ask THEN 'down.crossed' END], lambda z: z IS NOT NULL),
  list_transform(list_filter(tape, lambda z: z.size<=0), lambda z: 'issue tape.size')) END) AS what, generate_subscripts(CASE WHEN event_id%173=0 THEN [] WHEN event_id%179=0 THEN [1] ELSE list_concat(list_filter([CASE WHEN mid<-0.01 OR mid>1.01 THEN 1 END,
  CASE WHEN touch_pair<0.5 OR touch_pair>1.5 THEN 1 END, CASE WHEN up_bid>=up_ask THEN 1 END, CASE WHEN dn_bid>=dn_ask THEN 1 END], lambda z: z IS NOT NULL), list_transform(list_filter(tape, lambda z: z.size<=0), lambda z: 1)) END, 1) AS nth FROM pl),
er AS (SELECT *, row_number() OVER (PARTITION BY {_BY_FILE} ORDER BY line, nth) AS r FROM ev),
es AS (SELECT {_BY_FILE}, string_agg(CAST(line AS VARCHAR)||' '||what, '; ' ORDER BY r) AS issues FROM er WHERE r<=20 GROUP BY ALL),
se AS (SELECT {_BY_FILE}, string_agg(series||'='||CAST(n AS VARCHAR), ',' ORDER BY series) AS series_counts FROM (SELECT {_BY_FILE}, series, count(*) AS n FROM va GROUP BY ALL) GROUP BY ALL),
mk AS (SELECT {_BY_FILE}, series, duration, count(DISTINCT cid) AS w, CAST(sum(len(tape)) AS BIGINT) AS t FROM va GROUP BY ALL),
ms AS (SELECT {_BY_FILE}, count(*) AS markets, min(w) AS least, string_agg(series||'/'||CAST(duration AS VARCHAR)||'='||CAST(w AS VARCHAR)||'/'||CAST(t AS VARCHAR), ',' ORDER BY series, duration) AS market_breakdown FROM mk GROUP BY ALL)
SELECT {_BY_FILE}, {_COUNTS}, time_blocks, series_counts, market_breakdown, coalesce(issues,'') AS issues,
  CASE WHEN corrupt_lines=0 AND collector_errors=0 AND valid_ticks>=10000 AND windows_count>=100 AND tape_entries>=100 AND markets>=10 AND least>=10 AND len(string_split(time_blocks,','))>=3 AND schema_errors<=valid_ticks*0.05e0 AND sampling_gaps<=windows_count*0.1e0 THEN 'RESEARCH_READY'
   WHEN corrupt_lines=0 AND collector_errors<=valid_ticks*0.01e0 AND valid_ticks>=1000 AND windows_count>=30 AND tape_entries>=30 AND schema_errors<=valid_ticks*0.05e0 AND sampling_gaps<=windows_count*0.5e0 THEN 'EXPLORATORY' ELSE 'INSUFFICIENT' END AS readiness_level
FROM rep LEFT JOIN es USING ({_BY_FILE}) LEFT JOIN se USING ({_BY_FILE}) LEFT JOIN ms USING ({_BY_FILE})"""


@query("file_verify", _FILES_SQL)
def file_verify(spark, sf):
    """The whole report of every file; nested parts are told as text here."""
    rep = Q.verify_report(checked(spark, sf), GATES, ["file"], S.list_files(spark, bronze_path(spark, sf), "part-*").select("file", "size_bytes"))
    text = lambda a, f, sep=",": F.array_join(F.transform(a, f), sep)
    told = {
        "file_day": F.regexp_extract("file", S.DAY_PATTERN, 1), "piece": F.regexp_extract("file", "piece=([0-9]+)", 1), "time_blocks": F.array_join("time_blocks", ","),
        "series_counts": text(F.map_entries("series_counts"), lambda x: F.concat_ws("=", x["key"], x["value"])),
        "market_breakdown": text("market_breakdown", lambda x: F.concat(x["series"], F.lit("/"), x["duration"], F.lit("="), x["windows"], F.lit("/"), x["trades"])),
        "issues": F.coalesce(text("sample_issues", lambda x: F.concat_ws(" ", x["line"], x["type"], x["detail"]), "; "), F.lit("")),
    }
    return rep.withColumns(told).select("file_day", "piece", *_COUNTS.split(", "), "time_blocks", "series_counts", "market_breakdown", "issues", "readiness_level")


_REASON = "CASE WHEN {0}>0 THEN '{1}='||CAST({0} AS VARCHAR) END"


def _reasons(pairs):
    return "array_to_string(list_filter([" + ", ".join(_REASON.format(a, b) for a, b in pairs) + "], lambda z: z IS NOT NULL), '; ')"


_STATUS_SQL = _REP + """, st AS (SELECT *, CASE status WHEN 'PASS' THEN 'complete' WHEN 'WARN' THEN 'partial' ELSE 'broken' END AS label, CASE status WHEN 'PASS' THEN '' WHEN 'WARN' THEN W ELSE F END AS reasons FROM rep)
""".replace(
    " W ", " " + _reasons([("schema_errors", "schema"), ("sampling_gaps", "gaps"), ("collector_errors", "collector"), ("late_starts", "late"), ("early_cutoffs", "early"), ("time_reversals", "reversals")]) + " "
).replace(" F END", " " + _reasons([("corrupt_lines", "corrupt"), ("schema_errors", "schema")]) + " END")


@query("file_status", _STATUS_SQL + "SELECT file_day, status, label, reasons FROM st")
def file_status(spark, sf):
    return _report(spark, sf).select("file_day", "status", "label", "reasons")


_SUMS = ["raw_lines", "empty_lines", "corrupt_lines", "valid_ticks", "schema_errors", "sampling_gaps", "time_reversals"]


@query("dir_rollup", _REP + "SELECT count(*) AS files, " + ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in _SUMS) + ", CASE WHEN bool_or(status='FAIL') THEN 'FAIL' WHEN bool_or(status='WARN') THEN 'WARN' ELSE 'PASS' END AS status FROM rep")
def dir_rollup(spark, sf):
    return Q.dir_rollup(_report(spark, sf), _SUMS)


@query("day_gates", _STATUS_SQL + "SELECT file_day, status='PASS' AS accepted, CASE WHEN status<>'PASS' THEN 'status='||status END AS reason FROM st")
def day_gates(spark, sf):
    return Q.day_gates(_report(spark, sf)).select("file_day", "accepted", "reason")


def _digest(df, row):
    h = F.conv(F.substring(F.md5(row.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("digest"))


_DIG = "SELECT day, count(*) AS rows, CAST(sum(CAST('0x'||substr(md5({row}),1,8) AS BIGINT)) AS BIGINT) AS digest FROM ticks GROUP BY 1"
_ROW = "cid||'|'||CAST(ts_us AS VARCHAR)||'|'||CAST(event_id AS VARCHAR)"


@query("content_digests", T + _DIG.format(row=_ROW))
def content_digests(spark, sf):
    """Order-independent content digest per day; partial sums, so no day is ever gathered."""
    t = ticks(spark, sf)
    return _digest(t, F.concat_ws("|", "cid", c("ts_us").cast("string"), c("event_id").cast("string")))


@query("digest_drift", T + f""", a AS ({_DIG.format(row=_ROW)}), b AS ({_DIG.format(row=_ROW + "||CASE WHEN day LIKE '%-1%' AND event_id%500=0 THEN 'x' ELSE '' END")})
   SELECT day, a.digest AS recorded, b.digest AS current FROM a JOIN b USING (day) WHERE a.digest <> b.digest""")
def digest_drift(spark, sf):
    """Recorded digests against a second materialisation in which some days were altered."""
    t = ticks(spark, sf)
    row = F.concat_ws("|", "cid", c("ts_us").cast("string"), c("event_id").cast("string"))
    touched = F.when(c("day").contains("-1") & (c("event_id") % 500 == 0), "x").otherwise("")
    a = _digest(t, row).select("day", c("digest").alias("recorded"))
    b = _digest(t, F.concat(row, touched)).select("day", c("digest").alias("current"))
    return a.join(b, "day").filter(c("recorded") != c("current"))


@query("file_digests")
def file_digests(spark, sf):
    """sha256 of every source file (files up to 2 GB; larger sources use content digests)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(bronze_path(spark, sf))
    day = F.regexp_extract("path", S.DAY_PATTERN, 1)
    return files.select(day.alias("day"), F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


@query(
    "journal_snapshot",
    T + """, j AS (SELECT cid, max(struct_pack(t:=ts_us, b:=up_bid, a:=up_ask, n:=len(tape))) AS m FROM ticks GROUP BY 1)
    SELECT cid, CASE WHEN m.b IS NOT NULL THEN true ELSE false END AS has_bid, CASE WHEN m.n>0 THEN true ELSE false END AS has_prints FROM j""",
)
def journal_snapshot(spark, sf):
    """Latest state per window as a compact journal row: empty and zero fields are dropped."""
    last = ticks(spark, sf).groupBy("cid").agg(F.max_by(F.struct("up_bid", "up_ask", F.size("tape").cast("double").alias("prints")), "ts_us").alias("s"))
    state = F.map_filter(
        F.create_map(F.lit("up_bid"), c("s.up_bid"), F.lit("up_ask"), c("s.up_ask"), F.lit("prints"), c("s.prints")),
        lambda k, v: v.isNotNull() & (v != 0),
    )
    j = last.select("cid", F.to_json(state).alias("row"))
    return j.select("cid", c("row").contains('"up_bid"').alias("has_bid"), c("row").contains('"prints"').alias("has_prints"))

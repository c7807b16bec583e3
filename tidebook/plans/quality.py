"""Certification queries and ordered-scan queries over ticks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import text as X
from ..functions.num import round_dp
from ..functions.quality import silver_required, tick_issues
from ..operators import quality as Q
from ..operators import ranks as RK
from ..operators import windows as W
from ..operators.scan import Running, running, trailing, with_halo
from ..sources import feeds as FD
from ..sources.derived import ticks
from .features import WINDOWS_SQL
from .registry import query
from .sqltext import R, T, classify, day_of

c = F.col
GATES = Q.Gates(max_gap=5400.0, max_delay=1500.0, max_snap_interval=2400.0)

_G = "lag(ts_us) OVER (PARTITION BY cid ORDER BY line_no)"
GAP_SQL = T + f", g AS (SELECT *, {_G} AS prev_us, (ts_us-{_G})/1e6 AS gap FROM ticks)\n"


@query(
    "gaps_reversals",
    GAP_SQL
    + f"SELECT cid, count(*) FILTER (WHERE gap > 5400) AS gaps, count(*) FILTER (WHERE gap < 0) AS reversals, {R('max(gap) FILTER (WHERE gap > 5400)', 2)} AS max_gap FROM g GROUP BY 1",
)
def gaps_reversals(spark, sf):
    t = ticks(spark, sf).select("cid", "ts_us", "line_no")
    g = W.gaps_and_reversals(t, ["cid"], GATES.max_gap)
    return g.groupBy("cid").agg(F.count_if("is_gap").alias("gaps"), F.count_if("is_reversal").alias("reversals"), round_dp(F.max(F.when(c("is_gap"), c("gap_sec"))), 2).alias("max_gap"))


CONT_SQL = GAP_SQL + f""", w AS (SELECT cid, any_value(series) AS series, any_value(slug) AS slug, any_value(duration) AS duration, any_value(start_ts) AS start_ts, any_value(end_ts) AS end_ts,
  arg_min(ts, line_no) AS first_ts, arg_max(ts, line_no) AS last_ts, count(*) AS tick_count, count(*) FILTER (WHERE gap>5400) AS gaps_count,
  coalesce(max(gap) FILTER (WHERE gap>5400),0) AS mg, count(*) FILTER (WHERE gap<0) AS time_reversals, count(*) FILTER (WHERE coalesce(err,'')<>'') AS error_ticks,
  count(*) FILTER (WHERE coalesce(mid<-0.01 OR mid>1.01,false) OR coalesce(touch_pair<0.5 OR touch_pair>1.5,false)) AS bounds_violations,
  min(day) AS start_day FROM g GROUP BY 1),
cont AS (SELECT *, greatest(0.0e0,first_ts-start_ts)>1500 AS late_start, greatest(0.0e0,end_ts-last_ts)>1500 AS early_cutoff, {R('greatest(0.0e0,first_ts-start_ts)', 2)} AS start_delay_sec,
  {R('greatest(0.0e0,end_ts-last_ts)', 2)} AS end_cutoff_sec, {R('greatest(0.0e0,last_ts-first_ts)', 2)} AS span_sec, {R('mg', 2)} AS max_gap_sec, CAST(ceil(duration/2400.0e0) AS BIGINT) AS min_snaps FROM w),
gates AS (SELECT *, list_filter([CASE WHEN late_start THEN 'late_start' END, CASE WHEN early_cutoff THEN 'early_cutoff' END, CASE WHEN gaps_count>0 THEN 'sampling_gap' END, CASE WHEN time_reversals>0 THEN 'time_reversal' END,
  CASE WHEN error_ticks>0 THEN 'collector_error' END, CASE WHEN bounds_violations>0 THEN 'bounds_violation' END, CASE WHEN tick_count<min_snaps THEN 'snap_density' END], lambda z: z IS NOT NULL) AS failing FROM cont)
"""


@query("start_end_delay", CONT_SQL + "SELECT cid, start_delay_sec, end_cutoff_sec, late_start, early_cutoff, span_sec FROM cont")
def start_end_delay(spark, sf):
    w = W.window_continuity(ticks(spark, sf), GATES.max_gap, GATES.max_delay)
    return w.select("cid", "start_delay_sec", "end_cutoff_sec", "late_start", "early_cutoff", "span_sec")


@query("window_gates", CONT_SQL + "SELECT cid, tick_count, min_snaps, gaps_count, max_gap_sec, time_reversals, error_ticks, bounds_violations, array_to_string(failing, ',') AS failing_gates, len(failing)=0 AS passed FROM gates")
def window_gates(spark, sf):
    w = Q.window_gates(ticks(spark, sf), GATES)
    return w.select("cid", "tick_count", "min_snaps", "gaps_count", "max_gap_sec", "time_reversals", "error_ticks", "bounds_violations", F.concat_ws(",", "failing_gates").alias("failing_gates"), "passed")


# A looser policy under which a fair share of windows passes.
LOOSE = Q.Gates(max_gap=9000.0, max_delay=7200.0, max_snap_interval=7200.0)
LOOSE_SQL = CONT_SQL.replace("5400", "9000").replace(">1500", ">7200").replace("2400.0e0", "7200.0e0")
LOOSE_OK = "len(list_filter(failing, lambda z: z NOT IN ('collector_error','time_reversal','bounds_violation')))=0"


def loose_passed(spark, sf):
    w = Q.window_gates(ticks(spark, sf), LOOSE)
    tolerated = F.array(F.lit("collector_error"), F.lit("time_reversal"), F.lit("bounds_violation"))
    return w.filter(F.size(F.array_except("failing_gates", tolerated)) == 0)


@query("pair_pristine_counts", LOOSE_SQL + f"SELECT series, duration, count(*) AS windows FROM gates WHERE {LOOSE_OK} GROUP BY 1,2")
def pair_pristine_counts(spark, sf):
    return loose_passed(spark, sf).groupBy("series", "duration").agg(F.count(F.lit(1)).alias("windows"))


@query("keep_passed_windows", LOOSE_SQL + f"SELECT cid, count(*) AS ticks FROM ticks WHERE cid IN (SELECT cid FROM gates WHERE {LOOSE_OK}) GROUP BY 1")
def keep_passed_windows(spark, sf):
    kept = ticks(spark, sf).join(loose_passed(spark, sf).select("cid"), "cid", "left_semi")
    return kept.groupBy("cid").agg(F.count(F.lit(1)).alias("ticks"))


def missing_dim(spark, sf):
    """Expected (series, duration) pairs, named and not derived from what was found; one series was never recorded."""
    return spark.createDataFrame([(s, d) for s in EXPECTED for d in (43200, 86400)], "series string, duration int")


EXPECTED = ("click", "error", "purchase", "refund", "signup", "view")
_MISSING = "SELECT s.series, d.duration FROM (VALUES " + ", ".join(f"('{s}')" for s in EXPECTED) + ") s(series), (VALUES (43200),(86400)) d(duration)"


@query("missing_pairs", T + f" SELECT * FROM ({_MISSING}) EXCEPT SELECT DISTINCT series, duration FROM ticks")
def missing_pairs(spark, sf):
    found = ticks(spark, sf).select("series", "duration").distinct()
    return missing_dim(spark, sf).join(found, ["series", "duration"], "left_anti")


@query("expected_minus_found", T + f" SELECT * FROM ({_MISSING}) EXCEPT SELECT DISTINCT series, duration FROM ticks")
def expected_minus_found(spark, sf):
    return missing_dim(spark, sf).subtract(ticks(spark, sf).select("series", "duration"))


@query(
    "coverage_report",
    T + f""" SELECT e.series, e.duration, coalesce(n,0) AS windows, CASE WHEN n IS NULL THEN 'missing' ELSE 'found' END AS state FROM ({_MISSING}) e
    LEFT JOIN (SELECT series, duration, count(DISTINCT cid) AS n FROM ticks GROUP BY 1,2) f USING (series, duration)""",
)
def coverage_report(spark, sf):
    found = ticks(spark, sf).select("series", "duration", "cid").distinct().groupBy("series", "duration").agg(F.count(F.lit(1)).alias("n"))
    j = missing_dim(spark, sf).join(found, ["series", "duration"], "left")
    return j.select("series", "duration", F.coalesce("n", F.lit(0)).alias("windows"), F.when(c("n").isNull(), "missing").otherwise("found").alias("state"))


@query("market_breakdown", T + f" SELECT series, duration, count(DISTINCT cid) AS windows, CAST(sum(len(tape)) AS BIGINT) AS trades, {R('sum(len(tape))/count(DISTINCT cid)', 1)} AS trades_per_window FROM ticks GROUP BY 1,2")
def market_breakdown(spark, sf):
    return Q.market_breakdown(ticks(spark, sf))


@query(
    "capture_stats",
    T + f""" SELECT series, count(*) AS lines, CAST(sum(len(tape)) AS BIGINT) AS prints, count(*) FILTER (WHERE len(tape)=0) AS empty_samples, count(*) FILTER (WHERE len(tape)>0) AS nonempty_samples,
    {R('count(*) FILTER (WHERE len(tape)=0)/count(*)', 4)} AS empty_rate FROM ticks GROUP BY 1""",
)
def capture_stats(spark, sf):
    empty = F.size("tape") == 0
    return ticks(spark, sf).groupBy("series").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.size("tape")).alias("prints"), F.count_if(empty).alias("empty_samples"), F.count_if(~empty).alias("nonempty_samples"),
        round_dp(F.count_if(empty) / F.count(F.lit(1)), 4).alias("empty_rate"),
    )


_METRICS = CONT_SQL + f""", iss AS (SELECT count(*) AS n, sum((CASE WHEN mid<-0.01 OR mid>1.01 THEN 1 ELSE 0 END)+(CASE WHEN touch_pair<0.5 OR touch_pair>1.5 THEN 1 ELSE 0 END)+(CASE WHEN up_bid>=up_ask THEN 1 ELSE 0 END)
  +(CASE WHEN dn_bid>=dn_ask THEN 1 ELSE 0 END)+len(list_filter(tape, lambda z: z.size<=0))) AS se, count(*) FILTER (WHERE err IS NOT NULL) AS ce, sum(len(tape)) AS te FROM ticks),
mk AS (SELECT series, duration, count(DISTINCT cid) AS w FROM ticks GROUP BY 1,2),
met AS (SELECT (SELECT CAST(n AS DOUBLE) FROM iss) AS valid_ticks, (SELECT CAST(count(*) AS DOUBLE) FROM cont) AS independent_windows, (SELECT CAST(te AS DOUBLE) FROM iss) AS tape_entries,
  (SELECT CAST(count(*) AS DOUBLE) FROM mk) AS market_duration_coverage, (SELECT CAST(min(w) AS DOUBLE) FROM mk) AS minimum_windows_per_market,
  (SELECT CAST(count(DISTINCT {day_of('first_ts')}) AS DOUBLE) FROM cont) AS time_blocks, (SELECT {R('count(*) FILTER (WHERE event_id%179=0 AND event_id%173<>0)/count(*) FILTER (WHERE event_id%173<>0)', 6)} FROM ticks) AS corrupt_rate, (SELECT {R('se/n', 6)} FROM iss) AS schema_error_rate,
  (SELECT {R('sum(gaps_count)/count(*)', 6)} FROM cont) AS sampling_gap_rate, (SELECT {R('ce/n', 6)} FROM iss) AS collector_error_rate)
"""
_POL = ", ".join(f"('{n}','{d}',{e!r}e0,{r!r}e0)" for n, d, e, r in Q.POLICIES)
_CHECKS = (
    _METRICS + ", long AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {n} AS measured FROM met" for n, *_ in Q.POLICIES)
    + f"), pol(name, direction, er, rr) AS (VALUES {_POL}), chk AS (SELECT name, direction, measured, er AS exploratory_required, rr AS research_required, CASE direction WHEN 'min' THEN measured>=er ELSE measured<=er END AS exploratory_ok, "
    + "CASE direction WHEN 'min' THEN measured>=rr ELSE measured<=rr END AS research_ok FROM long JOIN pol USING (name))"
)


def _metrics(spark, sf):
    t = ticks(spark, sf)
    one = F.lit(1).alias("k")
    counters = Q.tick_counters(t, []).withColumn("k", F.lit(1))
    w = W.window_continuity(t, GATES.max_gap, GATES.max_delay)
    wm = w.agg(F.count(F.lit(1)).alias("independent_windows"), F.sum("gaps_count").alias("gaps"), F.count_distinct(X.day_key(c("first_ts"))).alias("time_blocks")).withColumn("k", F.lit(1))
    mk = Q.market_breakdown(t).agg(F.count(F.lit(1)).alias("market_duration_coverage"), F.min("windows").alias("minimum_windows_per_market")).withColumn("k", F.lit(1))
    from .bronze import parsed_lines

    states = parsed_lines(spark, sf).agg(F.count_if(c("state") == "corrupt").alias("corrupt"), F.count_if(c("state") != "empty").alias("written")).withColumn("k", F.lit(1))
    m = counters.join(wm, "k").join(mk, "k").join(states, "k")
    n = c("valid_ticks")
    return m.withColumns(
        {
            "corrupt_rate": round_dp(F.try_divide("corrupt", "written"), 6),
            "schema_error_rate": round_dp(c("schema_errors") / n, 6),
            "sampling_gap_rate": round_dp(c("gaps") / c("independent_windows"), 6),
            "collector_error_rate": round_dp(c("collector_errors") / n, 6),
        }
    )


@query("readiness", _CHECKS + " SELECT * FROM chk")
def readiness(spark, sf):
    return Q.readiness(_metrics(spark, sf))


@query(
    "readiness_level",
    _CHECKS + f", mm AS (SELECT count(*) AS missing_markets FROM (SELECT * FROM ({_MISSING}) EXCEPT SELECT DISTINCT series, duration FROM ticks)) "
    "SELECT CASE WHEN (SELECT bool_and(research_ok) FROM chk) AND missing_markets=0 THEN 'RESEARCH_READY' WHEN (SELECT bool_and(exploratory_ok) FROM chk) THEN 'EXPLORATORY' ELSE 'INSUFFICIENT' END AS level, missing_markets FROM mm",
)
def readiness_level(spark, sf):
    return Q.readiness_level(Q.readiness(_metrics(spark, sf)), missing_pairs(spark, sf))


_SET = _METRICS + """, pw AS (SELECT e.series, e.duration, coalesce(w,0) AS windows FROM (MISSQ) e LEFT JOIN mk USING (series, duration)),
  tot AS (SELECT independent_windows, time_blocks, valid_ticks, sampling_gap_rate FROM met)
  SELECT name, measured, required, CASE WHEN name='sampling_gap_rate' THEN measured<=required ELSE measured>=required END AS ok FROM (
  SELECT 'windows_count' AS name, independent_windows AS measured, 500.0e0 AS required FROM tot UNION ALL SELECT 'windows_per_market_pair', (SELECT CAST(min(windows) AS DOUBLE) FROM pw), 50.0e0
  UNION ALL SELECT 'time_blocks', time_blocks, 5.0e0 FROM tot UNION ALL SELECT 'valid_ticks', valid_ticks, 50000.0e0 FROM tot UNION ALL SELECT 'sampling_gap_rate', sampling_gap_rate, 0.05e0 FROM tot
  UNION ALL SELECT 'all_series_present', (SELECT CAST(count(*) FILTER (WHERE windows>0) AS DOUBLE) FROM pw), (SELECT CAST(count(*) AS DOUBLE) FROM pw))""".replace("MISSQ", _MISSING)


@query("set_gates", _SET)
def set_gates(spark, sf):
    m = _metrics(spark, sf).select(c("independent_windows").alias("windows_count"), "time_blocks", "valid_ticks", "sampling_gap_rate")
    return Q.set_gates(m, Q.market_breakdown(ticks(spark, sf)).select("series", "duration", "windows"), missing_dim(spark, sf))


@query("dataset_cells", WINDOWS_SQL + f"SELECT series, duration, {day_of('start_ts')} AS day, class, count(*) AS windows FROM windows GROUP BY 1,2,3,4")
def dataset_cells(spark, sf):
    w = W.finalize(ticks(spark, sf))
    return w.groupBy("series", "duration", X.day_key(c("start_ts")).alias("day"), "class").agg(F.count(F.lit(1)).alias("windows"))


@query("stable_window_rank", WINDOWS_SQL + "SELECT cid, row_number() OVER (ORDER BY first_ts, first_seq) AS rank FROM windows")
def stable_window_rank(spark, sf):
    """Global chronological rank; day slices are ranked in parallel and offset by earlier days."""
    w = ticks(spark, sf).groupBy("cid").agg(F.min("ts").alias("first_ts"), F.min("line_no").alias("first_seq"))
    from ..operators.scan import global_rank

    return global_rank(w, ["first_ts", "first_seq"], F.floor(c("first_ts") / 86400), "rank").select("cid", "rank")


@query(
    "sampling_interval",
    T + f""", r AS (SELECT DISTINCT ts_us//1000000 AS round_s FROM ticks), l AS (SELECT round_s, round_s-lag(round_s) OVER (ORDER BY round_s) AS gap FROM r)
    SELECT count(*) AS rounds, min(gap) AS min_gap, max(gap) AS max_gap, {R('avg(gap)', 4)} AS mean_gap FROM l""",
)
def sampling_interval(spark, sf):
    """Gap between consecutive sampling rounds (one round per whole second)."""
    r = ticks(spark, sf).select(F.expr("ts_us div 1000000").alias("round_s")).distinct().withColumn("k", F.lit(1))
    g = running(r, ["k"], ["round_s"], F.floor(c("round_s") / 3600), [Running("prev", "prev", c("round_s"))]).withColumn("gap", c("round_s") - c("prev"))
    return g.agg(F.count(F.lit(1)).alias("rounds"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), round_dp(F.avg("gap"), 4).alias("mean_gap"))


@query(
    "opportunity_span",
    T + f""", t1 AS (SELECT *, up_ask+dn_ask < 1.0115e0 AS cheap FROM ticks), t2 AS (SELECT *, lag(coalesce(cheap,false),1,false) OVER w AS was, lead(coalesce(cheap,false)) OVER w AS nxt FROM t1 WINDOW w AS (PARTITION BY cid ORDER BY ts_us, line_no)),
    t3 AS (SELECT *, sum(CASE WHEN coalesce(cheap,false) AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY cid ORDER BY ts_us, line_no ROWS UNBOUNDED PRECEDING) AS island FROM t2 ),
    s AS (SELECT series, cid, island, count(*) AS ticks FROM t3 WHERE cheap GROUP BY 1,2,3)
    SELECT series, count(*) AS runs, CAST(sum(ticks) AS BIGINT) AS ticks, max(ticks) AS longest, {R('count(*) FILTER (WHERE ticks=1)/count(*)', 4)} AS gone_next FROM s GROUP BY 1""",
)
def opportunity_span(spark, sf):
    """Runs of consecutive ticks whose touch pair is cheap, and the share gone by the next snapshot."""
    t = ticks(spark, sf).select("series", "cid", "ts_us", "line_no", "el_ms", F.coalesce(c("up_ask") + c("dn_ask") < 1.0115, F.lit(False)).alias("cheap"))
    t = running(t, ["cid"], ["ts_us", "line_no"], W.tick_slice(), [Running("was", "prev", c("cheap"))])
    t = Q.segments(t, ["cid"], c("cheap") & ~F.coalesce(c("was"), F.lit(False)))
    s = t.filter("cheap").groupBy("series", "cid", "island").agg(F.count(F.lit(1)).alias("ticks"))
    return s.groupBy("series").agg(F.count(F.lit(1)).alias("runs"), F.sum("ticks").alias("ticks"), F.max("ticks").alias("longest"), round_dp(F.count_if(c("ticks") == 1) / F.count(F.lit(1)), 4).alias("gone_next"))


@query(
    "rising_edge",
    T + """, t1 AS (SELECT *, lag(coalesce(mid>0.55e0,false),1,false) OVER (PARTITION BY cid ORDER BY ts_us, line_no) AS was FROM ticks)
    SELECT cid, count(*) AS edges FROM t1 WHERE mid>0.55e0 AND NOT was GROUP BY 1""",
)
def rising_edge(spark, sf):
    """First tick on which the condition turns true, re-armed when it turns false."""
    t = ticks(spark, sf).select("cid", "ts_us", "line_no", "el_ms", F.coalesce(c("mid") > 0.55, F.lit(False)).alias("hot"))
    t = running(t, ["cid"], ["ts_us", "line_no"], W.tick_slice(), [Running("was", "prev", c("hot"))])
    return t.filter(c("hot") & ~F.coalesce(c("was"), F.lit(False))).groupBy("cid").agg(F.count(F.lit(1)).alias("edges"))


@query(
    "change_only",
    T + """, t0 AS (SELECT event_id, line_no, up_token AS token, up_bid AS bid, up_ask AS ask FROM ticks UNION ALL SELECT event_id, line_no, dn_token, dn_bid, dn_ask FROM ticks),
    t1 AS (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, row_number() OVER w AS rn FROM t0 WINDOW w AS (PARTITION BY token ORDER BY line_no))
    SELECT event_id, token, bid, ask FROM t1 WHERE rn=1 OR bid IS DISTINCT FROM pb OR ask IS DISTINCT FROM pa""",
)
def change_only(spark, sf):
    """Keep a row of either leg only if the token's top of book changed since its previous row."""
    t = FD.legs(ticks(spark, sf), "event_id", "line_no").select("event_id", "token", "line_no", c("bb").alias("bid"), c("ba").alias("ask"), F.struct("bb", "ba").alias("top"))
    t = running(t, ["token"], ["line_no"], W.arrival_slice(), [Running("before", "prev", c("top"))])
    return t.filter(~c("top").eqNullSafe(c("before"))).select("event_id", "token", "bid", "ask")


@query(
    "rolling_drift",
    T + f""", p AS (SELECT event_id, series, ts_us, value0 FROM (SELECT event_id, series, ts_us, 100+event_id%37*0.25e0 AS value0 FROM ticks)),
    r AS (SELECT event_id, value0, first_value(value0) OVER (PARTITION BY series ORDER BY ts_us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS base FROM p)
    SELECT event_id, {R('(value0-base)/base', 8)} AS drift FROM r""",
)
def rolling_drift(spark, sf):
    """Relative move against the oldest price of a trailing range; slices carry a halo one range long."""
    reach = 1_800_000_000
    p = ticks(spark, sf).select("event_id", "series", "ts_us", (100 + c("event_id") % 37 * 0.25).alias("price"))
    h = with_halo(p, c("ts_us"), 3_600_000_000, reach)
    w = Window.partitionBy("series", "__slice").orderBy("ts_us").rangeBetween(-reach, 0)
    out = h.withColumn("base", F.first("price").over(w)).filter(~c("__halo"))
    return out.select("event_id", round_dp(B.spot_drift(c("price"), c("base")), 8).alias("drift"))


@query(
    "rolling_silence",
    T + f""", r AS (SELECT event_id, series, ts_us, count(*) OVER w AS n, sum(CASE WHEN len(tape)=0 THEN 1 ELSE 0 END) OVER w AS e, min(ts_us) OVER w AS f FROM ticks
      WINDOW w AS (PARTITION BY series ORDER BY ts_us RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW))
    SELECT event_id, {R('e/n', 4)} AS empty_rate, ts_us-f >= 6000000000 AND e/n > 0.5e0 AS alert FROM r""",
)
def rolling_silence(spark, sf):
    """Share of empty-tape samples in a trailing range, with an alert once the range is long enough: once a sample lies far enough back."""
    reach, long = 7_200_000_000, 6_000_000_000
    t = ticks(spark, sf).select("event_id", "series", "ts_us", (F.size("tape") == 0).cast("int").alias("e"))
    one = F.lit(1)
    h = trailing(t, ["series"], "ts_us", 3_600_000_000, {"n": (one, reach, 0), "k": (c("e"), reach, 0), "old": (one, reach, long)})
    rate = c("k") / c("n")
    return h.select("event_id", round_dp(rate, 4).alias("empty_rate"), (F.when(c("ts_us").isNotNull(), c("old") > 0) & (rate > 0.5)).alias("alert"))


@query(
    "preceding_events",
    T + """, r AS (SELECT event_id, list(event_id) OVER (PARTITION BY series ORDER BY line_no ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS ids FROM ticks)
    SELECT event_id, coalesce(array_to_string(ids, ','),'') AS before FROM r""",
)
def preceding_events(spark, sf):
    """The 15 frames before each frame. A slice starts from the tail of up to 15 earlier slices."""
    n = 15
    t = ticks(spark, sf).select("event_id", "series", "line_no").withColumn("__slice", F.floor(c("line_no") / 20_000).cast("bigint"))
    w = Window.partitionBy("series", "__slice").orderBy("line_no")
    local = t.withColumn("own", F.collect_list("event_id").over(w.rowsBetween(-n, -1)))
    tail = t.withColumn("r", F.row_number().over(Window.partitionBy("series", "__slice").orderBy(c("line_no").desc()))).filter(c("r") <= n)
    tails = tail.groupBy("series", "__slice").agg(F.sort_array(F.collect_list(F.struct("line_no", "event_id"))).alias("t"))
    prev = Window.partitionBy("series").orderBy("__slice").rowsBetween(-n, -1)
    carry = tails.select("series", "__slice", F.slice(F.concat(F.array_repeat(F.lit(None).cast("bigint"), n), F.transform(F.flatten(F.collect_list("t").over(prev)), lambda x: x["event_id"])), -n, n).alias("lead"))
    j = local.join(carry, ["series", "__slice"])
    both = F.filter(F.slice(F.concat("lead", "own"), -n, n), lambda x: x.isNotNull())
    return j.select("event_id", F.array_join(F.transform(both, lambda x: x.cast("string")), ",").alias("before"))


@query(
    "scope_exclusions",
    CONT_SQL + f""", ex AS (SELECT cid, CASE WHEN start_ts < 1704240000 THEN 'pre_coverage' WHEN first_ts-start_ts > 1500 AND first_ts <> start_ts THEN 'strict_late' WHEN bounds_violations>0 THEN 'touch_insane' ELSE 'kept' END AS reason FROM cont)
    SELECT reason, count(*) AS windows FROM ex GROUP BY 1""",
)
def scope_exclusions(spark, sf):
    """Windows kept for a comparison; the others counted by their first reason."""
    t = ticks(spark, sf)
    from ..functions.quality import bounds_violation

    w = t.groupBy("cid").agg(
        F.min("start_ts").alias("start_ts"), F.min_by("ts", "line_no").alias("first_ts"), F.bool_or(bounds_violation(c("mid"), c("touch_pair"))).alias("insane")
    )
    reason = (
        F.when(c("start_ts") < 1704240000, "pre_coverage").when((c("first_ts") - c("start_ts") > 1500) & (c("first_ts") != c("start_ts")), "strict_late").when(c("insane"), "touch_insane").otherwise("kept")
    )
    return w.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("windows"))


@query(
    "sample_limit",
    T + """, i AS (SELECT line_no, 'mid.range' AS issue FROM ticks WHERE mid<-0.01 OR mid>1.01 UNION ALL SELECT line_no, 'touch_pair.range' FROM ticks WHERE touch_pair<0.5 OR touch_pair>1.5
      UNION ALL SELECT line_no, 'up.crossed' FROM ticks WHERE up_bid>=up_ask UNION ALL SELECT line_no, 'down.crossed' FROM ticks WHERE dn_bid>=dn_ask)
    SELECT * FROM i ORDER BY line_no, issue LIMIT 20""",
)
def sample_limit(spark, sf):
    t = ticks(spark, sf).select("line_no", F.explode(tick_issues(silver_required())).alias("issue"))
    return Q.first_issues(t, F.struct("line_no", "issue"))


@query("interval_percentiles", GAP_SQL + f"SELECT series, count(gap) AS n, {R('min(gap)', 3)} AS min_gap, {R('quantile_cont(round(gap*1000), 0.5)/1000', 4)} AS p50, {R('quantile_cont(round(gap*1000), 0.95)/1000', 4)} AS p95, {R('quantile_cont(round(gap*1000), 0.99)/1000', 4)} AS p99, {R('max(gap)', 3)} AS max_gap, {R('avg(gap)', 4)} AS mean_gap FROM g WHERE gap IS NOT NULL GROUP BY GROUPING SETS ((series),())")
def interval_percentiles(spark, sf):
    """Inter-tick gaps per market and overall; exact interpolated percentiles on whole milliseconds."""
    g = W.gaps_and_reversals(ticks(spark, sf).select("series", "cid", "ts_us", "line_no"), ["cid"]).filter(c("gap_sec").isNotNull())
    g = RK.levels(g.select("series", "gap_sec"), "series").withColumn("ms", F.floor(c("gap_sec") * 1000 + 0.5))
    q = RK.quantiles(g, ["series"], "ms", {f"p{k}": ("linear", k / 100) for k in (50, 95, 99)})
    m = g.groupBy("series").agg(round_dp(F.min("gap_sec"), 3).alias("min_gap"), round_dp(F.max("gap_sec"), 3).alias("max_gap"), round_dp(F.avg("gap_sec"), 4).alias("mean_gap"))
    told = [round_dp(c(k) / 1000, 4).alias(k) for k in ("p50", "p95", "p99")]
    return q.join(m, "series").select(F.nullif("series", F.lit("overall")).alias("series"), "n", "min_gap", *told, "max_gap", "mean_gap")

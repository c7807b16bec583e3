"""Tick-level projections and per-window summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import text as X
from ..functions.num import as_price, milli, round_dp
from ..functions.quality import bounds_violation, silver_required, tick_issues
from ..operators import windows as W
from ..sources.derived import ladder_sql, ticks
from .registry import query
from .sqltext import R, T, TSM, classify, clamp, day_of, dec, mid, queue, resting_dn, resting_up

c = F.col
OFF = 0.02

_UP_BIDS = ladder_sql("up_bid_m", -5, 1, 50)
_DN_BIDS = ladder_sql("dn_bid_m", -5, 2, 45)
_UP_ASKS = ladder_sql("up_ask_m", 5, 3, 40)
_DN_ASKS = ladder_sql("dn_ask_m", 5, 4, 35)
_REM = "greatest(0.0e0, end_ts-ts)"
_MID_UP = mid("up_bid", "up_ask")


@query(
    "tick_features",
    T
    + f""", f AS (SELECT *, {_MID_UP} AS mu, {TSM} AS tsm FROM ticks),
    g AS (SELECT *, {resting_up('tsm', OFF)} AS ru, {resting_dn('tsm', OFF)} AS rd FROM f)
    SELECT event_id, mu AS mid_up, {mid('dn_bid', 'dn_ask')} AS mid_dn, tsm AS two_sided_mid,
      {R("(coalesce((up_bid+up_ask)/2.0e0, up_bid, up_ask, 0.5e0) + (1.0e0-coalesce((dn_bid+dn_ask)/2.0e0, dn_bid, dn_ask, 0.5e0)))/2.0e0", 4)} AS mid_default,
      coalesce(touch_pair, {R('up_ask+dn_ask', 4)}) AS touch_pair,
      ru AS resting_up, rd AS resting_dn, {R('ru+rd', 4)} AS resting_pair,
      {queue(_UP_BIDS, 'ru')} AS queue_up, {queue(_DN_BIDS, 'rd')} AS queue_dn,
      CASE WHEN up_bid>0 AND up_bid<=1 THEN up_bid END AS exec_bid,
      {R(clamp('mu', '0.0001e0', '0.9999e0'), 4)} AS mark,
      CASE WHEN end_ts>start_ts THEN end_ts-start_ts END AS window_length,
      greatest(0.0e0, ts-start_ts) AS elapsed, {_REM} AS remaining,
      {_REM} <= {R('0.1e0*(end_ts-start_ts)', 6)}+1e-6 AS in_dead_zone,
      end_ts-{R('0.1e0*(end_ts-start_ts)', 6)} AS dead_zone_start,
      {R('0.25e0*(end_ts-start_ts)', 6)} AS quarter_sec,
      {day_of('ts')} AS day_key, upper(split_part(slug,'-up-or-down-',1)) AS symbol,
      regexp_replace(cid, '[^A-Za-z0-9_\\-]', '_', 'g') AS safe_cid,
      len(list_filter({_UP_BIDS}, lambda q: q.price >= 0.05)) AS depth_levels,
      CASE WHEN touch_pair IS NOT NULL THEN {R('mid-mu', 4)} END AS mid_diff
    FROM g""",
)
def tick_features(spark, sf):
    """Every quote-level feature in one scan-and-project stage."""
    t = ticks(spark, sf)
    quotes = [c(x) for x in ("up_bid", "up_ask", "dn_bid", "dn_ask")]
    t = t.withColumns({"mid_up": B.mid(*quotes[:2]), "two_sided_mid": B.two_sided_mid(*quotes)})
    t = t.withColumns({"resting_up": B.resting_up(c("two_sided_mid"), OFF), "resting_dn": B.resting_down(c("two_sided_mid"), OFF)})
    length = B.window_clock(c("start_ts"), c("end_ts"))["length"]
    rem = B.remaining(c("ts"), c("end_ts"))
    return t.select(
        "event_id",
        "mid_up",
        B.mid(c("dn_bid"), c("dn_ask")).alias("mid_dn"),
        "two_sided_mid",
        B.two_sided_mid_default(*quotes).alias("mid_default"),
        B.touch_pair(c("touch_pair"), c("up_ask"), c("dn_ask")).alias("touch_pair"),
        "resting_up",
        "resting_dn",
        B.pair_cost(c("resting_up"), c("resting_dn")).alias("resting_pair"),
        B.queue_ahead(c("up_bids"), c("resting_up")).alias("queue_up"),
        B.queue_ahead(c("dn_bids"), c("resting_dn")).alias("queue_dn"),
        B.exec_quote(as_price(c("up_bid"))).alias("exec_bid"),
        B.clamp_mark(c("mid_up")).alias("mark"),
        length.alias("window_length"),
        B.elapsed(c("ts"), c("start_ts")).alias("elapsed"),
        rem.alias("remaining"),
        B.in_dead_zone(rem, length, 0.1).alias("in_dead_zone"),
        B.dead_zone_start(c("start_ts"), c("end_ts"), 0.1).alias("dead_zone_start"),
        B.window_fraction_seconds(length, 0.25).alias("quarter_sec"),
        X.day_key(c("ts")).alias("day_key"),
        X.token_symbol(c("slug")).alias("symbol"),
        X.safe_slug(c("cid")).alias("safe_cid"),
        F.size(B.compact_depth(c("up_bids"))).alias("depth_levels"),
        F.when(c("touch_pair").isNotNull(), round_dp(c("mid") - c("mid_up"), 4)).alias("mid_diff"),
    )


@query(
    "selection_filter",
    T
    + """ SELECT series, duration, count(*) AS ticks FROM ticks
    WHERE (contains(lower(series||' '||slug),'click') OR contains(lower(series||' '||slug),'up-or-down-24h')) AND duration IN (43200,86400)
      AND ts BETWEEN 1704499200 AND 1705708800 GROUP BY 1,2""",
)
def selection_filter(spark, sf):
    t = ticks(spark, sf)
    tokens, durations = X.validate_selection(
        ["CLICK", "up-or-down-24h"], ["43200", 86400], ["click-up-or-down-12h", "error-up-or-down-24h"], [43200, 86400]
    )
    keep = X.selection_filter(c("series"), c("slug"), c("duration"), tokens, durations)
    return t.filter(keep & c("ts").between(1704499200, 1705708800)).groupBy("series", "duration").agg(F.count(F.lit(1)).alias("ticks"))


@query(
    "start_delay_filter",
    T
    + """, w AS (SELECT cid, min(ts)-min(start_ts) AS delay FROM ticks GROUP BY 1)
    SELECT t.series, count(*) AS ticks, count(DISTINCT t.cid) AS windows FROM ticks t
    WHERE t.cid IN (SELECT cid FROM w WHERE delay <= 900) GROUP BY 1""",
)
def start_delay_filter(spark, sf):
    t = ticks(spark, sf)
    ok = t.groupBy("cid").agg((F.min("ts") - F.min("start_ts")).alias("delay")).filter(c("delay") <= 900)
    per_cid = t.groupBy("series", "cid").agg(F.count(F.lit(1)).alias("n")).join(ok, "cid", "left_semi")
    return per_cid.groupBy("series").agg(F.sum("n").alias("ticks"), F.count(F.lit(1)).alias("windows"))


@query(
    "depth_top_projection",
    T + f" SELECT event_id, up_bid, up_ask, dn_bid, dn_ask, {_MID_UP} AS mid, {R('up_ask+dn_ask', 4)} AS touch, {queue(_UP_BIDS, 'up_bid')} AS queue_up FROM ticks",
)
def depth_top_projection(spark, sf):
    return ticks(spark, sf).select(
        "event_id", "up_bid", "up_ask", "dn_bid", "dn_ask",
        B.mid(c("up_bid"), c("up_ask")).alias("mid"),
        B.pair_cost(c("up_ask"), c("dn_ask")).alias("touch"),
        B.queue_ahead(c("up_bids"), c("up_bid")).alias("queue_up"),
    )


_ISSUES = f"""
  (CASE WHEN mid < -0.01 OR mid > 1.01 THEN 1 ELSE 0 END) AS mid_bad,
  (CASE WHEN touch_pair < 0.5 OR touch_pair > 1.5 THEN 1 ELSE 0 END) AS touch_bad,
  (CASE WHEN up_bid >= up_ask THEN 1 ELSE 0 END) + (CASE WHEN dn_bid >= dn_ask THEN 1 ELSE 0 END) AS crossed,
  len(list_filter(tape, lambda x: x.size <= 0)) AS tape_bad"""


@query(
    "tick_quality",
    T
    + f""", q AS (SELECT *, {_ISSUES} FROM ticks)
    SELECT cid, CAST(sum(mid_bad+touch_bad+crossed+tape_bad) AS BIGINT) AS issues, CAST(sum(crossed) AS BIGINT) AS crossed,
      CAST(sum(CASE WHEN mid_bad+touch_bad>0 THEN 1 ELSE 0 END) AS BIGINT) AS bounds_violations,
      CAST(sum(CASE WHEN mid_bad+touch_bad+crossed+tape_bad>0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_ticks FROM q GROUP BY 1""",
)
def tick_quality(spark, sf):
    t = ticks(spark, sf).withColumn("issues", tick_issues(silver_required()))
    return t.groupBy("cid").agg(
        F.sum(F.size("issues")).alias("issues"),
        F.sum(F.size(F.filter("issues", lambda x: x.endswith(".crossed")))).alias("crossed"),
        F.count_if(bounds_violation(c("mid"), c("touch_pair"))).alias("bounds_violations"),
        F.count_if(F.size("issues") > 0).alias("bad_ticks"),
    )


@query(
    "issue_counts",
    T
    + f""", q AS (SELECT *, {_ISSUES} FROM ticks)
    SELECT * FROM (
      SELECT 'mid.range' AS issue, CAST(sum(mid_bad) AS BIGINT) AS n FROM q UNION ALL
      SELECT 'touch_pair.range', CAST(sum(touch_bad) AS BIGINT) FROM q UNION ALL
      SELECT 'up.crossed', CAST(sum(CASE WHEN up_bid>=up_ask THEN 1 ELSE 0 END) AS BIGINT) FROM q UNION ALL
      SELECT 'down.crossed', CAST(sum(CASE WHEN dn_bid>=dn_ask THEN 1 ELSE 0 END) AS BIGINT) FROM q UNION ALL
      SELECT 'tape.size', CAST(sum(tape_bad) AS BIGINT) FROM q) WHERE n > 0""",
)
def issue_counts(spark, sf):
    t = ticks(spark, sf).select(F.explode(tick_issues(silver_required())).alias("issue"))
    return t.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


_FIN = f"""
, m AS (SELECT cid, min(ts) AS first_ts, min(line_no) AS first_seq, any_value(series) AS series, any_value(label) AS label,
   any_value(duration) AS duration, any_value(slug) AS slug, any_value(start_ts) AS start_ts, any_value(end_ts) AS end_ts,
   max(ts) AS closed_ts, count(*) AS snaps, arg_min(MIDX, line_no) FILTER (WHERE MIDX IS NOT NULL) AS f,
   arg_max(MIDX, line_no) FILTER (WHERE MIDX IS NOT NULL) AS l, min(MIDX) AS mn, max(MIDX) AS mx,
   list_sort(list(touch_pair) FILTER (WHERE touch_pair IS NOT NULL)) AS tp FROM ticks GROUP BY cid),
windows AS (SELECT cid, series, label, duration, slug, start_ts, end_ts, closed_ts, snaps, first_ts, first_seq,
   {R('f', 4)} AS start_mid, {R('l', 4)} AS close_mid, {R('mn', 4)} AS min_mid, {R('mx', 4)} AS max_mid,
   coalesce({R('mx-0.5e0', 4)},0.0e0) AS max_up, coalesce({R('0.5e0-mn', 4)},0.0e0) AS max_down,
   {classify('mx', 'mn')} AS class, {R('tp[len(tp)//2+1]', 4)} AS touch_pair_median FROM m)
"""


def windows_sql(mid_expr: str = "mid") -> str:
    return T + _FIN.replace("MIDX", f"({mid_expr})")


WINDOWS_SQL = windows_sql()


@query("window_finalize", WINDOWS_SQL + "SELECT * FROM windows")
def window_finalize(spark, sf):
    return W.finalize(ticks(spark, sf))


@query(
    "classify_path",
    windows_sql(TSM)
    + f", w2 AS (SELECT cid, {classify('max(mid)', 'min(mid)')} AS recorded_class FROM ticks GROUP BY 1), "
    + f"w3 AS (SELECT cid, {classify(f'max({_MID_UP})', f'min({_MID_UP})')} AS up_class FROM ticks GROUP BY 1) "
    + "SELECT cid, class AS two_sided_class, recorded_class, up_class FROM windows JOIN w2 USING (cid) JOIN w3 USING (cid)",
)
def classify_path(spark, sf):
    """The same windows judged on three mid sources, in one aggregation."""
    t = ticks(spark, sf)
    exprs = []
    for src in W.MID_SOURCES:
        m = W.mid_column(src)
        exprs += [F.max(m).alias(f"mx_{src}"), F.min(m).alias(f"mn_{src}")]
    agg = t.groupBy("cid").agg(*exprs)
    return agg.select(
        "cid",
        B.classify_path(c("mx_two_sided"), c("mn_two_sided")).alias("two_sided_class"),
        B.classify_path(c("mx_recorded"), c("mn_recorded")).alias("recorded_class"),
        B.classify_path(c("mx_up_book"), c("mn_up_book")).alias("up_class"),
    )


_SUMMARY = """, s AS (SELECT series, count(*) AS windows, count(*) FILTER (WHERE greatest(max_up,max_down) > 0.01995) AS any_2c,
  count(*) FILTER (WHERE greatest(max_up,max_down) > 0.02995) AS any_3c, count(*) FILTER (WHERE class='oscillating') AS oscillating,
  count(*) FILTER (WHERE class='monotonic') AS monotonic, count(*) FILTER (WHERE class='flat') AS flat,
  list_sort(list(touch_pair_median) FILTER (WHERE touch_pair_median IS NOT NULL)) AS p FROM windows GROUP BY 1)
"""


@query(
    "series_summary",
    WINDOWS_SQL + _SUMMARY + """ SELECT d.series, d.duration, coalesce(windows,0) AS windows, coalesce(any_2c,0) AS any_2c, coalesce(any_3c,0) AS any_3c,
  coalesce(oscillating,0) AS oscillating, coalesce(monotonic,0) AS monotonic, coalesce(flat,0) AS flat, p[len(p)//2+1] AS pair_cost_median
  FROM (SELECT DISTINCT series, duration FROM ticks UNION ALL SELECT 'refund', 300) d LEFT JOIN s USING (series)""",
)
def series_summary(spark, sf):
    """The dimension names a series that was never recorded: it shows as a row of zeros."""
    t = ticks(spark, sf)
    return W.series_summary(W.finalize(t), W.series_dim(t).unionByName(spark.createDataFrame([("refund", 300)], W.series_dim(t).schema)))


@query(
    "flagship_oscillation",
    WINDOWS_SQL + _SUMMARY + " SELECT series, windows, any_2c, any_3c, oscillating, monotonic, flat, p[len(p)//2+1] AS pair_cost_median FROM s",
)
def flagship_oscillation(spark, sf):
    t = ticks(spark, sf)
    return W.series_summary(W.finalize(t), W.series_dim(t)).drop("duration")


@query(
    "last_n_per_group",
    WINDOWS_SQL + " SELECT series, cid, end_ts, rank FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY end_ts DESC, cid) AS rank FROM windows) WHERE rank<=10",
)
def last_n_per_group(spark, sf):
    w = ticks(spark, sf).groupBy("cid").agg(F.min("series").alias("series"), F.min("end_ts").alias("end_ts"))
    return W.newest_per_series(w).select("series", "cid", "end_ts", "rank")


@query(
    "chronological",
    WINDOWS_SQL + " SELECT cid, start_ts, end_ts, snaps FROM windows ORDER BY end_ts, start_ts, cid",
)
def chronological(spark, sf):
    w = ticks(spark, sf).groupBy("cid").agg(F.min("start_ts").alias("start_ts"), F.min("end_ts").alias("end_ts"), F.count(F.lit(1)).alias("snaps"))
    return w.orderBy("end_ts", "start_ts", "cid")


@query(
    "group_windows",
    T + " SELECT cid, event_id, row_number() OVER (PARTITION BY cid ORDER BY ts_us, line_no) AS pos FROM ticks",
)
def group_windows(spark, sf):
    """Position of every tick inside its window, by (ts, arrival), without a per-window task."""
    from ..operators.scan import Running, running

    t = ticks(spark, sf).select("cid", "event_id", "ts_us", "line_no", "el_ms")
    out = running(t, ["cid"], ["ts_us", "line_no"], W.tick_slice(), [Running("pos", "count", F.lit(1))])
    return out.select("cid", "event_id", "pos")


@query("tick_day_stats", T + f" SELECT {day_of('ts')} AS day, count(*) AS ticks, count(DISTINCT cid) AS windows FROM ticks GROUP BY 1")
def tick_day_stats(spark, sf):
    per = ticks(spark, sf).groupBy(X.day_key(c("ts")).alias("day"), "cid").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("day").agg(F.sum("n").alias("ticks"), F.count(F.lit(1)).alias("windows"))


_EXC = """SELECT series, class, count(*) AS n, MED(max_mid-min_mid) AS range_median, MED(greatest(max_up,max_down)) AS excursion_median,
  P10 AS excursion_p10, P90 AS excursion_p90, AVGX AS excursion_mean, MED(abs(start_mid-0.5e0)) AS start_dev_median, MED(touch_pair_median) AS touch_median
  FROM windows GROUP BY GROUPING SETS ((series),(class),())"""


def _exc_sql():
    g = "greatest(max_up,max_down)"
    s = _EXC
    for inner in ("max_mid-min_mid", g, "abs(start_mid-0.5e0)", "touch_pair_median"):
        s = s.replace(f"MED({inner})", R(f"quantile_cont({inner}, 0.5)", 6))
    return s.replace("P10", R(f"quantile_cont({g}, 0.1)", 6)).replace("P90", R(f"quantile_cont({g}, 0.9)", 6)).replace("AVGX", R(f"avg({g})", 6))


@query("excursion_stats", WINDOWS_SQL + _exc_sql())
def excursion_stats(spark, sf):
    """Exact percentiles on value counts (grid-bounded state), by series, by class and overall."""
    w = W.finalize(ticks(spark, sf)).withColumns(
        {"rng": c("max_mid") - c("min_mid"), "exc": F.greatest("max_up", "max_down"), "dev": F.abs(c("start_mid") - 0.5)}
    )
    def p(col, q):
        return round_dp(F.percentile(col, q), 6)

    return w.groupingSets([["series"], ["class"], []], "series", "class").agg(
        F.count(F.lit(1)).alias("n"),
        p("rng", 0.5).alias("range_median"), p("exc", 0.5).alias("excursion_median"),
        p("exc", 0.1).alias("excursion_p10"), p("exc", 0.9).alias("excursion_p90"),
        round_dp(F.avg("exc"), 6).alias("excursion_mean"),
        p("dev", 0.5).alias("start_dev_median"), p("touch_pair_median", 0.5).alias("touch_median"),
    )


@query("distinct_days_series", T + f" SELECT 'day' AS kind, {day_of('ts')} AS value FROM ticks UNION SELECT 'series', series FROM ticks")
def distinct_days_series(spark, sf):
    t = ticks(spark, sf)
    # one scan: distinct pairs first (tiny), then split
    pairs = t.select(X.day_key(c("ts")).alias("day"), "series").distinct()
    kinds = F.array(F.struct(F.lit("day").alias("kind"), c("day").alias("value")), F.struct(F.lit("series").alias("kind"), c("series").alias("value")))
    return pairs.select(F.inline(kinds)).distinct()


@query("union_days", T + " SELECT cid, count(*) AS ticks, min(ts_us) AS first_us, max(ts_us) AS last_us FROM ticks GROUP BY 1")
def union_days(spark, sf):
    """Parity halves of the feed arrive as separate inputs; windows re-join by cid."""
    t = ticks(spark, sf).select("cid", "ts_us", "line_no")
    a, b = t.filter(c("line_no") % 2 == 0), t.filter(c("line_no") % 2 == 1)
    u = a.unionByName(b.withColumn("source", F.lit("b")), allowMissingColumns=True)
    return u.groupBy("cid").agg(F.count(F.lit(1)).alias("ticks"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query(
    "exit_threshold",
    T
    + """ SELECT series, duration, count(*) AS ticks, min(CASE WHEN series='purchase' THEN 0.04e0 WHEN contains(series,'ic') OR contains(slug,'ic') THEN 0.03e0
      WHEN contains(series,'v') OR contains(slug,'v') THEN 0.06e0 ELSE 0.07e0 END) AS threshold FROM ticks GROUP BY 1,2""",
)
def exit_threshold(spark, sf):
    table = [("ic", 0.03), ("v", 0.06), ("purchase", 0.04), ("default_15m", 0.07)]
    t = ticks(spark, sf).withColumn("threshold", B.exit_threshold(c("series"), c("slug"), c("duration"), table))
    return t.groupBy("series", "duration").agg(F.count(F.lit(1)).alias("ticks"), F.min("threshold").alias("threshold"))


@query(
    "print_side",
    T
    + """, p AS (SELECT up_ask, dn_ask, up_token, unnest(tape) AS pr FROM ticks)
    SELECT CASE WHEN pr.asset=up_token THEN 'up' ELSE 'down' END AS leg, CASE WHEN pr.price >= CASE WHEN pr.asset=up_token THEN up_ask ELSE dn_ask END-1e-9 THEN 'buy' ELSE 'sell' END AS side, count(*) AS prints, round(sum(pr.size),4) AS size FROM p GROUP BY 1,2""",
)
def print_side(spark, sf):
    p = ticks(spark, sf).select("up_bid", "up_ask", "dn_bid", "dn_ask", "up_token", F.inline("tape"))
    up = c("asset") == c("up_token")
    own = lambda q: F.when(up, c(f"up_{q}")).otherwise(c(f"dn_{q}"))
    side = B.print_side(c("price"), own("bid"), own("ask"))
    return p.groupBy(F.when(up, "up").otherwise("down").alias("leg"), side.alias("side")).agg(F.count(F.lit(1)).alias("prints"), F.round(F.sum("size"), 4).alias("size"))


@query(
    "fill_predicate",
    T
    + f""", f AS (SELECT *, {resting_up(TSM, OFF)} AS ru FROM ticks)
    SELECT cid, count(*) FILTER (WHERE hit) AS tape_hits, count(*) FILTER (WHERE thr) AS ask_through, count(*) FILTER (WHERE hit OR thr) AS fills,
      count(*) FILTER (WHERE hit OR marketable) AS placed_fills
    FROM (SELECT cid, coalesce(len(list_filter(tape, lambda x: x.asset=up_token AND abs(x.price-ru) <= 0.001e0+1e-6))>0 AND ru IS NOT NULL, false) AS hit,
      coalesce(up_ask <= ru-0.001e0+1e-6, false) AS thr, coalesce(up_ask <= ru+1e-6, false) AS marketable FROM f) GROUP BY 1""",
)
def fill_predicate(spark, sf):
    t = ticks(spark, sf).withColumn("ru", B.resting_up(W.mid_column("two_sided"), OFF))
    hit = B.tape_hit(c("tape"), c("up_token"), c("ru"), 0.001)
    thr = B.ask_through(c("up_ask"), c("ru"), 0.001, F.lit(False))
    placed = B.fill_predicate(c("ru"), c("up_ask"), c("tape"), c("up_token"), 0.001, F.lit(True))
    return t.groupBy("cid").agg(
        F.count_if(hit).alias("tape_hits"), F.count_if(thr).alias("ask_through"), F.count_if(hit | thr).alias("fills"), F.count_if(placed).alias("placed_fills")
    )


@query("chase_rules", T + f"""
    , f AS (SELECT *, {TSM} AS m FROM ticks), g AS (SELECT *, floor((0.98e0-m+1e-9)*100.0e0)/100.0e0 AS cap, end_ts-{R('0.1e0*(end_ts-start_ts)', 6)} AS dz,
      start_ts+3600 AS naked FROM f),
    h AS (SELECT *, CASE WHEN dz<=naked THEN 1.0e0 WHEN ts<=naked THEN 0.0e0 ELSE least(1.0e0,greatest(0.0e0,(ts-naked)/(dz-naked))) END AS prog FROM g)
    SELECT event_id, cap, prog AS progress, CASE WHEN m IS NULL OR cap IS NULL THEN 0.0e0 WHEN cap<=m OR prog<=0 THEN {R('m', 2)} WHEN prog>=1 THEN {R('cap', 2)}
      ELSE floor((m+prog*(cap-m)+1e-9)*100.0e0)/100.0e0 END AS ceiling FROM h""")
def chase_rules(spark, sf):
    t = ticks(spark, sf).withColumn("m", W.mid_column("two_sided"))
    t = t.withColumn("cap", B.chase_cap(0.98, c("m")))
    prog = B.chase_progress(c("ts"), c("start_ts") + 3600, B.dead_zone_start(c("start_ts"), c("end_ts"), 0.1))
    return t.withColumn("progress", prog).select(
        "event_id", "cap", "progress", B.chase_ceiling(c("m"), c("cap"), c("progress")).alias("ceiling")
    )


@query("parse_timestamps", T + f"""
   , r AS (SELECT event_id, ts_us, CASE event_id%5 WHEN 0 THEN CAST(ts_us AS VARCHAR) WHEN 1 THEN CAST(ts_us//1000 AS VARCHAR)
      WHEN 2 THEN CAST(ts_us//1000000 AS VARCHAR) WHEN 3 THEN strftime(make_timestamp(ts_us//1000000*1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE 'junk' END AS raw FROM ticks)
   SELECT event_id, CASE event_id%5 WHEN 0 THEN ts_us/1e6 WHEN 1 THEN (ts_us//1000)/1e3 WHEN 4 THEN NULL ELSE CAST(ts_us//1000000 AS DOUBLE) END AS parsed FROM r""")
def parse_timestamps(spark, sf):
    t = ticks(spark, sf)
    us = c("ts_us")
    kind = c("event_id") % 5
    raw = (
        F.when(kind == 0, us.cast("string")).when(kind == 1, F.expr("cast(ts_us div 1000 as string)"))
        .when(kind == 2, F.expr("cast(ts_us div 1000000 as string)"))
        .when(kind == 3, F.date_format(F.timestamp_seconds(F.expr("ts_us div 1000000")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.lit("junk"))
    )
    return t.select("event_id", X.parse_print_ts(raw).alias("parsed"))

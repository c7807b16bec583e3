"""Feed reconciliation, as-of and interval joins, print and parser queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import text as X
from ..functions.num import milli, round_dp
from ..operators import prints as PR
from ..operators import ranks as RK
from ..operators import recon as RC
from ..operators import shocks as SH
from ..operators import windows as W
from ..operators.scan import Running, running
from ..session import cut, scratch_path
from ..sources import feeds as FD
from ..sources.derived import ticks
from .outcomes import BASE_SQL, base_outcomes
from .registry import query
from .sqltext import R, T

c = F.col
TOL_S = 150.0
E1 = "1.001e-3"

RECON_SQL = (
    T + "," + FD.SESSION_SQL + f""", ws AS (SELECT * FROM sess WHERE type='ws'), rs AS (SELECT * FROM sess WHERE type='rest'),
cand AS (SELECT w.line, min(struct_pack(d:=abs(r.rx_us-w.rx_us), l:=r.line, rx:=r.rx_us, bb:=r.bb, ba:=r.ba)) AS near, max(struct_pack(l:=r.line, rx:=r.rx_us, bb:=r.bb, ba:=r.ba)) AS above FROM ws w JOIN rs r ON r.token=w.token AND r.line<w.line GROUP BY 1),
nf AS (SELECT w.*, above IS NULL AS none, CASE WHEN rx_us<=0 AND above IS NOT NULL THEN struct_pack(rx:=above.rx, bb:=above.bb, ba:=above.ba) WHEN near.d<=150000000 THEN struct_pack(rx:=near.rx, bb:=near.bb, ba:=near.ba) END AS ref FROM ws w LEFT JOIN cand USING (line)),
nr AS (SELECT *, CASE WHEN none THEN 'no_snapshot' WHEN ref IS NULL THEN 'outside_freshness_window'
  WHEN coalesce(abs(decl_bb-ref.bb)>0.001e0+1e-9,false) OR coalesce(abs(decl_ba-ref.ba)>0.001e0+1e-9,false) THEN 'guard_reject' WHEN (ref.bb IS NULL AND ref.ba IS NULL) OR (bb IS NULL AND ba IS NULL) THEN 'no_comparable_quotes' END AS reason FROM nf),
cm0 AS (SELECT *, CASE WHEN reason IS NULL THEN greatest(abs(bb-ref.bb),abs(ba-ref.ba)) END AS gap, greatest(abs(bb-decl_bb),abs(ba-decl_ba)) AS in_gap FROM nr),
cm AS (SELECT *, reason IS NULL AS compared, coalesce(gap>0.001e0+1e-9,false) AS divergent, coalesce(in_gap>0.001e0+1e-9,false) AS in_divergent, CASE WHEN reason IS NULL AND rx_us>0 THEN (rx_us-ref.rx)/1e6 END AS age,
  CASE WHEN reason IS NULL THEN CASE WHEN ev_type IN ('price_change','best_bid_ask') AND (decl_bb IS NOT NULL OR decl_ba IS NOT NULL) THEN 'gated' ELSE 'blind' END END AS chk FROM cm0)
"""
)
_MAG = "CASE WHEN {0}<=0 THEN 'exact' WHEN {0}<=0.001e0+1e-9 THEN 'sub_tick' WHEN {0}<=0.003e0+1e-9 THEN '1_3_ticks' WHEN {0} IS NOT NULL THEN '>3_ticks' END"
_AGE = "CASE WHEN NOT compared THEN NULL WHEN age IS NULL THEN 'unknown' WHEN age<=0.05 THEN 'le_50ms' WHEN age<=0.1 THEN 'le_100ms' WHEN age<=0.25 THEN 'le_250ms' ELSE 'le_500ms' END"


def nearest(spark, sf):
    return RC.nearest_reference(FD.session(ticks(spark, sf)), TOL_S)


def cmp(spark, sf):
    return RC.comparisons(nearest(spark, sf))


@query("nearest_reference", RECON_SQL + "SELECT event_id, token, ref.rx AS ref_us, ref.bb AS ref_bb, reason FROM nr")
def nearest_reference(spark, sf):
    return nearest(spark, sf).select("event_id", "token", c("ref.rx").alias("ref_us"), c("ref.bb").alias("ref_bb"), "reason")


@query(
    "recon_report",
    RECON_SQL + f"""SELECT ev_type, count(*) AS events, count(*) FILTER (WHERE compared) AS comparisons, count(*) FILTER (WHERE in_divergent) AS in_frame_divergences, count(*) FILTER (WHERE divergent) AS rest_divergences,
 {R('count(*) FILTER (WHERE divergent)/nullif(count(*) FILTER (WHERE compared),0)', 4)} AS divergence_rate, {R('count(*) FILTER (WHERE in_divergent)/count(*)', 4)} AS in_frame_rate,
 {R('greatest(max(gap) FILTER (WHERE divergent), max(in_gap) FILTER (WHERE in_divergent))', 6)} AS max_gap FROM cm GROUP BY 1""",
)
def recon_report(spark, sf):
    return RC.by_type(cmp(spark, sf))


@query("recon_populations", RECON_SQL + f"SELECT chk AS \"check\", count(*) AS comparisons, count(*) FILTER (WHERE divergent) AS divergences, {R('count(*) FILTER (WHERE divergent)/count(*)', 4)} AS rate FROM cm WHERE compared GROUP BY 1")
def recon_populations(spark, sf):
    return RC.by_population(cmp(spark, sf))


@query(
    "recon_histograms",
    RECON_SQL + f""", h AS (SELECT 'magnitude' AS histogram, {_MAG.format('gap')} AS bucket FROM cm UNION ALL SELECT 'magnitude', {_MAG.format('in_gap')} FROM cm UNION ALL SELECT 'age', {_AGE} FROM cm
 UNION ALL SELECT 'age_divergent', CASE WHEN divergent THEN {_AGE} END FROM cm UNION ALL SELECT 'skew', CASE WHEN gap IS NULL THEN NULL WHEN rx_us<=0 THEN 'unknown' WHEN ref.rx>rx_us THEN 'rest_after_ws' ELSE 'rest_before_ws' END FROM cm UNION ALL SELECT 'excluded', reason FROM cm)
 SELECT histogram, bucket, count(*) AS n FROM h WHERE bucket IS NOT NULL GROUP BY 1,2""",
)
def recon_histograms(spark, sf):
    return RC.histograms(cmp(spark, sf))


@query(
    "recon_series",
    RECON_SQL + f"""SELECT series, count(*) AS comparisons, count(*) FILTER (WHERE divergent) AS divergences, {R('count(*) FILTER (WHERE divergent)/count(*)', 4)} AS rate, {R('max(gap)', 6)} AS max_gap,
 count(*) FILTER (WHERE {_MAG.format('gap')}='exact') AS n_exact, count(*) FILTER (WHERE {_MAG.format('gap')}='sub_tick') AS n_sub_tick, count(*) FILTER (WHERE {_MAG.format('gap')}='1_3_ticks') AS n_1_3, count(*) FILTER (WHERE {_MAG.format('gap')}='>3_ticks') AS n_over_3 FROM cm WHERE compared GROUP BY 1""",
)
def recon_series(spark, sf):
    return RC.by_series(cmp(spark, sf))


@query("first_divergence", RECON_SQL + "SELECT token, ev_type, rx_us, CASE WHEN in_divergent THEN 'in_frame' ELSE 'rest' END AS source FROM cm WHERE divergent OR in_divergent ORDER BY line LIMIT 1")
def first_divergence(spark, sf):
    return RC.first_divergence(cmp(spark, sf))


@query(
    "shadow_book_stats",
    RECON_SQL + f""", sh AS (SELECT series, chk, divergent, abs(bb-ref.bb) AS d_bb, abs(ba-ref.ba) AS d_ba, abs((bb+ba)/2.0e0-(ref.bb+ref.ba)/2.0e0) AS d_mid FROM cm WHERE compared AND (abs(bb-ref.bb) IS NOT NULL OR abs(ba-ref.ba) IS NOT NULL))
 SELECT series, count(*) AS comparisons, {R('avg(d_bb)', 6)} AS mean_abs_bb, {R('avg(d_ba)', 6)} AS mean_abs_ba, {R('avg(d_mid)', 6)} AS mean_abs_mid, {R('max(d_bb)', 6)} AS max_bb, {R('max(d_ba)', 6)} AS max_ba,
 {R("count(*) FILTER (WHERE chk='gated' AND divergent)/nullif(count(*) FILTER (WHERE chk='gated'),0)", 4)} AS rate_gated, {R("count(*) FILTER (WHERE chk='blind' AND divergent)/nullif(count(*) FILTER (WHERE chk='blind'),0)", 4)} AS rate_blind FROM sh GROUP BY 1""",
)
def shadow_book_stats(spark, sf):
    n = nearest(spark, sf).filter(c("reason").isNull())
    d_bb, d_ba = F.abs(c("bb") - c("ref.bb")), F.abs(c("ba") - c("ref.ba"))
    d_mid = F.abs((c("bb") + c("ba")) / 2.0 - (c("ref.bb") + c("ref.ba")) / 2.0)
    x = n.select("series", RC.checkability(c("ev_type"), c("decl_bb"), c("decl_ba")).alias("check"), d_bb.alias("d_bb"), d_ba.alias("d_ba"), d_mid.alias("d_mid"), F.coalesce(F.greatest(d_bb, d_ba) > RC.EDGE, F.lit(False)).alias("divergent"))
    return RC.shadow_stats(x.filter(c("d_bb").isNotNull() | c("d_ba").isNotNull()))


@query("session_verdict", T + "," + FD.SESSION_SQL + """, v AS (SELECT token, count(*) FILTER (WHERE type='rest' AND bb IS NOT NULL AND ba IS NOT NULL) AS rest_ok, count(*) FILTER (WHERE type='rest' AND bb IS NULL AND ba IS NULL) AS rest_empty,
  count(*) FILTER (WHERE type='rest' AND (bb IS NULL)<>(ba IS NULL)) AS rest_partial, count(*) FILTER (WHERE type='ws') AS ws FROM sess GROUP BY 1) SELECT *, rest_ok>0 AND ws>0 AS usable FROM v""")
def session_verdict(spark, sf):
    s = FD.session(ticks(spark, sf))
    rest = c("type") == "rest"
    v = s.groupBy("token").agg(
        F.count_if(rest & c("bb").isNotNull() & c("ba").isNotNull()).alias("rest_ok"), F.count_if(rest & c("bb").isNull() & c("ba").isNull()).alias("rest_empty"),
        F.count_if(rest & (c("bb").isNull() != c("ba").isNull())).alias("rest_partial"), F.count_if(~rest).alias("ws"),
    )
    return v.withColumn("usable", (c("rest_ok") > 0) & (c("ws") > 0))


@query("read_session", T + "," + FD.SESSION_SQL + " SELECT coalesce(CASE WHEN event_id%17=0 AND type='ws' THEN NULL ELSE type END,'ws') AS type, count(*) AS lines, count(bb) AS with_bid FROM sess GROUP BY 1")
def read_session(spark, sf):
    """Tagged-union JSON lines written and read back; untagged raw frames count as socket frames."""
    from ..schema import SESSION_DDL

    s = FD.session(ticks(spark, sf))
    tag = F.when(~((c("event_id") % 17 == 0) & (c("type") == "ws")), c("type"))
    top = F.struct(c("bb").alias("best_bid"), c("ba").alias("best_ask"))
    line = F.struct(tag.alias("type"), (c("rx_us") / 1e6).alias("rx"), "series", "token", F.when(c("type") == "rest", top).alias("book"), F.when(c("type") == "ws", F.struct(c("ev_type").alias("event_type"), c("token").alias("asset_id"), c("bb").alias("best_bid"), c("ba").alias("best_ask"))).alias("ev"))
    path = scratch_path(spark, "session")
    s.select(F.to_json(line).alias("value")).write.text(path)
    back = spark.read.schema(SESSION_DDL).json(path).withColumn("type", F.coalesce("type", F.lit("ws")))
    return back.groupBy("type").agg(F.count(F.lit(1)).alias("lines"), F.count(F.coalesce("book.best_bid", "ev.best_bid")).alias("with_bid"))


@query("token_series_lookup", T + "," + FD.SESSION_SQL + ", tsr AS (SELECT token, min(series) AS s FROM sess WHERE type='rest' AND event_id%2=0 GROUP BY 1) SELECT coalesce(s,'unknown') AS series, count(*) AS frames FROM sess LEFT JOIN tsr USING (token) WHERE type='ws' GROUP BY 1")
def token_series_lookup(spark, sf):
    """Series learned from reference rows; the token table grows with the windows, so the optimiser picks the join."""
    s = FD.session(ticks(spark, sf))
    known = s.filter((c("type") == "rest") & (c("event_id") % 2 == 0)).groupBy("token").agg(F.min("series").alias("s"))
    per = s.filter(c("type") == "ws").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return per.join(known, "token", "left").groupBy(F.coalesce("s", F.lit("unknown")).alias("series")).agg(F.sum("n").alias("frames"))


_SPOT = """, sp AS (SELECT event_id, series, ts_us, CASE WHEN event_id%3=0 THEN 'B' ELSE 'A' END AS feed, 100+(event_id*31)%97*0.5e0 AS price FROM ticks)
"""


def spot(spark, sf):
    return ticks(spark, sf).select("event_id", "series", "ts_us", F.when(c("event_id") % 3 == 0, "B").otherwise("A").alias("feed"), (100 + (c("event_id") * 31) % 97 * 0.5).alias("price"))


@query(
    "asof_backward",
    T + _SPOT + f""", ao AS (SELECT *, last_value(CASE WHEN feed='B' THEN price END IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS b FROM sp)
 SELECT event_id, price, b AS other_price, {R('price-b', 4)} AS diff, {R('(price-b)/b*100.0e0', 4)} AS diff_pct FROM ao WHERE feed='A'""",
)
def asof_backward(spark, sf):
    """Latest other-feed price at every row, with difference and percentage."""
    b = F.when(c("feed") == "B", c("price"))
    out = running(spot(spark, sf), ["series"], ["ts_us", "event_id"], F.floor(c("ts_us") / 3_600_000_000), [Running("other_price", "last", b)]).filter(c("feed") == "A")
    return out.select("event_id", "price", "other_price", B.spot_diff(c("price"), c("other_price")).alias("diff"), B.spot_diff_pct(c("price"), c("other_price")).alias("diff_pct"))


_ORD = BASE_SQL + "," + FD.PRINTS_SQL + """, od AS (SELECT cid||leg||CAST(n AS VARCHAR) AS order_id, cid||leg AS token, price, CAST(floor(placed_ts*1e6+0.5e0) AS BIGINT)+n*3600000000 AS placed_us
  FROM (SELECT cid, ':U' AS leg, ru AS price, placed_ts FROM outcomes WHERE entered UNION ALL SELECT cid, ':D', rd, placed_ts FROM outcomes WHERE entered), (VALUES (0),(1)) v(n))
"""


@query("prints_at_price_since", _ORD + "SELECT od.order_id, od.price, round(coalesce(sum(prints.size),0),4) AS printed FROM od LEFT JOIN prints ON prints.token=od.token AND abs(prints.price-od.price)<=0.001e0+1e-9 AND prints.ts_us>=od.placed_us GROUP BY 1,2")
def prints_at_price_since(spark, sf):
    """Printed size at a resting price since each order was placed; every leg is placed again an hour later."""
    o = base_outcomes(spark, sf).filter("entered")
    legs = F.array(F.struct(F.lit(":U").alias("leg"), c("ru").alias("price")), F.struct(F.lit(":D").alias("leg"), c("rd").alias("price")))
    orders = o.select("cid", F.floor(c("placed_ts") * 1e6 + 0.5).cast("bigint").alias("us"), F.inline(legs)).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    orders = orders.select(F.concat("cid", "leg", c("n").cast("string")).alias("order_id"), F.concat("cid", "leg").alias("token"), "price", (c("us") + c("n") * 3_600_000_000).alias("placed_us"))
    done = PR.printed_since(orders, FD.prints(ticks(spark, sf)))
    return done.select("order_id", "price", F.round("printed", 4).alias("printed"))


_ECHO = T + "," + FD.PRINTS_SQL + """, ek AS (SELECT *, CAST(floor(price*1000+0.5) AS INT) AS m, max(CASE WHEN source='ws' THEN ts_us END) OVER (PARTITION BY token, CAST(floor(price*1000+0.5) AS INT) ORDER BY ts_us, event_id, pos ROWS UNBOUNDED PRECEDING) AS ws_us FROM prints),
 kept AS (SELECT * FROM ek WHERE source='ws' OR ws_us IS NULL OR ts_us-ws_us > 7200000000)
"""


def echo_free(spark, sf):
    """Reference prints with no socket print of the same token and price shortly before."""
    p = FD.prints(ticks(spark, sf)).withColumn("m", milli(c("price")))
    ws = F.when(c("source") == "ws", c("ts_us"))
    out = running(p, ["token", "m"], ["ts_us", "event_id", "pos"], F.floor(c("ts_us") / 3_600_000_000), [Running("ws_us", "max", ws)])
    return out.filter((c("source") == "ws") | c("ws_us").isNull() | (c("ts_us") - c("ws_us") > 7_200_000_000))


@query("suppress_echo_prints", _ECHO + "SELECT event_id, pos, token, price FROM kept WHERE source='rest'")
def suppress_echo_prints(spark, sf):
    return echo_free(spark, sf).filter(c("source") == "rest").select("event_id", "pos", "token", "price")


@query("merge_tapes", _ECHO + "SELECT series, source, count(*) AS prints, round(sum(size),4) AS size FROM kept GROUP BY 1,2")
def merge_tapes(spark, sf):
    """Socket prints plus the reference prints the socket did not already carry."""
    k = echo_free(spark, sf)
    merged = k.filter(c("source") == "ws").unionByName(k.filter(c("source") == "rest"))
    return merged.groupBy("series", "source").agg(F.count(F.lit(1)).alias("prints"), F.round(F.sum("size"), 4).alias("size"))


@query("dedup_prints", T + "," + FD.PRINTS_SQL + " SELECT count(*) AS prints FROM (SELECT DISTINCT token, price, size, ts_us FROM (SELECT * FROM prints UNION ALL SELECT * FROM prints WHERE event_id%4=0))")
def dedup_prints(spark, sf):
    """Full print identity; a replayed share of the tape disappears."""
    p = FD.prints(ticks(spark, sf))
    twice = p.unionByName(p.filter(c("event_id") % 4 == 0))
    return twice.dropDuplicates(["token", "price", "size", "ts_us"]).agg(F.count(F.lit(1)).alias("prints"))


@query("printed_volume", T + "," + FD.PRINTS_SQL + f" SELECT token, {R('price', 4)} AS price, round(sum(size),4) AS size FROM prints GROUP BY 1,2")
def printed_volume(spark, sf):
    return FD.prints(ticks(spark, sf)).groupBy("token", round_dp(c("price"), 4).alias("price")).agg(F.round(F.sum("size"), 4).alias("size"))


_SHOCK = T + """, sh0 AS (SELECT event_id, series, ts_us, 100+(event_id*31)%97*0.5e0 AS price, up_bid, up_ask, dn_bid, dn_ask, two AS mid FROM (SELECT *, (up_bid+up_ask)/2.0e0 AS two FROM ticks)),
sh1 AS (SELECT *, first_value(price) OVER (PARTITION BY series ORDER BY ts_us RANGE BETWEEN 3000000000 PRECEDING AND CURRENT ROW) AS base FROM sh0),
sh2 AS (SELECT *, (price-base)/base AS drift, abs((price-base)/base)>=0.2e0 AS hot FROM sh1),
shocks AS (SELECT * FROM (SELECT *, lag(hot,1,false) OVER (PARTITION BY series ORDER BY ts_us) AS was FROM sh2) WHERE hot AND NOT was),
rx AS (SELECT s.event_id, min(b.ts_us) AS r_us FROM shocks s JOIN sh0 b ON b.series=s.series AND b.ts_us>s.ts_us AND b.ts_us<=s.ts_us+1200000000
  AND (abs(b.up_bid-s.up_bid)>=0.01e0-1e-9 OR abs(b.up_ask-s.up_ask)>=0.01e0-1e-9 OR abs(b.dn_bid-s.dn_bid)>=0.01e0-1e-9 OR abs(b.dn_ask-s.dn_ask)>=0.01e0-1e-9 OR abs(b.mid-s.mid)>=0.01e0-1e-9) GROUP BY 1)
"""
RANGE_US, REACT_US = 3_000_000_000, 1_200_000_000


def shock_reactions(spark, sf):
    """Rising edges of a trailing-range drift, each with the first book move of at least a cent soon after."""
    b = ticks(spark, sf).select("event_id", "series", "ts_us", (100 + (c("event_id") * 31) % 97 * 0.5).alias("price"), "up_bid", "up_ask", "dn_bid", "dn_ask", ((c("up_bid") + c("up_ask")) / 2.0).alias("mid"))
    x = SH.first_moves(SH.rising_edges(b.select("event_id", "series", "ts_us", "price"), RANGE_US, 0.2), b, REACT_US)
    # the SQL gives an event its earliest reaction, also where its number comes back
    x = x.withColumn("r_us", F.min("r_us").over(Window.partitionBy("event_id")))
    return x.withColumn("reaction_ms", (c("r_us") - c("ts_us")) / 1000.0)


@query("shock_reaction", _SHOCK + f"SELECT s.event_id, series, {R('drift', 8)} AS drift, (r_us-ts_us)/1000.0e0 AS reaction_ms FROM shocks s LEFT JOIN rx USING (event_id)")
def shock_reaction(spark, sf):
    return shock_reactions(spark, sf).select("event_id", "series", round_dp(c("drift"), 8).alias("drift"), "reaction_ms")


@query(
    "latency_summary",
    _SHOCK + f""", ls AS (SELECT series, drift, floor((r_us-ts_us)/1000.0e0+0.5e0) AS ms FROM shocks LEFT JOIN rx USING (event_id)), l2 AS (SELECT series, count(*) AS shocks, count(ms) AS reactions, list_sort(list(ms) FILTER (WHERE ms IS NOT NULL)) AS s, avg(ms) AS mean_ms, list_sort(list({R('abs(drift)', 6)})) AS d FROM ls GROUP BY GROUPING SETS ((series),()))
 SELECT series, shocks, reactions, {R('reactions/shocks*100.0e0', 2)} AS rate_pct, s[1] AS min_ms, {R("list_aggregate(s,'quantile_cont',0.5)", 1)} AS median_ms, {R('mean_ms', 1)} AS mean_ms, s[least(reactions-1, CAST(floor(reactions*0.95e0) AS BIGINT))+1] AS p95_ms,
 {R("list_aggregate(d,'quantile_cont',0.5)", 6)} AS median_drift, d[least(shocks-1, CAST(floor(shocks*0.95e0) AS BIGINT))+1] AS p95_drift FROM l2""",
)
def latency_summary(spark, sf):
    """Shocks, reactions and index-style percentiles on whole milliseconds, per series and overall."""
    x = shock_reactions(spark, sf).select("series", F.floor(c("reaction_ms") + 0.5).cast("double").alias("ms"), round_dp(F.abs("drift"), 6).alias("d"))
    # read by the totals and by every round of both quantiles: the scans of all ticks behind it run once
    x = RK.levels(cut(x, "reactions"), "series")
    n, k = F.count(F.lit(1)), F.count("ms")
    m = x.groupBy("series").agg(n.alias("shocks"), k.alias("reactions"), round_dp(k / n * 100.0, 2).alias("rate_pct"), F.min("ms").alias("min_ms"), round_dp(F.avg("ms"), 1).alias("mean_ms"))
    ms = RK.quantiles(x, ["series"], "ms", {"median_ms": ("linear", 0.5), "p95_ms": ("index", 0.95)}).drop("n")
    d = RK.quantiles(x, ["series"], "d", {"median_drift": ("linear", 0.5), "p95_drift": ("index", 0.95)}).drop("n")
    out = m.join(ms, "series", "left").join(d, "series", "left")
    return out.select(F.nullif("series", F.lit("overall")).alias("series"), "shocks", "reactions", "rate_pct", "min_ms", round_dp(c("median_ms"), 1).alias("median_ms"), "mean_ms", "p95_ms", round_dp(c("median_drift"), 6).alias("median_drift"), "p95_drift")


@query("spot_stop_signal", T + _SPOT + f""", b0 AS (SELECT s.*, first_value(price) OVER (PARTITION BY series, ts_us//86400000000 ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS base FROM sp s)
 SELECT event_id, {R('(price-base)/base', 8)} AS drift, CASE WHEN event_id%2=0 THEN (price-base)/base <= -0.1e0 ELSE (price-base)/base >= 0.1e0 END AS stop FROM b0""")
def spot_stop_signal(spark, sf):
    """Drift against the first spot price of the window; a naked up leg stops on a fall, a down leg on a rise."""
    s = spot(spark, sf).withColumn("w", F.expr("ts_us div 86400000000"))
    s = running(s, ["series", "w"], ["ts_us", "event_id"], F.floor(c("ts_us") / 3_600_000_000), [Running("base", "first", c("price"))])
    d = B.spot_drift(c("price"), c("base"))
    return s.select("event_id", round_dp(d, 8).alias("drift"), F.when(c("event_id") % 2 == 0, d <= -0.1).otherwise(d >= 0.1).alias("stop"))


@query("live_market_at", T + """, wn AS (SELECT cid, series, min(start_ts) AS s, min(end_ts) AS e FROM ticks GROUP BY 1,2), pr AS (SELECT event_id, series, ts+40000 AS now FROM ticks)
 SELECT event_id, cid FROM (SELECT pr.event_id, wn.cid, row_number() OVER (PARTITION BY pr.event_id ORDER BY wn.s DESC, wn.cid) AS r FROM pr JOIN wn ON wn.series=pr.series AND wn.s<=pr.now AND pr.now<wn.e) WHERE r=1""")
def live_market_at(spark, sf):
    """The market live at a probe time, newest start first. Windows are filed under every hour they cover."""
    t = ticks(spark, sf)
    w = t.groupBy("cid", "series").agg(F.min("start_ts").alias("s"), F.min("end_ts").alias("e"))
    w = w.withColumn("h", F.explode(F.sequence(F.floor(c("s") / 3600), F.floor((c("e") - 1e-6) / 3600))))
    p = t.select("event_id", "series", (c("ts") + 40000).alias("now")).withColumn("h", F.floor(c("now") / 3600))
    j = p.join(w, ["series", "h"]).filter((c("s") <= c("now")) & (c("now") < c("e")))
    best = j.groupBy("event_id").agg(F.min(F.struct((-c("s")).alias("s"), c("cid").alias("cid"))).alias("b"))
    return best.select("event_id", c("b.cid").alias("cid"))


@query("parse_market_listing", T + """ SELECT cid, min(slug) AS slug, min(up_token) AS up_token, min(dn_token) AS down_token, min(start_ts) AS start_ts, min(end_ts) AS end_ts, CASE WHEN min(series)='view' THEN 0.001e0 ELSE 0.01e0 END AS tick_size FROM ticks WHERE series<>'signup' GROUP BY cid""")
def parse_market_listing(spark, sf):
    """Listing payloads built from the windows (one series lists a single token and must vanish), then parsed."""
    w = ticks(spark, sf).groupBy("cid").agg(*[F.min(x).alias(x) for x in ("series", "slug", "up_token", "dn_token", "start_ts", "end_ts")])
    iso = lambda x: F.date_format(F.timestamp_seconds(c(x)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tokens = F.to_json(F.when(c("series") == "signup", F.array("up_token")).otherwise(F.array("up_token", "dn_token")))
    market = F.struct(c("cid").alias("conditionId"), "slug", iso("start_ts").alias("eventStartTime"), iso("end_ts").alias("endDate"), tokens.alias("clobTokenIds"), F.when(c("series") == "view", 0.001).alias("orderPriceMinTickSize"))
    raw = w.select(F.to_json(F.struct(F.array(F.struct(F.array(market).alias("markets"))).alias("events"))).alias("raw"))
    return raw.select(F.inline(FD.parse_listing(c("raw")))).select("cid", "slug", "up_token", "down_token", "start_ts", "end_ts", "tick_size")


@query("normalise_book", T + f""" SELECT event_id, CASE WHEN up_bid IS NULL THEN NULL ELSE up_bid END AS best_bid, CASE WHEN event_id%6=0 THEN 9.0e0 ELSE 5.0e0 END AS size_at_best, 1 AS malformed FROM ticks WHERE up_bid IS NOT NULL AND up_bid>0.01""")
def normalise_book(spark, sf):
    """Raw level arrays with a junk row and a repeated level; the later size wins, the junk is counted."""
    t = ticks(spark, sf).filter(c("up_bid").isNotNull() & (c("up_bid") > 0.01))
    row = lambda p, s: F.struct(p.cast("string").alias("price"), F.lit(s).alias("size"))
    base = F.array(row(c("up_bid"), "5"), row(c("up_bid") - 0.01, "7"), row(F.lit("junk"), "1"))
    raw = F.when(c("event_id") % 6 == 0, F.concat(base, F.array(row(c("up_bid"), "9")))).otherwise(base)
    levels, bad = FD.normalise_levels(c("raw"))
    n = t.select("event_id", raw.alias("raw")).select("event_id", levels.alias("m"), bad.alias("malformed")).withColumn("best_bid", FD.best(c("m"), True))
    return n.select("event_id", "best_bid", F.element_at("m", c("best_bid")).alias("size_at_best"), "malformed")


@query("parse_spot", T + """ SELECT event_id, upper(series) AS symbol, CASE event_id%4 WHEN 0 THEN (100+101)/2.0e0 WHEN 1 THEN 100.0e0 WHEN 2 THEN 55.5e0 END AS price, CASE WHEN event_id%2=0 THEN ts_us//1000 ELSE 77 END AS ts_ms FROM ticks WHERE event_id%4<3""")
def parse_spot(spark, sf):
    """Spot frames of four shapes (both quotes, one quote, trade only, unusable) parsed to symbol, price, time."""
    t, e = ticks(spark, sf), c("event_id")
    frame = F.struct(
        F.when(e % 3 == 0, c("series")).alias("s"), F.when(e % 3 != 0, F.concat("series", F.lit("@trade"))).alias("stream"), F.when(e % 4 <= 1, "100").alias("b"), F.when(e % 4 == 0, "101").alias("a"),
        F.when(e % 4 == 2, "55.5").when(e % 4 == 3, "-1").alias("p"), F.when(e % 2 == 0, F.expr("cast(ts_us div 1000 as string)")).alias("T"),
    )
    p = t.select("event_id", FD.parse_spot(F.to_json(frame), F.lit(77).cast("bigint")).alias("x")).filter(c("x").isNotNull())
    return p.select("event_id", "x.symbol", "x.price", "x.ts_ms")


@query("parse_print", T + "," + FD.PRINTS_SQL + " SELECT event_id, pos, token AS asset, price, size, 'BUY' AS side, ts_us//1000 AS ts_ms FROM prints WHERE event_id%7<>0")
def parse_print(spark, sf):
    p = FD.prints(ticks(spark, sf))
    frame = F.struct(c("token").alias("asset_id"), F.when(c("event_id") % 7 == 0, "1.7").otherwise(c("price").cast("string")).alias("price"), c("size").cast("string").alias("size"), F.lit("buy").alias("side"), F.expr("cast(ts_us div 1000 as string)").alias("timestamp"))
    x = p.select("event_id", "pos", FD.parse_print(F.to_json(frame)).alias("x")).filter(c("x").isNotNull())
    return x.select("event_id", "pos", "x.asset", "x.price", "x.size", "x.side", "x.ts_ms")

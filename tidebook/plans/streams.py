"""Streaming queries: run over the event stream to its end, compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut, scratch_path
from ..streaming import batches as BA
from ..streaming import jobs as J
from ..streaming.run import EVENTS_DDL, drain, tick_stream
from .feeds import REACT_US, RANGE_US
from ..sources import feeds as FD
from .registry import query
from .sqltext import R, T, classify
from .outcomesql import UPB
from ..sources.derived import ladder_sql, load

c = F.col
_UPA = ladder_sql("up_ask_m", 5, 3, 40)
# watermark of the whole stream: latest event (whole milliseconds) minus the allowed delay
WM = T + ", wm AS (SELECT max(ts_us)//1000*1000 - 600000000 AS w FROM ticks)"


@query("tick_stream", T + " SELECT day, series, count(*) AS ticks, count(DISTINCT ts_us//1000000) AS rounds FROM ticks GROUP BY 1,2")
def tick_stream_counts(spark, sf):
    """Continuous tick feed into day partitions; rows of one sampling round share a second."""
    out = drain(tick_stream(spark, sf).select("day", "series", "ts_us"), "ticks", partition="day")
    return out.groupBy("day", "series").agg(F.count(F.lit(1)).alias("ticks"), F.count_distinct(F.expr("ts_us div 1000000")).alias("rounds"))


@query(
    "window_close",
    WM + f", cw AS (SELECT cid, series, max(end_ts) AS e, count(*) AS snaps, {R('arg_min(mid, line_no) FILTER (WHERE mid IS NOT NULL)', 4)} AS start_mid, {R('arg_max(mid, line_no) FILTER (WHERE mid IS NOT NULL)', 4)} AS close_mid, {classify('max(mid)', 'min(mid)')} AS class FROM ticks GROUP BY 1,2) "
    "SELECT cid, series, snaps, start_mid, close_mid, class, false AS reopened FROM cw, wm WHERE e*1000000 <= w AND class<>'no_data'",
)
def window_close(spark, sf):
    return drain(J.window_close(tick_stream(spark, sf)), "closed").drop("end_at")


@query("trade_buffer", WM + f""", tb AS (SELECT p.asset AS token, ts_us//3600000000 AS h, count(*) AS n, {R('sum(p.size)', 4)} AS size FROM (SELECT ts_us, unnest(tape) AS p FROM ticks) GROUP BY 1,2)
 SELECT token, h AS hour, n, size FROM tb, wm WHERE (h+1)*3600000000 <= w""")
def trade_buffer(spark, sf):
    b = drain(J.trade_buffer(tick_stream(spark, sf)), "buffer")
    total = F.aggregate("prints", F.lit(0.0), lambda a, x: a + x["size"])
    from ..functions.num import round_dp

    return b.select("token", F.floor(F.unix_seconds("round_at") / 3600).alias("hour"), "n", round_dp(total, 4).alias("size"))


@query("silence_alert", WM + f""", sl AS (SELECT series, h+o.d AS h, len(tape)=0 AS e FROM (SELECT series, tape, ts_us//3600000000 AS h FROM ticks), (VALUES (0),(1)) o(d)), sg AS (SELECT series, h, count(*) AS n, count(*) FILTER (WHERE e) AS e FROM sl GROUP BY 1,2)
 SELECT series, h AS end_hour, n, {R('e/n', 4)} AS empty_rate, e/n>0.5e0 AS alert FROM (SELECT series, h+1 AS h, n, e FROM sg), wm WHERE h*3600000000 <= w""")
def silence_alert(spark, sf):
    a = drain(J.silence_alert(tick_stream(spark, sf)), "silence")
    return a.select("series", F.floor(F.unix_seconds("end_at") / 3600).alias("end_hour"), "n", "empty_rate", "alert")


@query("ttl_dedup", T + "," + FD.PRINTS_SQL + " SELECT token, count(*) AS prints FROM (SELECT DISTINCT token, price, size, ts_us FROM prints) GROUP BY 1")
def ttl_dedup(spark, sf):
    """Every print arrives twice; the repeat inside the watermark is dropped."""
    t = tick_stream(spark, sf)
    p = t.select("at", "ts_us", F.inline("tape")).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumnRenamed("asset", "token")
    return drain(J.ttl_dedup(p), "dedup").groupBy("token").agg(F.count(F.lit(1)).alias("prints"))


@query("aligned_snapshot", WM + f""", al AS (SELECT series, ts_us//3600000000 AS h, arg_max(struct_pack(s:=100+(event_id*31)%97*0.5e0, b:=up_bid, a:=up_ask), ts_us) AS x, min(100+(event_id*31)%97*0.5e0) AS lo, max(ts_us) AS last_us FROM ticks GROUP BY 1,2)
 SELECT series, h AS hour, x.s AS spot, x.b AS up_bid, x.a AS up_ask, {R('(x.s-lo)/lo', 8)} AS drift, last_us FROM al, wm WHERE (h+1)*3600000000 <= w""")
def aligned_snapshot(spark, sf):
    s = drain(J.aligned_snapshot(tick_stream(spark, sf)), "aligned")
    return s.select("series", F.floor(F.unix_seconds("round_at") / 3600).alias("hour"), "spot", "up_bid", "up_ask", "drift", "last_us")


@query("session_segments", WM + """, s1 AS (SELECT series, ts_us, ts_us-lag(ts_us) OVER (PARTITION BY series ORDER BY ts_us) >= 3600000000 AS b FROM ticks), s2 AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS g FROM s1),
 s3 AS (SELECT series, min(ts_us) AS start_us, max(ts_us)+3600000000 AS end_us, count(*) AS n FROM s2 GROUP BY series, g) SELECT series, start_us, end_us, n FROM s3, wm WHERE end_us <= w""")
def session_segments(spark, sf):
    s = drain(J.session_segments(tick_stream(spark, sf)), "segments")
    return s.select("series", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"), "n")


_HELD = "CASE WHEN event_id%97=0 THEN least(part+2,5) ELSE part END"
_DELIVERED = T + f""", dp AS (SELECT *, event_id*4//(SELECT max(event_id)+1 FROM ticks) AS part FROM ticks), dl AS (SELECT *, {_HELD} AS batch FROM dp),
 wb AS (SELECT batch, max(max(ts_us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)-600000000 AS mark FROM dl GROUP BY 1)
"""


def delivered(spark, sf, name="delivered"):
    """The events as a stream of six batches in which every 97th row comes two batches late."""
    events = load(spark, sf, "events").select([x.split()[0] for x in EVENTS_DDL.split(", ")])
    top = events.agg(F.max("event_id").alias("top"))
    part = F.expr("event_id * 4 div (top + 1)")
    batch = F.when(c("event_id") % 97 == 0, F.least(part + 2, F.lit(5))).otherwise(part)
    rows = cut(events.join(F.broadcast(top)).withColumn("batch", batch).drop("top"), name)
    path = scratch_path(spark, name)
    for i in range(6):  # one after another: the stream takes files in the order of their times
        # one file is one micro-batch; its small row groups let many tasks read it
        rows.filter(c("batch") == i).drop("batch").coalesce(1).write.option("parquet.block.size", 4 << 20).parquet(f"{path}/events_{i}.parquet")
    return tick_stream(spark, path + "/*", glob="*.parquet", max_files=1)


@query("late_data", _DELIVERED + " SELECT event_id, cid, CAST(batch AS INTEGER) AS batch, ts_us<mark AS late, end_ts*1e6<=mark AS reappeared, (mark-ts_us)/1e6 AS behind_sec FROM dl JOIN wb USING (batch) WHERE ts_us<mark OR end_ts*1e6<=mark")
def late_data(spark, sf):
    """Rows behind the watermark and rows of windows it had closed, where some rows are delivered late."""
    return BA.late_rows(delivered(spark, sf)).select("event_id", "cid", "batch", "late", "reappeared", "behind_sec")


# Level-by-level reconstruction: a level is alive after frame f if its last setting since the last snapshot
# has size and no later declared top excludes it. Frames of a token that are more than ``ttl_us`` apart share no state.
_DNB, _DNA = ladder_sql("dn_bid_m", -5, 2, 45), ladder_sql("dn_ask_m", 5, 4, 35)


def _book_sql(ttl_us: int = 2 * 86_400_000_000) -> str:
    def leg(token, bid, ask, bids, asks, price, size, side, keep):
        return f"""SELECT {token} AS token, event_id, line_no, ts_us, kind, {bids} AS bids, {asks} AS asks, {price} AS price, {size} AS size, {side} AS side,
  CASE WHEN kind='price_change' AND event_id%5<>0 THEN {bid} WHEN kind='best_bid_ask' THEN dn_bid END AS bb, CASE WHEN kind='price_change' AND event_id%5<>0 THEN {ask} END AS ba FROM kt WHERE {keep}"""

    up_price, dn_price = "CASE WHEN event_id%8=1 THEN up_bid ELSE up_ask END", "CASE WHEN event_id%8=1 THEN dn_ask ELSE dn_bid END"
    gone = "CASE WHEN event_id%3=0 THEN 0.0e0 ELSE 1.0e0+event_id%{} END"
    up = leg("up_token", "up_bid", "up_ask", UPB, _UPA, up_price, gone.format(50), "CASE WHEN event_id%8=1 THEN 'b' ELSE 'a' END", f"kind='book' OR (kind='price_change' AND {up_price} IS NOT NULL) OR event_id%8 IN (2,3)")
    dn = leg("dn_token", "dn_bid", "dn_ask", _DNB, _DNA, dn_price, gone.format(40), "CASE WHEN event_id%8=1 THEN 'a' ELSE 'b' END", f"kind='book' OR (kind='price_change' AND event_id%7<>0 AND {dn_price} IS NOT NULL) OR event_id%8 IN (6,7)")
    return T + f""", kt AS (SELECT *, CASE event_id%4 WHEN 0 THEN 'book' WHEN 1 THEN 'price_change' WHEN 2 THEN 'best_bid_ask' ELSE 'last_trade_price' END AS kind FROM ticks),
f0 AS ({up} UNION ALL {dn}),
f1 AS (SELECT *, coalesce(ts_us - max(ts_us) OVER (PARTITION BY token ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {ttl_us}, false) AS anew FROM f0),
fr AS (SELECT * REPLACE (token||'#'||CAST(sum(CASE WHEN anew THEN 1 ELSE 0 END) OVER (PARTITION BY token ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS token), token AS name FROM f1),
mu AS (SELECT *, kind='price_change' AS chg, max(CASE WHEN kind='book' THEN line_no END) OVER (PARTITION BY token ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS snap FROM fr),
lv AS (SELECT token, line_no, 'b' AS side, q.price AS price, q.size AS size FROM (SELECT token, line_no, unnest(bids) AS q FROM fr WHERE kind='book') UNION ALL SELECT token, line_no, 'a', q.price, q.size FROM (SELECT token, line_no, unnest(asks) AS q FROM fr WHERE kind='book')
  UNION ALL SELECT token, line_no, side, price, size FROM mu WHERE chg),
st AS (SELECT f.token, f.line_no, l.side, l.price, max(struct_pack(n:=l.line_no, s:=l.size)) AS last FROM mu f JOIN lv l ON l.token=f.token AND l.line_no<=f.line_no AND l.line_no>=coalesce(f.snap, -1) GROUP BY 1,2,3,4),
pr AS (SELECT token, line_no, bb, ba FROM mu WHERE chg),
al AS (SELECT st.* FROM st WHERE last.s>0 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.token=st.token AND pr.line_no>=last.n AND pr.line_no<=st.line_no AND ((st.side='b' AND st.price>pr.bb) OR (st.side='a' AND st.price<pr.ba)))),
bs AS (SELECT f.token, f.name, f.event_id, f.line_no, f.kind, max(price_b) AS best_bid, min(price_a) AS best_ask, count(price_b) AS n_bids, count(price_a) AS n_asks FROM (SELECT m.token, m.name, m.event_id, m.kind, m.line_no, CASE WHEN al.side='b' THEN al.price END AS price_b, CASE WHEN al.side='a' THEN al.price END AS price_a
  FROM mu m LEFT JOIN al ON al.token=m.token AND al.line_no=m.line_no) f GROUP BY ALL)
"""


_BOOK = _book_sql()
_IDLE_US = 6 * 3_600_000_000
_STATE = "SELECT name AS token, event_id, best_bid, best_ask, n_bids, n_asks FROM bs"


@query("book_state", _BOOK + _STATE)
def book_state(spark, sf):
    """Stateful ladder of both tokens from recorded messages: snapshots, level changes and ghost pruning."""
    out = drain(J.book_state(J.frames(tick_stream(spark, sf))), "book")
    return out.select("token", "event_id", "best_bid", "best_ask", "n_bids", "n_asks")


@query("state_expiry", _book_sql(_IDLE_US) + _STATE)
def state_expiry(spark, sf):
    """The same ladders where a token's state ends after six idle hours: its next frame starts afresh."""
    out = drain(J.book_state(J.frames(tick_stream(spark, sf)), _IDLE_US // 1000), "expiry")
    return out.select("token", "event_id", "best_bid", "best_ask", "n_bids", "n_asks")


@query(
    "book_provenance",
    _BOOK
    + """, pv AS (SELECT name, event_id, last_value(CASE WHEN kind<>'last_trade_price' THEN kind END IGNORE NULLS) OVER w AS last_kind,
  last_value(CASE WHEN kind<>'last_trade_price' THEN struct_pack(b:=bb, a:=ba) END IGNORE NULLS) OVER w AS d FROM mu WINDOW w AS (PARTITION BY token ORDER BY line_no ROWS UNBOUNDED PRECEDING))
 SELECT name AS token, event_id, last_kind, d.b AS decl_bb, d.a AS decl_ba FROM pv""",
)
def book_provenance(spark, sf):
    out = drain(J.book_state(J.frames(tick_stream(spark, sf))), "prov")
    return out.select("token", "event_id", "last_kind", "decl_bb", "decl_ba")


@query("top_of_book_log", _BOOK + ", tl AS (SELECT *, row_number() OVER w AS rn, lag(best_bid) OVER w AS pb, lag(best_ask) OVER w AS pa FROM bs WINDOW w AS (PARTITION BY token ORDER BY line_no)) SELECT name AS token, event_id, best_bid, best_ask FROM tl WHERE rn=1 OR best_bid IS DISTINCT FROM pb OR best_ask IS DISTINCT FROM pa")
def top_of_book_log(spark, sf):
    return drain(J.top_of_book_log(J.frames(tick_stream(spark, sf))), "toplog", partition="day").drop("day")


@query("source_authority", T + """, a0 AS (SELECT event_id, ts_us, up_token AS token, len(list_filter(tape, lambda z: z.asset=up_token))>0 AS printed FROM ticks UNION ALL SELECT event_id, ts_us, dn_token, len(list_filter(tape, lambda z: z.asset=dn_token))>0 FROM ticks),
 a1 AS (SELECT *, sum(CASE WHEN event_id%401=0 THEN 1 ELSE 0 END) OVER (PARTITION BY token ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS g FROM a0),
 a2 AS (SELECT event_id, token, ts_us, min(ts_us) OVER w AS ready, max(CASE WHEN printed THEN ts_us END) OVER (PARTITION BY token, g ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS lp FROM a1 WINDOW w AS (PARTITION BY token, g))
 SELECT event_id, token, coalesce(ts_us-ready>=600000000 AND ts_us-lp<=1200000000, false) AS authoritative FROM a2""")
def source_authority(spark, sf):
    return drain(J.source_authority(tick_stream(spark, sf), 600_000_000, 1_200_000_000), "authority").select("event_id", "token", "authoritative")


@query("spot_merge", T + """, m1 AS (SELECT event_id, series, ts_us, CASE WHEN event_id%3=0 THEN 'B' ELSE 'A' END AS feed, 100+(event_id*31)%97*0.5e0 AS price FROM ticks),
 m2 AS (SELECT *, last_value(CASE WHEN feed='A' THEN price END IGNORE NULLS) OVER w AS a, max(CASE WHEN feed='A' THEN ts_us END) OVER w AS a_us, last_value(CASE WHEN feed='B' THEN price END IGNORE NULLS) OVER w AS b FROM m1 WINDOW w AS (PARTITION BY series ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING))
 SELECT event_id, a AS primary_price, b AS secondary_price, CASE WHEN ts_us-a_us<=1800000000 THEN 'primary' WHEN b IS NOT NULL THEN 'secondary' END AS used FROM m2""")
def spot_merge(spark, sf):
    return BA.spot_merge(J.spot(tick_stream(spark, sf)), 1_800_000_000).select("event_id", "primary_price", "secondary_price", "used")


@query("window_baseline", T + " SELECT event_id, first_value(100+(event_id*31)%97*0.5e0) OVER (PARTITION BY series, ts_us//86400000000 ORDER BY ts_us, event_id) AS baseline FROM ticks")
def window_baseline(spark, sf):
    return BA.spot_merge(J.spot(tick_stream(spark, sf)), 1_800_000_000).select("event_id", "baseline")


# A shock's resolution (the first row that reacts, or lies beyond the reaction time) and the next shock's start (the first hot row
# with a mid after the resolution and after a row that was not hot) follow from its own row, so shocks are a chain.
_QUOTES = ("up_bid", "up_ask", "dn_bid", "dn_ask", "mid")
_MOVED = " OR ".join(f"coalesce(abs(b.{q}-a.{q})>=0.01e0-1e-9,false)" for q in _QUOTES)
_SHOCKS = WM.replace("WITH ", "WITH RECURSIVE ", 1) + f""", s0 AS (SELECT event_id, series, ts_us, 100+(event_id*31)%97*0.5e0 AS price, up_bid, up_ask, dn_bid, dn_ask, two AS mid, row_number() OVER (PARTITION BY series ORDER BY ts_us, event_id) AS n FROM (SELECT *, (up_bid+up_ask)/2.0e0 AS two FROM ticks)),
s1 AS (SELECT *, first_value(price) OVER (PARTITION BY series ORDER BY ts_us RANGE BETWEEN {RANGE_US} PRECEDING AND CURRENT ROW) AS base FROM s0),
s2 AS MATERIALIZED (SELECT *, (price-base)/base AS drift, abs((price-base)/base)>=0.2e0 AS hot FROM s1),
ca AS MATERIALIZED (SELECT * FROM s2 WHERE hot AND mid IS NOT NULL),
re AS MATERIALIZED (SELECT a.series, a.n, min(b.n) AS rn FROM ca a JOIN s2 b ON b.series=a.series AND b.n>a.n AND (b.ts_us-a.ts_us>{REACT_US} OR {_MOVED}) GROUP BY 1,2),
rr AS MATERIALIZED (SELECT a.series, a.n, a.event_id, a.ts_us, a.drift, re.rn, b.ts_us AS r_us FROM ca a LEFT JOIN re USING (series, n) LEFT JOIN s2 b ON b.series=a.series AND b.n=re.rn),
nh AS MATERIALIZED (SELECT a.series, a.n, min(b.n) AS cool FROM rr a JOIN s2 b ON b.series=a.series AND b.n>a.n AND NOT b.hot AND b.n IS DISTINCT FROM a.rn GROUP BY 1,2),
nx AS MATERIALIZED (SELECT a.series, a.n, min(k.n) AS nxt FROM rr a JOIN nh USING (series, n) JOIN ca k ON k.series=a.series AND k.n>a.rn AND k.n>nh.cool GROUP BY 1,2),
ch AS (SELECT series, min(n) AS n FROM ca GROUP BY 1 UNION ALL SELECT ch.series, nx.nxt FROM ch JOIN nx ON nx.series=ch.series AND nx.n=ch.n)
SELECT rr.series, rr.event_id AS shock_id, rr.ts_us AS shock_us, rr.drift, coalesce(rr.r_us-rr.ts_us<={REACT_US}, false) AS reacted, CASE WHEN rr.r_us-rr.ts_us<={REACT_US} THEN (rr.r_us-rr.ts_us)/1000.0e0 END AS reaction_ms
 FROM ch JOIN rr USING (series, n), wm WHERE rr.rn IS NOT NULL OR (rr.ts_us+{REACT_US})//1000+1 <= w//1000"""


@query("shock_detector", _SHOCKS)
def shock_detector(spark, sf):
    """One pending shock at a time per series; also checked against a plain-Python model in the tests."""
    return drain(J.shock_detector(tick_stream(spark, sf), 0.2, RANGE_US, REACT_US), "shocks")


@query("order_state", T + """, o1 AS (SELECT event_id, cid||'-'||CAST(user_id%3 AS VARCHAR) AS order_id, ts_us, CASE WHEN event_id%13=0 THEN 0 ELSE 1 END AS seed, CASE event_id%5 WHEN 0 THEN 'LIVE' WHEN 1 THEN 'MATCHED' WHEN 2 THEN 'DELAYED' WHEN 4 THEN 'CANCELED' END AS s FROM ticks),
 o2 AS (SELECT event_id, order_id, last_value(s IGNORE NULLS) OVER (PARTITION BY order_id ORDER BY seed, ts_us, event_id ROWS UNBOUNDED PRECEDING) AS status FROM o1) SELECT order_id, event_id, status, status IN ('LIVE','DELAYED') AS is_open FROM o2""")
def order_state(spark, sf):
    return drain(J.order_state(tick_stream(spark, sf)), "orders")

"""Ledger, account and parameter-manifest queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions.num import milli, round_dp
from ..operators import ledger as L
from ..operators import params as P
from ..operators import quality as Q
from ..operators import results as RS
from ..operators import sweeps as SW
from ..session import scratch_path
from ..sources import feeds as FD
from ..sources.derived import ticks
from .outcomes import HOLD, hold_outcomes
from .outcomesql import outcomes_sql
from .registry import query
from .results import GRID_SQL, sweep_outcomes
from .sqltext import R, T

c = F.col
FT = T + "," + FD.FILLS_SQL + "," + FD.TRADES_SQL
_JOIN = FT + """, st AS (SELECT market_slug, arg_max(pnl_usd, line_no) AS settle_pnl FROM trades WHERE action='WINDOW_SETTLE' GROUP BY 1), fj AS (SELECT fills.*, settle_pnl FROM fills LEFT JOIN st USING (market_slug))
"""
_BUCKET = "CASE WHEN fill_ratio>=0 AND fill_ratio<0.25 THEN '0.00-0.25' WHEN fill_ratio>=0.25 AND fill_ratio<0.5 THEN '0.25-0.50' WHEN fill_ratio>=0.5 AND fill_ratio<1 THEN '0.50-1.00' WHEN fill_ratio>=1 THEN '1.00+' END"
_BN = "(VALUES ('0.00-0.25'),('0.25-0.50'),('0.50-1.00'),('1.00+')) b(bucket)"


def _joined(spark, sf):
    t = ticks(spark, sf)
    return L.with_settle(FD.fills(t), FD.trades(t))


@query("fills_settle_pnl", _JOIN + "SELECT event_id, market_slug, leg, settle_pnl FROM fj")
def fills_settle_pnl(spark, sf):
    return _joined(spark, sf).select("event_id", "market_slug", "leg", "settle_pnl")


@query("latest_per_key", FT + " SELECT market_slug, arg_max(action, line_no) AS action, arg_max(pnl_usd, line_no) AS pnl_usd FROM trades GROUP BY 1")
def latest_per_key(spark, sf):
    t = FD.trades(ticks(spark, sf)).groupBy("market_slug").agg(F.max_by(F.struct("action", "pnl_usd"), "line_no").alias("m"))
    return t.select("market_slug", "m.action", "m.pnl_usd")


@query("read_ledger", FT + " SELECT action, count(*) AS rows, round(sum(pnl_usd),2) AS pnl FROM trades GROUP BY 1")
def read_ledger(spark, sf):
    """Trade ledger as JSON lines with broken lines mixed in; the tolerant reader skips them."""
    path = scratch_path(spark, "trades")
    t = FD.trades(ticks(spark, sf))
    rows = t.select(F.to_json(F.struct("action", "pnl_usd", "market_slug")).alias("value"))
    rows.unionByName(t.filter(c("event_id") % 100 == 0).select(F.lit("{oops").alias("value"))).write.text(path)
    back = spark.read.schema("action string, pnl_usd double, market_slug string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return back.filter(c("_corrupt").isNull()).groupBy("action").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("pnl_usd"), 2).alias("pnl"))


@query("fill_ratio_buckets", _JOIN + f", g AS (SELECT tape_source, {_BUCKET} AS bucket, count(*) AS n, avg(settle_pnl) AS m FROM fj GROUP BY 1,2) SELECT s.tape_source, b.bucket, coalesce(n,0) AS fills, {R('m', 4)} AS mean_settle_pnl FROM (SELECT DISTINCT tape_source FROM fj) s CROSS JOIN {_BN} LEFT JOIN g ON g.tape_source=s.tape_source AND g.bucket=b.bucket")
def fill_ratio_buckets(spark, sf):
    return L.fill_ratio_buckets(_joined(spark, sf), ["tape_source"])


@query(
    "queue_telemetry",
    _JOIN + f""", q AS (SELECT 'ws' AS tape_used, count(*) FILTER (WHERE NOT chased) AS fills, count(*) FILTER (WHERE chased) AS chased, {R('avg(settle_pnl) FILTER (WHERE chased)', 4)} AS chased_mean,
  {R('avg(settle_pnl) FILTER (WHERE NOT chased AND fill_ratio<0.5)', 4)} AS low_mean, {R('avg(settle_pnl) FILTER (WHERE NOT chased AND fill_ratio>=0.5)', 4)} AS high_mean FROM fj WHERE tape_source='ws' AND fill_ratio>=0)
 SELECT *, CASE WHEN coalesce(low_mean>0,false) AND NOT coalesce(high_mean>0,false) THEN 'tape-like' WHEN coalesce(high_mean>0,false) AND NOT coalesce(low_mean>0,false) THEN 'queue-toxic' ELSE 'mixed/unclear' END AS verdict FROM q""",
)
def queue_telemetry(spark, sf):
    return L.queue_telemetry(_joined(spark, sf))


@query("fill_ratio_flags", FT + f" SELECT event_id, {R('printed/greatest(queue_ahead,1.0e0)', 6)} AS ratio, printed/greatest(queue_ahead,1.0e0)>10 AS flagged FROM fills")
def fill_ratio_flags(spark, sf):
    r = B.fill_ratio(c("printed"), c("queue_ahead"))
    return FD.fills(ticks(spark, sf)).select("event_id", round_dp(r, 6).alias("ratio"), (r > 10).alias("flagged"))


@query(
    "observer_report",
    FT + f""" SELECT series, count(*) AS n, {R('count(*) FILTER (WHERE pnl_usd>0)/count(*)*100.0e0', 2)} AS win_pct, count(*) FILTER (WHERE action='PAIR_MERGE') AS pairs, count(*) FILTER (WHERE action LIKE '%STOP%') AS stops, {R('sum(pnl_usd)', 2)} AS pnl,
 min(pnl_usd) AS worst, {R('avg(pnl_usd)', 4)} AS avg_pnl FROM trades GROUP BY GROUPING SETS ((series),())""",
)
def observer_report(spark, sf):
    return L.observer_report(FD.trades(ticks(spark, sf)))


_ACT = T + "," + FD.ACTIVITY_SQL
_B, _S = "type='TRADE' AND side='BUY'", "type='TRADE' AND side='SELL'"


@query(
    "wallet_windows",
    _ACT + f""", ww AS (SELECT coalesce(condition_id, slug) AS window_id, max(ts) AS last_ts, coalesce(sum(usdc_milli) FILTER (WHERE {_B}),0) AS cost, coalesce(sum(size) FILTER (WHERE {_B}),0.0e0) AS shares, coalesce(sum(usdc_milli) FILTER (WHERE {_S}),0) AS sells,
  coalesce(sum(usdc_milli) FILTER (WHERE type='MERGE'),0) AS merges, coalesce(sum(usdc_milli) FILTER (WHERE type='REDEEM'),0) AS redeems, sum(usdc_milli) FILTER (WHERE {_B} AND outcome='Up') AS uc, sum(size) FILTER (WHERE {_B} AND outcome='Up') AS us,
  sum(usdc_milli) FILTER (WHERE {_B} AND outcome='Down') AS dc, sum(size) FILTER (WHERE {_B} AND outcome='Down') AS ds FROM act GROUP BY 1), w2 AS (SELECT *, sells+merges+redeems AS pro, sells+merges+redeems-cost AS pnl FROM ww)
 SELECT window_id, last_ts, {R('cost/1000.0e0', 3)} AS cost, shares, CASE WHEN merges>0 THEN 'PAIR_MERGE' WHEN sells>0 AND redeems=0 THEN CASE WHEN pnl>=0 THEN 'TAKE_PROFIT' ELSE 'STOP_EXIT' END WHEN redeems>0 THEN 'WINDOW_SETTLE' ELSE 'EXPIRED' END AS action, {R('pnl/1000.0e0', 2)} AS pnl_usd,
  {R('uc/us/1000.0e0', 3)} AS entry_up, {R('dc/ds/1000.0e0', 3)} AS entry_down, CASE WHEN shares>0 THEN {R('pro/1000.0e0/greatest(0.1e0,shares)', 3)} END AS exit_price, {R('pnl/1000.0e0/greatest(0.01e0,cost/1000.0e0)*100.0e0', 1)} AS pnl_pct FROM w2""",
)
def wallet_windows(spark, sf):
    return L.wallet_windows(FD.activity(ticks(spark, sf)))


@query(
    "cash_flow",
    _ACT + f""", s0 AS (SELECT min(struct_pack(t:=ts, e:=event_id)) AS s FROM act WHERE contains(slug,'purchase') AND outcome='Down' AND side='BUY'),
  cf AS (SELECT count(*) AS rows, {R("sum(CASE WHEN type='TRADE' AND side='BUY' THEN -usdc_milli WHEN type='TRADE' AND side='SELL' THEN usdc_milli WHEN type IN ('MERGE','REDEEM') THEN usdc_milli ELSE 0 END)/1000.0e0", 3)} AS net_cash FROM act, s0 WHERE struct_pack(t:=ts, e:=event_id)>=s)
 SELECT *, {R('5000.0e0-net_cash', 2)} AS opening_balance FROM cf""",
)
def cash_flow(spark, sf):
    marker = c("slug").contains("purchase") & (c("outcome") == "Down") & (c("side") == "BUY")
    return L.cash_flow(FD.activity(ticks(spark, sf)), marker, 5000.0)


SERIES = ("click", "error", "purchase", "signup", "view")
_RUN = "OVER (ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)"


@query(
    "ledger_timeline",
    FT + " SELECT event_id, series, " + R(f"sum(pnl_usd) {_RUN}", 2) + " AS total_pnl, " + R(f"sum(pnl_usd) {_RUN}+5000.0e0", 2) + f" AS portfolio_value, count(*) FILTER (WHERE action='PAIR_MERGE') {_RUN} AS pairs, count(*) FILTER (WHERE action LIKE '%STOP%') {_RUN} AS stops, "
    + ", ".join(R(f"sum(pnl_usd) FILTER (WHERE series='{s}') {_RUN}", 2) + f" AS pnl_{s}" for s in SERIES) + " FROM trades",
)
def ledger_timeline(spark, sf):
    t = L.timeline(FD.trades(ticks(spark, sf)), 5000.0)
    return t.select("event_id", "series", "total_pnl", "portfolio_value", "pairs", "stops", *[c("market_pnl")[s].alias(f"pnl_{s}") for s in SERIES])


_POS = T + "," + FD.POSITIONS_SQL + """, lq AS (SELECT cid, any_value(series) AS series, any_value(up_token) AS tok, arg_max(mid, ts_us) FILTER (WHERE mid IS NOT NULL) AS last_mid FROM ticks GROUP BY 1)
"""


def _latest(spark, sf):
    t = ticks(spark, sf)
    return t.groupBy("cid").agg(F.min("series").alias("series"), F.min("up_token").alias("up_token"), F.max_by("mid", F.when(c("mid").isNotNull(), c("ts_us"))).alias("last_mid"))


def enriched(spark, sf):
    """Positions with their market: by condition id, else by token (two equi-joins, no OR join)."""
    p = FD.positions(ticks(spark, sf))
    m = _latest(spark, sf)
    by_id = m.select(c("cid").alias("condition_id"), c("series").alias("s1"), c("last_mid").alias("m1"))
    by_tok = m.select(c("up_token").alias("token"), c("series").alias("s2"), c("last_mid").alias("m2"))
    j = p.join(by_id, "condition_id", "left").join(by_tok, "token", "left")
    return j.select("user_id", "token", "size", F.coalesce("s1", "s2").alias("series"), F.coalesce("m1", "m2").alias("mark"), F.when(c("s1").isNotNull(), "condition").otherwise("token").alias("matched_by"))


@query("position_enrich", _POS + "SELECT user_id, token, size, coalesce(a.series,b.series) AS series, coalesce(a.last_mid,b.last_mid) AS mark, CASE WHEN a.series IS NOT NULL THEN 'condition' ELSE 'token' END AS matched_by FROM pos LEFT JOIN lq a ON a.cid=pos.condition_id LEFT JOIN lq b ON b.tok=pos.token")
def position_enrich(spark, sf):
    return enriched(spark, sf)


@query(
    "account_value",
    _POS + f""", pv AS (SELECT user_id, sum(size*last_mid) AS v, count(*) AS n FROM pos JOIN lq ON lq.tok=pos.token GROUP BY 1), ca AS (SELECT user_id, CASE WHEN user_id%3=0 THEN CAST(sum(event_id%7) AS DOUBLE) END AS cash, CASE WHEN user_id%3=1 THEN CAST(sum(event_id%90) AS DOUBLE) END AS rt FROM ticks GROUP BY 1)
 SELECT user_id, {R('v', 2)} AS positions_value, n AS open_positions, {R('coalesce(cash, CASE WHEN rt IS NOT NULL THEN greatest(0.0e0, rt-v) END, 0.0e0)', 2)} AS cash_balance, {R('CASE WHEN cash IS NOT NULL THEN cash+v ELSE coalesce(rt,v) END', 2)} AS net_value FROM pv LEFT JOIN ca USING (user_id)""",
)
def account_value(spark, sf):
    e = enriched(spark, sf).withColumn("value", c("size") * c("mark"))
    u = c("user_id") % 3
    cash = ticks(spark, sf).groupBy("user_id").agg(F.sum(c("event_id") % 7).cast("double").alias("a"), F.sum(c("event_id") % 90).cast("double").alias("b"))
    cash = cash.select("user_id", F.when(u == 0, c("a")).alias("cash"), F.when(u == 1, c("b")).alias("reported_total"))
    return L.account_value(e, cash, "user_id")


@query(
    "open_position_marks",
    outcomes_sql([HOLD]) + f""", om AS (SELECT cid, 'up' AS leg, ru AS entry, coalesce(last_up_bid, last_tsm, 0.5e0) AS mark FROM outcomes WHERE filled_up AND kind='settle' UNION ALL SELECT cid, 'down', rd, coalesce(last_dn_bid, {R('1.0e0-coalesce(last_tsm,0.5e0)', 4)}) FROM outcomes WHERE filled_dn AND kind='settle')
 SELECT cid, leg, 50.0e0 AS size, entry, mark, {R('50.0e0*entry', 4)} AS initial_value, {R('50.0e0*mark', 4)} AS current_value, {R('50.0e0*mark-50.0e0*entry', 4)} AS unrealised FROM om""",
)
def open_position_marks(spark, sf):
    o = hold_outcomes(spark, sf).filter(c("kind") == "settle")
    up = F.when(c("filled_up"), F.struct(F.lit("up").alias("leg"), c("ru").alias("entry"), F.coalesce(c("last_up_bid"), c("last_tsm"), F.lit(0.5)).alias("mark")))
    dn = F.when(c("filled_dn"), F.struct(F.lit("down").alias("leg"), c("rd").alias("entry"), F.coalesce(c("last_dn_bid"), round_dp(1.0 - F.coalesce(c("last_tsm"), F.lit(0.5)), 4)).alias("mark")))
    legs = o.select("cid", F.inline(F.filter(F.array(up, dn), lambda x: x.isNotNull())))
    size = 50.0
    return legs.select("cid", "leg", F.lit(size).alias("size"), "entry", "mark", round_dp(size * c("entry"), 4).alias("initial_value"), round_dp(size * c("mark"), 4).alias("current_value"), round_dp(size * c("mark") - size * c("entry"), 4).alias("unrealised"))


@query("order_rows_rank", FT + """ SELECT event_id, market_slug FROM (SELECT *, CASE action WHEN 'EXPIRED' THEN 3 WHEN 'TAKE_PROFIT' THEN 2 WHEN 'STOP_EXIT' THEN 1 ELSE 0 END AS r FROM trades)""")
def order_rows_rank(spark, sf):
    """Display order of all rows: status rank, series, id."""
    rank = F.when(c("action") == "EXPIRED", 3).when(c("action") == "TAKE_PROFIT", 2).when(c("action") == "STOP_EXIT", 1).otherwise(0)
    return FD.trades(ticks(spark, sf)).orderBy(rank, "series", "event_id").select("event_id", "market_slug")


@query("preferred_dataset", T + """, fs AS (SELECT day, count(DISTINCT cid) AS windows, count(*) AS n, count(*) FILTER (WHERE err IS NOT NULL) AS errs FROM ticks GROUP BY 1)
 SELECT day, tier, windows FROM (SELECT *, CASE WHEN errs<=2 THEN 1 ELSE 2 END AS tier FROM fs) ORDER BY tier, CASE WHEN errs=0 THEN 0 WHEN errs<=2 THEN 1 ELSE 2 END, windows DESC, n DESC, day LIMIT 1""")
def preferred_dataset(spark, sf):
    """Best day: complete tier first, then level, windows, size and name."""
    t = ticks(spark, sf)
    per = t.groupBy("day", "cid").agg(F.count(F.lit(1)).alias("n"), F.count("err").alias("e")).groupBy("day").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n"), F.sum("e").alias("errs"))
    tier = F.when(c("errs") <= 2, 1).otherwise(2)
    level = F.when(c("errs") == 0, 0).when(c("errs") <= 2, 1).otherwise(2)
    return per.withColumn("tier", tier).orderBy("tier", level, c("windows").desc(), c("n").desc(), "day").limit(1).select("day", "tier", "windows")


AXIS = [(a, i, str(v)) for a, vs in SW.AXES.items() for i, v in enumerate(vs)]
_MAN = ", ".join(f"('{a}',{i},'{v}')" for a, i, v in AXIS)


def manifest_points(spark, sf):
    """The sweep axes as a manifest file, read back and joined to the sweep's results per value."""
    import json

    path = scratch_path(spark, "manifest")
    body = json.dumps({a: list(v) for a, v in SW.AXES.items()})
    spark.range(1).select(F.lit(body).alias("value")).write.text(path)
    m = P.read_manifest(spark, path)
    o = sweep_outcomes(spark, sf).groupBy("config_id").agg(F.count(F.lit(1)).alias("windows"), round_dp(F.sum(RS.net()), 2).alias("total_pnl"))
    return m.withColumn("config_id", F.concat_ws("=", "name", "value")).join(o, "config_id", "left").select("name", "ordinal", "value", "windows", "total_pnl")


_MP = GRID_SQL + f", so AS (SELECT config_id, count(*) AS windows, {R('sum((pnl-fees)*5.0e0)', 2)} AS total_pnl FROM outcomes GROUP BY 1), mp AS (SELECT name, ordinal, value, windows, total_pnl FROM (VALUES {_MAN}) m(name, ordinal, value) LEFT JOIN so ON so.config_id=name||'='||value)"


@query("param_manifest", _MP + " SELECT * FROM mp")
def param_manifest(spark, sf):
    return manifest_points(spark, sf)


@query("param_spec_join", _MP + " SELECT name, count(*) AS candidates, CAST(sum(windows) AS BIGINT) AS windows, CASE name WHEN 'offset' THEN 'tuning' WHEN 'queue_gate' THEN 'tuning' END AS param_class FROM mp GROUP BY 1")
def param_spec_join(spark, sf):
    j = P.join_spec(manifest_points(spark, sf), P.spec_table(spark))
    return j.groupBy("name", "param_class").agg(F.count(F.lit(1)).alias("candidates"), F.sum("windows").alias("windows")).select("name", "candidates", "windows", "param_class")


@query("param_grid_view", _MP + " SELECT CASE WHEN name IN ('offset','queue_gate') THEN 'trading_knobs' ELSE 'unspecified' END AS grp, count(DISTINCT name) AS params FROM mp GROUP BY 1")
def param_grid_view(spark, sf):
    v = P.grouped_view(P.join_spec(manifest_points(spark, sf), P.spec_table(spark)))
    return v.select("grp", F.size("params").cast("bigint").alias("params"))


_CFG = T + """, cf AS (SELECT event_id, CASE WHEN event_id%19=0 THEN 'min' WHEN event_id%2=0 THEN 'pct' ELSE 'sec' END AS u, CASE WHEN event_id%23=0 THEN 2.0e0 ELSE 0.1e0 END AS dz, CASE WHEN event_id%29=0 THEN 'wait' ELSE 'hold' END AS nl, CAST(event_id%40*100 AS DOUBLE) AS ed,
  0.5e0+(event_id%60)/100.0e0 AS mp, (event_id%10)/10.0e0 AS lo, 0.7e0 AS hi, CASE WHEN event_id%31=0 THEN CAST('nan' AS DOUBLE) ELSE 1.01e0 END AS pg FROM ticks)
"""


@query(
    "config_validate",
    _CFG + """SELECT violation, count(*) AS configs FROM (SELECT unnest(list_filter([CASE WHEN u NOT IN ('pct','sec') THEN 'dead_zone_unit' END, CASE WHEN u='pct' AND dz>1 THEN 'dead_zone_val' END, CASE WHEN nl NOT IN ('close','hold') THEN 'naked_leg_at_expiry' END,
  CASE WHEN ed>3600 THEN 'entry_delay_sec' END, CASE WHEN mp>1.0 THEN 'max_pair_cost' END, CASE WHEN lo>=hi THEN 'quote_range' END, CASE WHEN isnan(pg) THEN 'pair_cost_gate' END], lambda z: z IS NOT NULL)) AS violation FROM cf) GROUP BY 1""",
)
def config_validate(spark, sf):
    """One recorded configuration per sample, checked against every rule."""
    e = c("event_id")
    cfg = ticks(spark, sf).select(
        "event_id", F.when(e % 19 == 0, "min").when(e % 2 == 0, "pct").otherwise("sec").alias("dead_zone_unit"), F.when(e % 23 == 0, 2.0).otherwise(0.1).alias("dead_zone_val"),
        F.when(e % 29 == 0, "wait").otherwise("hold").alias("naked_leg_at_expiry"), (e % 40 * 100).cast("double").alias("entry_delay_sec"), (0.5 + e % 60 / 100.0).alias("max_pair_cost"),
        (e % 10 / 10.0).alias("lo"), F.lit(0.7).alias("hi"), F.when(e % 31 == 0, float("nan")).otherwise(1.01).alias("pair_cost_gate"),
    )
    return P.violations(cfg, P.config_rules(), "event_id").groupBy("violation").agg(F.count(F.lit(1)).alias("configs"))

"""Oracle SQL of the outcome chain, built for any list of configurations."""

from __future__ import annotations

from collections.abc import Sequence

from ..operators.outcomes import PARAMS, Quote
from ..sources.derived import ladder_sql
from .sqltext import R, T, TSM, classify, clamp, mid, queue

UPB = ladder_sql("up_bid_m", -5, 1, 50)
DNB = ladder_sql("dn_bid_m", -5, 2, 45)


def _lit(v):
    if isinstance(v, str):
        return f"'{v}'"
    if isinstance(v, float):
        return f"{v!r}e0" if "e" not in repr(v) else repr(v)
    return repr(v)


def cfg(configs: Sequence[Quote]) -> str:
    rows = ", ".join("(" + ", ".join([_lit(q.config_id), *[_lit(getattr(q, p)) for p in PARAMS]]) + ")" for q in configs)
    return f"cfg(config_id, {', '.join('p_' + p for p in PARAMS)}) AS (VALUES {rows})"


_P = ", ".join(f"p_{p}" for p in PARAMS)
_AP = ", ".join(f"any_value(p_{p}) AS p_{p}" for p in PARAMS)
EXQ = "CASE WHEN {0}>0 AND {0}<=1 THEN {0} END"
CUTOFF = f"(CASE p_dead_zone_unit WHEN 'sec' THEN least(p_dead_zone, length) ELSE {R('p_dead_zone*length', 6)} END)"
_DZ = f"(CASE WHEN rem<=0 THEN true ELSE ({CUTOFF} > 0 AND rem <= {CUTOFF}+1e-6) END)"


def rest(m: str, down: bool = False) -> str:
    base = f"(1.0e0-{m})" if down else m
    return R(clamp(f"{base}-p_offset", "0.01e0", "0.99e0"), 3)


def chain(configs: Sequence[Quote], detector: str = "both", leg_range: bool = True, skip_buys: bool = False) -> str:
    """CTEs qt, x, a, p, fl (fills with pair/held/entry)."""
    legs = f" AND {rest('tsm')} BETWEEN p_lo AND p_hi AND {rest('tsm', True)} BETWEEN p_lo AND p_hi" if leg_range else ""

    def hit(tok, r, ask):
        buy = f" AND NOT coalesce(z.price >= {ask}-1e-9, false)" if skip_buys else ""
        return f"(coalesce(len(list_filter(tape, lambda z: z.asset={tok} AND abs(z.price-{r})<=0.001e0+1e-6{buy}))>0,false) AND {r} IS NOT NULL)"

    def thr(ask, r):
        return f"coalesce(CASE WHEN coalesce(ts_us=p_us,false) THEN {ask}<={r}+1e-6 ELSE {ask}<={r}-0.001e0+1e-6 END,false)"

    def pred(tok, r, ask):
        return {"tape": hit(tok, r, ask), "ask": thr(ask, r), "both": f"({hit(tok, r, ask)} OR {thr(ask, r)})"}[detector]

    return (
        T
        + f""", {cfg(configs)},
qt AS (SELECT *, {TSM} AS tsm, {mid('up_bid', 'up_ask')} AS mid_up, greatest(0.0e0, ts-start_ts) AS elapsed,
  greatest(0.0e0, end_ts-ts) AS rem, end_ts-start_ts AS length, {UPB} AS up_bids, {DNB} AS dn_bids FROM ticks WHERE end_ts>start_ts),
x AS (SELECT *, {_DZ} AS dz FROM qt, cfg),
a AS (SELECT config_id, cid, min(ts_us) FILTER (WHERE ok) AS a_us, arg_min(tsm, ts_us) FILTER (WHERE ok) AS a_mid
  FROM (SELECT *, tsm IS NOT NULL AND tsm BETWEEN p_lo AND p_hi AND NOT dz{legs} AS ok FROM x) GROUP BY 1,2),
p0 AS (SELECT x.*, a_us, a_mid, {rest('a_mid')} AS ru, {rest('a_mid', True)} AS rd FROM x JOIN a USING (config_id, cid)),
p AS (SELECT config_id, cid, any_value(a_us) AS a_us, any_value(a_mid) AS a_mid, any_value(ru) AS ru, any_value(rd) AS rd,
  min(ts_us) FILTER (WHERE ok) AS p_us, min(elapsed) FILTER (WHERE ok) AS p_el
  FROM (SELECT *, coalesce(ts_us>=a_us AND elapsed>=CASE WHEN p_delay_pct>=0 THEN p_delay_pct*length ELSE p_delay END AND tsm BETWEEN p_lo AND p_hi AND NOT dz
    AND (p_queue_gate<=0 OR coalesce({queue('up_bids', 'ru')}<=p_queue_gate AND {queue('dn_bids', 'rd')}<=p_queue_gate, false))
    AND (p_touch_gate<=0 OR coalesce(up_ask+dn_ask<=p_touch_gate, true)), false) AS ok FROM p0) GROUP BY 1,2),
f0 AS (SELECT x.*, a_us, a_mid, ru, rd, p_us, p_el FROM x JOIN p USING (config_id, cid)),
f1 AS (SELECT config_id, cid, any_value(a_us) AS a_us, any_value(a_mid) AS a_mid, any_value(ru) AS ru, any_value(rd) AS rd, any_value(p_us) AS p_us, any_value(p_el) AS p_el,
  min(ts_us) FILTER (WHERE live AND u AND NOT dz) AS u_nd, min(ts_us) FILTER (WHERE live AND u) AS u_any,
  min(ts_us) FILTER (WHERE live AND d AND NOT dz) AS d_nd, min(ts_us) FILTER (WHERE live AND d) AS d_any
  FROM (SELECT *, coalesce(ts_us>=p_us,false) AND mid_up IS NOT NULL AS live, {pred('up_token', 'ru', 'up_ask')} AS u, {pred('dn_token', 'rd', 'dn_ask')} AS d FROM f0) GROUP BY 1,2),
f2 AS (SELECT *, coalesce(u_nd, CASE WHEN d_nd IS NOT NULL THEN u_any END) AS u_us, coalesce(d_nd, CASE WHEN u_nd IS NOT NULL THEN d_any END) AS d_us FROM f1),
fl AS (SELECT *, CASE WHEN u_us IS NOT NULL AND d_us IS NOT NULL THEN greatest(u_us,d_us) END AS pair_us, least(coalesce(u_us,d_us),coalesce(d_us,u_us)) AS first_us,
  CASE WHEN u_us IS NOT NULL AND (d_us IS NULL OR u_us<d_us) THEN 'up' WHEN d_us IS NOT NULL AND (u_us IS NULL OR d_us<u_us) THEN 'down' END AS held,
  CASE WHEN u_us IS NOT NULL AND (d_us IS NULL OR u_us<d_us) THEN ru WHEN d_us IS NOT NULL AND (u_us IS NULL OR d_us<u_us) THEN rd END AS entry FROM f2)
"""
    )


def chase_cte(src: str = "fl", mine: str = "true") -> str:
    """The open leg's chased quote after the first fill, per (config, window); ``mine`` says which configurations chase."""
    prog = "CASE WHEN dzs<=nk THEN 1.0e0 WHEN elapsed<=nk THEN 0.0e0 ELSE least(1.0e0,greatest(0.0e0,(elapsed-nk)/(dzs-nk))) END"
    target = R(clamp("least(ask,ceil)", "0.01e0", "0.99e0"), 3)
    w = "OVER (PARTITION BY config_id, cid ORDER BY ts_us ROWS"
    return f"""c0 AS (SELECT x.config_id, x.cid, x.ts_us, x.line_no, x.elapsed, x.tape, held, first_us/1e6-x.start_ts AS nk, x.length-{CUTOFF} AS dzs,
   CASE WHEN held='down' THEN up_ask ELSE dn_ask END AS ask, CASE WHEN held='down' THEN ru ELSE rd END AS orig, CASE WHEN held='down' THEN up_token ELSE dn_token END AS tok,
   floor((p_max_pair-entry+1e-9)*100.0e0)/100.0e0 AS cap FROM x JOIN {src} USING (config_id, cid) WHERE {mine} AND held IS NOT NULL AND ts_us>first_us AND mid_up IS NOT NULL),
c1 AS (SELECT *, {prog} AS prog FROM c0),
c2 AS (SELECT *, CASE WHEN cap<=orig OR prog<=0 THEN {R('orig', 2)} WHEN prog>=1 THEN {R('cap', 2)} ELSE floor((orig+prog*(cap-orig)+1e-9)*100.0e0)/100.0e0 END AS ceil FROM c1),
c3 AS (SELECT *, CASE WHEN ask IS NOT NULL THEN {target} END AS target FROM c2),
c4 AS (SELECT *, greatest(orig, coalesce(max(target) {w} UNBOUNDED PRECEDING),orig)) AS level, greatest(orig, coalesce(max(target) {w} BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),orig)) AS before FROM c3),
c5 AS (SELECT *, level>before AS raised, (coalesce(len(list_filter(tape, lambda z: z.asset=tok AND abs(z.price-level)<=0.001e0+1e-6))>0,false)
  OR coalesce(CASE WHEN level>before THEN ask<=level+1e-6 ELSE ask<=level-0.001e0+1e-6 END,false)) AS hit FROM c4)
"""


def chased_fills(ids: Sequence[str]) -> str:
    """``fl`` with the second leg of every chasing configuration taken from the chase."""
    mine = f"config_id IN ({', '.join(map(_lit, ids))})"
    return f"""{chase_cte('fl0', mine)}, ch AS (SELECT config_id, cid, min(ts_us) FILTER (WHERE hit) AS ch_us, arg_min(level, ts_us) FILTER (WHERE hit) AS ch_px FROM c5 GROUP BY 1,2),
fl AS (SELECT * EXCLUDE (ch_us, ch_px) REPLACE (CASE WHEN {mine} AND held='down' THEN ch_us ELSE u_us END AS u_us, CASE WHEN {mine} AND held='up' THEN ch_us ELSE d_us END AS d_us, CASE WHEN {mine} AND held IS NOT NULL THEN ch_us ELSE pair_us END AS pair_us,
  CASE WHEN held='down' AND ch_us IS NOT NULL THEN ch_px ELSE ru END AS ru, CASE WHEN held='up' AND ch_us IS NOT NULL THEN ch_px ELSE rd END AS rd) FROM fl0 LEFT JOIN ch USING (config_id, cid))
"""


def level_sql(configs: Sequence[Quote]) -> str:
    """The stop threshold of each configuration for series that no table names (windows longer than five minutes)."""
    own = "".join(f" WHEN config_id={_lit(q.config_id)} THEN {_lit(dict(q.thr_by_slug)['default_15m'])}" for q in configs if q.thr_by_slug)
    return f"(CASE{own} ELSE p_thr END)" if own else "p_thr"


def closing() -> str:
    lat = ", ".join(f"arg_max({q}, ts_us) FILTER (WHERE {q}>0 AND {q}<=1) AS lat_{q}" for q in ("up_bid", "up_ask", "dn_bid", "dn_ask"))
    last = ", ".join(f"max(struct_pack(t:=ts_us, v:={q})).v AS last_{q}" for q in ("up_bid", "up_ask", "dn_bid", "dn_ask"))
    return f"""cl AS (SELECT cid, any_value(series) AS series, any_value(slug) AS slug, any_value(duration) AS duration, any_value(day) AS day,
  any_value(start_ts) AS start_ts, any_value(end_ts) AS end_ts, count(*) AS n_snaps, min(ts) AS first_ts, min(line_no) AS first_seq, max(ts) AS last_ts,
  max(mid_up) AS mx, min(mid_up) AS mn, arg_max(tsm, ts_us) FILTER (WHERE tsm IS NOT NULL) AS last_tsm, {last}, {lat} FROM qt GROUP BY cid)"""


def outcomes_sql(configs: Sequence[Quote] = (Quote(),), detector: str = "both", thr: str | None = None) -> str:
    thr = level_sql(configs) if thr is None else thr
    exc = f"CASE WHEN held='up' THEN {R('entry-mid_up', 6)} WHEN held='down' THEN {R('mid_up-(1.0e0-entry)', 6)} END"
    hb = "CASE WHEN held='up' THEN up_bid WHEN held='down' THEN dn_bid END"

    def side(up, dn):
        return f"(CASE WHEN held='up' THEN {up} ELSE {dn} END)"

    bid = side(EXQ.format("last_up_bid"), EXQ.format("last_dn_bid"))
    opp = side(EXQ.format("last_dn_ask"), EXQ.format("last_up_ask"))
    cm = R(clamp(f"1.0e0-{opp}", "0.0001e0", "0.9999e0"), 4)
    lb = side("lat_up_bid", "lat_dn_bid")
    lo = side("lat_dn_ask", "lat_up_ask")
    lm = R(clamp(f"1.0e0-{lo}", "0.0001e0", "0.9999e0"), 4)
    hm = mid(side("last_up_bid", "last_dn_bid"), side("last_up_ask", "last_dn_ask"))
    om = mid(side("last_dn_bid", "last_up_bid"), side("last_dn_ask", "last_up_ask"))
    fee = lambda p: f"(CASE WHEN {p}>0 AND {p}<1 THEN p_fee_rate*{p}*(1.0e0-{p}) ELSE 0.0e0 END*100.0e0)"
    edge = R("(1.0e0-(ru+rd))*100.0e0 - p_gas_usd*100.0e0/greatest(1,p_shares)", 4)
    fills = chain(configs, detector)
    if chasing := [q.config_id for q in configs if q.max_pair]:
        fills = fills.replace("\nfl AS (", "\nfl0 AS (") + ", " + chased_fills(chasing)
    return (
        fills
        + f""", {closing()},
xe0 AS (SELECT *, {exc} AS exc, {hb} AS hb FROM (SELECT x.*, a_us, a_mid, ru, rd, p_us, p_el, u_us, d_us, pair_us, first_us, held, entry FROM x JOIN fl USING (config_id, cid))),
xe1 AS (SELECT config_id, cid, min(ts_us) FILTER (WHERE nk AND exc>={thr}) AS cross_us, min(ts_us) FILTER (WHERE cl) AS dz_us, arg_min(hb, ts_us) FILTER (WHERE cl) AS dz_bid
  FROM (SELECT *, nk AND dz AND p_policy='close' AND coalesce(hb>0 AND hb<=1,false) AS cl FROM (SELECT *, coalesce(ts_us>first_us,false) AND mid_up IS NOT NULL AND coalesce(ts_us<pair_us,true) AND held IS NOT NULL AS nk FROM xe0)) GROUP BY 1,2),
xe2 AS (SELECT config_id, cid, min(ts_us) FILTER (WHERE af AND hb IS NOT NULL) AS s_us, arg_min(hb, ts_us) FILTER (WHERE af AND hb IS NOT NULL) AS s_bid,
  min(ts_us) FILTER (WHERE af AND exc<p_reversal) AS l_us FROM (SELECT xe0.*, cross_us, coalesce(ts_us>=cross_us,false) AND mid_up IS NOT NULL AND coalesce(ts_us<pair_us,true) AS af FROM xe0 JOIN xe1 USING (config_id, cid)) GROUP BY 1,2),
o0 AS (SELECT fl.*, cfg.* EXCLUDE (config_id), cl.* EXCLUDE (cid), dz_us, dz_bid, CASE WHEN s_us IS NOT NULL AND coalesce(s_us<l_us,true) THEN s_us END AS stop_us, CASE WHEN s_us IS NOT NULL AND coalesce(s_us<l_us,true) THEN s_bid END AS stop_bid
  FROM fl JOIN cfg USING (config_id) JOIN cl USING (cid) JOIN xe1 USING (config_id, cid) JOIN xe2 USING (config_id, cid)),
o1 AS (SELECT *, list_min(list_filter([pair_us, dz_us, stop_us], lambda z: z IS NOT NULL)) AS x_us, {bid} AS bid, {cm} AS cm, {lb} AS lb, {lm} AS lm,
  coalesce({hm}, 1.0e0-{om}) AS rp FROM o0),
o2 AS (SELECT *, CASE WHEN first_us IS NULL THEN 'no_fill' WHEN x_us IS NULL THEN 'settle' WHEN x_us=pair_us THEN 'pair' WHEN x_us=dz_us THEN 'dead_zone' ELSE 'stop' END AS kind,
  CASE WHEN held IS NULL OR entry IS NULL THEN NULL WHEN bid IS NOT NULL THEN 'direct_bid' WHEN cm IS NOT NULL THEN 'complement_ask' WHEN lb IS NOT NULL THEN 'latched_bid' WHEN lm IS NOT NULL THEN 'latched_complement_ask'
    WHEN rp IS NOT NULL AND rp<>0.5 THEN 'redeemed' ELSE 'unresolved' END AS src, coalesce(bid,cm,lb,lm) AS mark FROM o1),
o3 AS (SELECT *, coalesce(mark, CASE WHEN rp>0.5 THEN 1.0e0 WHEN rp<0.5 THEN 0.0e0 END) AS val, CASE WHEN kind='dead_zone' THEN dz_bid WHEN kind='stop' THEN stop_bid END AS xb,
  coalesce(u_us<=x_us, true) AND u_us IS NOT NULL AS filled_up, coalesce(d_us<=x_us, true) AND d_us IS NOT NULL AS filled_dn FROM o2),
outcomes AS (SELECT config_id, cid, series, slug, duration, day, start_ts, end_ts, first_ts, first_seq, n_snaps, {classify('mx', 'mn')} AS class,
  coalesce(greatest(0.0e0,{R('mx-0.5e0', 4)}),0.0e0) AS max_up, coalesce(greatest(0.0e0,{R('0.5e0-mn', 4)}),0.0e0) AS max_down,
  a_mid AS anchor_mid, a_us/1e6 AS anchor_ts, p_us/1e6 AS placed_ts, p_el AS placed_elapsed, ru, rd, u_us/1e6 AS fill_up_ts, d_us/1e6 AS fill_dn_ts,
  p_us IS NOT NULL AS entered, filled_up, filled_dn, kind, CASE WHEN kind NOT IN ('no_fill','pair') THEN held END AS held, entry,
  coalesce(xb, CASE WHEN kind='settle' THEN mark END) AS exit_price,
  CASE WHEN kind='pair' THEN pair_us/1e6 WHEN kind='no_fill' THEN NULL ELSE coalesce(x_us/1e6, last_ts) END AS exit_ts,
  CASE WHEN kind='settle' THEN src END AS settle_source, CASE WHEN kind='pair' THEN {R('ru+rd', 4)} END AS pair_cost, CASE WHEN kind='pair' THEN {edge} END AS pair_edge,
  {R("CASE WHEN kind='pair' THEN " + edge + " WHEN kind IN ('dead_zone','stop') THEN (xb-entry)*100.0e0 WHEN kind='settle' THEN coalesce((val-entry)*100.0e0,0.0e0) ELSE 0.0e0 END", 4)} AS pnl,
  {R("CASE WHEN kind IN ('dead_zone','stop') THEN " + fee('xb') + " WHEN kind='settle' THEN p_fee_rate*0.5e0*0.5e0*100.0e0 + coalesce(" + fee('mark') + ",0.0e0) ELSE 0.0e0 END", 4)} AS fees,
  {R('CASE WHEN filled_up THEN ru ELSE 0.0e0 END + CASE WHEN filled_dn THEN rd ELSE 0.0e0 END', 4)} AS capital,
  {R('greatest(0.0e0,first_ts-start_ts)', 2)} AS start_delay, greatest(0.0e0,first_ts-start_ts)>5 AS partial, last_tsm, last_up_bid, last_dn_bid,
  CASE WHEN CAST(floor(last_tsm*1e4+0.5000001e0) AS INT)>5200 THEN 'up' WHEN CAST(floor(last_tsm*1e4+0.5000001e0) AS INT)<4800 THEN 'down' END AS winner FROM o3)
"""
    )

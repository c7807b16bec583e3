"""Feed-shaped inputs: parsers for raw text payloads, and feeds/ledgers derived from the tick view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.num import as_price, finite, round_dp
from ..schema import LISTING_DDL

c = F.col


# ---- parsers ---------------------------------------------------------------

def parse_listing(raw: Column, default_tick: float = 0.01) -> Column:
    """Listing JSON to an array of markets; a market needs exactly two tokens and both times."""
    events = F.from_json(raw, LISTING_DDL)["events"]
    markets = F.flatten(F.transform(events, lambda e: F.coalesce(e["markets"], F.array().cast("array<struct<conditionId:string,slug:string,eventStartTime:string,endDate:string,clobTokenIds:string,orderPriceMinTickSize:double,negRisk:boolean>>"))))

    def shape(m):
        tokens = F.from_json(m["clobTokenIds"], "array<string>")
        return F.struct(
            m["conditionId"].alias("cid"), m["slug"].alias("slug"), F.try_element_at(tokens, F.lit(1)).alias("up_token"), F.try_element_at(tokens, F.lit(2)).alias("down_token"),
            X.iso_epoch(m["eventStartTime"]).alias("start_ts"), X.iso_epoch(m["endDate"]).alias("end_ts"),
            F.coalesce(m["orderPriceMinTickSize"], F.lit(default_tick)).alias("tick_size"), F.coalesce(m["negRisk"], F.lit(False)).alias("neg_risk"), F.size(tokens).alias("n"),
        )

    return F.filter(F.transform(markets, shape), lambda m: (m["n"] == 2) & m["start_ts"].isNotNull() & m["end_ts"].isNotNull())


def normalise_levels(raw: Column) -> tuple[Column, Column]:
    """[{price,size}] strings to (price→size map at 4 dp, skipped rows); a repeated level keeps the last size."""
    parsed = F.transform(raw, lambda x: F.struct(round_dp(as_price(x["price"]), 4).alias("price"), as_price(x["size"]).alias("size")))
    ok = F.filter(parsed, lambda x: x["price"].isNotNull() & x["size"].isNotNull())
    # keep an entry only if no later entry has its price: map keys stay unique without session settings
    last = F.filter(ok, lambda x, i: ~F.exists(F.slice(ok, i + 2, F.greatest(F.size(ok) - i - 1, F.lit(0))), lambda y: y["price"] == x["price"]))
    return F.map_from_entries(last), F.size(raw) - F.size(ok)


def best(levels: Column, bids: bool) -> Column:
    keys = F.map_keys(levels)
    return F.array_max(keys) if bids else F.array_min(keys)


SPOT_DDL = "s string, b string, a string, p string, c string, T string, E string, stream string"


def parse_spot(raw: Column, arrival_ms: Column) -> Column:
    """Spot frame to (symbol, price, ts_ms): mid of both quotes, the one present, else trade, else close."""
    j = F.from_json(raw, SPOT_DDL)
    b, a, p, k = (as_price(j[x]) for x in ("b", "a", "p", "c"))
    price = F.coalesce((b + a) / 2.0, b, a, p, k)
    ts = F.coalesce(j["T"].try_cast("bigint"), j["E"].try_cast("bigint"), arrival_ms)
    symbol = F.upper(F.coalesce(j["s"], F.split(j["stream"], "@")[0]))
    return F.when((price > 0) & symbol.isNotNull(), F.struct(symbol.alias("symbol"), price.alias("price"), ts.alias("ts_ms")))


PRINT_DDL = "asset_id string, price string, size string, side string, timestamp string, transaction_hash string"


def parse_print(raw: Column) -> Column:
    """Trade frame to a print, or NULL when the price or size is unusable."""
    j = F.from_json(raw, PRINT_DDL)
    price, size = as_price(j["price"]), as_price(j["size"])
    ok = (j["asset_id"] != "") & price.between(0, 1) & (size >= 0)
    ms = X.parse_print_ts(j["timestamp"]) * 1000.0
    return F.when(ok, F.struct(j["asset_id"].alias("asset"), price.alias("price"), size.alias("size"), F.upper(j["side"]).alias("side"), F.floor(ms + 0.5).alias("ts_ms"), j["transaction_hash"].alias("hash")))


# ---- derived feeds -----------------------------------------------------------

def legs(ticks: DataFrame, *carry: str) -> DataFrame:
    """Both tokens of every tick: (token, leg, bb, ba) with the tick's own columns."""
    def leg(n, token, bb, ba):
        return F.struct(F.lit(n).alias("leg"), c(token).alias("token"), c(bb).alias("bb"), c(ba).alias("ba"))

    return ticks.select(*carry, F.inline(F.array(leg(0, "up_token", "up_bid", "up_ask"), leg(1, "dn_token", "dn_bid", "dn_ask"))))


def session(ticks: DataFrame) -> DataFrame:
    """Recorded session lines of both tokens: a socket frame and a reference read for every tick.

    Half of the reads stand above their tick's frame in the file; receive times run up to two minutes before and after the
    frame's whatever the line; every 17th frame is a raw one without a receive time.
    """
    e = c("event_id")
    t = legs(ticks, "event_id", "series", "ts_us")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("book", "price_change", "best_bid_ask", "last_trade_price")]), (e % 4 + 1).cast("int"))
    declared = (e % 4).isin(1, 2)
    nudge = F.when(e % 13 == 0, 0.002).otherwise(0.0)
    none = F.lit(None).cast("double")
    ws = t.select(
        F.lit("ws").alias("type"), "token", "series", F.when(e % 17 == 0, 0).otherwise(c("ts_us")).cast("bigint").alias("rx_us"), (e * 100 + 50 + c("leg")).alias("line"), "event_id", kinds.alias("ev_type"),
        "bb", "ba", F.when(declared, c("bb") + nudge).alias("decl_bb"), F.when(declared, c("ba")).alias("decl_ba"),
    )
    shift = F.when(e % 7 == 0, 0.004).when(e % 5 == 0, 0.001).otherwise(0.0)
    rest = t.select(
        F.lit("rest").alias("type"), "token", "series", (c("ts_us") + (e % 5 - 2) * 60_000_000).alias("rx_us"), (e * 100 + F.when(e % 4 < 3, 10).otherwise(90) + c("leg")).alias("line"), "event_id", F.lit(None).cast("string").alias("ev_type"),
        (c("bb") - shift).alias("bb"), "ba", none.alias("decl_bb"), none.alias("decl_ba"),
    )
    return ws.unionByName(rest)


SESSION_SQL = """
lg AS (SELECT event_id, series, ts_us, 0 AS leg, up_token AS token, up_bid AS bb, up_ask AS ba FROM ticks UNION ALL SELECT event_id, series, ts_us, 1, dn_token, dn_bid, dn_ask FROM ticks),
sess AS (SELECT 'ws' AS type, token, series, CASE WHEN event_id%17=0 THEN 0 ELSE ts_us END AS rx_us, event_id*100+50+leg AS line, event_id, CASE event_id%4 WHEN 0 THEN 'book' WHEN 1 THEN 'price_change' WHEN 2 THEN 'best_bid_ask' ELSE 'last_trade_price' END AS ev_type,
   bb, ba, CASE WHEN event_id%4 IN (1,2) THEN bb+CASE WHEN event_id%13=0 THEN 0.002e0 ELSE 0.0e0 END END AS decl_bb, CASE WHEN event_id%4 IN (1,2) THEN ba END AS decl_ba FROM lg
 UNION ALL SELECT 'rest', token, series, ts_us+(event_id%5-2)*60000000, event_id*100+CASE WHEN event_id%4<3 THEN 10 ELSE 90 END+leg, event_id, NULL, bb-CASE WHEN event_id%7=0 THEN 0.004e0 WHEN event_id%5=0 THEN 0.001e0 ELSE 0.0e0 END, ba, NULL, NULL FROM lg)
"""


def prints(ticks: DataFrame) -> DataFrame:
    p = ticks.select("event_id", "series", "cid", "ts_us", "ts", F.posexplode("tape").alias("pos", "p"))
    return p.select("event_id", "series", "cid", "ts_us", "ts", "pos", c("p.asset").alias("token"), c("p.price").alias("price"), c("p.size").alias("size"), F.when((c("event_id") + c("pos")) % 3 == 0, "rest").otherwise("ws").alias("source"))


PRINTS_SQL = """
prints AS (SELECT event_id, series, cid, ts_us, ts, pos, p.asset AS token, p.price AS price, p.size AS size, CASE WHEN (event_id+pos)%3=0 THEN 'rest' ELSE 'ws' END AS source
  FROM (SELECT event_id, series, cid, ts_us, ts, unnest(tape) AS p, generate_subscripts(tape,1)-1 AS pos FROM ticks WHERE len(tape)>0))
"""


def fills(ticks: DataFrame) -> DataFrame:
    """Fill telemetry: one row for every sixth tick that printed."""
    e = c("event_id")
    f = ticks.filter((e % 6 == 0) & (F.size("tape") > 0))
    queue = (1 + e % 50).cast("double")
    return f.select(
        "event_id", "ts", c("slug").alias("market_slug"), "series", F.when(e % 4 == 0, "up").otherwise("down").alias("leg"), (e % 10 == 0).alias("chased"),
        queue.alias("queue_ahead"), F.try_element_at("tape", F.lit(1))["size"].alias("printed"), F.when(e % 9 == 0, "rest").otherwise("ws").alias("tape_source"),
        F.when(e % 42 != 0, F.try_element_at("tape", F.lit(1))["size"] / F.greatest(queue, F.lit(1.0)) / 4.0).alias("fill_ratio"),
    )


FILLS_SQL = """
fills AS (SELECT event_id, ts, slug AS market_slug, series, CASE WHEN event_id%4=0 THEN 'up' ELSE 'down' END AS leg, event_id%10=0 AS chased, CAST(1+event_id%50 AS DOUBLE) AS queue_ahead, tape[1].size AS printed,
  CASE WHEN event_id%9=0 THEN 'rest' ELSE 'ws' END AS tape_source, CASE WHEN event_id%42<>0 THEN tape[1].size/greatest(CAST(1+event_id%50 AS DOUBLE),1.0e0)/4.0e0 END AS fill_ratio FROM ticks WHERE event_id%6=0 AND len(tape)>0)
"""

ACTIONS = ("PAIR_MERGE", "STOP_EXIT", "WINDOW_SETTLE", "TAKE_PROFIT", "EXPIRED")


def trades(ticks: DataFrame) -> DataFrame:
    """Trade events: every fifth tick closes something."""
    e = c("event_id")
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.expr("event_id div 5") % 5 + 1).cast("int"))
    pnl = (F.expr("event_id div 5") * 37 % 401 - 200) / 100.0
    return ticks.filter(e % 5 == 0).select("event_id", "line_no", "ts_us", "series", c("slug").alias("market_slug"), action.alias("action"), pnl.alias("pnl_usd"))


TRADES_SQL = """
trades AS (SELECT event_id, line_no, ts_us, series, slug AS market_slug, CASE (event_id//5)%5 WHEN 0 THEN 'PAIR_MERGE' WHEN 1 THEN 'STOP_EXIT' WHEN 2 THEN 'WINDOW_SETTLE' WHEN 3 THEN 'TAKE_PROFIT' ELSE 'EXPIRED' END AS action,
  CAST((event_id//5)*37%401-200 AS DOUBLE)/100.0e0 AS pnl_usd FROM ticks WHERE event_id%5=0)
"""


def activity(ticks: DataFrame) -> DataFrame:
    """Wallet activity: mostly buys, some sells, merges and redeems; every eleventh row lacks its condition id."""
    e = c("event_id")
    k = F.expr("(event_id div 3) % 10")
    kind = F.when(k < 8, "TRADE").when(k == 8, "MERGE").otherwise("REDEEM")
    return ticks.filter(e % 3 == 0).select(
        "event_id", kind.alias("type"), F.when(k < 6, "BUY").when(k < 8, "SELL").otherwise("").alias("side"), F.when(e % 2 == 0, "Up").otherwise("Down").alias("outcome"),
        (1 + e % 9).cast("double").alias("size"), F.floor(c("mid") * (1 + e % 9) * 1000.0 + 0.5).cast("double").alias("usdc_milli"), "ts",
        F.when(e % 11 != 0, c("cid")).alias("condition_id"), "slug", "series",
    ).filter(c("usdc_milli").isNotNull())


ACTIVITY_SQL = """
act AS (SELECT * FROM (SELECT event_id, CASE WHEN k<8 THEN 'TRADE' WHEN k=8 THEN 'MERGE' ELSE 'REDEEM' END AS type, CASE WHEN k<6 THEN 'BUY' WHEN k<8 THEN 'SELL' ELSE '' END AS side, CASE WHEN event_id%2=0 THEN 'Up' ELSE 'Down' END AS outcome,
   CAST(1+event_id%9 AS DOUBLE) AS size, floor(mid*(1+event_id%9)*1000.0e0+0.5e0) AS usdc_milli, ts, CASE WHEN event_id%11<>0 THEN cid END AS condition_id, slug, series FROM (SELECT *, (event_id//3)%10 AS k FROM ticks WHERE event_id%3=0)) WHERE usdc_milli IS NOT NULL)
"""


def positions(ticks: DataFrame) -> DataFrame:
    """Open positions: net size per (user, token); half of them know only the token."""
    p = ticks.filter(c("event_id") % 4 == 1).groupBy("user_id", "cid", "up_token").agg(F.sum(c("event_id") % 5 + 1).cast("double").alias("size"))
    return p.select("user_id", F.when(c("user_id") % 2 == 0, c("cid")).alias("condition_id"), c("up_token").alias("token"), "size")


POSITIONS_SQL = """
pos AS (SELECT user_id, CASE WHEN user_id%2=0 THEN cid END AS condition_id, up_token AS token, CAST(sum(event_id%5+1) AS DOUBLE) AS size FROM ticks WHERE event_id%4=1 GROUP BY user_id, cid, up_token)
"""

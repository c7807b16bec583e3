"""Recorded socket messages to token entries.

A message is one JSON object or an array of them. A ``book`` names its token and carries both sides; a ``price_change``
carries entries that name their own token (or fall back to the frame's), often of both legs. Prices outside 0..1, sizes that
are negative or no numbers, and entries without a token are dropped one by one, never the message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
LEVEL = "array<struct<price:string,size:string>>"
CHANGE = "array<struct<asset_id:string,price:string,size:string,side:string,best_bid:string,best_ask:string>>"
# Field names of the wire.
MESSAGE = (
    f"array<struct<event_type:string,asset_id:string,token_id:string,bids:{LEVEL},asks:{LEVEL},price_changes:{CHANGE},changes:{CHANGE},"
    "price:string,size:string,side:string,best_bid:string,best_ask:string>>"
)


def quote(text: Column) -> Column:
    """A price inside 0..1, else NULL."""
    x = text.try_cast("double")
    return F.when((x >= 0) & (x <= 1), x)


def amount(text: Column) -> Column:
    """A finite size of 0 or more, else NULL."""
    x = text.try_cast("double")
    return F.when((x >= 0) & (x < float("inf")), x)


def _side(levels: Column) -> Column:
    parsed = F.transform(levels, lambda x: F.struct(quote(x["price"]).alias("price"), amount(x["size"]).alias("size")))
    return F.coalesce(F.filter(parsed, lambda x: x["price"].isNotNull() & (x["size"] > 0)), F.array().cast("array<struct<price:double,size:double>>"))


def _named(*names: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(*[F.nullif(n, F.lit("")) for n in names])), F.lit(""))


def parse_frames(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row per token entry, ``seq`` being its place in the message; other columns of ``lines`` stay."""
    body = F.trim(c(value))
    parsed = F.from_json(F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]"))), MESSAGE)
    kept = [x for x in lines.columns if x != value]
    each = lines.select(*kept, F.posexplode(parsed).alias("nth", "m"))
    frame_token = _named(c("m.asset_id"), c("m.token_id"))
    changes = F.when(F.size("m.price_changes") > 0, c("m.price_changes")).otherwise(c("m.changes"))
    empty = F.array().cast("array<struct<price:double,size:double>>")

    def entry(token, price=None, size=None, side=None, bid=None, ask=None, bids=empty, asks=empty):
        none = F.lit(None)
        return F.struct(
            token.alias("token"), (none.cast("double") if price is None else quote(price)).alias("price"), (none.cast("double") if size is None else amount(size)).alias("size"),
            (none.cast("string") if side is None else F.when(F.upper(F.coalesce(side, F.lit("BUY"))).isin("BUY", "BID"), "b").otherwise("a")).alias("side"),
            (none.cast("double") if bid is None else quote(bid)).alias("decl_bb"), (none.cast("double") if ask is None else quote(ask)).alias("decl_ba"), bids.alias("bids"), asks.alias("asks"),
        )

    kind = c("m.event_type")
    moves = F.transform(changes, lambda x: entry(_named(x["asset_id"], frame_token), x["price"], F.coalesce(x["size"], F.lit("0")), x["side"], x["best_bid"], x["best_ask"]))
    moves = F.filter(moves, lambda x: x["price"].isNotNull() & x["size"].isNotNull())
    entries = (
        F.when(kind == "book", F.array(entry(frame_token, bids=_side(c("m.bids")), asks=_side(c("m.asks")))))
        .when(kind == "price_change", moves)
        .when(kind == "best_bid_ask", F.array(entry(frame_token, bid=c("m.best_bid"), ask=c("m.best_ask"))))
        .when(kind == "last_trade_price", F.array(entry(frame_token, c("m.price"), c("m.size"), c("m.side"))))
    )
    out = each.select(*kept, "nth", kind.alias("kind"), F.posexplode(entries).alias("at_entry", "e"))
    px = lambda s: F.transform(c(f"e.{s}"), lambda x: x["price"])
    sz = lambda s: F.transform(c(f"e.{s}"), lambda x: x["size"])
    return out.filter(c("e.token").isNotNull()).select(
        *kept, (c("nth") * 100_000 + c("at_entry")).alias("seq"), "kind", "e.token", "e.price", "e.size", "e.side", "e.decl_bb", "e.decl_ba",
        px("bids").alias("bid_px"), sz("bids").alias("bid_sz"), px("asks").alias("ask_px"), sz("asks").alias("ask_sz"),
    )


def recorded_messages(ticks: DataFrame) -> DataFrame:
    """The JSON messages of both tokens that ticks stand for: snapshots, changes of both legs, quotes and trades, some entries broken."""
    e, text = c("event_id"), lambda x: x.cast("string")
    odd = F.array(F.struct(F.lit("1.2").alias("price"), F.lit("9").alias("size")), F.struct(F.lit("0.4").alias("price"), F.lit("NaN").alias("size")))

    def side(levels):
        return F.concat(F.transform(levels, lambda x: F.struct(text(x["price"]).alias("price"), text(x["size"]).alias("size"))), odd)

    def snapshot(token, bids, asks):
        return F.struct(F.lit("book").alias("event_type"), token.alias("asset_id"), side(bids).alias("bids"), side(asks).alias("asks"))

    def change(token, price, size, buy, bid, ask):
        told = lambda q: F.when(e % 5 != 0, text(q))
        return F.struct(token.alias("asset_id"), price.alias("price"), text(size).alias("size"), F.when(buy, "BUY").otherwise("SELL").alias("side"), told(bid).alias("best_bid"), told(ask).alias("best_ask"))

    buy, gone = e % 8 == 1, e % 3 == 0
    up = change(c("up_token"), text(F.when(buy, c("up_bid")).otherwise(c("up_ask"))), F.when(gone, 0.0).otherwise(1.0 + e % 50), buy, c("up_bid"), c("up_ask"))
    dn_price = F.when(e % 7 == 0, "1.5").otherwise(text(F.when(buy, c("dn_ask")).otherwise(c("dn_bid"))))
    down = change(c("dn_token"), dn_price, F.when(gone, 0.0).otherwise(1.0 + e % 40), ~buy, c("dn_bid"), c("dn_ask"))
    flat = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    token = F.when(e % 8 == 2, c("up_token")).otherwise(c("dn_token"))
    value = (
        F.when(e % 4 == 0, F.to_json(F.array(snapshot(c("up_token"), c("up_bids"), c("up_asks")), snapshot(c("dn_token"), c("dn_bids"), c("dn_asks")))))
        .when(e % 4 == 1, flat(event_type=F.lit("price_change"), price_changes=F.array(up, down)))
        .when(e % 4 == 2, flat(event_type=F.lit("best_bid_ask"), asset_id=token, best_bid=text(c("dn_bid")), best_ask=F.lit("7")))
        .otherwise(flat(event_type=F.lit("last_trade_price"), asset_id=F.when(e % 8 == 3, c("up_token")).otherwise(c("dn_token")), price=F.lit("0.5"), size=F.lit("1")))
    )
    return ticks.select("event_id", "line_no", "ts_us", "at", value.alias("value"))

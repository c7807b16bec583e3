"""Fixed read schemas; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = "array<struct<price:double,size:double>>"

BOOK = (
    "struct<token_id:string,bids:map<string,double>,asks:map<string,double>,"
    "best_bid:double,best_ask:double,malformed:int,err:string>"
)

WIRE_TICK_DDL = (
    "ts double, iso string, series string, duration int, label string, cid string, slug string, "
    "start_ts double, end_ts double, t_rem double, up_token string, down_token string, "
    f"up_book {BOOK}, down_book {BOOK}, "
    "tape_delta array<struct<asset:string,price:double,size:double>>, "
    "mid double, touch_pair double, resting_pair double, queue_up double, queue_down double, err string"
)

CORRUPT = "_corrupt"


def wire_tick(with_corrupt: bool = False) -> T.StructType:
    ddl = WIRE_TICK_DDL + (f", {CORRUPT} string" if with_corrupt else "")
    return T.StructType.fromDDL(ddl)


SESSION_DDL = (
    "type string, rx double, mono double, series string, token string, "
    "book struct<best_bid:double,best_ask:double,err:string>, "
    "ev struct<event_type:string,asset_id:string,best_bid:double,best_ask:double,price:double,size:double>"
)

LISTING_DDL = (
    "events array<struct<markets:array<struct<conditionId:string,slug:string,eventStartTime:string,"
    "endDate:string,clobTokenIds:string,orderPriceMinTickSize:double,negRisk:boolean>>>>"
)

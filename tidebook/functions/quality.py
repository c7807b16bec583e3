"""Integrity predicates and issue lists per tick."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sane bounds.
MID_LO, MID_HI = -0.01, 1.01
TOUCH_LO, TOUCH_HI = 0.50, 1.50


def bounds_violation(mid: Column, touch: Column) -> Column:
    bad_mid = F.coalesce((mid < MID_LO) | (mid > MID_HI), F.lit(False))
    bad_touch = F.coalesce((touch < TOUCH_LO) | (touch > TOUCH_HI), F.lit(False))
    return bad_mid | bad_touch


def _flag(cond: Column, text: str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(text))


def _per_level(levels: Column, side: str, label: str) -> Column:
    """One issue per bad level: price outside [0,1] or unparseable, size not positive."""
    price = F.transform(
        levels,
        lambda x: F.when(x["price"].isNull(), F.lit(f"{label}.{side}.price_text"))
        .when((x["price"] < 0) | (x["price"] > 1), F.lit(f"{label}.{side}.price_range")),
    )
    size = F.transform(
        levels,
        lambda x: F.when(x["price"].isNotNull() & F.coalesce(x["size"] <= 0, F.lit(True)), F.lit(f"{label}.{side}.size")),
    )
    return F.coalesce(F.concat(price, size), F.array(F.lit(f"{label}.{side}.ladder")))


def book_issues(label: str, bid: Column, ask: Column, bids: Column, asks: Column) -> Column:
    scalars = F.array(
        _flag((bid < 0) | (bid > 1), f"{label}.best_bid.range"),
        _flag((ask < 0) | (ask > 1), f"{label}.best_ask.range"),
        _flag(bid >= ask, f"{label}.crossed"),
    )
    return F.concat(_per_level(bids, "bid", label), _per_level(asks, "ask", label), scalars)


def tick_issues(required: dict[str, Column]) -> Column:
    """Issue codes of one silver tick; an empty array is a clean tick."""
    c = F.col
    missing = [_flag(v.isNull(), f"absent.{k}") for k, v in required.items()]
    scalars = F.array(
        *missing,
        _flag(F.coalesce(c("ts") <= 0, F.lit(True)), "ts.value"),
        _flag(c("start_ts") > c("end_ts"), "window.order"),
        _flag((c("mid") < MID_LO) | (c("mid") > MID_HI), "mid.range"),
        _flag((c("touch_pair") < TOUCH_LO) | (c("touch_pair") > TOUCH_HI), "touch_pair.range"),
    )
    tape = F.coalesce(
        F.flatten(
            F.transform(
                c("tape"),
                lambda x: F.array(
                    _flag((x["price"] < 0) | (x["price"] > 1), "tape.price"),
                    _flag(x["size"] <= 0, "tape.size"),
                ),
            )
        ),
        F.array().cast("array<string>"),
    )
    every = F.concat(
        scalars,
        book_issues("up", c("up_bid"), c("up_ask"), c("up_bids"), c("up_asks")),
        book_issues("down", c("dn_bid"), c("dn_ask"), c("dn_bids"), c("dn_asks")),
        tape,
    )
    return F.filter(every, lambda x: x.isNotNull())


def silver_required() -> dict[str, Column]:
    """Required fields as they appear in the silver layout (a book is present if its ladder is)."""
    cols = {k: F.col(k) for k in ("ts", "cid", "series", "duration", "start_ts", "end_ts")}
    return {**cols, "up_book": F.col("up_bids"), "down_book": F.col("dn_bids")}

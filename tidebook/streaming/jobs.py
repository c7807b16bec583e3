"""Streaming jobs built from streaming ticks; each returns an unstarted streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions.num import round_dp
from ..operators import windows as W
from . import processors as P
from .frames import parse_frames, recorded_messages

c = F.col
DELAY = "10 minutes"


def window_close(ticks: DataFrame, source: str = "recorded") -> DataFrame:
    """One record per window once the watermark passes its own end; windows without a mid are not recorded."""
    t = ticks.withColumn("m", W.mid_column(source)).withWatermark("at", DELAY).select("cid", "series", "end_ts", "line_no", "m", "at")
    w = t.groupBy("cid", "series").transformWithStateInPandas(P.WindowProcessor(), outputStructType=P.WindowProcessor.OUT, outputMode="Append", timeMode="EventTime")
    return w.select(
        "cid", "series", F.timestamp_seconds("end_ts").alias("end_at"), "snaps", round_dp(c("f"), 4).alias("start_mid"), round_dp(c("l"), 4).alias("close_mid"), B.classify_path(c("mx"), c("mn")).alias("class"), "reopened"
    ).filter(c("class") != "no_data")


def trade_buffer(ticks: DataFrame, width: str = "1 hour", cap: int = 5000) -> DataFrame:
    """Prints per token and round, oldest first, the newest ``cap`` kept: the drop-oldest buffer is the feature."""
    p = ticks.select("at", "line_no", F.inline("tape")).withWatermark("at", DELAY)
    rows = F.sort_array(F.collect_list(F.struct("line_no", "price", "size")))
    g = p.groupBy(F.window("at", width), c("asset").alias("token")).agg(F.count(F.lit(1)).alias("n"), rows.alias("rows"))
    return g.select("token", c("window.start").alias("round_at"), "n", F.expr(f"slice(rows, -least(size(rows), {cap}), {cap})").alias("prints"))


def silence_alert(ticks: DataFrame, width: str = "2 hours", slide: str = "1 hour", rate: float = 0.5) -> DataFrame:
    t = ticks.withWatermark("at", DELAY)
    g = t.groupBy(F.window("at", width, slide), "series").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("tape") == 0).alias("e"))
    return g.select("series", c("window.end").alias("end_at"), "n", round_dp(c("e") / c("n"), 4).alias("empty_rate"), (c("e") / c("n") > rate).alias("alert"))


def ttl_dedup(prints: DataFrame, ttl: str = "60 seconds") -> DataFrame:
    return prints.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["token", "price", "size", "ts_us"])


def aligned_snapshot(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Latest spot price and tops per series and second (or any round width)."""
    t = ticks.withColumn("spot", 100 + (c("event_id") * 31) % 97 * 0.5).withWatermark("at", DELAY)
    last = F.max_by(F.struct("spot", "up_bid", "up_ask", "dn_bid", "dn_ask"), F.struct("ts_us", "line_no"))
    g = t.groupBy(F.window("at", width), "series").agg(last.alias("x"), F.min("spot").alias("lo"), F.max("ts_us").alias("last_us"))
    return g.select("series", c("window.start").alias("round_at"), "x.spot", "x.up_bid", "x.up_ask", "x.dn_bid", "x.dn_ask", round_dp((c("x.spot") - c("lo")) / c("lo"), 8).alias("drift"), "last_us")


def session_segments(ticks: DataFrame, gap: str = "1 hour") -> DataFrame:
    t = ticks.withWatermark("at", DELAY)
    g = t.groupBy(F.session_window("at", gap), "series").agg(F.count(F.lit(1)).alias("n"))
    return g.select("series", c("session_window.start").alias("start_at"), c("session_window.end").alias("end_at"), "n")


def frames(ticks: DataFrame) -> DataFrame:
    """Token entries of the recorded messages, both legs."""
    return parse_frames(recorded_messages(ticks))


def book_state(frame_stream: DataFrame, ttl_ms: int = 2 * P.DAY_MS) -> DataFrame:
    keep = frame_stream.withWatermark("at", DELAY)
    return keep.groupBy("token").transformWithStateInPandas(P.BookProcessor(ttl_ms), outputStructType=P.BookProcessor.OUT, outputMode="Append", timeMode="EventTime")


def top_of_book_log(frame_stream: DataFrame) -> DataFrame:
    """Only frames that moved the top of book, filed by day."""
    return book_state(frame_stream).filter("changed").select("token", "event_id", "best_bid", "best_ask", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd").alias("day"))


def source_authority(ticks: DataFrame, warmup_us: int, horizon_us: int) -> DataFrame:
    """Whether each leg of a window may be trusted at each of its rows."""
    leg = lambda token: F.struct(c(token).alias("token"), F.exists("tape", lambda x: x["asset"] == c(token)).alias("printed"))
    rows = ticks.withWatermark("at", DELAY).select("event_id", "line_no", "ts_us", (c("event_id") % 401 == 0).alias("reconnect"), "at", F.inline(F.array(leg("up_token"), leg("dn_token"))))
    return rows.groupBy("token").transformWithStateInPandas(P.AuthorityProcessor(warmup_us, horizon_us), outputStructType=P.AuthorityProcessor.OUT, outputMode="Append", timeMode="EventTime")


def spot(ticks: DataFrame) -> DataFrame:
    return ticks.select("series", "event_id", "ts_us", F.when(c("event_id") % 3 == 0, "B").otherwise("A").alias("feed"), (100 + (c("event_id") * 31) % 97 * 0.5).alias("price"))


def shock_detector(ticks: DataFrame, threshold: float, range_us: int, react_us: int) -> DataFrame:
    t = ticks.withWatermark("at", DELAY).select(
        "series", "event_id", "ts_us", (100 + (c("event_id") * 31) % 97 * 0.5).alias("price"), "up_bid", "up_ask", "dn_bid", "dn_ask", ((c("up_bid") + c("up_ask")) / 2.0).alias("mid"), "at"
    )
    return t.groupBy("series").transformWithStateInPandas(P.ShockProcessor(threshold, range_us, react_us), outputStructType=P.ShockProcessor.OUT, outputMode="Append", timeMode="EventTime")


def order_state(ticks: DataFrame) -> DataFrame:
    """Order events keyed by id; every thirteenth row of an order is part of the boot snapshot."""
    e = c("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("live", "matched", "delayed", "noise", "canceled")]), (e % 5 + 1).cast("int"))
    o = ticks.withWatermark("at", DELAY).select(F.concat_ws("-", "cid", (c("user_id") % 3).cast("string")).alias("order_id"), "event_id", "ts_us", status.alias("status"), F.when(e % 13 == 0, 0).otherwise(1).alias("seed"), "at")
    return o.groupBy("order_id").transformWithStateInPandas(P.OrderProcessor(), outputStructType=P.OrderProcessor.OUT, outputMode="Append", timeMode="EventTime")

"""Silver ticks derived from the ``events`` table: a pure projection, no shuffle, full pushdown.

Every event becomes one sample of one two-outcome window. ``event_type`` is the series; two series
trade half-day windows, the others day windows. All prices start as integer thousandths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

HALF_DAY_SERIES = ("click", "view")
LADDER_DEPTH = 5


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _price(m: Column) -> Column:
    return m / 1000.0


def _ladder(best: Column, step: int, k: int, cap: int) -> Column:
    levels = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(LADDER_DEPTH - 1)),
            lambda i: F.struct((best + i * step).alias("m"), (1 + (F.col("event_id") * (i + k)) % cap).alias("s")),
        ),
        lambda x: (x["m"] > 0) & (x["m"] < 1000),
    )
    arr = F.transform(levels, lambda x: F.struct((x["m"] / 1000.0).alias("price"), x["s"].cast("double").alias("size")))
    return F.when(best.isNotNull(), arr).otherwise(F.array().cast("array<struct<price:double,size:double>>"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_from_events(load(spark, sf_dir, "events"))


def ticks_from_events(events: DataFrame, *carry: str) -> DataFrame:
    """``carry`` names columns of ``events`` that go along as they are."""
    c = F.col
    e = events.select(
        *carry, "event_id", "user_id", c("event_type").alias("series"), "value",
        F.unix_micros(c("ts").cast("timestamp")).alias("ts_us"),
    )
    e = e.withColumn("duration", F.when(c("series").isin(*HALF_DAY_SERIES), 43200).otherwise(86400))
    e = e.withColumn("start_s", F.expr("(ts_us div 1000000) div duration * duration"))
    e = e.withColumns(
        {
            "el_ms": F.expr("ts_us div 1000 - start_s * 1000"),
            "dom": F.dayofmonth(F.timestamp_seconds(c("start_s"))),
            "half": F.expr("(start_s % 86400) div 43200"),
        }
    )
    e = e.withColumns(
        {
            "slope": (c("dom") * 13 + F.length("series") * 5 + c("half") * 3) % 7 - 3,
            "step": F.expr("el_ms * 70 div (duration * 1000)"),
        }
    )
    raw = 500 + c("slope") * c("step") * 2 + (c("event_id") * 37) % 61 - 30 + (c("event_id") * 7919) % 21 - 10
    e = e.withColumn("mid_m", F.least(F.lit(995), F.greatest(F.lit(5), raw)).cast("int"))

    def gone(mod):
        return c("event_id") % mod == 0

    m = c("mid_m")
    e = e.withColumns(
        {
            "up_bid_m": F.when(~gone(29), F.when(gone(97), F.least(F.lit(999), m + 8)).otherwise(F.greatest(F.lit(1), m - 5 - c("event_id") % 3))).cast("int"),
            "up_ask_m": F.when(~gone(31), F.least(F.lit(999), m + 5 + c("event_id") % 2)).cast("int"),
            "dn_bid_m": F.when(~gone(37), F.greatest(F.lit(1), 995 - m)).cast("int"),
            "dn_ask_m": F.when(~gone(41), F.least(F.lit(999), 1005 - m + c("event_id") % 4)).cast("int"),
            "cid": F.concat_ws(":", c("series"), c("start_s").cast("string")),
        }
    )
    up_tok, dn_tok = F.concat(c("cid"), F.lit(":U")), F.concat(c("cid"), F.lit(":D"))
    to_up = c("event_id") % 2 == 0
    print_m = F.when(to_up, m - 20 + c("event_id") % 7).otherwise(980 - m + c("event_id") % 7)
    print_m = F.least(F.lit(999), F.greatest(F.lit(1), print_m))
    size = F.floor(c("value") * 100.0 + 0.5).cast("double") / 100.0
    one = F.struct(F.when(to_up, up_tok).otherwise(dn_tok).alias("asset"), _price(print_m).alias("price"), size.alias("size"))
    two = F.struct(F.when(to_up, up_tok).otherwise(dn_tok).alias("asset"), _price(F.least(F.lit(999), print_m + 30)).alias("price"), F.lit(7.0).alias("size"))
    empty = F.array().cast("array<struct<asset:string,price:double,size:double>>")
    tape = F.when(gone(5), empty).when(gone(11), F.array(one, two)).otherwise(F.array(one))
    rec_mid = F.when(gone(151), F.lit(1.05)).when(
        c("up_bid_m").isNotNull() & c("up_ask_m").isNotNull(), (c("up_bid_m") + c("up_ask_m")) / 2000.0
    )
    rec_touch = F.when(gone(149), F.lit(1.6)).when(~gone(43), (c("up_ask_m") + c("dn_ask_m")) / 1000.0)
    return e.select(
        *carry,
        "event_id",
        (c("event_id") * 10 + F.when(gone(53), 25).otherwise(0)).alias("line_no"),
        "user_id",
        "series",
        "duration",
        F.when(c("duration") == 43200, "12h").otherwise("24h").alias("label"),
        "cid",
        F.concat(c("series"), F.lit("-up-or-down-"), F.when(c("duration") == 43200, "12h").otherwise("24h"), F.lit("-"), c("start_s").cast("string")).alias("slug"),
        F.date_format(F.timestamp_seconds(c("start_s")), "yyyy-MM-dd").alias("day"),
        "ts_us",
        (c("ts_us") / 1e6).alias("ts"),
        c("start_s").cast("double").alias("start_ts"),
        (c("start_s") + c("duration")).cast("double").alias("end_ts"),
        "el_ms",
        up_tok.alias("up_token"),
        dn_tok.alias("dn_token"),
        _price(c("up_bid_m")).alias("up_bid"),
        _price(c("up_ask_m")).alias("up_ask"),
        _price(c("dn_bid_m")).alias("dn_bid"),
        _price(c("dn_ask_m")).alias("dn_ask"),
        _ladder(c("up_bid_m"), -5, 1, 50).alias("up_bids"),
        _ladder(c("up_ask_m"), 5, 3, 40).alias("up_asks"),
        _ladder(c("dn_bid_m"), -5, 2, 45).alias("dn_bids"),
        _ladder(c("dn_ask_m"), 5, 4, 35).alias("dn_asks"),
        tape.alias("tape"),
        rec_mid.alias("mid"),
        rec_touch.alias("touch_pair"),
        F.when(gone(101), F.lit("fetch failed")).alias("err"),
    )


# The same projection for an ANSI SQL engine, used as the prefix of oracle queries.
TICKS_SQL = """
WITH e0 AS (
  SELECT event_id, user_id, event_type AS series, value, epoch_us(ts) AS ts_us,
         CASE WHEN event_type IN ('click','view') THEN 43200 ELSE 86400 END AS duration
  FROM events),
e1 AS (SELECT *, ((ts_us // 1000000) // duration) * duration AS start_s FROM e0),
e2 AS (SELECT *, ts_us // 1000 - start_s * 1000 AS el_ms,
         day(to_timestamp(start_s) AT TIME ZONE 'UTC') AS dom, (start_s % 86400) // 43200 AS half FROM e1),
e3 AS (SELECT *, (dom*13 + length(series)*5 + half*3) % 7 - 3 AS slope, el_ms*70 // (duration*1000) AS step FROM e2),
e4 AS (SELECT *, CAST(least(995, greatest(5, 500 + slope*step*2 + (event_id*37)%61 - 30 + (event_id*7919)%21 - 10)) AS INT) AS mid_m,
         series || ':' || CAST(start_s AS VARCHAR) AS cid FROM e3),
e5 AS (SELECT *,
  CASE WHEN event_id%29<>0 THEN CASE WHEN event_id%97=0 THEN least(999, mid_m+8) ELSE greatest(1, mid_m-5-event_id%3) END END AS up_bid_m,
  CASE WHEN event_id%31<>0 THEN least(999, mid_m+5+event_id%2) END AS up_ask_m,
  CASE WHEN event_id%37<>0 THEN greatest(1, 995-mid_m) END AS dn_bid_m,
  CASE WHEN event_id%41<>0 THEN least(999, 1005-mid_m+event_id%4) END AS dn_ask_m,
  CASE WHEN event_id%2=0 THEN cid||':U' ELSE cid||':D' END AS p_asset,
  least(999, greatest(1, CASE WHEN event_id%2=0 THEN mid_m-20+event_id%7 ELSE 980-mid_m+event_id%7 END)) AS p_m,
  floor(value*100.0+0.5)/100.0 AS p_size
  FROM e4),
ticks AS (SELECT event_id, event_id*10 + CASE WHEN event_id%53=0 THEN 25 ELSE 0 END AS line_no, user_id, series, duration,
  CASE WHEN duration=43200 THEN '12h' ELSE '24h' END AS label, cid,
  series || '-up-or-down-' || CASE WHEN duration=43200 THEN '12h' ELSE '24h' END || '-' || CAST(start_s AS VARCHAR) AS slug,
  strftime(to_timestamp(start_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, ts_us, ts_us/1e6 AS ts,
  CAST(start_s AS DOUBLE) AS start_ts, CAST(start_s+duration AS DOUBLE) AS end_ts, el_ms,
  cid||':U' AS up_token, cid||':D' AS dn_token,
  CAST(up_bid_m AS DOUBLE)/1000.0 AS up_bid, CAST(up_ask_m AS DOUBLE)/1000.0 AS up_ask,
  CAST(dn_bid_m AS DOUBLE)/1000.0 AS dn_bid, CAST(dn_ask_m AS DOUBLE)/1000.0 AS dn_ask,
  CASE WHEN event_id%5=0 THEN [] WHEN event_id%11=0 THEN [{'asset':p_asset,'price':CAST(p_m AS DOUBLE)/1000.0,'size':p_size},
     {'asset':p_asset,'price':CAST(least(999,p_m+30) AS DOUBLE)/1000.0,'size':CAST(7.0 AS DOUBLE)}]
     ELSE [{'asset':p_asset,'price':CAST(p_m AS DOUBLE)/1000.0,'size':p_size}] END AS tape,
  CASE WHEN event_id%151=0 THEN CAST(1.05 AS DOUBLE) ELSE CAST(up_bid_m+up_ask_m AS DOUBLE)/2000.0 END AS mid,
  CASE WHEN event_id%149=0 THEN CAST(1.6 AS DOUBLE) WHEN event_id%43<>0 THEN CAST(up_ask_m+dn_ask_m AS DOUBLE)/1000.0 END AS touch_pair,
  CASE WHEN event_id%101=0 THEN 'fetch failed' END AS err,
  up_bid_m, up_ask_m, dn_bid_m, dn_ask_m
  FROM e5)
"""


def ladder_sql(best: str, step: int, k: int, cap: int) -> str:
    """One ladder side as a list expression, matching ``_ladder``."""
    rows = ", ".join(
        f"{{'price': CAST({best}+({i * step}) AS DOUBLE)/1000.0, 'size': CAST(1+(event_id*{i + k})%{cap} AS DOUBLE)}}" for i in range(LADDER_DEPTH)
    )
    return f"CASE WHEN {best} IS NULL THEN [] ELSE list_filter([{rows}], lambda x: x.price > 0 AND x.price < 1) END"

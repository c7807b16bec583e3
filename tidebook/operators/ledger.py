"""Fill telemetry, trade and wallet ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import finite, round_dp, safe_div
from .scan import Running, running

c = F.col

# Fill-ratio buckets.
BUCKETS = (("0.00-0.25", 0.0, 0.25), ("0.25-0.50", 0.25, 0.5), ("0.50-1.00", 0.5, 1.0), ("1.00+", 1.0, None))


def settle_pnl(trades: DataFrame) -> DataFrame:
    """Settlement profit per market; the last settle line wins."""
    s = trades.filter((c("action") == "WINDOW_SETTLE") & (c("market_slug") != ""))
    return s.groupBy("market_slug").agg(F.max_by("pnl_usd", "line_no").alias("settle_pnl"))


def with_settle(fills: DataFrame, trades: DataFrame) -> DataFrame:
    return fills.join(settle_pnl(trades), "market_slug", "left")


def ratio_bucket(ratio: Column) -> Column:
    """Bucket name of a finite, non-negative ratio; bound once so the ratio is not re-derived per bucket."""
    def name(r):
        out = F.lit(None).cast("string")
        for label, lo, hi in reversed(BUCKETS):
            cond = r >= lo if hi is None else (r >= lo) & (r < hi)
            out = F.when(cond, label).otherwise(out)
        return F.when(~F.isnan(r) & (r < float("inf")), out)

    return F.element_at(F.transform(F.array(ratio), name), 1)


def fill_ratio_buckets(joined: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and mean joined profit per bucket; every bucket appears, empty ones with zero fills."""
    spark = joined.sparkSession
    names = spark.createDataFrame([(b[0],) for b in BUCKETS], "bucket string")
    g = joined.withColumn("bucket", ratio_bucket(c("fill_ratio"))).filter(c("bucket").isNotNull()).groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("fills"), F.avg("settle_pnl").alias("m")
    )
    # the bucket table has four rows; the key table is the distinct keys of the ledger
    frame = joined.select(*keys).distinct().withColumn("bucket", F.explode(F.array(*[F.lit(b[0]) for b in BUCKETS]))) if keys else names
    j = frame.join(g, [*keys, "bucket"], "left")
    return j.select(*keys, "bucket", F.coalesce("fills", F.lit(0)).alias("fills"), round_dp(c("m"), 4).alias("mean_settle_pnl"))


def queue_telemetry(joined: DataFrame) -> DataFrame:
    """One tape only (socket fills if there are any), chased fills apart, and a verdict.

    Low ratios profitable and high ones not reads tape-like; the reverse reads queue-toxic.
    """
    used = joined.agg(F.coalesce(F.bool_or(c("tape_source") == "ws"), F.lit(False)).alias("ws")).select(F.when(c("ws"), "ws").otherwise("rest").alias("tape_used"))
    x = joined.join(F.broadcast(used), joined["tape_source"] == used["tape_used"])
    plain, r = ~c("chased"), c("fill_ratio")
    low, high = F.avg(F.when(plain & (r < 0.5), c("settle_pnl"))), F.avg(F.when(plain & (r >= 0.5), c("settle_pnl")))
    a = x.filter(finite(r) >= 0).groupBy("tape_used").agg(
        F.count_if(plain).alias("fills"), F.count_if("chased").alias("chased"), round_dp(F.avg(F.when(c("chased"), c("settle_pnl"))), 4).alias("chased_mean"),
        round_dp(low, 4).alias("low_mean"), round_dp(high, 4).alias("high_mean"),
    )
    lo, hi = F.coalesce(c("low_mean") > 0, F.lit(False)), F.coalesce(c("high_mean") > 0, F.lit(False))
    return a.withColumn("verdict", F.when(lo & ~hi, "tape-like").when(hi & ~lo, "queue-toxic").otherwise("mixed/unclear"))


def observer_report(trades: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return trades.groupingSets([["series"], []], "series").agg(
        n.alias("n"), round_dp(F.count_if(c("pnl_usd") > 0) / n * 100.0, 2).alias("win_pct"), F.count_if(c("action") == "PAIR_MERGE").alias("pairs"), F.count_if(c("action").contains("STOP")).alias("stops"),
        round_dp(F.sum("pnl_usd"), 2).alias("pnl"), F.min("pnl_usd").alias("worst"), round_dp(F.avg("pnl_usd"), 4).alias("avg_pnl"),
    )


def wallet_windows(activity: DataFrame) -> DataFrame:
    """Cost, proceeds, action and average entries of every window a wallet touched."""
    t, side, usd, sz = c("type"), c("side"), c("usdc_milli"), c("size")
    buy, sell = (t == "TRADE") & (side == "BUY"), (t == "TRADE") & (side == "SELL")
    total = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0))
    g = activity.groupBy(F.coalesce("condition_id", "slug").alias("window_id")).agg(
        total(buy, usd).alias("cost"), total(buy, sz).alias("shares"), total(sell, usd).alias("sells"), total(t == "MERGE", usd).alias("merges"), total(t == "REDEEM", usd).alias("redeems"),
        total(buy & (c("outcome") == "Up"), usd).alias("uc"), total(buy & (c("outcome") == "Up"), sz).alias("us"),
        total(buy & (c("outcome") == "Down"), usd).alias("dc"), total(buy & (c("outcome") == "Down"), sz).alias("ds"), F.max("ts").alias("last_ts"),
    )
    proceeds = c("sells") + c("merges") + c("redeems")
    pnl = proceeds - c("cost")
    action = (
        F.when(c("merges") > 0, "PAIR_MERGE").when((c("sells") > 0) & (c("redeems") == 0), F.when(pnl >= 0, "TAKE_PROFIT").otherwise("STOP_EXIT")).when(c("redeems") > 0, "WINDOW_SETTLE").otherwise("EXPIRED")
    )
    return g.select(
        "window_id", "last_ts", round_dp(c("cost") / 1000.0, 3).alias("cost"), "shares", action.alias("action"), round_dp(pnl / 1000.0, 2).alias("pnl_usd"),
        round_dp(safe_div(c("uc"), c("us")) / 1000.0, 3).alias("entry_up"), round_dp(safe_div(c("dc"), c("ds")) / 1000.0, 3).alias("entry_down"),
        F.when(c("shares") > 0, round_dp(proceeds / 1000.0 / F.greatest(F.lit(0.1), c("shares")), 3)).alias("exit_price"),
        round_dp(pnl / 1000.0 / F.greatest(F.lit(0.01), c("cost") / 1000.0) * 100.0, 1).alias("pnl_pct"),
    )


def cash_flow(activity: DataFrame, marker: Column, balance: float) -> DataFrame:
    """Net signed cash since the first marker row, and the opening balance it implies."""
    start = activity.agg(F.min(F.when(marker, F.struct("ts", "event_id"))).alias("start")).withColumn("k", F.lit(1))
    x = activity.withColumn("k", F.lit(1)).join(F.broadcast(start), "k").filter(F.struct("ts", "event_id") >= c("start"))
    t = c("type")
    signed = F.when((t == "TRADE") & (c("side") == "BUY"), -c("usdc_milli")).when((t == "TRADE") & (c("side") == "SELL"), c("usdc_milli")).when(t.isin("MERGE", "REDEEM"), c("usdc_milli")).otherwise(F.lit(0.0))
    return x.agg(F.count(F.lit(1)).alias("rows"), round_dp(F.sum(signed) / 1000.0, 3).alias("net_cash")).withColumn("opening_balance", round_dp(F.lit(balance) - c("net_cash"), 2))


def timeline(trades: DataFrame, opening: float, max_series: int = 1000) -> DataFrame:
    """Portfolio value after every trade, with the running profit of each market found in the data as a map."""
    series = [r.series for r in trades.select("series").distinct().orderBy("series").limit(max_series + 1).collect()]
    if len(series) > max_series:
        raise ValueError(f"more than {max_series} series")
    x = trades.withColumn("__all", F.lit(1))
    outs = [Running("total_pnl", "sum", c("pnl_usd")), Running("pairs", "count", F.when(c("action") == "PAIR_MERGE", 1)), Running("stops", "count", F.when(c("action").contains("STOP"), 1))]
    outs += [Running(f"m_{i}", "sum", F.when(c("series") == s, c("pnl_usd"))) for i, s in enumerate(series)]
    r = running(x, ["__all"], ["ts_us", "event_id"], F.floor(c("ts_us") / 86_400_000_000), outs)
    pairs = F.array(*[F.struct(F.lit(s).alias("k"), round_dp(c(f"m_{i}"), 2).alias("v")) for i, s in enumerate(series)])
    per = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    return r.select("event_id", "series", round_dp(c("total_pnl"), 2).alias("total_pnl"), round_dp(c("total_pnl") + opening, 2).alias("portfolio_value"), "pairs", "stops", per.alias("market_pnl"))


def account_value(positions: DataFrame, cash: DataFrame, key: str) -> DataFrame:
    """Position value, count, cash (or what is left of a reported total) and net per account."""
    p = positions.groupBy(key).agg(F.sum("value").alias("pv"), F.count(F.lit(1)).alias("open_positions"))
    j = p.join(cash, key, "left")
    left = F.when(c("reported_total").isNotNull(), F.greatest(F.lit(0.0), c("reported_total") - c("pv")))
    cash_v = F.coalesce(c("cash"), left, F.lit(0.0))
    net = F.when(c("cash").isNotNull(), c("cash") + c("pv")).otherwise(F.coalesce(c("reported_total"), c("pv")))
    return j.select(key, round_dp(c("pv"), 2).alias("positions_value"), "open_positions", round_dp(cash_v, 2).alias("cash_balance"), round_dp(net, 2).alias("net_value"))

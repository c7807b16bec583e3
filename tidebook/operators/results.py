"""Aggregates over per-window outcomes: rollups, drawdown, sweep and EV metrics, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import round_dp, safe_div

MIN_FILLED = 30
MIN_SIZE = 5


def day_slice() -> Column:
    return F.floor(F.col("first_ts") / 86400).cast("bigint")


def net(size: int = MIN_SIZE) -> Column:
    return (F.col("pnl") - F.col("fees")) * float(max(MIN_SIZE, int(size)))


def max_drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, slice_by: Column, out: str = "max_drawdown") -> DataFrame:
    """Largest fall of the running total below its running peak (the peak starts at zero).

    Each (key, slice) is reduced to its total, highest and lowest prefix and own drawdown; slices are
    then chained per key. A key with most of the rows is spread over its slices.
    """
    part = [*keys, "__s"]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    a = df.withColumn("__s", slice_by).withColumn("__c", F.sum(value).over(w))
    a = a.withColumn("__p", F.max("__c").over(w))
    s = a.groupBy(*part).agg(
        F.sum(value).alias("t"), F.max("__c").alias("hi"), F.min("__c").alias("lo"), F.max(F.col("__p") - F.col("__c")).alias("dd")
    )
    prev = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("c0", F.coalesce(F.sum("t").over(prev), F.lit(0.0)))
    s = s.withColumn("p0", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("c0") + F.col("hi")).over(prev), F.lit(0.0))))
    fall = F.greatest(F.lit(0.0), F.col("dd"), F.col("p0") - F.col("c0") - F.col("lo"))
    return s.groupBy(*keys).agg(F.max(fall).alias(out))


def with_levels(df: DataFrame, levels: Sequence[tuple[str, Column]]) -> DataFrame:
    """One copy of each row per grouping level, as (level, grp); used where a level needs an ordered scan."""
    pairs = F.array(*[F.struct(F.lit(n).alias("level"), g.cast("string").alias("grp")) for n, g in levels])
    return df.select("*", F.inline(pairs))


def replay_levels() -> list[tuple[str, Column]]:
    return [("series", F.col("series")), ("duration", F.col("duration")), ("overall", F.lit("all"))]


def replay_rollup(o: DataFrame) -> DataFrame:
    """Per series, per duration and overall, in one pass over the outcomes via grouping sets."""
    c = F.col
    n = F.count(F.lit(1))
    entered = F.count_if("entered")
    pairs = F.count_if(c("kind") == "pair")
    exits = F.count_if(c("kind").isin("stop", "dead_zone"))
    g = o.groupingSets([["series"], ["duration"], []], "series", "duration").agg(
        n.alias("windows"),
        entered.alias("entered"),
        round_dp(entered / n, 4).alias("entered_rate"),
        round_dp(pairs / n, 4).alias("pair_rate"),
        F.coalesce(round_dp(safe_div(pairs, entered), 4), F.lit(0.0)).alias("pair_rate_entered"),
        round_dp(exits / n, 4).alias("exit_rate"),
        F.count_if(c("filled_up") & ~c("filled_dn")).alias("filled_up_only"),
        F.count_if(c("filled_dn") & ~c("filled_up")).alias("filled_down_only"),
        F.count_if(c("class") == "oscillating").alias("oscillating"),
        F.count_if(c("class") == "monotonic").alias("monotonic"),
        F.count_if(c("class") == "flat").alias("flat"),
        round_dp(F.sum("pnl"), 3).alias("total_pnl"),
        round_dp(F.avg("pnl"), 4).alias("avg_pnl"),
        round_dp(F.sum("fees"), 3).alias("total_fees"),
        round_dp(F.count_if(c("pnl") > 0) / n, 4).alias("win_rate"),
        pairs.alias("pairs_count"),
        exits.alias("stops_count"),
        round_dp(F.avg("pair_cost"), 4).alias("mean_pair_cost"),
        round_dp(F.avg("pair_edge"), 4).alias("mean_pair_edge"),
    )
    return g


def profit_factor(v: Column) -> Column:
    gains = F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0))
    losses = F.coalesce(-F.sum(F.when(v < 0, v)), F.lit(0.0))
    return F.when(losses > 0, gains / losses).when(gains > 0, F.lit(999.0)).otherwise(F.lit(0.0))


def sharpe(v: Column) -> Column:
    sd = F.stddev_samp(v)
    return F.when(sd > 0, F.avg(v) / sd * F.sqrt(F.count(v))).otherwise(F.lit(0.0))


def sweep_metrics(o: DataFrame, size: int = MIN_SIZE, levels: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """Per config (and per level group): net totals, rates, drawdown and risk ratios."""
    c = F.col
    levels = levels or [("overall", F.lit("all"))]
    x = with_levels(o.withColumn("net", net(size)), levels)
    keys = ["config_id", "level", "grp"]
    n, v = F.count(F.lit(1)), c("net")
    m = x.groupBy(*keys).agg(
        n.alias("n_windows"),
        F.count_if(c("filled_up") | c("filled_dn")).alias("filled_windows"),
        round_dp(F.count_if(c("kind") == "pair") / n, 4).alias("pair_rate"),
        round_dp(F.count_if(c("kind").isin("stop", "dead_zone")) / n, 4).alias("exit_rate"),
        round_dp(F.count_if(v > 0) / n, 4).alias("win_rate"),
        round_dp(F.sum(v), 2).alias("total_pnl"),
        round_dp(F.avg(v), 4).alias("avg_pnl"),
        round_dp(F.sum("fees") * float(max(MIN_SIZE, size)), 2).alias("total_fees"),
        round_dp(profit_factor(v), 2).alias("profit_factor"),
        round_dp(sharpe(v), 2).alias("sharpe_proxy"),
    )
    dd = max_drawdown(x, keys, ["first_ts", "first_seq"], "net", day_slice())
    return m.join(dd.withColumn("max_drawdown", round_dp(c("max_drawdown"), 2)), keys)


def sample_gate(metrics: DataFrame, min_filled: int = MIN_FILLED) -> DataFrame:
    return metrics.filter(F.col("filled_windows") >= min_filled)


def naked_settle() -> Column:
    return (F.col("filled_up") != F.col("filled_dn")) & F.col("kind").isin("settle")


def ev_summary(o: DataFrame, size: int = MIN_SIZE) -> DataFrame:
    """Report metrics of one outcome set; a zero-shaped row when it is empty."""
    c = F.col
    s = float(max(MIN_SIZE, size))
    x = o.withColumn("net", net(size))
    n, v = F.count(F.lit(1)), c("net")
    pair, exited, naked = c("kind") == "pair", c("kind").isin("stop", "dead_zone"), naked_settle()

    def rate(k):
        return F.coalesce(round_dp(safe_div(k, n), 6), F.lit(0.0))

    def mean_of(cond):
        return F.coalesce(round_dp(F.avg(F.when(cond, v)), 4), F.lit(0.0))

    def total_of(cond):
        return F.coalesce(round_dp(F.sum(F.when(cond, v)) / 100.0, 4), F.lit(0.0))

    capital = F.coalesce(F.sum("capital"), F.lit(0.0)) * s / 100.0
    total = F.coalesce(F.sum(v), F.lit(0.0))
    return x.agg(
        n.alias("n"), F.count_if(pair).alias("pairs"), rate(F.count_if(pair)).alias("pair_rate"), F.count_if(exited).alias("exits"), rate(F.count_if(exited)).alias("exit_rate"),
        F.count_if(naked).alias("naked_settle"), rate(F.count_if(v > 0)).alias("win_rate"), round_dp(total / 100.0, 4).alias("total_pnl_usd"),
        F.coalesce(round_dp(F.avg(v), 4), F.lit(0.0)).alias("mean_net_cents"),
        F.when(capital > 0, round_dp(total / 100.0 / capital * 100.0, 4)).otherwise(F.lit(0.0)).alias("roi_pct"),
        round_dp(capital, 4).alias("capital_usd"), round_dp(profit_factor(v), 4).alias("profit_factor"), F.coalesce(round_dp(sharpe(v), 4), F.lit(0.0)).alias("sharpe_proxy"),
        mean_of(pair).alias("pair_mean_c"), total_of(pair).alias("pair_total_usd"), mean_of(exited).alias("exit_mean_c"), total_of(exited).alias("exit_total_usd"),
        mean_of(naked).alias("naked_mean_c"), total_of(naked).alias("naked_total_usd"), F.count_if(~c("filled_up") & ~c("filled_dn")).alias("no_fill"),
    )


def grouped_ci(o: DataFrame, size: int = MIN_SIZE) -> DataFrame:
    """Four groupings in one pass, each with a normal-approximation lower bound."""
    c = F.col
    x = o.withColumn("net", net(size))
    v, n = c("net"), F.count(F.lit(1))
    sd = F.when(n > 1, F.stddev_samp(v)).otherwise(F.lit(0.0))
    return x.groupingSets([["series"], ["day"], ["duration"], ["class"]], "series", "day", "duration", "class").agg(
        n.alias("n"), F.count_if(c("kind") == "pair").alias("pairs"), F.count_if(c("kind").isin("stop", "dead_zone")).alias("exits"),
        round_dp(F.count_if(v > 0) / n, 6).alias("win_rate"), round_dp(F.avg(v), 4).alias("mean_net_cents"), round_dp(F.sum(v) / 100.0, 4).alias("total_usd"),
        round_dp(F.avg(v) - 1.96 * sd / F.sqrt(n), 4).alias("ci95_lo_approx"),
    )


def histogram(o: DataFrame, value: Column, width: float) -> DataFrame:
    """Counts per [lo, lo+width) bucket with zero on an edge; one bucket when nothing varies."""
    x = o.select(value.alias("v"))
    spread = x.agg((F.max("v") > F.min("v")).alias("varies"))
    b = x.groupBy(F.floor(F.col("v") / width).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    j = b.withColumn("k", F.lit(1)).join(spread.withColumn("k", F.lit(1)), "k")
    return j.groupBy(F.when(F.col("varies"), F.col("b")).otherwise(F.lit(0)).alias("b")).agg(F.sum("n").alias("n")).select(
        (F.col("b") * width).alias("lo"), ((F.col("b") + 1) * width).alias("hi"), "n"
    )

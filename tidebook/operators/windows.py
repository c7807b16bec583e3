"""Window (market) summaries, path classes and per-series tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions.num import decimilli, round_dp
from ..functions.quality import bounds_violation
from .agg import by_window
from .scan import Running, running

MID_SOURCES = ("recorded", "up_book", "two_sided")


def mid_column(source: str = "recorded") -> Column:
    """The mid a window is judged on: as recorded, from the up book, or from both books."""
    if source == "recorded":
        return F.col("mid")
    if source == "up_book":
        return B.mid(F.col("up_bid"), F.col("up_ask"))
    if source == "two_sided":
        return B.two_sided_mid(*[F.col(c) for c in ("up_bid", "up_ask", "dn_bid", "dn_ask")])
    raise ValueError(f"mid source must be one of {MID_SOURCES}")


def upper_middle(col: str) -> Column:
    """Element n//2 of the ascending values; the aggregate keeps value counts, not rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{col}` DESC)")


def index_quantile(col: str, q: float) -> Column:
    """Element int(n*q) (capped at n-1) of the ascending values."""
    return F.expr(f"percentile_disc({round(1.0 - q, 6)}) WITHIN GROUP (ORDER BY `{col}` DESC)")


def tick_slice(minutes: int = 10) -> Column:
    """Time slices along a window, the carry unit of ordered scans."""
    return F.floor(F.col("el_ms") / (minutes * 60_000)).cast("bigint")


def arrival_slice(rows: int = 200_000) -> Column:
    """Slices of the arrival ordinal."""
    return F.floor(F.col("line_no") / (rows * 10)).cast("bigint")


def _filled(c: str) -> Column:
    """First non-empty value in arrival order."""
    v = F.col(c)
    return F.min_by(v, F.when(v.isNotNull() & (v.cast("string") != ""), F.col("line_no"))).alias(c)


def finalize(ticks: DataFrame, source: str = "recorded") -> DataFrame:
    """One record per window; a single partially aggregated shuffle on ``cid``."""
    t = ticks.filter(F.col("cid").isNotNull() & (F.col("cid") != "")).withColumn("__m", mid_column(source))
    m, seen = F.col("__m"), F.when(F.col("__m").isNotNull(), F.col("line_no"))
    agg = t.groupBy("cid").agg(
        *[_filled(c) for c in ("series", "label", "duration", "slug", "start_ts", "end_ts")],
        F.max("ts").alias("closed_ts"),
        F.count(F.lit(1)).alias("snaps"),
        F.min_by(m, seen).alias("__first"),
        F.max_by(m, seen).alias("__last"),
        F.min(m).alias("__min"),
        F.max(m).alias("__max"),
        upper_middle("touch_pair").alias("__touch"),
        F.min("ts").alias("first_ts"),
        F.min("line_no").alias("first_seq"),
    )
    zero = F.lit(0.0)
    return agg.select(
        "cid", "series", "label", "duration", "slug", "start_ts", "end_ts", "closed_ts", "snaps", "first_ts", "first_seq",
        round_dp(F.col("__first"), 4).alias("start_mid"),
        round_dp(F.col("__last"), 4).alias("close_mid"),
        round_dp(F.col("__min"), 4).alias("min_mid"),
        round_dp(F.col("__max"), 4).alias("max_mid"),
        F.coalesce(round_dp(F.col("__max") - 0.5, 4), zero).alias("max_up"),
        F.coalesce(round_dp(0.5 - F.col("__min"), 4), zero).alias("max_down"),
        B.classify_path(F.col("__max"), F.col("__min")).alias("class"),
        round_dp(F.col("__touch"), 4).alias("touch_pair_median"),
    )


def series_dim(df: DataFrame) -> DataFrame:
    return df.select("series", "duration").distinct()


def series_summary(windows: DataFrame, dim: DataFrame) -> DataFrame:
    """Zero-filled per-series table over the dimension."""
    exc = F.greatest(decimilli(F.col("max_up")), decimilli(F.col("max_down")))
    agg = windows.filter(F.col("series") != "").groupBy("series").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(exc >= 200).alias("any_2c"),
        F.count_if(exc >= 300).alias("any_3c"),
        F.count_if(F.col("class") == "oscillating").alias("oscillating"),
        F.count_if(F.col("class") == "monotonic").alias("monotonic"),
        F.count_if(F.col("class") == "flat").alias("flat"),
        upper_middle("touch_pair_median").alias("pair_cost_median"),
    )
    counts = ["windows", "any_2c", "any_3c", "oscillating", "monotonic", "flat"]
    return dim.join(agg, "series", "left").na.fill(0, counts)


def newest_per_series(windows: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` windows of each series.

    A bounded top-n per (series, end day) runs first, so the final ranking of a series sees at
    most n rows per day instead of the whole series.
    """
    order = [F.col("end_ts").desc(), F.col("cid").asc()]
    pre = Window.partitionBy("series", "__d").orderBy(*order)
    fin = Window.partitionBy("series").orderBy(*order)
    w = windows.withColumn("__d", F.floor(F.col("end_ts") / 86400))
    w = w.withColumn("__r", F.row_number().over(pre)).filter(F.col("__r") <= n)
    return w.withColumn("rank", F.row_number().over(fin)).filter(F.col("rank") <= n).drop("__r", "__d")


def gaps_and_reversals(ticks: DataFrame, keys: Sequence[str] = ("cid",), max_gap: float = 6.0, slice_by: Column | None = None) -> DataFrame:
    """Per-tick gap to the previous tick in arrival order (a sort on ts would hide reversals)."""
    cut = arrival_slice() if slice_by is None else slice_by
    out = running(ticks, list(keys), ["line_no"], cut, [Running("prev_ts_us", "prev", F.col("ts_us"))])
    delta = (F.col("ts_us") - F.col("prev_ts_us")) / 1e6
    return out.withColumns({"gap_sec": delta, "is_reversal": delta < 0, "is_gap": delta > max_gap})


def window_continuity(
    ticks: DataFrame, max_gap: float = 6.0, max_delay: float = 5.0, keys: Sequence[str] = ("cid",), slice_by: Column | None = None
) -> DataFrame:
    """Counts of gaps and reversals, delays at both ends, error and bounds counts, per window."""
    slim = ticks.select(
        *keys, *[c for c in ("series", "slug", "duration", "start_ts", "end_ts", "ts", "ts_us", "line_no", "err", "mid", "touch_pair") if c not in keys]
    )
    g = gaps_and_reversals(slim, keys, max_gap, slice_by)
    arrival = F.col("line_no")
    specs = {n: ("first", F.col(n)) for n in ("duration", "start_ts", "end_ts")}
    specs |= {
        "first_ts": ("first", F.col("ts")), "last_ts": ("last", F.col("ts")), "tick_count": ("count", F.lit(True)), "gaps_count": ("count", F.col("is_gap")),
        "max_gap_sec": ("max", F.when(F.col("is_gap"), F.col("gap_sec"))), "time_reversals": ("count", F.col("is_reversal")),
        "error_ticks": ("count", F.coalesce(F.col("err"), F.lit("")) != ""), "bounds_violations": ("count", bounds_violation(F.col("mid"), F.col("touch_pair"))),
    }
    meta = [m for m in ("series", "slug") if m not in keys]
    agg = by_window(g, keys, meta, F.col("line_no"), specs)
    delay = F.when(F.col("start_ts") > 0, F.greatest(F.lit(0.0), F.col("first_ts") - F.col("start_ts"))).otherwise(F.lit(0.0))
    cutoff = F.when(F.col("end_ts") > 0, F.greatest(F.lit(0.0), F.col("end_ts") - F.col("last_ts"))).otherwise(F.lit(0.0))
    return agg.withColumns(
        {
            "late_start": delay > max_delay,
            "early_cutoff": cutoff > max_delay,
            "start_delay_sec": round_dp(delay, 2),
            "end_cutoff_sec": round_dp(cutoff, 2),
            "span_sec": round_dp(F.greatest(F.lit(0.0), F.col("last_ts") - F.col("first_ts")), 2),
            "max_gap_sec": round_dp(F.coalesce(F.col("max_gap_sec"), F.lit(0.0)), 2),
        }
    )

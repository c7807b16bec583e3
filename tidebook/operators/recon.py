"""Feed reconciliation: nearest reference, comparison buckets, divergence tables."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.num import round_dp
from .scan import Running, running

# Fixed values.
TOLERANCE = 0.001
EDGE = TOLERANCE + TOLERANCE * 1e-6
FRESHNESS_S = 0.5
GATED_TYPES = ("price_change", "best_bid_ask")

c = F.col


def gap_bucket(gap: Column) -> Column:
    return (
        F.when(gap <= 0, "exact").when(gap <= EDGE, "sub_tick").when(gap <= 3 * TOLERANCE + TOLERANCE * 1e-6, "1_3_ticks").when(gap.isNotNull(), ">3_ticks")
    )


def age_bucket(age: Column) -> Column:
    return F.when(age.isNull(), "unknown").when(age <= 0.05, "le_50ms").when(age <= 0.1, "le_100ms").when(age <= 0.25, "le_250ms").otherwise("le_500ms")


def skew_bucket(rest_us: Column, ws_us: Column) -> Column:
    return F.when(rest_us.isNull() | (ws_us <= 0), "unknown").when(rest_us > ws_us, "rest_after_ws").otherwise("rest_before_ws")


def checkability(ev_type: Column, decl_bb: Column, decl_ba: Column) -> Column:
    return F.when(ev_type.isin(*GATED_TYPES) & (decl_bb.isNotNull() | decl_ba.isNotNull()), "gated").otherwise("blind")


class Reads:
    """Reads of one token and time bucket that stand above a line, in the order of their times."""

    def __init__(self):
        self.at, self.books = [], []

    def add(self, rx: int, line: int, book: tuple) -> None:
        insort(self.at, (rx, line, len(self.books)))
        self.books.append(book)

    def nearest(self, rx: int, width: int):
        """(rx, bb, ba) of the read nearest to ``rx`` and within ``width`` of it, of equals the earliest line; else nothing."""
        at, i = self.at, bisect_left(self.at, (rx,))
        ends = at[i : i + 1]
        if i:
            ends.append(at[bisect_left(at, (at[i - 1][0],))])
        near = min(((abs(t - rx), line, n, t) for t, line, n in ends), default=None)
        return None if near is None or near[0] > width else (near[3], *self.books[near[2]])


def nearest_above(rows: DataFrame, width: int) -> DataFrame:
    """Frames of (token, k, is_read, ...) with ``near``, the nearest read above each in its (token, k).

    Spark deals the buckets and sorts them by line; a task passes through them once and holds the reads of one bucket, so a frame
    costs the logarithm of its bucket, however dense the reads are.
    """
    kept = [f for f in rows.schema if f.name not in ("k", "is_read")]
    out = StructType([*kept, *[StructField(n, t) for n, t in (("n_rx", LongType()), ("n_bb", DoubleType()), ("n_ba", DoubleType()))]])

    def run(batches):
        group, reads = None, Reads()
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in ("token", "k", "is_read", "line", "rx_us")), strict=True)
            bb, ba = batch.column("bb"), batch.column("ba")
            frames, found = [], []
            for i, (token, k, is_read, line, rx) in enumerate(keys):
                if group != (token, k):
                    group, reads = (token, k), Reads()
                if is_read:
                    reads.add(rx, line, (bb[i].as_py(), ba[i].as_py()))
                else:
                    frames.append(i)
                    found.append(reads.nearest(rx, width) if k >= 0 else None)
            part = batch.select([f.name for f in kept]).take(pa.array(frames, pa.int64()))
            near = [pa.array([None if x is None else x[j] for x in found], kind) for j, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *near], names=out.names)

    return rows.repartition("token", "k").sortWithinPartitions("token", "k", "line", "is_read").mapInArrow(run, out)


def nearest_reference(lines: DataFrame, tolerance_s: float = FRESHNESS_S, slice_lines: int = 1_000_000) -> DataFrame:
    """Each socket frame with the reference read nearest to it in time, or the reason it has none.

    Only reads above the frame in the file (``line``) are known to it, while their receive times may lie on either side of the
    frame's. Frames lie in time buckets of four tolerances, and a read goes to every bucket that it may serve, two at most; each bucket
    is passed through along its lines (``nearest_above``; of equals the earliest line). A frame without a receive time takes the last
    read above it, which is carried along the lines, as is whether there is any.
    """
    width = int(tolerance_s * 1e6)
    book = F.struct(c("rx_us").alias("rx"), c("bb").alias("bb"), c("ba").alias("ba"))
    above = Running("above", "last", F.when(c("type") == "rest", book))
    bucket = lambda us: F.floor(us / (4 * width)).cast("bigint")
    frames = running(lines, ["token"], ["line"], F.floor(c("line") / slice_lines), [above]).filter(c("type") == "ws")
    untimed = -1 - F.pmod(F.xxhash64("line"), F.lit(1024))
    frames = frames.withColumns({"k": F.when(c("rx_us") > 0, bucket(c("rx_us"))).otherwise(untimed), "is_read": F.lit(False)})
    reads = lines.filter((c("type") == "rest") & c("rx_us").isNotNull() & c("line").isNotNull())
    reads = reads.select("token", "line", "rx_us", "bb", "ba", F.explode(F.sequence(bucket(c("rx_us") - width), bucket(c("rx_us") + width))).alias("k"), F.lit(True).alias("is_read"))
    met = nearest_above(frames.unionByName(reads.filter("k >= 0"), allowMissingColumns=True), width)
    near = F.when(c("n_rx").isNotNull(), F.struct(c("n_rx").alias("rx"), c("n_bb").alias("bb"), c("n_ba").alias("ba")))
    out = met.withColumn("ref", F.when(c("rx_us") > 0, near).otherwise(c("above"))).drop("n_rx", "n_bb", "n_ba")

    def off(a, b):
        return F.coalesce(F.abs(a - b) > EDGE, F.lit(False))

    guard = off(c("decl_bb"), c("ref.bb")) | off(c("decl_ba"), c("ref.ba"))
    blank = (c("ref.bb").isNull() & c("ref.ba").isNull()) | (c("bb").isNull() & c("ba").isNull())
    reason = (
        F.when(c("above").isNull(), "no_snapshot").when(c("ref").isNull(), "outside_freshness_window").when(guard, "guard_reject").when(blank, "no_comparable_quotes")
    )
    return out.withColumn("reason", reason).drop("above")


def comparisons(nearest: DataFrame) -> DataFrame:
    """Gaps, buckets and divergence flags of every frame; reference columns are NULL on excluded frames."""
    kept = c("reason").isNull()
    d_bb, d_ba = F.abs(c("bb") - c("ref.bb")), F.abs(c("ba") - c("ref.ba"))
    gap = F.when(kept, F.greatest(d_bb, d_ba))
    in_gap = F.greatest(F.abs(c("bb") - c("decl_bb")), F.abs(c("ba") - c("decl_ba")))
    age = F.when(kept & (c("rx_us") > 0), (c("rx_us") - c("ref.rx")) / 1e6)
    return nearest.select(
        "token", "series", "rx_us", "line", "event_id", "ev_type", "reason", kept.alias("compared"), gap.alias("gap"), in_gap.alias("in_gap"),
        F.coalesce(gap > EDGE, F.lit(False)).alias("divergent"), F.coalesce(in_gap > EDGE, F.lit(False)).alias("in_divergent"), age.alias("age"),
        F.when(kept, checkability(c("ev_type"), c("decl_bb"), c("decl_ba"))).alias("check"), F.when(kept, skew_bucket(c("ref.rx"), c("rx_us"))).alias("skew"),
        F.when(kept, age_bucket(age)).alias("age_bucket"), gap_bucket(gap).alias("magnitude"),
    )


def by_type(cmp: DataFrame) -> DataFrame:
    """Per event type; rates are NULL on an empty denominator."""
    n = F.count_if("compared")
    return cmp.groupBy("ev_type").agg(
        F.count(F.lit(1)).alias("events"), n.alias("comparisons"), F.count_if("in_divergent").alias("in_frame_divergences"), F.count_if("divergent").alias("rest_divergences"),
        round_dp(F.count_if("divergent") / F.nullif(n, F.lit(0)), 4).alias("divergence_rate"),
        round_dp(F.count_if("in_divergent") / F.count(F.lit(1)), 4).alias("in_frame_rate"),
        round_dp(F.greatest(F.max(F.when(c("divergent"), c("gap"))), F.max(F.when(c("in_divergent"), c("in_gap")))), 6).alias("max_gap"),
    )


def by_population(cmp: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return cmp.filter("compared").groupBy("check").agg(n.alias("comparisons"), F.count_if("divergent").alias("divergences"), round_dp(F.count_if("divergent") / n, 4).alias("rate"))


def histograms(cmp: DataFrame) -> DataFrame:
    """Magnitude, age (all and divergent), skew and exclusion counts as one long table from one pass."""
    def entry(kind, key):
        return F.when(key.isNotNull(), F.struct(F.lit(kind).alias("histogram"), key.alias("bucket")))

    rows = F.filter(
        F.array(
            entry("magnitude", c("magnitude")), entry("magnitude", gap_bucket(c("in_gap"))), entry("age", c("age_bucket")),
            entry("age_divergent", F.when(c("divergent"), c("age_bucket"))), entry("skew", F.when(c("gap").isNotNull(), c("skew"))), entry("excluded", c("reason")),
        ),
        lambda x: x.isNotNull(),
    )
    return cmp.select(F.inline(rows)).groupBy("histogram", "bucket").agg(F.count(F.lit(1)).alias("n"))


def by_series(cmp: DataFrame) -> DataFrame:
    x = cmp.filter("compared")
    n = F.count(F.lit(1))
    return x.groupBy("series").agg(
        n.alias("comparisons"), F.count_if("divergent").alias("divergences"), round_dp(F.count_if("divergent") / n, 4).alias("rate"), round_dp(F.max("gap"), 6).alias("max_gap"),
        *[F.count_if(c("magnitude") == b).alias(f"n_{n_}") for b, n_ in (("exact", "exact"), ("sub_tick", "sub_tick"), ("1_3_ticks", "1_3"), (">3_ticks", "over_3"))],
    )


def first_divergence(cmp: DataFrame) -> DataFrame:
    hit = c("divergent") | c("in_divergent")
    at = F.when(hit, c("line"))
    return cmp.agg(F.min_by(F.struct("token", "ev_type", "rx_us", F.when(c("in_divergent"), "in_frame").otherwise("rest").alias("source")), at).alias("f")).select("f.*")


def shadow_stats(cmp_books: DataFrame) -> DataFrame:
    """Mean and max absolute deltas, each over its own population, with gated and blind rates."""
    gated, blind = c("check") == "gated", c("check") == "blind"
    return cmp_books.groupBy("series").agg(
        F.count(F.lit(1)).alias("comparisons"),
        round_dp(F.avg("d_bb"), 6).alias("mean_abs_bb"), round_dp(F.avg("d_ba"), 6).alias("mean_abs_ba"), round_dp(F.avg("d_mid"), 6).alias("mean_abs_mid"),
        round_dp(F.max("d_bb"), 6).alias("max_bb"), round_dp(F.max("d_ba"), 6).alias("max_ba"),
        round_dp(F.count_if(gated & c("divergent")) / F.nullif(F.count_if(gated), F.lit(0)), 4).alias("rate_gated"),
        round_dp(F.count_if(blind & c("divergent")) / F.nullif(F.count_if(blind), F.lit(0)), 4).alias("rate_blind"),
    )

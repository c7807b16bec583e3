"""Exact order statistics of any number of distinct values, with bounded state.

A wanted rank starts with the range of its group's values. Each round counts the values of every open range in ``bins`` equal
parts, keeps the part that holds the rank, and narrows it to the least and largest value seen there, until these are one: that is
the value at the rank. Counts are partially aggregated in every task, so a round shuffles at most ``bins`` rows a range and task;
values are never sorted or gathered, however many they are and however unevenly they fall on groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

c = F.col
#: open ranges up to which their table is sent to every task
SENT = 100_000


def _scale(log: bool):
    """A non-decreasing map of doubles to bin by: even, or by size, so that neither clusters nor long tails need many rounds."""
    by_size = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 800))
    return by_size if log else lambda x: x / 2


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, wants: DataFrame, bins: int = 4096) -> DataFrame:
    """(keys, rank, value): the element at each 0-based ``rank`` of ``wants`` (keys, rank) among a group's ascending values.

    Null values and null keys take no part; a rank outside a group gives no row.
    """
    keys = list(keys)
    rows = cut(df.select(*keys, c(value).cast("double").alias("v")).filter(c("v").isNotNull()), "rank-values")
    bounds = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    open_ = wants.select(*keys, "rank").distinct().join(bounds, keys).filter((c("rank") >= 0) & (c("rank") < c("n"))).drop("n").withColumn("below", F.lit(0).cast("bigint"))
    done, turn = None, -1
    while True:
        turn += 1
        open_ = cut(open_, "rank-ranges")
        found = open_.filter(c("lo") == c("hi")).select(*keys, "rank", c("lo").alias("value"))
        done = found if done is None else done.unionByName(found)
        rest = open_.filter(c("lo") < c("hi"))
        ranges = rest.select(*keys, "lo", "hi").distinct()
        many = ranges.count()
        if not many:
            return done
        near = rows.join(F.broadcast(ranges) if many <= SENT else ranges, keys).filter((c("v") >= c("lo")) & (c("v") <= c("hi")))
        by = _scale(log=turn % 2 == 1)
        share = F.try_divide(by(c("v")) - by(c("lo")), by(c("hi")) - by(c("lo")))
        apart = F.when(c("v") > c("lo"), bins - 1).otherwise(0)  # where doubles cannot tell the ends apart, the least value is split off
        bin_ = F.coalesce(F.when((c("v") > c("lo")) & (c("v") < c("hi")), F.least(F.floor(share * bins), F.lit(bins - 1))), apart)
        counts = near.groupBy(*keys, "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin"))
        counts = counts.withColumn("upto", upto)
        at = c("rank") - c("below")
        inside = rest.join(counts, [*keys, "lo", "hi"]).filter((at >= c("upto") - c("n")) & (at < c("upto")))
        open_ = inside.select(*keys, "rank", c("a").alias("lo"), c("b").alias("hi"), (c("below") + c("upto") - c("n")).alias("below"))


def _places(kind: str, q: float) -> tuple[Column, Column, Column]:
    """(lower rank, upper rank, weight of the upper) of one definition in a group of ``n``."""
    n = c("n")
    if kind == "linear":
        at = F.lit(q) * (n - 1)
        return F.floor(at), F.ceil(at), at - F.floor(at)
    if kind == "index":
        return (at := F.least(n - 1, F.floor(n * F.lit(q)))), at, F.lit(0.0)
    if kind == "upper":
        return (at := F.floor(n / 2)), at, F.lit(0.0)
    if kind == "exclusive":
        four = (n + 1) * F.lit(round(q * 4))
        j = F.greatest(F.lit(1), F.least(n - 1, F.floor(four / 4)))
        one = n == 1
        return F.when(one, 0).otherwise(j - 1), F.when(one, 0).otherwise(j), F.when(one, 0.0).otherwise((four - j * 4) / 4.0)
    raise ValueError(f"unknown quantile {kind!r}")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wants: Mapping[str, tuple[str, float]], bins: int = 4096) -> DataFrame:
    """Per group the count ``n`` of values and one column for every wanted (definition, fraction).

    Definitions: ``linear`` interpolates at q * (n - 1), ``index`` takes element floor(n * q), ``upper`` element n // 2, ``exclusive``
    quartiles interpolate at q * (n + 1).
    """
    keys = list(keys)
    n = cut(df.filter(c(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "rank-counts")
    places = {name: _places(*want) for name, want in wants.items()}
    at = n.select(*keys, "n", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), a.cast("bigint").alias("lower"), b.cast("bigint").alias("upper"), w.cast("double").alias("w")) for k, (a, b, w) in places.items()])))
    ranks = at.select(*keys, F.explode(F.array("lower", "upper")).alias("rank"))
    values = cut(select_ranks(df, keys, value, ranks, bins), "rank-found")
    low = values.select(*keys, c("rank").alias("lower"), c("value").alias("x"))
    high = values.select(*keys, c("rank").alias("upper"), c("value").alias("y"))
    told = at.join(low, [*keys, "lower"]).join(high, [*keys, "upper"]).withColumn("q", c("x") * (1 - c("w")) + c("y") * c("w"))
    return told.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(c("name") == k, c("q"))).alias(k) for k in wants])


def levels(df: DataFrame, key: str, name: str = "overall") -> DataFrame:
    """Every row under its group and under ``name``, for figures by group and over all."""
    return df.withColumn(key, F.explode(F.array(c(key), F.lit(name))))

"""Resampling and order statistics as grouped Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence
from math import e, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import round_dp
from .scan import Running, running

# cumulative Poisson(1) probabilities, as far as a double tells them from 1
POISSON_CDF = tuple(round(sum(1 / factorial(j) for j in range(k + 1)) / e, 15) for k in range(17))


def unit_hash(*parts: Column) -> Column:
    """A reproducible uniform in [0,1) from the md5 of the parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_weight(u: Column) -> Column:
    w = F.lit(0)
    for p in POISSON_CDF:
        w = w + F.when(u >= p, 1).otherwise(0)
    return w


def bootstrap_means(df: DataFrame, value: str, row_id: str, n_boot: int, seed: int, weight: str | None = None) -> DataFrame:
    """Replicate means under Poisson resampling. Rows explode inside the map stage and are reduced to
    ``n_boot`` partial sums per task before the shuffle."""
    x = df.select(F.col(value).alias("v"), F.col(row_id).alias("id"), (F.col(weight) if weight else F.lit(1)).alias("m"))
    x = x.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    x = x.withColumn("w", poisson_weight(unit_hash(F.lit(seed), F.col("b"), F.col("id"))) * F.col("m"))
    g = x.groupBy("b").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("k"))
    return g.filter(F.col("k") > 0).select("b", (F.col("s") / F.col("k")).alias("mean"))


def bootstrap_ci(df: DataFrame, value: str, row_id: str, n_boot: int = 3000, seed: int = 7, weight: str | None = None) -> DataFrame:
    """One row: n, mean and the percentile interval at indexes int(.025B) and int(.975B)-1 of the B replicates that drew anything."""
    means = bootstrap_means(df, value, row_id, n_boot, seed, weight)
    one_group = Window.partitionBy(F.lit(1))  # at most n_boot rows
    r = means.withColumns({"r": F.row_number().over(one_group.orderBy("mean")) - 1, "kept": F.count(F.lit(1)).over(one_group)})
    lo_i, hi_i = F.floor(F.col("kept") * 0.025), F.greatest(F.floor(F.col("kept") * 0.975) - 1, F.lit(0))
    q = r.agg(F.max(F.when(F.col("r") == lo_i, F.col("mean"))).alias("lo"), F.max(F.when(F.col("r") == hi_i, F.col("mean"))).alias("hi"))
    m = F.col(weight) if weight else F.lit(1)
    base = df.agg(F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias("n"), F.try_divide(F.sum(F.col(value) * m), F.sum(m)).alias("mean"))
    one = base.withColumn("k", F.lit(1)).join(q.withColumn("k", F.lit(1)), "k")
    point = F.col("n") == 1
    return one.select(
        "n", round_dp(F.when(F.col("n") > 0, F.col("mean")), 4).alias("mean"),
        round_dp(F.when(point, F.col("mean")).otherwise(F.col("lo")), 4).alias("lo"),
        round_dp(F.when(point, F.col("mean")).otherwise(F.col("hi")), 4).alias("hi"),
    )


def cluster_bootstrap_ci(df: DataFrame, value: str, cluster: str, n_boot: int = 3000, seed: int = 8) -> DataFrame:
    """Resample whole clusters weighted by size; NULL bounds below two clusters."""
    per = df.groupBy(cluster).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("sz"))
    ci = bootstrap_ci(per, "m", cluster, n_boot, seed, weight="sz")
    k = per.agg(F.count(F.lit(1)).alias("clusters")).withColumn("j", F.lit(1))
    out = ci.withColumn("j", F.lit(1)).join(k, "j").drop("j")
    ok = F.col("clusters") >= 2
    return out.withColumns({"lo": F.when(ok, F.col("lo")), "hi": F.when(ok, F.col("hi"))})


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with cumulative counts: the compact form every order statistic is read from."""
    h = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("v")
    return h.withColumns({"hi": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy(*keys))})


def _at_rank(rank: Column) -> Column:
    """Value holding the 1-based ``rank`` (evaluated inside an aggregation over value_counts)."""
    return F.max(F.when((F.col("hi") >= rank) & (F.col("hi") - F.col("c") < rank), F.col("v")))


def exclusive_quartiles(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exclusive-method quartiles from value counts; position (n+1)·i/4 clamped to the data."""
    out = []
    for i in (1, 2, 3):
        j = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor((F.col("n") + 1) * i / 4)))
        out += [_at_rank(j).alias(f"a{i}"), _at_rank(j + 1).alias(f"b{i}"), F.max(F.when(F.lit(True), (F.col("n") + 1) * i - j * 4)).alias(f"d{i}")]
    g = counts.groupBy(*keys).agg(F.max("n").alias("n"), F.max("v").alias("__only"), *out)

    def q(i):
        return F.when(F.col("n") == 1, F.col("__only")).otherwise((F.col(f"a{i}") * (4 - F.col(f"d{i}")) + F.col(f"b{i}") * F.col(f"d{i}")) / 4.0)

    return g.select(*keys, "n", q(1).alias("q1"), q(2).alias("q2"), q(3).alias("q3"))


def distribution_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, population deviation and exclusive quartiles."""
    base = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), round_dp(F.avg(value), 4).alias("mean"), round_dp(F.percentile(value, 0.5), 4).alias("median"), round_dp(F.stddev_pop(value), 4).alias("std")
    )
    q = exclusive_quartiles(value_counts(df, keys, value), keys).select(*keys, round_dp(F.col("q1"), 4).alias("p25"), round_dp(F.col("q3"), 4).alias("p75"))
    return base.join(q, list(keys))


def hashed_rank(df: DataFrame, keys: Sequence[str], hash_col: str, tail: str, name: str = "rank") -> DataFrame:
    """Rank inside each key by a hash; slices of the hash's leading digits keep a huge key parallel."""
    return running(df, keys, [hash_col, tail], F.substring(hash_col, 1, 2), [Running(name, "count", F.lit(1))])


def permute_labels(labels: DataFrame, key: str, label: str, perms: int, seed: int) -> DataFrame:
    """(perm, key, label) with labels shuffled over keys: the i-th key takes the label of the i-th hashed key."""
    base = labels.select(F.col(key).alias("k"), F.col(label).alias("l"))
    fixed = hashed_rank(base.withColumns({"one": F.lit(1), "h": F.md5(F.col("k").cast("binary"))}), ["one"], "h", "k", "pos").select("k", "pos")
    many = base.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    many = many.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col("k")).cast("binary")))
    shuffled = hashed_rank(many, ["perm"], "h", "k", "pos").select("perm", "pos", "l")
    return shuffled.join(fixed, "pos").select("perm", F.col("k").alias(key), F.col("l").alias(label))


def alike(rows: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """(key, like): the least key that holds the same rows ``by``."""
    whole = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*by))).alias("__rows"))
    return whole.join(whole.groupBy("__rows").agg(F.min(key).alias("like")), "__rows").select(key, "like")


def allocate(cells: DataFrame, pair: Sequence[str], cell: Sequence[str], target: int, floor_per_pair: int) -> DataFrame:
    """Windows to keep per cell: one each, a floor per pair by largest remainder, the rest proportional."""
    c = F.col
    tail = [c(k) for k in cell]
    wp = Window.partitionBy(*pair)
    a = cells.withColumns({"avail": F.sum("size").over(wp), "ncells": F.count(F.lit(1)).over(wp)})
    a = a.withColumn("need", F.greatest(F.lit(0), F.least(F.lit(floor_per_pair), c("avail")) - c("ncells")))
    a = a.withColumns({"quota": F.expr("size * need div avail"), "rem": F.expr("size * need % avail")})
    a = a.withColumn("take", F.least(c("quota"), c("size") - 1))
    a = a.withColumns({"left": c("need") - F.sum("take").over(wp), "open": c("size") > 1 + c("take")})
    order = Window.partitionBy(*pair, "open").orderBy(c("rem").desc(), c("size").desc(), *tail)
    a = a.withColumn("extra", F.when(c("open") & (F.row_number().over(order) <= c("left")), 1).otherwise(0))
    a = a.withColumn("n1", 1 + c("take") + c("extra"))
    totals = a.agg(F.sum("size").alias("all_size"), F.sum("n1").alias("used")).withColumn("__k", F.lit(1))
    a = a.withColumn("__k", F.lit(1)).join(totals, "__k").withColumn("budget", F.greatest(F.lit(0), F.lit(target) - c("used")))
    a = a.withColumn("more", F.least(F.expr("size * budget div all_size"), c("size") - c("n1")))
    spent = a.agg(F.sum("more").alias("spent")).withColumn("__k", F.lit(1))
    a = a.join(spent, "__k").withColumns({"rest": c("budget") - c("spent"), "room": c("size") > c("n1") + c("more")})
    last = Window.partitionBy("room").orderBy(c("size").desc(), *tail)
    a = a.withColumn("bonus", F.when(c("room") & (F.row_number().over(last) <= c("rest")), 1).otherwise(0))
    return a.select(*cell, "size", (c("n1") + c("more") + c("bonus")).alias("keep"))

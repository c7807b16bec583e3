"""Parameter manifests, specifications and configuration checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

# Parameter specification (name, group, unit, low, high, class).
SPEC = (
    ("offset", "trading_knobs", "$", 0.001, 0.49, "tuning"),
    ("queue_gate", "trading_knobs", "shares", 0.0, 100000.0, "tuning"),
    ("max_pair_cost", "structural_limits", "$", 0.50, 1.00, "structural"),
    ("quote_shares", "trading_knobs", "shares", 5.0, 10000.0, "tuning"),
    ("entry_delay_sec", "trading_knobs", "s", 0.0, 3600.0, "tuning"),
    ("entry_delay_pct", "trading_knobs", "%", 0.0, 1.0, "tuning"),
    ("quote_range", "structural_limits", "$", 0.0, 1.0, "structural"),
    ("exit_thresh_by_slug", "exit_thresholds", "$", None, None, "tuning"),
    ("exit_reversal", "trading_knobs", "$", 0.001, 0.50, "tuning"),
    ("pair_cost_gate", "trading_knobs", "$", 0.0, 2.00, "tuning"),
    ("merge_gas_usd", "execution_assumptions", "$", 0.0, 0.0, "assumption"),
    ("taker_fee_rate", "execution_assumptions", "coef", 0.07, 0.07, "assumption"),
    ("tick_size", "execution_assumptions", "$", 0.001, 0.001, "assumption"),
    ("dead_zone_val", "structural_limits", "% or s", 0.0, 3600.0, "structural"),
)
SPEC_DDL = "name string, grp string, unit string, lo double, hi double, param_class string"


def spec_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SPEC), SPEC_DDL)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest JSON (name → candidate values, scalars or pairs) as (name, ordinal, value)."""
    text = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", "map<string,array<string>>")
    return text.select(F.explode(m).alias("name", "vals")).select("name", F.posexplode("vals").alias("ordinal", "value"))


def join_spec(params: DataFrame, spec: DataFrame) -> DataFrame:
    """Exact name first, else the parent of a dotted name; unmatched parameters stay with NULL spec."""
    keyed = params.withColumn("__parent", F.split("name", r"\.")[0])
    s = spec.withColumnRenamed("name", "__parent")
    return keyed.join(F.broadcast(s), "__parent", "left").drop("__parent")


def violations(configs: DataFrame, rules: Mapping[str, Column], key: str) -> DataFrame:
    """One row per broken rule of each configuration."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return configs.select(key, F.explode(broken).alias("violation"))


def config_rules() -> dict[str, Column]:
    fin = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    return {
        "dead_zone_unit": c("dead_zone_unit").isin("pct", "sec"),
        "dead_zone_val": fin(c("dead_zone_val")) & (c("dead_zone_val") >= 0) & ((c("dead_zone_unit") != "pct") | (c("dead_zone_val") <= 1)),
        "naked_leg_at_expiry": c("naked_leg_at_expiry").isin("close", "hold"),
        "entry_delay_sec": fin(c("entry_delay_sec")) & c("entry_delay_sec").between(0, 3600),
        "max_pair_cost": fin(c("max_pair_cost")) & c("max_pair_cost").between(0.5, 1.0),
        "quote_range": fin(c("lo")) & fin(c("hi")) & (c("lo") >= 0) & (c("lo") < c("hi")) & (c("hi") <= 1),
        "pair_cost_gate": fin(c("pair_cost_gate")) & (c("pair_cost_gate") <= 2.0),
    }


def grouped_view(params: DataFrame) -> DataFrame:
    """The manifest grouped by specification group; dotted exit keys count under their parent's group."""
    per = params.groupBy("grp", "name", "param_class").agg(F.count(F.lit(1)).alias("candidates"))
    return per.groupBy(F.coalesce("grp", F.lit("unspecified")).alias("grp")).agg(F.sort_array(F.collect_list(F.struct("name", "param_class", "candidates"))).alias("params"))

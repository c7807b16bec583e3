"""Printed volume seen from resting orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import milli
from .scan import Running, running

c = F.col
#: prices this far apart count as one
REACH = 0.001 + 1e-9


def printed_since(orders: DataFrame, prints: DataFrame, slice_us: int = 3_600_000_000) -> DataFrame:
    """Every order with ``printed``: the size printed at its price (within a tick) from its placement on.

    Orders (order_id, token, price, placed_us) meet the distinct prices of their token first, then take one place each among the
    prints of such a price: sums from the end, by slices of time carried across slices. Prints are summed and never paired
    with orders, so two orders at one price differ by what printed between them, and a busy price is many tasks.
    """
    size = prints.select("token", c("price").alias("at"), "ts_us", "size")
    prices = size.select("token", "at").distinct().withColumn("m", milli(c("at")))
    near = orders.withColumn("m", F.explode(F.array(*[milli(c("price")) + d for d in (-1, 0, 1)])))
    asked = near.join(prices, ["token", "m"]).filter(F.abs(c("at") - c("price")) <= REACH)
    none = F.lit(None).cast("double")
    # at equal times an order stands before the prints, so they count
    rows = asked.select("token", "at", c("placed_us").alias("ts_us"), F.lit(0).alias("kind"), none.alias("size"), "order_id").unionByName(
        size.select("token", "at", "ts_us", F.lit(1).alias("kind"), "size", F.lit(None).cast("string").alias("order_id"))
    )
    scanned = running(rows, ["token", "at"], ["ts_us", "kind"], F.floor(c("ts_us") / slice_us), [Running("after", "sum", c("size"))], reverse=True)
    sums = scanned.filter(c("order_id").isNotNull()).groupBy("order_id").agg(F.sum("after").alias("printed"))
    return orders.join(sums, "order_id", "left").withColumn("printed", F.coalesce("printed", F.lit(0.0)))

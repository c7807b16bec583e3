"""Streams folded batch by batch in DataFrame operations, with a small state table carried between batches.

A micro-batch is processed by joins, windows and sliced scans, so one hot key is many tasks. The state after batch n is a
written table of its own; a batch that runs again after a failure reads the state before it and overwrites its own
outputs, so every batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import Running, running
from ..session import scratch_path

c = F.col
Step = Callable[[DataFrame, DataFrame, int], tuple[DataFrame, DataFrame]]


def fold(stream: DataFrame, name: str, state: str, step: Step) -> DataFrame:
    """Run ``step(batch, state, batch_id) -> (output, new state)`` over all available input; the outputs of all batches."""
    spark: SparkSession = stream.sparkSession
    root = scratch_path(spark, name)
    first = f"{root}/state/start"
    spark.createDataFrame([], state).write.parquet(first)
    schema: dict[str, object] = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = f"{root}/state/{batch_id - 1}" if batch_id else first
        out, after = step(batch, session.read.schema(state).parquet(before), batch_id)
        out.write.mode("overwrite").parquet(f"{root}/out/{batch_id}")
        after.select(session.read.schema(state).parquet(before).columns).write.mode("overwrite").parquet(f"{root}/state/{batch_id}")
        schema["out"], schema["last"] = out.schema, batch_id

    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    if not schema:
        empty = stream.limit(0)
        return spark.createDataFrame([], step(spark.createDataFrame([], empty.schema), spark.read.schema(state).parquet(first), 0)[0].schema)
    return spark.read.schema(schema["out"]).parquet(*[f"{root}/out/{i}" for i in range(schema["last"] + 1)])


SPOT_STATE = "series string, a double, a_us bigint, b double, day bigint, base double, last_us bigint"
DAY_US = 86_400_000_000


def spot_merge(spot: DataFrame, stale_us: int, ttl_us: int = 2 * DAY_US, slice_us: int = 600_000_000) -> DataFrame:
    """Latest price of two feeds per symbol, the secondary standing in while the primary is silent, and the day's first price.

    A symbol's rows of a batch are scanned by slices of time, each slice a task; one row a symbol is carried to the next batch, and
    dropped once the stream is ``ttl_us`` past it.
    """

    def step(batch: DataFrame, state: DataFrame, _: int) -> tuple[DataFrame, DataFrame]:
        today, own = F.floor(c("ts_us") / DAY_US), F.floor(c("ts_us") / slice_us)
        first = c("feed") == "A"
        rows = batch.withColumn("day", today.cast("bigint")).withColumn("seq", F.struct("ts_us", "event_id"))
        feeds = [
            Running("a", "last", F.when(first, c("price"))), Running("a_us", "last", F.when(first, c("ts_us"))), Running("b", "last", F.when(~first, c("price"))),
        ]
        order = ["ts_us", "event_id"]
        scanned = running(rows, ["series"], order, own, feeds)
        scanned = running(scanned, ["series", "day"], order, own, [Running("base", "first", c("price"))])
        s = state.select("series", *[c(x).alias(f"__{x}") for x in ("a", "a_us", "b", "day", "base")])
        j = scanned.join(F.broadcast(s) if state.count() <= 100_000 else s, "series", "left")
        j = j.withColumns({
            "a": F.coalesce("a", "__a"), "a_us": F.coalesce("a_us", "__a_us"), "b": F.coalesce("b", "__b"),
            "base": F.when(c("day") == c("__day"), c("__base")).otherwise(c("base")),
        }).drop("__a", "__a_us", "__b", "__day", "__base")
        used = F.when(c("a_us").isNotNull() & (c("ts_us") - c("a_us") <= stale_us), "primary").when(c("b").isNotNull(), "secondary")
        out = j.select("series", "event_id", "ts_us", c("a").alias("primary_price"), c("b").alias("secondary_price"), used.alias("used"), c("base").alias("baseline"))
        last = j.groupBy("series").agg(F.max_by(F.struct("a", "a_us", "b", "day", "base", c("ts_us").alias("last_us")), "seq").alias("x")).select("series", "x.*")
        kept = state.join(last.select("series"), "series", "left_anti").unionByName(last)
        top = kept.agg(F.max("last_us").alias("__top"))
        return out, kept.join(F.broadcast(top)).filter(c("last_us") >= c("__top") - ttl_us).drop("__top")

    return fold(spot, "spot", SPOT_STATE, step)


def late_rows(ticks: DataFrame, delay_us: int = 600_000_000) -> DataFrame:
    """Rows that came behind the watermark, and rows of windows it had already closed, with the batch that brought them.

    The watermark of a batch is the latest event of all batches before it less ``delay_us``.
    """

    def step(batch: DataFrame, state: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        mark = F.broadcast(state.agg((F.max("top") - delay_us).alias("mark")))
        late, closed = F.coalesce(c("ts_us") < c("mark"), F.lit(False)), F.coalesce(c("end_ts") * 1e6 <= c("mark"), F.lit(False))
        rows = batch.join(mark).select("event_id", "cid", "series", "ts_us", F.lit(batch_id).alias("batch"), late.alias("late"), closed.alias("reappeared"), ((c("mark") - c("ts_us")) / 1e6).alias("behind_sec"))
        top = state.select("top").unionByName(batch.agg(F.max("ts_us").alias("top"))).agg(F.max("top").alias("top"))
        return rows.filter("late or reappeared"), top

    # a batch is handed over computed: columns that are not read are not derived
    return fold(ticks.select("event_id", "cid", "series", "ts_us", "end_ts"), "late", "top bigint", step)

"""Stream sources and a drain that runs a query over everything available and returns its output table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch_path
from ..sources.derived import ticks_from_events

EVENTS_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, glob: str = "events*.parquet", max_files: int = 64) -> DataFrame:
    """Event files as a stream; a micro-batch is bounded by ``max_files``."""
    reader = prepare(spark).readStream.schema(EVENTS_DDL).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def tick_stream(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Streaming silver ticks with an event-time column ``at``."""
    return ticks_from_events(event_stream(spark, path, **kw)).withColumn("at", F.timestamp_micros("ts_us"))


def drain(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Run to the end of the available input in append mode and read the sink back."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out, ckpt = scratch_path(spark, name), scratch_path(spark, f"{name}-ckpt")
    w = df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if partition:
        w = w.partitionBy(partition)
    w.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)

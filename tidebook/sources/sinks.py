"""Writing ticks, windows and results. Spark's commit protocol gives the atomic replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_day(df: DataFrame, path: str, day: str = "day", fmt: str = "parquet", compression: str | None = None) -> None:
    """Append-only, partitioned by UTC day."""
    w = df.write.mode("append").partitionBy(day).format(fmt)
    if compression:
        w = w.option("compression", compression)
    w.save(path)


def in_files(df: DataFrame, day: str, order: str, span: int = 50_000) -> DataFrame:
    """``df`` dealt and sorted for ``write_lines``, with ``piece``: what rows become lines of is best dealt before it grows."""
    rows = df.withColumn("piece", F.lpad(F.floor(F.col(order) / span).cast("string"), 12, "0"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as narrow rows would be put into few tasks
    return rows.repartitionByRange(parts, F.col(day), F.col("piece")).sortWithinPartitions(day, "piece", order)


def write_lines(dealt: DataFrame, path: str, day: str, value: str = "value") -> None:
    """Compressed text files of a day, in order: one for each span of ``in_files``, so a huge day is many files of bounded size."""
    out = dealt.select(day, "piece", F.col(value).alias("value"))
    out.write.mode("overwrite").partitionBy(day, "piece").option("compression", "gzip").text(path)


def copy_verbatim(lines: DataFrame, passed: DataFrame, path: str, key: str = "cid", day: str = "start_day") -> None:
    """Raw lines of surviving windows, unchanged, filed under the window's start day."""
    kept = lines.join(passed.select(key), key, "left_semi")
    kept.select(day, "value").write.mode("overwrite").partitionBy(day).text(path)


def write_windows(windows: DataFrame, summary: DataFrame, path: str) -> None:
    windows.write.mode("overwrite").json(f"{path}/windows")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "cid", order: str = "ts_us") -> None:
    """Silver ticks bucketed by window: later per-window aggregates and joins need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order).saveAsTable(table)

"""Helpers the operators share: column names that cannot clash, bounded bitmaps, written tables, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.session import cut

WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of a column's text form, modulo ``modulus``; the folds of the labelled tables are cut by it."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


class Bitmap:
    """A bitmap of fixed size over 64-bit hashes, small enough to ship to every task whatever the key count.

    It only spares work: a set bit may be a chance hit, so what passes is joined exactly afterwards; a clear
    bit proves absence. When very many keys fill it, everything passes and results stay the same.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.astype(np.int64, copy=False).view(np.uint64) & np.uint64((1 << self.bits) - 1)
        word = self.words[(slot >> np.uint64(6)).astype(np.int64)]
        return ((word >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def bitmap(keys: DataFrame, column: str, bits: int = 22) -> Bitmap:
    """Bitmap of 2**bits bits over well-mixed hashes: at most 2**(bits - 6) words reach the driver, packed, 16 bytes each."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("held"))

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for c in batch.columns], ["word", "held"])

    out = np.zeros(1 << (bits - 6), np.uint64)
    for row in words.mapInArrow(pack, "word binary, held binary").collect():
        out[np.frombuffer(row.word, np.int64)] = np.frombuffer(row.held, np.uint64)
    return Bitmap(out, bits)


#: rows of ids up to which a table of ids is sent to every task
SENT_IDS = 1_000_000


def sent(ids: DataFrame, name: str) -> DataFrame:
    """A narrow table for a join with texts: written, counted, and sent to every task up to SENT_IDS rows, so that texts stay where they are."""
    ids = cut(ids, name)
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def without(docs: DataFrame, ids: DataFrame, condition, name: str) -> DataFrame:
    """``docs`` without the rows that meet ``condition`` with a row of ``ids``: texts stay where they are while ids are few
    (counted, at most SENT_IDS), and are shuffled beyond that."""
    return docs.join(sent(ids, name), condition, "left_anti")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and bit fields of hashes are spread evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) of every node on an edge: component is the smallest node reachable.

    Alternates two joins until no label moves: a node takes the smallest label among its neighbours, then the
    label of its label (pointer jumping), so a chain of n nodes needs about log n rounds. Labels are written
    to the shared folder each round; a hub's neighbours are pre-aggregated, so a hub is never one task's group.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{name}-edges")
    labels = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = cut(hooked.join(jump, "mid", "left").select("node", "old", F.least("mid", "far").alias("label")), f"{name}-{step}")
        if moved.filter("label <> old").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")


def ranked(df: DataFrame, keys: list, rank: str, name: str = "ranked") -> DataFrame:
    """``df`` with its 0-based position in the order of ``keys``, over all rows and without gaps.

    Rows are dealt by range of all keys (so equal leading keys spread over tasks), sorted inside each part and
    written; a part's rows are counted and the few counts summed up. ``keys`` should end in something nearly
    unique; rows equal in all keys take neighbouring ranks in either order. Ranks come from the written rows,
    so a lost task cannot change them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    low = F.lit((1 << 33) - 1)
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(low))
    counts = dealt.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(rank, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")

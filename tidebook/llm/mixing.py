"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in hashed order, form blocks of ``block`` rows. With integer weights that sum to W, block i of a
source of weight w is released at slot i*W/w (rounded down) and due by slot (i+1)*W/w (rounded up): its window.
Each slot goes to the released block that is due first (ties by source name). As the weights fill the slots exactly,
every block runs inside its window, so after any number of slots every source is less than one block from its share.

The schedule repeats every W slots: block w has the window of block 0, W slots later. So one period is computed on
the driver (W numbers, bounded by ``grain`` and the number of sources, never by rows) and block i of a source takes
the slot of block i mod w, i div w periods later: a join on (source, i mod w). A source that has run out leaves its
slots empty; closing the gaps keeps the rest at their weights.

``in_mix`` tells whether a row comes before the end of the mix: the last slot at which two sources still
had blocks. What follows is the surplus of one source, whose share could not be held; all rows are returned. In the pipeline
too no row goes: the schedule is the order of the stream, and a source that has run out leaves its share to the others.

Target weights: given, or rows of a source to the power ``temper``, which lifts small sources. They are rounded to whole slots
of a period as long as the stream has blocks (``fine_grain``), so that what holds against the rounded weights holds against the targets
to within one more block, up to MAX_GRAIN slots.

Defined results: a null source is a source of its own, before all names; weights of absent sources are ignored and
sources without a weight get the smallest; null or repeated ids only decide ties, and equal rows are all
scheduled; one source alone has no surplus; an empty table gives no rows; names of added columns win
over equal names in the input.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import SENT_IDS, ranked
from tidebook.session import cut

MAX_SOURCES = 100_000
#: slots of the longest period the driver computes
MAX_GRAIN = 1 << 17


def whole_weights(shares: dict, grain: int) -> dict:
    """Positive integers that sum to ``grain`` (or to two a source, if that is more), each less than one from its share of it;
    a source whose share is below one gets one, and the others share the rest."""
    left, rest, out = max(grain, 2 * len(shares)), sum(shares.values()), {}
    exact = {}
    for k in sorted(shares, key=lambda k: (shares[k], k)):
        if shares[k] * left < rest:
            out[k], left, rest = 1, left - 1, rest - shares[k]
        else:
            exact[k] = shares[k]
    exact = {k: v * left / rest for k, v in exact.items()}
    out |= {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: left - sum(out[k] for k in exact)]:
        out[k] += 1
    return out


def fine_grain(shares: dict, blocks: int) -> int:
    """Slots of a period: at least one a block of the stream, so that rounded weights drift by less than a block over all of it,
    and eight for the smallest share; at most MAX_GRAIN, beyond which the drift is below one block in MAX_GRAIN slots."""
    smallest = min(shares.values()) / sum(shares.values())
    return min(MAX_GRAIN, max(1000, blocks, int(8 / smallest)))


def period(weights: dict) -> list[tuple]:
    """(source, block, slot) of one period of the schedule: earliest due block first among those released."""
    total = sum(weights.values())
    waiting, ready, out = [(0, k, 0) for k in sorted(weights)], [], []
    heapq.heapify(waiting)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[k]), k, i))
        _, k, i = heapq.heappop(ready)
        out.append((k, i, slot))
        if i + 1 < weights[k]:
            heapq.heappush(waiting, ((i + 1) * total // weights[k], k, i + 1))
    return out


def end_of_mix(counts: dict, weights: dict, schedule: list[tuple], block: int) -> int:
    """The last slot at which two sources still had blocks (the last slot of all for one source)."""
    total, at = sum(weights.values()), {(k, i): slot for k, i, slot in schedule}
    last = []
    for k, n in counts.items():
        cycle, i = divmod(-(-n // block) - 1, weights[k])
        last.append(cycle * total + at[k, i])
    return sorted(last)[-2] if len(last) > 1 else last[0]


def mix(docs: DataFrame, weights: dict | None = None, temper: float = 0.7, block: int = 16, grain: int | None = None, carry: list[str] = (), id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, block, release, due, slot, seq, in_mix) per row, with the columns in ``carry`` as they are.

    ``seq`` is the row's place in the mixed stream, from 0; ``release`` and ``due`` bound ``slot``.
    """
    spark = docs.sparkSession
    kept = F.struct(F.lit(1).alias("one"), *[F.col(c) for c in carry]).alias("kept")
    # a name that sorts a missing source first and cannot equal a present one
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("="), source_col), F.lit("")).alias("key"), kept)
    found = rows.groupBy("key").count().orderBy("key").limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts = {r["key"]: r["count"] for r in found}
    named = {("" if k is None else f"={k}"): v for k, v in (weights or {}).items() if v > 0}
    least = min([named[k] for k in counts if k in named], default=1)
    shares = {k: named.get(k, least) if weights else n**temper for k, n in counts.items()}
    blocks = sum(-(-n // block) for n in counts.values())
    whole = whole_weights(shares, grain or fine_grain(shares, blocks)) if counts else {}
    schedule, total = period(whole), sum(whole.values())
    end = end_of_mix(counts, whole, schedule, block) if counts else 0

    begun, before = [], 0
    for k in sorted(counts):
        begun.append((k, before, whole[k]))
        before += counts[k]
    sources = spark.createDataFrame(begun, "key string, before long, weight long")
    places = spark.createDataFrame([(k, i, s) for k, i, s in schedule], "key string, turn long, at long")
    order = ranked(rows.withColumn("hash", F.xxhash64("id")), ["key", "hash", "id"], "rank", "mixing-blocks")
    order = order.join(sources, "key").withColumn("within", F.col("rank") - F.col("before")).withColumn("block", F.expr(f"within div {block}"))
    order = order.withColumn("turn", F.col("block") % F.col("weight")).join(F.broadcast(places), ["key", "turn"])
    order = order.withColumn("slot", F.expr(f"block div weight * {total}L + at"))
    order = ranked(order.select("id", "source", "kept", "block", "weight", "within", "slot"), ["slot", "within"], "seq", "mixing-stream")
    own = [
        F.col("id").alias(id_col), F.col("source").alias(source_col), "block",
        F.expr(f"block * {total}L div weight").alias("release"), F.expr(f"((block + 1) * {total}L + weight - 1) div weight").alias("due"),
        "slot", "seq", (F.col("slot") <= end).alias("in_mix"),
    ]
    taken = {id_col, source_col, "block", "release", "due", "slot", "seq", "in_mix"}
    return order.select(*own, *[F.col("kept").getField(c).alias(c) for c in carry if c not in taken])


def with_place(docs: DataFrame, place: str = "mix_seq", id_col: str = "doc_id", source_col: str = "source", **params) -> DataFrame:
    """``docs`` with the place of every row in the mixed stream, from 0; texts are not moved while ids are few.

    An id is taken to name one document: rows that repeat it take the first of its places. Rows without an id have none.
    """
    placed = mix(docs.select(id_col, source_col), id_col=id_col, source_col=source_col, **params).filter(F.col(id_col).isNotNull())
    places = cut(placed.groupBy(F.col(id_col).alias("_placed")).agg(F.min("seq").alias(place)), "mixing-places")
    places = F.broadcast(places) if places.count() <= SENT_IDS else places
    return docs.drop(place).join(places, F.col(id_col) == F.col("_placed"), "left").drop("_placed")


def keep_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **params) -> DataFrame:
    """All rows of ``docs`` with their columns as they are, in the order of the mixed stream: partition by partition, and
    inside each. Rows without an id come last, in hashed order."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    placed = with_place(docs, "_place", id_col, source_col, **params)
    keys = [F.col("_place").asc_nulls_last(), F.when(F.col("_place").isNull(), whole)]
    return placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_place")


def as_written(docs: DataFrame, place: str = "mix_seq") -> DataFrame:
    """``docs`` with every row's place, from 0, in the order in which its files were written: of ``keep_mix``, that of the mixed stream.

    ``docs`` is read from those files as a whole, neither filtered nor sorted since; a table of no files is written first.
    """
    docs = docs.drop(place)
    docs = docs if docs.inputFiles() else cut(docs, "mixing-written")
    rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = rows.groupBy("_file").count().withColumn("_part", F.regexp_extract("_file", r"part-(\d+)", 1).cast("long"))
    before = counts.select("_file", (F.sum("count").over(Window.orderBy("_part", "_file")) - F.col("count")).alias("_before"))
    return rows.join(F.broadcast(before), "_file").select(*docs.columns, (F.col("_before") + F.col("_row")).alias(place))

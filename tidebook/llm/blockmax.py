"""Exact top-k search by inner product, block at a time.

Vectors are scaled and floored to integers; a component is a term, its integer the term's weight in a document. Documents are
put into an order in which like ones are neighbours and cut into blocks of consecutive ones. A block keeps the largest and
the least weight of every term and a forward index of its documents. For a query, the sum over its terms of the most that a
block's weights can give (the largest for a positive weight, the least for a negative one) bounds every score in the block. Blocks
are scored in descending order of their bounds until the next bound is below the k-th best score; a bound that equals it
still counts while the block holds an id small enough to win the tie.

Some blocks make a segment. Queries first search the segment they lie in, which gives each a k-th score to start from; then
chunks of queries meet all segments, one task each, so a task holds one segment and one chunk, and it returns only what
can still be among the best. Shuffled are rows * queries * (1 / chunk + 1 / segment) rows, and nothing is sent to all tasks.

The order follows the nearest of a few anchors, which are a bounded sample (``anchors`` vectors of least hash). It decides how
much is pruned and no result.

Defined results: vectors that are null or hold null or non-finite components take no part; a component that one of two vectors
lacks adds nothing, so vectors of all lengths are compared and an empty one scores 0. Repeated rows are rows of their own: each
is searched if its id asks for it, and finds the others. A null id is no query, and comes last among equal scores. Integers and
scores are held to the range of a 64-bit long, inside which all arithmetic is exact. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import ranked
from tidebook.session import cut

LONG = (1 << 63) - 1
FOUND = "query long, query_id long, score long, vec_id long, row long"


def integer_rows(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, as arrays of longs."""
    v, edge = F.col("v"), float(1 << 63)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.coalesce(sound, F.lit(False)))
    held = lambda y: F.when(y >= edge, F.lit(LONG)).when(y <= -edge, F.lit(-LONG - 1)).otherwise(F.floor(F.when(F.abs(y) < edge, y)))
    return rows.select("id", F.transform(v, lambda x: held(x * F.lit(float(scale)))).alias("v"))


def padded(rows: list, width: int, kind=np.int64) -> np.ndarray:
    """Ragged rows as one matrix, cut to ``width`` or filled up with zeros."""
    out = np.zeros((len(rows), width), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:width]
    return out


def with_anchor(rows: DataFrame, anchors: int) -> DataFrame:
    """``near``: the number of the anchor with the largest cosine."""
    sample = rows.filter(F.size("v") > 0).select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(anchors)
    some = [np.array(r.v, np.float64) for r in sample.collect()]
    points = padded([r / max(1.0, np.linalg.norm(r)) for r in some], max(map(len, some), default=1), np.float64)

    def run(batches):
        for batch in batches:
            v = padded(batch.column("v").to_pylist(), points.shape[1], np.float64)
            near = (v @ points.T).argmax(axis=1) if len(points) else np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "near"])

    return rows.mapInArrow(run, "id long, v array<long>, near int")


def index(rows: DataFrame, anchors: int, block: int, segment: int) -> DataFrame:
    """Documents in order: (row, id, v, segment, block), ``block`` documents a block and ``segment`` blocks a segment."""
    order = ranked(with_anchor(rows, anchors), ["near", "id", "v"], "row", "search-order")
    wide = block * segment
    return order.select("row", "id", "v", F.floor(F.col("row") / wide).alias("segment"), F.floor(F.col("row") % wide / block).cast("int").alias("block"))


class Segment:
    """The blocks of one segment as matrices; a short block is filled up with rows of -1."""

    def __init__(self, docs: pd.DataFrame, width: int = 0):
        docs = docs.sort_values("row")
        number, size = np.unique(docs["block"].to_numpy(), return_counts=True)
        shape = (len(number), int(size.max()))
        at = np.repeat(np.arange(len(number)), size), np.arange(len(docs)) - np.repeat(np.cumsum(size) - size, size)
        self.width = max([width, *map(len, docs["v"])])
        self.row, self.id, self.null = np.full(shape, -1), np.zeros(shape, np.int64), np.zeros(shape, bool)
        self.forward = np.zeros((*shape, self.width), np.int64)
        self.row[at], self.null[at] = docs["row"], docs["id"].isna()
        self.id[at] = [0 if x is None or x != x else int(x) for x in docs["id"]]
        self.forward[at] = padded(list(docs["v"]), self.width)
        real = self.row >= 0
        self.high = np.where(real[:, :, None], self.forward, -LONG - 1).max(axis=1)
        self.low = np.where(real[:, :, None], self.forward, LONG).min(axis=1)
        self.least = np.where(real & ~self.null, self.id, LONG).min(axis=1)


def exact(weights: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The matrices as doubles where every sum of their products is exact in doubles, else as Python's integers."""
    size = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0))) + 1
    small = size(weights) * max(map(size, others)) * (weights.shape[1] + 1) < 1 << 53
    return [m.astype(np.float64 if small else object) for m in (weights, *others)]


def held(scores: np.ndarray) -> np.ndarray:
    return scores if scores.dtype != object else np.minimum(np.maximum(scores, -LONG - 1), LONG)


def order_of(score, null, ident, row) -> np.ndarray:
    """Per query the best first: real rows before others (-2), then score, ids (null last), and found rows before the floor (-1)."""
    keys = (row == -1, ident, null, -score, row == -2)
    if score.dtype != object:
        return np.lexsort(keys, axis=1)
    places = range(score.shape[1])
    return np.array([sorted(places, key=lambda j, q=q: tuple(m[q, j] for m in keys[::-1])) for q in range(len(score))]).reshape(score.shape)


def search(seg: Segment, own: np.ndarray, weights: np.ndarray, k: int, floor: tuple) -> tuple:
    """The k best of a segment for each query but its ``own`` row, as (scores, ids, null ids, rows; -1 is none).

    ``floor`` is a known k-th best of each query (score or -inf, id, whether that is null): what lies behind it is left out.
    """
    q, forward, high, low = exact(weights, seg.forward, seg.high, seg.low)
    bounds = held(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)
    order = np.argsort(-bounds, axis=1, kind="stable")
    score, ident, null = (np.repeat(np.array(f)[:, None], k, axis=1) for f in floor)
    score, found, live = score.astype(q.dtype), np.full(ident.shape, -1), np.arange(len(q))
    for step in range(order.shape[1]):
        bound = bounds[live, order[live, step]]
        live = live[bound >= score[live, k - 1]]
        if not len(live):
            break
        block = order[live, step]
        may = (bounds[live, block] > score[live, k - 1]) | (seg.least[block] <= ident[live, k - 1]) | null[live, k - 1]
        at, block = live[may], block[may]
        new = held((forward[block] @ q[at][:, :, None])[:, :, 0])
        real = (seg.row[block] >= 0) & (seg.row[block] != own[at][:, None])
        both = [(score, new), (null, seg.null[block]), (ident, seg.id[block]), (found, np.where(real, seg.row[block], -2))]
        both = [np.concatenate([old[at], more], axis=1) for old, more in both]
        first = order_of(*both)[:, :k]
        score[at], null[at], ident[at], found[at] = (np.take_along_axis(m, first, axis=1) for m in both)
    return score, ident, null, found


def told(seg: Segment, own: np.ndarray, query_id: np.ndarray, weights: np.ndarray, k: int, floor: tuple) -> pd.DataFrame:
    score, ident, null, found = search(seg, own, weights, k, floor)
    q, j = np.nonzero(found >= 0)
    ids = pd.array([None if z else x for x, z in zip(ident[q, j].tolist(), null[q, j], strict=True)], "Int64")
    return pd.DataFrame({"query": own[q], "query_id": query_id[q], "score": score[q, j].astype(np.int64), "vec_id": ids, "row": found[q, j]})


def no_floor(n: int) -> tuple:
    return np.full(n, -np.inf), np.full(n, LONG), np.ones(n, bool)


def best_first() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")]


def top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", anchors: int = 64, block: int = 32, segment: int = 16, chunk: int = 512) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best rows for every row whose id ``every`` divides."""
    docs = cut(index(integer_rows(vectors, scale, id_col, vector_col), anchors, block, segment), "search-blocks")
    asks = docs.filter(F.col("id") % every == 0)

    def home(group: pd.DataFrame) -> pd.DataFrame:
        seg = Segment(group)
        ask = (seg.row >= 0) & ~seg.null & (seg.id % every == 0)
        return told(seg, seg.row[ask], seg.id[ask], seg.forward[ask], k, no_floor(int(ask.sum())))

    place = F.row_number().over(Window.partitionBy("query").orderBy(*best_first()))
    seeds = docs.groupBy("segment").applyInPandas(home, FOUND).withColumn("rank", place).filter(F.col("rank") == k)
    floors = seeds.select(F.col("query").alias("row"), F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))
    chunks, segments = max(1, -(-asks.count() // chunk)), F.lit(docs.agg(F.max("segment")).first()[0] or 0)
    asked = asks.select("row", "id", "v").join(floors, "row", "left").withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    asked = cut(asked, "search-queries").withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), segments.cast("long"))))
    sides = docs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c.split()[0]: pd.array([], "Int64") for c in FOUND.split(", ")})
        none = right["floor"].isna().to_numpy()
        floor = np.array([-np.inf if z else int(x) for x, z in zip(right["floor"], none, strict=True)], object)
        nil = right["floor_id"].isna().to_numpy()
        floor_id = np.array([LONG if z else int(x) for x, z in zip(right["floor_id"], nil, strict=True)], np.int64)
        seg = Segment(left, max(map(len, right["v"])))
        return told(seg, right["row"].to_numpy(np.int64), right["id"].to_numpy(np.int64), padded(list(right["v"]), seg.width), k, (floor, floor_id, nil))

    met = sides.groupBy("segment", "chunk").cogroup(asked.groupBy("segment", "chunk")).applyInPandas(meet, FOUND)
    return met.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Near vectors see the pivots alike, so
they share most of their first few. The inverted lists are kept per pair of pivots: a vector stands in the list of
every pair among its first ``depth``, and two vectors meet when they share at least two pivots. Members of a list are
compared by cosine in double precision; a list above ``part`` members is dealt into parts, and every pair of parts
is one task, so no task holds more than two parts. A linked pair that meets in several lists counts in the
smallest pair of pivots they share, which both can tell from their own descriptions.

Equal vectors are one node. Tasks return link counts and a spanning forest, not pairs.

Pivots come from a bounded sample on the driver (the ``sample`` distinct vectors with the smallest hash, spread out by
farthest-first choice); all vectors are indexed. With 64 pivots and depth 4, recall against brute force on the
given tables is 1.0 (tests hold it to 0.9; README has figures).

Defined results: a vector that is null, empty, zero, or holds a null or a non-finite component, or whose length is not
the most common one, links with nothing; equal vectors link (if not void); a null id takes part but names no
component; labels and other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import components
from tidebook.session import cut


def sound(vectors: DataFrame, vector: str) -> DataFrame:
    """Vectors of the most common length that have a direction, as arrays of doubles."""
    v = F.col(vector)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = vectors.withColumn(vector, v.cast("array<double>")).filter(F.coalesce(ok, F.lit(False)))
    length = usable.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return usable.filter(F.size(vector) == (length[0].n if length else 0))


def digest(vector: str) -> Column:
    """The 64-bit name of a vector; a void vector's name is that of no sound one."""
    return F.xxhash64(F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)))


def unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def choose_pivots(nodes: DataFrame, count: int, sample: int) -> np.ndarray:
    """Pivots from at most ``sample`` vectors: each the farthest from those before it."""
    rows = nodes.orderBy("node").limit(sample).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    pool = unit(np.array([r.vector for r in rows], np.float64))
    chosen, near = [0], pool @ pool[0]
    while len(chosen) < min(count, len(pool)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, pool @ pool[chosen[-1]])
    return pool[chosen]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def described(nodes: DataFrame, pivots: np.ndarray, depth: int) -> DataFrame:
    """Nodes with ``lists``: the ascending codes of all pairs among a vector's ``depth`` nearest pivots."""
    depth = min(depth, len(pivots))
    pairs = np.array(list(combinations(range(depth), 2)) or [(0, 0)])

    def run(batches):
        for batch in batches:
            near = unit(matrix(batch.column("vector"))) @ pivots.T
            first = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :depth], axis=1)
            codes = np.sort(first[:, pairs[:, 0]] * len(pivots) + first[:, pairs[:, 1]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes), pa.list_(pa.int64()))], [*batch.schema.names, "lists"])

    return nodes.mapInArrow(run, "node long, copies long, vector array<double>, lists array<long>")


def compare(group: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(root, linked copies) per member of one list part, or of two; pairs that a smaller list holds are left to it."""
    code, side = int(group["list"].iloc[0]), group["side"].to_numpy(bool)
    vectors, lists = unit(np.stack(group["vector"].to_numpy())), np.stack(group["lists"].to_numpy())
    copies, nodes = group["copies"].to_numpy(), group["node"].to_numpy()
    links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    lower = [lists[:, j] for j in range(lists.shape[1])]
    two = side.any() and not side.all()
    for at in range(0, len(nodes), 256):
        a, b = np.nonzero(vectors[at : at + 256] @ vectors.T >= threshold)
        a += at
        keep = a < b
        if two:
            keep &= side[a] != side[b]
        a, b = a[keep], b[keep]
        earlier = np.zeros(len(a), bool)
        for mine in lower:
            small = mine[a] < code
            for other in lower:
                earlier |= small & (mine[a] == other[b])
        a, b = a[~earlier], b[~earlier]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        for x, y in zip(a, b, strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    return nodes[[find(x) for x in range(len(nodes))]], links


def linked(nodes: DataFrame, threshold: float, part: int) -> DataFrame:
    """(node, root, links) per task from described nodes."""
    posted = nodes.withColumn("list", F.explode("lists"))
    sizes = posted.groupBy("list").agg(F.count("*").alias("held")).filter("held > 1").select("list", F.ceil(F.col("held") / part).cast("long").alias("parts"))
    dealt = posted.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("list", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "copies", "vector", "lists", (F.col("own") > F.col("other")).alias("side"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        root, links = compare(group, threshold)
        out = pd.DataFrame({"node": group["node"].to_numpy(), "root": root, "links": links})
        return out[(out.links > 0)]

    return dealt.groupBy("list", "x", "y").applyInPandas(run, "node long, root long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 64, depth: int = 4, sample: int = 2048, part: int = 512) -> DataFrame:
    """One row per row of ``vectors``: its id, ``n_links``, ``component_id`` and ``kept`` (it is its component's id)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    good = sound(rows, "vector").withColumn("node", digest("vector"))
    nodes = cut(good.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.first("vector").alias("vector")), "pivot-nodes")
    chosen = choose_pivots(nodes, pivots, sample)
    found = cut(linked(cut(described(nodes.select("node", "copies", "vector"), chosen, depth), "pivot-lists"), threshold, part), "pivot-links")
    groups = components(found.filter("node <> root"), "node", "root", "pivot-group")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "copies", "first").join(groups, "node", "left").join(links, "node", "left").withColumn("group", F.coalesce("component", "node"))
    named = cut(named, "pivot-named")
    smallest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "group").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    tagged = rows.select("id", digest("vector").alias("node")).join(named, "node", "left")
    component = F.coalesce("component_id", "id")
    return tagged.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))

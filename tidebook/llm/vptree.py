"""Centroid clustering in exact integers, with a vantage-point tree over the centroids.

Components are scaled and floored to integers. Each round builds a vantage-point tree over the few centroids on the driver (as
many as ``clusters``, the bound of all that is collected or sent), ships it to every task, and assigns each vector by best-first
branch and bound: of a vector's open subtrees the one with the least distance bound is opened next, until every open bound
lies beyond the best distance. Bounds use root distances and ranges of them in doubles, widened by more than their rounding
error and inclusive, so a subtree that could hold an equal distance is opened; the distances that decide are exact integers,
and equal ones go to the smaller number. Tasks add up their batches before anything is shuffled, so a cluster of most rows costs
a task no more than any other; new centroids are exact floors of sum / count.

Defined results: only vectors with exactly ``width`` components, none null or non-finite, take part; others return no row.
Integers are held to the range of a 64-bit long, distances and inertias are computed exactly and held to it when returned. Fewer
rows than ``clusters`` make as many centroids as rows, an empty table makes none and no rows. Repeated rows count each; a null
id reads ``null`` in the hash, equal hashes are ordered by their vectors; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.pivots import matrix
from tidebook.session import cut

LONG = (1 << 63) - 1
#: components up to this size keep sums of squared differences of 64 components, and sums of a batch, inside 64 bits
SMALL = 1 << 27


def integer_vectors(vectors: DataFrame, scale: int, width: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of ``width`` finite components, each floor(scale * component)."""
    v = F.col("v")
    sound = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.coalesce(sound, F.lit(False)))
    edge = float(1 << 63)
    held = lambda y: F.when(y >= edge, F.lit(LONG)).when(y <= -edge, F.lit(-LONG - 1)).otherwise(F.floor(F.when(F.abs(y) < edge, y)))
    return rows.select("id", F.transform(v, lambda x: held(x * F.lit(float(scale)))).alias("v"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    d = a - b
    return (d * d).sum(axis=-1)


class Tree:
    """A vantage-point tree: node i holds a centroid; ``inner`` holds those within the median distance of it, ``outer`` the rest.

    Every child is kept with the least and largest distance of its members to the parent's centroid.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.point, self.children = [], []
        if len(centroids):
            self.grow(list(range(len(centroids))))

    def grow(self, members: list[int]) -> int:
        node, here = len(self.point), members[0]
        self.point.append(here)
        self.children.append([])
        rest = members[1:]
        if rest:
            d = np.sqrt(squared(self.centroids[rest], self.centroids[here]).astype(np.float64))
            order = np.argsort(d, kind="stable")
            for part in np.array_split(order, 2):
                if len(part):
                    self.children[node].append((self.grow([rest[i] for i in part]), float(d[part].min()), float(d[part].max())))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and exact squared distance of each vector's nearest centroid; all vectors search at once, each in its own order."""
        n = len(vectors)
        bound = np.full((n, len(self.point)), np.inf)
        bound[:, 0] = 0
        best, number = np.full(n, -1, vectors.dtype), np.full(n, len(self.point))
        reach, live, point = np.full(n, np.inf), np.arange(n), np.array(self.point)
        while len(live):
            node = bound[live].argmin(axis=1)
            least = bound[live, node]
            go = (least < np.inf) & (least <= reach[live])
            live, node = live[go], node[go]
            if not len(live):
                break
            bound[live, node] = np.inf
            here = point[node]
            exact = squared(vectors[live], self.centroids[here])
            old = best[live]
            better = (number[live] == len(point)) | (exact < old) | ((exact == old) & (here < number[live]))
            best[live[better]], number[live[better]] = exact[better], here[better]
            d = np.sqrt(exact.astype(np.float64))
            reach[live] = np.minimum(reach[live], d * (1 + 1e-9))
            for parent in np.unique(node):
                at = node == parent
                rows, dist = live[at], d[at]
                for child, lo, hi in self.children[parent]:
                    slack = 1e-9 * (dist + hi)
                    bound[rows, child] = np.maximum(0, np.maximum(dist - hi, lo - dist) - slack)
        return number, best


def exact_rows(batch: pa.RecordBatch, column: str, size: int) -> np.ndarray:
    """A batch's vectors, as 64-bit integers where nothing can overflow, else as Python's."""
    rows = matrix(batch.column(column))
    return rows if max(size, int(rows.max(initial=0)), -int(rows.min(initial=0))) <= SMALL else rows.astype(object)


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of every row; ``distance`` is a decimal, as it may pass a long."""
    size = max((abs(x) for c in centroids for x in c), default=0)

    def run(batches):
        trees: dict = {}
        for batch in batches:
            v = exact_rows(batch, "v", size)
            if v.dtype not in trees:
                trees[v.dtype] = Tree(np.array(centroids, v.dtype))
            number, best = trees[v.dtype].nearest(v)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()), pa.array(np.minimum(best, LONG).astype(np.int64))], ["id", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: floors of the exact means of their vectors; without vectors they stay."""
    size, width = max((abs(x) for c in centroids for x in c), default=0), len(centroids[0]) if centroids else 0
    wide = pa.decimal128(38, 0)

    def run(batches):
        trees: dict = {}
        for batch in batches:
            v = exact_rows(batch, "v", size)
            if v.dtype not in trees:
                trees[v.dtype] = Tree(np.array(centroids, v.dtype))
            number, _ = trees[v.dtype].nearest(v)
            held = np.unique(number)
            sums = [[Decimal(int(x)) for x in v[number == k].sum(axis=0)] for k in held]
            counts = [int((number == k).sum()) for k in held]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(wide))], ["cluster", "n", "sums"])

    parts = rows.mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    at = [F.sum(F.col("sums")[j]).cast("decimal(38,0)").alias(f"s{j}") for j in range(width)]
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *at).collect():
        out[r.cluster] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    return out


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector that takes part, and the final centroids."""
    rows = cut(integer_vectors(vectors, scale, width, id_col, vector_col), "cluster-vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    centroids = [list(r.v) for r in rows.select(name.alias("name"), "v").orderBy("name", "v").limit(clusters).collect()]
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    return assigned(rows, centroids), centroids


def report(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """One row per vector that takes part: its id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``."""
    found, centroids = cluster(vectors, id_col=id_col, **options)
    found = cut(found, "clusters")
    limit = F.lit(Decimal(LONG)).cast("decimal(38,0)")
    held = lambda c: F.least(c, limit).cast("long")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("decimal(38,0)").alias("s"))
    totals = {r.cluster: int(r.s) for r in sums.collect()}
    whole = sum(totals.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = [(k, Decimal(totals[k]), sha[k]) for k in sorted(totals)]
    named = vectors.sparkSession.createDataFrame(told, "cluster int, s decimal(38,0), centroid_sha256 string")
    out = found.join(F.broadcast(named), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", held(F.col("s")).alias("cluster_inertia"), F.lit(min(whole, LONG)).cast("long").alias("inertia"), "centroid_sha256")

"""Exact n-gram Jaccard join by PartEnum signatures.

Two texts link when ``den * |A & B| >= num * |A | B|``. Method:

1. *Bands.* Set sizes are cut into bands [l, r]; linked sets lie in one band or in neighbouring ones, so a set
   signs for its own band and, if a larger partner may lie beyond r, for the next. Inside a band a linked pair
   differs in at most k = 2r(den-num)/(den+num) elements.
2. *Signatures.* The 64-bit feature domain is cut into n1 ranges, each into n2 smaller ones. Some range then
   holds at most k2 = k // n1 differences, which touch at most k2 of its small ranges, so for some subset of
   n2 - k2 small ranges both sets hold the same elements. A set's signatures are the digests of all
   those subsets: **every linked pair shares a signature**, without exception.
   Signatures that occur once tie nothing: counting them first, and filtering through a bitmap of the repeated ones,
   keeps most of them out of the later shuffles.
3. *Candidate pairs.* Equal sets are one node. The nodes of a signature meet under its smallest node, their anchor: a row for
   (anchor, node), however many signatures the two share, so these rows grow with the signatures and never with the pairs. The sets of
   an anchor are compared by size and by sketch: the parities of a set's elements in at least as many classes as it has elements,
   1024 or more. Two sketches differ in no more places than the sets in elements, so both bounds are exact: no linked pair goes. An
   anchor of more than ``SPLIT`` nodes is dealt into blocks, every pair of blocks in one task. The components of what passes, over
   all anchors, are the clusters; sets that merely share a signature form none.
4. *Verification.* Sets of clustered nodes, one row's a node (found again through a bitmap of fixed size), are compared exactly.
   A cluster above ``block`` nodes or ``BLOCK_ELEMENTS`` elements is dealt into blocks, and every pair of blocks is one task, so no task
   holds more than two blocks. Tasks return a spanning forest and link counts, not pairs.

Defined results: a null, empty or white text has ``n_shingles`` 0 and links with nothing; equal rows
link with each other; a null id takes part and is never a component id unless its whole component has none;
other columns are ignored. Nodes are named by a 64-bit digest of their set.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import bitmap, components, mix64, without
from tidebook.llm.shingles import BASE, shingle_sets
from tidebook.session import cut


#: bits of the map of repeated signatures (8 MB a task), and the most it grows to when these are many (64 MB)
SIGN_BITS, MAX_BITS = 26, 29
#: 64-bit words of the smallest sketch
WORDS = 16
#: nodes of an anchor and elements of a block above which they are dealt into more
SPLIT, BLOCK_ELEMENTS = 4096, 1_000_000


class Scheme:
    """Bands and signature shapes for a threshold num/den."""

    def __init__(self, num: int, den: int, growth: float = 1.25):
        self.num, self.den, self.growth = num, den, growth
        self.upper = [1]
        self.shapes: dict[int, tuple] = {}

    def band(self, n: int) -> int:
        while self.upper[-1] < n:
            low = self.upper[-1] + 1
            self.upper.append(max(low, int(low * self.growth)))
        return int(np.searchsorted(self.upper, n))

    def bands_of(self, n: int) -> list[int]:
        own = self.band(n)
        beyond = n * self.den // self.num > self.upper[own]
        if beyond:
            self.band(self.upper[own] + 1)
        return [own, own + 1] if beyond else [own]

    def shape(self, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower bounds of the small ranges as (n1, n2), the subsets, and a salt for every (range, subset)."""
        if band in self.shapes:
            return self.shapes[band]
        k = 2 * self.upper[band] * (self.den - self.num) // (self.den + self.num)
        n1, n2, k2 = {0: (1, 1, 0), 1: (1, 4, 1), 2: (1, 5, 2)}.get(k, (-(-(k + 1) // 2), 3, 1))
        subsets = np.array(list(combinations(range(n2), n2 - k2)), np.int64)
        parts = n1 * n2
        bounds = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
        names = (np.uint64(band) << np.uint64(48)) + (np.arange(n1, dtype=np.uint64)[:, None] << np.uint64(8)) + np.arange(len(subsets), dtype=np.uint64)
        self.shapes[band] = bounds, subsets, mix64(names + np.uint64(1))
        return self.shapes[band]

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """All signatures of one sorted set of hashes."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(elements ^ np.uint64(BASE)), dtype=np.uint64)])
        out = []
        for band in self.bands_of(len(elements)):
            bounds, subsets, salt = self.shape(band)
            at = np.append(np.searchsorted(elements, bounds), len(elements))
            parts = (sums[at[1:]] - sums[at[:-1]]).reshape(salt.shape[0], -1)
            out.append(mix64(parts[:, subsets].sum(axis=2, dtype=np.uint64) + salt).ravel())
        return np.concatenate(out)


def node_of(elements: np.ndarray) -> int:
    """The 64-bit name of a set."""
    total = mix64(elements ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(mix64(np.array([total + np.uint64(len(elements))], np.uint64)).view(np.int64)[0])


def pieces(batches, rows: int = 1000):
    """Arrow batches in slices, so that a task holds the sets of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bits_for(keys: int, least: int) -> int:
    """Bits of a bitmap in which at most one slot in 16 is taken, from ``least`` up to MAX_BITS."""
    return min(MAX_BITS, max(least, (16 * keys).bit_length()))


def named_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, n_shingles, node) per row of (id, text)."""
    fields = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            sets = shingle_sets(batch.column("text"), width)
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())], ["id", "n_shingles", "node"])

    return docs.mapInArrow(run, f"id {fields}, n_shingles long, node long")


def sketch(elements: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Parities of the elements in 64 * words classes."""
    odd = np.bincount((mix64(elements) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signed(docs: DataFrame, width: int, num: int, den: int, copied, held=None) -> DataFrame:
    """The signatures of all sets, a node's once (of copies, whose bitmaps are those of their nodes and of their representatives, one signs): (sig), or (sig, node) of those that the bitmap may hold."""
    names = ["sig"] if held is None else ["sig", "node"]

    def run(batches):
        scheme = Scheme(num, den)
        for batch in pieces(batches):
            first, out = {}, []
            for s, key in zip(shingle_sets(batch.column("text"), width), batch.column("key").to_pylist(), strict=True):
                if len(s):
                    node = node_of(s)
                    if not copied[0].might_hold(np.array([node])) or copied[1].might_hold(np.array([node ^ key])):
                        first.setdefault(node, s)
            for node, s in first.items():
                sigs = np.unique(scheme.signatures(s)).view(np.int64)
                if held is None:
                    out.append((sigs,))
                    continue
                sigs = sigs[held.might_hold(sigs)]
                out.append((sigs, np.full(len(sigs), node, np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return docs.select(F.xxhash64("id").alias("key"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def representative(node, key):
    """Names a row among those of its node; ``key`` is a hash of its id."""
    return F.col(node).bitwiseXOR(key)


def sets_of(docs: DataFrame, held, width: int, shape=np.ndarray.tobytes) -> DataFrame:
    """(node, elements) of rows of (id, text) that the bitmap of representatives may hold, once per slice of a batch, in the given shape."""

    def run(batches):
        for batch in pieces(batches):
            sets, keys, first = shingle_sets(batch.column("text"), width), batch.column("key").to_numpy(), {}
            rows = [i for i, s in enumerate(sets) if len(s)]
            nodes = np.array([node_of(sets[i]) for i in rows], np.int64)
            keep = held.might_hold(nodes ^ keys[rows]) if len(rows) else np.zeros(0, bool)
            for i, node, kept in zip(rows, nodes.tolist(), keep, strict=True):
                if kept:
                    first.setdefault(node, i)
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int64()), pa.array([shape(sets[i]) for i in first.values()], pa.binary())], ["node", "elements"])

    return docs.select(F.xxhash64("id").alias("key"), "text").mapInArrow(run, "node long, elements binary")


def wide_sketch(elements: np.ndarray) -> bytes:
    """Parities in a power of two of classes, 64 * WORDS or the first that is not below the number of elements."""
    return sketch(elements, max(WORDS, (1 << (len(elements) - 1).bit_length()) // 64)).tobytes()


def wide_forest(sizes: np.ndarray, sketches: list[bytes], side: np.ndarray, num: int, den: int) -> np.ndarray:
    """The smallest index reachable over the pairs that sizes and wide sketches allow to link; across two blocks where ``side`` differs.

    The larger set of such a pair has the same number of classes or twice as many, which fold into one half."""
    widths, two = np.array([len(s) for s in sketches]), side.any() and not side.all()
    ends: list = [[], []]
    for width in np.unique(widths):
        own, above = (np.flatnonzero(widths == w) for w in (width, 2 * width))
        own, above = own[np.argsort(sizes[own], kind="stable")], above[np.argsort(sizes[above], kind="stable")]
        grid = np.array([np.frombuffer(sketches[i], np.uint64) for i in own])
        if len(above):
            halves = np.array([np.frombuffer(sketches[i], np.uint64).reshape(2, -1) for i in above])
            grid = np.concatenate([grid, halves[:, 0] ^ halves[:, 1]])
        rows = np.concatenate([own, above])
        held = sizes[rows]
        upto = np.searchsorted(held, held[: len(own)] * den // num, "right")
        for i, to in enumerate(upto):
            ok = may_link(held, grid, i, slice(i + 1, to), num, den)
            if two:
                ok &= side[rows[i + 1 : to]] != side[rows[i]]
            partner = rows[i + 1 : to][ok]
            ends[0].append(np.full(len(partner), rows[i]))
            ends[1].append(partner)
    return forest(len(sizes), *(np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends))


def may_link(sizes: np.ndarray, sketches: np.ndarray, a, b, num: int, den: int) -> np.ndarray:
    """Whether sizes and sketches of the rows a and b allow a link: A and B differ in at most (den-num)/(den+num) of |A| + |B| elements."""
    x, y = sizes[a], sizes[b]
    differ = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=-1, dtype=np.int64)
    return (den * np.minimum(x, y) >= num * np.maximum(x, y)) & (differ * (den + num) <= (x + y) * (den - num))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n, over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def starred(edges: DataFrame, name: str) -> DataFrame:
    """Edges of the same components: a node keeps the smallest of its roots, and its other roots are tied to that one."""
    near = cut(edges.groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots")), name)
    others = near.select(F.explode("roots").alias("node"), "low").filter("node <> low")
    return near.select("node", "low").unionByName(others).distinct().withColumnRenamed("low", "root")


def candidates(texts: DataFrame, copies: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(cluster, node): all nodes of a repeated signature, with the smallest of them as their cluster; a node may be in several."""
    several = copies.filter("copies > 1").select("node", representative("node", F.xxhash64("first")).alias("row"))
    copied = bitmap(several, "node"), bitmap(several, "row")
    twice = cut(signed(texts, width, num, den, copied).groupBy("sig").count().filter("count > 1").select("sig"), "partenum-repeated")
    held = bitmap(twice, "sig", bits_for(twice.count(), SIGN_BITS))
    posted = cut(signed(texts, width, num, den, copied, held), "partenum-posted")
    anchors = posted.groupBy("sig").agg(F.min("node").alias("cluster"), F.max("node").alias("last")).filter("cluster < last")
    return posted.join(anchors.select("sig", "cluster"), "sig").select("cluster", "node").distinct()


def overlaps(sets: list[np.ndarray], slab: int = 8192) -> np.ndarray:
    """Intersection sizes of all pairs of a bounded list of sets, by blocks of features."""
    _, feature, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(counts > 1) - 1
    shared = counts[feature] > 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[shared]
    feature = rank[feature[shared]]
    order = np.argsort(feature, kind="stable")
    owner, feature = owner[order], feature[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(feature[-1]) + 1 if len(feature) else 0, slab):
        a, b = np.searchsorted(feature, [low, low + slab])
        grid = np.zeros((len(sets), slab), np.float32)
        grid[owner[a:b], feature[a:b] - low] = 1
        out += grid @ grid.T
    return out


def link_block(nodes: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, linked copies) per node: exact links inside one block, or across two where ``side`` differs."""
    sizes = np.array([len(s) for s in sets], np.int64)
    common = overlaps(sets).astype(np.int64)
    linked = den * common >= num * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, False)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    root = np.arange(len(nodes))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(*np.nonzero(np.triu(linked)), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return nodes[[find(x) for x in range(len(nodes))]], linked @ copies


def blocks_of(members: DataFrame, sets: DataFrame, block: int, elements: int) -> DataFrame:
    """(cluster, node, copies, n_shingles) and (node, elements) joined, with every pair of a cluster in exactly one (cluster, x, y).

    Blocks are dealt before the sets join, so sets move to their node and then to their tasks, no further."""
    most = F.greatest(F.count("*") / block, F.sum("n_shingles") / elements)
    blocks = members.groupBy("cluster").agg(F.ceil(most).cast("long").alias("blocks"))
    dealt = members.join(blocks, "cluster").join(sets, "node").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("cluster", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "copies", "n_shingles", "elements", (F.col("own") > F.col("other")).alias("side"))


def refined(members: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root): edges whose components hold every pair of a cluster that wide sketches allow to link."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        nodes = group["node"].to_numpy()
        root = wide_forest(group["n_shingles"].to_numpy(), list(group["elements"]), group["side"].to_numpy(bool), num, den)
        moved = root != np.arange(len(nodes))
        return pd.DataFrame({"node": nodes[moved], "root": nodes[root[moved]]})

    return blocks_of(members, sketches, SPLIT, 16 * BLOCK_ELEMENTS).groupBy("cluster", "x", "y").applyInPandas(run, "node long, root long")


def verify(members: DataFrame, sets: DataFrame, block: int, num: int, den: int) -> DataFrame:
    """(node, root, links) per task from (cluster, node, copies, n_shingles) and (node, elements)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(e, np.uint64) for e in group["elements"]]
        nodes = group["node"].to_numpy()
        root, links = link_block(nodes, sets, group["copies"].to_numpy(), group["side"].to_numpy(bool), num, den)
        return pd.DataFrame({"node": nodes, "root": root, "links": links})

    return blocks_of(members, sets, block, BLOCK_ELEMENTS).groupBy("cluster", "x", "y").applyInPandas(run, "node long, root long, links long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100, block: int = 256) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``n_links`` (rows linked directly)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(named_sets(texts, width), "partenum-rows")
    copies = rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.min("n_shingles").alias("n_shingles"))
    copies = cut(copies, "partenum-nodes")

    def shaped(members, shape):
        held = bitmap(members.select(representative("node", F.xxhash64("first")).alias("row")), "row", bits_for(members.count(), 22))
        return sets_of(texts, held, width, shape).dropDuplicates(["node"])

    met = cut(candidates(texts, copies, width, num, den).join(copies, "node"), "partenum-candidates")
    edges = cut(refined(met, shaped(met, wide_sketch), num, den), "partenum-refined")
    clusters = components(starred(edges, "partenum-stars"), "node", "root", "partenum-cluster")
    members = cut(clusters.select("node", F.col("component").alias("cluster")).join(copies, "node"), "partenum-members")
    sets = shaped(members, np.ndarray.tobytes)
    found = cut(verify(members.select("cluster", "node", "copies", "n_shingles"), sets, block, num, den), "partenum-links")

    groups = components(starred(found.filter("node <> root").select("node", "root"), "partenum-forest"), "node", "root", "partenum-group")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = copies.join(groups, "node", "left").join(links, "node", "left").withColumn("group", F.coalesce("component", "node"))
    named = cut(named, "partenum-named")
    smallest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "group").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "n_shingles", "node").join(named, "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", width: int = 5, num: int = 80, den: int = 100, **params) -> DataFrame:
    """The rows of ``docs`` without those that link to an earlier one: of every component its smallest id stays.

    Rows without words all stay, and so do rows without an id, which cannot be named. Rows that repeat an id
    and a text are one document and stay once; an id is taken to name one text.

    Links take five words and a similarity of 0.8, and signatures are taken of the same sets by the same threshold, so
    every linked pair is compared, also one that differs in a single passage.
    """
    labels = cut(jaccard_join(docs, id_col, width=width, num=num, den=den, **params), "partenum-labels")
    later = labels.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_later")).distinct()
    out = without(docs, later, F.col(id_col) == F.col("_later"), "partenum-later")
    again = cut(labels.groupBy(id_col).count().filter("count > 1").select(id_col), "partenum-again")
    if again.isEmpty():
        return out
    return out.join(again, id_col, "left_anti").unionByName(out.join(again, id_col, "left_semi").dropDuplicates())

"""Embedding near-dedup with a random-projection tree forest (operator 12).

Vectors of one label link when their cosine (in double precision) is at least
``threshold``. Candidates come from a forest: ``trees`` trees split the vectors
of a label again and again at the median of a random projection. Vectors
within a margin of the median go to both sides (spill overlap), so close pairs
are seldom parted, and a pair is lost only if every tree parts it. All trees
grow level by level, one Spark round a level; a node's quartiles are counted
before anything is shuffled, so a label with a third of all rows is only a
tree with more levels. Within leaves every pair is compared; what passes is a
link, nothing else is.

* Equal vectors of a label are one node with a count.
* Pairs are counted, not listed: a pair that shares several leaves counts in
  the one with the smallest number, which each of the two rows carries along.
  Components come from a spanning forest of every leaf's links.
* A node whose projections lie so close that splitting would copy most of it
  is a dense leaf. Members within half the threshold's angle of its centre
  (its core) are all linked with each other by the triangle inequality: they
  are counted by their number. Other pairs of a large dense leaf are compared
  in blocks, block against block, each in a task's memory.

Labels of at most ``leaf`` different vectors are one leaf: compared whole.
Others can lose pairs near the threshold; the tests measure the share found
(pairs of cosine just above 0.93 included), and README states it.

Defined results: vectors that are null, zero or hold a null or non-finite
component, and rows without label, link with nothing; nor do vectors of
different lengths. Repeated rows link with each other. ``component_id`` is the
smallest non-null id reachable (null if there is none); a row without id is
kept only if that is null too. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

THRESHOLD = 0.93
TREES = 4
LEAF = 512  # vectors compared with one another without further splits
BLOCK = 4096  # vectors of a dense leaf that a task holds, twice
SPILL = 0.5  # margin, as a share of a threshold pair's typical projected distance
STALLS = 3  # rounds a node waits for a direction that parts it
PAIRS = 1 << 16  # verified pairs looked at at once


def _vectors(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, x, g (label and length; null if the row links with nothing), k1, k2 (128-bit key of its vector)."""
    x = F.col(vector)
    wrong = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = F.exists(x, lambda c: c != 0)
    usable = F.col(label).isNotNull() & x.isNotNull() & F.coalesce(some, F.lit(False)) & ~F.coalesce(wrong, F.lit(True))
    g = F.when(usable, F.concat_ws(":", F.size(x), F.col(label).cast("string")))
    return rows.select(F.col(vec_id).alias("vec_id"), x.alias("x"), g.alias("g"),
                       F.xxhash64(F.lit(1), F.col(label), x).alias("k1"), F.xxhash64(F.lit(2), F.col(label), x).alias("k2"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so that squares stay finite."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors ``x`` have one length."""
    sizes = np.diff(batch.column("x").offsets.to_numpy())
    for n in np.unique(sizes):
        yield batch if (sizes == n).all() else batch.take(pa.array(np.flatnonzero(sizes == n)))


def _projected(state: DataFrame, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _by_length(whole) if whole.num_rows else ():
                x, tree = _matrix(b.column("x")), b.column("tree").to_numpy()
                p = np.zeros(len(x))
                for t in np.unique(tree):
                    way = np.random.default_rng([int(t), level, x.shape[1]]).standard_normal(x.shape[1])
                    own = tree == t
                    p[own] = x[own] @ (way / np.linalg.norm(way))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "p"])
    names = ["node", "g", "x", "tree", "path", "stall"]
    kind = state.schema["x"].dataType.simpleString()
    return state.select(*names).mapInArrow(run, f"node long, g string, x {kind}, tree int, path long, stall int, p double")


def forest(distinct: DataFrame, threshold: float, trees: int, leaf: int, spill: float) -> tuple[DataFrame, DataFrame]:
    """(node, g, leaf) for every leaf that a vector is in, and the dense leaves' ids."""
    sizes = materialize(distinct.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "forest-groups")
    large = sizes.where(F.col("n") > leaf).select("g")
    done = [distinct.join(large, "g", "left_anti").select("node", "g", F.lit(0).alias("tree"), F.lit(1).cast("long").alias("path"),
                                                         F.lit(False).alias("dense"))]
    state = distinct.join(large, "g", "left_semi").select(
        "node", "g", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("path"), F.lit(0).alias("stall"))
    margin = F.lit(spill * np.sqrt(2 - 2 * threshold)) / F.sqrt(F.size("x"))
    level = 0
    while not (state := materialize(_projected(state, level), "forest")).isEmpty():
        quarters = F.percentile_approx("p", [0.25, 0.5, 0.75], 1000)
        split = state.groupBy("g", "tree", "path").agg(F.count(F.lit(1)).alias("n"), quarters.alias("q"))
        split = materialize(split, "forest-splits")  # its written size decides how it is joined
        told = state.join(split, ["g", "tree", "path"]).withColumn("margin", margin)
        parts = (F.col("q")[2] - F.col("q")[0] >= 4 * F.col("margin")) & (F.col("path") < (1 << 61))
        ends = (F.col("n") <= leaf) | (~parts & (F.col("stall") >= STALLS))
        done.append(told.where(ends).select("node", "g", "tree", "path", (F.col("n") > leaf).alias("dense")))
        sides = F.when(~parts, F.array(F.col("path"))).otherwise(F.filter(F.array(
            F.when(F.col("p") < F.col("q")[1] + F.col("margin"), 2 * F.col("path")),
            F.when(F.col("p") >= F.col("q")[1] - F.col("margin"), 2 * F.col("path") + 1)), lambda v: v.isNotNull()))
        state = told.where(~ends).select("node", "g", "x", "tree", F.explode(sides).alias("path"),
                                         F.when(parts, F.lit(0)).otherwise(F.col("stall") + 1).alias("stall"))
        level += 1
    every = reduce(DataFrame.unionByName, done).select("node", "g", F.xxhash64("g", "tree", "path").alias("leaf"), "dense")
    every = materialize(every.distinct(), "forest-leaves")
    return every, every.where("dense").groupBy("leaf", "g").agg(F.count(F.lit(1)).alias("n"))


def _cores(members: DataFrame, distinct: DataFrame, dense: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, core): members within half the angle of a large dense leaf's centre; of several the smallest."""
    big = dense.where(F.col("n") > block).select("leaf")
    own = materialize(members.join(big, "leaf").select("node", "leaf").join(distinct.select("node", "x"), "node"), "dense-members")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _by_length(whole) if whole.num_rows else ():
                leaves, at = np.unique(b.column("leaf").to_numpy(), return_inverse=True)
                total = np.zeros((len(leaves), len(b.column("x")[0])))
                np.add.at(total, at, _matrix(b.column("x")))
                width = total.shape[1]
                yield pa.RecordBatch.from_arrays([np.repeat(leaves, width), np.tile(np.arange(width, dtype=np.int32), len(leaves)), total.ravel()],
                                                 names=["leaf", "i", "s"])

    sums = own.select("leaf", "x").mapInArrow(added, "leaf long, i int, s double").groupBy("leaf", "i").agg(F.sum("s").alias("s"))
    centres = sums.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("centre"))
    # half the angle, a little less: a core's members are linked whatever rounding does
    near = float(np.cos(np.arccos(threshold) / 2 - 1e-7))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _by_length(whole) if whole.num_rows else ():
                c = b.column("centre").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                with np.errstate(all="ignore"):
                    cos = (_matrix(b.column("x")) * c).sum(1) / np.sqrt((c * c).sum(1))
                yield b.select(["node", "leaf"]).filter(pa.array(cos >= near))

    placed = own.join(materialize(centres, "centres"), "leaf").select("node", "leaf", "x", "centre")
    inside = placed.mapInArrow(within, "node long, leaf long")
    return materialize(inside.groupBy("node").agg(F.min("leaf").alias("core")), "cores")


def _dealt(members: DataFrame, distinct: DataFrame, cores: DataFrame, dense: DataFrame, block: int) -> DataFrame:
    """Rows per comparison cell (leaf, i, j): block i of the leaf against block j.
    Blocks of members of the leaf's own core never meet one another."""
    leaves = members.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    rows = distinct.select("node", "g", "x", "m").join(leaves, "node").join(cores, "node", "left")
    rows = materialize(rows, "forest-rows")
    big = materialize(dense.where(F.col("n") > block).select("leaf"), "big-leaves")
    flat = rows.select("node", "g", "x", "m", "core", "leaves", F.explode("leaves").alias("leaf"))
    zero = F.lit(0)
    small = flat.join(big, "leaf", "left_anti").select("*", zero.alias("i"), zero.alias("j"), F.lit(False).alias("right"))
    if big.isEmpty():
        return small
    own = flat.join(big, "leaf", "left_semi")
    held = own.groupBy("leaf", "core").agg(F.count(F.lit(1)).alias("c"))
    main = held.groupBy("leaf").agg(F.sum("c").alias("n"), F.max(F.when(F.col("core").isNotNull(), F.struct("c", "core"))).alias("most"))
    main = materialize(main.select("leaf", F.coalesce(F.col("most.core"), F.lit(-1)).alias("main"), F.coalesce(F.col("most.c"), F.lit(0)).alias("c"),
                                   "n", F.col("most").isNotNull().alias("has")), "main-cores")
    nc, nr = F.ceil(F.col("c") / block).cast("int"), F.ceil((F.col("n") - F.col("c")) / block).cast("int")
    told = own.join(main, "leaf").withColumn("nc", nc).withColumn("nr", nr).withColumn(
        "inner", F.col("has") & F.coalesce(F.col("core") == F.col("main"), F.lit(False)))
    h = F.xxhash64(F.lit("block"), "node")
    at = F.when(F.col("inner"), F.pmod(h, F.greatest("nc", F.lit(1)))).otherwise(F.col("nc") + F.pmod(h, F.greatest("nr", F.lit(1)))).cast("int")
    told = told.withColumn("at", at).withColumn("last", F.col("nc") + F.col("nr") - 1)
    upto = F.when(F.col("inner"), F.col("nc")).otherwise(F.col("at"))
    later = F.when(upto <= F.col("last"), F.sequence(upto, F.col("last"))).otherwise(F.array().cast("array<int>"))
    earlier = F.when(~F.col("inner") & (F.col("at") > 0), F.sequence(F.lit(0), F.col("at") - 1)).otherwise(F.array().cast("array<int>"))
    cells = F.concat(F.transform(later, lambda v: F.struct(F.col("at").alias("i"), v.alias("j"), F.lit(False).alias("right"))),
                     F.transform(earlier, lambda v: F.struct(v.alias("i"), F.col("at").alias("j"), F.lit(True).alias("right"))))
    spread = told.select("node", "g", "x", "m", "core", "leaves", "leaf", F.explode(cells).alias("cell"))
    return small.unionByName(spread.select("node", "g", "x", "m", "core", "leaves", "leaf", "cell.i", "cell.j", "cell.right"))


class _Cell:
    """The rows of one comparison cell: which of them link, each pair once."""

    def __init__(self, rows: pa.Table, leaf: int, same: bool, threshold: float):
        right = rows.column("right").to_numpy(zero_copy_only=False).astype(bool)
        self.x = _matrix(rows.column("x").combine_chunks())
        self.node, self.m = rows.column("node").to_numpy(), rows.column("m").to_numpy()
        core = rows.column("core")
        self.has = ~core.is_null().to_numpy().astype(bool)
        self.core = core.fill_null(0).to_numpy()
        leaves = rows.column("leaves").combine_chunks()
        size = np.diff(leaves.offsets.to_numpy())
        # leaves with smaller numbers than this one: a pair that shares one was counted there
        self.earlier = np.full((len(size), max(size, default=1)), leaf, np.int64)
        row = np.repeat(np.arange(len(size)), size)
        self.earlier[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = leaves.flatten().to_numpy()
        self.leaf, self.same, self.threshold = leaf, same, threshold
        self.left = np.arange(len(size)) if same else np.flatnonzero(~right)
        self.right = self.left if same else np.flatnonzero(right)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, (1 << 21) // max(1, len(self.right)))
        for at in range(0, len(self.left), step):
            own = self.left[at:at + step]
            hit = self.x[own] @ self.x[self.right].T >= self.threshold
            i, j = np.nonzero(hit)
            i, j = own[i], self.right[j]
            new = ~(self.has[i] & self.has[j] & (self.core[i] == self.core[j]))
            if self.same:
                new &= i < j
            i, j = i[new], j[new]
            for k in range(0, len(i), PAIRS):
                a, b = i[k:k + PAIRS], j[k:k + PAIRS]
                first = np.ones(len(a), bool)
                for c in range(self.earlier.shape[1]):
                    e = self.earlier[a, c]
                    first &= (e >= self.leaf) | ~(self.earlier[b] == e[:, None]).any(1)
                yield a, b, first

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(links by row, u, v): u-v is a spanning forest of the cell's links."""
        n = np.zeros(len(self.node), np.int64)
        root = np.arange(len(self.node))
        u, v = [], []
        for i, j, first in self.pairs():
            np.add.at(n, i[first], self.m[j[first]])
            np.add.at(n, j[first], self.m[i[first]])
            while True:  # links between different trees of the forest so far
                apart = root[i] != root[j]
                if not apart.any():
                    break
                i, j = i[apart], j[apart]
                # of every tree's links out, the one to the smallest root; taken one after the other
                _, at = np.unique(root[i], return_index=True)
                for a, b in zip(i[at].tolist(), j[at].tolist(), strict=True):
                    ra, rb = root[a], root[b]
                    if ra != rb:
                        root[root == max(ra, rb)] = min(ra, rb)
                        u.append(a)
                        v.append(b)
        return n, self.node[np.array(u, int)], self.node[np.array(v, int)]


def _compared(dealt: DataFrame, threshold: float) -> DataFrame:
    """node, n (links added, weighted by copies), other (null, or a node it links with)."""
    keys = ["leaf", "g", "i", "j"]

    def told(rows: list[pa.RecordBatch], key: tuple) -> pa.RecordBatch:
        leaf, _, i, j = key
        cell = _Cell(pa.Table.from_batches(rows), leaf, i == j, threshold)
        n, u, v = cell.links()
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays(
            [np.concatenate([cell.node[some], u]), np.concatenate([n[some], np.zeros(len(u), np.int64)]),
             pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(v, pa.int64())])], names=["node", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_pylist() for k in keys]
            edges = [0, *(r for r in range(1, b.num_rows) if any(c[r] != c[r - 1] for c in cols)), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                key = tuple(c[lo] for c in cols)
                if key != now and held:
                    yield told(held, now)
                    held = []
                now = key
                held.append(b.slice(lo, hi - lo))
        if held:
            yield told(held, now)

    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_rows = dealt.repartition(parts, *keys).sortWithinPartitions(*keys)
    return sorted_rows.select("node", "m", "x", "core", "leaves", *keys, "right").mapInArrow(run, "node long, n long, other long")


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
                 trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, spill: float = SPILL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows``."""
    spark = rows.sparkSession
    every = _vectors(rows, vec_id, vector, label)
    groups = every.where("g is not null").groupBy("g", "k1", "k2").agg(
        F.first("x").alias("x"), F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"))
    distinct = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")
    members, dense = forest(distinct, threshold, trees, leaf, spill)
    cores = (_cores(members, distinct, dense, threshold, block) if not dense.where(F.col("n") > block).isEmpty()
             else spark.createDataFrame([], "node long, core long"))
    told = materialize(_compared(_dealt(members, distinct, cores, dense, block), threshold), "vector-links")
    of_core = distinct.select("node", "m").join(cores, "node")
    core_sums = of_core.groupBy("core").agg(F.sum("m").alias("all"), F.min("node").alias("head"))
    in_core = materialize(of_core.join(core_sums, "core").select("node", (F.col("all") - F.col("m")).alias("n"), F.col("head").alias("other")), "core-links")
    edges = told.where("other is not null").union(in_core).select(F.col("node").alias("u"), F.col("other").alias("v"))
    counts = told.select("node", "n").union(in_core.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(edges)
    placed = distinct.select("node", "g", "k1", "k2", "m", "least").join(roots, "node", "left").join(counts, "node", "left")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "node")), "vector-roots")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    result = placed.join(least, "root").select("g", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    ids = every.select("vec_id", "g", "k1", "k2")
    linked = ids.where("g is not null").join(result, ["g", "k1", "k2"]).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = ids.where("g is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)

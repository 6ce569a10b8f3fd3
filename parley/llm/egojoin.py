"""Embedding near-duplicates: epsilon grid order join on principal dimensions.

Unit vectors with cosine of at least ``cosine`` lie within
``eps = sqrt(2 - 2 * cosine)`` of each other.

1. Equal vectors are one class with a count, so copies enter the join once.
2. The leading principal dimensions come from a bounded sample
   (``SAMPLE`` classes by hash); they steer the order only, never the result.
3. Classes are sorted by their grid cells of side ``eps`` on those dimensions
   (a range partitioning) and cut into sequence intervals of ``block`` rows.
4. Blocks meet if their cell ranges touch on the first dimension (an equi-join
   on cells) and their boxes lie within ``eps`` of each other.
5. In a task a pair of blocks is joined recursively: intervals whose boxes are
   provably further apart than ``eps`` are skipped, others halved down to
   ``LEAF`` rows and multiplied as matrices in double precision.  Products
   within rounding of the threshold are recomputed as plain cosines.

A leaf reports the number of links per class and a spanning set of its links
(at most one per row and column), so output stays linear; components come from
the spanning links in DataFrames.  Every pair is compared or provably distant:
no candidate cap and no index that can miss.

Edge cases: null, empty and zero vectors and those with null or non-finite
components link with nothing and are kept; a shorter vector counts as padded
with zeros; repeated rows link with each other; rows with a null ``vec_id``
are compared and counted, but no component is named after them and they are
not kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import cut, pairs_to_components

COSINE = 0.9
DIMS = 6
BLOCK = 4096
LEAF = 512
SAMPLE = 8192
SLACK = 1e-9


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their class key (null where the vector cannot link), and classes."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.exists("embedding", lambda x: x != 0) & ~bad
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    key = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.reverse("embedding")).alias("b"))
    rows = rows.withColumn("key", F.when(F.col("good"), key)).drop("good")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    # A class is a node; without any id it gets one of its own below all others.
    node = F.coalesce("first_id", -(F.pmod(F.col("key.a"), F.lit(1 << 61))) - (1 << 61))
    return rows.select("vec_id", "key"), classes.withColumn("node", node)


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows, zero-padded to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and (lengths == width).all():
        x = flat.reshape(len(column), width).astype(float)
    else:
        x = np.zeros((len(column), width))
        at = 0
        for i, k in enumerate(lengths):
            x[i, :k] = flat[at : at + k]
            at += k
    scale = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(scale > 0, scale, 1)  # tiny and huge components do not under- or overflow
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _axes(classes: DataFrame, width: int, total: int) -> np.ndarray:
    share = min(1.0, SAMPLE / max(total, 1))
    picked = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("embedding").toArrow()
    x = _padded(picked.column(0).combine_chunks() if picked.num_rows else pa.array([], pa.list_(pa.float64())), width)
    if not len(x):
        return np.eye(width)[:, : min(DIMS, width)]
    values, vectors = np.linalg.eigh(x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0)))
    return vectors[:, np.argsort(-values)[: min(DIMS, width)]]


class _Join:
    """Recursive join of two sequence intervals."""

    def __init__(self, cosine: float, axes: np.ndarray):
        self.cosine, self.axes = cosine, axes
        self.reach = 2 - 2 * cosine + 1e-6

    def load(self, ids: np.ndarray, counts: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.counts, self.x, self.low = ids, counts, x, x @ self.axes
        self.links = np.zeros(len(ids), np.int64)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def distant(self, s: slice, t: slice) -> bool:
        p, q = self.low[s], self.low[t]
        gap = np.maximum(0, np.maximum(q.min(0) - p.max(0), p.min(0) - q.max(0)))
        return float(gap @ gap) > self.reach

    def run(self, s: slice, t: slice) -> None:
        n, m = s.stop - s.start, t.stop - t.start
        if not n or not m or s != t and self.distant(s, t):
            return
        if max(n, m) <= LEAF:
            self.leaf(s, t)
        elif s == t:
            left, right = _halves(s)
            self.run(left, left)
            self.run(left, right)
            self.run(right, right)
        elif n >= m:
            for half in _halves(s):
                self.run(half, t)
        else:
            for half in _halves(t):
                self.run(s, half)

    def leaf(self, s: slice, t: slice) -> None:
        p, q = self.x[s], self.x[t]
        dots = p @ q.T
        hit = dots >= self.cosine
        for i, j in np.argwhere(np.abs(dots - self.cosine) < SLACK):
            hit[i, j] = math.fsum(p[i] * q[j]) / math.sqrt(math.fsum(p[i] * p[i]) * math.fsum(q[j] * q[j])) >= self.cosine
        if s == t:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.links[s] += hit @ self.counts[t]
        if s != t:
            self.links[t] += hit.T @ self.counts[s]
        # Smallest label over the leaf's links, then one link per labelled row or column.
        rows, cols = self.ids[s].copy(), self.ids[t].copy()
        top = np.iinfo(np.int64).max
        while True:
            new_rows = np.minimum(rows, np.where(hit, cols, top).min(1))
            new_cols = np.minimum(cols, np.where(hit, new_rows[:, None], top).min(0))
            if (new_rows == rows).all() and (new_cols == cols).all():
                break
            rows, cols = new_rows, new_cols
        for ids, labels in ((self.ids[s], rows), (self.ids[t], cols)):
            moved = ids != labels
            self.a.append(ids[moved])
            self.b.append(labels[moved])


def _halves(s: slice) -> tuple[slice, slice]:
    mid = (s.start + s.stop) // 2
    return slice(s.start, mid), slice(mid, s.stop)


def _block_pairs(blocks: DataFrame, dims: int, reach: float) -> DataFrame:
    """``i, j`` (i <= j) of blocks that may hold a link."""
    p = blocks.select(F.col("block").alias("i"), "low", "high", F.explode(F.sequence("first_cell", "last_cell")).alias("cell")).alias("p")
    q = blocks.select(F.col("block").alias("j"), "low", "high", F.explode(F.sequence(F.col("first_cell") - 1, F.col("last_cell") + 1)).alias("cell")).alias("q")
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col("q.low")[d] - F.col("p.high")[d], F.col("p.low")[d] - F.col("q.high")[d]), 2) for d in range(dims)), F.lit(0.0))
    on = (F.col("p.cell") == F.col("q.cell")) & (F.col("i") <= F.col("j")) & (gap <= reach)
    return p.join(q, on).select("i", "j").distinct()


def embedding_near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``."""
    rows, classes = _classes(vectors)
    rows, classes = cut(rows), cut(classes)
    total, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    axes = _axes(classes, width, total)
    dims = axes.shape[1]
    eps = math.sqrt(max(2 - 2 * cosine, 1e-6))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = _padded(batch.column(2), width) @ axes
            spots = pa.array(list(low), pa.list_(pa.float64()))
            cells = pa.array(list(np.floor(low / eps).astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, spots, cells], names=["node", "n", "embedding", "spot", "cells"])

    placed = classes.select("node", "n", "embedding").mapInArrow(place, "node long, n long, embedding array<double>, spot array<double>, cells array<int>")
    order = [F.col("cells")[d] for d in range(dims)] + [F.col("spot")[0], F.col("node")]
    n_blocks = max(1, math.ceil(total / block))
    placed = placed.repartitionByRange(n_blocks, *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("at", F.monotonically_increasing_id()))
    # The rank of a row is its partition's offset plus its number in it (the
    # lower 33 bits), so blocks hold ``block`` rows whatever the partitions.
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # one row per partition
    offset = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("part", part).join(sizes.select("part", offset.alias("before")), "part")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(ranked.withColumn("block", F.floor(rank / block).cast("int")).drop("part", "before"))
    boxes = placed.groupBy("block").agg(
        F.array(*[F.min(F.col("spot")[d]) for d in range(dims)]).alias("low"),
        F.array(*[F.max(F.col("spot")[d]) for d in range(dims)]).alias("high"),
        F.min(F.col("cells")[0]).alias("first_cell"),
        F.max(F.col("cells")[0]).alias("last_cell"),
    )
    pairs = cut(_block_pairs(cut(boxes), dims, eps * eps + 1e-6))
    slim = placed.select("block", "at", "node", "n", "embedding")
    left = pairs.join(slim, pairs["i"] == slim["block"])
    right = pairs.where("i <> j").join(slim, pairs["j"] == slim["block"])
    members = left.unionByName(right).select("i", "j", "block", "at", "node", "n", "embedding")
    members = members.repartition("i", "j").sortWithinPartitions("i", "j", "at")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Join(cosine, axes)

        def done(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(part)
            block_no = whole.column("block").to_numpy()
            x = np.concatenate([_padded(b.column(6), width) for b in part])
            task.load(whole.column("node").to_numpy(), whole.column("n").to_numpy(), x)
            split = int((block_no == block_no[0]).sum())
            if split == len(block_no) and part[0].column(0)[0].as_py() == part[0].column(1)[0].as_py():
                task.run(slice(0, split), slice(0, split))
            else:
                task.run(slice(0, split), slice(split, len(block_no)))
            hit = np.flatnonzero(task.links)
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (task.a, task.b))
            none = pa.nulls
            columns = [
                pa.concat_arrays([pa.array(task.ids[hit]), pa.array(a)]),
                pa.concat_arrays([none(len(hit), pa.int64()), pa.array(b)]),
                pa.concat_arrays([pa.array(task.links[hit]), none(len(a), pa.int64())]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "links"])

        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1 if len(i) else []
            at = 0
            for end in [*edges, len(i)]:
                if end > at:
                    here = (i[at], j[at])
                    if key is not None and here != key:
                        yield done(held)
                        held = []
                    key = here
                    held.append(batch.slice(at, end - at))
                    at = end
        if held:
            yield done(held)

    found = cut(members.mapInArrow(join, "a long, b long, links long"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comp = pairs_to_components(found.where("b is not null").select("a", "b"))
    known = classes.select("key", "node", "first_id", "n").join(links, "node", "left").join(comp, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    lowest = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(lowest, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

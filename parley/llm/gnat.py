"""Hard negatives through a multiway hyperplane tree (GNAT).

Rows are integer vectors (``floor(256 * x)``), the score of a row is its inner
product with an anchor.  A window of scores is an annulus of distances around
the anchor, given the norms of the rows in question: ``d^2 = |a|^2 + |x|^2 -
2 * score``.

1. Rows with equal vector and label are one class with its ``PER_CLASS``
   smallest ids: an anchor has at most 5 positives and 3 negatives a window, so
   no further row of a class can be asked for.  The limit is applied before the
   shuffle.
2. Root of the tree: ``SPLITS`` split points, chosen from a bounded sample
   (``SAMPLE`` classes by hash) each as far as possible from those before.
   Rows belong to the nearest one (hyperplane cells).  Sorted by label and cell
   they are cut into shards of about ``16 * sqrt(n)`` rows; every split point
   stores the range of its distances to every shard, a shard also its norms and
   labels.  This table has ``sqrt(n) / 16`` rows.
3. A query goes to the shards whose ranges intersect the annulus of its window
   for every split point.  First window: everything from the score of the sixth
   best row of its label in the sample on (labels differ: skipped).  Then one
   window per positive.
4. A task holds one shard and builds the same tree over it (``FAN`` split points
   a node, ranges from each to every sibling, down to ``LEAF`` rows); queries
   stream through in batches.  Leaves compute exact scores.

Anchors with the same vector and label are one query.  The sample steers the
order and the first bound only, so the result is exact.

Scores are exact: in double precision while they stay below 2**53, else in
whole numbers of any size, whose results stop at the limits of a long.

Edge cases: rows with a null label, a null vector or a null or non-finite
component (also ``256 * x`` beyond double range) take no part; a shorter vector
counts as padded with zeros; an empty one scores 0; rows with a null ``vec_id``
are no anchors, come last among equal scores and are reported as null (2**63-1
stands for them inside); repeated rows are rows of their own, an anchor leaves
out itself only; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import cut, spread_join

POSITIVES = 5
NEGATIVES = 3
PER_CLASS = POSITIVES + 1  # an anchor may be among them
SPLITS = 16
FAN = 8
LEAF = 256
SAMPLE = 4096
SAFE = 2.0**53
LONGEST = 1e7
TOP = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min


def points(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x, a, b`` of the rows that take part: relabelled, with
    the scaled vector (whole doubles) and its 128-bit key."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v * 256) == float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("e").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # Doubles from 2**52 on are whole; a cast of the floor to long would cut them.
    scaled = lambda v: F.when(F.abs(v * 256) < 2.0**52, F.floor(v * 256).cast("double")).otherwise(v * 256)
    rows = rows.select("vec_id", moved.alias("label"), F.transform("e", scaled).alias("x"))
    return rows.withColumn("a", F.xxhash64("x")).withColumn("b", F.xxhash64(F.reverse("x"), F.size("x")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zero-padded to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as longs."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1) < SAFE:
        return (q @ x.T).astype(np.int64)
    big = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(big(q) @ big(x).T, -TOP, TOP).astype(np.int64)


def distances(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``p`` to those of ``x`` (never overflowing)."""
    scale = max(np.abs(p).max(initial=0), np.abs(x).max(initial=0), 1.0)
    p, x = p / scale, x / scale
    square = (p * p).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (p @ x.T)
    return np.sqrt(np.maximum(square, 0)) * scale


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each as far as possible from those before it."""
    chosen = [0]
    gap = distances(x[:1], x)[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(gap.argmax()))
        if gap[chosen[-1]] == 0:
            chosen.pop()
            break
        gap = np.minimum(gap, distances(x[chosen[-1]][None], x)[0])
    return x[chosen]


class Annulus:
    """The windows of a batch of queries as distances around each query."""

    def __init__(self, q: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.q, self.low, self.high = q, low.astype(float), high.astype(float)
        self.norms = distances(q, np.zeros((1, q.shape[1])))[:, 0]

    def meets(self, rows: np.ndarray, to_split: np.ndarray, near: np.ndarray, far: np.ndarray, norms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether a row in each subtree may score in the window of each query.

        ``to_split``: queries x splits; ``near, far``: subtrees x splits, the
        ranges of distances; ``norms``: the subtrees' ranges of lengths.
        """
        a, least, most = self.norms[rows][:, None], norms[0][None, :], norms[1][None, :]
        # Slack for the rounding of distances taken as differences of squares.
        slack = 1e-7 * (a + most) + 1e-6
        with np.errstate(over="ignore", invalid="ignore"):
            inner = np.sqrt(np.maximum(a * a + least * least - 2 * self.high[rows][:, None], 0)) - slack
            square = a * a + most * most - 2 * self.low[rows][:, None]
            outer = np.sqrt(np.maximum(square, 0)) + slack
            out = square >= -slack * slack - 1e-7 * (a * a + most * most)
            for s in range(near.shape[1]):
                d = to_split[:, s][:, None]
                out &= np.maximum(near[None, :, s] - d, d - far[None, :, s]) <= outer
                out &= d + far[None, :, s] >= inner
        # Squares of longer vectors are not exact enough to rule anything out.
        return out | (a > LONGEST) | (most > LONGEST)


class Tree:
    """The tree over one shard: searched for a whole batch of queries at once."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, marks: tuple[np.ndarray, np.ndarray]):
        self.x, self.ids, self.labels, self.marks = x, ids, labels, marks
        self.norms = distances(np.zeros((1, x.shape[1])), x)[0]
        self.seen = self.skipped = 0
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) > LEAF:
            step = max(1, len(rows) // (4 * LEAF))
            splits = far_apart(self.x[rows[::step]], FAN)
            if len(splits) > 1:
                d = distances(splits, self.x[rows])
                cell = d.argmin(0)
                centres = np.unique(cell)
                parts = [np.flatnonzero(cell == c) for c in centres]
                if len(parts) > 1:
                    near = np.array([d[:, p].min(1) for p in parts])
                    far = np.array([d[:, p].max(1) for p in parts])
                    norms = np.array([self.norms[rows[p]].min() for p in parts]), np.array([self.norms[rows[p]].max() for p in parts])
                    return splits, near, far, norms, [self._build(rows[p]) for p in parts], [len(p) for p in parts], centres
            half = len(rows) // 2  # equal vectors: nothing to tell apart
            return None, None, None, None, [self._build(rows[:half]), self._build(rows[half:])], None, None
        return (rows,)

    def search(self, q: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple:
        """Best ``k`` rows of each query and window: ``query, window, place, score``.

        ``low, high``: queries x windows, inclusive; an empty window has
        ``low > high``.  A window's lower end rises to its ``k``-th best score.
        """
        self.q, self.q_labels, self.low, self.high, self.k, self.same = q, labels, low.copy(), high, k, same
        self.found = [np.zeros((0, 4), np.int64) for _ in range(low.shape[1])]
        open_rows = np.flatnonzero((low <= high).any(1))
        self._visit(self.root, open_rows)
        whole = [np.column_stack([f[:, 0], np.full(len(f), w), f[:, 1], f[:, 2]]) for w, f in enumerate(self.found)]
        return np.concatenate(whole) if whole else np.zeros((0, 4), np.int64)

    def _visit(self, node: tuple, queries: np.ndarray) -> None:
        if not len(queries):
            return
        if len(node) == 1:
            self._leaf(node[0], queries)
            return
        splits, near, far, norms, children, sizes, centres = node
        if splits is None:
            for child in children:
                self._visit(child, queries)
            return
        d = distances(self.q[queries], splits)
        # Nearest cells first, so that windows close early.
        for c in np.argsort(d.mean(0)[centres], kind="stable"):
            live = self.low[queries] <= self.high[queries]
            low = np.where(live, self.low[queries], TOP).min(1)
            high = np.where(live, self.high[queries], _NONE).max(1)
            meet = Annulus(self.q[queries], low, high).meets(np.arange(len(queries)), d, near[c : c + 1], far[c : c + 1], (norms[0][c : c + 1], norms[1][c : c + 1]))[:, 0]
            self.seen += len(queries) * sizes[c]
            self.skipped += int((~meet).sum()) * sizes[c]
            self._visit(children[c], queries[meet])

    def _leaf(self, rows: np.ndarray, queries: np.ndarray) -> None:
        scores = products(self.q[queries], self.x[rows])
        fits = (self.labels[rows][None, :] == self.q_labels[queries][:, None]) == self.same
        for w, found in enumerate(self.found):
            i, j = np.nonzero(fits & (scores >= self.low[queries, w][:, None]) & (scores <= self.high[queries, w][:, None]))
            if not len(i):
                continue
            # query, place in the shard, score, id
            new = np.column_stack([queries[i], rows[j], scores[i, j], self.ids[rows[j]]])
            mixed = np.concatenate([found[np.isin(found[:, 0], new[:, 0])], new])
            order = np.lexsort((mixed[:, 3], -mixed[:, 2], mixed[:, 0]))
            mixed = mixed[order]
            starts = np.flatnonzero(np.r_[True, mixed[1:, 0] != mixed[:-1, 0]])
            place = np.arange(len(mixed)) - np.repeat(starts, np.diff(np.r_[starts, len(mixed)]))
            kept = mixed[place < self.k]
            full = mixed[place == self.k - 1]
            self.low[full[:, 0], w] = full[:, 2]
            self.found[w] = np.concatenate([found[~np.isin(found[:, 0], kept[:, 0])], kept])


_POINT = "shard int, kind int, vec_id long, label long, a long, b long, x array<double>, low array<long>, high array<long>"
_FOUND = "a long, b long, label long, window long, vec_id long, score long, na long, nb long"


def _search(sent: DataFrame, width: int, k: int, same: bool, stats=None) -> DataFrame:
    """Rows (kind 0) and queries (kind 1) of each shard: the best rows of every
    query and window within the shard."""
    names = [f.split()[0] for f in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for whole in batches:
            key = whole.column("shard").to_numpy().astype(np.int64) * 2 + whole.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)] if len(key) else [0]
            for at, end in zip(edges, edges[1:]):
                batch = whole.slice(at, end - at)
                here, kind = divmod(int(key[at]), 2)
                if here != shard:
                    shard, held, tree = here, [], None
                if kind == 0:
                    held.append(batch)
                    continue
                if tree is None:
                    if not held:
                        continue
                    t = pa.Table.from_batches(held)
                    ids = t.column("vec_id").to_numpy()
                    tree = Tree(matrix(t.column("x"), width), ids, t.column("label").to_numpy(), (t.column("a").to_numpy(), t.column("b").to_numpy()))
                    held = []
                step = max(1, (1 << 22) // LEAF)
                for cut_at in range(0, len(batch), step):
                    part = batch.slice(cut_at, step)
                    low, high = (np.array(part.column(c).to_pylist(), np.int64).reshape(len(part), -1) for c in ("low", "high"))
                    hits = tree.search(matrix(part.column("x"), width), part.column("label").to_numpy(), low, high, k, same)
                    q, w, place, score = hits.T
                    own = [part.column(c).to_numpy()[q] for c in ("a", "b", "label")]
                    columns = [*own, w, tree.ids[place], score, tree.marks[0][place], tree.marks[1][place]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
                if stats is not None:
                    stats.add((tree.seen, tree.skipped))
                    tree.seen = tree.skipped = 0

    return sent.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows per query and window; ``place`` from 1."""
    order = Window.partitionBy("a", "b", "label", "window").orderBy(F.col("score").desc(), "vec_id", "na", "nb")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


class Index:
    """Every row of ``vectors`` in shards, with the root of the tree."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        self.rows = rows = points(vectors)
        ids = Window.partitionBy("a", "b", "label").orderBy(F.col("vec_id").asc_nulls_last())
        few = rows.withColumn("place", F.row_number().over(ids)).where(F.col("place") <= PER_CLASS)
        few = cut(few.select(F.coalesce("vec_id", F.lit(int(TOP))).alias("vec_id"), "label", "x", "a", "b", "place"))
        n, width = few.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
        self.n, self.width = n, width = n, max(width, 1)
        share = min(1.0, SAMPLE / max(n, 1))
        picked = few.where(F.pmod(F.xxhash64("a", "b", "label", "place"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("label", "x", "a", "b", "place").toArrow()
        picked = picked.sort_by([(c, "ascending") for c in ("a", "b", "label", "place")])
        self.sample_labels = picked.column("label").to_numpy()
        self.sample = matrix(picked.column("x"), width) if picked.num_rows else np.zeros((0, width))
        splits = self.splits = far_apart(self.sample, SPLITS) if picked.num_rows else np.zeros((1, width))
        shards = self.shards = max(1, math.ceil(math.sqrt(n) / 16))
        names = [*few.columns, "cell", "d", "norm"]
        at_x = names.index("x")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(at_x), width)
                d = distances(x, splits)
                norm = distances(x, np.zeros((1, width)))[:, 0]
                more = [pa.array(d.argmin(1).astype(np.int32)), pa.array(list(d), pa.list_(pa.float64())), pa.array(norm)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

        schema = "vec_id long, label long, x array<double>, a long, b long, place int, cell int, d array<double>, norm double"
        dealt = few.mapInArrow(place, schema).repartitionByRange(shards, "label", "cell", "a", "b", "place")
        dealt = cut(dealt.withColumn("shard", F.spark_partition_id()))
        self.points = dealt.select("shard", "vec_id", "label", "a", "b", "x", "place")
        ranges = [f(F.col("d")[s]).alias(f"{f.__name__}{s}") for f in (F.min, F.max) for s in range(len(splits))]
        table = dealt.groupBy("shard").agg(*ranges, F.min("norm").alias("nmin"), F.max("norm").alias("nmax"), F.min("label").alias("lmin"), F.max("label").alias("lmax")).orderBy("shard").toPandas()
        self.table = {
            "shard": table["shard"].to_numpy().astype(np.int32),
            "near": table[[f"min{s}" for s in range(len(splits))]].to_numpy(float).reshape(len(table), len(splits)),
            "far": table[[f"max{s}" for s in range(len(splits))]].to_numpy(float).reshape(len(table), len(splits)),
            "norms": (table["nmin"].to_numpy(float), table["nmax"].to_numpy(float)),
            "lmin": table["lmin"].to_numpy(np.int64),
            "lmax": table["lmax"].to_numpy(np.int64),
        }
        self.seen = spark.sparkContext.accumulator((0, 0), _Pair())
        self.routed = spark.sparkContext.accumulator((0, 0), _Pair())

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """Best ``k`` rows of the same (or another) label for every query and
        window.  ``queries``: ``a, b, label, x, low, high``; null windows mean
        from the sample's ``k``-th best row on."""
        table, splits, width, routed = self.table, self.splits, self.width, self.routed
        sample, sample_labels = self.sample, self.sample_labels

        def first_bound(q: np.ndarray, labels: np.ndarray) -> np.ndarray:
            low = np.full(len(q), -TOP)
            for label in np.unique(labels):
                mine, here = np.flatnonzero(labels == label), sample[sample_labels == label]
                if len(here) >= k:
                    for at in range(0, len(mine), 1024):
                        part = mine[at : at + 1024]
                        low[part] = -np.partition(-products(q[part], here), k - 1, axis=1)[:, k - 1]
            return low

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [f.split()[0] for f in _POINT.split(", ")]
            for whole in batches:
                for start in range(0, len(whole), 512):
                    batch = whole.slice(start, 512)
                    q, labels = matrix(batch.column("x"), width), batch.column("label").to_numpy()
                    if same:
                        low = first_bound(q, labels)[:, None]
                        high = np.full_like(low, TOP)
                        windows = [pa.array(low.tolist(), pa.list_(pa.int64())), pa.array(high.tolist(), pa.list_(pa.int64()))]
                    else:
                        windows = [batch.column("low"), batch.column("high")]
                        low, high = (np.array(c.to_pylist(), np.int64).reshape(len(batch), -1) for c in windows)
                    live = low <= high
                    to_split = distances(q, splits)
                    ring = Annulus(q, np.where(live, low, TOP).min(1), np.where(live, high, _NONE).max(1))
                    go = ring.meets(np.arange(len(q)), to_split, table["near"], table["far"], table["norms"]) & live.any(1)[:, None]
                    inside = (table["lmin"][None, :] <= labels[:, None]) & (labels[:, None] <= table["lmax"][None, :])
                    alone = (table["lmin"] == table["lmax"])[None, :] & inside
                    go &= inside if same else ~alone
                    routed.add((go.size, int(go.size - go.sum())))
                    for s in range(go.shape[1]):
                        take = pa.array(np.flatnonzero(go[:, s]))
                        if len(take):
                            one = pa.nulls(len(take), pa.int64())
                            constant = lambda v: pa.array(np.full(len(take), v, np.int32))
                            rows = [constant(table["shard"][s]), constant(1), one, *[batch.column(c).take(take) for c in ("label", "a", "b", "x")], *[w.take(take) for w in windows]]
                            yield pa.RecordBatch.from_arrays(rows, names=names)

        none = F.lit(None).cast("array<long>")
        sent = queries.mapInArrow(route, _POINT)
        rows = self.points.select("shard", F.lit(0).alias("kind"), "vec_id", "label", "a", "b", "x", none.alias("low"), none.alias("high"))
        both = rows.unionByName(sent).repartition(self.shards, "shard").sortWithinPartitions("shard", "kind")
        return _best(_search(both, width, k, same, self.seen), k)


class _Pair:
    """Accumulates (compared or offered, skipped)."""

    def zero(self, value: tuple) -> tuple:
        return (0, 0)

    def addInPlace(self, a: tuple, b: tuple) -> tuple:  # noqa: N802
        return (a[0] + b[0], a[1] + b[1])


def hard_negatives(vectors: DataFrame, every: int = 50, index: Index | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for the anchors whose ``vec_id`` is divisible by ``every``."""
    index = index or Index(vectors)
    keys = ["a", "b", "label"]
    asked = cut(index.rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), *keys, "x"))
    queries = cut(asked.groupBy(*keys).agg(F.first("x").alias("x")))
    mine = (F.col("na") == F.col("a")) & (F.col("nb") == F.col("b"))
    row = F.struct("place", "vec_id", "score", mine.alias("own"))
    positives = index.search(queries.select(*keys, "x", *_windows(F.lit(None), F.lit(None))), PER_CLASS, True)
    positives = positives.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("found"))
    # One window per different positive score.  A row that is its class alone
    # (no other of the same score) is the anchor itself and nobody's positive.
    same_score = lambda p: F.size(F.filter("found", lambda o: o["score"] == p["score"]))
    scores = F.array_distinct(F.transform(F.filter("found", lambda p: ~(p["own"] & (same_score(p) == 1))), lambda p: p["score"]))
    positives = cut(positives.withColumn("scores", scores))
    low = F.expr("transform(scores, p -> p - shiftright(p, 1))")  # half, rounded up
    high = F.expr("transform(scores, p -> p - (p div 20) - if(p > 0 and p % 20 <> 0, 1, 0))")  # 95 %, rounded down
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(int(v)), PER_CLASS - F.size(c)))
    windows = positives.join(queries, keys).select(*keys, "x", *_windows(fill(low, TOP), fill(high, _NONE)))
    negatives = index.search(cut(windows), NEGATIVES, False)
    negatives = negatives.groupBy(*keys, "window").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("rows"))
    negatives = negatives.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("window", "rows"))).alias("negatives"))
    joined = spread_join(asked.select("anchor_id", *keys), positives.join(negatives, keys), keys)
    # The anchor's own row goes, once; without it the best five stay.
    itself = F.array_position(F.transform("found", lambda p: p["own"] & (p["vec_id"] == F.col("anchor_id"))), True)
    others = F.slice(F.filter("found", lambda p, i: i + 1 != itself), 1, POSITIVES)
    each = joined.select("anchor_id", "scores", "negatives", F.explode(others).alias("p"))
    found = F.try_element_at("negatives", F.array_position("scores", F.col("p.score")).cast("long") - 1)
    rows = each.select("anchor_id", "p", F.explode(found).alias("n"))
    named = lambda c: F.when(F.col(c) != int(TOP), F.col(c))
    return rows.select("anchor_id", named("p.vec_id").alias("positive_id"), F.col("n.place").alias("rank"), named("n.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def _windows(low: Column, high: Column) -> list[Column]:
    return [low.cast("array<long>").alias("low"), high.cast("array<long>").alias("high")]

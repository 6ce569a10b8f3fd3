"""SimHash near-duplicates: bit-majority fingerprints searched with BK-trees.

1. ``fingerprints``: one 64-bit SimHash per whole text.
2. Texts with the same fingerprint are one class, so exact copies (any number
   of them) enter the search once.
3. ``near_links``: the fingerprints are dealt into shards such that any two
   within the radius meet in at least one, and each shard is searched with a
   BK-tree: children keyed by their integer Hamming distance to the parent; a
   search follows only edges within ``radius`` of the query's distance.
4. Links are contracted to components in DataFrames.

Sharding.  64 bits are cut into ``blocks`` blocks.  Two fingerprints that
differ in at most ``radius`` bits agree on at least ``blocks - radius`` whole
blocks, so sharding by every choice of ``blocks - radius`` blocks loses no
pair.  A tree is sent to the tasks that search it by the shuffle rather than
by a driver broadcast: the trees together hold every fingerprint, which has no
size bound.  A shard of more than ``tree_size`` fingerprints is cut into
sub-trees of about that size; its queries are replicated to the sub-trees, so
a hot shard is many tasks and no tree outgrows a task.

Inside a shard only a spanning set of the links found is emitted (a
union-find over the shard), so a group of n near copies gives at most n rows.

Edge cases: a null text is empty; an empty text has fingerprint zero and is
linked like any other.  Fewer words than the shingle length: the whole word
sequence is the one shingle.  Repeated rows share a class.  Rows with a null
``doc_id`` are fingerprinted and returned; a component's id ignores nulls
(null when it has no other row).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import cut, pairs_to_components

SHINGLE = 4
RADIUS = 4
BLOCKS = 6
TREE_SIZE = 4096
SEED = 42
PIECE = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as an unsigned integer."""
    # bytes.lower() changes A-Z only; bytes.split() splits on ASCII space and 09-0D only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        top = min(n, at + PIECE)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:top].tolist(), ends[at + k - 1 : top + k - 1].tolist())]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Burkhard-Keller tree over integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, fresh = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while fresh:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = fresh
                return
            at = nxt

    def search(self, value: int, radius: int) -> Iterator[int]:
        """Node numbers within ``radius`` of ``value``, as they are found."""
        stack, values, children = [0] if self.values else [], self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            for edge, child in children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def _shard_links(radius: int):
    """Arrow handler: rows sorted by (shard, part, not own) -> spanning links."""

    def root(up: list[int], i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, up, groups = None, BKTree(), [], 0
        for batch in batches:
            left, right = [], []
            for s, part, guest, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (s, part) != shard:
                    shard, tree, up, groups = (s, part), BKTree(), [], 0
                value = fp & 0xFFFFFFFFFFFFFFFF
                # One link per group of linked members; when every group is
                # met, further hits add nothing (a dense shard ends at once).
                tops: dict[int, int] = {}
                for hit in tree.search(value, radius):
                    tops.setdefault(root(up, hit), hit)
                    if len(tops) == groups:
                        break
                for hit in tops.values():
                    v = tree.values[hit]
                    left.append(fp)
                    right.append(v - (1 << 64) if v >> 63 else v)
                if not guest:
                    tree.add(value)
                    up.append(len(up))
                    for top in tops:
                        up[top] = len(up) - 1
                    groups += 1 - len(tops)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def near_links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links ``a, b`` spanning every pair of distinct fingerprints within ``radius``.

    ``classes`` has one row per distinct ``fp``.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("needs 0 <= radius < blocks <= 64")
    edge = [64 * i // blocks for i in range(blocks + 1)]

    def mask(i: int) -> int:
        m = (1 << edge[i + 1]) - (1 << edge[i])
        return m - (1 << 64) if m >> 63 else m

    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        m = 0
        for i in chosen:
            m |= mask(i)
        keys.append(F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")))
    dealt = classes.select("fp", F.explode(F.array(*keys)).alias("shard")).select("fp", F.col("shard.n").alias("n"), F.col("shard.bits").alias("bits"))
    sizes = dealt.groupBy("n", "bits").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / tree_size).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    rows = (
        dealt.join(sizes, ["n", "bits"])
        .select("fp", "n", "bits", own.alias("own"), F.explode(F.sequence(own, parts - 1)).alias("part"))
        .select(F.struct("n", "bits").alias("shard"), "part", (F.col("own") != F.col("part")).alias("guest"), "fp")
        .repartition("shard", "part")
        .sortWithinPartitions("shard", "part", "guest", "fp")
    )
    rows = rows.select(F.concat_ws(":", "shard.n", "shard.bits").alias("shard"), "part", "guest", "fp")
    return rows.mapInArrow(_shard_links(radius), "a long, b long").distinct()


def simhash_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, tree_size: int = TREE_SIZE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``."""
    return _grouped(docs, shingle, radius, blocks, tree_size).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, tree_size: int = TREE_SIZE) -> DataFrame:
    """``doc_id, fp, component_id, component``: the latter is one of its
    fingerprints, as components of one shared id have equal ``component_id``."""
    marked = cut(fingerprints(docs, shingle))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = pairs_to_components(near_links(classes.select("fp"), radius, blocks, tree_size))
    # Only linked fingerprints can have a component id other than their own first id.
    linked = classes.join(comp.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = linked.join(lowest, "component").select("fp", "component", F.col("component_id").alias("linked_id"))
    ids = classes.join(ids, "fp", "left").select("fp", F.coalesce("linked_id", "first_id").alias("component_id"), F.coalesce("component", "fp").alias("component"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id", "component")


def keep_one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the
    document with the smallest id stays (once, when its row is repeated).  Texts
    of one id that lie in different components are different documents.
    Rows without an id cannot be named as copies and stay."""
    found = cut(_grouped(docs, **params).where("doc_id is not null"))
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "fp")).alias("f")).groupBy("f.doc_id").agg(F.collect_list("f.fp").alias("_prints"))
    shared = found.groupBy("doc_id").agg((F.min("fp") != F.max("fp")).alias("_shared"))
    stay = first.join(shared, "doc_id").withColumnRenamed("doc_id", "_first")

    @F.pandas_udf("long")
    def fingerprint(texts):
        return texts.map(lambda t: int(np.uint64(simhash(t, params.get("shingle", SHINGLE))).view(np.int64)))

    # Only ids with several fingerprints need theirs again.
    kept = docs.join(stay, docs["doc_id"] == stay["_first"])
    kept = kept.withColumn("_print", F.when(F.col("_shared"), fingerprint(F.when(F.col("_shared"), docs["text"]))).otherwise(F.lit(0)))
    kept = kept.where(~F.col("_shared") | F.array_contains("_prints", F.col("_print"))).dropDuplicates(["_first", "_print"])
    return kept.drop("_first", "_prints", "_shared", "_print").unionByName(docs.where(F.col("doc_id").isNull()))

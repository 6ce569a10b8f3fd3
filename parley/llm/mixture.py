"""Mixing sources to target weights with hash-threshold histograms (SQL functions only).

Every source gets a token target.  A source is read ``floor(target / size)``
times in full, and the rest of its target by a hash threshold: a document
takes part in the last pass if its hash lies below the source's threshold, so
budgets are nested (raising a target only adds documents).  The thresholds
come from histograms instead of a sort: tokens are summed by source and the
top bits of the hash, the bucket in which the budget ends is found by a
running sum over the histogram, and only that bucket is split again by the
next bits, until the hash has no bits left.  The document on the boundary
joins if that brings the source nearer to its target.

A histogram has at most 2**10 rows per source whatever the number of
documents, and a hot source is pre-aggregated like any other.

The hash is of id, source, text and a number among fully equal rows, so every
row has its own, whatever rows share an id or have none: each source ends
within one document of its target.

Edge cases: a null text has size 0; a null source is a source of its own, last
in order; null and shared ids and repeated rows are taken one by one; sources
of size 0 get target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import WORD, cut, number_equals, repeated_keys

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
LEVELS = 6
LEVEL_BITS = 10


def _size(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")


def _hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, LEVELS * LEVEL_BITS // 4), 16, 10).cast("long")


def _key(docs: DataFrame) -> Column:
    """Id, digest of the text and source, equal for fully equal rows only."""
    part = lambda c: F.coalesce(docs[c].cast("string"), F.lit("null"))
    return F.concat_ws("|", part("doc_id"), F.md5(part("text")), part("source"))


def _hashed(rows: DataFrame, key: str, name: str, again: DataFrame | None) -> DataFrame:
    """``rows`` with a 60-bit hash of key and number among equal keys."""
    numbered = number_equals(rows, key, f"{name}_k", again)
    return numbered.withColumn(name, _hash(F.concat_ws("|", key, F.col(f"{name}_k").cast("string")))).drop(key, f"{name}_k")


def sized(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``doc_id, source, size, h``: whitespace words and a 60-bit hash of each
    row; and the keys of fully equal rows."""
    slim = cut(docs.select("doc_id", "source", _size(docs).alias("size"), _key(docs).alias("key")))
    again = repeated_keys(slim, "key")
    return cut(_hashed(slim, "key", "h", again)), again


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, source_size)``.

    Sources in code-point order (null last) weigh ``weights``, repeating.  A
    target stops at ``most`` times its source's size and the excess is shared
    again by weight; the fixed point is a common level: with the sources by
    size per weight, the first ``j`` are full and the rest get
    ``level * weight``.  One row per source meets in these windows, whose task
    holds the names of all sources (100 MB for a million of them).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # Level if exactly the sources before this one are full; this one is full if its cap lies below.
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    s = s.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("final") * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, source_size, target, passes, threshold``: documents with
    ``h <= threshold`` are taken once more than ``passes`` times."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    # prefix: hash bits fixed so far; spent: tokens in the buckets wholly below it.
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("spent", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * LEVEL_BITS
        at = state.select(F.col("source").alias("_source"), "prefix", "spent", "budget")
        inside = docs.join(F.broadcast(at) if _few(at) else at, docs["source"].eqNullSafe(at["_source"]))
        if level:
            inside = inside.where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        hist = inside.groupBy("source", "budget", "spent", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        run = F.col("spent") + F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("upto", run)
        # The boundary bucket is the first that reaches the budget.
        edge = hist.where("upto >= budget").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("below"), "upto")).alias("e"))
        edge = edge.select(F.col("source").alias("_source"), F.col("e.bucket").alias("bucket"), F.col("e.below").alias("below"), F.col("e.upto").alias("upto"))
        state = state.drop("bucket", "below", "upto", "_source").join(edge, F.col("source").eqNullSafe(F.col("_source")), "left")
        state = cut(state.withColumn("prefix", F.coalesce("bucket", "prefix")).withColumn("spent", F.coalesce("below", "spent")))
    nearer = (F.col("upto") - F.col("budget")) <= (F.col("budget") - F.col("below"))
    threshold = F.when(F.col("bucket").isNull(), F.lit(-1)).when(F.col("budget") <= 0, F.lit(-1)).when(nearer, F.col("bucket")).otherwise(F.col("bucket") - 1)
    return state.select("source", "source_size", "target", "passes", threshold.cast("long").alias("threshold"))


def _few(df: DataFrame, most: int = 100_000) -> bool:
    return df.count() <= most


def _cuts(slim: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``thresholds`` by ``_source``, ready to be joined."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = cut(targets(sizes, weights, share, most))
    cuts = thresholds(slim, goals).withColumnRenamed("source", "_source")
    return F.broadcast(cuts) if _few(goals) else cuts


def take(docs: DataFrame, copies: str = "copies", taken: str = "taken", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with how often and how many words.

    Texts of rows without an equal one stay in the scan: their hash follows
    from the row.  Only fully equal rows are written once, to be numbered.
    """
    sizes, again = sized(docs)
    cuts = _cuts(sizes, weights, share, most).select(F.struct("_source", "passes", "threshold").alias("_mix_cut"))
    free = lambda n: n if n.lower() not in {c.lower() for c in docs.columns} else free(f"_{n}")
    key, h = free("_mix_key"), free("_mix_h")
    hashed = _hashed(docs.withColumn(key, _key(docs)), key, h, again)
    n = (F.col("_mix_cut.passes") + F.when(F.col(h) <= F.col("_mix_cut.threshold"), 1).otherwise(0)).cast("long")
    joined = hashed.join(cuts, hashed["source"].eqNullSafe(F.col("_mix_cut._source"))).where(n > 0)
    return joined.select(*[hashed[f"`{c}`"] for c in docs.columns], n.alias(copies), (_size(hashed) * n).alias(taken))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row."""
    slim, _ = sized(docs)
    cuts = _cuts(slim, weights, share, most)
    joined = slim.join(cuts, slim["source"].eqNullSafe(cuts["_source"]))
    copies = F.col("passes") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))

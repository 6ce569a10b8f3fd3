"""Benchmark decontamination: SimHash over item-sized windows (SQL functions only).

A document is contaminated by a benchmark item when some window of the
document with as many words as the item has a weighted-shingle similarity of
at least ``threshold`` with it.  Words are the runs of letters and digits of
the lower-cased text, shingles are ``shingle`` consecutive words (the whole
item when it is shorter), a shingle weighs its number of occurrences, and the
similarity is the sum of the smaller weights over the sum of the larger ones.

1. ``_hits``: every shingle of every document is looked up among the item
   shingles.  A window whose similarity reaches the threshold holds at least
   ``t`` of them (``t`` follows from the threshold and the item's length), so
   windows with fewer are never built.  This loses nothing and leaves a
   handful of windows for each real passage.
2. The windows left are collapsed by content (copies of a passage count once)
   and get a 64-bit SimHash of their weighted shingles, as do the items.
3. Multi-index blocks: the 64 bits are cut into ``radius + 1`` blocks, so two
   fingerprints within the radius agree on a whole block; windows and items of
   one length meet on equal blocks and stay if they differ in at most
   ``radius`` bits.
4. The survivors' similarity is computed exactly on the words.

The radius guards recall: two bags at similarity 0.8 have an expected distance
of about 10 of 64 bits with a deviation of 3, so 21 lies beyond three and a
half deviations.

Edge cases: null, empty and word-less texts and items match nothing; a
document shorter than an item is one window; repeated rows give one result per
``(doc_id, item_id)`` (the best similarity, then the first position); a null
``doc_id`` or ``item_id`` is a value like any other; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bind, cut

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 21
# Documents with hits are few; up to this many go to the scan by broadcast
# (bytes of their hit table: ids and positions), beyond it they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _items(benchmark: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``item_id, words, w, k, n, need``: item length in words, its shingle
    length, its number of shingles and the least number of shared ones."""
    items = bind(benchmark, ["item_id"], words=words(F.col("text"))).where(F.size("words") > 0)
    items = items.dropDuplicates(["item_id", "words"]).withColumn("w", F.size("words")).withColumn("k", F.least(F.col("w"), F.lit(shingle)))
    n = F.col("w") - F.col("k") + 1
    return items.withColumn("n", n).withColumn("need", F.ceil(2 * F.col("n") * threshold / (1 + threshold) - 1e-9).cast("int"))


# ``array<struct<pos, h>>`` of every run of k words (1-based).
_SHINGLES = "if(size({words}) >= {k}, transform(sequence(1, size({words}) - {k} + 1), i -> struct(i as pos, xxhash64(slice({words}, i, {k})) as h)), array())"


def _shingle_hashes(words: str, k: str) -> Column:
    return F.expr(_SHINGLES.format(words=words, k=k))


def _hits(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, w, starts``: per document and item length the first words of
    all windows that hold enough item shingles."""
    lengths = [r.k for r in items.select("k").distinct().collect()]  # at most `shingle` values
    index = items.select("w", "k", "n", "need", F.explode(_shingle_hashes("words", "k")).alias("s"))
    index = index.groupBy(F.col("s.h").alias("h"), "k", "w", "n").agg(F.min("need").alias("need"))
    tokens = bind(docs, ["doc_id"], words=words(F.col("text")))
    lengths = lengths or [1]  # no items: nothing joins
    every = F.concat(*[F.expr(f"transform({_SHINGLES.format(words='words', k=k)}, s -> struct({k} as k, s.pos as pos, s.h as h))") for k in sorted(lengths)])
    found = tokens.select("doc_id", F.size("words").alias("n_words"), F.explode(every).alias("s")).select("doc_id", "n_words", "s.*").join(index, ["k", "h"])
    by_doc = found.groupBy("doc_id", "n_words", "w", "k", "n", "need").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    # Every run of `need` hits that fits into one window, and the windows around it.
    whole = F.expr(f"if(size(p) >= {threshold}D * (n_words - k + 1 + n) / (1 + {threshold}D) - 1e-9D, array(1), array())")
    runs = F.expr(
        "if(size(p) >= need, array_distinct(flatten(transform(filter(sequence(0, size(p) - need), j -> p[j + need - 1] - p[j] < n),"
        " j -> sequence(greatest(1, p[j + need - 1] - n + 1), least(p[j], n_words - w + 1))))), array())"
    )
    starts = by_doc.select("doc_id", "w", "k", F.when(F.col("n_words") < F.col("w"), whole).otherwise(runs).alias("starts")).where(F.size("starts") > 0)
    return starts.groupBy("doc_id", "w", "k").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def _simhash(hashes: str) -> Column:
    """Majority bits of an array of 64-bit hashes (repeats count)."""
    return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, i) -> acc | if(2 * size(filter({hashes}, h -> (shiftright(h, i) & 1L) = 1L)) > size({hashes}), shiftleft(1L, i), 0L))")


def _fingerprint(df: DataFrame, keep: list[str]) -> DataFrame:
    hashed = bind(df, keep, hashes=F.expr("transform({0}, s -> s.h)".format("sh")))
    return bind(hashed, keep, fp=_simhash("hashes"))


def _blocks(df: DataFrame, radius: int, fp: str) -> DataFrame:
    edge = [64 * i // (radius + 1) for i in range(radius + 2)]
    cells = [F.struct(F.lit(b).alias("block"), F.shiftright(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits")) for b, (lo, hi) in enumerate(zip(edge, edge[1:]))]
    return df.withColumn("c", F.explode(F.array(*cells))).select("*", "c.block", "c.bits").drop("c")


def similarity(a: str, b: str) -> Column:
    """Weighted similarity of two arrays of shingles."""
    both = f"aggregate(array_distinct(array_intersect({a}, {b})), 0, (acc, x) -> acc + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    return F.expr(f"transform(array({both}), m -> m / cast(size({a}) + size({b}) - m as double))[0]")


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_windows`` for every document
    and benchmark item that share a passage."""
    docs = docs.select(F.col("doc_id"), F.col("text"))
    items = cut(_items(benchmark.select("item_id", "text"), shingle, threshold))
    hits = cut(_hits(docs, items, threshold))
    size = hits.agg(F.coalesce(F.sum(32 + 4 * F.size("starts")), F.lit(0))).first()[0]
    side = F.broadcast(hits) if size <= BROADCAST_BYTES else hits
    side = side.select(F.col("doc_id").alias("_id"), "w", "k", "starts")
    # Only documents with hits are split into words again.
    texts = docs.join(side, docs["doc_id"].eqNullSafe(side["_id"])).select("doc_id", "w", "k", "starts", "text")
    windows = bind(texts, ["doc_id", "w", "k", "starts"], words=words(F.col("text")))
    windows = windows.select("doc_id", "w", "k", F.explode(F.expr("transform(filter(starts, s -> s <= size(words)), s -> struct(s as start, slice(words, s, w) as words))")).alias("x"))
    windows = cut(windows.select("doc_id", "w", "k", "x.start", "x.words", F.md5(F.concat_ws(" ", "x.words")).alias("content")).distinct())
    unique = windows.select("w", "k", "content", "words").dropDuplicates(["w", "content"])
    prints = cut(_fingerprint(unique.withColumn("sh", _shingle_hashes("words", "k")), ["w", "k", "content", "words"]))
    tests = _fingerprint(items.withColumn("sh", _shingle_hashes("words", "k")), ["item_id", "w", "words"])
    tests = tests.select("item_id", "w", F.col("words").alias("item_words"), F.col("fp").alias("item_fp"))
    left = _blocks(prints.select("w", "content", "fp"), radius, "fp")
    right = _blocks(tests.select("w", "item_id", "item_words", "item_fp"), radius, "item_fp")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    # A pair counts at its first equal block only.
    edge = [64 * i // (radius + 1) for i in range(radius + 2)]
    equal = [(F.shiftright(F.col("fp").bitwiseXOR(F.col("item_fp")), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) == 0, b) for b, (lo, hi) in enumerate(zip(edge, edge[1:]))]
    first = F.coalesce(*[F.when(e, F.lit(b)) for e, b in equal])
    l, r = left.alias("l"), right.alias("r")
    on = (F.col("l.w") == F.col("r.w")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.bits") == F.col("r.bits")) & near & (first == F.col("l.block"))
    pairs = l.join(r, on).select(F.col("l.w").alias("w"), "content", "item_id", "item_words")
    shingles = "transform(sequence(1, size({0}) - k + 1), i -> concat_ws(' ', slice({0}, i, k)))"
    checked = pairs.join(prints.select("w", "k", "content", "words"), ["w", "content"]).where(F.size("words") >= F.col("k"))
    checked = bind(checked, ["w", "content", "item_id"], a=F.expr(shingles.format("words")), b=F.expr(shingles.format("item_words")))
    checked = bind(checked, ["w", "content", "item_id"], similarity=similarity("a", "b")).where(F.col("similarity") >= threshold)
    where = windows.select("doc_id", "w", "content", "start").join(checked, ["w", "content"])
    best = where.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start"))).alias("b"), F.countDistinct("start").alias("n_windows"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("similarity"), F.col("b.start").alias("start_word"), "n_windows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that share no passage with the benchmark.  The text
    alone decides, so rows are told apart by its digest: those that share an id,
    or have none, do not share their fate."""
    key = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    bad = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, **params).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, key == bad["_bad"], "left_anti")

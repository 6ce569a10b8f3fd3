"""Filter interaction audit by the potential of the removal game.

Filters are the players of a game per part of the corpus; a coalition's worth
is the number of documents that at least one of its filters fails.  The
potential (Hart and Mas-Colell) of a coalition is its worth plus the potentials
of the coalitions with one filter less, divided by its size; a filter's Shapley
value is the grand coalition's potential minus that without the filter.  The
steps of an order are differences of worths along its coalitions.

1. One pass over the texts gives every row a mask of the filters that look at
   the text alone and a 128-bit digest.  Equal rows are counted together.
2. A text's first rows (smallest ``doc_id``) are kept by a ranked window, whose
   limit is applied before the shuffle, so a text of any number of copies sends
   a few rows per task.  All other rows with an id fail the duplicate filter.
3. Rows are summed to 32 coalition counts per part.  From there on a part is
   one row: worths, potentials (folded over the coalitions in ascending order,
   in sixtieths, which are whole numbers for five filters) and the 120 orders.

Edge cases: null and empty texts have no words (they fail A only, and E behind
a smaller id); null and empty sources are one part; a row with a null
``doc_id`` is no copy of anything, and nothing is a copy of it; rows that share
the smallest id of a text are all its first ones; a document is good (toxic) if
any of its rows in ``labels`` says so; an empty table has no parts.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import cut, spread_join

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
ALL = (1 << len(FILTERS)) - 1
UNIT = 60  # least common multiple of the coalition sizes
MIN_WORDS = 50
MIN_DISTINCT = 65  # per cent of words
MAX_CAPITALS = 5  # per cent of code points
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#$%&*|")] = True
_CAPITALS = np.zeros(256, bool)
_CAPITALS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def text_mask(raw: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = raw.split()  # at the six ASCII separators
    data = np.frombuffer(raw, np.uint8)
    capitals = int(_CAPITALS[data].sum())
    points = len(raw) - int(((data & 0xC0) == 0x80).sum())
    failed = (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words), 100 * capitals > MAX_CAPITALS * points, bool(_SIGNS[data].any()))
    return sum(bit << i for i, bit in enumerate(failed))


def masked(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, d1, d2`` of every row: failed text filters and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, first, second = [], [], []
            for t in batch.column(2):
                raw = t.as_py()
                digest = xxhash.xxh3_128_digest(raw)
                masks.append(text_mask(raw))
                first.append(int.from_bytes(digest[:8], "big", signed=True))
                second.append(int.from_bytes(digest[8:], "big", signed=True))
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "d1", "d2"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return slim.mapInArrow(run, "doc_id long, part string, mask int, d1 long, d2 long")


def coalition_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: rows by the exact set of filters they fail."""
    rows = cut(masked(docs).groupBy("doc_id", "part", "mask", "d1", "d2").agg(F.count("*").alias("n")))
    truth = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    truth = truth.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    judged = spread_join(rows, truth, ["doc_id"], "left")
    judged = cut(judged.select("doc_id", "part", "mask", "d1", "d2", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))
    keys = ["part", "mask", "good", "toxic"]
    ranked = judged.where("doc_id is not null").withColumn("place", F.rank().over(Window.partitionBy("d1", "d2").orderBy("doc_id")))
    first = ranked.where("place = 1").select(*keys, "n").unionByName(judged.where("doc_id is null").select(*keys, "n"))
    first = cut(first.groupBy(*keys).agg(F.sum("n").alias("n")))
    every = judged.groupBy(*keys).agg(F.sum("n").alias("n"))
    copied = F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask")
    moved = every.select("part", copied, "good", "toxic", "n").unionByName(first.select("part", copied, "good", "toxic", (-F.col("n")).alias("n"))).unionByName(first)
    return moved.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def _worths(counts: Column) -> Column:
    """Worth of every coalition: rows whose failures meet it."""
    everything = F.sequence(F.lit(0), F.lit(ALL))
    met = lambda s: lambda total, m: total + F.when(s.bitwiseAND(m) != 0, F.get(counts, m)).otherwise(F.lit(0).cast("long"))
    return F.transform(everything, lambda s: F.aggregate(everything, F.lit(0).cast("long"), met(s)))


def potentials(worths: Column) -> Column:
    """``UNIT`` times the potential of every coalition, by the recursion over
    the coalitions with one filter less."""
    bits = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])

    def one(known: Column, s: Column) -> Column:
        smaller = F.aggregate(bits, F.lit(0).cast("long"), lambda total, b: total + F.when(s.bitwiseAND(b) != 0, F.get(known, s - b)).otherwise(F.lit(0).cast("long")))
        return F.concat(known, F.array(F.floor((F.get(worths, s) * UNIT + smaller) / F.bit_count(s)).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), one)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step; see the module text."""
    counts = coalition_counts(docs, labels)
    sums = lambda which: F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & which, F.col("n"))), F.lit(0)).cast("long") for m in range(ALL + 1)])
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), sums(F.lit(True)).alias("c_all"), sums(F.col("good")).alias("c_good"), sums(F.col("toxic")).alias("c_toxic"))
    parts = cut(parts.select("part", "total", *[_worths(F.col(f"c_{w}")).alias(w) for w in ("all", "good", "toxic")]))
    parts = cut(parts.withColumn("potential", potentials(F.col("all"))))
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append({"o": "".join(FILTERS[i] for i in order), "s": step, "before": before, "bit": 1 << f})
            before |= 1 << f
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,s:int,before:int,bit:int>>")
    rows = parts.select("*", F.explode(plan).alias("at"))
    before, bit = F.col("at.before"), F.col("at.bit")
    after = before.bitwiseOR(bit)
    here = lambda w: F.get(F.col(w), after) - F.get(F.col(w), before)
    without = lambda c: F.get(F.col(c), F.lit(ALL)) - F.get(F.col(c), F.lit(ALL) - bit)
    return rows.select(
        "part",
        F.col("at.o").alias("filter_order"),
        F.col("at.s").alias("step"),
        (F.col("total") - F.get(F.col("all"), after)).alias("kept"),
        here("all").alias("removed"),
        (F.get(F.col("all"), bit) - here("all")).alias("redundant"),
        without("all").alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        # Summed over the 120 orders: 120 Shapley values, of which UNIT are in the potential.
        (without("potential") * (120 // UNIT)).alias("shapley"),
    )

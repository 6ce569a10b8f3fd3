"""Substring deduplication by content-defined marks.

A gear rolling hash (shift left, add a table value per byte) runs over each
text's UTF-8 bytes, so its value depends on the last ``WINDOW`` bytes only.  A
mark is set wherever that value is the smallest of some ``SPAN`` neighbouring
ones (local minima): marks depend on content alone, and any two copies of
``WINDOW + SPAN - 1`` = 101 bytes, wherever they stand, share one.  51 words
have at least as many.

1. Marks are deduplicated by a digest of their window: the first place
   (smallest ``doc_id``, then offset) keeps it, every later place is a repeat.
2. Neighbouring repeats with the same distance to their first places and the
   same bytes between them (by digest) join to a run.
3. Both ends of every run are extended byte by byte against its first place
   (up to ``SIDE`` bytes; marks further out have runs of their own), which also
   checks the window itself.  Touching runs of a document join to a passage,
   which is then narrowed to whole words.
4. A passage is reported from ``min_words`` words on, so a phrase that recurs
   by chance is left alone.

A repeat inside one document is reported as well, with that document as the
first place.  A window that occurs in a third of all documents is
pre-aggregated to its first place before the join back.

Edge cases: null and empty texts have no marks; a text shorter than a window
is marked as a whole; in a run of equal windows one mark per ``SPAN`` stays;
repeated rows of one id and text are one document; rows without an id, and rows
that share one with other texts, are documents of their own behind all others
(``doc_id`` and ``first_doc_id`` show the id they have); an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import cut

MASK_BITS = 5
LEAST = 20
MOST = 72
MIN_WORDS = 15
WINDOW = 32
SPAN = 70
SIDE = 256
PIECE = 1 << 20

# One value per byte, made by rule: the upper half of a multiplicative hash.
GEAR = np.array([xxhash.xxh32_intdigest(bytes((b,)), 2024) for b in range(256)], dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte: sum of GEAR[byte] << age over 32 bytes."""
    h = GEAR[data]
    step = 1
    while step < WINDOW and step < len(h) + 1:
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step) if step < len(h) else 0
        h = h + older
        step *= 2
    return h


def boundaries(data: np.ndarray, mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Chunk ends of a whole text."""
    marks = []
    for at in range(0, len(data), PIECE):
        back = max(0, at - WINDOW)  # enough bytes before the piece for exact hashes
        h = gear(data[back : at + PIECE])[at - back :]
        marks.append(np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + at + 1)
    ends, start = [], 0
    for mark in np.concatenate(marks).tolist() if marks else []:
        while mark - start > most:
            start += most
            ends.append(start)
        if mark - start >= least:
            ends.append(mark)
            start = mark
    n = len(data)
    while n - start > most:
        start += most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def _slide(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """``f`` over every ``w`` neighbouring values."""
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - w + size], x[w - size :]) if size < w else x


def marks(data: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Ends of the marked windows of a whole text."""
    n = len(data)
    if n < WINDOW:
        return np.arange(n, n + (n > 0))
    ends, values = [], []
    for at in range(WINDOW - 1, n, PIECE):
        low = max(WINDOW - 1, at - span + 1)  # enough hashes around the piece for whole spans
        back = low - WINDOW + 1
        h = gear(data[back : at + PIECE + span - 1])[low - back :]
        w = min(span, len(h))
        edge = np.zeros(w - 1, h.dtype)
        least = _slide(np.concatenate((edge, _slide(h, w, np.minimum), edge)), w, np.maximum)
        here = np.flatnonzero(h == least)
        here = here[(here + low >= at) & (here + low < at + PIECE)]
        ends.append(here + low + 1)
        values.append(h[here])
    end, value = np.concatenate(ends), np.concatenate(values)
    new = np.ones(len(end), bool)
    new[1:] = (value[1:] != value[:-1]) | (np.diff(end) >= span)
    step = (end - end[np.maximum.accumulate(np.where(new, np.arange(len(end)), 0))]) // span
    new[1:] |= step[1:] != step[:-1]
    return end[new]


# ``place``: end of the window (31 bits), distance from the mark before (8 bits, 0 at
# the first) and a digest of the bytes between (24 bits), in one value for a lean shuffle.
MARK_SCHEMA = "doc_id long, place long, d long"


def marked(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per mark: place and digest of its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for i, t in zip(batch.column(0), batch.column(1)):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if not raw:
                    continue
                ends = marks(np.frombuffer(raw, np.uint8), span).astype(np.int64)
                gaps = np.diff(ends, prepend=ends[0])
                at = ends.tolist()
                d = b"".join([xxhash.xxh3_64_digest(raw[max(0, b - WINDOW) : b]) for b in at])
                between = np.array([xxhash.xxh32_intdigest(raw[a:b]) >> 8 for a, b in zip([at[0], *at], at)], np.int64)
                parts.append((np.full(len(ends), i.as_py()), ends << 32 | gaps << 24 | between, np.frombuffer(d, "<i8")))
                size += len(ends)
                if size >= 100_000:
                    yield _mark_batch(parts)
                    parts, size = [], 0
            if parts:
                yield _mark_batch(parts)

    return docs.select("doc_id", "text").mapInArrow(run, MARK_SCHEMA)


def _mark_batch(parts: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in MARK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)], names=names)


def _runs(docs: DataFrame, span: int) -> DataFrame:
    """``doc_id, a, b, n, first_doc_id, fa, fb``: the ends of a run's first and
    last window here and at the first place."""
    found = marked(docs, span)
    first = found.groupBy("d").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    end = lambda place: F.shiftright(place, 32)
    repeats = found.join(first, "d").where((F.col("doc_id") != F.col("first.doc_id")) | (end("place") != end("first.place")))
    low = lambda place: F.col(place).bitwiseAND(F.lit((1 << 32) - 1))
    back = F.when(low("place") == low("first.place"), F.shiftright(low("place"), 24)).otherwise(0)
    repeats = repeats.select("doc_id", end("place").alias("b"), F.col("first.doc_id").alias("first_doc_id"), end("first.place").alias("fb"), back.alias("back"))
    repeats = cut(repeats.distinct())
    order = Window.partitionBy("doc_id").orderBy("b", "first_doc_id", "fb")
    same = F.expr("back > 0") & (F.lag("b").over(order) == F.col("b") - F.col("back")) & (F.lag("first_doc_id").over(order) == F.col("first_doc_id")) & (F.lag("fb").over(order) == F.col("fb") - F.col("back"))
    run = F.sum(F.when(same, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = repeats.withColumn("run", run).groupBy("doc_id", "run", "first_doc_id")
    return runs.agg(F.min("b").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"), F.min("fb").alias("fa"), F.max("fb").alias("fb")).drop("run")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes before and behind the asked places."""
    for batch in batches:
        rows = []
        for i, t, asked in zip(*batch.columns):
            raw = t.as_py().encode("utf-8", "surrogatepass")
            rows += [(i.as_py(), p["fa"], p["fb"], raw[max(0, p["fa"] - WINDOW - SIDE) : p["fa"]], raw[p["fb"] : p["fb"] + SIDE]) for p in asked.as_py()]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, [pa.int64()] * 3 + [pa.binary()] * 2)], names=["first_doc_id", "fa", "fb", "before", "behind"])


def _whole(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without broken words at its ends (characters, where a word is
    longer than a window) and leading white space."""
    if start and not _SPACE[raw[start - 1]]:
        start = next((i for i in range(start, min(end, start + WINDOW)) if _SPACE[raw[i]]), start)
    if end < len(raw) and not _SPACE[raw[end]]:
        end = next((i for i in range(end, max(start, end - WINDOW), -1) if _SPACE[raw[i - 1]]), end)
    while start < end and (raw[start] & 0xC0 == 0x80 or _SPACE[raw[start]]):
        start += 1
    while start < end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


PASSAGES = "doc_id long, start_byte int, end_byte int, words int, chunks int, first_doc_id long"


def _passages(min_words: int):
    def one(raw: bytes, runs: list[dict]) -> list[tuple[int, int, int, int]]:
        found = []
        for r in runs:
            left = _common(raw[max(0, r["a"] - len(r["before"])) : r["a"]][::-1], r["before"][::-1])
            if left < min(WINDOW, r["a"]):
                continue  # equal digests of different bytes
            start, end = r["a"] - left, r["b"] + _common(raw[r["b"] : r["b"] + SIDE], r["behind"])
            found.append((start, end, r["n"], r["first_doc_id"]))
        out: list[list[int]] = []
        for start, end, n, first in sorted(found):
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
                out[-1][2] += n
            else:
                out.append([start, end, n, first])
        return [(*_whole(raw, start, end), n, first) for start, end, n, first in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t, runs in zip(*batch.columns):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                space = _SPACE[np.frombuffer(raw, np.uint8)]
                starts = ~space
                starts[1:] &= space[:-1]
                for a, b, n, first in one(raw, runs.as_py()):
                    words = int(starts[a:b].sum())
                    if words >= min_words:
                        rows.append((i.as_py(), a, b, words, n, first))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), *[pa.int32()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, types)], names=[f.split()[0] for f in PASSAGES.split(", ")])

    return run


OWN = 1 << 62  # keys of rows without an id of their own begin here


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a key per document, and ``key, id`` of the rows whose key
    is not their id.

    The key is the id wherever one id means one text.  Rows without an id and
    rows of an id with several texts are written once and numbered; ids are
    counted map-side, and only repeated ones look at their texts.
    """
    rows = docs.withColumn("_id", F.col("doc_id").cast("long"))
    often = cut(rows.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1 or _id is null").select(F.col("_id").alias("_often")))
    n = often.count()
    if not n:
        return rows.withColumnRenamed("_id", "_key"), None
    often = F.broadcast(often) if n <= 50_000 else often
    shared = rows.join(often, rows["_id"].eqNullSafe(often["_often"]), "left_semi")
    texts = shared.groupBy("_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    mixed = cut(texts.where("_id is null or a <> b").select(F.col("_id").alias("_mixed")))
    n = mixed.count()
    if not n:
        return rows.withColumnRenamed("_id", "_key"), None
    mixed = F.broadcast(mixed) if n <= 50_000 else mixed
    on = rows["_id"].eqNullSafe(mixed["_mixed"])
    own = cut(rows.join(mixed, on, "left_semi").withColumn("_key", F.lit(OWN) + F.monotonically_increasing_id()))
    plain = rows.join(mixed, on, "left_anti").withColumn("_key", F.col("_id"))
    return plain.unionByName(own).drop("_id"), own.select(F.col("_key").alias("key"), F.col("_id").alias("id"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, span: int = SPAN) -> DataFrame:
    """``doc_id, start_byte, end_byte, words, chunks, first_doc_id`` of every
    passage that an earlier place already holds (``chunks``: its marks)."""
    rows, names = keyed(docs)
    found = _by_key(rows.select(F.col("_key").alias("doc_id"), "text"), min_words, span)
    if names is None:
        return found
    for column in ("doc_id", "first_doc_id"):
        joined = found.join(names, found[column] == names["key"], "left")
        found = joined.withColumn(column, F.when(F.col("key").isNull(), F.col(column)).otherwise(F.col("id"))).drop("key", "id")
    return found


def _by_key(docs: DataFrame, min_words: int, span: int) -> DataFrame:
    """The same for documents whose ids are keys."""
    runs = cut(_runs(docs, span))
    texts = docs.where("text <> ''").select("doc_id", "text")
    asked = runs.select(F.col("first_doc_id").alias("doc_id"), "fa", "fb").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("fa", "fb")).alias("asked"))
    around = texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_around, "first_doc_id long, fa long, fb long, before binary, behind binary")
    known = runs.join(around, ["first_doc_id", "fa", "fb"]).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "n", "first_doc_id", "before", "behind")).alias("runs"))
    return texts.join(known, "doc_id").select("doc_id", "text", "runs").mapInArrow(_passages(min_words), PASSAGES).distinct()


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, **params) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``."""
    rows, _ = keyed(docs)
    found = _by_key(rows.select(F.col("_key").alias("doc_id"), "text"), min_words, params.get("span", SPAN))
    spans = found.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start_byte", "end_byte"))).alias("_spans"))

    @F.pandas_udf("string")
    def clean(texts, spans):
        def one(text, cuts):
            if text is None or cuts is None or not len(cuts):
                return text
            raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
            for c in cuts:
                out.append(raw[at : c["start_byte"]])
                at = max(at, c["end_byte"])
            return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")

        import pandas as pd

        return pd.Series([one(t, c) for t, c in zip(texts, spans)], dtype="object")

    joined = rows.join(spans, F.col("_key") == F.col("_id"), "left")
    return joined.withColumn("text", clean("text", "_spans")).select(*docs.columns)

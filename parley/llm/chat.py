"""Chat formatting: cumulative-snapshot collapse, then rendering.

A logger that writes a conversation after every turn leaves conversations that
are prefixes of longer ones.  Every turn gets a rolling hash of its prefix
(position, role and text of all turns so far, 128 bits); a conversation whose
whole hash is a proper prefix hash of another is a snapshot.  Anti-joins drop
snapshots, equal conversations collapse to the smallest id, and the maximal
conversations are rendered in segments of ``segment`` turns.

The rolling hash is a running XOR of position-dependent turn hashes, so it is
built in chunks: turns are ordered inside ``(conversation, chunk of turn
numbers)`` and the chunks' counts and XORs are added up over one row per
chunk.  A conversation that holds a third of all turns is thus many tasks;
prefixes that many conversations share are pre-aggregated to one row; a
rendered row never holds more than ``segment`` turns.

Edge cases: turns are ordered by turn number, then role (nulls first), then a
hash of role and text, so ties and repeated rows have a fixed order; a null role is rendered
as ``unknown`` and a null text as empty, both distinct from those values in
the comparison; rows with a null ``conv_id`` form one conversation; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import cut

CHUNK = 1024
SEGMENT = 256
START, STOP = "<|im_start|>", "<|im_end|>"
HASHES = ("p", "q")


def _content(salt: int) -> Column:
    """Hash of a turn's role and text; null differs from empty."""
    return F.xxhash64(F.lit(salt), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def _positions(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` with ``chunk`` and the 1-based ``pos`` of the turn in its conversation."""
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / chunk))
    counts = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(_earlier()), F.lit(0)))
    rows = _with(rows, counts.select("conv_id", "chunk", "before"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), *HASHES)
    return rows.withColumn("pos", F.col("before") + F.row_number().over(inside)).drop("before")


def _earlier():
    """The chunks of a conversation before this one."""
    return Window.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)


def _hashed(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", *[_content(i + 1).alias(h) for i, h in enumerate(HASHES)])


def rolling(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, pos, p, q``: every turn's position and the hash of the prefix
    that ends there.  Texts are hashed in the scan and not carried along."""
    rows = _positions(_hashed(turns).drop("text"), chunk)
    rows = cut(rows.select("conv_id", "chunk", "pos", *[F.xxhash64("pos", h).alias(h) for h in HASHES]))
    xors = rows.groupBy("conv_id", "chunk").agg(*[F.bit_xor(h).alias(h) for h in HASHES])
    xors = xors.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(h).over(_earlier()), F.lit(0)).alias(f"{h}_before") for h in HASHES])
    upto = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return _with(rows, xors).select("conv_id", "pos", *[F.bit_xor(h).over(upto).bitwiseXOR(F.col(f"{h}_before")).alias(h) for h in HASHES])


def _with(rows: DataFrame, side: DataFrame) -> DataFrame:
    side = side.withColumnRenamed("conv_id", "_conv").withColumnRenamed("chunk", "_chunk")
    return rows.join(side, rows["conv_id"].eqNullSafe(side["_conv"]) & rows["chunk"].eqNullSafe(side["_chunk"])).drop("_conv", "_chunk")


def maximal(rolled: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies`` of the conversations that prefix no longer one."""
    size = rolled.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    ends = rolled.join(size.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    whole = ends.where("pos = n_turns").groupBy("n_turns", *HASHES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = ends.where("pos < n_turns").select(F.col("pos").alias("n_turns"), *HASHES).distinct()
    return whole.join(proper, ["n_turns", *HASHES], "left_anti").select("conv_id", "n_turns", "copies")


def format_chats(turns: DataFrame, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, n_turns, copies, rendered`` of the maximal conversations."""
    kept = cut(maximal(cut(rolling(turns, chunk)))).withColumnRenamed("conv_id", "_conv")
    texts = _hashed(turns).join(kept, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    piece = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(STOP + "\n"))
    rows = _positions(texts, chunk)
    rows = rows.select("conv_id", F.floor((F.col("pos") - 1) / segment).cast("long").alias("segment"), "n_turns", "copies", F.struct("pos", piece.alias("piece")).alias("x"))
    out = rows.groupBy("conv_id", "segment", "n_turns", "copies").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return out.select("conv_id", "segment", F.col("n_turns").cast("long").alias("n_turns"), "copies", F.array_join("xs.piece", "").alias("rendered"))

"""Conversation assembly: pairing, prefixes, ordered lists (J1, A1, A2, P1, P2,
W1, W2, W4, U1).

Partitioning plan.  The per-channel ordinal is computed in turn chunks
(``(conv_id, channel, chunk)`` windows plus a small offsets table), and the
pairing aggregate is keyed by ``(conv_id, seq)``, so no step before the
operators whose output is per conversation (prefixes, assembly) needs a whole
conversation in one task.  A single-``conv_id``-window strategy is kept for
data whose conversations are known to be small.

Nulls and ties.  Rows with a null ``conv_id`` are one conversation; keys are
compared as structs, in which nulls are equal.  A null ``turn`` comes last, and
rows of one turn follow the order of their values (nulls last), so the result
does not depend on the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.schemas import CALLER, VICTIM
from parley.session import cut_lineage


DEFAULT_CHUNK = 4096  # turn numbers per ordinal chunk
DENSE = 4  # a chunk with more rows than DENSE times its turn numbers is ranked over many tasks
LIST_CHUNK = 1024  # rows per chunk of a list; bounds what one window task sorts
MOST_BROADCAST = 50_000  # keys of a counted table that may still be broadcast


def _bounded(keys: DataFrame) -> tuple[DataFrame, int]:
    """A small key table and its size; broadcast only while it is small."""
    keys = cut_lineage(keys)
    n = keys.count()
    return (F.broadcast(keys) if n <= MOST_BROADCAST else keys), n


def ranked(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Add ``_rank``: the 0-based place of each row within its ``key``, over any
    number of tasks however many rows share the key or the order.

    The rows are range-partitioned by key, order and their number in the scan;
    a row's rank is its place in its partition's run of the key plus the sizes
    of that key's runs before (one row per key and partition).
    """
    by = [F.col(key).asc(), *order, F.col("_row").asc()]
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_in")  # the upper bits of the id are the partition
    runs = placed.groupBy(key, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(key).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(key, "_in", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_in", F.shiftright("_at", 33)).join(runs, [key, "_in"])
    return joined.withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_in", "_first", "_before")


def _turn_order(turns: DataFrame, ties: Sequence[str] | None) -> list[Column]:
    if ties is None:
        ties = [f.name for f in turns.schema.fields if f.name not in ("conv_id", "turn", "channel") and not isinstance(f.dataType, T.MapType)]
    return [F.col(c).asc_nulls_last() for c in ("turn", *ties)]


def channel_ordinal(
    turns: DataFrame,
    channels: Sequence[str] = (CALLER, VICTIM),
    strategy: str = "chunked",
    chunk: int = DEFAULT_CHUNK,
    ties: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``seq``: 0-based position of the utterance within its own channel.

    ``strategy="chunked"`` (default) is skew-safe: turns are cut into chunks of
    ``chunk`` consecutive turn numbers, each chunk's per-channel count is
    aggregated, a running sum over the (few) chunks gives each chunk's offset,
    and ``row_number`` runs inside ``(conv_id, channel, chunk)`` only.  A
    conversation holding a third of all rows is spread over many tasks.  Chunks
    that hold far more rows than turn numbers (one number, or none, for many
    rows) are ranked by a range partitioning instead (``ranked``).

    ``strategy="window"`` uses one running count per ``conv_id`` window: a
    single Exchange, right when conversations are known to be small.

    ``ties`` order the rows of one turn (default: all other columns).
    """
    order = _turn_order(turns, ties)
    if strategy == "window":
        w = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seq: Column | None = None
        for ch in channels:
            running = F.sum(F.when(F.col("channel") == ch, 1).otherwise(0)).over(w) - 1
            seq = F.when(F.col("channel") == ch, running) if seq is None else seq.when(F.col("channel") == ch, running)
        return turns.withColumn("seq", seq.cast("int"))
    if strategy != "chunked":
        raise ValueError(f"unknown strategy {strategy!r}")
    # The count branch reads only key columns (column pruning) and
    # pre-aggregates map-side; only the row-number branch carries the values.
    key = F.struct("conv_id", "channel", F.floor(F.col("turn") / F.lit(chunk)).alias("chunk")).alias("_k")
    keyed = turns.where(F.col("channel").isin(*channels)).select("*", key)
    counts = cut_lineage(keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("_k.conv_id", "_k.channel").orderBy(F.col("_k.chunk").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_k", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    dense, n_dense = _bounded(offsets.where(F.col("_n") > DENSE * chunk).select("_k", "_off"))
    sparse = keyed.join(dense, "_k", "left_anti") if n_dense else keyed
    inner = Window.partitionBy("_k").orderBy(*order)
    out = sparse.join(offsets, "_k").withColumn("_rank", F.row_number().over(inner) - 1)
    out = out.select(*turns.columns, (F.col("_off") + F.col("_rank")).cast("int").alias("seq"))
    if n_dense:
        many = ranked(keyed.join(dense, "_k"), "_k", order)
        out = out.unionByName(many.select(*turns.columns, (F.col("_off") + F.col("_rank")).cast("int").alias("seq")))
    return out


def pair_turns(
    turns: DataFrame,
    value: str = "text",
    carry: Sequence[str] = (),
    caller: str = CALLER,
    victim: str = VICTIM,
    strategy: str = "chunked",
) -> DataFrame:
    """Positional pairing of the two speakers, truncated to the shorter side.

    The k-th caller utterance (by ``turn``, then by value) is paired with the k-th victim
    utterance; the result has ``conv_id, seq, caller, victim`` plus the
    conversation-level ``carry`` columns.  Each ``(conv_id, seq)`` group holds
    at most two rows, so the aggregate is bounded per key.
    """
    ordered = channel_ordinal(turns.select("conv_id", "turn", "channel", value, *carry), (caller, victim), strategy=strategy)
    keys = ["conv_id", "seq", *carry]
    # A (conv_id, seq) key holds at most one utterance per channel, so the
    # group is collected (<= 2 structs, hash-based aggregation for any value
    # type) and each side is picked by channel.
    packed = F.struct(F.col("channel").alias("ch"), F.col(value).alias("v"))
    grouped = ordered.groupBy(*keys).agg(F.collect_list(packed).alias("_p"))
    side = lambda ch: F.filter("_p", lambda x: x["ch"] == F.lit(ch))
    both = (F.size(side(caller)) > 0) & (F.size(side(victim)) > 0)
    return grouped.where(both).select(
        *keys,
        F.element_at(side(caller), 1)["v"].alias("caller"),
        F.element_at(side(victim), 1)["v"].alias("victim"),
    )


def growing_lists(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], keep: Sequence[str], chunk: int = LIST_CHUNK) -> DataFrame:
    """Per key and in ``order`` (a dense 0-based number), every row with the
    lists of ``values`` so far, as ``_<value>``.

    A two-level scan.  Inside a chunk of ``chunk`` rows a window grows the
    lists.  A key of several chunks also sends each chunk's finished list to
    every later chunk of the key; what arrives at (key, chunk) is put together
    there and prepended.  So neither the values nor the quadratic output of a
    hot key ever meet in one task: a task holds the chunks before its own once,
    which is what one of its result rows holds.  Keys of one chunk, the usual
    case, take no part in the second level.
    """
    part = F.floor(F.col(order) / chunk).alias("_part")
    rows = cut_lineage(df.select(F.struct(*keys).alias("_k"), order, *values, *keep, part))
    inside = Window.partitionBy("_k", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.select("_k", order, *keep, "_part", *[F.collect_list(_slot(v)).over(inside).alias(f"_l_{v}") for v in values])
    bare = lambda v: F.transform(f"_l_{v}", _field("v"))
    long, n_long = _bounded(rows.groupBy("_k").agg(F.max("_part").alias("_last")).where("_last > 0"))
    if not n_long:
        return own.select("_k.*", order, *keep, *[bare(v).alias(f"_{v}") for v in values])
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *values)))
    chunks = rows.join(long, "_k").groupBy("_k", "_part", "_last").agg(packed.alias("_rows"))
    target = F.explode(F.sequence(F.col("_part") + 1, F.col("_last"))).alias("_target")
    sent = chunks.where("_part < _last").select("_k", target, F.struct("_part", *[F.transform("_rows", _field(v)).alias(v) for v in values]).alias("_p"))
    arrived = sent.groupBy("_k", F.col("_target").alias("_part")).agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    earlier = arrived.select("_k", "_part", *[F.flatten(F.transform("_ps", _field(v))).alias(f"_e_{v}") for v in values])
    joined = own.join(earlier, ["_k", "_part"], "left")
    whole = lambda v: F.when(F.col(f"_e_{v}").isNull(), bare(v)).otherwise(F.concat(f"_e_{v}", bare(v)))
    return joined.select("_k.*", order, *keep, *[whole(v).alias(f"_{v}") for v in values])


def _slot(value: str) -> Column:
    """The value in a struct: ``collect_list`` leaves out bare nulls."""
    return F.struct(F.col(value).alias("v"))


def conversation_prefixes(pairs: DataFrame, values: Sequence[str] = ("caller", "victim"), carry: Sequence[str] = (), chunk: int = LIST_CHUNK) -> DataFrame:
    """Prefix expansion: pair k becomes a row holding pairs 0..k of both channels.

    ``prefix_id`` is ``<conv_id>_<k>`` (null without a ``conv_id``).  Output size is quadratic in the
    conversation length by definition of the operator; it is made chunk-wise
    (``growing_lists``).
    """
    grown = growing_lists(pairs, ["conv_id"], "seq", values, carry, chunk)
    return grown.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("seq").cast("string")).alias("prefix_id"),
        F.col("conv_id"),
        F.col("seq").cast("int").alias("prefix_no"),
        *[F.col(f"_{v}").alias(v) for v in values],
        *carry,
    )


def _field(name: str):
    return lambda x: x[name]


def ordered_lists(df: DataFrame, keys: Sequence[str], order: str, value: str, chunk: int = LIST_CHUNK) -> DataFrame:
    """``keys, values``: the values of each key in ``order`` (a number; nulls
    last, equal ones by value, null values last).

    Sorted chunk by chunk first, then the chunks are put together, so only the
    finished list of a hot key meets in one row.
    """
    last = lambda c: [F.isnull(c).alias(f"_n_{c}"), F.col(c)]
    rows = df.select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v"), F.floor(F.col(order) / chunk).alias("_part"))
    parts = rows.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list(F.struct(*last("_o"), *last("_v")))).alias("_rows"))
    parts = parts.select(*keys, F.struct(*last("_part"), F.transform("_rows", _field("_v")).alias("_vs")).alias("_p"))
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_ps")).select(*keys, F.flatten(F.transform("_ps", _field("_vs"))).alias("values"))


def assemble_conversations(turns: DataFrame, value: str = "text", carry: Sequence[str] = (), channels: Sequence[str] = (CALLER, VICTIM), chunk: int = LIST_CHUNK) -> DataFrame:
    """One row per conversation with both channels' complete utterance lists.

    Unequal channels keep their surplus; a conversation in which one side never
    speaks has an empty list there.
    """
    ordered = channel_ordinal(turns.select("conv_id", "turn", "channel", value, *carry), channels)
    lists = ordered_lists(ordered, ["conv_id", *carry, "channel"], "seq", value, chunk)
    side = lambda ch: F.first(F.when(F.col("channel") == ch, F.col("values")), ignorenulls=True)
    out = lists.groupBy("conv_id", *carry).agg(*[side(ch).alias(f"_{ch}") for ch in channels])
    empty = F.array().cast(lists.schema["values"].dataType)
    return out.select("conv_id", *carry, *[F.coalesce(f"_{ch}", empty).alias(ch) for ch in channels])


def distinct_conversations(turns: DataFrame) -> DataFrame:
    """Distinct conversation ids with their first turn and size, in id order."""
    return (
        turns.groupBy("conv_id")
        .agg(
            F.min("turn").alias("first_turn"),
            F.count(F.lit(1)).alias("n_turns"),
            F.sum(F.when(F.col("channel") == CALLER, 1).otherwise(0)).alias("n_caller"),
            F.sum(F.when(F.col("channel") == VICTIM, 1).otherwise(0)).alias("n_victim"),
        )
        .orderBy("conv_id")
    )


def lookup_conversation(
    df: DataFrame,
    key: str,
    list_columns: Sequence[str],
    order_by: str,
    value: object | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Equality lookup with column-wise collapse.

    For the rows of each key value (or of ``value`` only, when given):
    ``list_columns`` become their full list in ``order_by`` order; every other
    column becomes its single value when it has one distinct value, else the
    sorted list of its distinct values (as ``array<string>``).
    """
    src = df if value is None else df.where(F.col(key) == F.lit(value))
    others = [c for c in df.columns if c not in (key, *list_columns, *exclude)]
    src = src.withColumn("_k", F.struct(key))  # in a struct, a null key equals itself
    out = src.groupBy("_k").agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"_s_{c}") for c in others])
    for c in list_columns:
        # Sorted chunk by chunk, so a hot key's rows are not sorted in one task.
        out = out.join(ordered_lists(src, ["_k"], order_by, c).withColumnRenamed("values", f"_l_{c}"), "_k")
    return out.select(
        F.col(f"_k.{key}"),
        *[F.col(f"_l_{c}").alias(c) for c in list_columns],
        *[
            F.struct(
                F.when(F.size(f"_s_{c}") == 1, F.col(f"_s_{c}")[0]).alias("scalar"),
                F.when(F.size(f"_s_{c}") != 1, F.col(f"_s_{c}")).alias("values"),
            ).alias(c)
            for c in others
        ],
    )


def fetch_prefix(pairs: DataFrame, prefix_id: str, columns: Sequence[str] = ("prefix_id", "caller", "victim"), values: Sequence[str] = ("caller", "victim")) -> DataFrame:
    """Point lookup of one prefix: its conversation and number follow from the
    id, so only the pairs it holds are read, and no other prefix is made.  A
    stored table of prefixes (with a ``prefix_id`` column) is filtered."""
    if "prefix_id" in pairs.columns:
        return pairs.select(*columns).where(F.col("prefix_id") == F.lit(prefix_id)).limit(1)
    conv_id, _, number = prefix_id.rpartition("_")
    if not number.isdigit():
        return pairs.limit(0).select(F.lit(prefix_id).alias("prefix_id"), *[F.array(v).alias(v) for v in values]).select(*columns)
    held = pairs.where((F.col("conv_id") == F.lit(conv_id)) & (F.col("seq") <= int(number)))
    lists = ordered_lists(held.withColumn("_pair", F.struct(*values)), ["conv_id"], "seq", "_pair")
    # Without its last pair the prefix does not exist.
    lists = lists.where(F.size("values") == int(number) + 1)
    return lists.select(F.lit(prefix_id).alias("prefix_id"), "conv_id", F.lit(int(number)).alias("prefix_no"), *[F.transform("values", _field(v)).alias(v) for v in values]).select(*columns)


def running_transcript(turns: DataFrame, value: str = "text", chunk: int = LIST_CHUNK) -> DataFrame:
    """Per channel, the list of utterances so far, re-emitted at every utterance."""
    numbered = channel_ordinal(turns.select("conv_id", "channel", "turn", value))  # null and tied turns as there
    grown = growing_lists(numbered, ["conv_id", "channel"], "seq", [value], ["turn"], chunk)
    return grown.select("conv_id", "channel", "turn", F.col(f"_{value}").alias("transcript"))


def union_conversations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append new rows to a dataset (no dedupe), matching columns by name."""
    return existing.unionByName(new)

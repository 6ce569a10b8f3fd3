"""Ingest, keys, codecs and profiles.

Generated conversations arrive as a JSON object of numbered turns,
``{"1": {"Attacker"|"Helper": s, "Victim": s}, ...}``, plus a type string.
``from_json`` to a map keeps document order, so ``posexplode`` yields the turn
position without any Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.assemble import ordered_lists
from parley.schemas import RESPONSE

# Fixed values of the labelling contract.
SCAM_TYPE = "vishing"
NORMAL_TYPE = "normal"


def encode_label(type_col: Column | str) -> Column:
    """``vishing`` -> 1, anything else -> 0."""
    c = F.col(type_col) if isinstance(type_col, str) else type_col
    return F.when(c == F.lit(SCAM_TYPE), F.lit(1)).otherwise(F.lit(0)).cast("int")


def conversation_key(*cols: Column | str, length: int = 14) -> Column:
    """Deterministic conversation id: the first ``length`` hex chars of the
    SHA-256 of the content, so re-ingesting the same text is idempotent."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, length)


KEY_BITS = 56  # bits per key half; two halves make a 112-bit key


def conversation_content_key(turns, key: str = "conv_id", order: str = "turn", value: str = "text"):
    """Content key of whole conversations without gathering them.

    Each turn's ``(turn number, text)`` is hashed with SHA-256; two 56-bit
    slices of the digest are summed per conversation (order-aware, because the
    turn number is hashed in; commutative, so the sums pre-aggregate map-side
    and a conversation of any size never meets in one row).  The key is the
    two sums modulo 2^56 as 28 hex characters: deterministic, so re-ingesting
    the same conversation gives the same key.
    """
    digest = F.sha2(F.concat_ws("\u001f", F.col(order).cast("string"), F.coalesce(F.col(value), F.lit(""))), 256)
    half = lambda start: F.conv(F.substring(digest, start, KEY_BITS // 4), 16, 10).cast("decimal(38,0)")
    sums = turns.groupBy(key).agg(F.sum(half(1)).alias("_x"), F.sum(half(1 + KEY_BITS // 4)).alias("_y"))
    modulus = F.lit(2**KEY_BITS).cast("decimal(38,0)")
    fmt = lambda c: F.lpad(F.lower(F.hex(F.pmod(F.col(c), modulus).cast("long"))), KEY_BITS // 4, "0")
    return sums.select(key, F.concat(fmt("_x"), fmt("_y")).alias("conv_key"))


def ingest_conversation_json(
    df: DataFrame,
    json_col: str = "response",
    type_col: str = "conversation_type",
    id_col: str = "conv_id",
) -> tuple[DataFrame, DataFrame]:
    """Explode response documents to one row per turn.

    Returns ``(turns, rejects)``.  ``turns`` has ``conv_id, seq, turn_key,
    caller, victim, label`` where the caller text is ``Attacker`` for the scam
    type and ``Helper`` otherwise.  Documents whose JSON does not parse to the
    expected map go to ``rejects`` unchanged instead of failing the job.
    """
    parsed = df.select("*", F.from_json(F.col(json_col), RESPONSE).alias("_turns"))
    rejects = parsed.where(F.col("_turns").isNull() | (F.size("_turns") == 0)).drop("_turns")
    good = parsed.where(F.col("_turns").isNotNull() & (F.size("_turns") > 0))
    exploded = good.select(
        F.col(id_col).alias("conv_id"),
        F.col(type_col),
        F.posexplode("_turns").alias("seq", "turn_key", "_t"),
    )
    is_scam = F.col(type_col) == F.lit(SCAM_TYPE)
    turns = exploded.select(
        "conv_id",
        F.col("seq").cast("int").alias("seq"),
        "turn_key",
        F.when(is_scam, F.col("_t.Attacker")).otherwise(F.col("_t.Helper")).alias("caller"),
        F.col("_t.Victim").alias("victim"),
        encode_label(type_col).alias("label"),
    )
    return turns, rejects


def cast_labels(df: DataFrame, raw: str = "raw_label", label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels that arrive as text: ``(valid, rejects, counts)``.

    ``valid`` has the integer ``label``; rows whose text is not an integer go to
    ``rejects`` unchanged instead of failing the job; ``counts`` has one row,
    ``n_valid, n_rejected``.  A null text is a missing label and is rejected.
    """
    tried = df.withColumn(label, F.col(raw).try_cast("int"))
    counts = tried.agg(F.count(label).alias("n_valid"), (F.count(F.lit(1)) - F.count(label)).alias("n_rejected"))
    return tried.where(F.col(label).isNotNull()), tried.where(F.col(label).isNull()).drop(label), counts


def render_response(pairs: DataFrame, label_col: str = "label") -> DataFrame:
    """Inverse of :func:`ingest_conversation_json`: one response document per
    conversation, numbered from 1 in ``seq`` order."""
    is_scam = F.col(label_col) == 1
    entry = F.struct(
        (F.col("seq") + 1).cast("string").alias("key"),
        F.struct(
            F.when(is_scam, F.col("caller")).alias("Attacker"),
            F.when(~is_scam, F.col("caller")).alias("Helper"),
            F.col("victim").alias("Victim"),
        ).alias("value"),
    )
    grouped = ordered_lists(pairs.withColumn("_entry", entry), ["conv_id", label_col], "seq", "_entry")
    return grouped.select(
        "conv_id",
        F.to_json(F.map_from_entries("values")).alias("response"),
        F.when(F.col(label_col) == 1, F.lit(SCAM_TYPE)).otherwise(F.lit(NORMAL_TYPE)).alias("conversation_type"),
    )


def dataset_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, columns and per-column null counts in one scan.

    One row per column: ``column, position, n_rows, n_nulls, n_cols``.
    """
    cols = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"_z{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    stacked = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"_z{i}").alias("n_nulls")) for i, c in enumerate(cols)])
    ).alias("s")
    return one.select(F.col("_n").alias("n_rows"), stacked).select(
        "s.column",
        F.col("s.position").cast("int").alias("position"),
        "n_rows",
        F.col("s.n_nulls").cast("long").alias("n_nulls"),
        F.lit(len(cols)).cast("int").alias("n_cols"),
    )

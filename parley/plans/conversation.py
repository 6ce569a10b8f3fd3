"""Checked queries over conversation assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import assemble as asm
from parley.plans.registry import SQL_CLEAN, SQL_CONV_TURNS, SQL_DOC_TURNS, SQL_TOKENS, register, sql_pairs
from parley.sources.tables import conversation_turns, document_channels


def tokenized_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with cleaned tokens; cleaning runs once per turn,
    map-side, before any shuffle."""
    return conversation_turns(spark, sf_dir).withColumn("tokens", tx.clean_tokens("text"))


def tokenized_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = asm.pair_turns(tokenized_turns(spark, sf_dir), value="tokens")
    return asm.conversation_prefixes(pairs)


ORACLE_PREFIXES = f"""
WITH {sql_pairs(SQL_CONV_TURNS, SQL_TOKENS.format(x='text'))}
SELECT conv_id || '_' || CAST(seq AS VARCHAR) AS prefix_id, conv_id, seq AS prefix_no,
       to_json(list(caller) OVER w) AS caller, to_json(list(victim) OVER w) AS victim
FROM p
WINDOW w AS (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


@register("conversation_prefixes", oracle=ORACLE_PREFIXES)
def q_conversation_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenized_prefixes(spark, sf_dir)
    return out.select("prefix_id", "conv_id", "prefix_no", F.to_json("caller").alias("caller"), F.to_json("victim").alias("victim"))


@register(
    "pair_turns",
    oracle=f"""
WITH {sql_pairs(SQL_CONV_TURNS, 'text')}
SELECT conv_id, seq, caller, victim FROM p
""",
)
def q_pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asm.pair_turns(conversation_turns(spark, sf_dir)).select("conv_id", "seq", "caller", "victim")


@register(
    "clean_text",
    oracle=f"""
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS BIGINT) AS turn,
       {SQL_CLEAN.format(x='text')} AS cleaned,
       to_json({SQL_TOKENS.format(x='text')}) AS tokens,
       len({SQL_TOKENS.format(x='text')}) AS n_tokens
FROM conversations
""",
)
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.sources.tables import load_table

    conv = load_table(spark, sf_dir, "conversations")
    tokens = tx.clean_tokens("text")
    return conv.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        tx.clean_text("text").alias("cleaned"),
        F.to_json(tokens).alias("tokens"),
        F.size(tokens).cast("long").alias("n_tokens"),
    )


SQL_LISTS = """
WITH t AS (SELECT * FROM ({turns}) x)
SELECT conv_id{carry},
       to_json(coalesce(list({value} ORDER BY turn NULLS LAST, {value} NULLS LAST) FILTER (WHERE channel = 'caller'), [])) AS caller,
       to_json(coalesce(list({value} ORDER BY turn NULLS LAST, {value} NULLS LAST) FILTER (WHERE channel = 'victim'), [])) AS victim,
       count(*) FILTER (WHERE channel = 'caller') AS n_caller, count(*) FILTER (WHERE channel = 'victim') AS n_victim
FROM t GROUP BY conv_id{carry}
"""


def _listed(df: DataFrame, *carry: str) -> DataFrame:
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("caller", "victim")]
    return df.select("conv_id", *carry, F.to_json("caller").alias("caller"), F.to_json("victim").alias("victim"), *sizes)


@register("assemble_conversations", oracle=SQL_LISTS.format(turns=SQL_CONV_TURNS, value=SQL_TOKENS.format(x="text"), carry=""))
def q_assemble_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(asm.assemble_conversations(tokenized_turns(spark, sf_dir), value="tokens"))


@register("assemble_documents", oracle=SQL_LISTS.format(turns=SQL_DOC_TURNS, value=SQL_TOKENS.format(x="text"), carry=", label"))
def q_assemble_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both complete line lists of every labelled document, cleaned in the row."""
    docs = document_channels(spark, sf_dir)
    lists = docs.select("conv_id", "label", *[F.transform(c, tx.clean_tokens).alias(c) for c in ("caller", "victim")])
    return _listed(lists, "label")


@register(
    "fetch_prefix",
    oracle=f"""
WITH {sql_pairs(SQL_CONV_TURNS, 'text')}
SELECT conv_id || '_' || CAST(max(seq) AS VARCHAR) AS prefix_id, to_json(list(caller ORDER BY seq)) AS caller, to_json(list(victim ORDER BY seq)) AS victim
FROM p WHERE conv_id = (SELECT min(conv_id) FROM p) GROUP BY conv_id
""",
)
def q_fetch_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookup of one prefix: the last one of the first conversation."""
    pairs = asm.pair_turns(conversation_turns(spark, sf_dir))
    last = pairs.where("conv_id is not null").select(F.min(F.struct("conv_id", (-F.col("seq")).alias("s"))).alias("m")).first()["m"]
    wanted = f"{last['conv_id']}_{-last['s']}" if last else ""
    out = asm.fetch_prefix(pairs, wanted)
    return out.select("prefix_id", F.to_json("caller").alias("caller"), F.to_json("victim").alias("victim"))


@register(
    "distinct_conversations",
    oracle=f"""
SELECT conv_id, min(turn) AS first_turn, count(*) AS n_turns,
       CAST(sum(CASE WHEN channel = 'caller' THEN 1 ELSE 0 END) AS BIGINT) AS n_caller,
       CAST(sum(CASE WHEN channel = 'victim' THEN 1 ELSE 0 END) AS BIGINT) AS n_victim
FROM ({SQL_CONV_TURNS}) t GROUP BY conv_id
""",
)
def q_distinct_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asm.distinct_conversations(conversation_turns(spark, sf_dir))


@register(
    "lookup_conversation",
    oracle="""
SELECT CAST(conv_id AS VARCHAR) AS conv_id,
       to_json(list(text ORDER BY turn NULLS LAST, text NULLS LAST)) AS text,
       CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS role_scalar,
       CASE WHEN count(DISTINCT role) <> 1 THEN to_json(list_sort(list(DISTINCT role) FILTER (WHERE role IS NOT NULL))) END AS role_values
FROM conversations GROUP BY conv_id
""",
)
def q_lookup_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.sources.tables import load_table

    conv = load_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text")
    out = asm.lookup_conversation(conv, "conv_id", ["text"], order_by="turn", exclude=["turn"])
    return out.select(
        "conv_id",
        F.to_json("text").alias("text"),
        F.col("role.scalar").alias("role_scalar"),
        F.to_json(F.col("role.values")).alias("role_values"),
    )


@register(
    "running_transcript",
    oracle=f"""
SELECT conv_id, channel, turn,
       to_json(list({SQL_CLEAN.format(x='text')}) OVER (PARTITION BY conv_id, channel ORDER BY turn NULLS LAST, {SQL_CLEAN.format(x='text')} NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS transcript
FROM ({SQL_CONV_TURNS}) t
""",
)
def q_running_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir).withColumn("cleaned", tx.clean_text("text"))
    out = asm.running_transcript(turns, value="cleaned")
    return out.select("conv_id", "channel", "turn", F.to_json("transcript").alias("transcript"))

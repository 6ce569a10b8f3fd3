"""Checked queries over sources, sinks and codecs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import assemble as asm
from parley.plans.registry import SQL_CONV_TURNS, SQL_DOC_TURNS, SQL_TOKENS, register, sql_pairs
from parley.schemas import RAW_TURNS
from parley.session import cut_lineage, scratch_path
from parley.sources import commits, ingest
from parley.sources.tables import conversation_turns, document_line_pairs, labelled_documents, load_table


@register(
    "dataset_profile",
    oracle="""
WITH n AS (SELECT count(*) AS n_rows,
                  count_if(conv_id IS NULL) AS z0, count_if(turn IS NULL) AS z1,
                  count_if(role IS NULL) AS z2, count_if(text IS NULL) AS z3 FROM conversations)
SELECT 'conv_id' AS "column", 0 AS position, n_rows, z0 AS n_nulls, 4 AS n_cols FROM n
UNION ALL SELECT 'turn', 1, n_rows, z1, 4 FROM n
UNION ALL SELECT 'role', 2, n_rows, z2, 4 FROM n
UNION ALL SELECT 'text', 3, n_rows, z3, 4 FROM n
""",
)
def q_dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dataset_profile(load_table(spark, sf_dir, "conversations"))


@register(
    "ingest_conversation_json",
    oracle=f"""
WITH {sql_pairs(SQL_DOC_TURNS, 'text', carry='label')}
SELECT conv_id, seq, CAST(seq + 1 AS VARCHAR) AS turn_key, caller, victim, label, false AS rejected
FROM p WHERE CAST(conv_id AS BIGINT) % 10 <> 0
UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, NULL, label, true FROM p WHERE CAST(conv_id AS BIGINT) % 10 = 0
""",
)
def q_ingest_conversation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of every labelled document; those of each tenth document are
    cut in half first, so the query also shows what becomes of malformed JSON:
    one reject row each, and no turn rows."""
    responses = ingest.render_response(document_line_pairs(spark, sf_dir))
    half = F.substr(F.col("response"), F.lit(1), F.floor(F.length("response") / 2).cast("int"))
    broken = F.col("conv_id").cast("long") % 10 == 0
    turns, rejects = ingest.ingest_conversation_json(responses.withColumn("response", F.when(broken, half).otherwise(F.col("response"))))
    kept = turns.withColumn("rejected", F.lit(False))
    return kept.unionByName(rejects.select("conv_id", ingest.encode_label("conversation_type").alias("label"), F.lit(True).alias("rejected")), allowMissingColumns=True)


@register(
    "cast_labels",
    oracle="""
WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS conv_id, CASE WHEN doc_id % 7 = 0 THEN lang ELSE CAST(quality AS VARCHAR) END AS raw_label
           FROM documents JOIN labels USING (doc_id))
SELECT conv_id, raw_label, TRY_CAST(raw_label AS INTEGER) AS label, count(TRY_CAST(raw_label AS INTEGER)) OVER () AS n_valid,
       count(*) FILTER (WHERE TRY_CAST(raw_label AS INTEGER) IS NULL) OVER () AS n_rejected FROM r
""",
)
def q_cast_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text labels of every labelled document; each seventh holds its language
    instead of a number.  Valid and rejected rows with both counts."""
    raw = F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise(F.col("quality").cast("string"))
    rows = labelled_documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("conv_id"), raw.alias("raw_label"))
    valid, rejects, counts = ingest.cast_labels(rows)
    rows = valid.unionByName(rejects, allowMissingColumns=True)
    return rows.select("*", *[counts.select(n).scalar().alias(n) for n in ("n_valid", "n_rejected")])


@register(
    "conversation_key",
    oracle="""
WITH h AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id,
                  sha256(CAST(turn AS VARCHAR) || chr(31) || coalesce(text, '')) AS d FROM conversations),
  s AS (SELECT conv_id, sum(CAST(('0x' || substr(d, 1, 14))::BIGINT AS HUGEINT)) AS x,
               sum(CAST(('0x' || substr(d, 15, 14))::BIGINT AS HUGEINT)) AS y FROM h GROUP BY conv_id)
SELECT conv_id,
       lpad(lower(hex(CAST(x % 72057594037927936 AS BIGINT))), 14, '0')
       || lpad(lower(hex(CAST(y % 72057594037927936 AS BIGINT))), 14, '0') AS conv_key
FROM s
""",
)
def q_conversation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = load_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "text")
    return ingest.conversation_content_key(conv)


_ESCAPED = r"replace(replace(replace(replace(w, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"
SQL_LITERAL = (
    f"CASE WHEN w IS NULL THEN 'None' WHEN contains(w, chr(39)) AND NOT contains(w, '\"') THEN '\"' || {_ESCAPED} || '\"' "
    f"ELSE chr(39) || replace({_ESCAPED}, chr(39), '\\' || chr(39)) || chr(39) END"
)
SQL_RENDER = "'[' || array_to_string(list_transform({x}, lambda xs: '[' || array_to_string(list_transform(xs, lambda w: " + SQL_LITERAL + "), ', ') || ']'), ', ') || ']'"


@register(
    "parse_nested_list",
    oracle=f"""
WITH a AS (SELECT conv_id, coalesce(list(string_split(text, ' ') ORDER BY turn NULLS LAST, text NULLS LAST) FILTER (WHERE channel = 'caller'), []) AS caller
           FROM ({SQL_CONV_TURNS}) t GROUP BY conv_id),
  c AS (SELECT conv_id, {SQL_RENDER.format(x='caller')} AS cell, caller FROM a)
SELECT conv_id, CASE WHEN CAST(conv_id AS BIGINT) % 10 = 0 THEN cell[1:-2] ELSE cell END AS cell,
       CASE WHEN CAST(conv_id AS BIGINT) % 10 <> 0 THEN to_json(caller) END AS parsed, CAST(conv_id AS BIGINT) % 10 = 0 AS rejected
FROM c
""",
)
def q_parse_nested_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw words of every conversation's caller as list-literal cells and
    back; each tenth cell has lost its last bracket and is rejected."""
    turns = conversation_turns(spark, sf_dir).withColumn("words", F.split("text", " "))
    conv = asm.assemble_conversations(turns, value="words")
    cell = tx.render_nested_list("caller")
    broken = F.col("conv_id").cast("long") % 10 == 0
    cells = conv.select("conv_id", F.when(broken, F.substr(cell, F.lit(1), F.length(cell) - 1)).otherwise(cell).alias("cell"))
    valid, rejects = tx.split_nested_list(cells, "cell", "parsed")
    out = valid.select("conv_id", "cell", F.to_json("parsed").alias("parsed"), F.lit(False).alias("rejected"))
    return out.unionByName(rejects.select("conv_id", "cell", F.lit(None).cast("string").alias("parsed"), F.lit(True).alias("rejected")))


@register("append_conversations", oracle=f"WITH {sql_pairs(SQL_CONV_TURNS, 'text')} SELECT conv_id, seq, caller, victim, CAST(NULL AS INTEGER) AS label, 2 AS n_batches FROM p")
def q_append_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired turns appended as two batches, one of them twice, and read back."""
    path = scratch_path(spark, "datasets", uuid.uuid4().hex)
    pairs = cut_lineage(asm.pair_turns(conversation_turns(spark, sf_dir)).select("conv_id", "seq", "caller", "victim", F.lit(None).cast("int").alias("label")))
    odd = F.coalesce(F.col("conv_id").cast("long") % 2 == 1, F.lit(False))
    for part in (pairs.where(odd), pairs.where(~odd), pairs.where(odd).repartition(3)):
        commits.append_batch(part, path)
    n = commits.commits(spark, path).select(F.count("*").cast("int")).scalar()
    return commits.read_batches(spark, path, RAW_TURNS).select("*", n.alias("n_batches"))


@register(
    "encode_messages",
    oracle=f"""
WITH {sql_pairs(SQL_CONV_TURNS, SQL_TOKENS.format(x='text'))}
SELECT conv_id || '_' || CAST(seq AS VARCHAR) AS prefix_id,
       to_json({{'Attacker_Helper': flatten(list(caller) OVER w), 'Victim': flatten(list(victim) OVER w)}}) AS message
FROM p
WINDOW w AS (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
)
def q_encode_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir).withColumn("tokens", tx.clean_tokens("text"))
    prefixes = asm.conversation_prefixes(asm.pair_turns(turns, value="tokens"))
    return prefixes.select(
        "prefix_id",
        tx.encode_message(tx.flatten_tokens("caller").alias("Attacker_Helper"), tx.flatten_tokens("victim").alias("Victim")).alias("message"),
    )


@register(
    "union_conversations",
    oracle=f"""
WITH {sql_pairs(SQL_CONV_TURNS, 'text')}
SELECT conv_id, seq, caller, victim, CAST(NULL AS INTEGER) AS label, 'conversations' AS origin FROM p
UNION ALL
SELECT * FROM (WITH {sql_pairs(SQL_DOC_TURNS, 'text', carry='label')}
               SELECT conv_id, seq, caller, victim, label, 'documents' AS origin FROM p)
""",
)
def q_union_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = asm.pair_turns(conversation_turns(spark, sf_dir)).select(
        "conv_id", "seq", "caller", "victim", F.lit(None).cast("int").alias("label"), F.lit("conversations").alias("origin")
    )
    new = document_line_pairs(spark, sf_dir).select(
        "conv_id", "seq", "caller", "victim", "label", F.lit("documents").alias("origin")
    )
    return asm.union_conversations(existing, new)




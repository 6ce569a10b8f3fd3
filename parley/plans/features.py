"""Checked queries over features."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import assemble as asm
from parley.operators import features as ft
from parley.operators import normalize as nz
from parley.plans.porter_sql import stem_ctes
from parley.plans.registry import SQL_CONV_TURNS, SQL_DOC_TURNS, SQL_TOKENS, register, sql_pairs
from parley.session import cut_lineage
from parley.sources.tables import conversation_turns, document_channels

SQL_SLOT = "CAST(('0x' || substr(md5({x}), 1, 8))::BIGINT % 200 AS INTEGER)"

# Labelled two-channel documents: every line's tokens, English ones stemmed.
SQL_DOC_TK = f"""
  lines AS MATERIALIZED (SELECT conv_id, label, lang, channel, turn // 2 AS seq, {SQL_TOKENS.format(x='text')} AS tokens FROM ({SQL_DOC_TURNS}) t),
  raw AS MATERIALIZED (SELECT conv_id, label, lang, channel, seq, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM lines),
  english AS (SELECT DISTINCT token FROM raw WHERE lang = 'en'),
  {stem_ctes('english')},
  tk AS MATERIALIZED (SELECT raw.conv_id, raw.label, raw.channel, raw.seq, raw.pos, CASE WHEN raw.lang = 'en' THEN stems.stem ELSE raw.token END AS token
         FROM raw LEFT JOIN stems ON raw.token = stems.token),
  docs AS (SELECT DISTINCT conv_id, label FROM lines)
"""
SQL_DOC_TOKENS = f"""
WITH {SQL_DOC_TK},
  tf AS (SELECT conv_id, channel, {SQL_SLOT.format(x='token')} AS slot, count(*) AS tf FROM tk GROUP BY ALL),
  m AS (SELECT count(*) AS m FROM docs),
  idf AS (SELECT channel, slot, count(*) AS df,
                 ln((m.m + 1.0) / (count(*) + 1.0)) AS idf,
                 ln((m.m + 1.0) / (count(*) + 1.0)) + 1.0 AS idf_smooth
          FROM tf, m GROUP BY channel, slot, m.m)
"""


def document_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, label, lang`` and both channels' complete token lists, cleaned in the row."""
    docs = document_channels(spark, sf_dir)
    return docs.select("conv_id", "label", "lang", *[F.transform(c, lambda x: tx.clean_tokens(x)).alias(c) for c in ft.CHANNEL_ORDER])


def raw_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.channel_list_tokens(document_lists(spark, sf_dir), carry=["label", "lang"])


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, label, lang, channel, seq, pos, token``: every token of the
    labelled documents, English ones stemmed (others as they are)."""
    return nz.normalize_tokens(raw_document_tokens(spark, sf_dir), unsupported="keep")


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, label`` of every labelled document, also of those without a token."""
    return document_channels(spark, sf_dir).select("conv_id", "label")


def document_weights(spark: SparkSession, sf_dir: str):
    """Documents, their term frequencies and the IDF table.

    The term frequencies (at most 400 rows a document) are written once; the
    output and the IDF both read them.  The token stream is not stored.
    """
    docs = document_ids(spark, sf_dir)
    tf = cut_lineage(ft.bucket_tf(document_tokens(spark, sf_dir)))
    return docs, tf, ft.idf_weights(tf, ft.document_count(docs))


@register("bucket_tf", oracle=SQL_DOC_TOKENS + "SELECT conv_id, channel, slot, tf FROM tf")
def q_bucket_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tf, _ = document_weights(spark, sf_dir)
    return tf.select("conv_id", "channel", "slot", "tf")


@register(
    "idf_weights",
    oracle=SQL_DOC_TOKENS + "SELECT channel, slot, df, round(idf, 6) AS idf, round(idf_smooth, 6) AS idf_smooth FROM idf",
)
def q_idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, idf = document_weights(spark, sf_dir)
    return idf.select("channel", "slot", "df", F.round("idf", 6).alias("idf"), F.round("idf_smooth", 6).alias("idf_smooth"))


@register(
    "tfidf",
    oracle=SQL_DOC_TOKENS
    + """SELECT tf.conv_id, tf.channel, tf.slot, tf.tf, round(tf.tf * idf.idf, 6) AS tfidf,
              round(tf.tf * idf.idf_smooth, 6) AS tfidf_smooth
       FROM tf JOIN idf USING (channel, slot)""",
)
def q_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tf, idf = document_weights(spark, sf_dir)
    out = ft.tfidf(tf, idf)
    return out.select("conv_id", "channel", "slot", "tf", F.round("tfidf", 6).alias("tfidf"), F.round("tfidf_smooth", 6).alias("tfidf_smooth"))


@register(
    "feature_vectors",
    oracle=SQL_DOC_TOKENS
    + """, w AS (SELECT tf.conv_id, CASE WHEN tf.channel = 'caller' THEN tf.slot ELSE 200 + tf.slot END AS slot,
                     tf.tf * idf.idf AS v FROM tf JOIN idf USING (channel, slot))
  SELECT docs.conv_id, docs.label, 400 AS width, CAST(w.slot AS INTEGER) AS slot, round(w.v, 6) AS value
  FROM docs LEFT JOIN w ON docs.conv_id = w.conv_id AND w.v <> 0""",
)
def q_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-zero slot of every document's 400-wide vector (a document
    without any has one row without a slot)."""
    docs, tf, idf = document_weights(spark, sf_dir)
    vec = ft.feature_vectors(ft.tfidf(tf, idf), docs, keep=["label"])
    slots = F.transform("features_array", lambda v, i: F.struct(i.alias("slot"), v.alias("value")))
    rows = vec.select("conv_id", "label", F.size("features_array").alias("width"), F.explode_outer(F.filter(slots, lambda s: s["value"] != 0)).alias("s"))
    return rows.select("conv_id", "label", "width", "s.slot", F.round("s.value", 6).alias("value"))


@register(
    "prefix_tf",
    oracle=f"""
WITH {sql_pairs(SQL_CONV_TURNS, SQL_TOKENS.format(x='text'))},
  tk AS (SELECT conv_id, seq, 'caller' AS channel, unnest(caller) AS token FROM p
         UNION ALL SELECT conv_id, seq, 'victim', unnest(victim) FROM p),
  ends AS (SELECT DISTINCT conv_id, seq AS prefix_no FROM p)
SELECT e.conv_id || '_' || CAST(e.prefix_no AS VARCHAR) AS prefix_id, e.conv_id, e.prefix_no, tk.channel,
       {SQL_SLOT.format(x='tk.token')} AS slot, count(*) AS tf
FROM ends e JOIN tk ON tk.conv_id = e.conv_id AND tk.seq <= e.prefix_no
GROUP BY ALL
""",
)
def q_prefix_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir).withColumn("tokens", tx.clean_tokens("text")).drop("text")
    pairs = asm.pair_turns(turns, value="tokens")
    return ft.prefix_tf(pairs)


def stemmed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, label, caller, victim``: each channel's tokens as one flat
    list, which MLlib's HashingTF needs (order does not matter to it)."""
    tokens = document_tokens(spark, sf_dir)
    side = lambda ch: F.collect_list(F.when(F.col("channel") == ch, F.col("token"))).alias(ch)  # noqa: E731  nulls are left out
    empty = document_ids(spark, sf_dir).select("conv_id", "label", F.lit(None).cast("string").alias("channel"), F.lit(None).cast("string").alias("token"))
    rows = tokens.select("conv_id", "label", "channel", "token").unionByName(empty)
    return rows.groupBy("conv_id", "label").agg(*[side(ch) for ch in ft.CHANNEL_ORDER])


def fitted_features(spark: SparkSession, sf_dir: str):
    docs = cut_lineage(stemmed_lists(spark, sf_dir))
    model = ft.feature_model(flatten=False).fit(docs)
    return model, model.transform(docs)


@register(
    "hashing_tf",
    oracle=f"""
WITH {SQL_DOC_TK}
SELECT d.conv_id, d.label, CAST(count(tk.token) FILTER (WHERE tk.channel = 'caller') AS DOUBLE) AS caller_tf_sum,
       CAST(count(tk.token) FILTER (WHERE tk.channel = 'victim') AS DOUBLE) AS victim_tf_sum, 200 AS width
FROM docs d LEFT JOIN tk ON tk.conv_id = d.conv_id GROUP BY d.conv_id, d.label
""",
)
def q_hashing_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLlib HashingTF counts: per channel the slot counts sum to the token count."""
    docs = stemmed_lists(spark, sf_dir)
    hashed = ft.hashing_model().transform(docs)
    total = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, v: a + v)
    return hashed.select("conv_id", "label", total("AH_features").alias("caller_tf_sum"), total("V_features").alias("victim_tf_sum"), F.size(vector_to_array("AH_features")).alias("width"))


@register("mllib_features")
def q_mllib_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-zero slot of the fitted MLlib TF-IDF pipeline (its hash slots
    differ from the MD5 slots of ``feature_vectors``)."""
    _, out = fitted_features(spark, sf_dir)
    slots = F.transform(vector_to_array("combined_features"), lambda v, i: F.struct(i.alias("slot"), v.alias("value")))
    rows = out.select("conv_id", "label", F.explode_outer(F.filter(slots, lambda s: s["value"] != 0)).alias("s"))
    return rows.select("conv_id", "label", "s.slot", F.round("s.value", 6).alias("value"))

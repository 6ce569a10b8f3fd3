"""Checked queries over vocabulary and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import features as ft
from parley.operators import normalize as nz
from parley.operators import sequences as sq
from parley.plans.features import SQL_DOC_TK, document_lists, raw_document_tokens
from parley.plans.registry import register
from parley.session import cut_lineage, stored

SQL_VOCAB = f"""
WITH {SQL_DOC_TK},
  wc AS (SELECT token, count(*) AS cnt FROM tk GROUP BY token),
  vocab AS (SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) AS INTEGER) AS idx FROM wc),
  enc AS (SELECT tk.conv_id, tk.channel, list(v.idx ORDER BY tk.seq, tk.pos) AS ids
          FROM tk JOIN vocab v USING (token) GROUP BY tk.conv_id, tk.channel),
  seqs AS (SELECT d.conv_id, d.label,
                  coalesce(c.ids, []::INTEGER[]) AS caller, coalesce(v.ids, []::INTEGER[]) AS victim
           FROM docs d LEFT JOIN enc c ON c.conv_id = d.conv_id AND c.channel = 'caller'
                       LEFT JOIN enc v ON v.conv_id = d.conv_id AND v.channel = 'victim')
"""


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, label, lang``, a number and both channels' token lists, cleaned
    and split once and written to the shared folder: the counts and the encoding
    read them.  The number stands for the id in the token stream."""
    return stored(document_lists(spark, sf_dir).withColumn("_d", F.monotonically_increasing_id()))


def raw_tokens(lists: DataFrame) -> DataFrame:
    return ft.channel_list_tokens(lists, doc="_d", carry=["lang"])


def document_sequences(spark: SparkSession, sf_dir: str):
    """The stemmed vocabulary and both channels of every document as its ids."""
    lists = document_words(spark, sf_dir)
    tokens = raw_tokens(lists)
    vocab, lookup = sq.stemmed_vocabulary(sq.family_counts(tokens))
    family = F.when(F.col("lang").isin(*nz.STEMMED_LANGUAGES), F.col("lang")).otherwise(F.lit("")).alias("family")
    encoded = sq.encode_sequences(tokens.select("*", family), lists.select("_d", "conv_id", "label"), lookup, doc="_d", carry=["conv_id", "label"], on=["family", "token"])
    return vocab, encoded.drop("_d")


@register("word_counts", oracle=SQL_VOCAB + "SELECT token, cnt FROM wc")
def q_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sq.family_counts(raw_document_tokens(spark, sf_dir))
    return nz.stem_families(counts).groupBy(F.col("stem").alias("token")).agg(F.sum("cnt").alias("cnt"))


@register("vocabulary", oracle=SQL_VOCAB + "SELECT token, cnt, idx FROM vocab")
def q_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.vocabulary(q_word_counts(spark, sf_dir))


@register("encode_sequences", oracle=SQL_VOCAB + "SELECT conv_id, label, to_json(caller) AS caller, to_json(victim) AS victim FROM seqs")
def q_encode_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, encoded = document_sequences(spark, sf_dir)
    return encoded.select("conv_id", "label", F.to_json("caller").alias("caller"), F.to_json("victim").alias("victim"))


@register(
    "sequence_stats",
    oracle=SQL_VOCAB
    + """SELECT max(len(caller)) AS max_len_caller, max(len(victim)) AS max_len_victim,
              greatest(max(len(caller)), max(len(victim))) AS max_len,
              (SELECT count(*) FROM wc) + 1 AS vocab_size FROM seqs""",
)
def q_sequence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab, encoded = document_sequences(spark, sf_dir)
    return sq.sequence_stats(encoded, vocab)


SQL_PAD = "list_concat(list_transform(range(greatest({w} - len({x}), 0)), lambda z: 0), {x}[greatest(len({x}) - {w}, 0) + 1:])"


@register(
    "pad_sequences",
    oracle=SQL_VOCAB
    + f""", wmax AS (SELECT CAST(greatest(max(len(caller)), max(len(victim))) AS BIGINT) AS w FROM seqs)
SELECT conv_id, label, to_json(list_concat({SQL_PAD.format(w='wmax.w', x='caller')}, {SQL_PAD.format(w='wmax.w', x='victim')})) AS ids,
       CAST(2 * wmax.w AS INTEGER) AS width
FROM seqs, wmax""",
)
def q_pad_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, encoded = document_sequences(spark, sf_dir)
    encoded = cut_lineage(encoded)  # read for the width and for the result
    width = encoded.select(F.greatest(F.max(F.size("caller")), F.max(F.size("victim")))).scalar()
    padded = sq.padded_sequences(encoded, width, carry=["label"])
    return padded.select("conv_id", "label", F.to_json("ids").alias("ids"), F.size("ids").alias("width"))

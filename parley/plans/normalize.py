"""Checked queries over token normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import greek
from parley.functions import text as tx
from parley.functions.stopwords import stop_word_sql
from parley.operators import languages as lg
from parley.operators import normalize as nz
from parley.operators import train as tr
from parley.plans.porter_sql import stem_ctes
from parley.plans.registry import SQL_TOKENS, register
from parley.sources.tables import scan_texts

SQL_ALL_TK = f"""
  t AS (SELECT CAST(doc_id AS VARCHAR) AS conv_id, lang, {SQL_TOKENS.format(x='text')} AS tokens FROM documents),
  tk AS MATERIALIZED (SELECT conv_id, lang, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM t)
"""


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, lang, tokens``: every document's cleaned tokens in one array."""
    docs = scan_texts(spark, sf_dir, "documents", ["doc_id", "lang", "text"], "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("conv_id"), "lang", tx.clean_tokens("text").alias("tokens"))


def all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one row per token: ``conv_id, lang, pos, token``."""
    return all_documents(spark, sf_dir).select("conv_id", "lang", F.posexplode("tokens").alias("pos", "token"))


@register(
    "remove_stopwords",
    oracle=f"""
WITH {SQL_ALL_TK},
  sw AS (SELECT DISTINCT lang, lower(word) AS word FROM {stop_word_sql()})
SELECT conv_id, CAST(pos AS INTEGER) AS pos, token FROM tk
WHERE NOT EXISTS (SELECT 1 FROM sw WHERE sw.lang = tk.lang AND sw.word = lower(tk.token))
""",
)
def q_remove_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token that stays, of every document: the anti-join on the table."""
    return nz.remove_stopwords(all_tokens(spark, sf_dir), nz.stop_word_table(spark)).select("conv_id", "pos", "token")


@register(
    "content_words",
    oracle=f"""
WITH {SQL_ALL_TK},
  sw AS (SELECT DISTINCT lang, lower(word) AS word FROM {stop_word_sql()}),
  k AS (SELECT conv_id, list(token ORDER BY pos) AS kept FROM tk
        WHERE NOT EXISTS (SELECT 1 FROM sw WHERE sw.lang = tk.lang AND sw.word = lower(tk.token)) GROUP BY conv_id)
SELECT t.conv_id, to_json(coalesce(k.kept, [])) AS tokens FROM t LEFT JOIN k ON k.conv_id = t.conv_id
""",
)
def q_content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same removal inside the row, as the feature path would use it."""
    docs = all_documents(spark, sf_dir)
    return docs.select("conv_id", F.to_json(nz.keep_content_words("tokens", "lang")).alias("tokens"))


@register(
    "detect_language",
    oracle=f"""
WITH {SQL_ALL_TK},
  sw AS (SELECT * FROM {stop_word_sql()}),
  h AS (SELECT conv_id, sw.lang, count(*) AS hits FROM tk JOIN sw ON tk.token = sw.word GROUP BY ALL),
  r AS (SELECT *, rank() OVER (PARTITION BY conv_id ORDER BY hits DESC) AS rk FROM h),
  b AS (SELECT conv_id, count(*) AS n_top, min(lang) AS lang, max(hits) AS hits FROM r WHERE rk = 1 GROUP BY conv_id)
SELECT t.conv_id, coalesce(CASE WHEN b.n_top = 1 THEN b.lang ELSE 'unknown' END, 'unknown') AS lang, coalesce(b.hits, 0) AS hits
FROM t LEFT JOIN b USING (conv_id)
""",
)
def q_detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.detect_language(all_documents(spark, sf_dir))


SQL_GRAMS = "flatten(list_transform({x}, lambda t: list_transform(range(1, length(t) + 1), lambda i: substr(' ' || t || ' ', i, 3))))"


@register(
    "detect_language_grams",
    oracle=f"""
WITH t AS MATERIALIZED (
    SELECT CAST(doc_id AS VARCHAR) AS conv_id, lang, {SQL_TOKENS.format(x='text')} AS tokens,
           ('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 80 AS train FROM documents),
  g AS MATERIALIZED (SELECT conv_id, lang, train, unnest({SQL_GRAMS.format(x='tokens')}) AS gram FROM t),
  c AS (SELECT lang, gram, count(*) AS cnt FROM g WHERE train AND lang IS NOT NULL GROUP BY ALL),
  n AS (SELECT lang, sum(cnt) + {lg.GRAMS} AS total FROM c GROUP BY lang),
  p AS (SELECT lang, gram, ln(cnt + 1.0::DOUBLE) AS weight FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, gram) <= {lg.GRAMS}),
  k AS (SELECT conv_id, count(*) AS n_grams FROM g GROUP BY conv_id),
  w AS (SELECT g.conv_id, p.lang, sum(p.weight) AS s FROM g JOIN p USING (gram) GROUP BY ALL),
  s AS (SELECT k.conv_id, n.lang, k.n_grams, coalesce(w.s, 0) - k.n_grams * ln(n.total::DOUBLE) AS score
        FROM k CROSS JOIN n LEFT JOIN w ON w.conv_id = k.conv_id AND w.lang = n.lang),
  r AS (SELECT *, lead(score) OVER (PARTITION BY conv_id ORDER BY score DESC, lang) AS second,
               row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, lang) AS place FROM s),
  b AS (SELECT conv_id, lang, n_grams, (score - second) / n_grams AS margin FROM r WHERE place = 1)
SELECT t.conv_id, CASE WHEN b.margin >= {lg.MARGIN} THEN b.lang ELSE 'unknown' END AS lang, round(b.margin, 6) AS lead, coalesce(b.n_grams, 0) AS n_grams
FROM t LEFT JOIN b USING (conv_id)
""",
)
def q_detect_language_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by trigram profiles, which four fifths of the
    documents (by hash of the id) and their given languages make up."""
    docs = all_documents(spark, sf_dir)
    profiles = lg.language_profiles(tr.split_dataset(docs).where("split = 'train'"))
    return lg.detect_language_by_grams(docs, profiles).withColumn("lead", F.round("lead", 6))


@register(
    "stem_vocabulary",
    oracle=f"WITH {SQL_ALL_TK}, english AS (SELECT DISTINCT token FROM tk WHERE lang = 'en'), {stem_ctes('english')} SELECT token, stem FROM stems",
)
def q_stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Porter stems of the distinct English tokens."""
    return nz.stem_vocabulary(all_tokens(spark, sf_dir)).select("token", "stem")


# Greek letters for the Latin ones: words of the corpus that the rules can work on.
LATIN, GREEK = "abgdezhqiklmnxoprstufcyw", "αβγδέζηθικλμνξοπρστυφχψω"
SQL_GREEK_STEM = "translate(lower(token), '" + greek.MARKED + "', '" + greek.PLAIN + "')"
for _pattern in greek.patterns():
    SQL_GREEK_STEM = f"regexp_replace({SQL_GREEK_STEM}, '{_pattern}', '\\1')"


@register(
    "stem_greek",
    oracle=f"""
WITH {SQL_ALL_TK},
  g AS (SELECT DISTINCT regexp_replace(translate(token, '{LATIN}', '{GREEK}'), 'σ$', 'ς') AS token FROM tk WHERE lang = 'en'),
  w AS (SELECT token, translate(lower(token), '{greek.MARKED}', '{greek.PLAIN}') AS word, {SQL_GREEK_STEM} AS stem FROM g)
SELECT token, CASE WHEN length(word) <= {greek.SHORT} THEN word ELSE stem END AS stem FROM w
""",
)
def q_stem_greek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greek stems of the distinct English tokens, spelt in Greek letters."""
    spelt = F.regexp_replace(F.translate("token", LATIN, GREEK), "σ$", "ς")
    tokens = all_tokens(spark, sf_dir).where("lang = 'en'").select(F.lit("el").alias("lang"), spelt.alias("token"))
    return nz.stem_vocabulary(tokens).select("token", "stem")


@register(
    "normalize_tokens",
    oracle=f"""WITH {SQL_ALL_TK}, english AS (SELECT DISTINCT token FROM tk WHERE lang = 'en'), {stem_ctes('english')}
SELECT tk.conv_id, CAST(tk.pos AS INTEGER) AS pos, stems.stem AS token FROM tk JOIN stems ON tk.token = stems.token WHERE tk.lang = 'en'""",
)
def q_normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every English document, stemmed."""
    return nz.normalize_tokens(all_tokens(spark, sf_dir), unsupported="skip").select("conv_id", "pos", "token")

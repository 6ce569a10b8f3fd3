"""Token normalisation: stop words, language vote, stemming.

* Stop words: left-anti join of ``(lang, lower(token))`` against the broadcast
  stop-word table (a few hundred words per language).
* Language vote: stop-word hits per language are counted inside the row; a tie
  at the top or no hit at all gives ``unknown``.
* Stemming: distinct ``(lang, token)`` pairs are stemmed once with the column
  expressions of :mod:`parley.functions.porter` and joined back on the token.
  The distinct vocabulary grows far slower than the token stream; the stems of
  its most frequent tokens are broadcast, and only rare tokens are shuffled to
  theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import greek, porter
from parley.functions.stopwords import LANGUAGES, UNKNOWN, stop_word_rows, stop_words
from parley.session import cut_lineage

STEMMED_LANGUAGES = ("en", "el")  # languages with a rule-based stemmer
MOST_BROADCAST = 50_000  # most frequent tokens whose stems are broadcast


def stop_word_table(spark: SparkSession, languages: Sequence[str] = tuple(LANGUAGES)) -> DataFrame:
    return spark.createDataFrame(stop_word_rows(tuple(languages)), "lang string, word string")


def remove_stopwords(tokens: DataFrame, stop_words: DataFrame, token: str = "token", lang: str = "lang") -> DataFrame:
    """Drop tokens that are stop words of their row's language (case-insensitive)."""
    sw = F.broadcast(stop_words.select(F.col("lang").alias("_sl"), F.lower("word").alias("_sw")).distinct())
    cond = (F.col(lang) == F.col("_sl")) & (F.lower(F.col(token)) == F.col("_sw"))
    return tokens.join(sw, cond, "left_anti")


def keep_content_words(tokens: str, lang: str, languages: Sequence[str] = tuple(LANGUAGES)) -> Column:
    """The same removal on a token array column: in the row, order kept.
    Rows of a language without a list keep every token."""
    out = F.col(tokens)
    for code in languages:
        words = sorted({w.lower() for w in stop_words(code)})
        out = F.when(F.col(lang) == code, F.filter(tokens, lambda t: ~F.lower(t).isin(words))).otherwise(out)
    return out


def language_vote(tokens: Column | str, languages: Sequence[str] = tuple(LANGUAGES)) -> tuple[Column, Column]:
    """``(lang, hits)`` of a token array: the language whose stop words occur
    most often; a tie at the top or no hit at all is ``unknown``."""
    hits = [F.size(F.filter(tokens, lambda t: t.isin(list(stop_words(code))))) for code in languages]
    most = F.greatest(*hits)
    first = F.coalesce(*[F.when(h == most, F.lit(code)) for h, code in zip(hits, languages)])
    ties = sum((F.when(h == most, 1).otherwise(0) for h in hits), F.lit(0))
    return F.when((most > 0) & (ties == 1), first).otherwise(F.lit(UNKNOWN)), most.cast("long")


def detect_language(docs: DataFrame, doc: str = "conv_id", tokens: str = "tokens", languages: Sequence[str] = tuple(LANGUAGES)) -> DataFrame:
    """``doc, lang, hits`` of documents with one token array each.

    Every language's hits are counted in the row, so there is no shuffle;
    documents without any token are ``unknown`` too.
    """
    hits = lambda code: F.size(F.filter(tokens, lambda t: t.isin(list(stop_words(code)))))
    votes = [F.struct(hits(code).alias("hits"), F.lit(code).alias("lang")) for code in languages]
    counted = docs.select(doc, F.array(*votes).alias("_votes")).select(doc, "_votes", F.array_max(F.transform("_votes", lambda v: v["hits"])).alias("hits"))
    top = F.filter("_votes", lambda v: v["hits"] == F.col("hits"))
    lang = F.when((F.col("hits") > 0) & (F.size(top) == 1), top[0]["lang"]).otherwise(F.lit(UNKNOWN))
    return counted.select(doc, lang.alias("lang"), F.col("hits").cast("long").alias("hits"))


def normalize_list(tokens: str, lang: Column | str) -> Column:
    """A token array with the tokens of the stemmed languages stemmed."""
    code = F.col(lang) if isinstance(lang, str) else lang
    return F.when(code == "en", porter.stem_tokens(tokens)).when(code == "el", greek.stem_tokens(tokens)).otherwise(F.col(tokens))


def stem_vocabulary(tokens: DataFrame, token: str = "token", lang: str | None = "lang") -> DataFrame:
    """Distinct ``(lang, token)`` -> ``stem`` for the stemmed languages (without
    ``lang`` all tokens count as one stemmed language)."""
    cols = [lang, token] if lang else [token]
    vocab = tokens.select(*cols).distinct()
    if lang:
        vocab = vocab.where(F.col(lang).isin(*STEMMED_LANGUAGES))
    return _stemmed(vocab, token, lang)


def _stemmed(words: DataFrame, token: str, lang: str | None) -> DataFrame:
    """``words`` (distinct, of stemmed languages) with ``stem``.  Every word
    passes the Porter steps, which leave other scripts alone; Greek words take
    the Greek cascade's result instead."""
    out = porter.stem_column(words, token, "stem")
    return out.withColumn("stem", F.when(F.col(lang) == "el", greek.stem(token)).otherwise(F.col("stem"))) if lang else out


def stem_families(counts: DataFrame) -> DataFrame:
    """Distinct ``(family, token)`` rows with ``stem``: tokens of a family that
    has a stemmer are stemmed, the others are their own stem.  The distinct
    tokens are written once, as both branches read them."""
    counts = cut_lineage(counts)
    stemmed = F.col("family").isin(*STEMMED_LANGUAGES)
    ruled = _stemmed(counts.where(stemmed), "token", "family")
    return ruled.unionByName(counts.where(~stemmed).withColumn("stem", F.col("token")))


def _looked_up(tokens: DataFrame, found: DataFrame, keys: list[str], supported: Column) -> DataFrame:
    """``tokens`` with the ``stem`` that ``found`` (``keys, stem, _cnt``) lists.

    The ``MOST_BROADCAST`` most frequent tokens are looked up where the stream
    is read.  Only the others are shuffled: none of them is frequent, so no
    task gets a hot key, and tokens without a stemmer stay where they are.
    """
    found = cut_lineage(found.select(*keys, "stem", "_cnt"))
    few = found.count() <= MOST_BROADCAST
    common = found if few else found.orderBy(F.desc("_cnt"), *keys).limit(MOST_BROADCAST)
    marked = tokens.join(F.broadcast(common.drop("_cnt")), keys, "left")
    if few:
        return marked
    rare = F.col("stem").isNull() & F.coalesce(supported, F.lit(False))
    return marked.where(~rare).unionByName(marked.where(rare).drop("stem").join(found.drop("_cnt"), keys, "left"))


def normalize_tokens(tokens: DataFrame, token: str = "token", lang: str = "lang", unsupported: str = "skip", stems: DataFrame | None = None) -> DataFrame:
    """Replace each token by its stem.

    ``stems(lang, token, stem)`` plugs in other languages (or other stems of
    the built-in ones): a language that occurs there is supported, and its
    tokens that are not listed stay as they are.  ``unsupported`` decides rows
    whose language has no stemmer: ``skip`` drops them, ``keep`` leaves the
    token as is, ``error`` fails the job.
    """
    if unsupported not in ("skip", "keep", "error"):
        raise ValueError("unsupported must be skip, keep or error")
    keys, codes, known = [lang, token], list(STEMMED_LANGUAGES), []
    if stems is not None:
        given = stems.where("token is not null").groupBy(F.col("lang").alias(lang), F.col("token").alias(token)).agg(F.min("stem").alias("stem"))
        # One row per language that the table knows.
        known = [r[0] for r in given.select(lang).distinct().collect() if r[0] is not None]
        codes += [code for code in known if code not in codes]
    supported = F.col(lang).isin(*codes)
    counts = tokens.where(supported).groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    found = _stemmed(counts.where(~F.col(lang).isin(*known)) if known else counts, token, lang)
    if known:
        found = found.unionByName(counts.join(given, keys))
    joined = _looked_up(tokens, found, keys, supported)
    if stems is not None:
        joined = joined.withColumn("stem", F.when(supported, F.coalesce("stem", token)))
    if unsupported == "skip":
        return joined.where(supported).withColumn(token, F.col("stem")).drop("stem")
    if unsupported == "error":
        checked = F.when(supported, F.col("stem")).otherwise(F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(F.col(lang), F.lit("null")))))
        return joined.withColumn(token, checked).drop("stem")
    return joined.withColumn(token, F.coalesce(F.col("stem"), F.col(token))).drop("stem")

"""Language detection by character n-grams.

A profile is a table of log-probabilities: for every language the ``GRAMS`` most
frequent trigrams of its words (with their borders), smoothed by one, and a
floor for all others.  A text's score per language is the sum over the trigrams
of its words; the language with the highest score is the text's, unless its
lead over the second, per trigram, is below ``MARGIN``: then it is ``unknown``.

Profiles have at most ``GRAMS`` rows a language, so they are broadcast, and a
text's trigrams meet them where the text was read; one row of sums per text is
shuffled.  Training counts trigrams map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.stopwords import UNKNOWN
from parley.session import cut_lineage

GRAMS = 3000
WIDTH = 3
MARGIN = 0.05  # nats per trigram


def word_grams(tokens: Column | str) -> Column:
    """All trigrams of all words of a token array, word borders as blanks.
    Words are short, so this is linear in the text."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substr(F.concat(F.lit(" "), t, F.lit(" ")), i, F.lit(WIDTH)))
    return F.flatten(F.transform(tokens, grams))


def language_profiles(docs: DataFrame, tokens: str = "tokens", lang: str = "lang", grams: int = GRAMS) -> DataFrame:
    """``lang, gram, weight, floor`` from texts of known languages: the
    trigram's log-probability above the floor of its language."""
    counted = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(word_grams(tokens)).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("cnt"))
    counted = cut_lineage(counted)
    total = counted.groupBy("lang").agg((F.sum("cnt") + grams).alias("total"))  # one row per language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cnt"), "gram"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= grams)
    return top.join(F.broadcast(total), "lang").select("lang", "gram", F.log(F.col("cnt") + 1.0).alias("weight"), (-F.log("total")).alias("floor"))


def detect_language_by_grams(docs: DataFrame, profiles: DataFrame, doc: str = "conv_id", tokens: str = "tokens", margin: float = MARGIN) -> DataFrame:
    """``doc, lang, lead, n_grams`` for every row of ``docs``.

    A text without words is ``unknown`` (null lead); with a single language in
    the profiles the lead is that over the floor.
    """
    floors = cut_lineage(profiles.groupBy("lang").agg(F.first("floor").alias("floor")))
    langs = [(r.lang, r.floor) for r in floors.orderBy("lang").collect()]  # one row per language
    if not langs:
        return docs.select(doc, F.lit(UNKNOWN).alias("lang"), F.lit(None).cast("double").alias("lead"), F.size(word_grams(tokens)).cast("long").alias("n_grams"))
    wide = profiles.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == code, F.col("weight"))), F.lit(0.0)).alias(f"w{i}") for i, (code, _) in enumerate(langs)])
    # Numbered before the trigrams are dealt out, so that a text keeps one number.
    numbered = docs.select(doc, tokens, F.monotonically_increasing_id().alias("_row"))
    rows = numbered.select(doc, "_row", F.explode_outer(word_grams(tokens)).alias("gram"))
    hits = rows.join(F.broadcast(wide), "gram", "left")
    # The id is a key, not a first(): a string buffer would sort every trigram row.
    sums = hits.groupBy("_row", doc).agg(F.count("gram").alias("n_grams"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(len(langs))])
    scores = F.array_sort(F.array(*[F.struct((-(F.col(f"s{i}") + F.col("n_grams") * F.lit(floor))).alias("score"), F.lit(code).alias("lang")) for i, (code, floor) in enumerate(langs)]))
    ranked = sums.select(doc, "n_grams", scores.alias("r"))
    second = F.coalesce(F.get("r", F.lit(1))["score"], -F.col("n_grams") * F.lit(min((f for _, f in langs), default=0.0)))
    lead = F.when(F.col("n_grams") > 0, (second - F.col("r")[0]["score"]) / F.col("n_grams"))
    out = ranked.select(doc, F.col("r")[0]["lang"].alias("_lang"), lead.alias("lead"), "n_grams")
    return out.select(doc, F.when(F.col("lead") >= margin, F.col("_lang")).otherwise(F.lit(UNKNOWN)).alias("lang"), "lead", "n_grams")

"""Features: term frequency, IDF, TF-IDF and the 400-wide feature vector
(M1-M6, A3, F8, F10, F11).

Two forms of the same computation:

* **Relational** (``bucket_tf`` -> ``idf_weights`` -> ``tfidf`` ->
  ``feature_vectors``): tokens stay exploded; term frequencies are a
  ``groupBy(doc, channel, slot)`` with map-side partial aggregation, so a hot
  conversation is pre-aggregated before the shuffle and each key ends with at
  most ``num_features`` rows per channel.  The IDF table has at most
  ``2 * num_features`` rows — a proven bound, so it is broadcast.
* **MLlib** (``feature_model``): ``HashingTF`` x2, ``IDF`` x2,
  ``VectorAssembler`` in a ``Pipeline``, for parity with saved pipelines.
  It needs each document's tokens as one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.schemas import CALLER, VICTIM

# Fixed values of the feature contract.
NUM_FEATURES = 200  # hash slots per channel
CHANNEL_ORDER = (CALLER, VICTIM)  # caller vector first, then victim


def token_slot(token: Column | str, num_features: int = NUM_FEATURES) -> Column:
    """Stable hash slot of a token: first 32 bits of its MD5, modulo the width."""
    t = F.col(token) if isinstance(token, str) else token
    return F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(num_features)).cast("int")


def channel_tokens(pairs: DataFrame, doc: str = "conv_id", channels: Sequence[str] = CHANNEL_ORDER, carry: Sequence[str] = ()) -> DataFrame:
    """Paired token lists -> one row per token: ``doc, seq, channel, token``."""
    stacked = F.explode(F.array(*[F.struct(F.lit(ch).alias("channel"), F.col(ch).alias("tokens")) for ch in channels])).alias("_c")
    per_channel = pairs.select(doc, "seq", *carry, stacked)
    return per_channel.select(doc, "seq", *carry, F.col("_c.channel").alias("channel"), F.explode("_c.tokens").alias("token"))


def channel_list_tokens(docs: DataFrame, doc: str = "conv_id", channels: Sequence[str] = CHANNEL_ORDER, carry: Sequence[str] = ()) -> DataFrame:
    """Complete utterance lists (``array<array<string>>`` per channel) -> one
    row per token: ``doc, carry, channel, seq, pos, token``."""
    stacked = F.explode(F.array(*[F.struct(F.lit(ch).alias("channel"), F.col(ch).alias("said")) for ch in channels])).alias("_c")
    lines = docs.select(doc, *carry, stacked).select(doc, *carry, F.col("_c.channel").alias("channel"), F.posexplode("_c.said").alias("seq", "_tokens"))
    return lines.select(doc, *carry, "channel", "seq", F.posexplode("_tokens").alias("pos", "token"))


def bucket_tf(tokens: DataFrame, doc: str = "conv_id", num_features: int = NUM_FEATURES, carry: Sequence[str] = ()) -> DataFrame:
    """Hashed term frequency in long form: ``doc, channel, slot, tf`` (counts; collisions add)."""
    return tokens.groupBy(doc, *carry, "channel", token_slot("token", num_features).alias("slot")).agg(F.count(F.lit(1)).alias("tf"))


def document_count(docs: DataFrame, doc: str = "conv_id") -> Column:
    """Number of documents, as a scalar subquery column."""
    return docs.select(F.countDistinct(doc)).scalar()


def idf_weights(tf: DataFrame, n_docs: Column, doc: str = "conv_id", min_doc_freq: int = 0) -> DataFrame:
    """Per ``(channel, slot)``: document frequency and ``ln((m+1)/(df+1))``.

    ``tf`` has one row per (doc, channel, slot) present, so ``df`` is a count.
    Slots under ``min_doc_freq`` get weight 0, like MLlib's IDF.
    """
    dfreq = tf.groupBy("channel", "slot").agg(F.count(F.lit(1)).alias("df"))
    m = n_docs.cast("double")
    idf = F.log((m + 1.0) / (F.col("df") + 1.0))
    return dfreq.select(
        "channel",
        "slot",
        "df",
        F.when(F.col("df") >= min_doc_freq, idf).otherwise(F.lit(0.0)).alias("idf"),
        (F.log((m + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf_smooth"),
    )


def tfidf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """``tf * idf`` and the smoothed variant ``tf * (ln((1+m)/(1+df)) + 1)``.

    The IDF side is at most channels x slots rows, so it is broadcast.
    """
    joined = tf.join(F.broadcast(idf.select("channel", "slot", "idf", "idf_smooth")), ["channel", "slot"])
    return joined.withColumn("tfidf", F.col("tf") * F.col("idf")).withColumn("tfidf_smooth", F.col("tf") * F.col("idf_smooth")).drop(
        "idf", "idf_smooth"
    )


def feature_vectors(
    weights: DataFrame,
    docs: DataFrame,
    doc: str = "conv_id",
    value: str = "tfidf",
    num_features: int = NUM_FEATURES,
    channels: Sequence[str] = CHANNEL_ORDER,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Long ``(doc, channel, slot, value)`` -> one ``channels x width``
    array and MLlib vector per document (caller slots first), and its non-zero
    ``entries``.

    ``docs`` (one row per document, with the ``keep`` columns) is united with
    the entries as rows without a slot, so one aggregate does it all and
    documents without tokens get an empty vector.  A document has at most
    ``len(channels) * num_features`` entries, so the collect is bounded.
    """
    offset = F.when(F.col("channel") == channels[0], F.lit(0))
    for i, ch in enumerate(channels[1:], start=1):
        offset = offset.when(F.col("channel") == ch, F.lit(i * num_features))
    width = len(channels) * num_features
    entry = F.struct((offset + F.col("slot")).cast("int").alias("k"), F.col(value).cast("double").alias("v"))
    empty = F.lit(None).cast("struct<k:int,v:double>")
    rows = weights.select(doc, entry.alias("_e")).unionByName(docs.select(doc, *keep, empty.alias("_e")), allowMissingColumns=True)
    carried = [F.max(c).alias(c) for c in keep]
    per_doc = rows.groupBy(doc).agg(*carried, F.array_sort(F.collect_list("_e")).alias("_es"))
    # The zeros between neighbouring entries, then the entry: linear in the width.
    filled = F.expr(
        "flatten(transform(_es, (e, i) -> concat(array_repeat(0D, e.k - if(i = 0, -1, _es[i - 1].k) - 1), array(e.v))))"
    )
    tail = F.expr(f"array_repeat(0D, {width} - 1 - if(size(_es) = 0, -1, element_at(_es, -1).k))")
    out = per_doc.select(doc, *keep, F.col("_es").alias("entries"), F.concat(filled, tail).alias("features_array"))
    return out.withColumn("features", array_to_vector("features_array"))


def prefix_tf(pairs: DataFrame, doc: str = "conv_id", num_features: int = NUM_FEATURES, channels: Sequence[str] = CHANNEL_ORDER) -> DataFrame:
    """Term frequencies of every conversation prefix without materialising it.

    Input: paired token lists (``doc, seq, caller, victim``).  Per-pair slot
    counts get a running sum over ``seq`` inside ``(doc, channel, slot)``; each
    sum holds until the slot's next pair (``lead``) or the document's last
    pair, so one ``sequence`` per sparse row fills the grid and no join fans
    out a hot document.  Output: ``prefix_id, doc, prefix_no, channel, slot,
    tf`` for every slot seen in the prefix (also for pairs without tokens).
    """
    tokens = channel_tokens(pairs, doc, channels)
    per_pair = tokens.groupBy(doc, "seq", "channel", token_slot("token", num_features).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    last = pairs.groupBy(doc).agg(F.max("seq").alias("_last"))
    w = Window.partitionBy(doc, "channel", "slot").orderBy("seq")
    summed = per_pair.select(doc, "seq", "channel", "slot", F.sum("n").over(w).alias("tf"), F.lead("seq").over(w).alias("_next"))
    until = F.coalesce(F.col("_next") - 1, F.col("_last"))
    filled = summed.join(last, doc).select(doc, "channel", "slot", "tf", F.explode(F.sequence("seq", until)).alias("_k"))
    return filled.select(
        F.concat_ws("_", F.col(doc), F.col("_k").cast("string")).alias("prefix_id"), doc, F.col("_k").cast("int").alias("prefix_no"), "channel", "slot", "tf"
    )


# --- MLlib form -------------------------------------------------------------


def flatten_stage(column: str) -> SQLTransformer:
    """Flatten ``array<array<string>>`` in place; saved pipelines need no Python class."""
    return SQLTransformer(
        statement=f"SELECT * EXCEPT ({column}), flatten(filter(coalesce({column}, array()), x -> x IS NOT NULL)) AS {column} FROM __THIS__"
    )


def feature_model(
    caller_col: str = CALLER,
    victim_col: str = VICTIM,
    num_features: int = NUM_FEATURES,
    flatten: bool = True,
    min_doc_freq: int = 0,
) -> Pipeline:
    """Training pipeline: flatten x2 (optional), HashingTF x2, IDF x2, assembler -> 400."""
    stages = []
    if flatten:
        stages += [flatten_stage(caller_col), flatten_stage(victim_col)]
    stages += [
        HashingTF(inputCol=caller_col, outputCol="AH_features", numFeatures=num_features, binary=False),
        HashingTF(inputCol=victim_col, outputCol="V_features", numFeatures=num_features, binary=False),
        IDF(inputCol="AH_features", outputCol="AH_tfidf_features", minDocFreq=min_doc_freq),
        IDF(inputCol="V_features", outputCol="V_tfidf_features", minDocFreq=min_doc_freq),
        VectorAssembler(inputCols=["AH_tfidf_features", "V_tfidf_features"], outputCol="combined_features", handleInvalid="error"),
    ]
    return Pipeline(stages=stages)


def hashing_model(caller_col: str = CALLER, victim_col: str = VICTIM, num_features: int = NUM_FEATURES) -> PipelineModel:
    """The two HashingTF stages alone; they need no fit."""
    return PipelineModel(stages=[HashingTF(inputCol=c, outputCol=o, numFeatures=num_features, binary=False) for c, o in ((caller_col, "AH_features"), (victim_col, "V_features"))])


def serving_model(fitted: PipelineModel) -> PipelineModel:
    """The fitted training pipeline without its flatten stages, for messages
    whose channels are already flat ``array<string>``."""
    return PipelineModel(stages=[s for s in fitted.stages if not isinstance(s, SQLTransformer)])

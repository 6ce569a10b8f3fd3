"""Vocabulary-encoded sequences.

The vocabulary ranks every token by count (ties by token), ids from 1.  The
rank is distributed: a range partitioning by (count, token), row numbers
inside each partition and one offset per partition.  Which ids an encoder
emits can be limited (``num_words``); the vocabulary itself never is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.assemble import LIST_CHUNK
from parley.operators.normalize import STEMMED_LANGUAGES, stem_families
from parley.schemas import CALLER, VICTIM
from parley.session import cut_lineage

# Fixed values of the sequence contract.
FIRST_ID = 1  # id 0 is padding


def word_counts(tokens: DataFrame) -> DataFrame:
    """Token counts over every channel (the channels' corpora unioned)."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


def family_counts(tokens: DataFrame) -> DataFrame:
    """``family, token, cnt`` of a raw token stream with its ``lang``: counted
    once, map-side.  A family is a language with a stemmer; all other languages
    are the family ``''``, whose tokens stand for themselves."""
    family = F.when(F.col("lang").isin(*STEMMED_LANGUAGES), F.col("lang")).otherwise(F.lit(""))
    return tokens.groupBy(family.alias("family"), "token").agg(F.count(F.lit(1)).alias("cnt"))


def stemmed_vocabulary(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vocabulary over the stems of ``family_counts``, and the lookup
    ``family, token, idx`` from raw tokens straight to ids.

    Everything here works on distinct tokens: each is stemmed once, and the
    token stream later meets one table instead of a stem table and a vocabulary.
    """
    stemmed = cut_lineage(stem_families(counts))
    vocab = vocabulary(stemmed.groupBy(F.col("stem").alias("token")).agg(F.sum("cnt").alias("cnt")))
    ids = vocab.select(F.col("token").alias("stem"), "idx")
    return vocab, cut_lineage(stemmed.join(ids, "stem").select("family", "token", "idx"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """``token, cnt, idx`` of every token; id 1 is the most frequent one.

    The ranged rows are written to the shared folder once, so numbering and
    offsets see the same partitions even if an executor is lost in between.
    """
    order = [F.desc("cnt"), F.asc("token")]
    ranged = cut_lineage(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits of the id are the partition, the lower 33 the row in it.
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", offset.alias("_off"))
    numbered = ranged.withColumn("_part", part).withColumn("_row", row).join(offsets, "_part")
    return numbered.select("token", "cnt", (F.col("_off") + F.col("_row") + FIRST_ID).cast("int").alias("idx"))


def encode_sequences(
    tokens: DataFrame,
    docs: DataFrame,
    vocab: DataFrame,
    doc: str = "conv_id",
    channels: Sequence[str] = (CALLER, VICTIM),
    carry: Sequence[str] = (),
    num_words: int | None = None,
    chunk: int = LIST_CHUNK,
    on: Sequence[str] = ("token",),
) -> DataFrame:
    """Each channel's tokens (all utterances in ``seq`` order) as vocabulary ids.

    ``tokens`` has ``doc, channel, seq, pos, token``; ``docs`` one row per
    document with the ``carry`` columns.  Tokens are looked up by an equi-join
    that AQE broadcasts only if the vocabulary measures small, collected per
    ``chunk`` utterances and then put together, so only the finished list of a
    document meets in one row.  Unknown tokens, and ids from ``num_words`` on
    when it is given, drop out; a channel without known tokens gets ``[]``.
    ``on`` names the lookup's key columns.
    """
    known = vocab.select(*on, "idx")
    if num_words is not None:
        known = known.where(F.col("idx") < num_words)
    hits = tokens.select(doc, "channel", "seq", "pos", *on).join(known, list(on))
    parts = hits.groupBy(doc, "channel", F.floor(F.col("seq") / chunk).alias("_part")).agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "idx"))).alias("_ids"))
    packed = F.struct("channel", "_part", F.transform("_ids", lambda x: x["idx"]).alias("ids")).alias("_p")
    empty = F.lit(None).cast("struct<channel:string,_part:bigint,ids:array<int>>").alias("_p")
    rows = parts.select(doc, packed).unionByName(docs.select(doc, *carry, empty), allowMissingColumns=True)
    out = rows.groupBy(doc).agg(*[F.max(c).alias(c) for c in carry], F.array_sort(F.collect_list("_p")).alias("_ps"))
    side = lambda ch: F.flatten(F.transform(F.filter("_ps", lambda p: p["channel"] == F.lit(ch)), lambda p: p["ids"]))
    return out.select(doc, *carry, *[side(ch).alias(ch) for ch in channels])


def encode_messages(messages: DataFrame, vocab: DataFrame, width: int, channels: Sequence[str] = (CALLER, VICTIM), num_words: int | None = None) -> DataFrame:
    """Messages with one word list per channel as padded id sequences: every
    other column plus ``ids`` (``len(channels) * width`` of them).

    Words are looked up as in ``encode_sequences``, so live ids equal those the
    training data got; unknown words, and ids from ``num_words`` on, drop out.
    A message without a known word, or with null lists, is all padding.  Each
    row of ``messages`` gives one row, whatever its keys.
    """
    keep = [c for c in messages.columns if c not in channels]
    known = vocab.select(F.col("token").alias("_token"), "idx")
    if num_words is not None:
        known = known.where(F.col("idx") < num_words)
    words = lambda k, ch: F.transform(F.coalesce(F.col(ch), F.array().cast("array<string>")), lambda t, i: F.struct(F.lit(k).alias("ch"), i.alias("pos"), t.alias("token")))
    numbered = messages.withColumn("_m", F.monotonically_increasing_id())
    rows = numbered.select("_m", F.struct(*keep).alias("_keep"), F.explode_outer(F.concat(*[words(k, ch) for k, ch in enumerate(channels)])).alias("_w"))
    hits = rows.join(known, F.col("_w.token") == F.col("_token"), "left")
    found = F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("_w.ch", "_w.pos", "idx"))))
    out = hits.groupBy("_m").agg(F.first("_keep").alias("_keep"), found.alias("_found"))
    side = lambda k: F.transform(F.filter("_found", lambda x: x["ch"] == k), lambda x: x["idx"])
    padded = F.concat(*[_pad(side(k), F.lit(width)) for k in range(len(channels))])
    return out.select(*[F.col(f"_keep.{c}").alias(c) for c in keep], padded.alias("ids"))


def id_weights(encoded: DataFrame, num_words: int, channels: Sequence[str] = (CALLER, VICTIM), label: str = "label") -> tuple[list[float], float]:
    """A linear model over ids from labelled sequences: per id the log ratio of
    its smoothed shares in both classes (``num_words`` numbers, id 0 is 0), and
    the log ratio of the classes.  At most ``num_words`` rows reach the driver.
    """
    import math

    ids = encoded.select(label, F.explode(F.concat(*channels)).alias("idx")).where(F.col("idx") < num_words)
    one, other = (F.count_if(F.col(label) == k).alias(f"c{k}") for k in (1, 0))
    counts = ids.groupBy("idx").agg(one, other).collect()
    n1, n0 = (sum(r[c] for r in counts) + num_words for c in ("c1", "c0"))
    weights = [0.0] * num_words
    for r in counts:
        weights[r.idx] = math.log((r.c1 + 1) / n1) - math.log((r.c0 + 1) / n0)
    docs = encoded.agg(one, other).first()
    return weights, math.log((docs.c1 + 1) / (docs.c0 + 1))


def sequence_stats(encoded: DataFrame, vocab_tokens: DataFrame, channels: Sequence[str] = (CALLER, VICTIM)) -> DataFrame:
    """Longest sequence per channel and overall, and the vocabulary size
    (distinct tokens + 1 for the padding id)."""
    lens = encoded.agg(*[F.max(F.size(ch)).alias(f"max_len_{ch}") for ch in channels])
    vocab_size = vocab_tokens.select(F.countDistinct("token")).scalar() + 1
    return lens.select(
        *[F.col(f"max_len_{ch}") for ch in channels],
        F.greatest(*[F.col(f"max_len_{ch}") for ch in channels]).alias("max_len"),
        vocab_size.alias("vocab_size"),
    )


def padded_sequences(encoded: DataFrame, width, doc: str = "conv_id", channels: Sequence[str] = (CALLER, VICTIM), carry: Sequence[str] = ()) -> DataFrame:
    """Pad/truncate each channel to ``width`` (zeros in front, last ids kept)
    and concatenate the channels: ``ids`` has ``len(channels) * width`` ids.
    ``width`` may be an int or a scalar Column (e.g. the longest sequence)."""
    w = width if not isinstance(width, int) else F.lit(width)
    parts = [_pad(F.col(ch), w) for ch in channels]
    return encoded.select(doc, *carry, F.concat(*parts).alias("ids"))


def _pad(ids, width):
    n = F.size(ids)
    keep = F.slice(ids, F.greatest(n - width, F.lit(0)) + 1, width)
    zeros = F.array_repeat(F.lit(0), F.greatest(width - n, F.lit(0)))
    return F.concat(zeros, keep)

"""Table scans and the derived turn tables every other operator starts from.

* ``conversation_turns``: the ``conversations`` table as utterances — role
  ``assistant`` is the caller side, ``user`` the victim, ``system`` dropped.
* ``document_channels``: a labelled two-channel corpus from ``documents``
  (odd lines caller, even lines victim) joined to ``labels`` (label =
  ``quality``), with both complete line lists in the row.

Scans are plain parquet reads, so Catalyst pushes filters and prunes columns
into ``ReadSchema``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.schemas import CALLER, VICTIM

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed role mapping of the conversations table.
ROLE_TO_CHANNEL = {"assistant": CALLER, "user": VICTIM}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Session setting: number of partitions that scans of long texts are dealt
# into.  Unset (the default) scans keep their file splits; the bench and tests
# set it because their tables are single row groups.
SCAN_PARTITIONS = "spark.parley.scanPartitions"


def scan_texts(spark: SparkSession, sf_dir: str, name: str, columns: list[str], key: str) -> DataFrame:
    """A column-pruned scan, dealt by ``key`` when the session asks for it."""
    df = load_table(spark, sf_dir, name).select(*columns)
    parts = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(parts), key) if parts else df


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id string, turn long, channel string, text string``."""
    conv = load_table(spark, sf_dir, "conversations")
    channel = F.when(F.col("role") == "assistant", F.lit(CALLER)).when(F.col("role") == "user", F.lit(VICTIM))
    return conv.where(F.col("role").isin(*ROLE_TO_CHANNEL)).select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        channel.alias("channel"),
        F.col("text"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents ⋈ labels`` on ``doc_id``; the join strategy is left to AQE,
    which turns it into a broadcast join only when the label side measures
    under the broadcast threshold at run time."""
    docs = scan_texts(spark, sf_dir, "documents", ["doc_id", "text", "lang", "n_chars"], "doc_id")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id")


def document_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as two-channel conversations, one row each:
    ``conv_id, label, lang, caller, victim``.

    Lines alternate: line 1, 3, 5, ... are the caller's, line 2, 4, ... the
    victim's.  Both lists are complete, whether or not they are equally long.
    A null text is one empty line, as an empty text is.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    every = lambda k: F.filter(lines, lambda x, i: i % 2 == F.lit(k))  # noqa: E731  one pass over the lines
    return labelled_documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("conv_id"),
        F.col("quality").cast("int").alias("label"),
        "lang",
        every(0).alias(CALLER),
        every(1).alias(VICTIM),
    )


def document_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as turns: ``conv_id, label, lang, turn, channel, text``."""
    docs = document_channels(spark, sf_dir)
    sides = F.explode(F.array(*[F.struct(F.lit(ch).alias("channel"), F.lit(k).alias("k"), F.col(ch).alias("lines")) for k, ch in enumerate((CALLER, VICTIM))])).alias("s")
    lines = docs.select("conv_id", "label", "lang", sides).select("conv_id", "label", "lang", "s.channel", "s.k", F.posexplode("s.lines").alias("seq", "text"))
    return lines.select("conv_id", "label", "lang", (F.col("seq") * 2 + F.col("k")).cast("long").alias("turn"), "channel", "text")


def document_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional pairs of the two-channel documents, built inside each row and
    truncated to the shorter side: ``conv_id, seq, caller, victim, label``.

    Linear in the lines: both lists are zipped and generated, without a
    window, join or shuffle.
    """
    docs = document_channels(spark, sf_dir)
    zipped = F.posexplode(F.arrays_zip(CALLER, VICTIM)).alias("seq", "p")
    # Only the longer (caller) side can miss a partner, in its last line.
    return docs.select("conv_id", "label", F.size(VICTIM).alias("n"), zipped).where("seq < n").select("conv_id", "seq", f"p.{CALLER}", f"p.{VICTIM}", "label")

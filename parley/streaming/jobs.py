"""Structured Streaming operators.

Live flow: two channel sources (JSON lines or Kafka) -> watermarks ->
stream-stream equi-join on ``(conv_id, seq)`` (J2) -> stateful growing
transcript per conversation (X6) -> serving features -> model -> verdict ->
alert / audit sinks.  Every query has a checkpoint below the shared
``spark.checkpoint.dir`` so it restarts where it stopped after a failure;
sinks are idempotent per batch id.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from parley.operators import evaluate as ev
from parley.operators.assemble import channel_ordinal
from parley.schemas import CALLER, CHANNEL_MESSAGE, MESSAGE, VICTIM
from parley.session import scratch_path
from parley.streaming.transcripts import stream_running_transcript  # noqa: F401  (part of this module's interface)

# Fixed values of the streaming contract.
EVENT_TIME_BASE = 1_700_000_000  # seconds; event times stay far from epoch 0
SECONDS_PER_TURN = 5
DEFAULT_WATERMARK = "10 minutes"


# --- sources ----------------------------------------------------------------


CORRUPT = "_corrupt_record"


def read_message_stream(
    spark: SparkSession,
    path: str,
    schema=MESSAGE,
    fmt: str = "json",
    options: dict | None = None,
    keep_malformed: bool = False,
) -> DataFrame:
    """JSON-lines (files) or Kafka source with a fixed schema.

    For Kafka, ``options`` carries ``kafka.bootstrap.servers`` / ``subscribe``;
    the value is parsed with ``from_json`` and expanded to columns.  With
    ``keep_malformed`` a line that does not parse is kept with its raw text in
    ``_corrupt_record`` (and null fields), so it can be counted or routed
    instead of silently dropped.
    """
    opts = options or {}
    if fmt == "kafka":
        return parse_messages(spark.readStream.format("kafka").options(**opts).load(), schema, keep_malformed)
    if keep_malformed:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    reader = spark.readStream.schema(schema).options(**opts)
    if keep_malformed:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.format(fmt).load(path)


def parse_messages(raw: DataFrame, schema=MESSAGE, keep_malformed: bool = False) -> DataFrame:
    """The ``value`` of Kafka-shaped rows as the columns of ``schema``; with
    ``keep_malformed`` also the raw text of lines that do not parse."""
    text = F.col("value").cast("string")
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    parsed = raw.select(F.from_json(text, full, {"columnNameOfCorruptRecord": CORRUPT}).alias("data"), text.alias("_raw"))
    bad = F.when(F.col("data").isNull() | F.col(f"data.{CORRUPT}").isNotNull(), F.col("_raw"))
    columns = [F.col(f"data.{f.name}").alias(f.name) for f in schema.fields]
    return parsed.select(*columns, *([bad.alias(CORRUPT)] if keep_malformed else []))


def split_malformed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, malformed)`` halves of a stream read with ``keep_malformed``."""
    bad = F.col(CORRUPT).isNotNull()
    # The raw text travels with a parsed column: Spark refuses raw-file
    # queries that reference the corrupt-record column alone.
    return messages.where(~bad).drop(CORRUPT), messages.where(bad).select("conv_id", CORRUPT)


def write_channel_messages(turns: DataFrame, folder: str, value: str = "text") -> None:
    """Producer side: one JSON-lines folder per channel with ``conv_id, seq,
    event_ts, text``; ``seq`` is the per-channel ordinal assigned here, since
    streams cannot number rows."""
    ordered = channel_ordinal(turns)
    out = ordered.select(
        "conv_id",
        F.col("seq").cast("long").alias("seq"),
        F.timestamp_seconds(F.lit(EVENT_TIME_BASE) + F.col("turn") * SECONDS_PER_TURN).alias("event_ts"),
        F.col(value).alias("text"),
        "channel",
    )
    out.write.mode("overwrite").partitionBy("channel").json(folder)


def read_channel_stream(spark: SparkSession, folder: str, channel: str) -> DataFrame:
    """One channel's messages that parse (``read_message_stream`` with
    ``keep_malformed`` and ``split_malformed`` also gives the others)."""
    return split_malformed(read_message_stream(spark, f"{folder}/channel={channel}", schema=CHANNEL_MESSAGE, keep_malformed=True))[0]


# --- operators --------------------------------------------------------------


def stream_pair_turns(caller: DataFrame, victim: DataFrame, watermark: str = DEFAULT_WATERMARK, bound: str | None = None) -> DataFrame:
    """k-th caller message with k-th victim message.

    Without ``bound`` (default) a message waits for its partner as long as it
    takes, as the batch pairing does; nothing is lost, and the join state grows
    with the messages still waiting.  With ``bound`` the state is limited: a
    message whose partner is further away in event time leaves the join when
    the watermark has passed, as a row with a null side (``split_unpaired``)
    instead of vanishing.
    """
    if bound is None:
        c, v = caller.alias("c"), victim.alias("v")
        joined = c.join(v, (F.col("c.conv_id") == F.col("v.conv_id")) & (F.col("c.seq") == F.col("v.seq")), "inner")
    else:
        c, v = caller.withWatermark("event_ts", watermark).alias("c"), victim.withWatermark("event_ts", watermark).alias("v")
        cond = (
            (F.col("c.conv_id") == F.col("v.conv_id"))
            & (F.col("c.seq") == F.col("v.seq"))
            & (F.col("c.event_ts") >= F.col("v.event_ts") - F.expr(f"INTERVAL {bound}"))
            & (F.col("c.event_ts") <= F.col("v.event_ts") + F.expr(f"INTERVAL {bound}"))
        )
        joined = c.join(v, cond, "full_outer")
    return joined.select(
        F.coalesce("c.conv_id", "v.conv_id").alias("conv_id"),
        F.coalesce("c.seq", "v.seq").alias("seq"),
        F.greatest("c.event_ts", "v.event_ts").alias("event_ts"),
        F.col("c.text").alias(CALLER),
        F.col("v.text").alias(VICTIM),
        F.col("c.seq").isNotNull().alias("has_caller"),
        F.col("v.seq").isNotNull().alias("has_victim"),
    )


def split_unpaired(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pairs, rejects)`` of ``stream_pair_turns``: rejects never met a partner."""
    both = F.col("has_caller") & F.col("has_victim")
    return pairs.where(both).drop("has_caller", "has_victim"), pairs.where(~both)


def stream_score(messages: DataFrame, serving, model) -> DataFrame:
    """Stateless serving features + MLlib model + verdict on a stream.

    Models with a probability decide by it; models without one (a linear SVM)
    by their own prediction, with a null confidence and their margin.
    """
    scored = model.transform(serving.transform(messages))
    return ev.decide(scored, [c for c in ("conv_id", "seq") if c in messages.columns])


def stream_alerts(scored: DataFrame) -> DataFrame:
    """The scored rows that raise an alert."""
    return scored.where("alert")


# --- sinks and lifecycle ----------------------------------------------------


def audit_sink(output_path: str, audit_path: str, score: Callable[[DataFrame], DataFrame] | None = None):
    """foreachBatch handler: scored rows and one audit row per batch.

    ``score`` scores the batch first (external models, X3); without it the
    batch is scored already.  The batch is computed once, by writing it, and not
    kept: the counters are taken from three columns of what was written, so
    they also say what is stored.  Both writes replace the ``batch_id=<n>``
    folder, so a batch that is replayed after a failure replaces its own output
    and gives the same counts again.  A batch without rows leaves nothing (P9).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        received = datetime.now(timezone.utc)
        spark, folder = batch.sparkSession, f"{output_path}/batch_id={batch_id}"
        scored = score(batch) if score else batch
        scored.write.mode("overwrite").parquet(folder)
        written = spark.read.schema(scored.schema).parquet(folder).select("prediction", "alert", "probability")
        audit = written.agg(
            F.lit(batch_id).cast("long").alias("batch_id"),
            F.lit(received).alias("received_at"),
            F.current_timestamp().alias("scored_at"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("prediction") == 1).alias("n_scam"),
            F.count_if("alert").alias("n_alerts"),
            F.max("probability").alias("max_probability"),
        ).where("n_rows > 0")
        audit.coalesce(1).write.mode("overwrite").parquet(f"{audit_path}/batch_id={batch_id}")
        if spark.read.schema(audit.schema).parquet(f"{audit_path}/batch_id={batch_id}").isEmpty():
            for empty in (folder, f"{audit_path}/batch_id={batch_id}"):
                path = spark._jvm.org.apache.hadoop.fs.Path(empty)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # just written, without rows

    return handle


class ProgressLog(StreamingQueryListener):
    """Keeps the latest progress reports of the session's queries (X7):
    ``spark.streams.addListener(ProgressLog())``."""

    def __init__(self, keep: int = 100):
        self.reports: deque[dict] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.reports.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_stream(df: DataFrame, name: str, sink_path: str | None = None, foreach_batch=None, available_now: bool = True, processing_time: str | None = None):
    """Start a query with a checkpoint under the shared checkpoint folder.

    ``available_now`` drains what is there and stops (tests, backfills);
    ``processing_time`` runs continuously.  Returns the started query.
    """
    ckpt = scratch_path(df.sparkSession, "streams", name, "checkpoint")
    writer = df.writeStream.outputMode("append").option("checkpointLocation", ckpt)
    if foreach_batch is not None:
        writer = writer.foreachBatch(foreach_batch)
    else:
        writer = writer.format("parquet").option("path", sink_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time or "5 seconds")
    return writer.queryName(name.replace("/", "_")).start()


@dataclass(frozen=True)
class ScoringConfig:
    """Which scoring path a live run uses (X9): ``mllib`` models score inside
    the stream; ``external`` models (numpy/ONNX predict functions) score in
    ``foreachBatch`` with a batched UDF, and so do ``sequences`` models, which
    take padded vocabulary ids instead of features.  Validated before anything
    starts."""

    model_kind: str
    path: str = "mllib"

    MLLIB = ("logistic_regression", "random_forest", "gbt", "linear_svc", "mlp")

    def validate(self) -> ScoringConfig:
        if not isinstance(self.model_kind, str):
            raise TypeError("model kind must be a string")
        if self.path not in ("mllib", "external", "sequences"):
            raise ValueError(f"unknown scoring path {self.path!r}")
        if self.path == "mllib" and self.model_kind not in self.MLLIB:
            raise ValueError(f"{self.model_kind!r} is not an MLlib model; use path='external'")
        return self


def external_scorer(predict_factory, width: int = 400) -> Callable[[DataFrame], DataFrame]:
    """Batch scorer for a model outside MLlib (X3): features stay on the
    executors and are scored in Arrow batches; nothing is collected."""
    from parley.operators.score import score_with_model, with_verdict

    def score(batch: DataFrame) -> DataFrame:
        scored = with_verdict(score_with_model(batch, predict_factory, input_col="features_array", width=width))
        return scored.drop("features_array").withColumn("alert", ev.is_alert())

    return score


SEQUENCE_WIDTH = 383  # fixed value: ids per channel of a live sequence


def sequence_scorer(vocabulary_path: str, predict_factory, width: int = SEQUENCE_WIDTH, num_words: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Batch scorer for a model over id sequences (X3): the messages' words are
    joined with the stored vocabulary, put back together and padded per message,
    and scored in Arrow batches.

    The vocabulary is read anew for every batch, so one that was replaced while
    the query rested is picked up without a restart.
    """
    from parley.operators.score import score_with_model, with_verdict
    from parley.operators.sequences import encode_messages
    from parley.sources.io import read_vocabulary

    def score(batch: DataFrame) -> DataFrame:
        encoded = encode_messages(batch, read_vocabulary(batch.sparkSession, vocabulary_path), width, num_words=num_words)
        scored = with_verdict(score_with_model(encoded, predict_factory, input_col="ids", width=2 * width))
        return scored.withColumn("alert", ev.is_alert())

    return score


def start_scoring(config: ScoringConfig, messages: DataFrame, serving, name: str, output_path: str, audit_path: str, model=None, predict_factory=None, vocabulary_path: str | None = None, width: int = SEQUENCE_WIDTH, num_words: int | None = None):
    """Start the scoring path that ``config`` chooses, all with the audit sink.

    ``mllib`` scores in the stream with ``model``; ``external`` computes the
    serving features in the stream and scores each batch with
    ``predict_factory``; ``sequences`` encodes each batch with the vocabulary
    under ``vocabulary_path`` and scores the padded ids.
    """
    from pyspark.ml.functions import vector_to_array

    config.validate()
    if config.path == "mllib":
        if model is None:
            raise ValueError("the mllib path needs a model")
        return run_stream(stream_score(messages, serving, model), name, foreach_batch=audit_sink(output_path, audit_path))
    if predict_factory is None:
        raise ValueError(f"the {config.path} path needs a predict factory")
    if config.path == "sequences":
        if vocabulary_path is None:
            raise ValueError("the sequences path needs a vocabulary")
        wanted = messages.select("conv_id", "seq", CALLER, VICTIM)
        return run_stream(wanted, name, foreach_batch=audit_sink(output_path, audit_path, sequence_scorer(vocabulary_path, predict_factory, width, num_words)))
    features = serving.transform(messages).select("conv_id", "seq", vector_to_array("combined_features").alias("features_array"))
    return run_stream(features, name, foreach_batch=audit_sink(output_path, audit_path, external_scorer(predict_factory)))

"""Streaming queries (X1-X9, J2), each run to completion with ``availableNow``
and read back, so they can be compared with their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import features as ft
from parley.operators import normalize as nz
from parley.operators import sequences as sq
from parley.operators import train as tr
from parley.plans.conversation import ORACLE_PREFIXES
from parley.functions.stopwords import stop_word_sql
from parley.plans.features import fitted_features
from parley.plans.porter_sql import stem_ctes
from parley.plans.registry import SQL_CONV_TURNS, SQL_DOC_TURNS, SQL_TOKENS, register, sql_pairs
from parley.plans.sequences import document_sequences
from parley.session import cut_lineage, scratch_path
from parley.sources import io
from parley.sources.tables import conversation_turns
from parley.streaming import jobs


def _workdir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def _paired_stream(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    jobs.write_channel_messages(conversation_turns(spark, sf_dir), f"{root}/in")
    caller = jobs.read_channel_stream(spark, f"{root}/in", "caller")
    victim = jobs.read_channel_stream(spark, f"{root}/in", "victim")
    return jobs.split_unpaired(jobs.stream_pair_turns(caller, victim))[0]


def _drain(df: DataFrame, root: str, name: str) -> DataFrame:
    q = jobs.run_stream(df, name=f"{root.rsplit('/', 1)[-1]}", sink_path=f"{root}/out")
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{root}/out")


@register("stream_pair_turns", oracle=f"WITH {sql_pairs(SQL_CONV_TURNS, 'text')} SELECT conv_id, seq, caller, victim FROM p")
def q_stream_pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _workdir(spark, "pair")
    out = _drain(_paired_stream(spark, sf_dir, root), root, "pair")
    return out.select("conv_id", F.col("seq").cast("int").alias("seq"), "caller", "victim")


SQL_BOUNDED = f"""
WITH {sql_pairs(SQL_CONV_TURNS, 'text')}
SELECT coalesce(c.conv_id, v.conv_id) AS conv_id, coalesce(c.seq, v.seq) AS seq, c.v AS caller, v.v AS victim,
       c.seq IS NOT NULL AND v.seq IS NOT NULL AS paired
FROM (SELECT * FROM s WHERE channel = 'caller') c FULL JOIN (SELECT * FROM s WHERE channel = 'victim') v ON c.conv_id = v.conv_id AND c.seq = v.seq
"""
END = "~end"  # a conversation whose late messages move the watermark past all others


@register("stream_pair_turns_bounded", oracle=SQL_BOUNDED)
def q_stream_pair_turns_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairing with bounded state: messages whose partner does not come
    within the bound leave the join as rejects once the watermark has passed."""
    root = _workdir(spark, "bounded")
    late = spark.createDataFrame([(END, 1_000_000, ch, "") for ch in ("caller", "victim")], "conv_id string, turn long, channel string, text string")
    jobs.write_channel_messages(conversation_turns(spark, sf_dir).unionByName(late), f"{root}/in")
    caller, victim = (jobs.read_channel_stream(spark, f"{root}/in", ch) for ch in ("caller", "victim"))
    out = _drain(jobs.stream_pair_turns(caller, victim, bound="1 hour"), root, "bounded").where(F.col("conv_id") != END)
    pairs, rejects = jobs.split_unpaired(out)
    columns = ["conv_id", F.col("seq").cast("int").alias("seq"), "caller", "victim"]
    return pairs.select(*columns, F.lit(True).alias("paired")).unionByName(rejects.select(*columns, F.lit(False).alias("paired")))


@register("stream_running_transcript", oracle=ORACLE_PREFIXES)
def q_stream_running_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _workdir(spark, "transcript")
    pairs = _paired_stream(spark, sf_dir, root)
    tokens = pairs.select("conv_id", "seq", "event_ts", tx.clean_tokens("caller").alias("caller"), tx.clean_tokens("victim").alias("victim"))
    out = _drain(jobs.stream_running_transcript(tokens), root, "transcript")
    return out.select("prefix_id", "conv_id", "prefix_no", "caller", "victim")


def _served(spark: SparkSession, sf_dir: str, root: str):
    """The serving pipeline and the classifier, fitted, stored and loaded back
    as a live run would load them."""
    fitted, features = fitted_features(spark, sf_dir)
    model = tr.train("logistic_regression", tr.split_dataset(features).where(F.col("split") == "train"))
    io.save_model(ft.serving_model(fitted), f"{root}/serving")
    io.save_model(model, f"{root}/model")
    return io.load_model(f"{root}/serving"), tr.ModelRegistry({"logistic_regression": f"{root}/model"}).load("logistic_regression")


def _message_stream(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Live messages: paired turns -> language vote and stems -> growing
    transcript -> flat word lists of both channels so far (the producer's
    message shape)."""
    pairs = _paired_stream(spark, sf_dir, root)
    tokens = pairs.select("conv_id", "seq", "event_ts", tx.clean_tokens("caller").alias("caller"), tx.clean_tokens("victim").alias("victim"))
    voted = tokens.withColumn("lang", nz.language_vote(F.concat("caller", "victim"))[0])
    stemmed = voted.select("conv_id", "seq", "event_ts", *[nz.normalize_list(c, "lang").alias(c) for c in ("caller", "victim")])
    grown = jobs.stream_running_transcript(stemmed)
    return grown.select(
        "conv_id",
        F.col("prefix_no").cast("long").alias("seq"),
        F.flatten(F.from_json("caller", "array<array<string>>")).alias("caller"),
        F.flatten(F.from_json("victim", "array<array<string>>")).alias("victim"),
    )


@register("stream_score")
def q_stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the live conversation stream with the MLlib model: serving
    features -> model -> verdict and alert, through the idempotent audit
    sink.  Returns the scored rows."""
    root = _workdir(spark, "score")
    serving, model = _served(spark, sf_dir, root)
    config = jobs.ScoringConfig("logistic_regression")
    q = jobs.start_scoring(config, _message_stream(spark, sf_dir, root), serving, root.rsplit("/", 1)[-1], f"{root}/scored", f"{root}/audit", model=model)
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/scored")
    return out.select("conv_id", "seq", "prediction", "verdict", F.round("confidence", 6).alias("confidence"), "alert")


@register("stream_score_external")
def q_stream_score_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the same stream with an external (numpy) model in foreachBatch.
    The external model is the fitted regression's weights, so its verdicts
    equal the MLlib path's."""
    from parley.plans.models import _logistic_predictor

    root = _workdir(spark, "external")
    serving, model = _served(spark, sf_dir, root)
    make = _logistic_predictor(model.coefficients.toArray().tolist(), float(model.intercept))
    config = jobs.ScoringConfig("numpy_logistic", path="external")
    q = jobs.start_scoring(config, _message_stream(spark, sf_dir, root), serving, root.rsplit("/", 1)[-1], f"{root}/scored", f"{root}/audit", predict_factory=make)
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/scored")
    return out.select("conv_id", "seq", "prediction", "verdict", F.round("confidence", 6).alias("confidence"), "alert")


NUM_WORDS = 10_000  # fixed value: ids below it are scored
_W = jobs.SEQUENCE_WIDTH
_PAD = "list_concat(list_transform(range(greatest({w} - len({x}), 0)), lambda z: 0), {x}[greatest(len({x}) - {w}, 0) + 1:])"

SQL_STREAM_SEQUENCES = f"""
WITH {sql_pairs(SQL_CONV_TURNS, SQL_TOKENS.format(x='text'))},
  lines AS MATERIALIZED (SELECT conv_id, label, lang, channel, turn // 2 AS seq, {SQL_TOKENS.format(x='text')} AS tokens FROM ({SQL_DOC_TURNS}) t),
  raw AS MATERIALIZED (SELECT conv_id, label, lang, channel, seq, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM lines),
  said AS MATERIALIZED (
    SELECT conv_id, seq, 'caller' AS channel, unnest(caller) AS token, generate_subscripts(caller, 1) AS pos FROM p UNION ALL
    SELECT conv_id, seq, 'victim', unnest(victim), generate_subscripts(victim, 1) FROM p),
  hits AS (SELECT conv_id, seq, sw.lang, count(*) AS hits FROM said JOIN (SELECT * FROM {stop_word_sql()}) sw ON said.token = sw.word GROUP BY ALL),
  best AS (SELECT *, rank() OVER (PARTITION BY conv_id, seq ORDER BY hits DESC) AS rk FROM hits),
  vote AS (SELECT conv_id, seq, CASE WHEN count(*) = 1 THEN min(lang) END AS lang FROM best WHERE rk = 1 GROUP BY ALL),
  spoken AS MATERIALIZED (SELECT said.*, vote.lang FROM said LEFT JOIN vote USING (conv_id, seq)),
  english AS (SELECT token FROM raw WHERE lang = 'en' UNION SELECT token FROM spoken WHERE lang = 'en'),
  {stem_ctes('english')},
  tk AS MATERIALIZED (SELECT raw.conv_id, raw.label, raw.channel, raw.seq, raw.pos, CASE WHEN raw.lang = 'en' THEN stems.stem ELSE raw.token END AS token
         FROM raw LEFT JOIN stems ON raw.token = stems.token),
  wc AS (SELECT token, count(*) AS cnt FROM tk GROUP BY token),
  vocab AS MATERIALIZED (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) AS INTEGER) AS idx FROM wc QUALIFY idx < {NUM_WORDS}),
  nb AS (SELECT v.idx, count(*) FILTER (label = 1) AS c1, count(*) FILTER (label = 0) AS c0 FROM tk JOIN vocab v USING (token) GROUP BY v.idx),
  total AS (SELECT sum(c1) + {NUM_WORDS} AS n1, sum(c0) + {NUM_WORDS} AS n0 FROM nb),
  weight AS MATERIALIZED (SELECT idx, ln((c1 + 1) / n1::DOUBLE) - ln((c0 + 1) / n0::DOUBLE) AS w FROM nb, total),
  prior AS (SELECT ln((count(*) FILTER (label = 1) + 1) / (count(*) FILTER (label = 0) + 1)::DOUBLE) AS b FROM (SELECT DISTINCT conv_id, label FROM lines)),
  known AS MATERIALIZED (SELECT spoken.conv_id, spoken.seq, spoken.channel, spoken.pos, v.idx
    FROM spoken LEFT JOIN stems ON spoken.token = stems.token JOIN vocab v ON v.token = CASE WHEN spoken.lang = 'en' THEN stems.stem ELSE spoken.token END),
  sent AS (SELECT p.conv_id, p.seq, coalesce(list(k.idx ORDER BY k.seq, k.pos) FILTER (k.channel = 'caller'), []::INTEGER[]) AS caller,
                  coalesce(list(k.idx ORDER BY k.seq, k.pos) FILTER (k.channel = 'victim'), []::INTEGER[]) AS victim
           FROM p LEFT JOIN known k ON k.conv_id = p.conv_id AND k.seq <= p.seq GROUP BY p.conv_id, p.seq),
  padded AS (SELECT conv_id, seq, list_concat({_PAD.format(w=_W, x='caller')}, {_PAD.format(w=_W, x='victim')}) AS ids FROM sent),
  z AS (SELECT conv_id, seq, (SELECT b FROM prior) + coalesce((SELECT sum(w) FROM (SELECT unnest(ids) AS idx) u JOIN weight USING (idx)), 0) AS z, ids FROM padded),
  scored AS (SELECT conv_id, seq, ids, 1 / (1 + exp(-least(greatest(z, -30), 30))) AS p FROM z)
SELECT conv_id, CAST(seq AS BIGINT) AS seq, to_json(ids) AS ids, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction,
       CASE WHEN p > 0.5 THEN 'scam' ELSE 'normal' END AS verdict, round(greatest(p, 1 - p), 6) AS confidence, p > 0.85 AS alert
FROM scored
"""


def _id_predictor(weights: list[float], intercept: float):
    """An external model over padded ids: a sum of id weights."""
    import numpy as np

    w = np.asarray(weights)

    def make():
        def predict(ids):
            z = np.clip(w[ids.astype(np.int64)].sum(axis=1) + intercept, -30, 30)
            return 1 / (1 + np.exp(-z))

        return predict

    return make


@register("stream_score_sequences", oracle=SQL_STREAM_SEQUENCES)
def q_stream_score_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the live messages by a model over id sequences: the vocabulary and
    the id weights come from the labelled documents, the vocabulary is stored
    and joined with each batch's words."""
    root = _workdir(spark, "sequences")
    vocab, encoded = document_sequences(spark, sf_dir)
    io.write_vocabulary(vocab, f"{root}/vocabulary")
    weights, intercept = sq.id_weights(cut_lineage(encoded), NUM_WORDS)
    config = jobs.ScoringConfig("id_weights", path="sequences")
    messages = _message_stream(spark, sf_dir, root)
    q = jobs.start_scoring(config, messages, None, root.rsplit("/", 1)[-1], f"{root}/scored", f"{root}/audit", predict_factory=_id_predictor(weights, intercept), vocabulary_path=f"{root}/vocabulary", num_words=NUM_WORDS)
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/scored")
    return out.select("conv_id", "seq", F.to_json("ids").alias("ids"), "prediction", "verdict", F.round("confidence", 6).alias("confidence"), "alert")

"""Checked queries over evaluation and decisions.

Metric twins use a fixed rule scorer on ``documents ⋈ labels`` so they do not
depend on training: model ``rule_T`` predicts scam when ``n_chars > T`` with
probability ``n_chars / (n_chars + T)`` (> 0.5 exactly when ``n_chars > T``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import evaluate as ev
from parley.operators import train as tr
from parley.plans.registry import register
from parley.sources.tables import labelled_documents, load_table

# Fixed scorer thresholds (characters).
RULE_THRESHOLDS = (500, 1000, 2000)


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, conv_id, label, prediction, probability`` for every rule."""
    docs = labelled_documents(spark, sf_dir).select("doc_id", "n_chars", "quality")
    rules = F.explode(F.array(*[F.lit(t) for t in RULE_THRESHOLDS])).alias("t")
    per_rule = docs.select("*", rules)
    n = F.col("n_chars").cast("double")
    return per_rule.select(
        F.concat(F.lit("rule_"), F.col("t").cast("string")).alias("model"),
        F.col("doc_id").cast("string").alias("conv_id"),
        F.col("quality").cast("int").alias("label"),
        F.when(F.col("n_chars") > F.col("t"), 1).otherwise(0).alias("prediction"),
        (n / (n + F.col("t"))).alias("probability"),
    )


SQL_SCORES = """
WITH s AS (
  SELECT 'rule_' || CAST(v.t AS VARCHAR) AS model, CAST(d.doc_id AS VARCHAR) AS conv_id, CAST(l.quality AS INTEGER) AS label,
         CASE WHEN d.n_chars > v.t THEN 1 ELSE 0 END AS prediction,
         CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + v.t) AS probability
  FROM documents d JOIN labels l USING (doc_id), (VALUES (500), (1000), (2000)) v(t)),
c AS (SELECT model, label AS actual, prediction AS predicted, count(*) AS n FROM s GROUP BY ALL),
tot AS (SELECT model, sum(n) AS total, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS hit FROM c GROUP BY model),
pc AS (SELECT a.model, a.cls, a.n_actual, coalesce(p.n_pred, 0) AS n_pred, coalesce(t.tp, 0) AS tp, tot.total, tot.hit
       FROM (SELECT model, actual AS cls, sum(n) AS n_actual FROM c GROUP BY ALL) a
       LEFT JOIN (SELECT model, predicted AS cls, sum(n) AS n_pred FROM c GROUP BY ALL) p USING (model, cls)
       LEFT JOIN (SELECT model, actual AS cls, n AS tp FROM c WHERE actual = predicted) t USING (model, cls)
       JOIN tot USING (model)),
pr AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS p,
                 CASE WHEN n_actual > 0 THEN tp / n_actual ELSE 0 END AS r FROM pc),
m AS (SELECT model, any_value(hit / total) AS accuracy,
             sum(n_actual / total * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f1,
             sum(n_actual / total * p) AS wp, sum(n_actual / total * r) AS wr FROM pr GROUP BY model),
ml AS (SELECT model, 'accuracy' AS metric, accuracy AS value FROM m
       UNION ALL SELECT model, 'f1', f1 FROM m
       UNION ALL SELECT model, 'weightedPrecision', wp FROM m
       UNION ALL SELECT model, 'weightedRecall', wr FROM m)
"""


def rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.classification_metrics(ev.confusion_counts(rule_scores(spark, sf_dir)))


@register("classification_metrics", oracle=SQL_SCORES + "SELECT model, metric, round(value, 6) AS value FROM ml")
def q_classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_metrics(spark, sf_dir).withColumn("value", F.round("value", 6))


@register(
    "confusion_matrix",
    oracle=SQL_SCORES
    + """SELECT g.model, g.actual, g.predicted, coalesce(c.n, 0) AS n
         FROM (SELECT DISTINCT model FROM c) mm, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) cell(actual, predicted),
              LATERAL (SELECT mm.model AS model, cell.actual AS actual, cell.predicted AS predicted) g
         LEFT JOIN c USING (model, actual, predicted)""",
)
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_matrix(ev.confusion_counts(rule_scores(spark, sf_dir)))


@register(
    "binary_f1",
    oracle=SQL_SCORES
    + """, b AS (SELECT model,
                sum(CASE WHEN round_even(probability, 0) = 1 AND label = 1 THEN 1 ELSE 0 END) AS tp,
                sum(CASE WHEN round_even(probability, 0) = 1 AND label = 0 THEN 1 ELSE 0 END) AS fp,
                sum(CASE WHEN round_even(probability, 0) = 0 AND label = 1 THEN 1 ELSE 0 END) AS fn FROM s GROUP BY model),
       q AS (SELECT model, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
                    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM b)
  SELECT model, 'precision' AS metric, round(pr, 6) AS value FROM q
  UNION ALL SELECT model, 'recall', round(rc, 6) FROM q
  UNION ALL SELECT model, 'f1score', round(2 * (pr * rc) / (pr + rc + 1e-7), 6) FROM q""",
)
def q_binary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.binary_f1(rule_scores(spark, sf_dir)).withColumn("value", F.round("value", 6))


@register(
    "log_loss",
    oracle=SQL_SCORES
    + """SELECT model, 'val_loss' AS metric,
              round(avg(-(label * ln(least(greatest(probability, 1e-7), 1 - 1e-7))
                         + (1 - label) * ln(1 - least(greatest(probability, 1e-7), 1 - 1e-7)))), 6) AS value
       FROM s GROUP BY model""",
)
def q_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.log_loss(rule_scores(spark, sf_dir)).withColumn("value", F.round("value", 6))


@register(
    "compare_models",
    oracle=SQL_SCORES
    + """SELECT model, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1,
              round(wp, 6) AS "weightedPrecision", round(wr, 6) AS "weightedRecall" FROM m""",
)
def q_compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ev.compare_models(rule_metrics(spark, sf_dir))
    return wide.select("model", *[F.round(m, 6).alias(m) for m in ev.MULTICLASS_METRICS])


@register(
    "best_model",
    oracle=SQL_SCORES + "SELECT model, metric, round(value, 6) AS value FROM ml WHERE metric = 'accuracy' ORDER BY value DESC, model LIMIT 1",
)
def q_best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.best_model(rule_metrics(spark, sf_dir)).withColumn("value", F.round("value", 6))


@register(
    "misclassified",
    oracle=SQL_SCORES + "SELECT model, conv_id, label, prediction, round(probability, 6) AS probability FROM s WHERE prediction <> label",
)
def q_misclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.misclassified(rule_scores(spark, sf_dir), columns=["model", "conv_id", "label", "prediction", "probability"])
    return out.withColumn("probability", F.round("probability", 6))


@register(
    "verdict",
    oracle=SQL_SCORES
    + """SELECT model, conv_id, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction,
              CASE WHEN probability > 0.5 THEN 'scam' ELSE 'normal' END AS verdict,
              round(CASE WHEN probability > 0.5 THEN probability ELSE 1 - probability END, 6) AS confidence
       FROM s""",
)
def q_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    prediction, verdict, confidence = ev.verdict("probability")
    return rule_scores(spark, sf_dir).select("model", "conv_id", prediction, verdict, F.round(confidence, 6).alias("confidence"))


@register(
    "alerts",
    oracle=SQL_SCORES + "SELECT model, conv_id, label, round(probability, 6) AS probability FROM s WHERE prediction = 1 AND probability > 0.85",
)
def q_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.alerts(rule_scores(spark, sf_dir)).select("model", "conv_id", "label", F.round("probability", 6).alias("probability"))


@register(
    "split_counts",
    oracle="""
SELECT CASE WHEN CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS INTEGER) < 80
            THEN 'train' ELSE 'test' END AS split,
       CAST(quality AS INTEGER) AS label, count(*) AS n
FROM documents JOIN labels USING (doc_id) GROUP BY ALL
""",
)
def q_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = labelled_documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("conv_id"), F.col("quality").cast("int").alias("label"))
    return ev.split_counts(tr.split_dataset(docs))


def transcript_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser events derived from ``conversations``: per turn one partial
    hypothesis (first word, not final) and one final result whose
    alternatives are the text and its lowercase form; system turns end with an
    empty final result."""
    conv = load_table(spark, sf_dir, "conversations")
    device = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2)
    partial = F.struct(F.lit(0).alias("k"), F.lit(False).alias("is_final"), F.array(F.split(F.col("text"), " ")[0]).alias("alternatives"))
    final_alts = F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(F.array(F.col("text"), F.lower("text")))
    final = F.struct(F.lit(1).alias("k"), F.lit(True).alias("is_final"), final_alts.alias("alternatives"))
    ev_rows = conv.select(
        F.col("conv_id").cast("string").alias("conv_id"), device.cast("int").alias("device"), "turn", F.explode(F.array(partial, final)).alias("e")
    )
    return ev_rows.select("conv_id", "device", (F.col("turn") * 2 + F.col("e.k")).cast("long").alias("seq"), "e.is_final", "e.alternatives")


@register(
    "final_transcripts",
    oracle="""
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CASE role WHEN 'assistant' THEN 0 ELSE 1 END AS device,
       CAST(turn * 2 + 1 AS BIGINT) AS seq, text AS transcript
FROM conversations WHERE role IN ('assistant', 'user')
""",
)
def q_final_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.final_transcripts(transcript_events(spark, sf_dir)).select("conv_id", "device", "seq", "transcript")

"""Evaluation, verdicts and reports.

All metrics of a scored frame come from one ``groupBy(model, label,
prediction)`` aggregate — at most ``models x classes^2`` rows — instead of
one job per metric.  Everything downstream of that aggregate works on a tiny
table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the decision and metric contract.
VERDICT_THRESHOLD = 0.5  # strict >: scam
ALERT_THRESHOLD = 0.85  # strict >: alert
ALERT_MARGIN = 1.0  # strict >: alert of a model without probabilities (outside the SVM's margin)
EPSILON = 1e-7  # guard in F1 and log-loss clipping
SCAM = "scam"
NORMAL = "normal"
MULTICLASS_METRICS = ("accuracy", "f1", "weightedPrecision", "weightedRecall")


def confusion_counts(scored: DataFrame, label: str = "label", prediction: str = "prediction", model: str = "model") -> DataFrame:
    """``model, actual, predicted, n`` for the combinations that occur."""
    return scored.groupBy(
        F.col(model).alias("model"),
        F.col(label).cast("int").alias("actual"),
        F.col(prediction).cast("int").alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Zero-filled matrix in long form: rows = actual, columns = predicted."""
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted")) for a in classes for p in classes])
    full = counts.select("model").distinct().select("model", F.explode(cells).alias("c")).select("model", "c.actual", "c.predicted")
    return full.join(counts, ["model", "actual", "predicted"], "left").select(
        "model", "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def classification_metrics(counts: DataFrame) -> DataFrame:
    """accuracy, f1 (weighted), weightedPrecision, weightedRecall per model.

    Per class c: precision = tp/predicted (0 when nothing is predicted c),
    recall = tp/actual, f1 = 2pr/(p+r) (0 when p+r = 0); weights = actual/total.
    """
    c = counts
    total = c.groupBy("model").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    actual = c.groupBy("model", F.col("actual").alias("cls")).agg(F.sum("n").alias("n_actual"))
    predicted = c.groupBy("model", F.col("predicted").alias("cls")).agg(F.sum("n").alias("n_pred"))
    tp = c.where(F.col("actual") == F.col("predicted")).select("model", F.col("actual").alias("cls"), F.col("n").alias("tp"))
    per_class = (
        actual.join(predicted, ["model", "cls"], "left")
        .join(tp, ["model", "cls"], "left")
        .join(total, "model")
        .fillna(0, ["n_pred", "tp"])
    )
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("n_actual") > 0, F.col("tp") / F.col("n_actual")).otherwise(0.0)
    per_class = per_class.withColumn("p", prec).withColumn("r", rec)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    weight = F.col("n_actual") / F.col("total")
    agg = per_class.groupBy("model").agg(
        F.first(F.col("hit") / F.col("total")).alias("accuracy"),
        F.sum(weight * f1).alias("f1"),
        F.sum(weight * F.col("p")).alias("weightedPrecision"),
        F.sum(weight * F.col("r")).alias("weightedRecall"),
    )
    return _long(agg, MULTICLASS_METRICS)


def binary_f1(scored: DataFrame, label: str = "label", probability: str = "probability", model: str = "model") -> DataFrame:
    """Precision, recall and ``2pr/(p+r+eps)`` on probabilities rounded
    half-to-even; counts are summed, so batches can be unioned first."""
    pred = F.rint(F.col(probability))
    y = F.col(label).cast("double")
    agg = scored.groupBy(F.col(model).alias("model")).agg(
        F.sum(F.when((pred == 1) & (y == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((pred == 1) & (y == 0), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((pred == 0) & (y == 1), 1).otherwise(0)).alias("fn"),
    )
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = agg.select("model", p.alias("precision"), r.alias("recall"))
    out = out.withColumn("f1score", 2 * (F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall") + F.lit(EPSILON)))
    return _long(out, ("precision", "recall", "f1score"))


def log_loss(scored: DataFrame, label: str = "label", probability: str = "probability", model: str = "model") -> DataFrame:
    """Mean binary cross-entropy with probabilities clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(F.col(probability), F.lit(EPSILON)), F.lit(1 - EPSILON))
    y = F.col(label).cast("double")
    out = scored.groupBy(F.col(model).alias("model")).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("val_loss"))
    return _long(out, ("val_loss",))


def split_counts(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


def compare_models(evaluations: DataFrame, metrics: Sequence[str] = MULTICLASS_METRICS) -> DataFrame:
    """``model, metric, value`` -> one row per model, one column per metric."""
    return evaluations.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def best_model(evaluations: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Top-1 model by a metric; ties go to the smaller model name."""
    return evaluations.where(F.col("metric") == metric).orderBy(F.desc("value"), F.asc("model")).limit(1)


def misclassified(
    scored: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    columns: Sequence[str] = ("conv_id", "label", "prediction", "probability"),
) -> DataFrame:
    return scored.where(F.col(prediction) != F.col(label).cast(scored.schema[prediction].dataType)).select(*columns)


def verdict(probability: Column | str) -> tuple[Column, Column, Column]:
    """``(prediction, verdict, confidence)``: scam when p > 0.5 (confidence p),
    else normal (confidence 1 - p).  Confidence stays in [0, 1]."""
    p = F.col(probability) if isinstance(probability, str) else probability
    is_scam = p > F.lit(VERDICT_THRESHOLD)
    return (
        F.when(is_scam, 1).otherwise(0).alias("prediction"),
        F.when(is_scam, F.lit(SCAM)).otherwise(F.lit(NORMAL)).alias("verdict"),
        F.when(is_scam, p).otherwise(1 - p).alias("confidence"),
    )


def is_alert(probability: str = "probability") -> Column:
    return F.coalesce(F.col(probability) > F.lit(ALERT_THRESHOLD), F.lit(False))


def decide(predicted: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` + ``prediction, verdict, confidence, probability, margin, alert``
    of an MLlib model's output.

    With probabilities the thresholds decide.  Without (linear SVM) the model's
    own prediction does: probability and confidence are null, and an alert
    needs a margin beyond ``ALERT_MARGIN``.
    """
    margin = vector_to_array("rawPrediction")[1] if "rawPrediction" in predicted.columns else F.lit(None).cast("double")
    if "probability" in predicted.columns:
        out = predicted.select(*keep, vector_to_array("probability")[1].alias("probability"), margin.alias("margin"))
        prediction, said, confidence = verdict("probability")
        return out.select(*keep, prediction, said, confidence, "probability", "margin", is_alert().alias("alert"))
    scam = F.col("prediction") == 1
    none = F.lit(None).cast("double")
    return predicted.select(
        *keep,
        F.col("prediction").cast("int").alias("prediction"),
        F.when(scam, F.lit(SCAM)).otherwise(F.lit(NORMAL)).alias("verdict"),
        none.alias("confidence"),
        none.alias("probability"),
        margin.alias("margin"),
        (scam & (margin > F.lit(ALERT_MARGIN))).alias("alert"),
    )


def alerts(scored: DataFrame, prediction: str = "prediction", probability: str = "probability") -> DataFrame:
    """Scam predictions above the alert threshold."""
    return scored.where((F.col(prediction) == 1) & (F.col(probability) > F.lit(ALERT_THRESHOLD)))


def final_transcripts(events: DataFrame) -> DataFrame:
    """Keep final recognition results that have an alternative; take the first."""
    return events.where(F.col("is_final") & (F.size("alternatives") > 0)).withColumn("transcript", F.element_at("alternatives", 1))


def grid_report(spark: SparkSession, cv_model, metric_name: str | None = None) -> DataFrame:
    """Average cross-validation metric per grid point, best first.

    ``avgMetrics`` has one value per parameter map (a handful); the report is
    built from that small list."""
    points = [{p.name: v for p, v in m.items()} for m in cv_model.getEstimatorParamMaps()]
    return search_report(spark, list(zip(points, cv_model.avgMetrics)), metric_name)


def search_report(spark: SparkSession, points: Sequence[tuple[dict, float]], metric_name: str | None = None) -> DataFrame:
    """The same report from ``(settings, average metric)`` per grid point."""
    rows = [(i, ", ".join(f"{k}={v}" for k, v in sorted(m.items())), float(score)) for i, (m, score) in enumerate(points)]
    df = spark.createDataFrame(rows, "grid_point int, params string, avg_metric double")
    best = max(rows, key=lambda r: (r[2], -r[0]))[0] if rows else -1
    df = df.withColumn("is_best", F.col("grid_point") == best)
    if metric_name:
        df = df.withColumn("metric", F.lit(metric_name))
    return df.orderBy(F.desc("avg_metric"), "grid_point")


def _long(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")
    return wide.select("model", stacked).select("model", "s.metric", "s.value")

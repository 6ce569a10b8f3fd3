"""Scoring (M15, M16, M17, P3, P7, P8).

MLlib models score with ``transform``.  External models (a network trained
elsewhere) score through ``predict_batch_udf``: Arrow batches, the model built
once per Python worker, never per row and never on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LinearSVCModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import evaluate as ev


def score(model, features: DataFrame, keep: tuple[str, ...] = ("conv_id", "label"), model_name: str | None = None) -> DataFrame:
    """``keep`` + ``prediction``, ``probability`` (P(scam), null for SVM),
    ``margin`` (raw score of the scam class), verdict and confidence."""
    out = model.transform(features)
    raw = vector_to_array("rawPrediction")
    if isinstance(model, LinearSVCModel) or "probability" not in out.columns:
        prob = F.lit(None).cast("double")
    else:
        prob = vector_to_array("probability")[1]
    scored = out.select(*keep, F.col("prediction").cast("int").alias("prediction"), prob.alias("probability"), raw[1].alias("margin"))
    if model_name is not None:
        scored = scored.withColumn("model", F.lit(model_name))
    return scored


def score_with_model(
    df: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    input_col: str = "features_array",
    width: int = 400,
    batch_size: int = 1024,
) -> DataFrame:
    """Score with any numpy-in/numpy-out model: ``make_predict`` is called once
    per worker and returns ``f(batch[n, width]) -> p[n]``."""
    udf = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]])
    return df.withColumn("probability", udf(F.col(input_col)))


def with_verdict(scored: DataFrame, probability: str = "probability") -> DataFrame:
    prediction, verdict, confidence = ev.verdict(probability)
    return scored.withColumn("prediction", prediction).withColumn("verdict", verdict).withColumn("confidence", confidence)


def evaluate_models(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For a union of scored frames (``model, label, prediction[, probability]``):
    the long metric table and the zero-filled confusion matrix."""
    counts = ev.confusion_counts(scored)
    metrics = ev.classification_metrics(counts)
    if "probability" in scored.columns:
        with_p = scored.where(F.col("probability").isNotNull())
        metrics = metrics.unionByName(ev.binary_f1(with_p)).unionByName(ev.log_loss(with_p))
    return metrics, ev.confusion_matrix(counts)

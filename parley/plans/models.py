"""Training and scoring queries.

Training data: relational TF-IDF vectors of the labelled two-channel
documents, split 80/20 by hash of the document id.  These queries have no
SQL twin (model fitting is iterative); the tests check their invariants.
"""

from __future__ import annotations

import functools
import uuid
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import ensembles as es
from parley.operators import evaluate as ev
from parley.operators import features as ft
from parley.operators import network as nt
from parley.operators import score as sc
from parley.operators import train as tr
from parley.plans.features import document_weights
from parley.plans.registry import register
from parley.session import cut_lineage, scratch_path


def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, label, split, fold, combined_features``, written once to the
    shared folder: every fit, fold and model reads it from there."""
    docs, tf, idf = document_weights(spark, sf_dir)
    vec = ft.feature_vectors(ft.tfidf(tf, idf), docs, keep=["label"]).withColumnRenamed("features", tr.FEATURES)
    return cut_lineage(tr.with_folds(tr.split_dataset(vec)).select("conv_id", "label", "split", "fold", tr.FEATURES))


def _fit_and_score(spark: SparkSession, sf_dir: str, kind: str, **params) -> DataFrame:
    data = training_frame(spark, sf_dir)
    model = tr.train(kind, data.where(F.col("split") == "train"), **params)
    scored = sc.score(model, data.where(F.col("split") == "test"), keep=("conv_id", "label"), model_name=kind)
    return scored.select("model", "conv_id", "label", "prediction", F.round("probability", 6).alias("probability"), F.round("margin", 6).alias("margin"))


@register("train_logistic_regression")
def q_train_logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_and_score(spark, sf_dir, "logistic_regression")


@register("train_linear_svc")
def q_train_linear_svc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_and_score(spark, sf_dir, "linear_svc")


@register("train_random_forest")
def q_train_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_and_score(spark, sf_dir, "random_forest")


@register("train_gbt")
def q_train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_and_score(spark, sf_dir, "gbt")


@register("train_mlp")
def q_train_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_and_score(spark, sf_dir, "mlp")


def _search(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The whole grid of a kind under 7-fold cross-validation (folds by document
    hash): the report per grid point, best first."""
    data = training_frame(spark, sf_dir).where(F.col("split") == "train")
    cv = tr.reference_search(kind, data, parallelism=8)
    return ev.grid_report(spark, cv, metric_name=tr.CV_METRIC[kind]).withColumn("avg_metric", F.round("avg_metric", 6))


@register("cross_validate")
def q_cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "logistic_regression")


@register("cross_validate_linear_svc")
def q_cross_validate_linear_svc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "linear_svc")


def _staged(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The whole grid of an ensemble kind: the largest ensemble of every other
    setting is fitted per fold, smaller ones are scored on its first trees."""
    data = training_frame(spark, sf_dir).where(F.col("split") == "train")
    points = es.staged_search(kind, data, parallelism=8)
    return ev.search_report(spark, points, tr.CV_METRIC[kind]).withColumn("avg_metric", F.round("avg_metric", 6))


@register("cross_validate_random_forest")
def q_cross_validate_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir, "random_forest")


@register("cross_validate_gbt")
def q_cross_validate_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir, "gbt")


@register("tune_mlp")
def q_tune_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = training_frame(spark, sf_dir).where(F.col("split") == "train")
    rows = [(str(shape), float(loss)) for shape, loss in tr.tune_mlp(data)]
    return spark.createDataFrame(rows, "layers string, val_loss double").orderBy("val_loss")


@register("train_network")
def q_train_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ReLU network of the default configuration, scored on the test side."""
    data = training_frame(spark, sf_dir)
    return _network_scores(data, data.where(F.col("split") == "test"))


def _network_scores(data: DataFrame, test: DataFrame) -> DataFrame:
    config = nt.Config()
    state = nt.train_network(data.where(F.col("split") == "train"), config)
    arrays = test.select("conv_id", "label", vector_to_array(tr.FEATURES).alias("features_array"))
    scored = sc.with_verdict(sc.score_with_model(arrays, nt.predictor(config, state)))
    return scored.select(F.lit("network").alias("model"), "conv_id", "label", "prediction", F.round("probability", 6).alias("probability"))


@register("tune_network")
def q_tune_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperband over the network's search space: every network of every rung
    with its budget in steps and its validation loss."""
    data = training_frame(spark, sf_dir).where(F.col("split") == "train")
    rows = nt.search(data, scratch_path(spark, "networks", uuid.uuid4().hex))
    schema = "bracket int, rung int, network int, config string, budget int, loss double, kept boolean"
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema).withColumn("loss", F.round("loss", 6))


MODEL_KINDS = ("logistic_regression", "random_forest", "gbt", "linear_svc", "mlp")


@register("evaluate_models")
def q_evaluate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out comparison of the five models and the network: every metric, every cell of the
    confusion matrix and every misclassified document, as one long table."""
    data = training_frame(spark, sf_dir)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    fits = [lambda kind=kind: sc.score(tr.train(kind, train), test, model_name=kind) for kind in MODEL_KINDS]
    fits.append(lambda: _network_scores(data, test))
    # A fit is many short jobs, which leave most cores idle: the six fits run side by side.
    with ThreadPool(len(fits)) as pool:
        parts = pool.map(lambda fit: fit(), fits, chunksize=1)
    scored = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    scored = cut_lineage(scored)  # read three times below
    metrics, matrix = sc.evaluate_models(scored)
    wrong = ev.misclassified(scored, columns=["model", "conv_id", "label", "prediction", "probability"])
    number = lambda c: F.round(F.col(c).cast("double"), 6).alias("value")
    cell = F.concat_ws("->", F.col("actual").cast("string"), F.col("predicted").cast("string"))
    miss = F.concat_ws(":", "conv_id", F.col("label").cast("string"), F.col("prediction").cast("string"))
    return (
        metrics.select("model", F.lit("metric").alias("part"), F.col("metric").alias("name"), number("value"))
        .unionByName(matrix.select("model", F.lit("matrix").alias("part"), cell.alias("name"), number("n")))
        .unionByName(wrong.select("model", F.lit("misclassified").alias("part"), miss.alias("name"), number("probability")))
    )


def _logistic_predictor(coefficients: list[float], intercept: float):
    """An external numpy model: a closure the workers rebuild once each."""
    w = np.asarray(coefficients, dtype=np.float64)

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return 1.0 / (1.0 + np.exp(-(x @ w + intercept)))

        return predict

    return make


@register("score_with_model")
def q_score_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batched external scoring (Arrow, model built once per worker) of the
    test split, with verdicts; the model is the trained logistic regression's
    weights applied in numpy."""
    data = training_frame(spark, sf_dir)
    lr = tr.train("logistic_regression", data.where(F.col("split") == "train"))
    make = _logistic_predictor(lr.coefficients.toArray().tolist(), float(lr.intercept))
    test = data.where(F.col("split") == "test").withColumn("features_array", vector_to_array(tr.FEATURES))
    scored = sc.score_with_model(test, make, input_col="features_array")
    out = sc.with_verdict(scored)
    return out.select("conv_id", "label", F.round("probability", 6).alias("probability"), "prediction", "verdict")

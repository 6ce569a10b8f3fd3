"""Training, tuning and the model registry.

Training data is the persisted 400-wide feature frame.  Splits and folds are
hash buckets of the *base* conversation id, so every prefix of a conversation
lands on the same side (no prefix leakage) and the assignment does not depend
on partitioning or row order.
"""

from __future__ import annotations

import statistics
import threading
from collections.abc import Iterator, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.base import _FitMultipleIterator
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators import evaluate as ev
from parley.operators import forests as fo

FEATURES = "combined_features"
LABEL = "label"
PREDICTION = "prediction"

# The reference's search grids and chosen settings.
REFERENCE_GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {"maxIter": [35, 40, 50, 60], "regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.1, 0.2, 0.3]},
    "random_forest": {"numTrees": [85, 100, 130, 150, 200], "maxDepth": [10, 15, 20, 30], "maxBins": [16, 32, 45, 60]},
    "gbt": {"maxDepth": [1, 2, 4], "stepSize": [0.1, 0.3, 0.4], "maxIter": [60, 70, 100, 130]},
    "linear_svc": {"regParam": [0.1, 0.01, 0.02, 0.03], "maxIter": [50, 100, 150, 200]},
}
CHOSEN: dict[str, dict] = {
    "logistic_regression": {"maxIter": 40, "regParam": 0.01, "elasticNetParam": 0.1},
    "random_forest": {"numTrees": 150, "maxDepth": 30, "maxBins": 16},
    "gbt": {"maxDepth": 4, "stepSize": 0.4, "maxIter": 130},
    "linear_svc": {"regParam": 0.02, "maxIter": 200},
}
CV_METRIC = {"logistic_regression": "weightedRecall", "random_forest": "weightedRecall", "gbt": "accuracy", "linear_svc": "weightedRecall"}
NUM_FOLDS = 7
TRAIN_RATIO = 0.8
SEED = 42
ROWS_A_PART = 10_000  # least rows of a partition in a search


def hash_bucket(key: Column | str, buckets: int, seed: int = SEED) -> Column:
    """Deterministic bucket in ``[0, buckets)`` from the MD5 of ``seed:key``."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def split_dataset(df: DataFrame, base_id: str = "conv_id", train_ratio: float = TRAIN_RATIO, seed: int = SEED) -> DataFrame:
    """Add ``split`` = train/test by hash bucket of the base conversation id."""
    cut = int(round(train_ratio * 100))
    return df.withColumn("split", F.when(hash_bucket(base_id, 100, seed) < cut, F.lit("train")).otherwise(F.lit("test")))


def with_folds(df: DataFrame, base_id: str = "conv_id", k: int = NUM_FOLDS, seed: int = SEED) -> DataFrame:
    """Fold column for ``CrossValidator(foldCol=...)``, by base id."""
    return df.withColumn("fold", hash_bucket(base_id, k, seed + 1))


def estimator(kind: str, features: str = FEATURES, label: str = LABEL, **params) -> Estimator:
    """A classifier with the reference's chosen settings unless overridden."""
    settings = {**CHOSEN.get(kind, {}), **params}
    common = {"featuresCol": features, "labelCol": label, "predictionCol": PREDICTION}
    if kind == "logistic_regression":
        return LogisticRegression(**common, **settings)
    if kind == "random_forest":
        return RandomForestClassifier(**common, seed=SEED, **settings)
    if kind == "gbt":
        return GBTClassifier(**common, seed=SEED, **settings)
    if kind == "linear_svc":
        return LinearSVC(**common, **settings)
    if kind == "mlp":
        layers = settings.pop("layers", [400, 64, 32, 16, 2])
        return MultilayerPerceptronClassifier(**common, layers=layers, seed=SEED, **settings)
    raise ValueError(f"unknown model kind {kind!r}")


def train(kind: str, train_df: DataFrame, **params):
    """The fitted model; a forest that the driver might not hold is grown and
    stored by the executors."""
    if kind == "random_forest":
        settings = {**CHOSEN[kind], **params}
        rows = train_df.count()
        if fo.too_large(rows, settings["numTrees"], settings):
            return fo.train(train_df, rows, SEED, FEATURES, LABEL, PREDICTION, **settings)
    return estimator(kind, **params).fit(train_df)


def param_grid(est: Estimator, grid: Mapping[str, Sequence]):
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    return builder.build()


def few_partitions(df: DataFrame) -> DataFrame:
    """``df`` in partitions of at least ``ROWS_A_PART`` rows: a fit is very many
    short jobs, and partitions of few rows would make them many short tasks."""
    return df.coalesce(min(df.rdd.getNumPartitions(), df.count() // ROWS_A_PART + 1))


class _SharedIterations:
    """An iterative classifier whose fits differ in ``maxIter`` alone share one
    fit where that is exact: the longest is fitted first, and if it converged
    within fewer iterations, a fit limited to no less than those ends in the
    same model.  Where it did not, the shorter fit is made."""

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]) -> Iterator:
        est, limit = self.copy(), self.maxIter
        longest, found, locks = {}, {}, {}
        key = lambda m: tuple(sorted((p.name, v) for p, v in m.items() if p != limit))
        rounds = lambda m: m.get(limit, est.getMaxIter())
        for m in paramMaps:
            k = key(m)
            longest[k] = m if k not in longest or rounds(m) > rounds(longest[k]) else longest[k]
            locks.setdefault(k, threading.Lock())

        def one(i: int):
            m, k = paramMaps[i], key(paramMaps[i])
            with locks[k]:
                if k not in found:
                    found[k] = est.fit(dataset, longest[k])
            return found[k] if rounds(m) == rounds(longest[k]) or self.training(found[k]).totalIterations <= rounds(m) else est.fit(dataset, m)

        return _FitMultipleIterator(one, len(paramMaps))


class SharedLogisticRegression(_SharedIterations, LogisticRegression):
    def training(self, model: LogisticRegressionModel):
        return model.summary


class SharedLinearSVC(_SharedIterations, LinearSVC):
    def training(self, model: LinearSVCModel):
        return model.summary()


class SteppedCrossValidator(CrossValidator):
    """Cross-validation of a linear kind whose fits step together (``linear``)."""

    MODELS = {"logistic_regression": LogisticRegressionModel, "linear_svc": LinearSVCModel}

    def fit_together(self, kind: str, dataset: DataFrame, rows: int, metric: str) -> CrossValidatorModel:
        from parley.operators import linear  # which reads this module

        est, maps = self.getEstimator(), self.getEstimatorParamMaps()
        points = [{p.name: v for p, v in m.items()} for m in maps]
        defaults = {n: est.getOrDefault(n) if est.hasParam(n) else 0.0 for n in linear.SETTINGS}
        scores, models = linear.search(kind, dataset, rows, points, defaults, metric, self.getFoldCol(), self.getNumFolds(), est.getFeaturesCol(), est.getLabelCol())
        metrics = [sum(s) / len(s) for s in zip(*scores)]
        best = max(range(len(maps)), key=lambda i: (metrics[i], -i))
        weights, bias = models[best]
        jvm = dataset.sparkSession.sparkContext._jvm
        kept = getattr(jvm.org.apache.spark.ml.classification, self.MODELS[kind].__name__)(est.uid, _py2java(dataset.sparkSession.sparkContext, Vectors.dense(weights)), float(bias))
        model = est.copy(maps[best])._copyValues(self.MODELS[kind](kept))
        spread = [statistics.pstdev(s) for s in zip(*scores)]
        return self._copyValues(CrossValidatorModel(model, metrics, stdMetrics=spread))


SHARED = {"logistic_regression": SharedLogisticRegression, "linear_svc": SharedLinearSVC}


def cross_validate(
    kind: str,
    df: DataFrame,
    grid: Mapping[str, Sequence] | None = None,
    metric: str | None = None,
    fold_col: str = "fold",
    parallelism: int = 4,
    num_folds: int = NUM_FOLDS,
    **params,
):
    """k-fold CV over a grid (default: the chosen point only) with a fold column.

    Use ``REFERENCE_GRIDS[kind]`` for the full search.  All fits of logistic
    regression or linear SVC step together over two classes; in other searches
    the input is persisted, in few partitions, while the folds read it, and
    points that differ in ``maxIter`` alone share the fits that converged.
    """
    est = estimator(kind, **params)
    if kind in SHARED:
        est = est._copyValues(SHARED[kind]())
    grid = grid or {k: [v] for k, v in CHOSEN.get(kind, {}).items()}
    metric = metric or CV_METRIC.get(kind, "accuracy")
    evaluator = MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName=metric)
    cv = SteppedCrossValidator(
        estimator=est,
        estimatorParamMaps=param_grid(est, grid),
        evaluator=evaluator,
        foldCol=fold_col,
        numFolds=num_folds,
        parallelism=parallelism,
        seed=SEED,
    )
    if kind in SHARED and not params and set(grid) <= {"maxIter", "regParam", "elasticNetParam"} and metric in ev.MULTICLASS_METRICS:
        sides = df.groupBy(fold_col, LABEL).count().collect()
        folds = {r[fold_col] for r in sides}
        if folds == set(range(num_folds)) and len(folds) > 1 and {r[LABEL] for r in sides} == {0, 1}:
            return cv.fit_together(kind, df, sum(r["count"] for r in sides), metric)
    cached = few_partitions(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cv.fit(cached)
    finally:
        cached.unpersist()


def reference_search(kind: str, df: DataFrame, parallelism: int = 4):
    """The reference's full search for ``kind`` (its grid, 7 folds, its CV
    metric) as a named preset; the default ``cross_validate`` grid is small."""
    return cross_validate(kind, df, grid=REFERENCE_GRIDS[kind], metric=CV_METRIC[kind], parallelism=parallelism)


def tune_mlp(
    df: DataFrame,
    hidden: Sequence[Sequence[int]] = ((64, 32, 16), (128, 64, 32)),
    n_features: int = 400,
    max_iter: int = 100,
    base_id: str = "conv_id",
) -> list[tuple[list[int], float]]:
    """Network search: every hidden-layer shape with its validation log-loss,
    best first (MLlib MLP: sigmoid hidden units, softmax out).

    Training and validation side are hash buckets of the base id (0.8), so all
    prefixes of a conversation fall on one side.
    """
    side = hash_bucket(base_id, 100, SEED + 2) < int(round(TRAIN_RATIO * 100))
    fit, held = df.where(side).persist(StorageLevel.MEMORY_AND_DISK), df.where(~side).persist(StorageLevel.MEMORY_AND_DISK)
    evaluator = MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol=PREDICTION, probabilityCol="probability", metricName="logLoss")
    shapes = [[n_features, *h, 2] for h in hidden]
    est = estimator("mlp", maxIter=max_iter)
    try:
        models = est.fit(fit, [{est.layers: s} for s in shapes])
        losses = [evaluator.evaluate(m.transform(held)) for m in models]
    finally:
        fit.unpersist()
        held.unpersist()
    return sorted(zip(shapes, losses), key=lambda x: x[1])


class ModelRegistry:
    """Model id -> (path, MLlib model class).  Ids are validated before any
    lookup: non-strings raise ``TypeError``, unknown ids ``ValueError``."""

    LOADERS = {
        "logistic_regression": LogisticRegressionModel,
        "random_forest": RandomForestClassificationModel,
        "gbt": GBTClassificationModel,
        "linear_svc": LinearSVCModel,
        "mlp": MultilayerPerceptronClassificationModel,
    }

    def __init__(self, paths: Mapping[str, str]):
        unknown = set(paths) - set(self.LOADERS)
        if unknown:
            raise ValueError(f"unknown model kinds {sorted(unknown)}")
        self.paths = dict(paths)

    def load(self, model_id):
        if not isinstance(model_id, str):
            raise TypeError("model id must be a string")
        if model_id not in self.paths:
            raise ValueError(f"unknown model id {model_id!r}; known: {sorted(self.paths)}")
        return self.LOADERS[model_id].load(self.paths[model_id])

"""Linear searches that step together: against MLlib's fits, one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator

from parley.operators import linear as li
from parley.operators import train as tr


@pytest.fixture(scope="module")
def data(spark):
    """A column that never changes, a rare one, rows that come twice, ids of null."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(240, 3)), np.full(240, 0.1), rng.random(240) < 0.02])
    y = (x[:, 0] + 0.7 * rng.normal(size=240) > 0.5).astype(int)
    rows = [(None if i < 5 else f"c{i}", int(y[i]), x[i].tolist(), i % 3) for i in list(range(240)) + list(range(20))]
    schema = "conv_id string, label int, x array<double>, fold int"
    return spark.createDataFrame(rows, schema).select("conv_id", "label", "fold", array_to_vector("x").alias(tr.FEATURES)).coalesce(2).cache()


def check(data, monkeypatch, kind, grid):
    ran = []
    monkeypatch.setattr(li, "fitted", lambda *a, f=li.fitted: ran.append(1) or f(*a))
    got = tr.cross_validate(kind, data, grid=grid, num_folds=3)
    assert ran == [1]
    est = tr.estimator(kind)
    evaluator = MulticlassClassificationEvaluator(labelCol=tr.LABEL, predictionCol=tr.PREDICTION, metricName=tr.CV_METRIC[kind])
    want = CrossValidator(estimator=est, estimatorParamMaps=tr.param_grid(est, grid), evaluator=evaluator, foldCol="fold", numFolds=3, parallelism=4).fit(data)
    assert [{p.name: v for p, v in m.items()} for m in got.getEstimatorParamMaps()] == [{p.name: v for p, v in m.items()} for m in want.getEstimatorParamMaps()]
    assert np.allclose(got.avgMetrics, want.avgMetrics, atol=1e-9)
    assert np.allclose(got.bestModel.coefficients.toArray(), want.bestModel.coefficients.toArray(), atol=1e-7)
    assert abs(got.bestModel.intercept - want.bestModel.intercept) < 1e-7
    assert [r.prediction for r in got.bestModel.transform(data).collect()] == [r.prediction for r in want.bestModel.transform(data).collect()]


def test_logistic_points_equal_mllibs_fits(data, monkeypatch):
    check(data, monkeypatch, "logistic_regression", {"maxIter": [2, 7, 40], "regParam": [0.01], "elasticNetParam": [0.0, 0.3]})


def test_one_class_alone_is_always_said(spark):
    rows = [(1 if i < 8 else 0, [float(i)], 0 if i < 8 else 1) for i in range(16)]
    df = spark.createDataFrame(rows, "label int, x array<double>, fold int").select("label", "fold", array_to_vector("x").alias(tr.FEATURES))
    assert tr.cross_validate("logistic_regression", df, grid={"maxIter": [5]}, num_folds=2).avgMetrics == [0.0]


def test_svc_points_equal_mllibs_fits(data, monkeypatch):
    check(data, monkeypatch, "linear_svc", {"maxIter": [2, 6, 15], "regParam": [0.1, 0.02]})

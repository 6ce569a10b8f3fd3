"""Feature, sequence, evaluation and model invariants."""

from __future__ import annotations

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from parley.operators import evaluate as ev
from parley.operators import features as ft
from parley.operators import sequences as sq
from parley.operators import train as tr
from tests.conftest import SF001


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "conv_id string, seq int, caller array<string>, victim array<string>")


def test_tf_counts_and_idf_formula(spark):
    pairs = _pairs(spark, [("d1", 0, ["a", "a", "b"], ["c"]), ("d2", 0, ["a"], [])])
    tf = ft.bucket_tf(ft.channel_tokens(pairs))
    total = tf.where(F.col("conv_id") == "d1").groupBy("channel").agg(F.sum("tf")).collect()
    assert dict(map(tuple, total)) == {"caller": 3, "victim": 1}
    idf = {(r["channel"], r["slot"]): r for r in ft.idf_weights(tf, ft.document_count(pairs)).collect()}
    slot_a = spark.range(1).select(ft.token_slot(F.lit("a")).alias("s")).first()["s"]
    row = idf[("caller", slot_a)]
    assert row["df"] == 2 and math.isclose(row["idf"], math.log(3 / 3))
    slot_c = spark.range(1).select(ft.token_slot(F.lit("c")).alias("s")).first()["s"]
    assert math.isclose(idf[("victim", slot_c)]["idf"], math.log(3 / 2))


def test_feature_vector_width_and_zero_docs(spark):
    pairs = _pairs(spark, [("d1", 0, ["a"], ["b"]), ("d2", 0, [], [])])
    tf = ft.bucket_tf(ft.channel_tokens(pairs))
    vec = ft.feature_vectors(ft.tfidf(tf, ft.idf_weights(tf, ft.document_count(pairs))), pairs.select("conv_id").distinct(), value="tf")
    rows = {r["conv_id"]: r["features_array"] for r in vec.collect()}
    assert len(rows["d1"]) == 400 and sum(rows["d1"]) == 2 and sum(rows["d2"]) == 0


def test_prefix_tf_equals_recount(spark):
    # Pair 3 has no tokens at all: its prefix still carries everything so far.
    pairs = _pairs(spark, [("d", 0, ["a"], ["b"]), ("d", 1, ["a", "c"], []), ("d", 2, [], ["b"]), ("d", 3, [], [])])
    out = ft.prefix_tf(pairs).groupBy("prefix_no", "channel").agg(F.sum("tf").alias("n")).collect()
    got = {(r["prefix_no"], r["channel"]): r["n"] for r in out}
    assert got == {
        (0, "caller"): 1, (0, "victim"): 1, (1, "caller"): 3, (1, "victim"): 1,
        (2, "caller"): 3, (2, "victim"): 2, (3, "caller"): 3, (3, "victim"): 2,
    }


def test_mllib_pipeline_width_and_serving(spark):
    docs = spark.createDataFrame([("d1", [["a", "b"], ["c"]], [["x"]], 1), ("d2", [["b"]], [["y"], None], 0)], "conv_id string, caller array<array<string>>, victim array<array<string>>, label int")
    fitted = ft.feature_model().fit(docs)
    out = fitted.transform(docs).select(F.size(vector_to_array("combined_features")).alias("w"), vector_to_array("AH_features").alias("ah")).collect()
    assert all(r["w"] == 400 for r in out) and sorted(sum(r["ah"]) for r in out) == [1.0, 3.0]
    serving = ft.serving_model(fitted)
    msg = spark.createDataFrame([(["a", "b", "c"], ["x"])], "caller array<string>, victim array<string>")
    assert serving.transform(msg).select(F.size(vector_to_array("combined_features"))).first()[0] == 400


def test_vocabulary_ties_unknown_and_limit(spark):
    words = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "token string")
    vocab = sq.vocabulary(sq.word_counts(words))
    assert [tuple(r) for r in vocab.orderBy("idx").collect()] == [("c", 2, 1), ("a", 1, 2), ("b", 1, 3)]
    lists = spark.createDataFrame([("d", [["c", "zzz"], [], ["a", "b"]], []), ("e", [], [])], "conv_id string, caller array<array<string>>, victim array<array<string>>")
    tokens = ft.channel_list_tokens(lists)
    enc = {r["conv_id"]: r for r in sq.encode_sequences(tokens, lists.select("conv_id"), vocab, chunk=1).collect()}
    assert enc["d"]["caller"] == [1, 2, 3] and enc["d"]["victim"] == [] and enc["e"]["caller"] == []
    assert sq.encode_sequences(tokens, lists.select("conv_id"), vocab, num_words=3).where("conv_id = 'd'").first()["caller"] == [1, 2]


def test_vocabulary_rank_over_many_partitions(spark):
    counts = spark.range(5000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"), (F.col("id") % 97).alias("cnt")).repartition(13)
    got = [(r["token"], r["idx"]) for r in sq.vocabulary(counts).collect()]
    want = sorted(((f"w{i}", i % 97) for i in range(5000)), key=lambda x: (-x[1], x[0]))
    assert sorted(got, key=lambda x: x[1]) == [(t, i) for i, (t, _) in enumerate(want, 1)]


def test_metrics_and_one_class_confusion(spark):
    scored = spark.createDataFrame([("m", 0, 0, 0.2), ("m", 0, 0, 0.4), ("m", 0, 1, 0.9)], "model string, label int, prediction int, probability double")
    counts = ev.confusion_counts(scored)
    cm = sorted(tuple(r) for r in ev.confusion_matrix(counts).collect())
    assert cm == [("m", 0, 0, 2), ("m", 0, 1, 1), ("m", 1, 0, 0), ("m", 1, 1, 0)]
    metrics = {r["metric"]: r["value"] for r in ev.classification_metrics(counts).collect()}
    assert math.isclose(metrics["accuracy"], 2 / 3) and math.isclose(metrics["weightedRecall"], metrics["accuracy"])
    f1 = {r["metric"]: r["value"] for r in ev.binary_f1(scored).collect()}
    assert f1["precision"] == 0.0 and f1["f1score"] == 0.0


def test_verdict_thresholds(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (0.85,), (0.86,)], "p double")
    pred, verdict, conf = ev.verdict("p")
    out = df.select("p", pred, verdict, conf).withColumn("probability", F.col("p")).collect()
    assert [r["verdict"] for r in out] == ["normal", "scam", "scam", "scam"]
    alerts = ev.alerts(df.select(pred, F.col("p").alias("probability"))).collect()
    assert [r["probability"] for r in alerts] == [0.86]


def test_split_is_by_base_id(spark):
    df = spark.createDataFrame([(f"c{i}", k) for i in range(200) for k in range(3)], "conv_id string, k int")
    per_conv = tr.split_dataset(df).groupBy("conv_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count()
    assert per_conv == 0
    share = tr.split_dataset(df).where("split = 'train'").count() / df.count()
    assert 0.65 < share < 0.95


def test_registry_validation():
    reg = tr.ModelRegistry({"logistic_regression": "/nowhere"})
    with pytest.raises(TypeError):
        reg.load(3)
    with pytest.raises(ValueError):
        reg.load("gbt")
    with pytest.raises(ValueError):
        tr.ModelRegistry({"keras": "/x"})


def test_train_save_load_same_predictions(spark, scratch):
    from parley.plans.models import training_frame
    from parley.sources.io import save_model

    data = training_frame(spark, SF001)
    train = data.where("split = 'train'")
    model = tr.train("logistic_regression", train)
    save_model(model, f"{scratch}/lr")
    loaded = tr.ModelRegistry({"logistic_regression": f"{scratch}/lr"}).load("logistic_regression")
    a = [r["prediction"] for r in model.transform(data).orderBy("conv_id").collect()]
    b = [r["prediction"] for r in loaded.transform(data).orderBy("conv_id").collect()]
    assert a == b and len(a) > 0


def test_external_scoring_equals_mllib(spark):
    from parley.operators import score as sc
    from parley.plans.models import _logistic_predictor, training_frame

    data = training_frame(spark, SF001)
    lr = tr.train("logistic_regression", data.where("split = 'train'"))
    ml = {r["conv_id"]: r["probability"] for r in sc.score(lr, data).collect()}
    make = _logistic_predictor(lr.coefficients.toArray().tolist(), float(lr.intercept))
    arrays = data.withColumn("features_array", vector_to_array(tr.FEATURES))
    ext = {r["conv_id"]: r["probability"] for r in sc.score_with_model(arrays, make).collect()}
    assert ml.keys() == ext.keys()
    assert all(math.isclose(ml[k], ext[k], rel_tol=1e-9, abs_tol=1e-12) for k in ml)


def test_searches_report_every_grid_point(spark):
    """A tiny search of each kind: one row per grid point, the best one marked."""
    rows = [(f"c{i}", i % 2, [float(i % 2), float(i % 3)]) for i in range(80)]
    from pyspark.ml.functions import array_to_vector

    data = spark.createDataFrame(rows, "conv_id string, label int, x array<double>").select("conv_id", "label", array_to_vector("x").alias(tr.FEATURES))
    data = tr.with_folds(data, k=2)
    grids = {
        "logistic_regression": {"maxIter": [2, 5], "regParam": [0.01]},
        "random_forest": {"numTrees": [2, 3], "maxDepth": [2], "maxBins": [8]},
        "gbt": {"maxDepth": [1], "stepSize": [0.1, 0.3], "maxIter": [2]},
        "linear_svc": {"regParam": [0.1, 0.01], "maxIter": [5]},
    }
    for kind, grid in grids.items():
        report = ev.grid_report(spark, tr.cross_validate(kind, data, grid=grid, num_folds=2)).collect()
        assert len(report) == 2 and sum(r["is_best"] for r in report) == 1 and report[0]["is_best"], kind
    assert [len(tr.param_grid(tr.estimator(k), g)) for k, g in tr.REFERENCE_GRIDS.items()] == [48, 80, 36, 16]
    shapes = tr.tune_mlp(data, hidden=((3, 2, 2), (4, 2, 2)), n_features=2, max_iter=5)
    assert len(shapes) == 2 and shapes[0][1] <= shapes[1][1]


def test_misclassified_default_columns(spark):
    scored = spark.createDataFrame([("a", 1, 0, 0.1), ("b", 1, 1, 0.9)], "conv_id string, label int, prediction int, probability double")
    assert [tuple(r) for r in ev.misclassified(scored).collect()] == [("a", 1, 0, 0.1)]


def test_vocabulary_write_read(spark, scratch):
    from parley.sources import io

    vocab = sq.vocabulary(sq.word_counts(spark.createDataFrame([("a",), ("b",), ("a",)], "token string")))
    io.write_vocabulary(vocab, f"{scratch}/vocab")
    back = sorted(tuple(r) for r in io.read_vocabulary(spark, f"{scratch}/vocab").collect())
    assert back == [("a", 2, 1), ("b", 1, 2)]

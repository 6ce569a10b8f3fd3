"""Live scoring of id sequences: ids as in batch, a replaced vocabulary, the sink."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import sequences as sq
from parley.plans.streams import _id_predictor
from parley.sources import io
from parley.streaming import jobs

MESSAGES = "conv_id string, seq long, caller array<string>, victim array<string>"


def vocabulary(spark, *words):
    return spark.createDataFrame([(w, 10 - i, i + 1) for i, w in enumerate(words)], "token string, cnt long, idx int")


def test_message_ids_equal_batch_ids(spark):
    """Live messages get the ids that the training path gives the same words."""
    lists = {"a": (["hi", "you", "hi"], ["who"]), "b": ([], ["new", "hi", "you", "you", "who"]), "c": (["none"], [])}
    tokens = [(c, ch, 0, i, t) for c, both in lists.items() for ch, words in zip(("caller", "victim"), both) for i, t in enumerate(words)]
    vocab = vocabulary(spark, "hi", "you", "who", "new")
    encoded = sq.encode_sequences(spark.createDataFrame(tokens, "conv_id string, channel string, seq int, pos int, token string"), spark.createDataFrame([(c,) for c in lists], "conv_id string"), vocab, num_words=4)
    batch = {r.conv_id: r.ids for r in sq.padded_sequences(encoded, 3).collect()}
    messages = spark.createDataFrame([(c, 0, *both) for c, both in lists.items()], MESSAGES)
    live = {r.conv_id: r.ids for r in sq.encode_messages(messages, vocab, 3, num_words=4).collect()}
    assert live == batch == {"a": [1, 2, 1, 0, 0, 3], "b": [0, 0, 0, 2, 2, 3], "c": [0] * 6}


def test_every_message_gives_one_row(spark):
    rows = [("a", 0, ["hi"], None), ("a", 0, ["hi"], None), (None, None, None, None), ("b", 1, [None, "hi"], ["hi", None])]
    messages = spark.createDataFrame(rows, MESSAGES).withColumn("idx", F.lit(7)).withColumn("token", F.lit("x"))
    got = sq.encode_messages(messages, vocabulary(spark, "hi"), 2)
    assert got.columns == ["conv_id", "seq", "idx", "token", "ids"]
    assert sorted((repr(r.conv_id), r.idx, r.ids) for r in got.collect()) == [("'a'", 7, [0, 1, 0, 0]), ("'a'", 7, [0, 1, 0, 0]), ("'b'", 7, [0, 1, 0, 1]), ("None", 7, [0, 0, 0, 0])]
    assert sq.encode_messages(messages.limit(0), vocabulary(spark, "hi"), 2).count() == 0


def test_id_weights_are_log_ratios(spark):
    encoded = spark.createDataFrame([([1, 1, 2], [3], 1), ([2], [2, 9], 0)], "caller array<int>, victim array<int>, label int")
    weights, prior = sq.id_weights(encoded, 5)
    assert prior == 0 and weights[0] == weights[4] == 0
    n1, n0 = 4 + 5, 2 + 5
    assert np.allclose(weights[1:4], [np.log(3 / n1) - np.log(1 / n0), np.log(2 / n1) - np.log(3 / n0), np.log(2 / n1) - np.log(1 / n0)])


def test_a_replaced_vocabulary_is_picked_up(spark, scratch):
    """The query stops, the vocabulary is replaced, the query goes on."""
    schema = spark.createDataFrame([], MESSAGES).schema
    name = f"seq_{uuid.uuid4().hex[:8]}"
    path = f"{scratch}/vocabulary"
    weights = [0.0, 4.0, -4.0]

    def run(rows):
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").json(f"{scratch}/in")
        stream = spark.readStream.schema(schema).json(f"{scratch}/in")
        config = jobs.ScoringConfig("ids", path="sequences")
        jobs.start_scoring(config, stream, None, name, f"{scratch}/out", f"{scratch}/audit", predict_factory=_id_predictor(weights, 0.0), vocabulary_path=path, width=3).awaitTermination()
        return {r.seq: r for r in spark.read.parquet(f"{scratch}/out").collect()}

    io.write_vocabulary(vocabulary(spark, "pin", "mum"), path)
    first = run([("a", 0, ["your", "pin"], ["mum"]), ("a", 1, ["pin"], ["what"])])
    assert [first[0].ids, first[1].ids] == [[0, 0, 1, 0, 0, 2], [0, 0, 1, 0, 0, 0]]
    assert (first[0].verdict, first[1].verdict, first[1].alert) == ("normal", "scam", True)
    io.write_vocabulary(vocabulary(spark, "mum", "pin"), path)
    second = run([("a", 2, ["pin"], [])])
    assert second[2].ids == [0, 0, 2, 0, 0, 0] and second[2].verdict == "normal" and len(second) == 3
    assert second[1].ids == first[1].ids  # what was scored stays
    assert spark.read.parquet(f"{scratch}/audit").agg(F.sum("n_rows")).first()[0] == 3


def test_the_sequences_path_needs_its_parts(spark):
    config = jobs.ScoringConfig("ids", path="sequences")
    assert config.validate()
    for params in ({"predict_factory": None}, {"predict_factory": len}):
        with pytest.raises(ValueError):
            jobs.start_scoring(config, None, None, "x", "x", "x", **params)

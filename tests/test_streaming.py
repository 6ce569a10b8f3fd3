"""Streaming = batch: the stream operators, drained with availableNow, give the
same rows as their batch twins; a restart from the checkpoint adds nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.operators import assemble as asm
from parley.sources.tables import conversation_turns
from parley.streaming import jobs
from tests.conftest import SF001


def test_stream_pairs_equal_batch_and_restart_is_idempotent(spark, scratch):
    turns = conversation_turns(spark, SF001)
    jobs.write_channel_messages(turns, f"{scratch}/in")
    pairs = jobs.split_unpaired(jobs.stream_pair_turns(jobs.read_channel_stream(spark, f"{scratch}/in", "caller"), jobs.read_channel_stream(spark, f"{scratch}/in", "victim")))[0]
    name = f"test_pairs_{uuid.uuid4().hex[:8]}"
    q = jobs.run_stream(pairs, name, sink_path=f"{scratch}/out")
    q.awaitTermination()
    streamed = sorted(tuple(r) for r in spark.read.parquet(f"{scratch}/out").select("conv_id", F.col("seq").cast("int"), "caller", "victim").collect())
    batch = sorted(tuple(r) for r in asm.pair_turns(turns).select("conv_id", "seq", "caller", "victim").collect())
    assert streamed == batch and len(batch) > 0
    again = jobs.run_stream(pairs, name, sink_path=f"{scratch}/out")
    again.awaitTermination()
    assert spark.read.parquet(f"{scratch}/out").count() == len(batch)


def test_running_transcript_equals_prefixes(spark):
    from parley.plans import all_queries

    qs = all_queries()
    streamed = sorted(tuple(r) for r in qs["stream_running_transcript"](spark, SF001).collect())
    batch = sorted(tuple(r) for r in qs["conversation_prefixes"](spark, SF001).collect())
    assert streamed == batch


def test_scoring_config_validation():
    import pytest

    assert jobs.ScoringConfig("logistic_regression").validate()
    with pytest.raises(ValueError):
        jobs.ScoringConfig("keras_net").validate()
    assert jobs.ScoringConfig("keras_net", path="external").validate()
    with pytest.raises(TypeError):
        jobs.ScoringConfig(5).validate()


def test_external_stream_scoring_equals_mllib_stream_scoring(spark):
    from parley.plans import all_queries

    qs = all_queries()
    mllib = {(r["conv_id"], r["seq"]): (r["prediction"], r["verdict"]) for r in qs["stream_score"](spark, SF001).collect()}
    ext = {(r["conv_id"], r["seq"]): (r["prediction"], r["verdict"]) for r in qs["stream_score_external"](spark, SF001).collect()}
    assert mllib == ext and len(mllib) > 0


def test_audit_rows_match_scored_output(spark):
    from parley.plans.streams import _message_stream, _served, _workdir

    root = _workdir(spark, "audit_test")
    serving, model = _served(spark, SF001, root)
    scored = jobs.stream_score(_message_stream(spark, SF001, root), serving, model)
    jobs.run_stream(scored, name=root.rsplit("/", 1)[-1], foreach_batch=jobs.audit_sink(f"{root}/scored", f"{root}/audit")).awaitTermination()
    out = spark.read.parquet(f"{root}/scored")
    audit = spark.read.parquet(f"{root}/audit").agg(F.sum("n_rows"), F.sum("n_scam"), F.sum("n_alerts")).first()
    assert audit[0] == out.count()
    assert audit[1] == out.where("prediction = 1").count()
    assert audit[2] == out.where("alert").count()


def test_malformed_messages_are_kept_and_counted(spark, scratch):
    import os

    os.makedirs(f"{scratch}/msgs")
    with open(f"{scratch}/msgs/part-0.json", "w") as fh:
        fh.write('{"conv_id": "a", "seq": 0, "Attacker_Helper": ["hi"], "Victim": ["yo"]}\n')
        fh.write("not json\n")
        fh.write('{"conv_id": "a", "seq": 1, "Attacker_Helper": ["x"], "Victim": []}\n')
    stream = jobs.read_message_stream(spark, f"{scratch}/msgs", keep_malformed=True)
    good, bad = jobs.split_malformed(stream)
    name = f"malformed_{uuid.uuid4().hex[:8]}"
    jobs.run_stream(good, f"{name}_good", sink_path=f"{scratch}/good").awaitTermination()
    jobs.run_stream(bad, f"{name}_bad", sink_path=f"{scratch}/bad").awaitTermination()
    assert spark.read.parquet(f"{scratch}/good").count() == 2
    assert [r[jobs.CORRUPT] for r in spark.read.parquet(f"{scratch}/bad").collect()] == ["not json"]


def _said(spark, scratch, rows):
    """Turns ``(turn, channel)`` of one conversation as two channel streams."""
    turns = spark.createDataFrame([("a", t, ch, f"{ch}{t}") for t, ch in rows], "conv_id string, turn long, channel string, text string")
    jobs.write_channel_messages(turns, f"{scratch}/in")
    return turns, [jobs.read_channel_stream(spark, f"{scratch}/in", ch) for ch in ("caller", "victim")]


def test_one_sided_talk_loses_no_pair(spark, scratch):
    """All caller turns long before all victim turns: batch and stream agree."""
    turns, (caller, victim) = _said(spark, scratch, [(t, "caller") for t in range(200)] + [(t, "victim") for t in range(200, 400)])
    pairs, _ = jobs.split_unpaired(jobs.stream_pair_turns(caller, victim))
    jobs.run_stream(pairs, f"one_sided_{uuid.uuid4().hex[:8]}", sink_path=f"{scratch}/out").awaitTermination()
    streamed = sorted(tuple(r) for r in spark.read.parquet(f"{scratch}/out").select("seq", "caller", "victim").collect())
    assert streamed == sorted(tuple(r) for r in asm.pair_turns(turns).select("seq", "caller", "victim").collect()) and len(streamed) == 200


def test_bounded_pairing_rejects_instead_of_dropping(spark, scratch):
    """With a bound, far partners come out as rejects once the watermark passed."""
    _, (caller, victim) = _said(spark, scratch, [(0, "caller"), (1, "victim"), (2, "caller"), (4000, "victim"), (8000, "caller"), (8001, "victim"), (16000, "caller"), (16001, "victim")])
    joined = jobs.stream_pair_turns(caller, victim, bound="10 minutes")
    name = f"bounded_{uuid.uuid4().hex[:8]}"
    jobs.run_stream(joined, name, sink_path=f"{scratch}/out").awaitTermination()
    out = spark.read.parquet(f"{scratch}/out")
    good, bad = jobs.split_unpaired(out)
    assert sorted(r["seq"] for r in good.collect()) == [0, 2, 3]
    assert sorted((r["seq"], r["has_caller"]) for r in bad.collect()) == [(1, False), (1, True)]


class _Handle:
    """Keyed state of one conversation in memory."""

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class List(list):
        def exists(self):
            return bool(self)

        def get(self):
            return iter(self)

        def appendList(self, rows):  # noqa: N802
            self.extend(rows)

    class Map(dict):
        containsKey = dict.__contains__  # noqa: N815
        getValue = dict.get  # noqa: N815
        updateValue = dict.__setitem__  # noqa: N815
        removeKey = dict.pop  # noqa: N815

        def iterator(self):
            return iter(list(self.items()))

    def __init__(self):
        self.timers, self.parts = set(), {}

    def _part(self, kind):
        return lambda name, *schema: self.parts.setdefault(name, kind())

    getValueState = property(lambda self: self._part(self.Value))  # noqa: N815
    getListState = property(lambda self: self._part(self.List))  # noqa: N815
    getMapState = property(lambda self: self._part(self.Map))  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def _pairs(*seqs):
    import json

    import pandas as pd

    return pd.DataFrame({"seq": seqs, "event_ts": pd.to_datetime([1_700_000_000 + s for s in seqs], unit="s"), "caller": [json.dumps(f"c{s}") for s in seqs], "victim": [json.dumps(f"v{s}") for s in seqs]})


def _processor(idle_ms):
    from parley.streaming.transcripts import Transcript

    processor, handle = Transcript(idle_ms), _Handle()
    processor.init(handle)
    return processor, handle


def test_transcript_gap_idle_and_return():
    """A gap waits; the idle limit emits what waits, marked; a late pair is
    emitted, marked; a conversation that returns goes on with its numbers."""
    processor, handle = _processor(1000)
    rows = lambda frames: [(int(n), bool(g), c.count(",") + 1) for f in frames for n, g, c in zip(f["prefix_no"], f["gap"], f["caller"])]
    feed = lambda *seqs: rows(processor.handleInputRows(("a",), iter([_pairs(*seqs)]), handle))

    assert feed(0, 2, 3) == [(0, False, 1)] and len(handle.timers) == 1
    assert rows(processor.handleExpiredTimer(("a",), handle, None)) == [(2, True, 2), (3, False, 3)]
    assert feed(1) == [(1, True, 4)] and not handle.timers
    assert feed(4, 5) == [(4, False, 5), (5, False, 6)]
    patient, state = _processor(None)
    assert list(patient.handleInputRows(("a",), iter([_pairs(1, 2)]), state)) == [] and not state.timers
    assert sum(len(f) for f in patient.handleInputRows(("a",), iter([_pairs(0, *range(3, 200))]), state)) == 200
    assert len(state.parts["said"]) == 200 and not state.parts["waiting"]


def test_a_transcript_update_appends_only_the_new_pair():
    """The pairs said before are read, not written again."""
    processor, handle = _processor(None)
    list(processor.handleInputRows(("a",), iter([_pairs(*range(50))]), handle))
    written, said = [], handle.parts["said"]
    said.appendList = written.extend
    (frame,) = processor.handleInputRows(("a",), iter([_pairs(50)]), handle)
    assert len(written) == 1 and frame["caller"][0].count(",") == 50


def test_transcript_restart_continues(spark, scratch):
    """Stopped between two inputs, the stream goes on where it was; a pair that
    waited in state comes out when its gap closes."""
    schema = "conv_id string, seq long, event_ts timestamp, caller array<string>, victim array<string>"
    name = f"transcript_{uuid.uuid4().hex[:8]}"

    def run(*seqs):
        rows = spark.createDataFrame([("a", s, [f"c{s}"], [f"v{s}"]) for s in seqs], "conv_id string, seq long, caller array<string>, victim array<string>")
        rows.withColumn("event_ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))).coalesce(1).write.mode("append").json(f"{scratch}/in")
        jobs.run_stream(jobs.stream_running_transcript(spark.readStream.schema(schema).json(f"{scratch}/in")), name, sink_path=f"{scratch}/out").awaitTermination()
        return sorted((r.prefix_no, r.caller) for r in spark.read.parquet(f"{scratch}/out").collect())

    assert run(0, 2) == [(0, '[["c0"]]')]
    assert run(1) == [(0, '[["c0"]]'), (1, '[["c0"],["c1"]]'), (2, '[["c0"],["c1"],["c2"]]')]
    assert len(run(3)) == 4


def test_audit_rows_are_the_same_on_replay_and_none_for_empty_batches(spark, scratch):
    import os

    rows = spark.createDataFrame([("a", 1, True, 0.9), ("b", 0, False, 0.2), ("c", 1, False, None)], "conv_id string, prediction int, alert boolean, probability double")
    handle = jobs.audit_sink(f"{scratch}/out", f"{scratch}/audit")
    for _ in range(2):
        handle(rows, 7)
    assert spark.read.parquet(f"{scratch}/out").count() == 3
    (audit,) = spark.read.parquet(f"{scratch}/audit").collect()
    assert (audit.n_rows, audit.n_scam, audit.n_alerts, audit.max_probability) == (3, 2, 1, 0.9)
    handle(rows.limit(0), 8)
    assert os.listdir(f"{scratch}/audit") == ["batch_id=7"] and not os.path.exists(f"{scratch}/out/batch_id=8")


def test_stream_verdicts_equal_batch_verdicts_for_every_model(spark, scratch):
    """Every kind decides in the stream as its own predictions do, the SVM too."""
    from pyspark.ml import PipelineModel

    from parley.operators import features as ft
    from parley.operators import train as tr

    rows = [(f"c{i}", i, ["win", "prize", "call"] if i % 2 else ["hello", "mum"], ["yes"] * (1 + i % 3), i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "conv_id string, seq long, caller array<string>, victim array<string>, label int")
    fitted = ft.feature_model(flatten=False).fit(docs)
    data = fitted.transform(docs).cache()
    small = {"logistic_regression": {}, "random_forest": {"numTrees": 5, "maxDepth": 3}, "gbt": {"maxIter": 3}, "linear_svc": {"maxIter": 20}, "mlp": {"layers": [400, 4, 2], "maxIter": 20}}
    docs.drop("label").write.json(f"{scratch}/msgs")
    for kind, params in small.items():
        model = tr.train(kind, data, **params)
        serving = PipelineModel(stages=ft.serving_model(fitted).stages)
        stream = spark.readStream.schema(docs.drop("label").schema).json(f"{scratch}/msgs")
        config = jobs.ScoringConfig(kind)
        jobs.start_scoring(config, stream, serving, f"{kind}_{uuid.uuid4().hex[:8]}", f"{scratch}/{kind}/out", f"{scratch}/{kind}/audit", model=model).awaitTermination()
        out = {r["conv_id"]: r for r in spark.read.parquet(f"{scratch}/{kind}/out").collect()}
        want = {r["conv_id"]: int(r["prediction"]) for r in model.transform(data).collect()}
        assert {k: r["prediction"] for k, r in out.items()} == want and 1 in want.values(), kind
        assert all((r["verdict"] == "scam") == (r["prediction"] == 1) for r in out.values())
        assert all((r["probability"] is None) == (kind == "linear_svc") for r in out.values())
        assert spark.read.parquet(f"{scratch}/{kind}/audit").first()["received_at"] is not None


def test_kafka_shaped_messages_keep_malformed(spark):
    raw = spark.createDataFrame([(b'{"conv_id": "a", "seq": 1, "Attacker_Helper": ["x"], "Victim": []}',), (b"not json",), (None,)], "value binary")
    got = jobs.parse_messages(raw, keep_malformed=True).collect()
    assert [(r["conv_id"], r[jobs.CORRUPT]) for r in got] == [("a", None), (None, "not json"), (None, None)]
    assert jobs.parse_messages(raw).columns == [f.name for f in jobs.MESSAGE.fields]

"""Nulls, ties and hot conversations: the same rows at any partitioning, and
no task that holds a hot key."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from parley.operators import assemble as asm
from parley.plans import all_oracles
from parley.schemas import CALLER, VICTIM

TURNS = "conv_id string, turn long, channel string, text string"


def turn_frame(spark, rows, parts=1):
    return spark.createDataFrame(rows, TURNS).repartition(parts)


def plain_channels(rows):
    """conv_id -> channel -> texts, by turn (null last), then text (null last)."""
    out = {}
    last = lambda x: (x is None, x if x is not None else "")
    for conv, turn, channel, text in sorted(rows, key=lambda r: ((r[1] is None, r[1] or 0), last(r[3]))):
        if channel in (CALLER, VICTIM):
            out.setdefault(conv, {CALLER: [], VICTIM: []})[channel].append(text)
    return out


def some_rows(seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in ("a", "b", None):
        for _ in range(60):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice([CALLER, VICTIM, "system"]), rng.choice([None, "", *"abcdefgh"])))
    return rows + [("only", None, CALLER, "alone"), ("low", -5, CALLER, "x"), ("low", -5, VICTIM, "y")]


ONE_TURN = [("hot", 7, CALLER if i % 2 else VICTIM, f"text {i:04d}") for i in range(600)] + [("hot", None, CALLER, "same")] * 300 + [("hot", None, VICTIM, "same")] * 300


@pytest.mark.parametrize("rows", [some_rows(), ONE_TURN], ids=["nulls and ties", "one turn"])
def test_lists_and_pairs_do_not_depend_on_the_partitions(spark, rows):
    want = plain_channels(rows)
    pairs = sorted(((c, k, x, y) for c, ch in want.items() for k, (x, y) in enumerate(zip(ch[CALLER], ch[VICTIM]))), key=repr)
    for parts in (1, 3, 7):
        turns = turn_frame(spark, rows, parts)
        for params in ({}, {"strategy": "window"}):
            got = asm.pair_turns(turns, **params).select("conv_id", "seq", "caller", "victim").collect()
            assert sorted((tuple(r) for r in got), key=repr) == pairs, (parts, params)
        few = asm.channel_ordinal(turns, chunk=4)  # most chunks are dense here
        again = few.groupBy("conv_id", "channel").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x")).collect()
        assert {(r.conv_id, r.channel): [x.text for x in r.x] for r in again} == {(c, ch): texts for c, both in want.items() for ch, texts in both.items() if texts}
        assert all([x.seq for x in r.x] == list(range(len(r.x))) for r in again)
        lists = {r.conv_id: {CALLER: r.caller, VICTIM: r.victim} for r in asm.assemble_conversations(turns, chunk=8).collect()}
        assert lists == want


def test_transcripts_and_prefixes_keep_rows_without_id_or_turn(spark):
    rows = some_rows(6)
    want = plain_channels(rows)
    turns = turn_frame(spark, rows, 3)
    for chunk in (4, 1024):
        said = asm.running_transcript(turns, chunk=chunk).collect()
        got = {}
        for r in said:
            got.setdefault((r.conv_id, r.channel), []).append(r.transcript)
        assert {k: sorted(v, key=len) for k, v in got.items()} == {(c, ch): [t[: i + 1] for i in range(len(t))] for c, both in want.items() for ch, t in both.items() if t}
        prefixes = {(r.conv_id, r.prefix_no): (r.prefix_id, r.caller, r.victim) for r in asm.conversation_prefixes(asm.pair_turns(turns), chunk=chunk).collect()}
        for c, both in want.items():
            n = min(map(len, both.values()))
            for k in range(n):
                assert prefixes.pop((c, k)) == (None if c is None else f"{c}_{k}", both[CALLER][: k + 1], both[VICTIM][: k + 1])
        assert not prefixes


def test_twins_agree_on_nulls_and_ties(spark, scratch):
    """The registered queries next to their SQL on a table with nulls and ties."""
    from parley.plans import all_queries

    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 2, 2, 3]), rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "b c", "A 1", "z", "running late"])) for _ in range(80)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{scratch}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{scratch}/conversations.parquet/*.parquet'")
    for name in ("pair_turns", "conversation_prefixes", "assemble_conversations", "running_transcript", "lookup_conversation", "fetch_prefix"):
        frame = all_queries()[name](spark, scratch)
        columns = sorted(frame.columns)
        twin = con.sql(f"SELECT {', '.join(columns)} FROM ({all_oracles()[name]})").fetchall()
        assert sorted(map(repr, twin)) == sorted(repr(tuple(r)) for r in frame.select(*columns).collect()), name


def test_a_hot_conversation_is_scanned_in_two_levels(spark):
    """No window runs over the chunks of a key, and what reaches a (key, chunk)
    is only the chunks before it."""
    n, chunk = 400, 16
    pairs = spark.range(n).select(F.lit("hot").alias("conv_id"), F.col("id").cast("int").alias("seq"), F.col("id").cast("string").alias("caller"), F.col("id").alias("victim"))
    grown = asm.growing_lists(pairs, ["conv_id"], "seq", ["caller", "victim"], [], chunk)
    plan = grown._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[[^\n]*", plan)
    assert windows and all("_part" in w for w in windows)
    assert "BroadcastExchange" not in plan or "_last" in plan  # only the counted key table may be broadcast
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        tasks = grown.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(F.size("_caller")).alias("values")).collect()
    finally:
        spark.conf.set(key, before)
    assert sum(t.n for t in tasks) == n and len(tasks) >= 6
    assert max(t.n for t in tasks) <= 8 * chunk
    got = {r.seq: (r._caller, r._victim) for r in grown.collect()}
    assert all(got[k] == ([str(i) for i in range(k + 1)], list(range(k + 1))) for k in range(n))


def test_short_keys_take_no_part_in_the_second_level(spark):
    pairs = spark.range(100).select((F.col("id") % 20).alias("conv_id"), F.floor(F.col("id") / 20).cast("int").alias("seq"), F.col("id").alias("caller"), F.col("id").alias("victim"))
    plan = asm.conversation_prefixes(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1


def test_ranks_of_equal_rows_are_dealt_out(spark):
    rows = spark.range(0, 3000, 1, 5).select(F.struct((F.col("id") % 2).alias("x")).alias("_k"), F.lit(1).alias("turn"), F.lit("same").alias("text"))
    got = asm.ranked(rows, "_k", [F.col("turn").asc_nulls_last(), F.col("text").asc_nulls_last()])
    for r in got.groupBy("_k").agg(F.sort_array(F.collect_list("_rank")).alias("r")).collect():
        assert r.r == list(range(1500))


def test_fetch_prefix_reads_only_its_pairs(spark):
    pairs = spark.createDataFrame([("x_1", k, f"c{k}", f"v{k}") for k in range(5)] + [("y", 0, "c", None)], "conv_id string, seq int, caller string, victim string")
    assert [tuple(r) for r in asm.fetch_prefix(pairs, "x_1_2").collect()] == [("x_1_2", ["c0", "c1", "c2"], ["v0", "v1", "v2"])]
    assert [tuple(r) for r in asm.fetch_prefix(pairs, "y_0").collect()] == [("y_0", ["c"], [None])]
    for wrong in ("x_1_9", "z_0", "x", "", "x_1_-1"):
        assert asm.fetch_prefix(pairs, wrong).collect() == []
    plan = asm.fetch_prefix(pairs, "x_1_2")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "seq" in plan.split("Filter")[-1]

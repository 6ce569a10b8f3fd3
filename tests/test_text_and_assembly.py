"""Hand-written edge cases for cleaning, tokenising, pairing and prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import assemble as asm
from parley.sources import ingest


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_clean_digits_punctuation(spark):
    assert _one(spark, tx.clean_text("x"), "Call 555-01, now!") == "call xxxxx now"


def test_clean_newline_merges_words(spark):
    assert _one(spark, tx.clean_text("x"), "line\nnext") == "linenext"
    assert _one(spark, tx.clean_text("x", separator=" "), "line\nnext") == "line next"


def test_clean_non_ascii(spark):
    assert _one(spark, tx.clean_text("x"), "Étion 12, l'été ٣ 日本") == "étion xx lété x 日本"


def test_null_and_empty(spark):
    assert _one(spark, tx.clean_text("x"), None) == ""
    assert _one(spark, tx.clean_tokens("x"), "") == []
    arr = spark.createDataFrame([(["Ab", None],)], "x array<string>").select(tx.clean_text("x", is_array=True).alias("r")).first()["r"]
    assert arr == ["ab", ""]


def test_flatten_drops_null_and_empty_inner(spark):
    df = spark.createDataFrame([([["a"], []],), ([["a"], None],), (None,)], "x array<array<string>>")
    got = [r["r"] for r in df.select(tx.flatten_tokens("x").alias("r")).collect()]
    assert got == [["a"], ["a"], []]


def test_parse_nested_list_with_none(spark):
    df = spark.createDataFrame([("[['ab'], None]",), ("[['a', 'b'], ['c']]",)], "x string")
    got = [r["r"] for r in df.select(tx.parse_nested_list("x").alias("r")).collect()]
    assert got == [[["ab"], None], [["a", "b"], ["c"]]]


def test_pad_sequences(spark):
    from parley.operators import sequences as sq

    df = spark.createDataFrame([("d", [5], [1, 2, 3, 4])], "conv_id string, caller array<int>, victim array<int>")
    assert sq.padded_sequences(df, 3).first()["ids"] == [0, 0, 5, 2, 3, 4]


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id string, turn long, channel string, text string")


def test_pairing_truncates_to_shorter_and_orders(spark):
    rows = [("c", 0, "caller", "a0"), ("c", 1, "victim", "v0"), ("c", 2, "caller", "a1"), ("c", 3, "victim", "v1"), ("c", 4, "caller", "a2")]
    for strategy in ("chunked", "window"):
        got = sorted(tuple(r) for r in asm.pair_turns(_turns(spark, rows), strategy=strategy).select("seq", "caller", "victim").collect())
        assert got == [(0, "a0", "v0"), (1, "a1", "v1")]


def test_chunked_ordinal_spans_chunks(spark):
    rows = [("h", t, "caller" if t % 3 else "victim", f"t{t}") for t in range(50)]
    small = asm.channel_ordinal(_turns(spark, rows), chunk=4).select("turn", "seq").collect()
    whole = asm.channel_ordinal(_turns(spark, rows), strategy="window").select("turn", "seq").collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, whole))


def test_prefixes_three_turns(spark):
    rows = [("c", 0, "caller", "a"), ("c", 1, "victim", "b"), ("c", 2, "caller", "c"), ("c", 3, "victim", "d"), ("c", 4, "caller", "e"), ("c", 5, "victim", "f")]
    out = asm.conversation_prefixes(asm.pair_turns(_turns(spark, rows))).orderBy("prefix_no").collect()
    assert [r["prefix_id"] for r in out] == ["c_0", "c_1", "c_2"]
    assert [len(r["caller"]) for r in out] == [1, 2, 3]
    assert out[-1]["victim"] == ["b", "d", "f"]


def test_lookup_collapse(spark):
    df = spark.createDataFrame([("x", 0, "u", "hi"), ("x", 1, "a", "yo"), ("y", 0, "u", "z")], "conv_id string, turn long, role string, text string")
    out = {r["conv_id"]: r for r in asm.lookup_conversation(df, "conv_id", ["text"], order_by="turn", exclude=["turn"]).collect()}
    assert out["x"]["text"] == ["hi", "yo"] and out["x"]["role"]["values"] == ["a", "u"] and out["x"]["role"]["scalar"] is None
    assert out["y"]["role"]["scalar"] == "u"
    one = asm.lookup_conversation(df, "conv_id", ["text"], order_by="turn", value="y", exclude=["turn"]).collect()
    assert len(one) == 1


def test_fetch_prefix(spark):
    rows = [("c", 0, "caller", "a"), ("c", 1, "victim", "b"), ("c", 2, "caller", "c"), ("c", 3, "victim", "d")]
    pre = asm.conversation_prefixes(asm.pair_turns(_turns(spark, rows)))
    got = asm.fetch_prefix(pre, "c_1").collect()
    assert len(got) == 1 and got[0]["caller"] == ["a", "c"]


def test_ingest_json_and_rejects(spark):
    good = '{"1": {"Attacker": "give pin", "Victim": "ok"}, "2": {"Attacker": "now", "Victim": "no"}}'
    normal = '{"1": {"Helper": "hello", "Victim": "hi"}}'
    df = spark.createDataFrame([("a", good, "vishing"), ("b", normal, "normal"), ("c", "not json", "vishing")], "conv_id string, response string, conversation_type string")
    turns, rejects = ingest.ingest_conversation_json(df)
    got = sorted(tuple(r) for r in turns.select("conv_id", "seq", "caller", "victim", "label").collect())
    assert got == [("a", 0, "give pin", "ok", 1), ("a", 1, "now", "no", 1), ("b", 0, "hello", "hi", 0)]
    assert [r["conv_id"] for r in rejects.collect()] == ["c"]


def test_conversation_key_is_deterministic(spark):
    df = spark.createDataFrame([("hello",), ("hello",), ("other",)], "t string")
    keys = [r["k"] for r in df.select(ingest.conversation_key("t").alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 14


def test_profile(spark):
    df = spark.createDataFrame([("a", None), (None, 1)], "s string, n int")
    got = {r["column"]: (r["n_rows"], r["n_nulls"], r["n_cols"]) for r in ingest.dataset_profile(df).collect()}
    assert got == {"s": (2, 1, 2), "n": (2, 1, 2)}


def test_write_read_roundtrip_and_append(spark, scratch):
    from parley.sources import io

    df = spark.createDataFrame([("c", 0, "a", "b", 1)], "conv_id string, seq int, caller string, victim string, label int")
    io.write_dataset(df, f"{scratch}/ds")
    io.append_conversations(df, f"{scratch}/ds")
    assert io.read_conversations(spark, f"{scratch}/ds").count() == 2
    nested = spark.createDataFrame([("c", [["a"]])], "conv_id string, caller array<array<string>>")
    io.write_dataset(nested, f"{scratch}/csv", fmt="csv")
    back = spark.read.option("header", "true").option("escape", '"').csv(f"{scratch}/csv").first()
    assert back["caller"] == '[["a"]]'
    assert F  # keep import used


def test_hot_conversation_is_spread_and_exact(spark):
    """All of sf0.01's conversations folded into ONE conversation: the chunked
    ordinal must give the same pairs as the single-window plan, while the
    hot key's rows are numbered in several tasks."""
    from parley.sources.tables import conversation_turns
    from tests.conftest import SF01

    hot = conversation_turns(spark, SF01).select(
        F.lit("hot").alias("conv_id"), (F.col("conv_id").cast("long") * 100 + F.col("turn")).alias("turn"), "channel", "text"
    )
    chunked = asm.pair_turns(hot, strategy="chunked")
    window = asm.pair_turns(hot, strategy="window")
    a = sorted(tuple(r) for r in chunked.select("seq", "caller", "victim").collect())
    b = sorted(tuple(r) for r in window.select("seq", "caller", "victim").collect())
    assert a == b and len(a) > 200
    # Observe task placement without AQE merging the (tiny) partitions.
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        # ``seq`` is aggregated so the numbering step is not pruned away.
        def tasks(df):
            return len(df.groupBy(F.spark_partition_id().alias("p")).agg(F.max("seq")).collect())

        spread_tasks = tasks(asm.channel_ordinal(hot, chunk=256))
        single = tasks(asm.channel_ordinal(hot, strategy="window"))
    finally:
        spark.conf.set(key, before)
    assert single == 1 and spread_tasks > 1


def test_document_line_pairs_equal_generic_pairing(spark):
    from parley.sources.tables import document_line_pairs, document_turns
    from tests.conftest import SF001

    fast = sorted(tuple(r) for r in document_line_pairs(spark, SF001).select("conv_id", "seq", "caller", "victim", "label").collect())
    generic = sorted(
        tuple(r) for r in asm.pair_turns(document_turns(spark, SF001), carry=["label"]).select("conv_id", "seq", "caller", "victim", "label").collect()
    )
    assert fast == generic and len(fast) > 0


def test_assembly_keeps_whole_texts(spark):
    """No line is lost to an unequal or one-sided conversation."""
    from parley.sources.tables import document_channels, labelled_documents
    from tests.conftest import SF01

    docs = document_channels(spark, SF01).select("conv_id", (F.size("caller") + F.size("victim")).alias("n"))
    lines = labelled_documents(spark, SF01).select(F.col("doc_id").cast("string").alias("conv_id"), F.size(F.split("text", "\n")).alias("want"))
    joined = docs.join(lines, "conv_id")
    assert joined.count() == lines.count() and joined.where("n <> want").count() == 0
    turns = spark.createDataFrame([("a", t, "caller", f"x{t}") for t in range(5)] + [("a", 9, "victim", "y"), ("b", 0, "victim", "z")], "conv_id string, turn long, channel string, text string")
    got = {r["conv_id"]: (r["caller"], r["victim"]) for r in asm.assemble_conversations(turns, chunk=2).collect()}
    assert got == {"a": ([f"x{t}" for t in range(5)], ["y"]), "b": ([], ["z"])}


def test_line_pairing_is_linear(spark):
    """Twice the lines take about twice the time, not four times."""
    import time

    from parley.sources import tables

    def seconds(n):
        df = spark.createDataFrame([(1, "line of text\n" * n)], "doc_id long, text string").cache()
        df.count()
        lines = F.split("text", "\n")
        channels = df.select(F.filter(lines, lambda x, i: i % 2 == 0).alias("caller"), F.filter(lines, lambda x, i: i % 2 == 1).alias("victim"))
        best = 1e9
        for _ in range(3):
            t = time.perf_counter()
            channels.select(F.posexplode(F.arrays_zip("caller", "victim"))).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        return best

    assert tables.document_line_pairs
    seconds(20_000)
    assert seconds(80_000) < 3.2 * seconds(40_000) + 0.2


def test_hot_lists_are_chunked_and_exact(spark):
    """One conversation holds everything: prefixes, transcripts and lists equal
    the single-window results and are made in several tasks."""
    from parley.sources.tables import conversation_turns
    from tests.conftest import SF01

    hot = conversation_turns(spark, SF01).select(
        F.lit("hot").alias("conv_id"), (F.col("conv_id").cast("long") * 100 + F.col("turn")).alias("turn"), "channel", "text"
    )
    pairs = asm.pair_turns(hot).cache()
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        prefixes = asm.conversation_prefixes(pairs, chunk=16)
        got = {r["prefix_no"]: (r["caller"], r["victim"]) for r in prefixes.collect()}
        ordered = [(r["caller"], r["victim"]) for r in pairs.orderBy("seq").collect()]
        assert len(got) == len(ordered) > 200
        for k in (0, 15, 16, 17, 100, len(ordered) - 1):
            assert got[k] == ([c for c, _ in ordered[: k + 1]], [v for _, v in ordered[: k + 1]])
        tasks = prefixes.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.size("caller"))).count()
        assert tasks > 1
        lists = asm.assemble_conversations(hot, chunk=16).first()
        for ch in ("caller", "victim"):
            assert lists[ch] == [r["text"] for r in hot.where(F.col("channel") == ch).orderBy("turn").collect()]
        said = {(r["channel"], r["turn"]): r["transcript"] for r in asm.running_transcript(hot, chunk=16).collect()}
        for (ch, _), t in said.items():
            assert t == lists[ch][: len(t)]
        assert max(map(len, said.values())) == max(len(lists["caller"]), len(lists["victim"]))
    finally:
        spark.conf.set(key, before)
        pairs.unpersist()


def test_text_labels(spark):
    valid, rejects, counts = ingest.cast_labels(spark.createDataFrame([("1",), ("x",), (None,), ("0",)], "raw_label string"))
    assert sorted(r["label"] for r in valid.collect()) == [0, 1] and rejects.count() == 2
    assert tuple(counts.first()) == (2, 2)


def test_read_csv_with_fixed_schema_and_multiline_cells(spark, scratch):
    from parley.sources import io

    with open(f"{scratch}/turns.csv", "w") as fh:
        fh.write('conv_id,seq,caller,victim,label\n')
        fh.write('c1,0,"hello, ""there""","line one\nline two",1\n')
        fh.write("c1,1,bye,ok,1\n")
    rows = io.read_conversations(spark, f"{scratch}/turns.csv", fmt="csv").orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [0, 1]
    assert rows[0]["caller"] == 'hello, "there"' and rows[0]["victim"] == "line one\nline two"
    assert rows[0]["label"] == 1


def test_content_key_order_aware_and_row_order_free(spark):
    rows = [("a", 0, "hello"), ("a", 1, "world"), ("b", 0, "world"), ("b", 1, "hello")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, text string")
    keys = {r["conv_id"]: r["conv_key"] for r in ingest.conversation_content_key(df).collect()}
    shuffled = spark.createDataFrame(list(reversed(rows)), "conv_id string, turn long, text string").repartition(3)
    again = {r["conv_id"]: r["conv_key"] for r in ingest.conversation_content_key(shuffled).collect()}
    assert keys == again and keys["a"] != keys["b"] and len(keys["a"]) == 28

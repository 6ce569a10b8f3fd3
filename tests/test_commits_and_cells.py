"""Repeatable append, and list-literal cells."""

from __future__ import annotations

import ast
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.schemas import RAW_TURNS
from parley.sources import commits

ROWS = [("a", 0, "hi", "who", 1), ("a", 1, None, "", 1), ("b", 0, "x", "y", None)]


def batch(spark, rows, parts=1):
    return spark.createDataFrame(rows, RAW_TURNS).repartition(parts)


def stored(spark, path):
    return sorted((tuple(r) for r in commits.read_batches(spark, path, RAW_TURNS).collect()), key=repr)


def test_the_same_batch_twice_adds_nothing(spark, scratch):
    path = f"{scratch}/ds"
    assert stored(spark, path) == [] and commits.commits(spark, path).count() == 0
    key = commits.append_batch(batch(spark, ROWS), path)
    assert key and commits.append_batch(batch(spark, ROWS[::-1], 3), path) is None
    assert stored(spark, path) == sorted(ROWS, key=repr)
    more = [("c", 0, "z", "z", 0)]
    assert commits.append_batch(batch(spark, more), path)
    assert stored(spark, path) == sorted(ROWS + more, key=repr)
    assert {(r.key, r.n_rows) for r in commits.commits(spark, path).collect()} >= {(key, 3)}
    assert commits.append_batch(batch(spark, ROWS + ROWS), path)  # other rows: each of them twice
    assert len(stored(spark, path)) == 10


def test_keys_tell_contents_apart(spark):
    frames = [
        spark.createDataFrame(rows, "k string, v string")
        for rows in ([("a", "b")], [("ab", "")], [("a", None)], [("a", "-")], [("a", "null")], [("b", "a")], [("a", "b"), ("a", "b")], [], [(None, None)], [("1:a", "b")])
    ]
    keys = [commits.batch_key(f)[0] for f in frames]
    assert len(set(keys)) == len(keys)
    assert commits.batch_key(frames[0].select("v", "k")) == commits.batch_key(frames[0])
    nested = spark.createDataFrame([([["a"], None],)], "x array<array<string>>")
    assert commits.batch_key(nested) == commits.batch_key(nested) != commits.batch_key(spark.createDataFrame([([["a"]],)], "x array<array<string>>"))


def test_a_killed_writer_leaves_nothing_visible(spark, scratch, monkeypatch):
    path = f"{scratch}/ds"
    commits.append_batch(batch(spark, ROWS[:1]), path)

    def killed(self, name, content):
        raise KeyboardInterrupt

    monkeypatch.setattr(commits._Folder, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        commits.append_batch(batch(spark, ROWS), path)
    assert stored(spark, path) == ROWS[:1]
    assert len([d for d in os.listdir(path) if d.startswith("batch-")]) == 2  # written, never committed
    monkeypatch.undo()
    assert commits.append_batch(batch(spark, ROWS), path) and len(stored(spark, path)) == 4


def test_two_writers_both_land_and_one_of_a_pair_does(spark, scratch):
    path = f"{scratch}/ds"
    jobs = [ROWS, [("d", 0, "1", "2", 0)], ROWS, [("e", 0, "1", "2", 0)]]
    with ThreadPoolExecutor(4) as pool:
        keys = list(pool.map(lambda rows: commits.append_batch(batch(spark, rows), path), jobs))
    assert keys[1] and keys[3] and sorted(k is None for k in (keys[0], keys[2])) == [False, True]
    assert stored(spark, path) == sorted(ROWS + jobs[1] + jobs[3], key=repr)
    folder = commits._Folder(spark, path)
    assert folder.publish("x.json", "{}") and not folder.publish("x.json", "{}")


# -- list-literal cells ---------------------------------------------------------


def parsed(spark, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, cell string")
    valid, rejects = tx.split_nested_list(df, "cell", "parsed")
    out = {r.i: r.parsed for r in valid.collect()}
    assert {r.i for r in rejects.collect()} == set(range(len(cells))) - set(out)
    return [out.get(i) for i in range(len(cells))]


def test_cells_of_every_kind(spark):
    cells = [
        r"[['say, None, ok']]",
        r"[['caf\xe9', 'a\tb', 'it\'s', 'back\\slash', 'é\U0001f642\101']]",
        "[[\"it's\", 'a \"word\"'], None, [None, 'x']]",
        "[['a',], ['b', 'c',],]",
        "[]",
        "[[]]",
        "[None, None]",
        "[ [ 'a' ,\n 'b' ] ]",
        r"[['a]', '[b', ',', 'None', '\'']]",
        r"[['\d']]",
        "[['é日🙂']]",
        "[['" + "long " * 50_000 + "']]",
        "[[" + ", ".join(["'w'"] * 20_000) + "]]",
    ]
    got = parsed(spark, cells)
    for cell, value in zip(cells, got):
        assert value == ast.literal_eval(cell.replace(r"\d", r"\\d")), cell[:60]


def test_malformed_cells_are_rejects(spark):
    cells = ["", "x", "[['a'", "[['a']", "['a']", "[['a'], 'b']", "[[['a']]]", "[['a' 'b']]", "[['a']] x", "[[a]]", "[[1]]", "[['a\\x4']]", "[['\\ud83d']]", "[['a]]", "[[,]]", "[['a',,'b']]", "(['a'],)", "{'a': 1}", "[[u'a']]", "[['a'] ['b']]", "None", "[[\"a']]", "[['\\U00110000']]"]
    assert parsed(spark, cells) == [None] * len(cells)
    assert parsed(spark, [None]) == [[]]


def test_cells_are_parsed_once(spark):
    """Both halves read the parsed cells; neither plan parses them again."""
    df = spark.createDataFrame([(1, "[['a']]"), (2, "[['a'"), (3, None)], "id int, cell string")
    halves = tx.split_nested_list(df, "cell", "parsed")
    assert all("regexp_extract_all" not in h._jdf.queryExecution().optimizedPlan().toString() for h in halves)
    assert [sorted(r.id for r in h.collect()) for h in halves] == [[1, 3], [2]]


def test_rendered_cells_come_back(spark):
    rng = random.Random(8)
    alphabet = "ab'\"\\,[] \n\r\tNone{}é日\x0b "
    word = lambda: None if rng.random() < 0.1 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6)))
    values = [[None if rng.random() < 0.1 else [word() for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 4))] for _ in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<array<string>>")
    out = df.select("i", tx.render_nested_list("v").alias("cell")).withColumn("back", tx.parse_nested_list("cell")).collect()
    for r in out:
        assert r.back == values[r.i], r.cell
        assert ast.literal_eval(r.cell) == values[r.i]


def test_registered_dataset_is_repeatable(spark):
    from parley.plans import all_queries
    from tests.conftest import SF001

    out = all_queries()["append_conversations"](spark, SF001)
    assert {r.n_batches for r in out.select("n_batches").distinct().collect()} == {2}
    assert out.count() == all_queries()["pair_turns"](spark, SF001).count()
    assert out.where(F.col("caller").isNull()).count() == 0

"""Brute-force and round-trip tests of hard negatives, id planes and the filter audit."""

from __future__ import annotations

import glob
import io
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import gnat, interactions, planes
from parley.llm.common import cut, spread_join

VECTORS = "vec_id long, embedding array<double>, label int, a string, place int"


# -- 11 hard negatives --------------------------------------------------------


def plain_negatives(rows, every=50):
    """``rows``: (vec_id, vector, label); exact integers, one loop per anchor."""
    part = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(256 * x) for x in v):
            continue
        label = math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label
        part.append((i, [math.floor(256 * x) for x in v], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (i, v, label) in enumerate(part):
        if i is None or i % every:
            continue
        score = lambda w, v=v: sum(a * b for a, b in zip(v, w))
        ranked = sorted(((-score(w), last(j), j, other) for m, (j, w, other) in enumerate(part) if m != k), key=lambda r: r[:2])
        for s, _, j, _ in [r for r in ranked if r[3] == label][:5]:
            fits = [(t, n) for t, _, n, other in ranked if other != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fits[:3], 1)]
    return out


def as_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def vector_rows(seed, n, dim=8, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    return [(int(i), (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)


def test_hard_negatives_equal_the_plain_loop(spark):
    rows = vector_rows(1, 900)
    hot = rows[50][1]
    rows += [(1000 + i, hot, 1) for i in range(500)]  # a third of all rows: one vector
    rows += [(2000 + i, hot, 2) for i in range(40)] + [(1050, hot, 1), (1050, hot, 1), (1100, rows[3][1], 1)]
    rows += [(3000, None, 1), (3050, [0.1] * 8, None), (3100, [0.1, None] * 4, 1), (3150, [float("nan")] * 8, 1), (3200, [float("inf")] * 8, 1)]
    rows += [(None, hot, 1), (None, hot, 2), (None, rows[7][1], 3), (3300, [], 1), (3350, hot[:3], 2), (3400, [0.0] * 8, 0), (-50, [-x for x in hot], 2), (0, hot, 3)]
    got = gnat.hard_negatives(vector_frame(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert as_rows(got) == sorted(plain_negatives(rows), key=repr)


def test_hard_negatives_of_long_vectors_are_exact(spark):
    rng = random.Random(4)
    rows = [(25 * i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(0, 5) for _ in range(4)], i % 3) for i in range(80)]
    rows += [(7000 + 50 * i, [3e6 + i / 256, 2e6 + 1 / 3, 1.0, -5e5], i % 2) for i in range(12)]  # products beyond 2**53
    assert as_rows(gnat.hard_negatives(vector_frame(spark, rows))) == sorted(plain_negatives(rows), key=repr)
    huge = [(50 * i, [1e300, 1.0 + i], i % 2) for i in range(4)]  # scores stop at the limits of a long
    found = gnat.hard_negatives(vector_frame(spark, huge)).collect()
    assert all(abs(r.positive_score) <= gnat.TOP for r in found)


def test_hard_negatives_without_rows_or_partners(spark):
    assert gnat.hard_negatives(vector_frame(spark, [])).count() == 0
    assert gnat.hard_negatives(vector_frame(spark, [(50, [1.0], 1)])).count() == 0
    assert gnat.hard_negatives(vector_frame(spark, [(50, [], 1), (51, [], 1), (52, [], 2)])).count() == 1


def test_the_tree_skips_siblings_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(gnat, "LEAF", 16)
    rows = vector_rows(2, 3000, spread=0.1)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    labels = np.array([label for _, _, label in rows], np.int64)
    tree = gnat.Tree(x, np.arange(3000), labels, (labels, labels))
    q = x[:40]
    scores = gnat.products(q, x)
    low, high = scores[:, :1] // 2, np.full((40, 1), 60_000)
    got = {}
    for query, _, place, score in tree.search(q, labels[:40], low, high, 3, False).tolist():
        got.setdefault(query, []).append((-score, place))
    for k in range(40):
        fits = [(-int(scores[k, j]), j) for j in range(3000) if labels[j] != labels[k] and low[k, 0] <= scores[k, j] <= 60_000]
        assert sorted(got.get(k, [])) == sorted(fits)[:3]
    assert tree.skipped > 0.3 * tree.seen


def test_spread_join_deals_hot_and_null_keys(spark):
    left = cut(spark.range(5000).select(F.when(F.col("id") < 3000, 1).when(F.col("id") < 4000, None).otherwise(F.col("id")).alias("k"), "id"))
    right = spark.createDataFrame([(1, "one"), (4500, "x"), (9, "none")], "k long, v string")
    joined = spread_join(left, right, ["k"], "left", per=100)
    assert joined.count() == 5000 and joined.columns == ["k", "id", "v"]
    assert {(r.v, r["count"]) for r in joined.groupBy("v").count().collect()} == {("one", 3000), ("x", 1), (None, 1999)}
    assert spread_join(left, right, ["k"], per=100).count() == 3001


# -- 12 id planes ----------------------------------------------------------------

TEXTS = [None, "", " ", "  two  blanks ", "line\nnext\n\n  more \n", "tab\t x\r\n y", "don't we'll I'm 'S", "laño leñezado, Étion12 日本 语 ٣ naïve", "a" * 3000, "12abc34 x_y-z (a) \"b\" ...!? &&& |||", "<|endoftext|> as text <|endoftext|>", "nbsp  x  y\x1c z​ q", "é combining àb", "🙂🙂 ok🙂no", "\n", "x " * 500]


@pytest.fixture(scope="module")
def tokenizer():
    return planes.default_tokenizer()


def plain_ids(tokenizer, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_encode_like_whole_texts(tokenizer, monkeypatch):
    own = planes.Encoder(tokenizer)
    assert own.by_piece
    rng = random.Random(6)
    alphabet = "abzABZ0189 \n\t\r'\".,;:!?|_-()ñßéÉ日٣½²🙂 ́​\x1c"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)]
    assert got == [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(planes, "CACHE", 50)
    again = [np.frombuffer(b, "<u4").tolist() for at in range(0, len(texts), 100) for b in own.encode(texts[at : at + 100])]
    assert again == got
    assert not planes.Encoder(tokenizer, special=True).by_piece
    assert np.frombuffer(planes.Encoder(tokenizer, special=True).encode(["<|endoftext|>"])[0], "<u4").tolist() == [50256]


def test_pieces_that_come_again_are_not_forgotten(tokenizer, monkeypatch):
    """A full cache forgets the pieces that were not met for long, not all."""
    monkeypatch.setattr(planes, "CACHE", 20)
    own, learnt = planes.Encoder(tokenizer), []
    learn = own._learn
    own._learn = lambda new: learnt.extend(new) or learn(new)
    for k in range(40):
        own.encode([f"x common{'abcdefgh'[k % 8]}{'ijklm'[k // 8]} word"])
    assert learnt.count(" word") == 1 and len(own.known) + len(own.older) <= 40


def test_columns_are_cut_and_encoded_like_texts(tokenizer, monkeypatch):
    """Pieces are cut in the column's bytes, and a word that is known is not learnt again."""
    piece = re.compile(r"[ \n]*+(?:[A-Za-z]++(?![^\x00-\x7f])|[^ \n]++)|[ \n]++")
    rng = random.Random(8)
    texts = ["".join(rng.choice("abzAZ01 \n\t\r'.,-é日\xa0\u3000🙂ς\x85\x1c") for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    raw = [t.encode() for t in texts]
    starts, odd = planes.cut_places(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    assert starts.tolist() == [0, *np.cumsum([len(p.encode()) for t in texts for p in piece.findall(t)])[:-1].tolist()]
    assert {i for i, t in enumerate(texts) if planes._ODD_SPACE.search(t)} <= set(odd.tolist())
    own = planes.Encoder(tokenizer)
    wanted = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    column = pa.array(["zz first", *texts]).slice(1)
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_column(column)] == wanted
    monkeypatch.setattr(own, "_learn", None)
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_column(column)] == wanted
    monkeypatch.setattr(planes, "TEXT_BYTES", 100)
    batch = pa.record_batch([column, column], names=["doc_id", "text"])
    parts = list(planes.slices(batch))
    assert len(parts) > 100 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [np.frombuffer(b, "<u4").tolist() for b in planes.Encoder(tokenizer).encode(["", "a"])] == [[], [64]]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    own = planes.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not own.by_piece
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(["Hello, World", ""])] == [e.ids for e in own.tokenizer.encode_batch(["Hello, World", ""], add_special_tokens=False)]


@pytest.mark.parametrize("unit", [1, 8])
def test_planes_of_any_block_come_back(unit):
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        found = planes.to_planes(ids, unit)
        assert len(found) == 32 // unit and planes.from_planes(found, n, unit).tolist() == ids.tolist()
    if unit == 1:
        assert planes.to_planes(np.array([1, 2, 3], np.uint32), 1)[:3] == [b"\x05", b"\x06", b"\x00"]
    else:
        assert planes.to_planes(np.array([0x01020304, 5], np.uint32), 8) == [b"\x04\x05", b"\x03\x00", b"\x02\x00", b"\x01\x00"]


def test_a_damaged_file_is_noticed():
    class Sink(io.BytesIO):
        def close(self):
            pass

    sink = Sink()
    writer = planes.Writer(sink, 8, 100)
    for i, n in enumerate((0, 1, 350, 49, 20)):
        writer.add(i if i else None, np.arange(n, dtype="<u4").tobytes())
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    raw = sink.getvalue()
    found = list(planes.Reader(Source(raw)).documents())
    assert [(i, at, len(x)) for i, at, x in found] == [(None, 0, 0), (1, 0, 1), (2, 1, 350), (3, 351, 49), (4, 400, 20)]
    assert found[2][2].tolist() == list(range(350))
    whole = [x for _, _, ids in found for x in ids.tolist()]
    for a, b in ((0, 420), (99, 101), (150, 150), (399, 10_000)):
        assert planes.read_range(Source(raw), a, b).tolist() == whole[a:b]
    for at in range(16, len(raw) - planes._TAIL.size, 7):
        broken = bytearray(raw)
        broken[at] ^= 0xFF
        with pytest.raises((ValueError, MemoryError)):
            list(planes.Reader(Source(bytes(broken))).documents())
    with pytest.raises(ValueError):
        planes.Reader(Source(raw[:-3]))


@pytest.mark.parametrize("unit", [1, 8])
def test_tokens_come_back_in_order(spark, scratch, tokenizer, unit):
    rows = [(500 - i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (7, "same"), (7, "same"), (7, "other"), (3, "word " * 30_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, start int").repartition(3)
    manifest = planes.write_tokens(docs, scratch, tokenizer, unit=unit, block=64, file_ids=500)
    got = planes.read_tokens(manifest, scratch).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows if i is not None)) + [None, None]
    expected = {}
    for i, t in rows:
        expected.setdefault(i, []).append(plain_ids(tokenizer, t))
    at = 0
    for r in got:
        assert r.ids in expected[r.doc_id]
        expected[r.doc_id].remove(r.ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    assert not any(expected.values()) and manifest.count() > 3
    # The order does not depend on the partitions.
    again = planes.round_trip(docs.repartition(7), tokenizer, block=1000).orderBy("start").collect()
    assert [tuple(r) for r in again] == [tuple(r)[:4] for r in got]


def test_an_absent_or_other_file_raises(spark, scratch, tokenizer):
    import os

    docs = spark.createDataFrame([(i, "some text " * i) for i in range(50)], "doc_id long, text string")
    manifest = planes.write_tokens(docs, scratch, tokenizer, file_ids=100)
    names = sorted(glob.glob(f"{scratch}/*.ids"))
    os.truncate(names[0], 10)
    with pytest.raises(Exception, match="cut off"):
        planes.read_tokens(manifest, scratch).collect()
    with pytest.raises(Exception, match="(?i)no such file"):
        planes.read_tokens(manifest.withColumn("name", F.concat("name", F.lit("x"))), scratch).collect()


def test_tokens_of_an_empty_table(spark, tokenizer):
    empty = spark.createDataFrame([], "doc_id long, text string")
    got = planes.round_trip(empty, tokenizer)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0


# -- 13 filter audit ------------------------------------------------------------


def plain_audit(docs, labels):
    import re

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals = len(re.findall("[A-Z]", text))
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        failed = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * capitals > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": copy}
        rows.append((source or "", {f for f, bad in failed.items() if bad}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in mine)
                total[f] += len(gone)
                steps.append((part, order, step, len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def test_the_audit_equals_removal_one_by_one(spark):
    rng = random.Random(9)
    some = lambda n, k: " ".join(rng.choice("abcdefghij") * rng.randint(1, k) for _ in range(n))
    texts = [some(rng.randint(0, 120), rng.choice([1, 30])) + rng.choice(["", "", " $", " CAPITALS AND MORE " * 9]) for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(300)]
    docs += [(3, texts[0], "a"), (3, texts[0], "a"), (None, texts[0], "a"), (None, None, None), (400, None, "c"), (401, "", "c"), (402, "É日 x " * 60, "c"), (403, "w " * 50_000 + "W" * 10, "c"), (2, texts[1], "b")]
    docs += [(500, texts[2], "hot")] * 200
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 300, 2)] + [(3, 0, 0), (3, 1, 1), (None, 1, 1), (9999, 1, 1), (500, None, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, n int, mask string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.audit(frame, truth)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(docs, labels)
    assert interactions.audit(frame.limit(0), truth).count() == 0
    assert interactions.audit(frame.where("source = 'c'"), truth.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_potentials_of_a_known_game(spark):
    # Three documents failing {A}, {A, B} and {C, D, E}: A gets 1 + 1/2, B 1/2, the others 1/3 each.
    worth = lambda s: int(bool(s & 1)) + int(bool(s & 3)) + int(bool(s & 28))
    frame = spark.createDataFrame([([worth(s) for s in range(32)],)], "w array<long>")
    p = frame.select(interactions.potentials(F.col("w")).alias("p")).first().p
    assert [p[31] - p[31 - (1 << i)] for i in range(5)] == [90, 30, 20, 20, 20]

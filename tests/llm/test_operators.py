"""Small-fixture and brute-force tests of the training-data operators."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import chat, chunks, decontaminate, egojoin, licenses, mixture, pii, quality, simhash, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    full = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


EDGE = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "word " * 30_000, "b"), (6, "x" * 100_000, "a"), (7, "same text here", "b"), (7, "same text here", "b"), (None, "no id at all", "a")]


# -- connected components ---------------------------------------------------


def test_components_of_a_long_chain_and_a_star(spark):
    from parley.llm.common import pairs_to_components

    pairs = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.component for r in pairs_to_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {1000 + i: 1000 for i in range(40)}
    assert pairs_to_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 8 SimHash ----------------------------------------------------------------


def plain_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(values, linked):
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if linked(a, b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    rows = list(EDGE[:-1])
    for i in range(60):
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(300)] = f"w{rng.randint(0, 400)}"
        rows.append((100 + i, " ".join(words).upper() if i % 2 else " ".join(words), "s"))
    got = simhash.simhash_near_duplicates(docs_frame(spark, rows), tree_size=8).collect()
    prints = {}
    for i, t, _ in rows:
        prints[i] = plain_simhash(t)
    assert all(r.fp & (2**64 - 1) == prints[r.doc_id] for r in got)
    want = plain_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(got) == len(rows)


def test_simhash_links_random_fingerprints_within_the_radius(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(40):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [v - 2**64 if v >> 63 else v for v in values]
    classes = spark.createDataFrame([(v,) for v in signed], "fp long")
    from parley.llm.common import pairs_to_components

    got = {r.node: r.component for r in pairs_to_components(simhash.near_links(classes, tree_size=4)).collect()}
    want = plain_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {v: got.get(v, v) for v in signed} == want


def test_bk_tree_finds_everything_within_the_radius():
    rng = random.Random(1)
    tree, values = simhash.BKTree(), [rng.getrandbits(12) for _ in range(300)]
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 97):
        assert sorted(tree.values[i] for i in tree.search(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_simhash_stage_keeps_one_of_each(spark):
    kept = simhash.keep_one_of_each(docs_frame(spark, EDGE).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x")))
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    # Null, empty and blank texts share fingerprint zero.
    assert ids == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (True, None)]
    assert simhash.keep_one_of_each(docs_frame(spark, [])).count() == 0


# -- 10 decontamination -------------------------------------------------------


def plain_contaminated(docs, items, threshold=0.8):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for item, it in items:
        b = split(it)
        if not b:
            continue
        k = min(5, len(b))
        bs = [" ".join(b[i : i + k]) for i in range(len(b) - k + 1)]
        for doc, t in docs:
            d = split(t)
            if not set(bs) & {" ".join(d[i : i + k]) for i in range(len(d) - k + 1)}:
                continue  # no common shingle: every window has similarity 0
            for s in range(max(1, len(d) - len(b) + 1)):
                w = d[s : s + len(b)]
                ws = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
                if not ws:
                    continue
                m = sum(min(ws.count(x), bs.count(x)) for x in set(ws))
                sim = m / (len(ws) + len(bs) - m)
                if sim >= threshold:
                    best = out.get((doc, item), (0, 0, 0))
                    out[doc, item] = (max(best[0], sim), s + 1 if sim > best[0] else best[1], best[2] + 1)
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 60)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 8, 20, 40, 40, 60])] + [(20, None), (21, ""), (22, "?!")]
    items.append((23, "la la la la la la la la la la la la"))
    docs = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 80))]
        passage = (items[i % 7][1]).split()
        if i % 3:
            if i % 4 == 1 and len(passage) > 20:
                passage[-1] = "changed"
            if i % 5 == 2 and len(passage) > 20:
                passage = passage[1:]
            at = rng.randint(0, len(words))
            words[at:at] = [p.upper() + "," for p in passage]
        docs.append((i, " ".join(words)))
    # Documents shorter than an item are one window.
    docs += [(200 + i, " ".join(items[6][1].split()[i % 4 : 60 - i])) for i in range(16)]
    docs += [(220 + i, " ".join(items[3][1].split()[: 20 - i])) for i in range(6)]
    docs += [(100, None), (101, ""), (102, "la " * 500), (103, items[4][1]), (103, items[4][1]), (104, items[6][1].rsplit(" ", 2)[0])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_windows) for r in decontaminate.contaminated(frame, bench).collect()}
    want = plain_contaminated(docs[:-2] + docs[-1:], items)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][0] == pytest.approx(v[0]) and got[k][1] == v[1], k
    clean = decontaminate.drop_contaminated(frame, bench)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_rows_without_or_with_shared_ids_have_their_own_fate(spark):
    rng = random.Random(21)
    some = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(60))
    item, a, b, c, near = some(), some(), some(), some(), some()
    frame = docs_frame(spark, [(None, item, "a"), (None, a, "a"), (7, f"{b} {item}", "a"), (7, b, "a"), (8, c, "a")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {(r.doc_id, r.text) for r in decontaminate.drop_contaminated(frame, bench).collect()} == {(None, a), (7, b), (8, c)}
    # One id with texts in two groups, one of them copied by a later id.
    frame = docs_frame(spark, [(7, a, "a"), (7, a, "a"), (7, near, "a"), (8, near, "a"), (9, c, "a"), (6, b, "a"), (7, b, "a")])
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one_of_each(frame).collect()) == sorted([(7, a), (7, near), (9, c), (6, b)])


def test_decontamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(d, b).count() == 0
    assert decontaminate.contaminated(d.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


# -- 6 mixture ------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: 2 * sizes[s] for s in over}


def test_mixture_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["hot"] * 6 + ["a", "b", "É", None, "zz"])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "nothing"), (None, "no id", "b"), (7000, "twice", "b"), (7000, "twice", "b")]
    frame = docs_frame(spark, rows).withColumn("size", F.lit("clash")).withColumn("h", F.lit(0)).withColumn("target", F.lit(0))
    got = mixture.mix(frame).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in taken.items():
        assert abs(t - want[s]) <= 90
    assert sorted(map(str, mixture.mix(frame).collect())) == sorted(map(str, got))
    assert mixture.mix(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["no ids", "equal rows", "long text"])
def test_mixture_takes_every_row_by_itself(spark, kind):
    """Nine tenths without id, or one row in many copies: every source still
    ends within one document of its target, in the query and in the stage."""
    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 30)))
    rows = [(None if rng.random() < 0.9 else rng.randint(0, 5), text(), rng.choice("aabc")) for _ in range(600)]
    if kind == "equal rows":
        rows = rows[:100] + [(7, "one two three four five", "a")] * 500 + [(None, None, None)] * 50
    if kind == "long text":
        rows = rows[:50] + [(8, "word " * 200_000, "a"), (None, "word " * 100_000, "b")]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    most = {s: max(len((t or "").split()) for _, t, o in rows if o == s) for s in sizes}
    frame = docs_frame(spark, rows)
    got = mixture.mix(frame).collect()
    assert len(got) == len(rows)
    staged = mixture.take(frame).collect()
    for found in (got, staged):
        taken = dict.fromkeys(sizes, 0)
        for r in found:
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert sum(r.copies for r in staged) == sum(r.copies for r in got)
    again = mixture.mix(frame.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixture_stage_takes_rows_without_or_with_shared_ids_one_by_one(spark):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(rng.choice([None, 7]), " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 40))), rng.choice(["a"] * 8 + ["b", "c"])) for _ in range(900)]
    sizes, taken = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    frame = docs_frame(spark, rows)
    got = corpus_pipeline.mixture_stage(spark, frame, SF).collect()
    for r in got:
        assert r.taken == r.copies * len(r.text.split())
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = plain_targets(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) <= 40 for s in sizes)
    assert sorted(map(str, corpus_pipeline.mixture_stage(spark, frame, SF).collect())) == sorted(map(str, got))


# -- 1 personal data --------------------------------------------------------------


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, ("email", "ip", "card", "phone")[k], e) for s, k, e in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a.b@c.de", "@", "x@y", "a@b.c@d.ee", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (310) 555-4510", "+49 30 1234", "9", ".", " ", "-", "é", "٣", "+", "0000000000000000", "%", "..", "12", "\n", "@a.b", "00300.1.1.1"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_of_zeros_are_numbers():
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}1.2.3.{zeros}") == [(0, "ip", 10006)]


def test_pii_query_rows(spark):
    model = pii.train(spark, docs_frame(spark, EDGE))
    texts = EDGE + [(20, 'é mail a.b@c.de token = "0123456789abcdef0123456789abcdef01234567" on 2024-01-31', "a"), (21, "1" * 200_000, "a"), (22, "a" * 200_000 + "@", "b")]
    frame = docs_frame(spark, texts).withColumn("spans", F.lit("x"))
    rows = pii.find_pii(frame, model).collect()
    assert len(rows) == len(texts)
    empty = hashlib.sha256(b"").hexdigest()
    by_id = {r.doc_id: r for r in rows}
    for i in (1, 2, 3, 4, 5, 6, 7, None, 22):
        assert (by_id[i].base_sha256, by_id[i].spans, by_id[i].n_more) == (empty, "", 0)
    r = by_id[20]
    assert r.n_email == 1 and r.spans == "email:7:15,key:25:65"
    assert r.base_sha256 == hashlib.sha256(b"email:7:15").hexdigest()
    out = {r.doc_id: r for r in pii.redact(frame, model).collect()}
    assert out[20].text == 'é mail [EMAIL] token = "[KEY]" on 2024-01-31' and out[20].n_chars == len(out[20].text)
    assert out[1].text is None and out[4].text == "one"
    assert pii.find_pii(docs_frame(spark, []), model).count() == 0


def test_boosted_trees_on_unseen_examples(spark):
    model = pii.train(spark)
    held = pii.examples(["alpha", "beta", "gamma", "delta"], 1500, seed=99)
    scores = model.scores(np.array([pii.features(t, s, k, e) for t, s, k, e, _ in held]))
    said = [p >= model.cuts[h[2]] for p, h in zip(scores, held)]
    true = sum(a and h[4] for a, h in zip(said, held))
    assert true / max(1, sum(said)) >= 0.95
    assert true / sum(h[4] for h in held) >= 0.7


def test_pii_lists_of_numbers_and_long_addresses(spark):
    """Every window of neighbouring groups is proposed; the right ones win."""
    model = pii.train(spark)
    found = lambda t: {(k, t[s:e]) for s, k, e in pii.base_spans(t) + model.more_spans(t, pii.base_spans(t))}
    assert found("call 555-123-4567 555-987-6543") == {("phone", "555-123-4567"), ("phone", "555-987-6543")}
    # 18 digits that happen to pass Luhn: the base card stays, the two ids are added.
    assert found("ssn 123-45-6789 987-65-4321") == {("card", "123-45-6789 987-65-4321"), ("id", "123-45-6789"), ("id", "987-65-4321")}
    assert found("order 12345 555-123-4567") == {("phone", "555-123-4567")}
    assert found("mail " + "a" * 80 + " (at) b (dot) com") == {("email", "a" * 80 + " (at) b (dot) com")}
    proposed = {("x 1 22 333 4444 55555 666666"[s:e], k) for s, k, e in pii.candidates("x 1 22 333 4444 55555 666666")}
    assert {w for w, _ in proposed} == {"1 22 333 4444", "1 22 333 4444 55555", "22 333 4444", "22 333 4444 55555", "333 4444", "333 4444 55555", "333 4444 55555 666666", "4444 55555", "4444 55555 666666", "55555 666666"}
    numbers = " ".join(str(i % 10) for i in range(3000))
    assert len(model.more_spans(numbers, pii.base_spans(numbers))) < 1000  # one pass, in pieces


def test_pii_context_reaches_the_driver_as_words_only(spark):
    """The plan limits words, never texts, and merges equal ones before."""
    docs = docs_frame(spark, [(i, f"text {i} " + "w" * 5000, "a") for i in range(50)] + [(None, "same same", "a")] * 500)
    frame = pii.context(docs, 10)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    limit = plan[plan.index("GlobalLimit") :]
    assert "Aggregate" in limit and "text#" not in limit[: limit.index("Aggregate")]
    rows = frame.collect()
    assert len(rows) == 10 and all(len(w) <= 40 for r in rows for w in r.w)
    assert sorted(map(str, rows)) == sorted(map(str, pii.context(docs.repartition(7), 10).collect()))


def test_pii_context_rows_are_limited(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "examples", lambda words, *a: seen.append(len(words)) or [("call 1234567", 5, "phone", 12, i % 2) for i in range(40)])
    pii.train(spark, docs_frame(spark, [(7, f"w{chr(97 + i // 26)}{chr(97 + i % 26)}", "a") for i in range(500)]), n=60, context_docs=20)
    assert sum(seen) == 20


# -- 5 quality ----------------------------------------------------------------------


def test_em_recovers_labellers():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    acc = [0.95, 0.85, 0.7]
    votes = np.array([["b" if (t == (rng.random() < a)) else "g" for a in acc] for t in y])
    spoken = rng.random(votes.shape) < 0.8
    patterns = ["".join(v if s else "-" for v, s in zip(*p)) for p in zip(votes, spoken)]
    distinct = sorted(set(patterns))
    counts = np.array([patterns.count(p) for p in distinct], float)
    p, accuracy, share = quality.estimate(distinct, counts)
    assert np.allclose(accuracy, acc, atol=0.06) and abs(share - 0.2) < 0.05


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("votes", F.lit(1))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(docs).join(labels, "doc_id").collect()
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    bad = [r for r in got if r.quality == 0]
    abusive = [r for r in got if any(w[9:13].count("b") for w in [r.votes])]
    assert sum(r.stays for r in clean) / len(clean) >= 0.98
    assert sum(not r.stays for r in bad) / len(bad) >= 0.85
    assert abusive and sum(not r.stays for r in abusive) / len(abusive) >= 0.95


def test_toxic_recall_on_given_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic = 1")
    scorers = quality.train(docs)
    got = quality.score(docs.join(labels, "doc_id", "left_semi"), scorers).join(docs.select("doc_id", "lang"), "doc_id").collect()
    english = [r for r in got if r.lang == "en"]
    assert sum(not r.stays for r in english) / len(english) >= 0.95
    # Other languages have no list of terms (README): 30 of 170 at the time of writing.
    assert sum(not r.stays for r in got) / len(got) >= 0.65


def test_training_samples_are_bounded_whatever_the_ids(spark):
    rows = [(None, f"text {i}", "a") for i in range(3000)] + [(7, f"more {i}", "a") for i in range(2000)] + [(i, "same", "a") for i in range(5000)]
    frame = docs_frame(spark, rows)
    got = quality.sample(frame, len(rows), 200).collect()
    weight = {k: sum(r.n for r in got if r.text.startswith(k)) for k in ("text", "more", "same")}
    assert len(got) <= 200 and [r.d for r in got] == sorted(r.d for r in got)
    assert weight["same"] in (100, 101) and abs(weight["text"] - 60) <= 25 and abs(weight["more"] - 40) <= 20
    assert {r.n for r in quality.sample(frame, len(rows), 20_000).collect()} == {1, 5000}
    # Equal rows weigh like their number.
    x = (np.array([1, 1, 1]), np.array([3, 4, 3]), np.ones(3), np.array([0.9, 0.1, 0.8]))
    a = quality.fit(*x, count=np.array([2.0, 3.0, 1.0]))
    b = quality.fit(*(np.repeat(v, [2, 3, 1]) for v in x))
    assert np.allclose(a.weights, b.weights) and a.intercept == pytest.approx(b.intercept)


def test_quality_edge_cases(spark):
    words = "the of and to in is that for it as was with be by on not he".split()
    rng = random.Random(0)
    good = [(100 + i, " ".join(rng.choice(words) + rng.choice(words) for _ in range(60)) + ".", "a") for i in range(40)]
    bad = [(200 + i, " ".join(rng.choice(words).upper() + "!!" for _ in range(60)), "a") for i in range(8)]
    frame = docs_frame(spark, EDGE + good + bad).withColumn("stays", F.lit(False))
    rows = quality.score(frame).collect()
    assert len(rows) == len(EDGE) + 48
    assert all(r.stays for r in rows if r.doc_id in (1, 2, 3, 4, 7, None)) and not any(r.stays for r in rows if (r.doc_id or 0) >= 200)
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 7, None, *range(100, 140)}
    assert quality.score(docs_frame(spark, [])).count() == 0


# -- 2 WARC ---------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    same = "<p>" + "é" * 600
    rows = [(1, "http://a/1", same), (2, "http://a/ü\r\nX: 1", same), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", same), (9, "u", "x" * 300_000), (9, "u", "x" * 300_000)]
    rows += [(100 + i, f"http://b/{i}", f"<html>{i} " + "body " * i) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("salt", F.lit(1))
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(warc.plan_records(pages), folder, archive_bytes=100_000)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    for i, _, html in rows:
        data = (html or "").encode()
        for r in by_id[i]:
            assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
            assert r.record_type == "revisit" or bytes(r.payload) == data
    assert [(r.record_type, r.refers_to) for r in by_id[1] + by_id[None]] == [("revisit", 2)] * 2
    assert by_id[2][0].record_type == "response" and "\r" not in by_id[2][0].url
    assert {r.record_type for i in (5, 6, 9) for r in by_id[i]} == {"response"}
    assert len({r.path for r in got}) > 1
    # An archive that a lost attempt left behind is not in the manifest.
    import shutil

    stray = sorted((tmp_path / "warc").glob("*.warc.zst"))[0]
    manifest = spark.createDataFrame([(p.name,) for p in (tmp_path / "warc").glob("*.warc.zst")], "name string")
    shutil.copy(stray, tmp_path / "warc" / "000000-999-00000.warc.zst")
    assert warc.read_archives(spark, folder, manifest=manifest).count() == len(rows) < warc.read_archives(spark, folder).count()
    assert warc.round_trip(pages.limit(0), f"{tmp_path}/none").count() == 0


def test_warc_manifest_is_checked_both_ways(spark, tmp_path):
    """An archive that is absent, or holds fewer records than were written, raises."""
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p"), F.repeat(F.col("id").cast("string"), 900)).alias("html"))
    manifest = warc.write_archives(warc.plan_records(pages), str(tmp_path), archive_bytes=10_000)
    assert warc.read_archives(spark, str(tmp_path), manifest=manifest).count() == 60
    with pytest.raises(Exception, match="the manifest says"):
        warc.read_archives(spark, str(tmp_path), manifest=manifest.withColumn("records", F.col("records") + 1)).collect()
    next(tmp_path.glob("*.warc.zst")).unlink()
    with pytest.raises(Exception, match="(?i)no such file"):
        warc.read_archives(spark, str(tmp_path), manifest=manifest).collect()


def test_folders_without_a_scheme_follow_the_default_file_system(spark, tmp_path):
    from parley.llm.common import shared_folder

    assert shared_folder(spark, f"{tmp_path}/x") == f"file://{tmp_path}/x" and (tmp_path / "x").is_dir()
    assert shared_folder(spark, f"file:{tmp_path}/y") == shared_folder(spark, f"file://{tmp_path}/y") == f"file://{tmp_path}/y"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://elsewhere/")
    try:
        with pytest.raises(Exception, match="(?i)viewfs|elsewhere"):
            shared_folder(spark, f"{tmp_path}/z")
    finally:
        conf.set("fs.defaultFS", before)


def test_archives_are_read_in_pieces():
    """A record at a time, whatever the archive's size: frames of any length
    over piece ends, and a long skippable frame in between."""
    import io
    import struct

    import zstandard

    box = zstandard.ZstdCompressor()
    rng = random.Random(1)
    records = [rng.randbytes(n) for n in (0, 1, 70_000, 65_536, 200_000, 5, 131_072)]
    raw = b"".join(box.compress(r) for r in records[:4]) + struct.pack("<II", warc.SKIPPABLE, 150_000) + b"s" * 150_000 + b"".join(box.compress(r) for r in records[4:])

    class Pieces(io.BytesIO):
        most = 0

        def read(self, n):
            self.most = max(self.most, n)
            return super().read(n)

    source = Pieces(raw)
    assert list(warc.frames(source)) == records and source.most <= 2 * warc.READ_BYTES
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(raw[:-1])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(raw + b"abc")))


def test_warc_rejects_damage(spark, tmp_path):
    import struct

    import zstandard

    raw = b"WARC/1.1 dictionary content for the test"
    box = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    good = warc.record(1, "u", b"hello", None)
    bad = [good.replace(b"Content-Length: ", b"Content-Length: 9", 1), good.replace(b"hello", b"hallo"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good[:-2]]
    body = b"".join(box.compress(r) for r in [good, *bad])
    head = struct.pack("<II", warc.SKIPPABLE, len(raw)) + raw
    (tmp_path / "x.warc.zst").write_bytes(head + body + box.compress(good)[:-3])
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert [r.error is None for r in sorted(got, key=lambda r: r.record_no)] == [True, False, False, False, False, False]


# -- 3 chat -----------------------------------------------------------------------------


def test_chat_collapse(spark):
    rows = []
    for conv, n in ((1, 2), (2, 4), (3, 4), (4, 1), (5, 5)):
        rows += [(conv, 10 * t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if conv != 5 or t < 2 else f"other {t}") for t in range(n)]
    rows += [(6, 0, None, None), (7, 0, "unknown", ""), (8, None, "user", "x"), (8, 3, "user", "y"), (8, 3, "user", "y"), (None, 0, "user", "no id")]
    rows += [(9, t, "user", f"long {t}") for t in range(600)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("p", F.lit(1))
    for chunk in (1024, 7):
        got = {(r.conv_id, r.segment): r for r in chat.format_chats(turns, chunk=chunk).collect()}
        assert set(got) == {(2, 0), (5, 0), (6, 0), (7, 0), (8, 0), (None, 0), (9, 0), (9, 1), (9, 2)}
        assert got[2, 0].copies == 2 and got[2, 0].n_turns == 4
        assert got[6, 0].rendered == "<|im_start|>unknown\n<|im_end|>\n"
        assert got[8, 0].rendered == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in "xyy")
        assert "".join(got[9, s].rendered for s in range(3)).count("long") == 600
    assert chat.format_chats(turns.limit(0)).count() == 0


# -- 4 chunks -----------------------------------------------------------------------------


def plain_boundaries(data, bits=chunks.MASK_BITS):
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        if i + 1 - start == chunks.MOST and not (h >> (32 - bits) == 0):
            ends.append(i + 1)
            start = i + 1
        elif h >> (32 - bits) == 0 and i + 1 - start >= chunks.LEAST:
            ends.append(i + 1)
            start = i + 1
    return ends + ([len(data)] if start < len(data) else [])


def test_chunk_boundaries_equal_the_byte_loop(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 31, 32, 33, 5000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        assert chunks.boundaries(data) == plain_boundaries(data.tolist())
    flat = np.zeros(3000, np.uint8)
    assert chunks.boundaries(flat)[-1] == 3000 and max(np.diff([0, *chunks.boundaries(flat)])) <= chunks.MOST
    monkeypatch.setattr(chunks, "PIECE", 700)
    assert chunks.boundaries(data) == plain_boundaries(data.tolist())


def test_repeated_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(100)), "a") for i in range(40)]
    rows += [(100 + i, " ".join(word() for _ in range(20 + i)) + " " + passage + " " + word(), "a") for i in range(30)]
    rows += [r for r in EDGE if r[0] not in (5, 6)]
    frame = docs_frame(spark, rows).withColumn("seq", F.lit(1)).withColumn("words", F.lit("x"))
    got = chunks.repeated_passages(frame).collect()
    assert {r.doc_id for r in got} == set(range(101, 130))
    assert all(100 <= r.first_doc_id < r.doc_id for r in got)
    text = {i: t for i, t, _ in rows}
    for r in got:
        piece = text[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert piece in text[100] and r.words >= 15
    left = {r.doc_id: r.text for r in chunks.without_repeats(frame).collect()}
    assert all(left[i] == text[i] for i in range(40)) and all(len(left[i]) < len(text[i]) - 150 for i in range(101, 130)) and left[100] == text[100]
    assert chunks.repeated_passages(docs_frame(spark, [])).count() == 0
    assert chunks.repeated_passages(docs_frame(spark, [r for r in EDGE if r[0] == 7])).count() == 0


def test_repeats_of_rows_without_or_with_shared_ids(spark):
    """Every row takes part: three rows with one passage, two of them without
    id; one id with several texts; rows that are repeated as a whole."""
    rng = random.Random(5)
    some = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))
    passages = [some(60) for _ in range(3)]
    rows = [(5, some(30) + " " + passages[0], "a"), (None, passages[0] + " " + some(30), "b"), (None, some(9) + " " + passages[0], "b")]
    rows += [(7, some(20) + " " + passages[1], "a"), (7, passages[1] + " " + some(20), "a"), (8, passages[1], "a")]
    rows += [(9, passages[2], "a"), (9, passages[2], "a"), (None, some(80), "c"), (None, None, "c"), (11, some(100), "a")]
    rows += [r for r in EDGE if r[0] in (5, 6)]  # the very long ones
    frame = docs_frame(spark, [(i + 100 if i in (5, 6) and len(t) > 9000 else i, t, s) for i, t, s in rows])
    got = sorted((str(r.doc_id), str(r.first_doc_id)) for r in chunks.repeated_passages(frame).collect() if r.doc_id not in (105, 106))
    assert [g for g in got if g[0] == "None"] == [("None", "5")] * 2
    # Id 8 has one text and comes first; both texts of id 7 are documents behind it.
    assert [g for g in got if g[0] in ("7", "8")] == [("7", "8")] * 2 and "9" not in {a for a, _ in got}
    left = chunks.without_repeats(frame)
    assert left.columns == frame.columns and left.count() == len(rows)
    kept = [r.text or "" for r in left.collect()]
    assert [sum(p in t for t in kept) for p in passages] == [1, 1, 2]
    again = chunks.repeated_passages(frame.repartition(4)).collect()
    assert sorted((str(r.doc_id), str(r.first_doc_id)) for r in again if r.doc_id not in (105, 106)) == got


def test_long_repeats_are_caught_on_the_corpus(spark):
    """Documents that repeat a passage of over 50 words of an earlier document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, later, tens, shared = {}, set(), {}, set()
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        w = (r.text or "").split()
        for k, seen, out in ((51, first, later), (8, tens, shared)):
            grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            if len(set(grams)) < len(grams) or any([seen.setdefault(g, r.doc_id) != r.doc_id for g in grams]):
                out.add(r.doc_id)
    flagged = {r.doc_id for r in chunks.repeated_passages(docs).collect()}
    assert len(later - flagged) <= 0.01 * len(later)
    assert flagged <= shared  # documents that share nothing are left alone


def test_marks_are_shared_by_every_copy_of_101_bytes(monkeypatch):
    rng = np.random.default_rng(3)
    whole = rng.integers(97, 107, 5000).astype(np.uint8)
    at = chunks.marks(whole)
    monkeypatch.setattr(chunks, "PIECE", 700)
    assert chunks.marks(whole).tolist() == at.tolist()
    for _ in range(300):
        part = rng.integers(97, 107, 101).astype(np.uint8)
        seen = []
        for _ in range(2):
            raw = np.concatenate((rng.integers(97, 107, rng.integers(0, 200)), part, rng.integers(97, 107, rng.integers(0, 200)))).astype(np.uint8)
            seen.append({raw[max(0, e - chunks.WINDOW) : e].tobytes() for e in chunks.marks(raw).tolist()})
        assert any(w in part.tobytes() for w in seen[0] & seen[1])
    assert len(chunks.marks(np.zeros(100_000, np.uint8))) < 2000


def test_passages_of_51_words_with_two_copies(spark):
    rng = random.Random(12)
    word = lambda least, most: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most)))
    some = lambda n: " ".join(word(3, 9) for _ in range(n))
    rows, planted = [], {}
    for k in range(400):
        passage = " ".join(word(1, 1 + k % 8) for _ in range(51))
        for i in (2 * k, 2 * k + 1):
            rows.append((i, f"{some(rng.randint(0, 40))} {passage} {some(rng.randint(0, 40))}", "a"))
        planted[2 * k + 1] = passage
    text = {i: t for i, t, _ in rows}
    got = {r.doc_id: r for r in chunks.repeated_passages(docs_frame(spark, rows)).collect()}
    assert set(got) == set(planted)
    for i, r in got.items():
        assert r.first_doc_id == i - 1 and planted[i] in text[i].encode()[r.start_byte : r.end_byte].decode()
        assert text[i].encode()[r.start_byte : r.end_byte].decode() in text[i - 1]


# -- 7 licenses ------------------------------------------------------------------------------


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= common_length(a, b)
        assert len(licenses._common(a, b)) == common_length(a, b)
    assert licenses.align(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]


def test_license_matches_are_tight():
    a = "licensed under the mit license".split()
    assert licenses.tightest(a, "the under work the x y licensed under the mit license z the".split()) == (5, 6, 11)
    assert licenses.tightest(a, "nothing here".split()) == (0, 0, 0)
    rng = random.Random(3)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8, 0.5)
    for name, text in licenses.TEMPLATES.items():
        for _ in range(5):
            noise = [rng.choice(["the", "of", "under", "license", "software", "x", "y", "is"]) for _ in range(rng.randint(0, 120))]
            found = scanner.scan(" ".join(noise) + " " + text + " " + " ".join(noise[:30]))
            assert any(f[0] == name and f[1] == 1.0 for f in found), name


def test_license_scan(spark):
    rng = random.Random(9)
    noise = lambda n: " ".join(rng.choice(["the", "of", "under", "this", "work", "is", "lorem", "ipsum", "dolor"]) for _ in range(n))
    mit = licenses.TEMPLATES["MIT text"].split()
    edited = " ".join(w for i, w in enumerate(mit) if i % 11)
    rows = [(10, noise(300) + " " + " ".join(mit) + " " + noise(50), "a"), (11, edited, "a"), (12, noise(5000), "a"), (13, "Released under the MIT License.\n" * 3, "a"), (14, "Licensed under CC BY-NC 4.0.", "a")]
    frame = docs_frame(spark, rows + EDGE).withColumn("template", F.lit(1))
    got = licenses.scan_licenses(frame).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.template, round(r.coverage, 2)))
    assert found[10] == [("MIT text", 1.0)]
    assert [t for t, _ in found[11]] == ["MIT text"] and found[11][0][1] >= 0.85
    assert found[13] == [("MIT line", 1.0)] * 3 and ("CC-BY-NC-4.0 line", 1.0) in found[14]
    assert set(found) == {10, 11, 13, 14}
    start = next(r.start_word for r in got if r.doc_id == 10)
    assert start == 300
    assert licenses.scan_licenses(docs_frame(spark, [])).count() == 0
    assert licenses.scan_licenses(frame, {"none": "", "null": None}).count() == 0


# -- 9 embeddings ------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4096, 40])
def test_embedding_join_equals_brute_force(spark, block):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(25, 16))
    x = np.repeat(base, 6, axis=0) + rng.normal(size=(150, 16)) * np.repeat(np.linspace(0.05, 0.6, 25), 6)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    rows += [(200, rows[3][1]), (201, [2 * c for c in rows[3][1]]), (202, None), (203, []), (204, [0.0] * 16), (205, [None, *rows[0][1][1:]]), (206, [float("nan")] * 16), (207, [float("inf"), *rows[0][1][1:]])]
    rows += [(209, rows[9][1]), (209, rows[9][1]), (300, [1e-200] + [0.0] * 15), (301, [1e200] + [0.0] * 15)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("key", F.lit(1))
    got = egojoin.embedding_near_duplicates(frame, block=block).collect()
    assert len(got) == len(rows)
    fine = [(k, i, np.array(v, float) / max(map(abs, v))) for k, (i, v) in enumerate(rows) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    linked = {}
    for k, _, a in fine:
        linked[k] = {j for j, _, b in fine if j != k and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.9}
    comp = plain_components(range(len(rows)), lambda a, b: b in linked.get(a, ()))
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[comp[k]] = min(smallest.get(comp[k], i), i)
    want = sorted((i, len(linked.get(k, ())), smallest[comp[k]]) for k, (i, _) in enumerate(rows))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert egojoin.embedding_near_duplicates(frame.limit(0)).count() == 0


# -- queries and pipeline ------------------------------------------------------------------------


def test_every_operator_has_a_query(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    for name in ("op3_chat", "op7_licenses", "op4_chunks"):
        assert names[name](spark, SF).count() >= 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        steps[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixture":
            assert sorted(docs.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars"])
    a, b, c, d, e = steps.values()
    assert set(e) <= set(d) == set(c) <= set(b) <= set(a) <= set(before)
    # Brute force on what each stage was given.
    prints = {i: plain_simhash(r.text) for i, r in a.items()}
    comp = plain_components(list(prints), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 4)
    assert set(b) == {i for i in comp if comp[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(c) == set(b) - {i for i, _ in plain_contaminated([(i, r.text) for i, r in b.items()], items)}
    assert all(plain_base(r.text) == [] for r in d.values())
    assert sum(r.taken for r in e.values()) == pytest.approx(1.5 * sum(len((r.text or "").split()) for r in d.values()), rel=0.2)
    run = {(r.doc_id, r.copies) for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {(r.doc_id, r.copies) for r in e.values()}


def test_pipeline_edge_tables(spark):
    import corpus_pipeline

    for rows in (EDGE, []):
        docs = docs_frame(spark, rows).withColumn("copies", F.lit("clash")).withColumn("taken", F.lit(1)).withColumn("id", F.lit(1)).withColumn("n", F.lit(2)).withColumn("a.b", F.lit(3))
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "copies", "taken"]
        assert len(set(docs.columns)) == 12
        assert docs.count() <= len(rows)

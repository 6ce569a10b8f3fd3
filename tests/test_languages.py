"""Language detection by trigram profiles."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from parley.operators import languages as lg
from parley.operators import normalize as nz
from parley.operators import train as tr
from parley.plans.normalize import all_documents
from tests.conftest import SF01

DOCS = "conv_id string, lang string, tokens array<string>"


def plain_grams(words):
    return [f" {w} "[i : i + 3] for w in words for i in range(len(w))]


def test_profiles_and_scores_equal_a_plain_loop(spark):
    rows = [("a", "en", ["the", "thing"]), ("b", "en", ["then"]), ("c", "de", ["das", "ding"]), ("d", None, ["the", "das"]), ("e", "fr", []), ("f", None, []), ("g", None, None), ("h", None, ["é", "日本"])]
    docs = spark.createDataFrame(rows, DOCS)
    profiles = lg.language_profiles(docs, grams=5)
    counts = {code: Counter(g for _, lang, w in rows if lang == code for g in plain_grams(w)) for code in ("en", "de")}
    want = {}
    for code, c in counts.items():
        floor = -math.log(sum(c.values()) + 5)
        for gram, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5]:
            want[code, gram] = (math.log(n + 1), floor)
    got = {(r.lang, r.gram): (r.weight, r.floor) for r in profiles.collect()}
    assert got.keys() == want.keys() and all(math.isclose(a, b) for k in want for a, b in zip(got[k], want[k]))
    found = {r.conv_id: r for r in lg.detect_language_by_grams(docs, profiles, margin=0.2).collect()}
    assert len(found) == len(rows)
    for i, _, words in rows:
        grams = plain_grams(words or [])
        score = {code: sum(want.get((code, g), (0, 0))[0] - math.log(sum(c.values()) + 5) for g in grams) for code, c in counts.items()}
        best, second = sorted(score, key=lambda code: -score[code])
        lead = (score[best] - score[second]) / len(grams) if grams else None
        assert found[i].n_grams == len(grams)
        assert (lead is None and found[i].lead is None) or math.isclose(found[i].lead, lead, abs_tol=1e-12)
        assert found[i].lang == (best if lead is not None and lead >= 0.2 else "unknown")
    assert lg.detect_language_by_grams(docs, profiles.limit(0)).select("lang").distinct().collect()[0].lang == "unknown"
    assert lg.detect_language_by_grams(docs.limit(0), profiles).count() == 0


def test_held_out_accuracy_is_that_of_the_vote_or_better(spark):
    docs = tr.split_dataset(all_documents(spark, SF01)).cache()
    profiles = lg.language_profiles(docs.where("split = 'train'"))
    held = docs.where("split = 'test'")
    truth = held.select("conv_id", F.col("lang").alias("given"), F.size("tokens").alias("words"))
    hit = lambda found: found.select("conv_id", "lang").join(truth, "conv_id").where("words > 0").agg(F.avg((F.col("lang") == F.col("given")).cast("int"))).first()[0]
    grams, vote = hit(lg.detect_language_by_grams(held, profiles)), hit(nz.detect_language(held))
    assert grams >= vote and grams > 0.95, (grams, vote)


def test_profiles_are_broadcast_and_trigrams_stay(spark):
    docs = all_documents(spark, SF01)
    plan = lg.detect_language_by_grams(docs, lg.language_profiles(docs))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "partial_sum" in plan


def test_scores_are_summed_without_sorting_the_trigrams(spark):
    docs = spark.createDataFrame([("a", "en", ["the", "thing"]), ("a", "de", ["das"]), (None, None, ["the"])], DOCS)
    found = lg.detect_language_by_grams(docs, lg.language_profiles(docs, grams=5))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.conv_id or "", r.n_grams) for r in found.collect()) == [("", 3), ("a", 3), ("a", 8)]

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import porter
from parley.functions.stopwords import stop_words
from parley.operators import normalize as nz
from tests.conftest import SF01
from tests.porter_reference import stem as ref_stem

PAPER_WORDS = [
    "caresses", "ponies", "ties", "caress", "cats", "feed", "agreed", "plastered", "bled", "motoring", "sing",
    "conflated", "troubled", "sized", "hopping", "tanned", "falling", "hissing", "fizzed", "failing", "filing",
    "happy", "sky", "relational", "conditional", "rational", "valenci", "hesitanci", "digitizer", "conformabli",
    "radicalli", "differentli", "vileli", "analogousli", "vietnamization", "predication", "operator", "feudalism",
    "decisiveness", "hopefulness", "callousness", "formaliti", "sensitiviti", "sensibiliti", "triplicate",
    "formative", "formalize", "electriciti", "electrical", "hopeful", "goodness", "revival", "allowance",
    "inference", "airliner", "gyroscopic", "adjustable", "defensible", "irritant", "replacement", "adjustment",
    "dependent", "adoption", "homologou", "communism", "activate", "angulariti", "homologous", "effective",
    "bowdlerize", "probate", "rate", "cease", "controll", "roll", "generalizations", "oscillators", "syzygy",
    "sayyid", "yyy", "by", "a", "", "étions", "running", "meetings",
]

# Published single-word results of the whole algorithm.
KNOWN = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "falling": "fall",
    "happy": "happi", "relational": "relat", "generalizations": "gener", "oscillators": "oscil",
}


def test_porter_matches_reference_on_word_list(spark):
    df = spark.createDataFrame([(w,) for w in PAPER_WORDS], "token string")
    got = dict(porter.stem_column(df).select("token", "stem").collect())
    for w in PAPER_WORDS:
        assert got[w] == ref_stem(w), w
    for w, s in KNOWN.items():
        assert got[w] == s, w


def test_letter_maps_equal_those_built_by_letter(spark):
    import itertools

    words = ["".join(w) for n in range(5) for w in itertools.product("yaCbV", repeat=n)] + ["ééy", "y𝒳y", "a\ny", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", porter._cv(F.col("w")), porter._cv_by_letter(F.col("w"))).collect()
    assert len(got) == len(words) and all(fast == slow for _, fast, slow in got)


def test_porter_matches_reference_on_corpus_vocabulary(spark):
    from parley.plans.normalize import all_tokens

    stems = nz.stem_vocabulary(all_tokens(spark, SF01)).select("token", "stem").collect()
    assert len(stems) > 1000
    bad = [(t, s, ref_stem(t)) for t, s in stems if s != ref_stem(t)]
    assert bad == []


def test_stopwords_case_insensitive_and_language_scoped(spark):
    sw = nz.stop_word_table(spark)
    tokens = spark.createDataFrame(
        [("d1", "en", "The"), ("d1", "en", "cat"), ("d2", "fr", "the"), ("d2", "fr", "le")], "conv_id string, lang string, token string"
    )
    kept = sorted(tuple(r) for r in nz.remove_stopwords(tokens, sw).select("conv_id", "token").collect())
    assert kept == [("d1", "cat"), ("d2", "the")]


def test_language_vote_accuracy_and_ties(spark):
    from parley.plans.normalize import all_documents

    detected = nz.detect_language(all_documents(spark, SF01))
    truth = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").cast("string").alias("conv_id"), F.col("lang").alias("truth"))
    joined = detected.join(truth, "conv_id")
    acc = joined.select(F.avg((F.col("lang") == F.col("truth")).cast("double"))).first()[0]
    assert acc > 0.9
    tie = spark.createDataFrame([("x", ["the", "le"]), ("y", ["zzz"]), ("z", []), ("w", ["the", "and", "le"])], "conv_id string, tokens array<string>")
    want = {"x": "unknown", "y": "unknown", "z": "unknown", "w": "en"}
    assert dict((r[0], r[1]) for r in nz.detect_language(tie).collect()) == want
    assert dict(tuple(r) for r in tie.select("conv_id", nz.language_vote("tokens")[0]).collect()) == want


def test_stems_in_the_row_equal_the_vocabulary_stems(spark):
    from parley.functions import porter

    df = spark.createDataFrame([(PAPER_WORDS, "en"), (["running"], "fr"), ([], "en")], "tokens array<string>, lang string")
    got = [r[0] for r in df.select(nz.normalize_list("tokens", "lang")).collect()]
    assert got == [[ref_stem(w) for w in PAPER_WORDS], ["running"], []]
    assert porter.STEPS


def test_stop_word_lists_loaded():
    assert "the" in stop_words("en") and "le" in stop_words("fr") and "und" in stop_words("de") and "el" in stop_words("es")


def test_normalize_unsupported_modes(spark):
    tokens = spark.createDataFrame([("a", "en", "running"), ("b", "fr", "mangeons")], "conv_id string, lang string, token string")
    skip = sorted(tuple(r) for r in nz.normalize_tokens(tokens, unsupported="skip").select("conv_id", "token").collect())
    assert skip == [("a", "run")]
    keep = sorted(tuple(r) for r in nz.normalize_tokens(tokens, unsupported="keep").select("conv_id", "token").collect())
    assert keep == [("a", "run"), ("b", "mangeons")]
    import pytest

    with pytest.raises(Exception):
        nz.normalize_tokens(tokens, unsupported="error").collect()


def plain_greek(word):
    """The Greek cascade letter by letter, from the endings alone."""
    from parley.functions import greek

    word = "".join(greek.PLAIN[greek.MARKED.index(c)] if c in greek.MARKED else c for c in word.lower())
    if len(word) <= greek.SHORT:
        return word
    for endings, least in greek.STEPS:
        fits = [e for e in endings if word.endswith(e) and len(word) - len(e) >= least]
        if fits:
            word = word[: -len(max(fits, key=len))]
    return word


# Forms of one word that have one stem, and pairs that must not.
GREEK_FORMS = [
    ["άνθρωπος", "άνθρωπο", "άνθρωποι", "ανθρώπων", "ΑΝΘΡΩΠΟΥΣ", "ανθρώπου"],
    ["τράπεζα", "τράπεζας", "τράπεζες", "τραπεζών"],
    ["λογαριασμός", "λογαριασμού", "λογαριασμοί", "λογαριασμών"],
    ["μεταφέρω", "μεταφέρεις", "μεταφέρουμε", "μεταφέρουν"],
    ["αριθμός", "αριθμό", "αριθμοί"],
    ["μεγαλύτερος", "μεγαλύτερη", "μεγαλύτερο"],
    ["κάρτα", "κάρτες", "καρτών", "κάρτας"],
]


def test_greek_stems(spark):
    words = [w for forms in GREEK_FORMS for w in forms] + ["και", "ο", "", "ναι", "ϋ", "hello", "ώρα", "ΐδιος", "ομασταν", "ερχόμασταν", "γράμματα", "γράμματος"]
    df = spark.createDataFrame([("d", "el", w) for w in words], "conv_id string, lang string, token string")
    got = {r.token: r.stem for r in nz.stem_vocabulary(df).collect()}
    assert got == {w: plain_greek(w) for w in words}
    assert all(len({got[w] for w in forms}) == 1 for forms in GREEK_FORMS)
    assert len({got[forms[0]] for forms in GREEK_FORMS}) == len(GREEK_FORMS)
    row = spark.createDataFrame([(words, "el")], "tokens array<string>, lang string")
    assert row.select(nz.normalize_list("tokens", "lang")).first()[0] == [got[w] for w in words]
    out = nz.normalize_tokens(df, unsupported="error").collect()
    assert sorted(r.token for r in out) == sorted(got[w] for w in words)


def test_a_stem_table_plugs_in_languages(spark):
    tokens = spark.createDataFrame([("a", "en", "running"), ("b", "fr", "mangeons"), ("b", "fr", "pain"), ("c", "de", "gehen"), ("d", None, "x")], "conv_id string, lang string, token string")
    table = spark.createDataFrame([("fr", "mangeons", "mang"), ("fr", "mangeons", "mange"), ("fr", None, "x")], "lang string, token string, stem string")
    keep = sorted((r.conv_id, r.token) for r in nz.normalize_tokens(tokens, unsupported="keep", stems=table).collect())
    assert keep == [("a", "run"), ("b", "mang"), ("b", "pain"), ("c", "gehen"), ("d", "x")]
    skip = sorted((r.conv_id, r.token) for r in nz.normalize_tokens(tokens, stems=table).collect())
    assert skip == keep[:3]
    import pytest

    with pytest.raises(Exception, match="unsupported language"):
        nz.normalize_tokens(tokens, unsupported="error", stems=table).collect()
    own = spark.createDataFrame([("en", "running", "RUN")], "lang string, token string, stem string")
    assert nz.normalize_tokens(tokens.where("lang = 'en'"), stems=own).first().token == "RUN"


def test_frequent_tokens_are_stemmed_without_shuffling_the_stream(spark, monkeypatch):
    rows = [("a", "en", "running")] * 5 + [("a", "en", "cats"), ("b", "en", "flies"), ("b", "de", "running"), ("c", None, "cats"), ("c", "en", None)]
    tokens = spark.createDataFrame(rows, "conv_id string, lang string, token string")
    table = spark.createDataFrame([("de", "running", "renn"), ("de", "cats", None)], "lang string, token string, stem string")
    forms = [dict(unsupported="keep"), dict(unsupported="skip"), dict(unsupported="keep", stems=table)]
    found = lambda: [sorted((r.conv_id, r.lang or "", r.token or "") for r in nz.normalize_tokens(tokens, **form).collect()) for form in forms]
    want = found()
    assert want[1] == [("a", "en", "cat")] + [("a", "en", "run")] * 5 + [("b", "en", "fli"), ("c", "en", "")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in nz.normalize_tokens(tokens)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    monkeypatch.setattr(nz, "MOST_BROADCAST", 1)
    assert found() == want

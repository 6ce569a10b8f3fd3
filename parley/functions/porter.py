"""Porter (1980) suffix-stripping stemmer as Spark column expressions.

In batch it is meant to run over the *distinct* vocabulary (one row per
token), not over the token stream: ``stem_column(df, "token")`` adds ``stem``
and the result is joined back to the tokens.  ``stem_tokens`` stems an array
in the row, for streams, whose small messages have no vocabulary to join.
Every step is a ``CASE`` over suffixes, longest
suffix first (the paper's rule: only the longest matching suffix of a step is
considered).  Conditions use the measure ``m`` of the stem, computed from a
consonant/vowel map of the word built once per step with string functions
(words with ``yy``: an ``aggregate`` over the characters): ``a e i o u`` are
vowels, ``y`` is a vowel when it follows a consonant, everything else is a
consonant.  ``m`` is the
number of vowel->consonant transitions, i.e. ``regexp_count(cv, 'VC')``.
Words of one or two letters are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffix rules of the published algorithm, step by step,
# as (suffix, replacement).
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
VOWELS = ("a", "e", "i", "o", "u")

W = "_pw"  # working word
C = "_pc"  # its consonant/vowel map


def _cv(word: Column) -> Column:
    """Consonant/vowel map.  A single ``y`` is decided by the letter before it,
    with string functions; runs of ``y`` alternate, letter by letter."""
    marked = F.translate(F.regexp_replace(word, "[^aeiouy]", "C"), "".join(VOWELS), "V" * len(VOWELS))
    single = F.translate(F.regexp_replace(marked, "(^|V)y", "$1C"), "y", "V")
    return F.when(F.contains(word, F.lit("yy")), _cv_by_letter(word)).otherwise(single)


def _cv_by_letter(word: Column) -> Column:
    chars = F.filter(F.split(word, ""), lambda ch: ch != "")
    return F.aggregate(
        chars,
        F.lit(""),
        lambda acc, ch: F.concat(
            acc,
            F.when(ch.isin(*VOWELS), F.lit("V"))
            .when((ch == "y") & (F.length(acc) > 0) & (F.substring(acc, -1, 1) == "C"), F.lit("V"))
            .otherwise(F.lit("C")),
        ),
    )


class Word:
    """A working word and its consonant/vowel map, as columns."""

    def __init__(self, w: Column, c: Column):
        self.w, self.c = w, c

    @property
    def n(self) -> Column:
        return F.length(self.w)

    def prefix(self, n: Column) -> Column:
        return F.substr(self.w, F.lit(1), n)

    def cv_prefix(self, n: Column) -> Column:
        return F.substr(self.c, F.lit(1), n)

    def m(self, n: Column) -> Column:
        """Measure of the first ``n`` letters."""
        return F.regexp_count(self.cv_prefix(n), F.lit("VC"))

    def has_vowel(self, n: Column) -> Column:
        return F.instr(self.cv_prefix(n), "V") > 0

    def char(self, pos: Column) -> Column:
        return F.substr(self.w, pos, F.lit(1))

    def double_consonant(self, n: Column) -> Column:
        """The first ``n`` letters end with a double consonant."""
        return (n >= 2) & (self.char(n) == self.char(n - 1)) & (F.substr(self.c, n - 1, F.lit(2)) == "CC")

    def cvc(self, n: Column) -> Column:
        """The first ``n`` letters end consonant-vowel-consonant, last not w, x, y."""
        return (n >= 3) & (F.substr(self.c, n - 2, F.lit(3)) == "CVC") & ~self.char(n).isin("w", "x", "y")

    def ends(self, suffix: str) -> Column:
        return self.w.endswith(suffix)


def _rules(x: Word, rules: list[tuple[str, str]], condition) -> Column:
    """Longest matching suffix decides; its condition gates the replacement."""
    out = None
    for suffix, repl in sorted(rules, key=lambda r: -len(r[0])):
        n = x.n - len(suffix)
        value = F.when(condition(n, suffix), F.concat(x.prefix(n), F.lit(repl))).otherwise(x.w)
        out = F.when(x.ends(suffix), value) if out is None else out.when(x.ends(suffix), value)
    return out.otherwise(x.w)


def _step1a(x: Word) -> Column:
    return (
        F.when(x.ends("sses"), x.prefix(x.n - 2))
        .when(x.ends("ies"), x.prefix(x.n - 2))
        .when(x.ends("ss"), x.w)
        .when(x.ends("s"), x.prefix(x.n - 1))
        .otherwise(x.w)
    )


def _step1b_fix(x: Word, n: Column) -> Column:
    stem = x.prefix(n)
    tail2 = F.substr(x.w, n - 1, F.lit(2))
    return (
        F.when(tail2.isin("at", "bl", "iz"), F.concat(stem, F.lit("e")))
        .when(x.double_consonant(n) & ~x.char(n).isin("l", "s", "z"), x.prefix(n - 1))
        .when((x.m(n) == 1) & x.cvc(n), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )


def _step1b(x: Word) -> Column:
    n_eed, n_ed, n_ing = x.n - 3, x.n - 2, x.n - 3
    return (
        F.when(x.ends("eed"), F.when(x.m(n_eed) > 0, x.prefix(x.n - 1)).otherwise(x.w))
        .when(x.ends("ed") & x.has_vowel(n_ed), _step1b_fix(x, n_ed))
        .when(x.ends("ing") & x.has_vowel(n_ing), _step1b_fix(x, n_ing))
        .otherwise(x.w)
    )


def _step1c(x: Word) -> Column:
    n = x.n - 1
    return F.when(x.ends("y") & x.has_vowel(n), F.concat(x.prefix(n), F.lit("i"))).otherwise(x.w)


def _step2(x: Word) -> Column:
    return _rules(x, STEP2, lambda n, s: x.m(n) > 0)


def _step3(x: Word) -> Column:
    return _rules(x, STEP3, lambda n, s: x.m(n) > 0)


def _step4(x: Word) -> Column:
    def cond(n, suffix):
        base = x.m(n) > 1
        if suffix == "ion":
            return base & x.char(n).isin("s", "t")
        return base

    return _rules(x, [(s, "") for s in STEP4], cond)


def _step5a(x: Word) -> Column:
    n = x.n - 1
    return F.when(x.ends("e") & ((x.m(n) > 1) | ((x.m(n) == 1) & ~x.cvc(n))), x.prefix(n)).otherwise(x.w)


def _step5b(x: Word) -> Column:
    return F.when((x.m(x.n) > 1) & x.double_consonant(x.n) & x.ends("l"), x.prefix(x.n - 1)).otherwise(x.w)


STEPS = (_step1a, _step1b, _step1c, _step2, _step3, _step4, _step5a, _step5b)


def stem_column(df: DataFrame, token: str = "token", out: str = "stem") -> DataFrame:
    """Add the Porter stem of ``token`` as ``out``.

    Each step is its own projection (word + its consonant/vowel map), so the
    expression tree stays linear in the number of steps.
    """
    cur = df.withColumn(W, F.col(token))
    for step in STEPS:
        cur = cur.withColumn(C, _cv(F.col(W)))
        cur = cur.withColumn(W, step(Word(F.col(W), F.col(C))))
    short = F.length(F.col(token)) <= 2
    return cur.withColumn(out, F.when(short, F.col(token)).otherwise(F.col(W))).drop(W, C)


def stem_tokens(tokens: Column | str) -> Column:
    """The same on a token array, inside the row."""
    cur = F.transform(tokens, lambda t: F.struct(t.alias("o"), t.alias("w")))
    for step in STEPS:
        cur = F.transform(cur, lambda x: F.struct(x["o"].alias("o"), x["w"].alias("w"), _cv(x["w"]).alias("c")))
        cur = F.transform(cur, lambda x: F.struct(x["o"].alias("o"), step(Word(x["w"], x["c"])).alias("w")))
    return F.transform(cur, lambda x: F.when(F.length(x["o"]) <= 2, x["o"]).otherwise(x["w"]))

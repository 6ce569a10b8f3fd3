"""The Porter stemmer as DuckDB SQL, for the twins of stemmed queries.

Written from the published description, step by step, over a table of distinct
words: ``stem_ctes("words")`` gives CTEs that end in ``stems(token, stem)``.
``w`` is the working word and ``cv`` its consonant/vowel map.
"""

from __future__ import annotations

from parley.functions.porter import STEP2, STEP3, STEP4

CV = (
    "list_reduce(list_prepend('', string_split(w, '')), lambda acc, ch: acc || CASE WHEN ch = '' THEN '' "
    "WHEN ch IN ('a', 'e', 'i', 'o', 'u') THEN 'V' WHEN ch = 'y' AND acc <> '' AND right(acc, 1) = 'C' THEN 'V' ELSE 'C' END)"
)


def _stem(cut: int) -> str:
    return f"substr(w, 1, length(w) - {cut})"


def _m(cut: int) -> str:
    return f"len(regexp_extract_all(substr(cv, 1, length(w) - {cut}), 'VC'))"


def _vowel(cut: int) -> str:
    return f"contains(substr(cv, 1, length(w) - {cut}), 'V')"


def _double(cut: int) -> str:
    return (
        f"(length(w) - {cut} >= 2 AND substr(w, length(w) - {cut}, 1) = substr(w, length(w) - {cut} - 1, 1) "
        f"AND substr(cv, length(w) - {cut} - 1, 2) = 'CC')"
    )


def _cvc(cut: int) -> str:
    return f"(length(w) - {cut} >= 3 AND substr(cv, length(w) - {cut} - 2, 3) = 'CVC' AND substr(w, length(w) - {cut}, 1) NOT IN ('w', 'x', 'y'))"


def _after_1b(cut: int) -> str:
    return (
        f"CASE WHEN substr(w, length(w) - {cut} - 1, 2) IN ('at', 'bl', 'iz') THEN {_stem(cut)} || 'e' "
        f"WHEN {_double(cut)} AND substr(w, length(w) - {cut}, 1) NOT IN ('l', 's', 'z') THEN {_stem(cut + 1)} "
        f"WHEN {_m(cut)} = 1 AND {_cvc(cut)} THEN {_stem(cut)} || 'e' ELSE {_stem(cut)} END"
    )


def _suffixes(rules: list[tuple[str, str]], least: int) -> str:
    """The longest suffix that fits decides."""
    cases = []
    for suffix, put in sorted(rules, key=lambda r: -len(r[0])):
        n = len(suffix)
        held = f"{_m(n)} > {least}" + (f" AND substr(w, length(w) - {n}, 1) IN ('s', 't')" if suffix == "ion" else "")
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {held} THEN {_stem(n)} || '{put}' ELSE w END")
    return "CASE " + " ".join(cases) + " ELSE w END"


STEPS = (
    f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_stem(2)} WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {_stem(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m(3)} > 0 THEN {_stem(1)} ELSE w END "
    f"WHEN ends_with(w, 'ed') AND {_vowel(2)} THEN {_after_1b(2)} WHEN ends_with(w, 'ing') AND {_vowel(3)} THEN {_after_1b(3)} ELSE w END",
    f"CASE WHEN ends_with(w, 'y') AND {_vowel(1)} THEN {_stem(1)} || 'i' ELSE w END",
    _suffixes(STEP2, 0),
    _suffixes(STEP3, 0),
    _suffixes([(s, "") for s in STEP4], 1),
    f"CASE WHEN ends_with(w, 'e') AND ({_m(1)} > 1 OR ({_m(1)} = 1 AND NOT {_cvc(1)})) THEN {_stem(1)} ELSE w END",
    f"CASE WHEN {_m(0)} > 1 AND {_double(0)} AND ends_with(w, 'l') THEN {_stem(1)} ELSE w END",
)


def stem_ctes(words: str) -> str:
    """CTEs over ``words(token)`` (distinct); the last is ``stems(token, stem)``."""
    out, last = [], f"(SELECT token, token AS w FROM {words})"
    for i, step in enumerate(STEPS):
        out.append(f"pm{i} AS MATERIALIZED (SELECT token, w, {CV} AS cv FROM {last} z{i})")
        out.append(f"ps{i} AS MATERIALIZED (SELECT token, {step} AS w FROM pm{i})")
        last = f"ps{i}"
    out.append(f"stems AS (SELECT token, CASE WHEN length(token) <= 2 THEN token ELSE w END AS stem FROM {last})")
    return ",\n".join(out)

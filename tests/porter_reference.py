"""Plain imperative Porter (1980) stemmer used only as a brute-force check of
the column-expression version."""

from __future__ import annotations


# The paper's rules, written out here a second time so that a
# wrong or missing rule in the module shows.
STEP2 = [r.split(" ") for r in """ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,\
ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble""".split(",")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _is_cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in "aeiou":
        return False
    if ch == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        cons = _is_cons(stem, i)
        if cons and prev_vowel:
            m += 1
        prev_vowel = not cons
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(stem: str) -> bool:
    return len(stem) >= 2 and stem[-1] == stem[-2] and _is_cons(stem, len(stem) - 1) and _is_cons(stem, len(stem) - 2)


def _cvc(stem: str) -> bool:
    n = len(stem)
    return n >= 3 and _is_cons(stem, n - 3) and not _is_cons(stem, n - 2) and _is_cons(stem, n - 1) and stem[-1] not in "wxy"


def _longest(w: str, rules):
    best = None
    for suf, rep in rules:
        if w.endswith(suf) and (best is None or len(suf) > len(best[0])):
            best = (suf, rep)
    return best


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # 1b
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = None
        if w.endswith("ed") and _has_vowel(w[:-2]):
            cut = w[:-2]
        elif w.endswith("ing") and _has_vowel(w[:-3]):
            cut = w[:-3]
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double_cons(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    # 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # 2, 3
    for rules in (STEP2, STEP3):
        hit = _longest(w, rules)
        if hit and _measure(w[: len(w) - len(hit[0])]) > 0:
            w = w[: len(w) - len(hit[0])] + hit[1]
    # 4
    hit = _longest(w, [(s, "") for s in STEP4])
    if hit:
        st = w[: len(w) - len(hit[0])]
        if _measure(st) > 1 and (hit[0] != "ion" or (st and st[-1] in "st")):
            w = st
    # 5a
    if w.endswith("e"):
        st = w[:-1]
        m = _measure(st)
        if m > 1 or (m == 1 and not _cvc(st)):
            w = st
    # 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w

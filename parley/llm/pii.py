"""Personal data: candidate generators scored by gradient-boosted trees.

1. Base finder (``base_spans``): the four fixed patterns with their checks.
   What it finds is always kept.
2. High-recall generators (``candidates``) propose further, overlapping spans:
   every window of neighbouring digit groups with 7 to 19 digits, obfuscated
   addresses, account numbers, long keys.
3. Every candidate becomes a row of format and context features; boosted trees
   (Spark ML ``GBTClassifier``) trained here score it.
4. Each kind has a threshold calibrated on held-out examples: the lowest score
   from which the share of true spans is at least ``PRECISION``.
5. Accepted candidates that overlap no base span and no better candidate join
   the base spans; so do numbers that a base card in truth lists.

Training examples are made by rule (``examples``): personal and harmless
formats, alone and in lists, set into words of a bounded sample of the corpus
(50 distinct words of each of ``CONTEXT_DOCS`` texts, picked by hash).  Their
number is fixed (``EXAMPLES``), so training does not grow with the corpus; every
document is scored whole.  The scan cuts a picked text to its words, and equal
ones are merged before the limit, so what reaches the driver depends on neither
the length of the texts nor the number of partitions.

All scans are linear in the text: each pattern starts only where a run
starts, so a megabyte of digits or letters costs one pass; a digit group begins
at most a dozen windows.

Edge cases: a null or empty text has no spans (digest of the empty string);
repeated rows each give their row; a null ``doc_id`` is kept; an empty table
gives no rows (the model is then trained without corpus words).
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "id", "key")
EXAMPLES = 4800
CONTEXT_DOCS = 200
TREES = 30
DEPTH = 5
PRECISION = 0.98
LEAST_DIGITS, MOST_DIGITS = 7, 19
LISTS = 10  # one in so many texts of the examples is a list of numbers
PIECE = 4096  # candidates scored at once
SLICE = 256  # texts redacted at once
SEED = 17

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run that starts inside a digit run cannot match where the run's start does not.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_DIGITS = re.compile(r"[0-9]+")
_GROUPS = re.compile(r"(?<![0-9A-Za-z_.])[+(]?[0-9]+(?:[ ().\-/:]{1,2}[0-9]+)*")
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}) ?", re.I)
_SPELT = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]+)+", re.I)
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}")

# Cue words looked for in the text before a span, by what they speak for.
CUES = {
    "reach": ("phone", "call", "tel", "mobile", "fax", "mail", "contact", "whatsapp"),
    "person": ("ssn", "social", "passport", "iban", "account", "licence", "insurance"),
    "secret": ("token", "key", "secret", "password", "bearer", "auth", "api"),
    "amount": ("price", "total", "version", "date", "isbn", "order", "page", "build", "commit", "range", "size", "sha"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the four base kinds, by start, then kind."""
    found: list[tuple[int, int, int]] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            found.append((start, 0, tail.end()))
        # Text before this sign cannot begin a later address; a domain may.
        floor = tail.end() if tail else at + 1
        at = text.find("@", floor)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return [(s, KINDS[k], e) for s, k, e in found]


def _windows(text: str, groups: list[tuple[int, int]]) -> Iterator[tuple[int, str, int]]:
    """Every window of neighbouring groups that may be a number of some kind."""
    for i, (start, _) in enumerate(groups):
        n, lead = 0, start - (start > 0 and text[start - 1] in "+(")
        for begin, end in groups[i : i + MOST_DIGITS]:
            n += end - begin
            if n > MOST_DIGITS:
                break
            if LEAST_DIGITS <= n <= 15:
                yield lead, "phone", end
            if n >= 13:
                yield lead, "card", end
            if n in (9, 11):
                yield lead, "id", end


def candidates(text: str) -> Iterator[tuple[int, str, int]]:
    """High-recall proposals ``(start, kind, end)``; they may overlap."""
    if _DIGIT.search(text):
        for m in _GROUPS.finditer(text):
            if m.end() - m.start() >= LEAST_DIGITS:
                yield from _windows(text, [g.span() for g in _DIGITS.finditer(text, m.start(), m.end())])
        for m in _ACCOUNT.finditer(text):
            yield m.start(), "id", m.end()
        for m in _KEY.finditer(text):
            run = m.group()
            if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
                yield m.start(), "key", m.end()
    for m in _AT.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in _LOCAL:  # at most back to the bracket of the sign before
            start -= 1
        tail = _SPELT.match(text, m.end())
        if tail and start < m.start():
            yield start, "email", tail.end()


FEATURES = (
    "kind email, kind card, kind phone, kind id, kind key, length, digits, letters, capitals, groups, first group, last group, longest group, "
    "separators, kinds of separator, colon or slash, plus sign, bracket, luhn, distinct characters, hexadecimal, quote before, quote after, "
    "sign before, blanks, last word, cue reach, cue person, cue secret, cue amount, checksum, date order, "
    "sign to the number before, its digits, that sign inside, sign to the number after, its digits, that sign inside"
).split(", ")


def _date_like(groups: list[str]) -> bool:
    return len(groups) >= 3 and (len(groups[0]) == 4 and groups[0][:2] in ("19", "20") or len(groups[2]) == 4 and groups[2][:2] in ("19", "20")) and all(len(g) <= 4 for g in groups[:3])


_SIGNS = " -./():,"


def _neighbour(text: str, at: int, step: int, span: str) -> list[float]:
    """What joins a span to a number beside it: the sign, that number's digits,
    whether the sign stands inside the span too."""
    i = at if step > 0 else at - 1
    sign, width = "", 0
    while 0 <= i < len(text) and width < 2 and text[i] in _SIGNS:
        sign, width, i = sign or text[i], width + 1, i + step
    digits = 0
    while 0 <= i < len(text) and digits < 9 and text[i] in "0123456789":
        digits, i = digits + 1, i + step
    return [1 + _SIGNS.index(sign), digits, sign in span] if sign and digits else [0, digits, False]


def _checksum(span: str) -> bool:
    """ISO 13616 remainder."""
    s = span.replace(" ", "").upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, kind: str, end: int) -> list[float]:
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    groups = re.findall(r"[0-9]+", span) or [""]
    seps = [c for c in span if not c.isalnum()]
    before = text[max(0, start - 32) : start].lower()
    last = before.rstrip()[-1:]
    row = [kind == k for k in ("email", "card", "phone", "id", "key")]
    row += [len(span), len(digits), sum(c.isalpha() for c in span), sum(c.isupper() for c in span), len(groups), len(groups[0]), len(groups[-1]), max(map(len, groups))]
    row += [len(seps), len(set(seps)), any(c in ":/" for c in seps), span[0] == "+", "(" in span, luhn(digits) if digits else False, len(set(span))]
    row += [all(c in "0123456789abcdefABCDEF" for c in span), before[-1:] in "\"'" and bool(before), text[end : end + 1] in ("\"", "'"), last in ("=", ":", "#", "$", "€")]
    row += [span.count(" "), len(re.split(r"[^A-Za-z]+", span)[-1])]
    words = re.findall(r"[a-z]+", before)
    row += [any(w in CUES[c] for w in words) for c in ("reach", "person", "secret", "amount")]
    row += [_checksum(span) if kind == "id" else False, _date_like(groups)]
    row += _neighbour(text, start, -1, span) + _neighbour(text, end, 1, span)
    return [float(x) for x in row]


def _with_luhn(rng: random.Random, n: int, valid: bool) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    good = next(str(d) for d in range(10) if luhn(body + str(d)))
    return body + (good if valid else str((int(good) + rng.randint(1, 9)) % 10))


def examples(words: list[str], n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, int, str, int, int]]:
    """``(text, start, kind, end, label)``: formats made by rule, in corpus words.

    Of a list of numbers every candidate is an example: windows that are one of
    its numbers against those that cut or join them.
    """
    rng = random.Random(seed)
    words = words or "the of and on was for with that from this".split()
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    word = lambda: re.sub(r"[^A-Za-z]", "", rng.choice(words)) or "an"

    def account(valid: bool) -> str:
        country, body = rng.choice(["DE", "FR", "ES", "GB"]), num(18)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        check = check if valid else (check + rng.randint(1, 90)) % 97
        s = f"{country}{check:02d}{body}"
        return rng.choice([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))])

    def grouped(s: str) -> str:
        sep = rng.choice([" ", "-"])
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    phone = lambda: rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(6)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(7)}"])
    social = lambda: f"{rng.randint(1, 899):03d}-{num(2)}-{num(4)}"

    def listed() -> list[tuple[str, int, str, int, int]]:
        """The candidates of a text with several numbers."""
        what = rng.choice(["phone", "phone", "id", "card", "after", "harmless"])
        if what == "phone":
            make, cue = rng.choice([phone, lambda: f"{num(3)}-{num(3)}-{num(4)}"]), rng.choice(["call", "tel:", "phone", "mobile"])
        elif what == "id":
            make, cue = social, rng.choice(["ssn", "social", "insurance"])
        elif what == "card":
            make, cue = (lambda: grouped(_with_luhn(rng, 16, True))), rng.choice(["account", ""])
        elif what == "after":
            make, cue = (lambda: f"{num(3)}-{num(3)}-{num(4)}"), f"{rng.choice(['order', 'page', 'total', 'build'])} {num(rng.randint(1, 6))}"
        else:
            make, cue = (lambda: num(rng.randint(1, 6))), rng.choice(["", "page", "total", "range", "size", "order"])
        many = rng.randint(4, 9) if what == "harmless" else 1 if what == "after" else rng.randint(2, 3)
        sign = rng.choice([" ", " ", ", ", "; ", "\n", " / "])
        head = " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
        text, true = f"{head} {cue} ", set()
        for k in range(many):
            text += sign if k else ""
            number = make()
            if what != "harmless":
                true.add((len(text), "phone" if what == "after" else what, len(text) + len(number)))
            text += number
        text += f" {' '.join(rng.choice(words) for _ in range(2))}"
        return [(text, *c, int(c in true)) for c in candidates(text)]

    made = []
    for i in range(n):
        if i % LISTS == LISTS - 1:
            made += listed()
            continue
        kind = ("email", "card", "phone", "id", "key")[i % 5]
        label = rng.randint(0, 1)
        cue = ""
        if kind == "email":
            at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", ".")])
            span = f"{word().lower()}.{word().lower()}{at}{word().lower()}{dot}com" if label else f"{word()}{rng.choice([' (at) ', '(at)'])}{word()}. {word()}"
            cue = rng.choice(["mail", "contact", ""]) if label else rng.choice(["", "price", "size"])
        elif kind == "card":
            span = grouped(_with_luhn(rng, 16, True)) if label else rng.choice([_with_luhn(rng, rng.randint(13, 19), False), grouped(_with_luhn(rng, 16, False)), num(13)])
            cue = rng.choice(["account", "", ""]) if label else rng.choice(["order", "isbn", "", "total"])
        elif kind == "phone":
            if label:
                span, cue = phone(), rng.choice(["call", "tel:", "phone", "mobile"])
            else:
                year = rng.randint(1950, 2039)
                span = rng.choice([f"{year}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{year}", num(rng.randint(7, 15)), f"{num(1)}.{num(2)}.{num(4)}", f"{year}-{year + 1}", f"{num(2)}:{num(2)}:{num(3)}", f"{num(4)} {num(4)}", f"{year}-01-02 {num(2)}:{num(2)}:{num(2)}", f"{num(3)}-{num(3)}-{num(4)}"])
                cue = rng.choice(["", "date", "version", "price", "range", "page", "build", "order"])
        elif kind == "id":
            if label:
                span, cue = rng.choice([(social(), rng.choice(["ssn", "social", "insurance"])), (account(True), rng.choice(["iban", "account", ""]))])
            else:
                span = rng.choice([account(False), num(9), num(11), f"{num(3)}-{num(3)}-{num(3)}", f"{num(3)} {num(3)} {num(3)}"])
                cue = rng.choice(["", "order", "total", "page", "build"])
        else:
            span = rng.choice([hexa(32), hexa(40), hexa(64), "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))])
            cue = rng.choice(['token = "', 'key: "', "secret=", "password = '", 'api key "']) if label else rng.choice(["commit", "sha", "", "build", "size"])
        head = " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
        lead = f"{head} {cue}"
        lead += "" if cue[-1:] in "\"'=" and cue else " "
        tail = rng.choice(['"', ""]) if cue[-1:] == '"' else ""
        text = f"{lead}{span}{tail} {' '.join(rng.choice(words) for _ in range(3))}"
        made.append((text, len(lead), kind, len(lead) + len(span), label))
    return made


def _tree(lines: list[str], at: int) -> tuple[object, int]:
    """One tree from its printed form: ``(feature, cut, left, right)`` or a value."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1]), at + 1
    feature, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left, at = _tree(lines, at + 1)
    right, at = _tree(lines, at + 1)
    return (int(feature), float(cut), left, right), at


def _values(node: object, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    below = x[:, node[0]] <= node[1]
    out = np.empty(len(x))
    out[below], out[~below] = _values(node[2], x[below]), _values(node[3], x[~below])
    return out


class Model:
    """The fitted trees with one threshold per kind, small enough for a task closure."""

    def __init__(self, trees: list, weights: list[float], cuts: dict[str, float]):
        self.trees, self.weights, self.cuts = trees, weights, cuts

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = sum(w * _values(t, x) for t, w in zip(self.trees, self.weights))
        return 1 / (1 + np.exp(-2 * margin))

    def more_spans(self, text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        """Accepted candidates that overlap neither a base span nor a better one.

        A base card that is in truth a list of numbers (two or more accepted
        candidates of other kinds hold all its digits) stays, as every base
        span does; its numbers are added.
        """
        free, best = _free([(s, e) for s, _, e in base]), []
        cards = [(s, e) for s, k, e in base if k == "card"]
        within = lambda c: c[1] != "card" and next(((s, e) for s, e in cards[max(0, bisect_left(cards, (c[0] + 1,)) - 1) :][:1] if s <= c[0] and c[2] <= e), None)
        proposed = (c for c in candidates(text) if free(c) or within(c))
        while piece := list(itertools.islice(proposed, PIECE)):
            scored = self.scores(np.array([features(text, *c) for c in piece]))
            best += [(-p, c) for p, c in zip(scored, piece) if p >= self.cuts[c[1]]]
        chosen = _disjoint([c for _, c in sorted(best)])
        listed: dict[tuple[int, int], list] = {}
        for c in chosen:
            if not free(c):
                listed.setdefault(within(c), []).append(c)
        digits = lambda s, e: sum(d in "0123456789" for d in text[s:e])
        whole = {c for card, parts in listed.items() if len(parts) > 1 and sum(digits(s, e) for s, _, e in parts) == digits(*card) for c in parts}
        return [c for c in chosen if c in whole or free(c)]


def _free(taken: list[tuple[int, int]]) -> Callable[[tuple[int, str, int]], bool]:
    """Whether a span overlaps none of ``taken``."""
    taken = sorted(taken)
    starts = [s for s, _ in taken]
    reach = list(itertools.accumulate((e for _, e in taken), max))

    def free(span: tuple[int, str, int]) -> bool:
        i = bisect_left(starts, span[2])
        return i == 0 or reach[i - 1] <= span[0]

    return free


def _disjoint(ranked: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Greedy choice in rank order of spans that do not overlap."""
    chosen: list[tuple[int, int, str]] = []
    for s, k, e in ranked:
        i = bisect_left(chosen, (e, -1, ""))
        if i == 0 or chosen[i - 1][1] <= s:
            insort(chosen, (s, e, k))
    return [(s, k, e) for s, e, k in chosen]


def context(docs: DataFrame, n: int = CONTEXT_DOCS) -> DataFrame:
    """``w``: 50 words of each of ``n`` different texts, the same in every run.

    Texts are picked by their hash below a cut that follows from the number of
    rows, and cut to words in the scan; equal ones are merged before the limit.
    """
    rows = docs.select("text").where("text <> ''")
    share = min(1.0, 8 * n / max(docs.count(), 1))
    h = F.xxhash64("text")
    picked = rows.where(F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30)))
    w = F.slice(F.array_sort(F.array_distinct(F.transform(F.split("text", r"\s+"), lambda x: F.substring(x, 1, 40)))), 1, 50)
    return picked.select(h.alias("h"), w.alias("w")).distinct().orderBy("h").limit(n).select("w")


def train(spark: SparkSession, docs: DataFrame | None = None, n: int = EXAMPLES, context_docs: int = CONTEXT_DOCS, seed: int = SEED) -> Model:
    words: list[str] = []
    if docs is not None:
        words = sorted({w for r in context(docs, context_docs).collect() for w in r.w if w and not any(c.isdigit() or c == "@" for c in w)})
    # Held-out examples use other words, so thresholds do not lean on the words seen.
    made = examples(words[::2], n * 2 // 3, seed)
    fit = range(len(made))
    made += examples(words[1::2], n // 3, seed + 1)
    held = range(len(fit), len(made))
    x = [features(t, s, k, e) for t, s, k, e, _ in made]
    y = [m[4] for m in made]
    frame = spark.createDataFrame([(x[i], float(y[i])) for i in fit], "x array<double>, label double").coalesce(1)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(frame.select(array_to_vector("x").alias("features"), "label"))
    trees = [_tree(t.toDebugString.strip().split("\n")[1:], 0)[0] for t in model.trees]
    out = Model(trees, list(model.treeWeights), {})
    scores = out.scores(np.array([x[i] for i in held]))
    for kind in KINDS:
        ranked = sorted(((p, y[i]) for p, i in zip(scores, held) if made[i][2] == kind), reverse=True)
        out.cuts[kind], true = math.inf, 0
        for j, (p, label) in enumerate(ranked, 1):
            true += label
            if true / j >= PRECISION and p > 0.5:
                out.cuts[kind] = p
    return out


def _written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


SPANS_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long"


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: base counts and digest, all spans."""
    model = model or train(docs.sparkSession, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py() or ""
                base = base_spans(text)
                more = model.more_spans(text, base)
                spans = sorted(base + more, key=lambda c: (c[0], KINDS.index(c[1]), c[2]))
                counts = [sum(k == kind for _, k, _ in base) for kind in KINDS[:4]]
                rows.append((i, *counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), len(more)))
            yield _batch(rows, SPANS_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS_SCHEMA)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``[KIND]``; other columns stay
    (``n_chars`` follows the new text when it is there).  A null text stays null."""
    model = model or train(docs.sparkSession, docs)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        base = base_spans(text)
        spans = sorted(base + model.more_spans(text, base), key=lambda c: (c[0], -c[2]))
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [text[at:s], f"[{k.upper()}]"]
            at = max(at, e)
        return "".join(out) + text[at:] if out else text

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        # A few texts at a time, so that a batch is never held as Python strings.
        parts = [pa.array([one(t.as_py()) for t in texts.slice(at, SLICE)], pa.string()) for at in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

"""Quality classifier: a weak-label model trains hashed linear scorers.

Two axes are judged, form (``quality``) and abuse (``toxic``).  For each:

1. Heuristic labellers vote bad, vote good or stay silent on every whole text.
   They overlap: a shouted text shows in its capitals, in its exclamation
   marks and in its lack of plain words.
2. The vote patterns are counted over all documents (their number is bounded
   by the labellers, not by the corpus) and expectation-maximisation estimates
   every labeller's accuracy and every pattern's posterior.  No given labels
   are read.
3. The posteriors label a bounded sample (at most ``TRAIN_DOCS`` distinct texts,
   chosen by their digest, each weighing as many rows as a sample of that size
   would hold of it) on which a logistic scorer over hashed tokens is trained:
   word shapes and repeats for form, words for abuse.
4. The scorers judge every whole document; it stays if neither finds it bad.

Edge cases: a null text is empty; on empty and very short texts the labellers
are silent and the scorers' intercepts decide, which keep the text unless most
documents are bad; repeated rows are judged alike; a null ``doc_id`` is kept;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 8_000
HASH_BITS = 14
EM_ROUNDS = 60
FIT_ROUNDS = 150
RIDGE = 1e-4
CUT = 0.5
PICK = 1 << 30

# Terms of abuse.
ABUSE = ("idiot", "moron", "stupid", "clown", "loser", "trash", "scum", "worthless", "pathetic", "disgusting")

BAD, GOOD, SILENT = "b", "g", "-"
AXES = {
    "quality": ("symbols", "capitals", "shouts", "repeats", "variety", "bare", "few_plain", "clean"),
    "toxic": ("first_terms", "second_terms", "several", "density", "none"),
}

# Byte classes for word shapes: letters become A or a (bytes beyond ASCII count
# as small letters), digits 0, white space a blank; other signs stay.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[9:14] = ord(" ")
_SYMBOL = re.compile(rb"[#$%&*@^~<>{}|\\]")
_PLAIN = re.compile(rb"A?a?[.,;:?]?")
_LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
_ABUSE = frozenset(w.encode() for w in ABUSE)
_FIRST = frozenset(w.encode() for w in ABUSE[::2])


class Measured:
    """What labellers and scorers see of one whole text."""

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        self.n = len(words)
        self.kinds = len(set(words))
        self.repeats = sum(map(eq, words, words[1:]))
        codes = _CLASS[np.frombuffer(raw, np.uint8)]
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        self.shapes = Counter(codes[new].tobytes().split())
        self.words = Counter(raw.lower().translate(_LETTERS).split())

    def share(self, test) -> float:
        return sum(c for s, c in self.shapes.items() if test(s)) / self.n

    def votes(self) -> str:
        return self.quality_votes() + self.toxic_votes()

    def quality_votes(self) -> str:
        if self.n < 5:
            return SILENT * len(AXES["quality"])
        again, varied = self.repeats / self.n, self.kinds / self.n
        many = self.n >= 40
        plain = self.share(_PLAIN.fullmatch)
        return "".join(
            (
                BAD if self.share(_SYMBOL.search) > 0.25 else SILENT,
                BAD if self.share(lambda s: b"A" in s and b"a" not in s) > 0.4 else SILENT,
                BAD if self.share(lambda s: b"!" in s) > 0.3 else SILENT,
                BAD if again > 0.2 else SILENT,
                BAD if many and varied < 0.3 else SILENT,
                BAD if self.share(lambda s: not (b"a" in s or b"A" in s or b"0" in s)) > 0.15 else SILENT,
                BAD if plain < 0.6 else SILENT,
                GOOD if plain > 0.85 and again < 0.04 and (not many or varied > 0.4) else SILENT,
            )
        )

    def toxic_votes(self) -> str:
        found = {w: self.words[w] for w in _ABUSE if w in self.words}
        hits = sum(found.values())
        first = len(_FIRST.intersection(found))
        return "".join(
            (
                BAD if first else SILENT,
                BAD if len(found) > first else SILENT,
                BAD if len(found) > 1 else SILENT,
                BAD if hits * 400 >= self.n else SILENT,
                SILENT if hits else GOOD,
            )
        )

    def features(self) -> dict[str, dict[int, float]]:
        slot = lambda token: zlib.crc32(token) & ((1 << HASH_BITS) - 1)
        n = max(self.n, 1)
        form: Counter = Counter()
        for s, c in self.shapes.items():
            form[slot(s[:12])] += c / n
            for sign in set(s):
                form[slot(b"sign " + bytes((sign,)))] += c / n
        if self.n >= 5:
            form[slot(b"adjacent repeats")] += self.repeats / n
        if self.n >= 40:
            form[slot(b"little variety")] += max(0.0, 0.5 - self.kinds / n)
        return {"quality": {k: v**0.5 for k, v in form.items()}, "toxic": dict.fromkeys(map(slot, self.words), 1.0)}


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over distinct vote patterns: posterior of bad per pattern, accuracy per
    labeller, share of bad.

    A labeller that speaks is right with its accuracy, whatever the class;
    silence says nothing.  Accuracies start at 0.9, which makes the labellers'
    majority the bad class, and stay above a half.
    """
    votes = np.array([[{BAD: 1, GOOD: -1, SILENT: 0}[v] for v in p] for p in patterns], dtype=float).reshape(len(patterns), -1)
    accuracy, share, p = np.full(votes.shape[1], 0.9), 0.1, np.zeros(len(patterns))
    for _ in range(rounds):
        z = votes @ np.log(accuracy / (1 - accuracy)) + np.log(share / (1 - share))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        right = ((votes > 0) * p[:, None] + (votes < 0) * (1 - p[:, None])) * counts[:, None]
        spoken = ((votes != 0) * counts[:, None]).sum(0)
        accuracy = np.clip((right.sum(0) + 9) / (spoken + 10), 0.55, 0.99)
        share = float(np.clip((p * counts).sum() / max(counts.sum(), 1), 0.01, 0.5))
    return p, accuracy, share


class Scorer:
    """Logistic scorer over hashed features."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def probability(self, x: dict[int, float]) -> float:
        z = self.intercept + float(self.weights[list(x)] @ np.fromiter(x.values(), float, len(x))) if x else self.intercept
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def fit(lengths: np.ndarray, col: np.ndarray, val: np.ndarray, target: np.ndarray, rounds: int = FIT_ROUNDS, count: np.ndarray | None = None) -> Scorer:
    """Full-batch Adam on soft labels with an L2 penalty; rare and common
    classes weigh the same.  Row ``i`` has ``lengths[i]`` entries of ``col``, ``val``
    and stands for ``count`` equal ones."""
    rows = len(lengths)
    count = np.ones(rows) if count is None else count
    n = float(count.sum())
    row = np.repeat(np.arange(rows, dtype=np.int32), lengths)
    bad = max(float((target * count).sum()), 1.0)
    weight = count * (target * (n / (2 * bad)) + (1 - target) * (n / (2 * max(n - bad, 1.0))))
    size = 1 << HASH_BITS
    w, m, s = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[col] * val, rows) + w[size]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / n
        g = np.append(np.bincount(col, e[row] * val, size), e.sum()) + RIDGE * np.append(w[:size], 0.0)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    # Move the intercept to the cut that agrees best with the labels, midway
    # between the two scores around it.
    z = np.bincount(row, w[col] * val, rows) + w[size]
    order = np.argsort(z)
    kept = (count * (1 - target)).sum()
    wrong = np.concatenate(([kept], kept + np.cumsum((count * (2 * target - 1))[order])))
    at = int(np.argmin(wrong))
    cut = (z[order[max(at - 1, 0)]] + z[order[min(at, len(z) - 1)]]) / 2
    if at == 0 or at == len(z):
        cut = 0.0
    return Scorer(w[:size].copy(), float(w[size] - cut))


def vote_patterns(docs: DataFrame) -> dict[str, int]:
    """Number of documents per vote pattern, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(Measured(t.as_py()).votes() for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])

    rows = docs.select("text").mapInArrow(run, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    return {r.votes: r.n for r in rows.collect()}


def label_models(seen: dict[str, int]) -> dict[str, dict]:
    """Per axis the posterior of each pattern and the labellers' accuracies."""
    out, at = {}, 0
    for axis, names in AXES.items():
        own: Counter = Counter()
        for votes, n in seen.items():
            own[votes[at : at + len(names)]] += n
        p, accuracy, share = estimate(list(own), np.array(list(own.values()), float))
        out[axis] = {"at": at, "posterior": dict(zip(own, p)), "accuracy": dict(zip(names, accuracy.tolist())), "share": share}
        at += len(names)
    return out


def sample(docs: DataFrame, total: int, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``d, n, text``: at most ``train_docs`` distinct texts with their weights,
    in the order of their digests.  A text of ``c`` rows weighs ``c`` times the
    rate, rounded up or down by its digest, whatever the ids of its rows."""
    rate = min(1.0, train_docs / total)
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).select(F.md5("text").alias("d"), "text")
    share = F.pmod(F.xxhash64("d"), F.lit(PICK)) / PICK
    counts = texts.groupBy("d").agg(F.count("*").alias("c")).withColumn("n", F.floor(F.col("c") * rate + share).cast("long"))
    chosen = counts.where("n > 0").orderBy(F.xxhash64("d", F.lit(1)), "d").limit(train_docs).select("d", "n")
    return texts.join(F.broadcast(chosen), "d").dropDuplicates(["d"]).orderBy("d").select("d", "n", "text")


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict[str, Scorer]:
    """One scorer per axis; nothing for an empty table."""
    seen = vote_patterns(docs)
    total = sum(seen.values())
    if not total:
        return {}
    models = label_models(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [Measured(t.as_py()) for t in batch.column(2)]
            rows = [(m.votes(), m.features()) for m in got]
            cols = [batch.column(1), pa.array([v for v, _ in rows], pa.string())]
            for axis in AXES:
                cols += [pa.array([list(f[axis]) for _, f in rows], pa.list_(pa.int32())), pa.array([list(f[axis].values()) for _, f in rows], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["n", "votes", "qk", "qv", "tk", "tv"])

    got = sample(docs, total, train_docs).mapInArrow(run, "n long, votes string, qk array<int>, qv array<float>, tk array<int>, tv array<float>").toArrow()
    votes, count = got.column("votes").to_pylist(), got.column("n").to_numpy().astype(float)
    scorers = {}
    for axis, k, v in (("quality", "qk", "qv"), ("toxic", "tk", "tv")):
        model = models[axis]
        target = np.array([model["posterior"][p[model["at"] : model["at"] + len(AXES[axis])]] for p in votes])
        keys, values = (got.column(c).combine_chunks() for c in (k, v))
        lengths = np.diff(keys.offsets.to_numpy())
        scorers[axis] = fit(lengths, keys.flatten().to_numpy(), values.flatten().to_numpy(), target, count=count)
    return scorers


def _judge(scorers: dict[str, Scorer], text: str | None) -> tuple[str, float, float]:
    m = Measured(text)
    f = m.features()
    return m.votes(), scorers["quality"].probability(f["quality"]), scorers["toxic"].probability(f["toxic"])


def score(docs: DataFrame, scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """``doc_id, votes, bad_quality, bad_toxic, stays`` for every row."""
    scorers = train(docs) if scorers is None else scorers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_judge(scorers, t.as_py()) for t in batch.column(1)]
            votes, q, x = zip(*rows) if rows else ((), (), ())
            cols = [batch.column(0), pa.array(votes, pa.string()), pa.array(q, pa.float64()), pa.array(x, pa.float64()), pa.array([a < CUT and b < CUT for a, b in zip(q, x)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "votes", "bad_quality", "bad_toxic", "stays"])

    schema = "doc_id long, votes string, bad_quality double, bad_toxic double, stays boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    scorers = train(docs) if scorers is None else scorers

    @F.pandas_udf("boolean")
    def stays(texts):
        return texts.map(lambda t: max(_judge(scorers, t)[1:]) < CUT)

    return docs.where(stays("text"))

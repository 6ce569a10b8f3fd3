"""Linear searches: all points and folds of a grid step together.

MLlib fits one model after the other, and every evaluation of a loss is a job.
Here every model of the search is a minimiser that asks for the loss and the
gradient at one point, and a job answers all of them: its tasks multiply their
rows with the points of all models at once.  What moves is the size of the
weights, whatever the rows.

The minimisers are those of MLlib, step by step (breeze's L-BFGS with the strong
Wolfe search, and OWL-QN with the backtracking one), over MLlib's objectives:
features centred and scaled by those of the fold's training side, elastic net
on the scaled weights.  Points that differ in ``maxIter`` alone are the same run
looked at after so many iterations.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Generator, Iterator, Mapping, Sequence

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import evaluate as ev
from parley.operators import network as nt

# The defaults of MLlib's estimators and breeze's minimisers.
TOLERANCE = 1e-6
MEMORY = 10
VALUES = 20
KINDS = ("logistic_regression", "linear_svc")
SETTINGS = {"maxIter", "regParam", "elasticNetParam"}

class _Failed(Exception):
    """A search for a step that found none."""


def _direction(history: list[tuple[np.ndarray, np.ndarray]], grad: np.ndarray) -> np.ndarray:
    """Minus the approximate inverse Hessian times ``grad``; the latest step is first."""
    out, used = grad.copy(), []
    diagonal = 1.0
    with np.errstate(all="ignore"):
        if history:
            step, change = history[0]
            along = step @ change
            if along < 0 or np.isnan(along):
                raise _Failed
            diagonal = along / (change @ change)
        for step, change in history:
            rho = step @ change
            a = (step @ out) / rho
            if np.isnan(a):
                raise _Failed
            out -= a * change
            used.append((a, rho))
        out *= diagonal
        for (step, change), (a, rho) in zip(history[::-1], used[::-1]):
            out += (a - (change @ out) / rho) * step
    return -out


def _interpolated(left: tuple, right: tuple) -> float:
    """Where the cubic through two brackets ``(t, value, slope)`` is least."""
    (a, fa, da), (b, fb, db) = left, right
    with np.errstate(all="ignore"):
        d1 = da + db - 3 * np.float64(fa - fb) / (a - b)
        d2 = np.sqrt(np.float64(d1 * d1 - da * db))
        t = float(b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2))
    low, high = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return low if t < low else high if t > high else t


def _wolfe(ask, value: float, slope: float, t: float) -> Generator:
    """breeze's strong Wolfe search (ten steps, ten zooms): the step's length."""
    if slope > 0:
        raise _Failed

    def zoom(low: tuple, high: tuple) -> Generator:
        for _ in range(10):
            t = _interpolated(high, low) if low[0] > high[0] else _interpolated(low, high)
            c = (t, *(yield from ask(t)))
            if c[1] > value + 1e-4 * t * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return t
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed

    low = (0.0, value, slope)
    for i in range(10):
        c = (t, *(yield from ask(t)))
        if math.isinf(c[1]) or math.isnan(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low, t = c, t * 1.5
    raise _Failed


def _backtracked(ask, plain: float, value: float, slope: float, t: float, shrink: float) -> Generator:
    """breeze's backtracking search (20 steps): the step's length.  It takes the
    value without penalty where the step starts for that of its first point."""
    # Where no penalty lifts the value, the first point is always shrunk.
    found = plain, (yield from ask(t, *([t * shrink, t * shrink * shrink] if plain == value else [])))[1]
    for i in range(20):
        if found[0] > value + t * slope * 1e-4:
            factor = shrink
        elif found[1] < 0.9 * slope:
            factor = 2.1
        elif found[1] > -0.9 * slope:
            factor = shrink
        else:
            return t
        if not 1e-10 <= t * factor <= 1e10:
            raise _Failed
        if i == 19:
            return t
        t *= factor
        found = yield from ask(t)
    return t


def minimised(x: np.ndarray, stops: Sequence[int], l1: np.ndarray | None = None, orthants: bool = False) -> Generator:
    """A minimiser: yields points, is sent ``(value, gradient)`` at each, and
    returns the point after each number of iterations of ``stops`` (the last one
    where it ended earlier).  ``orthants`` is OWL-QN with the penalty ``l1``."""
    known: list = []

    def at(p: np.ndarray, *ahead: np.ndarray) -> Generator:
        for q, answer in known:
            if np.array_equal(p, q):
                return answer
        asked = [p, *ahead]  # what may be needed next is answered in the same job
        known[:] = zip(asked, (yield asked))
        return known[0][1]

    def adjusted(p: np.ndarray, v: float, g: np.ndarray) -> tuple[float, np.ndarray]:
        if l1 is None:
            return v, g
        still = np.where(g - l1 > 0, g - l1, np.where(g + l1 < 0, g + l1, 0.0))
        return v + float(np.abs(l1 * p).sum()), np.where(l1 == 0, g, np.where(p == 0, still, g + np.sign(p) * l1))

    def moved(d: np.ndarray, t: float) -> np.ndarray:
        out = x + d * t
        if not orthants:
            return out
        side = np.where(x != 0, np.sign(x), np.sign(-slope_at))
        return np.where(np.sign(out) == side, out, 0.0)

    value, grad = yield from at(x)
    total, slope_at = adjusted(x, value, grad)
    first, seen, history, failed, n, kept = abs(total), [math.inf], [], False, 0, {}
    while True:
        kept |= {s: x for s in stops if s <= n and s not in kept}
        flat = float(np.linalg.norm(slope_at)) <= max(TOLERANCE * abs(total), 1e-8)
        if n >= max(stops) or flat or (len(seen) >= 2 and abs(total - max(seen)) <= TOLERANCE * first):
            break
        try:
            d = _direction(history, slope_at if orthants else grad)
            if orthants:
                d = np.where(d * slope_at < 0, d, 0.0)

            def ask(t: float, *ahead: float) -> Generator:
                p = moved(d, t)  # noqa: B023
                v, g = yield from at(p, *(moved(d, u) for u in ahead))  # noqa: B023
                v, g = adjusted(p, v, g)
                return v, float(d @ g)  # noqa: B023

            if orthants:
                length = float(np.linalg.norm(grad))
                t = yield from _backtracked(ask, value, total, float(d @ slope_at), 1.0 if n else 0.5 / length if length else math.inf, 0.5 if n else 0.1)
            else:
                length = float(np.linalg.norm(d))
                t = yield from _wolfe(ask, value, float(d @ grad), 1.0 if n else 1 / length if length else math.inf)
                if t * float(np.linalg.norm(grad)) < 1e-10:
                    raise _Failed
            new = moved(d, t)
            v, g = yield from at(new)
            history = [(new - x, g - grad), *history][:MEMORY]
            seen = [*seen, v][-VALUES:]
            x, value, grad, n, failed = new, v, g, n + 1, False
            total, slope_at = adjusted(x, value, grad)
        except _Failed:
            if failed:
                break
            failed, history = True, []
    return [kept.get(s, x) for s in stops]


def _folds(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and fold of the rows of a block, which has them in one number."""
    return y % 2, y // 2


class _Moments:
    """Rows, rows of class 1, and every feature's mean, squared deviations and range."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.n, self.ones, self.mean = len(y), y.sum(), x.mean(0)
        self.squares, self.low, self.high = ((x - self.mean) ** 2).sum(0), x.min(0), x.max(0)

    def __add__(self, other: _Moments) -> _Moments:
        out, n, apart = object.__new__(_Moments), self.n + other.n, other.mean - self.mean
        out.n, out.ones, out.mean = n, self.ones + other.ones, self.mean + apart * (other.n / n)
        out.squares = self.squares + other.squares + apart**2 * (self.n * other.n / n)
        out.low, out.high = np.minimum(self.low, other.low), np.maximum(self.high, other.high)
        return out

    @property
    def inverse(self) -> np.ndarray:
        """One over the standard deviation, none for a feature that never changes."""
        there = (self.low < self.high) & (self.squares > 0)
        return np.where(there, 1 / np.sqrt(np.where(there, self.squares, 1) / max(self.n - 1, 1)), 0.0)


def _moments(data: RDD) -> dict[float, _Moments]:
    """The moments of every fold's rows."""

    def partial(found: Iterator[tuple]) -> Iterator[tuple[float, _Moments]]:
        for x, y in map(nt.unpacked, found):
            label, fold = _folds(y)
            for k in np.unique(fold):
                yield float(k), _Moments(x[fold == k], label[fold == k])

    return dict(data.mapPartitions(partial).reduceByKey(lambda a, b: a + b).collect())


def _sums(kind: str, weights: np.ndarray, bias: np.ndarray, left_out: np.ndarray):
    """What a block adds to every model's loss and gradient: the models are
    columns, the rows of a model's held-out fold count for nothing."""

    def one(x: np.ndarray, y: np.ndarray, place: tuple[int, int]) -> np.ndarray:
        label, fold = _folds(y)
        margin = x @ weights + bias
        label = label[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            if kind == "logistic_regression":
                loss, back = np.logaddexp(0, margin) - label * margin, 1 / (1 + np.exp(-margin)) - label
            else:
                sign = 2 * label - 1
                loss = np.maximum(1 - sign * margin, 0)
                back = np.where(1 > sign * margin, -sign, 0.0)
        held = fold[:, None] == left_out
        loss[held], back[held] = 0, 0
        return np.concatenate([loss.sum(0), back.sum(0), (x.T @ back).reshape(-1)])

    return one


def _hits(weights: np.ndarray, bias: np.ndarray, left_out: np.ndarray):
    """Held-out rows by model, label and prediction."""

    def one(x: np.ndarray, y: np.ndarray, place: tuple[int, int]) -> np.ndarray:
        label, fold = _folds(y)
        held, said = fold[:, None] == left_out, x @ weights + bias > 0
        return np.stack([(held & (label[:, None] == a) & (said == p)).sum(0) for a in (0, 1) for p in (0, 1)], 1).reshape(-1).astype(float)

    return one


def fitted(kind: str, data: RDD, moments: Mapping[float, _Moments], models: Sequence[tuple[int, float, float]], stops: Sequence[int]) -> list[list[tuple[np.ndarray, float]]]:
    """Weights and intercept of every model (held-out fold, or -1 for none;
    ``regParam``; ``elasticNetParam``) after each number of iterations of
    ``stops``, all fitted side by side."""
    sides = {k: _sum([m for f, m in sorted(moments.items()) if f != k]) for k, _, _ in models}
    runs, asked, out = {}, {}, [[] for _ in models]
    for i, (k, reg, net) in enumerate(models):
        side = sides[k]
        width = len(side.mean)
        start = np.zeros(width + 1)
        if kind == "logistic_regression":
            if side.ones in (0, side.n):  # one class alone: MLlib fits nothing
                out[i] = [(np.zeros(width), math.inf if side.ones else -math.inf)] * len(stops)
                continue
            start[-1] = math.log(side.ones / (side.n - side.ones))
        logistic = kind == "logistic_regression"
        l1 = np.r_[np.full(width, net * reg if logistic else 0.0), 0.0]
        runs[i] = minimised(start, stops, l1, True) if not logistic or net * reg > 0 else minimised(start, stops)
        asked[i] = next(runs[i])

    def plain(i: int, p: np.ndarray) -> tuple[np.ndarray, float]:
        side = sides[models[i][0]]
        w = p[:-1] * side.inverse
        return w, p[-1] - float(w @ side.mean)

    while asked:
        now = [(i, p) for i in sorted(asked) for p in asked[i]]
        weights, bias = zip(*(plain(i, p) for i, p in now))
        work = _sums(kind, np.stack(weights, 1), np.array(bias), np.array([models[i][0] for i, _ in now], float))
        width = len(weights[0])
        _, total = nt._totals(data, [len(now) * (width + 2)], work)
        loss, back, grads = total[: len(now)], total[len(now) : 2 * len(now)], total[2 * len(now) :].reshape(width, len(now))
        answers: dict[int, list] = {i: [] for i in asked}
        for j, (i, p) in enumerate(now):
            k, reg, net = models[i]
            side = sides[k]
            l2 = reg * (1 - net) if kind == "logistic_regression" else reg
            grad = np.r_[(grads[:, j] - side.mean * back[j]) * side.inverse, back[j]] / side.n
            grad[:-1] += l2 * p[:-1]
            answers[i].append((loss[j] / side.n + l2 * float(p[:-1] @ p[:-1]) / 2, grad))
        for i, answer in answers.items():
            try:
                asked[i] = runs[i].send(answer)
            except StopIteration as end:
                out[i] = [plain(i, q) for q in end.value]
                del asked[i]
    return out


def _sum(parts: Sequence[_Moments]) -> _Moments:
    return parts[0] if len(parts) == 1 else _sum(parts[:-1]) + parts[-1]


def search(kind: str, df: DataFrame, rows: int, points: Sequence[Mapping[str, float]], defaults: Mapping[str, float], metric: str, fold_col: str, num_folds: int, features: str, label: str) -> tuple[list[list[float]], list[tuple[np.ndarray, float]]]:
    """Per fold the metric of every point, and every point's model over all rows."""
    whole = [{**defaults, **p} for p in points]
    settings = sorted({(p["regParam"], p["elasticNetParam"]) for p in whole})
    stops = sorted({p["maxIter"] for p in whole})
    sc = df.sparkSession.sparkContext
    parts = min(df.rdd.getNumPartitions(), sc.defaultParallelism, rows // 1000 + 1)
    coded = F.col(label).cast("double") + 2 * F.col(fold_col)
    data = nt.blocks(df.coalesce(parts).select(vector_to_array(features).alias("x"), coded.alias("y"))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = [(k, *s) for k in [*range(num_folds), -1] for s in settings]
        runs = dict(zip(models, fitted(kind, data, _moments(data), models, stops)))
        found = lambda k, p: runs[(k, p["regParam"], p["elasticNetParam"])][stops.index(p["maxIter"])]
        places = list(itertools.product(range(num_folds), range(len(points))))
        tested = [found(k, whole[i]) for k, i in places]
        _, hits = nt._totals(data, [4 * len(places)], _hits(np.stack([w for w, _ in tested], 1), np.array([b for _, b in tested]), np.array([k for k, _ in places], float)))
    finally:
        data.unpersist()
    counts = [(f"{k}/{i}", j // 2, j % 2, int(n)) for (k, i), four in zip(places, hits.reshape(-1, 4)) for j, n in enumerate(four) if n]
    counts = df.sparkSession.createDataFrame(counts, "model string, actual int, predicted int, n long")
    values = {r["model"]: r["value"] for r in ev.classification_metrics(counts).where(F.col("metric") == metric).collect()}
    return [[values[f"{k}/{i}"] for i in range(len(points))] for k in range(num_folds)], [found(-1, p) for p in whole]

"""A feed-forward network trained on the cluster, and its adaptive search.

Three ReLU layers with dropout and L1/L2 penalties, one sigmoid output, binary
cross-entropy.  Training is data-parallel and synchronous: a step broadcasts the
weights, every partition sums its rows' gradients in numpy, the sums are merged
in two levels, and the driver makes the update.  What moves is the size of the
weights (``Config.size`` numbers a network), whatever the rows.

Networks train together: a step computes the gradients of all networks of a
rung in one job over the data, so a rung of 27 networks costs the scans of one.

``search`` is Hyperband: in each bracket many configurations get a small budget
of steps, the best third goes on with three times the budget, continued from
the weights and moments stored at the end of the rung.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import train as tr

# The search space and the width of the features.
UNITS = tuple(range(16, 129, 16))
DROPOUT = tuple(round(0.05 * i, 2) for i in range(15))
PENALTY = (1e-7, 1e-1)  # log-uniform
RATE = (1e-5, 1e-2)  # log-uniform
OPTIMIZERS = ("adam", "sgd", "rmsprop", "nadam")
N_FEATURES = 400
SEED = tr.SEED
EPSILON = 1e-7
DENSE = 0.8  # share of numbers other than zero from which a block is kept whole
DIRECT_BYTES = 32 << 20  # sums of partitions that go to the driver without a second level


@dataclass(frozen=True)
class Config:
    units: tuple[int, ...] = (64, 32, 16)
    dropout: tuple[float, ...] = (0.2, 0.1, 0.0)
    l1: tuple[float, ...] = (1e-6, 1e-6, 1e-6)
    l2: tuple[float, ...] = (1e-4, 1e-4, 1e-4)
    optimizer: str = "adam"
    rate: float = 0.01
    beta1: float = 0.9  # momentum of sgd, decay of rmsprop
    beta2: float = 0.999
    n_features: int = N_FEATURES

    @property
    def shapes(self) -> list[tuple[int, int]]:
        widths = [self.n_features, *self.units, 1]
        return list(zip(widths[:-1], widths[1:]))

    @property
    def size(self) -> int:
        return sum(a * b + b for a, b in self.shapes)

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views of the weight matrix and bias of every layer."""
        out, at = [], 0
        for a, b in self.shapes:
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out


@dataclass
class State:
    """A network in training: weights, moments of the optimiser, steps made."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0


def start(config: Config, seed: int = SEED) -> State:
    """He-uniform weights for the ReLU layers, Glorot-uniform for the output."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(config.size)
    layers = config.layers(flat)
    for i, (w, _) in enumerate(layers):
        limit = math.sqrt(6 / (w.shape[0] + (w.shape[1] if i == len(layers) - 1 else 0)))
        w[:] = rng.uniform(-limit, limit, w.shape)
    return State(flat, np.zeros(config.size), np.zeros(config.size))


def forward(config: Config, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Probability of class 1 (no dropout)."""
    layers = config.layers(flat)
    for w, b in layers[:-1]:
        x = np.maximum(x @ w + b, 0)
    w, b = layers[-1]
    return 1 / (1 + np.exp(-np.clip((x @ w + b)[:, 0], -500, 500)))


def loss_sum(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, EPSILON, 1 - EPSILON)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def gradient(config: Config, flat: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
    """Sum over the rows of the cross-entropy and of its gradient; with ``rng``
    units drop out, the others scaled up."""
    layers, seen, masks = config.layers(flat), [x], []
    for (w, b), rate in zip(layers[:-1], config.dropout):
        h = np.maximum(seen[-1] @ w + b, 0)
        mask = (rng.random(h.shape) >= rate) / (1 - rate) if rng is not None and rate > 0 else 1.0
        masks.append((h > 0) * mask)
        seen.append(h * mask)
    w, b = layers[-1]
    p = 1 / (1 + np.exp(-np.clip((seen[-1] @ w + b)[:, 0], -500, 500)))
    out = np.zeros(config.size)
    back = (p - y)[:, None]
    for i in range(len(layers) - 1, -1, -1):
        gw, gb = config.layers(out)[i]
        gw[:], gb[:] = seen[i].T @ back, back.sum(0)
        if i:
            back = (back @ layers[i][0].T) * masks[i - 1]
    return loss_sum(p, y), out


def penalty(config: Config, flat: np.ndarray) -> tuple[float, np.ndarray]:
    """L1 and L2 of the hidden layers' matrices and their gradient."""
    total, out = 0.0, np.zeros(config.size)
    for (w, _), (g, _), l1, l2 in zip(config.layers(flat), config.layers(out), config.l1, config.l2):
        total += l1 * np.abs(w).sum() + l2 * (w * w).sum()
        g[:] = l1 * np.sign(w) + 2 * l2 * w
    return float(total), out


def update(config: Config, state: State, grad: np.ndarray) -> None:
    """One step of the configuration's optimiser."""
    state.step += 1
    t, b1, b2, rate = state.step, config.beta1, config.beta2, config.rate
    if config.optimizer == "sgd":
        state.first = b1 * state.first - rate * grad
        state.weights = state.weights + state.first
        return
    if config.optimizer == "rmsprop":
        state.second = b1 * state.second + (1 - b1) * grad * grad
        state.weights = state.weights - rate * grad / (np.sqrt(state.second) + EPSILON)
        return
    state.first = b1 * state.first + (1 - b1) * grad
    state.second = b2 * state.second + (1 - b2) * grad * grad
    first, second = state.first / (1 - b1**t), state.second / (1 - b2**t)
    if config.optimizer == "nadam":
        first = b1 * first + (1 - b1) * grad / (1 - b1**t)
    elif config.optimizer != "adam":
        raise ValueError(f"unknown optimizer {config.optimizer!r}")
    state.weights = state.weights - rate * first / (np.sqrt(second) + EPSILON)


def _rows(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))


def blocks(rows: DataFrame) -> RDD:
    """``rows`` (``x, y``) as ``(numbers, places, y, size)``, one per Arrow
    batch, in bytes: a persisted block reaches numpy as it is, without a plan or a
    conversion per step.  Of a block with many zeros only the other numbers are
    kept, and a bit for every place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
                there = x != 0
                sparse = len(x) > 0 and there.mean() < DENSE
                parts = (x[there], np.packbits(there), y) if sparse else (x, np.zeros(0, np.uint8), y)
                yield pa.RecordBatch.from_arrays([*(pa.array([v.tobytes()], pa.binary()) for v in parts), pa.array([len(x)], pa.int64())], names=["x", "places", "y", "n"])

    return rows.mapInArrow(pack, "x binary, places binary, y binary, n long").rdd.map(lambda r: (bytes(r.x), bytes(r.places), bytes(r.y), r.n))


def unpacked(block: tuple[bytes, bytes, bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The features (rows x width) and labels of a block."""
    x, places, y, n = *(np.frombuffer(v, kind) for v, kind in zip(block, (float, np.uint8, float))), block[3]
    if len(places):
        whole = np.zeros(n)
        whole[np.unpackbits(places, count=n).view(bool)] = x
        x = whole
    return x.reshape(len(y), -1), y


def _totals(data: RDD | DataFrame, sizes: Sequence[int], one: Callable) -> tuple[int, np.ndarray]:
    """Rows and the sums of ``one(x, y, (partition, block))`` (a vector of
    ``sum(sizes)`` numbers) over all rows: summed per partition, then, where
    that is much, in two levels."""
    data, width = data if isinstance(data, RDD) else blocks(data), sum(sizes)

    def partial(part: int, found: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        n, total = 0, np.zeros(width)
        for k, (x, y) in enumerate(map(unpacked, found)):
            total += one(x, y, (part, k))
            n += len(y)
        yield n, total

    def merge(found: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        n, total = 0, np.zeros(width)
        for k, v in found:
            n, total = n + k, total + v
        yield n, total

    sums, parts = data.mapPartitionsWithIndex(partial), data.getNumPartitions()
    if parts * width * 8 > DIRECT_BYTES and parts > 4:
        groups = math.isqrt(parts)
        dealt = sums.mapPartitionsWithIndex(lambda p, found: ((p % groups, v) for v in found)).partitionBy(groups, int)
        sums = dealt.values().mapPartitions(merge)
    found = sums.collect()
    return sum(n for n, _ in found), sum((v for _, v in found), np.zeros(width))


def train_together(data: RDD | DataFrame, configs: Sequence[Config], states: Sequence[State], steps: int, seed: int = SEED) -> list[float]:
    """``steps`` steps of every network in place, one job a step; the penalised
    training loss of each before its last step.  ``data`` (``x, y``, or their
    ``blocks``) should be persisted."""
    data = data if isinstance(data, RDD) else blocks(data)
    sc, losses = data.context, [math.nan] * len(configs)
    sizes = [c.size + 1 for c in configs]
    for _ in range(steps):
        shared = sc.broadcast([(c, s.weights, s.step) for c, s in zip(configs, states)])

        def one(x: np.ndarray, y: np.ndarray, place: tuple[int, int]) -> np.ndarray:
            out = []
            for config, weights, step in shared.value:  # noqa: B023
                rng = np.random.default_rng([seed, step, *place])
                loss, grad = gradient(config, weights, x, y, rng)
                out += [[loss], grad]
            return np.concatenate(out)

        n, total = _totals(data, sizes, one)
        shared.unpersist()
        if not n:
            return losses
        at = 0
        for i, (config, state) in enumerate(zip(configs, states)):
            part = total[at : at + sizes[i]] / n
            at += sizes[i]
            extra, grad = penalty(config, state.weights)
            losses[i] = part[0] + extra
            update(config, state, part[1:] + grad)
    return losses


def held_out_losses(data: RDD | DataFrame, configs: Sequence[Config], states: Sequence[State]) -> list[float]:
    """Mean cross-entropy of every network, in one job."""
    data = data if isinstance(data, RDD) else blocks(data)
    shared = data.context.broadcast([(c, s.weights) for c, s in zip(configs, states)])

    def one(x: np.ndarray, y: np.ndarray, place: tuple[int, int]) -> np.ndarray:
        return np.array([loss_sum(forward(c, w, x), y) for c, w in shared.value])

    n, total = _totals(data, [1] * len(configs), one)
    shared.unpersist()
    return (total / n).tolist() if n else [math.nan] * len(configs)


def train_network(df: DataFrame, config: Config = Config(), steps: int = 60, features: str = tr.FEATURES, label: str = tr.LABEL, seed: int = SEED) -> State:
    data = blocks(_rows(df, features, label)).persist(StorageLevel.MEMORY_AND_DISK)
    state = start(config, seed)
    try:
        train_together(data, [config], [state], steps, seed)
    finally:
        data.unpersist()
    return state


def predictor(config: Config, state: State) -> Callable:
    """A predict factory for ``score_with_model``."""
    weights = state.weights

    def make():
        return lambda x: forward(config, weights, np.asarray(x, float))

    return make


def save_networks(spark: SparkSession, path: str, configs: Sequence[Config], states: Sequence[State]) -> None:
    """Store networks with everything that training needs to go on."""
    rows = [(i, json.dumps(asdict(c)), s.step, *(v.tobytes() for v in (s.weights, s.first, s.second))) for i, (c, s) in enumerate(zip(configs, states))]
    spark.createDataFrame(rows, "i int, config string, step int, weights binary, first binary, second binary").write.mode("overwrite").parquet(path)


def load_networks(spark: SparkSession, path: str) -> tuple[list[Config], list[State]]:
    configs, states = [], []
    for r in spark.read.parquet(path).orderBy("i").collect():
        raw = json.loads(r.config)
        configs.append(Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}))
        states.append(State(*(np.frombuffer(v).copy() for v in (r.weights, r.first, r.second)), r.step))
    return configs, states


def draw(n: int, seed: int = SEED, n_features: int = N_FEATURES) -> list[Config]:
    """Configurations of the search space."""
    rng = random.Random(seed)
    log = lambda low, high: math.exp(rng.uniform(math.log(low), math.log(high)))
    three = lambda f: tuple(f() for _ in range(3))
    out = []
    for _ in range(n):
        optimizer = rng.choice(OPTIMIZERS)
        beta1 = log(0.1, 0.9) if optimizer in ("sgd", "rmsprop") else log(0.85, 0.95)
        out.append(Config(three(lambda: rng.choice(UNITS)), three(lambda: rng.choice(DROPOUT)), three(lambda: log(*PENALTY)), three(lambda: log(*PENALTY)), optimizer, log(*RATE), beta1, log(0.99, 0.999), n_features))
    return out


def brackets(most: int, eta: int = 3, least: int = 5) -> list[list[tuple[int, int]]]:
    """Per bracket the rungs as (networks, budget in steps)."""
    top = int(math.log(most / least) / math.log(eta) + 1e-9)
    out = []
    for s in range(top, -1, -1):
        n = math.ceil((top + 1) / (s + 1) * eta**s)
        out.append([(max(1, n // eta**i), most // eta ** (s - i)) for i in range(s + 1)])
    return out


def search(df: DataFrame, folder: str, most: int = 45, eta: int = 3, least: int = 5, features: str = tr.FEATURES, label: str = tr.LABEL, base_id: str = "conv_id", n_features: int = N_FEATURES, seed: int = SEED) -> list[dict]:
    """Hyperband over ``draw``'s configurations: one row per network and rung
    (``bracket, rung, network, config, budget, loss, kept``), the loss on a fifth
    of the base ids.  The networks of a rung are stored under ``folder`` and the
    next rung reads them from there."""
    spark = df.sparkSession
    side = tr.hash_bucket(base_id, 100, SEED + 2) < int(round(tr.TRAIN_RATIO * 100))
    fit, held = (blocks(_rows(df.where(s), features, label)).persist(StorageLevel.MEMORY_AND_DISK) for s in (side, ~side))
    out, drawn = [], 0
    try:
        for b, rungs in enumerate(brackets(most, eta, least)):
            configs = draw(rungs[0][0], seed + b, n_features)
            states = [start(c, seed + drawn + i) for i, c in enumerate(configs)]
            numbers = list(range(drawn, drawn + len(configs)))
            drawn += len(configs)
            for rung, (_, budget) in enumerate(rungs):
                train_together(fit, configs, states, budget - states[0].step, seed)
                losses = held_out_losses(held, configs, states)
                order = sorted(range(len(configs)), key=lambda i: (math.isnan(losses[i]), losses[i], numbers[i]))  # noqa: B023
                keep = order[: rungs[rung + 1][0]] if rung + 1 < len(rungs) else order[:1]
                for i, c in enumerate(configs):
                    out.append({"bracket": b, "rung": rung, "network": numbers[i], "config": json.dumps(asdict(c)), "budget": budget, "loss": losses[i], "kept": i in keep})
                path = f"{folder}/bracket-{b}-rung-{rung}"
                save_networks(spark, path, [configs[i] for i in keep], [states[i] for i in keep])
                configs, states = load_networks(spark, path)
                numbers = [numbers[i] for i in keep]
    finally:
        fit.unpersist()
        held.unpersist()
    return out

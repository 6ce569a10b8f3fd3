"""The network: gradients, data-parallel steps, stored states, adaptive search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from parley.operators import network as nt
from parley.operators import train as tr

SMALL = nt.Config((6, 5, 4), (0.0, 0.0, 0.0), (1e-3, 0.0, 1e-4), (1e-2, 1e-3, 0.0), "adam", 0.02, 0.9, 0.999, 3)


def rows(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, (x[:, 0] * x[:, 1] > 0).astype(float)


@pytest.fixture(scope="module")
def data(spark):
    x, y = rows(240)
    made = spark.createDataFrame([(f"c{i}", int(y[i]), x[i].tolist()) for i in range(len(x))], "conv_id string, label int, x array<double>")
    return made.select("conv_id", "label", array_to_vector("x").alias(tr.FEATURES)).repartition(7).cache()


def test_gradients_equal_finite_differences():
    x, y = rows(20)
    flat = nt.start(SMALL, 3).weights
    loss, grad = nt.gradient(SMALL, flat, x, y)
    extra, slope = nt.penalty(SMALL, flat)
    assert np.isclose(loss, nt.loss_sum(nt.forward(SMALL, flat, x), y))
    for i in np.random.default_rng(0).choice(SMALL.size, 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        both = [nt.loss_sum(nt.forward(SMALL, f, x), y) + nt.penalty(SMALL, f)[0] for f in (up, down)]
        assert np.isclose((both[0] - both[1]) / 2e-6, grad[i] + slope[i], rtol=1e-4, atol=1e-5)


def test_dropout_keeps_the_mean_and_is_off_without_a_generator():
    x, y = rows(4000)
    config = nt.Config((40, 20, 10), (0.5, 0.3, 0.0), n_features=3)
    flat = nt.start(config, 1).weights
    same = nt.gradient(config, flat, x, y)[1]
    assert np.array_equal(same, nt.gradient(config, flat, x, y)[1])
    dropped = np.mean([nt.gradient(config, flat, x, y, np.random.default_rng(k))[1] for k in range(30)], axis=0)
    assert not np.array_equal(same, dropped) and np.corrcoef(same, dropped)[0, 1] > 0.8


def test_steps_over_partitions_equal_steps_over_all_rows(spark, data):
    """Two networks trained together on seven partitions, and one by one on one array."""
    x, y = rows(240)
    other = nt.Config((4, 4, 4), (0.0,) * 3, (0.0,) * 3, (0.0,) * 3, "nadam", 0.01, 0.9, 0.99, 3)
    configs, states = [SMALL, other], [nt.start(SMALL, 1), nt.start(other, 2)]
    spread = nt._rows(data, tr.FEATURES, "label")
    nt.train_together(spread, configs, states, 4)
    for config, state, seed in ((SMALL, states[0], 1), (other, states[1], 2)):
        plain = nt.start(config, seed)
        for _ in range(4):
            nt.update(config, plain, nt.gradient(config, plain.weights, x, y)[1] / len(x) + nt.penalty(config, plain.weights)[1])
        assert np.allclose(plain.weights, state.weights, atol=1e-10) and state.step == 4
    assert np.allclose(nt.held_out_losses(spread, configs, states), [nt.loss_sum(nt.forward(c, s.weights, x), y) / len(x) for c, s in zip(configs, states)])
    assert np.isnan(nt.held_out_losses(spread.limit(0), configs, states)).all()


@pytest.mark.parametrize("optimizer", nt.OPTIMIZERS)
def test_every_optimizer_learns(optimizer):
    x, y = rows(300)
    config = nt.Config((16, 8, 8), (0.0,) * 3, (0.0,) * 3, (0.0,) * 3, optimizer, 0.3 if optimizer == "sgd" else 0.01, 0.9, 0.999, 3)
    state = nt.start(config, 5)
    before = nt.loss_sum(nt.forward(config, state.weights, x), y)
    for _ in range(150):
        nt.update(config, state, nt.gradient(config, state.weights, x, y)[1] / len(x))
    assert nt.loss_sum(nt.forward(config, state.weights, x), y) < 0.6 * before


def test_stored_networks_go_on_where_they_were(spark, data, scratch):
    spread = nt._rows(data, tr.FEATURES, "label").cache()
    dropping = nt.Config((6, 5, 4), (0.3, 0.1, 0.0), n_features=3)
    whole, halves = [nt.start(dropping, 1)], [nt.start(dropping, 1)]
    nt.train_together(spread, [dropping], whole, 4)
    nt.train_together(spread, [dropping], halves, 2)
    nt.save_networks(spark, f"{scratch}/n", [dropping], halves)
    configs, states = nt.load_networks(spark, f"{scratch}/n")
    assert configs == [dropping] and states[0].step == 2
    nt.train_together(spread, configs, states, 2)
    assert np.allclose(states[0].weights, whole[0].weights, atol=1e-12)


def test_brackets_share_the_budget():
    assert nt.brackets(45) == [[(9, 5), (3, 15), (1, 45)], [(5, 15), (1, 45)], [(3, 45)]]
    assert nt.brackets(5) == [[(1, 5)]]


def test_search_reports_every_rung_and_reruns_agree(data, scratch):
    found = nt.search(data, f"{scratch}/a", most=9, least=3, n_features=3)
    assert [(r["bracket"], r["rung"], r["budget"]) for r in found] == [(0, 0, 3)] * 3 + [(0, 1, 9)] + [(1, 0, 9)] * 2
    again = nt.search(data, f"{scratch}/b", most=9, least=3, n_features=3)
    assert [(r["config"], r["kept"]) for r in found] == [(r["config"], r["kept"]) for r in again]
    for b, rung in {(r["bracket"], r["rung"]) for r in found}:
        part = [r for r in found if (r["bracket"], r["rung"]) == (b, rung)]
        assert max(r["loss"] for r in part if r["kept"]) <= min([r["loss"] for r in part if not r["kept"]], default=np.inf)


def test_blocks_keep_every_number(spark):
    rng = np.random.default_rng(2)
    for share in (0.0, 0.3, 1.0):
        x = np.where(rng.random((37, 11)) < share, rng.normal(size=(37, 11)), 0.0)
        made = spark.createDataFrame([(v.tolist(), float(i)) for i, v in enumerate(x)], "x array<double>, y double").coalesce(1)
        (found,) = nt.blocks(made).collect()
        got, y = nt.unpacked(found)
        assert np.array_equal(got, x) and np.array_equal(y, np.arange(37))
        assert len(found[0]) == 8 * np.count_nonzero(x)


def test_sums_in_two_levels_equal_direct_ones(data, monkeypatch):
    spread = nt.blocks(nt._rows(data, tr.FEATURES, "label")).cache()
    one = lambda x, y, place: np.concatenate([x.sum(0), [y.sum()]])
    direct = nt._totals(spread, [3, 1], one)
    monkeypatch.setattr(nt, "DIRECT_BYTES", 0)
    merged = nt._totals(spread, [3, 1], one)
    assert direct[0] == merged[0] == 240 and np.allclose(direct[1], merged[1])


def test_a_step_plans_nothing(spark, data, monkeypatch):
    """The rows are converted once; a step only reads the stored blocks."""
    made = []
    whole = nt.blocks
    monkeypatch.setattr(nt, "blocks", lambda rows: made.append(1) or whole(rows))
    nt.train_network(data, SMALL, steps=3)
    assert made == [1]

"""Exact sums, stacked populations and tiles."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from evalgrid.functions.exact import BLOCK, Adder, exact_sums, total
from evalgrid.functions.losses import COSTS
from evalgrid.functions.squash import SQUASHES, limited_array
from evalgrid.operators.scoring import partials, score_bin, score_population
from evalgrid.plans.arrow_tier import Shared, tiles
from evalgrid.plans.creature import Creature, Neuron, Synapse, compile_creature
from evalgrid.queries import NETWORKS, POPULATION
from evalgrid.sources import corpus as C
from evalgrid.sources import creatures as K
from evalgrid.streaming.racing import CONTINUE, race

from .test_scorer import corpus


def values(n, seed=0):
    rng = random.Random(seed)
    some = [rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-30, 30) for _ in range(n)]
    return some + [0.0, -0.0, 1.0, 2.0**-52, 0.5, 1e16, -1e16, 2.0**26, 2.0**26 - 2.0**-20, 1.0 - 2.0**-53]


def exactly(xs):
    return float(sum(map(Fraction, xs)))


@pytest.mark.parametrize("parts", [1, 5, 32])
def test_expression_sums_are_exact_for_any_split(spark, parts):
    rows = [(i % 3, x) for i, x in enumerate(values(999))]
    df = spark.createDataFrame([*rows, (7, math.nan), (7, 1.0), (8, 0.0), (9, math.inf)], "k int, x double").repartition(parts)
    got = {r.k: (r.s, r.n) for r in exact_sums(df, ["k"], "x", "s").collect()}
    for k in range(3):
        own = [x for i, x in rows if i == k]
        assert got[k] == (exactly(own), len(own))
    assert math.isnan(got[7][0]) and got[7][1] == 2 and got[8] == (0.0, 1) and math.isnan(got[9][0])


def test_block_sums_are_exact_in_any_order():
    xs = values(3 * BLOCK)
    for seed in range(3):
        random.Random(seed).shuffle(xs)
        adder = Adder(3)
        for a in range(0, len(xs), BLOCK):
            own = np.array(xs[a : a + BLOCK])
            adder.add(1, np.stack([own, -np.abs(own)]))
        assert total(adder.units(1)) == exactly(xs) and total(adder.units(2)) == exactly([-abs(x) for x in xs]) and total(adder.units(0)) == 0.0
    adder.add(0, np.array([[1.0, math.nan]]))
    assert math.isnan(total(adder.units(0))) and not math.isnan(total(adder.units(1)))


@pytest.mark.parametrize("most", [3, 10**9, 2**40])
def test_block_sums_with_counts_are_exact(most):
    xs, rng = values(BLOCK - 20), random.Random(most)
    n = [rng.randint(1, most) for _ in xs]
    adder = Adder(1)
    adder.add(0, np.array([xs]), np.array(n, float))
    assert total(adder.units(0)) == float(sum(Fraction(x) * k for x, k in zip(xs, n)))


@pytest.mark.parametrize("least", [1e-300, 2.0**-60, 0.1])
def test_block_sums_of_positive_terms_and_equal_counts_are_exact(least):
    rng = random.Random(7)
    xs = [least, *(rng.uniform(least, 1) ** 2 for _ in range(BLOCK - 1))]
    adder = Adder(2)
    adder.add(0, np.array([xs, xs]), np.full(BLOCK, 7))
    adder.add(1, np.array([xs]))
    assert total(adder.units(0)) == float(7 * sum(map(Fraction, xs))) and total(adder.units(1)) == float(8 * sum(map(Fraction, xs)))


def test_tangents_from_steps_are_those_of_double_precision():
    z = np.concatenate([np.random.default_rng(3).normal(0, 2, 200_000), np.geomspace(1e-38, 9.3, 5000), [0.0, -0.0, 9.25, 30, -1e38, np.inf, -np.inf, np.nan]]).astype(np.float32)
    got, want = limited_array(SQUASHES["TANH"], z), np.nan_to_num(np.tanh(z.astype(np.float64))).astype(np.float32)
    assert (np.abs(got - want) <= np.spacing(np.abs(want))).all() and (got != want).mean() < 1e-4
    assert (got[-8:] == np.array([0, 0, 1, 1, -1, 1, -1, 0])).all()


def test_sums_have_the_same_bits_for_any_split_and_in_a_race(spark):
    rng = np.random.default_rng(1)
    x, t = rng.uniform(-1, 1, (3000, 3)), rng.uniform(0.1, 1, 3000)
    for tier in ("sql", "arrow"):
        seen = {tuple(sorted((r.key, r.loss_sum) for r in partials(corpus(spark, x, t, n), POPULATION, "MSE", tier).collect())) for n in (1, 5, 32)}
        assert len(seen) == 1
        plain = {r.key: r.error for r in score_population(corpus(spark, x, t), POPULATION, "RMSE", tier=tier).collect()}
        raced = race(corpus(spark, x, t), POPULATION, lambda rows: CONTINUE, 700, "RMSE", tier=tier)
        assert {r.key: r.error for r in raced.collect()} == plain


def uneven(seed):
    """Neurons that read inputs and other neurons, with one to four synapses each, and two activations on a level."""
    rng = random.Random(seed)
    hidden = [Neuron("hidden", f"h{i}", rng.uniform(-1, 1), ("TANH", "LOGISTIC", "RELU")[i % 3]) for i in range(9)]
    synapses = []
    for i in range(9):
        sources = [f"input-{j}" for j in range(3)] + ([f"h{j}" for j in range(3)] if i >= 3 else []) + ([f"h{j}" for j in range(3, 6)] if i >= 6 else [])
        synapses += [Synapse(s, f"h{i}", rng.uniform(-1, 1)) for s in random.Random(i).sample(sources, 1 + i % 3)]
    synapses += [Synapse(f"h{i}", f"output-{o}", rng.uniform(-1, 1)) for o in range(2) for i in range(o, 9, 2)] + [Synapse("input-1", "output-1", 0.5)]
    return Creature(3, 2, (*hidden, Neuron("output", "output-0", 0.1, "TANH"), Neuron("output", "output-1", -0.1)), tuple(synapses))


@pytest.mark.parametrize("cost", COSTS)
def test_tiers_add_up_alike(spark, cost):
    rng = np.random.default_rng(2)
    df = corpus(spark, rng.uniform(-1, 1, (500, 3)), rng.uniform(0.1, 1, (500, 2)))
    named = {f"u{i}": uneven(i) for i in range(4)}
    a, b = ({r.key: r.loss_sum for r in partials(df, named, cost, tier).collect()} for tier in ("sql", "arrow"))
    assert a.keys() == b.keys()
    for k in a:
        assert b[k] == pytest.approx(a[k], rel=1e-9)


def test_linear_and_branching_networks_have_the_same_bits_in_both_tiers(spark):
    rng = np.random.default_rng(3)
    df = corpus(spark, rng.uniform(-1, 1, (500, 3)), rng.uniform(0, 1, 500))
    named = {k: c for k, c in (NETWORKS | POPULATION).items() if not any(n.squash == "TANH" for n in c.neurons)}
    a, b = ({r.key: r.loss_sum for r in partials(df, named, "MSE", tier).collect()} for tier in ("sql", "arrow"))
    assert a == b and len(a) > 8


def test_alike_creatures_are_stacked():
    named = [compile_creature(c) for c in [K.dense(3, 4, 1, shift=0.1 * i) for i in range(50)] + [uneven(i) for i in range(3)]]
    one, two = tiles(named)
    assert (len(one.numbers), len(two.numbers)) == (50, 3) and len(tiles(named, 1)) == 53
    x = np.random.default_rng(0).uniform(-1, 1, (3, 10)).astype(np.float32)
    for tile in (one, two):
        for i, y in zip(tile.numbers, tile.outputs(x), strict=True):
            assert (tiles([named[i]])[0].outputs(x)[0] == y).all()


def test_any_tile_size_gives_the_same_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, t = rng.uniform(-1, 1, (2000, 3)), rng.uniform(0, 1, 2000)
    named = {f"c{i:03}": K.dense(3, 4, 1, shift=0.001 * i) if i % 3 else K.linear([0.1 * i, 0.2, 0.3]) for i in range(300)}
    networks = [compile_creature(c) for c in named.values()]
    df = corpus(spark, x, t, 4)
    C.write_bin(df, f"{tmp_path}/bin", 3)
    from evalgrid.operators.scoring import totals
    from evalgrid.plans import arrow_tier as A

    keys = list(named)
    rows = lambda lines: sorted((r.key, r.loss_sum, r.n) for r in totals(lines, keys).collect())
    want = rows(A.units(df, networks, keys, "MSE"))
    assert len(want) == 300
    for tile, limit in ((1 << 20, 0), (500, 0), (500, 1 << 30)):
        assert rows(A.units(df, networks, keys, "MSE", tile, limit)) == want
        assert rows(A.bin_units(spark, f"{tmp_path}/bin", networks, keys, "MSE", tile=tile, limit=limit)) == want
    assert Shared.of(spark, tiles(networks, 500), 0).value is None
    assert {r.key: r.error for r in score_bin(spark, named, f"{tmp_path}/bin").collect()} == {k: s / n for k, s, n in want}

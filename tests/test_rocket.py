"""Convolution features against plain loops."""

from itertools import combinations

import numpy as np
import pytest

from seqloom.operators import rocket

RNG = np.random.default_rng(4)


def plain(x, weights, dilation, bias):
    """Convolution, then the four pooled numbers, place by place."""
    n = len(x)
    values = [sum(w * x[i + (j - 4) * dilation] for j, w in enumerate(weights) if 0 <= i + (j - 4) * dilation < n) for i in range(n)]
    above = [i for i, v in enumerate(values) if v > bias]
    longest = run = 0
    for v in values:
        run = run + 1 if v > bias else 0
        longest = max(longest, run)
    if not above:
        return [0.0, 0.0, 0.0, 0.0]
    return [len(above) / n, sum(values[i] - bias for i in above) / len(above), sum(above) / len(above) / max(1, n - 1), longest / n]


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_features_equal_loops(n):
    x, dilations = RNG.normal(size=n), (1, 3)
    model = rocket.Rocket(dilations, RNG.normal(size=(2, 2, 84, 2)))
    got = dict(zip(model.names, rocket.features_of(x, model)))
    kernels = [[2 if i in c else -1 for i in range(9)] for c in combinations(range(9), 3)]
    signals = [x - x.mean(), np.diff(x) if n > 1 else np.zeros(1)]
    for f, form in enumerate(("value", "step")):
        for i, d in enumerate(dilations):
            for k in (0, 17, 83):
                for b in range(2):
                    want = plain(signals[f], kernels[k], d, model.biases[f, i, k, b])
                    assert [got[f"{form}_d{d}_k{k}_b{b}_{p}"] for p in rocket.POOLED] == pytest.approx(want)
    assert len(got) == 2 * 2 * 84 * 2 * 4


def test_dilations_follow_the_length():
    assert rocket.dilations_for(5, 4) == (1,) and rocket.dilations_for(9, 4) == (1,)
    assert rocket.dilations_for(129, 5) == (1, 2, 4, 8, 16) and max(rocket.dilations_for(1000, 32)) == 124


def test_fit_and_transform(spark):
    rows = [(s, i, None if i == 3 else float(np.sin(i * (1 + s % 3) / 3) + s)) for s in range(90) for i in range(20 + s % 5)]
    df = spark.createDataFrame(rows, "sequence_id long, sequence_counter long, x double")
    model, again = rocket.fit(df, "x", 3, 2), rocket.fit(df.repartition(5), "x", 3, 2)
    assert model.dilations == again.dilations == (1, 2) and np.array_equal(model.biases, again.biases)
    assert 0.3 < np.mean(rocket.fit(df, "x", 1, 64).biases > 0) < 0.7
    got = {r.sequence_id: r.features for r in rocket.transform(df.repartition(4), "x", model).collect()}
    for s in (0, 41, 89):
        x = np.array([np.nan if v is None else v for q, _, v in rows if q == s])
        assert got[s] == pytest.approx(rocket.features_of(x, model).tolist())
    none = df.where("false")
    assert rocket.transform(none, "x", rocket.fit(none, "x")).count() == 0

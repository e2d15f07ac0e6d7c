"""Bayesian and genetic search on known surfaces."""

import numpy as np
import pytest

from seqloom.operators import search

SPACE = {"a": list(range(12)), "b": [0.1, 0.2, 0.4, 0.8, 1.6, 3.2], "kind": ["x", "y", "z"]}


def surface(p):
    return -((p["a"] - 8) ** 2) / 20 - (SPACE["b"].index(p["b"]) - 3) ** 2 / 4 + {"x": 0.0, "y": 1.0, "z": 0.3}[p["kind"]]


def scorer(calls):
    def score(points):
        calls.append(points)
        return [surface(p) for p in points]

    return score


@pytest.mark.parametrize("points", [lambda s, seed: search.bayesian_points(s, SPACE, 24, 4, seed), lambda s, seed: search.genetic_points(s, SPACE, 8, 6, seed=seed)])
def test_better_than_as_many_random_draws(points):
    ours, theirs = [], []
    for seed in range(8):
        calls = []
        found = points(scorer(calls), seed)
        asked = [tuple(sorted(p.items())) for c in calls for p in c]
        assert len(asked) == len(set(asked)) == len(found)
        assert all(s == surface(p) for p, s, _ in found)
        ours.append(max(s for _, s, _ in found))
        theirs.append(max(surface(p) for p in search.drawn(SPACE, len(asked), seed + 100)))
    assert np.mean(ours) > np.mean(theirs)


def test_bayesian_rounds():
    calls = []
    found = search.bayesian_points(scorer(calls), SPACE, 10, 4, 1)
    assert [len(c) for c in calls] == [4, 4, 2] and [t for *_, t in found] == [0] * 4 + [1] * 4 + [2] * 2
    assert found == search.bayesian_points(scorer([]), SPACE, 10, 4, 1)
    small = {"a": [1, 2], "kind": ["x"]}
    assert len(search.bayesian_points(lambda ps: [1.0 for _ in ps], small, 9, 4)) == 2
    assert search.bayesian_points(lambda ps: [], {"a": []}, 3) == []


def test_surrogate_meets_its_points():
    x = np.random.default_rng(0).random((12, 2))
    y = np.sin(3 * x[:, 0]) + x[:, 1]
    mean, deviation = search.Surrogate(x, y)(x)
    assert np.abs(mean - y).max() < 0.05 and deviation.max() < 0.1
    far, wide = search.Surrogate(x, y)(np.array([[9.0, 9.0]]))
    assert far[0] == pytest.approx(y.mean(), abs=0.05) and wide[0] > deviation.max()
    assert search.improvement(np.array([1.0, 0.0]), np.array([1e-9, 1.0]), 0.5) == pytest.approx([0.5, 0.19780], abs=1e-4)


def test_coordinates_keep_order_and_kinds_apart():
    got = search.coordinates(SPACE, [{"a": 0, "b": 3.2, "kind": "x"}, {"a": 11, "b": 0.1, "kind": "z"}])
    assert got[:, :2].tolist() == [[0.0, 1.0], [1.0, 0.0]] and got.shape == (2, 5)


def test_genetic_population_of_a_small_space():
    found = search.genetic_points(lambda ps: [float(p["a"]) for p in ps], {"a": [1, 2, 3]}, population=6, generations=5, mutation=0.5)
    assert sorted(p["a"] for p, *_ in found) == [1, 2, 3]


def test_the_query_breeds_as_many_generations_as_the_operator(monkeypatch):
    """Three points and one generation of children were left of the search."""
    from contextlib import contextmanager

    from seqloom.plans import models

    @contextmanager
    def scored(*_):
        yield lambda points: [p["numTrees"] + p["maxDepth"] / 10 for p in points]

    monkeypatch.setattr(models, "folded", lambda spark, d: (None, []))
    monkeypatch.setattr(search, "cross_validated", scored)
    monkeypatch.setattr(search, "_table", lambda df, found: found)
    found = models.l16_genetic(None, "")
    assert found == search.genetic_points(scored().__enter__(), models.SPACE) and sum(turn == 0 for *_, turn in found) == 8 and max(turn for *_, turn in found) > 1

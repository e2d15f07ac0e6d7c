"""Search spaces: encoding, validation, and random, Bayesian and genetic search by cross-validation."""

from __future__ import annotations

import json
import random
from math import erf, pi

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import cross_validated

# The choices of the parameters that are names.
CHOICES = {"sequence_crop_mode": ("head", "tail", "center", "none"), "window_cap_policy": ("last", "first", "uniform"), "final_window_mode": ("pad", "overlap"), "output_format": ("frame",)}
POSITIVE = ("window_size", "window_stride", "n_scales", "nperseg", "maxlen")


def encoded(space: dict[str, list]) -> dict[str, list]:
    """The space with nested values as JSON text, so that every value can be hashed and compared."""
    plain = lambda v: json.dumps(v, sort_keys=True) if isinstance(v, (dict, list, tuple)) else v
    return {k: [plain(v) for v in values] for k, values in space.items()}


def decoded(value):
    """A value of an encoded space as it was (tuples come back as lists)."""
    return json.loads(value) if isinstance(value, str) and value[:1] in "[{" else value


def validated(params: dict) -> dict:
    """The parameters themselves; unknown choices and sizes that aren't positive whole numbers are errors."""
    for name, known in CHOICES.items():
        if params.get(name, known[0]) not in known:
            raise ValueError(f"{name} must be one of {known}, got {params[name]!r}")
    for name in POSITIVE:
        value = params.get(name)
        if value is not None and (isinstance(value, bool) or int(value) != float(value) or int(value) <= 0):
            raise ValueError(f"{name} must be a positive whole number, got {value!r}")
    return params


def drawn(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """n different points of the space (all, if it has fewer), in seeded order."""
    names, total = sorted(space), 1
    for k in names:
        total *= len(space[k])
    out = []
    for place in random.Random(seed).sample(range(total), min(n, total)):
        point = {}
        for k in names:
            place, i = divmod(place, len(space[k]))
            point[k] = space[k][i]
        out.append(point)
    return out


def _table(df: DataFrame, scored: list[tuple[dict, float, int]]) -> DataFrame:
    rows = [(json.dumps(p, sort_keys=True), s, turn) for p, s, turn in scored]
    return df.sparkSession.createDataFrame(rows, "params string, f1 double, round int").orderBy(F.desc("f1"), "params")


def random_search(df: DataFrame, names: list[str], label: str, fold: str, space: dict[str, list], n: int = 10, seed: int = 42) -> DataFrame:
    """(params as JSON, f1) of forests at n drawn points, cross-validated by the fold column; best first. `label` is
    numeric; the space names parameters of the forest."""
    points = drawn(space, n, seed)
    with cross_validated(df, names, label, fold, seed) as score:
        scores = score(points)
    return _table(df, [(p, s, 0) for p, s in zip(points, scores)]).drop("round")


def coordinates(space: dict[str, list], points: list[dict]) -> np.ndarray:
    """Points of a space as vectors: a parameter of numbers is one coordinate from 0 to 1 by the rank of its value, any
    other one has a coordinate for each of its values."""
    columns = []
    for name in sorted(space):
        values = list(dict.fromkeys(space[name]))
        if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            order = sorted(values)
            columns.append([order.index(p[name]) / max(1, len(order) - 1) for p in points])
        else:
            columns += [[float(p[name] == v) / 2**0.5 for p in points] for v in values]
    return np.array(columns, float).reshape(len(columns), len(points)).T


class Surrogate:
    """A Gaussian process with the Matern kernel of order 5/2. The length scale and the noise are those of a small grid
    under which the scores are likeliest; scores are standardised."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.mean, self.scale = x, y.mean(), y.std() or 1.0
        z, best = (y - self.mean) / self.scale, None
        for length in (0.1, 0.2, 0.4, 0.8, 1.6):
            for noise in (1e-6, 1e-3, 1e-1):
                low = np.linalg.cholesky(self._kernel(x, x, length) + noise * np.eye(len(x)))
                half = np.linalg.solve(low, z)
                likely = -0.5 * half @ half - np.log(np.diag(low)).sum()
                if best is None or likely > best[0]:
                    best = (likely, length, low, half)
        _, self.length, self.low, self.half = best

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
        d = np.sqrt(5 * np.maximum(((a[:, None] - b[None]) ** 2).sum(axis=2), 0)) / length
        return (1 + d + d * d / 3) * np.exp(-d)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected score and its deviation at each point."""
        across = np.linalg.solve(self.low, self._kernel(self.x, x, self.length))
        return self.mean + self.scale * (across.T @ self.half), self.scale * np.sqrt(np.maximum(1 - (across * across).sum(axis=0), 1e-12))


def improvement(mean: np.ndarray, deviation: np.ndarray, best: float) -> np.ndarray:
    """The expected improvement over the best score."""
    z = (mean - best) / deviation
    return (mean - best) * 0.5 * (1 + np.array([erf(v / 2**0.5) for v in z])) + deviation * np.exp(-z * z / 2) / (2 * pi) ** 0.5


def bayesian_points(score, space: dict[str, list], n: int = 16, batch: int = 4, seed: int = 42, most_candidates: int = 2048) -> list[tuple[dict, float, int]]:
    """(point, score, round) of n different points (all, if the space has fewer): `batch` drawn ones, then in each round
    `batch` of the highest expected improvement among the points that aren't scored yet. After a pick the surrogate
    takes its own expectation for that point's score, so that the next pick goes elsewhere. Spaces above
    `most_candidates` points offer that many seeded ones in each round."""
    scored: list[tuple[dict, float, int]] = []
    ask, turn = drawn(space, min(batch, n), seed), 0
    while ask:
        scored += [(p, s, turn) for p, s in zip(ask, score(ask))]
        turn += 1
        seen = [p for p, *_ in scored]
        rest = [p for p in drawn(space, most_candidates + len(seen), seed + turn) if p not in seen]
        x, y, place = coordinates(space, seen), np.array([s for _, s, _ in scored]), coordinates(space, rest)
        ask = []
        while rest and len(ask) < min(batch, n - len(scored)):
            mean, deviation = Surrogate(x, y)(place)
            i = int(np.argmax(improvement(mean, deviation, y.max())))
            x, y = np.vstack([x, place[i]]), np.append(y, mean[i])
            ask.append(rest.pop(i))
            place = np.delete(place, i, axis=0)
    return scored


def genetic_points(
    score, space: dict[str, list], population: int = 8, generations: int = 4, tournament: int = 3, crossover: float = 0.8, mutation: float = 0.1, elite: int = 1, seed: int = 42
) -> list[tuple[dict, float, int]]:
    """(point, score, generation) of every point that a seeded population met, each scored once. Parents win tournaments;
    with probability `crossover` a child takes each parameter from either parent, else it is the first one; each parameter
    mutates to another value with probability `mutation`; the `elite` best go on as they are."""
    rng, names = random.Random(seed), sorted(space)
    key = lambda p: json.dumps(p, sort_keys=True)
    memory: dict[str, tuple[dict, float, int]] = {}
    alive = drawn(space, population, seed)
    for turn in range(generations):
        new = list({key(p): p for p in alive if key(p) not in memory}.values())
        memory |= {key(p): (p, s, turn) for p, s in zip(new, score(new))}
        if turn == generations - 1:
            break
        ranked = sorted(alive, key=lambda p: -memory[key(p)][1])
        parent = lambda: max(rng.choices(alive, k=tournament), key=lambda p: memory[key(p)][1])
        children = ranked[:elite]
        while len(children) < len(alive):
            a, b = parent(), parent()
            child = {k: (a if rng.random() < 0.5 else b)[k] for k in names} if rng.random() < crossover else dict(a)
            for k in names:
                others = [v for v in space[k] if v != child[k]]
                if others and rng.random() < mutation:
                    child[k] = rng.choice(others)
            children.append(child)
        alive = children
    return list(memory.values())


def bayesian_search(df: DataFrame, names: list[str], label: str, fold: str, space: dict[str, list], n: int = 16, batch: int = 4, seed: int = 42) -> DataFrame:
    """(params as JSON, f1, round), best first: bayesian_points over cross-validated forests."""
    with cross_validated(df, names, label, fold, seed) as score:
        return _table(df, bayesian_points(score, space, n, batch, seed))


def genetic_search(df: DataFrame, names: list[str], label: str, fold: str, space: dict[str, list], seed: int = 42, **how) -> DataFrame:
    """(params as JSON, f1, round: its generation), best first: genetic_points over cross-validated forests."""
    with cross_validated(df, names, label, fold, seed) as score:
        return _table(df, genetic_points(score, space, seed=seed, **how))

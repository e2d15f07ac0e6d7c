"""Linear machines that learn row by row, and radial kernels by random Fourier features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.shared import cut

from .models import linear


@dataclass(frozen=True)
class Machine:
    """One row of weights a class, the last weight is the constant; the class of the highest value wins, the first of
    equal ones."""

    classes: tuple
    weights: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:, :-1].T + self.weights[:, -1]


def learnt(weights: np.ndarray, x: np.ndarray, y: np.ndarray, kind: str, rate: float, penalty: float, most: float) -> np.ndarray:
    """One pass over the rows in their order, one class against the rest. sgd: the gradient of the hinge loss with an L2
    penalty (not on the constant). pa: the smallest change that brings a row's loss to 0, `most` at most."""
    w, x = weights.copy(), np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y[:, None] == np.arange(len(w))[None], 1.0, -1.0)
    for row, s in zip(x, sign):
        loss = 1 - s * (w @ row)
        if kind == "pa":
            step = np.minimum(most, np.maximum(loss, 0) / (row @ row))
        else:
            w[:, :-1] *= 1 - rate * penalty
            step = rate * (loss > 0)
        w += (step * s)[:, None] * row
    return w


def trained(
    df: DataFrame, features: str, label: str, key: str, kind: str = "sgd", rounds: int = 5, parts: int = 8, rate: float = 0.01, penalty: float = 1e-4, most: float = 1.0, seed: int = 42
) -> Machine:
    """A machine fitted in `rounds` passes. Rows are dealt to `parts` partitions by the hash of their key; in a round each
    partition learns from its rows in seeded order, starting at the common weights, and the new weights are averaged by
    numbers of rows. Only the first dealing moves rows. What is averaged is summed in Spark, weight by weight, so the driver sees one set of weights
    a round. With one part this is the plain loop over all rows.

    Features are an array column without gaps; rows without features or label are left out. No rows give no classes."""
    if kind not in ("sgd", "pa"):
        raise ValueError(f"unknown kind {kind!r}")
    rows = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(features).cast("array<double>").alias("x"), F.col(label).alias("y"))
    rows = cut(rows)
    classes = tuple(r[0] for r in rows.select("y").distinct().orderBy("y").collect())
    width = (rows.agg(F.max(F.size("x"))).first()[0] or 0) + 1
    number, weights = {c: i for i, c in enumerate(classes)}, np.zeros((len(classes), width))

    def learn(frames, start):
        now, n = start, 0
        for f in frames:
            if len(f):
                now = learnt(now, np.array(f.x.tolist(), float), f.y.map(number).to_numpy(), kind, rate, penalty, most)
                n += len(f)
        if n:
            yield pd.DataFrame({"i": np.arange(now.size), "w": now.ravel() * n, "n": n})

    dealt = rows.repartition(parts, "k").persist(StorageLevel.DISK_ONLY)  # each round only sorts it anew
    for turn in range(rounds if classes else 0):
        order = F.md5(F.concat_ws(":", "k", F.lit(str(seed)), F.lit(str(turn))))
        sums = dealt.sortWithinPartitions(order, "k").mapInPandas(lambda frames, start=weights: learn(frames, start), "i long, w double, n long")
        sums = sums.groupBy("i").agg(F.sum("w") / F.sum("n")).collect()
        weights = np.array([v for _, v in sorted(map(tuple, sums))]).reshape(weights.shape)
    dealt.unpersist()
    return Machine(classes, weights)


def predicted(df: DataFrame, features: str, machine: Machine, out: str = "prediction") -> DataFrame:
    """df plus the class of the highest value; null without features."""
    from pyspark.sql import types as T

    kind = T.StringType() if all(isinstance(c, str) for c in machine.classes) else T.DoubleType() if any(isinstance(c, float) for c in machine.classes) else T.LongType()

    @F.pandas_udf(kind)
    def of(x: pd.Series) -> pd.Series:
        known, found = x.notna().to_numpy(), np.full(len(x), None, object)
        if known.any() and machine.classes:
            best = machine.values(np.array(x[known].tolist(), float)).argmax(axis=1)
            found[known] = [machine.classes[i] for i in best]
        return pd.Series(found, index=x.index)

    return df.withColumn(out, of(F.col(features)))


def frequencies(width: int, size: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (width, size)), rng.uniform(0, 2 * np.pi, size)


def waves(x: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.sqrt(2 / len(at[1])) * np.cos(x @ at[0] + at[1])


def scale(df: DataFrame, features: str, gamma: float | None = None) -> tuple[int, float]:
    """The number of features; gamma, or one over that number times their variance over all rows."""
    width = max(0, df.agg(F.max(F.size(features))).first()[0] or 0)
    if gamma is None:
        one = df.where(F.col(features).isNotNull()).select(F.explode(F.col(features).cast("array<double>")).alias("x"))
        gamma = 1.0 / ((one.agg(F.var_pop("x")).first()[0] or 1.0) * max(1, width))
    return width, gamma


def fourier_features(df: DataFrame, features: str, size: int = 512, gamma: float | None = None, seed: int = 42, out: str = "waves") -> DataFrame:
    """df plus an array whose inner products approximate exp(-gamma * squared distance): random Fourier features. Their
    error is about 1 / sqrt(size) for a pair of rows. gamma: one over the number of features times their variance over
    all rows, where it isn't given. Nothing is fitted to rows but that variance; rows without features give null."""
    width, gamma = scale(df, features, gamma)
    at = frequencies(width, size, gamma, seed)

    @F.arrow_udf("array<double>")
    def of(x: pa.Array) -> pa.Array:
        known = x.is_valid().to_numpy(zero_copy_only=False)
        values = x.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
        found = waves(values.reshape(int(known.sum()), -1), at) if known.any() else np.empty((0, size))
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(known * size)).astype(np.int32), found.ravel(), mask=pa.array(~known))

    return df.withColumn(out, of(F.col(features)))


def radial_machine(df: DataFrame, features: str, label: str, size: int = 512, gamma: float | None = None, penalty: float = 0.01, seed: int = 42) -> DataFrame:
    """df plus `prediction`: a support-vector machine with a radial kernel, fitted on df itself, by Fourier features and
    linear machines, one class against the rest. Features of equal rows are made once for the fit."""
    gamma = scale(df, features, gamma)[1]
    return linear(df, features, label, "svm", penalty, lambda d: fourier_features(d, features, size, gamma, seed, "_expanded"))

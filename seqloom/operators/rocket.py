"""Random-convolution features that learn their biases: the 84 kernels of nine weights, dilated along the sequence."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import bounds, whole_sequences
from .windows import AT, SEQ

#: Weights of the kernels: three of nine are 2, the others -1.
KERNELS = np.array([[2.0 if i in c else -1.0 for i in range(9)] for c in combinations(range(9), 3)])
POOLED = ("share", "mean", "place", "stretch")
#: Sequences that biases are read from.
SAMPLE = 64


@dataclass(frozen=True)
class Rocket:
    """Fitted on a column: dilations, and biases (form, dilation, kernel, one each) for the values and their differences."""

    dilations: tuple[int, ...]
    biases: np.ndarray

    @property
    def names(self) -> list[str]:
        form = ("value", "step")
        return [f"{form[f]}_d{d}_k{k}_b{b}_{p}" for f in range(2) for d in self.dilations for k in range(84) for b in range(self.biases.shape[3]) for p in POOLED]


def dilations_for(length: int, most: int) -> tuple[int, ...]:
    """Up to `most` dilations, evenly spaced in their logarithm, of which the widest kernel just spans the length."""
    widest = max(1.0, (length - 1) / 8)
    return tuple(sorted({int(v) for v in np.exp2(np.linspace(0, np.log2(widest), most))}))


def forms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centred signal and its first differences; unknown values count as the mean."""
    x = np.asarray(x, float)
    known = np.isfinite(x)
    x = np.where(known, x - (x[known].mean() if known.any() else 0.0), 0.0)
    return x, np.diff(x) if len(x) > 1 else np.zeros(1)


def convolved(x: np.ndarray, dilation: int) -> np.ndarray:
    """(84, n): all kernels at one dilation; the signal has zeros beyond its ends."""
    wide = np.pad(x, 4 * dilation)
    return KERNELS @ np.stack([wide[k * dilation : k * dilation + len(x)] for k in range(9)])


def pooled(values: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """(84, biases, 4): of the values above each bias their share, their mean height above it, the mean of their places
    (between 0 and 1) and the longest stretch of them in a row, as a share of the length; zeros where none is above."""
    n, places = values.shape[1], np.arange(values.shape[1])
    over = values[:, None] - biases[:, :, None]
    above = over > 0
    count = above.sum(axis=2)
    some = np.maximum(count, 1)
    gap = np.maximum.accumulate(np.where(above, -1, places), axis=2)
    return np.stack([count / n, np.where(above, over, 0).sum(axis=2) / some, (above * places).sum(axis=2) / some / max(1, n - 1), (places - gap).max(axis=2) / n], axis=2)


def fit(df: DataFrame, x: str, most_dilations: int = 4, n_biases: int = 1, seed: int = 42) -> Rocket:
    """Dilations for the median length of the sequences; for each form, dilation and kernel the biases are quantiles of
    its values on a sequence of its own, drawn from a fixed number of sequences (those of the least seeded MD5). The
    quantiles follow the golden ratio, so that they spread evenly. An empty table gives biases of 0."""
    sizes = df.groupBy(SEQ).agg(F.count("*").alias("n"))
    length = sizes.agg(F.percentile_approx("n", 0.5)).first()[0] or 1
    picked = sizes.orderBy(F.md5(F.concat_ws(":", F.col(SEQ).cast("string"), F.lit(str(seed)))), SEQ).limit(SAMPLE).select(SEQ)
    rows = df.join(F.broadcast(picked), SEQ, "left_semi").select(SEQ, AT, x).toPandas().sort_values([SEQ, AT])
    signals = [forms(g[x].to_numpy(float)) for _, g in rows.groupby(SEQ)]
    dilations, rng = dilations_for(int(length), most_dilations), np.random.default_rng(seed)
    biases = np.zeros((2, len(dilations), 84, n_biases))
    share = (np.arange(1, biases.size + 1) * (5**0.5 - 1) / 2 % 1).reshape(biases.shape)
    for f in range(2):
        for i, d in enumerate(dilations):
            for k, own in enumerate(rng.integers(0, len(signals), 84) if signals else ()):
                biases[f, i, k] = np.quantile(convolved(signals[own][f], d)[k], share[f, i, k])
    return Rocket(dilations, biases)


def features_of(x: np.ndarray, model: Rocket) -> np.ndarray:
    return np.concatenate([pooled(convolved(signal, d), model.biases[f, i]).ravel() for f, signal in enumerate(forms(x)) for i, d in enumerate(model.dilations)])


def transform(df: DataFrame, x: str, model: Rocket) -> DataFrame:
    """(sequence_id, features array<double>), in the order of model.names. Whole sequences go to NumPy in Arrow batches."""
    kind = df.schema[SEQ].dataType.simpleString()

    def run(frames):
        for frame in whole_sequences(frames):
            at, values = bounds(frame), frame[x].to_numpy(float)
            yield pd.DataFrame({SEQ: frame[SEQ].to_numpy()[at[:-1]], "features": [features_of(values[a:b], model).tolist() for a, b in zip(at, at[1:])]})

    return df.select(SEQ, AT, x).repartition(SEQ).sortWithinPartitions(SEQ, AT).mapInPandas(run, f"{SEQ} {kind}, features array<double>")

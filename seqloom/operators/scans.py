"""Recurrences along a sequence: exponential smoothing and the Kalman filter, in time linear in the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import sequences
from .windows import AT, SEQ


def exponential_mean(df: DataFrame, x: str, alpha: float, out: str) -> DataFrame:
    """y0 = x0, then y = (1 - alpha) y + alpha x; from a null on, nulls. Returns (sequence_id, sequence_counter, out)."""

    def make(frame, at):
        def advance(s, v, t):
            y = (1 - alpha) * s[0] + alpha * v
            return (y,), y

        return {out: sequences.fold(frame[x].to_numpy(float), at, lambda v: ((v,), v), advance)}

    return sequences.along(df.select(SEQ, AT, x), make, [out]).select(SEQ, AT, out)


def smoothed(df: DataFrame, names: dict[str, str], process_noise: float = 1e-3, measurement_noise: float = 1e-2) -> DataFrame:
    """df with names[x] (new or in place) from x by a scalar Kalman filter each, which starts at the first value with
    variance 1; nulls count as 0. The gain depends on the place in the sequence alone."""

    def make(frame, at):
        longest = int(np.diff(at).max())
        gains, p = np.empty(longest), 1.0
        for t in range(longest):
            p += process_noise
            gains[t] = p / (p + measurement_noise)
            p *= 1 - gains[t]

        def advance(s, v, t):
            y = s[0] + gains[t] * (v - s[0])
            return (y,), y

        return {y: sequences.fold(np.nan_to_num(frame[x].to_numpy(float)), at, lambda v: ((v,), v), advance) for x, y in names.items()}

    return sequences.along(df, make, [y for x, y in names.items() if y not in df.columns])


def kalman(df: DataFrame, x: str, out: str, process_noise: float = 1e-3, measurement_noise: float = 1e-2) -> DataFrame:
    """Returns (sequence_id, sequence_counter, out)."""
    return smoothed(df.select(SEQ, AT, x), {x: out}, process_noise, measurement_noise).select(SEQ, AT, out)

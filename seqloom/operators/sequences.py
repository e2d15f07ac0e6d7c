"""Whole sequences in Arrow batches: NumPy work that has to see a sequence from its first row to its last."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .windows import SEQ, position


def whole_sequences(frames):
    """Batches of rows sorted by sequence, cut so that no sequence is in two of them."""
    parts: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        new = (frame[SEQ] != frame[SEQ].iat[-1]).to_numpy()
        start = int(len(new) - new[::-1].argmax()) if new.any() else 0
        if start or parts and parts[0][SEQ].iat[-1] != frame[SEQ].iat[0]:
            yield pd.concat([*parts, frame.iloc[:start]], ignore_index=True)
            parts = []
        parts.append(frame.iloc[start:])
    if parts:
        yield pd.concat(parts, ignore_index=True)


def bounds(frame: pd.DataFrame) -> np.ndarray:
    """Where the sequences of a batch begin, and its length."""
    ids = frame[SEQ].to_numpy()
    return np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]


def along(df: DataFrame, make, adds: list[str] = ()) -> DataFrame:
    """df with what make(frame, bounds) returns: columns by name, those of df replaced and `adds` (doubles) new.

    The rows come from a window over the sequence, which leaves them clustered and in order; where the plan below is
    partitioned by sequence already (any operator of this package is), that adds no shuffle. Spark doesn't know that the
    rows that come back still are, so the next operator that needs it shuffles once."""
    fields = [f for f in df.schema.fields if f.name not in adds]
    schema = T.StructType([*fields, *(T.StructField(a, T.DoubleType()) for a in adds)])

    def run(frames):
        for frame in whole_sequences(frames):
            if len(frame):
                made = pd.DataFrame(make(frame, bounds(frame)), index=frame.index)
                yield pd.concat([frame.drop(columns=made.columns, errors="ignore"), made], axis=1)[schema.names]

    return df.withColumn("_place", position()).mapInPandas(run, schema)


def fold(values: np.ndarray, at: np.ndarray, start, advance) -> np.ndarray:
    """A recurrence along all sequences of a batch at once, time step by time step: state, y = start(x), then
    state, y = advance(state, x, step). The work is linear in the rows."""
    sizes, out = np.diff(at), np.empty_like(values)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = at[:-1][order], sizes[order]
    state, out[begin] = start(values[begin])
    for t in range(1, int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        state, y = advance(tuple(s[:n] for s in state), values[begin[:n] + t], t)
        out[begin[:n] + t] = y
    return out

"""Seeded augmentation of sequences. What happens to a sequence depends on its id and the seed, not on partitions: every
random number is drawn from the MD5 of the sequence's id, what it is for, and the seed. Kinds that change a row by its own
place are columns; those that look up other rows of the sequence are NumPy over whole sequences."""

from __future__ import annotations

import hashlib
from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import along
from .windows import AT, SEQ, entire, position

_SPAN = float(1 << 32)


def draw(*what) -> Column:
    """A number between 0 and 1 for each sequence and purpose; columns among `what` draw anew for each of their values."""
    text = [w if isinstance(w, Column) else F.lit(str(w)) for w in what]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(SEQ).cast("string"), *text)), 1, 8), 16, 10)
    return (bits.cast("double") + 0.5) / _SPAN


def drawn(sequence, *what) -> float:
    """What draw() gives, in Python."""
    return (int(hashlib.md5(":".join(map(str, (sequence, *what))).encode()).hexdigest()[:8], 16) + 0.5) / _SPAN


def normal(*what) -> Column:
    """A standard normal number by the method of Box and Muller."""
    return F.sqrt(-2 * F.log(draw(*what, "r"))) * F.cos(2 * pi * draw(*what, "a"))


# Kinds of columns: (names, seed) to the changed columns. _i is the row's place in its sequence, _n the sequence's length.


def jitter(names, seed, sigma=0.03):
    return {n: F.col(n) + sigma * normal("jitter", n, F.col(AT).cast("string"), seed) for n in names}


def gaussian_noise(names, seed, std=0.05):
    """Noise in units of the channel's deviation in the sequence, of known values; of 1 where that is 0 or unknown."""
    known = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n))
    width = lambda n: F.coalesce(F.nullif(F.stddev_pop(known(n)).over(entire()), F.lit(0.0)), F.lit(1.0))
    return {n: F.col(n) + std * width(n) * normal("gaussian_noise", n, F.col(AT).cast("string"), seed) for n in names}


def scaling(names, seed, sigma=0.1):
    factor = 1 + sigma * normal("scaling", seed)
    return {n: F.col(n) * factor for n in names}


def temporal_mask(names, seed, share=0.1, masks=1):
    """Zero in `masks` stretches of a share of the rows, one row at least."""
    size = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    hidden = F.lit(False)
    for m in range(masks):
        after = F.col("_i") - F.floor(draw("temporal_mask", m, seed) * (F.col("_n") - size + 1))
        hidden = hidden | (after >= 0) & (after < size)
    return {n: F.when(hidden, 0.0).otherwise(F.col(n)) for n in names}


def channel_drop(names, seed, chance=0.1):
    return {n: F.when(draw("channel_drop", n, seed) < chance, 0.0).otherwise(F.col(n)) for n in names}


# Sensors by the beginnings of their columns' names.
SENSORS = {"acc": ("acc_", "lin_acc"), "rot": ("rot",), "tof": ("tof_", "depth_"), "thm": ("thm_", "thermal_", "temp_")}


def sensor_of(name: str) -> str | None:
    return next((s for s, starts in SENSORS.items() if name.startswith(starts)), None)


def sensor_drop(names, seed, chance=0.3):
    """Each sensor goes as a whole, by its own draw; columns of no sensor stay."""
    return {n: F.when(draw("sensor_drop", sensor_of(n), seed) < chance, 0.0).otherwise(F.col(n)) for n in names if sensor_of(n)}


def spline(place: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The cubic spline through (knots, values (knots, columns)) whose first two and last two pieces are one cubic each;
    a line or a parabola through two or three knots."""
    n = len(knots)
    if n < 4:
        return np.stack([np.polyval(np.polyfit(knots, v, n - 1), place) for v in values.T], axis=1)
    h, d = np.diff(knots), np.diff(values, axis=0) / np.diff(knots)[:, None]
    a, b = np.zeros((n, n)), np.zeros((n, values.shape[1]))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (d[i] - d[i - 1])
    a[0, :3], a[-1, -3:] = (h[1], -h[0] - h[1], h[0]), (h[-1], -h[-2] - h[-1], h[-2])
    m = np.linalg.solve(a, b)  # second derivatives at the knots
    i = np.clip(np.searchsorted(knots, place, side="right") - 1, 0, n - 2)
    s, t, w = (place - knots[i])[:, None], (knots[i + 1] - place)[:, None], h[i][:, None]
    return (m[i] * t**3 + m[i + 1] * s**3) / (6 * w) + (values[i] / w - m[i] * w / 6) * t + (values[i + 1] / w - m[i + 1] * w / 6) * s


def _cardinal(knots: int) -> np.ndarray:
    """(pieces, knots, 4): the coefficients by which each knot's value enters the spline within each piece."""
    place = np.arange(knots - 1)[:, None] + np.arange(4) / 3
    values = spline(place.ravel(), np.arange(knots, dtype=float), np.eye(knots)).reshape(knots - 1, 4, knots)
    return np.einsum("cs,psk->pkc", np.linalg.inv(np.vander(np.arange(4) / 3, 4, increasing=True)), values)


def magnitude_warp(names, seed, sigma=0.2, knots=4):
    """Every channel times a smooth curve of its own: the spline through knots of mean 1 that stand evenly over the sequence.
    Sequences with fewer rows have a knot for each; one row alone stays."""

    def curve(name: str, k: int) -> Column:
        at = F.col("_i") * (k - 1) / (F.col("_n") - 1)
        piece = F.least(F.floor(at), F.lit(k - 2)).cast("int")
        t, table = at - piece, _cardinal(k)
        of = lambda j, c: F.element_at(F.array(*(F.lit(float(table[p, j, c])) for p in range(k - 1))), piece + 1)
        weight = lambda j: of(j, 0) + t * (of(j, 1) + t * (of(j, 2) + t * of(j, 3)))
        return sum((weight(j) * (1 + sigma * normal("magnitude_warp", name, j, seed)) for j in range(k)), F.lit(0.0))

    def factor(name: str) -> Column:
        out = F.when(F.col("_n") < 2, 1.0)
        for k in range(2, knots):
            out = out.when(F.col("_n") == k, curve(name, k))
        return out.otherwise(curve(name, knots))

    return {n: F.col(n) * factor(n) for n in names}


def quaternion_flip(names, seed):
    """The same rotations by quaternions of the other sign."""
    return {n: -F.col(n) for n in names if n in ("rot_w", "rot_x", "rot_y", "rot_z")}


# Kinds over whole sequences: (rows x channels, u) with draws u(name) between 0 and 1.


def time_shift(x, u, share=0.1):
    """Rows move by up to a share of the length, one row at least; the rows at the end repeat."""
    most = max(1, int(len(x) * share))
    by = int(u("by") * (2 * most + 1)) - most
    return x[np.clip(np.arange(len(x)) - by, 0, len(x) - 1)]


def _read(x, place):
    return np.stack([np.interp(place, np.arange(len(x)), c) for c in x.T], axis=1)


def crop_resize(x, u, low=0.5, high=0.9):
    """A random stretch of the rows, drawn out to the whole length."""
    size = min(len(x), max(2, int(len(x) * (low + (high - low) * u("size")))))
    return _read(x, int(u("at") * (len(x) - size + 1)) + np.linspace(0, size - 1, len(x)))


def time_stretch(x, u, low=0.8, high=1.2):
    """Plays the sequence faster or slower from its start; the end holds."""
    return _read(x, np.arange(len(x)) * (low + (high - low) * u("speed")))


def frequency_filter(x, u, low=0.2, high=0.8):
    """Frequencies above a random share of the highest go."""
    spectrum = np.fft.rfft(x, axis=0)
    spectrum[max(1, int(len(spectrum) * (low + (high - low) * u("share")))) :] = 0
    return np.fft.irfft(spectrum, len(x), axis=0)


COLUMNS = {jitter, gaussian_noise, scaling, temporal_mask, channel_drop, sensor_drop, magnitude_warp, quaternion_flip}
#: In the order in which a sequence meets them.
AUGMENTATIONS = {f.__name__: f for f in (jitter, gaussian_noise, scaling, time_shift, crop_resize, temporal_mask, channel_drop, sensor_drop, magnitude_warp, time_stretch, quaternion_flip, frequency_filter)}


def augmented(df: DataFrame, names: list[str], kinds: list[str] | None = None, chance: float = 0.5, each: float = 0.5, seed: int = 42) -> DataFrame:
    """df with augmented columns: a sequence is changed with probability `chance`, then by each kind with `each`. Nulls
    stay null where a kind is a column; over whole sequences they count as not a number."""
    unknown = set(kinds or ()) - set(AUGMENTATIONS)
    if unknown:
        raise ValueError(f"unknown augmentations {sorted(unknown)}")
    fields = df.columns
    df = df.withColumns({n: F.col(n).cast("double") for n in names}).withColumns({"_i": position(), "_n": F.count("*").over(entire())})
    for kind in (k for k in AUGMENTATIONS if kinds is None or k in kinds):
        change = AUGMENTATIONS[kind]
        if change in COLUMNS:
            meets = (draw("changed", seed) < chance) & (draw(kind, "met", seed) < each)
            df = df.withColumns({n: F.when(meets, c).otherwise(F.col(n)) for n, c in change(names, seed).items()})
        else:
            df = along(df, _along(kind, names, chance, each, seed))
    return df.select(fields)


def _along(kind: str, names: list[str], chance: float, each: float, seed: int):
    def make(frame, at):
        x, ids = frame[names].to_numpy(float), frame[SEQ].to_numpy()
        for a, b in zip(at, at[1:]):
            if drawn(ids[a], "changed", seed) < chance and drawn(ids[a], kind, "met", seed) < each:
                x[a:b] = AUGMENTATIONS[kind](x[a:b], lambda what: drawn(ids[a], kind, what, seed))
        return dict(zip(names, x.T))

    return make


def mixup(df: DataFrame, names: list[str], alpha: float = 0.2, seed: int = 42) -> DataFrame:
    """Feature rows (one per sequence) blended with a seeded partner each: rows and partners are both numbered within
    buckets by their draws, so one join on (bucket, number) finds every partner. The last row of a bucket meets the first."""
    buckets = max(1, df.count() // 50_000)  # counted at once, so that a bucket stays of one size
    w = Window.partitionBy("_b")
    rows = df.select(SEQ, *names, F.floor(draw("bucket", seed) * buckets).alias("_b"))
    rows = rows.withColumns({"_i": F.row_number().over(w.orderBy(draw("order", seed), SEQ)), "_n": F.count("*").over(w)})
    other = rows.select("_b", F.when(F.col("_i") == 1, F.col("_n")).otherwise(F.col("_i") - 1).alias("_i"), F.col(SEQ).alias("partner"), *(F.col(n).alias(f"_{n}") for n in names))
    share = draw("share", seed) * alpha
    return rows.join(other, ["_b", "_i"]).select(SEQ, "partner", *(((1 - share) * F.col(n) + share * F.col(f"_{n}")).alias(n) for n in names))


def cutmix(df: DataFrame, names: list[str], seed: int = 42) -> DataFrame:
    """Sequences of which a seeded run of rows comes from the same places of a partner: (sequence_id, partner,
    sequence_counter, names...). The share that is replaced is drawn evenly from 0 to 1; rows that the partner lacks stay."""
    ids = df.groupBy(SEQ).agg(F.count("*").alias("_n"))
    pairs = mixup(ids, [], 0.0, seed).join(ids, SEQ)
    size = F.floor(draw("size", seed) * F.col("_n"))
    pairs = pairs.select(SEQ, "partner", size.alias("_size"), F.floor(draw("from", seed) * (F.col("_n") - size + 1)).alias("_from"))
    place = F.row_number().over(Window.partitionBy(SEQ).orderBy(AT)) - 1
    rows = df.select(SEQ, AT, *names, place.alias("_i"))
    other = rows.select(F.col(SEQ).alias("partner"), "_i", F.struct(*names).alias("_other"))
    rows = rows.join(pairs, SEQ).join(other, ["partner", "_i"], "left")
    inside = (F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_from") + F.col("_size")) & F.col("_other").isNotNull()
    return rows.select(SEQ, "partner", AT, *(F.when(inside, F.col("_other").getField(n)).otherwise(F.col(n)).alias(n) for n in names))


def noisy(df: DataFrame, names: list[str], sigma: float = 0.01, seed: int = 42) -> DataFrame:
    """Additive normal noise on a feature table, drawn for each sequence and column."""
    return df.withColumns({n: F.col(n) + sigma * normal("noisy", n, seed) for n in names})

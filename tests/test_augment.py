"""Values of the augmentations, drawn again in Python."""

from math import cos, log, pi, sqrt

import numpy as np
import pytest

from seqloom.operators import augment as au

RNG = np.random.default_rng(2)
LENGTHS = {"a": 1, "b": 2, "c": 3, "d": 9, "e": 40}


def normal(*what):
    return sqrt(-2 * log(au.drawn(*what, "r"))) * cos(2 * pi * au.drawn(*what, "a"))


@pytest.fixture(scope="module")
def rows():
    return [(s, 10 + i, float(RNG.normal()), 2.0) for s, n in LENGTHS.items() for i in range(n)]


def changed(spark, rows, kind, **how):
    df = spark.createDataFrame(rows, "sequence_id string, sequence_counter long, acc_x double, rot_w double").repartition(3)
    out = au.augmented(df, ["acc_x", "rot_w"], [kind], how.get("chance", 1.0), 1.0, 7)
    assert out.columns == df.columns
    got = {}
    for r in out.orderBy("sequence_id", "sequence_counter").collect():
        got.setdefault(r.sequence_id, []).append([r.acc_x, r.rot_w])
    return got


def plain(rows, s):
    return np.array([[x, w] for q, _, x, w in rows if q == s])


def test_masks_and_drops(spark, rows):
    mask, channel, sensor = (changed(spark, rows, k) for k in ("temporal_mask", "channel_drop", "sensor_drop"))
    for s, n in LENGTHS.items():
        x, size = plain(rows, s), max(1, int(n * 0.1))
        at = int(au.drawn(s, "temporal_mask", 0, 7) * (n - size + 1))
        want = x.copy()
        want[at : at + size] = 0
        assert np.allclose(mask[s], want)
        assert np.allclose(channel[s], x * [au.drawn(s, "channel_drop", c, 7) >= 0.1 for c in ("acc_x", "rot_w")])
        assert np.allclose(sensor[s], x * [au.drawn(s, "sensor_drop", c, 7) >= 0.3 for c in ("acc", "rot")])


def test_noise_and_warp(spark, rows):
    noise, warp, flip = (changed(spark, rows, k) for k in ("gaussian_noise", "magnitude_warp", "quaternion_flip"))
    for s, n in LENGTHS.items():
        x, k = plain(rows, s), max(2, min(4, n))
        width = [x[:, 0].std() or 1.0, 1.0]  # a constant channel gets noise of unit width
        want = [[v + 0.05 * width[c] * normal(s, "gaussian_noise", name, 10 + i, 7) for c, (v, name) in enumerate(zip(row, ("acc_x", "rot_w")))] for i, row in enumerate(x)]
        assert np.allclose(noise[s], want)
        assert np.allclose(flip[s], x * [1, -1])
        if n < 2:
            assert np.allclose(warp[s], x)
            continue
        knots = np.array([[1 + 0.2 * normal(s, "magnitude_warp", c, j, 7) for c in ("acc_x", "rot_w")] for j in range(k)])
        assert np.allclose(warp[s], x * au.spline(np.arange(n, dtype=float), np.linspace(0, n - 1, k), knots))


@pytest.mark.parametrize("knots", [2, 3, 4, 6])
def test_cardinal_splines(knots):
    table, values = au._cardinal(knots), RNG.normal(size=(knots, 1))
    for at in RNG.uniform(0, knots - 1, 50):
        p = min(int(at), knots - 2)
        own = sum(values[j, 0] * np.polyval(table[p, j, ::-1], at - p) for j in range(knots))
        assert own == pytest.approx(au.spline(np.array([at]), np.arange(knots, dtype=float), values)[0, 0])


def test_shift_moves_short_sequences_too(spark, rows):
    shift = changed(spark, rows, "time_shift")
    for s, n in LENGTHS.items():
        most = max(1, int(n * 0.1))
        by = int(au.drawn(s, "time_shift", "by", 7) * (2 * most + 1)) - most
        assert np.allclose(shift[s], plain(rows, s)[np.clip(np.arange(n) - by, 0, n - 1)])


def test_gaps_and_chances(spark, rows):
    gapped = [(s, c, None if c == 12 else x, w) for s, c, x, w in rows]
    got = changed(spark, gapped, "gaussian_noise")
    assert all((v[0] is None) == (10 + i == 12) for s in LENGTHS for i, v in enumerate(got[s]))
    assert all(abs(v[0] - plain(rows, "e")[i, 0]) < 2 for i, v in enumerate(got["e"]) if v[0] is not None)
    half = changed(spark, rows, "scaling", chance=0.5)
    assert {s for s in LENGTHS if not np.allclose(half[s], plain(rows, s))} == {s for s in LENGTHS if au.drawn(s, "changed", 7) < 0.5}
    with pytest.raises(ValueError):
        changed(spark, rows, "no_such_kind")

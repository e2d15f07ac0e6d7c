import numpy as np
import pytest

from seqloom.functions import numeric as nm
from seqloom.operators import spectral as sp


def test_sine_has_half_its_squared_amplitude():
    t = np.arange(1000) / 100
    f, p = nm.spectrogram(np.sin(2 * np.pi * 5 * t), 100, 200, 100)
    s = nm.spectrum_summary(f, p, 1.0, ((4.0, 6.0),))
    assert abs(s["mean_power"] - 0.5) < 0.025 and s["peak_frequency_hz"] == 5
    f, p2 = nm.spectrogram(2 * np.sin(2 * np.pi * 5 * t), 100, 200, 100)
    assert abs(p2.sum() / p.sum() - 4) < 1e-9


def test_short_signals_have_the_same_columns():
    long, short = (nm.spectrum_summary(*nm.spectrogram(np.ones(n)), 0.8, ((2.1, 2.4),)) for n in (50, 2))
    assert list(long) == list(short) and short["band0_resolved"] == 0


def test_scalings():
    x = np.random.default_rng(2).normal(size=100)
    (f, psd), (_, power), (_, magnitude) = (nm.spectrogram(x, 20, 32, scaling=k) for k in ("psd", "power_spectrum", "magnitude"))
    frames = np.pad(x, (16, 28))[np.arange(0, 128, 16)[:, None] + np.arange(32)][: len(psd)]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    plain = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * window, axis=1))[1:6]
    twice = np.r_[1.0, np.full(15, 2.0), 1.0]
    assert np.allclose(magnitude[1:6], plain / 16) and np.allclose(power[1:6], twice * plain**2 / 256) and np.allclose(psd[1:5], (twice * plain**2 / (20 * 12))[:4])
    s = nm.spectrum_summary(f, psd, 0.8)
    shape = psd / psd.sum(axis=1, keepdims=True)
    flux = np.abs(np.diff(shape, axis=0)).sum(axis=1)
    assert s["psd_normalized_flux_mean"] == pytest.approx(flux.mean()) and s["psd_normalized_flux_max"] == pytest.approx(flux.max())


def test_wavelets():
    scales = np.geomspace(2.5, 12, 8)
    s = nm.scalogram_summary(np.sin(2 * np.pi * 2 * np.arange(400) / 20), scales, 20)
    assert len(s) == 30 and s["sum_magnitude"] > 0 and 0 < s["boundary_fraction"] < 1 and abs(s["dominant_frequency_hz"] - 2) < 0.5
    assert s["ridge_count_per_sample"] > 0 and s["low_scale_magnitude_fraction"] + s["mid_scale_magnitude_fraction"] + s["high_scale_magnitude_fraction"] == pytest.approx(1)
    blank = nm.scalogram_summary(np.full(9, np.nan), scales, 20)
    assert blank.pop("boundary_fraction") == 1.0 and set(blank.values()) == {0.0} and len(blank) == 29
    for bad in ((20, 4, 1.0), (20, 4, 16.0, None, 1.0), (20, 4, 16.0, 11.0)):
        with pytest.raises(ValueError):
            nm.scale_range(*bad)
    with pytest.raises(ValueError):
        nm.scalogram_summary(np.array([1.0, np.nan, 2.0]), scales, 20)


def test_gaps_are_refused(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in (0, 1, 3, 4)], "sequence_id string, sequence_counter long, x double")
    for f in (sp.stft_features, sp.cwt_features):
        with pytest.raises(Exception, match="uniform"):
            f(df, ["x"]).collect()


def test_spline_runs_through_its_knots():
    from seqloom.operators.augment import spline

    knots = np.array([0.0, 2.0, 5.0, 6.0, 9.0])
    cubic = np.stack([knots**3 - 4 * knots, 2 * knots**2 + 1], axis=1)
    place = np.linspace(0, 9, 31)
    assert np.allclose(spline(place, knots, cubic), np.stack([place**3 - 4 * place, 2 * place**2 + 1], axis=1))


def test_resampling_keeps_rows_and_marks(spark):
    rows = [("a", i, float(np.sin(i / 3)) if i != 4 else -1.0, 1.0, 0.0, 0.0, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "sequence_id string, sequence_counter long, x double, w double, i double, j double, k double")
    out = sp.resampled(df, ["x"], 20, 10, ["w", "i", "j", "k"]).orderBy("sequence_counter").collect()
    assert [r.sequence_counter for r in out] == list(range(20)) and out[4].x == -1.0
    assert all(abs(r.w**2 + r.i**2 + r.j**2 + r.k**2 - 1) < 1e-9 for r in out)


def test_native_transform_agrees_with_numpy(spark):
    x = np.random.default_rng(1).normal(size=16)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "sequence_id string, sequence_counter long, x double")
    got = {r.bin: r.power for r in sp.frame_spectrum(df, "x").collect()}
    want = np.abs(np.fft.rfft(x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)))) ** 2
    assert all(abs(got[b] - want[b]) < 1e-9 for b in (1, 2, 3, 4))


def test_equal_amplitudes_peak_where_the_sums_do(spark):
    """One value that isn't 0 has the same amplitude everywhere; the fast transform's rounding put the peak at 4 Hz."""
    lists = {1: [0, 0, 0.07, 0, 0], 2: [0, 0.05, 0, 0, 0, 0], 3: [0, 0.02, 0, 0, 0.09, 0, 0], 4: [0, 0, 0, 0, 0]}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in lists.items() for i, v in enumerate(x)], "sequence_id long, sequence_counter long, acc_x double")
    got = {r.sequence_id: (r.peak_frequency, round(r.peak, 6)) for r in sp.fft_features(df, ["acc_x"]).collect()}
    assert got == {1: (0.0, 0.07), 2: (0.0, 0.05), 3: (0.0, 0.11), 4: (0.0, 0.0)}

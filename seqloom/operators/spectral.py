"""Time-frequency operators: whole sequences go to NumPy in Arrow groups, one shuffle on the sequence."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import numeric as nm

from .sequences import along, bounds, whole_sequences
from .windows import AT, SEQ, entire, position


NOT_UNIFORM = "samples must be uniform: the counter must rise by one for every row; interpolate missing samples first"


def _per_sequence(df: DataFrame, signals: list[str], make, names: list[str], uniform: bool = False) -> DataFrame:
    """(sequence_id, signal, names...) of make(values) for every sequence and signal. With `uniform`, a sequence whose
    counter doesn't rise by one from row to row is an error. Partitions follow the size of the table."""
    kind = df.schema[SEQ].dataType.simpleString()

    def run(frames):
        for frame in whole_sequences(frames):
            starts = np.flatnonzero(frame[SEQ].to_numpy()[1:] != frame[SEQ].to_numpy()[:-1]) + 1
            ids, out = [], {n: [] for n in ("signal", *names)}
            if uniform and ((np.diff(frame[AT].to_numpy(float)) != 1) & (frame[SEQ].to_numpy()[1:] == frame[SEQ].to_numpy()[:-1])).any():
                raise ValueError(NOT_UNIFORM)
            values = {s: frame[s].to_numpy(float) for s in signals}
            for a, b in zip([0, *starts], [*starts, len(frame)]):
                for s in signals:
                    ids.append(frame[SEQ].iat[a])
                    out["signal"].append(s)
                    for n, v in make(values[s][a:b]).items():
                        out[n].append(v)
            yield pd.DataFrame({SEQ: ids} | out)

    rows = df.select(SEQ, AT, *signals).repartition(SEQ).sortWithinPartitions(SEQ, AT)
    return rows.mapInPandas(run, f"{SEQ} {kind}, signal string, " + ", ".join(f"{n} double" for n in names))


def stft_features(df: DataFrame, signals: list[str], rate: float = 20.0, size: int = 32, overlap: int | None = None, scaling: str = "density", bands=nm.BANDS) -> DataFrame:
    """Summary of the short-time Fourier transform of each signal (see numeric.spectrum_summary). Counters must be
    uniform; a signal without any value counts as zeros, nulls inside one are an error."""
    for low, high in bands:
        if not 0 <= low < high <= rate / 2:
            raise ValueError(f"bad frequency band {(low, high)}")
    if scaling not in nm.SCALINGS or not 0 <= (size // 2 if overlap is None else overlap) < size:
        raise ValueError(f"bad scaling or overlap: {scaling}, {overlap}")
    hop = (size - (size // 2 if overlap is None else overlap)) / rate

    def make(x):
        known = np.isfinite(x)
        if known.any() and not known.all():
            raise ValueError("a Fourier transform needs values without gaps")
        f, p = nm.spectrogram(x if known.all() else np.zeros(0), rate, size, overlap, scaling)
        return nm.spectrum_summary(f, p, hop, bands, scaling)

    return _per_sequence(df, signals, make, list(make(np.zeros(4))), uniform=True)


def welch(df: DataFrame, signals: list[str], rate: float = 20.0, size: int = 32) -> DataFrame:
    """(sequence_id, signal, psd array<double>): mean power density of the whole half-overlapping frames, without padding;
    a signal shorter than a frame is one frame (its periodogram)."""
    kind = df.schema[SEQ].dataType.simpleString()

    def run(frames):
        for frame in whole_sequences(frames):
            ids = frame[SEQ].to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(frame)]
            out = [(ids[a], s, nm.mean_density(np.nan_to_num(frame[s].to_numpy(float)[a:b]), rate, size).tolist()) for a, b in zip(cuts, cuts[1:]) for s in signals]
            yield pd.DataFrame(out, columns=[SEQ, "signal", "psd"])

    return df.select(SEQ, AT, *signals).repartition(SEQ).sortWithinPartitions(SEQ, AT).mapInPandas(run, f"{SEQ} {kind}, signal string, psd array<double>")


def cwt_features(df: DataFrame, signals: list[str], rate: float = 20.0, n_scales: int = 32, max_scale: float = 128.0, max_frequency: float | None = None, min_scale: float | None = None) -> DataFrame:
    """Summary of the Morlet wavelet magnitudes of each signal (see numeric.scalogram_summary). Counters must be uniform."""
    scales = nm.scale_range(rate, n_scales, max_scale, max_frequency, min_scale)
    return _per_sequence(df, signals, lambda x: nm.scalogram_summary(x, scales, rate), list(nm.scalogram_summary(np.zeros(0), scales, rate)), uniform=True)


def frame_spectrum(df: DataFrame, x: str, size: int = 16, hop: int = 8, bins: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(sequence_id, frame, bin, power): the discrete Fourier transform of whole frames, without Python: each row adds to
    the sine and cosine sums of the frames and bins that it belongs to."""
    df = df.withColumns({"_i": position(), "_n": F.count("*").over(entire())})
    frames = F.filter(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("_n") - size, F.lit(0)) / hop)), lambda f: (f * hop <= F.col("_i")) & (F.col("_i") < f * hop + size) & (f * hop + size <= F.col("_n")))
    df = df.select(SEQ, F.col(x).alias("_x"), "_i", F.explode(frames).alias("frame")).select(SEQ, "frame", "_x", (F.col("_i") - F.col("frame") * hop).alias("_k"), F.explode(F.array(*map(F.lit, bins))).alias("bin"))
    hann = 0.5 - 0.5 * F.cos(2 * pi * F.col("_k") / size)
    angle = 2 * pi * F.col("_k") * F.col("bin") / size
    sums = df.groupBy(SEQ, "frame", "bin").agg(F.sum(F.col("_x") * hann * F.cos(angle)).alias("c"), F.sum(F.col("_x") * hann * F.sin(angle)).alias("s"))
    return sums.select(SEQ, "frame", "bin", (F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("power"))


def band_powers(spectrum: DataFrame, rate: float, size: int, bands=nm.BANDS) -> DataFrame:
    """(sequence_id, band<i>) sums of power by half-open frequency band, and the spectral entropy in bits."""
    f = F.col("bin") * F.lit(rate / size)
    return spectrum.groupBy(SEQ).agg(*(F.sum(F.when((f >= a) & (f < b), F.col("power")).otherwise(0.0)).alias(f"band{i}") for i, (a, b) in enumerate(bands)))


def spectral_entropy(spectrum: DataFrame) -> DataFrame:
    """(sequence_id, entropy_bits) of the mean power per bin."""
    m = spectrum.groupBy(SEQ, "bin").agg(F.avg("power").alias("p"))
    p = F.col("p") / F.col("t")
    m = m.join(m.groupBy(SEQ).agg(F.sum("p").alias("t")), SEQ)
    return m.groupBy(SEQ).agg(F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p))), F.lit(0.0)).alias("entropy_bits"))


def fft_features(df: DataFrame, signals: list[str], rate: float = 20.0, bands=nm.BANDS, dc_offset: float | None = None) -> DataFrame:
    """Peak, energy and band energies of the amplitude spectrum of whole sequences; with a dc_offset, frequencies up to it
    count 0."""

    def make(x):
        x = np.nan_to_num(x)
        m = np.abs(np.fft.fft(x))[: max(1, len(x) // 2)]
        f = np.arange(len(m)) * rate / len(x)
        m = nm.peaks_settled(x, m if dc_offset is None else np.where(f <= dc_offset, 0.0, m))
        return {"peak_frequency": float(f[m.argmax()]), "peak": float(m.max()), "energy": float((m**2).sum())} | {f"band{i}": float((m[(f >= a) & (f < b)] ** 2).sum()) for i, (a, b) in enumerate(bands)}

    return _per_sequence(df, signals, make, list(make(np.zeros(4))))


def integrated(df: DataFrame, x: str, rate: float = 20.0, times: int = 1) -> DataFrame:
    """df plus <x>_integral: integration in the frequency domain (the mean has no integral)."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(AT)
        f = np.fft.fftfreq(len(frame), 1 / rate)
        y = np.fft.fft(np.nan_to_num(frame[x].to_numpy(float)))
        y[1:] /= (2j * np.pi * f[1:]) ** times
        y[0] = 0
        return frame.assign(**{f"{x}_integral": np.fft.ifft(y).real})

    return df.groupBy(SEQ).applyInPandas(run, f"{kind}, {x}_integral double")


def resampled(df: DataFrame, names: list[str], native: int, target: int, quaternions: list[str] | None = None) -> DataFrame:
    """df with the named columns as sensors of the target rate would give them, on the same rows; counters and all other
    columns stay. -1 marks pixels without return: they are bridged before and restored after. Quaternions are joined
    along the sphere."""

    def make(frame, at):
        out = {n: frame[n].to_numpy(float).copy() for n in (*names, *(quaternions or ()))}
        for a, b in zip(at, at[1:]):
            for n in names:
                x = out[n][a:b]
                gone = (x == -1) | ~np.isfinite(x)
                if not gone.all():
                    i = np.arange(len(x))
                    out[n][a:b] = np.where(gone, x, nm.resampled(np.interp(i, i[~gone], x[~gone]), native, target))
            if quaternions:
                q, t = np.stack([out[n][a:b] for n in quaternions], axis=1), np.arange(b - a) / native
                slow = np.arange(0, t[-1] + 1e-9, 1 / target)
                turned = nm.slerp(nm.slerp(q / np.linalg.norm(q, axis=1, keepdims=True), slow, t), t, slow)
                for k, n in enumerate(quaternions):
                    out[n][a:b] = turned[:, k]
        return out

    return along(df, make)


def with_spectra(df: DataFrame, signals: list[str], rate: float, stft: dict | None, cwt: dict | None) -> tuple[DataFrame, list[str]]:
    """df with the numbers of stft_features and cwt_features of every signal on each row of its sequence, as
    <signal>_stft0_<name> and <signal>_cwt0_<name>, and their names (shuffles: see sequences.along). A sequence whose
    counter doesn't rise by one from row to row is an error."""
    makers = []
    if stft is not None:
        how = {"size": 32, "overlap": None, "scaling": "density"} | stft
        hop = (how["size"] - (how["size"] // 2 if how["overlap"] is None else how["overlap"])) / rate
        makers.append(("stft0", lambda x: nm.spectrum_summary(*nm.spectrogram(x, rate, how["size"], how["overlap"], how["scaling"]), hop, nm.BANDS, how["scaling"])))
    if cwt is not None:
        scales = nm.scale_range(rate, **cwt)
        makers.append(("cwt0", lambda x: nm.scalogram_summary(x, scales, rate)))
    names = [f"{s}_{kind}_{n}" for s in signals for kind, f in makers for n in f(np.zeros(4))]

    def make(frame, at):
        out, inner = {n: np.empty(len(frame)) for n in names}, np.ones(max(len(frame) - 1, 0), bool)
        inner[at[1:-1] - 1] = False  # steps from one sequence to the next
        if (np.diff(frame[AT].to_numpy(float))[inner] != 1).any():
            raise ValueError(NOT_UNIFORM)
        for s in signals:
            values = frame[s].to_numpy(float)
            for a, b in zip(at, at[1:]):
                for kind, f in makers:
                    for n, v in f(np.nan_to_num(values[a:b])).items():
                        out[f"{s}_{kind}_{n}"][a:b] = v
        return out

    return along(df, make, names), names


def signal_summary(df: DataFrame, signals: list[str], rate: float = 20.0, n_bands: int = 5) -> DataFrame:
    """Time statistics of the known values of each signal, of its one-sided amplitude spectrum, and the energies of
    equal frequency bands up to half the rate (the last one closed). Signals without any value give zeros."""

    def make(x):
        x = x[np.isfinite(x)]
        x = x if len(x) else np.zeros(1)
        m = nm.peaks_settled(x, np.abs(np.fft.rfft(x)))
        f, width = np.arange(len(m)) * rate / len(x), rate / 2 / n_bands
        out = {"mean": x.mean(), "std": x.std(), "min": x.min(), "max": x.max(), "median": np.median(x), "range": np.ptp(x), "energy": (x * x).sum(), "rms": np.sqrt((x * x).mean())}
        out |= {"fft_peak_frequency": f[m.argmax()], "fft_peak_magnitude": m.max(), "fft_total_energy": (m * m).sum(), "fft_mean": m.mean(), "fft_std": m.std()}
        for i in range(n_bands):
            inside = (f >= i * width) & ((f < (i + 1) * width) if i < n_bands - 1 else (f <= rate / 2))
            out[f"fft_band_{i + 1}_energy"] = (m[inside] ** 2).sum()
        return {k: float(v) for k, v in out.items()}

    return _per_sequence(df, signals, make, list(make(np.zeros(4))))


def peak_bands(df: DataFrame, signals: list[str], rate: float = 20.0, prominence: float = 1e-4, most: int = 8) -> DataFrame:
    """Moments of the amplitude spectrum and of the band around its highest peak; bands end half-way between the `most`
    highest prominent peaks."""

    def make(x):
        x = np.nan_to_num(x)
        a, f = np.abs(np.fft.rfft(x - x.mean())), np.fft.rfftfreq(len(x), 1 / rate)
        inner = np.flatnonzero((a[1:-1] > a[:-2]) & (a[1:-1] >= a[2:])) + 1 if len(a) > 2 else np.zeros(0, int)
        high = [p for p in inner if a[p] - max(a[:p].min(), a[p + 1 :].min()) >= prominence]
        high = sorted(sorted(high, key=lambda p: -a[p])[:most])
        total = a.sum()
        mean = float((f * a).sum() / total) if total > 0 else 0.0
        std = float(np.sqrt((((f - mean) ** 2) * a).sum() / total)) if total > 0 else 0.0
        third, fourth = (float(((((f - mean) / std) ** k) * a).sum() / total) if std > 0 else 0.0 for k in (3, 4))
        top = max(high, key=lambda p: a[p]) if high else 0
        at = high.index(top) if high else 0
        low = (f[high[at - 1]] + f[top]) / 2 if high and at else 0.0
        end = (f[high[at + 1]] + f[top]) / 2 if high and at + 1 < len(high) else float(f[-1])
        return {"peaks": float(len(high)), "mean": mean, "std": std, "skew": third, "kurtosis": fourth, "auc": float(total), "top_frequency": float(f[top]), "top_band_energy": float((a[(f >= low) & (f < end)] ** 2).sum())}

    return _per_sequence(df, signals, make, list(make(np.zeros(4))))


def kernel_features(df: DataFrame, x: str, dilations: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """(sequence_id, features array<double>): shares of positive values under a fixed set of dilated kernels."""
    kind = df.schema[SEQ].dataType.simpleString()

    def run(batches):
        for frame in whole_sequences(b.to_pandas() for b in batches):
            at, values = bounds(frame), np.nan_to_num(frame[x].to_numpy(float))
            means = np.array([values[a:b].mean() for a, b in zip(at, at[1:])])
            shares = nm.kernel_shares_of(values - np.repeat(means, np.diff(at)), at, dilations)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1]), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(frame[SEQ].iloc[at[:-1]]), lists], [SEQ, "features"])

    return df.select(SEQ, AT, x).repartition(SEQ).sortWithinPartitions(SEQ, AT).mapInArrow(run, f"{SEQ} {kind}, features array<double>")

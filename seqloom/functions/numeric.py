"""NumPy helpers for the operators that Spark expressions can't state: small arrays of one sequence or one grid."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np

#: Default frequency bands in Hz, half open.
BANDS = ((0.0, 1.0), (1.0, 3.0), (3.0, 6.0), (6.0, 10.0))


def segments(x: np.ndarray, size: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames (n, size) of x between half a frame of zeros on both sides, padded to whole hops, and the observed share
    of every sample in them."""
    seen = np.ones(len(x))
    if len(x) < size:
        x, seen = np.pad(x, (0, size - len(x))), np.pad(seen, (0, size - len(seen)))
    half = size // 2
    x, seen = np.pad(x, half), np.pad(seen, half)
    rest = -(len(x) - size) % hop
    x, seen = np.pad(x, (0, rest)), np.pad(seen, (0, rest))
    at = np.arange(0, len(x) - size + 1, hop)[:, None] + np.arange(size)
    return x[at], seen[at]


SCALINGS = {"density": "psd", "psd": "psd", "spectrum": "power_spectrum", "power_spectrum": "power_spectrum", "magnitude": "magnitude"}


def spectrogram(x: np.ndarray, rate: float = 20.0, size: int = 32, overlap: int | None = None, scaling: str = "density"):
    """(frequencies, values (frames, bins)): periodic Hann window, mean removed per frame, one-sided. Powers count both
    sides of the spectrum; densities are divided by the share of window energy that lies on observed samples (a frame
    without any is 0); magnitudes are plain absolute values."""
    hop = size - (size // 2 if overlap is None else overlap)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    frames, seen = segments(np.asarray(x, float), size, hop)
    magnitude = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * window, axis=1))
    kind, f = SCALINGS[scaling], np.fft.rfftfreq(size, 1 / rate)
    if kind == "magnitude":
        return f, magnitude / window.sum()
    power = magnitude**2
    power[:, 1 : size // 2 if size % 2 == 0 else None] *= 2
    if kind == "power_spectrum":
        return f, power / window.sum() ** 2
    energy = (window**2).sum()
    share = (seen * window**2).sum(axis=1, keepdims=True) / energy
    return f, np.where(share > 0, power / (rate * energy * np.where(share > 0, share, 1.0)), 0.0)


def mean_density(x: np.ndarray, rate: float, size: int) -> np.ndarray:
    """Mean one-sided power density of the whole half-overlapping Hann frames of x, the mean of each removed."""
    size = max(1, min(size, len(x)))
    at = np.arange(0, max(1, len(x) - size + 1), max(1, size // 2))[:, None] + np.arange(size)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    frames = x[at] if len(x) else np.zeros((1, 1))
    power = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    power[:, 1 : size // 2 if size % 2 == 0 else None] *= 2
    return power.mean(axis=0) / (rate * (window**2).sum())


def entropy_bits(p: np.ndarray) -> float:
    total = p.sum()
    if total <= 0:
        return 0.0
    p = p[p > 0] / total
    return float(-(p * np.log2(p)).sum())


def slope(t: np.ndarray, y: np.ndarray) -> float:
    """Of the least-squares line; 0 for a single point."""
    t = t - t.mean() if len(t) else t
    return float((t * y).sum() / (t * t).sum()) if len(t) > 1 else 0.0


def levels(v: np.ndarray) -> dict[str, float]:
    return {"mean": v.mean(), "std": v.std(), "max": v.max(), "min": v.min(), "median": np.median(v), "sum": v.sum()}


def spectrum_summary(f: np.ndarray, values: np.ndarray, hop_seconds: float, bands=BANDS, scaling: str = "density") -> dict[str, float]:
    """Numbers about a spectrogram: levels, peak, log levels and the flux between the frames' normalised spectra; of
    densities also mean power, centroid, spread, entropy, course over time and band powers."""
    t, kind = np.arange(len(values)) * hop_seconds, SCALINGS[scaling]
    peak = np.unravel_index(values.T.argmax(), values.T.shape)
    out = {f"{kind}_{k}": v for k, v in levels(values).items()} | {"peak_frequency_hz": f[peak[0]], "peak_time_s": t[peak[1]]}
    if kind == "psd":
        step = f[1] - f[0]
        weights, frame = values.mean(axis=0) * step, values.sum(axis=1) * step
        power = weights.sum()
        centroid = (f * weights).sum() / power if power else 0.0
        out |= {
            "mean_power": power, "power_std_across_frames": frame.std(), "spectral_centroid_hz": centroid,
            "spectral_spread_hz": np.sqrt(((f - centroid) ** 2 * weights).sum() / power) if power else 0.0, "spectral_entropy_bits": entropy_bits(weights),
            "temporal_power_mean": frame.mean(), "temporal_power_std": frame.std(), "temporal_power_slope_per_s": slope(t, frame),
        }
        for i, (low, high) in enumerate(bands):
            inside = (f >= low) & (f < high)
            band = weights[inside].sum()
            out |= {f"band{i}_mean_power": band, f"band{i}_power_fraction": band / power if power > 0 else 0.0, f"band{i}_resolved": inside.any()}
    logs = np.log1p(values)
    shape = values / np.maximum(values.sum(axis=1, keepdims=True), np.finfo(float).tiny)
    flux = np.abs(np.diff(shape, axis=0)).sum(axis=1) if len(shape) > 1 else np.zeros(1)
    out |= {f"log1p_{kind}_mean": logs.mean(), f"log1p_{kind}_std": logs.std(), f"log1p_{kind}_max": logs.max()}
    out |= {f"{kind}_normalized_flux_mean": flux.mean(), f"{kind}_normalized_flux_std": flux.std(), f"{kind}_normalized_flux_max": flux.max()}
    return {k: float(v) for k, v in out.items()}


#: Oscillations per unit of scale of the Morlet wavelet exp(-x^2 / 2) cos(5 x), and where it ends on both sides.
MORLET_CENTRE, MORLET_END = 0.8125, 8.0


def integrated_morlet(points: int = 1 << 12) -> tuple[np.ndarray, float]:
    """The running integral of the wavelet over its support, and the distance of its points."""
    x = np.linspace(-MORLET_END, MORLET_END, points)
    return np.cumsum(np.exp(-(x**2) / 2) * np.cos(5 * x)) * (x[1] - x[0]), x[1] - x[0]


def scalogram(x: np.ndarray, scales: np.ndarray):
    """(coefficients (scales, n), inside (scales, n)): the signal against the wavelet's integral at each scale, then
    differences (as exact as the integral, also for scales near one sample), and which values both ends leave alone."""
    n, (integral, step) = len(x), integrated_morlet()
    out, inside = np.zeros((len(scales), n)), np.zeros((len(scales), n), bool)
    for i, s in enumerate(scales):
        at = (np.arange(s * 2 * MORLET_END + 1) / (s * step)).astype(int)
        full = -np.sqrt(s) * np.diff(np.convolve(x, integral[at[at < len(integral)]][::-1]))
        spare = (len(full) - n) / 2
        out[i] = full[int(np.floor(spare)) : len(full) - int(np.ceil(spare))] if spare > 0 else full
        edge = int(np.ceil(MORLET_END * s / 2))
        inside[i, edge : max(edge, n - edge)] = True
    return out, inside


def scale_range(rate: float, n_scales: int = 32, max_scale: float = 128.0, max_frequency: float | None = None, min_scale: float | None = None) -> np.ndarray:
    """Geometric scales from that of the highest frequency; none may lie above the Nyquist frequency."""
    top = 0.4 * rate if max_frequency is None else max_frequency
    if not 0 < top <= rate / 2:
        raise ValueError("the highest frequency must lie between 0 and half the rate")
    low = MORLET_CENTRE * rate / top if min_scale is None else min_scale
    if low <= 0 or low > max_scale:
        raise ValueError("the largest scale lies above the highest frequency")
    if MORLET_CENTRE * rate / low > rate / 2 * (1 + 1e-12):
        raise ValueError("scales lie above the Nyquist frequency")
    return np.geomspace(low, max_scale, n_scales)


def scalogram_summary(x: np.ndarray, scales: np.ndarray, rate: float) -> dict[str, float]:
    """Numbers about the wavelet magnitudes that both ends leave alone: 27 of them and three of their logarithms. Signals
    without any value give zeros and a boundary fraction of 1; nulls inside a signal are an error."""
    if len(x) and np.isfinite(x).any():
        if not np.isfinite(x).all():
            raise ValueError("a wavelet transform needs values without gaps")
        coefficients, inside = scalogram(x, scales)
        blank = False
    else:
        coefficients, inside, blank = np.zeros((len(scales), 1)), np.zeros((len(scales), 1), bool), True
    magnitude = np.where(inside, np.abs(coefficients), 0.0)
    some = magnitude[inside] if inside.any() else np.zeros(1)
    per_scale, per_time = (magnitude.sum(axis=k) / np.maximum(inside.sum(axis=k), 1) for k in (1, 0))
    best, third, total = int(per_scale.argmax()), len(scales) // 3, per_scale.sum()
    inner = magnitude[1:-1]
    ridge = inner[(inner > magnitude[:-2]) & (inner > magnitude[2:])] if len(scales) > 2 else np.zeros(0)
    share = lambda part: part.sum() / total if total > 0 and third else 0.0
    logs = np.log1p(some)
    out = {f"{k}_magnitude": v for k, v in levels(some).items()} | {
        "coefficient_power_mean": (some**2).mean(), "scale_mean_max_magnitude": per_scale.max(), "scale_mean_min_magnitude": per_scale.min(),
        "scale_mean_std_magnitude": per_scale.std(), "dominant_scale": 0.0 if blank else scales[best], "dominant_frequency_hz": 0.0 if blank else MORLET_CENTRE * rate / scales[best],
        "dominant_scale_mean_magnitude": per_scale.max(), "scale_entropy_bits": entropy_bits(per_scale), "temporal_mean_magnitude": per_time.mean(),
        "temporal_std_magnitude": per_time.std(), "temporal_entropy_bits": entropy_bits(per_time), "temporal_slope_per_s": slope(np.arange(len(per_time)) / rate, per_time),
        "boundary_fraction": 1 - inside.mean(), "low_scale_magnitude_fraction": share(per_scale[:third]), "mid_scale_magnitude_fraction": share(per_scale[third : 2 * third]),
        "high_scale_magnitude_fraction": share(per_scale[2 * third :]), "ridge_mean": ridge.mean() if len(ridge) else 0.0, "ridge_std": ridge.std() if len(ridge) else 0.0,
        "ridge_count_per_sample": len(ridge) / max(1, len(per_time)), "variance_to_mean_scale_magnitude": per_scale.var() / per_scale.mean() if per_scale.mean() > 0 else 0.0,
        "valid_coefficient_fraction": inside.mean(), "log1p_magnitude_mean": logs.mean(), "log1p_magnitude_std": logs.std(), "log1p_magnitude_max": logs.max(),
    }
    return {k: float(v) for k, v in out.items()}


def low_pass(widest: int) -> np.ndarray:
    """Filter of unit sum that ends at the `widest`-th part of the highest frequency: ten zero crossings on either side."""
    t = np.arange(-10 * widest, 10 * widest + 1)
    taps = np.sinc(t / widest) * np.kaiser(len(t), 5.0)
    return taps / taps.sum()


def polyphase(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up / down times its rate through a Kaiser-windowed low-pass filter."""
    common = math.gcd(up, down)
    up, down = up // common, down // common
    if up == down or not len(x):
        return x.copy()
    taps = low_pass(max(up, down)) * up
    half = len(taps) // 2
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    weight = np.zeros(len(x) * up)
    weight[::up] = 1.0
    same = lambda v: np.convolve(v, taps)[half : half + len(v)]
    full, unit = same(wide), same(weight)
    return (full / np.where(np.abs(unit) > 1e-9, unit, 1.0))[::down]


def resampled(x: np.ndarray, native: int, target: int) -> np.ndarray:
    """x as a sensor of the target rate would have seen it, on the native grid: filtered down, then joined by lines."""
    low = polyphase(x, target, native)
    return np.interp(np.arange(len(x)) / native, np.arange(len(low)) / target, low)


def slerp(q: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Unit quaternions between those at `times`."""
    i = np.clip(np.searchsorted(times, at, side="right") - 1, 0, max(0, len(times) - 2))
    j = np.minimum(i + 1, len(times) - 1)
    span = np.where(times[j] > times[i], times[j] - times[i], 1.0)
    s = np.clip((at - times[i]) / span, 0, 1)[:, None]
    a, b = q[i], q[j]
    dot = (a * b).sum(axis=1, keepdims=True)
    b, dot = np.where(dot < 0, -b, b), np.clip(np.abs(dot), 0, 1)
    angle = np.arccos(dot)
    small = angle < 1e-6
    safe = np.where(small, 1.0, np.sin(angle))
    out = np.where(small, (1 - s) * a + s * b, (np.sin((1 - s) * angle) * a + np.sin(s * angle) * b) / safe)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def largest_blob(grid: np.ndarray, below: float = 1500.0) -> tuple[int, float, float]:
    """Area and centre (row, column) of the largest 4-connected group of near pixels."""
    todo, best = {tuple(p) for p in np.argwhere(grid < below)}, []
    while todo:
        group, front = [], [todo.pop()]
        while front:
            r, c = front.pop()
            group.append((r, c))
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in todo:
                    todo.remove(p)
                    front.append(p)
        best = max(best, group, key=len)
    return (len(best), *np.mean(best, axis=0)) if best else (0, 0.0, 0.0)


def near_blob(g: np.ndarray) -> tuple[int, float, float]:
    return largest_blob(g, 100.0)


def fft_energy(g: np.ndarray) -> tuple[float, float, float]:
    """Power in the four middle bins of the shifted two-dimensional spectrum, elsewhere, and the former's share."""
    p = np.abs(np.fft.fftshift(np.fft.fft2(g))) ** 2
    low = p[3:5, 3:5].sum()
    return low, p.sum() - low, low / p.sum() if p.sum() > 0 else 0.0


def singular_values(g: np.ndarray) -> tuple[float, ...]:
    """The three largest singular values, the ratio of the first two, and the share of energy in the first two."""
    s = np.linalg.svd(g, compute_uv=False)
    energy = (s**2).sum()
    return (*s[:3], s[1] / s[0] if s[0] > 0 else 0.0, (s[:2] ** 2).sum() / energy if energy > 0 else 0.0)


def kernel_shares(x: np.ndarray, dilations: tuple[int, ...] = (1, 2, 4)) -> np.ndarray:
    """Shares of positive values after convolution with the 84 kernels of nine weights, three of them 2 and six -1, at
    each dilation. Signals are padded with zeros so that every place counts."""
    return kernel_shares_of(x, np.array([0, len(x)]), dilations)[0]


#: 1 where a kernel's weight is 2, not -1.
KERNELS = np.array([[float(k in c) for k in range(9)] for c in combinations(range(9), 3)])
#: Values that meet the kernels at a time.
KERNEL_VALUES = 1 << 12


def kernel_shares_of(values: np.ndarray, at: np.ndarray, dilations: tuple[int, ...] = (1, 2, 4)) -> np.ndarray:
    """kernel_shares of many signals, one a row: those between the places `at` of one array. Whole signals go together,
    KERNEL_VALUES values or one signal at a time."""
    sizes, out = np.diff(at), np.empty((len(at) - 1, len(KERNELS) * len(dilations)))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(at, at[a] + KERNEL_VALUES, side="right")) - 1)
        n, first, last = sizes[a:b], np.repeat(at[a:b], sizes[a:b]), np.repeat(at[a + 1 : b + 1], sizes[a:b])
        place = np.arange(at[a], at[b])
        for i, d in enumerate(dilations):
            taps = np.zeros((9, len(place)))
            for k in range(9):
                there = place + (k - 4) * d
                known = (there >= first) & (there < last)
                taps[k, known] = values[there[known]]
            positive = (3 * KERNELS @ taps - taps.sum(axis=0)) > 0
            out[a:b, i * len(KERNELS) : (i + 1) * len(KERNELS)] = (np.add.reduceat(positive, at[a:b] - at[a], axis=1, dtype=np.int64) / n).T
        a = b
    return out


def peaks_settled(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The amplitudes m of x's transform, those that all but tie for the highest from sums of cosines and sines in row
    order. A fast transform leaves to its rounding which of equal amplitudes is the highest one (a single value that isn't
    0 has equal ones everywhere). The work is the number of ties times that of values that aren't 0, which is about len(x)."""
    near = np.flatnonzero((m >= m.max() * (1 - 1e-9)) & (m > 0))
    if len(near) > 1:
        m, n, some = m.copy(), len(x), [(int(i), float(x[i])) for i in np.flatnonzero(x)]
        for k in near.tolist():
            c = s = 0.0
            for i, v in some:
                angle = 2 * math.pi * i * k / n
                c, s = c + v * math.cos(angle), s + v * math.sin(angle)
            m[k] = math.sqrt(c * c + s * s)
    return m

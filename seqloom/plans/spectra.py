"""Queries of the time-frequency operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import numeric as nm
from seqloom.operators import spectral as sp
from seqloom.sources import adapters as src

from .ordered import units
from .registry import query

PLACES = """i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY sequence_counter) - 1 AS i, count(*) OVER (PARTITION BY sequence_id) AS n FROM samples)"""
DFT = f"""{PLACES},
f AS (SELECT sequence_id, acc_x, i, n, unnest(range(0, greatest(n - 16, 0) // 8 + 1)) AS frame FROM i),
g AS (SELECT sequence_id, frame, acc_x, i - frame * 8 AS k, unnest([1, 2, 3, 4]) AS bin FROM f WHERE frame * 8 <= i AND i < frame * 8 + 16 AND frame * 8 + 16 <= n),
h AS (SELECT *, acc_x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / 16)) AS x, 2 * pi() * k * bin / 16 AS angle FROM g),
p AS (SELECT sequence_id, frame, bin, pow(sum(x * cos(angle)), 2) + pow(sum(x * sin(angle)), 2) AS power FROM h GROUP BY 1, 2, 3)"""


def rounded(df, digits: dict, default: int = 6):
    """Doubles rounded for comparison, without negative zero."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(c, digits.get(c, default)) + 0.0).alias(c) if kinds[c] == "double" else c for c in df.columns))


@query("z01_frame_spectrum", f"WITH {DFT} SELECT sequence_id, CAST(frame AS BIGINT) AS frame, bin, round(power, 4) AS power FROM p", "samples")
def z01(spark, d):
    return sp.frame_spectrum(src.samples(spark, d), "acc_x").withColumn("power", F.round("power", 4))


BAND_SUMS = ", ".join(
    f"round(sum(CASE WHEN bin * 1.25::DOUBLE >= {a} AND bin * 1.25::DOUBLE < {b} THEN power ELSE 0 END), 3) AS band{i}" for i, (a, b) in enumerate(nm.BANDS)
)


@query("z03_band_powers", f"WITH {DFT} SELECT sequence_id, {BAND_SUMS} FROM p GROUP BY 1", "samples")
def z03(spark, d):
    b = sp.band_powers(sp.frame_spectrum(src.samples(spark, d), "acc_x"), 20.0, 16)
    return b.select("sequence_id", *(F.round(f"band{i}", 3).alias(f"band{i}") for i in range(4)))


@query("z04_spectral_entropy", f"""WITH {DFT}, m AS (SELECT sequence_id, bin, avg(power) AS p FROM p GROUP BY 1, 2),
t AS (SELECT sequence_id, p / sum(p) OVER (PARTITION BY sequence_id) AS p FROM m)
SELECT sequence_id, round(-sum(p * log2(p)), 6) AS entropy_bits FROM t GROUP BY 1""", "samples")
def z04(spark, d):
    return sp.spectral_entropy(sp.frame_spectrum(src.samples(spark, d), "acc_x")).withColumn("entropy_bits", F.round("entropy_bits", 6))


def padded_sql(size: int, scale: str) -> str:
    """Frames of half-overlapping Hann windows over signals between half a frame of zeros, padded to whole hops: `v`
    holds a value for every sequence, frame m and bin b, of the power by `scale` (psd divides by the observed share)."""
    hop, energy, total = size // 2, 3 * size / 8, size / 2
    value = {"psd": f"CASE WHEN share > 0 THEN power / (20 * {energy}::DOUBLE) / share ELSE 0 END", "power_spectrum": f"power / {total * total}::DOUBLE"}[scale]
    return f"""{PLACES},
n AS (SELECT DISTINCT sequence_id, n, greatest(n, {size}) AS long FROM i),
m AS (SELECT sequence_id, n, unnest(range(0, (long + {hop - 1}) // {hop} + 1)) AS m FROM n),
k AS (SELECT sequence_id, n, m, unnest(range(0, {size})) AS k FROM m),
x AS (SELECT k.*, m * {hop} - {hop} + k AS pos, coalesce(i.acc_x, 0) AS x, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / {size}) AS w
  FROM k LEFT JOIN i ON i.sequence_id = k.sequence_id AND i.i = m * {hop} - {hop} + k),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY sequence_id, m) AS c, sum(CASE WHEN pos >= 0 AND pos < n THEN w * w ELSE 0 END) OVER (PARTITION BY sequence_id, m) / {energy}::DOUBLE AS share FROM x),
b AS (SELECT *, unnest(range(0, {size // 2 + 1})) AS b FROM c),
q AS (SELECT sequence_id, m, b, any_value(share) AS share, pow(sum(c * w * cos(2 * pi() * k * b / {size})), 2) + pow(sum(c * w * sin(2 * pi() * k * b / {size})), 2) AS p FROM b GROUP BY 1, 2, 3),
o AS (SELECT *, p * CASE WHEN b IN (0, {size // 2}) THEN 1 ELSE 2 END AS power FROM q),
v AS (SELECT sequence_id, m, b, b * 20.0::DOUBLE / {size} AS f, {value} AS v FROM o),
u AS (SELECT *, v / greatest(sum(v) OVER (PARTITION BY sequence_id, m), 2.2250738585072014e-308::DOUBLE) AS u FROM v),
d AS (SELECT sequence_id, m, sum(d) AS d FROM (SELECT sequence_id, m, abs(u - lag(u) OVER (PARTITION BY sequence_id, b ORDER BY m)) AS d FROM u) WHERE d IS NOT NULL GROUP BY 1, 2),
flux AS (SELECT sequence_id, avg(d) AS mean, stddev_pop(d) AS std, max(d) AS max FROM d GROUP BY 1),
levels AS (SELECT sequence_id, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS max, min(v) AS min, median(v) AS median, sum(v) AS sum, arg_max(f, v) AS peak, arg_max(m * {hop} / 20.0::DOUBLE, v) AS peak_time,
  avg(ln(1 + v)) AS log_mean, stddev_pop(ln(1 + v)) AS log_std, max(ln(1 + v)) AS log_max FROM v GROUP BY 1)"""


BANDS_OF = ", ".join(f"sum(CASE WHEN f >= {a} AND f < {b} THEN w ELSE 0 END) AS band{i}" for i, (a, b) in enumerate(nm.BANDS))
BANDS_OUT = ", ".join(f"round(band{i}, 4) + 0.0 AS band{i}_mean_power, round(band{i} / power, 6) + 0.0 AS band{i}_power_fraction, 1.0::DOUBLE AS band{i}_resolved" for i in range(len(nm.BANDS)))


def levels_out(kind: str, digits: int) -> str:
    names = ", ".join(f"round(l.{c}, {digits}) + 0.0 AS {kind}_{c}" for c in ("mean", "std", "max", "min", "median", "sum"))
    logs = ", ".join(f"round(log_{c}, 6) + 0.0 AS log1p_{kind}_{c}" for c in ("mean", "std", "max"))
    flux = ", ".join(f"round(flux.{c}, 6) + 0.0 AS {kind}_normalized_flux_{c}" for c in ("mean", "std", "max"))
    return f"{names}, round(peak, 6) AS peak_frequency_hz, round(peak_time, 6) AS peak_time_s, {logs}, {flux}"


@query("z02_stft_summary", f"""WITH {padded_sql(32, 'psd')},
w AS (SELECT sequence_id, f, avg(v) * 0.625::DOUBLE AS w FROM v GROUP BY 1, 2),
p AS (SELECT sequence_id, sum(w) AS power, sum(f * w) / sum(w) AS centroid, {BANDS_OF} FROM w GROUP BY 1),
s AS (SELECT sequence_id, any_value(centroid) AS centroid, sqrt(sum(pow(f - centroid, 2) * w) / any_value(power)) AS spread, -sum(CASE WHEN w > 0 THEN w / power * log2(w / power) ELSE 0 END) AS entropy FROM w JOIN p USING (sequence_id) GROUP BY 1),
t AS (SELECT sequence_id, m * 0.8::DOUBLE AS t, sum(v) * 0.625::DOUBLE AS p FROM v GROUP BY 1, 2),
y AS (SELECT sequence_id, avg(p) AS mean, stddev_pop(p) AS std, regr_slope(p, t) AS slope FROM t GROUP BY 1)
SELECT l.sequence_id, 'acc_x' AS signal, {levels_out('psd', 4)}, round(power, 4) AS mean_power, round(y.std, 4) AS power_std_across_frames, round(s.centroid, 6) AS spectral_centroid_hz,
  round(spread, 6) AS spectral_spread_hz, round(entropy, 6) AS spectral_entropy_bits, round(y.mean, 4) AS temporal_power_mean, round(y.std, 4) AS temporal_power_std, round(slope, 4) + 0.0 AS temporal_power_slope_per_s, {BANDS_OUT}
FROM levels l JOIN p USING (sequence_id) JOIN s USING (sequence_id) JOIN y USING (sequence_id) JOIN flux USING (sequence_id)""", "samples")
def z02(spark, d):
    s = sp.stft_features(src.samples(spark, d), ["acc_x"])
    four = [f"psd_{c}" for c in ("mean", "std", "max", "min", "median", "sum")] + ["mean_power", "power_std_across_frames", "temporal_power_mean", "temporal_power_std", "temporal_power_slope_per_s"]
    return rounded(s, dict.fromkeys([*four, *(f"band{i}_mean_power" for i in range(4))], 4))


@query("z12_power_spectrum_scalings", f"WITH {padded_sql(16, 'power_spectrum')} SELECT l.sequence_id, 'acc_x' AS signal, {levels_out('power_spectrum', 4)} FROM levels l JOIN flux USING (sequence_id)", "samples")
def z12(spark, d):
    s = sp.stft_features(src.samples(spark, d), ["acc_x"], size=16, scaling="spectrum")
    return rounded(s, dict.fromkeys([f"power_spectrum_{c}" for c in ("mean", "std", "max", "min", "median", "sum")], 4))


@query("z12_welch", f"""WITH {PLACES},
n AS (SELECT DISTINCT sequence_id, n, least(n, 16) AS size FROM i),
m AS (SELECT *, unnest(range(0, (n - size) // greatest(size // 2, 1) + 1)) * greatest(size // 2, 1) AS a FROM n),
x AS (SELECT m.sequence_id, size, a, i.i - a AS k, acc_x - avg(acc_x) OVER (PARTITION BY m.sequence_id, a) AS x, CASE WHEN size = 1 THEN 1 ELSE 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (i.i - a) / size) END AS w FROM m JOIN i ON i.sequence_id = m.sequence_id AND i.i >= a AND i.i < a + size),
b AS (SELECT *, unnest(range(0, size // 2 + 1)) AS b FROM x),
p AS (SELECT sequence_id, a, b, (pow(sum(x * w * cos(2 * pi() * k * b / size)), 2) + pow(sum(x * w * sin(2 * pi() * k * b / size)), 2)) * CASE WHEN b = 0 OR 2 * b = any_value(size) THEN 1 ELSE 2 END / (20 * sum(w * w)) AS p FROM b GROUP BY 1, 2, 3)
SELECT sequence_id, CAST(b AS INTEGER) AS bin, round(avg(p), 4) + 0.0 AS psd FROM p GROUP BY 1, 2""", "samples")
def z12w(spark, d):
    p = sp.welch(src.samples(spark, d), ["acc_x"], size=16)
    return rounded(p.select("sequence_id", F.posexplode("psd").alias("bin", "psd")), {"psd": 4})


@query("z05_cwt_summary")
def z05(spark, d):
    return sp.cwt_features(src.samples(spark, d), ["acc_x"], n_scales=16, max_scale=16.0)


def amplitudes_sql(half: str, shape: str = "samples", names: str = "acc_x") -> str:
    """Amplitudes a at frequencies f of whole sequences' transforms, bins below `half`."""
    axes = ", ".join(f"'{n}', {n}" for n in names.split())
    return f"""y AS (SELECT sequence_id, sequence_counter, unnest(map_entries(MAP {{{axes.replace("', ", "': ")}}})) AS e FROM {shape}),
z AS (SELECT sequence_id, e.key AS signal, e.value AS x, row_number() OVER (PARTITION BY sequence_id, e.key ORDER BY sequence_counter) - 1 AS i, count(*) OVER (PARTITION BY sequence_id, e.key) AS n FROM y),
c AS (SELECT *, unnest(range(0, {half})) AS k FROM z),
a AS (SELECT sequence_id, signal, k * 20.0::DOUBLE / any_value(n) AS f, sqrt(pow(sum(x * cos(2 * pi() * i * k / n)), 2) + pow(sum(x * sin(2 * pi() * i * k / n)), 2)) AS a FROM c GROUP BY sequence_id, signal, k)"""


def fft_out(amplitude: str) -> str:
    bands = ", ".join(f"round(sum(CASE WHEN f >= {a} AND f < {b} THEN a * a ELSE 0 END), 5) + 0.0 AS band{i}" for i, (a, b) in enumerate(nm.BANDS))
    return f"""r AS (SELECT sequence_id, signal, f, {amplitude} AS a FROM a), top AS (SELECT sequence_id, signal, max(a) AS top FROM r GROUP BY 1, 2)
SELECT sequence_id, signal, round(min(f) FILTER (a = top), 6) AS peak_frequency, round(any_value(top), 6) + 0.0 AS peak, round(sum(a * a), 5) + 0.0 AS energy, {bands} FROM r JOIN top USING (sequence_id, signal) GROUP BY 1, 2"""


FFT_DIGITS = {"energy": 5} | {f"band{i}": 5 for i in range(4)}


@query("z07_fft_features", f"WITH {amplitudes_sql('greatest(1, n // 2)', 'samples3', 'acc_x acc_y acc_z')}, {fft_out('a')}", "samples3")
def z07(spark, d):
    return rounded(sp.fft_features(src.samples3(spark, d), ["acc_x", "acc_y", "acc_z"]), FFT_DIGITS)


@query("z08_fft_without_dc", f"WITH {amplitudes_sql('greatest(1, n // 2)')}, {fft_out('CASE WHEN f <= 0.5 THEN 0 ELSE a END')}", "samples")
def z08(spark, d):
    return rounded(sp.fft_features(src.samples(spark, d), ["acc_x"], dc_offset=0.5), FFT_DIGITS)


@query("z09_fft_integral", f"""WITH {PLACES},
c AS (SELECT *, unnest(range(1, n)) AS k FROM i),
s AS (SELECT sequence_id, k, any_value(n) AS n, sum(acc_x * cos(2 * pi() * i * k / n)) AS re, -sum(acc_x * sin(2 * pi() * i * k / n)) AS im FROM c GROUP BY 1, 2),
g AS (SELECT *, 2 * pi() * CASE WHEN 2 * k < n THEN k ELSE k - n END * 20.0::DOUBLE / n AS w FROM s),
j AS (SELECT sequence_id, i, sequence_counter, sum((im * cos(2 * pi() * i * k / g.n) + re * sin(2 * pi() * i * k / g.n)) / w) / any_value(g.n) AS y FROM i JOIN g USING (sequence_id) GROUP BY 1, 2, 3)
SELECT sequence_id, sequence_counter, round(coalesce(y, 0), 6) + 0.0 AS acc_x_integral FROM i LEFT JOIN j USING (sequence_id, sequence_counter)""", "samples")
def z09(spark, d):
    return rounded(sp.integrated(src.samples(spark, d), "acc_x").select("sequence_id", "sequence_counter", "acc_x_integral"), {})


TAPS = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(map(float, nm.low_pass(2))))


@query("z13_polyphase_resample", f"""WITH {PLACES}, taps(j, tap) AS (VALUES {TAPS}),
low AS (SELECT a.sequence_id, a.i, sum(b.acc_x * tap) / sum(tap) AS y FROM i a JOIN i b ON a.sequence_id = b.sequence_id AND a.i % 2 = 0 AND abs(a.i - b.i) <= 20 JOIN taps ON j = a.i - b.i + 20 GROUP BY 1, 2)
SELECT i.sequence_id, sequence_counter, phase, round(CASE WHEN i.i % 2 = 0 THEN c.y ELSE (p.y + coalesce(f.y, p.y)) / 2 END, 6) + 0.0 AS acc_x FROM i
LEFT JOIN low c ON c.sequence_id = i.sequence_id AND c.i = i.i LEFT JOIN low p ON p.sequence_id = i.sequence_id AND p.i = i.i - 1 LEFT JOIN low f ON f.sequence_id = i.sequence_id AND f.i = i.i + 1""", "samples")
def z13(spark, d):
    return rounded(sp.resampled(src.samples(spark, d), ["acc_x"], 20, 10).select("sequence_id", "sequence_counter", "phase", "acc_x"), {})


@query("z14_slerp_resample")
def z14(spark, d):
    return sp.resampled(units(spark, d), [], 20, 10, ["rot_w", "rot_x", "rot_y", "rot_z"])


@query("z15_rows_preserved", """SELECT sequence_id, count(*) AS n, CAST(sum(sequence_counter) AS BIGINT) AS counters, count(*) FILTER (acc_x < 20) AS marked, true AS changed FROM samples GROUP BY 1""", "samples")
def z15(spark, d):
    """Rows, counters and marks (-1) stay where they are; other values change."""
    marked = src.samples(spark, d).withColumns({"was": F.when(F.col("acc_x") < 20, -1.0).otherwise(F.col("acc_x")), "acc_x": F.when(F.col("acc_x") < 20, -1.0).otherwise(F.col("acc_x"))})
    after = sp.resampled(marked, ["acc_x"], 20, 10)
    kept, moved = (F.col("was") == -1) & (F.col("acc_x") == -1), F.abs(F.col("acc_x") - F.col("was")) > 1e-9
    changed = F.coalesce(F.max(moved), F.lit(False)) | (F.count("*") < 4)
    return after.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("sequence_counter").alias("counters"), F.count_if(kept).alias("marked"), changed.alias("changed"))


@query("z10_peak_bands")
def z10(spark, d):
    return sp.peak_bands(src.samples(spark, d), ["acc_x"])


FIVE = ", ".join(f"round(sum(CASE WHEN f >= {2 * i} AND f {'<' if i < 4 else '<='} {2 * i + 2} THEN a * a ELSE 0 END), 2) + 0.0 AS fft_band_{i + 1}_energy" for i in range(5))


@query("z11_signal_summary", f"""WITH {amplitudes_sql('n // 2 + 1')}, top AS (SELECT sequence_id, max(a) AS top FROM a GROUP BY 1),
t AS (SELECT sequence_id, avg(acc_x) AS mean, stddev_pop(acc_x) AS std, min(acc_x) AS min, max(acc_x) AS max, median(acc_x) AS median, sum(acc_x * acc_x) AS energy, sqrt(avg(acc_x * acc_x)) AS rms FROM samples GROUP BY 1),
s AS (SELECT sequence_id, min(f) FILTER (a = top) AS peak, any_value(top) AS top, sum(a * a) AS total, avg(a) AS mean_a, stddev_pop(a) AS std_a, {FIVE} FROM a JOIN top USING (sequence_id) GROUP BY 1)
SELECT sequence_id, 'acc_x' AS signal, round(mean, 9) + 0.0 AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(median, 6) AS median, round(max - min, 6) AS "range", round(energy, 2) AS energy, round(rms, 6) AS rms,
  round(peak, 6) AS fft_peak_frequency, round(top, 4) AS fft_peak_magnitude, round(total, 2) AS fft_total_energy, round(mean_a, 4) AS fft_mean, round(std_a, 4) AS fft_std, {', '.join(f'fft_band_{i + 1}_energy' for i in range(5))} FROM t JOIN s USING (sequence_id)""", "samples")
def z11(spark, d):
    two = dict.fromkeys(["energy", "fft_total_energy", *(f"fft_band_{i + 1}_energy" for i in range(5))], 2)
    return rounded(sp.signal_summary(src.samples(spark, d), ["acc_x"]), two | {"mean": 9} | dict.fromkeys(["fft_peak_magnitude", "fft_mean", "fft_std"], 4))

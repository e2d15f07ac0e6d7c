"""SensorPipeline: filter, clean, derive and summarise sequences as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import grids as gr
from seqloom.functions import numeric as nm
from seqloom.functions import rotation as rot
from seqloom.functions.branches import first_sensors, modes
from seqloom.operators import chunking, scans, spectral, stats
from seqloom.operators import windows as w
from seqloom.operators.sequences import along

ACC = {"raw", "smoothed", "velocity", "displacement", "jerk", "dead_reckoning"}
ROTATION = {"quaternion", "euler", "delta_euler", "angular_velocity", "rot6d"}
DEPTH = {"stats", "pooled_stats", "pool_2x2", "regions", "zones", "centre", "edges", "motion", "difference", "fft", "haar", "singular_values", "blob"}
#: Depth features that NumPy computes, from filled grids.
FRAME_WISE = {"singular_values": (nm.singular_values, ("sv1", "sv2", "sv3", "sv_ratio", "rank2_energy")), "blob": (nm.near_blob, ("blob_area", "blob_row", "blob_column"))}
THERMO = {"raw", "centered", "diff", "centered_diff", "diff_per_second", "mean"}


@dataclass
class SensorPipeline:
    """Order of the steps: problematic sequences go, gaps are filled, resampling, dt, clip, gravity, motion filter,
    features of motion, rotation, depth and temperature, context, spectra.

    Every native step is a projection over the same window, so they share one shuffle on sequence_id. A step that hands
    whole sequences to NumPy (resample, motion_filter, spectra) takes that partitioning as it is and costs one shuffle
    after it. skew_limit reads the table a second time for the sequences to drop. Names are known before anything runs.

    grids: array columns of 64 pixels; thermo: temperature columns. resample: (native, target) rates of accelerations and
    orientations. stft and cwt: settings of spectral.with_spectra. linear_acceleration: world or body; without
    orientation columns the high-pass approximation stands in."""

    acc: list[str] = field(default_factory=lambda: ["acc_x", "acc_y", "acc_z"])
    acc_modes: str = "raw|velocity|displacement|jerk"
    rotation_modes: str = ""
    magnitude: bool = True
    rate: float = 20.0
    interpolation: str = "linear"
    clip: float | None = None
    linear_acceleration: str | None = None
    gravity_units: bool = False
    motion_filter: bool = False
    smooth_window: int = 7
    skew_limit: float | None = None
    skew_many: int = 6
    dead_reckoning_detrend: bool = True
    grids: list[str] = field(default_factory=list)
    depth_modes: str = "stats"
    depth_fill: str = "far_255"
    most_depth_sensors: int | None = None
    thermo: list[str] = field(default_factory=list)
    thermo_modes: str = "raw"
    most_thermo_sensors: int | None = None
    resample: tuple[int, int] | None = None
    global_context: bool = False
    stft: dict | None = None
    cwt: dict | None = None
    crop: int | None = 160
    crop_mode: str = "tail"
    frame_stats: tuple[str, ...] = stats.FRAME

    def __post_init__(self):
        self._acc, self._rot = modes(self.acc_modes, ACC), modes(self.rotation_modes, ROTATION)
        self._depth, self._thermo = modes(self.depth_modes, DEPTH), modes(self.thermo_modes, THERMO)
        self._grids, self._thm = first_sensors(self.grids, self.most_depth_sensors), first_sensors(self.thermo, self.most_thermo_sensors)
        if self.interpolation not in ("linear", "ffill"):
            raise ValueError(f"unknown interpolation {self.interpolation!r}")
        if self.linear_acceleration not in (None, "world", "body"):
            raise ValueError(f"unknown frame {self.linear_acceleration!r}")

    def _turns(self, df: DataFrame) -> list[str]:
        names = [f"rot_{c}" for c in "wxyz"]
        return names if set(names) <= set(df.columns) and (self._rot or self.linear_acceleration) else []

    def clean(self, df: DataFrame) -> DataFrame:
        turns = self._turns(df)
        names = [*self.acc, *turns, *self._thm]
        if self.skew_limit is not None:
            df = stats.drop_problematic(df, [*self.acc, *turns], self.skew_limit, self.skew_many)
        df = w.interpolated(df, names) if self.interpolation == "linear" else df.withColumns({n: w.filled(n) for n in names})
        if self.resample:
            df = spectral.resampled(df, self.acc, *self.resample, turns or None)
        df = w.with_dt(df, self.rate)
        if self.clip is not None:
            df = df.withColumns({n: F.least(F.greatest(n, F.lit(-self.clip)), F.lit(self.clip)) for n in self.acc})
        if self.linear_acceleration:
            if turns:
                unit = rot.GRAVITY if self.gravity_units else 1.0
                lin = rot.linear_acceleration(tuple(F.col(n) * unit for n in self.acc), rot.normalised(rot.columns()), self.linear_acceleration)
            else:
                lin = [w.highpass(F.col(n)) for n in self.acc]
            df = df.withColumns({f"lin_{n}": c for n, c in zip(self.acc, lin)})
        if self.motion_filter:
            df = scans.smoothed(df, {n: n for n in self.acc})
        return df

    def features(self, df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
        """Features per time step, their names, and the names of those that are one value a sequence."""
        turns = self._turns(df)
        df, names = self.clean(df), []
        moving = [m for m in ("velocity", "displacement", "jerk") if m in self._acc]
        if moving:
            df = w.with_motion(df, self.acc)
        names += self.acc if "raw" in self._acc else []
        names += [f"{n}_{m}" for m in moving for n in self.acc]
        if "dead_reckoning" in self._acc:
            df = w.dead_reckoned(df, self.acc, self.dead_reckoning_detrend)
            names += [f"{n}_dr_{k}" for k in ("vel", "pos") for n in self.acc]
        if "smoothed" in self._acc:
            df = df.withColumns({f"{n}_smooth": w.rolling_mean(F.col(n), self.smooth_window) for n in self.acc})
            names += [f"{n}_smooth" for n in self.acc]
        if self.magnitude:
            df, names = df.withColumn("acc_mag", w.magnitude(*self.acc)), [*names, "acc_mag"]
        if self.linear_acceleration:
            names += [f"lin_{n}" for n in self.acc]
        if self._rot and turns:
            df, more = self._rotations(df)
            names += more
        for g in self._grids:
            df, more = self._depths(df, g)
            names += more
        df, more = self._all_depths(df)
        names += more
        df, more = self._temperatures(df)
        names += more
        if self.global_context:
            context = [*self.acc, *(["acc_mag"] if self.magnitude else [])]
            df = w.with_global_context(df, context)
            names += [f"{n}_sequence_{k}" for k in ("mean", "std") for n in context]
        df, still = stats.finite(df, names).select(w.SEQ, w.AT, *dict.fromkeys([*names, *(self.acc if self.stft is not None or self.cwt is not None else [])])), []
        if self.stft is not None or self.cwt is not None:
            df, still = spectral.with_spectra(df, self.acc, self.rate, self.stft, self.cwt)
        return df.select(w.SEQ, w.AT, *names, *still), names, still

    def _rotations(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        unit, names = dict(zip((f"rot_{c}" for c in "wxyz"), rot.normalised(rot.columns()))), []
        df = rot.with_steady_signs(df.withColumns(unit))
        q, angles = rot.columns(), ["rot_roll", "rot_pitch", "rot_yaw"]
        if "quaternion" in self._rot:
            names += list(unit)
        if {"euler", "delta_euler"} & set(self._rot):
            df = df.withColumns(dict(zip(angles, rot.euler(q))))
        if "euler" in self._rot:
            names += angles
        if "delta_euler" in self._rot:
            df = df.withColumns({f"{n}_delta": w.wrapped_step(F.col(n)) for n in angles})
            names += [f"{n}_delta" for n in angles]
        if "rot6d" in self._rot:
            six = [f"rot6d_c{i}_{c}" for i in (1, 2) for c in "xyz"]
            df, names = df.withColumns(dict(zip(six, rot.six(q)))), names + six
        if "angular_velocity" in self._rot:
            df = rot.with_angular_velocity(df)
            names += [f"rot_angular_velocity_{c}" for c in ("x", "y", "z", "magnitude")]
        return df, names

    def _depths(self, df: DataFrame, grid: str) -> tuple[DataFrame, list[str]]:
        """Numbers about an 8 x 8 grid; pixels without return are filled where a number needs them."""
        df = df.withColumn("_full", gr.imputed(F.col(grid), self.depth_fill))  # arrays are columns first: no expression stands twice
        full, new = F.col("_full"), {}
        df = df.withColumns({"_pool_2x2": gr.pooled(full, gr.squares(2)), "_regions": gr.pooled(full, gr.nine_regions())})
        several = lambda kind, values, n: {f"{grid}_{kind}_{i}": F.coalesce(F.col(values)[i], F.lit(0.0)) for i in range(n)}
        if "stats" in self._depth:
            new |= {f"{grid}_{k}": c for k, c in gr.sensor_stats(F.col(grid), self.depth_fill).items()}
        if "pool_2x2" in self._depth:
            new |= several("pool", "_pool_2x2", 16)
        if "regions" in self._depth:
            new |= several("region", "_regions", 9)
        if "zones" in self._depth:
            new |= {f"{grid}_{k}": gr.mean(gr.pick(full, p)) for k, p in gr.halves().items()}
        if "centre" in self._depth:
            new |= dict(zip((f"{grid}_centre_row", f"{grid}_centre_column"), gr.centre_of_mass(gr.valid(F.col(grid)))))
        if "edges" in self._depth:
            new |= {f"{grid}_edge_mean": gr.mean(gr.sobel(full))}
        if "fft" in self._depth:
            new |= dict(zip((f"{grid}_fft_low", f"{grid}_fft_high"), gr.fft_energy(full)))
        if "haar" in self._depth:
            new |= {f"{grid}_haar_{k}": c for k, c in gr.haar(full).items()}
        names = list(new)
        df = df.withColumns(new)
        if "difference" in self._depth:
            df = df.withColumn("_difference", gr.difference(F.col(grid), F.lag(grid).over(w.ordered())))
            pixels = {f"{grid}_difference_{i}": F.coalesce(F.col("_difference")[i], F.lit(0.0)) for i in range(64)}
            df, names = df.withColumns(pixels).drop("_difference"), [*names, *pixels]
        if "motion" in self._depth:
            before = F.lag(full).over(w.ordered())
            moved = F.zip_with(full, before, lambda a, b: F.abs(a - b))
            df, names = df.withColumn(f"{grid}_motion", F.coalesce(gr.mean(moved), F.lit(0.0))), [*names, f"{grid}_motion"]
        return df.drop("_full", "_pool_2x2", "_regions"), names

    def _all_depths(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """Numbers about the pixels of all sensors together, and those that NumPy computes frame by frame."""
        new = {}
        if self._grids and "pooled_stats" in self._depth:
            together = F.concat(*(F.coalesce(F.col(g), F.array_repeat(F.lit(gr.NO_RETURN), 64)) for g in self._grids))
            df = df.withColumn("_together", together)
            new = {f"tof_pooled_{k}": c for k, c in gr.sensor_stats(F.col("_together"), self.depth_fill).items()}
            df = df.withColumns(new).drop("_together")
        kinds = [k for k in FRAME_WISE if k in self._depth]
        added = [f"{g}_{n}" for g in self._grids for k in kinds for n in FRAME_WISE[k][1]]
        if added:
            df = df.withColumns({f"_full_{g}": gr.imputed(F.col(g), self.depth_fill) for g in self._grids})

            def make(frame, at):
                out = {n: np.zeros(len(frame)) for n in added}
                for g in self._grids:
                    for i, full in enumerate(frame[f"_full_{g}"]):
                        if full is not None:
                            for k in kinds:
                                for n, v in zip(FRAME_WISE[k][1], FRAME_WISE[k][0](np.array(full, float).reshape(8, 8))):
                                    out[f"{g}_{n}"][i] = v
                return out

            df = along(df, make, added).drop(*(f"_full_{g}" for g in self._grids))
        return df, [*new, *added]

    def _temperatures(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        new: dict = {}
        for n in self._thm:
            own, centred = F.col(n), w.centred(n)
            known = {
                "raw": {"raw": own}, "centered": {"centered": centred}, "diff": {"diff": w.step(own)}, "centered_diff": {"centered": centred, "centered_diff": w.step(own)},
                "diff_per_second": {"temperature_rate_per_s": w.step(own) / F.col("dt")}, "mean": {},
            }
            new |= {f"{n}_{k}": c for m in self._thermo for k, c in known[m].items()}
        if self._thm and "mean" in self._thermo:
            new["thm_mean"] = sum((F.col(n) for n in self._thm[1:]), F.col(self._thm[0])) / len(self._thm)
        return df.withColumns(new), list(new)

    def frame(self, df: DataFrame) -> DataFrame:
        """One row per sequence with <feature>_<stat>, and the features that are one value a sequence as they are."""
        steps, names, still = self.features(df)
        steps = w.cropped(steps, self.crop, self.crop_mode) if self.crop else steps
        return steps.groupBy(w.SEQ).agg(*(stats.stat(s, n).alias(f"{n}_{s}") for s in self.frame_stats for n in names), *(F.first(n).alias(n) for n in still))

    def chunks(self, df: DataFrame, window: int = 128, stride: int = 64, final: str = "pad", most: int | None = None) -> DataFrame:
        """Padded and masked windows of the features."""
        steps, names, still = self.features(df)
        steps = w.cropped(steps, self.crop, self.crop_mode) if self.crop else steps
        return chunking.padded_chunks(steps, names + still, window, chunking.stride_of(window, stride), final, most=most)

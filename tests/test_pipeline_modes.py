"""Pipeline modes that sequences must be refused for, or that add columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import grids as gr
from seqloom.functions import rotation as rot
from seqloom.operators import windows as w
from seqloom.plans.pipeline import SensorPipeline


def samples(spark, counters):
    return spark.createDataFrame([("a", c, float(c % 5)) for c in counters] + [("b", c, 1.0) for c in range(7, 12)], "sequence_id string, sequence_counter long, acc_x double")


@pytest.mark.parametrize("kind", ["stft", "cwt"])
def test_spectra_refuse_counters_with_gaps(spark, kind):
    settings = {kind: {} if kind == "stft" else {"n_scales": 4, "max_scale": 8.0}}
    p = SensorPipeline(acc=["acc_x"], acc_modes="raw", magnitude=False, crop=None, **settings)
    assert p.frame(samples(spark, range(12))).count() == 2
    for counters in ([0, 1, 3, 4, 9, 10], [0, 1, 2, 2]):
        with pytest.raises(Exception, match="uniform"):
            p.frame(samples(spark, counters)).collect()


@pytest.mark.parametrize("detrend", [True, False])
def test_dead_reckoning(spark, detrend):
    acc = np.random.default_rng(0).normal(size=9)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(acc)] + [("one", 4, 3.0)], "sequence_id string, sequence_counter long, acc_x double")
    p = SensorPipeline(acc=["acc_x"], acc_modes="dead_reckoning", magnitude=False, crop=None, rate=10.0, dead_reckoning_detrend=detrend)
    steps, names, _ = p.features(df)
    assert names == ["acc_x_dr_vel", "acc_x_dr_pos"]
    line = lambda y: y - np.linspace(y[0], y[-1], len(y)) if detrend else y
    dt = np.r_[0.0, np.full(8, 0.1)]
    vel = line(np.cumsum(acc * dt))
    pos = line(np.cumsum(vel * dt))
    rows = steps.orderBy("sequence_id", "sequence_counter").collect()
    assert [r.acc_x_dr_vel for r in rows] == pytest.approx([*vel, 0.0]) and [r.acc_x_dr_pos for r in rows] == pytest.approx([*pos, 0.0])


def test_depth_modes(spark):
    a, b = [float(i) for i in range(64)], [-1.0] * 32 + [50.0] * 32
    rows = [("a", 0, 0.0, a, b), ("a", 1, 0.0, b, None), ("a", 2, 0.0, a, a)]
    df = spark.createDataFrame(rows, "sequence_id string, sequence_counter long, acc_x double, left array<double>, right array<double>")
    modes = "pooled_stats|difference|fft|haar|singular_values|blob"
    steps, names, _ = SensorPipeline(acc=["acc_x"], acc_modes="raw", magnitude=False, grids=["left", "right"], depth_modes=modes, crop=None).features(df)
    assert {"tof_pooled_valid_mean", "left_difference_63", "right_fft_high", "left_haar_diagonal", "right_sv1", "left_blob_area"} <= set(names)
    got = steps.orderBy("sequence_counter").collect()
    assert got[0].tof_pooled_valid_mean == pytest.approx((sum(a) + 32 * 50) / 96) and got[1].tof_pooled_valid_fraction == 0.25
    assert [r.left_difference_40 for r in got] == [0.0, 10.0, -10.0] and [r.left_difference_3 for r in got] == [0.0] * 3
    assert got[2].left_sv1 == pytest.approx(np.linalg.svd(np.arange(64.0).reshape(8, 8))[1][0]) and got[1].right_sv1 == 0.0


def test_difference_and_upside_down(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, 3.0], [4.0, 2.0, -1.0])], "k int, now array<double>, before array<double>")
    assert df.select(gr.difference(F.col("now"), F.col("before")).alias("d")).first().d == [-3.0, 0.0, 0.0]
    assert df.select(gr.difference(F.col("now"), F.lit(None).cast("array<double>")).alias("d")).first().d == [0.0] * 3
    df = spark.createDataFrame([("x", 1.0, 2.0, 3.0, 4.0), (None, 1.0, 2.0, 3.0, 4.0)], "subject string, acc_x double, rot_w double, rot_x double, ang double")
    got = rot.upside_down(df, F.col("subject") == "x", ["acc_x", "acc_y"], ["ang"]).collect()
    assert [tuple(r)[1:] for r in got] == [(-1.0, 2.0, -3.0, -4.0), (1.0, 2.0, 3.0, 4.0)]


def test_unknown_modes_are_errors():
    for name in ("acc_modes", "depth_modes", "thermo_modes", "rotation_modes"):
        with pytest.raises(ValueError):
            SensorPipeline(**{name: "no_such_mode"})

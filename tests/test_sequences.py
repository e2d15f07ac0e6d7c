import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.functions import grids as gr
from seqloom.functions import rotation as rot
from seqloom.operators import chunking as ch
from seqloom.operators import scans
from seqloom.operators import stats as st
from seqloom.operators import windows as w

KEYS = "sequence_id string, sequence_counter long"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("sequence_id", "sequence_counter").collect()]


def test_dt_and_jerk_on_uneven_counters(spark):
    df = rows(spark, [("a", c, x) for c, x in ((10, 0.0), (11, 2.0), (13, 6.0), (16, 12.0))], f"{KEYS}, acc_x double")
    out = values(w.with_motion(w.with_dt(df), ["acc_x"]), "dt", "acc_x_jerk", "acc_x_velocity")
    assert [round(o[0], 9) for o in out] == [0.05, 0.05, 0.1, 0.15]
    assert [round(o[1], 9) for o in out] == [0, 40, 40, 40]
    assert out[0][2] == 0


def test_filling_stays_in_the_sequence(spark):
    df = rows(spark, [("a", 0, 1.0), ("a", 1, None), ("b", 0, None), ("b", 1, 9.0), ("c", 0, None)], f"{KEYS}, x double")
    assert [v for (v,) in values(df.withColumn("y", w.filled("x")), "y")] == [1, 1, 9, 9, None]
    assert [v for (v,) in values(w.interpolated(df, ["x"]), "x")] == [1, 1, 9, 9, None]


def test_lines_through_gaps(spark):
    df = rows(spark, [("a", i, x) for i, x in enumerate((None, 1.0, None, None, 4.0, None))], f"{KEYS}, x double")
    assert [v for (v,) in values(w.interpolated(df, ["x"]), "x")] == [1, 1, 2, 3, 4, 4]


def test_repeated_counters_fail(spark):
    df = rows(spark, [("a", 0, 1.0), ("a", 0, 2.0)], f"{KEYS}, x double")
    assert w.counter_violations(df).count() == 2
    with pytest.raises(Exception, match="strictly increasing"):
        w.assert_counters(df).collect()


def test_gaps_are_reported(spark):
    df = rows(spark, [("a", c, 0.0) for c in (0, 1, 3, 4)], f"{KEYS}, x double")
    assert [r.sequence_counter for r in w.grid_violations(df).collect()] == [3]


@pytest.mark.parametrize("frame", ["world", "body"])
def test_gravity_goes(spark, frame):
    h = math.sqrt(0.5)
    df = rows(spark, [("a", 0, h, h, 0.0, 0.0, 0.0, 9.80665, 0.0)], f"{KEYS}, rot_w double, rot_x double, rot_y double, rot_z double, acc_x double, acc_y double, acc_z double")
    lin = rot.linear_acceleration(tuple(F.col(f"acc_{c}") for c in "xyz"), rot.columns(), frame)
    assert all(abs(v) < 1e-9 for v in df.select(*lin).first())


def test_spin_with_alternating_signs(spark):
    data = []
    for i in range(21):
        a, s = 1.2 * i / 20 / 2, 1 if i % 2 == 0 else -1
        data.append(("a", i, s * math.cos(a), 0.0, 0.0, s * math.sin(a)))
    df = w.with_dt(rows(spark, data, f"{KEYS}, rot_w double, rot_x double, rot_y double, rot_z double"))
    out = values(rot.with_angular_velocity(rot.with_steady_signs(df)), "rot_angular_velocity_z")
    assert out[0][0] == 0 and all(abs(v - 1.2) < 1e-9 for (v,) in out[1:])


def test_zero_quaternions_fail_or_become_identity(spark):
    df = rows(spark, [("a", 0, 0.0, 0.0, 0.0, 0.0)], f"{KEYS}, rot_w double, rot_x double, rot_y double, rot_z double")
    assert tuple(df.select(*rot.normalised(rot.columns(), strict=False)).first()) == (1, 0, 0, 0)
    with pytest.raises(Exception, match="non-zero"):
        df.select(*rot.normalised(rot.columns())).collect()


def test_two_pixels(spark):
    df = rows(spark, [([10.0, -1.0],)], "g array<double>")
    s = gr.sensor_stats(F.col("g"), "far_500")
    assert tuple(df.select(s["imputed_mean"], s["valid_mean"], s["valid_fraction"]).first()) == (255, 10, 0.5)


def test_pooled_ramp(spark):
    df = rows(spark, [([-1.0, *map(float, range(1, 64))],)], "g array<double>")
    pool = gr.pooled(gr.imputed(F.col("g"), "far_500"), gr.squares(2))
    share = gr.pooled(F.transform(gr.validity(F.col("g")), lambda v: v.cast("double")), gr.squares(2))
    assert tuple(df.select(pool[0], share[0]).first()) == (129.5, 0.75)
    with pytest.raises(ValueError):
        gr.imputed(F.col("g"), "near")


def ramp(spark, n, name="a"):
    return spark.range(n).select(F.lit(name).alias("sequence_id"), F.col("id").alias("sequence_counter"), F.col("id").cast("double").alias("x"))


@pytest.mark.parametrize("n,window,stride,final,expected", [
    (250, 100, 100, "pad", [0, 100, 200]), (250, 100, 100, "overlap", [0, 100, 150]), (80, 100, 100, "pad", [0]), (100, 100, 50, "overlap", [0]), (150, 100, 50, "pad", [0, 50, 100]),
])
def test_starts(spark, n, window, stride, final, expected):
    assert [r.start for r in ch.chunk_starts(ramp(spark, n), window, stride, final).orderBy("start").collect()] == expected


@pytest.mark.parametrize("policy,expected", [("last", [340, 360, 380, 400]), ("uniform", [0, 140, 260, 400]), ("first", [0, 20, 40, 60])])
def test_caps(spark, policy, expected):
    out = ch.chunk_starts(ramp(spark, 500), 100, ch.stride_of(100, ratio=0.2), "overlap", 4, policy)
    assert [r.start for r in out.orderBy("start").collect()] == expected


def test_masks_and_padding(spark):
    c = ch.padded_chunks(ramp(spark, 80), ["x"], 100, 100).first()
    assert c.mask == [True] * 80 + [False] * 20 and c.features[79] == [79.0] and c.features[80] == [-999.0]
    r = ch.report(ramp(spark, 150).union(ramp(spark, 150, "b")), 100, 50, "pad", 2).first()
    assert tuple(r) == (4, 2, 3, 2)


@pytest.mark.parametrize("mode,first", [("head", 0), ("tail", 300), ("center", 150)])
def test_crops(spark, mode, first):
    assert w.cropped(ramp(spark, 500), 200, mode).agg(F.min("x"), F.count("*")).first() == (first, 200)


def test_order_and_partitions_do_not_matter(spark):
    df = spark.range(400).select((F.col("id") % 7).cast("string").alias("sequence_id"), (F.col("id") / 7).cast("long").alias("sequence_counter"), F.sin(F.col("id").cast("double")).alias("acc_x"))
    one = values(scans.kalman(df, "acc_x", "y"), "sequence_id", "sequence_counter", "y")
    two = values(scans.kalman(df.orderBy(F.desc("id") if "id" in df.columns else F.desc("acc_x")).repartition(3), "acc_x", "y"), "sequence_id", "sequence_counter", "y")
    assert one == two and len(one) == 400


def test_skewness_is_bias_corrected(spark):
    df = rows(spark, [("a", i, x) for i, x in enumerate((1.0, 2.0, 10.0))], f"{KEYS}, x double")
    want = pd.Series([1.0, 2.0, 10.0]).skew()
    assert abs(df.groupBy("sequence_id").agg(st.skewness("x").alias("s")).first().s - want) < 1e-9

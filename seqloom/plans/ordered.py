"""Queries of the ordered operators within a sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import rotation as rot
from seqloom.operators import chunking as ch
from seqloom.operators import scans
from seqloom.operators import stats as st
from seqloom.operators import windows as w
from seqloom.sources import adapters as src

from .registry import query

KEY = ("sequence_id", "sequence_counter")
#: The window of every ordered operator, in SQL.
WIN = "WINDOW w AS (PARTITION BY sequence_id ORDER BY sequence_counter)"
DT = "coalesce(sequence_counter - lag(sequence_counter) OVER w, 1) / CAST(20 AS DOUBLE)"


def r(x, digits: int = 6):
    """Rounded for comparison, without negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + 0.0


def out(df, **columns):
    return df.select(*KEY, *(r(c).alias(n) for n, c in columns.items()))


@query("s01_counter_violations", f"SELECT sequence_id, sequence_counter, acc_x FROM (SELECT *, count(*) OVER (PARTITION BY sequence_id, sequence_counter) AS n FROM (SELECT user_id AS sequence_id, CAST(floor(epoch(ts) / 7200) AS BIGINT) AS sequence_counter, value AS acc_x FROM events)) WHERE n > 1")
def s01(spark, d):
    e = src.table(spark, d, "events").select(F.col("user_id").alias("sequence_id"), F.floor(F.col("ts").cast("timestamp").cast("double") / 7200).alias("sequence_counter"), F.col("value").alias("acc_x"))
    return w.counter_violations(e)


@query("s02_grid_violations", f"SELECT sequence_id, sequence_counter, gap FROM (SELECT *, sequence_counter - lag(sequence_counter) OVER w AS gap FROM samples_gap {WIN}) WHERE gap <> 1", "samples_gap")
def s02(spark, d):
    return w.grid_violations(src.samples_gap(spark, d)).select(*KEY, "gap")


@query("s03_dt", f"SELECT sequence_id, sequence_counter, round({DT}, 6) AS dt FROM samples_gap {WIN}", "samples_gap")
def s03(spark, d):
    return out(w.with_dt(src.samples_gap(spark, d)), dt="dt")


@query("s04_ffill_bfill", "SELECT sequence_id, sequence_counter, round(coalesce(last_value(acc_x IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY sequence_counter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(acc_x IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY sequence_counter ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS filled FROM samples_gap", "samples_gap")
def s04(spark, d):
    return out(src.samples_gap(spark, d).withColumn("filled", w.filled("acc_x")), filled="filled")


@query("s05_interp_linear", """WITH i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY sequence_counter) AS i FROM samples_gap),
b AS (SELECT *, last_value(acc_x IGNORE NULLS) OVER p AS a, last_value(CASE WHEN acc_x IS NOT NULL THEN i END IGNORE NULLS) OVER p AS ia, first_value(acc_x IGNORE NULLS) OVER n AS b, first_value(CASE WHEN acc_x IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ib FROM i
WINDOW p AS (PARTITION BY sequence_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY sequence_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT sequence_id, sequence_counter, round(CASE WHEN acc_x IS NOT NULL THEN acc_x ELSE coalesce(a + (b - a) * (i - ia) / (ib - ia), a, b) END, 6) AS acc_x FROM b""", "samples_gap")
def s05(spark, d):
    return out(w.interpolated(src.samples_gap(spark, d), ["acc_x"]), acc_x="acc_x")


@query("s06_rolling_mean", "SELECT sequence_id, sequence_counter, round(avg(acc_x) OVER (PARTITION BY sequence_id ORDER BY sequence_counter ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM samples", "samples")
def s06(spark, d):
    return out(src.samples(spark, d), smooth=w.rolling_mean(F.col("acc_x"), 5))


@query("s07_ewm", """WITH e AS (SELECT sequence_id, sequence_counter, acc_x AS y FROM samples WHERE sequence_counter = 0
UNION ALL SELECT s.sequence_id, s.sequence_counter, 0.7::DOUBLE * e.y + 0.3::DOUBLE * s.acc_x FROM e JOIN samples s ON s.sequence_id = e.sequence_id AND s.sequence_counter = e.sequence_counter + 1)
SELECT sequence_id, sequence_counter, round(y, 6) AS ewm FROM e""", "samples")
def s07(spark, d):
    return out(scans.exponential_mean(src.samples(spark, d), "acc_x", 0.3, "ewm"), ewm="ewm")


@query("s08_highpass", "SELECT sequence_id, sequence_counter, round(acc_x - avg(acc_x) OVER (PARTITION BY sequence_id ORDER BY sequence_counter ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS highpass FROM samples", "samples")
def s08(spark, d):
    return out(src.samples(spark, d), highpass=w.highpass(F.col("acc_x"), 5))


UNIT = "unit AS (SELECT sequence_id, sequence_counter, rot_w / n AS w, rot_x / n AS x, rot_y / n AS y, rot_z / n AS z, acc_x AS ax, acc_y AS ay, acc_z AS az FROM (SELECT *, sqrt(rot_w * rot_w + rot_x * rot_x + rot_y * rot_y + rot_z * rot_z) AS n FROM quats))"


def units(spark, d):
    q = src.quats(spark, d)
    return q.select(*KEY, *(c.alias(n) for c, n in zip(rot.normalised(rot.columns()), ("rot_w", "rot_x", "rot_y", "rot_z"))), "acc_x", "acc_y", "acc_z")


@query("s09_linear_acceleration", f"""WITH {UNIT},
t AS (SELECT *, 2 * (y * az - z * ay) AS tx, 2 * (z * ax - x * az) AS ty, 2 * (x * ay - y * ax) AS tz FROM unit)
SELECT sequence_id, sequence_counter,
  round(ax + w * tx + y * tz - z * ty, 6) + 0.0 AS world_x, round(ay + w * ty + z * tx - x * tz, 6) + 0.0 AS world_y,
  round(az + w * tz + x * ty - y * tx - 9.80665::DOUBLE, 6) + 0.0 AS world_z,
  round(ax - 9.80665::DOUBLE * 2 * (x * z - w * y), 6) + 0.0 AS body_x, round(ay - 9.80665::DOUBLE * 2 * (y * z + w * x), 6) + 0.0 AS body_y,
  round(az - 9.80665::DOUBLE * (1 - 2 * (x * x + y * y)), 6) + 0.0 AS body_z FROM t""", "quats")
def s09(spark, d):
    q, acc = units(spark, d), tuple(F.col(f"acc_{c}") for c in "xyz")
    both = {f: rot.linear_acceleration(acc, rot.columns(), f) for f in ("world", "body")}
    return out(q, **{f"{f}_{c}": x for f, xs in both.items() for c, x in zip("xyz", xs)})


MOTION = f"m AS (SELECT *, {DT} AS dt FROM samples {WIN}), v AS (SELECT *, sum(acc_x * dt) OVER w - first_value(acc_x * dt) OVER w AS vel, coalesce(acc_x - lag(acc_x) OVER w, 0) / dt AS jerk FROM m {WIN})"


@query("s10_velocity", f"WITH {MOTION} SELECT sequence_id, sequence_counter, round(vel, 5) + 0.0 AS velocity FROM v", "samples")
def s10(spark, d):
    df = w.with_motion(w.with_dt(src.samples(spark, d)), ["acc_x"])
    return df.select(*KEY, r("acc_x_velocity", 5).alias("velocity"))


@query("s11_displacement", f"WITH {MOTION} SELECT sequence_id, sequence_counter, round(sum(vel * dt) OVER w - first_value(vel * dt) OVER w, 7) + 0.0 AS displacement FROM v {WIN}", "samples")
def s11(spark, d):
    df = w.with_motion(w.with_dt(src.samples(spark, d)), ["acc_x"])
    return df.select(*KEY, r("acc_x_displacement", 7).alias("displacement"))


@query("s12_jerk", f"WITH {MOTION} SELECT sequence_id, sequence_counter, round(jerk, 6) + 0.0 AS jerk FROM v", "samples")
def s12(spark, d):
    return out(w.with_motion(w.with_dt(src.samples(spark, d)), ["acc_x"]), jerk="acc_x_jerk")


@query("s13_linear_axis_motion", f"""WITH m AS (SELECT *, {DT} AS dt FROM samples3 {WIN})
SELECT sequence_id, sequence_counter, round(sum(acc_x * dt) OVER w - first_value(acc_x * dt) OVER w, 5) + 0.0 AS vx, round(sum(acc_y * dt) OVER w - first_value(acc_y * dt) OVER w, 6) + 0.0 AS vy, round(coalesce(acc_z - lag(acc_z) OVER w, 0) / dt, 6) + 0.0 AS jz FROM m {WIN}""", "samples3")
def s13(spark, d):
    df = w.with_motion(w.with_dt(src.samples3(spark, d)), ["acc_x", "acc_y", "acc_z"])
    return df.select(*KEY, r("acc_x_velocity", 5).alias("vx"), r("acc_y_velocity").alias("vy"), r("acc_z_jerk").alias("jz"))


@query("s14_magnitude", "SELECT sequence_id, sequence_counter, round(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z), 6) AS acc_mag FROM samples3", "samples3")
def s14(spark, d):
    return out(src.samples3(spark, d), acc_mag=w.magnitude("acc_x", "acc_y", "acc_z"))


@query("s15_kalman", """WITH k AS (SELECT sequence_id, sequence_counter, acc_x AS y, (1 - 1.001::DOUBLE / 1.011::DOUBLE) * 1.001::DOUBLE AS p FROM samples WHERE sequence_counter = 0
UNION ALL SELECT s.sequence_id, s.sequence_counter, k.y + (k.p + 0.001::DOUBLE) / (k.p + 0.001::DOUBLE + 0.01::DOUBLE) * (s.acc_x - k.y), (1 - (k.p + 0.001::DOUBLE) / (k.p + 0.001::DOUBLE + 0.01::DOUBLE)) * (k.p + 0.001::DOUBLE) FROM k JOIN samples s ON s.sequence_id = k.sequence_id AND s.sequence_counter = k.sequence_counter + 1)
SELECT sequence_id, sequence_counter, round(y, 6) AS kalman FROM k""", "samples")
def s15(spark, d):
    return out(scans.kalman(src.samples(spark, d), "acc_x", "kalman"), kalman="kalman")


SIGNS = f"f AS (SELECT *, CASE WHEN w * lag(w) OVER k + x * lag(x) OVER k + y * lag(y) OVER k + z * lag(z) OVER k < 0 THEN 1 ELSE 0 END AS f FROM unit WINDOW k AS (PARTITION BY sequence_id ORDER BY sequence_counter)), g AS (SELECT sequence_id, sequence_counter, CASE WHEN sum(f) OVER k % 2 = 1 THEN -1 ELSE 1 END AS s, w, x, y, z FROM f WINDOW k AS (PARTITION BY sequence_id ORDER BY sequence_counter)), h AS (SELECT sequence_id, sequence_counter, s * w AS w, s * x AS x, s * y AS y, s * z AS z FROM g)"
GAIN = "(k.p + 0.001::DOUBLE) / (k.p + 0.001::DOUBLE + 0.01::DOUBLE)"


@query("s16_quaternion_kalman", f"""WITH {UNIT}, {SIGNS},
k AS (SELECT sequence_id, sequence_counter, w, x, y, z, (1 - 1.001::DOUBLE / 1.011::DOUBLE) * 1.001::DOUBLE AS p FROM h WHERE sequence_counter = 0
UNION ALL SELECT h.sequence_id, h.sequence_counter, {', '.join(f'k.{c} + {GAIN} * (h.{c} - k.{c})' for c in 'wxyz')}, (1 - {GAIN}) * (k.p + 0.001::DOUBLE)
  FROM k JOIN h ON h.sequence_id = k.sequence_id AND h.sequence_counter = k.sequence_counter + 1),
n AS (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM k)
SELECT sequence_id, sequence_counter, {', '.join(f'round({c} / n, 6) + 0.0 AS rot_{c}' for c in 'wxyz')} FROM n""", "quats")
def s16(spark, d):
    names = [f"rot_{c}" for c in "wxyz"]
    whole = scans.smoothed(rot.with_steady_signs(units(spark, d)).select(*KEY, *names), {n: n for n in names})
    return out(whole, **{f"rot_{c}": v for c, v in zip("wxyz", rot.normalised(rot.columns()))})


@query("s17_dead_reckoning", f"""WITH {MOTION}, e AS (SELECT *, first_value(vel) OVER a AS f, last_value(vel) OVER a AS l, count(*) OVER a AS n, row_number() OVER w - 1 AS i FROM v WINDOW w AS (PARTITION BY sequence_id ORDER BY sequence_counter), a AS (PARTITION BY sequence_id ORDER BY sequence_counter ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT sequence_id, sequence_counter, round(CASE WHEN n <= 1 THEN 0 ELSE vel - (f + (l - f) * i / (n - 1)) END, 10) + 0.0 AS reckoned FROM e""", "samples")
def s17(spark, d):
    df = w.with_motion(w.with_dt(src.samples(spark, d)), ["acc_x"])
    return df.select(*KEY, r(w.detrended("acc_x_velocity"), 10).alias("reckoned"))


#: Velocity v and position p of samples, each as its integral (raw) and without the line between its ends.
ENDS = "count(*) OVER a AS n, row_number() OVER w - 1 AS i FROM {t} WINDOW w AS (PARTITION BY sequence_id ORDER BY sequence_counter), a AS (PARTITION BY sequence_id ORDER BY sequence_counter ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
STRAIGHT = "CASE WHEN n <= 1 THEN 0 ELSE x - (f + (l - f) * i / (n - 1)) END"
RECKONED = f"""{MOTION},
v1 AS (SELECT sequence_id, sequence_counter, dt, vel AS x, first_value(vel) OVER a AS f, last_value(vel) OVER a AS l, {ENDS.format(t='v')}),
v2 AS (SELECT *, {STRAIGHT} AS v FROM v1),
p1 AS (SELECT *, sum(v * dt) OVER w - first_value(v * dt) OVER w AS p, sum(x * dt) OVER w - first_value(x * dt) OVER w AS raw FROM v2 {WIN}),
p2 AS (SELECT sequence_id, sequence_counter, v, raw, p AS x, first_value(p) OVER a AS f, last_value(p) OVER a AS l, {ENDS.format(t='p1')}),
d AS (SELECT sequence_id, sequence_counter, v, raw, {STRAIGHT} AS p FROM p2)"""


@query("s17_dead_reckoned_position", f"WITH {RECKONED} SELECT sequence_id, sequence_counter, round(v, 8) + 0.0 AS velocity, round(p, 8) + 0.0 AS position, round(raw, 6) + 0.0 AS drifting_position FROM d", "samples")
def s17_position(spark, d):
    df = w.with_dt(src.samples(spark, d))
    straight = w.dead_reckoned(df, ["acc_x"])
    drifting = w.dead_reckoned(straight.select(*KEY, "dt", "acc_x", F.col("acc_x_dr_vel").alias("v"), F.col("acc_x_dr_pos").alias("p")), ["acc_x"], detrend=False)
    return drifting.select(*KEY, r("v", 8).alias("velocity"), r("p", 8).alias("position"), r("acc_x_dr_pos").alias("drifting_position"))


@query("s18_detrend", """WITH e AS (SELECT *, first_value(acc_x) OVER a AS f, last_value(acc_x) OVER a AS l, count(*) OVER a AS n, row_number() OVER w - 1 AS i FROM samples WINDOW w AS (PARTITION BY sequence_id ORDER BY sequence_counter), a AS (PARTITION BY sequence_id ORDER BY sequence_counter ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT sequence_id, sequence_counter, round(CASE WHEN n <= 1 THEN 0 ELSE acc_x - (f + (l - f) * i / (n - 1)) END, 8) + 0.0 AS detrended FROM e""", "samples")
def s18(spark, d):
    return src.samples(spark, d).select(*KEY, r(w.detrended("acc_x"), 8).alias("detrended"))


@query("s19_trapezoid", f"""WITH m AS (SELECT *, {DT} AS dt FROM samples {WIN}), v AS (SELECT *, coalesce((acc_x + lag(acc_x) OVER w) / 2 * dt, 0) AS a FROM m {WIN}), s AS (SELECT *, sum(a) OVER w AS vel FROM v {WIN}), u AS (SELECT *, coalesce((vel + lag(vel) OVER w) / 2 * dt, 0) AS b FROM s {WIN})
SELECT sequence_id, sequence_counter, round(vel, 6) + 0.0 AS velocity, round(sum(b) OVER w, 8) + 0.0 AS displacement FROM u {WIN}""", "samples")
def s19(spark, d):
    df = w.with_trapezoids(w.with_dt(src.samples(spark, d)), "acc_x")
    return df.select(*KEY, r("acc_x_trapezoid_velocity", 6).alias("velocity"), r("acc_x_trapezoid_displacement", 8).alias("displacement"))


ANGLE = "a AS (SELECT sequence_id, sequence_counter, atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)) AS roll, asin(least(greatest(2 * (w * y - z * x), -1), 1)) AS pitch, atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)) AS yaw FROM unit)"


def angles(spark, d):
    q = units(spark, d)
    return q.select(*KEY, *(c.alias(n) for c, n in zip(rot.euler(rot.columns()), ("roll", "pitch", "yaw"))))


@query("s20_delta_wrapped", f"WITH {UNIT}, {ANGLE}, s AS (SELECT *, yaw - lag(yaw) OVER w AS s FROM a {WIN}) SELECT sequence_id, sequence_counter, round(coalesce(atan2(sin(s), cos(s)), 0), 6) + 0.0 AS yaw_delta FROM s", "quats")
def s20(spark, d):
    return out(angles(spark, d), yaw_delta=w.wrapped_step(F.col("yaw")))


@query("s21_unwrap", f"WITH {UNIT}, {ANGLE}, s AS (SELECT *, coalesce(-floor((yaw - lag(yaw) OVER w + pi()) / (2 * pi())), 0) AS k FROM a {WIN}) SELECT sequence_id, sequence_counter, round(yaw + sum(k) OVER w * 2 * pi(), 6) + 0.0 AS yaw FROM s {WIN}", "quats")
def s21(spark, d):
    return out(w.unwrapped(angles(spark, d), "yaw", "flat"), yaw="flat")




@query("s22_sign_continuity", f"WITH {UNIT}, {SIGNS} SELECT sequence_id, sequence_counter, round(w, 6) + 0.0 AS rot_w, round(x, 6) + 0.0 AS rot_x, round(y, 6) + 0.0 AS rot_y, round(z, 6) + 0.0 AS rot_z FROM h", "quats")
def s22(spark, d):
    return out(rot.with_steady_signs(units(spark, d)), **{f"rot_{c}": f"rot_{c}" for c in "wxyz"})


def velocity_sql(body: bool) -> str:
    b = "lag({}) OVER k"
    p = {c: b.format(c) for c in "wxyz"}
    if body:  # conj(before) * now
        terms = (f"{p['w']}*w + {p['x']}*x + {p['y']}*y + {p['z']}*z", f"{p['w']}*x - {p['x']}*w - {p['y']}*z + {p['z']}*y", f"{p['w']}*y + {p['x']}*z - {p['y']}*w - {p['z']}*x", f"{p['w']}*z - {p['x']}*y + {p['y']}*x - {p['z']}*w")
    else:  # now * conj(before)
        terms = (f"{p['w']}*w + {p['x']}*x + {p['y']}*y + {p['z']}*z", f"-w*{p['x']} + x*{p['w']} - y*{p['z']} + z*{p['y']}", f"-w*{p['y']} + x*{p['z']} + y*{p['w']} - z*{p['x']}", f"-w*{p['z']} - x*{p['y']} + y*{p['x']} + z*{p['w']}")
    return f"""WITH {UNIT}, {SIGNS}, q AS (SELECT sequence_id, sequence_counter, {terms[0]} AS a, {terms[1]} AS b, {terms[2]} AS c, {terms[3]} AS e FROM h WINDOW k AS (PARTITION BY sequence_id ORDER BY sequence_counter)),
n AS (SELECT *, CASE WHEN a < 0 THEN -1 ELSE 1 END AS s, sqrt(b * b + c * c + e * e) AS z FROM q),
o AS (SELECT sequence_id, sequence_counter, b * s * k AS b, c * s * k AS c, e * s * k AS e FROM (SELECT *, CASE WHEN z < 1e-12 THEN 2 ELSE 2 * atan2(z, a * s) / z END * 20 AS k FROM n))
SELECT sequence_id, sequence_counter, round(coalesce(b, 0), 5) + 0.0 AS x, round(coalesce(c, 0), 5) + 0.0 AS y, round(coalesce(e, 0), 5) + 0.0 AS z, round(coalesce(sqrt(b * b + c * c + e * e), 0), 5) + 0.0 AS magnitude FROM o"""


def spin(spark, d, frame):
    df = rot.with_angular_velocity(rot.with_steady_signs(w.with_dt(units(spark, d))), frame=frame)
    return df.select(*KEY, *(r(f"rot_angular_velocity_{c}", 5).alias(c) for c in ("x", "y", "z", "magnitude")))


@query("s23_angular_velocity_body", velocity_sql(True), "quats")
def s23(spark, d):
    return spin(spark, d, "body")


@query("s24_angular_velocity_world", velocity_sql(False), "quats")
def s24(spark, d):
    return spin(spark, d, "world")


@query("s25_thermo_diffs", f"SELECT sequence_id, sequence_counter, round(coalesce(thm_1 - lag(thm_1) OVER w, 0), 6) + 0.0 AS diff, round(coalesce(thm_1 - lag(thm_1) OVER w, 0) / ({DT}), 6) + 0.0 AS diff_per_second FROM thermo {WIN}", "thermo")
def s25(spark, d):
    df = w.with_dt(src.thermo(spark, d))
    return out(df, diff=w.step(F.col("thm_1")), diff_per_second=w.step(F.col("thm_1")) / F.col("dt"))


@query("s26_centred", "SELECT sequence_id, sequence_counter, round(thm_2 - avg(thm_2) OVER (PARTITION BY sequence_id), 6) + 0.0 AS centred FROM thermo", "thermo")
def s26(spark, d):
    return out(src.thermo(spark, d), centred=w.centred("thm_2"))


@query("s29_normalised_index", "SELECT sequence_id, sequence_counter, round(CAST(sequence_counter AS DOUBLE) / (SELECT max(n) FROM (SELECT count(*) AS n FROM samples GROUP BY sequence_id)), 6) AS idx FROM samples", "samples")
def s29(spark, d):
    s = src.samples(spark, d)
    most = s.groupBy("sequence_id").count().agg(F.max("count")).first()[0]
    return out(s, idx=w.position() / F.lit(most or 1))


@query("s30_standardise", "WITH t AS (SELECT avg(acc_x) AS m, stddev_pop(acc_x) AS s FROM samples) SELECT sequence_id, sequence_counter, round((acc_x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS z FROM samples, t", "samples")
def s30(spark, d):
    return out(st.standardised(src.samples(spark, d), ["acc_x"]), z="acc_x")


@query("s31_pre_fft", """WITH c AS (SELECT *, acc_x - avg(acc_x) OVER (PARTITION BY sequence_id) AS c, count(*) OVER (PARTITION BY sequence_id) AS n, row_number() OVER (PARTITION BY sequence_id ORDER BY sequence_counter) - 1 AS i FROM samples)
SELECT sequence_id, sequence_counter, round(avg(c) OVER (PARTITION BY sequence_id ORDER BY sequence_counter ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) * CASE WHEN n <= 1 THEN 1 ELSE 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / (n - 1)) END, 6) + 0.0 AS x FROM c""", "samples")
def s31(spark, d):
    return out(w.pre_transform(src.samples(spark, d), "acc_x", "y"), x="y")


@query("m01_normalise", f"WITH {UNIT} SELECT sequence_id, sequence_counter, round(w, 6) + 0.0 AS w, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM unit", "quats")
def m01(spark, d):
    return out(units(spark, d), **{c: f"rot_{c}" for c in "wxyz"})


@query("m02_euler", f"WITH {UNIT}, {ANGLE} SELECT sequence_id, sequence_counter, round(roll, 6) + 0.0 AS roll, round(pitch, 6) + 0.0 AS pitch, round(yaw, 6) + 0.0 AS yaw FROM a", "quats")
def m02(spark, d):
    return out(angles(spark, d), roll="roll", pitch="pitch", yaw="yaw")


@query("m03_rot6d", f"""WITH {UNIT} SELECT sequence_id, sequence_counter, round(1 - 2 * (y * y + z * z), 6) + 0.0 AS c1_x, round(2 * (x * y + w * z), 6) + 0.0 AS c1_y, round(2 * (x * z - w * y), 6) + 0.0 AS c1_z,
round(2 * (x * y - w * z), 6) + 0.0 AS c2_x, round(1 - 2 * (x * x + z * z), 6) + 0.0 AS c2_y, round(2 * (y * z + w * x), 6) + 0.0 AS c2_z FROM unit""", "quats")
def m03(spark, d):
    return out(units(spark, d), **dict(zip(("c1_x", "c1_y", "c1_z", "c2_x", "c2_y", "c2_z"), rot.six(rot.columns()))))


@query("m04_mirror_left_handed", f"""WITH {UNIT}, {ANGLE},
h AS (SELECT u.*, a.roll / 2 AS r, -a.pitch / 2 AS p, -a.yaw / 2 AS q, u.sequence_id % 2 = 0 AS l FROM unit u JOIN a USING (sequence_id, sequence_counter))
SELECT sequence_id, sequence_counter, round(CASE WHEN l THEN -ax ELSE ax END, 6) + 0.0 AS acc_x, round(ay, 6) + 0.0 AS acc_y, round(az, 6) + 0.0 AS acc_z,
  round(CASE WHEN l THEN cos(r) * cos(p) * cos(q) + sin(r) * sin(p) * sin(q) ELSE w END, 6) + 0.0 AS w,
  round(CASE WHEN l THEN sin(r) * cos(p) * cos(q) - cos(r) * sin(p) * sin(q) ELSE x END, 6) + 0.0 AS x,
  round(CASE WHEN l THEN cos(r) * sin(p) * cos(q) + sin(r) * cos(p) * sin(q) ELSE y END, 6) + 0.0 AS y,
  round(CASE WHEN l THEN cos(r) * cos(p) * sin(q) - sin(r) * sin(p) * cos(q) ELSE z END, 6) + 0.0 AS z FROM h""", "quats")
def m04(spark, d):
    acc, q = rot.mirrored(tuple(F.col(f"acc_{c}") for c in "xyz"), rot.columns(), F.col("sequence_id") % 2 == 0)
    return units(spark, d).select(*KEY, *(r(c).alias(f"acc_{n}") for n, c in zip("xyz", acc)), *(r(c).alias(n) for n, c in zip("wxyz", q)))


@query("m05_upside_down", "SELECT sequence_id, sequence_counter, CASE WHEN sequence_id IN (3, 5) THEN -rot_x ELSE rot_x END AS rot_x FROM (SELECT sequence_id, sequence_counter, round(rot_x, 6) + 0.0 AS rot_x FROM quats)", "quats")
def m05(spark, d):
    return src.quats(spark, d).select(*KEY, (F.when(F.col("sequence_id").isin(3, 5), -r("rot_x")).otherwise(r("rot_x"))).alias("rot_x"))


@query("m05_upside_down_sensors", "SELECT sequence_id, sequence_counter, " + ", ".join(f"round(CASE WHEN sequence_id % 3 = 0 THEN -{c} ELSE {c} END, 6) + 0.0 AS {c}" for c in ("rot_x", "rot_y", "rot_z", "acc_x", "acc_y", "acc_z")) + ", round(rot_w, 6) + 0.0 AS rot_w FROM quats", "quats")
def m05_all(spark, d):
    df = rot.upside_down(src.quats(spark, d), F.col("sequence_id") % 3 == 0, ["acc_x", "acc_y", "acc_z"], ["ang_vel_x"])
    return df.select(*KEY, *(r(c).alias(c) for c in ("rot_w", "rot_x", "rot_y", "rot_z", "acc_x", "acc_y", "acc_z")))


@query("m06_rotate_vector", f"""WITH {UNIT}, t AS (SELECT *, 2 * (y * 3 - z * 2) AS tx, 2 * (z * 1 - x * 3) AS ty, 2 * (x * 2 - y * 1) AS tz FROM unit)
SELECT sequence_id, sequence_counter, round(1 + w * tx + y * tz - z * ty, 6) + 0.0 AS x, round(2 + w * ty + z * tx - x * tz, 6) + 0.0 AS y, round(3 + w * tz + x * ty - y * tx, 6) + 0.0 AS z FROM t""", "quats")
def m06(spark, d):
    return out(units(spark, d), **dict(zip("xyz", rot.rotated(rot.columns(), (F.lit(1.0), F.lit(2.0), F.lit(3.0))))))


# ---- frame statistics and windows ----------------------------------------------------------------------------------


@query("flagship_motion_frame", f"WITH {MOTION} SELECT sequence_id, round(avg(jerk), 5) + 0.0 AS jerk_mean, round(stddev_pop(jerk), 5) AS jerk_std, round(min(jerk), 5) AS jerk_min, round(max(jerk), 5) AS jerk_max, round(arg_max(jerk, sequence_counter), 5) + 0.0 AS jerk_last FROM v GROUP BY 1", "samples")
def flagship(spark, d):
    df = w.with_motion(w.with_dt(src.samples(spark, d)), ["acc_x"]).withColumnRenamed("acc_x_jerk", "jerk")
    f = st.frame(df, ["jerk"])
    return f.select("sequence_id", *(r(f"jerk_{s}", 5).alias(f"jerk_{s}") for s in st.FRAME))


@query("g12_frame_statistics", """SELECT sequence_id, round(avg(acc_x), 6) AS acc_x_mean, round(stddev_pop(acc_x), 6) AS acc_x_std, min(acc_x) AS acc_x_min, max(acc_x) AS acc_x_max, arg_min(acc_x, sequence_counter) AS acc_x_first, arg_max(acc_x, sequence_counter) AS acc_x_last,
round(median(acc_x), 6) AS acc_x_median, round(sqrt(avg(acc_x * acc_x)), 6) AS acc_x_rms, round(avg(abs(acc_x)), 6) AS acc_x_abs_mean, round(stddev_pop(acc_y), 6) AS acc_y_std FROM samples3 GROUP BY 1""", "samples3")
def g12(spark, d):
    f = st.frame(src.samples3(spark, d), ["acc_x", "acc_y"], ("mean", "std", "min", "max", "first", "last", "median", "rms", "abs_mean"))
    exact = ("min", "max", "first", "last")
    return f.select("sequence_id", *(F.col(f"acc_x_{s}") if s in exact else r(f"acc_x_{s}").alias(f"acc_x_{s}") for s in ("mean", "std", "min", "max", "first", "last", "median", "rms", "abs_mean")), r("acc_y_std").alias("acc_y_std"))


for _mode, _start in (("head", "0"), ("tail", "greatest(n - 20, 0)"), ("center", "greatest(n - 20, 0) // 2")):

    @query(f"g13_crop_{_mode}", f"WITH i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY sequence_counter) - 1 AS i, count(*) OVER (PARTITION BY sequence_id) AS n FROM samples) SELECT sequence_id, count(*) AS n, min(i) AS first, round(avg(acc_x), 6) AS mean FROM i WHERE i >= {_start} AND i < {_start} + 20 GROUP BY 1", "samples")
    def g13(spark, d, mode=_mode):
        return w.cropped(src.samples(spark, d), 20, mode).groupBy("sequence_id").agg(F.count("*").alias("n"), F.min("sequence_counter").alias("first"), r(F.avg("acc_x")).alias("mean"))


@query("g14_global_context", "SELECT sequence_id, sequence_counter, round(avg(acc_x) OVER p, 6) AS mean, round(coalesce(stddev_samp(acc_x) OVER p, 0), 6) AS std FROM samples3 WINDOW p AS (PARTITION BY sequence_id)", "samples3")
def g14(spark, d):
    return out(w.with_global_context(src.samples3(spark, d), ["acc_x"]), mean="acc_x_sequence_mean", std="acc_x_sequence_std")


@query("g15_simple_tabular", "SELECT sequence_id, round(coalesce(avg(x), 0), 6) AS mean, round(coalesce(stddev_pop(x), 0), 6) AS std, coalesce(min(x), 0) AS min, coalesce(max(x), 0) AS max, round(coalesce(sum(x * x), 0), 4) AS energy FROM (SELECT sequence_id, nullif(acc_x, 1) AS x FROM samples3) GROUP BY 1", "samples3")
def g15(spark, d):
    x = src.samples3(spark, d).withColumn("x", F.nullif(F.col("acc_x"), F.lit(1.0)))
    f = st.frame(x, ["x"], ("mean", "std", "min", "max", "energy"))
    return f.select("sequence_id", *(F.round(F.coalesce(F.col(f"x_{s}"), F.lit(0.0)), 4 if s == "energy" else 6).alias(s) for s in ("mean", "std", "min", "max", "energy")))


@query("g16_time_statistics", "SELECT sequence_id, round(avg(acc_x), 6) AS mean, round(stddev_pop(acc_x), 6) AS std, round(sqrt(avg(acc_x * acc_x)), 6) AS rms, round(sum(acc_x * acc_x), 3) AS energy, round(max(acc_x) - min(acc_x), 6) AS ptp FROM samples GROUP BY 1", "samples")
def g16(spark, d):
    f = st.frame(src.samples(spark, d), ["acc_x"], ("mean", "std", "rms", "energy", "ptp"))
    return f.select("sequence_id", *(F.round(f"acc_x_{s}", 3 if s == "energy" else 6).alias(s) for s in ("mean", "std", "rms", "energy", "ptp")))


@query("g17_zero_crossings", """WITH c AS (SELECT *, acc_x - avg(acc_x) OVER (PARTITION BY sequence_id) AS c FROM samples),
s AS (SELECT *, sign(c) <> lag(sign(c)) OVER (PARTITION BY sequence_id ORDER BY sequence_counter) AS z FROM c)
SELECT sequence_id, round(avg(c), 6) + 0.0 AS mean, round(stddev_pop(c), 6) AS std, round(min(c), 6) AS min, round(max(c), 6) AS max, round(sqrt(avg(c * c)), 6) AS rms,
  round(max(c) - min(c), 6) AS ptp, round(sum(c * c), 3) AS energy, count(*) FILTER (z) AS zero_crossings FROM s GROUP BY 1""", "samples")
def g17(spark, d):
    t = st.time_features(src.samples(spark, d).withColumn("c", w.centred("acc_x")), "c")
    return t.select("sequence_id", *(r(n, 3 if n == "energy" else 6).alias(n) for n in ("mean", "std", "min", "max", "rms", "ptp", "energy")), "zero_crossings")


@query("g18_rotation_statistics", f"WITH {UNIT}, {ANGLE} SELECT sequence_id, round(avg(roll), 6) + 0.0 AS roll_mean, round(avg(abs(pitch)), 6) AS pitch_abs_mean, round(avg(sqrt(roll * roll + pitch * pitch + yaw * yaw)), 6) AS magnitude_mean FROM a GROUP BY 1", "quats")
def g18(spark, d):
    a = angles(spark, d).withColumn("magnitude", w.magnitude("roll", "pitch", "yaw"))
    return a.groupBy("sequence_id").agg(r(st.stat("mean", "roll")).alias("roll_mean"), r(st.stat("abs_mean", "pitch")).alias("pitch_abs_mean"), r(st.stat("mean", "magnitude")).alias("magnitude_mean"))


@query("f10_problematic_sequences", "SELECT sequence_id, CAST(coalesce(abs(skewness(acc_x)) > 0.8, false)::INT + coalesce(abs(skewness(acc_y)) > 0.8, false)::INT + coalesce(abs(skewness(acc_z)) > 0.8, false)::INT AS BIGINT) AS skewed FROM samples3 GROUP BY 1 HAVING count(*) >= 3 AND skewed >= 2", "samples3")
def f10(spark, d):
    return st.problematic_sequences(src.samples3(spark, d), ["acc_x", "acc_y", "acc_z"], 0.8, 2)


for _final in ("pad", "overlap"):
    _xs = "list_transform(range(0, (n + 9) // 10), lambda k: k * 10)" if _final == "pad" else "list_distinct(list_concat(list_transform(range(0, (n - 20) // 10 + 1), lambda k: k * 10), [n - 20]))"

    @query(f"w0{2 if _final == 'pad' else 3}_starts_{_final}", f"WITH n AS (SELECT sequence_id, count(*) AS n FROM samples GROUP BY 1) SELECT sequence_id, n AS length, CAST(unnest(CASE WHEN n <= 20 THEN [0] ELSE {_xs} END) AS BIGINT) AS start FROM n", "samples")
    def starts(spark, d, final=_final):
        return ch.chunk_starts(src.samples(spark, d), 20, 10, final).select("sequence_id", "length", "start")


@query("w04_cap_last", "WITH n AS (SELECT sequence_id, count(*) AS n FROM samples GROUP BY 1), x AS (SELECT sequence_id, CASE WHEN n <= 20 THEN [0] ELSE list_transform(range(0, (n + 9) // 10), lambda k: k * 10) END AS x FROM n) SELECT sequence_id, CAST(unnest(CASE WHEN len(x) > 3 THEN x[-3:] ELSE x END) AS BIGINT) AS start FROM x", "samples")
def w04(spark, d):
    return ch.chunk_starts(src.samples(spark, d), 20, 10, "pad", 3, "last").select("sequence_id", "start")


@query("w04_cap_uniform", "WITH n AS (SELECT sequence_id, count(*) AS n FROM samples GROUP BY 1), x AS (SELECT sequence_id, CASE WHEN n <= 20 THEN [0] ELSE list_transform(range(0, (n + 9) // 10), lambda k: k * 10) END AS x FROM n) SELECT sequence_id, CAST(unnest(CASE WHEN len(x) > 4 THEN list_distinct(list_transform([0, 1, 2, 3], lambda i: x[1 + CAST(round_even(i * (len(x) - 1) / 3.0::DOUBLE, 0) AS INT)])) ELSE x END) AS BIGINT) AS start FROM x", "samples")
def w04u(spark, d):
    return ch.chunk_starts(src.samples(spark, d), 20, 10, "pad", 4, "uniform").select("sequence_id", "start")


@query("w05_window_rows", "WITH i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY sequence_counter) - 1 AS i, count(*) OVER (PARTITION BY sequence_id) AS n FROM samples), x AS (SELECT sequence_id, acc_x, i, unnest(CASE WHEN n <= 20 THEN [0] ELSE list_transform(range(0, (n + 9) // 10), lambda k: k * 10) END) AS start FROM i) SELECT sequence_id, CAST(start AS BIGINT) AS start, count(*) AS valid, round(avg(acc_x), 6) AS mean FROM x WHERE i >= start AND i < start + 20 GROUP BY 1, 2", "samples")
def w05(spark, d):
    return ch.chunk_rows(src.samples(spark, d), 20, 10).groupBy("sequence_id", "start").agg(F.count("*").alias("valid"), r(F.avg("acc_x")).alias("mean"))


@query("w05_padded_chunks", "WITH i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY sequence_counter) - 1 AS i, count(*) OVER (PARTITION BY sequence_id) AS n FROM samples), x AS (SELECT sequence_id, CAST(acc_x AS FLOAT)::DOUBLE AS acc_x, i, unnest(CASE WHEN n <= 20 THEN [0] ELSE list_transform(range(0, (n + 9) // 10), lambda k: k * 10) END) AS start FROM i) SELECT sequence_id, CAST(start AS BIGINT) AS start, count(*) AS valid, CAST(20 AS BIGINT) AS width, round(sum(acc_x) - 999 * (20 - count(*)), 3) AS total FROM x WHERE i >= start AND i < start + 20 GROUP BY 1, 2", "samples")
def w05p(spark, d):
    c = ch.padded_chunks(src.samples(spark, d), ["acc_x"], 20, 10)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x[0].cast("double"))
    return c.select("sequence_id", "start", F.size(F.filter("mask", lambda m: m)).cast("long").alias("valid"), F.size("features").cast("long").alias("width"), F.round(total, 3).alias("total"))


@query("w07_longest_window", 'SELECT max(n) AS "window" FROM (SELECT count(*) AS n FROM samples GROUP BY sequence_id)', "samples")
def w07(spark, d):
    return ch.longest(src.samples(spark, d))


@query("w08_chunk_report", "WITH n AS (SELECT sequence_id, count(*) AS n FROM samples GROUP BY 1), x AS (SELECT CASE WHEN n <= 20 THEN 1 ELSE (n + 9) // 10 END AS b FROM n) SELECT CAST(sum(least(b, 5)) AS BIGINT) AS chunks, count(*) FILTER (b > 5) AS capped_sequences, CAST(max(b) AS BIGINT) AS most_before, CAST(max(least(b, 5)) AS BIGINT) AS most_after FROM x", "samples")
def w08(spark, d):
    return ch.report(src.samples(spark, d), 20, 10, "pad", 5)


@query("w09_counter_windows", "WITH m AS (SELECT *, max(sequence_counter) OVER (PARTITION BY sequence_id) AS top FROM samples), x AS (SELECT *, unnest(CASE WHEN top + 1 < 16 THEN [0] ELSE list_transform(range(0, (top + 1 - 16) // 8 + 1), lambda k: k * 8) END) AS start FROM m) SELECT sequence_id, CAST(start AS BIGINT) AS start, CAST(start // 8 AS BIGINT) AS segment_id, count(*) AS n, round(avg(acc_x), 6) AS mean FROM x WHERE top + 1 < 16 OR (sequence_counter >= start AND sequence_counter < start + 16) GROUP BY 1, 2, 3", "samples")
def w09(spark, d):
    return ch.counter_windows(src.samples(spark, d), "sequence_counter", 16, 8).groupBy("sequence_id", "start", "segment_id").agg(F.count("*").alias("n"), r(F.avg("acc_x")).alias("mean"))


@query("w10_segments_by_phase", "WITH f AS (SELECT *, min(sequence_counter) OVER (PARTITION BY sequence_id, phase) AS f FROM samples), s AS (SELECT *, dense_rank() OVER (PARTITION BY sequence_id ORDER BY f) - 1 AS segment_id FROM f) SELECT sequence_id, phase, segment_id, count(*) AS n FROM s GROUP BY 1, 2, 3", "samples")
def w10(spark, d):
    return ch.segments(src.samples(spark, d), "phase").groupBy("sequence_id", "phase", "segment_id").agg(F.count("*").alias("n"))


@query("w11_fixed_length", "WITH s AS (SELECT sequence_id, list(acc_x ORDER BY sequence_counter) AS x FROM samples GROUP BY 1) SELECT sequence_id, len(x) AS length, round(list_sum(x[1:64]), 4) AS total, CAST(64 AS BIGINT) AS width FROM s", "samples")
def w11(spark, d):
    f = ch.fixed_length(src.samples(spark, d), "acc_x", 64)
    return f.select("sequence_id", "length", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("values").cast("long").alias("width"))


@query("w12_chunk_comparison", "WITH n AS (SELECT count(*) AS n FROM samples GROUP BY sequence_id) SELECT CAST(sum(CASE WHEN n <= 20 THEN 1 ELSE (n - 20) // 10 + 1 + CASE WHEN (n - 20) % 10 > 0 THEN 1 ELSE 0 END END) AS BIGINT) AS narrow, CAST(sum(CASE WHEN n <= 40 THEN 1 ELSE (n - 40) // 20 + 1 + CASE WHEN (n - 40) % 20 > 0 THEN 1 ELSE 0 END END) AS BIGINT) AS wide FROM n", "samples")
def w12(spark, d):
    n = src.samples(spark, d).groupBy("sequence_id").agg(F.count("*").alias("n"))
    return n.agg(*(F.sum(F.size(ch.starts(F.col("n"), size, step, "overlap"))).alias(name) for name, size, step in (("narrow", 20, 10), ("wide", 40, 20))))

"""Quaternion and angle algebra as column expressions; quaternions are (w, x, y, z), body to world."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.windows import ordered, so_far

Quat = tuple[Column, Column, Column, Column]
GRAVITY = 9.80665


def columns(prefix: str = "rot") -> Quat:
    return tuple(F.col(f"{prefix}_{c}") for c in "wxyz")


def norm(q: Quat) -> Column:
    return F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))


def normalised(q: Quat, strict: bool = True) -> Quat:
    """Unit quaternion. Zero and non-finite ones fail (strict) or become the identity."""
    n = norm(q)
    good = (n > 0) & (n < float("inf"))
    if strict:
        checked = F.when(F.coalesce(good, F.lit(False)), n).otherwise(F.raise_error(F.lit("quaternions must be finite and non-zero")).cast("double"))
        return tuple(c / checked for c in q)
    return tuple(F.when(F.coalesce(good, F.lit(False)), c / n).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, c in enumerate(q))


def product(a: Quat, b: Quat) -> Quat:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def conjugate(q: Quat) -> Quat:
    return (q[0], -q[1], -q[2], -q[3])


def rotated(q: Quat, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """v turned by q."""
    w, u = q[0], q[1:]
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    t = tuple(2 * c for c in cross(u, v))
    return tuple(v[i] + w * t[i] + cross(u, t)[i] for i in range(3))


def euler(q: Quat) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw."""
    w, x, y, z = q
    sine = F.least(F.greatest(2 * (w * y - z * x), F.lit(-1.0)), F.lit(1.0))
    return F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(sine), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def from_euler(roll: Column, pitch: Column, yaw: Column) -> Quat:
    cr, sr, cp, sp, cy, sy = (f(a / 2) for a in (roll, pitch, yaw) for f in (F.cos, F.sin))
    return cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy


def six(q: Quat) -> tuple[Column, ...]:
    """The first two columns of the rotation matrix."""
    w, x, y, z = q
    return 1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y), 2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)


def linear_acceleration(acc, q: Quat, frame: str = "world", gravity: float = GRAVITY):
    """Acceleration without gravity, in the world's axes or the body's."""
    up = (F.lit(0.0), F.lit(0.0), F.lit(gravity))
    if frame == "world":
        return tuple(a - g for a, g in zip(rotated(q, acc), up))
    if frame == "body":
        return tuple(a - g for a, g in zip(acc, rotated(conjugate(q), up)))
    raise ValueError(f"unknown frame {frame!r}")


def rotation_vector(q: Quat) -> tuple[Column, Column, Column]:
    """Axis times angle of the shorter way round."""
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    w, x, y, z = (c * sign for c in q)
    size = F.sqrt(x * x + y * y + z * z)
    scale = F.when(size < 1e-12, 2.0).otherwise(2 * F.atan2(size, w) / size)
    return x * scale, y * scale, z * scale


def with_steady_signs(df: DataFrame, prefix: str = "rot") -> DataFrame:
    """Quaternions flipped so that neighbours lie in one half space; flips follow the parity of the sign changes."""
    q = columns(prefix)
    dot = sum((c * F.lag(c).over(ordered()) for c in q[1:]), q[0] * F.lag(q[0]).over(ordered()))
    df = df.withColumn("_flip", F.when(dot < 0, 1).otherwise(0)).withColumn("_sign", F.when(F.sum("_flip").over(so_far()) % 2 == 1, -1.0).otherwise(1.0))
    return df.withColumns({f"{prefix}_{c}": F.col(f"{prefix}_{c}") * F.col("_sign") for c in "wxyz"}).drop("_flip", "_sign")


def with_angular_velocity(df: DataFrame, prefix: str = "rot", dt: str = "dt", frame: str = "body") -> DataFrame:
    """<prefix>_angular_velocity_{x,y,z} in rad/s and its magnitude, 0 on the first row."""
    q = columns(prefix)
    before = tuple(F.lag(c).over(ordered()) for c in q)
    df = df.withColumn("_d", F.struct(*(c.alias(n) for c, n in zip(product(conjugate(before), q) if frame == "body" else product(q, conjugate(before)), "wxyz"))))
    vec = rotation_vector(tuple(F.col(f"_d.{n}") for n in "wxyz"))
    names = [f"{prefix}_angular_velocity_{c}" for c in "xyz"]
    df = df.withColumns({n: F.coalesce(v / F.col(dt), F.lit(0.0)) for n, v in zip(names, vec)}).drop("_d")
    return df.withColumn(f"{prefix}_angular_velocity_magnitude", F.sqrt(sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0]))))


def upside_down(df: DataFrame, turned: Column, acc: list[str], rates: list[str] = (), prefix: str = "rot") -> DataFrame:
    """df with accelerations, the vector part of the orientation and angular rates negated on rows where `turned` holds
    (sensors worn upside down); a null condition counts as not turned. Columns that df doesn't have are left out."""
    names = [n for n in (*acc, *(f"{prefix}_{c}" for c in "xyz"), *rates) if n in df.columns]
    return df.withColumns({n: F.when(turned, -F.col(n)).otherwise(F.col(n)) for n in names})


def mirrored(acc, q: Quat, left: Column):
    """Left-handed recordings as right-handed ones: acc_x and the pitch and yaw angles change sign."""
    roll, pitch, yaw = euler(q)
    turned = from_euler(roll, -pitch, -yaw)
    return (F.when(left, -acc[0]).otherwise(acc[0]), *acc[1:]), tuple(F.when(left, t).otherwise(c) for t, c in zip(turned, q))

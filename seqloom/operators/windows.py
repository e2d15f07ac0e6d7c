"""Ordered operators within a sequence: every one is a projection over a window on (sequence_id, sequence_counter)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ, AT = "sequence_id", "sequence_counter"


def ordered() -> Window:
    return Window.partitionBy(SEQ).orderBy(AT)


def backwards() -> Window:
    return Window.partitionBy(SEQ).orderBy(F.col(AT).desc())


def entire() -> Window:
    return Window.partitionBy(SEQ)


def so_far() -> Window:
    return ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def step(x: Column) -> Column:
    """Change since the row before, 0 on the first row."""
    return F.coalesce(x - F.lag(x).over(ordered()), F.lit(0.0))


def position() -> Column:
    return (F.row_number().over(ordered()) - 1).cast("long")


def counter_violations(df: DataFrame) -> DataFrame:
    """Rows whose counter is null, not finite or no greater than the one before it in input that is read in counter
    order; the strict form of this check is `assert_counters`."""
    again = F.count("*").over(Window.partitionBy(SEQ, AT)) > 1
    c = F.col(AT).cast("double")
    return df.withColumn("_bad", F.col(AT).isNull() | F.isnan(c) | again).where("_bad").drop("_bad")


def assert_counters(df: DataFrame) -> DataFrame:
    """df itself; running it fails where counters aren't strictly increasing within a sequence."""
    bad = F.col(AT).isNull() | (F.count("*").over(Window.partitionBy(SEQ, AT)) > 1)
    return df.withColumn("_ok", F.assert_true(~bad, F.lit("sequence_counter must be strictly increasing"))).where(F.col("_ok").isNull()).drop("_ok")


def grid_violations(df: DataFrame) -> DataFrame:
    """Rows that don't follow the row before them at a distance of one (spectral operators need a uniform grid)."""
    return df.withColumn("gap", (F.col(AT) - F.lag(AT).over(ordered())).cast("long")).where("gap <> 1")


def with_dt(df: DataFrame, rate: float = 20.0, out: str = "dt") -> DataFrame:
    """Seconds since the row before; the first row of a sequence counts as one step."""
    return df.withColumn(out, F.coalesce((F.col(AT) - F.lag(AT).over(ordered())).cast("double"), F.lit(1.0)) / rate)


def filled(name: str) -> Column:
    """The last known value, before the first one the next; both within the sequence."""
    return F.coalesce(F.last(name, ignorenulls=True).over(so_far()), F.last(name, ignorenulls=True).over(backwards().rowsBetween(Window.unboundedPreceding, 0)))


def interpolated(df: DataFrame, names: list[str]) -> DataFrame:
    """Nulls between known values become points on the line between them, by row position; edges are held."""
    down = backwards().rowsBetween(Window.unboundedPreceding, 0)
    keep, work = df.columns, df.withColumn("_i", position())
    at = {n: F.when(F.col(n).isNotNull(), F.col("_i")) for n in names}
    last = lambda x, w: F.last(x, ignorenulls=True).over(w)
    # all forward frames, then all backward ones: one sort each
    work = work.withColumns({f"_{n}_{k}": last(x, so_far()) for n in names for k, x in (("a", F.col(n)), ("ia", at[n]))})
    work = work.withColumns({f"_{n}_{k}": last(x, down) for n in names for k, x in (("b", F.col(n)), ("ib", at[n]))})
    def value(n: str) -> Column:
        a, b, ia, ib = (F.col(f"_{n}_{x}") for x in ("a", "b", "ia", "ib"))
        return F.when(F.col(n).isNotNull(), F.col(n)).otherwise(F.coalesce(a + (b - a) * (F.col("_i") - ia) / (ib - ia), a, b))
    return work.select(*(value(c).alias(c) if c in names else c for c in keep))


def rolling_mean(x: Column, width: int) -> Column:
    """Centred mean over `width` rows, of those that exist."""
    return F.avg(x).over(ordered().rowsBetween(-(width // 2), width - 1 - width // 2))


def highpass(x: Column, width: int = 5) -> Column:
    return x - rolling_mean(x, width)


def velocity(x: str, dt: str = "dt") -> Column:
    """Integral of x from the start of the sequence; the first row adds nothing."""
    return _integral(F.col(x) * F.col(dt))


def _integral(area: Column) -> Column:
    return F.sum(area).over(so_far()) - F.first(area).over(so_far())


def with_motion(df: DataFrame, names: list[str], dt: str = "dt") -> DataFrame:
    """<name>_velocity, <name>_displacement and <name>_jerk of each acceleration."""
    df = df.withColumns({f"{n}_velocity": _integral(F.col(n) * F.col(dt)) for n in names} | {f"{n}_jerk": step(F.col(n)) / F.col(dt) for n in names})
    return df.withColumns({f"{n}_displacement": _integral(F.col(f"{n}_velocity") * F.col(dt)) for n in names})


def dead_reckoned(df: DataFrame, names: list[str], detrend: bool = True, dt: str = "dt") -> DataFrame:
    """<name>_dr_vel and <name>_dr_pos of each acceleration: its integral, and the integral of that; the first row adds
    nothing. detrend: each without the line from its first to its last value, the velocity before it is integrated."""
    for source, kind in (("", "_dr_vel"), ("_dr_vel", "_dr_pos")):
        df = df.withColumns({f"{n}{kind}": _integral(F.col(f"{n}{source}") * F.col(dt)) for n in names})
        df = df.withColumns({f"{n}{kind}": detrended(f"{n}{kind}") for n in names}) if detrend else df
    return df


def magnitude(*names: str) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (F.col(n) * F.col(n) for n in names)))


def detrended(x: str) -> Column:
    """x without the line from its first to its last value; sequences of one row give 0."""
    n, i = F.count("*").over(entire()), position()
    first, last = (F.first(x).over(w) for w in (ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), backwards().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return F.when(n <= 1, 0.0).otherwise(F.col(x) - (first + (last - first) * i / (n - 1)))


def with_trapezoids(df: DataFrame, x: str, dt: str = "dt") -> DataFrame:
    """<x>_trapezoid_velocity and _displacement: integrals by the trapezoid rule."""
    area = lambda y: F.coalesce((y + F.lag(y).over(ordered())) / 2 * F.col(dt), F.lit(0.0))
    df = df.withColumn("_area", area(F.col(x))).withColumn(f"{x}_trapezoid_velocity", F.sum("_area").over(so_far()))
    df = df.withColumn("_area", area(F.col(f"{x}_trapezoid_velocity"))).withColumn(f"{x}_trapezoid_displacement", F.sum("_area").over(so_far()))
    return df.drop("_area")


def wrapped_step(x: Column) -> Column:
    """Change of an angle since the row before, in (-pi, pi]."""
    d = x - F.lag(x).over(ordered())
    return F.coalesce(F.atan2(F.sin(d), F.cos(d)), F.lit(0.0))


def unwrapped(df: DataFrame, x: str, out: str) -> DataFrame:
    """The angle x with jumps of more than pi undone by multiples of 2 pi."""
    d = F.col(x) - F.lag(x).over(ordered())
    turns = F.coalesce(-F.floor((d + F.lit(3.141592653589793)) / F.lit(6.283185307179586)), F.lit(0))
    return df.withColumn("_turns", turns).withColumn(out, F.col(x) + F.sum("_turns").over(so_far()) * 6.283185307179586).drop("_turns")


def centred(x: str) -> Column:
    return F.col(x) - F.avg(x).over(entire())


def with_global_context(df: DataFrame, names: list[str]) -> DataFrame:
    """<name>_sequence_mean and <name>_sequence_std (of a sample; 0 for single rows) on every row."""
    return df.withColumns({f"{n}_sequence_mean": F.avg(n).over(entire()) for n in names} | {f"{n}_sequence_std": F.coalesce(F.stddev_samp(n).over(entire()), F.lit(0.0)) for n in names})


def cropped(df: DataFrame, rows: int, mode: str = "tail") -> DataFrame:
    """At most `rows` rows of each sequence: head, tail, center or none (all)."""
    if mode not in ("head", "tail", "center", "none"):
        raise ValueError(f"unknown crop mode {mode!r}")
    if mode == "none":
        return df
    df = df.withColumns({"_i": position(), "_n": F.count("*").over(entire())})
    start = {"head": F.lit(0), "tail": F.greatest(F.col("_n") - rows, F.lit(0)), "center": F.floor(F.greatest(F.col("_n") - rows, F.lit(0)) / 2)}[mode]
    return df.where((F.col("_i") >= start) & (F.col("_i") < start + rows)).drop("_i", "_n")


def pre_transform(df: DataFrame, x: str, out: str) -> DataFrame:
    """x without its mean, smoothed over three rows and weighed by a symmetric Hann window."""
    n = F.count("*").over(entire())
    df = df.withColumn("_c", centred(x)).withColumn("_s", rolling_mean(F.col("_c"), 3))
    hann = F.when(n <= 1, 1.0).otherwise(0.5 - 0.5 * F.cos(6.283185307179586 * position() / (n - 1)))
    return df.withColumn(out, F.col("_s") * hann).drop("_c", "_s")

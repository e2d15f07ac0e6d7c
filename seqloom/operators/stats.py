"""Per-sequence statistics: frame features, tabular summaries and quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import AT, SEQ, ordered

FRAME = ("mean", "std", "min", "max", "last")


def stat(name: str, x: str) -> Column:
    """One frame statistic of a column; the deviation is that of the population."""
    c = F.col(x)
    known = {
        "mean": F.avg(c), "std": F.stddev_pop(c), "min": F.min(c), "max": F.max(c), "first": F.min_by(c, F.col(AT)), "last": F.max_by(c, F.col(AT)),
        "median": F.median(c), "rms": F.sqrt(F.avg(c * c)), "abs_mean": F.avg(F.abs(c)), "energy": F.sum(c * c), "ptp": F.max(c) - F.min(c),
    }
    if name not in known:
        raise ValueError(f"unknown statistic {name!r}")
    return known[name]


def frame(df: DataFrame, names: list[str], stats=FRAME) -> DataFrame:
    """One row per sequence with <name>_<stat>, statistics first. One shuffle, partial sums where the statistic allows."""
    return df.groupBy(SEQ).agg(*(stat(s, n).alias(f"{n}_{s}") for s in stats for n in names))


def finite(df: DataFrame, names: list[str]) -> DataFrame:
    """Nulls, NaN and infinities become 0."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(bad(c), 0.0).otherwise(F.col(c)) for c in names})


def zero_crossings(df: DataFrame, x: str) -> DataFrame:
    """(sequence_id, zero_crossings): changes of sign from one row to the next."""
    change = F.signum(x) != F.lag(F.signum(x)).over(ordered())
    return df.withColumn("_c", F.coalesce(change, F.lit(False)).cast("long")).groupBy(SEQ).agg(F.sum("_c").alias("zero_crossings"))


def time_features(df: DataFrame, x: str) -> DataFrame:
    """(sequence_id, mean, std, min, max, rms, ptp, energy, zero_crossings) of one column, in one shuffle."""
    change = F.coalesce((F.signum(x) != F.lag(F.signum(x)).over(ordered())).cast("long"), F.lit(0))
    numbers = [stat(n, x).alias(n) for n in ("mean", "std", "min", "max", "rms", "ptp", "energy")]
    return df.withColumn("_c", change).groupBy(SEQ).agg(*numbers, F.sum("_c").alias("zero_crossings"))


def skewness(x: str) -> Column:
    """Bias-corrected sample skewness; null for fewer than three values."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def problematic_sequences(df: DataFrame, names: list[str], limit: float = 1.35, many: int = 6) -> DataFrame:
    """(sequence_id, skewed): sequences with at least `many` columns whose skewness is beyond the limit."""
    over = sum((F.coalesce((F.abs(skewness(n)) > limit).cast("long"), F.lit(0)) for n in names[1:]), F.coalesce((F.abs(skewness(names[0])) > limit).cast("long"), F.lit(0)))
    return df.groupBy(SEQ).agg(over.alias("skewed")).where(F.col("skewed") >= many)


def drop_problematic(df: DataFrame, names: list[str], limit: float = 1.35, many: int = 6) -> DataFrame:
    return df.join(problematic_sequences(df, names, limit, many).select(SEQ), SEQ, "left_anti")


def segment_lengths(df: DataFrame, by: str, rate: float) -> DataFrame:
    """Describes the lengths in seconds of the (sequence, by) segments: count, mean, std, quartiles and extremes."""
    n = df.groupBy(SEQ, by).agg((F.count("*") / rate).alias("s"))
    q = F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = n.groupBy(by).agg(F.count("*").alias("count"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"), F.min("s").alias("min"), q.alias("q"), F.max("s").alias("max"))
    return out.select(by, "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def masked_mean(x: Column, mask: Column) -> Column:
    return F.sum(x * mask) / F.greatest(F.sum(mask), F.lit(1.0))


def columns_mostly_known(df: DataFrame, names: list[str], most_null: float = 0.2) -> list[str]:
    """Columns with no more than a share of nulls (one aggregate over the table)."""
    shares = df.agg(*(F.avg(F.col(n).isNull().cast("double")).alias(n) for n in names)).first()
    return [n for n in names if shares[n] is not None and shares[n] <= most_null]


def standardised(df: DataFrame, names: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std of the population, a std of 0 counting as 1; nulls become the mean."""
    stats = (fitted_on or df).agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = {}
    for n in names:
        m, s = stats[f"{n}_m"] or 0.0, stats[f"{n}_s"] or 0.0
        scaled[n] = (F.coalesce(F.col(n), F.lit(m)) - m) / (s if s > 0 else 1.0)
    return df.withColumns(scaled)

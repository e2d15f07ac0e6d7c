"""Feature names and the branches of sensor data that they belong to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Branch by the mark or the start of a feature name, the first that fits.
RULES = (("stft", r"_stft\d*_"), ("cwt", r"_cwt\d*_"), ("tof", r"^tof_"), ("thermo", r"^thm_"), ("rotation", r"^rot"), ("derived_imu", r"^(lin_acc|acc_mag)|_(velocity|displacement|jerk|smooth)$"), ("acc", r"^acc_"))


def branch(name: Column) -> Column:
    out = F.when(name.rlike(RULES[0][1]), RULES[0][0])
    for b, pattern in RULES[1:]:
        out = out.when(name.rlike(pattern), b)
    return out.otherwise("other")


def modes(text: str, known: set[str]) -> list[str]:
    """Modes of a string such as "raw|velocity|none": split at bars, lower-cased, without `none`; others are errors."""
    out = [m for m in (x.strip().lower() for x in (text or "").split("|")) if m and m != "none"]
    if set(out) - known:
        raise ValueError(f"unknown modes {sorted(set(out) - known)}")
    return out


def existing(columns: list[str], wanted: list[str]) -> list[str]:
    """The wanted names that exist, each once, in the order wanted."""
    have = set(columns)
    return [c for c in dict.fromkeys(wanted) if c in have]


def except_columns(columns: list[str], gone: list[str]) -> list[str]:
    return [c for c in columns if c not in set(gone)]


def first_sensors(names: list[str], most: int | None) -> list[str]:
    """The first `most` sensors by the number in their names; all for None."""
    number = lambda n: int((re.findall(r"\d+", n) or ["0"])[0])
    ordered = sorted(names, key=lambda n: (number(n), n))
    return ordered if most is None else ordered[:most]


#: Branches whose features are one value a sequence.
STATIC = ("stft", "cwt")


def branch_summary(names: DataFrame) -> DataFrame:
    """(branch, n_features, kind, example_columns) of a table of feature names."""
    rows = names.select("name").distinct().withColumn("branch", branch(F.col("name")))
    out = rows.groupBy("branch").agg(F.count("*").alias("n_features"), F.slice(F.array_sort(F.collect_set("name")), 1, 3).alias("_some"))
    examples = F.concat(F.array_join("_some", ", "), F.when(F.col("n_features") > 3, ", ...").otherwise(""))
    kind = F.when(F.col("branch").isin(*STATIC), "static (per-sequence)").otherwise("time-series")
    return out.select("branch", "n_features", kind.alias("kind"), examples.alias("example_columns"))

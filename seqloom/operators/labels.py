"""Label derivation, metadata filters and leakage-free splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = "(all)"


def with_labels(df: DataFrame, missing_gesture: str = "non_bfrb", missing_orientation: str = "Unknown", separator: str = "-") -> DataFrame:
    """Fills missing labels and derives is_target, bfrb (the gesture of target rows), gesture_position and
    gesture_action (first and last token of the gesture; the whole where the separator is absent)."""
    df = df.withColumns({"gesture": F.coalesce("gesture", F.lit(missing_gesture)), "orientation": F.coalesce("orientation", F.lit(missing_orientation)), "is_target": F.coalesce((F.col("sequence_type") == "Target").cast("int"), F.lit(0))})
    parts = F.split("gesture", separator)
    return df.withColumns({"bfrb": F.when(F.col("is_target") == 1, F.col("gesture")).otherwise(missing_gesture), "gesture_position": F.element_at(parts, 1), "gesture_action": F.element_at(parts, -1)})


def candidates(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows that meet every list of values; an empty list, or one with `(all)`, lets its column pass."""
    conditions = [F.col(c).isin(v) for c, v in wanted.items() if v and ALL not in v]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def age_band(age: Column) -> Column:
    return F.when(age <= 18, "child").when(age < 25, "young_adult").when(age >= 25, "adult")


def composite(separator: str, *names: str) -> Column:
    return F.concat_ws(separator, *names)


def seeded(key: str, seed: int) -> Column:
    """An order that depends on key and seed alone: hexadecimal MD5 of both."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def seeded_places(df: DataFrame, key: str, cell: list[str], seed: int) -> DataFrame:
    """df plus _place (from 1, in seeded order within the cell) and _size (of the cell). Keys are dealt to 4096 ranges
    of their hash; a row counts those of its own range and adds the counts of the ranges before, so a cell that holds
    all rows isn't sorted in one task."""
    df = df.withColumn("_h", seeded(key, seed)).withColumn("_range", F.substring("_h", 1, 3))
    counts = df.groupBy(*cell, "_range").agg(F.count("*").alias("_n"))
    of, before = Window.partitionBy(*cell), Window.partitionBy(*cell).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(c).alias(f"_cell{i}") for i, c in enumerate(cell)]
    counts = counts.select(*named, F.col("_range").alias("_r"), F.sum("_n").over(of).alias("_size"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_cell{i}")) for i, c in enumerate(cell)), F.col("_range") == F.col("_r"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*cell, "_range").orderBy("_h", key))
    return df.join(counts, same).withColumn("_place", place).drop("_h", "_range", "_r", "_before", *(f"_cell{i}" for i in range(len(cell))))


def balanced_split(df: DataFrame, key: str, cell: list[str], train: float = 0.8, test: float = 0.2, seed: int = 42) -> DataFrame:
    """(key, cell..., split): per cell, the same quota of keys for training, then for testing, in seeded order. The quota
    is the share of all keys over the product of the cell columns' distinct counts, which are counted at once. Fails
    where a quota is zero."""
    total, *sizes = df.agg(F.count("*"), *(F.count_distinct(c) for c in cell)).first()
    cells = reduce(lambda a, b: a * b, sizes, 1) or 1
    n_train, n_test = int(total * train) // cells, int(total * test) // cells
    if not n_train or not n_test:
        raise ValueError("too few sequences for a balanced split")
    out = seeded_places(df.select(key, *cell), key, cell, seed).where(F.col("_place") <= n_train + n_test)
    return out.select(key, *cell, F.when(F.col("_place") <= n_train, "train").otherwise("test").alias("split"))


def folds(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """df plus fold: whole keys by the hash of key and seed."""
    return df.withColumn("fold", (F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long") % n).cast("long"))


def stratified_split(df: DataFrame, key: str, label: str, share: float, seed: int = 42) -> DataFrame:
    """(key, label, is_validation): round(share * rows) keys of each label, in seeded order."""
    placed = seeded_places(df.select(key, label), key, [label], seed)
    return placed.select(key, label, (F.col("_place") <= F.round(F.col("_size") * share)).alias("is_validation"))


def leaks(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides of a split; empty where nothing leaks."""
    return a.select(key).intersect(b.select(key))


def episodes(df: DataFrame, key: str, label: str, ways: int, shots: int, queries: int, seed: int = 42) -> DataFrame:
    """(label, key, role): support and query rows of the first `ways` labels in seeded order. A label with fewer rows
    than shots + queries gives some of them again: support first goes round its rows, then the queries go on from there."""
    chosen = df.select(label).distinct().orderBy(F.md5(F.concat_ws(":", F.col(label).cast("string"), F.lit(str(seed))))).limit(ways)
    rows = seeded_places(df.join(F.broadcast(chosen), label, "left_semi").select(label, key), key, [label], seed).where(F.col("_place") <= shots + queries)
    turns = F.sequence(F.lit(0), F.floor((shots + queries - F.col("_place")) / F.col("_size")).cast("int"))
    rows = rows.select(label, key, "_place", "_size", F.explode(turns).alias("_turn")).withColumn("_place", F.col("_place") + F.col("_turn") * F.col("_size"))
    return rows.select(label, key, F.when(F.col("_place") <= shots, "support").otherwise("query").alias("role"))


def many_episodes(df: DataFrame, key: str, label: str, n: int, ways: int, shots: int, queries: int, seed: int = 42) -> DataFrame:
    """(episode, way, label, key, role) of n episodes: for each, `ways` labels in an order of its own, and of each label
    a run of shots + queries keys, support first. The keys of a label stand in one seeded order; an episode's run begins
    at a place drawn for it and goes on from the first key behind the last one, so that keys stand once in a run unless
    the label has fewer. Labels, not keys, are multiplied by the episodes; the runs meet the keys in one join.
    Rows without a label take no part; with fewer labels than `ways` an episode has all of them."""
    known = df.where(F.col(label).isNotNull()).select(key, label)
    number = lambda *what: F.md5(F.concat_ws(":", F.col(label).cast("string"), *(w.cast("string") if isinstance(w, Column) else F.lit(str(w)) for w in what)))
    sizes = known.groupBy(label).agg(F.count("*").alias("_all")).select(label, "_all", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("episode"))
    way = F.row_number().over(Window.partitionBy("episode").orderBy(number(F.col("episode"), seed), label))
    picks = sizes.withColumn("way", way - 1).where(F.col("way") < ways)
    start = F.conv(F.substring(number(F.col("episode"), seed, "start"), 1, 8), 16, 10).cast("long") % F.col("_all")
    picks = picks.select("episode", "way", label, "_all", start.alias("_start"), F.explode(F.sequence(F.lit(0), F.lit(shots + queries - 1))).alias("_j"))
    picks = picks.withColumn("_place", (F.col("_start") + F.col("_j")) % F.col("_all") + 1).drop("_all", "_start")
    placed = seeded_places(known, key, [label], seed).drop("_size")
    role = F.when(F.col("_j") < shots, "support").otherwise("query").alias("role")
    return picks.join(placed, [label, "_place"]).select("episode", "way", label, key, role)

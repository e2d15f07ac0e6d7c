"""Fixed-size windows over sequences, their padding, caps and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import SEQ, entire, position


def stride_of(window: int, stride: int | None = None, ratio: float | None = None) -> int:
    """A stride between 1 and the window. A ratio is rounded half to even; a stride of 0 or less means the window."""
    if ratio is not None:
        return max(1, min(window, round(window * ratio)))
    return window if stride is None or stride <= 0 else min(stride, window)


def starts(length: Column, window: int, stride: int, final: str = "pad") -> Column:
    """Start places of the windows of a sequence. `pad` goes on while a start lies inside the sequence, `overlap` ends
    with a full window at the end."""
    zero = F.array(F.lit(0).cast("long"))
    n = length.cast("long")
    if final == "pad":
        rest = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(stride).cast("long"))
    elif final == "overlap":
        rest = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), n - window, F.lit(stride).cast("long")), F.array(n - window)))
    else:
        raise ValueError(f"unknown final window mode {final!r}")
    return F.when(n <= window, zero).otherwise(rest)


def capped(xs: Column, most: int, policy: str = "last") -> Column:
    """At most `most` of the starts: the first, the last, or evenly spread ones that include the last."""
    if policy == "first":
        return F.slice(xs, 1, most)
    if policy == "last":
        return F.when(F.size(xs) > most, F.slice(xs, -most, most)).otherwise(xs)
    if policy != "uniform":
        raise ValueError(f"unknown window cap policy {policy!r}")
    place = lambda n, i: F.rint(i * (n - 1) / (most - 1) if most > 1 else F.lit(0) * i + n - 1).cast("int")
    n = F.size(xs).cast("double")
    picked = F.transform(F.array(*(F.lit(float(i)) for i in range(most))), lambda i: F.element_at(xs, place(n, i) + 1))
    return F.when(F.size(xs) > most, F.array_distinct(picked)).otherwise(xs)


def chunk_starts(df: DataFrame, window: int, stride: int, final: str = "pad", most: int | None = None, policy: str = "last") -> DataFrame:
    """(sequence_id, length, chunk_idx, start) of every window."""
    n = df.groupBy(SEQ).agg(F.count("*").alias("length"))
    xs = starts(F.col("length"), window, stride, final)
    n = n.withColumn("xs", capped(xs, most, policy) if most else xs)
    return n.select(SEQ, "length", F.posexplode("xs").alias("chunk_idx", "start")).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


def chunk_rows(df: DataFrame, window: int, stride: int, final: str = "pad") -> DataFrame:
    """Every row with each window that holds it: (start, pos). A row finds its windows from its own place and the length
    of its sequence, so no join is needed."""
    df = df.withColumns({"_i": position(), "_n": F.count("*").over(entire())})
    mine = F.filter(starts(F.col("_n"), window, stride, final), lambda s: (s <= F.col("_i")) & (F.col("_i") < s + window))
    return df.withColumn("start", F.explode(mine)).withColumn("pos", F.col("_i") - F.col("start")).drop("_i", "_n")


def padded_chunks(df: DataFrame, names: list[str], window: int, stride: int, final: str = "pad", pad: float = -999.0, most: int | None = None, policy: str = "last") -> DataFrame:
    """(sequence_id, chunk_idx, start, features array<array<float>>, mask array<boolean>): windows of `window` rows, padded
    at the end; the mask is true on real rows. Sequences are gathered whole: a sequence must fit a task."""
    row = F.struct("_i", F.array(*(F.col(n).cast("float") for n in names)).alias("x"))
    seq = df.withColumn("_i", position()).groupBy(SEQ).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    xs = starts(F.size("rows"), window, stride, final)
    seq = seq.select(SEQ, "rows", F.posexplode(capped(xs, most, policy) if most else xs).alias("chunk_idx", "start"))
    part = F.transform(F.slice("rows", (F.col("start") + 1).cast("int"), F.lit(window)), lambda r: r["x"])
    seq = seq.select(SEQ, F.col("chunk_idx").cast("long").alias("chunk_idx"), "start", part.alias("part"))
    blank = F.array(*([F.lit(pad).cast("float")] * len(names)))
    fill = F.lit(window) - F.size("part")
    return seq.select(SEQ, "chunk_idx", "start", F.concat("part", F.array_repeat(blank, fill)).alias("features"), F.concat(F.transform("part", lambda _: F.lit(True)), F.array_repeat(F.lit(False), fill)).alias("mask"))


def longest(df: DataFrame) -> DataFrame:
    """The window that holds every sequence whole."""
    return df.groupBy(SEQ).count().agg(F.max("count").alias("window"))


def report(df: DataFrame, window: int, stride: int, final: str, most: int, policy: str = "last") -> DataFrame:
    """Windows before and after the cap, and how many sequences it touched."""
    n = df.groupBy(SEQ).agg(F.count("*").alias("length"))
    n = n.withColumn("before", F.size(starts(F.col("length"), window, stride, final)).cast("long"))
    n = n.withColumn("after", F.size(capped(starts(F.col("length"), window, stride, final), most, policy)).cast("long"))
    return n.agg(
        F.sum("after").alias("chunks"), F.sum((F.col("after") < F.col("before")).cast("long")).alias("capped_sequences"),
        F.max("before").alias("most_before"), F.max("after").alias("most_after"),
    )


def counter_windows(df: DataFrame, counter: str, size: int, stride: int) -> DataFrame:
    """Rows by windows [start, start + size) of the counter that end within the sequence; shorter sequences are one
    window. Adds start and segment_id."""
    top = F.max(counter).over(entire())
    low = F.col(counter) - F.col(counter) % stride
    mine = F.filter(F.sequence(F.greatest(low - size + stride - (size % stride), F.lit(0).cast("long")), low, F.lit(stride).cast("long")), lambda s: (s <= F.col(counter)) & (F.col(counter) < s + size) & (s + size <= F.col("_top") + 1))
    df = df.withColumn("_top", top)
    return df.withColumn("start", F.explode(F.when(F.col("_top") + 1 < size, F.array(F.lit(0).cast("long"))).otherwise(mine))).withColumn("segment_id", F.floor(F.col("start") / stride)).drop("_top")


def segments(df: DataFrame, by: str) -> DataFrame:
    """Adds segment_id: the ordinal of each value of `by` in a sequence, in order of appearance."""
    first = F.min("sequence_counter").over(Window.partitionBy(SEQ, by))
    df = df.withColumn("_first", first)
    return df.withColumn("segment_id", (F.dense_rank().over(Window.partitionBy(SEQ).orderBy("_first")) - 1).cast("long")).drop("_first")


def fixed_length(df: DataFrame, x: str, size: int, pad: float = 0.0) -> DataFrame:
    """(sequence_id, length, values): the first `size` values of each sequence, padded at the end; length is the true one."""
    seq = df.groupBy(SEQ).agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence_counter", F.col(x).cast("double").alias("x")))), lambda r: r["x"]).alias("xs"))
    return seq.select(SEQ, F.size("xs").cast("long").alias("length"), F.slice(F.concat("xs", F.array_repeat(F.lit(pad), size)), 1, size).alias("values"))

"""The driver's tables in the shapes of sensor data: samples, orientations, grids, sequences and subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counter(*order: str):
    """Places within a sequence. The window is over the renamed key, so that what follows needs no shuffle of its own."""
    return (F.row_number().over(Window.partitionBy("sequence_id").orderBy(*order)) - 1).cast("long").alias("sequence_counter")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One axis: a sequence per user, its events in time order."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("sequence_id"), "ts", "event_id", "value", "event_type")
    return e.select("sequence_id", _counter("ts", "event_id"), F.col("value").alias("acc_x"), F.col("event_type").alias("phase"))


def samples_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As samples, with nulls for `error` events and without `signup` events, so that counters have gaps."""
    s = samples(spark, sf_dir)
    return s.withColumn("acc_x", F.when(F.col("phase") != "error", F.col("acc_x"))).where("phase <> 'signup'")


def samples3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three axes: a sequence per order, its lines in a total order."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sequence_id"), *order, "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return li.select(
        "sequence_id", _counter(*order),
        F.col("l_quantity").alias("acc_x"), F.col("l_discount").alias("acc_y"), F.col("l_tax").alias("acc_z"), F.col("l_returnflag").alias("behavior"),
    )


#: Ids of a block of vectors: within a block, the vectors of a label are a sequence.
BLOCK = 512


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in sequences of bounded length: one for each label and block of ids (labels are 0 to 9)."""
    sequence = F.col("label") + 10 * F.floor(F.col("vec_id") / BLOCK)
    return table(spark, sf_dir, "embeddings").select(sequence.cast("long").alias("sequence_id"), "vec_id", "embedding")


def quats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientations: the first four dimensions of every vector, and accelerations: the next three; a sequence per label and block of ids."""
    e, at = _vectors(spark, sf_dir), lambda i: F.col("embedding")[i].cast("double")
    names = [*(f"rot_{c}" for c in "wxyz"), *(f"acc_{c}" for c in "xyz")]
    return e.select("sequence_id", _counter("vec_id"), *(at(i).alias(n) for i, n in enumerate(names)))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 depth grids in row-major order: components times 1000, the negative ones without return (-1)."""
    pixel = lambda x: F.when(x < 0, F.lit(-1.0)).otherwise(x.cast("double") * 1000)
    return _vectors(spark, sf_dir).select("sequence_id", _counter("vec_id"), "vec_id", F.transform("embedding", pixel).alias("grid"))


def thermo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five temperature channels: dimensions 10 to 14."""
    return _vectors(spark, sf_dir).select("sequence_id", _counter("vec_id"), *(F.col("embedding")[9 + i].cast("double").alias(f"thm_{i}") for i in range(1, 6)))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence labels: a row per order, with some labels missing."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("sequence_id"), F.col("o_custkey").alias("subject"),
        F.when(F.col("o_orderstatus") == "F", "Target").otherwise("Other").alias("sequence_type"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("gesture"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("orientation"), F.col("o_totalprice").alias("weight"),
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject demographics: a row per customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("sex"), (F.col("c_custkey") % 40 + 8).alias("age"),
        (F.col("c_nationkey") % 2).cast("long").alias("handedness"), F.col("c_acctbal").alias("height_cm"),
    )


#: The same shapes as DuckDB common table expressions.
SQL = {
    "samples": "samples AS (SELECT user_id AS sequence_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence_counter, value AS acc_x, event_type AS phase FROM events)",
    "samples_gap": "all_samples AS (SELECT user_id AS sequence_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence_counter, CASE WHEN event_type <> 'error' THEN value END AS acc_x, event_type AS phase FROM events), samples_gap AS (SELECT * FROM all_samples WHERE phase <> 'signup')",
    "samples3": "samples3 AS (SELECT l_orderkey AS sequence_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS sequence_counter, l_quantity AS acc_x, l_discount AS acc_y, l_tax AS acc_z, l_returnflag AS behavior FROM lineitem)",
    "quats": "quats AS (SELECT CAST(label + 10 * (vec_id // 512) AS BIGINT) AS sequence_id, row_number() OVER (PARTITION BY label, vec_id // 512 ORDER BY vec_id) - 1 AS sequence_counter, CAST(embedding[1] AS DOUBLE) AS rot_w, CAST(embedding[2] AS DOUBLE) AS rot_x, CAST(embedding[3] AS DOUBLE) AS rot_y, CAST(embedding[4] AS DOUBLE) AS rot_z, CAST(embedding[5] AS DOUBLE) AS acc_x, CAST(embedding[6] AS DOUBLE) AS acc_y, CAST(embedding[7] AS DOUBLE) AS acc_z FROM embeddings)",
    "grids": "grids AS (SELECT CAST(label + 10 * (vec_id // 512) AS BIGINT) AS sequence_id, row_number() OVER (PARTITION BY label, vec_id // 512 ORDER BY vec_id) - 1 AS sequence_counter, vec_id, list_transform(embedding, lambda x: CASE WHEN x < 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(x AS DOUBLE) * 1000 END) AS grid FROM embeddings)",
    "thermo": "thermo AS (SELECT CAST(label + 10 * (vec_id // 512) AS BIGINT) AS sequence_id, row_number() OVER (PARTITION BY label, vec_id // 512 ORDER BY vec_id) - 1 AS sequence_counter, " + ", ".join(f"CAST(embedding[{9 + i + 1}] AS DOUBLE) AS thm_{i}" for i in range(1, 6)) + " FROM embeddings)",
    "sequences": "sequences AS (SELECT o_orderkey AS sequence_id, o_custkey AS subject, CASE WHEN o_orderstatus = 'F' THEN 'Target' ELSE 'Other' END AS sequence_type, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS gesture, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS orientation, o_totalprice AS weight FROM orders)",
    "subjects": "subjects AS (SELECT c_custkey AS subject, c_mktsegment AS sex, c_custkey % 40 + 8 AS age, CAST(c_nationkey % 2 AS BIGINT) AS handedness, c_acctbal AS height_cm FROM customer)",
}

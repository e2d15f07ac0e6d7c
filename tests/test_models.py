"""Fits read written tables in bounded partitions."""

from pyspark.sql import functions as F

from seqloom.operators import models as ml
from seqloom.operators import scoring


def test_class_weights_shuffle_no_rows(spark):
    """A join by label would put a class into one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(60).select("id", (F.col("id") % 3 == 0).alias("y")).repartition(5)
        out = scoring.balanced_weights(df, "y")
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r.y, r.class_weight) for r in out.collect()} == {(True, 1.5), (False, 0.75)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_tables_are_fitted_in_small_partitions(spark, monkeypatch):
    monkeypatch.setattr(ml, "FIT_ROWS", 10)
    df = spark.range(95).coalesce(1)
    assert ml.spread(df).rdd.getNumPartitions() == 10 and ml.spread(df.limit(5)).rdd.getNumPartitions() == 1


def test_features_are_computed_once(spark):
    from seqloom.plans.models import features

    frame, _ = features(spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and frame.count() > 0


def test_equal_rows_count_as_often_as_they_stand(spark):
    """Models of rows with weights against models of the repeated rows."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(3)
    some = [(rng.integers(0, 3, 4).astype(float).tolist(), int(rng.integers(0, 3)), 1 + int(rng.integers(0, 40))) for _ in range(12)]
    both = spark.createDataFrame(some, "_expanded array<double>, y int, n int").select("*", array_to_vector("_expanded").alias("_features"), F.col("y").cast("double").alias("_label")).coalesce(1)
    once = both.withColumn("w", F.col("n").cast("double"))
    often = both.withColumn("w", F.lit(1.0)).withColumn("_r", F.explode(F.expr("sequence(1, n)")))
    assert ml.shared_out(once, "w").agg(F.count("*"), F.max("w"), F.sum("w")).first() == (often.count(), 1.0, float(often.count()))
    for kind, of in (("logistic", lambda m: [m.coefficientMatrix.toArray(), m.interceptVector.toArray()]), ("ridge", lambda m: [m.coefficients.toArray(), m.intercept]), ("svm", lambda m: [v for b in m.models for v in (b.coefficients.toArray(), b.intercept)])):
        one, many = (ml.linear_models(rows, "w", kind, 0.05, 3) for rows in (ml.shared_out(once, "w") if kind == "svm" else once, often))
        for a, b in zip(one, many):
            assert all(np.allclose(x, y, atol=0.02 if kind == "svm" else 1e-4) for x, y in zip(of(a), of(b))), kind


def test_a_linear_fit_reads_equal_rows_once(spark, monkeypatch):
    monkeypatch.setattr(ml, "LEAST_SHARE", 1.0)
    sizes, real = [], ml.linear_models
    monkeypatch.setattr(ml, "linear_models", lambda rows, *how: sizes.append(rows.count()) or real(rows, *how))
    df = spark.range(600).coalesce(1).select("id", F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("x"), F.when(F.col("id") % 3 == 1, "a").otherwise("b").alias("y"))
    for kind in ("logistic", "svm", "ridge"):
        out = ml.linear(df, "x", "y", kind, 0.001)
        assert out.columns == ["id", "x", "y", "prediction"] and out.count() == 600
    assert sizes == [3, 3, 3]
    assert [r.prediction == r.y for r in ml.linear(df, "x", "y", "logistic", 0.001, lambda d: d.withColumn("_expanded", F.transform("x", lambda v: (v - 1) * (v - 1)))).collect()] == [True] * 600


def test_a_linear_fit_keeps_no_features_beside_its_blocks(spark, monkeypatch):
    """Whole partitions of features were persisted, then once more in blocks: executors ran out of memory."""
    fits, real = [], ml.LinearSVC.fit
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(ml.LinearSVC, "fit", lambda self, rows, *how: fits.append((rows.rdd.getNumPartitions(), "InMemory" in rows._jdf.queryExecution().optimizedPlan().toString(), held())) or real(self, rows, *how))
    df = spark.range(90).coalesce(1).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"), (F.col("id") < 40).cast("string").alias("y"))
    whole = [r.prediction for r in ml.linear(df, "x", "y", "svm").orderBy("id").collect()]
    monkeypatch.setattr(ml, "FIT_ROWS", 10)
    parts = [r.prediction for r in ml.linear(df, "x", "y", "svm").orderBy("id").collect()]
    wide = lambda d: d.withColumn("_expanded", F.array_repeat(F.col("x")[0], 128))
    ml.linear(df, "x", "y", "svm", 0.01, wide)
    assert whole == parts and [n for n, *_ in fits[2:]] == [9, 9, 18, 18] and {f[1:] for f in fits} == {(False, held())}


def test_cross_validation_fits_once_a_fold_and_point(spark, monkeypatch):
    fits, real = [], ml.RandomForestClassifier.fit
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda self, rows, params: fits.append((rows.count(), rows.columns)) or real(self, rows, params))
    df = spark.range(60).coalesce(1).select("id", (F.col("id") % 2).alias("fold"), (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 5 > 2).cast("double").alias("y"))
    with ml.cross_validated(df, ["a"], "y", "fold") as score:
        assert score([{"numTrees": 2, "maxDepth": 3}, {"numTrees": 2, "maxDepth": 0}])[0] > 0.9
    assert fits == [(30, ["features", "y", "fold"])] * 4


def test_a_search_keeps_its_table_on_disk(spark):
    """Forests keep rows of their own in memory; the table beside them drove those to disk."""
    df = spark.range(60).coalesce(1).select((F.col("id") % 2).alias("fold"), F.col("id").cast("double").alias("a"), (F.col("id") > 30).cast("double").alias("y"))
    held, cost = spark.sparkContext._jsc.getPersistentRDDs().size(), spark.conf.get("spark.sql.files.openCostInBytes")
    with ml.cross_validated(df, ["a"], "y", "fold") as score:
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
        assert score([{"numTrees": 2, "maxDepth": 2}])[0] > 0.9
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost

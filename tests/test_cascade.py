"""No row of a cascade forest sees its own fold; layers end when they don't help."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from seqloom.operators import cascade as cf

RNG = np.random.default_rng(9)


def test_layers_and_folds(spark, monkeypatch):
    x = RNG.normal(size=(90, 2))
    rows = [(i, i % 3, float(a), float(b), "p" if a * b > 0 else "q") for i, (a, b) in enumerate(x)] + [(100, 0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "k long, fold int, a double, b double, y string")
    asked, real = [], cf._class_vectors

    def watched(train, rows, *how):
        mine, others = ({r.fold for r in d.select("fold").distinct().collect()} for d in (rows, train))
        asked.append((how[0], mine, others))
        return real(train, rows, *how)

    monkeypatch.setattr(cf, "_class_vectors", watched)
    out, scores = cf.cascade(df, ["a", "b"], "y", "fold", most_layers=2, trees=5, depth=4)
    got = out.collect()
    assert len(got) == 90 and out.columns == [*df.columns, "prediction"]
    assert all(len(mine) == 1 and not mine & others and len(others) == 2 for _, mine, others in asked)
    assert len(scores) == 2 and len(asked) == 6
    assert asked[0][0] == ["a", "b"] and set(asked[3][0]) == {"a", "b", *(f"c0_{i}_{c}" for i in range(2) for c in range(2))}
    right = sum(r.prediction == r.y for r in got) / 90
    assert right == pytest.approx(max(scores)) and right > 0.7


def test_noise_gives_no_knowledge(spark):
    """Labels by chance: were a row's own fold seen, its forests would know them by heart."""
    df = spark.range(120).select(F.col("id").alias("k"), (F.col("id") % 2).alias("fold"), F.rand(1).alias("a"), F.when(F.rand(2) < 0.5, "p").otherwise("q").alias("y"))
    df = df.toPandas().pipe(spark.createDataFrame)
    _, scores = cf.cascade(df, ["a"], "y", "fold", most_layers=1, trees=5, depth=8)
    assert scores[0] < 0.7
    with pytest.raises(ValueError):
        cf.cascade(df.where("fold = 0"), ["a"], "y", "fold")


def test_fits_read_vectors_of_other_folds(spark, monkeypatch):
    """A fit's rows are vectors in files that hold no row of the fold left out; forests on plain columns give the same."""
    x = np.random.default_rng(3).normal(size=(60, 2))
    rows = [(i, "" if i % 3 == 0 else f"a/{i % 3}", float(a), float(b), "p" if a > b else "q") for i, (a, b) in enumerate(x)]
    df, seen, real = spark.createDataFrame(rows, "k long, fold string, a double, b double, y string"), [], cf._class_vectors

    def watched(train, rows, names, classes, layer, trees, depth, seed):
        mine, others = ({r[0] for r in d.select(F.input_file_name()).distinct().collect()} for d in (rows, train))
        assert not mine & others and "_x" in train.columns
        out = real(train, rows, names, classes, layer, trees, depth, seed)
        columns = lambda d: VectorAssembler(inputCols=["a", "b"], outputCol="_x", handleInvalid="keep").transform(d.drop("_x"))
        plain = cf._forest("sqrt", trees, depth, seed).fit(columns(train)).transform(columns(rows)).select("k", "_v").collect() if layer == 0 else []
        got = {r.k: r.c for r in out.select("k", F.col(f"c{layer}_0_0").alias("c")).collect()}
        assert all(got[r.k] == r["_v"][0] for r in plain) and len(got) == 20
        seen.append((names, {(r.k, tuple(r["_x"].toArray())) for r in rows.select("k", "_x").collect()}))
        return out

    monkeypatch.setattr(cf, "_class_vectors", watched)
    out, scores = cf.cascade(df, ["a", "b"], "y", "fold", most_layers=3, trees=3, depth=3, least_gain=-1.0, kept=["k", "a", "b"])
    assert out.columns == ["k", "a", "b", "prediction"] and out.count() == 60 and len(scores) == 3 and len(seen) == 9
    for i, (names, vectors) in enumerate(seen):
        assert names == ["a", "b", *(f"c{i // 3 - 1}_{j}_{c}" for j in range(2) for c in range(2) if i > 2)]
        assert all(len(v) == len(names) and v[:2] == tuple(x[k]) for k, v in vectors)
    assert "spark.sql.files.minPartitionNum" not in {r.key for r in spark.sql("SET").collect()}

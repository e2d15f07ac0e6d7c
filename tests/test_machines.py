"""Row-by-row machines against a plain loop, kernels against their formula."""

import hashlib

import numpy as np
import pytest

from seqloom.operators import machines as mc

RNG = np.random.default_rng(6)


def table(spark, n=60):
    x = RNG.normal(size=(n, 3))
    y = ["a" if v[0] + v[1] > 0.3 else "b" if v[2] > 0 else "c" for v in x]
    rows = [(i, x[i].tolist(), y[i]) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (n, None, "a"), (n + 1, [0.0, 0.0, 0.0], None)], "k long, x array<double>, y string").repartition(4)


@pytest.mark.parametrize("kind", ["sgd", "pa"])
def test_one_part_is_the_plain_loop(spark, kind):
    rows, df = table(spark)
    machine = mc.trained(df, "x", "y", "k", kind, rounds=3, parts=1, rate=0.1, penalty=0.01, most=0.5, seed=5)
    w = np.zeros((3, 4))
    for turn in range(3):
        for k, x, y in sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}:5:{turn}".encode()).hexdigest(), str(r[0]))):
            row = np.array([*x, 1.0])
            for c, name in enumerate("abc"):
                sign = 1.0 if name == y else -1.0
                loss = 1 - sign * float(w[c] @ row)
                if kind == "pa":
                    w[c] += min(0.5, max(loss, 0.0) / float(row @ row)) * sign * row
                else:
                    w[c, :3] *= 1 - 0.1 * 0.01
                    w[c] += 0.1 * sign * row * (loss > 0)
    assert machine.classes == ("a", "b", "c") and np.allclose(machine.weights, w)


def test_many_parts_learn_too(spark):
    rows, df = table(spark, 400)
    for kind in ("sgd", "pa"):
        machine = mc.trained(df, "x", "y", "k", kind, rounds=6, parts=4, rate=0.05)
        again = mc.trained(df.repartition(7), "x", "y", "k", kind, rounds=6, parts=4, rate=0.05)
        assert np.allclose(machine.weights, again.weights)
        got = {r.k: r.prediction for r in mc.predicted(df, "x", machine).collect()}
        assert sum(got[k] == y for k, _, y in rows) > 0.75 * len(rows) and got[400] is None
    none = mc.trained(df.where("false"), "x", "y", "k")
    assert none.classes == () and mc.predicted(df, "x", none).where("prediction IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        mc.trained(df, "x", "y", "k", "other")


def test_waves_approximate_the_kernel():
    x = RNG.normal(size=(40, 5))
    z = mc.waves(x, mc.frequencies(5, 4096, 0.2, 1))
    kernel = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.08


def test_radial_machine_bends(spark):
    x = RNG.normal(size=(300, 2))
    rows = [(i, v.tolist(), "in" if (v**2).sum() < 1.2 else "out") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, x array<double>, y string")
    got = mc.radial_machine(df, "x", "y", 256, penalty=0.001).collect()
    assert sum(r.y == r.prediction for r in got) > 0.9 * len(got) and got[0].asDict().keys() == {"k", "x", "y", "prediction"}


def test_rows_are_dealt_once(spark, monkeypatch):
    """Each round used to shuffle all rows again."""
    _, df = table(spark)
    dealt, real = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *how: dealt.append(how) or real(self, *how))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    mc.trained(df, "x", "y", "k", "pa", rounds=3, parts=4)
    assert dealt == [(4, "k")] and spark.sparkContext._jsc.getPersistentRDDs().size() == held

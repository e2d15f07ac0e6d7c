import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from seqloom.functions import branches
from seqloom.functions.branches import modes
from seqloom.operators import augment, scoring, search
from seqloom.operators import labels as lb
from seqloom.operators import models as ml
from seqloom.plans import catalog
from seqloom.plans.pipeline import SensorPipeline
from seqloom.sources import files


def test_stratified_split(spark):
    df = spark.createDataFrame([(i, "A" if i < 5 else "B") for i in range(10)], "id int, label string")
    out = lb.stratified_split(df, "id", "label", 0.4).where("is_validation")
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {"A": 2, "B": 2}


def test_balanced_split_needs_rows(spark):
    df = spark.createDataFrame([(1, "s", "g")], "id int, subject string, gesture string")
    with pytest.raises(ValueError):
        lb.balanced_split(df, "id", ["subject", "gesture"])


def test_score(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "non_bfrb"), ("non_bfrb", "a"), ("b", "b")], "t string, p string")
    s = scoring.competition_score(df, "t", "p").first()
    assert abs(s.binary_f1 - 2 / 3) < 1e-9 and abs(s.macro_f1 - (2 / 3 + 1 + 0) / 3) < 1e-9


def test_modes():
    assert modes("Raw|velocity|none", {"raw", "velocity"}) == ["raw", "velocity"]
    with pytest.raises(ValueError):
        SensorPipeline(acc_modes="fast")


def test_augmentation_does_not_depend_on_partitions(spark):
    df = spark.range(200).select((F.col("id") % 5).alias("sequence_id"), F.col("id").alias("sequence_counter"), F.rand(1).alias("x")).cache()
    key = ["sequence_id", "sequence_counter", "x"]
    a, b = (sorted(map(tuple, augment.augmented(d, ["x"], None, 1.0).select(*key).collect())) for d in (df, df.repartition(3)))
    assert a == b


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("SEQ_1", 0, 1.5)], "sequence_id string, sequence_counter long, acc_x double")
    schema = df.schema
    df.write.option("header", True).csv(str(tmp_path / "in"))
    assert files.read_csv(spark, str(tmp_path / "in"), schema).collect() == df.collect()
    calls = []
    for _ in range(2):
        out = files.cached_features(spark, str(tmp_path / "cache"), lambda: calls.append(1) or df)
    assert out.collect() == df.collect() and len(calls) == 1
    assert len(files.sample_schema().names) == 9 + 12 + 320


def test_every_oracle_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_places_of_one_large_cell(spark):
    df = spark.range(5000).selectExpr("id as k", "if(id < 4900, 'a', if(id < 4990, null, 'b')) as c")
    got = lb.seeded_places(df, "k", ["c"], 1).collect()
    by = {}
    for r in got:
        by.setdefault(r.c, []).append((r._place, hashlib.md5(f"{r.k}:1".encode()).hexdigest(), r._size))
    for c, rows in by.items():
        rows.sort()
        assert [p for p, *_ in rows] == list(range(1, len(rows) + 1)) and [h for _, h, _ in rows] == sorted(h for _, h, _ in rows)
        assert {n for *_, n in rows} == {len(rows)}


def test_episodes_repeat_short_classes(spark):
    df = spark.createDataFrame([(i, "ab"[i > 3]) for i in range(40)], "k long, c string")
    rows = lb.episodes(df, "k", "c", 2, 3, 4).collect()
    for c in "ab":
        assert sorted(r.role for r in rows if r.c == c) == ["query"] * 4 + ["support"] * 3
    assert len({r.k for r in rows if r.c == "a"}) == 4


def test_model_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(40)], "x double, y int")
    model = ml.boosted(df, ["x"], "y", 2)
    files.save_model(model, str(tmp_path / "m"), ["x"], seed=3)
    again, about = files.load_model(spark, str(tmp_path / "m"))
    assert about == {"features": ["x"], "seed": 3} and again.transform(df).count() == 40
    names = ("cv_results.csv", "holdout_results.csv", "best_results.csv")
    for bad in (("../x.csv", *names), names[:2]):
        with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
            for n in bad:
                z.writestr(n, "a")
        with pytest.raises(ValueError):
            files.collect_bundle(str(tmp_path / "b.zip"), str(tmp_path / "out"))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        for n in names:
            z.writestr(f"r/{n}", "a")
    assert len(files.collect_bundle(str(tmp_path / "b.zip"), str(tmp_path / "out"))) == 3
    (tmp_path / "in" / "set").mkdir(parents=True)
    (tmp_path / "in" / "set" / "train.csv").write_text("a")
    assert files.find_data_root(spark, places=(str(tmp_path / "in"),)).endswith("in/set")
    with pytest.raises(FileNotFoundError):
        files.find_data_root(spark, ("no-such-file",))


def test_search_spaces():
    space = {"a": [1, 2, 3], "b": [{"x": 1}, [2]]}
    coded = search.encoded(space)
    assert [search.decoded(v) for v in coded["b"]] == [{"x": 1}, [2]]
    points = search.drawn(coded, 10)
    assert len(points) == 6 and len({tuple(sorted(p.items())) for p in points}) == 6 and search.drawn(coded, 3) == search.drawn(coded, 3)
    assert search.validated({"window_size": 8}) == {"window_size": 8}
    for bad in ({"window_size": 0}, {"maxlen": 1.5}, {"sequence_crop_mode": "x"}):
        with pytest.raises(ValueError):
            search.validated(bad)


def test_names_of_columns():
    assert branches.existing(["a", "b"], ["b", "c", "b", "a"]) == ["b", "a"] and branches.except_columns(["a", "b"], ["a"]) == ["b"]
    assert branches.first_sensors(["tof_10", "tof_2", "tof_1"], 2) == ["tof_1", "tof_2"]


def test_pipeline_shuffles_once(spark):
    names = [*(f"acc_{c}" for c in "xyz"), *(f"rot_{c}" for c in "wxyz"), "thm_1"]
    df = spark.createDataFrame([("a", i, *([0.5] * 8), [1.0] * 64) for i in range(9)], "sequence_id string, sequence_counter long, " + ", ".join(f"{n} double" for n in names) + ", tof_1 array<double>")
    native = {
        "acc_modes": "raw|velocity|dead_reckoning", "rotation_modes": "quaternion|angular_velocity", "linear_acceleration": "body", "grids": ["tof_1"], "depth_modes": "regions|motion",
        "thermo": ["thm_1"], "thermo_modes": "centered_diff|mean", "global_context": True, "frame_stats": ("mean",),
    }
    for more, shuffles in (({}, 1), ({"motion_filter": True}, 2), ({"motion_filter": True, "resample": (20, 10), "stft": {}}, 4)):
        frame = SensorPipeline(**native, **more).frame(df)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles


def test_many_episodes(spark):
    rows = [(i, "abcd"[i % 3]) for i in range(60)] + [(100, "d"), (101, "d"), (102, None)]
    df = spark.createDataFrame(rows, "k long, y string").repartition(3)
    got = lb.many_episodes(df, "k", "y", 20, 3, 2, 4).collect()
    of, runs = dict(rows), {}
    for r in got:
        assert of[r.k] == r.y
        runs.setdefault((r.episode, r.way), []).append(r)
    assert {e for e, _ in runs} == set(range(20)) and {w for _, w in runs} == {0, 1, 2} and len(runs) == 60
    for run in runs.values():
        assert sorted(r.role for r in run) == ["query"] * 4 + ["support"] * 2 and len({r.y for r in run}) == 1
        assert len({r.k for r in run}) == (2 if run[0].y == "d" else 6)
    assert len({tuple(sorted(r.k for r in run)) for run in runs.values()}) > 20
    assert all(len({runs[e, w][0].y for w in range(3)}) == 3 for e in range(20))
    again = lb.many_episodes(df.repartition(7), "k", "y", 20, 3, 2, 4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_nearest_prototypes_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    protos, points = rng.normal(size=(50, 3)), rng.normal(size=(40, 3))
    protos[7] = protos[3]  # the first label of a tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, x array<double>").repartition(3)
    table = spark.createDataFrame([(f"c{i:02}", v.tolist()) for i, v in enumerate(protos)], "label string, centroid array<double>")
    d = ((points[:, None] - protos[None]) ** 2).sum(axis=2)
    for block in (1000, 7):
        got = {r.id: r for r in ml.nearest_centroid(df, "x", table, "label", block).collect()}
        for i in range(40):
            best = int(d[i].argmin())
            assert got[i].nearest == f"c{best:02}" and got[i].distance == pytest.approx(d[i, best])
            assert got[i].probability == pytest.approx(1 / np.exp(d[i, best] - d[i]).sum())
    none = ml.nearest_centroid(df, "x", table.where("false"), "label").first()
    assert none.nearest is None and none.probability is None

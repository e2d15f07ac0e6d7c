"""Queries of the models, augmentations and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.branches import branch, branch_summary
from seqloom.operators import augment as au
from seqloom.operators import cascade
from seqloom.operators import clusters as cl
from seqloom.operators import hierarchy, machines
from seqloom.operators import labels as lb
from seqloom.operators import models as ml
from seqloom.operators import rocket, search
from seqloom.operators import spectral as sp
from seqloom.operators import stats as st
from seqloom.shared import cut
from seqloom.sources import adapters as src

from .ordered import RECKONED
from .pipeline import SensorPipeline
from .registry import query


def features(spark, d):
    """A row of features a sequence, with its label, and their names; a written table, since fitting reads it many times."""
    f = st.frame(src.samples3(spark, d), ["acc_x", "acc_y", "acc_z"], ("mean", "std", "max"))
    y = src.sequences(spark, d).select("sequence_id", "sequence_type")
    return cut(f.join(y, "sequence_id")), [f"acc_{c}_{s}" for s in ("mean", "std", "max") for c in "xyz"]


@query("l01_random_forest")
def l01(spark, d):
    f, names = features(spark, d)
    return ml.forest(f, names, "sequence_type", trees=100, depth=8).transform(f.withColumn("class_weight", F.lit(1.0))).select("sequence_id", "prediction")


@query("l05_feature_importance")
def l05(spark, d):
    f, names = features(spark, d)
    values = ml.forest(f, names, "sequence_type", trees=50, depth=5).stages[2].featureImportances.toArray()
    t = spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
    return t.groupBy(F.substring_index("feature", "_", 2).alias("axis")).agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"))


#: Names of features in many branches, from the numbers of the parts table.
NAMES = "n AS (SELECT DISTINCT (['acc_', 'rot_', 'tof_', 'thm_', 'lin_acc_', 'foot_'])[1 + p_partkey % 6] || (p_size % 9) || (['', '_jerk', '_stft0_mean', '_cwt1_std', '_smooth'])[1 + p_partkey % 5] AS name FROM part)"
BRANCHES = "b AS (SELECT name, CASE WHEN regexp_matches(name, '_stft\\d*_') THEN 'stft' WHEN regexp_matches(name, '_cwt\\d*_') THEN 'cwt' WHEN name LIKE 'tof\\_%' ESCAPE '\\' THEN 'tof' WHEN name LIKE 'thm\\_%' ESCAPE '\\' THEN 'thermo' WHEN name LIKE 'rot%' THEN 'rotation' WHEN regexp_matches(name, '^(lin_acc|acc_mag)|_(velocity|displacement|jerk|smooth)$') THEN 'derived_imu' WHEN name LIKE 'acc\\_%' ESCAPE '\\' THEN 'acc' ELSE 'other' END AS branch FROM n)"


def feature_names(spark, d):
    pick = lambda n, *words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % n + 1).cast("int"))
    start, end = pick(6, "acc_", "rot_", "tof_", "thm_", "lin_acc_", "foot_"), pick(5, "", "_jerk", "_stft0_mean", "_cwt1_std", "_smooth")
    return src.table(spark, d, "part").select(F.concat(start, (F.col("p_size") % 9).cast("string"), end).alias("name")).distinct()


@query("l07_branches", f"WITH {NAMES}, {BRANCHES} SELECT name, branch FROM b")
def l07(spark, d):
    return feature_names(spark, d).select("name", branch(F.col("name")).alias("branch"))


@query("l07_branch_summary", f"""WITH {NAMES}, {BRANCHES}, s AS (SELECT branch, count(*) AS n_features, list_sort(list(name))[1:3] AS s FROM b GROUP BY 1)
SELECT branch, n_features, CASE WHEN branch IN ('stft', 'cwt') THEN 'static (per-sequence)' ELSE 'time-series' END AS kind, array_to_string(s, ', ') || CASE WHEN n_features > 3 THEN ', ...' ELSE '' END AS example_columns FROM s""")
def l07_summary(spark, d):
    return branch_summary(feature_names(spark, d))


@query("l09_feature_selection")
def l09(spark, d):
    f, names = features(spark, d)
    kept = ml.selected(f.withColumn("y", (F.col("sequence_type") == "Target").cast("double")), names, "y", 0.5)
    return spark.createDataFrame([(n,) for n in kept], "feature string")


@query("l11_nearest_prototype", """WITH e AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label AS k, i, avg(x) AS m FROM e GROUP BY 1, 2), s AS (SELECT vec_id, label, k, sum((x - m) * (x - m)) AS s FROM e JOIN c USING (i) GROUP BY 1, 2, 3)
SELECT vec_id, label, arg_min(k, s) AS nearest, round(min(s), 5) AS distance FROM s GROUP BY 1, 2""")
def l11(spark, d):
    e = src.table(spark, d, "embeddings")
    out = ml.nearest_centroid(e, "embedding", ml.centroids(e, "embedding", "label"), "label")
    return out.select("vec_id", "label", "nearest", F.round("distance", 5).alias("distance"))


@query("l13_pca")
def l13(spark, d):
    f, names = features(spark, d)
    return ml.principal_components(f, names).select("sequence_id", "pc1", "pc2")


@query("l14_k_means_sweep")
def l14(spark, d):
    return ml.k_means_sweep(st.frame(src.samples(spark, d), ["acc_x"], ("mean", "std", "max")), ["acc_x_mean", "acc_x_std", "acc_x_max"])


@query("l14_mixture_sweep")
def l14m(spark, d):
    return ml.mixture_sweep(st.frame(src.samples(spark, d), ["acc_x"], ("mean", "std")), ["acc_x_mean", "acc_x_std"])


def planar(spark, d):
    """The first two dimensions of every vector."""
    return src.table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in (0, 1)))


PLANAR = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
APART = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query("l14_dbscan", f"""WITH RECURSIVE {PLANAR},
n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON {APART} <= 0.02),
c AS (SELECT a AS id FROM n GROUP BY 1 HAVING count(*) >= 5),
e AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)),
r AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a),
k AS (SELECT id, min(root) AS cluster FROM r GROUP BY 1),
j AS (SELECT n.a AS id, min(k.cluster) AS cluster FROM n JOIN k ON n.b = k.id GROUP BY 1)
SELECT p.id AS vec_id, coalesce(k.cluster, j.cluster) AS cluster, k.id IS NOT NULL AS core FROM p LEFT JOIN k ON p.id = k.id LEFT JOIN j ON p.id = j.id""")
def l14_dbscan(spark, d):
    return cl.dbscan(planar(spark, d), "vec_id", ["x0", "x1"], 0.02, 5)


@query("l14_k_distance_curve", f"""WITH {PLANAR},
n AS (SELECT a.id, {APART} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {APART}) AS k FROM p a, p b),
q AS (SELECT unnest(range(0, 101)) AS i),
v AS (SELECT quantile_cont(d, list_transform(range(0, 101), lambda i: 1.0 - i / 100.0)) AS v FROM n WHERE k = 4)
SELECT CAST(i AS DOUBLE) AS percent, round(v[i + 1], 9) AS k_distance FROM q, v""")
def l14_k_distance_curve(spark, d):
    curve = cl.k_distance_curve(planar(spark, d), "vec_id", ["x0", "x1"], 4)
    return curve.withColumn("k_distance", F.round("k_distance", 9))


@query("l14_hdbscan")
def l14_hdbscan(spark, d):
    return hierarchy.hdbscan(planar(spark, d), "vec_id", ["x0", "x1"], 5)


@query("l14_agglomerative")
def l14_agglomerative(spark, d):
    f = st.frame(src.samples(spark, d), ["acc_x"], ("mean", "std", "max"))
    return cl.agglomerative(f, "sequence_id", ["acc_x_mean", "acc_x_std", "acc_x_max"], 4, "ward")[0]


@query("l14_merge_table")
def l14_merge_table(spark, d):
    f = st.frame(src.samples(spark, d), ["acc_x"], ("mean", "std", "max"))
    return cl.agglomerative(f, "sequence_id", ["acc_x_mean", "acc_x_std", "acc_x_max"], 4, "average", 500)[1]


@query("l18_boosted_trees")
def l18(spark, d):
    f, names = features(spark, d)
    f = f.withColumn("y", (F.col("sequence_type") == "Target").cast("double"))
    return ml.boosted(f, names, "y", 20).transform(f).select("sequence_id", "prediction")


@query("a07_augmentor")
def a07(spark, d):
    return au.augmented(src.samples(spark, d), ["acc_x"])


def drawn_sql(*what: str) -> str:
    """A draw of augment.draw as SQL; columns come in parentheses."""
    text = " || ':' || ".join(["CAST(sequence_id AS VARCHAR)", *(w if w[0] == "(" else f"'{w}'" for w in what)])
    return f"((CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)"


def normal_sql(*what: str) -> str:
    return f"(sqrt(-2 * ln({drawn_sql(*what, 'r')})) * cos(2 * pi() * {drawn_sql(*what, 'a')}))"


ROW = "(CAST(sequence_counter AS VARCHAR))"
SIZED = "s AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY sequence_counter) - 1 AS i, count(*) OVER (PARTITION BY sequence_id) AS n, stddev_pop(acc_x) OVER (PARTITION BY sequence_id) AS dev FROM samples)"
HIDDEN = f"i - floor({drawn_sql('temporal_mask', '0', '42')} * (n - greatest(1, floor(n * 0.1)) + 1))"
#: The cubic through four knots, by Lagrange; the sequences of the table have four rows and more.
WARP = " + ".join(
    "(" + " * ".join(f"(u - {m}) / ({j} - {m})::DOUBLE" for m in range(4) if m != j) + f") * (1 + 0.2::DOUBLE * {normal_sql('magnitude_warp', 'acc_x', str(j), '42')})" for j in range(4)
)
AUGMENTED = {
    "jitter": f"acc_x + 0.03::DOUBLE * {normal_sql('jitter', 'acc_x', ROW, '42')}",
    "gaussian_noise": f"acc_x + 0.05::DOUBLE * CASE WHEN dev = 0 THEN 1 ELSE dev END * {normal_sql('gaussian_noise', 'acc_x', ROW, '42')}",
    "scaling": f"acc_x * (1 + 0.1::DOUBLE * {normal_sql('scaling', '42')})",
    "temporal_mask": f"CASE WHEN {HIDDEN} >= 0 AND {HIDDEN} < greatest(1, floor(n * 0.1)) THEN 0 ELSE acc_x END",
    "channel_drop": f"CASE WHEN {drawn_sql('channel_drop', 'acc_x', '42')} < 0.1 THEN 0 ELSE acc_x END",
    "magnitude_warp": f"acc_x * ({WARP})",
}
TURNED = {"quaternion_flip": ("-{c}", "{c}"), "sensor_drop": tuple(f"CASE WHEN {drawn_sql('sensor_drop', k, '42')} < 0.3 THEN 0 ELSE {{c}} END" for k in ("rot", "acc"))}

for _kind in au.AUGMENTATIONS:
    _sql, _cte = None, None
    if _kind in AUGMENTED:
        _sql = f"WITH {SIZED}, k AS (SELECT *, i * 3 / (n - 1)::DOUBLE AS u FROM s) SELECT sequence_id, sequence_counter, phase, round({AUGMENTED[_kind]}, 6) + 0.0 AS acc_x FROM k"
        _cte = "samples"
    elif _kind in TURNED:
        _names = [(f"rot_{c}", TURNED[_kind][0]) for c in "wxyz"] + [(f"acc_{c}", TURNED[_kind][1]) for c in "xyz"]
        _sql, _cte = "SELECT sequence_id, sequence_counter, " + ", ".join(f"round({how.format(c=n)}, 6) + 0.0 AS {n}" for n, how in _names) + " FROM quats", "quats"

    @query(f"a_{_kind}", *([_sql, _cte] if _sql else []))
    def a(spark, d, kind=_kind):
        if kind in TURNED:
            names = ["acc_x", "acc_y", "acc_z", "rot_w", "rot_x", "rot_y", "rot_z"]
            out = au.augmented(src.quats(spark, d), names, [kind], 1.0, 1.0)
        else:
            names, out = ["acc_x"], au.augmented(src.samples(spark, d), ["acc_x"], [kind], 1.0, 1.0)
        return out.withColumns({n: F.round(n, 6) + 0.0 for n in names})


@query("a08_mixup", f"""WITH f AS (SELECT sequence_id, avg(acc_x) AS m, stddev_pop(acc_x) AS s FROM samples GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY {drawn_sql('order', '42')}, sequence_id) AS i, count(*) OVER () AS n, {drawn_sql('share', '42')} * 0.2::DOUBLE AS share FROM f)
SELECT a.sequence_id, b.sequence_id AS partner, round((1 - a.share) * a.m + a.share * b.m, 6) + 0.0 AS acc_x_mean, round((1 - a.share) * a.s + a.share * b.s, 6) + 0.0 AS acc_x_std
FROM o a JOIN o b ON a.i = CASE WHEN b.i = 1 THEN b.n ELSE b.i - 1 END""", "samples")
def a08(spark, d):
    names = ["acc_x_mean", "acc_x_std"]
    out = au.mixup(st.frame(src.samples(spark, d), ["acc_x"], ("mean", "std")), names)
    return out.withColumns({n: F.round(n, 6) + 0.0 for n in names})


@query("a08_cutmix")
def a08_cutmix(spark, d):
    return au.cutmix(src.samples(spark, d), ["acc_x"])


@query("a09_tabular_noise", f"WITH f AS (SELECT sequence_id, avg(acc_x) AS m FROM samples3 GROUP BY 1) SELECT sequence_id, round(m + 0.01::DOUBLE * {normal_sql('noisy', 'acc_x_mean', '42')}, 6) + 0.0 AS acc_x_mean FROM f", "samples3")
def a09(spark, d):
    return au.noisy(st.frame(src.samples3(spark, d), ["acc_x"], ("mean",)), ["acc_x_mean"]).withColumn("acc_x_mean", F.round("acc_x_mean", 6) + 0.0)


@query("pipeline_frame", """WITH m AS (SELECT *, 1 / CAST(20 AS DOUBLE) AS dt FROM samples3), c AS (SELECT *, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS mag, coalesce(acc_x - lag(acc_x) OVER (PARTITION BY sequence_id ORDER BY sequence_counter), 0) / dt AS jerk FROM m)
SELECT sequence_id, round(avg(mag), 6) AS acc_mag_mean, round(stddev_pop(jerk), 5) AS jerk_std, max(acc_y) AS acc_y_max FROM c GROUP BY 1""", "samples3")
def pipeline_frame(spark, d):
    f = SensorPipeline().frame(src.samples3(spark, d))
    return f.select("sequence_id", F.round("acc_mag_mean", 6).alias("acc_mag_mean"), F.round("acc_x_jerk_std", 5).alias("jerk_std"), "acc_y_max")


@query("pipeline_reckoning", f"WITH {RECKONED} SELECT sequence_id, round(avg(v), 7) + 0.0 AS acc_x_dr_vel_mean, round(avg(p), 7) + 0.0 AS acc_x_dr_pos_mean, round(max(p), 7) + 0.0 AS acc_x_dr_pos_max FROM d GROUP BY 1", "samples")
def pipeline_reckoning(spark, d):
    f = SensorPipeline(acc=["acc_x"], acc_modes="dead_reckoning", magnitude=False, crop=None).frame(src.samples(spark, d))
    return f.select("sequence_id", *((F.round(n, 7) + 0.0).alias(n) for n in ("acc_x_dr_vel_mean", "acc_x_dr_pos_mean", "acc_x_dr_pos_max")))


@query("pipeline_depth", """WITH b AS (SELECT *, lag(grid) OVER (PARTITION BY sequence_id ORDER BY sequence_counter) AS before, list_filter(grid, lambda p: p <> -1) AS v, list_transform(grid, lambda p: CASE WHEN p = -1 THEN 255::DOUBLE ELSE p END) AS filled FROM grids)
SELECT sequence_id, round(avg(coalesce(list_avg(v), 0)), 5) + 0.0 AS tof_pooled_valid_mean_mean, round(avg(len(v) / 64.0::DOUBLE), 6) + 0.0 AS tof_pooled_valid_fraction_mean,
  round(max(CASE WHEN grid[10] <> -1 AND before[10] <> -1 THEN grid[10] - before[10] ELSE 0 END), 6) + 0.0 AS grid_difference_9_max,
  round(avg(list_sum(list_transform(filled, lambda p: p * p)) * 64), -2) + 0.0 AS grid_power
FROM b GROUP BY 1""", "grids")
def pipeline_depth(spark, d):
    """All depth modes in one plan; the sum of the spectrum's two parts is that of the squares."""
    steps = src.grids(spark, d).select("sequence_id", "sequence_counter", "grid", F.lit(0.0).alias("acc_x"))
    kinds = "pooled_stats|difference|fft|haar|singular_values|blob"
    f = SensorPipeline(acc=["acc_x"], acc_modes="raw", magnitude=False, grids=["grid"], depth_modes=kinds, crop=None, frame_stats=("mean", "max")).frame(steps)
    names = {"tof_pooled_valid_mean_mean": 5, "tof_pooled_valid_fraction_mean": 6, "grid_difference_9_max": 6}
    power = F.round(F.col("grid_fft_low_mean") + F.col("grid_fft_high_mean"), -2) + 0.0
    return f.select("sequence_id", *((F.round(n, k) + 0.0).alias(n) for n, k in names.items()), power.alias("grid_power"))


@query("pipeline_chunks")
def pipeline_chunks(spark, d):
    c = SensorPipeline(acc=["acc_x"], acc_modes="raw|jerk", magnitude=False).chunks(src.samples(spark, d), 32, 16)
    return c.select("sequence_id", "chunk_idx", "start", F.size(F.filter("mask", lambda m: m)).alias("valid"), F.size("features").alias("rows"))


@query("pipeline_rotation")
def pipeline_rotation(spark, d):
    return SensorPipeline(acc_modes="raw", rotation_modes="quaternion|euler|delta_euler|angular_velocity|rot6d", linear_acceleration="world").frame(src.quats(spark, d))


@query("pipeline_all_sensors", """WITH t AS (SELECT sequence_id, sequence_counter, thm_1 - avg(thm_1) OVER (PARTITION BY sequence_id) AS c, coalesce(thm_2 - lag(thm_2) OVER (PARTITION BY sequence_id ORDER BY sequence_counter), 0) AS s FROM thermo),
g AS (SELECT sequence_id, sequence_counter, list_avg(list_transform(grid, lambda p: CASE WHEN p = -1 THEN 255::DOUBLE ELSE p END)) AS m FROM grids)
SELECT q.sequence_id, round(avg(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z)), 6) + 0.0 AS acc_mag_mean, round(stddev_pop(c), 6) + 0.0 AS thm_1_centered_std, round(max(s), 6) + 0.0 AS thm_2_diff_max, round(avg(m), 4) + 0.0 AS grid_imputed_mean_mean
FROM quats q JOIN t USING (sequence_id, sequence_counter) JOIN g USING (sequence_id, sequence_counter) GROUP BY 1""", "quats thermo grids")
def pipeline_all_sensors(spark, d):
    """Motion, rotation, depth and temperature of every step, and spectra, in one plan."""
    keys = ["sequence_id", "sequence_counter"]
    steps = src.quats(spark, d).join(src.thermo(spark, d), keys).join(src.grids(spark, d).drop("vec_id"), keys)
    p = SensorPipeline(
        acc_modes="raw|velocity|jerk|dead_reckoning", rotation_modes="quaternion|angular_velocity", linear_acceleration="world", grids=["grid"], depth_modes="stats|regions|motion",
        thermo=[f"thm_{i}" for i in range(1, 6)], thermo_modes="centered|diff|mean", global_context=True, stft={}, cwt={"n_scales": 8, "max_scale": 16.0}, crop=None,
    )
    names = {"acc_mag_mean": 6, "thm_1_centered_std": 6, "thm_2_diff_max": 6, "grid_imputed_mean_mean": 4}
    return p.frame(steps).select("sequence_id", *((F.round(n, k) + 0.0).alias(n) for n, k in names.items()))


@query("l08_kernel_features")
def l08(spark, d):
    return sp.kernel_features(src.samples(spark, d), "acc_x")


@query("l08_rocket_features")
def l08_rocket(spark, d):
    """Learnt biases and four pooled numbers a kernel, on the sequences of all users."""
    samples = src.samples(spark, d)
    return rocket.transform(samples, "acc_x", rocket.fit(samples, "acc_x", most_dilations=3))


for _kind in ("logistic", "svm", "ridge"):

    @query(f"l08_linear_{_kind}")
    def l08_linear(spark, d, kind=_kind):
        """A linear classifier on kernel features of the orders' sequences."""
        f = sp.kernel_features(src.samples3(spark, d), "acc_x", (1,))
        y = src.sequences(spark, d).select("sequence_id", "sequence_type")
        return ml.linear(cut(f.join(y, "sequence_id")), "features", "sequence_type", kind).select("sequence_id", "prediction")


SPACE = {"numTrees": [5, 10, 20], "maxDepth": [2, 3, 4], "minInstancesPerNode": [1, 5]}


def folded(spark, d):
    f, names = features(spark, d)
    return lb.folds(f.withColumn("y", (F.col("sequence_type") == "Target").cast("double")), "sequence_id", 3), names


for _kind in ("sgd", "pa"):

    @query(f"l08_online_{_kind}")
    def l08_online(spark, d, kind=_kind):
        f, names = features(spark, d)
        f = f.withColumn("x", F.array(*(F.coalesce(F.col(n), F.lit(0.0)) / 50 for n in names)))
        machine = machines.trained(f, "x", "sequence_type", "sequence_id", kind, rounds=3, rate=0.05)
        return machines.predicted(f, "x", machine).select("sequence_id", "prediction")


@query("l18_radial_machine")
def l18_radial(spark, d):
    f, names = features(spark, d)
    f = f.select("sequence_id", "sequence_type", F.array(*(F.coalesce(F.col(n), F.lit(0.0)) / 50 for n in names)).alias("x"))
    return machines.radial_machine(f, "x", "sequence_type", 64).select("sequence_id", "prediction")


@query("l18_cascade_forest")
def l18_cascade(spark, d):
    f, names = folded(spark, d)
    return cascade.cascade(f, names, "sequence_type", "fold", most_layers=2, trees=5, depth=4, kept=["sequence_id"])[0].select("sequence_id", "prediction")


@query("l16_random_search")
def l16_random(spark, d):
    f, names = folded(spark, d)
    return search.random_search(f, names, "y", "fold", SPACE, 4)


@query("l16_bayesian_search")
def l16_bayesian(spark, d):
    f, names = folded(spark, d)
    return search.bayesian_search(f, names, "y", "fold", SPACE, n=4, batch=2)


@query("l16_genetic_search")
def l16_genetic(spark, d):
    f, names = folded(spark, d)
    return search.genetic_search(f, names, "y", "fold", SPACE)


@query("l16_grid_search")
def l16(spark, d):
    f, names = folded(spark, d)
    return ml.grid_search(f, names, "y", "fold", (3, 5), (10, 20))

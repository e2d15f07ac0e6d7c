"""Sequence classifiers, projections and clusterings on feature tables, with pyspark.ml."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRestModel, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.shared import a_file_a_partition, cut, drop_cut

from . import scoring


#: Rows of a partition while a model is fitted: forests keep a row's draw of every tree in memory.
FIT_ROWS = 250_000


#: Features up to which FIT_ROWS rows make a partition; of wider rows, one holds as many fewer.
FIT_WIDTH = 64


def spread(df: DataFrame, width: int = 1) -> DataFrame:
    """df in partitions of about FIT_ROWS rows (of `width` features each), where the table is so large that those are more
    than the cluster's cores; a scan packs files by bytes, whatever a fit makes of their rows."""
    n = -(-df.count() * max(width, FIT_WIDTH) // (FIT_ROWS * FIT_WIDTH))
    return df.repartition(n) if n > df.sparkSession.sparkContext.defaultParallelism else df


def assembled(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep").transform(df)


def forest(df: DataFrame, names: list[str], label: str, trees: int = 100, depth: int = 8, seed: int = 42) -> PipelineModel:
    """Random forest with balanced class weights; predictions come back as labels."""
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(df)
    rf = RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="class_weight", numTrees=trees, maxDepth=depth, seed=seed, predictionCol="_prediction")
    back = IndexToString(inputCol="_prediction", outputCol="prediction", labels=index.labels)
    return Pipeline(stages=[index, VectorAssembler(inputCols=names, outputCol="_features"), rf, back]).fit(scoring.balanced_weights(spread(df.select(label, *names)), label))


def boosted(df: DataFrame, names: list[str], label: str, rounds: int = 20, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees for a 0/1 label."""
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_features"), GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, seed=seed)]).fit(spread(df.select(label, *names)))


def linear(df: DataFrame, features: str, label: str, kind: str = "logistic", penalty: float = 0.01, expand=None) -> DataFrame:
    """df plus `prediction`, fitted on df itself: a linear classifier on an array column. Kinds: logistic (multinomial),
    svm (hinge loss, one class against the rest), ridge (least squares on the signs of the classes; highest value wins).

    A fit reads its rows many times, so equal rows are one row with their number as its weight, in a written table. The
    solvers keep what they learn from in blocks, in memory, on disk what doesn't fit; nothing is persisted beside those, and
    rows come in partitions of bounded size, since a task holds much of one while it makes its blocks.
    `expand` (a function of frames) may add an array column `_expanded` made from `features`, which then is learnt from."""
    expand = expand or (lambda d: d.withColumn("_expanded", F.col(features)))
    vectors = lambda d: expand(d).withColumn("_features", array_to_vector("_expanded"))
    rows = shared_out(cut(df.groupBy(F.col(features), F.col(label)).agg(F.count("*").cast("double").alias("_weight"))), "_weight")
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    out, back = vectors(df), IndexToString(inputCol="_prediction", outputCol="prediction", labels=index.labels)
    width = expand(rows.limit(1)).agg(F.max(F.size("_expanded"))).first()[0] or 0
    models = linear_models(vectors(index.transform(spread(rows, width))), "_weight", kind, penalty, len(index.labels))
    for model in models:
        out = model.transform(out)
    if kind == "ridge":
        values = F.array(*(F.col(f"_value{i}") for i in range(len(models))))
        out = out.withColumn("_prediction", (F.array_position(values, F.array_max(values)) - 1).cast("double"))
    return back.transform(out).select(*df.columns, "prediction")


#: Equal rows stay several rows where they are more than this share of all.
LEAST_SHARE = 1e-4


def shared_out(rows: DataFrame, weight: str) -> DataFrame:
    """rows with whole weights as rows of at most LEAST_SHARE of all weights (or 1): the variances that the solvers take
    of them, and with those the steps they go, are then all but those of the repeated rows."""
    most = F.lit(max(1.0, LEAST_SHARE * (rows.agg(F.sum(weight)).first()[0] or 0.0)))
    parts = F.ceil(F.col(weight) / most)
    return rows.withColumn("_part", F.explode(F.sequence(F.lit(1).cast("long"), parts))).withColumn(weight, F.col(weight) / parts).drop("_part")


def linear_models(rows: DataFrame, weight: str, kind: str, penalty: float, classes: int) -> list:
    """The model of `_features` and `_label`, or for ridge a model a class; rows count as often as their weight says.

    The solvers that standardise features divide their squares by weights - squared weights / weights, not by rows - 1.
    That is one factor for all features, so a penalty divided by it gives what the repeated rows would."""
    total, squares = rows.agg(F.sum(weight), F.sum(F.col(weight) * F.col(weight))).first()
    free = (total or 0.0) - (squares or 0.0) / (total or 1.0)
    factor = (total - 1) / free if free > 0 and total > 1 else 1.0
    how = {"featuresCol": "_features", "weightCol": weight}
    if kind == "logistic":
        return [LogisticRegression(labelCol="_label", predictionCol="_prediction", regParam=penalty / factor, **how).fit(rows)]
    if kind == "svm":
        # OneVsRest would persist the features beside the blocks that the machines keep of them
        machine = LinearSVC(labelCol="_one", regParam=penalty / factor, maxIter=20, **how)
        one = lambda i: rows.withColumn("_one", F.when(F.col("_label") == i, 1.0).otherwise(0.0))
        return [OneVsRestModel([machine.fit(one(i)) for i in range(classes)]).setFeaturesCol("_features").setPredictionCol("_prediction")]
    if kind == "ridge":
        few = features_few(rows, "_expanded")  # the normal equations divide by the weights alone
        how |= {"labelCol": "_sign", "regParam": penalty if few else penalty / factor**0.5, "solver": "normal" if few else "l-bfgs"}
        signed = lambda i: rows.withColumn("_sign", F.when(F.col("_label") == i, 1.0).otherwise(-1.0))
        return [LinearRegression(predictionCol=f"_value{i}", **how).fit(signed(i)) for i in range(classes)]
    raise ValueError(f"unknown kind {kind!r}")


def features_few(df: DataFrame, features: str) -> bool:
    """Whether the normal equations of an array column fit the solver's limit of 4096."""
    return (df.agg(F.max(F.size(features))).first()[0] or 0) < 4096


def selected(df: DataFrame, names: list[str], label: str, percentile: float = 0.5) -> list[str]:
    """The share of features with the largest ANOVA F against a numeric class label."""
    s = UnivariateFeatureSelector(featuresCol="features", labelCol=label, outputCol="_s", selectionMode="percentile")
    model = s.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(percentile).fit(assembled(df, names))
    return [names[i] for i in model.selectedFeatures]


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, centroid): mean vector per class, summed place by place so that no class is gathered."""
    places = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return places.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, vector: str, prototypes: DataFrame, label: str, block: int = 1000) -> DataFrame:
    """df plus the class of the nearest prototype (of equal distances the first label), its squared distance and its
    softmax probability. The prototypes, one a class, meet the rows in blocks: each is a table of one row with about
    `block` of them, small enough to be broadcast whatever the number of classes. No prototypes give nulls."""
    blocks = -(-prototypes.count() // block)
    tables = prototypes.select(label, "centroid", F.pmod(F.xxhash64(label), F.lit(max(1, blocks))).alias("_b"))
    tables = cut(tables.groupBy("_b").agg(F.collect_list(F.struct(F.col("centroid").alias("c"), F.col(label).alias("label"))).alias("_p")))
    squared = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    kind = f"struct<d:double,label:{prototypes.schema[label].dataType.simpleString()}>"
    df = df.withColumns({"_best": F.lit(None).cast(kind), "_sum": F.lit(0.0)})
    for b in sorted(r["_b"] for r in tables.select("_b").collect()):  # a hash may leave a block empty
        df = df.join(F.broadcast(tables.where(F.col("_b") == b).select("_p")))  # one row
        df = df.withColumn("_d", F.transform("_p", lambda p: F.struct(squared(p["c"]).alias("d"), p["label"].alias("label")))).drop("_p")
        df = df.withColumn("_low", F.least("_best", F.array_min("_d")))
        own = F.aggregate("_d", F.lit(0.0), lambda s, x: s + F.exp(F.col("_low.d") - x["d"]))
        before = F.coalesce(F.col("_sum") * F.exp(F.col("_low.d") - F.col("_best.d")), F.lit(0.0))
        df = df.withColumn("_sum", before + own).withColumn("_best", F.col("_low")).drop("_d", "_low")
    found = {"nearest": F.col("_best.label"), "distance": F.col("_best.d"), "probability": F.when(F.col("_sum") > 0, 1 / F.col("_sum"))}
    return df.withColumns(found).drop("_best", "_sum")


def principal_components(df: DataFrame, names: list[str], k: int = 2) -> DataFrame:
    """df plus pc1..pck of the centred features."""
    steps = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_f"), StandardScaler(inputCol="_f", outputCol="_c", withMean=True, withStd=False), PCA(k=k, inputCol="_c", outputCol="_p")])
    out = steps.fit(df).transform(df).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({f"pc{i + 1}": F.col("_p")[i] for i in range(k)}).drop("_f", "_c", "_p")


def k_means_sweep(df: DataFrame, names: list[str], ks=(2, 3, 4), seed: int = 42) -> DataFrame:
    """(k, silhouette, cost) for several numbers of clusters."""
    x = assembled(df, names).select("features").cache()
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features").fit(x)
        rows.append((k, float(ClusteringEvaluator().evaluate(model.transform(x))), float(model.summary.trainingCost)))
    x.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, cost double")


def mixture_sweep(df: DataFrame, names: list[str], ks=(2, 3, 4), seed: int = 42) -> DataFrame:
    """(k, log_likelihood, aic, bic) of Gaussian mixtures with full covariances."""
    from math import log

    x, d = assembled(df, names).select("features").cache(), len(names)
    n, rows = x.count(), []
    for k in ks:
        ll = float(GaussianMixture(k=k, seed=seed, featuresCol="features").fit(x).summary.logLikelihood)
        free = k * (d + d * (d + 1) / 2) + k - 1
        rows.append((k, ll, 2 * free - 2 * ll, free * log(n) - 2 * ll))
    x.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, aic double, bic double")


def grid_search(df: DataFrame, names: list[str], label: str, fold: str, depths=(3, 5), trees=(10, 20), seed: int = 42) -> DataFrame:
    """(trees, depth, f1): cross-validated forests over a grid; rows of one fold number are held out together, so a fold
    column by sequence or subject keeps groups whole. `label` is numeric."""
    points = [{"maxDepth": d, "numTrees": t} for d in depths for t in trees]
    with cross_validated(df, names, label, fold, seed) as score:
        rows = [(p["numTrees"], p["maxDepth"], s) for p, s in zip(points, score(points))]
    return df.sparkSession.createDataFrame(rows, "trees int, depth int, f1 double").orderBy(F.desc("f1"), "trees", "depth")


@contextmanager
def cross_validated(df: DataFrame, names: list[str], label: str, fold: str, seed: int = 42):
    """score(points): the mean f1 of forests at each point of a space that names parameters of the forest. Rows of one
    fold number are held out together. A forest keeps a row for each of its own in memory, and on disk what doesn't fit, so
    one is fitted after the other, none to all folds, and the table isn't kept beside them: it is a written one, read
    in its small partitions, and deleted at the end."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed)
    metric = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    rows = cut(spread(df.select(*names, label, fold)))
    x = assembled(rows, names).select("features", label, fold)
    folds = sorted(r[0] for r in x.select(fold).distinct().collect())

    def score(points: list[dict]) -> list[float]:
        sums = [0.0] * len(points)
        for f in folds:
            train, held = x.where(F.col(fold) != f), x.where(F.col(fold) == f)
            for i, p in enumerate(points):
                model = rf.fit(train, {rf.getParam(k): v for k, v in p.items()})
                sums[i] += float(metric.evaluate(model.transform(held)))
        return [s / len(folds) for s in sums]

    with a_file_a_partition(df.sparkSession):
        try:
            yield score
        finally:
            drop_cut(rows)

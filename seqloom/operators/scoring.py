"""Classification scores, class weights and pooled predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of every label that is true or predicted somewhere."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).count()
    both = F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("t") != F.col("p"), F.col("count")).otherwise(0).alias("fn")),
                   F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col("t") != F.col("p"), F.col("count")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))
    by = pairs.select(F.explode(both).alias("x")).groupBy(F.col("x.label").alias("label")).agg(*(F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return by.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn")), "f1": safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def macro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return class_counts(df, truth, pred).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def competition_score(df: DataFrame, truth: str, pred: str, other: str = "non_bfrb") -> DataFrame:
    """Mean of the F1 of target against other, and the macro F1 over the rows whose truth is a target."""
    flags = df.withColumns({"_t": (F.col(truth) != other).cast("int"), "_p": (F.col(pred) != other).cast("int")})
    binary = flags.agg(F.sum(F.col("_t") * F.col("_p")).alias("tp"), F.sum("_t").alias("t"), F.sum("_p").alias("p"))
    binary = binary.select(F.coalesce(F.when(F.col("t") + F.col("p") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p"))), F.lit(0.0)).alias("binary_f1"))
    both = binary.unionByName(macro_f1(flags.where("_t = 1"), truth, pred), allowMissingColumns=True)
    both = both.agg(F.max("binary_f1").alias("binary_f1"), F.max("macro_f1").alias("macro_f1"))
    return both.withColumn("score", (F.col("binary_f1") + F.col("macro_f1")) / 2)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """df plus class_weight: rows / (classes * rows of the class), from one small aggregate. The aggregate is broadcast: a
    shuffle by label would put all rows of a class in one task."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    n = n.withColumn("class_weight", F.sum("_n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("_n"))).drop("_n")
    return df.join(F.broadcast(n), label)


def pooled_predictions(df: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """Mean probability per class over the chunks of a sequence and the first class of the highest."""
    p = df.groupBy(key).agg(*(F.avg(c).alias(c) for c in classes))
    xs = F.array(*classes)
    return p.withColumn("prediction", F.element_at(F.array(*map(F.lit, classes)), F.array_position(xs, F.array_max(xs)).cast("int")))


def first_label(labels: DataFrame, key: str, names: list[str], order: str) -> DataFrame:
    """One row per key: the labels of its first row."""
    return labels.groupBy(key).agg(*(F.min_by(n, order).alias(n) for n in names))


def aligned(features: DataFrame, labels: DataFrame, key: str, defaults: dict[str, str], keep_unmatched: bool = True) -> DataFrame:
    """Labels for every feature row, with defaults where none is known (or without the row)."""
    out = features.join(labels, key, "left" if keep_unmatched else "inner")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}) if keep_unmatched else out


def nearest_mean(means: DataFrame, label: str) -> DataFrame:
    """One row with `_means`: structs of mean and label. A row per class comes together, so classes must be few."""
    return means.agg(F.collect_list(F.struct(F.col("m"), F.col(label).alias("label"))).alias("_means"))


def routed(df: DataFrame, x: str, binary: DataFrame, target: str, branches: DataFrame, leaves: DataFrame, other: str) -> DataFrame:
    """df's rows through three stages of nearest-mean models on x: rows that the binary model doesn't take for `target`
    become `other`; the rest go to a branch, then to the leaf model of that branch. Models are tables of class means
    (binary: sequence_type, m; branches: orientation, m; leaves: orientation, gesture, m); ties go to the first label."""
    def nearest(means, label):
        return F.array_min(F.transform(means, lambda s: F.struct(F.abs(F.col(x) - s["m"]).alias("d"), s["label"].alias("label"))))["label"]
    models = nearest_mean(binary, "sequence_type").withColumnRenamed("_means", "_binary")
    models = models.join(nearest_mean(branches, "orientation").withColumnRenamed("_means", "_branch"))  # one row each
    leaf = leaves.groupBy("orientation").agg(F.collect_list(F.struct(F.col("m"), F.col("gesture").alias("label"))).alias("_leaf"))
    out = df.join(F.broadcast(models)).withColumns({"_t": nearest("_binary", "sequence_type"), "orientation": nearest("_branch", "orientation")})
    out = out.join(leaf, "orientation", "left").withColumn("prediction", F.when(F.col("_t") != target, other).otherwise(nearest("_leaf", "gesture")))
    return out.select("sequence_id", "prediction")

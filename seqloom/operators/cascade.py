"""Cascade forests: layers of random forests, each of which sees the class vectors that the layer before gave to rows it
hadn't learnt from."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorSizeHint, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.shared import cut, small_partitions

from .models import assembled

#: Forests of a layer: how many features a split may look at.
KINDS = ("sqrt", "onethird")


def _forest(strategy: str, trees: int, depth: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy=strategy, predictionCol="_p", probabilityCol="_v", rawPredictionCol="_r"
    )


def _class_vectors(train: DataFrame, rows: DataFrame, names: list[str], classes: int, layer: int, trees: int, depth: int, seed: int) -> DataFrame:
    """rows plus c<layer>_<kind>_<class>: the probabilities that forests fitted on train give. Both hold names as a vector `_x`."""
    sized = VectorSizeHint(inputCol="_x", size=len(names), handleInvalid="optimistic")
    train, rows = sized.transform(train), sized.transform(rows)
    for i, strategy in enumerate(KINDS):
        found = _forest(strategy, trees, depth, seed + i).fit(train).transform(rows).withColumn("_v", vector_to_array("_v"))
        rows = found.withColumns({f"c{layer}_{i}_{c}": F.col("_v")[c] for c in range(classes)}).drop("_r", "_v", "_p")
    return rows


def cascade(
    df: DataFrame, names: list[str], label: str, fold: str, most_layers: int = 4, trees: int = 20, depth: int = 6, least_gain: float = 0.0, seed: int = 42, kept: list[str] | None = None
) -> tuple[DataFrame, list[float]]:
    """df (its columns `kept`, or all) plus `prediction` (of rows that the forests behind it hadn't learnt from), and the
    accuracy of each layer.

    In a layer every fold's rows get class vectors from forests fitted on the other folds; they join the features of the
    next layer. So no row sees a forest that has seen its own fold (fold: a column by sequence or subject keeps groups
    whole). Layers end when the accuracy doesn't grow by more than least_gain; the best layer's mean class vector
    decides, the first class in alphabetical order of equal ones. Rows without a label are left out; null and unknown
    features count as not a number; fewer than two folds are an error.

    Each layer is a written table with a folder a fold (`_f`), so that a fit reads the files of the other folds only. It
    holds the features as one vector: a forest goes through its rows three times before it keeps them.
    """
    known, kept = df.where(F.col(label).isNotNull()), df.columns if kept is None else kept
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(known)
    classes, seen, scores, best = len(index.labels), list(names), [], None
    own_names = VectorSlicer(inputCol="_x", outputCol="_own", indices=list(range(len(names))))
    with small_partitions(df.sparkSession):
        vectors = assembled(index.transform(known), names, "_x").withColumn("_f", F.concat(F.lit("f"), F.col(fold).cast("string")))
        state = cut(vectors.select(*dict.fromkeys([*kept, fold]), "_y", "_x", "_f"), "_f")
        folds = [r["_f"] for r in sorted(state.select(fold, "_f").distinct().collect())]
        if len(folds) < 2:
            raise ValueError("a cascade needs two folds at least")
        for layer in range(most_layers):
            own = [f"c{layer}_{i}_{c}" for i in range(len(KINDS)) for c in range(classes)]
            parts = [_class_vectors(state.where(F.col("_f") != f), state.where(F.col("_f") == f), seen, classes, layer, trees, depth, seed + 10 * layer) for f in folds]
            out, seen = parts[0], names + own
            for part in parts[1:]:
                out = out.unionByName(part)
            means = F.array(*(sum((F.col(f"c{layer}_{i}_{c}") for i in range(1, len(KINDS))), F.col(f"c{layer}_0_{c}")) for c in range(classes)))
            out = out.withColumn(f"_p{layer}", F.array_position(means, F.array_max(means)) - 1)
            if layer + 1 < most_layers:
                out = assembled(own_names.transform(out).drop("_x"), ["_own", *own], "_x")
            else:
                out = out.drop("_x")
            state = cut(out.drop("_own", *own), "_f")
            scores.append(float(state.agg(F.avg((F.col(f"_p{layer}") == F.col("_y")).cast("double"))).first()[0]))
            if best is not None and scores[-1] <= scores[best] + least_gain:
                break
            best = layer
    named = F.element_at(F.array(*map(F.lit, index.labels)), (F.col(f"_p{best}") + 1).cast("int"))
    return state.select(*kept, named.alias("prediction")), scores

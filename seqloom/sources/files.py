"""File sources and sinks with stated schemas."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

D, S = T.DoubleType(), T.StringType()


def sample_schema(pixels: bool = True) -> T.StructType:
    """A row per time step: keys, labels, motion, orientation, temperature and depth columns."""
    names = ["row_id", "sequence_type", "sequence_id"]
    fields = [T.StructField(n, S) for n in names] + [T.StructField("sequence_counter", T.LongType())]
    fields += [T.StructField(n, S) for n in ("subject", "orientation", "behavior", "phase", "gesture")]
    numbers = [f"acc_{c}" for c in "xyz"] + [f"rot_{c}" for c in "wxyz"] + [f"thm_{i}" for i in range(1, 6)]
    numbers += [f"tof_{s}_v{p}" for s in range(1, 6) for p in range(64)] if pixels else []
    return T.StructType(fields + [T.StructField(n, D) for n in numbers])


def demographics_schema() -> T.StructType:
    whole = [T.StructField(n, T.IntegerType()) for n in ("adult_child", "age", "sex", "handedness")]
    return T.StructType([T.StructField("subject", S), *whole, *(T.StructField(n, D) for n in ("height_cm", "shoulder_to_wrist_cm", "elbow_to_wrist_cm"))])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def with_grids(df: DataFrame, sensors: int = 5) -> DataFrame:
    """The pixel columns of each sensor as one array, in the order of their numbers."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    for s in range(1, sensors + 1):
        names = [f"tof_{s}_v{p}" for p in range(64)]
        if have.issuperset(names):
            df = df.withColumn(f"tof_{s}", F.array(*names)).drop(*names)
    return df


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, clustered by sequence where there is one, partitioned by a column of few values where named."""
    if "sequence_id" in df.columns:
        df = df.sortWithinPartitions("sequence_id")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_results(df: DataFrame, path: str, kind: str = "csv") -> None:
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown kind {kind!r}")
    getattr(df.write.mode("overwrite").option("header", True), kind)(path)


def cached_features(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made and written first where it isn't there yet."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
        write_table(make(), path)
    return spark.read.parquet(path)


def find_data_root(spark: SparkSession, needed: tuple[str, ...] = ("train.csv",), places: tuple[str, ...] = (), named: str = "data") -> str:
    """The first folder that holds all `needed` files: the working folder and those above it, each also with `named`
    below it, then `places` and the folders directly in them. Any file system that Spark reads will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path

    def children(place: str) -> list[str]:
        path = make(place)
        system = path.getFileSystem(conf)
        return sorted(f.getPath().toString() for f in system.listStatus(path) if f.isDirectory()) if system.exists(path) else []

    here = [Path.cwd(), *Path.cwd().parents]
    for folder in [*(str(p) for h in here for p in (h / named, h)), *(x for p in places for x in (p, *children(p)))]:
        paths = [make(folder, n) for n in needed]
        if all(p.getFileSystem(conf).exists(p) for p in paths):
            return folder
    raise FileNotFoundError(f"no folder holds {', '.join(needed)}")


def save_model(model, path: str, features: list[str], **notes) -> None:
    """A fitted pyspark.ml model, and beside it the features it expects (in order) and notes about it as one JSON row."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    row = json.dumps({"features": features, **notes}, sort_keys=True)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str):
    """(model, what save_model noted)."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/about").first().value)


def collect_bundle(archive: str, folder: str, needed: tuple[str, ...] = ("cv_results.csv", "holdout_results.csv", "best_results.csv")) -> list[str]:
    """Unpack a zip of result files: names that lead outside the folder are refused before anything is written, and a
    bundle without all `needed` files is an error. Returns the paths of those files."""
    with zipfile.ZipFile(archive) as bundle:
        root = Path(folder).resolve()
        for name in bundle.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{name!r} leads outside the folder")
        missing = set(needed) - {Path(n).name for n in bundle.namelist()}
        if missing:
            raise ValueError(f"the bundle lacks {sorted(missing)}")
        bundle.extractall(root)
        return [str(root / n) for n in bundle.namelist() if Path(n).name in needed]

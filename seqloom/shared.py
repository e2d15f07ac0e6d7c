"""Tables in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session takes a
    temporary folder; on a cluster, where driver and executors have disks of their own, that is an error."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="seqloom-")
    return _own_dir


@contextmanager
def conf(spark: SparkSession, key: str, value):
    """The setting `key` is `value` within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Files that a task of a table in folders has open at once.
MOST_WRITERS = 8


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors. With `by`, a
    column of few values, every value has a folder of its own, and filters by it read no other files; a task that meets
    no more than MOST_WRITERS values needn't sort its rows for that."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
    else:
        with conf(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", MOST_WRITERS):
            df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def a_file_a_partition(spark: SparkSession):
    """Scans that are run within take every file as one partition, as it was written, instead of packing files by bytes."""
    return conf(spark, "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))


def small_partitions(spark: SparkSession, times: int = 3):
    """Scans that are run within pack files into at least `times` partitions a core, as far as there are files: at one a
    core, one partition more, or one larger than the others, has the rest wait."""
    return conf(spark, "spark.sql.files.minPartitionNum", times * spark.sparkContext.defaultParallelism)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame that cut() returned, once nothing reads them any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node of an undirected edge list (src, dst).

    Edges are rewritten until they are stars, by turns: every node's larger neighbours are hung on its smallest
    neighbour (or itself), then its smaller neighbours and itself are hung on the smallest of them. Each turn is an
    aggregate and a join back on the node; only distinct edges stay. No edges give no rows; loops are ignored.
    """
    edges = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    nodes, sums = edges, None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small)
        if edges is not nodes:
            drop_cut(edges)
        # the edges are the same as before: their number and two sums of hashes are
        before, edges = sums, new
        sums = new.agg(F.count("*"), *(F.sum(F.xxhash64("u", "v", F.lit(i)).cast("decimal(38,0)")) for i in (0, 1))).first()
        if sums == before:
            break
    ends = nodes.select(F.col("u").alias("node")).union(nodes.select("v")).distinct()
    return ends.join(edges.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))

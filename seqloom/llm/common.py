"""Small helpers shared by the corpus operators: shared-folder tables, graph components and bytes columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule [^\x20\x09-\x0D]+, as a Java regex class; bytes.split() uses the same six bytes.
WORD = r"[^\x20\x09-\x0D]++"

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


#: Lets a finished write delete the shuffle files that only it needed.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors. The shuffle
    files of the write go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame that cut() returned, once nothing reads them any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of at most so many rows from now on: whole texts are long, and both sides of a Python stage hold a
    batch in memory. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_crc(doc_id="doc_id"):
    """crc32 of the id as text; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of an undirected edge list (src, dst).

    Each round takes the smallest label among the neighbours and then jumps to that label's own label, so the
    number of rounds grows with the logarithm of the longest path. Labels live in tables in the shared folder.
    Returns (node, component); no edges give no rows.
    """
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels, both.dst == labels.node).select(F.col("src").alias("node"), "component")
        low = near.union(labels.select("node", "component")).groupBy("node").agg(F.min("component").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        new = cut(
            low.join(jump, "low")
            .select("node", F.least("low", "lower").alias("component"))
            .join(labels.withColumnRenamed("component", "was"), "node")
        )
        changed = new.where("component <> was").limit(1).count()
        drop_cut(labels)
        labels = new.select("node", "component")
        if not changed:
            drop_cut(both)
            return labels

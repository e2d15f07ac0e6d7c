"""Clusterings by density and by merging, on feature tables."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.shared import components, cut

from . import neighbours as nb


def k_distances(df: DataFrame, key: str, names: list[str], k: int = 4) -> DataFrame:
    """(key, k_distance): the distance from each row to its k-th nearest row, itself counted as the first; null with fewer
    rows. Keys are unique; rows with a null key, or a null or non-finite value, are left out."""
    found = nb.nearest(nb.index(nb.points(df, key, names), len(names)), k)
    return found.select(F.col("id").alias(key), F.when(F.size("near") >= k, F.element_at("near", k)).alias("k_distance"))


def k_distance_curve(df: DataFrame, key: str, names: list[str], k: int = 4, steps: int = 100) -> DataFrame:
    """(percent, k_distance): the curve of k-distances in falling order, read at equal steps (its knee suggests eps for
    dbscan). Exact percentiles with linear interpolation; an empty table gives no rows."""
    at = [i / steps for i in range(steps + 1)]
    values = k_distances(df, key, names, k).agg(F.percentile("k_distance", F.array(*map(F.lit, reversed(at)))).alias("v"))
    return values.select(F.posexplode("v").alias("i", "k_distance")).select((F.col("i") * 100.0 / steps).alias("percent"), "k_distance")


def _counts(eps: float, dims: int):
    def work(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        n, x, y = np.zeros(len(q), np.int64), nb.matrix(q.x, dims), nb.matrix(r.x, dims)
        for lo in range(0, len(q), 512):
            n[lo : lo + 512] = (nb.distances(x[lo : lo + 512], y) <= eps).sum(axis=1)
        return pd.DataFrame({"id": q.id, "n": n})

    return work


def _links(eps: float, dims: int, other: bool):
    """Distinct pairs of a query's and a row's group that are within eps. other: only of different groups."""

    def work(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        a, own = pd.factorize(q["group"])
        b, theirs = pd.factorize(r["group"])
        x, y, found = nb.matrix(q.x, dims), nb.matrix(r.x, dims), set()
        for lo in range(0, len(q) if len(r) else 0, 512):
            near = nb.distances(x[lo : lo + 512], y) <= eps
            if other:
                near &= q["group"].to_numpy()[lo : lo + 512, None] != r["group"].to_numpy()[None]
            i, j = np.nonzero(near)
            found |= set(zip(*(z.tolist() for z in np.unique(np.stack([a[lo + i], b[j]]), axis=1)))) if len(i) else set()
        pairs = sorted(found)
        return pd.DataFrame({"src": [own[i] for i, _ in pairs], "dst": [theirs[j] for _, j in pairs]}, columns=["src", "dst"])

    return work


def _least_cluster(eps: float, dims: int):
    def work(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        ids, found = [], []
        r = r.sort_values("cluster", kind="stable")
        x, y = nb.matrix(q.x, dims), nb.matrix(r.x, dims)
        for lo in range(0, len(q) if len(r) else 0, 512):
            near = nb.distances(x[lo : lo + 512], y) <= eps
            some = near.any(axis=1)
            ids.append(q.id.iloc[lo : lo + 512][some])
            found.append(r.cluster.iloc[near[some].argmax(axis=1)])
        return pd.DataFrame({"id": pd.concat(ids).to_numpy(), "cluster": pd.concat(found).to_numpy()}) if ids else pd.DataFrame({"id": q.id[:0], "cluster": r.cluster[:0]})

    return work


def dbscan(df: DataFrame, key: str, names: list[str], eps: float, min_samples: int = 5) -> DataFrame:
    """(key, cluster, core): density clusters. A row is core if min_samples rows, itself included, are within eps; core
    rows within eps of each other are in one cluster, named by its smallest core key; another row joins the smallest
    named cluster that has a core row within eps, or is noise (null).

    Cells whose diagonal is eps hold rows that are all within eps of each other. A cell of min_samples rows is core
    as a whole and asks for no neighbours, so only rows of thin cells are compared. Cells with core rows are what gets
    linked: first from a few rows of each (the outermost in every dimension), then, from every core row, to the leaves of
    the index that hold rows of other components. No list of the pairs within a dense group is ever made.
    Keys are unique. Rows with a null key, or a null or non-finite value, are left out; an empty table gives no rows.
    """
    if not eps > 0 or min_samples < 1:
        raise ValueError("eps and min_samples must be positive")
    dims, kind = len(names), df.schema[key].dataType.simpleString()
    side = eps / sqrt(dims) * (1 - 1e-9)
    place = lambda v: v / side - F.pmod(v / side, F.lit(1.0))  # noqa: E731  floor, also beyond the range of long
    rows = nb.points(df, key, names).withColumn("cell", F.transform("x", place))
    where = nb.index(rows, dims)
    every, asking = where.points, F.lit(float(eps)).alias("radius")
    dense = every.groupBy("cell").count().where(F.col("count") >= min_samples).select("cell", F.lit(True).alias("dense"))
    marked = cut(every.join(dense, "cell", "left"))
    thin = marked.where("dense IS NULL")
    counts = nb.search(thin.select("id", "x", asking), every.select("id", "x", "leaf"), where, _counts(eps, dims), f"id {kind}, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id", F.lit(True).alias("enough"))
    marked = cut(marked.join(counts, "id", "left").withColumn("core", F.coalesce("dense", "enough", F.lit(False))))

    core = marked.where("core")
    ends = [F.min_by("x", F.col("x")[j]) for j in range(dims)] + [F.max_by("x", F.col("x")[j]) for j in range(dims)]
    cells = cut(core.groupBy("cell").agg(F.min("id").alias("group"), F.array_distinct(F.array(F.min_by("x", "id"), *ends)).alias("ends")))
    core = cut(core.join(cells.select("cell", "group"), "cell").groupBy("group", "leaf", "x").agg(F.min("id").alias("id")))
    first = cells.select(F.col("group").alias("id"), "group", F.explode("ends").alias("x"), asking)
    links = f"src {kind}, dst {kind}"
    linked = components(nb.search(first, core, where, _links(eps, dims, False), links).distinct())
    named = lambda rows, found: rows.join(found.select(F.col("node").alias("group"), "component"), "group", "left").withColumn("group", F.coalesce("component", "group")).drop("component")
    core = cut(named(core, linked))
    single = core.groupBy("leaf").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo = hi").select("leaf", "lo")
    single = {r["leaf"]: r["lo"] for r in single.collect()}  # one row a leaf
    across = nb.search(core.select("id", "x", "group", asking), core, where, _links(eps, dims, True), links, single).distinct()
    joined = components(across)
    core = named(core, joined).select("id", "x", "leaf", F.col("group").alias("cluster"))

    border = nb.search(marked.where("NOT core").select("id", "x", asking), core, where, _least_cluster(eps, dims), f"id {kind}, cluster {kind}")
    border = border.groupBy("id").agg(F.min("cluster").alias("cluster"))
    group_of = named(named(cells.select("cell", "group"), linked), joined).select("cell", F.col("group").alias("cluster"))
    inner = marked.where("core").join(group_of, "cell").select("id", "cluster", "core")
    outer = marked.where("NOT core").join(border, "id", "left").select("id", "cluster", "core")
    return inner.unionByName(outer).withColumnRenamed("id", key)


def _merges(d: np.ndarray, size: np.ndarray, linkage: str) -> list[tuple[float, int, int]]:
    """(distance, one member, another member) of the merges that nearest-neighbour chains find, in rising order; the
    distances to a merged pair follow from those to its halves (Lance and Williams). d is overwritten."""
    n, out, chain, size = len(d), [], [], size.astype(float)
    there = np.ones(n, bool)
    np.fill_diagonal(d, np.inf)
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(there))]
        while True:
            i = chain[-1]
            j = int(np.argmin(d[i]))
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        i, j = min(i, j), max(i, j)
        out.append((float(d[i, j]), i, j))
        a, b = d[i], d[j]
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.maximum(a, b)
        elif linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        else:
            with np.errstate(invalid="ignore"):
                total = size[i] + size[j] + size
                new = np.sqrt(np.maximum((size[i] + size) * a**2 + (size[j] + size) * b**2 - size * d[i, j] ** 2, 0) / total)
        there[j], size[i] = False, size[i] + size[j]
        new[~there] = np.inf
        new[i] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
    return sorted(out, key=lambda m: m[0])


def agglomerative(df: DataFrame, key: str, names: list[str], n_clusters: int = 3, linkage: str = "ward", summaries: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(key, cluster) with clusters named by their smallest key, and the merge table (step, one, other, distance, size): what
    merges at a step, where names below the number of starting groups are those groups, and name groups + s is what
    step s made.

    Linkages: ward, complete, average, single. Up to `summaries` rows each row starts as a group of its own and the
    result is exact. Above that the rows are first dealt into that many compact leaves of a tree (the leaf of largest
    spread is split next, on a bounded sample) and summed there to numbers and means in Spark; leaves start as groups, and distances
    between them are those of their means (for ward with their sizes). The driver holds one square matrix of the groups.
    Keys are unique. Rows with a null key, or a null or non-finite value, are left out; an empty table gives no rows.
    Of equal distances either pair may merge first.
    """
    if linkage not in ("ward", "complete", "average", "single"):
        raise ValueError(f"unknown linkage {linkage!r}")
    spark, dims = df.sparkSession, len(names)
    rows = nb.points(df, key, names)
    n = rows.count()
    if n <= summaries:
        dealt = cut(rows.withColumn("start", F.col("id")))
    else:
        where = nb.index(rows, dims, summaries)
        dealt = where.points.withColumnRenamed("leaf", "start")
    means = [F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(dims)]
    groups = dealt.groupBy("start").agg(F.count("*").alias("n"), *means).toPandas().sort_values("start", ignore_index=True)
    m, size = groups[[f"m{j}" for j in range(dims)]].to_numpy(float), groups.n.to_numpy()
    d = nb.distances(m, m)
    if linkage == "ward" and len(m):
        d *= np.sqrt(2 * size[:, None] * size[None] / (size[:, None] + size[None]))
    merges, name, parent, table = _merges(d, size, linkage), list(range(len(m))), list(range(len(m))), []
    cluster, total = list(range(len(m))), size.tolist()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for step, (distance, i, j) in enumerate(merges):
        i, j = root(i), root(j)
        total[i] += total[j]
        table.append((step, *sorted((name[i], name[j])), distance, total[i]))
        parent[j], name[i] = i, len(m) + step
        if step == len(m) - n_clusters - 1:
            cluster = [root(k) for k in range(len(m))]
    if n_clusters >= len(m):
        cluster = list(range(len(m)))
    start = groups.start.tolist()
    of = spark.createDataFrame([(start[k], c) for k, c in enumerate(cluster)], f"start {dealt.schema['start'].dataType.simpleString()}, c long")
    out = dealt.join(F.broadcast(of), "start")
    first = out.groupBy("c").agg(F.min("id").alias("cluster"))
    labels = out.join(F.broadcast(first), "c").select(F.col("id").alias(key), "cluster")
    return labels, spark.createDataFrame(table, "step int, one int, other int, distance double, size long")

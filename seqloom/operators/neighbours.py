"""Neighbours of points in space: a tree of cells, searches within a radius, and exact k nearest neighbours.

A table of points has (id, x array<double>). Rows are dealt to the leaves of a tree whose splits come from a bounded
sample; a search sends every query to the leaves that its ball touches. Leaves above a block of rows, and leaves asked
by more than a block of queries, are split into pairs of blocks, each one bounded task.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.shared import cut

#: Rows that a leaf should hold, rows and queries of a block, rows of the sample that the splits come from, and bytes of
#: the tree with its boxes: a table for which that many leaves don't do has larger leaves, in more blocks.
LEAF, BLOCK, SAMPLE, TREE_BYTES = 2048, 4096, 1 << 16, 64 << 20


class Tree:
    """Splits of space into regions, one a leaf. Balanced: the node with most rows of the sample is split next, at the
    median of its widest dimension. Otherwise the one with the largest sum of squares, at the mean of the dimension that
    varies most, so that leaves don't straddle groups that lie apart."""

    def __init__(self, sample: np.ndarray, leaves: int, balanced: bool = True):
        edge = np.full(sample.shape[1], np.inf)
        self.dim, self.at, self.left, self.right, region = [0], [0.0], [-1], [-1], [(-edge, edge)]
        heap = [(-np.inf, 0, sample)]
        while heap and len(region) < 2 * leaves - 1:
            _, me, x = heapq.heappop(heap)
            wide = np.ptp(x, axis=0) if len(x) else edge * 0
            if not wide.max(initial=0) > 0:
                continue
            dim = int(np.argmax(wide if balanced else np.where(wide > 0, x.var(axis=0), -1)))
            values = np.sort(x[:, dim])
            at = values[len(values) // 2] if balanced else values.mean()
            at = float(at) if values[0] < at <= values[-1] else float(values[values > values[0]][0])
            under, (low, high) = x[:, dim] < at, region[me]
            upto, above = high.copy(), low.copy()
            upto[dim] = above[dim] = at
            self.dim[me], self.at[me], self.left[me], self.right[me] = dim, at, len(region), len(region) + 1
            for part, box in ((x[under], (low, upto)), (x[~under], (above, high))):
                heapq.heappush(heap, (-len(part) if balanced else -((part - part.mean(axis=0)) ** 2).sum(), len(region), part))
                for values, v in ((self.dim, 0), (self.at, 0.0), (self.left, -1), (self.right, -1), (region, box)):
                    values.append(v)
        self.dim, self.left, self.right, self.at = np.array(self.dim), np.array(self.left), np.array(self.right), np.array(self.at)
        ends = self.left < 0
        self.leaf = np.where(ends, np.cumsum(ends) - 1, -1)
        self.low, self.high = (np.array([r[i] for r, end in zip(region, ends) if end]) for i in (0, 1))

    def of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every point."""
        node = np.zeros(len(x), np.int64)
        while (inner := self.leaf[node] < 0).any():
            n = node[inner]
            under = x[inner, self.dim[n]] < self.at[n]
            node[inner] = np.where(under, self.left[n], self.right[n])
        return self.leaf[node]

    def touching(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf): every leaf whose region is within the query's radius, and perhaps some more."""
        q, node, found = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(q):
            end = self.leaf[node] >= 0
            found.append((q[end], self.leaf[node[end]]))
            q, node = q[~end], node[~end]
            past = x[q, self.dim[node]] - self.at[node]
            left, right = past <= radius[q], past >= -radius[q]
            q, node = np.r_[q[left], q[right]], np.r_[self.left[node[left]], self.right[node[right]]]
        return tuple(np.concatenate(a) for a in zip(*found)) if found else (q, node)


@dataclass
class Index:
    """Points with their leaves (id, x, leaf, and what else the table had), the tree, and the boxes that leaves fill."""

    points: DataFrame
    tree: Tree
    low: np.ndarray
    high: np.ndarray
    sizes: dict[int, int]

    def blocks(self, spark):
        """(leaf, n): how many blocks the rows of each leaf make, for a broadcast join."""
        return F.broadcast(spark.createDataFrame([(leaf, -(-n // BLOCK)) for leaf, n in self.sizes.items()], "leaf long, n int"))


def matrix(x: pd.Series, dims: int) -> np.ndarray:
    return np.array(x.tolist(), float).reshape(len(x), dims)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, dimension by dimension: no more than two arrays of the result's size at a time."""
    out, d = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for j in range(a.shape[1]):
        np.subtract(a[:, j, None], b[None, :, j], out=d)
        d *= d
        out += d
    return np.sqrt(out, out=out)


def points(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(id, x): rows with a null id, or a null or non-finite value, are left out."""
    x = F.array(*(F.col(n).cast("double") for n in names))
    known = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col(key).alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.coalesce(known, F.lit(False)))


def index(rows: DataFrame, dims: int, summaries: int | None = None) -> Index:
    """The points in their leaves, written to the shared folder: balanced leaves of about LEAF rows, or that number of
    compact ones (`summaries`). An empty table has one empty leaf."""
    n = rows.count()
    every = max(1, n // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(every)) == 0).limit(2 * SAMPLE).select("x").toPandas()
    tree = Tree(matrix(sample.x, dims), summaries or max(1, min(-(-n // LEAF), TREE_BYTES // (32 * dims + 64))), not summaries)

    def assign(frames):
        for f in frames:
            yield f.assign(leaf=tree.of(matrix(f.x, dims)))

    dealt = cut(rows.mapInPandas(assign, _ddl(rows) + ", leaf long"))
    ends = [f(F.col("x")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(dims)]
    low, high, sizes = np.full((len(tree.low), dims), np.inf), np.full((len(tree.low), dims), -np.inf), {}
    for r in dealt.groupBy("leaf").agg(F.count("*"), *ends).collect():  # one row a leaf
        sizes[r["leaf"]], low[r["leaf"]], high[r["leaf"]] = r[1], r[2 : dims + 2], r[dims + 2 :]
    return Index(dealt, tree, low, high, sizes)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def search(queries: DataFrame, rows: DataFrame, where: Index, work, schema: str, leaves: dict | None = None) -> DataFrame:
    """work(queries, rows) as pandas frames for every pair of blocks of a leaf. Queries have (id, x, radius) and go to
    the leaves whose box is within their radius; rows have (id, x, leaf). `leaves` gives the only group (column
    `group`) of leaves that hold one: queries of the same group don't go there.

    Where the queries go is worked out twice: to count them by leaf, and to send them."""
    tree, low, high, dims = where.tree, where.low, where.high, where.low.shape[1]
    only = None if leaves is None else np.array([leaves.get(i, np.iinfo(np.int64).min) for i in range(len(low))])

    def send(frames):
        for f in frames:
            x, radius = matrix(f.x, dims), f.radius.to_numpy(float)
            q, leaf = tree.touching(x, radius * (1 + 1e-9))
            gap = np.maximum(np.maximum(low[leaf] - x[q], x[q] - high[leaf]), 0)
            near = np.sqrt((gap * gap).sum(axis=1)) <= radius[q] * (1 + 1e-9)
            if only is not None:
                near &= only[leaf] != f["group"].to_numpy()[q]
            yield f.iloc[q[near]].assign(leaf=leaf[near])

    queries = queries.drop("leaf")
    sent = queries.mapInPandas(send, _ddl(queries) + ", leaf long")
    count = lambda df: {r["leaf"]: r["count"] for r in df.groupBy("leaf").count().collect()}  # noqa: E731  one row a leaf
    asked, held = count(sent), count(rows)
    blocks = [(leaf, -(-n // BLOCK), -(-held[leaf] // BLOCK)) for leaf, n in asked.items() if leaf in held]
    blocks = F.broadcast(queries.sparkSession.createDataFrame(blocks, "leaf long, nq int, nr int"))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sent.join(blocks, "leaf").withColumn("qb", block("nq", 1)).withColumn("rb", every("nr")).drop("nq", "nr")
    right = rows.join(blocks, "leaf").withColumn("rb", block("nr", 2)).withColumn("qb", every("nq")).drop("nq", "nr")
    left = left.select([F.col(c).alias(c) for c in left.columns])
    keys = ["leaf", "qb", "rb"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(lambda key, q, r: work(q, r), schema)


def _nearest(k: int, dims: int):
    """Per query the k smallest distances in a block that aren't above its radius."""

    def work(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out, x, y = [], matrix(q.x, dims), matrix(r.x, dims)
        limit = q.radius.to_numpy(float) if len(q) else np.zeros(0)
        for lo in range(0, len(q) if len(r) else 0, 512):
            d = distances(x[lo : lo + 512], y)
            d = np.sort(np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d, axis=1)
            out += [row[row <= most] for row, most in zip(d, limit[lo : lo + 512])]
        return pd.DataFrame({"id": q.id[: len(out)], "near": out}, columns=["id", "near"])

    return work


def nearest(where: Index, k: int) -> DataFrame:
    """(id, near array<double>): each point's k smallest distances to points of the table, itself (0) included, in order;
    all, if there are fewer. A block of its own leaf bounds a point's k-th distance; the leaves within that bound are
    searched. Where k points are equal the bound is 0 and nothing is left to search. Ids stand once."""
    rows, dims = where.points.select("id", "x", "leaf"), where.low.shape[1]
    kind = rows.schema["id"].dataType.simpleString()

    def bound(f: pd.DataFrame) -> pd.DataFrame:
        x, out = matrix(f.x, dims), []
        for lo in range(0, len(f), 512):
            d = distances(x[lo : lo + 512], x)
            out.append(np.partition(d, k - 1, axis=1)[:, k - 1] if len(f) >= k else np.full(len(d), np.inf))
        return pd.DataFrame({"id": f.id, "x": f.x, "radius": np.concatenate(out)})

    blocks = where.blocks(rows.sparkSession)
    dealt = rows.join(blocks, "leaf").withColumn("b", F.pmod(F.xxhash64("id", F.lit(2)), "n").cast("int"))
    asking = cut(dealt.groupBy("leaf", "b").applyInPandas(bound, f"id {kind}, x array<double>, radius double"))
    found = search(asking.where("radius > 0"), rows, where, _nearest(k, dims), f"id {kind}, near array<double>")
    found = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return found.unionByName(asking.where("radius = 0").select("id", F.array_repeat(F.lit(0.0), k).alias("near")))

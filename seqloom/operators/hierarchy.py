"""Density hierarchies: the minimum spanning tree of mutual reachability distances, and HDBSCAN clusters from it.

The tree is found in the leaves of the neighbour index first. A leaf's own spanning tree (Prim) holds every edge inside
the leaf that the whole tree can have, and an edge of it is settled at once if it is shorter than the way out of the leaf
for one of the components that it joins. What is left is joined in rounds (Boruvka): each component takes its shortest
edge to another one, found by a search within a bound and only in leaves that hold rows of other components.

The hierarchy isn't built point by point. Parts of the tree below min_cluster_size are merged first (crumbs); each crumb
has one edge at which it joins something as large as a cluster. These edges make one basin around each density peak, and the
other edges merge basins. So only basins and their edges, a row for each peak in the data (at most a point in
min_cluster_size, usually far fewer), are folded into the tree of clusters in one place; crumbs and points stay distributed.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.shared import components, cut

from . import neighbours as nb

#: Components whose representatives are compared in one task.
TOGETHER = 1024


def _spanning(ids: np.ndarray, w: np.ndarray) -> list[tuple]:
    """The minimum spanning tree of a full matrix as (weight, smaller place, larger place), ordered; ties by the ends."""
    n, out = len(ids), []
    best, key, inside = np.full(n, np.inf), np.full(n, n * n, np.int64), np.zeros(n, bool)
    other, now = np.arange(n), 0
    for _ in range(n - 1):
        inside[now] = True
        keys = np.minimum(other, now) * n + np.maximum(other, now)
        better = ~inside & ((w[now] < best) | (w[now] == best) & (keys < key))
        best[better], key[better] = w[now][better], keys[better]
        open_ = np.where(inside, np.inf, best)
        ties = np.flatnonzero(~inside & (best == open_.min()))
        now = int(ties[np.argmin(key[ties])])
        out.append((float(best[now]), int(key[now]) // n, int(key[now]) % n))
    return sorted(out)


def _reachability(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """The largest of the distance and both core distances, in the array of the distances."""
    w = nb.distances(x, x)
    np.maximum(w, core[:, None], out=w)
    return np.maximum(w, core[None], out=w)


def _find(parent: list, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _inside(where: nb.Index, dims: int):
    """Of each unit (a leaf, or a block of a leaf that is too large): edges of its tree, settled or not, and the component that
    the settled ones put each point in (settled null)."""
    low, high = where.tree.low, where.tree.high
    whole = {leaf for leaf, n in where.sizes.items() if n <= nb.BLOCK}

    def work(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        x, core, leaf = nb.matrix(f.x, dims), f.core.to_numpy(float), int(f.leaf.iloc[0])
        edges = _spanning(f.id.to_numpy(), _reachability(x, core))
        out = np.minimum((x - low[leaf]).min(axis=1), (high[leaf] - x).min(axis=1))
        out = (np.maximum(core, out) if leaf in whole else core).tolist()  # nothing outside is nearer
        parent, rows, ids = list(range(len(f))), [], f.id.tolist()
        for w, i, j in edges:
            a, b = _find(parent, i), _find(parent, j)
            settled = w < max(out[a], out[b])
            if settled:
                parent[max(a, b)] = min(a, b)
                out[min(a, b)] = min(out[a], out[b])
            rows.append((ids[i], ids[j], w, settled))
        rows += [(p, ids[_find(parent, i)], 0.0, None) for i, p in enumerate(ids)]
        return pd.DataFrame(rows, columns=["a", "b", "w", "settled"]).astype({"settled": "boolean"})

    return work


def _shortest(dims: int):
    """Per component the shortest edge of the queries to rows of other components and other units."""

    def work(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        best, x, y = {}, nb.matrix(q.x, dims), nb.matrix(r.x, dims)
        if len(q) and len(r):
            r_id, r_group, r_unit, r_core = r.id.to_numpy(), r["group"].to_numpy(), r.unit.to_numpy(), r.core.to_numpy()
            for lo in range(0, len(q), 512):
                own = q.iloc[lo : lo + 512]
                w = np.maximum(np.maximum(own.core.to_numpy()[:, None], r_core[None]), nb.distances(x[lo : lo + 512], y))
                w[(own["group"].to_numpy()[:, None] == r_group[None]) | (own.unit.to_numpy()[:, None] == r_unit[None])] = np.inf
                w[w > own.radius.to_numpy()[:, None]] = np.inf
                least = w.min(axis=1)
                for i in np.flatnonzero(least < np.inf):
                    group, me = own["group"].iloc[i], own.id.iloc[i]
                    if group in best and best[group][0] < least[i]:
                        continue
                    for j in np.flatnonzero(w[i] == least[i]):
                        edge = (float(least[i]), *((me, r_id[j], group, r_group[j]) if me < r_id[j] else (r_id[j], me, r_group[j], group)))
                        if group not in best or edge < best[group]:
                            best[group] = edge
        return pd.DataFrame([(g, *e) for g, e in best.items()], columns=["group", "w", "a", "b", "u", "v"])

    return work


def _representatives(f: pd.DataFrame) -> pd.DataFrame:
    x, core, out = np.array(f.x.tolist()), f.core.to_numpy(), []
    w = _reachability(x, core)
    np.fill_diagonal(w, np.inf)
    for i, j in enumerate(w.argmin(axis=1)) if len(f) > 1 else ():
        (a, u), (b, v) = sorted([(f.id.iloc[i], f["group"].iloc[i]), (f.id.iloc[j], f["group"].iloc[j])])
        out.append((f["group"].iloc[i], float(w[i, j]), a, b, u, v))
    return pd.DataFrame(out, columns=["group", "w", "a", "b", "u", "v"])


def reachability_tree(where: nb.Index, min_samples: int) -> DataFrame:
    """(a, b, w): the minimum spanning tree of the points, a < b, by mutual reachability: the largest of the distance and
    of both ends' distances to their min_samples-th nearest point, themselves included. Equal weights go by (a, b)."""
    dims, kind = where.low.shape[1], where.points.schema["id"].dataType.simpleString()
    near = nb.nearest(where, min_samples).select("id", F.element_at("near", -1).alias("core"))
    blocks = where.blocks(near.sparkSession)
    rows = where.points.select("id", "x", "leaf").join(near, "id").join(blocks, "leaf")
    rows = cut(rows.withColumn("unit", F.col("leaf") * (1 << 20) + F.pmod(F.xxhash64("id", F.lit(2)), "n")).drop("n"))
    first = cut(rows.groupBy("unit").applyInPandas(_inside(where, dims), f"a {kind}, b {kind}, w double, settled boolean"))
    tree = [first.where("settled").select("a", "b", "w")]
    open_ = first.where("NOT settled").select("w", "a", "b")
    state = cut(rows.join(first.where("settled IS NULL").select(F.col("a").alias("id"), F.col("b").alias("group")), "id"))
    edge, found = F.struct("w", "a", "b", "u", "v"), f"group {kind}, w double, a {kind}, b {kind}, u {kind}, v {kind}"
    best = lambda df: df.groupBy("group").agg(F.min(edge).alias("e")).select("group", "e.*")
    turn = 0
    while (groups := state.select("group").distinct().count()) > 1:
        group_of = state.select("id", "group")
        for end, name in (("a", "u"), ("b", "v")):
            open_ = open_.join(group_of.select(F.col("id").alias(end), F.col("group").alias(name)), end)
        open_ = cut(open_.where("u <> v"))
        known = best(open_.select(F.explode(F.array("u", "v")).alias("group"), "w", "a", "b", "u", "v"))
        speakers = state.groupBy("group").agg(F.min_by(F.struct("id", "x", "core"), "id").alias("r")).select("group", "r.*")
        deal = F.pmod(F.xxhash64("group", F.lit(turn)), F.lit(-(-groups // TOGETHER)))
        known = cut(best(known.unionByName(speakers.groupBy(deal).applyInPandas(_representatives, found))))
        asking = state.join(known.select("group", F.col("w").alias("radius")), "group").where("core <= radius")
        single = state.groupBy("leaf").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo = hi").collect()
        near = nb.search(asking, state, where, _shortest(dims), found, {r["leaf"]: r["lo"] for r in single})
        chosen = cut(best(known.unionByName(near)).select("w", "a", "b", "u", "v").distinct())
        tree.append(chosen.select("a", "b", "w"))
        joined = components(chosen.select(F.col("u").alias("src"), F.col("v").alias("dst")))
        state = state.join(joined.select(F.col("node").alias("group"), "component"), "group", "left")
        state = cut(state.withColumn("group", F.coalesce("component", "group")).drop("component"))
        open_, turn = open_.select("w", "a", "b"), turn + 1
    out = tree[0]
    for more in tree[1:]:
        out = out.unionByName(more)
    return out


def _crumbs(tree: DataFrame, ids: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, crumb) of all points, and the tree's edges between crumbs (w, a, b, u, v). Crumbs are the largest parts that
    single linkage builds with fewer than `least` points: two of them merge while each is the other's nearest and both
    together are still small."""
    parts = cut(ids.select("id", F.col("id").alias("crumb")))
    edges = cut(tree.select("w", "a", "b", F.col("a").alias("u"), F.col("b").alias("v")))
    while True:
        ends = edges.select(F.explode(F.array("u", "v")).alias("crumb"), F.struct("w", "a", "b", "u", "v").alias("e"))
        nearest = ends.groupBy("crumb").agg(F.min("e").alias("e"))
        both = nearest.groupBy("e").count().where("count = 2").select("e.u", "e.v")
        size = parts.groupBy("crumb").agg(F.count("*").alias("n"))
        for end in "uv":
            both = both.join(size.select(F.col("crumb").alias(end), F.col("n").alias(f"n{end}")), end)
        both = cut(both.where(F.col("nu") + F.col("nv") < least).select(F.greatest("u", "v").alias("crumb"), F.least("u", "v").alias("into")))
        if not both.limit(1).count():
            return parts, edges
        parts = cut(parts.join(both, "crumb", "left").select("id", F.coalesce("into", "crumb").alias("crumb")))
        for end in "uv":
            edges = edges.join(both.select(F.col("crumb").alias(end), F.col("into").alias(f"_{end}")), end, "left")
        edges = cut(edges.select("w", "a", "b", F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")).where("u <> v"))


class Clusters:
    """The tree of clusters over basins, from the edges (w, a, b, basin, basin) between them in rising order. Basins are
    clusters 0 to n - 1, the cluster that edge i makes is n + i."""

    def __init__(self, basins: list, edges: list[tuple]):
        n = len(basins)
        self.n, self.place, self.order = n + len(edges), {b: i for i, b in enumerate(basins)}, [e[:3] for e in edges]
        self.parent, self.children = np.full(self.n, -1, np.int64), {}
        top, root = list(range(n)), list(range(n))
        for c, (*_, u, v) in enumerate(edges, n):
            i, j = _find(root, self.place[u]), _find(root, self.place[v])
            self.parent[[top[i], top[j]]], self.children[c] = c, (top[i], top[j])
            root[j], top[i] = i, c
        # the edge that ends a cluster from below, and the one that made it; the root has no end
        self.ends = np.where(self.parent >= 0, self.parent - n, len(edges))
        self.born = [edges[i][0] if i < len(edges) else np.inf for i in self.ends]
        self.merged = [0.0] * n + [e[0] for e in edges]

    def for_tasks(self) -> Clusters:
        """What leaving() reads: every Python worker holds a copy, so it has no part of the tree that only chosen() needs."""
        out = object.__new__(Clusters)
        out.place, out.order, out.parent, out.ends = self.place, self.order, self.parent, self.ends
        return out

    def leaving(self, basins, edges) -> np.ndarray:
        """The clusters that crumbs join by their edges (w, a, b): of the basin's ancestors the one that is there then."""
        at = np.array([self.place[b] for b in basins], np.int64)
        before = np.array([bisect_left(self.order, e) for e in edges], np.int64)
        while (up := self.ends[at] < before).any():
            at[up] = self.parent[at[up]]
        return at

    def chosen(self, joined: dict[int, tuple[int, float]]) -> np.ndarray:
        """For every cluster the selected cluster that it is in, or -1. joined: points and the sum of 1 / weight of the
        crumbs that join at the cluster. A cluster is selected over those below it if its stability is no less than the
        sum of theirs; the root never is."""
        level = lambda w: np.inf if w == 0 else 0.0 if w == np.inf else 1.0 / w
        size, best, own = [0] * self.n, [0.0] * self.n, [True] * self.n
        for c in range(self.n):
            birth, (points, levels) = level(self.born[c]), joined.get(c, (0, 0.0))
            below = self.children.get(c, ())
            size[c] = points + sum(size[k] for k in below)
            inner = sum(size[k] for k in below)
            stable = 0.0 if birth == np.inf else levels - points * birth + (inner * (level(self.merged[c]) - birth) if inner else 0.0)
            under = sum(best[k] for k in below)
            own[c] = stable >= under or not below
            best[c] = max(stable, under)
        out = np.full(self.n, -1, np.int64)
        for c in range(self.n - 1, -1, -1):
            p = self.parent[c]
            out[c] = -1 if p < 0 else out[p] if out[p] >= 0 else c if own[c] else -1
        return out


def hdbscan(df: DataFrame, key: str, names: list[str], min_cluster_size: int = 5, min_samples: int | None = None) -> DataFrame:
    """(key, cluster): clusters of the condensed tree with the most stability (excess of mass, never the root), named by
    their smallest key; noise has null. min_samples is min_cluster_size where it isn't given.

    Keys are unique. Rows with a null key, or a null or non-finite value, are left out; with fewer rows than a cluster
    needs, all are noise; an empty table gives no rows. Equal distances are taken in the order of the ends' keys. Every
    step but the tree of basins (see the module) is distributed; the tree is held by the driver and sent to the tasks.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has two rows at least")
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    where = nb.index(nb.points(df, key, names), len(names))
    ids = where.points.select("id")
    if sum(where.sizes.values()) < max(min_cluster_size, 2):
        return ids.select(F.col("id").alias(key), F.lit(None).cast(kind).alias("cluster"))
    tree = cut(reachability_tree(where, min_samples or min_cluster_size))
    parts, edges = _crumbs(tree, ids, min_cluster_size)
    ends = edges.select(F.explode(F.array("u", "v")).alias("crumb"), F.struct("w", "a", "b", "u", "v").alias("e"))
    nearest = cut(ends.groupBy("crumb").agg(F.min("e").alias("e")).select("crumb", "e.*"))
    basins = cut(components(nearest.select(F.col("u").alias("src"), F.col("v").alias("dst"))))
    rest = edges.join(nearest.select("a", "b").distinct(), ["a", "b"], "left_anti")
    for end in "uv":
        rest = rest.join(basins.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end)
    merging = [tuple(r) for r in rest.orderBy("w", "a", "b").select("w", "a", "b", "_u", "_v").collect()]  # a row for each peak but one
    peaks = [r[0] for r in basins.select("component").distinct().orderBy("component").collect()]
    tree_of = Clusters(peaks, merging)
    clusters = spark.sparkContext.broadcast(tree_of.for_tasks())

    def locate(frames):
        for f in frames:
            yield pd.DataFrame({"crumb": f.crumb, "at": clusters.value.leaving(f.basin, zip(f.w, f.a, f.b)), "w": f.w})

    joins = nearest.join(basins.select(F.col("node").alias("crumb"), F.col("component").alias("basin")), "crumb")
    joins = cut(joins.select("crumb", "basin", "w", "a", "b").mapInPandas(locate, f"crumb {kind}, at long, w double"))
    size = parts.groupBy("crumb").agg(F.count("*").alias("n"))
    level = F.when(F.col("w") == 0, F.lit(float("inf"))).otherwise(1 / F.col("w"))
    sums = joins.join(size, "crumb").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("n") * level).alias("levels"))
    chosen = tree_of.chosen({r["at"]: (r["n"], r["levels"]) for r in sums.collect()})  # two rows for each peak
    names_ = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(chosen)], "at long, chosen long"))
    out = parts.join(joins.select("crumb", "at"), "crumb").join(names_, "at").select("id", F.expr("nullif(chosen, -1)").alias("chosen"))
    named = out.where("chosen IS NOT NULL").groupBy("chosen").agg(F.min("id").alias("cluster"))
    return out.join(named, "chosen", "left").select(F.col("id").alias(key), "cluster")

"""Clusterings against brute force, in one leaf of the neighbour index and in many."""

import numpy as np
import pandas as pd
import pytest

from seqloom.operators import clusters as cl
from seqloom.operators import hierarchy
from seqloom.operators import neighbours as nb
from seqloom.shared import components

RNG = np.random.default_rng(3)


def table(spark, x):
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"f{j}" for j in range(x.shape[1])]).assign(k=np.arange(len(x)))).repartition(3)


def names(x):
    return [f"f{j}" for j in range(x.shape[1])]


def apart(x):
    out = np.zeros((len(x), len(x)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - x[None, :, j]) ** 2
    return np.sqrt(out)


def blobs(n, dims):
    """Dense and loose groups, scattered rows, and one row that a fifth of all repeat."""
    parts = [RNG.normal(c, s, (n // 5, dims)) for c, s in zip(RNG.uniform(-2, 2, (3, dims)), (0.1, 0.15, 0.3))]
    return np.concatenate([*parts, RNG.uniform(-3, 3, (n // 5, dims)), np.tile(RNG.uniform(-1, 1, (1, dims)), (n - 4 * (n // 5), 1))])


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(nb, "LEAF", 80)
    monkeypatch.setattr(nb, "BLOCK", 70)


def plain_dbscan(x, eps, least):
    near = apart(x) <= eps
    core = near.sum(1) >= least
    cluster = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if cluster[i] < 0:
            todo, cluster[i] = [i], i
            while todo:
                new = np.flatnonzero(near[todo.pop()] & core & (cluster < 0))
                cluster[new] = i
                todo += new.tolist()
    for i in np.flatnonzero(~core):
        around = cluster[near[i] & core]
        cluster[i] = around.min() if len(around) else -1
    return cluster, core


def test_dbscan_and_k_distances_in_many_leaves(spark, small):
    x = blobs(250, 2)
    df = table(spark, x)
    bad = spark.createDataFrame([(None, 0.0, 1000), (float("nan"), 0.0, 1001), (0.0, float("inf"), 1002), (0.0, 0.0, None)], "f0 double, f1 double, k long")
    got = cl.dbscan(df.unionByName(bad), "k", names(x), 0.15, 5).toPandas().sort_values("k")
    cluster, core = plain_dbscan(x, 0.15, 5)
    assert got.k.tolist() == list(range(250)) and (got.cluster.fillna(-1).to_numpy() == cluster).all() and (got.core.to_numpy() == core).all()
    assert len(set(cluster)) > 3 and (cluster < 0).any() and (~core & (cluster >= 0)).any()
    k = cl.k_distances(df, "k", names(x), 4).toPandas().sort_values("k").k_distance.to_numpy()
    assert k.tolist() == np.sort(apart(x), axis=1)[:, 3].tolist()


def test_dbscan_edges(spark):
    x = np.array([[0.0], [1.0], [2.0], [10.0], [1e300], [-1e300]])
    got = {r.k: (r.cluster, r.core) for r in cl.dbscan(table(spark, x), "k", ["f0"], 1.0, 3).collect()}
    assert got == {0: (1, False), 1: (1, True), 2: (1, False), 3: (None, False), 4: (None, False), 5: (None, False)}
    none = table(spark, x).where("false")
    assert cl.dbscan(none, "k", ["f0"], 1.0, 3).count() == 0 and cl.k_distance_curve(none, "k", ["f0"]).count() == 0
    with pytest.raises(ValueError):
        cl.dbscan(none, "k", ["f0"], 0.0)


def plain_hdbscan(x, least, k):
    """The spanning tree's edges, and labels from the whole dendrogram, condensed from its root down."""
    n, d = len(x), apart(x)
    core = np.sort(d, axis=1)[:, k - 1]
    w = np.maximum(np.maximum(core[:, None], core[None]), d)
    owner, node, tree = list(range(n)), {i: (None, [i], 0.0) for i in range(n)}, []
    for weight, i, j in sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = owner[i], owner[j]
        if a != b:
            tree.append((i, j, weight))
            node[a] = ((node[a], node[b]), node[a][1] + node[b][1], weight)
            for p in node[b][1]:
                owner[p] = a
    clusters = [[-1, node[owner[0]][1], 0.0]]

    def descend(part, me, birth):
        while part[0]:
            (left, right), level = part[0], 1 / part[2]
            large = [p for p in (left, right) if len(p[1]) >= least]
            gone = part[1] if len(large) != 1 else min((left, right), key=lambda p: len(p[1]) >= least)[1]
            clusters[me][2] += (level - birth) * len(gone)
            if len(large) == 2:
                for p in large:
                    clusters.append([me, p[1], 0.0])
                    descend(p, len(clusters) - 1, level)
            if len(large) != 1:
                return
            part = large[0]

    descend(node[owner[0]], 0, 0.0)
    below = lambda i: [j for j, c in enumerate(clusters) if c[0] == i]
    best = [0.0] * len(clusters)
    for i in reversed(range(len(clusters))):
        best[i] = max(clusters[i][2], sum(best[j] for j in below(i)))
    label, todo = np.full(n, -1), below(0)
    while todo:
        i = todo.pop()
        if clusters[i][2] >= sum(best[j] for j in below(i)):
            label[clusters[i][1]] = min(clusters[i][1])
        else:
            todo += below(i)
    return sorted(tree), label


def test_hdbscan_in_many_leaves(spark, small):
    parts = [RNG.normal(c, s, (40, 2)) for c, s in zip(RNG.uniform(-2, 2, (4, 2)), (0.1, 0.15, 0.3, 0.1))]
    x = np.concatenate([*parts, RNG.uniform(-3, 3, (40, 2))])
    df = table(spark, x)
    tree, label = plain_hdbscan(x, 6, 4)
    where = nb.index(nb.points(df, "k", names(x)), 2)
    assert len(where.sizes) > 2
    assert sorted((r.a, r.b, r.w) for r in hierarchy.reachability_tree(where, 4).collect()) == tree
    got = hierarchy.hdbscan(df, "k", names(x), 6, 4).toPandas().sort_values("k")
    assert got.cluster.fillna(-1).tolist() == label.tolist() and len(set(label)) > 3


def test_hdbscan_edges(spark):
    x = np.concatenate([np.zeros((8, 1)), np.full((8, 1), 5.0), [[2.0]]])
    got = [r.cluster for r in hierarchy.hdbscan(table(spark, x), "k", ["f0"], 4).orderBy("k").collect()]
    assert got == [0] * 8 + [8] * 8 + [0]  # the last row leaves the first group below the level at which both part
    assert [r.cluster for r in hierarchy.hdbscan(table(spark, x[:3]), "k", ["f0"], 4).collect()] == [None] * 3
    assert hierarchy.hdbscan(table(spark, x).where("false"), "k", ["f0"]).count() == 0


def test_cluster_tree_is_that_of_brute_force():
    """The fold over basins alone: many random trees, ties among their weights."""
    for _ in range(20):
        x = np.round(RNG.normal(size=(60, 2)), 1) + RNG.normal(size=(60, 2)) * 1e-3
        tree, label = plain_hdbscan(x, 4, 3)
        parts, edges = list(range(60)), [(w, a, b, a, b) for a, b, w in tree]
        while True:
            near = {}
            for e in edges:
                for c in e[3:]:
                    near[c] = min(near.get(c, e), e)
            pairs = [e for e in near.values() if list(near.values()).count(e) == 2 and parts.count(e[3]) + parts.count(e[4]) < 4]
            into = {max(e[3:]): min(e[3:]) for e in pairs}
            if not into:
                break
            parts = [into.get(p, p) for p in parts]
            edges = [(w, a, b, into.get(u, u), into.get(v, v)) for w, a, b, u, v in edges]
            edges = [e for e in edges if e[3] != e[4]]
        basin = {c: c for c in near}
        for e in set(near.values()):
            old, new = sorted((basin[e[3]], basin[e[4]]), reverse=True)
            basin = {c: new if b == old else b for c, b in basin.items()}
        rest = sorted((*e[:3], basin[e[3]], basin[e[4]]) for e in edges if e not in near.values())
        clusters = hierarchy.Clusters(sorted(set(basin.values())), rest)
        at = clusters.leaving([basin[c] for c in near], [near[c][:3] for c in near])
        joined = {}
        for c, k in zip(near, at.tolist()):
            n, levels = joined.get(k, (0, 0.0))
            joined[k] = (n + parts.count(c), levels + parts.count(c) / near[c][0])
        chosen = dict(zip(near, clusters.chosen(joined)[at].tolist()))
        groups = lambda values: {frozenset(i for i, v in enumerate(values) if v == c) for c in set(values) - {-1}}
        assert groups([chosen[p] for p in parts]) == groups(label.tolist())


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_merges_equal_brute_force(linkage):
    x = RNG.normal(size=(30, 3))
    d, groups, want = apart(x), [[i] for i in range(30)], []

    def between(a, b):
        if linkage == "ward":
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        return {"single": np.min, "complete": np.max, "average": np.mean}[linkage](d[np.ix_(a, b)])

    while len(groups) > 1:
        distance, i, j = min((between(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        want.append(distance)
        groups[i] += groups.pop(j)
    assert [m[0] for m in cl._merges(d, np.ones(30), linkage)] == pytest.approx(want)


def test_agglomerative_rows_and_summaries(spark):
    x = np.concatenate([RNG.normal(c, 0.1, (40, 2)) for c in ([0, 0], [3, 0], [0, 3])])
    labels, merges = cl.agglomerative(table(spark, x), "k", names(x), 3)
    assert [r.cluster for r in labels.orderBy("k").collect()] == [0] * 40 + [40] * 40 + [80] * 40
    rows = merges.orderBy("step").collect()
    assert len(rows) == 119 and rows[-1]["size"] == 120 and rows[-3].distance < 1 < rows[-2].distance
    few, _ = cl.agglomerative(table(spark, x), "k", names(x), 3, "average", summaries=16)
    got, want = (np.array(c) for c in ([r.cluster for r in few.orderBy("k").collect()], [0] * 40 + [40] * 40 + [80] * 40))
    assert len(set(got)) == 3 and (got == want).sum() >= 100  # a summary may hold rows of two groups
    assert cl.agglomerative(table(spark, x).where("false"), "k", names(x))[0].count() == 0
    assert cl.agglomerative(table(spark, x[:2]), "k", names(x), 5)[0].count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (33, 31), (7, 7), (40, 40), (5, 2), (31, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 33: 30}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_unit_holds_two_matrices():
    """Every worker of an executor holds a unit; it took four arrays of the unit's distances."""
    import tracemalloc
    from types import SimpleNamespace

    n = 1024
    frame = pd.DataFrame({"id": np.arange(n), "x": list(np.random.default_rng(3).normal(size=(n, 2))), "core": 0.01, "leaf": 0})
    where = SimpleNamespace(tree=SimpleNamespace(low=np.full((1, 2), -np.inf), high=np.full((1, 2), np.inf)), sizes={0: n})
    work = hierarchy._inside(where, 2)
    tracemalloc.start()
    edges = work(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.6 * 8 * n * n and edges.settled.notna().sum() == n - 1


def test_tasks_get_no_more_of_the_tree_than_they_read():
    clusters = hierarchy.Clusters([1, 5, 9], [(1.0, 1, 5, 1, 5), (2.0, 5, 9, 5, 9)])
    some = ([1, 9, 5], [(0.5, 1, 2), (1.5, 9, 10), (3.0, 5, 6)])
    assert clusters.for_tasks().leaving(*some).tolist() == clusters.leaving(*some).tolist() and not hasattr(clusters.for_tasks(), "children")

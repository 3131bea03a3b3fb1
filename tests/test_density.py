import numpy as np
import pytest
from brute import hdbscan, mutual_reachability, pair_distances, prim, same_partition
from conftest import make_points

from pyspark.sql import functions as F

from themeloom.operators import density, merge_tree
from themeloom.operators.graph import connected_components
from themeloom.runtime import cut


def labels_of(df, n):
    got = {r["row_id"]: r["cluster_id"] for r in df.collect()}
    assert len(got) == n
    return [got[i] for i in range(n)]


def eps_brute(x, eps, min_samples, min_size):
    near = pair_distances(x) <= eps
    core = near.sum(axis=1) >= min_samples
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = label[near[i] & core].min()
        if np.array_equal(new, label):
            break
        label = new
    for v in set(label) - {-1}:
        if (label == v).sum() < min_size:
            label[label == v] = -1
    return label


@pytest.mark.parametrize("task_rows", [10**6, 3])
def test_components(spark, task_rows):
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 200, (150, 2))
    label = {int(v): int(v) for v in set(pairs.ravel())}
    for _ in range(200):
        for a, b in pairs:
            low = min(label[int(a)], label[int(b)])
            label[int(a)] = label[int(b)] = low
    df = spark.createDataFrame([tuple(map(int, p)) for p in pairs], "a bigint, b bigint")
    got = {r["node"]: r["comp"] for r in connected_components(df, task_rows=task_rows).collect()}
    apart = {v for a, b in pairs for v in (int(a), int(b)) if a != b}
    assert got == {v: label[v] for v in apart}
    twice = df.withColumn("g", F.lit(7)).unionByName(df.where("a % 2 = 0").withColumn("g", F.lit(8)))
    each = connected_components(twice, "g", task_rows)
    assert {r["node"]: r["comp"] for r in each.where("g = 7").collect()} == got
    part = connected_components(df.where("a % 2 = 0"))
    assert sorted(each.where("g = 8").drop("g").collect()) == sorted(part.collect())


@pytest.mark.parametrize("dim,direct,axes,rows", [(2, 4096, 3, 9), (2, 0, 3, 9), (3, 10, 3, 9), (5, 4096, 9, 9), (5, 1, 3, 2048), (12, 1, 3, 16), (2, 1, 0, 30)])
def test_eps_components(spark, dim, direct, axes, rows):
    rng = np.random.default_rng(dim)
    x = np.vstack(
        [rng.normal(0, 0.12, (60, dim)), rng.normal(1, 0.25, (60, dim)), rng.uniform(-2, 3, (40, dim))]
    )
    x = np.vstack([x, np.repeat(x[:1], 15, axis=0), np.repeat(x[150:151], 6, axis=0)])
    eps = 0.15 * np.sqrt(dim)
    want = eps_brute(x, eps, 3, 5)
    points = make_points(spark, x).unionByName(spark.createDataFrame([(-5, None, None)], "row_id bigint, point array<double>, cluster_id int"))
    found = density.eps_components(points, eps, 3, 5, direct, axes, rows)
    assert found.where("row_id = -5").first()["cluster_id"] == -1
    got = labels_of(found.where("row_id >= 0"), len(x))
    assert list(got) == list(want)
    assert len(set(want)) > 2


@pytest.mark.parametrize("cell_rows,small,task_rows,widen", [(2048, 4 << 20, 10**6, 8), (25, 0, 0, 8), (5, 0, 10**6, 3)])
def test_spanning_tree_weight(spark, blobs, cell_rows, small, task_rows, widen, monkeypatch):
    monkeypatch.setattr(density, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(density, "WIDEN", widen)
    nodes, edges = density.spanning_tree(
        make_points(spark, blobs), 3, k=5, cell_rows=cell_rows, small_bytes=small, task_rows=task_rows
    )
    rows = edges.collect()
    assert len(rows) == len(blobs) - 1
    want = sorted(w for w, _, _ in prim(mutual_reachability(blobs, 3)))
    assert np.allclose(sorted(r["w"] for r in rows), want)
    assert connected_components(edges.selectExpr("lo a", "hi b")).select("comp").distinct().count() == 1


def test_density_clusters(spark, blobs):
    rng = np.random.default_rng(3)
    x = np.vstack([blobs, rng.normal((8, 1.8), 0.2, (25, 2)), np.repeat(blobs[3:4], 3, axis=0)])
    points = make_points(spark, x)
    nodes, edges = density.spanning_tree(points, 3, cell_rows=40)
    settings = [(5, 0.0), (5, 0.1), (5, 1.5), (2, 0.0), (2, 0.4), (12, 0.0), (40, 0.0), (500, 0.0)]
    for band_rows in (10**6, 30, 7):
        table = [(i, m, epsilon) for i, (m, epsilon) in enumerate(settings)]
        found = cut(merge_tree.cut_trees(nodes, edges, table, band_rows))
        for i, m, epsilon in table:
            of = {r["pid"]: r["cluster_id"] for r in found.where(f"trial = {i}").collect()}
            home = {r["row_id"]: r["pid"] for r in density.homes(points, nodes).collect()}
            got = [of.get(home[k], -1) for k in range(len(x))]
            assert same_partition(got, hdbscan(x, m, 3, epsilon)), (m, epsilon, band_rows)


def test_trees_of_many_shapes(spark):
    """Chains, pairs of pairs and copies: bands of every size give what one band gives, and that what
    the definition gives."""
    rng = np.random.default_rng(11)
    chain = np.cumsum(rng.uniform(0.1, 3, 60))
    halves = np.array([sum((i >> b & 1) * 3.0**b for b in range(6)) for i in range(64)])
    halves = halves + rng.normal(0, 1e-3, 64)  # equal weights may be merged in any order
    for x in (chain, halves, np.concatenate([halves, np.repeat(halves[:3], 4), [500.0]])):
        x = x[:, None]
        points = make_points(spark, x)
        nodes, edges = (cut(df) for df in density.spanning_tree(points, 2))
        home = {r["row_id"]: r["pid"] for r in density.homes(points, nodes).collect()}
        table = [(0, 2, 0.0), (1, 3, 0.0), (2, 5, 2.0)]
        for band_rows in (4, 1000):
            found = cut(merge_tree.cut_trees(nodes, edges, table, band_rows))
            for i, m, epsilon in table:
                of = {r["pid"]: r["cluster_id"] for r in found.where(f"trial = {i}").collect()}
                got = [of.get(home[k], -1) for k in range(len(x))]
                assert same_partition(got, hdbscan(x, m, 2, epsilon)), (m, epsilon, band_rows)


def test_values_of_deep_trees(spark):
    """Excess of mass on random trees and on a chain of 400, against the definition."""
    rng = np.random.default_rng(4)
    rows = []
    for m, deep in ((1, False), (2, True)):
        parent = [None] + [i - 1 if deep else int(rng.integers(max(0, i - 6), i)) for i in range(1, 400)]
        s = rng.exponential(1, 400) * (10 if deep else 1)
        rows += [(m, i, p, float(v)) for i, (p, v) in enumerate(zip(parent, s))]
    df = cut(spark.createDataFrame(rows, "m bigint, cid bigint, parent bigint, stability double").repartition(6))
    got = {(r["m"], r["cid"]): r["eligible"] for r in merge_tree.with_eligible(df).collect()}
    apart = {(r["m"], r["cid"]): r["eligible"] for r in merge_tree.with_eligible(df, 1).collect()}
    assert apart == got
    below = {}
    for m, i, p, v in sorted(rows, key=lambda r: (r[0], -r[1])):
        b = below.get((m, i), 0.0)
        assert got[m, i] == (v >= b), (m, i)
        if p is not None:
            below[m, p] = below.get((m, p), 0.0) + max(v, b)


def test_blobs_are_found(spark, blobs):
    got = labels_of(density.density_clusters(make_points(spark, blobs)), len(blobs))
    for at in (0, 30, 60):
        part = [v for v in got[at : at + 30] if v != -1]
        assert len(set(part)) >= 1 and len(part) >= 20


def test_few_points_are_noise(spark):
    points = make_points(spark, [[0.0, 0.0], [1.0, 1.0]])
    assert labels_of(density.density_clusters(points), 2) == [-1, -1]
    one = make_points(spark, [[0.0, 0.0]])
    assert labels_of(density.density_clusters(one), 1) == [-1]


def test_large_row_ids_keep_their_clusters(spark, blobs):
    parts = []
    for start in (0, 2**61):
        rows = [(start + i, [float(v) for v in p]) for i, p in enumerate(blobs)]
        df = spark.createDataFrame(rows, "row_id bigint, point array<double>")
        got = {r["row_id"] - start: r["cluster_id"] for r in density.density_clusters(df).collect()}
        assert len(got) == len(blobs)
        parts.append([got[i] for i in range(len(blobs))])
    assert same_partition(*map(np.array, parts))

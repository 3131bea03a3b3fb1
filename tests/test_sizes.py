"""Work that must not grow with the square of the blocks or clusters."""

import numpy as np
import pyarrow as pa
import pytest
from brute import pair_distances
from conftest import make_points

from pyspark.sql import functions as F

from themeloom.operators import blocks, neighbors, quality
from themeloom.plans import analysis
from themeloom.runtime import cut
from themeloom.streaming import ingest


def test_small_blocks_are_bounded_in_number_and_met_in_groups(spark):
    x = np.random.default_rng(3).normal(size=(300, 4))
    points = make_points(spark, x)
    assert blocks.fit_tree(points, 10**6, 64).depth <= 10
    tree = blocks.fit_tree(points, len(x), 2)
    packed = blocks.pack(points, tree)
    n = packed.count()
    assert n > 4 * blocks.GROUPS
    run = lambda q, others: pa.table({"a": pa.array([q["block"]] * len(others)), "b": pa.array([o["block"] for o in others])})
    tally = lambda t: pa.table({"a": pa.array([t.num_rows]), "b": pa.array([0])})
    pairs = blocks.pairs_within(packed, 1e9)
    every = blocks.meet(pairs, packed, packed, run, "a bigint, b bigint")
    assert every.distinct().count() == n * (n + 1) // 2
    tasks = [r["a"] for r in blocks.meet(pairs, packed, packed, run, "a bigint, b bigint", tally).collect()]
    assert sum(tasks) == n * (n + 1) // 2 and len(tasks) <= blocks.GROUPS * (blocks.GROUPS + 1) // 2


def test_kernels_equal_sums_per_coordinate():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.integers(0, 3, (60, 3)).astype(float), rng.normal(0, 1e-9, (20, 3)), rng.normal(5e5, 1, (40, 3))])
    want, ids = neighbors.distances(x, x), rng.permutation(len(x))
    for radius in (0.0, 1.0, 2**0.5, 1e-9, 3.0):
        assert np.array_equal(neighbors.within(x, x, radius), want <= radius)
    for k in (1, 4, 200):
        got = neighbors.block_top_k(ids, x, ids, x, k, True)
        for i, r in enumerate(ids):
            mine = sorted((want[i, j], ids[j]) for j in range(len(x)) if j != i)[:k]
            f = got[got["row_id"] == r]
            assert list(zip(f["distance"], f["neighbor_id"])) == mine
    assert np.allclose(neighbors.pair_distances(x, x), pair_distances(x), atol=1e-7)


def test_silhouette_of_many_clusters_sends_few_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(240, 3))
    label = np.r_[np.zeros(150, int), 1 + np.arange(90) // 2]
    d = pair_distances(x)
    want = []
    for i in range(len(x)):
        a = d[i, (label == label[i])].sum() / ((label == label[i]).sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label) if c != label[i])
        want.append((b - a) / max(a, b))
    points = make_points(spark, x, label)
    got = {r["pid"]: r["value"] for r in quality.silhouette_values(*quality._folded(points)).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-9)
    # a row for each of 46 clusters would be 240 * 46 at least
    info = cut(points.select(F.lit(0).cast("bigint").alias("trial"), F.col("row_id").alias("pid"), F.col("cluster_id").cast("bigint").alias("cluster_id"), "point", F.lit(1).cast("bigint").alias("weight")))
    sizes = info.groupBy("trial", "cluster_id").agg(F.sum("weight").alias("size"), F.ceil(F.count(F.lit(1)) / 40).alias("parts"))
    assert quality.distance_sums(info, sizes, 6, False).count() <= 240 * (6 + 6 + 2)
    # repeated ids: every row of theirs counts as often as the labels that meet it
    both = points.unionByName(points.where("row_id < 20"))
    one = both.select(F.col("row_id").alias("pid"), "point", F.lit(1).alias("weight"))
    labels = both.select(F.lit(3).cast("bigint").alias("trial"), F.col("row_id").alias("pid"), F.col("cluster_id").cast("bigint").alias("cluster_id"))
    got = {r["pid"]: r["value"] for r in quality.silhouette_values(one, labels).collect()}
    times = np.r_[np.full(20, 4), np.ones(220, int)]
    for i in range(len(x)):
        mine = label == label[i]
        a = (d[i] * times)[mine].sum() / (times[mine].sum() - 1) * times[i]
        b = min((d[i] * times)[label == c].sum() / times[label == c].sum() for c in set(label) if c != label[i]) * times[i]
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def test_silhouettes_of_trials_in_many_partitions(spark):
    x = np.random.default_rng(4).normal(size=(60, 2))
    points = make_points(spark, x).select(F.col("row_id").alias("pid"), "point", F.lit(1).alias("weight"))
    trial = F.explode(F.expr("sequence(0L, 7L)")).alias("trial")
    labels = points.select(trial, "pid").select("trial", "pid", (F.col("pid") % (F.col("trial") + 2)).alias("cluster_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["trial"], r["pid"]): r["value"] for r in quality.silhouette_values(points, labels).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    d = pair_distances(x)
    for t in range(8):
        label = np.arange(60) % (t + 2)
        for i in range(60):
            a = d[i, label == label[i]].sum() / ((label == label[i]).sum() - 1)
            b = min(d[i, label == c].mean() for c in set(label) if c != label[i])
            assert abs(got[t, i] - (b - a) / max(a, b)) < 1e-9


def test_single_precision_settles_ordinary_points(monkeypatch):
    """F14, F15, F16, F18: the pairs of a search go through one product in single precision; double
    precision is for what it cannot tell."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 12))
    far = np.vstack([x, x[:1] * 1e7])  # one point far out blurs all the others
    def whole(p, k):
        d = neighbors.distances(p, p)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1, kind="stable")[:, :k].ravel().tolist()
    ids = np.arange(701)
    assert neighbors.block_top_k(ids, far, ids, far, 4, True)["neighbor_id"].tolist() == whole(far, 4)
    def refuse(a, b):
        raise AssertionError("double precision")
    monkeypatch.setattr(neighbors, "squares", refuse)
    ids = np.arange(700)
    assert neighbors.block_top_k(ids, x, ids, x, 4, True)["neighbor_id"].tolist() == whole(x, 4)


def test_search_many_keeps_rows_without_an_id(spark):
    """queries and members meet in blocks of their cells, whose ids are whole numbers; a NULL id stays NULL."""
    x = np.random.default_rng(5).normal(size=(40, 3))
    rows = [(None if i == 7 else i, [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, embedding array<double>")
    model = neighbors.fit_cells(df, 3)
    asked = df.select("row_id", F.col("embedding").alias("point"))
    got = neighbors.search_many(neighbors.place_in_cells(df, model), neighbors.cell_centers(spark, model), asked, 3, 4, probes=3).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 160
    for q in (7, 20):
        own = sorted((r for r in got if r["row_id"] == (None if q == 7 else q)), key=lambda r: r["rank"])
        want = np.argsort(-(unit @ unit[q]), kind="stable")[:4]
        assert {r["neighbor_id"] for r in own} == {None if i == 7 else int(i) for i in want}
        assert [r["similarity"] for r in own] == pytest.approx((unit @ unit[q])[want].tolist())


def test_overlapping_blocks_give_each_neighbour_once(spark):
    """F14, F15, F16, F18: a leaf cut by hash gives blocks that overlap, so that points of one block begin
    their search in different ones."""
    x = np.random.default_rng(2).normal(size=(300, 6))
    points = cut(make_points(spark, x))
    tree = blocks.fit_tree(points, len(x), 16)
    members = cut(blocks.pack(points.withColumn("leaf", F.lit(0)), tree))
    assert members.count() > 10
    got = neighbors._searched(members, members, tree, 5, True).toPandas()
    d = pair_distances(x)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert got.sort_values(["row_id", "rank"])["neighbor_id"].to_numpy().reshape(300, 5).tolist() == want.tolist()


def test_batch_of_one_file_is_spread(spark, tmp_path, monkeypatch):
    """the assignment of a batch that arrives as one file takes as many tasks as there are cores."""
    seen = []

    def spy(df):
        seen.append(df.rdd.getNumPartitions())
        return df.limit(0)

    monkeypatch.setattr(ingest, "cut", spy)
    rows = [(i, [float(i), 1.0]) for i in range(50)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "row_id bigint, embedding array<double>").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("row_id bigint, embedding array<double>").parquet(folder)
    base = str(tmp_path / "base")
    ingest.recluster_stream(stream, base, f"{base}/out", f"{base}/mark", analysis.Options()).awaitTermination()
    assert seen and seen[0] >= spark.sparkContext.defaultParallelism


def test_nearest_centers_take_a_matrix_product(monkeypatch):
    """rows and centers both grow, so that a center costs a product and not a pass per coordinate."""
    rng = np.random.default_rng(4)
    x, c = np.round(rng.normal(size=(300, 2)), 1), np.round(rng.normal(size=(200, 2)), 1)
    d = neighbors.distances(x, c)
    monkeypatch.setattr(neighbors, "distances", None)
    got = neighbors.nearest_centers(np.arange(200) * 3, c, x)
    assert got["nearest_id"].tolist() == (d.argmin(axis=1) * 3).tolist()
    assert got["distance"].tolist() == d.min(axis=1).tolist()

import numpy as np
import pytest
from brute import pair_distances
from conftest import make_points

from themeloom.operators import clusters, drift, neighbors, quality, tuning


@pytest.mark.parametrize("small,cell_rows", [(4 << 20, 2048), (0, 30)])
def test_knn_is_exact(spark, blobs, small, cell_rows):
    x = np.vstack([blobs, np.repeat(blobs[:1], 4, axis=0)])
    d = pair_distances(x)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :4]
    found = neighbors.knn_graph(make_points(spark, x), 4, small_bytes=small, cell_rows=cell_rows)
    got = {}
    for r in found.orderBy("row_id", "rank").collect():
        got.setdefault(r["row_id"], []).append(r["distance"])
    assert np.allclose([got[i] for i in range(len(x))], want)


def silhouette_brute(x, labels):
    d, out = pair_distances(x), []
    for i, c in enumerate(labels):
        if c == -1:
            continue
        same = [j for j, k in enumerate(labels) if k == c and j != i]
        if not same:
            out.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(
            d[i, [j for j, k in enumerate(labels) if k == o]].mean() for o in set(labels) - {c, -1}
        )
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouette(spark, blobs):
    labels = np.repeat([0, 1, 2, -1], [30, 30, 30, 10])
    labels[99] = 5  # a singleton
    x = np.vstack([blobs, np.repeat(blobs[:1], 3, axis=0)])
    labels = np.append(labels, [0, 0, 0])
    got = quality.silhouette(make_points(spark, x, labels)).first()["silhouette_score"]
    assert got == pytest.approx(silhouette_brute(x, list(labels)), abs=1e-9)
    lone = make_points(spark, blobs, np.zeros(len(blobs)))
    assert quality.silhouette(lone).first()["silhouette_score"] == 0.0


def test_scores_of_known_sizes(spark):
    labels = [0, 0, 1, 1, 2, 2, -1, -1, 0, 1] * 10
    rng = np.random.default_rng(0)
    p = make_points(spark, rng.random((100, 2)), labels)
    assert quality.balance(p).first()[0] == pytest.approx(0.823223, abs=1e-6)
    r = quality.count_score(p).first()
    assert (r["noise_penalty"], r["cluster_count_score"]) == (pytest.approx(0.8), 0.125)
    counts = clusters.cluster_counts(p).first()
    assert tuple(counts) == (3, 20, 100)
    stats = quality.clustering_statistics(p)
    lines = [r.value for r in clusters.report_lines(stats, clusters.cluster_sizes(p)).collect()]
    assert lines[2:4] == ["clustering.noise = 20", "clustering.noise share = 20.0%"]
    assert lines[-1] == "cluster 2: points 20, share 20.0%"


def test_nearest_cluster(spark):
    centers = spark.createDataFrame(
        [(0, [0.5, 0.3]), (1, [0.2, 0.8])], "cluster_id int, centroid array<double>"
    )
    p = make_points(spark, [[0.3, 0.4]]).select("row_id", "point")
    r = clusters.nearest_cluster(p, centers).first()
    assert r["nearest_cluster"] == 0 and r["distance"] == pytest.approx(0.05**0.5)
    none = clusters.nearest_cluster(p, centers.limit(0)).first()
    assert none["nearest_cluster"] == -1 and none["distance"] == float("inf")


def test_drift(spark):
    vec = lambda rows: spark.createDataFrame([(r,) for r in rows], "embedding array<double>")
    r = drift.drift_decision(drift.drift_score(vec([[0.0, 1.0]]), vec([[1.0, 1.0]]))).first()
    assert r["drift_score"] == pytest.approx(1 - 2**-0.5)
    assert r["needs_retraining"] and r["drift_severity"] == "High"
    z = drift.drift_decision(drift.drift_score(vec([[0.0, 0.0]]), vec([[1.0, 1.0]]))).first()
    assert z["drift_score"] != z["drift_score"] and not z["needs_retraining"]
    same = vec([[1.0, 0.0]])
    assert drift.update_training(same, same).count() == 1
    assert drift.update_training(vec([[0.0, 1.0]]), same).count() == 2


def test_trials(spark):
    t = tuning.random_trials(spark, 20)
    for name, (low, high) in tuning.fixed.SEARCH_SPACE.items():
        assert t.where(f"{name} < {low} OR {name} > {high}").count() == 0
    scored = t.selectExpr("*", "cast(trial_id as double) / 100 as score")
    assert set(tuning.best_parameters(scored)) == {
        "n_components", "min_cluster_size", "min_samples", "epsilon",
    }
    lines = [r.value for r in tuning.optimization_report(scored).collect()]
    assert lines[0] == "trials.count = 20" and "best.score = 0.1900" in lines
    empty = [r.value for r in tuning.optimization_report(scored.limit(0)).collect()]
    assert empty[:2] == ["trials.count = 0", "trials.mean = -"] and len(empty) == 5
    with pytest.raises(ValueError):
        tuning.best_parameters(scored.limit(0))

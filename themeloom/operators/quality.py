"""Cluster-quality metrics. Inputs carry (row_id, point array<double>, cluster_id int)."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import fixed, vector
from themeloom.operators import silhouettes
from themeloom.operators.clusters import NOISE, centroids, cluster_counts, cluster_sizes
from themeloom.operators.blocks import GROUP_BYTES, GROUPS, to_matrix
from themeloom.operators.embed import mean_vector
from themeloom.operators.neighbors import knn_join, pair_distances
from themeloom.runtime import cut, doubles, sized_broadcast

#: Rows of one side of a distance block.
BLOCK_ROWS = 8192

_SUMS = pa.schema([("trial", pa.int64()), ("pid", pa.int64()), ("other", pa.int64()), ("total", pa.float64()), ("least", pa.float64())])


def _members(points: DataFrame) -> DataFrame:
    return points.where(F.col("cluster_id") != NOISE)


# ---------------------------------------------------------------- silhouette


def _folded(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct points (pid, point, weight) of the clusters and their labels (trial 0)."""
    own = cut(
        _members(points)
        .groupBy(
            F.col("cluster_id").cast("bigint").alias("cluster_id"),
            vector.as_double(F.col("point")).alias("point"),
        )
        .agg(F.min("row_id").alias("pid"), F.count(F.lit(1)).alias("weight"))
    )
    return own.select("pid", "point", "weight"), own.select(F.lit(0).cast("bigint").alias("trial"), "pid", "cluster_id")


def silhouette_values(points: DataFrame, labels: DataFrame, squared: bool = False) -> DataFrame:
    """(trial, pid, cluster_id, weight, value): Euclidean silhouette (Rousseeuw 1987) of every
    distinct point (pid, point, weight) under each trial's labels (trial, pid, cluster_id), from
    which noise is left out; 0 in a singleton cluster.

    By definition every distance counts, so the work is quadratic in distinct points. Trials whose
    clusters nest, or are few, share one pass over the distances (``silhouettes``). Others take a pass
    each: points that are asked are dealt to blocks, as are the members, a cluster of up to a block's rows as a whole; each
    pair of blocks is one task. It keeps the least mean distance to its whole clusters, so that only
    sums over parts of large clusters, and over the own one, leave it, however many clusters there
    are. A point is sent once per block; no pair ever leaves a task. ``silhouette_squared`` is the
    linear variant of one labelling.
    """
    points, labels = points.where("pid IS NOT NULL"), labels.where("trial IS NOT NULL AND pid IS NOT NULL AND cluster_id IS NOT NULL")
    every = labels.select("pid").distinct().join(points.select("pid", F.size("point").alias("dim")), "pid")
    most, dim = every.agg(F.count(F.lit(1)), F.max("dim")).first()
    most, dim = most or 0, dim or 1
    # as few blocks as keep a block's vectors small and the tasks many
    ways = max(1, min(GROUPS, ceil(most / BLOCK_ROWS)), ceil(most * 8 * dim / GROUP_BYTES))
    shared = silhouettes.values(points, labels, most, ways, squared)
    if shared is not None:
        return shared
    info = cut(labels.withColumn("trial", F.col("trial").cast("bigint")).join(points, "pid"))
    rows = max(1, ceil(most / ways))
    sizes = info.groupBy("trial", "cluster_id").agg(F.sum("weight").alias("size"), F.ceil(F.count(F.lit(1)) / rows).alias("parts"))
    sizes = sized_broadcast(cut(sizes), 64)
    sums = distance_sums(info, sizes, ways, squared).groupBy("trial", "pid", "other").agg(
        F.sum("total").alias("total"), F.min("least").alias("least")
    )
    sizes = sizes.select("trial", F.col("cluster_id").alias("other"), "size")
    info = info.select("trial", "pid", "cluster_id", "weight")
    same = F.col("other") == F.col("cluster_id")
    per = (
        sums.join(sizes, ["trial", "other"], "left")
        .join(info, ["trial", "pid"])
        .groupBy("trial", "pid", "cluster_id", "weight")
        .agg(
            F.max(F.when(same & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"),
            F.min(F.when(~same, F.col("total") / F.col("size"))).alias("b"),
            F.min(F.when(same, F.col("least"))).alias("least"),
        )
    )
    a, b = F.col("a"), F.least("b", "least")
    value = F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(
        F.when(F.greatest(a, b) == 0, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    )
    return per.select("trial", "pid", "cluster_id", "weight", value.alias("value"))


def distance_sums(info: DataFrame, sizes: DataFrame, ways: int, squared: bool) -> DataFrame:
    """(trial, pid, other, total, least): of a point and a block of members, the sums of distances to
    the parts of large clusters and to its own cluster, and, with its own cluster as ``other``, the
    least mean to another whole cluster."""
    # keys of both sides are of one type: they are hashed
    every, of = F.explode(F.sequence(F.lit(0), F.lit(ways - 1))), lambda h: F.pmod(h, F.lit(ways)).cast("int")
    place = F.xxhash64("trial", "cluster_id") + F.pmod(F.xxhash64("pid"), "parts")
    asked = info.select("trial", "pid", "cluster_id", "point", of(F.xxhash64("pid")).alias("block"), every.alias("other"))
    members = info.join(sizes, ["trial", "cluster_id"]).select(
        F.col("trial").alias("_trial"), F.col("cluster_id").alias("_name"), F.col("point").alias("_point"),
        F.col("weight").alias("_weight"), F.col("size").alias("_size"), (F.col("parts") == 1).alias("_whole"),
        of(place).alias("_other"), every.alias("_block"),
    )

    def run(q: pa.Table, m: pa.Table) -> pa.Table:
        if not q.num_rows or not m.num_rows:
            return _SUMS.empty_table()
        trial, q, m = q["trial"][0].as_py(), q.sort_by("pid"), m.sort_by("_name")
        x, y = to_matrix(q["point"].combine_chunks()), to_matrix(m["_point"].combine_chunks())
        # an id with several rows is asked with their sums, once for each of its clusters
        pid, first, place = np.unique(q["pid"].to_numpy(), return_index=True, return_inverse=True)
        place, mine = np.unique(np.stack([place, q["cluster_id"].to_numpy()]), axis=1)
        first, until = np.r_[first, len(x)], np.searchsorted(place, np.arange(len(pid) + 1))
        weight, name = m["_weight"].to_numpy().astype(float), m["_name"].to_numpy()
        starts = np.flatnonzero(np.r_[True, np.diff(name) != 0])
        names, size = name[starts], m["_size"].to_numpy()[starts].astype(float)
        whole = m["_whole"].to_numpy()[starts].astype(bool)
        out, step = [], max(1, 4_000_000 // len(y))

        def keep(pids, others, totals, least):
            n = len(pids)
            out.append(pa.table({
                "trial": pa.array(np.full(n, trial)), "pid": pa.array(pids), "other": pa.array(others, pa.int64()),
                "total": pa.array(totals) if totals is not None else pa.nulls(n, pa.float64()), "least": pa.array(least) if least is not None else pa.nulls(n, pa.float64()),
            }, schema=_SUMS))

        for at in range(0, len(pid), step):
            to = min(at + step, len(pid))
            d = pair_distances(x[first[at] : first[to]], y, squared)
            if (weight != 1).any():
                d *= weight
            total = np.add.reduceat(d, starts, axis=1)
            if len(total) > to - at:
                total = np.add.reduceat(total, first[at:to] - first[at], axis=0)
            for c in np.flatnonzero(~whole):
                keep(pid[at:to], np.full(to - at, names[c]), total[:, c], None)
            if not whole.any():
                continue
            own, row = mine[until[at] : until[to]], place[until[at] : until[to]] - at
            j = np.minimum(np.searchsorted(names, own), len(names) - 1)
            home = np.flatnonzero(names[j] == own)
            i = home[whole[j[home]]]
            keep(pid[at + row[i]], own[i], total[row[i], j[i]], None)
            total = total[row] / size
            total[home, j[home]] = np.inf
            least = total[:, whole].min(axis=1)
            i = np.flatnonzero(np.isfinite(least))
            keep(pid[at + row[i]], own[i], None, least[i])
        return pa.concat_tables(out)

    found = asked.groupBy("trial", "block", "other").cogroup(members.groupBy("_trial", "_block", "_other"))
    return found.applyInArrow(run, "trial bigint, pid bigint, other bigint, total double, least double")


def _mean_or_zero(values: DataFrame) -> DataFrame:
    """Weighted mean; 0 below two points or two clusters."""
    n, k = F.sum("weight"), F.countDistinct("cluster_id")
    return values.agg(
        F.when((n > 1) & (k > 1), F.sum(F.col("value") * F.col("weight")) / n)
        .otherwise(F.lit(0.0))
        .alias("silhouette_score")
    ).select(F.coalesce("silhouette_score", F.lit(0.0)).alias("silhouette_score"))


def silhouette(points: DataFrame) -> DataFrame:
    """One row ``silhouette_score``: mean Euclidean silhouette without noise."""
    return _mean_or_zero(silhouette_values(*_folded(points)))


def silhouette_squared(points: DataFrame) -> DataFrame:
    """One row ``silhouette_score`` with squared Euclidean distances, linear in the points.

    The mean squared distance of x to cluster c is |x - m_c|^2 + v_c, with m_c the centroid
    and v_c the mean squared distance of its members to it: a squared distance from (x, 0)
    to (m_c, sqrt v_c). The closest other cluster is thus a nearest-neighbour question.
    """
    members = _members(points).select(
        "row_id", vector.as_double(F.col("point")).alias("point"), "cluster_id"
    )
    centers = cut(centroids(members))
    spread = (
        members.join(sized_broadcast(centers, 64, extra=doubles("centroid")), "cluster_id")
        .groupBy("cluster_id")
        .agg(
            F.avg(vector.squared_euclidean(F.col("point"), F.col("centroid"))).alias("v"),
            F.count(F.lit(1)).alias("size"),
        )
    )
    lifted = cut(
        centers.join(spread, "cluster_id").select(
            F.col("cluster_id").cast("bigint").alias("row_id"),
            F.concat("centroid", F.array(F.sqrt("v"))).alias("point"),
            "size",
        )
    )
    asked = members.select("row_id", F.concat("point", F.array(F.lit(0.0))).alias("point"))
    near = knn_join(asked, lifted, 2)
    own = F.col("neighbor_id") == F.col("cluster_id")
    other = (
        near.join(members.select("row_id", "cluster_id"), "row_id")
        .groupBy("row_id", "cluster_id")
        .agg(F.min(F.when(~own, F.col("distance") * F.col("distance"))).alias("b"))
    )
    mine = lifted.select(
        F.col("row_id").alias("cluster_id"), F.col("point").alias("home"), "size"
    )
    scored = (
        members.join(sized_broadcast(mine, 64, extra=doubles("home")), "cluster_id")
        .select(
            "row_id",
            "cluster_id",
            F.when(
                F.col("size") > 1,
                vector.squared_euclidean(
                    F.concat("point", F.array(F.lit(0.0))), F.col("home")
                )
                * F.col("size")
                / (F.col("size") - 1),
            ).alias("a"),
        )
        .join(other.drop("cluster_id"), "row_id")
    )
    a, b = F.col("a"), F.col("b")
    value = F.when(
        a.isNull() | b.isNull() | (F.greatest(a, b) == 0), F.lit(0.0)
    ).otherwise((b - a) / F.greatest(a, b))
    return _mean_or_zero(
        scored.select("cluster_id", F.lit(1).alias("weight"), value.alias("value"))
    )


METRICS = {"euclidean": silhouette, "squared_euclidean": silhouette_squared}
METRIC_SQUARED = {"euclidean": False, "squared_euclidean": True}


def silhouette_by(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """One row (silhouette_score, silhouette_metric).

    The Euclidean score takes quadratic work in bounded blocks; ``squared_euclidean`` is another
    score, with linear work, for those who ask for it.
    """
    return METRICS[metric](points).withColumn("silhouette_metric", F.lit(metric))


# ---------------------------------------------------------------- labels and statistics


def quality_label(num_clusters: Column, num_noise: Column, total: Column, score: Column) -> Column:
    ratio = F.when(total > 0, num_noise / total).otherwise(F.lit(0.0))
    return (
        F.when(num_clusters == 0, fixed.Q_NONE)
        .when(ratio > 0.5, fixed.Q_NOISE)
        .when(score < 0.1, fixed.Q_LOW)
        .when(score < 0.3, fixed.Q_MID)
        .otherwise(fixed.Q_HIGH)
    )


def clustering_statistics(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """One row: counts, silhouette with its metric, and the quality label."""
    counts = cluster_counts(points)
    score = silhouette_by(points, metric).first()
    return counts.select(
        "*",
        F.lit(score["silhouette_score"]).alias("silhouette_score"),
        F.lit(score["silhouette_metric"]).alias("silhouette_metric"),
    ).withColumn(
        "clustering_quality",
        quality_label(
            F.col("num_clusters"),
            F.col("num_noise_points"),
            F.col("total_points"),
            F.col("silhouette_score"),
        ),
    )


# ---------------------------------------------------------------- score parts


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """One row ``calinski_harabasz`` (Calinski and Harabasz 1974)."""
    members = _members(points)
    centers = centroids(members)
    sizes = cluster_sizes(members)
    between = (
        centers.join(sizes, "cluster_id")
        .withColumn("_grand", mean_vector(members, "point").scalar())
        .select(
            (F.col("size") * vector.squared_euclidean(F.col("centroid"), F.col("_grand"))).alias("x")
        )
        .agg(F.sum("x"))
        .scalar()
    )
    within = (
        members.join(sized_broadcast(centers, 64, extra=doubles("centroid")), "cluster_id")
        .select(
            vector.squared_euclidean(
                vector.as_double(F.col("point")), F.col("centroid")
            ).alias("x")
        )
        .agg(F.sum("x"))
        .scalar()
    )
    n, k = F.col("n"), F.col("k")
    counts = sizes.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.select("n", "k", between.alias("b"), within.alias("w")).select(
        F.when((k < 2) | (n <= k), F.lit(0.0))
        .when(F.col("w") == 0, F.lit(1.0))
        .otherwise((F.col("b") / (k - 1)) / (F.col("w") / (n - k)))
        .alias("calinski_harabasz")
    )


def balance(points: DataFrame) -> DataFrame:
    """One row ``cluster_balance`` = 1 - population deviation / mean of cluster sizes."""
    return cluster_sizes(points).agg(
        F.when(F.count(F.lit(1)) > 1, 1 - F.stddev_pop("size") / F.avg("size"))
        .otherwise(F.lit(0.0))
        .alias("cluster_balance")
    )


def count_score(points: DataFrame) -> DataFrame:
    """One row: noise_penalty = 1 - noise ratio and cluster_count_score around ten."""
    return cluster_counts(points).select(
        F.when(
            F.col("total_points") > 0, 1 - F.col("num_noise_points") / F.col("total_points")
        )
        .otherwise(F.lit(0.0))
        .alias("noise_penalty"),
        (1 / (1 + F.abs(F.col("num_clusters") - 10))).alias("cluster_count_score"),
    )


def trial_scores(
    points: DataFrame, labels: DataFrame, total: int, trials: list[int], metric: str = "euclidean"
) -> DataFrame:
    """(trial, silhouette, calinski_harabasz, cluster_balance, noise_penalty, cluster_count_score,
    score) of several labellings (trial, pid, cluster_id; noise left out) of the same distinct
    points (pid, point, weight), which stand for ``total`` rows. All trials share one pass over the
    distances and one over the members."""
    spark = points.sparkSession
    asked = spark.createDataFrame([(int(i),) for i in trials], "trial bigint")
    members = points.join(labels, "pid")
    v = array_to_vector(F.col("point"))
    per = members.groupBy("trial", "cluster_id").agg(
        F.sum("weight").alias("n"),
        Summarizer.mean(v, F.col("weight").cast("double")).alias("center"),
    )
    per = cut(per.withColumn("center", vector_to_array("center")))
    # spread within a cluster is taken from its center, not as a difference of large squares
    spread = (
        members.select("trial", "cluster_id", "point", "weight")
        .join(sized_broadcast(per.drop("n"), 64, extra=doubles("center")), ["trial", "cluster_id"])
        .groupBy("trial")
        .agg(F.sum(F.col("weight") * vector.squared_euclidean(F.col("point"), F.col("center"))).alias("within"))
    )
    whole = per.groupBy("trial").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.when(F.count(F.lit(1)) > 1, 1 - F.stddev_pop("n") / F.avg("n")).otherwise(F.lit(0.0)).alias("cluster_balance"),
        vector_to_array(Summarizer.mean(array_to_vector("center"), F.col("n").cast("double"))).alias("grand"),
    )
    between = (
        per.select("trial", F.col("n").alias("size"), "center")
        .join(whole.select("trial", "grand"), "trial")
        .groupBy("trial")
        .agg(F.sum(F.col("size") * vector.squared_euclidean(F.col("center"), F.col("grand"))).alias("between"))
    )
    means = (
        silhouette_values(points, labels, METRIC_SQUARED[metric])
        .groupBy("trial")
        .agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"))
    )
    facts = asked
    for part in (whole.drop("grand"), spread, between, means):
        facts = facts.join(part, "trial", "left")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    noise = F.lit(1.0) - (F.lit(total) - n) / F.lit(max(total, 1))
    ratio = (F.col("between") / (k - 1)) / (F.col("within") / (n - k))
    parts = facts.select(
        "trial",
        F.when((n > 1) & (k > 1), F.col("mean")).otherwise(F.lit(0.0)).alias("silhouette"),
        F.when((k < 2) | (n <= k), F.lit(0.0)).when(F.col("within") == 0, F.lit(1.0)).otherwise(ratio).alias("calinski_harabasz"),
        F.coalesce("cluster_balance", F.lit(0.0)).alias("cluster_balance"),
        (noise if total else F.lit(1.0)).alias("noise_penalty"),
        (1 / (1 + F.abs(k - 10))).alias("cluster_count_score"),
        ((n >= 2) & (k >= 2)).alias("ok"),
    )
    # --- fixed values: weights of the parts ---
    weighted = (
        0.4 * F.col("silhouette")
        + 0.2 * F.col("calinski_harabasz") / 1000
        + 0.2 * F.col("cluster_balance")
        + 0.1 * F.col("noise_penalty")
        + 0.1 * F.col("cluster_count_score")
    )
    return parts.select("*", F.when(F.col("ok"), weighted).otherwise(F.lit(0.0)).alias("score")).drop("ok")


def composite_score(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """One row with the parts and their weighted ``score``; 0 below two points or clusters."""
    return trial_scores(*_folded(points), points.count(), [0], metric).drop("trial")

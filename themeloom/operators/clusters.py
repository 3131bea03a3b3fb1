"""Statistics, samples and similarity of given clusters; assignment to centroids.

Inputs carry (row_id, point array<double>, cluster_id int); cluster_id -1 is noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import vector
from themeloom.operators import report
from themeloom.operators.embed import mean_of
from themeloom.operators.neighbors import with_nearest
from themeloom.runtime import doubles, sized_broadcast

NOISE = -1


def centroids(points: DataFrame, point: str = "point") -> DataFrame:
    """(cluster_id, centroid): mean point of every cluster but noise."""
    return (
        points.where(F.col("cluster_id") != NOISE)
        .groupBy("cluster_id")
        .agg(mean_of(F.col(point)).alias("centroid"))
    )


def cluster_sizes(points: DataFrame) -> DataFrame:
    return (
        points.where(F.col("cluster_id") != NOISE)
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("size"))
    )


def cluster_counts(points: DataFrame) -> DataFrame:
    """One row: clusters, noise points, all points."""
    per = points.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    noise = F.col("cluster_id") == NOISE
    return per.agg(
        F.count_if(~noise).alias("num_clusters"),
        F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)).alias("num_noise_points"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_points"),
    )


def cluster_samples(points: DataFrame, texts: DataFrame | None = None, n: int = 10) -> DataFrame:
    """(cluster_id, samples): the first ``n`` texts of each cluster by row_id.

    The row ids are ranked first (n per cluster and task survive before the shuffle);
    only the winners fetch their text.
    """
    w = Window.partitionBy("cluster_id").orderBy("row_id")
    keep = ["row_id", "cluster_id"] + ([] if texts is not None else ["text"])
    ranked = (
        points.where(F.col("cluster_id") != NOISE)
        .select(*keep)
        .withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= n)
    )
    if texts is not None:
        ranked = texts.select("row_id", "text").join(sized_broadcast(ranked, 64), "row_id")
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "text")))
    return ranked.groupBy("cluster_id").agg(
        F.transform(ordered, lambda s: s["text"]).alias("samples")
    )


def cluster_summary(points: DataFrame, centers: DataFrame, samples: DataFrame) -> DataFrame:
    """(cluster_id, size, avg_distance_to_centroid, centroid, sample_texts)."""
    c = sized_broadcast(centers, 64, extra=doubles("centroid"))
    per = (
        points.where(F.col("cluster_id") != NOISE)
        .join(c, "cluster_id")
        .groupBy("cluster_id")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.avg(vector.euclidean(F.col("point"), F.col("centroid"))).alias(
                "avg_distance_to_centroid"
            ),
        )
    )
    return (
        per.join(centers, "cluster_id")
        .join(samples, "cluster_id")
        .select(
            "cluster_id",
            "size",
            "centroid",
            "avg_distance_to_centroid",
            F.slice("samples", 1, 5).alias("sample_texts"),
        )
    )


def one_cluster_summary(summaries: DataFrame, cluster_id: int) -> DataFrame:
    if cluster_id == NOISE:
        raise ValueError("Cannot summarize noise cluster")
    return summaries.where(F.col("cluster_id") == cluster_id)


def similar_clusters(centers: DataFrame, target: int, threshold: float = 0.8) -> DataFrame:
    """(cluster_id, similarity) of clusters whose centroid is close to the target's.

    The target's centroid is a scalar subquery, so the table is read once and never
    paired with itself; an unknown target gives no rows.
    """
    aim = centers.where(F.col("cluster_id") == target).select("centroid").scalar()
    return (
        centers.where(F.col("cluster_id") != target)
        .withColumn("_aim", aim)  # a subquery may not sit inside a lambda
        .withColumn("similarity", vector.cosine(F.col("_aim"), F.col("centroid")))
        .where(F.col("similarity") >= threshold)
        .select("cluster_id", "similarity")
        .orderBy(F.desc("similarity"), "cluster_id")
    )


def nearest_cluster(points: DataFrame, centers: DataFrame, point: str = "point") -> DataFrame:
    """Add (nearest_cluster, distance) by Euclidean distance to the centroids; without
    centroids (-1, inf); ties go to the lowest cluster id."""
    near = with_nearest(
        points,
        centers.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("point")),
        point,
    )
    return near.select(
        *points.columns,
        F.coalesce(F.col("nearest_id"), F.lit(NOISE))
        .cast(centers.schema["cluster_id"].dataType)
        .alias("nearest_cluster"),
        F.coalesce(F.col("distance"), F.lit(float("inf"))).alias("distance"),
    )


def cluster_radii(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster_id, centroid, radius): largest training distance to the centroid."""
    c = sized_broadcast(centers, 64, extra=doubles("centroid"))
    radii = (
        points.join(c, "cluster_id")
        .groupBy("cluster_id")
        .agg(F.max(vector.euclidean(F.col("point"), F.col("centroid"))).alias("radius"))
    )
    return centers.join(radii, "cluster_id")


def predict_assign(new_points: DataFrame, radii: DataFrame) -> DataFrame:
    """(row_id, point, cluster_id): nearest centroid, noise beyond its training radius."""
    near = nearest_cluster(new_points.select("row_id", "point"), radii)
    reach = radii.select(F.col("cluster_id").alias("nearest_cluster"), "radius")
    return near.join(sized_broadcast(reach, 32), "nearest_cluster", "left").select(
        "row_id",
        "point",
        F.when(F.col("distance") <= F.col("radius"), F.col("nearest_cluster"))
        .otherwise(F.lit(NOISE))
        .cast(radii.schema["cluster_id"].dataType)
        .alias("cluster_id"),
    )


def prediction_statistics(predicted: DataFrame) -> DataFrame:
    counts = cluster_counts(predicted)
    ratio = F.col("num_noise_points") / F.col("total_points")
    return counts.withColumn(
        "prediction_quality",
        F.when((F.col("total_points") > 0) & (ratio < 0.3), F.lit("Good")).otherwise(F.lit("Fair")),
    )


def model_statistics(training: DataFrame, centers: DataFrame) -> DataFrame:
    """One row: training rows, clusters, and the sorted cluster ids."""
    n = training.agg(F.count(F.lit(1)).alias("n")).scalar()
    return centers.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.concat_ws(
            ",", F.transform(F.array_sort(F.collect_list("cluster_id")), lambda c: c.cast("string"))
        ).alias("cluster_ids"),
    ).select(n.alias("n_training_samples"), "n_clusters", "cluster_ids")


def report_lines(stats: DataFrame, sizes: DataFrame) -> DataFrame:
    """Report lines of one statistics row and the sizes of the clusters."""
    total = stats.select("total_points").scalar()
    head = {
        "points": F.col("total_points"),
        "clusters": F.col("num_clusters"),
        "noise": F.col("num_noise_points"),
        "noise share": report.percent(F.col("num_noise_points"), F.col("total_points")),
        "silhouette": report.number(F.col("silhouette_score")),
        "quality": F.col("clustering_quality"),
    }
    body = {"points": F.col("size"), "share": report.percent(F.col("size"), total)}
    return report.ordered(
        report.facts(0, "clustering", stats, head), report.items(1, "cluster", sizes, "cluster_id", body)
    )

"""Themes of several inputs: what they share and what is exclusive to each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.neighbors import cosine_top_k
from themeloom.runtime import cut


def best_matches(left: DataFrame, right: DataFrame, dim: int) -> DataFrame:
    """(cluster_id, match_id, similarity): for every left theme the right theme with the
    closest centroid by cosine. A neighbour search, not a pairing of all themes."""
    near = cosine_top_k(
        left.select(F.col("cluster_id").cast("bigint").alias("row_id"), F.col("centroid").alias("point")),
        right.select(F.col("cluster_id").cast("bigint").alias("row_id"), F.col("centroid").alias("point")),
        dim,
        1,
    )
    return near.select(
        F.col("row_id").alias("cluster_id"),
        F.col("neighbor_id").alias("match_id"),
        "similarity",
    )


def shared_themes(left: DataFrame, right: DataFrame, dim: int, threshold: float = 0.8) -> DataFrame:
    """Left themes with a right theme at ``threshold`` cosine or closer."""
    return best_matches(left, right, dim).where(F.col("similarity") >= threshold)


def exclusive_themes(left: DataFrame, right: DataFrame, dim: int, threshold: float = 0.8) -> DataFrame:
    """cluster_id of left themes without such a right theme."""
    matched = shared_themes(left, right, dim, threshold)
    return left.select("cluster_id").join(matched, "cluster_id", "left_anti")


def compare_files(left: DataFrame, right: DataFrame, dim: int, threshold: float = 0.8) -> DataFrame:
    """One row: shared_themes (left themes with a match) and unique_themes (themes of
    either side without one)."""
    shared = cut(shared_themes(left, right, dim, threshold))
    only_left = left.select("cluster_id").join(shared, "cluster_id", "left_anti")
    only_right = exclusive_themes(right, left, dim, threshold)
    unique = only_left.unionAll(only_right).agg(F.count(F.lit(1)).alias("n")).scalar()
    return shared.agg(F.count(F.lit(1)).alias("shared_themes")).select(
        "shared_themes", unique.alias("unique_themes")
    )

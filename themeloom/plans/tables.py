"""Views of the given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.runtime import widen


#: Tables whose rows take real work, with their keys.
WIDE = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return widen(df, WIDE[name]) if name in WIDE else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (row_id, text, lang, source, n_chars)."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), "text", "lang", "source", "n_chars")


def themed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (row_id, text, cluster_id): the number of the source is the cluster."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_id"),
        "text",
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("cluster_id"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (row_id, point, cluster_id): label 0 stands for noise."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("point"),
        F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).cast("int").alias("cluster_id"),
    )


def flat_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the first two coordinates as the point."""
    return points(spark, sf_dir).withColumn("point", F.slice("point", 1, 2))


#: SQL twins of the views above.
TEXTS = "(SELECT doc_id AS row_id, text, lang, source, n_chars FROM documents)"
THEMED = (
    "(SELECT doc_id AS row_id, text, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) "
    "AS cluster_id FROM documents)"
)
POINTS = (
    "(SELECT vec_id AS row_id, embedding::DOUBLE[] AS point, "
    "CASE WHEN label = 0 THEN -1 ELSE label END AS cluster_id FROM embeddings)"
)
FLAT = (
    "(SELECT vec_id AS row_id, embedding[1:2]::DOUBLE[] AS point, "
    "CASE WHEN label = 0 THEN -1 ELSE label END AS cluster_id FROM embeddings)"
)

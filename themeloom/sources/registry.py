"""Results by analysis id: one table, one partition per analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.sources.scan import hadoop_path, path_exists


def analysis_id(path: Column, column: Column) -> Column:
    """Stable id of an input and its text column."""
    return F.concat(F.lit("analysis_"), F.xxhash64(path, column).cast("string"))


def analysis_id_of(spark: SparkSession, path: str, column: str) -> str:
    return spark.range(1).select(analysis_id(F.lit(path), F.lit(column)).alias("id")).first()["id"]


def _folder(root: str, key: str) -> str:
    return f"{root}/analysis_id={key}"


def put(result: DataFrame, root: str, key: str) -> None:
    result.write.mode("overwrite").parquet(_folder(root, key))


def get(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The partition of one analysis; a missing id is a ``KeyError``."""
    if not path_exists(spark, _folder(root, key)):
        raise KeyError(f"Analysis not found: {key}")
    return spark.read.option("basePath", root).parquet(_folder(root, key))


def delete(spark: SparkSession, root: str, key: str) -> None:
    if not path_exists(spark, _folder(root, key)):
        raise KeyError(f"Analysis not found: {key}")
    p, fs = hadoop_path(spark, _folder(root, key))
    fs.delete(p, True)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(analysis_id, rows) of everything stored."""
    return (
        spark.read.option("mergeSchema", True)
        .parquet(root)
        .groupBy("analysis_id")
        .agg(F.count(F.lit(1)).alias("rows"))
    )

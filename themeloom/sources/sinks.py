"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which CSV can hold."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Values come back from ``scan.read_csv`` as they were, outer blanks included; only
    missing-value words turn into NULL there."""
    (
        _flat(df)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_processed(records: DataFrame, folder: str) -> None:
    write_csv(records, f"{folder}/processed_summaries.csv")


def write_clustering(points: DataFrame, folder: str) -> None:
    """x, y, cluster of every point."""
    flat = points.select(
        F.col("point")[0].alias("x"), F.col("point")[1].alias("y"), F.col("cluster_id").alias("cluster")
    )
    write_csv(flat, f"{folder}/clustering_results.csv")


def write_themes(themes: DataFrame, folder: str) -> None:
    rows = themes.select(
        "cluster_id",
        F.col("name").alias("theme_name"),
        "description",
        "sample_count",
        "data_quality_issues",
        "data_quality_percentage",
    )
    write_csv(rows, f"{folder}/theme_analysis.csv")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short report as one text file."""
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered report lines (part, line, value) as text files in name order."""
    lines.orderBy("part", "line").select("value").write.mode("overwrite").text(path)


def write_report(spark: SparkSession, text: str, folder: str) -> None:
    write_text(spark, text, f"{folder}/analysis_report.txt")

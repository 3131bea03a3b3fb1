"""Scans: CSV inputs, landing folder, previews."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions import fixed
from themeloom.operators.profile import detect_text_column
from themeloom.operators.rows import normalize_na
from themeloom.runtime import with_row_id


def check_suffix(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in fixed.SUFFIXES:
        raise ValueError(f"Unsupported file format: {suffix}")
    if suffix != ".csv":
        raise ValueError(f"No Spark source for {suffix}: convert to .csv")
    return suffix


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def file_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file, or of all files of a folder."""
    p, fs = hadoop_path(spark, path)
    return fs.getContentSummary(p).getLength()


def _reader(spark: SparkSession, schema: T.StructType | None, multi_line: bool = True):
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("enforceSchema", False)
    )
    return reader.schema(schema) if schema else reader.option("inferSchema", True)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV table(s) with NA tokens as NULL and a ``row_id`` in file order.

    Give a schema for repeated jobs: inference reads the input once more. A file whose quoted
    fields hold line breaks is read by one task; without any, ``multi_line=False`` splits it.
    """
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        check_suffix(p)
        if not path_exists(spark, p):
            raise FileNotFoundError(f"File not found: {p}")
    # one scan a path: within one scan files are ordered by size, not as they are listed
    whole = None
    for p in paths:
        part = _reader(spark, schema, multi_line).csv(p)
        whole = part if whole is None else whole.unionByName(part)
    return with_row_id(normalize_na(whole))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("CSV file is empty")
    return df


def load(
    spark: SparkSession, path: str, column: str | None = None, schema: T.StructType | None = None
) -> tuple[DataFrame, str]:
    """Table and the name of its text column, named by the caller or detected."""
    df = require_rows(read_csv(spark, path, schema))
    if column is None:
        column = detect_text_column(df, policy="first")
        if column is None:
            raise ValueError("No suitable summary column found")
        return df, column
    if column not in df.columns:
        have = ", ".join(c for c in df.columns if c != "row_id")
        raise ValueError(f"Column '{column}' not found. Available columns: {have}")
    if df.agg(F.count(f"`{column}`")).first()[0] == 0:
        raise ValueError(f"Column '{column}' contains no data")
    return df, column


def preview(df: DataFrame) -> DataFrame:
    """One row: column names and row count."""
    names = ",".join(c for c in df.columns if c != "row_id")
    return df.agg(F.lit(names).alias("column_names"), F.count(F.lit(1)).alias("total_rows"))


def land(df: DataFrame, folder: str) -> DataFrame:
    """Write an input once as parquet and read it back: fixed row ids, column pruning and
    pushed filters for everything downstream."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def land_csv(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Copy a CSV file, or a folder of its parts, into the landing folder and report it: one row
    (path, file_name, file_size). A name that is there already is replaced once the copy is whole."""
    check_suffix(path)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    source, fs = hadoop_path(spark, path)
    name = source.getName()
    target, to = hadoop_path(spark, f"{folder}/{name}")
    partial, _ = hadoop_path(spark, f"{folder}/_{name}.partial")
    conf = spark._jsc.hadoopConfiguration()
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to, partial, False, True, conf)
    to.delete(target, True)
    if not to.rename(partial, target):
        raise OSError(f"cannot land {name}")
    size = to.getContentSummary(target).getLength()
    return spark.range(1).select(
        F.lit(target.toString()).alias("path"), F.lit(name).alias("file_name"), F.lit(size).cast("bigint").alias("file_size")
    )


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, file_size) of the .csv files of a landing folder."""
    # file metadata only: content is pruned, so nothing but the listing is read
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.col("length").alias("file_size"),
        )
    )


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_name, row_id, text) of several CSV files with differing text columns."""
    out = None
    for path in paths:
        df, column = load(spark, path)
        part = df.select(
            F.lit(PurePosixPath(path).name).alias("file_name"),
            F.col(f"`{column}`").cast("string").alias("text"),
        )
        out = part if out is None else out.unionByName(part)
    return with_row_id(out).select("file_name", "row_id", "text")

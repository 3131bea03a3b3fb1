"""Pieces that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.runtime import ensure_checkpoint_dir

#: A word of every contract: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_bits(value: Column, salt: str = "") -> Column:
    """A 60-bit uniform number from the MD5 of a value's text form (null as empty)."""
    text = F.concat(F.lit(salt), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def interval(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are at most the value, by binary search.

    The bounds travel as one text that the optimizer folds into an array.
    """
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    keys = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: at
        + F.when(F.get(keys, at + step - F.lit(1)) <= value, step).otherwise(F.lit(0)),
    )


def local_form(uri: str) -> str:
    """A folder's address as pyarrow's file systems take it."""
    if uri.startswith("file:"):
        return "file:///" + uri[5:].lstrip("/")
    return uri if "://" in uri else f"file://{uri}"


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{local_form(ensure_checkpoint_dir(spark))}/{name}"


def hadoop_path(spark: SparkSession, uri: str):
    """(file system, path) of an address on the driver's JVM."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Rename finished temporary files to their final names; the number of files is the bound."""
    for old, new in moves:
        fs, path = hadoop_path(spark, old)
        if not fs.rename(path, hadoop_path(spark, new)[1]):
            raise OSError(f"cannot rename {old} to {new}")


def write_small(spark: SparkSession, uri: str, text: str) -> None:
    """Write a small text under a temporary name, then rename it."""
    fs, path = hadoop_path(spark, f"{uri}.tmp")
    out = fs.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()
    publish(spark, [(f"{uri}.tmp", uri)])

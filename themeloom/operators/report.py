"""Reports as ordered lines, one fact or one item a line, so that executors can write them.

Every line has its part of the report, its place there and its text. Facts read
``section.name = value``, items ``section key: name value, name value``; a missing value is ``-``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("-"))


def number(value: Column, places: int = 3) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value.cast("double")))


def percent(part: Column, whole: Column) -> Column:
    """A share in percent; 0 of nothing."""
    share = F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))
    return F.concat(number(share, 1), F.lit("%"))


def facts(part: int, section: str, row: DataFrame, values: dict[str, Column]) -> DataFrame:
    """A line for every value of a frame of one row."""
    lines = [F.concat(F.lit(f"{section}.{name} = "), _shown(v)) for name, v in values.items()]
    return row.select(F.posexplode(F.array(*lines)).alias("line", "value")).select(
        F.lit(part).alias("part"), F.col("line").cast("bigint").alias("line"), "value"
    )


def items(part: int, section: str, rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """A line for every row, in order of its key."""
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{name} "), _shown(v)) for name, v in values.items()])
    return rows.select(
        F.lit(part).alias("part"),
        F.col(key).cast("bigint").alias("line"),
        F.concat(F.lit(f"{section} "), F.col(key).cast("string"), F.lit(": "), shown).alias("value"),
    )


def ordered(*parts: DataFrame) -> DataFrame:
    """The parts of a report, in order."""
    return reduce(DataFrame.unionByName, parts).orderBy("part", "line")

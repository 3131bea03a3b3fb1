"""Session helpers: lineage cuts, size-checked broadcasts, row identity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Ceiling for anything shipped whole to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024

#: Ceiling for a piece of work handed to one task (rows of a block, edges of a group).
TASK_ROWS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the one the session names, else a scratch one.

    A scratch folder is only made in local mode; on a cluster every executor must
    reach the folder, so an unset ``spark.checkpoint.dir`` is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="themeloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return sc.getCheckpointDir()


#: Tables written by ``cut`` in this process, for ``drop_cuts``.
_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    A lost executor costs one read, not a recomputation. A table is used rather than
    ``checkpoint()`` because that keeps the size estimate of the old plan, and estimates
    multiply with every join of an iterative job; the files tell the planner real sizes.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/themeloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_measured(df: DataFrame, measures: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates of the rows that are taken while they are written."""
    seen = Observation()
    written = cut(df.observe(seen, *[c.alias(name) for name, c in measures.items()]))
    return written, seen.get


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables ``cut`` wrote; call when results derived from them are stored."""
    conf = spark._jsc.hadoopConfiguration()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def fits(
    df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, extra: Column | None = None
) -> bool:
    """True when ``df`` holds at most ``limit`` bytes: ``row_bytes`` a row, and ``extra``, the bytes
    of a row's arrays or texts, as measured.

    The count stops one row past the ceiling, so a huge side costs no full scan.
    """
    ceiling = max(1, limit // max(1, row_bytes))
    more = F.lit(0) if extra is None else F.coalesce(extra, F.lit(0)).cast("bigint")
    head = df.select(more.alias("more")).limit(ceiling + 1)
    n, wide = head.agg(F.count(F.lit(1)), F.coalesce(F.sum("more"), F.lit(0))).first()
    return n <= ceiling and n * row_bytes + wide <= limit


def sized_broadcast(
    df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, extra: Column | None = None
) -> DataFrame:
    """Hint a broadcast only when the side is proven small; else leave it to a shuffle
    join, whose hot keys AQE splits."""
    return F.broadcast(df) if fits(df, row_bytes, limit, extra) else df


def doubles(column: str) -> Column:
    """Bytes of an array of doubles."""
    return F.size(column) * 8


def widen(df: DataFrame, key: str) -> DataFrame:
    """Spread an input that has fewer partitions than the session has cores.

    Text work is CPU bound, so a single-file table would leave cores idle. Rows are hashed
    on the row key, which later groupings by text reuse. Inputs with enough splits, which
    is every large one, pass through untouched.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, key)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Give rows increasing ids in input order (unique, not gap-free; one pass).

    The ids belong to this read of the input: land or ``cut`` the result before it is
    used twice, so that a recomputed partition can never renumber its rows.
    """
    return df.select(F.monotonically_increasing_id().alias(name), *df.columns)


def tidy(x: Column, places: int = 6) -> Column:
    """Round and turn -0.0 into 0.0 so equal results compare equal."""
    return F.round(x, places) + F.lit(0.0)

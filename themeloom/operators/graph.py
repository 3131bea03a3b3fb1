"""Connected components as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.runtime import TASK_ROWS, cut_measured

_KEY = ["part", "a"]


def connected_components(edges: DataFrame, by: str | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b); comp is the smallest node reached.

    With ``by``, edges of different values of that column belong to graphs of their own, and the
    result carries the column. The edges are dealt to tasks of about ``task_rows``, each of which
    replaces its own by stars around their smallest nodes. Large-star and small-star steps (Kiveris et al. 2014) then
    alternate until nothing changes: minima per node are combined map-side, and a node with most of
    the edges meets its one-row minimum in a join whose hot key AQE splits.
    """
    pairs = edges.select((F.col(by) if by else F.lit(0)).cast("bigint").alias("part"), "a", "b").where("a <> b")
    h = F.xxhash64("part", "a", "b")
    mark = {"n": F.count(F.lit(1)), "x": F.bit_xor(h), "s": F.sum(F.shiftright(h, 20))}
    pairs, seen = cut_measured(pairs, {"n": mark["n"]})
    tasks = max(1, ceil(seen["n"] / task_rows))
    e, now = cut_measured(pairs.coalesce(tasks).mapInPandas(_stars(task_rows), "part bigint, a bigint, b bigint"), mark)
    # stars of one task are whole components
    before = now if tasks == 1 else None
    while now != before:
        before = now
        e, now = cut_measured(_small_star(_large_star(e)), mark)
    roots = e.select("part", F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    found = e.select("part", F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
    return found.withColumnRenamed("part", by) if by else found.drop("part")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select("part", F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(*_KEY).agg(F.min("b").alias("m"))
    low = low.select(*_KEY, F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, _KEY).select("part", F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy(*_KEY).agg(F.min("b").alias("m"))
    moved = e.join(low, _KEY).where("b <> m").select("part", F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(*_KEY, F.col("m").alias("b"))).distinct()


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0 to n - 1 that each is linked to by edges (a, b), within one task."""
    label, before = np.arange(n), None
    while before is None or not np.array_equal(label, before):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


def _stars(task_rows: int):
    def joined(f: pd.DataFrame) -> pd.DataFrame:
        part = f["part"].to_numpy()
        ends = np.concatenate([f["a"].to_numpy(), f["b"].to_numpy()])
        both = np.concatenate([part, part])
        order = np.lexsort((ends, both))
        new = np.r_[True, (np.diff(both[order]) != 0) | (np.diff(ends[order]) != 0)]
        code = np.empty(len(ends), np.int64)
        code[order] = np.cumsum(new) - 1
        part, node = both[order][new], ends[order][new]
        label = least_labels(code[: len(f)], code[len(f) :], len(node))
        leaf = label != np.arange(len(node))
        return pd.DataFrame({"part": part[leaf], "a": node[leaf], "b": node[label[leaf]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for f in frames:
            if not len(f):
                continue
            held.append(f)
            n += len(f)
            if n >= 2 * task_rows:  # parts of a table are not quite equal
                yield joined(pd.concat(held))
                held, n = [], 0
        if held:
            yield joined(pd.concat(held))

    return run

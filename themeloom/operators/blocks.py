"""Blocks of near points, and exact searches between pairs of blocks.

Points are projected on the leading principal axes of a bounded sample, which also gives the splits
of a tree of boxes; leaves are cut further where they are crowded. A block is one row: ids, vectors,
the box of the projections and the range of what the projections leave out. For orthogonal axes
``|x - y|^2 >= |Px - Py|^2 + (|rest x| - |rest y|)^2``, which bounds the distance from a point, or
from a whole block, to a block, in few dimensions as in many. Only block numbers and bounds decide
which pairs meet. Blocks are dealt to groups, and a task meets one group with another, so a vector
travels once for each group of the other side: in proportion to the input, however many pairs of
blocks there are. Pairs of points never leave a task.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import vector
from themeloom.runtime import BROADCAST_BYTES, cut

#: Principal axes that are kept, sample rows for each leaf, and rows of a block aimed at.
AXES, PER_LEAF, BLOCK_ROWS = 8, 16, 2048

#: Smaller blocks than ``BLOCK_ROWS`` are made up to this number of them; pairs of blocks are listed.
MOST_BLOCKS = 1024

#: Groups that the blocks of a side are dealt to, and bytes of a group; more groups where it is full.
GROUPS, GROUP_BYTES = 12, 32 * 1024 * 1024

#: Room for rounding: bounds give way by this share of the points' size.
SLACK = 1e-9

PACKED = "block bigint, n int, ids binary, v binary, w binary, lo array<double>, hi array<double>"


@dataclass
class Tree:
    """Axes and splits: node i has children 2i + 1 and 2i + 2; the leaves are one level."""

    mean: np.ndarray
    axes: np.ndarray
    split: np.ndarray
    at: np.ndarray
    depth: int
    rows: int = BLOCK_ROWS

    def project(self, x: np.ndarray) -> np.ndarray:
        """Projections and, last, the length of the rest."""
        y = x - self.mean
        p = y @ self.axes.T
        rest = np.sqrt(np.maximum((y * y).sum(axis=1) - (p * p).sum(axis=1), 0))
        return np.column_stack([p, rest])

    def leaf(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            right = p[np.arange(len(p)), self.split[node]] > self.at[node]
            node = 2 * node + 1 + right
        return node


def fit_tree(points: DataFrame, n: int, rows: int = BLOCK_ROWS, axes: int = AXES) -> Tree:
    """A tree from a sample that is bounded in bytes; it decides cost, never a result. ``rows`` grows
    up to ``BLOCK_ROWS`` where there would be more than ``MOST_BLOCKS``."""
    rows = max(rows, min(BLOCK_ROWS, ceil(n / MOST_BLOCKS)))
    head = points.where("point IS NOT NULL").select(F.size("point").alias("d")).first()
    dim = max(1, head["d"]) if head else 1
    room = max(PER_LEAF, BROADCAST_BYTES // (8 * dim))
    leaves = min(max(1, ceil(n / rows)), max(1, room // PER_LEAF))
    some = points.orderBy(F.xxhash64("row_id", F.lit(42)), "row_id").limit(min(room, max(4096, leaves * PER_LEAF)))
    x = to_matrix(some.select("point").toArrow()["point"].combine_chunks(), dim)
    mean = x.mean(axis=0) if len(x) else np.zeros(dim)
    _, _, basis = np.linalg.svd(x - mean, full_matrices=False) if len(x) > 1 else (0, 0, np.eye(1, dim))
    depth = (leaves - 1).bit_length()
    size = (1 << depth) - 1
    tree = Tree(mean, basis[: min(axes, dim)], np.zeros(size, np.int64), np.zeros(size), depth, rows)
    p, node = tree.project(x), np.zeros(len(x), np.int64)
    for i in range(size):
        mine = np.flatnonzero(node == i)
        if len(mine):
            tree.split[i] = int(p[mine].var(axis=0).argmax())
            tree.at[i] = np.median(p[mine, tree.split[i]])
        node[mine] = 2 * i + 1 + (p[mine, tree.split[i]] > tree.at[i])
    return tree


def to_matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(len(column), -1 if len(column) else dim or 0)


def pack(points: DataFrame, tree: Tree, carry: tuple[str, ...] = ()) -> DataFrame:
    """Packed blocks of (row_id, point) and, where there is one, a whole-number ``weight``; a crowded
    leaf gives several, by hash of the id. The columns of ``carry`` are arrays in the order of the ids.
    Points with a ``leaf`` of their own are not placed by the tree."""
    weight = F.col("weight") if "weight" in points.columns else F.lit(1)
    placed_before = "leaf" in points.columns

    def place(batches):
        for b in batches:
            if placed_before:
                yield b
                continue
            x = to_matrix(b["point"])
            leaf = tree.leaf(tree.project(x)) if len(x) else np.zeros(0, np.int64)
            yield b.append_column("leaf", pa.array(leaf, pa.int64()))

    own = points.select(
        F.col("row_id").cast("bigint").alias("row_id"),
        vector.as_double(F.col("point")).alias("point"),
        weight.cast("bigint").alias("weight"),
        *carry,
        *([F.col("leaf").cast("bigint").alias("leaf")] if placed_before else []),
    )
    kinds = {c: points.schema[c].dataType.simpleString() for c in carry}
    more = "".join(f", {c} {kind}" for c, kind in kinds.items())
    placed = own.mapInArrow(place, f"row_id bigint, point array<double>, weight bigint{more}, leaf bigint")
    load = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / tree.rows).alias("chunks"))
    # blocks are numbered by leaf and chunk; the number of leaves is bounded with the sample
    dealt = placed.join(F.broadcast(load), "leaf").select(
        "row_id", "point", "weight", *carry, (F.col("leaf") * F.lit(1 << 32) + F.pmod(F.xxhash64("row_id", F.lit(7)), "chunks")).alias("block")
    )

    def packed(key, t):
        x, ids = to_matrix(t["point"].combine_chunks()), t["row_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        p = tree.project(x)
        return pa.table({
            "block": [key[0].as_py()], "n": pa.array([len(ids)], pa.int32()), "ids": [ids[order].astype("<i8").tobytes()],
            "v": [x[order].astype("<f8").tobytes()], "w": [t["weight"].to_numpy()[order].astype("<i8").tobytes()], "lo": [p.min(axis=0).tolist()], "hi": [p.max(axis=0).tolist()],
        } | {c: pa.array([t[c].to_numpy()[order]]) for c in carry})

    return dealt.groupBy("block").applyInArrow(packed, PACKED + "".join(f", {c} array<{kind}>" for c, kind in kinds.items()))


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["v"], "<f8").reshape(len(ids), -1)


def homes(blocks: DataFrame) -> DataFrame:
    """(row_id, cell): every row and the place of its block in the order of the blocks."""
    order = {b: i for i, b in enumerate(sorted(r["block"] for r in blocks.select("block").collect()))}

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), order[row["block"]], np.int32))], ["row_id", "cell"])

    return blocks.select("block", "ids").mapInArrow(run, "row_id bigint, cell int")


def boxes(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and boxes of all blocks; some 150 bytes for each ``BLOCK_ROWS`` points."""
    t = blocks.select("block", "lo", "hi").toArrow().sort_by("block")
    number = t["block"].to_numpy()
    lo, hi = (to_matrix(t[c].combine_chunks()) for c in ("lo", "hi"))
    return number, lo, hi


def gaps(low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances between boxes (low, high) and boxes (lo, hi)."""
    out = np.zeros((len(low), len(lo)))
    for j in range(low.shape[1]):
        g = np.maximum(lo[None, :, j] - high[:, j, None], low[:, j, None] - hi[None, :, j])
        out += np.maximum(g, 0) ** 2
    room = SLACK * (1 + np.abs(low).max(initial=0) + np.abs(lo).max(initial=0))
    return np.maximum(np.sqrt(out) - room, 0)


def search_pairs(queries: DataFrame, members: DataFrame, tree: Tree, limits: DataFrame | None) -> DataFrame:
    """(q_block, block, gap, who): pairs of blocks that must meet and the queries, as bits, that
    must look. Without ``limits`` each query only looks into the block nearest by its bound; with
    (block, kth array in order of the ids), into every other one not farther than its limit.
    Queries that carry ``leaves``, an array each, look into the blocks of these leaves alone."""
    share = queries.sparkSession.sparkContext.broadcast(boxes(members))
    first = limits is None
    own = queries.select("block", "ids", "v", *[c for c in queries.columns if c == "leaves"])
    asked = own.withColumn("kth", F.lit(None).cast("array<double>")) if first else own.join(limits, "block")

    def run(batches):
        number, lo, hi = share.value
        for batch in batches:
            for row in batch.to_pylist():
                _, x = unpacked(row)
                p, out = tree.project(x), []
                near = gaps(p, p, lo, hi) if len(number) else np.zeros((len(x), 0))
                if not near.shape[1]:
                    continue
                open_ = np.ones(near.shape, bool)
                if "leaves" in row:
                    open_ = np.array([np.isin(number >> 32, leaves) for leaves in row["leaves"]])
                    near[~open_] = np.inf
                home = near.argmin(axis=1)
                if first:
                    see = np.zeros(near.shape, bool)
                    see[np.arange(len(x)), home] = True
                    see &= open_
                else:
                    limit = np.array([np.inf if k is None else k for k in row["kth"]])
                    see = near <= limit[:, None] * (1 + 1e-12) + 1e-12
                    see[np.arange(len(x)), home] = False
                    see &= open_
                for j in np.flatnonzero(see.any(axis=0)):
                    out.append((row["block"], int(number[j]), float(near[see[:, j], j].min()), np.packbits(see[:, j]).tobytes()))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("q_block", "block", "gap", "who"), o)) for o in out],
                    pa.schema([("q_block", pa.int64()), ("block", pa.int64()), ("gap", pa.float64()), ("who", pa.binary())]),
                )

    return asked.mapInArrow(run, "q_block bigint, block bigint, gap double, who binary")


def _grouped(blocks: DataFrame, name: str, group: str) -> DataFrame:
    """(name, group): every block and its group, blocks of near numbers together. A row a block."""
    t = blocks.select("block", (F.length("ids") + F.length("v") + F.length("w")).alias("size")).toArrow().sort_by("block")
    size = t["size"].to_numpy()
    ways = max(GROUPS, ceil(int(size.sum()) / GROUP_BYTES))
    at = (np.cumsum(size) - size) * ways // max(1, int(size.sum()))
    rows = list(zip(t["block"].to_pylist(), at.tolist()))
    return F.broadcast(blocks.sparkSession.createDataFrame(rows, f"{name} bigint, {group} bigint"))


def meet(pairs: DataFrame, left: DataFrame, right: DataFrame, run, schema: str, fold=None) -> DataFrame:
    """``run(left row, right rows)`` for every block of ``pairs`` (q_block, block, gap, ...) and the
    blocks it must meet, nearest first. A task has a group of either side, and ``fold`` merges what
    its runs give."""
    extra = [c for c in pairs.columns if c not in ("q_block", "block")]
    dealt = cut(pairs.join(_grouped(left, "q_block", "q_group"), "q_block").join(_grouped(right, "block", "group"), "block"))
    lists = dealt.groupBy("q_block", "q_group", "group").agg(F.collect_list(F.struct("block", *extra)).alias("others"))
    lists = lists.select(F.col("q_block").alias("_block"), F.col("q_group").alias("_q_group"), F.col("group").alias("_group"), F.col("others").alias("_others"))
    own = lists.join(left.select(*[F.col(c).alias(f"_{c}") for c in left.columns if c != "n"]), "_block")
    blocks = dealt.select("q_group", "group", "block").distinct().join(right.drop("n"), "block")

    def both(a, b):
        if not a.num_rows or not b.num_rows:
            return none(schema)
        held = {r["block"]: r for r in b.to_pylist()}
        out = []
        for q in a.to_pylist():
            others = sorted(q["_others"], key=lambda r: (r["gap"], r["block"]))
            out.append(run({c[1:]: v for c, v in q.items()}, [held[r["block"]] | r for r in others]))
        found = pa.concat_tables(out)
        return fold(found) if fold else found

    return own.groupBy("_q_group", "_group").cogroup(blocks.groupBy("q_group", "group")).applyInArrow(both, schema)


def none(schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    return pa.table({f.split()[0]: pa.array([], kinds[f.split()[1]]) for f in schema.split(", ")})


def reaches(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Upper bounds of the distances from projected points to the points of blocks."""
    out = (p[:, None, -1] + hi[None, :, -1]) ** 2
    for j in range(p.shape[1] - 1):
        out += np.maximum(np.abs(p[:, j, None] - lo[None, :, j]), np.abs(hi[None, :, j] - p[:, j, None])) ** 2
    return np.sqrt(out) + SLACK * (1 + np.abs(p).max(initial=0) + np.abs(hi).max(initial=0))


def pairs_within(blocks: DataFrame, radius: float) -> DataFrame:
    """(q_block, block, gap): pairs of blocks, the first number not larger, that may hold points
    within ``radius`` of each other."""
    share = blocks.sparkSession.sparkContext.broadcast(boxes(blocks))

    def run(batches):
        number, lo, hi = share.value
        for batch in batches:
            for row in batch.to_pylist():
                g = gaps(np.array([row["lo"]]), np.array([row["hi"]]), lo, hi)[0]
                hit = np.flatnonzero((g <= radius) & (number >= row["block"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hit), row["block"])), pa.array(number[hit]), pa.array(g[hit])], ["q_block", "block", "gap"]
                )

    return blocks.select("block", "lo", "hi").mapInArrow(run, "q_block bigint, block bigint, gap double")

"""Exact and approximate nearest neighbours of vectors.

The exact join works on blocks of near points (``blocks``): every query searches the block nearest
to it, and the k-th distance found there tells, through bounds from orthogonal projections, which
other blocks can still matter. A dense region only means more blocks. Pairs exist inside a task as
a NumPy block; k rows per query leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.functions import vector
from themeloom.operators import blocks
from themeloom.runtime import cut, fits, sized_broadcast, widen

#: Aimed-at rows of a cell.
CELL_ROWS = 2048

#: Rows of members that are compared at once, and pairs whose distances are summed at once.
MEMBER_ROWS, SUMMED = 4096, 100_000

#: Pairs of a tile in single precision, and in double.
TILE, WIDE_TILE = 1 << 20, 4_000_000

#: Points up to this size and number are searched as one broadcast block.
SMALL_POINT_BYTES, SMALL_POINTS = 4 * 1024 * 1024, 16_384

#: Stands for a NULL id in blocks.
NO_ID = -(1 << 63)

FOUND = "row_id bigint, neighbor_id bigint, distance double"


# ---------------------------------------------------------------- NumPy kernels


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance block, summed per coordinate (no cancellation near zero)."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += np.subtract.outer(a[:, j], b[:, j]) ** 2
    return np.sqrt(out)


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and a bound of their error."""
    with np.errstate(all="ignore"):
        x, y = (a - b.mean(axis=0), b - b.mean(axis=0)) if len(b) else (a, b)
        sx, sy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        room = 8 * (a.shape[1] + 8) * np.finfo(float).eps * float(sx.max(initial=0) + sy.max(initial=0))
        if not np.isfinite(room):
            return distances(a, b) ** 2, 1e-12
        out = x @ y.T
        out *= -2
        out += sx[:, None]
        out += sy[None, :]
    return out, room


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows to rows, as ``distances`` has them."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(out)


def ceiling(limit: np.ndarray, room: float) -> np.ndarray:
    """What ``squares`` cannot exceed for distances up to ``limit``."""
    return limit * limit * (1 + 1e-12) + room + 1e-300


class Screen:
    """Tells which of ``x`` and ``p`` may be near, by a matrix product in single precision.

    ``products`` gives x * p - |p|^2 / 2, centred and scaled, which is no more than ``room`` off; it is
    at least ``least(limit)`` for pairs within ``limit``. Not ``usable`` for numbers that are not finite.
    """

    def __init__(self, x: np.ndarray, p: np.ndarray):
        with np.errstate(all="ignore"):
            x, p = x - p.mean(axis=0), p - p.mean(axis=0)
            sx, sp = (x * x).sum(axis=1), (p * p).sum(axis=1)
            size = max(float(sx.max(initial=0)), float(sp.max(initial=0)))
            if np.isnan(sx).any() or np.isnan(sp).any():
                size = np.nan
        self.usable = 1e-200 < size < 1e200
        if not self.usable:
            return
        self.size, self.sx = size, sx / size
        self.a, self.b = np.ones((len(x), x.shape[1] + 1), np.float32), np.empty((len(p), x.shape[1] + 1), np.float32)
        self.a[:, :-1], self.b[:, :-1] = x / np.sqrt(size), p / np.sqrt(size)
        self.b[:, -1] = sp / (-2 * size)
        self.room = (x.shape[1] + 8) * float(np.finfo(np.float32).eps) * float(self.sx.max(initial=0) + sp.max(initial=0) / size)

    def products(self, rows: slice) -> np.ndarray:
        return self.a[rows] @ self.b.T

    def least(self, rows: slice, limit: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((self.sx[rows] - limit * limit / self.size * (1 + 1e-12)) / 2 - 2 * self.room).astype(np.float32)


def picked(mask: np.ndarray):
    """Steps of the (row, column) that are set."""
    at = np.flatnonzero(mask.ravel())
    for i in range(0, len(at), SUMMED):
        yield np.divmod(at[i : i + SUMMED], mask.shape[1])


def within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Which pairs are within ``radius``: those near it are summed per coordinate."""
    d, room = squares(a, b)
    low, high = radius * radius * (1 - 1e-12) - room, float(ceiling(np.float64(radius), room))
    hit = d < low
    for i, j in picked((d >= low) & (d <= high)):
        hit[i, j] = summed(a[i], b[j]) <= radius
    return hit


def pair_distances(a: np.ndarray, b: np.ndarray, squared: bool = False) -> np.ndarray:
    """Distance block for sums: one matrix product, but what rounding could blur is summed per coordinate."""
    d, room = squares(a, b)
    close = list(picked(d < 1e4 * room))
    np.maximum(d, 0, out=d)
    if not squared:
        np.sqrt(d, out=d)
    for i, j in close:
        near = summed(a[i], b[j])
        d[i, j] = near * near if squared else near
    return d


class Spread:
    """Tiles of distances for sums, as ``pair_distances`` has them: one product of widened matrices gives
    the squares, and only a tile with some that rounding could blur sums these per coordinate."""

    def __init__(self, x: np.ndarray, y: np.ndarray, squared: bool = False):
        self.x, self.y, self.squared = x, y, squared
        with np.errstate(all="ignore"):
            mean = y.mean(axis=0)
            a, b = x - mean, y - mean
            sa, sb = (a * a).sum(axis=1), (b * b).sum(axis=1)
            self.room = 16 * (x.shape[1] + 8) * np.finfo(float).eps * float(sa.max(initial=0) + sb.max(initial=0))
        self.usable = bool(np.isfinite(self.room))
        if self.usable:
            self.a = np.column_stack([-2 * a, sa, np.ones(len(a))])
            self.b = np.ascontiguousarray(np.column_stack([b, np.ones(len(b)), sb]).T)

    def tile(self, rows: slice, columns: slice) -> np.ndarray:
        if not self.usable:
            return pair_distances(self.x[rows], self.y[columns], self.squared)
        d = self.a[rows] @ self.b[:, columns]
        close = list(picked(d < 1e4 * self.room)) if d.min(initial=np.inf) < 1e4 * self.room else []
        if close:
            np.maximum(d, 0, out=d)
        if not self.squared:
            np.sqrt(d, out=d)
        for i, j in close:
            near = summed(self.x[rows][i], self.y[columns][j])
            d[i, j] = near * near if self.squared else near
        return d


class Nearest:
    """The ``k`` nearest of the points seen so far, for the queries of a task; ties to the lower id.

    A matrix product leaves the points that may be near enough; their distances are then summed per
    coordinate. ``limit`` is a distance beyond which no point counts.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, skip_self: bool, limit: np.ndarray | None = None):
        self.ids, self.x, self.k, self.skip_self = ids, x, k, skip_self
        self.limit = np.full(len(ids), np.inf) if limit is None else limit
        self.far, self.last = self.limit.copy(), np.full(len(ids), np.iinfo(np.int64).max)
        self.dist, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def look(self, who: np.ndarray, pid: np.ndarray, p: np.ndarray) -> None:
        """Compare the queries ``who``, by place, with points."""
        if not len(who) or not len(pid):
            return
        screen = Screen(self.x[who], p)
        step = max(1, (TILE if screen.usable else WIDE_TILE) // len(pid))
        for at in range(0, len(who), step):
            i, mask = who[at : at + step], None
            if screen.usable:
                mask = self._screened(screen, slice(at, at + step), i, pid)
            if mask is None:
                mask = self._open(i, pid, p)
            for row, column in picked(mask):
                q = i[row]
                dist, near = summed(self.x[q], p[column]), pid[column]
                ok = np.isfinite(dist) & ((dist < self.far[q]) | ((dist == self.far[q]) & (near <= self.last[q])))
                if self.skip_self:
                    ok &= self.ids[q] != near
                if ok.any():
                    self._merge(q[ok], dist[ok], near[ok])

    def _screened(self, screen: Screen, rows: slice, i: np.ndarray, pid: np.ndarray) -> np.ndarray | None:
        """Pairs that may count, None where single precision leaves too many."""
        near = screen.products(rows)
        least = screen.least(rows, self.far[i])
        free = np.flatnonzero(np.isinf(self.far[i]))
        if len(free) and self.k < len(pid):  # the k-th of these points is a limit
            own = near[free]
            if self.skip_self:
                own[self.ids[i[free], None] == pid[None, :]] = -np.inf
            least[free] = np.partition(own, len(pid) - self.k, axis=1)[:, len(pid) - self.k] - 4 * screen.room
        mask = near >= least[:, None]
        return mask if np.count_nonzero(mask) <= max(mask.size >> 4, 2 * self.k * len(i)) else None

    def _open(self, i: np.ndarray, pid: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Pairs that may count, in double precision."""
        d, room = squares(self.x[i], p)
        top = ceiling(self.far[i], room)
        free = np.flatnonzero(np.isinf(self.far[i]))
        if len(free) and self.k < len(pid):
            own = np.nan_to_num(d[free], nan=np.inf)
            if self.skip_self:
                own[self.ids[i[free], None] == pid[None, :]] = np.inf
            kth = np.partition(own, self.k - 1, axis=1)[:, self.k - 1]
            top[free] = kth * (1 + 1e-12) + 2 * room + 1e-300
        return d <= top[:, None]

    def _merge(self, q: np.ndarray, dist: np.ndarray, near: np.ndarray) -> None:
        rows, place = np.unique(q, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(rows)), self.k), place])
        dist = np.concatenate([self.dist[rows].ravel(), dist])
        near = np.concatenate([self.near[rows].ravel(), near])
        order = np.lexsort((near, dist, at))
        at = at[order]
        first = np.flatnonzero(np.r_[True, np.diff(at) != 0])
        keep = order[np.arange(len(at)) - first[at] < self.k]
        self.dist[rows], self.near[rows] = dist[keep].reshape(-1, self.k), near[keep].reshape(-1, self.k)
        worst = self.dist[rows, -1]
        self.far[rows] = np.minimum(worst, self.limit[rows])
        self.last[rows] = np.where(worst <= self.limit[rows], self.near[rows, -1], np.iinfo(np.int64).max)

    def found(self) -> dict[str, np.ndarray]:
        has = np.isfinite(self.dist)
        return {"row_id": np.repeat(self.ids, has.sum(axis=1)), "neighbor_id": self.near[has], "distance": self.dist[has]}


def block_top_k(
    qid: np.ndarray, q: np.ndarray, pid: np.ndarray, p: np.ndarray, k: int, skip_self: bool
) -> pd.DataFrame:
    """k nearest of ``p`` for every row of ``q``; ties to the lower id."""
    best, every = Nearest(qid, q, k, skip_self), np.arange(len(qid))
    for at in range(0, len(pid), MEMBER_ROWS):
        best.look(every, pid[at : at + MEMBER_ROWS], p[at : at + MEMBER_ROWS])
    return pd.DataFrame(best.found())


# ---------------------------------------------------------------- exact join


def _keep_k(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("row_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _small_side(queries: DataFrame, points: DataFrame, k: int, skip_self: bool) -> DataFrame:
    held = points.toPandas()  # proven small by the caller
    share = queries.sparkSession.sparkContext.broadcast(
        (held["row_id"].to_numpy(), matrix(held["point"]))
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, p = share.value
        for frame in frames:
            if len(frame) and len(pid):
                out = block_top_k(
                    frame["row_id"].to_numpy(), matrix(frame["point"]), pid, p, k, skip_self
                )
                # every query met all points here, so its rows are final: no shuffle
                yield out.assign(rank=out.groupby("row_id").cumcount() + 1)

    return queries.select("row_id", "point").mapInPandas(run, FOUND + ", rank int")


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    skip_self: bool = False,
    small_bytes: int = SMALL_POINT_BYTES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(row_id, neighbor_id, distance, rank): the k nearest points of every query.

    Both sides carry (row_id bigint, point array<double>); rows without a point take no part.
    Exact; ties to the lower id.
    """
    points = points.where("point IS NOT NULL").select("row_id", vector.as_double(F.col("point")).alias("point"))
    points = cut(points)
    queries = queries.where("point IS NOT NULL").select("row_id", vector.as_double(F.col("point")).alias("point"))
    n = points.count()
    first = points.select(F.size("point").alias("d")).first()
    dim = first["d"] if first else 1
    if n * (8 * dim + 8) <= small_bytes and n <= SMALL_POINTS:
        return _small_side(widen(queries, "row_id"), points, k, skip_self)

    tree = blocks.fit_tree(points, n, cell_rows)
    members = cut(blocks.pack(points, tree))
    asked = members if skip_self else cut(blocks.pack(queries, tree))
    return _searched(asked, members, tree, k, skip_self)


def _searched(asked: DataFrame, members: DataFrame, tree: blocks.Tree, k: int, skip_self: bool) -> DataFrame:
    """The k nearest of packed points for packed queries: the nearest block first, whose distances
    are limits for the others."""
    own = cut(_meet(blocks.search_pairs(asked, members, tree, None), asked, members, k, skip_self))
    limits = cut(_limits(asked, own, k))
    rest = _meet(blocks.search_pairs(asked, members, tree, limits), asked.join(limits, "block"), members, k, skip_self)
    return _keep_k(own.unionByName(rest), k)


def _meet(pairs: DataFrame, asked: DataFrame, members: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """The k nearest, among the blocks of each task, of the queries that must look into them. Blocks
    come nearest first, and a query that has k neighbours closer than a block passes it over; so it
    does from the start with the distances ``kth`` of its k-th neighbour elsewhere."""

    def run(q: dict, rows: list[dict]) -> pa.Table:
        qid, x = blocks.unpacked(q)
        limit = np.array([np.inf if d is None else d for d in q["kth"]]) if q.get("kth") else None
        best = Nearest(qid, x, k, skip_self, limit)
        part, look, n, allowed = [], np.zeros(len(qid), bool), 0, True
        for row in [*rows, None]:
            bits = who = look
            if row is not None:
                bits = np.unpackbits(np.frombuffer(row["who"], np.uint8), count=len(qid)).astype(bool)
                who = bits & (row["gap"] <= best.far)
            # blocks are joined for queries that look into all of them: what was found elsewhere must not be found again
            if part and (row is None or n >= MEMBER_ROWS or ((look | who) & ~(allowed & bits)).any()):
                pid, y = (np.concatenate(z) for z in zip(*part))
                best.look(np.flatnonzero(look), pid, y)
                part, look, n, allowed = [], np.zeros(len(qid), bool), 0, True
            if row is not None and who.any():
                part.append(blocks.unpacked(row))
                look, n, allowed = look | who, n + len(part[-1][0]), allowed & bits
        return pa.table(best.found())

    return blocks.meet(pairs, asked, members, run, FOUND)


def _limits(asked: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """(block, kth): for every block its queries' k-th distance so far, in order of the ids, NULL
    with fewer than k neighbours."""
    known = own.groupBy("row_id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("have"))
    known = known.select("row_id", F.when(F.col("have") >= k, F.col("far")).alias("far"))

    def ids(batches):
        for b in batches:
            for row in b.to_pylist():
                own_ids = np.frombuffer(row["ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own_ids), row["block"])), pa.array(own_ids)], ["block", "row_id"])

    placed = asked.select("block", "ids").mapInArrow(ids, "block bigint, row_id bigint")
    in_order = F.array_sort(F.collect_list(F.struct("row_id", "far")))
    return placed.join(known, "row_id", "left").groupBy("block").agg(F.transform(in_order, lambda r: r["far"]).alias("kth"))


def open_share(points: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row (pairs, open): pairs of a point and a block, and those that the bounds leave open
    for the k nearest neighbours."""
    points = cut(points.select("row_id", vector.as_double(F.col("point")).alias("point")))
    tree = blocks.fit_tree(points, points.count(), cell_rows)
    members = cut(blocks.pack(points, tree))
    own = cut(_meet(blocks.search_pairs(members, members, tree, None), members, members, k, True))
    rest = blocks.search_pairs(members, members, tree, _limits(members, own, k))
    size = members.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("b"))
    return size.select((F.col("n") * F.col("b")).alias("pairs"), (F.col("n") + _ones(rest).scalar()).alias("open"))


def _ones(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            n = [int.from_bytes(w, "big").bit_count() for w in b["who"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    return pairs.select("who").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)))


def _scaled(v: Column) -> Column:
    """``v`` by its length, which is taken once a row: within ``transform`` it would be for every element."""
    held = F.array(F.struct(v.alias("v"), vector.norm(v).alias("size")))
    return F.transform(held, lambda r: F.transform(r["v"], lambda x: x / r["size"]))[0]


def _unit(column: Column, dim: int, side: int) -> Column:
    """Unit vector with two spare coordinates; a zero vector points along spare ``side``,
    which makes its cosine with everything 0."""
    v = vector.as_double(column)
    size = vector.norm(v)
    spare = F.array(F.lit(0.0), F.lit(0.0))
    lone = F.array(*[F.lit(1.0 if i == dim + side else 0.0) for i in range(dim + 2)])
    return F.when(size == 0, lone).otherwise(F.concat(_scaled(v), spare))


def cosine_top_k(
    queries: DataFrame, points: DataFrame, dim: int, k: int = 5, skip_self: bool = False, **options
) -> DataFrame:
    """(row_id, neighbor_id, similarity, rank): exact cosine top-k for every query."""
    found = knn_join(
        queries.select("row_id", _unit(F.col("point"), dim, 0).alias("point")),
        points.select("row_id", _unit(F.col("point"), dim, 1).alias("point")),
        k,
        skip_self,
        **options,
    )
    return found.select(
        "row_id",
        "neighbor_id",
        (1 - F.col("distance") * F.col("distance") / 2).alias("similarity"),
        "rank",
    )


def most_similar(points: DataFrame, query: Column, k: int = 5, column: str = "embedding") -> DataFrame:
    """(index, similarity): exact cosine top-k of one query vector (a literal array or a
    scalar subquery). Every task keeps k rows; only those are merged."""
    return (
        # the query becomes a column first: a subquery may not sit inside a lambda
        points.select(F.col("row_id").alias("index"), F.col(column).alias("_v"), query.alias("_q"))
        .select(
            "index", vector.cosine(F.col("_q"), vector.as_double(F.col("_v"))).alias("similarity")
        )
        .orderBy(F.desc("similarity"), "index")
        .limit(k)
    )


def nearest_centers(ids: np.ndarray, c: np.ndarray, x: np.ndarray) -> pd.DataFrame:
    """(nearest_id, distance) of the center nearest to every row of ``x``; ties to the first of the sorted ids."""
    best, every = Nearest(np.arange(len(x)), x, 1, False), np.arange(len(x))
    place = np.arange(len(c))
    for at in range(0, len(c), MEMBER_ROWS):
        best.look(every, place[at : at + MEMBER_ROWS], c[at : at + MEMBER_ROWS])
    near, dist = best.near[:, 0].copy(), best.dist[:, 0].copy()
    # where a number is not finite, all centers are compared one by one
    odd = every if not np.isfinite(c).all() else np.flatnonzero(~np.isfinite(dist))
    step = max(1, WIDE_TILE // len(ids))
    for at in range(0, len(odd), step):
        i = odd[at : at + step]
        d = distances(x[i], c)
        near[i], dist[i] = d.argmin(axis=1), d.min(axis=1)
    return pd.DataFrame({"nearest_id": ids[near], "distance": dist})


def with_nearest(df: DataFrame, centers: DataFrame, point: str = "point") -> DataFrame:
    """Add (nearest_id, distance) of the closest (id, point) center, NULL without centers.

    A center table of proven small size is shipped to the tasks and the rows stay where
    they are; a larger one goes through ``knn_join``.
    """
    held = cut(
        centers.select(
            F.col("id").cast("bigint").alias("row_id"), vector.as_double(F.col("point")).alias("point")
        )
    )
    head = held.select(F.size("point").alias("d")).first()
    dim = head["d"] if head else 1
    if not fits(held, 8 * dim + 8, SMALL_POINT_BYTES):
        near = knn_join(df.select("row_id", F.col(point).alias("point")), held, 1)
        return df.join(
            near.select("row_id", F.col("neighbor_id").alias("nearest_id"), "distance"),
            "row_id",
            "left",
        )
    local = held.toPandas().sort_values("row_id")  # proven small
    share = df.sparkSession.sparkContext.broadcast(
        (local["row_id"].to_numpy(), matrix(local["point"]))
    )

    @F.pandas_udf("nearest_id bigint, distance double")
    def closest(column: pd.Series) -> pd.DataFrame:
        return nearest_centers(*share.value, matrix(column))

    if not len(local):
        none = F.lit(None)
        return df.withColumns(
            {"nearest_id": none.cast("bigint"), "distance": none.cast("double")}
        )
    return df.withColumn("_near", closest(vector.as_double(F.col(point)))).select(
        *df.columns, "_near.nearest_id", "_near.distance"
    )


def knn_graph(points: DataFrame, k: int = 15, **options) -> DataFrame:
    """(row_id, neighbor_id, distance, rank) over all points, a point not its own neighbour."""
    return knn_join(points, points, k, True, **options)


# ---------------------------------------------------------------- approximate index


def fit_cells(points: DataFrame, cells: int, column: str = "embedding", seed: int = 42) -> KMeansModel:
    unit = _normal(points, column)
    return KMeans(k=cells, seed=seed, featuresCol="_unit", predictionCol="cell").fit(unit)


def _normal(points: DataFrame, column: str) -> DataFrame:
    v = vector.as_double(F.col(column))
    size = vector.norm(v)
    unit = F.when(size == 0, v).otherwise(_scaled(v))
    return points.withColumn("_unit", array_to_vector(unit))


def write_index(points: DataFrame, model: KMeansModel, path: str, column: str = "embedding") -> None:
    """Vector table laid out by cell, plus the cell model, under ``path``."""
    placed = model.transform(_normal(points, column)).drop("_unit")
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    model.write().overwrite().save(f"{path}/cells")


def search_index(
    index: DataFrame, model: KMeansModel, query: list[float], k: int = 5, probes: int = 4,
    column: str = "embedding",
) -> DataFrame:
    """Approximate top-k: exact cosine inside the ``probes`` cells nearest to the query.
    On a written index the cell filter prunes partitions."""
    q = np.asarray(query, float)
    size = np.linalg.norm(q)
    unit = q / size if size else q
    centers = np.vstack(model.clusterCenters())
    chosen = np.argsort(((centers - unit) ** 2).sum(axis=1), kind="stable")[:probes]
    near = index.where(F.col("cell").isin(*[int(c) for c in chosen]))
    return most_similar(near, F.array(*[F.lit(float(x)) for x in q]), k, column)


def place_in_cells(points: DataFrame, model: KMeansModel, column: str = "embedding") -> DataFrame:
    return model.transform(_normal(points, column)).drop("_unit")


def cell_centers(spark: SparkSession, model: KMeansModel) -> DataFrame:
    """(cell, center) of an index."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cell int, center array<double>")


def probe_cells(queries: DataFrame, centers: DataFrame, probes: int) -> DataFrame:
    """(row_id, point, cell): every query (row_id, point) with the ``probes`` cells nearest to its
    direction."""
    return nearest_cells(queries, centers, probes).select("row_id", "point", F.explode("leaves").alias("cell"))


def nearest_cells(queries: DataFrame, centers: DataFrame, probes: int) -> DataFrame:
    """(row_id, point, leaves): the same as an array, the nearest cell first. The centers are one row,
    as many as the model has cells."""
    held = centers.agg(F.collect_list(F.struct("cell", "center")).alias("_centers"))
    v = vector.as_double(F.col("point"))
    unit = F.when(vector.norm(v) == 0, v).otherwise(_scaled(v))
    asked = queries.where("point IS NOT NULL").select("row_id", "point", unit.alias("_unit")).crossJoin(F.broadcast(held))
    far = F.transform("_centers", lambda c: F.struct(vector.squared_euclidean(F.col("_unit"), c["center"]), c["cell"].alias("cell")))
    near = F.slice(F.array_sort(far), 1, probes)
    return asked.select("row_id", "point", F.transform(near, lambda c: c["cell"]).alias("leaves"))


def search_many(
    index: DataFrame, centers: DataFrame, queries: DataFrame, dim: int, k: int = 5, probes: int = 4, column: str = "embedding"
) -> DataFrame:
    """(row_id, neighbor_id, similarity, rank): approximate top-k by cosine for every query, exact
    inside its ``probes`` cells.

    The cells that any query probes, at most those of the model, become a partition filter of a
    written index. Members lie in blocks of their cells and queries in blocks of their nearest cells,
    and a query keeps what it has found from block to block. Vectors with parts that are not numbers take no part.
    """
    finite = vector.norm(F.col("point")) < F.lit(float("inf"))
    probed = nearest_cells(queries, centers, probes).withColumn("point", _unit(F.col("point"), dim, 0)).where(finite)
    known = F.coalesce(F.col("row_id"), F.lit(NO_ID)).alias("row_id")
    visits = cut(probed.select(known, "point", "leaves", F.col("leaves")[0].alias("leaf")))
    wanted = [r["cell"] for r in visits.select(F.explode("leaves").alias("cell")).distinct().collect()]
    held = index.where(F.col("cell").isin(wanted) & F.col(column).isNotNull())
    held = cut(held.select(known, F.col("cell").alias("leaf"), _unit(F.col(column), dim, 1).alias("point")).where(finite))
    tree = blocks.fit_tree(held, held.count(), CELL_ROWS)
    found = _searched(cut(blocks.pack(visits, tree, ("leaves",))), cut(blocks.pack(held, tree)), tree, k, False)
    named = [F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in ("row_id", "neighbor_id")]
    return found.select(*named, (1 - F.col("distance") * F.col("distance") / 2).alias("similarity"), "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (wanted, found, recall): the share of the exact neighbours that were found."""
    hits = exact.select("row_id", "neighbor_id").join(
        found.select("row_id", "neighbor_id", F.lit(1).alias("_hit")), ["row_id", "neighbor_id"], "left"
    )
    n, hit = F.count(F.lit(1)), F.count("_hit")
    return hits.agg(n.alias("wanted"), hit.alias("found"), F.when(n > 0, hit / n).otherwise(F.lit(1.0)).alias("recall"))

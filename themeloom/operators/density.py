"""Density clustering with noise.

``eps_components``: components of core points at a fixed distance, on a grid.
``density_clusters``: HDBSCAN* (Campello, Moulavi and Sander 2013): a minimum spanning tree of
mutual reachability (growth inside cells, then Boruvka rounds over neighbour lists, finished by a
pruned search), whose clusters ``merge_tree`` finds.

The neighbour count never includes the point itself: the core distance of a point is the
distance to its ``min_samples``-th other point. Copies of a point count as points.
"""

from __future__ import annotations

import heapq
from itertools import product
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import vector
from themeloom.operators import blocks
from themeloom.operators.graph import connected_components, least_labels
from themeloom.operators.merge_tree import BAND_ROWS, cut_trees
from themeloom.operators.neighbors import (
    CELL_ROWS,
    ceiling,
    knn_join,
    matrix,
    picked,
    squares,
    summed,
    within,
)
from themeloom.runtime import TASK_ROWS, cut, cut_measured, sized_broadcast

NOISE = -1

#: Core-point pairs of two neighbouring cells up to which they are compared directly.
DIRECT_PAIRS = 4096

#: Cells of a group, compared with the groups before, in which trees grow on.
WIDEN = 8

#: Leading coordinates used to find neighbouring cells.
GRID_AXES = 3


def fold_copies(points: DataFrame) -> DataFrame:
    """(pid, point, copies): distinct points, named by their smallest row_id."""
    v = vector.as_double(F.col("point"))
    return points.groupBy(v.alias("point")).agg(
        F.min("row_id").alias("pid"), F.count(F.lit(1)).alias("copies")
    )


# ------------------------------------------------------------------ fixed distance


def eps_components(
    points: DataFrame,
    eps: float,
    min_samples: int = 3,
    min_cluster_size: int = 5,
    direct_pairs: int = DIRECT_PAIRS,
    grid_axes: int = GRID_AXES,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """(row_id, cluster_id): a point is core if ``min_samples`` points (itself included)
    lie within ``eps``; core points within ``eps`` of each other share a cluster, named by
    its smallest row_id. All else, and clusters below ``min_cluster_size``, is noise (-1).

    Up to ``grid_axes`` coordinates: cells are so small that points of one cell are always within
    ``eps``. A cell with ``min_samples`` points is core and connected as it stands, whatever it
    holds; only thin cells count neighbours, and clusters form over cells, not points. With more
    coordinates such cells hold single points, and blocks of near points meet instead
    (``_block_components``). Rows without a point are noise.
    """
    folded = cut(fold_copies(points.where("point IS NOT NULL")))
    head = folded.select(F.size("point").alias("d")).first()
    if head is None:
        return points.select("row_id", F.lit(NOISE).cast("bigint").alias("cluster_id"))
    d = head["d"]
    if d > grid_axes:
        return _named(points, _block_components(folded, eps, min_samples, block_rows), min_cluster_size)
    side = eps / sqrt(d) * (1 - 1e-9)
    reach = ceil(eps / side)
    axes = min(d, GRID_AXES)
    cell = _cell_of(side)
    coarse = lambda c: F.array(*[F.floor(c[i] / reach) for i in range(axes)])
    offsets = F.array(
        *[F.array(*[F.lit(o) for o in move]) for move in product((-1, 0, 1), repeat=axes)]
    )
    around = lambda c: F.transform(
        offsets, lambda o: F.zip_with(c, o, lambda x, y: x + y)
    )
    gridded = cut(
        folded.withColumn("cell", cell).withColumn("coarse", coarse(F.col("cell")))
    )

    # core points
    load = gridded.groupBy("cell").agg(F.sum("copies").alias("load"))
    loaded = cut(gridded.join(load, "cell"))
    thin = loaded.where(F.col("load") < min_samples).select(
        "pid", F.col("point").alias("at"), F.explode(around(F.col("coarse"))).alias("coarse")
    )
    near = (
        thin.join(loaded.select("coarse", "point", "copies"), "coarse")
        .where(vector.euclidean(F.col("at"), F.col("point")) <= eps)
        .groupBy("pid")
        .agg(F.sum("copies").alias("n"))
        .where(F.col("n") >= min_samples)
        .select("pid")
    )
    core = cut(
        loaded.where(F.col("load") >= min_samples).unionByName(
            loaded.where(F.col("load") < min_samples).join(near, "pid", "left_semi"),
            allowMissingColumns=True,
        )
    ).select("pid", "point", "copies", "cell", "coarse")

    # cells of core points and which of them touch
    low = F.array(*[F.min(F.col("point")[i]) for i in range(d)])
    high = F.array(*[F.max(F.col("point")[i]) for i in range(d)])
    cells = cut(
        core.groupBy("cell", "coarse").agg(
            F.min("pid").alias("node"), F.count(F.lit(1)).alias("n"), low.alias("lo"), high.alias("hi")
        )
    )
    a = cells.select(
        F.col("cell").alias("cell_a"),
        F.col("node").alias("a"),
        F.col("n").alias("n_a"),
        F.col("lo").alias("lo_a"),
        F.col("hi").alias("hi_a"),
        F.explode(around(F.col("coarse"))).alias("coarse"),
    )
    b = cells.select(
        "coarse",
        F.col("cell").alias("cell_b"),
        F.col("node").alias("b"),
        F.col("n").alias("n_b"),
        F.col("lo").alias("lo_b"),
        F.col("hi").alias("hi_b"),
    )
    touching = cut(
        a.join(b, "coarse")
        .where(F.col("a") < F.col("b"))
        .where(_box_gap("lo_a", "hi_a", "lo_b", "hi_b") <= eps)
        .withColumn("sure", _box_span("lo_a", "hi_a", "lo_b", "hi_b") <= eps)
        .drop("coarse")
    )
    edges = touching.where("sure").select("a", "b")
    open_ = touching.where("NOT sure").select("a", "b", "cell_a", "cell_b", "n_a", "n_b")
    small = F.col("n_a") * F.col("n_b") <= direct_pairs
    members = core.select("cell", "point")
    left = members.select(F.col("cell").alias("cell_a"), F.col("point").alias("p"))
    right = members.select(F.col("cell").alias("cell_b"), F.col("point").alias("q"))
    direct = (
        open_.where(small)
        .join(left, "cell_a")
        .join(right, "cell_b")
        .where(vector.euclidean(F.col("p"), F.col("q")) <= eps)
        .select("a", "b")
        .distinct()
    )
    edges = edges.unionByName(direct).unionByName(_refine(open_.where(~small), core, eps, side, d))

    found = connected_components(edges)
    named = cells.select("cell", F.col("node")).join(found, "node", "left")
    named = named.select("cell", F.coalesce("comp", "node").alias("comp"))
    return _named(points, core.join(named, "cell").select("point", "copies", "comp"), min_cluster_size)


def _named(points: DataFrame, labelled: DataFrame, min_cluster_size: int) -> DataFrame:
    """Labels of all rows from the components (point, copies, comp) of the core points."""
    big = (
        labelled.groupBy("comp")
        .agg(F.sum("copies").alias("n"))
        .where(F.col("n") >= min_cluster_size)
        .select("comp")
    )
    kept = labelled.join(big, "comp", "left_semi").select("point", "comp")
    return points.select("row_id", vector.as_double(F.col("point")).alias("point")).join(
        kept, "point", "left"
    ).select("row_id", F.coalesce("comp", F.lit(NOISE)).cast("bigint").alias("cluster_id"))


def _block_components(folded: DataFrame, eps: float, min_samples: int, rows: int) -> DataFrame:
    """(point, copies, comp) of the core points, by blocks of near points.

    Pairs of blocks whose boxes come within ``eps`` meet twice: to count neighbours, which leaves a
    row per point, and to link core points, which leaves the edges of a forest.
    """
    n = folded.count()
    held = folded.select(F.col("pid").alias("row_id"), "point", F.col("copies").alias("weight"))
    tree = blocks.fit_tree(held, n, rows)
    packed = cut(blocks.pack(held, tree))

    def near(a: dict, b: dict):
        """Steps of the pairs of rows within eps."""
        (_, x), (_, y) = blocks.unpacked(a), blocks.unpacked(b)
        step = max(1, 4_000_000 // max(1, len(y)))
        for at in range(0, len(x), step):
            at_, j = np.divmod(np.flatnonzero(within(x[at : at + step], y, eps).ravel()), max(1, len(y)))
            yield at_ + at, j

    def count(q: dict, others: list[dict]) -> pa.Table:
        own, _ = blocks.unpacked(q)
        mine, ids, totals = np.zeros(len(own)), [], []
        for b in others:
            them, _ = blocks.unpacked(b)
            theirs = np.zeros(len(them))
            for i, j in near(q, b):
                mine += np.bincount(i, np.frombuffer(b["w"], "<i8")[j], len(own))
                theirs += np.bincount(j, np.frombuffer(q["w"], "<i8")[i], len(them))
            if b["block"] != q["block"]:
                seen = np.flatnonzero(theirs)
                ids.append(them[seen])
                totals.append(theirs[seen])
        ids, totals = np.concatenate([own, *ids]), np.concatenate([mine, *totals])
        return pa.table({"pid": pa.array(ids), "n": pa.array(totals.astype(np.int64))})

    def total(found: pa.Table) -> pa.Table:
        t = found.group_by("pid").aggregate([("n", "sum")])
        return pa.table({"pid": t["pid"], "n": t["n_sum"]})

    def forest(a: np.ndarray, b: np.ndarray) -> pa.Table:
        """Edges that join what the edges (a, b) join, one less than nodes at most."""
        names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = least_labels(code[: len(a)], code[len(a) :], len(names))
        edge = label != np.arange(len(names))
        return pa.table({"a": pa.array(names[edge], pa.int64()), "b": pa.array(names[label[edge]], pa.int64())})

    def link(q: dict, others: list[dict]) -> pa.Table:
        a, b = [], []
        own, _ = blocks.unpacked(q)
        for o in others:
            them, _ = blocks.unpacked(o)
            for i, j in near(q, o):
                a.append(own[i])
                b.append(them[j])
            if sum(map(len, a)) > TASK_ROWS:
                t = forest(np.concatenate(a), np.concatenate(b))
                a, b = [t["a"].to_numpy()], [t["b"].to_numpy()]
        return forest(np.concatenate([*a, own[:0]]), np.concatenate([*b, own[:0]]))

    def linked(found: pa.Table) -> pa.Table:
        return forest(found["a"].to_numpy(), found["b"].to_numpy())

    counted = blocks.meet(blocks.pairs_within(packed, eps), packed, packed, count, "pid bigint, n bigint", total)
    core = cut(counted.groupBy("pid").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).join(folded, "pid"))
    only = cut(blocks.pack(core.select(F.col("pid").alias("row_id"), "point"), tree))
    edges = blocks.meet(blocks.pairs_within(only, eps), only, only, link, "a bigint, b bigint", linked)
    found = connected_components(edges)
    return core.join(found.withColumnRenamed("node", "pid"), "pid", "left").select(
        "point", "copies", F.coalesce("comp", "pid").alias("comp")
    )


def _cell_of(width: float):
    return F.transform("point", lambda x: F.floor(x / width))


def _box_gap(lo_a, hi_a, lo_b, hi_b):
    """Smallest distance between two boxes."""
    gaps = F.zip_with(
        F.zip_with(F.col(lo_b), F.col(hi_a), lambda x, y: x - y),
        F.zip_with(F.col(lo_a), F.col(hi_b), lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))


def _box_span(lo_a, hi_a, lo_b, hi_b):
    """Largest distance between two boxes."""
    spans = F.zip_with(
        F.zip_with(F.col(hi_b), F.col(lo_a), lambda x, y: F.abs(x - y)),
        F.zip_with(F.col(hi_a), F.col(lo_b), lambda x, y: F.abs(x - y)),
        lambda x, y: F.greatest(x, y),
    )
    return F.sqrt(F.aggregate(spans, F.lit(0.0), lambda s, x: s + x * x))


def _refine(open_: DataFrame, core: DataFrame, eps: float, side: float, d: int) -> DataFrame:
    """(a, b) of crowded cell pairs that do come within ``eps``.

    Halves the boxes of both cells until each pair of boxes is surely near or surely far.
    Pairs of boxes survive only along the eps line, and a cell pair leaves as soon as one
    pair of its boxes is near, so the work follows the boundary, not the crowd.
    """
    live = cut(open_.select("a", "b", "cell_a", "cell_b"))
    live = live.withColumn("sub_a", F.col("cell_a")).withColumn("sub_b", F.col("cell_b"))
    out = open_.select("a", "b").limit(0)
    level, width = 0, side
    while not live.isEmpty():
        level, width = level + 1, width / 2
        parent = F.col("cell") if level == 1 else _cell_of(width * 2)
        sub = _cell_of(width)
        low = F.array(*[F.min(F.col("point")[i]) for i in range(d)])
        high = F.array(*[F.max(F.col("point")[i]) for i in range(d)])
        boxes = cut(
            core.withColumn("parent", parent)
            .withColumn("sub", sub)
            .groupBy("cell", "parent", "sub")
            .agg(low.alias("lo"), high.alias("hi"))
        )
        side_of = lambda s: boxes.select(
            F.col("cell").alias(f"cell_{s}"),
            F.col("parent").alias(f"sub_{s}"),
            F.col("sub").alias(f"next_{s}"),
            F.col("lo").alias(f"lo_{s}"),
            F.col("hi").alias(f"hi_{s}"),
        )
        pairs = cut(
            live.join(side_of("a"), ["cell_a", "sub_a"])
            .join(side_of("b"), ["cell_b", "sub_b"])
            .where(_box_gap("lo_a", "hi_a", "lo_b", "hi_b") <= eps)
            .withColumn("sure", _box_span("lo_a", "hi_a", "lo_b", "hi_b") <= eps)
        )
        done = pairs.where("sure").select("a", "b").distinct()
        out = out.unionByName(done)
        live = cut(
            pairs.join(done, ["a", "b"], "left_anti").select(
                "a", "b", "cell_a", "cell_b",
                F.col("next_a").alias("sub_a"), F.col("next_b").alias("sub_b"),
            )
        )
    return out


# ------------------------------------------------------------------ spanning tree


def core_distances(folded: DataFrame, near: DataFrame, min_samples: int) -> DataFrame:
    """Add ``core`` and ``reach`` (distance up to which the neighbour list is complete)."""
    others = near.join(
        folded.select(F.col("pid").alias("neighbor_id"), F.col("copies").alias("more")), "neighbor_id"
    )
    steps = F.array_sort(F.collect_list(F.struct("distance", "neighbor_id", "more")))
    lists = others.groupBy(F.col("row_id").alias("pid")).agg(
        steps.alias("steps"), F.max("distance").alias("reach")
    )
    # walk outwards until enough points are seen; copies of the point come first, at 0
    seen = F.aggregate(
        "steps",
        F.struct((F.col("copies") - 1).alias("n"), F.lit(0.0).alias("core")),
        lambda s, x: F.when(s["n"] >= min_samples, s).otherwise(
            F.struct((s["n"] + x["more"]).alias("n"), x["distance"].alias("core"))
        ),
    )
    return folded.join(lists, "pid", "left").select(
        "pid",
        "point",
        "copies",
        F.coalesce(seen["core"], F.lit(0.0)).alias("core"),
        F.coalesce("reach", F.lit(float("inf"))).alias("reach"),
    )


def spanning_tree(
    points: DataFrame,
    min_samples: int = 3,
    k: int = 16,
    cell_rows: int = CELL_ROWS,
    task_rows: int = TASK_ROWS,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): distinct points with ``copies`` and ``core``, and the exact minimum
    spanning tree (lo, hi, w) of their mutual reachability; ties by (w, lo, hi).

    The k-neighbour lists prove a component's lightest edge while it is lighter than the reach of its
    lists, which no unlisted edge is. Trees grow along such edges inside cells first, then inside
    groups of ``WIDEN`` times as many cells, as long as the edges left in the largest group are no
    more than ``task_rows``; then in Boruvka rounds of joins. Components without proof wait; when
    only such are left, ``_foreign`` searches for them.
    """
    k = max(k, min_samples)
    folded = cut(fold_copies(points))
    held = folded.select(F.col("pid").alias("row_id"), "point")
    near = cut(knn_join(held, held, k, True, cell_rows=cell_rows, **options))
    n = folded.count()
    nodes = cut(core_distances(folded, near, min_samples))
    if n - 1 <= k:  # lists are complete
        nodes = nodes.withColumn("reach", F.lit(float("inf")))
    core = nodes.select("pid", "core")
    ends = near.select(
        F.least("row_id", "neighbor_id").alias("lo"),
        F.greatest("row_id", "neighbor_id").alias("hi"),
        "distance",
    ).distinct()
    edges = cut(
        ends.join(core.select(F.col("pid").alias("lo"), F.col("core").alias("c1")), "lo")
        .join(core.select(F.col("pid").alias("hi"), F.col("core").alias("c2")), "hi")
        .select(
            F.col("lo").alias("a"), F.col("hi").alias("b"),
            F.greatest("distance", "c1", "c2").alias("w"), "lo", "hi",
        )
    )
    by = blocks.fit_tree(held, n, cell_rows)
    cells = cut(blocks.homes(cut(blocks.pack(held, by))))
    proven = cut(_grow_in_cells(nodes, near, cells))
    tree = proven.select("lo", "hi", "w").distinct()
    found = connected_components(proven.select("a", "b"))
    label = cut(
        nodes.select("pid")
        .join(found.select(F.col("node").alias("pid"), "comp"), "pid", "left")
        .select("pid", F.coalesce("comp", "pid").alias("comp"))
    )
    least = lambda df: df.groupBy("comp").agg(F.min("reach").alias("reach"), F.min("cell").alias("cell"))
    home = cells.select(F.col("row_id").alias("pid"), "cell")
    comps, seen = cut_measured(least(label.join(nodes.select("pid", "reach"), "pid").join(home, "pid")), {"n": F.count(F.lit(1))})
    for c in ("a", "b"):
        to = label.select(F.col("pid").alias(c), F.col("comp").alias("_to"))
        edges = edges.join(to, c).withColumn(c, F.col("_to")).drop("_to")
    edges = cut(edges.where("a <> b"))
    # a cell of one block has grown all it can
    width, wide = 1, cells.agg(F.max("cell")).first()[0] + 1 if n > CELL_ROWS else 1
    while seen["n"] > 1:
        both = edges.select(F.col("a").alias("comp"), F.col("b").alias("other"), "w", "lo", "hi")
        both = both.unionByName(
            edges.select(F.col("b").alias("comp"), F.col("a").alias("other"), "w", "lo", "hi")
        )
        chosen = None
        if width < wide:
            width *= WIDEN
            chosen = _grow_in_groups(both, comps, F.floor(F.col("cell") / width), task_rows)
            if chosen is not None and chosen.isEmpty():
                continue
        if chosen is None:
            best = both.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e"))
            known = cut(comps.join(best, "comp", "left"))
            # strict: an unlisted edge of equal weight could come first in the tie order
            chosen = known.where(F.col("e.w") < F.col("reach")).select("comp", "e.*")
            if chosen.isEmpty():
                label = cut(label)
                chosen = _foreign(nodes, label, known, by)
            chosen = cut(chosen.select("lo", "hi", "w", F.col("comp").alias("a"), F.col("other").alias("b")))
        tree = tree.unionByName(chosen.select("lo", "hi", "w").distinct())
        moves = cut(connected_components(chosen.select("a", "b")))
        moves = sized_broadcast(moves, 64)
        to = lambda df, c: df.join(
            moves.select(F.col("node").alias(c), F.col("comp").alias("_to")), c, "left"
        ).withColumn(c, F.coalesce("_to", c)).drop("_to")
        comps, seen = cut_measured(least(to(comps, "comp")), {"n": F.count(F.lit(1))})
        label = to(label, "comp")
        edges = cut(to(to(edges, "a"), "b").where("a <> b"))
    return nodes, cut(tree)


def _grow_in_groups(both: DataFrame, comps: DataFrame, group, task_rows: int) -> DataFrame | None:
    """Edges provable inside groups of components, None where a group has more than ``task_rows``."""
    grouped = comps.select("comp", "reach", group.alias("block"))
    load = both.join(grouped, "comp").groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    if (load.agg(F.max("n")).first()[0] or 0) > task_rows:
        return None
    lists = both.groupBy("comp").agg(F.collect_list(F.struct("w", "lo", "hi", "other")).alias("steps"))
    rows = grouped.join(lists, "comp").withColumnRenamed("comp", "pid")
    return cut(_grow(rows, ["block"]))


def _grow_in_cells(nodes: DataFrame, near: DataFrame, placed: DataFrame) -> DataFrame:
    """Tree edges provable inside one block of a cell, before anything global runs: most
    merging happens here, in one pass and in parallel."""
    home = placed.select(F.col("row_id").alias("pid"), "cell")
    size = home.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts"))
    blocks = home.join(sized_broadcast(size, 16), "cell").select(
        "pid", "cell", F.pmod(F.xxhash64("pid"), F.col("parts")).alias("part")
    )
    core = nodes.select("pid", "core")
    pair = F.col("pid"), F.col("other")
    lists = (
        near.select(F.col("row_id").alias("pid"), F.col("neighbor_id").alias("other"), "distance")
        .join(core, "pid")
        .join(core.select(F.col("pid").alias("other"), F.col("core").alias("far")), "other")
        .select(
            "pid",
            F.struct(
                F.greatest("distance", "core", "far").alias("w"),
                F.least(*pair).alias("lo"),
                F.greatest(*pair).alias("hi"),
                "other",
            ).alias("step"),
        )
        .groupBy("pid")
        .agg(F.collect_list("step").alias("steps"))
    )
    rows = nodes.select("pid", "reach").join(blocks, "pid").join(lists, "pid")
    return _grow(rows, ["cell", "part"])


def _grow(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(lo, hi, w, a, b): tree edges provable within each group of ``keys``.

    Rows are components (pid, reach, steps) with their listed edges (w, lo, hi, other). A
    component takes its lightest edge while it is lighter than the reach of every list in
    it. An edge to a component outside the group is kept and ends the growth.
    """

    def run(block: pd.DataFrame) -> pd.DataFrame:
        ids = [int(v) for v in block["pid"]]
        place = {v: i for i, v in enumerate(ids)}
        limit = block["reach"].to_list()
        heaps = [[(e["w"], e["lo"], e["hi"], e["other"]) for e in steps] for steps in block["steps"]]
        up = list(range(len(ids)))
        for heap in heaps:
            heapq.heapify(heap)

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        edges, queue = set(), list(range(len(ids)))
        while queue:
            i = queue.pop()
            if up[i] != i:
                continue
            heap = heaps[i]
            while heap and heap[0][3] in place and root(place[heap[0][3]]) == i:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= limit[i]:
                continue
            w, lo, hi, other = heap[0]
            edges.add((lo, hi, w, ids[i], other))
            if other not in place:
                continue
            j = root(place[other])
            if len(heaps[i]) > len(heaps[j]):
                i, j = j, i
            for e in heaps[i]:  # smaller into larger
                heapq.heappush(heaps[j], e)
            heaps[i], up[i], limit[j] = [], j, min(limit[i], limit[j])
            queue.append(j)
        return pd.DataFrame(list(edges), columns=["lo", "hi", "w", "a", "b"])

    return rows.groupBy(*keys).applyInPandas(
        run, "lo bigint, hi bigint, w double, a bigint, b bigint"
    )


def _foreign(nodes: DataFrame, label: DataFrame, known: DataFrame, tree: blocks.Tree) -> DataFrame:
    """Exact lightest outgoing edge (comp, w, lo, hi, other) of every component in
    ``known``, which carries the best listed edge where there is one.

    A point looks into a block only if the block holds a point of another component and its
    distance bound does not exceed the best weight known for the point's component.
    """
    sc = nodes.sparkSession.sparkContext
    full = cut(nodes.select("pid", "point", "core", "reach").join(label, "pid").withColumnRenamed("pid", "row_id"))
    members = cut(blocks.pack(full, tree, ("core", "comp")))
    facts = members.select(
        "block", F.array_min("comp").alias("c1"), F.array_max("comp").alias("c2"),
        F.array_min("core").alias("low"), F.array_max("core").alias("high"),
    ).toArrow().sort_by("block")  # a row a block, as their boxes are
    facts = {c: facts[c].to_numpy() for c in facts.column_names}
    pure = np.where(facts["c1"] == facts["c2"], facts["c1"], np.iinfo(np.int64).min)
    share = sc.broadcast((*blocks.boxes(members), pure, facts["low"], facts["high"]))

    def bound(frames):
        _, lo, hi, pure, _, high = share.value
        for f in frames:
            if not len(f):
                continue
            far = blocks.reaches(tree.project(matrix(f["point"])), lo, hi)
            far = np.maximum(np.maximum(far, f["core"].to_numpy()[:, None]), high[None, :])
            far[pure[None, :] == f["comp"].to_numpy()[:, None]] = np.inf
            out = pd.DataFrame({"comp": f["comp"], "top": far.min(axis=1)})
            yield out.groupby("comp", as_index=False)["top"].min()

    lost = known.where(F.col("e").isNull()).select("comp")
    tops = (
        full.join(sized_broadcast(lost, 32), "comp", "left_semi")
        .select("comp", "point", "core")
        .mapInPandas(bound, "comp bigint, top double")
        .groupBy("comp")
        .agg(F.min("top").alias("top"))
    )
    limits = cut(
        known.join(tops, "comp", "left").select(
            "comp", F.coalesce(F.col("e.w"), F.col("top")).alias("top")
        )
    )
    asked = full.join(sized_broadcast(limits, 32), "comp").where(F.col("reach") <= F.col("top"))
    asked = cut(blocks.pack(asked, tree, ("core", "comp", "top")))

    def near(batches):
        number, lo, hi, pure, low, _ = share.value
        for batch in batches:
            for row in batch.to_pylist():
                p = tree.project(blocks.unpacked(row)[1])
                gap = np.maximum(np.maximum(blocks.gaps(p, p, lo, hi), np.array(row["core"])[:, None]), low[None, :])
                see = (gap <= np.array(row["top"])[:, None] * (1 + 1e-12) + 1e-300) & (pure[None, :] != np.array(row["comp"])[:, None])
                hit = np.flatnonzero(see.any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(hit), row["block"])), pa.array(number[hit]),
                        pa.array([float(gap[see[:, j], j].min()) for j in hit], pa.float64()),
                        pa.array([np.packbits(see[:, j]).tobytes() for j in hit], pa.binary()),
                    ],
                    ["q_block", "block", "gap", "who"],
                )

    pairs = asked.select("block", "ids", "v", "core", "comp", "top").mapInArrow(
        near, "q_block bigint, block bigint, gap double, who binary"
    )
    found = "comp bigint, w double, lo bigint, hi bigint, other bigint"

    def lightest(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("comp", "w", "lo", "hi")])
        comp = t["comp"].to_numpy()
        return t.take(np.flatnonzero(np.r_[True, np.diff(comp) != 0])) if len(comp) else t

    def run(q: dict, rows: list[dict]) -> pa.Table:
        pid, x = blocks.unpacked(q)
        core, comp = np.array(q["core"]), np.array(q["comp"])
        _, first, mine = np.unique(comp, return_index=True, return_inverse=True)
        top, best = np.array(q["top"])[first], []
        for row in rows:
            who = np.unpackbits(np.frombuffer(row["who"], np.uint8), count=len(pid)).astype(bool)
            i = np.flatnonzero(who & (row["gap"] <= top[mine] * (1 + 1e-12) + 1e-300))
            them, y = blocks.unpacked(row)
            their_core, their = np.array(row["core"]), np.array(row["comp"])
            step = max(1, 4_000_000 // len(them))
            for at in range(0, len(i), step):
                ask = i[at : at + step]
                d, room = squares(x[ask], y)
                open_ = (d <= ceiling(top[mine[ask]], room)[:, None]) & (comp[ask][:, None] != their[None, :])
                for r, j in picked(open_):
                    a = ask[r]
                    w = np.maximum(np.maximum(summed(x[a], y[j]), core[a]), their_core[j])
                    ok = w <= top[mine[a]] * (1 + 1e-12)
                    if not ok.any():
                        continue
                    a, j, w = a[ok], j[ok], w[ok]
                    np.minimum.at(top, mine[a], w)
                    ends = np.minimum(pid[a], them[j]), np.maximum(pid[a], them[j])
                    best.append(lightest(pa.table({"comp": comp[a], "w": w, "lo": ends[0], "hi": ends[1], "other": their[j]})))
        return lightest(pa.concat_tables(best)) if best else blocks.none(found)

    searched = blocks.meet(pairs, asked, members, run, found, lightest)
    listed = known.where(F.col("e").isNotNull()).select("comp", "e.w", "e.lo", "e.hi", "e.other")
    return (
        searched.unionByName(listed)
        .groupBy("comp")
        .agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e"))
        .select("comp", "e.*")
    )


# ------------------------------------------------------------------ clusters


def homes(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row_id, pid): the distinct point that stands for each row."""
    own = points.select("row_id", vector.as_double(F.col("point")).alias("point"))
    return own.join(nodes.select("point", "pid"), "point").select("row_id", "pid")


def density_clusters(
    points: DataFrame,
    min_cluster_size: int = 5,
    min_samples: int = 3,
    epsilon: float = 0.1,
    band_rows: int = BAND_ROWS,
    **options,
) -> DataFrame:
    """(row_id, cluster_id) of HDBSCAN* on (row_id, point); noise is -1."""
    nodes, edges = spanning_tree(points, min_samples, **options)
    found = cut_trees(nodes, edges, [(0, min_cluster_size, epsilon)], band_rows)
    return (
        homes(points, nodes)
        .join(found.select("pid", "cluster_id"), "pid", "left")
        .select("row_id", F.coalesce("cluster_id", F.lit(NOISE)).cast("bigint").alias("cluster_id"))
    )

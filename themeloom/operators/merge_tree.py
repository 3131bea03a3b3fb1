"""Density clusters of a spanning tree, for many settings at once.

The tree of merges is built by contraction. Edges are cut by weight into bands of bounded size. In
rounds that halve the ranges of bands, the components of each lower half become single vertices of
the upper half, so that after ``log2(bands)`` rounds every band knows the components it starts from
and their sizes. All bands, for all cluster sizes, are then merged in parallel, one task a band and
size. What crosses bands are names: a component that enters a band with a cluster in it, and points
that have not met one yet. Pointer doubling resolves both in ``log2(bands)`` joins.

Clusters are chosen by excess of mass (Campello, Moulavi and Sander 2013): the value of a cluster is
the larger of its stability and the sum of its children's values. Rounds of joins take the settled
children into their parents and fold chains with one open child, so that their number grows with
the logarithm of the clusters, whatever the depth of the tree. Nothing is gathered in one place.
"""

from __future__ import annotations

from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.graph import connected_components
from themeloom.runtime import TASK_ROWS, cut, cut_measured

#: Edges of a band, which one task merges.
BAND_ROWS = 200_000

#: Smallest distance, so that densities stay finite for copies.
TINY = 1e-12

#: Relative difference below which a cluster's stability equals its children's values.
TIE = 1e-9


def _levels(bands: int) -> int:
    return (bands - 1).bit_length()


def contracted(nodes: DataFrame, edges: DataFrame, band_rows: int = BAND_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """Edges (band, eid, a, b, w), whose ends are the components that the lighter bands leave, and
    these components as the band meets them (band, id, size); a component is named by its smallest
    point. ``eid`` follows the order (w, lo, hi). The number of bands comes third."""
    bands = max(1, ceil(edges.count() / band_rows))
    ordered = edges.repartitionByRange(bands, "w", "lo", "hi").sortWithinPartitions("w", "lo", "hi")
    # the id holds the partition, here the band, in its upper bits
    numbered = ordered.select(F.monotonically_increasing_id().alias("eid"), F.col("lo").alias("a"), F.col("hi").alias("b"), "w")
    rest = cut(numbered.withColumn("band", F.shiftright("eid", 33)))
    held = nodes.select(F.lit(0).cast("bigint").alias("band"), F.col("pid").alias("id"), F.col("copies").alias("size"))
    for step in reversed(range(_levels(bands))):
        # held.band counts ranges of 2 << step bands; each is halved
        e = rest.withColumn("part", F.shiftright("band", step + 1))
        upper = F.shiftright("band", step).bitwiseAND(F.lit(1)) == 1
        comps = cut(connected_components(e.where(~upper).select("part", "a", "b"), "part"))
        moved = e.where(upper)
        for c in ("a", "b"):
            to = comps.select("part", F.col("node").alias(c), F.col("comp").alias("_to"))
            moved = moved.join(to, ["part", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        rest = cut(e.where(~upper).unionByName(moved).drop("part"))
        named = held.join(comps.select(F.col("part").alias("band"), F.col("node").alias("id"), "comp"), ["band", "id"], "left")
        above = named.groupBy("band", F.coalesce("comp", "id").alias("id")).agg(F.sum("size").alias("size"))
        both = held.withColumn("band", F.col("band") * 2).unionByName(above.withColumn("band", F.col("band") * 2 + 1))
        at = F.shiftright("band", step).alias("band")
        ends = rest.select(at, F.col("a").alias("id")).unionByName(rest.select(at, F.col("b").alias("id"))).distinct()
        held = cut(both.join(ends, ["band", "id"], "left_semi"))
    return rest, held, bands


_FOLDED = (
    "kind string, m bigint, band bigint, id bigint, name bigint, cid bigint, via bigint, "
    "mass double, parent bigint, birth double, size bigint"
)


def _fold(key: tuple, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
    """Merge the components of one band along its edges, for clusters of at least ``m`` points.

    A component of that size has an open cluster: ``cid``, born here, or the one that entry ``via``
    brought along. Rows: a cluster with the mass it gains here and, if it closes, its parent; entries
    below the size with the cluster they fall into; and what is open at the end, by component.
    """
    m, band = int(key[0]), int(key[1])
    ids, size = v["id"].tolist(), v["size"].tolist()
    place = {x: i for i, x in enumerate(ids)}
    cluster = [(None, x) if n >= m else None for x, n in zip(ids, size)]
    loose = [[] if c else [i] for i, c in enumerate(cluster)]
    up, mass, closed, own = list(range(len(ids))), {}, {}, []

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    e = e.sort_values("eid")
    for a, b, w, eid in zip(e["a"].tolist(), e["b"].tolist(), e["w"].tolist(), e["eid"].tolist()):
        i, j = root(place[a]), root(place[b])
        if ids[j] < ids[i]:
            i, j = j, i
        density, total = 1.0 / max(w, TINY), size[i] + size[j]
        x, y = cluster[i], cluster[j]
        fallen, leaves = loose[i] + loose[j], min(size[i], size[j])
        if x and y:
            closed[x], closed[y] = (2 * eid, w, size[i]), (2 * eid, w, size[j])
        if x and y or not x and not y:
            x, leaves = ((2 * eid, None) if total >= m else None), total
        elif y:
            x, leaves = y, size[i]
        else:
            leaves = size[j]
        if x:
            mass[x] = mass.get(x, 0.0) + leaves * density
            own += [(k, x) for k in fallen]
            fallen = []
        up[j], size[i], cluster[i], loose[i], loose[j] = i, total, x, fallen, []
    none = (None,) * 3
    out = [("cluster", None, None, *c, mass.get(c, 0.0), *closed.get(c, none)) for c in {**mass, **closed}]
    out += [("own", ids[k], None, *c, None, *none) for k, c in own]
    for i, x in enumerate(ids):
        if up[i] == i and cluster[i]:
            out.append(("open", None, x, *cluster[i], None, *none))
        out += [("loose", ids[k], x, None, None, None, *none) for k in loose[i]]
    frame = pd.DataFrame(out, columns=["kind", "id", "name", "cid", "via", "mass", "parent", "birth", "size"])
    # large whole numbers beside missing ones must not become floats
    kinds = {c: "Int64" for c in ("id", "name", "cid", "via", "parent", "size")} | {"mass": float, "birth": float}
    columns = {c: pd.Series([r[i] for r in out], dtype=kinds.get(c, object)) for i, c in enumerate(frame.columns)}
    columns |= {"m": pd.Series([m] * len(out), dtype="int64"), "band": pd.Series([band] * len(out), dtype="int64")}
    return pd.DataFrame(columns)[[f.split()[0] for f in _FOLDED.split(", ")]]


def _doubled(pointers: DataFrame, rounds: int) -> DataFrame:
    """(m, band, id, cid): pointers (to_band, to_id) followed until a cluster is known."""
    for _ in range(rounds):
        to = pointers.select(
            "m", F.col("band").alias("to_band"), F.col("id").alias("to_id"), F.col("cid").alias("_cid"),
            F.col("to_band").alias("_band"), F.col("to_id").alias("_id"),
        )
        pointers = cut(
            pointers.join(to, ["m", "to_band", "to_id"], "left").select(
                "m", "band", "id", F.coalesce("cid", "_cid").alias("cid"), F.col("_band").alias("to_band"), F.col("_id").alias("to_id")
            )
        )
    return pointers.select("m", "band", "id", "cid")


def cluster_trees(
    nodes: DataFrame, edges: DataFrame, sizes: list[int], band_rows: int = BAND_ROWS
) -> tuple[DataFrame, DataFrame]:
    """For each least cluster size m: clusters (m, cid, parent, birth, size, stability) without the
    root, parent NULL below it, and members (m, pid, cid), the first cluster of each point."""
    rest, held, bands = contracted(nodes, edges, band_rows)
    rounds = _levels(bands)
    every = F.explode(F.array(*[F.lit(int(m)).cast("bigint") for m in sorted(set(sizes))])).alias("m")
    met = held.select("*", every)
    folded = rest.select("*", every).groupBy("m", "band").cogroup(met.groupBy("m", "band")).applyInPandas(_fold, _FOLDED)
    folded = cut(folded)

    # a point with enough copies is a cluster before any edge
    copies = cut(
        nodes.select("pid", "copies", "core", (F.monotonically_increasing_id() * 2 + 1).alias("born"))
        .select("*", every)
        .where(F.col("copies") >= F.col("m"))
    )
    late = folded.where("kind = 'open'").select("m", F.col("name").alias("id"), "band", F.lit(1).alias("late"), F.struct("band", "cid", "via").alias("x"))
    asked = met.where(F.col("size") >= F.col("m")).select("m", "id", "band", F.lit(0).alias("late"), F.lit(None).cast(late.schema["x"].dataType).alias("x"))
    past = Window.partitionBy("m", "id").orderBy("band", "late").rowsBetween(Window.unboundedPreceding, -1)
    brought = asked.unionByName(late).withColumn("x", F.last("x", True).over(past)).where("late = 0")
    born = copies.select("m", F.col("pid").alias("id"), "born")
    pointers = brought.join(born, ["m", "id"], "left").select(
        "m", "band", "id", F.when(F.col("x").isNull(), F.col("born")).otherwise(F.col("x.cid")).alias("cid"),
        F.col("x.band").alias("to_band"), F.col("x.via").alias("to_id"),
    )
    brought = cut(_doubled(pointers, rounds))
    known = folded.join(brought.select("m", "band", F.col("id").alias("via"), F.col("cid").alias("_cid")), ["m", "band", "via"], "left")
    known = known.withColumn("cid", F.coalesce("cid", "_cid")).drop("_cid")

    start = copies.select("m", F.col("born").alias("cid"), (F.col("copies") / F.greatest("core", F.lit(TINY))).alias("mass"))
    gained = known.where("kind = 'cluster'").unionByName(start, allowMissingColumns=True)
    whole = gained.groupBy("m", "cid").agg(
        F.sum("mass").alias("mass"), F.max("parent").alias("parent"), F.max("birth").alias("birth"), F.max("size").alias("size")
    )
    whole = cut(whole)
    inner = whole.where("parent IS NOT NULL")
    roots = whole.where("parent IS NULL").select("m", F.col("cid").alias("parent"), F.lit(True).alias("at_root"))
    stability = F.col("mass") - F.col("size") / F.greatest("birth", F.lit(TINY))
    clusters = inner.join(roots, ["m", "parent"], "left").select(
        "m", "cid", F.when(F.col("at_root").isNull(), F.col("parent")).alias("parent"), "birth", "size", stability.alias("stability")
    )

    # points that leave a band without a cluster enter a later one in their component
    own = known.where("kind = 'own'").select("m", "band", "id", "cid")
    loose = folded.where("kind = 'loose'").select("m", "band", "id", "name")
    begun = held.groupBy("id").agg(F.min("band").alias("band"))
    if rounds:
        entry = met.select("m", "id", "band", F.lit(0).alias("late"), F.col("band").alias("to_band"))
        left = loose.select("m", F.col("name").alias("id"), "band", F.lit(1).alias("late")).distinct()
        ahead = Window.partitionBy("m", "id").orderBy("band", "late").rowsBetween(1, Window.unboundedFollowing)
        later = entry.unionByName(left, allowMissingColumns=True).withColumn("to_band", F.first("to_band", True).over(ahead)).where("late = 1")
        later = later.select("m", "band", F.col("id").alias("name"), "to_band")
        moved = loose.join(later, ["m", "band", "name"]).select("m", "band", "id", "to_band", F.col("name").alias("to_id"))
        own = _doubled(cut(own.unionByName(moved, allowMissingColumns=True)), rounds)
    first = own.where("cid IS NOT NULL").join(begun, ["id", "band"]).select("m", F.col("id").alias("pid"), "cid")
    return cut(clusters), cut(first.unionByName(copies.select("m", "pid", F.col("born").alias("cid"))))


_STATE = (
    "m bigint, cid bigint, parent bigint, s double, got double, open bigint, kid bigint, value double, "
    "base bigint, least double, more double, fresh boolean"
)


def _settled(frames):
    """Values of the clusters whose children's values the task knows, from the leaves on; ``fresh``
    marks a value that the parent, which another task holds, has yet to be told."""
    f = pd.concat(list(frames) or [pd.DataFrame(columns=[c.split()[0] for c in _STATE.split(", ")])])
    place = {k: i for i, k in enumerate(zip(f["m"].tolist(), f["cid"].tolist()))}
    own, got, open_, kid = (f[c].tolist() for c in ("s", "got", "open", "kid"))
    parent = [None if pd.isna(p) else place.get((m, int(p)), -1) for m, p in zip(f["m"].tolist(), f["parent"])]
    value, fresh, ids = [None] * len(f), [False] * len(f), f["cid"].tolist()
    ready = [i for i, n in enumerate(open_) if n == 0]
    for i in ready:
        value[i], up = max(own[i], got[i]), parent[i]
        fresh[i] = up == -1
        if up is not None and up >= 0:
            got[up], open_[up], kid[up] = got[up] + value[i], open_[up] - 1, kid[up] ^ ids[i]
            if open_[up] == 0:
                ready.append(up)
    f = f.assign(got=got, open=open_, kid=kid, value=pd.Series(value, f.index, dtype=float), fresh=fresh)
    f["base"] = pd.Series([k if n == 1 else None for k, n in zip(kid, open_)], f.index, dtype="Int64")
    f["more"] = f["got"].where(f["base"].notna(), 0.0).astype(float)
    yield f.assign(parent=f["parent"].astype("Int64"))


def _told(step: DataFrame) -> DataFrame:
    """Fresh values taken into the parents; a parent with one child left waits for its value."""
    given = step.where("fresh AND parent IS NOT NULL").groupBy("m", F.col("parent").alias("cid")).agg(
        F.sum("value").alias("_got"), F.count(F.lit(1)).alias("_n"), F.bit_xor("cid").alias("_kid")
    )
    got, open_ = F.col("got") + F.coalesce("_got", F.lit(0.0)), F.col("open") - F.coalesce("_n", F.lit(0))
    kid = F.col("kid").bitwiseXOR(F.coalesce("_kid", F.lit(0)))
    lone = (open_ == 1) & F.col("base").isNull()
    return step.join(given, ["m", "cid"], "left").select(
        "m", "cid", "parent", "s", got.alias("got"), open_.alias("open"), kid.alias("kid"), "value",
        F.when(lone, kid).otherwise(F.col("base")).alias("base"),
        "least",
        F.when(lone, got).otherwise(F.col("more")).alias("more"),
    )


def with_eligible(clusters: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Clusters with ``eligible``: the children's values do not beat the cluster's own stability.

    Tasks of about ``task_rows`` settle what they hold with all its descendants; rounds of joins
    settle the rest.
    """
    kids = clusters.groupBy("m", F.col("parent").alias("cid")).agg(F.count(F.lit(1)).alias("open"), F.bit_xor("cid").alias("kid"))
    kids = kids.where("cid IS NOT NULL")
    state = clusters.select("m", "cid", "parent", F.col("stability").alias("s")).join(kids, ["m", "cid"], "left")
    zero = {"got": F.lit(0.0), "open": F.coalesce("open", F.lit(0)), "kid": F.coalesce("kid", F.lit(0)), "least": F.col("s"), "more": F.lit(0.0)}
    none = {"value": F.lit(None).cast("double"), "base": F.lit(None).cast("bigint"), "fresh": F.lit(False)}
    n = {"n": F.count_if(F.col("value").isNull()), "fresh": F.count_if("fresh")}
    state, seen = cut_measured(state.withColumns(zero | none).select(*[c.split()[0] for c in _STATE.split(", ")]), n)
    tasks = max(1, ceil(seen["n"] / task_rows))
    state, seen = cut_measured(state.coalesce(tasks).mapInPandas(_settled, _STATE), n)
    if seen["fresh"]:
        state, seen = cut_measured(_told(state), {"n": n["n"]})
    while seen["n"]:
        # a cluster with one open child is max(least, more + value of base), and so are chains of them
        below = state.select("m", F.col("cid").alias("base"), *[F.col(c).alias(f"_{c}") for c in ("value", "base", "least", "more")])
        known = F.col("_value").isNotNull()
        hop = ~known & F.col("_base").isNotNull()
        value = F.when(F.col("open") == 0, F.greatest("s", "got")).when(known, F.greatest(F.col("least"), F.col("more") + F.col("_value")))
        step = state.join(below, ["m", "base"], "left").select(
            "m", "cid", "parent", "s", "got", "open", "kid",
            F.coalesce("value", value).alias("value"),
            (F.col("value").isNull() & value.isNotNull()).alias("fresh"),
            F.when(hop, F.col("_base")).otherwise(F.col("base")).alias("base"),
            F.when(hop, F.greatest(F.col("least"), F.col("more") + F.col("_least"))).otherwise(F.col("least")).alias("least"),
            F.when(hop, F.col("more") + F.col("_more")).otherwise(F.col("more")).alias("more"),
        )
        state, seen = cut_measured(_told(step), {"n": n["n"]})
    beaten = state.select("m", "cid", (F.col("s") >= F.col("got") - TIE * F.abs("got")).alias("eligible"))
    return clusters.join(beaten, ["m", "cid"])


def _topmost(tree: DataFrame, flagged: Column | None) -> DataFrame:
    """(trial, cid, top): the highest flagged cluster on the way up (trial, cid, parent), itself
    included. Pointer doubling: rounds grow with the logarithm of the depth."""
    t = tree.select("trial", "cid", F.col("parent").alias("up"), (F.when(flagged, F.col("cid")) if flagged is not None else F.col("cid")).alias("top"))
    t, seen = cut_measured(t, {"n": F.count("up")})
    while seen["n"]:
        above = t.select("trial", F.col("cid").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        t, seen = cut_measured(
            t.join(above, ["trial", "up"], "left").select("trial", "cid", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top")),
            {"n": F.count("up")},
        )
    return t.select("trial", "cid", "top")


def select_clusters(clusters: DataFrame, trials: DataFrame, lift: bool) -> DataFrame:
    """(trial, cid, label) for trials (trial, m, epsilon): the chosen cluster that each cluster lies in.

    Excess of mass takes the highest eligible clusters; with ``lift``, a chosen cluster born below
    ``epsilon`` gives way to its first ancestor born above it (Malzer and Baum 2020).
    """
    tree = cut(with_eligible(clusters).join(trials, "m").select("trial", "cid", "parent", "birth", "eligible", "epsilon"))
    best = _topmost(tree, F.col("eligible"))
    if not lift:
        return best.where("top IS NOT NULL").withColumnRenamed("top", "label")
    chosen = best.where("top IS NOT NULL").select("trial", F.col("top").alias("cid")).distinct()
    stop = F.col("parent").isNull() | (F.col("birth") > F.col("epsilon"))
    hops = tree.withColumn("parent", F.when(~stop, F.col("parent")))
    lifted = _topmost(hops, None)
    low = (F.col("epsilon") > 0) & (F.col("birth") < F.col("epsilon"))
    taken = (
        chosen.join(tree, ["trial", "cid"])
        .join(lifted, ["trial", "cid"])
        .select("trial", F.when(low, F.col("top")).otherwise(F.col("cid")).alias("cid"))
        .distinct()
        .withColumn("taken", F.lit(True))
    )
    marked = tree.join(taken, ["trial", "cid"], "left")
    return _topmost(marked, F.col("taken")).where("top IS NOT NULL").withColumnRenamed("top", "label")


def cut_trees(nodes: DataFrame, edges: DataFrame, settings: list[tuple], band_rows: int = BAND_ROWS) -> DataFrame:
    """(trial, pid, cluster_id) for settings (trial, min_cluster_size, epsilon): points in a chosen
    cluster, named by its smallest point; all other points are noise in that trial."""
    if not settings:
        raise ValueError("no settings")
    spark = nodes.sparkSession
    trials = spark.createDataFrame(
        [(int(i), int(m), float(e)) for i, m, e in settings], "trial bigint, m bigint, epsilon double"
    )
    clusters, members = cluster_trees(nodes, edges, [s[1] for s in settings], band_rows)
    labels = select_clusters(clusters, trials, any(s[2] > 0 for s in settings))
    of = members.join(trials.select("trial", "m"), "m").join(labels, ["trial", "cid"])
    placed = cut(of.select("trial", "pid", "label"))
    names = placed.groupBy("trial", "label").agg(F.min("pid").alias("cluster_id"))
    return placed.join(names, ["trial", "label"]).select("trial", "pid", "cluster_id")

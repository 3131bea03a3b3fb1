"""Silhouettes of several labellings from one pass over the distances.

Distinct points are dealt to blocks once, for all trials. The clusters of trials that cut one tree nest,
so a point is placed by the largest of its clusters that a block can hold, and each cluster of that size
or less lies whole in a block. A task meets two blocks: each distance is taken once, for all trials and
both ends. Points of a block with the same labels in all trials are an atom; sums over atoms give those
over clusters. What leaves a task is packed: sums over the few clusters that lie in several blocks, and
the least mean to a whole cluster. Trials whose clusters lie across each other are left to the caller.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import vector
from themeloom.operators.blocks import to_matrix
from themeloom.operators.neighbors import Spread
from themeloom.runtime import cut, sized_broadcast

#: Rows and columns of a tile of distances, which stays in a core's cache.
TILE_ROWS, TILE_COLUMNS = 256, 512

#: Atoms of a block up to which their sums are a matrix product; bytes of the sums kept for the other end.
FEW, KEPT_BYTES = 32, 64 * 1024 * 1024

#: Bytes of sums in one packed row.
SLICE_BYTES = 8 * 1024 * 1024

#: Clusters in several blocks that are summed in one pass, for each trial and block.
SPLIT = 4

_LABELS = [("of", "i4"), ("trial", "i8"), ("cluster", "i8"), ("size", "f8"), ("times", "f8"), ("column", "i4")]
_ASKED = [("pid", "i8"), *_LABELS, ("weight", "f8")]


def values(points: DataFrame, labels: DataFrame, n: int, ways: int, squared: bool) -> DataFrame | None:
    """(trial, pid, cluster_id, weight, value) as ``quality.silhouette_values`` has them, from up to
    ``n`` labelled rows in ``ways`` blocks; None where too many clusters lie across blocks."""
    rows = max(1, ceil(n / ways))
    labels = labels.select(F.col("trial").cast("bigint").alias("trial"), "pid", F.col("cluster_id").cast("bigint").alias("cluster_id"))
    weights = points.select("pid", "weight")
    loads = cut(labels.join(weights, "pid").groupBy("trial", "cluster_id").agg(F.count(F.lit(1)).alias("n")))
    loads = sized_broadcast(loads, 64)
    largest = F.max(F.when(F.col("n") <= rows, F.struct("n", "trial", "cluster_id")))
    placed = labels.join(loads, ["trial", "cluster_id"]).groupBy("pid").agg(largest.alias("home"))
    key = F.coalesce(F.when(F.col("home").isNotNull(), F.xxhash64("home.trial", "home.cluster_id")), F.xxhash64("pid", F.lit("alone")))
    placed = cut(placed.select("pid", key.alias("key")))
    placed = _dealt(placed, rows, ways)

    at = F.col("block")
    sizes = cut(
        labels.join(weights, "pid").join(placed, "pid").groupBy("trial", "cluster_id")
        .agg(F.sum("weight").alias("size"), (F.min(at) == F.max(at)).alias("whole"))
    )
    parts, trials = sizes.agg(F.count(F.when(~F.col("whole"), 1)), F.countDistinct("trial")).first()
    if parts > SPLIT * trials * ways:
        return None
    split = sorted(tuple(r) for r in sizes.where("NOT whole").select("trial", "cluster_id", "size").collect())
    columns = labels.sparkSession.createDataFrame([(t, c, i) for i, (t, c, _) in enumerate(split)], "trial bigint, cluster_id bigint, column int")
    known = sized_broadcast(sizes.join(F.broadcast(columns), ["trial", "cluster_id"], "left").select("trial", "cluster_id", "size", F.coalesce("column", F.lit(-1)).alias("column")), 64)
    tagged = (
        labels.join(known, ["trial", "cluster_id"])
        .groupBy("pid")
        .agg(F.array_sort(F.collect_list(F.struct("trial", "cluster_id", F.col("size").cast("double").alias("size"), "column"))).alias("labels"))
    )
    name = F.array_join(F.transform("labels", lambda x: F.concat_ws(":", x["trial"], x["cluster_id"])), ",")
    full = (
        points.select("pid", vector.as_double(F.col("point")).alias("point"), F.col("weight").cast("double").alias("weight"))
        .join(tagged, "pid").join(placed, "pid").withColumn("name", name)
    )
    packed = cut(full.groupBy("block").applyInArrow(_pack, "block int, " + ", ".join(f"{c} binary" for c in _PACKED)))
    return _finished(_met(packed, ways, len(split), squared), split)


def _dealt(placed: DataFrame, rows: int, ways: int) -> DataFrame:
    """(pid, block): keys with many points go to the emptiest block, the others by hash."""
    loads = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    heavy = loads.where(F.col("n") > max(1, rows // 16)).orderBy(F.desc("n"), "key").collect() if ways > 1 else []
    filled = [(0, i) for i in range(ways)]
    home = []
    for r in heavy:  # bounded: 16 a block and so for all blocks
        load, i = heapq.heappop(filled)
        home.append((r["key"], i))
        heapq.heappush(filled, (load + r["n"], i))
    homes = F.broadcast(placed.sparkSession.createDataFrame(home, "key bigint, home int"))
    block = F.coalesce("home", F.pmod("key", F.lit(ways)).cast("int"))
    return cut(placed.join(homes, "key", "left").select("pid", block.alias("block")))


# ------------------------------------------------------------------ blocks

_PACKED = ["pid", "first", "v", "w", "atom", "start", "labels", "asked"]
_KINDS = {"pid": "i8", "first": "i8", "v": "f8", "w": "f8", "atom": "i4", "start": "i8", "labels": _LABELS, "asked": _ASKED}


def _pack(key, t):
    """One row: points in the order of their atoms and ids, the labels of the atoms, and what is asked:
    a row for every id, label and weight."""
    x, pid, w = to_matrix(t["point"].combine_chunks()), t["pid"].to_numpy(), t["weight"].to_numpy()
    _, some, atom = np.unique(np.array(t["name"].to_pylist(), dtype=object), return_index=True, return_inverse=True)
    order = np.lexsort((w, pid, atom))
    x, pid, w, atom = x[order], pid[order], w[order], atom[order]
    rows = []
    for i, held in enumerate(t["labels"].take(pa.array(some)).to_pylist()):
        seen: dict = {}
        for r in held:
            seen.setdefault((r["trial"], r["cluster_id"]), []).append(r)
        rows += [(i, *k, r[0]["size"], len(r), r[0]["column"]) for k, r in seen.items()]
    labels = np.array(rows, dtype=_LABELS)
    first = np.flatnonzero(np.r_[True, np.diff(pid) != 0])
    place = np.cumsum(np.r_[True, np.diff(pid) != 0]) - 1
    # labels of a trial, all together, multiply what an id is asked for
    begin, until = np.searchsorted(labels["of"], np.arange(len(some))), np.searchsorted(labels["of"], np.arange(len(some)), "right")
    other = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(w) != 0)])  # an id's weights, each once
    many = (until - begin)[atom[other]]
    at = np.repeat(begin[atom[other]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    asked = np.zeros(len(at), dtype=_ASKED)
    for c, _ in _LABELS[1:]:
        asked[c] = labels[c][at]
    asked["of"], asked["pid"], asked["weight"] = np.repeat(place[other], many), np.repeat(pid[other], many), np.repeat(w[other], many)
    _, group = np.unique(np.stack([asked["of"], asked["trial"]]), axis=1, return_inverse=True)
    one = np.repeat(np.r_[True, np.diff(place[other]) != 0], many)
    asked["times"] = np.bincount(group[one], asked["times"][one], group.max(initial=-1) + 1)[group]
    held = {"pid": pid[first], "first": np.r_[first, len(x)], "v": x, "w": w, "atom": atom.astype("i4"), "start": np.searchsorted(atom, np.arange(len(some))), "labels": labels, "asked": asked}
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32())} | {c: pa.array([held[c].astype(_KINDS[c]).tobytes()]) for c in _PACKED})


class Block:
    """A packed row, and its clusters by trial."""

    def __init__(self, row: dict, columns: int):
        for c in _PACKED:
            setattr(self, c, np.frombuffer(row[c], _KINDS[c]))
        self.number = row["block"]
        self.v = self.v.reshape(len(self.atom), -1)
        self.atoms = len(self.start)
        self.even = bool((self.w == 1).all())
        self.whole, self.split = {}, np.zeros((self.atoms, columns))
        part = self.labels[self.labels["column"] >= 0]
        self.split[part["of"], part["column"]] = part["times"]
        own = self.labels[self.labels["column"] < 0]
        for t in np.unique(own["trial"]):
            mine = own[own["trial"] == t]
            mine = mine[np.argsort(mine["cluster"], kind="stable")]
            starts = np.flatnonzero(np.r_[True, np.diff(mine["cluster"]) != 0])
            times = mine["times"] if (mine["times"] != 1).any() else None
            self.whole[t] = mine["of"], times, starts, mine["cluster"][starts], mine["size"][starts]
        # the asked of a trial, in order of the ids
        self.asks = {t: np.flatnonzero(self.asked["trial"] == t) for t in np.unique(self.asked["trial"])}

    def weights(self, rows: slice) -> np.ndarray:
        """Rows by atoms, for a matrix product."""
        out = np.zeros((rows.stop - rows.start, self.atoms))
        out[np.arange(len(out)), self.atom[rows]] = self.w[rows]
        return out


class Answers:
    """Sums and least means of the points of a block from another one."""

    def __init__(self, q: Block, m: Block):
        self.q, self.m, self.same = q, m, q.number == m.number
        self.sums = np.zeros((len(q.pid), m.split.shape[1]))
        self.least = np.full(len(q.asked), np.inf)
        self.own = np.full(len(q.asked), np.nan)

    def settle(self, at: int, to: int, sums: np.ndarray) -> None:
        """Takes the sums over the atoms of ``m`` for the rows of the ids from ``at`` to ``to``."""
        q, m = self.q, self.m
        if len(sums) > to - at:
            sums = np.add.reduceat(sums, q.first[at:to] - q.first[at], axis=0)
        if self.sums.shape[1]:
            self.sums[at:to] = sums @ m.split
        for t, (atoms, times, starts, names, size) in m.whole.items():
            asks = q.asks.get(t)
            if asks is None:
                continue
            low, high = np.searchsorted(q.asked["of"][asks], (at, to))
            asks = asks[low:high]
            if not len(asks):
                continue
            row = q.asked["of"][asks] - at
            total = sums[:, atoms]
            if times is not None:
                total *= times
            if len(starts) < len(atoms):
                total = np.add.reduceat(total, starts, axis=1)
            mean = total / size
            if len(row) != len(mean) or row[-1] != len(mean) - 1:
                mean = mean[row]
            if self.same:
                j = np.minimum(np.searchsorted(names, q.asked["cluster"][asks]), len(names) - 1)
                home = np.flatnonzero(names[j] == q.asked["cluster"][asks])
                self.own[asks[home]] = total[row[home], j[home]]
                mean[home, j[home]] = np.inf
            self.least[asks] = mean.min(axis=1)

    def rows(self) -> list[dict]:
        """Packed, in slices of ids."""
        step = max(1, SLICE_BYTES // (8 * max(1, self.sums.shape[1])))
        step, of, out = min(step, SLICE_BYTES // 64), self.q.asked["of"], []
        for i, at in enumerate(range(0, len(self.q.pid), step)):
            low, high = np.searchsorted(of, (at, at + step))
            own = self.same
            asked = self.q.asked[low:high].copy()
            asked["of"] -= at
            out.append({
                "block": self.q.number, "slice": i, "n": min(step, len(self.q.pid) - at), "sums": self.sums[at : at + step].tobytes(), "least": self.least[low:high].tobytes(),
                "own": self.own[low:high].tobytes() if own else None, "asked": asked.tobytes() if own else None,
            })
        return out


def _over_atoms(d: np.ndarray, m: Block, cols: slice, out: np.ndarray, weights: np.ndarray | None) -> None:
    """Adds to ``out`` the sums of a tile over the atoms of its columns."""
    if weights is not None:
        out += d @ weights
        return
    if not m.even:
        d = d * m.w[cols]
    low, high = m.atom[cols.start], m.atom[cols.stop - 1] + 1
    out[:, low:high] += np.add.reduceat(d, np.maximum(m.start[low:high] - cols.start, 0), axis=1)


def _tiles(q: Block, limit: int):
    """(first id, id after, rows) with some ``limit`` rows, whole ids."""
    at = 0
    while at < len(q.pid):
        to = max(at + 1, int(np.searchsorted(q.first, q.first[at] + limit, "right")) - 1)
        yield at, to, slice(int(q.first[at]), int(q.first[to]))
        at = to


def _one_way(q: Block, m: Block, squared: bool) -> Answers:
    found, far = Answers(q, m), Spread(q.v, m.v, squared)
    few = m.atoms <= FEW
    steps = [slice(i, min(i + TILE_COLUMNS, len(m.v))) for i in range(0, len(m.v), TILE_COLUMNS)]
    weights = [m.weights(c) if few else None for c in steps]
    for at, to, rows in _tiles(q, max(16, min(TILE_ROWS, KEPT_BYTES // (16 * m.atoms)))):
        sums = np.zeros((rows.stop - rows.start, m.atoms))
        for cols, w in zip(steps, weights):
            _over_atoms(far.tile(rows, cols), m, cols, sums, w)
        found.settle(at, to, sums)
    return found


def _both_ways(q: Block, m: Block, squared: bool) -> list[Answers]:
    """Every distance once, for both ends."""
    there, back, far = Answers(q, m), Answers(m, q), Spread(q.v, m.v, squared)
    few, kept = m.atoms <= FEW, np.zeros((q.atoms, len(m.v)))
    steps = [slice(i, min(i + TILE_COLUMNS, len(m.v))) for i in range(0, len(m.v), TILE_COLUMNS)]
    weights = [m.weights(c) if few else None for c in steps]
    for at, to, rows in _tiles(q, TILE_ROWS):
        sums = np.zeros((rows.stop - rows.start, m.atoms))
        low, high = q.atom[rows.start], q.atom[rows.stop - 1] + 1
        mine = q.weights(rows)[:, low:high].T
        for cols, w in zip(steps, weights):
            d = far.tile(rows, cols)
            _over_atoms(d, m, cols, sums, w)
            kept[low:high, cols] += mine @ d
        there.settle(at, to, sums)
    for at, to, rows in _tiles(m, 4096):
        back.settle(at, to, np.ascontiguousarray(kept[:, rows].T))
    return [there, back]


def _met(packed: DataFrame, ways: int, columns: int, squared: bool) -> DataFrame:
    """Answers of all pairs of blocks, a pair a task."""
    pairs = [(i, j) for i in range(ways) for j in range(i, ways)]
    number = packed.sparkSession.createDataFrame([(b, k) for k, (i, j) in enumerate(pairs) for b in {i, j}], "block int, pair int")
    dealt = packed.join(F.broadcast(number), "block").repartitionById(len(pairs), F.col("pair"))

    def run(batches):
        held: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row.pop("pair"), []).append(row)
        for pair, rows in held.items():
            got = [Block(r, columns) for r in sorted(rows, key=lambda r: r["block"])]
            i, j = pairs[pair]
            if i == j:
                out = [_one_way(got[0], got[0], squared)]
            elif len(got) < 2:
                continue
            elif got[0].atoms * len(got[1].v) * 8 <= KEPT_BYTES:
                out = _both_ways(*got, squared)
            elif got[1].atoms * len(got[0].v) * 8 <= KEPT_BYTES:
                out = _both_ways(*got[::-1], squared)
            else:
                out = [_one_way(*got, squared), _one_way(*got[::-1], squared)]
            for a in out:
                for r in a.rows():
                    yield pa.RecordBatch.from_pylist([r], _ANSWERS)

    return dealt.mapInArrow(run, "block int, slice int, n int, sums binary, least binary, own binary, asked binary")


_ANSWERS = pa.schema([("block", pa.int32()), ("slice", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("sums", "least", "own", "asked")]])


def _finished(answers: DataFrame, split: list[tuple]) -> DataFrame:
    """Silhouettes of the points of a slice, whose answers come from all blocks."""
    trial, size = np.array([t for t, _, _ in split], "i8"), np.array([float(s) for _, _, s in split])

    def run(t: pa.Table) -> pa.Table:
        asked = own = sums = least = None
        for batch in t.to_batches():
            for i in range(batch.num_rows):
                r = {c: batch[c][i] for c in ("n", "sums", "least", "own", "asked")}
                s, x = np.frombuffer(r["sums"].as_buffer(), "f8").reshape(r["n"].as_py(), -1), np.frombuffer(r["least"].as_buffer(), "f8")
                sums, least = (s, x) if sums is None else (sums + s, np.minimum(least, x))
                if r["asked"].is_valid:
                    asked, own = np.frombuffer(r["asked"].as_buffer(), _ASKED), np.frombuffer(r["own"].as_buffer(), "f8")
        a, b = own.copy(), least.copy()
        for k in np.unique(asked["trial"]):
            mine = np.flatnonzero(trial == k)
            if not len(mine):
                continue
            e = np.flatnonzero(asked["trial"] == k)
            total = sums[asked["of"][e]][:, mine]
            at = asked["column"][e]
            has = np.flatnonzero(at >= 0)
            j = np.searchsorted(mine, at[has])
            a[e[has]] = total[has, j]
            mean = total / size[mine]
            mean[has, j] = np.inf
            b[e] = np.minimum(b[e], mean.min(axis=1))
        with np.errstate(all="ignore"):
            a = np.where(asked["size"] > 1, a * asked["times"] / (asked["size"] - 1), np.nan)
            b = b * asked["times"]
            value = (b - a) / np.maximum(a, b)
        value = np.where(np.isnan(a) | np.isinf(b) | (np.maximum(a, b) == 0), 0.0, value)
        return pa.table({"trial": asked["trial"], "pid": asked["pid"], "cluster_id": asked["cluster"], "weight": asked["weight"].astype("i8"), "value": value})

    return answers.groupBy("block", "slice").applyInArrow(run, "trial bigint, pid bigint, cluster_id bigint, weight bigint, value double")

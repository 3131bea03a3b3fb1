"""Near-duplicates by SimHash, with a generalised pigeonhole search.

A fingerprint bit is set when more than half of the XXH64 hashes of a text's word shingles (repeats
included) have it. Fingerprints at most ``RADIUS`` bits apart are linked; classes are the connected
components.

Search, on distinct fingerprints: correlated bits, by a bounded sample, go into the same partition.
Partitions get thresholds t_i >= -1 with sum(t_i + 1) = RADIUS + 1, so that two linked fingerprints
differ in at most t_i bits in some partition i; dynamic programming finds the thresholds with the
least estimated number of candidates and probes, over 2 to 5 partitions. The estimates only decide
the cost, never the result. Every fingerprint is filed under the values within t_i bits of its own.
A file that is too large is divided by the bits that its key leaves out: these are split in
RADIUS + 1 parts, of which linked fingerprints share one; this goes on for ``DEPTH`` rounds. Within
a file, fingerprints are verified by breadth-first search against those not reached yet, so that it
gives a spanning forest of its links and never the pairs of a dense group. What is left large after
the rounds is one ball of nearly equal fingerprints, whose number of distinct ones is bounded by
its radius; it takes 8 bytes each.

Cases: null texts and texts without words have fingerprint zero, which links like any other; equal
texts share a fingerprint; rows that repeat a doc_id keep their own fingerprints; a null doc_id
never names a component that has another id; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import table
from themeloom.runtime import cut

SHINGLE, SEED, RADIUS = 4, 42, 4
SAMPLE, LARGE, DEPTH = 4_000, 4_096, 3
#: Masks of one threshold that are worth an estimate, and a filed row's cost in verified pairs.
MASKS, ROW_COST = 600, 50.0
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    digest = xxhash.xxh64_intdigest
    counts, hashes = np.zeros(64, np.int64), np.array([digest(g, SEED) for g in grams], "<u8")
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([fingerprint(t, n) for t in b["text"].to_pylist()], pa.int64())], ["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size; each grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8), bitorder="little").reshape(-1, 64).astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    like = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    left, groups = list(range(64)), []
    for p in range(parts):
        size = len(left) // (parts - p)
        group = [max(left, key=lambda b: (like[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (like[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def mask_of(bits) -> int:
    return sum(1 << int(b) for b in bits)


def flips(bits: list[int], most: int) -> list[int]:
    """Masks of at most ``most`` of the bits."""
    return [mask_of(c) for r in range(most + 1) for c in combinations(bits, r)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def plan(sample: np.ndarray, total: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions with the least estimated cost."""
    best, least = None, np.inf
    share = total / max(len(sample), 1)
    for parts in range(2, radius + 2):
        groups = grouped_bits(sample, parts)
        cost = np.zeros((parts, radius + 2))  # by threshold + 1
        for i, bits in enumerate(groups):
            value, many = np.unique(sample & np.uint64(mask_of(bits)), return_counts=True)
            pairs = -float(many.sum())  # of a fingerprint with itself
            for r in range(radius + 1):
                if comb(len(bits), r) > MASKS:
                    cost[i, r + 1 :] = np.inf
                    break
                for m in (mask_of(c) for c in combinations(bits, r)):
                    at = np.minimum(np.searchsorted(value, value ^ np.uint64(m)), len(value) - 1)
                    pairs += float((many * np.where(value[at] == value ^ np.uint64(m), many[at], 0)).sum())
                cost[i, r + 1] = pairs * share * share / 2 + ROW_COST * len(flips(bits, r)) * total
        need = radius + 1
        spent = np.full((parts + 1, need + 1), np.inf)
        spent[0, 0], choice = 0, np.zeros((parts + 1, need + 1), int)
        for i in range(parts):
            for have in range(need + 1):
                for t in range(need - have + 1):
                    c = spent[i, have] + cost[i, t]
                    if c < spent[i + 1, have + t]:
                        spent[i + 1, have + t], choice[i + 1, have + t] = c, t
        if spent[parts, need] < least:
            least, have, best = spent[parts, need], need, []
            for i in range(parts, 0, -1):
                t = choice[i, have]
                best.append((groups[i - 1], t - 1))
                have -= t
            best = best[::-1]
    return best


def forest(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints."""
    left, a, b = fp, [], []
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            later = []
            for f in wave:
                near = np.bitwise_count(left ^ f) <= radius
                if near.any():
                    hit = left[near]
                    a.append(np.full(len(hit), f))
                    b.append(hit)
                    later.append(hit)
                    left = left[~near]
                    if not len(left):
                        break
            wave = np.concatenate(later) if later else left[:0]
    none = np.zeros(0, fp.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verified(radius: int):
    """Links of files that arrive in order of (part, key); a file may span batches."""

    def files(part, key, fp):
        new = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)) + 1
        starts = np.r_[0, new]
        return starts, np.diff(np.r_[starts, len(fp)])

    def links(fp, starts, sizes):
        a, b = [], []
        place = np.arange(len(fp)) - np.repeat(starts, sizes)
        room = np.repeat(sizes, sizes) - place
        small = np.repeat(sizes <= 16, sizes)
        for step in range(1, 16):
            i = np.flatnonzero(small & (room > step))
            if not len(i):
                break
            x, y = fp[i], fp[i + step]
            near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
            a.append(x[near])
            b.append(y[near])
        for s, n in zip(starts[sizes > 16], sizes[sizes > 16]):
            x, y = forest(np.unique(fp[s : s + n]), radius)
            a.append(x)
            b.append(y)
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *a]).view(np.int64), np.concatenate([none, *b]).view(np.int64)

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch[c].to_numpy() for c in ("part", "key", "fp")])
            ends = held[-1][0][-1] == held[0][0][0] and held[-1][1][-1] == held[0][1][0]
            if ends:  # all one file so far
                continue
            part, key, fp = (np.concatenate(c) for c in zip(*held))
            starts, sizes = files(part, key, fp)
            last = starts[-1]
            x, y = links(fp[:last].view(np.uint64), starts[:-1], sizes[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], schema=_EDGES)
            held = [[part[last:], key[last:], fp[last:]]]
        if held:
            part, key, fp = (np.concatenate(c) for c in zip(*held))
            if len(fp):
                x, y = links(fp.view(np.uint64), *files(part, key, fp))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], schema=_EDGES)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, large: int = LARGE, depth: int = DEPTH, sample: int = SAMPLE) -> DataFrame:
    """(a, b): links that connect every component of distinct fingerprints (fp)."""
    total = distinct.count()
    some = [r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    parts = plan(np.array(some or [0], np.int64).view(np.uint64), total, radius)
    filed = None
    for i, (bits, most) in enumerate(parts):
        if most < 0:
            continue
        own = F.col("fp").bitwiseAND(F.lit(signed(mask_of(bits))))
        masks = F.array(*[F.lit(signed(m)) for m in flips(bits, most)])
        rows = distinct.select(
            F.lit(i).alias("part"), F.explode(F.transform(masks, lambda m: own.bitwiseXOR(m))).alias("key"), "fp"
        )
        filed = rows if filed is None else filed.unionByName(rows)
    used = {i: mask_of(bits) for i, (bits, _) in enumerate(parts)}
    ready = []
    for round_ in range(depth + 1):
        filed = cut(filed)
        if round_ == depth:
            ready.append(filed)
            break
        crowded = cut(filed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > large).select("part", "key"))
        if crowded.isEmpty():
            ready.append(filed)
            break
        ready.append(filed.join(crowded, ["part", "key"], "left_anti"))
        hot = filed.join(crowded, ["part", "key"], "left_semi")
        filed, then = None, {}
        for part, mask in used.items():
            rest = [b for b in range(64) if not mask >> b & 1]
            for j, bits in enumerate(np.array_split(rest, radius + 1)):
                code = part * (radius + 1) + j + 1000 * 10**round_
                then[code] = mask | mask_of(bits)
                own = F.col("fp").bitwiseAND(F.lit(signed(mask_of(bits))))
                rows = hot.where(F.col("part") == part).select(F.lit(code).alias("part"), F.col("key").bitwiseOR(own).alias("key"), "fp")
                filed = rows if filed is None else filed.unionByName(rows)
        used = then
    every = ready[0]
    for r in ready[1:]:
        every = every.unionByName(r)
    dealt = every.repartition("part", "key").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(_verified(radius), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of the component of every node that has an edge.

    Large-star and small-star steps in turn, until the edges stay the same. Least neighbours are
    combined before the shuffle; the join of a hub's edges with its one row is left to the engine,
    which splits it. Every round is written to the checkpoint folder.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        turned = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = e.unionByName(turned) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("least"))
        joined = both.join(least, "a")
        if large:
            moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
                least.select("a", F.col("least").alias("b"))
            )
        return moved.where("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    for _ in range(rounds):
        now = cut(stars(stars(now, True), False))
        after = state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id, one row a document."""
    fps = cut(fingerprints(docs, n))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), radius))
    rooted = cut(
        distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(rooted.join(least, "root").select(F.col("fp").alias("own"), "component_id"))
    return fps.join(named, fps.fp == named.own).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_duplicates(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the least doc_id, with all its columns.

    Of rows that repeat a doc_id, the one whose text is first in order stays. Rows without an id
    cannot be named as copies or as what stays, and are never removed.
    """
    return one_each(docs, near_duplicates(docs, n, radius))


def one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents whose doc_id names their component in found (doc_id, component_id)."""
    stay = cut(
        found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("rows"))
    ).select(F.col("doc_id").alias("stay_id"), "rows")
    row = docs.select(F.struct(*docs.columns).alias("row"))
    stay = stay.hint("merge")  # what stays grows with the input: one plan at every size
    kept = row.join(stay, F.col("row.doc_id") == F.col("stay_id")).select("row", "rows")
    nameless = row.where("row.doc_id IS NULL").select("row.*")
    if stay.where("rows > 1").isEmpty():
        return kept.select("row.*").unionByName(nameless)
    first = Window.partitionBy("row.doc_id").orderBy("row.text")
    one = kept.withColumn("place", F.row_number().over(first)).where("place = 1")
    return one.select("row.*").unionByName(nameless)


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))

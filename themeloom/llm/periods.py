"""Periodic runs of words by a dictionary of basic factors.

Every text's words get numbers; for each power of two the stretches (basic factors) of that many
words are numbered from the pairs of factors of half the length, and only factors that occur again
in the same text are kept. Per power of two 2m, the factors of m words at places divisible by m
look up where they occur again at a distance of 2m to 4m words. Such occurrences form a few
arithmetic progressions; those that overlap by half the factor or more share its own short period,
which a smaller power proposes, and are passed over, the others propose their distance as a
period. Neighbouring factors that propose the same period are one proposal. Each proposal is
extended to both sides by comparing factors of falling length. Stretches found with several
periods keep the smallest one. A run of period q has two periods, so an unbroken factor of m <= q/2
words at a place divisible by m lies in its first part and occurs again q words later: none is
missed. Whole texts are compared, several short ones at once; a factor never spans two of them.

Memory and time grow as n log n with the words of the texts at hand, at least one text and about
``WORDS`` words.

Cases: null texts and texts without words have no runs; a null doc_id is kept; repeated rows are
documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import table

#: Words of short texts that are taken together, and the least length of a run.
WORDS, LEAST = 100_000, 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def basic_factors(ids: np.ndarray) -> list[np.ndarray]:
    """Item k: the number of the factor of 2**k words at each place, -1 where it occurs once."""
    n, names = len(ids), []
    at = np.arange(n)
    key, size = ids.astype(np.int64), 1
    while len(at):
        _, back, many = np.unique(key, return_inverse=True, return_counts=True)
        again = many[back] > 1
        at, back = at[again], back[again]
        if not len(at):
            break
        level = np.full(n, -1, np.int64)
        level[at] = back
        names.append(level)
        at = at[at < n - size]
        at = at[level[at + size] >= 0]
        key = level[at] * n + level[at + size]
        at, key, size = at[at <= n - 2 * size], key[at <= n - 2 * size], 2 * size
    return names


def _extended(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and from a and b on are the same, for a < b."""
    n = len(names[0])
    back, on = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        x, y = a + on, np.minimum(b + on, n - 1)
        same = (names[k][x] >= 0) & (names[k][x] == names[k][y]) & (b + on < n)
        on += same << k
        x, y = a - back - (1 << k), b - back - (1 << k)
        same = (x >= 0) & (names[k][x] >= 0) & (names[k][x] == names[k][y])
        back += same << k
    return back, on


def _proposed(level: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that the factors of m words propose."""
    n = len(level)
    low, high = (2 * m, 4 * m) if m > 1 else (1, 4)
    live = np.flatnonzero(level >= 0)
    order = np.sort(level[live] * (n + 1) + live)  # by factor, then place
    tight = np.diff(order) <= m // 2  # same factor, overlapping by half: one progression
    chain = np.r_[0, np.cumsum(~tight)] if len(order) else order
    own = live[live % m == 0]
    key = level[own] * (n + 1) + own
    first, last = np.searchsorted(order, key + low), np.searchsorted(order, key + high)
    # a place of another factor is not within the bounds of this one
    ends = (level[own] + 1) * (n + 1)
    last = np.minimum(last, np.searchsorted(order, ends))
    many = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(own)), many)
    hit = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
    period = order[hit] - key[row]
    fresh = (chain[hit] != chain[np.searchsorted(order, key)][row]) | (period <= m // 2)
    at, period = own[row[fresh]], period[fresh]
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    joined = np.r_[False, (np.diff(period) == 0) & (np.diff(at) == m)] if len(at) else np.zeros(0, bool)
    return at[~joined], period[~joined]


def runs(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run, by start, then period."""
    names, found = basic_factors(ids), [np.zeros((0, 3), np.int64)]
    for k, level in enumerate(names):
        at, period = _proposed(level, 1 << k)
        if not len(at):
            continue
        back, on = _extended(names, at, at + period)
        length = back + on + period
        good = length >= np.maximum(least, 2 * period)
        found.append(np.column_stack([at - back, length, period])[good])
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[new]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _texts(texts: list[list[bytes]], least: int) -> tuple[list[np.ndarray], list[str]]:
    """Runs and collapsed text of each list of words."""
    numbers, base = [], 0
    for words in texts:
        own = {w: i for i, w in enumerate(dict.fromkeys(words), base)}  # numbers of this text alone
        numbers.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
        base += len(own)
    ends = np.cumsum([0, *map(len, texts)])
    all_ = runs(np.concatenate([*numbers, np.zeros(0, np.int64)]), least)
    cover = np.zeros(ends[-1] + 1, np.int64)
    np.add.at(cover, all_[:, 0] + all_[:, 2], 1)
    np.add.at(cover, all_[:, 0] + all_[:, 1], -1)
    stay = np.cumsum(cover)[:-1] == 0
    split = np.searchsorted(all_[:, 0], ends)
    out, left = [], []
    for i, words in enumerate(texts):
        mine = all_[split[i] : split[i + 1]] - (ends[i], 0, 0)
        if len(mine):
            words = [words[j] for j in np.flatnonzero(stay[ends[i] : ends[i + 1]])]
        out.append(mine)
        left.append(b" ".join(words).decode())
    return out, left


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed: the text's words
    without those that a run holds after its first period, joined by blanks."""

    def run(batches):
        for b in batches:
            doc_ids, texts = b["doc_id"], b["text"].to_pylist()
            at = 0
            while at < len(texts):
                group, held, begin = [], 0, at
                while at < len(texts) and (held < WORDS or at == begin):
                    group.append((texts[at] or "").encode().split())  # bytes: ASCII white space only
                    held, at = held + len(group[-1]), at + 1
                found, left = _texts(group, least)
                rows = np.concatenate(found)
                columns = [pa.array(rows[:, i]) for i in range(3)]
                values = pa.StructArray.from_arrays(columns, fields=list(_RUN))
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(begin, at - begin), pa.ListArray.from_arrays(offsets, values), pa.array(left)],
                    ["doc_id", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents, by CRC-32 of the id, a stretch of words repeats to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def turned(s):
        n = F.size(s["words"])
        at = F.pmod(s["g"], n.cast("long")).cast("int")
        period = F.lit(1) + F.floor((n - at) / (F.lit(3) + F.pmod(s["g"], F.lit(8)))).cast("int")
        # the array holds what the inner function uses, so that it is computed once a text
        cut = F.transform(F.array(F.struct(s["words"].alias("w"), at.alias("a"), period.alias("p"))), _laid_out)
        return F.when(n > 0, F.get(cut, F.lit(0))).otherwise(F.lit(""))

    changed = F.get(F.transform(F.array(F.struct(words.alias("words"), g.alias("g"))), turned), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def _laid_out(s):
    place = F.sequence(F.lit(0), F.size(s["w"]) - 1)
    return F.array_join(F.transform(place, lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]))), " ")


def report(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of what ``periodic_runs`` gives."""
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    top = found.select("*", longest.alias("top")).select(
        "*", F.col("top.n").alias("length"), (-F.col("top.s")).alias("start"), (-F.col("top.p")).alias("period")
    )
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        F.floor(F.lit(1000) * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def query(spark, sf_dir):
    return report(periodic_runs(with_repeats(table(spark, sf_dir, "documents"))))

"""Harmonic packing of token sequences.

A piece of length n belongs to the class k = capacity // n of lengths in (capacity / (k + 1),
capacity / k], and a sequence of class k holds exactly k pieces. Where k pieces of that length
would leave more than ``WASTE`` of a sequence empty, the document is cut instead: a piece of length
capacity // (k + 1), which fills its class, is taken off and the rest is treated in the same way.
Workers fill the classes independently. Pieces of sequences that a worker could not fill are dealt
again by class, and what is left then, less than one sequence of every class and so bounded by the
capacity alone, is laid end to end and cut where a sequence is full.

Cases: a null text is empty and yields its end id alone; a null doc_id is kept; repeated rows are
documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import table
from themeloom.llm.tokens import TEXTS, encoded, encoder
from themeloom.runtime import cut

CAPACITY, END, WASTE = 2048, 1, 0.03
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, k int, ids binary"
_SCHEMA = pa.schema([
    *[(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
    ("k", pa.int32()), ("ids", pa.binary()),
])


def lengths(n: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        size = n if k * n >= (1 - waste) * capacity else capacity // (k + 1)
        out.append(size)
        n -= size
    return out


class Filler:
    """Open sequences of one worker, one a class."""

    def __init__(self, worker: int, capacity: int):
        self.worker, self.capacity = worker, capacity
        self.open: dict[int, list] = {}
        self.made, self.rows = 0, []

    def add(self, doc_id, start: int, length: int, doc_tokens: int, ids: bytes) -> None:
        k = self.capacity // length
        pieces = self.open.setdefault(k, [])
        pieces.append((doc_id, start, length, doc_tokens, ids))
        if len(pieces) == k:
            self.close(self.open.pop(k))

    def close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, length, doc_tokens, ids in pieces:
            self.rows.append((doc_id, start, length, zlib.crc32(ids), doc_tokens, (self.worker << 32) + self.made, at, None, None))
            at += length
        self.made += 1

    def take(self):
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)] if rows else [pa.array([], t) for t in _SCHEMA.types],
            schema=_SCHEMA,
        )

    def rest(self) -> None:
        """Give out the pieces of sequences that are not full, with their ids."""
        for k, pieces in self.open.items():
            for doc_id, start, length, doc_tokens, ids in pieces:
                self.rows.append((doc_id, start, length, None, doc_tokens, None, None, k, ids))
        self.open = {}


def _cut_up(path: str, capacity: int, end: int):
    def run(batches):
        filler = Filler(TaskContext.get().partitionId(), capacity)
        by = encoder(path, spaced=False)
        for big in batches:
            for at in range(0, big.num_rows, TEXTS):
                batch = big.slice(at, TEXTS)
                docs = batch["doc_id"].to_pylist()
                for doc_id, ids in zip(docs, encoded(batch["text"].to_pylist(), by, end)):
                    begin = 0
                    for n in lengths(len(ids), capacity):
                        filler.add(doc_id, begin, n, len(ids), ids[begin : begin + n].tobytes())
                        begin += n
                yield filler.take()
        filler.rest()
        yield filler.take()

    return run


def _again(stage: int, capacity: int):
    """Fill the classes with pieces that earlier workers left over."""

    def run(batches):
        filler = Filler((stage << 24) + TaskContext.get().partitionId(), capacity)
        for batch in batches:
            for r in batch.to_pylist():
                filler.add(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids"])
            yield filler.take()
        filler.rest()
        yield filler.take()

    return run


def _end_to_end(stage: int, capacity: int):
    def run(batches):
        filler, room, pieces = Filler(stage << 24, capacity), capacity, []
        for batch in batches:
            for r in batch.to_pylist():
                start, ids = r["start"], r["ids"]
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    n = len(part) // 4
                    pieces.append((r["doc_id"], start, n, r["doc_tokens"], part))
                    start, room = start + n, room - n
                    if not room:
                        filler.close(pieces)
                        room, pieces = capacity, []
        if pieces:
            filler.close(pieces)
        yield filler.take()

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, one row a piece."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = cut(need.mapInArrow(_cut_up(path, capacity, end), PIECE))
    left = first.where("k IS NOT NULL").repartition("k").sortWithinPartitions("k", "doc_id", "start")
    second = cut(left.mapInArrow(_again(1, capacity), PIECE))
    last = second.where("k IS NOT NULL").repartition(1).sortWithinPartitions("k", "doc_id", "start")
    third = last.mapInArrow(_end_to_end(2, capacity), PIECE)
    done = [x.where("k IS NULL").drop("k", "ids") for x in (first, second, third)]
    return done[0].unionByName(done[1]).unionByName(done[2])


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))

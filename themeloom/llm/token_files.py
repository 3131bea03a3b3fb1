"""Token files: ids in blocks, packed by an adaptive context-mixing range coder.

File: magic, then blocks, then the document table, then the footer. A block holds up to ``BLOCK``
ids of the concatenated documents and is coded on its own: model and coder start anew, and its
header has the number of ids, of literals and of code words and the CRC-32 of ids and payload, so
any block can be read, checked or skipped alone. The document table (doc_id, ids) has a CRC, too.

Model of a block: order 2 and order 1 each predict the id last seen after the last two ids and the
last one (hashed tables with a confidence of 0 to 3); order 0 predicts from the histogram of the
ids so far, renewed at steps of growing length. The code range is shared among them by mixing
weights that follow how often each was right at its present confidence; equal predictions add
their shares. An id that nothing predicts is coded as an escape and kept as a literal. The range
coder has 64 bits of state and gives out 32-bit words.

Up to ``LANES`` blocks are coded side by side, one position of each at a time, so that the
arithmetic is NumPy's; the last block is padded to the length of the others with id 0 and cut again
after reading. Rows are range-sorted by doc_id, with boundaries of near-equal bytes. A task starts
another file after ``FILE_IDS`` ids, at the end of a document. Files get temporary names; the driver
renames the finished ones and writes the manifest, which has the number of ids before each file.

Cases: a null text is empty and has the end id alone; a null doc_id comes first; rows that repeat
a doc_id are ordered by text; an empty table gives a manifest without files; other columns
are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import hadoop_path, interval, publish, shared_folder, table, write_small
from themeloom.llm.tokens import encoded, encoder
from themeloom.runtime import cut

BLOCK, LANES, FILE_IDS = 1024, 2048, 1 << 26
MAGIC, END = b"TLIDS001", 0
ORDER2, ORDER1 = 256, 256
UNIT = 1024  # the code range is shared in units of 1 / UNIT
_HEAD = struct.Struct("<IIIIIII")  # ids, coded ids, bytes of an id, literals, words, CRC of ids, CRC of payload
_FOOT = struct.Struct("<QQII")  # place and bytes of the document table, its CRC, documents
_STEPS = [0, 16, 32, 64, 128, 256, 512, 768]
U = np.uint64
_LOW = U(0xFFFFFFFF)
_FILES = "name string, temp string, ids long, docs long, bytes long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class _Model:
    """Predictions and weights of many blocks at the same position."""

    def __init__(self, lanes: int):
        self.two = np.zeros(lanes * ORDER2, np.uint32)
        self.one = np.zeros(lanes * ORDER1, np.uint32)
        self.base2 = np.arange(lanes, dtype=np.int64) * ORDER2
        self.base1 = np.arange(lanes, dtype=np.int64) * ORDER1
        self.base4 = np.arange(lanes, dtype=np.int64) * 4
        self.right2 = np.full(lanes * 4, 1 << 14, np.int32)  # chance in 2^-16 at a confidence
        self.right1 = np.full(lanes * 4, 1 << 14, np.int32)
        self.novel = np.full(lanes, 1 << 15, np.int32)
        self.a = np.zeros(lanes, np.int64)
        self.b = np.zeros(lanes, np.int64)

    def predict(self):
        """The widths of the shares of order 2, order 1, order 0 and the escape."""
        self.at2 = self.base2 + (((self.a * 40503 + self.b * 30011) >> 3) & (ORDER2 - 1))
        self.at1 = self.base1 + ((self.b * 40503 >> 2) & (ORDER1 - 1))
        e2, e1 = self.two.take(self.at2, mode="clip"), self.one.take(self.at1, mode="clip")
        self.c2, self.c1 = e2 >> 2, e1 >> 2
        self.f2, self.f1 = e2 & 3, e1 & 3
        self.r2, self.r1 = self.base4 + self.f2, self.base4 + self.f1
        self.p2, self.p1 = self.right2.take(self.r2, mode="clip"), self.right1.take(self.r1, mode="clip")
        w2 = 1 + (self.p2 * 960 >> 16)
        rest = UNIT - w2
        w1 = 1 + ((rest - 62) * (self.p1 >> 2) >> 14)
        rest = rest - w1
        out = 1 + ((rest - 2) * (self.novel >> 2) >> 14)
        self.same = self.c2 == self.c1
        w2 = np.where(self.same, w2 + w1, w2)
        w1 = np.where(self.same, 0, w1)
        return w2, w1, rest - out, out

    def learn(self, x, hit2, hit1, escaped):
        miss2 = ~hit2
        self.two[self.at2] = (x << 2) | np.where(hit2, np.minimum(self.f2 + 1, 3), 0).astype(np.uint32)
        was1 = x == self.c1
        self.one[self.at1] = (x << 2) | np.where(was1, np.minimum(self.f1 + 1, 3), 0).astype(np.uint32)
        self.right2[self.r2] = self.p2 + (((hit2.astype(np.int32) << 16) - hit2 - self.p2) >> 5)
        free = miss2 & ~self.same
        self.right1[self.r1] = self.p1 + np.where(free, ((hit1.astype(np.int32) << 16) - hit1 - self.p1) >> 5, 0)
        deep = miss2 & ~hit1
        self.novel += np.where(deep, ((escaped.astype(np.int32) << 16) - escaped - self.novel) >> 5, 0)
        self.a, self.b = self.b, x.astype(np.int64)


def _marks(steps: int):
    """Spans of positions with one histogram."""
    at = [s for s in _STEPS if s < steps] + [steps]
    return zip(at, at[1:])


def _runs(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the run of equal values around each place of sorted rows."""
    steps = ranked.shape[1]
    spots = np.arange(steps, dtype=np.int16)
    fresh = np.ones(ranked.shape, bool)
    np.not_equal(ranked[:, 1:], ranked[:, :-1], out=fresh[:, 1:])
    first = np.maximum.accumulate(np.where(fresh, spots, np.int16(0)), axis=1)
    ends = np.ones(ranked.shape, bool)
    ends[:, :-1] = fresh[:, 1:]
    last = np.minimum.accumulate(np.where(ends, spots, np.int16(steps))[:, ::-1], axis=1)[:, ::-1]
    return first, last


def encode_blocks(ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Code words of every row of ``ids`` (blocks x positions), and where the escapes are."""
    lanes, steps = ids.shape
    m = _Model(lanes)
    low, rng = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    words, pos = np.zeros((lanes, steps + 4), np.int64), np.zeros(lanes, np.int64)
    escapes = np.zeros((lanes, steps), bool)
    order = np.argsort(ids, axis=1, kind="stable").astype(np.int16)
    first, last = _runs(np.take_along_axis(ids, order, 1))
    first_of, last_of = np.empty_like(first), np.empty_like(first)
    np.put_along_axis(first_of, order, first, 1)
    np.put_along_axis(last_of, order, last, 1)
    for since, until in _marks(steps):
        seen = np.zeros((lanes, steps + 1), np.int16)
        np.cumsum(order < since, axis=1, out=seen[:, 1:])
        below = np.take_along_axis(seen, first_of[:, since:until], 1).T.astype(np.int32)
        many = np.take_along_axis(seen, last_of[:, since:until] + 1, 1).T - below
        now, size = np.ascontiguousarray(ids[:, since:until].T).astype(np.uint32), max(since, 1)
        for t in range(until - since):
            x = now[t]
            w2, w1, w0, out = m.predict()
            hit2 = x == m.c2
            hit1 = (x == m.c1) & ~hit2
            found = many[t] > 0
            w21 = w2 + w1
            cum = np.where(found, w21 * size + w0 * below[t], (UNIT - out) * size)
            freq = np.where(found, w0 * many[t], out * size)
            cum = np.where(hit2, 0, np.where(hit1, w2 * size, cum))
            freq = np.where(hit2, w2 * size, np.where(hit1, w1 * size, freq))
            r = rng // U(UNIT * size)
            add = r * cum.astype(U)
            low += add
            carry = np.flatnonzero(low < add)
            if len(carry):
                words[carry, pos[carry] - 1] += 1
            rng = r * freq.astype(U)
            small = np.flatnonzero(rng <= _LOW)
            if len(small):
                part = low[small]
                words[small, pos[small]] = (part >> U(32)).astype(np.int64)
                pos[small] += 1
                low[small] = part << U(32)
                rng[small] <<= U(32)
            escaped = ~(hit2 | hit1 | found)
            escapes[:, since + t] = escaped
            m.learn(x, hit2, hit1, escaped)
    lane = np.arange(lanes)
    words[lane, pos] = (low >> U(32)).astype(np.int64)
    words[lane, pos + 1] = (low & _LOW).astype(np.int64)
    for i in range(words.shape[1] - 1, 0, -1):  # carries that were put off
        words[:, i - 1] += words[:, i] >> 32
    words &= 0xFFFFFFFF
    return [words[j, : pos[j] + 2].astype("<u4") for j in range(lanes)], escapes


def decode_blocks(words: list[np.ndarray], literals: list[np.ndarray], steps: int, dtype) -> np.ndarray:
    """The ids of blocks of ``steps`` positions."""
    lanes = len(words)
    stream = np.zeros((lanes, max(map(len, words)) + 1), np.uint32)
    spare = np.zeros((lanes, max(map(len, literals), default=0) + 1), np.uint32)
    for j in range(lanes):
        stream[j, : len(words[j])] = words[j]
        spare[j, : len(literals[j])] = literals[j]
    last_word = stream.shape[1] - 1
    m = _Model(lanes)
    rng = np.full(lanes, (1 << 64) - 1, U)
    code = (stream[:, 0].astype(U) << U(32)) | stream[:, 1]
    pos, used = np.full(lanes, 2, np.int64), np.zeros(lanes, np.int64)
    ids = np.zeros((steps, lanes), dtype)
    lane = np.arange(lanes)
    spare_row = lane * spare.shape[1]
    for since, until in _marks(steps):
        size = max(since, 1)
        ranked = np.sort(ids[:size].T, axis=1)
        first, last = _runs(ranked)
        ranked, first, last = ranked.ravel(), first.ravel(), last.ravel()
        row = lane * size
        for t in range(since, until):
            w2, w1, w0, out = m.predict()
            w21 = w2 + w1
            r = rng // U(UNIT * size)
            v = np.minimum(code // r, U(UNIT * size - 1)).astype(np.int32)
            hit2 = v < w2 * size
            hit1 = (v < w21 * size) & ~hit2
            escaped = v >= (UNIT - out) * size
            slot = ((v - w21 * size) / w0).astype(np.int64)  # exact: all below 2^24
            slot = row + np.minimum(np.maximum(slot, 0), size - 1)
            begin = first.take(slot, mode="clip").astype(np.int32)
            many = last.take(slot, mode="clip") + 1 - begin
            x = np.where(escaped, spare.take(spare_row + used, mode="clip"), ranked.take(slot, mode="clip"))
            used += escaped
            x = np.where(hit2, m.c2, np.where(hit1, m.c1, x)).astype(np.uint32)
            cum = np.where(escaped, (UNIT - out) * size, w21 * size + w0 * begin)
            freq = np.where(escaped, out * size, w0 * many)
            cum = np.where(hit2, 0, np.where(hit1, w2 * size, cum))
            freq = np.where(hit2, w2 * size, np.where(hit1, w1 * size, freq))
            code -= r * cum.astype(U)
            rng = r * freq.astype(U)
            small = np.flatnonzero(rng <= _LOW)
            if len(small):
                at = pos[small]
                code[small] = (code[small] << U(32)) | stream[small, np.minimum(at, last_word)]
                pos[small] = at + 1
                rng[small] <<= U(32)
            ids[t] = x
            m.learn(x, hit2, hit1, escaped)
    return ids.T


def seal(ids: np.ndarray) -> list[bytes]:
    """Finished blocks of a run of ids."""
    steps = min(BLOCK, len(ids))
    lanes = -(-len(ids) // max(steps, 1))
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    padded = np.zeros(lanes * steps, f"<u{width}")
    padded[: len(ids)] = ids
    padded = padded.reshape(lanes, steps)
    words, escapes = encode_blocks(padded) if lanes else ([], [])
    out = []
    for j in range(lanes):
        n = min(steps, len(ids) - j * steps)
        spare = padded[j][escapes[j]]
        payload = spare.tobytes() + words[j].tobytes()
        out.append(_HEAD.pack(n, steps, width, len(spare), len(words[j]), zlib.crc32(padded[j, :n].tobytes()), zlib.crc32(payload)) + payload)
    return out


def unseal(blocks: list[tuple[tuple, bytes]]) -> np.ndarray:
    """The ids of blocks (header fields, payload); damage is an error."""
    parts: list = [None] * len(blocks)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, ((_, steps, width, *_), _) in enumerate(blocks):
        kinds.setdefault((steps, width), []).append(i)
    for (steps, width), own in kinds.items():
        words, spare = [], []
        for i in own:
            (_, _, _, literals, _, _, check), payload = blocks[i]
            if zlib.crc32(payload) != check:
                raise ValueError("a block differs from its checksum")
            spare.append(np.frombuffer(payload, f"<u{width}", literals))
            words.append(np.frombuffer(payload, "<u4", offset=literals * width))
        ids = decode_blocks(words, spare, steps, f"<u{width}")
        for i, row in zip(own, ids):
            parts[i] = row[: blocks[i][0][0]]
            if zlib.crc32(np.ascontiguousarray(parts[i]).tobytes()) != blocks[i][0][5]:
                raise ValueError("decoded ids differ from their checksum")
    return np.concatenate([np.zeros(0, "<u4"), *parts]).astype("<u4")


class _File:
    """A token file being written under a temporary name."""

    def __init__(self, folder: str):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(f"{self.path}/_temporary")
        self.out = None

    def open(self, name: str) -> None:
        self.name, self.temp = name, f"_temporary/{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.path}/{self.temp}", compression=None)
        self.out.write(MAGIC)
        self.bytes, self.ids, self.docs, self.sizes, self.held, self.waiting = len(MAGIC), 0, [], [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        while self.waiting >= BLOCK * LANES:
            every = np.concatenate(self.held)
            self._put(every[: BLOCK * LANES])
            self.held = [every[BLOCK * LANES :]]
            self.waiting = len(self.held[0])

    def _put(self, ids: np.ndarray) -> None:
        for block in seal(ids):
            self.out.write(block)
            self.bytes += len(block)

    def close(self) -> dict:
        if self.waiting:
            self._put(np.concatenate(self.held))
        null = np.array([d is None for d in self.docs])
        body = zlib.compress(
            null.tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes()
        )
        self.out.write(body + _FOOT.pack(self.bytes, len(body), zlib.crc32(body), len(self.docs)))
        self.out.close()
        self.out = None
        return {"name": self.name, "temp": self.temp, "ids": self.ids, "docs": len(self.docs), "bytes": self.bytes + len(body) + _FOOT.size}


def _writer(folder: str, path: str, end: int, file_ids: int):
    schema = pa.schema([("name", pa.string()), ("temp", pa.string()), ("ids", pa.int64()), ("docs", pa.int64()), ("bytes", pa.int64())])

    def write(batches):
        file, by, now, part, done = _File(folder), encoder(path, spaced=True), None, 0, []
        for batch in batches:
            cols = batch["range"].to_pylist(), batch["doc_id"].to_pylist(), encoded(batch["text"].to_pylist(), by, end)
            for range_, doc_id, ids in zip(*cols):
                if file.out and (range_ != now or file.ids >= file_ids):
                    part = part + 1 if range_ == now else 0
                    done.append(file.close())
                elif range_ != now:
                    part = 0
                now = range_
                if not file.out:
                    file.open(f"ids-{range_:06d}-{part:05d}.bin")
                file.add(doc_id, ids)
        if file.out:
            done.append(file.close())
        yield pa.RecordBatch.from_pylist(done, schema)

    return write


def boundaries(docs: DataFrame, ranges: int) -> list[int]:
    """Ascending doc_ids that begin a range; bytes are near equal, by a hash sample of about 64
    rows a range with their sizes."""
    narrow = cut(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("size")))
    total = narrow.count()
    every = max(1, total // (ranges * 64))
    some = narrow.where("doc_id IS NOT NULL").where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    some = some.groupBy("doc_id").agg(F.sum("size").alias("size"))
    end = F.sum("size").over(Window.orderBy("doc_id"))
    part = F.floor((end - F.col("size")) * ranges / F.sum("size").over(Window.partitionBy()))
    got = some.select("doc_id", part.alias("part")).groupBy("part").agg(F.min("doc_id").alias("at")).orderBy("at").collect()
    return [r["at"] for r in got][1:]


def write_tokens(
    docs: DataFrame, folder: str, path: str | None = None, end: int = END, file_ids: int = FILE_IDS, ranges: int | None = None
) -> list[dict]:
    """Write the ids of all documents below a shared folder; the manifest's entries, in order."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = boundaries(need, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = (
        need.withColumn("range", F.coalesce(interval(bounds, F.col("doc_id")), F.lit(0)))
        .repartitionById(len(bounds) + 1, F.col("range"))
        .sortWithinPartitions("range", "doc_id", "text")
    )
    done = sorted((r.asDict() for r in dealt.mapInArrow(_writer(folder, path, end, file_ids), _FILES).collect()), key=lambda r: r["name"])
    publish(spark, [(f"{folder}/{r['temp']}", f"{folder}/{r['name']}") for r in done])
    before = 0
    for r in done:
        del r["temp"]
        r["before"] = before
        before += r["ids"]
    write_small(spark, f"{folder}/manifest.json", json.dumps({"files": done}))
    fs, temporary = hadoop_path(spark, f"{folder}/_temporary")
    fs.delete(temporary, True)
    return done


def read_file(fs, path: str):
    """The document table (doc_ids, sizes) and the ids, group by group, of one file."""
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - _FOOT.size)
        place, length, check, n = _FOOT.unpack(f.read(_FOOT.size))
        f.seek(place)
        body = f.read(length)
        if zlib.crc32(body) != check:
            raise ValueError(f"{path}: the document table differs from its checksum")
        body = zlib.decompress(body)
        null, numbers = np.frombuffer(body, bool, n), np.frombuffer(body, "<i8", 2 * n, n)
        yield [None if x else int(d) for x, d in zip(null, numbers[:n])], numbers[n:]
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path}: not a token file")
        while f.tell() < place:
            group = []
            while f.tell() < place and len(group) < LANES:
                head = _HEAD.unpack(f.read(_HEAD.size))
                group.append((head, f.read(head[3] * head[2] + head[4] * 4)))
            yield unseal(group)


def read_tokens(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files of a manifest."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def read(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch["name"].to_pylist(), batch["before"].to_pylist()):
                parts = read_file(fs, f"{path}/{name}")
                docs, sizes = next(parts)
                ends = np.cumsum(sizes)
                checks, doc, at = [0] * len(docs), 0, 0
                for ids in parts:
                    lo = 0
                    while lo < len(ids):
                        hi = min(len(ids), int(ends[doc]) - at)
                        checks[doc] = zlib.crc32(ids[lo:hi].tobytes(), checks[doc])
                        lo = hi
                        if at + hi == ends[doc]:
                            doc += 1
                    at += len(ids)
                if doc != len(docs) or (len(docs) and at != ends[-1]):
                    raise ValueError(f"{name}: ids and document table differ")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(before + ends - sizes), pa.array(sizes), pa.array(checks, pa.int64())], schema=schema
                )

    names = spark.createDataFrame([(f["name"], f["before"]) for f in files], "name string, before long")
    return names.repartition(max(1, len(files))).mapInArrow(read, _DOCS)


def query(spark, sf_dir):
    folder = shared_folder(spark, f"tokens-{uuid.uuid4().hex}")
    files = write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder, files)

"""Deterministic, sharded WARC files.

Of pages with equal payloads (SHA-1) the one with the smallest page_id is a response record, the
others are revisit records that refer to it. Records are range-sorted by page_id: boundaries come
from a hash sample of the ids, so they depend on the rows alone. A task writes the records of its
ranges in order, a gzip member each, and starts another file when the range ends or the compressed
size passes ``roll``. HTTP and WARC headers, digests and record ids are made anew from the page.
Files are written under temporary names unique to the attempt; the driver renames the finished
ones and writes the manifest last, so a lost executor or a repeated task leaves nothing behind
that a reader sees.

Cases: a null html is an empty payload; a null url becomes ``urn:page:<id>``; rows that repeat a
page_id and its payload are all responses; a null page_id sorts first and is never referred to
unless all copies lack an id; an empty table gives a manifest without files; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import hadoop_path, interval, publish, shared_folder, table, write_small
from themeloom.runtime import cut

ROLL, RANGE_BYTES = 64 << 20, 256 << 20
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_FILES = "name string, temp string, records long, bytes long, first long, last long"
_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def base32(sha1_hex: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: 40 bits at a time through base 32 digits."""
    parts = [
        F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, digest and refers_to of the revisits: only they differ from a plain response."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = cut(
        pages.select("page_id", F.octet_length(payload).cast("long").alias("size"), base32(F.sha1(payload)).alias("digest"))
    )
    first = narrow.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    copies = narrow.join(first, "digest").where(F.col("page_id") > F.col("refers_to"))
    return narrow, copies.select("page_id", "digest", "refers_to").distinct()


def boundaries(narrow: DataFrame, ranges: int) -> list[int]:
    """Ascending page_ids that begin a range, from a hash sample of about 64 a range."""
    total = narrow.count()
    every = max(1, total // (ranges * 64))
    ids = narrow.select("page_id").where("page_id IS NOT NULL").where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)
    tiles = ids.distinct().withColumn("tile", F.ntile(ranges).over(Window.orderBy("page_id")))
    got = tiles.groupBy("tile").agg(F.min("page_id").alias("at")).orderBy("at").collect()
    return [r["at"] for r in got][1:]


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def _sha(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    data = head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join((url or f"urn:page:{page_id}").split())
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", _sha(block)),
        ("Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("Refers-To-Page-ID", str(refers_to)),
        ]
    return _record(headers, block)


class _Roller:
    """The file being written, under a temporary name."""

    def __init__(self, folder: str):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(f"{self.path}/_temporary")
        self.out = None

    def open(self, name: str) -> None:
        self.name, self.temp = name, f"_temporary/{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.path}/{self.temp}", compression=None)
        self.records = self.bytes = 0
        self.first = self.last = None
        self.add(None, _record([
            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "")), ("WARC-Date", DATE),
            ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
        ], b"format: WARC File Format 1.1\r\n"))

    def add(self, page_id, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)
        if page_id is not None:
            self.first = page_id if self.first is None else self.first
            self.last = page_id
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        self.out = None
        return {"name": self.name, "temp": self.temp, "records": self.records, "bytes": self.bytes, "first": self.first, "last": self.last}


def _writer(folder: str, roll: int):
    schema = pa.schema([("name", pa.string()), ("temp", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def write(batches):
        roller, now, part, known = _Roller(folder), None, 0, {}
        done = []
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("range", "page_id", "is_page", "digest", "refers_to", "url", "html")]
            for range_, page_id, is_page, digest, refers_to, url, html in zip(*cols):
                if not is_page:  # comes just before its page
                    known = {k: v for k, v in known.items() if k[0] == page_id}
                    known[page_id, digest] = refers_to
                    continue
                if roller.out and (range_ != now or roller.bytes >= roll):
                    part = part + 1 if range_ == now else 0
                    done.append(roller.close())
                elif range_ != now:
                    part = 0
                now = range_
                if not roller.out:
                    roller.open(f"pages-{range_:06d}-{part:05d}.warc.gz")
                payload = (html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                roller.add(page_id, _page_record(page_id, url, payload, digest, known.get((page_id, digest))))
        if roller.out:
            done.append(roller.close())
        yield pa.RecordBatch.from_pylist(done, schema)

    return write


def write_archive(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL, ranges: int | None = None) -> list[dict]:
    """Write the archive below a shared folder; the manifest's entries, in order."""
    spark = pages.sparkSession
    narrow, copies = records(pages, least)
    copies = cut(copies)
    if ranges is None:
        held = narrow.agg(F.sum("size").alias("b")).first().b or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES))
    bounds = boundaries(narrow, ranges)
    rows = (
        pages.select("page_id", F.lit(True).alias("is_page"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
        .unionByName(
            copies.select("page_id", F.lit(False).alias("is_page"), "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
        )
        .withColumn("range", F.coalesce(interval(bounds, F.col("page_id")), F.lit(0)))
    )
    dealt = rows.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions(
        "range", "page_id", "is_page", F.sha1(F.coalesce(F.col("html"), F.lit("")))
    )
    done = sorted((r.asDict() for r in dealt.mapInArrow(_writer(folder, roll), _FILES).collect()), key=lambda r: r["name"])
    publish(spark, [(f"{folder}/{r['temp']}", f"{folder}/{r['name']}") for r in done])
    for r in done:
        del r["temp"]
    write_small(spark, f"{folder}/manifest.json", json.dumps({"files": done}))
    fs, path = hadoop_path(spark, f"{folder}/_temporary")
    fs.delete(path, True)
    return done


def members(stream, chunk: int = 1 << 20):
    """The uncompressed gzip members of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(z.decompress(data))
            if not z.eof:
                break
            data = z.unused_data
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last record is cut off")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def read_archive(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """The pages of the files of a manifest; digests are checked against the payload."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def read(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                out = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for record in members(stream):
                        h, block = parse(record)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if h["WARC-Block-Digest"] != _sha(block):
                            raise ValueError(f"{name}: a block differs from its digest")
                        if h["WARC-Type"] == "response" and (h["WARC-Payload-Digest"] != _sha(payload) or size != len(payload)):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        out.append({
                            "page_id": int(h["Page-ID"]) if h["Page-ID"] else None, "payload_bytes": size,
                            "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": h["WARC-Type"],
                            "refers_to": int(x) if (x := h.get("Refers-To-Page-ID")) else None, "url": h["WARC-Target-URI"],
                        })
                        if len(out) >= 5000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    names = spark.createDataFrame([(f["name"],) for f in files], "name string")
    return names.repartition(max(1, len(files))).mapInArrow(read, _PAGES)


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x FROM p),
b AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(x, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest
  FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM f
"""


def query(spark, sf_dir):
    folder = shared_folder(spark, f"warc-{uuid.uuid4().hex}")
    files = write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder, files).drop("url")

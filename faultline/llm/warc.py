"""WARC archives with a two-level capture index.

Writing: every page becomes one gzip member of a WARC file; of records with
equal payloads of at least ``min_payload`` bytes the one with the smallest
page id is a response and the others are revisits of it (a grouped minimum,
no group is gathered). Captures are then sorted by reversed-host URL key
(``com,example)/path`` plus the page id) and written as compressed index
blocks; a file ends with its sparse block directory (first key, offset and
length of each block). Records are WARC/1.1: a response holds an HTTP response,
a revisit its header and the response it refers to; ``X-`` fields keep the page
ids, and a URL that is no URI as it was.

Reading: keys are sent to the index file whose key range holds them, found in
the directory by binary search, and a block and then the record are read by
byte range. Files are written under names no other attempt uses, and only
those that the committed manifest lists are read.

Defined cases: null html is an empty payload; a null URL gives the key ``)``;
a null page id sorts after every other; rows that repeat the smallest page id
of a group are all responses; an empty table gives empty archives; payloads of
any length are one record; other columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.storage import fresh_path, written
from faultline.llm.url_filter import after_scheme, lower_ascii

BLOCK_LINES = 256
# fixed value of the WARC/1.1 format
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisits/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, start long, length long"
RECORD = "key string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def reversed_host_key(url: Column, page_id: Column) -> Column:
    rest = after_scheme(url)
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    tail = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    order = F.coalesce(F.lpad((page_id.cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("string"), 20, "0"), F.lit("~"))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail, F.lit(" "), order)


def with_record_type(pages: DataFrame, min_payload: int = 100, salts: int = 16) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null: a response)."""
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    base = base.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    own = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    groups = (base.where(F.col("payload_bytes") >= min_payload).groupBy(F.col("payload_digest").alias("_digest"))
              .agg(F.min(own).alias("_own"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _own is not null")
              .select("_digest", F.col("_own.page_id").alias("_first"), F.col("_own.url").alias("_first_url"), "_n"))
    # a hot payload is spread over the salts; the groups' side is one small row for each
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("_n")
    salted = base.withColumn("_s", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = salted.join(groups, (F.col("payload_digest") == F.col("_digest")) & (F.col("_s") == F.col("_salt")), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, F.col("_first")).alias("refers_to"),
                         F.when(revisit, F.col("_first_url")).alias("refers_to_url"))


def _record_id(page_id, url) -> bytes:
    return b"<urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")).encode() + b">"


def target_uri(page_id, url) -> bytes:
    """The URL with what no URI holds percent-encoded; a page without one has a name of its own."""
    return quote(url, safe=":/?#[]@!$&'()*+,;=-._~%").encode() if url else _record_id(page_id, url)[1:-1]


def _record(page_id, url, html, n, digest, refers_to, refers_to_url, date: bytes) -> bytes:
    """One gzip member with a WARC/1.1 record: an HTTP response, or a revisit that has its header only."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http if revisit else http + html
    uri = target_uri(page_id, url)
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _record_id(page_id, url), b"WARC-Date: " + date, b"WARC-Target-URI: " + uri,
            b"WARC-Payload-Digest: sha256:" + digest.encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block), b"X-Payload-Length: %d" % n]
    if revisit:
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: " + _record_id(refers_to, refers_to_url), b"WARC-Refers-To-Target-URI: " + target_uri(refers_to, refers_to_url),
                 b"WARC-Refers-To-Date: " + date, b"X-Refers-To-Page-Id: %d" % refers_to]
    if url is None or uri != url.encode():
        head.append(b"X-Url: " + json.dumps(url).encode())  # the URL as it was
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    return gzip.compress(b"\r\n".join([*head, b"", b""]) + block + b"\r\n\r\n", 6, mtime=0)


def _parse(member: bytes) -> dict:
    raw = gzip.decompress(member)
    end = raw.index(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in raw[:end].split(b"\r\n")[1:])
    number = lambda name: int(fields[name]) if name in fields else None
    block = raw[end + 4: end + 4 + int(fields[b"Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4:]
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != number(b"X-Payload-Length")):
        raise ValueError("a payload differs from its digest")
    url = json.loads(fields[b"X-Url"]) if b"X-Url" in fields else fields[b"WARC-Target-URI"].decode()
    return {"page_id": number(b"X-Page-Id"), "url": url, "payload": payload if kind == "response" else None, "payload_bytes": number(b"X-Payload-Length"), "payload_digest": digest,
            "record_type": kind, "refers_to": number(b"X-Refers-To-Page-Id")}


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``most`` rows or some 8 MB of payload."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row.get("payload") or b"")
        if len(kept) >= most or size > 8_000_000:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


CAPTURE_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
RECORD_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                          ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
SHARD_ARROW = pa.schema([("file", pa.string()), ("first_key", pa.string()), ("last_key", pa.string()), ("blocks", pa.int64()), ("captures", pa.int64())])


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return store, path


def _writer(folder: str, date: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        store, path = _open(folder)
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    member = _record(row["page_id"], row["url"], row["html"], row["payload_bytes"], row["payload_digest"], row["refers_to"], row["refers_to_url"], date)
                    out.write(member)
                    yield {"key": row["key"], "page_id": row["page_id"], "file": name, "start": at, "length": len(member)}
                    at += len(member)
            if out is not None:
                out.close()
        yield from _batches(rows(), CAPTURE_ARROW, 4096)
    return write


def _index_writer(folder: str):
    """Sorted captures of one partition -> one index file: blocks, directory, its length."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, directory, lines, first, last, n = None, f"{uuid.uuid4().hex}.idx", 0, [], [], None, None, 0

        def flush():
            nonlocal at, lines
            block = zlib.compress(json.dumps(lines).encode())
            out.write(block)
            directory.append([lines[0][0], at, len(block)])
            at, lines = at + len(block), []

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store, path = _open(folder)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    first = row["key"]
                lines.append([row["key"], row["file"], row["start"], row["length"]])
                last, n = row["key"], n + 1
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + struct.pack("<q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first_key": first, "last_key": last, "blocks": len(directory), "captures": n}], SHARD_ARROW)
    return write


def write_archive(pages: DataFrame, folder: str, min_payload: int = 100, date: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Write archives and index under ``folder``; returns (captures, index files). ``date`` is the records' date, else the time of the call."""
    stamp = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ").encode()
    records = with_record_type(pages, min_payload).withColumn("key", reversed_host_key(F.col("url"), F.col("page_id")))
    captures = written(records.mapInArrow(_writer(f"{folder}/archive", stamp), CAPTURE), "captures")
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shards = (captures.repartitionByRange(n, "key").sortWithinPartitions("key")
              .mapInArrow(_index_writer(f"{folder}/index"), "file string, first_key string, last_key string, blocks long, captures long"))
    return captures, written(shards, "index-files")


class _Reader:
    """Byte ranges of the files of one folder, with few of them held open."""

    def __init__(self, folder: str, most: int = 64):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.open, self.most = OrderedDict(), most

    def file(self, name: str):
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.store.open_input_file(f"{self.path}/{name}")
        self.open.move_to_end(name)
        return self.open[name]

    def range(self, name: str, start: int, length: int) -> bytes:
        return self.file(name).read_at(length, start)

    def size(self, name: str) -> int:
        return self.file(name).size()


def _lookup(folder: str):
    """(file, key) rows sorted by file and key -> the records of those keys."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            index, archive = _Reader(f"{folder}/index"), _Reader(f"{folder}/archive")
            name = directory = firsts = None
            block_no, block, keys = -1, [], []
            for batch in batches:
                for row in batch.to_pylist():
                    if row["file"] != name:
                        name, size = row["file"], index.size(row["file"])
                        (length,) = struct.unpack("<q", index.range(name, size - 8, 8))
                        directory = json.loads(zlib.decompress(index.range(name, size - 8 - length, length)))
                        firsts, block_no = [d[0] for d in directory], -1
                    at = max(0, bisect.bisect_left(firsts, row["key"]) - 1)  # equal keys may begin in the block before
                    while at < len(directory) and (firsts[at] <= row["key"]):
                        if at != block_no:
                            block_no, block = at, json.loads(zlib.decompress(index.range(name, directory[at][1], directory[at][2])))
                            keys = [line[0] for line in block]
                        for line in block[bisect.bisect_left(keys, row["key"]): bisect.bisect_right(keys, row["key"])]:
                            yield {"key": row["key"]} | _parse(archive.range(line[1], line[2], line[3]))
                        at += 1
        yield from _batches(rows(), RECORD_ARROW)
    return read


def _placer(spans: list[tuple[str, str, str]]):
    """Keys -> (file, key) for each index file whose key range holds the key, by binary search of the ranges."""
    firsts = [first for first, _, _ in spans]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, keys = [], []
            for key in batch.column("key").to_pylist():
                i = bisect.bisect_right(firsts, key) - 1
                while i >= 0 and spans[i][1] >= key:  # more than one file only for a key at their border
                    files.append(spans[i][2])
                    keys.append(key)
                    i -= 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(keys, pa.string())], names=["file", "key"])
    return place


def look_up(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """The records of each key of ``keys`` (column key, each once).

    The index files' key ranges are the upper level: a row per file, at most
    as many as sort partitions, sent to the tasks as a sorted list. A key that
    a third of the captures share may span files.
    """
    spans = sorted((r["first_key"], r["last_key"], r["file"]) for r in shards.select("first_key", "last_key", "file").collect())
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = keys.select("key").mapInArrow(_placer(spans), "file string, key string")
    return placed.repartition(n, "file").sortWithinPartitions("file", "key").mapInArrow(_lookup(folder), RECORD)


def archive_round_trip(pages: DataFrame, min_payload: int = 100) -> DataFrame:
    """Write every page, then read every capture back through the index."""
    folder = fresh_path(pages.sparkSession, "warc")
    if ":" not in folder.split("/", 1)[0]:  # a plain path
        folder = f"file://{folder}"
    captures, shards = write_archive(pages, folder, min_payload)
    return look_up(captures.select("key").distinct(), shards, folder)

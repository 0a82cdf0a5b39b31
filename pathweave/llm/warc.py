"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, each a gzip member of its own, in archive files in the shared folder.
The capture index has a line for each record, sorted by key: the URL with its host reversed
(``com,example,www)/path``) and the page's id. Lines lie in compressed blocks in index files; a sparse
directory has the first key of each block and its place. A lookup finds its block by binary search in
the directory, reads that range of the index file, finds its lines in the block by binary search, and
reads the records' ranges from the archives.

The directory is kept to about ``MOST_BLOCKS`` rows, whatever the number of pages (blocks grow with the
table), so that it can be sent to all tasks.

Files are written by tasks under names of their own and closed before any row about them goes out; a
task that runs again writes new files, and no row refers to those of a failed one.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_input, open_output, scratch, written

#: Payloads below this size are always stored.
LEAST_REVISIT = 1000
#: Digests up to which those that repeat are broadcast (60 bytes each) rather than joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Bytes after which a task begins a new archive file.
ROLL = 64_000_000
#: Bytes of an archive whose records are read in a row.
STRETCH = 1_000_000
#: Bytes of archives that one task reads, about.
READ = 32_000_000
#: Lines in a block at least, and blocks in an index at most (but for one a partition).
BLOCK_LINES, MOST_BLOCKS = 256, 100_000
#: The names that the format prescribes.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of all records: pages carry none.
DATE = "1970-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """The URL with its host reversed, in lower case and without scheme, port and white space."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        parts, host = None, ""
    if parts is None or not host:
        return quote(url, safe="/:?=&%,)(-._~")
    path = parts.path or "/"
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.lower().split("."))) + ")" + quote(path + query, safe="/:?=&%,)(-._~")


def capture_key(url: str | None, page_id: int | None) -> str:
    """The index key of a page's record: its URL key, then its id so that ids sort as numbers."""
    return f"{url_key(url)} {'-' if page_id is None else format(page_id + (1 << 63), '020d')}"


def record_id(page_id: int | None) -> str:
    """The URN of a page's record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit has the HTTP head alone."""
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


@dataclass
class Record:
    """A record read back."""

    page_id: int | None
    kind: str
    url: str | None
    payload: bytes
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def parse(member: bytes) -> Record:
    """Read one gzip member; a stored payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION:
        raise ValueError(f"not a record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda name: int(fields[name]) if name in fields else None
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    return Record(number("Page-ID"), fields["WARC-Type"], fields.get("WARC-Target-URI"), payload, size, digest, number("Refers-To-Page-ID"))


def _write_archives(folder: str):
    names = ["key", "file", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, name, at, rows = None, "", 0, []

        def close() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names)

        for batch in batches:
            for page_id, url, html, size, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if stream is None:
                    name = f"{folder}/part-of-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    stream, at, rows = open_output(name), 0, []
                member = record(page_id, url, (html or "").encode(), size, digest, refers_to)
                stream.write(member)
                rows.append((capture_key(url, page_id), name, at, len(member)))
                at += len(member)
                if at >= ROLL:
                    yield close()
                    stream = None
        if stream is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns where: key, file, offset, length.

    Of records with equal payloads of ``LEAST_REVISIT`` bytes or more that with the largest page_id is a
    response, the others are revisits of it. Rows without a page_id are responses. A null html is an
    empty payload, a null url leaves out the target. Repeated rows have a record each, an empty table none;
    other columns, whatever their names, are left out.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.octet_length(html).cast("long").alias("bytes"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    # Only digests that repeat are looked up, so pages that repeat nothing don't move.
    sizes = rows.where(f"bytes >= {LEAST_REVISIT}").groupBy("digest").agg(F.max("page_id").alias("root"), F.count("*").alias("n"))
    repeated = written(sizes.where("n > 1").select("digest", "root"), "payloads")
    met = rows.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_DIGESTS else repeated, "digest", "left")
    refers = F.when(F.col("page_id") != F.col("root"), F.col("root"))
    payload = F.when(refers.isNull(), F.col("html"))
    out = met.select("page_id", "url", payload.alias("html"), "bytes", "digest", refers.alias("refers_to"))
    return written(out.mapInArrow(_write_archives(folder), "key string, file string, offset long, length long"), "captures")


def _write_blocks(folder: str, block_lines: int):
    names = ["first_key", "last_key", "file", "offset", "length", "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gz"
        stream, at, rows, lines = None, 0, [], []

        def flush() -> None:
            nonlocal stream, at, lines
            stream = stream or open_output(name)
            block = zlib.compress("\n".join(f"{key} {json.dumps(place)}" for key, place in lines).encode(), 6)
            stream.write(block)
            rows.append((lines[0][0], lines[-1][0], name, at, len(block), len(lines)))
            at, lines = at + len(block), []

        for batch in batches:
            for key, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                lines.append((key, [file, offset, length]))
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if stream is not None:
            stream.close()
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return run


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort the captures by key into compressed blocks; returns the block directory."""
    n = captures.count()
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "file", "offset"]
    rows = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lines = max(BLOCK_LINES, -(-n // MOST_BLOCKS))
    directory = rows.select("key", "file", "offset", "length").mapInArrow(_write_blocks(folder, lines), "first_key string, last_key string, file string, offset long, length long, lines long")
    return written(directory, "directory")


@dataclass
class Directory:
    """The sparse directory in key order, for binary search."""

    first: list[str]
    last: list[str]
    places: list[tuple[str, int, int]]

    @classmethod
    def of(cls, directory: DataFrame) -> Directory:
        rows = sorted((r["first_key"], r["last_key"], r["file"], r["offset"], r["length"]) for r in directory.collect())
        return cls([r[0] for r in rows], [r[1] for r in rows], [r[2:] for r in rows])

    def blocks(self, low: str, high: str) -> range:
        """Numbers of the blocks that may hold keys from ``low`` to ``high``."""
        return range(bisect.bisect_left(self.last, low), bisect.bisect_right(self.first, high))


def read_block(place: tuple[str, int, int]) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Keys and record places of a block, from one range read."""
    file, offset, length = place
    with open_input(file) as stream:
        stream.seek(offset)
        lines = zlib.decompress(stream.read(length)).decode().split("\n")
    pairs = [line.split(" [", 1) for line in lines]
    return [p[0] for p in pairs], [tuple(json.loads("[" + p[1])) for p in pairs]


def read_records(places: Iterable[tuple[str, int, int]]) -> Iterator[Record]:
    """The records at these places, each by a range read of its archive."""
    name, stream = None, None
    for file, offset, length in places:
        if file != name:
            if stream is not None:
                stream.close()
            name, stream = file, open_input(file)
        stream.seek(offset)
        yield parse(stream.read(length))
    if stream is not None:
        stream.close()


class CaptureIndex:
    """Archives and index of a table of pages; the files lie in ``folder``."""

    def __init__(self, pages: DataFrame, folder: str | None = None) -> None:
        self.spark = pages.sparkSession
        self.folder = folder or scratch(self.spark, "warc")
        self.captures = write_archives(pages, f"{self.folder}/archives")
        self.directory = build_index(self.captures, f"{self.folder}/index")
        stored = self.captures.agg(F.sum("length").alias("n")).first()["n"] or 0
        self.parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), stored // READ)
        self.search = Directory.of(self.directory)  # about MOST_BLOCKS rows at most

    def find(self, url: str) -> list[Record]:
        """All captures of one URL, on the driver."""
        low, high = f"{url_key(url)} ", f"{url_key(url)} ~"
        places = []
        for b in self.search.blocks(low, high):
            keys, at = read_block(self.search.places[b])
            places += at[bisect.bisect_left(keys, low) : bisect.bisect_right(keys, high)]
        return list(read_records(sorted(places)))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Records of the captures with these (page_id, url): a row for each record, whatever the number of
        rows that ask for it. Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
        shared = self.spark.sparkContext.broadcast(self.search)

        def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = shared.value
            for batch in batches:
                keys, blocks = [], []
                for page_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    key = capture_key(url, page_id)
                    for b in search.blocks(key, key):
                        keys.append(key)
                        blocks.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(blocks, pa.int64())], ["key", "block"])

        def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, keys, at = -1, [], []
            for batch in batches:
                found = []
                for key, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if block != now:
                        now, (keys, at) = block, read_block(shared.value.places[block])
                    found += at[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "length"])

        def in_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            for batch in batches:
                rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to, r.url) for r in read_records(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        asked = wanted.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(to_blocks, "key string, block long").distinct()
        places = asked.repartition(self.parts, "block").sortWithinPartitions("block", "key").mapInArrow(in_blocks, "file string, offset long, length long")
        spread = places.withColumn("stretch", F.floor(F.col("offset") / STRETCH)).repartition(self.parts, "file", "stretch").sortWithinPartitions("file", "offset")
        return spread.select("file", "offset", "length").mapInArrow(in_archives, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read each back through the index."""
    return CaptureIndex(pages).lookup(pages)

"""WARC archives with a two-level capture index.

Records are gzip members in archive files, one member each. The index sorts the
captures by their reversed-host URL key and writes them in compressed blocks; each
index file ends with a sparse directory of its blocks, and one row per file says
which keys it holds. A lookup searches the files' key ranges, then a file's directory, both
by bisection, reads only the blocks that can hold a key, and then only the records'
bytes. Every step is a Spark stage dealt by file and block, so a key with very many
captures spreads over as many tasks as it has blocks.

Files go to a folder that all executors share, through ``pyarrow.fs``; a task that
runs again writes files of a new name, and only those named in its result count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.llm.common import arrow_map
from meshtally.session import scratch_dir, settle

REVISIT_FROM = 1000  # bytes: smaller payloads are always written
ROLL = 1 << 30  # bytes of an archive file
LINES = 1000  # captures in an index block
READ = 8 << 20  # bytes fetched at once where records lie side by side
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)")


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``http://www.a.org/x`` is ``org,a,www)/x``; NULL is empty."""
    m = _URL.match((url or "").strip())
    scheme, host, port, rest = m.groups() if m else (None, "", None, "")
    port = port if port and (scheme or "").lower() + port not in ("http:80", "https:443") else ""
    parts = [p for p in host.lower().split(".") if p]
    return f"{','.join(reversed(parts))}{port or ''}){rest or '/'}" if parts or rest else ""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the HTTP headers, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {date}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of one record; the digest of a response is computed from its payload and must match."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    named = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = named["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {named['WARC-Record-ID']} is damaged")

    def page(uri: str | None) -> int | None:
        number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    return {"page_id": page(named["WARC-Record-ID"]), "url": named.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": digest, "record_type": named["WARC-Type"], "refers_to": page(named.get("WARC-Refers-To")),
            "payload": None if revisit else payload}


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class _Reader:
    """Byte ranges of files; the file last read stays open."""

    def __init__(self) -> None:
        self.name, self.file = None, None

    def get(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file:
                self.file.close()
            fs, path = _open(name)
            self.name, self.file = name, fs.open_input_file(path)
        return self.file.read_at(length, offset)


class _Writer:
    """Appends to new files of a folder, each at most a little over ``ROLL`` bytes."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.folder, self.suffix, self.file, self.name, self.at = folder, suffix, None, "", 0

    def put(self, data: bytes) -> tuple[str, int, int]:
        if self.file and self.at > ROLL:
            self.close()
        if not self.file:
            fs, path = _open(self.folder)
            fs.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}{self.suffix}"
            self.name, self.file, self.at = f"{self.folder}/{name}", fs.open_output_stream(f"{path}/{name}", compression=None), 0
        self.file.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.file = None


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload BINARY, digest, record_type, refers_to of each row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_FROM
    heads = settle(rows.where(large).groupBy("digest").agg(
        F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "head"))
    revisit = F.coalesce(large & F.col("head").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("head"))),
                         F.lit(False))
    return rows.join(heads, "digest", "left").select(
        "page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("head")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages`` below ``folder``; return the captures: key, page_id, file, offset, length.

    Of records with equal payloads of ``REVISIT_FROM`` bytes or more, those with the largest
    page_id are responses and the others revisit it. A NULL html is an empty payload, a NULL url has the empty
    key; a NULL page_id is smaller than any, and a response where no equal payload has one.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(f"{folder}/warc", ".warc.gz")
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
            at = [out.put(record(p, u, body, digest, to, again, date)) for p, u, body, digest, again, to in rows]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([url_key(r[1]) for r in rows], pa.string()), "page_id": batch.column(0),
                "file": pa.array([a[0] for a in at], pa.string()), "offset": pa.array([a[1] for a in at], pa.int64()),
                "length": pa.array([a[2] for a in at], pa.int64())})
        out.close()

    return settle(planned(pages).mapInArrow(
        write, "key string, page_id bigint, file string, offset bigint, length bigint"))


@dataclass
class Index:
    """One row per index file: its first and last key, and where its directory lies."""

    files: list[tuple[str, str, str, int, int]]


def build_index(captures: DataFrame, folder: str, shards: int | None = None) -> Index:
    """Sort the captures into compressed blocks of ``LINES``, in index files with directories.

    Unless ``shards`` says how many at most, there are 64, or as many as hold a million captures each.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(f"{folder}/index", ".cdx.gz")
        directory: list[tuple[str, int, int]] = []
        held: list[tuple] = []
        last = ""

        def flush(n: int) -> None:
            nonlocal held, last
            block, held = held[:n], held[n:]
            lines = "".join(json.dumps(row) + "\n" for row in block)
            _, at, size = out.put(gzip.compress(lines.encode(), 6, mtime=0))
            directory.append((block[0][0], at, size))
            last = block[-1][0]

        for batch in batches:
            held.extend(zip(*(batch.column(i).to_pylist() for i in range(5))))
            while len(held) >= LINES:
                flush(LINES)
        if held:
            flush(len(held))
        if directory:
            name, at, size = out.put(gzip.compress(json.dumps(directory).encode(), 6, mtime=0))
            yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "last": [last], "file": [name],
                                              "at": pa.array([at], pa.int64()), "size": pa.array([size], pa.int64())})
        out.close()

    order = ["key", "page_id", "file", "offset"]
    shards = shards or max(64, -(-captures.count() // 1_000_000))
    rows = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(
        shards, *order).sortWithinPartitions(*order)
    files = settle(rows.mapInArrow(write, "first string, last string, file string, at bigint, size bigint")).collect()
    return Index(sorted((tuple(r) for r in files), key=lambda f: (f[0].encode(), f[1].encode())))


def lookup(keys: DataFrame, index: Index) -> DataFrame:
    """(key, page_id, file, offset, length): all captures of the distinct keys in ``keys`` (key)."""
    firsts, lasts = [f[0].encode() for f in index.files], [f[1].encode() for f in index.files]

    def find_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, open_file, directory, starts = _Reader(), None, [], []
        for batch in batches:
            out: list[tuple[str, int, int, str]] = []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, _, name, at, size = index.files[n]
                if name != open_file:
                    open_file, directory = name, json.loads(gzip.decompress(reader.get(name, at, size)))
                    starts = [d[0].encode() for d in directory]
                wanted = key.encode()
                # the block before the first that begins with the key may end with it
                for b in range(max(0, bisect_left(starts, wanted) - 1), bisect_right(starts, wanted)):
                    out.append((name, directory[b][1], directory[b][2], key))
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([o[0] for o in out], pa.string()), "at": pa.array([o[1] for o in out], pa.int64()),
                "size": pa.array([o[2] for o in out], pa.int64()), "key": pa.array([o[3] for o in out], pa.string())})

    def in_files(batch: pa.RecordBatch) -> dict:
        out: list[tuple[str, int]] = []
        for key in batch.column(0).to_pylist():
            wanted = key.encode()
            out.extend((key, n) for n in range(bisect_left(lasts, wanted), bisect_right(firsts, wanted)))
        return {"key": pa.array([o[0] for o in out], pa.string()), "n": pa.array([o[1] for o in out], pa.int32())}

    def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, block, lines = _Reader(), None, {}
        for batch in batches:
            out: list[list] = []
            for name, at, size, key in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (name, at) != block:
                    block, lines = (name, at), {}
                    for line in gzip.decompress(reader.get(name, at, size)).decode().splitlines():
                        row = json.loads(line)
                        lines.setdefault(row[0], []).append(row)
                out.extend(lines.get(key, ()))
            yield pa.RecordBatch.from_pydict({
                c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate([
                    ("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                    ("length", pa.int64())])})

    placed = arrow_map(keys.select("key").where("key is not null").distinct(), in_files, "key string, n int")
    blocks = placed.repartition("n", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("n", "key").mapInArrow(
        find_blocks, "file string, at bigint, size bigint, key string")
    return blocks.repartition("file", "at").sortWithinPartitions("file", "at", "key").mapInArrow(
        read_blocks, "key string, page_id bigint, file string, offset bigint, length bigint")


def read_records(captures: DataFrame, payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each capture, read from the archives.

    With ``payload`` also the payload of responses. Captures side by side in a file are fetched together.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    kinds = dict(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            found: list[dict] = []
            i = 0
            while i < len(rows):
                name, start, size = rows[i]
                j, end = i + 1, start + size
                while j < len(rows) and rows[j][:2] == (name, end) and end - start < READ:
                    end += rows[j][2]
                    j += 1
                data = reader.get(name, start, end - start)
                found.extend(parse(data[at - start:at - start + n]) for _, at, n in rows[i:j])
                i = j
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in found], kinds[c]) for c in names})

    near = captures.select("file", "offset", "length").repartition("file", F.expr(f"offset div {4 * READ}"))
    return near.sortWithinPartitions("file", "offset").mapInArrow(
        read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
              "refers_to bigint" + ", payload binary" * payload)


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are ignored) as archives, index them, look up every key, read all records.

    One row per row of ``pages``, repeated ones included; no rows give none.
    """
    folder = folder or f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder)
    index = build_index(captures, folder)
    return read_records(lookup(captures.select("key"), index))

"""WARC records in ZIP packages: written per partition, read back by ranges without extraction.

A package holds stored members: archive/data.warc.gz (records, each its own gzip member), indexes/index.cdxj (a line for
each record: key, timestamp and a JSON object with its file, offset and length) and datapackage.json.  The reader takes
any package of that layout: it parses the end record, the ZIP64 one if there is one, the central directory and the local
headers itself, finds the members under archive/ and indexes/, streams every index (plain or gzipped, with or without key
and timestamp), and reads runs of adjacent records as ranges; any file system that pyarrow opens will do.  Secondary
indexes (.idx) only point into the others and are left alone.

Files are named at random, and only the names that a task returns count, so a task that is run again leaves a file that
nothing reads.  Equal payloads of at least LEAST bytes are written once: by the record of the smallest page_id, to which
the others, revisits, refer.

Defined cases: a null html is an empty payload; equal rows of the smallest page_id are all responses; a row with a null
page_id is a revisit if its payload has a response with an id; other columns are not read.  Of foreign records, the
payload is what follows the HTTP header, as stored (transfer codings stay), or the whole block where there is none; a
SHA-256 or SHA-1 digest in the header is checked, others aren't; a record without a length in its HTTP header has its
payload's.  Records that no index names aren't read; an index that names a missing or compressed member is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import runtime

DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
ARCHIVES, INDEXES, LISTS = "archive/", "indexes/", (".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")
#: Bytes of a payload that may be a revisit, bytes of records read in one range, compression level.
LEAST, RANGE, LEVEL = 100, 4 << 20, 4
#: Digests (about 100 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000
DATE, STAMP = "2000-01-01T00:00:00Z", "20000101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(name: Column) -> Column:
    """The page_id of a name_of(); null for an empty or a foreign one."""
    return F.regexp_extract(name, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c not in "\r\n" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: list[str]) -> dict[str, str]:
    """Header lines by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header (none where the block has none) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = headers(lines[1:])
    block = rest[: int(warc["content-length"])]
    if not block.startswith(b"HTTP/"):
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http.decode(errors="replace").split("\r\n")[1:]), payload


def checked(payload: bytes, told: str) -> str:
    """The SHA-256 of a payload, which has the digest that its record tells, if that is of a known kind."""
    kind, _, value = told.partition(":")
    digest = hashlib.sha256(payload).hexdigest()
    if kind.lower() == "sha256" and value.lower() != digest:
        raise ValueError("broken payload")
    if kind.lower() == "sha1" and value.upper() not in (base64.b32encode(hashlib.sha1(payload).digest()).decode(), hashlib.sha1(payload).hexdigest().upper()):
        raise ValueError("broken payload")
    return digest


class Stream:
    """A stream that a ZIP writer can't seek in, as object stores have."""

    def __init__(self, sink: pa.NativeFile) -> None:
        self.sink, self.at = sink, 0

    def write(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        self.sink.flush()


def members(source: pa.NativeFile) -> dict[str, tuple[int, int, int]]:
    """Of each member its method, where its data start and their size, by the central directory or its ZIP64 form."""
    size = source.size()
    source.seek(max(0, size - 65_557))
    tail = source.read(min(size, 65_557))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (place,) = struct.unpack_from("<Q", tail, end - 12)
        source.seek(place)
        wide = source.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    source.seek(start)
    directory, at, out = source.read(length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, names, extras, notes, header = (struct.unpack_from(f, directory, at + k)[0] for f, k in (("<H", 10), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
        name = directory[at + 46 : at + 46 + names].decode()
        extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, long = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # 64-bit values stand for those that are full of ones, in this order
                values = list(struct.unpack_from(f"<{long // 8}Q", extra, k + 4))
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                header = values.pop(0) if header == 0xFFFFFFFF else header
            k += 4 + long
        at += 46 + names + extras + notes
        source.seek(header)
        local = source.read(30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        out[name] = (method, header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
    return out


def opened(path: str) -> pa.NativeFile:
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def stored(source: pa.NativeFile, found: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    method, start, size = found[name]
    if method != 0:
        raise ValueError(f"{name} is not stored")
    return start, size


def roles(pages: DataFrame, text: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, payload, digest, revisit and refers_to of each row."""
    data = F.encode(F.coalesce(pages[text].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages[key].alias("page_id"), pages[url].cast("string").alias("url"), data.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= LEAST)
    copies = runtime.written(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "copies")
    small = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(small, "digest", "left").select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def packages(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows of roles(), a package a partition; path and records of each, from a written table."""
    runtime.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        lines: list[str] = []
        with system.open_output_stream(f"{place}/{name}") as sink, zipfile.ZipFile(Stream(sink), "w", zipfile.ZIP_STORED) as package:
            with package.open(DATA, "w", force_zip64=True) as data:
                at = 0
                for batch in _chained(first, batches):
                    for page_id, url, payload, digest, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        raw = packer.compress(record(page_id, url, payload, digest, refers_to, revisit)) + packer.flush()
                        data.write(raw)
                        about = {"url": url or "", "digest": f"sha256:{digest}", "mime": "warc/revisit" if revisit else "text/html", "filename": DATA.removeprefix(ARCHIVES), "offset": str(at), "length": str(len(raw))}
                        lines.append(f"page:{'' if page_id is None else page_id})/ {STAMP} {json.dumps(about)}")
                        at += len(raw)
            package.writestr(INDEX, "".join(x + "\n" for x in lines))
            package.writestr(ABOUT, json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(lines)], pa.int64())], ["path", "records"])

    return runtime.written(rows.select("page_id", "url", "payload", "digest", "revisit", "refers_to").mapInArrow(run, "path string, records long"), "packages")


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def listed(source: pa.NativeFile, start: int, size: int, packed: bool) -> Iterator[dict]:
    """The JSON objects of an index's lines, read a range at a time."""
    unpacker, line = zlib.decompressobj(31), b""
    for at in range(start, start + size, RANGE):
        source.seek(at)
        data = source.read(min(RANGE, start + size - at))
        while data:
            text = unpacker.decompress(data) if packed else data
            data = unpacker.unused_data if packed else b""  # another gzip member
            if data:
                unpacker = zlib.decompressobj(31)
            *whole, line = (line + text).split(b"\n")
            yield from (json.loads(x[x.index(b"{") :]) for x in whole if b"{" in x)
    if b"{" in line:
        yield json.loads(line[line.index(b"{") :])


def ranges(paths: DataFrame) -> DataFrame:
    """path, start, lengths and packed (whether gzipped) of runs of adjacent records of about RANGE bytes, by the packages' own indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "start", "lengths", "packed"]
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            with opened(path) as source:
                found = members(source)
                archives = [n for n in found if n.startswith(ARCHIVES) and not n.endswith("/")]
                rows: list[tuple[str, int, list[int], bool]] = []
                end = None
                for name in sorted(n for n in found if n.startswith(INDEXES) and n.endswith(LISTS)):
                    for entry in listed(source, *stored(source, found, name), name.endswith(".gz")):
                        file = entry.get("filename")
                        member = archives[0] if file is None and len(archives) == 1 else next((n for n in archives if n == file or n == f"{ARCHIVES}{file}"), None)
                        if member is None:
                            raise ValueError(f"{path} has no archive {file}")
                        base, _ = stored(source, found, member)
                        start, length = base + int(entry["offset"]), int(entry["length"])
                        if start != end or start - rows[-1][1] > RANGE:
                            if len(rows) >= 1000:
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                                rows = []
                            rows.append((path, start, [], member.endswith(".gz")))
                        rows[-1][2].append(length)
                        end = start + length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return paths.select("path").mapInArrow(run, "path string, start long, lengths array<long>, packed boolean")


def records(paths: DataFrame) -> DataFrame:
    """record_id, record_type, url, payload_bytes, payload_digest (SHA-256; of a revisit, as told), refers_to_id and payload
    (null in revisits) of each record."""
    partitions = max(1, paths.count())
    fields = (("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths, packed in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(path) as source:
                    source.seek(start)
                    data = source.read(sum(lengths))
                rows, at = [], 0
                for length in lengths:
                    raw = data[at : at + length]
                    at += length
                    warc, http, payload = parsed(zlib.decompress(raw, 31) if packed else raw)
                    kind, told = warc["warc-type"], warc.get("warc-payload-digest", "")
                    size = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(payload)
                    if kind == "revisit":
                        rows.append((warc["warc-record-id"], kind, warc.get("warc-target-uri"), size, told.partition(":")[2] or None, warc.get("warc-refers-to"), None))
                    else:
                        rows.append((warc["warc-record-id"], kind, warc.get("warc-target-uri"), len(payload), checked(payload, told), None, payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])

    dealt = ranges(paths.repartition(partitions)).repartition(2 * partitions)
    return dealt.mapInArrow(run, "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to_id string, payload binary")


def read(paths: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null in revisits) of the records of packages()."""
    return records(paths).select(id_of(F.col("record_id")).alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", id_of(F.col("refers_to_id")).alias("refers_to"), "payload")


def op5_warc_zip(spark, sf_dir: str) -> DataFrame:
    folder = f"{runtime.shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    found = read(packages(roles(runtime.table(spark, sf_dir, "pages")), folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha256(t) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM r
"""

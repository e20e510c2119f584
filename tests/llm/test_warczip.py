"""Round trips through packages, and the ZIP reader against the standard library's writer."""

import base64
import gzip
import hashlib
import io
import json
import zipfile

import pyarrow as pa
import pytest

from glyphflow.llm import warczip


@pytest.mark.parametrize("streamed", [False, True])
def test_members(streamed, monkeypatch):
    plain = {"a.txt": b"x" * 10, "é/b": b"", "c": b"y" * 70_000}
    if streamed:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in plain.items():
            with z.open(k, "w", force_zip64=streamed) as f:
                f.write(v)
        z.comment = b"a comment"
    source = pa.PythonFile(io.BytesIO(out.getvalue()), "r")
    found = warczip.members(source)
    assert {k: out.getvalue()[s : s + n] for k, (m, s, n) in found.items() if m == 0} == plain


def test_no_archive():
    with pytest.raises(ValueError):
        warczip.members(pa.PythonFile(io.BytesIO(b"plain" * 10), "r"))


def test_round_trip(spark, tmp_path):
    same = "<p>é</p>" * 40
    rows = [(5, "http://a/\r\nx", same), (3, None, same), (9, "u", same), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", same), (10, "u", "z" * 100 + "\r\n\r\n"), (3, None, same)]
    df = spark.createDataFrame([(p, u, h, "x") for p, u, h in rows], "page_id long, url string, html string, payload string")
    got = warczip.read(warczip.packages(warczip.roles(df).repartition(3), f"file://{tmp_path}/out")).collect()
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = data == same.encode() and p != 3
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"} == {p: h or "" for p, _, h in rows if (p, h) != (p, same) or p == 3}
    assert next(r.url for r in got if r.page_id == 5) == "http://a/%0D%0Ax"


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warczip.read(warczip.packages(warczip.roles(df), f"file://{tmp_path}/out")).count() == 0


def warc(kind, block, **fields):
    head = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_packages(spark, tmp_path, monkeypatch, packed):
    """Several archives, gzipped and plain, indexes in several forms, records of other kinds and digests, and gaps."""
    monkeypatch.setattr(warczip, "RANGE", 150)
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    one = [
        warc("warcinfo", b"software: y", WARC_Record_ID="<urn:uuid:0>"),
        warc("response", http + b"hello", WARC_Record_ID="<urn:uuid:1>", WARC_Target_URI="http://a/", WARC_Payload_Digest=f"sha1:{sha1}"),
        warc("resource", b"plain", WARC_Record_ID="<urn:uuid:2>", WARC_Payload_Digest="md5:unknown"),
        warc("revisit", http, WARC_Record_ID="<urn:uuid:3>", WARC_Refers_To="<urn:uuid:1>", WARC_Payload_Digest=f"sha1:{sha1}"),
    ]
    two = [warc("response", http + bytes([i]) * i, WARC_Record_ID=f"<urn:uuid:two-{i}>") for i in range(20)]
    path = f"{tmp_path}/foreign.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        lines = {"a": [], "b": []}
        for name, rows, pack in (("rec-1.warc.gz", one, True), ("rec-2.warc", two, False)):
            data, skip = b"", b"unlisted"
            for k, row in enumerate(rows):
                raw = gzip.compress(row) if pack else row
                if k % 3 == 2:
                    data += gzip.compress(skip) if pack else skip
                about = {"filename": name, "offset": str(len(data)) if pack else len(data), "length": str(len(raw))}
                lines["a" if pack else "b"].append(("com,a)/ 20200101000000 " if pack else "") + json.dumps(about))
                data += raw
            z.writestr(f"archive/{name}", data)
        first, rest = "\n".join(lines["a"]).encode(), ("!meta 0\n" + "\n".join(lines["b"]) + "\n").encode()
        z.writestr("indexes/index.cdx.gz" if packed else "indexes/index.cdx", gzip.compress(first[:100]) + gzip.compress(first[100:]) if packed else first)
        z.writestr("indexes/more.cdxj", rest)
        z.writestr("indexes/index.idx", b"a pointer into the others {")
        z.writestr("pages/pages.jsonl", b"{}", zipfile.ZIP_DEFLATED)
    got = {r.record_id: r for r in warczip.records(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()}
    assert len(got) == 24
    assert bytes(got["<urn:uuid:1>"].payload) == b"hello" and got["<urn:uuid:1>"].url == "http://a/" and got["<urn:uuid:1>"].payload_digest == hashlib.sha256(b"hello").hexdigest()
    assert bytes(got["<urn:uuid:2>"].payload) == b"plain" and got["<urn:uuid:0>"].record_type == "warcinfo"
    assert got["<urn:uuid:3>"].refers_to_id == "<urn:uuid:1>" and got["<urn:uuid:3>"].payload is None
    assert all(bytes(got[f"<urn:uuid:two-{i}>"].payload) == bytes([i]) * i for i in range(20))


def test_broken_payloads_and_missing_archives(spark, tmp_path):
    with pytest.raises(ValueError):
        warczip.checked(b"x", "sha1:" + "A" * 32)
    with pytest.raises(ValueError):
        warczip.checked(b"x", "sha256:00")
    path = f"{tmp_path}/none.wacz"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/a.warc", b"")
        z.writestr("indexes/i.cdxj", b'{"filename": "b.warc", "offset": 0, "length": 1}')
    with pytest.raises(Exception, match="no archive b.warc"):
        warczip.records(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()

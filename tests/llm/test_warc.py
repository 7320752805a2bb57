import gzip
import hashlib
import io
import json
import zipfile

import pyarrow as pa
import pytest

from tesselar.llm import warc


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("limit", [zipfile.ZIP64_LIMIT, 10])
@pytest.mark.parametrize("comment", [b"", b"a comment PK\x05\x06 in the end"])
def test_directories(monkeypatch, limit, comment):
    """Plain and ZIP64 directories, written by the standard library."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2 if limit == 10 else zipfile.ZIP_FILECOUNT_LIMIT)
    out = Source()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(5):
            z.writestr(f"m{k}", bytes([k]) * (50 + k))
        z.writestr("packed", b"x" * 500, zipfile.ZIP_DEFLATED)
        z.comment = comment
    d = warc.ZipDirectory(out)
    assert set(d.members) == {f"m{k}" for k in range(5)}
    for k in range(5):
        assert d.read(*d.locate(f"m{k}")) == bytes([k]) * (50 + k)


def test_broken():
    for data in (b"", b"PK\x05\x06", b"x" * 100):
        with pytest.raises(ValueError):
            warc.ZipDirectory(Source(data))


def test_record_round_trip():
    for payload in (b"", b"<html>\r\n\r\nWARC/1.1\r\n</html>", bytes(range(256)) * 9):
        got = warc.parse(warc.record("7", "http://x/ü ?a=b\n", payload, warc.digest_of(payload), None, False))
        assert (got["id"], got["url"], got["payload"], got["length"]) == ("7", "http://x/ü ?a=b\n", payload, len(payload))
        again = warc.parse(warc.record(None, None, payload, warc.digest_of(payload), "9", True))
        assert (again["id"], again["url"], again["payload"], again["length"], again["refers_to"], again["type"]) == (None, None, None, len(payload), "9", "revisit")
    with pytest.raises(ValueError):
        warc.parse(warc.record("7", "u", b"abc", warc.digest_of(b"abd"), None, False))


def test_pages(spark, monkeypatch):
    rows = [(1, "u1", "same"), (5, "u5", "same"), (3, None, "same"), (2, "u2", None), (4, "u4", ""), (6, "u6", "größe"), (None, "u", "same"), (7, "u7", "x" * 300_000), (7, "u7", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "'c' as row_id", "'p' as payload")
    monkeypatch.setattr(warc, "RANGE_BYTES", 300)
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 3)
    out = warc.round_trip(pages).collect()
    assert sorted(str(r.id) for r in out) == sorted(str(r[0]) for r in rows)
    for r in out:
        texts = {h or "" for i, _, h in rows if i == r.id}
        raw = texts.pop().encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == warc.digest_of(raw)
        tops = {"same": 5, None: 4, "": 4, "größe": 6}
        top = tops.get(raw.decode(), 7)
        if r.record_type == "revisit":
            assert r.refers_to == top and r.payload is None
        else:
            assert r.id == top and r.refers_to is None and hashlib.sha1(r.payload).digest() == hashlib.sha1(raw).digest()
    assert sum(r.record_type == "response" for r in out) == 4
    large = warc.round_trip(pages, least=5).collect()
    assert sum(r.record_type == "revisit" for r in large) == 1
    assert warc.round_trip(pages.where("false")).count() == 0
    assert pa is not None


def other_record(kind, rec_id, block, extra=(), content="application/http; msgtype=response", packed=True):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rec_id}>", "WARC-Date: 2020-02-02T02:02:02Z", f"Content-Type: {content}", f"Content-Length: {len(block)}", *extra]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw) if packed else raw


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_of_other_writers(spark, tmp_path, monkeypatch, zip64):
    """Several WARC files, a gzipped CDXJ index with a header line, a file without an index, other record types; also with ZIP64 fields."""
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    one = [
        other_record("warcinfo", "w", b"software: x", content="application/warc-fields"),
        other_record("response", "a", http + b"first", [f"WARC-Payload-Digest: sha1:{warc.digest_of(b'first')}", "WARC-Target-URI: http://a.org/x"]),
        other_record("request", "q", b"GET /x HTTP/1.1\r\n\r\n", content="application/http; msgtype=request"),
        other_record("revisit", "b", http, ["WARC-Refers-To: <urn:uuid:a>", f"WARC-Payload-Digest: sha1:{warc.digest_of(b'first')}"]),
    ]
    two = [other_record("resource", "c", b"plain payload", content="text/plain"), other_record("response", "d", http + b"y" * 200_000)]
    three = [other_record("response", "e", http + b"z", packed=False), other_record("response", "f", http, packed=False)]
    lines, at = ["!meta 0 {}"], 0
    for k, data in enumerate(one):
        if k in (1, 3):
            lines.append(f'org,a)/x 20200202020202 {{"url": "http://a.org/x", "length": "{len(data)}", "offset": "{at}", "filename": "one.warc.gz"}}')
        at += len(data)
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = str(tmp_path / "other.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("datapackage.json", "{}")
        z.writestr("archive/one.warc.gz", b"".join(one))
        z.writestr("archive/two.warc.gz", b"".join(two))
        z.writestr("archive/three.warc", b"".join(three))
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode()))
    monkeypatch.undo()
    out = {r.id: r for r in warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()}
    assert set(out) == {f"urn:uuid:{x}" for x in "abcdef"}
    get = lambda x: out[f"urn:uuid:{x}"]
    assert [bytes(get(x).payload) for x in "acdef"] == [b"first", b"plain payload", b"y" * 200_000, b"z", b""]
    assert (get("b").record_type, get("b").refers_to, get("b").payload, get("b").payload_bytes) == ("revisit", "urn:uuid:a", None, None)
    assert get("a").url == "http://a.org/x" and get("c").payload_digest == warc.digest_of(b"plain payload")


def test_index_is_cdxj(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://www.b.org:80/P?q=1 2", "x"), (2, None, "x"), (3, "http://a.org", "y")], "page_id long, url string, html string").coalesce(1)
    files = [r.path for r in warc.write_archives(pages, f"file://{tmp_path}").collect()]
    assert len(files) == 1
    with zipfile.ZipFile(files[0].removeprefix("file://")) as z:
        lines = z.read(warc.INDEX_MEMBER).decode().splitlines()
        data = z.read(warc.WARC_MEMBER)
    assert [x.split(" ", 2)[:2] for x in lines] == [["-", "20000101000000"], ["org,a)/", "20000101000000"], ["org,b:80)/p?q=1%202", "20000101000000"]]
    for x in lines:
        e = json.loads(x.split(" ", 2)[2])
        got = warc.parse(gzip.decompress(data[int(e["offset"]) : int(e["offset"]) + int(e["length"])]))
        assert e["filename"] == "data.warc.gz" and e["digest"] == "sha1:" + got["digest"] and (e["mime"] == "warc/revisit") == (got["type"] == "revisit")


def test_compressed_members_are_refused():
    """A ZIP whose records are deflated is an error, not an archive without records; other members may be."""

    def made(inside):
        out = Source()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("archive/data.warc", b"stored")
            z.writestr(inside, b"some text " * 50, zipfile.ZIP_DEFLATED)
        return out

    for inside in ("archive/more.warc", "indexes/index.cdx"):
        with pytest.raises(ValueError):
            warc.ZipDirectory(made(inside))
    assert list(warc.ZipDirectory(made("pages/pages.jsonl")).members) == ["archive/data.warc"]

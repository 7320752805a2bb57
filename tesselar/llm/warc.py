"""WARC records in ZIP-packaged archives: writing, and reading without extraction.

An archive is a ZIP file of stored members: WARC files under ``archive/`` (a gzip member a record) and their indexes under
``indexes/`` (CDXJ: a line a record with its sort key, time and a JSON object with its file, offset and length). The reader parses the end
record, the ZIP64 records and the central directory, finds where the stored members lie, reads the indexes, and then reads ranges of
records; no member is unpacked as a whole. WARC files that no index names are walked record by record. Archives lie in the shared folder and
are opened by URI, so any executor can read what another one wrote.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_ROWS, Facts, Numbered, Scratch, opened, tidied

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
_WARCS, _INDEXES = (".warc.gz", ".warc"), (".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")
#: An archive is closed at this many bytes or records; a read task gets ranges of about this many bytes.
ARCHIVE_BYTES, ARCHIVE_RECORDS, RANGE_BYTES = 256 << 20, 200_000, 4 << 20
_GAP = 1 << 16
DATE = "2000-01-01T00:00:00Z"
_STAMP = re.sub(r"\D", "", DATE)
_ID = "urn:x-record:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(rec_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """A WARC 1.1 record; a revisit has the HTTP header only, whose Content-Length still is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if rec_id is None else 'i' + quote(rec_id, safe='')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{_ID}{'' if refers_to is None else 'i' + quote(refers_to, safe='')}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL = ":/?#[]@!$&'()*+,;=-._~"


def _id_in(value: str) -> str | None:
    """The id that ``record`` was given, or any other writer's id as it is."""
    value = value.strip().removeprefix("<").removesuffix(">")
    if not value.startswith(_ID):
        return value or None
    value = value.removeprefix(_ID)
    return unquote(value[1:]) if value else None


def sort_key(url: str | None) -> str:
    """The host's labels from the last to the first, then the rest, without blanks; "-" without a URL."""
    parts = urlsplit(quote(url, safe=_URL)) if url else None
    if not parts or not parts.netloc:
        return quote(url, safe=_URL).lower() if url else "-"
    host, _, port = parts.netloc.rpartition("@")[2].lower().partition(":")
    rest = parts.path.lower() + ("?" + parts.query.lower() if parts.query else "")
    return ",".join(host.removeprefix("www.").split(".")[::-1]) + (":" + port if port else "") + ")" + (rest or "/")


def parse(raw: bytes) -> dict:
    """A record's id, url, type, digest, refers_to, payload (None for a revisit) and the full payload's length (None if unknown).

    Records of HTTP responses hold their payload after the HTTP header, all others are payload. A SHA-1 payload digest is checked where
    nothing was done to the payload on its way (a transfer or content encoding); without one it is computed."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block, kind = rest[: int(fields["content-length"])], fields["warc-type"]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record is too short")
    length, payload, coded = None, block, False
    if fields.get("content-type", "").startswith("application/http") or kind == "revisit":
        http, _, payload = block.partition(b"\r\n\r\n")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
        coded = b"transfer-encoding" in named or b"content-encoding" in named
        length = int(named[b"content-length"]) if named.get(b"content-length", b"").isdigit() else None
    revisit = kind == "revisit"
    digest = fields.get("warc-payload-digest", "")
    algorithm, _, digest = digest.rpartition(":")
    if not revisit:
        length = len(payload)
        if not digest:
            digest = digest_of(payload)
        elif algorithm == "sha1" and not coded and digest_of(payload) != digest.upper():
            raise ValueError("a payload differs from its digest")
    url = fields.get("warc-target-uri")
    return {
        "id": _id_in(fields.get("warc-record-id", "")),
        "url": None if url is None else unquote(url.removeprefix("<").removesuffix(">")),
        "type": kind,
        "digest": digest or None,
        "refers_to": _id_in(fields.get("warc-refers-to", "")) if revisit else None,
        "payload": None if revisit else payload,
        "length": length,
    }


class ArchiveWriter:
    """Streams records into one ZIP file under a temporary name, which ``close`` replaces by the final one."""

    def __init__(self, uri: str):
        self.uri, self.index, self.at, self.n = uri, [], 0, 0
        self.fs, self.path = opened(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.zip = zipfile.ZipFile(_Stream(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)

    def add(self, url: str | None, raw: bytes, digest: str, revisit: bool) -> None:
        packed = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = packed.compress(raw) + packed.flush()
        self.member.write(data)
        entry = {"url": quote(url, safe=_URL) if url else "-", "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{digest}"}
        entry |= {"length": str(len(data)), "offset": str(self.at), "filename": WARC_MEMBER.rpartition("/")[2]}
        self.index.append(f"{sort_key(url)} {_STAMP} {json.dumps(entry)}\n")
        self.at += len(data)
        self.n += 1

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(sorted(self.index)))
        self.zip.close()
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.uri, self.n, self.at


class _Stream(io.RawIOBase):
    """A write-only stream that can't seek, so that the ZIP writer uses data descriptors."""

    def __init__(self, out):
        self.out = out

    def writable(self):
        return True

    def write(self, data):
        self.out.write(data)
        return len(data)

    def flush(self):
        pass


class ZipDirectory:
    """Where the stored members of a ZIP file lie, read from its directories only."""

    def __init__(self, source):
        self.source, self.size = source, source.size()
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<H2I", tail, at + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            locator = self.read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            (end64,) = struct.unpack_from("<Q", locator, 8)
            record = self.read(end64, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<3Q", record, 32)
        self.members: dict[str, tuple[int, int]] = {}
        directory, p = self.read(start, length), 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            method = struct.unpack_from("<H", directory, p + 10)[0]
            packed, plain, n, extra, comment = struct.unpack_from("<2I3H", directory, p + 20)
            local = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n].decode("utf-8")
            q, stop = p + 46 + n, p + 46 + n + extra
            while q + 4 <= stop:
                kind, size = struct.unpack_from("<2H", directory, q)
                if kind == 1:  # 64-bit values of those fields that are full, in this order
                    r = q + 4
                    if plain == 0xFFFFFFFF:
                        plain, r = struct.unpack_from("<Q", directory, r)[0], r + 8
                    if packed == 0xFFFFFFFF:
                        packed, r = struct.unpack_from("<Q", directory, r)[0], r + 8
                    if local == 0xFFFFFFFF:
                        local = struct.unpack_from("<Q", directory, r)[0]
                q += 4 + size
            if method == 0:
                self.members[name] = (local, packed)
            elif name.startswith(("archive/", "indexes/")):  # its records would be missing without a word
                raise ValueError(f"{name} is compressed in the ZIP; members with records or indexes must be stored")
            p = stop + comment

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("the archive is too short")
        return data

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's data in the archive."""
        local, length = self.members[name]
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("a broken local header")
        n, extra = struct.unpack_from("<2H", head, 26)
        return local + 30 + n + extra, length


def revisits(pages: Numbered, id_col: str, payload: str, least: int = 0) -> Facts:
    """(row, refers_to) of the rows that revisit another: of rows with equal payloads of at least ``least`` bytes the one with the
    largest id (of equal ids the row written last) is the response.

    Null and repeated rows are treated as any; an empty table gives no facts. Payloads stay where they are; only their keys (length and SHA-256) are aggregated and joined, so that a large group can be split.
    """
    scratch, size = pages.scratch, F.octet_length(payload)
    keys = pages.rows.where(size >= least).select(F.col(pages.row).alias("row"), F.col(id_col).alias("id"), F.concat_ws(":", size.cast("string"), F.sha2(payload, 256)).alias("key"))
    keys = scratch.save(keys, "keys")
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("id", "row")).alias("top")).where("size > 1")
    groups = scratch.save(groups.select("key", "top"), "groups")
    found = keys.join(groups, "key").where(F.col("top.row") != F.col("row")).select("row", F.col("top.id").cast("string").alias("refers_to"))
    out = pages.facts(found, F.shiftright("row", BLOCK_ROWS))
    scratch.drop(keys, groups)
    return out


def write_archives(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0) -> DataFrame:
    """Writes ZIP archives under ``uri``, some for each task; returns (path, records, bytes) of each.

    The result is the manifest: written as a table, it names only archives that tasks completed. A repeated task writes the same
    names again. Null texts are empty payloads, long ones are written whole; null ids and urls are kept as such; repeated rows and equal
    ids are records of their own, of which ``revisits`` names the response; an empty table has no archives and an empty manifest.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    numbered = Numbered(rows, Scratch(pages.sparkSession, "pages"))
    repeats = revisits(numbered, "id", "payload", least)
    rows = numbered.rows.select(F.col(numbered.row).alias("row"), F.col("id").cast("string"), "url", "payload")
    base = uri.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, out, done = TaskContext.get().partitionId(), 0, None, []
        refers, of = {}, None
        for batch, _, found in repeats.beside(batches, 0):
            if of is not found:
                refers, of = dict(zip(found.column("row").to_pylist(), found.column("refers_to").to_pylist())), found
            for row, rec_id, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = ArchiveWriter(f"{base}/part-{part:06d}-{k:04d}.zip")
                    k += 1
                digest = digest_of(payload)
                out.add(url, record(rec_id, url, payload, digest, refers.get(row), row in refers), digest, row in refers)
                if out.at >= ARCHIVE_BYTES or out.n >= ARCHIVE_RECORDS:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return rows.mapInArrow(tidied(run), "path string, records long, bytes long")


def index_spans(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(file, offset, length) of the lines of a CDXJ index, gzipped or not: a sort key, a time and a JSON object."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for line in data.split(b"\n"):
        at = line.find(b"{")
        if at >= 0 and not line.startswith(b"!"):  # a header line
            entry = json.loads(line[at:])
            if {"filename", "offset", "length"} <= entry.keys():
                yield entry["filename"], int(entry["offset"]), int(entry["length"])


def record_spans(source, at: int, length: int, packed: bool) -> Iterator[tuple[int, int]]:
    """Offset and length of the records of a WARC file that lies at ``at`` of the source, read in order, a piece at a time."""
    end, begin, piece, held = at + length, at, 1 << 20, b""
    here = at  # of what was not read yet
    if packed:
        while begin < end:
            inflate = zlib.decompressobj(31)
            while not inflate.eof:
                if not held:
                    source.seek(here)
                    held = source.read(min(piece, end - here))
                    here += len(held)
                    if not held:
                        raise ValueError("a broken gzip member")
                inflate.decompress(held)
                held = inflate.unused_data
            stop = here - len(held)
            yield begin, stop - begin
            begin = stop
        return
    while begin < end:
        source.seek(begin)
        head = b""
        while b"\r\n\r\n" not in head:
            more = source.read(min(1 << 16, end - begin - len(head)))
            if not more:
                raise ValueError("a broken record header")
            head += more
        head = head[: head.index(b"\r\n\r\n") + 4]
        size = len(head) + int(re.search(rb"(?im)^content-length:\s*(\d+)", head).group(1)) + 4
        yield begin, size
        begin += size


def spans_of(source) -> list[tuple[int, int]]:
    """Offset and length in the archive of all its records that an index names, and of all in WARC files without one, in order."""
    zipped = ZipDirectory(source)
    files = {n: zipped.locate(n) for n in zipped.members if n.startswith("archive/") and n.endswith(_WARCS)}
    found, named = set(), set()
    for name in zipped.members:
        if name.startswith("indexes/") and name.endswith(_INDEXES):
            for file, offset, length in index_spans(zipped.read(*zipped.locate(name))):
                file = file if file.startswith("archive/") else "archive/" + file
                if file not in files:
                    raise ValueError(f"an index names {file}, which is not stored in the archive")
                named.add(file)
                found.add((files[file][0] + offset, length))
    for name, (at, length) in files.items():
        if name not in named:
            found.update(record_spans(source, at, length, name.endswith(".gz")))
    return sorted(found)


def read_archives(archives: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """All records of the archives named in ``path``: id, url, record_type, payload (null for a revisit), payload_bytes (null if a
    revisit doesn't tell), payload_digest, refers_to. Directories and indexes are read first; then tasks read ranges of records.
    Archives of other writers may have any number of WARC files and indexes; a table without a path gives no record."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = opened(path)
                with fs.open_input_file(p) as f:
                    spans = spans_of(f)
                starts, cut = [], []
                for s in spans:
                    if cut and (s[0] + s[1] - cut[0][0] > RANGE_BYTES or s[0] - sum(cut[-1]) > _GAP):
                        starts.append(cut)
                        cut = []
                    cut.append(s)
                if cut:
                    starts.append(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(starts), pa.string()), pa.array([[x[0] for x in c] for c in starts], pa.list_(pa.int64())), pa.array([[x[1] for x in c] for c in starts], pa.list_(pa.int64()))],
                    names=["path", "offsets", "lengths"],
                )

    schema = "id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string"
    names = ["id", "url", "type", "payload", "length", "digest", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                fs, p = opened(path)
                with fs.open_input_file(p) as f:
                    f.seek(offsets[0])
                    data = f.read(offsets[-1] + lengths[-1] - offsets[0])
                found = []
                for at, n in zip(offsets, lengths):
                    raw = data[at - offsets[0] : at - offsets[0] + n]
                    found.append(parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw))
                    if len(found) >= 500:
                        yield _batch(found)
                        found = []
                if found:
                    yield _batch(found)

    def _batch(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    ranges = archives.select("path").mapInArrow(tidied(locate), "path string, offsets array<long>, lengths array<long>")
    out = ranges.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(tidied(fetch), schema)
    if id_type is not None:
        out = out.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
    return out


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0) -> DataFrame:
    """Writes archives to the shared folder and reads them back: one row a page, with its id in its own type again.

    Of equal payloads the row with the largest id is the response (null ids are the smallest; of repeated ids the row written last).
    Other columns, whatever they are called, aren't read; an empty table gives an empty result."""
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "warc")
    manifest = scratch.save(write_archives(pages, f"{scratch.root}/archives", id_col, url_col, text_col, least), "manifest")
    return read_archives(manifest, pages.schema[id_col].dataType)

"""ZIP-packaged WARC archives: writer, directory reader and range reader (operator 5).

An archive is a ZIP file whose members are stored, not deflated: WARC files
with one gzip member a record (``archive/*.warc.gz``) and an index with one
JSON line a record (``indexes/index.cdxj``). A reader looks at the end of the
file, follows the end-of-directory record (and the ZIP64 one where sizes, or
the number of members, need it) to the central directory, locates the stored
members and reads single records by range: nothing is extracted.

Files are opened inside the tasks through ``pyarrow.fs``, in the shared folder
that the cluster names. Each writing task makes files of its own names and
lists them only at its end, so an attempt that is lost leaves nothing behind
that would be read.

Defined results: a null payload is an empty one; of equal payloads every row
with the smallest id is a response (also repeated rows), others are revisits;
rows with a null id are revisits if any equal payload has an id, else
responses; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.session import scratch_path

from .common import materialize
from .files import open_input, open_output

MEMBER_BYTES = 16 << 20  # a WARC member is closed at this size
ARCHIVE_BYTES = 256 << 20  # and an archive at this one
MIN_DEDUP_BYTES = 0
DATE = "1980-01-01T00:00:00Z"
# Fixed values of the ZIP format: signatures, and the marks for "see ZIP64"
LOCAL, CENTRAL, END, LOCATOR, END64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
WORD, LONG = 0xFFFF, 0xFFFFFFFF


# ---- ZIP --------------------------------------------------------------------

class ZipWriter:
    """Stored members, one after the other, to a stream that only appends.

    ``zip64`` forces the 64-bit records that are otherwise written on need."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        start, crc, raw = self.at, zlib.crc32(data), name.encode()
        wide = self.zip64 or len(data) >= LONG
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = LONG if wide else len(data)
        self._put(LOCAL + struct.pack("<HHHHHLLLHH", 45, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.members.append((raw, crc, len(data), start))

    def close(self) -> None:
        first = self.at
        for raw, crc, size, start in self.members:
            big = [self.zip64 or size >= LONG, self.zip64 or start >= LONG]
            extra = b"".join([struct.pack("<QQ", size, size) if big[0] else b"", struct.pack("<Q", start) if big[1] else b""])
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            told = LONG if big[0] else size
            self._put(CENTRAL + struct.pack("<HHHHHHLLLHHHHHLL", 45, 45, 0x800, 0, 0, 33, crc, told, told, len(raw),
                                            len(extra), 0, 0, 0, 0, LONG if big[1] else start) + raw + extra)
        size, n = self.at - first, len(self.members)
        if self.zip64 or n >= WORD or size >= LONG or first >= LONG:
            end64 = self.at
            self._put(END64 + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, n, n, size, first))
            self._put(LOCATOR + struct.pack("<LQL", 0, end64, 1))
            n, size, first = WORD, LONG, LONG
        self._put(END + struct.pack("<HHHHLLH", 0, 0, n, n, size, first, 0))
        self.out.close()


def directory(f) -> dict[str, tuple[int, int, int, int]]:
    """Members of an open archive: name -> (method, first byte, stored size, size)."""
    total = f.size()
    tail_at = max(0, total - WORD - 22 - 20)
    f.seek(tail_at)
    tail = f.read(total - tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)  # the signature inside a comment
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    _, _, _, n, size, first, _ = struct.unpack("<HHHHLLH", tail[at + 4:at + 22])
    if (n == WORD or size == LONG or first == LONG) and at >= 20 and tail[at - 20:at - 16] == LOCATOR:
        f.seek(struct.unpack("<LQL", tail[at - 16:at])[1])
        record = f.read(56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of directory where the locator points")
        n, size, first = struct.unpack("<QQQ", record[32:56])
    f.seek(first)
    listed, members, at = f.read(size), {}, 0
    for _ in range(n):
        if listed[at:at + 4] != CENTRAL:
            raise ValueError("broken ZIP directory")
        (_, _, _, method, _, _, _, packed, full, name_len, extra_len, note_len, _, _, _, start
         ) = struct.unpack("<HHHHHHLLLHHHHHLL", listed[at + 4:at + 46])
        name = listed[at + 46:at + 46 + name_len].decode()
        extra, k = listed[at + 46 + name_len:at + 46 + name_len + extra_len], 0
        while k + 4 <= len(extra):
            kind, length = struct.unpack("<HH", extra[k:k + 4])
            if kind == 1:  # 64-bit values stand here for those that are marked, in this order
                wide = iter(struct.unpack(f"<{length // 8}Q", extra[k + 4:k + 4 + length // 8 * 8]))
                full = next(wide) if full == LONG else full
                packed = next(wide) if packed == LONG else packed
                start = next(wide) if start == LONG else start
            k += 4 + length
        members[name] = (method, start, packed, full)
        at += 46 + name_len + extra_len + note_len
    located = {}
    for name, (method, start, packed, full) in members.items():
        f.seek(start)  # the local header's extra field may differ in length from the directory's
        local = f.read(30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        located[name] = (method, start + 30 + sum(struct.unpack("<HH", local[26:30])), packed, full)
    return located


def member_bytes(f, member: tuple[int, int, int, int]) -> bytes:
    """A whole member (for indexes, which are small and may be deflated)."""
    method, start, packed, _ = member
    f.seek(start)
    data = f.read(packed)
    if method == 8:
        return zlib.decompress(data, -15)
    if method:
        raise ValueError(f"compression method {method} isn't supported")
    return data


# ---- WARC -------------------------------------------------------------------

def _line(value: str) -> str:
    """A header value: control characters can't stand in it."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_id(page_id) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_of(told: str | None) -> str | None:
    return told[10:-1] if told and told.startswith("<urn:page:") else None


def warc_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response, or with ``refers_to`` a revisit, which has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url or 'urn:none')}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to)}"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), the HTTP headers and the payload of a record."""
    warc, rest = _headers(raw)
    http, payload = _headers(rest[:int(warc["content-length"])])
    return {"warc": warc, "http": http, "payload": payload}


# ---- jobs -------------------------------------------------------------------

def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_dedup_bytes: int = MIN_DEDUP_BYTES, zip64: bool = False) -> DataFrame:
    """Writes the archives; one row (path, n_records, n_bytes) per archive.

    First occurrences are found on digests alone, with partial minima, so a
    payload that a third of all pages share costs a row per task. Only digests
    that do repeat are joined to the pages."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    d = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
                     F.unhex(F.sha1(payload)).alias("sha1"), F.length(payload).cast("long").alias("n"))
    seen = d.groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("m"))
    seen = materialize(seen.where((F.col("m") > 1) & (F.col("n") >= min_dedup_bytes)).select(
        F.col("sha1").alias("_sha1"), F.col("n").alias("_n"), "first"), "repeated-payloads")
    d = d.join(seen, (d["sha1"] == seen["_sha1"]) & (d["n"] == seen["_n"]), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    d = d.select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("first")).alias("refers_to"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, zipped, path, member, index, names, count, total = [], None, "", bytearray(), [], 0, 0, 0

        def end_member() -> None:
            nonlocal member, names
            if member:
                zipped.add(f"archive/data-{names:05d}.warc.gz", bytes(member))
                member, names = bytearray(), names + 1

        def end_archive() -> None:
            nonlocal zipped, index, names, count, total
            if zipped:
                end_member()
                zipped.add("indexes/index.cdxj", "".join(index).encode())
                zipped.close()
                done.append((path, count, zipped.at))
                zipped, index, names, count, total = None, [], 0, 0, 0

        for batch in batches:
            for row in batch.to_pylist():
                if zipped is None:
                    path = f"{folder}/{uuid.uuid4().hex}.wacz"
                    zipped = ZipWriter(open_output(path), zip64)
                digest = base64.b32encode(row["sha1"]).decode()
                raw = warc_record(row["page_id"], row["url"], row["payload"], digest, row["refers_to"])
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                own = pack.compress(raw) + pack.flush()
                told = {"url": row["url"], "digest": f"sha1:{digest}", "filename": f"archive/data-{names:05d}.warc.gz",
                        "offset": len(member), "length": len(own)}
                index.append(f"{_line(row['url'] or 'urn:none').replace(' ', '%20')} 19800101000000 {json.dumps(told)}\n")
                member += own
                count, total = count + 1, total + len(own)
                if len(member) >= MEMBER_BYTES:
                    end_member()
                if total >= ARCHIVE_BYTES:
                    end_archive()
        end_archive()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()),
                                          pa.array([x[2] for x in done], pa.int64())], names=["path", "n_records", "n_bytes"])

    return materialize(d.mapInArrow(written, "path string, n_records long, n_bytes long"), "archives")


def read_archives(archives: DataFrame, parts: int | None = None) -> DataFrame:
    """Reads all records of the archives in column ``path`` through their
    indexes: page (the record's id, as text), url, record_type, payload_bytes,
    payload_digest, refers_to (a page, as text), payload (null for revisits).

    Every response's digest and length are computed anew and compared."""
    names = ["page", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_input(path) as f:
                    members = directory(f)
                    for name in sorted(x for x in members if x.startswith("indexes/")):
                        for line in member_bytes(f, members[name]).decode().splitlines():
                            told = json.loads(line.split(" ", 2)[2])
                            method, start, packed, _ = members[told["filename"]]
                            if method or told["offset"] + told["length"] > packed:
                                raise ValueError(f"{path}: {told['filename']} isn't stored or the index points beyond it")
                            f.seek(start + told["offset"])
                            got = parse_record(zlib.decompress(f.read(told["length"]), 31))
                            warc, body = got["warc"], got["payload"]
                            digest, length = warc["warc-payload-digest"].removeprefix("sha1:"), int(got["http"]["content-length"])
                            response = warc["warc-type"] == "response"
                            if response and (len(body) != length or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                                raise ValueError(f"{path}: payload of {warc['warc-record-id']} isn't what was written")
                            rows.append((page_of(warc["warc-record-id"]), warc["warc-target-uri"], warc["warc-type"], length,
                                         digest, page_of(warc.get("warc-refers-to")), body if response else None))
                            size += len(body)
                            if size > 8 << 20:
                                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                                rows, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    spread = archives.select("path").repartition(parts) if parts else archives.select("path")
    return spread.mapInArrow(read, "page string, url string, record_type string, payload_bytes long, payload_digest string, "
                                   "refers_to string, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Archives ``pages`` beside the checkpoints and reads them back."""
    listed = write_archives(pages, scratch_path(spark, f"warc-{uuid.uuid4().hex}"), **options)
    n = listed.count()
    return read_archives(listed, max(1, n))

"""WARC records in ZIP-packaged archives: writer, directory parser, range reader.

An archive is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``,
whose records are gzip members of their own, and ``indexes/index.cdxj``, one line per
record with its offset and length in the former. Each task writes archives of bounded
size under a name that its partition gives, first under a name of its attempt and then
renamed, so a repeated task replaces its own work and a lost one leaves nothing that
is read.

The reader works by ranges: the end record and the ZIP64 records at a file's tail, the
central directory, the local header of a stored member, the index, and then single
records; nothing is extracted. Files are reached through pyarrow's file systems.

Equal payloads. The response of a digest is its largest id: a map-side combined
maximum over (digest, length), joined back on ids and digests alone. Payloads are
written where they are read; they are not shuffled.

Defined results: null payload is empty; payloads under ``MIN_REVISIT`` bytes are all
responses; rows that repeat an id and payload each get a record (the repeated id is the
response for each of them); a null id is kept apart, never revisits nor is revisited.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize

MIN_REVISIT = 1000
#: MB of shared payloads' digests that may be broadcast; parts of a digest beyond that.
BROADCAST_MB = 32
SPLITS = 16
#: An archive is closed beyond so many bytes; a read batch holds so many records.
ARCHIVE_BYTES = 32 << 20
READ_RECORDS = 200
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"
_MAX32 = 0xFFFFFFFF


# ---- ZIP -------------------------------------------------------------------------


def _extra64(*values: int) -> bytes:
    return struct.pack("<HH", 1, 8 * len(values)) + b"".join(struct.pack("<Q", v) for v in values) if values else b""


class ZipWriter:
    """Stored members, streamed; ZIP64 wherever a value needs it (or always)."""

    def __init__(self, out, always64: bool = False):
        self.out, self.at, self.members, self.always64 = out, 0, [], always64

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes], size: int, crc: int) -> None:
        large = self.always64 or size >= _MAX32
        start, raw = self.at, name.encode()
        extra = _extra64(size, size) if large else b""
        shown = _MAX32 if large else size
        self.put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if large else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        for part in parts:
            self.put(part)
        self.members.append((raw, start, size, crc))

    def close(self) -> None:
        start = self.at
        for raw, at, size, crc in self.members:
            large, far = self.always64 or size >= _MAX32, self.always64 or at >= _MAX32
            extra = _extra64(*([size, size] if large else []), *([at] if far else []))
            shown = _MAX32 if large else size
            self.put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if far else at) + raw + extra)
        length, n = self.at - start, len(self.members)
        if self.always64 or start >= _MAX32 or length >= _MAX32 or n >= 0xFFFF:
            end = self.at
            self.put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, start))
            self.put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            self.put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, _MAX32, _MAX32, 0))
        else:
            self.put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, length, start, 0))


def read_range(file, at: int, length: int) -> bytes:
    file.seek(at)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"archive ends early: {len(data)} of {length} bytes at {at}")
    return data


def central_directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """Name to (place of the local header, stored size, method) of each member."""
    reach = min(size, 65557 + 20)
    tail = read_range(file, size - reach, reach)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("not a ZIP archive")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        place = struct.unpack_from("<Q", tail, end - 12)[0]
        head = read_range(file, place, 56)
        if head[:4] != b"PK\x06\x06":
            raise ValueError("damaged ZIP64 end record")
        n, length, start = struct.unpack_from("<QQQ", head, 32)
    data, at, found = read_range(file, start, length), 0, {}
    for _ in range(n):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", data, at + 10)
        stored, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
        local, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n_name].decode()
        extra, k = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, k)
            if tag == 1:
                values = [x[0] for x in struct.iter_unpack("<Q", extra[k + 4 : k + 4 + width // 8 * 8])]
                if full == _MAX32:
                    full = values.pop(0)
                if stored == _MAX32:
                    stored = values.pop(0)
                if local == _MAX32:
                    local = values.pop(0)
            k += 4 + width
        found[name] = (local, stored, method)
        at += 46 + n_name + n_extra + n_note
    return found


def member_start(file, entry: tuple[int, int, int]) -> int:
    """Where a stored member's bytes begin."""
    local, _, method = entry
    if method != 0:
        raise ValueError("only stored members can be read by range")
    head = read_range(file, local, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("damaged local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return local + 30 + n_name + n_extra


# ---- WARC ------------------------------------------------------------------------


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, n_payload: int, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own. A revisit has no block."""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", "".join(c if c > " " else "%20" for c in url or "about:blank")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Payload-Length", str(n_payload)),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n", 1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower-cased names) and block of one record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


class ArchiveWriter:
    """Collects records in memory up to ``limit`` bytes, then writes one archive."""

    def __init__(self, folder: str, name: str, limit: int = ARCHIVE_BYTES):
        self.files, self.folder = pafs.FileSystem.from_uri(folder)
        self.name, self.limit, self.count = name, limit, 0
        self.begin()

    def begin(self) -> None:
        self.parts, self.lines, self.size = [], [], 0

    def add(self, page_id: int | None, record: bytes) -> str | None:
        self.lines.append(json.dumps({"page": page_id, "offset": self.size, "length": len(record)}, separators=(",", ":")))
        self.parts.append(record)
        self.size += len(record)
        return self.close() if self.size >= self.limit else None

    def close(self) -> str | None:
        import zlib

        if not self.parts:
            return None
        crc = 0
        for part in self.parts:
            crc = zlib.crc32(part, crc)
        index = ("\n".join(self.lines) + "\n").encode()
        self.files.create_dir(self.folder, recursive=True)
        final = f"{self.folder}/{self.name}-{self.count:05d}.wacz"
        attempt = f"{self.folder}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(attempt, compression=None) as out:
            z = ZipWriter(out)
            z.member(DATA, iter(self.parts), self.size, crc)
            z.member(INDEX, iter([index]), len(index), zlib.crc32(index))
            z.close()
        self.files.move(attempt, final)
        self.count += 1
        self.begin()
        return final


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row; ``archive, n_records`` of each archive. The folder must be
    one that all executors share."""
    p = pages.select(F.col(page_id).cast("long").alias("_id"), F.col(url).cast("string").alias("_url"), F.col(html).cast("string").alias("_html"))
    payload = F.encode(F.coalesce("_html", F.lit("")), "UTF-8")
    large = p.where(F.octet_length("_html") >= MIN_REVISIT).where("_id is not null")
    keys = large.select("_id", F.unhex(F.sha1(payload)).alias("_digest"))
    newest = keys.groupBy("_digest").agg(F.max("_id").alias("_to"), F.min("_id").alias("_least")).where("_to != _least")
    newest = newest.select(F.col("_digest").alias("_nd"), "_to")
    newest = materialize(newest, "newest")
    # beyond a broadcast, a payload that very many pages share is dealt in SPLITS parts
    n_newest = newest.count()
    if n_newest * 64 <= BROADCAST_MB << 20:
        copies = keys.join(F.broadcast(newest), F.col("_digest") == F.col("_nd"))
    else:
        parts = newest.withColumn("_np", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
        copies = keys.join(parts, (F.col("_digest") == F.col("_nd")) & (F.pmod(F.xxhash64("_id"), F.lit(SPLITS)).cast("int") == F.col("_np")))
    revisits = copies.where("_id != _to").select(F.col("_id").alias("_ri"), F.col("_digest").alias("_rd"), "_to").distinct()
    p = p.withColumn("_digest", F.unhex(F.sha1(payload)))
    p = p.join(revisits, (F.col("_id") == F.col("_ri")) & (F.col("_digest") == F.col("_rd")), "left").select("_id", "_url", F.when(F.col("_to").isNull(), F.col("_html")).alias("_html"), F.coalesce(F.octet_length("_html"), F.lit(0)).cast("long").alias("_n"), F.hex("_digest").alias("_hex"), "_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ArchiveWriter(folder, f"part-{TaskContext.get().partitionId():06d}", archive_bytes)
        done, held = [], 0
        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                page, link, text, n, digest, to = (x.as_py() for x in row)
                data = (text or "").encode("utf-8", "surrogatepass")
                kind = "response" if to is None else "revisit"
                held += 1
                if name := out.add(page, record_bytes(kind, page, link, data, digest.lower(), n, to)):
                    done.append((name, held))
                    held = 0
        if name := out.close():
            done.append((name, held))
        yield pa.RecordBatch.from_pydict({"archive": [x[0] for x in done], "n_records": [x[1] for x in done]}, schema=pa.schema([("archive", pa.string()), ("n_records", pa.int64())]))

    return materialize(p.mapInArrow(write, "archive string, n_records long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload`` of
    each record of the archives named. A first step reads directories and
    indexes, a second one ranges of records, so records spread over all tasks."""
    parts = "archive string, at long, records array<struct<page: long, offset: long, length: long>>"

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("records", pa.list_(pa.struct([("page", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_file(path) as f:
                    members = central_directory(f, f.size())
                    index = read_range(f, member_start(f, members[INDEX]), members[INDEX][1])
                    start = member_start(f, members[DATA])
                records = [json.loads(line) for line in index.decode().splitlines()]
                for at in range(0, len(records), READ_RECORDS):
                    yield pa.RecordBatch.from_pylist([{"archive": path, "at": start, "records": records[at : at + READ_RECORDS]}], schema=schema)

    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.to_pylist():
                rows = []
                with files.open_input_file(part["archive"]) as f:
                    for x in part["records"]:
                        fields, block = parse_record(read_range(f, part["at"] + x["offset"], x["length"]))
                        digest, n = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["payload-length"])
                        if fields["warc-type"] == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != n):
                            raise ValueError(f"record {fields['warc-record-id']} differs from its digest")
                        rows.append((_page(fields["warc-record-id"]), n, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), fields["warc-target-uri"], block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    archives = archives.where("archive is not null").select("archive")
    located = archives.mapInArrow(locate, parts)
    return located.repartition(F.col("archive"), F.col("records")[0]["offset"]).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def package_and_read(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, page_id, url, html, archive_bytes), folder)

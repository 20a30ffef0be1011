"""Web archives packed in ZIP files, written and read back without extraction.

Every archive is a ZIP with two stored members: gzip-compressed WARC records one after another, and an index with the
place of each record. Directories carry ZIP64 fields, so that offsets above 4 GB work. The reader parses the end
record, the ZIP64 records and the central directory, finds the members by their local headers, and reads single
records by byte range. Files go through pyarrow's file systems into the folder that all executors share, under a name
of their own for every attempt; only files named in the manifest count, so a lost executor leaves nothing half-written
behind that is read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import shared_dir, written

RECORDS, INDEX = "archive/records.warc.gz", "indexes/records.idx"
ARCHIVE_BYTES = 16 << 20
REVISIT_BYTES = 100

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
END_SIZE, LOCATOR_SIZE = 22, 20

Reader = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


# --- writing ---------------------------------------------------------------------------------------------------------


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of stored members with ZIP64 sizes and offsets."""
    body, directory = bytearray(), bytearray()
    for name, data in members:
        at, crc, label = len(body), zlib.crc32(data), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        body += LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32, len(label), len(extra)) + label + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        directory += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32, len(label), len(extra), 0, 0, 0, 0, FULL32)
        directory += label + extra
    start, n = len(body), len(members)
    end64 = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), start)
    locator = LOCATOR64 + struct.pack("<IQI", 0, start + len(directory), 1)
    return bytes(body + directory + end64 + locator + END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def warc_record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip-compressed record; a revisit (``refers_to`` given) has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def page_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, refers_to (null: a response).

    Only ids and digests are grouped, so that a payload which very many pages share moves no pages; the verdict then
    meets the page by its id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("n_bytes"), F.sha2(payload, 256).alias("digest"))
    long = full.filter(F.col("n_bytes") >= least).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("refers_to").isNotNull())
    revisits = long.join(first, "digest").filter(F.coalesce(F.col("page_id") > F.col("refers_to"), F.lit(True))).select("page_id", "digest", "refers_to").distinct()
    verdict = revisits.toDF("revisit_id", "revisit_digest", "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest"))
    return full.join(verdict, same, "left").select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "n_bytes", "digest", "refers_to")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``records`` and return the manifest: path, n_records. A task holds one archive of about ``archive_bytes``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        body, index = bytearray(), []

        def flush() -> pa.RecordBatch:
            fs, base = _file_system(folder)
            name = f"{base}/{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{name}.part") as out:
                out.write(zip_bytes([(RECORDS, bytes(body)), (INDEX, "\n".join(index).encode())]))
            fs.move(f"{name}.part", name)
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([len(index)], pa.int64())], ["path", "n_records"])
            body.clear()
            index.clear()
            return row

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "n_bytes", "digest", "refers_to")]
            for page_id, url, payload, n_bytes, digest, refers_to in zip(*columns, strict=True):
                record = warc_record(page_id, url, payload or b"", n_bytes, digest, refers_to)
                index.append(f"{len(body)} {len(record)}")
                body += record
                if len(body) >= archive_bytes:
                    yield flush()
        if index:
            yield flush()

    fs, base = _file_system(folder)
    fs.create_dir(base, recursive=True)
    return records.mapInArrow(run, "path string, n_records long")


# --- reading ---------------------------------------------------------------------------------------------------------


def members(read: Reader, size: int) -> list[Member]:
    """The central directory of a ZIP of ``size`` bytes that ``read(offset, length)`` gives access to."""
    tail_at = max(0, size - END_SIZE - LOCATOR_SIZE - FULL16)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if (n == FULL16 or FULL32 in (length, start)) and end >= LOCATOR_SIZE and tail[end - LOCATOR_SIZE : end - LOCATOR_SIZE + 4] == LOCATOR64:
        (at,) = struct.unpack_from("<Q", tail, end - LOCATOR_SIZE + 8)
        record = read(at, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = read(start, length), 0, []
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        (method,) = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: in this order, those of the three that do not fit above
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            extra = extra[4 + width :]
        found.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return found


def member_start(read: Reader, member: Member) -> int:
    """Where the data of a stored member begins."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed")
    local = read(member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError("no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def parse_record(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of one compressed record."""
    head, _, block = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda s: None if s is None or s.endswith(":None>") else int(s.rsplit(":", 1)[1].rstrip(">"))
    http, _, body = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    row = {"page_id": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": None}
    if row["record_type"] == "revisit":
        return row | {"payload_bytes": int(said["Content-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:")}
    digest = hashlib.sha256(body).hexdigest()
    if fields["WARC-Payload-Digest"] != f"sha256:{digest}" or len(body) != int(said["Content-Length"]):
        raise ValueError(f"record of page {row['page_id']} is damaged")
    return row | {"payload": body, "payload_bytes": len(body), "payload_digest": digest}


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """One row per record of the archives at ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number, text = pa.int64(), pa.string()
        kinds = {"page_id": number, "payload_bytes": number, "payload_digest": text, "record_type": text, "refers_to": number} | ({"payload": pa.binary()} if payload else {})
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            fs, name = _file_system(path)
            with fs.open_input_file(name) as file:
                read = lambda at, n, f=file: f.read_at(n, at)
                by_name = {m.name: m for m in members(read, file.size())}
                start = member_start(read, by_name[RECORDS])
                index = read(member_start(read, by_name[INDEX]), by_name[INDEX].size).decode().split("\n")
                for k in range(0, len(index), 500):
                    found = [parse_record(read(start + at, n)) for at, n in (map(int, line.split()) for line in index[k : k + 500])]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kind) for c, kind in kinds.items()], list(kinds))

    return manifest.select("path").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` under the shared folder and read the records back, one row per page.

    Null html is an empty payload; payloads under 100 bytes, and the smallest page_id of equal longer ones, are
    responses, as are further rows of that very page_id; a null page_id revisits a known one. Null urls are left out of
    the record. An empty table writes no archive and gives no rows; further columns are ignored.
    """
    folder = f"{shared_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    return read_archives(written(write_archives(page_records(pages), folder)))

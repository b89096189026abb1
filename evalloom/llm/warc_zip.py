"""WARC archives packed in ZIP files: written by each task, read back by ranges without extraction."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, hot_lookup, materialize, shared_dir, slices

#: Records that one reading task takes.
RECORDS = 2000
ARCHIVE, INDEX = "records.warc.gz", "records.idx"
#: A line of the index: offset and length of a record in the archive member, at fixed width, so that line i is found by i alone.
_LINE = "{:020d} {:012d}\n"
_WIDTH = 34
#: The date of records whose pages have none; the same in every attempt of a task.
DATE = "1970-01-01T00:00:00Z"


# -- ZIP directories --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def read_range(file, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"the archive ends before byte {start + size}")
    return data


def directory(file, length: int) -> list[Member]:
    """Members of a ZIP file from its central directory; ZIP64 records are used where the plain fields are full."""
    tail_at = max(0, length - 65_557)
    tail = read_range(file, tail_at, length - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of a central directory: not a ZIP file")
        if at + 22 <= len(tail) and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") == len(tail):
            break
    count, size, start = struct.unpack("<HLL", tail[at + 10 : at + 20])
    end = tail_at + at
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        locator = read_range(file, end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        record = read_range(file, struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 record is missing")
        count, size, start = struct.unpack("<QQQ", record[32:56])
    data, at, out = read_range(file, start, size), 0, []
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", data[at + 8 : at + 12])
        packed, plain, n, extra_n, comment_n = struct.unpack("<LLHHH", data[at + 20 : at + 34])
        header = int.from_bytes(data[at + 42 : at + 46], "little")
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n : at + 46 + n + extra_n]
        while len(extra) >= 4:
            kind, k = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                # in this order, and only those whose plain field is full
                plain = wide.pop(0) if plain == 0xFFFFFFFF and wide else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF and wide else packed
                header = wide.pop(0) if header == 0xFFFFFFFF and wide else header
            extra = extra[4 + k :]
        out.append(Member(name, method, packed, header))
        at += 46 + n + extra_n + comment_n
    return out


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    head = read_range(file, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    n, extra = struct.unpack("<HH", head[26:30])
    return member.header + 30 + n + extra


# -- WARC records -----------------------------------------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page) -> str:
    return f"<urn:page:{page}>"


def record(page, url: str | None, payload: bytes, digest: str, revisit_of=None, revisit: bool = False, date: str = DATE) -> bytes:
    """One record, gzipped. A revisit has the HTTP head only, which still names the payload's length. Records without a key have
    an id by their URL and digest."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head.append(f"WARC-Record-ID: {_urn(page)}" if page is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if revisit_of is not None:
            head.append(f"WARC-Refers-To: {_urn(revisit_of)}")
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page, bytes of the full payload, its digest, record type, page referred to); a response's digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(_fields(http)["content-length"])
    if fields["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("the payload doesn't fit its digest")
    page, refers = (int(u[len("<urn:page:") : -1]) if (u := fields.get(k, "")).startswith("<urn:page:") else None for k in ("warc-record-id", "warc-refers-to"))
    return page, size, digest, fields["warc-type"], refers


def scan_archive(file, start: int, size: int, piece: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive member without an index, one gzip member after the other."""
    done, unpack, out = 0, zlib.decompressobj(31), []
    while done < size:
        data = read_range(file, start + done, min(piece, size - done))
        done += len(data)
        while data:
            out.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(out)
                unpack, out = zlib.decompressobj(31), []


# -- DataFrames -------------------------------------------------------------------------------------------------------


def write_archives(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", least: int = 0, date: str = DATE) -> DataFrame:
    """Write a record for each row; one ZIP file a task, in the shared folder. Returns ``path, n_records``, already written.

    Keys are integers, as records refer to each other by them. ``date`` is when the pages were fetched.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest key is a response (several rows that
    share that key all are), the others are revisits of it; null keys are never the largest. Null payloads are empty. A
    repeated task writes another file, and only the file of the task that counted is listed.
    """
    folder = shared_dir(df.sparkSession, "warc")
    rows = df.select(F.col(key).cast("bigint").alias("_page"), F.col(url).alias("_url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("_payload"))
    rows = rows.withColumn("_sha", F.sha1("_payload"))
    found = rows.groupBy("_sha").agg(F.max("_page").alias("_first"), F.count("*").alias("n_rows"), F.first(F.octet_length("_payload")).alias("_n"))
    shared = materialize(found.where(F.col("_n") >= least).where("n_rows > 1").select("_sha", "_first", "n_rows"), "payloads")
    total = shared.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    marked = hot_lookup(rows, shared, "_sha", total)

    def write(batches):
        out = None
        # payloads become objects about a megabyte at a time
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in slices(whole.column(2))):
            for page, url_, payload, sha, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.zip"
                    system, path = filesystem(uri)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(path)
                    archive = zipfile.ZipFile(_Tell(stream), "w", zipfile.ZIP_STORED, allowZip64=True)
                    out, index, at, n = archive.open(ARCHIVE, "w", force_zip64=True), io.BytesIO(), 0, 0
                revisit = first is not None and page != first
                raw = record(page, url_, payload, base64.b32encode(bytes.fromhex(sha)).decode(), first, revisit, date)
                out.write(raw)
                index.write(_LINE.format(at, len(raw)).encode())
                at, n = at + len(raw), n + 1
        if out is not None:
            out.close()
            archive.writestr(INDEX, index.getvalue())
            archive.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["path", "n_records"])

    return materialize(marked.select("_page", "_url", "_payload", "_sha", "_first").mapInArrow(write, "path string, n_records bigint"), "archives")


class _Tell:
    """A stream that zipfile takes for one that can't seek."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


def read_archives(archives: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to`` of every record in ZIP files (``path``, ``n_records``).

    A task takes ``RECORDS`` records: it reads the directory, its lines of the index and then each record by its range. An
    archive without an index is unpacked once, from its start to its end, by the task of its first records.
    """
    parts = archives.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_records") - 1, F.lit(RECORDS).cast("bigint"))).alias("start"), "n_records").where("n_records > 0")
    parts = parts.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    names = [key, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def rows_of(raws):
        rows = []
        for raw in raws:
            rows.append(parse(raw))
            if len(rows) == RECORDS:
                yield rows
                rows = []
        if rows:
            yield rows

    def read(batches):
        for batch in batches:
            for path, start, n in zip(*(c.to_pylist() for c in batch.columns)):
                system, local = filesystem(path)
                with system.open_input_file(local) as file:
                    members = {m.name: m for m in directory(file, file.size())}
                    data = data_start(file, members[ARCHIVE])
                    if INDEX in members:
                        count = min(RECORDS, n - start)
                        lines = read_range(file, data_start(file, members[INDEX]) + start * _WIDTH, count * _WIDTH)
                        ranges = [tuple(map(int, lines[i * _WIDTH : (i + 1) * _WIDTH].split())) for i in range(count)]
                        raws = (zlib.decompress(read_range(file, data + a, k), 31) for a, k in ranges)
                    else:
                        raws = scan_archive(file, data, members[ARCHIVE].size) if start == 0 else ()
                    for rows in rows_of(raws):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return parts.select("path", "start", "n_records").mapInArrow(read, f"`{key}` bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")

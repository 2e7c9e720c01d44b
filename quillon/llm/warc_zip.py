"""ZIP-packaged web archives: written by partition, and read by ranges without extraction.

A package has the stored (uncompressed) members archive/data.warc.gz, in which every record is a gzip member of its own,
and indexes/index.cdx, with the offset and length of each record. The reader takes the end of the file, follows the
end-of-central-directory record, or its ZIP64 form, to the central directory, finds where the stored members' data
begin from their local headers, reads the index, and fetches each record by its range.

Of records with equal payloads of at least MIN_BYTES bytes, that with the smallest page_id is a response and the others
are revisits, which have the response's headers but no payload.

Defined results: null html is an empty payload; a null url is an empty target; a null page_id is written as such, ranks
last and is read back as null; rows that repeat a page_id and payload are one record each, all responses if that
page_id is the smallest; an empty table gives no packages and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A package is closed once it has this many bytes, or this many records, whose index lines are held until then.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 200_000
#: Bytes fetched at a time when records follow one another.
READ_BYTES = 4 << 20
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record; refers_to makes it a revisit. The HTTP headers tell the payload's size in either case."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode(errors="replace").split("\r\n")[1:])}


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


class Package:
    """Reads a ZIP file by ranges; f is seekable."""

    def __init__(self, f):
        self.f = f
        f.seek(0, io.SEEK_END)
        self.size = f.tell()
        self.members: dict[str, tuple[int, int, int]] = {}  # method, local header's offset, stored size
        self._directory()

    def range(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        out = self.f.read(n)
        if len(out) < n:
            raise ValueError("the package is cut short")
        return out

    def _directory(self) -> None:
        n = min(self.size, 22 + 65_535)
        tail = self.range(self.size - n, n)
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no end of central directory")
        entries, size, start = struct.unpack_from("<HII", tail, at + 10)
        if entries == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
            place = self.size - n + at - 20
            sign, _, end64, _ = struct.unpack("<IIQI", self.range(place, 20))
            if sign == 0x07064B50:
                entries, size, start = struct.unpack_from("<QQQ", self.range(end64, 56), 32)
        raw, at = self.range(start, size), 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\1\2":
                raise ValueError("bad central directory")
            method, = struct.unpack_from("<H", raw, at + 10)
            packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
            local, = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
            x = at + 46 + n_name
            end = x + n_extra
            while x + 4 <= end:
                kind, k = struct.unpack_from("<HH", raw, x)
                if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                    y = x + 4
                    if whole == 0xFFFFFFFF:
                        y += 8
                    if packed == 0xFFFFFFFF:
                        packed, = struct.unpack_from("<Q", raw, y)
                        y += 8
                    if local == 0xFFFFFFFF:
                        local, = struct.unpack_from("<Q", raw, y)
                x += 4 + k
            self.members[name] = (method, local, packed)
            at = end + n_comment

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's data begin, and their size."""
        method, local, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed")
        head = self.range(local, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("bad local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n_name + n_extra, size

    def records(self) -> Iterator[bytes]:
        """Records in index order; neighbours are fetched together."""
        base, _ = self.stored(DATA)
        at, size = self.stored(INDEX)
        have, buffer = 0, b""
        for line in self.range(at, size).decode().splitlines():
            offset, n = map(int, line.split("\t")[:2])
            if not have <= offset or offset + n > have + len(buffer):
                end = self.stored(DATA)[1]
                have, buffer = offset, self.range(base + offset, min(max(n, READ_BYTES), end - offset))
            yield zlib.decompress(buffer[offset - have : offset - have + n], 31)


class _Writer:
    def __init__(self, folder: str):
        fs, base = common.filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.path = f"{folder}/{name}"
        self.out = fs.open_output_stream(f"{base}/{name}")
        self.zip = zipfile.ZipFile(_Forward(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> None:
        z = zlib.compressobj(3, zlib.DEFLATED, 31)
        packed = z.compress(record(page_id, url, payload, refers_to)) + z.flush()
        self.data.write(packed)
        self.lines.append(f"{self.at}\t{len(packed)}\t{'' if page_id is None else page_id}")
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


class _Forward(io.RawIOBase):
    """A stream that cannot seek, so that sizes follow the data and any store will do."""

    def __init__(self, out):
        self.out, self.n = out, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, b) -> int:
        self.out.write(bytes(b))
        self.n += len(b)
        return len(b)

    def flush(self) -> None:
        pass


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, int]] = []
        w = None
        for b in common.tables(batches):
            for page, url, payload, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                w = w or _Writer(folder)
                w.add(page, url or "", payload, refers)
                if w.at >= PACKAGE_BYTES or len(w.lines) >= PACKAGE_RECORDS:
                    made.append(w.close())
                    w = None
        if w:
            made.append(w.close())
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in made], pa.string()), "records": pa.array([n for _, n in made], pa.int64())})

    return run


def write(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write packages and return their paths, a row for each."""
    spark = pages.sparkSession
    common.arrow_rows(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    narrow = common.stored(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").alias("size")).where(f"size >= {int(min_bytes)}"), "payloads")
    groups = common.stored(narrow.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    again = common.with_group_winner(narrow.select("page_id", "sha1"), groups, "sha1", "copies", narrow.count()).where("first < coalesce(page_id, 9223372036854775807)")
    again = common.stored(again.select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "first").distinct(), "revisits")
    few = again.count() <= 50_000
    with_sum = rows.withColumn("s0", F.sha1(F.col("html").cast("binary")))
    on = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("s0") == F.col("s"))
    rows = with_sum.join(F.broadcast(again) if few else again, on, "left").select("page_id", "url", "html", F.col("first").alias("refers"))
    return common.stored(rows.mapInArrow(_write(folder), "path string, records long"), "packages")


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, p = common.filesystem(path)
                with fs.open_input_file(p) as f:
                    rows: list[tuple] = []
                    size = 0
                    for data in Package(f).records():
                        warc, http, payload = parse(data)
                        kind, refers = warc["warc-type"], warc.get("x-refers-to-page-id")
                        if kind == "response":
                            n, digest = len(payload), sha1_base32(payload)
                            if f"sha1:{digest}" != warc["warc-payload-digest"]:
                                raise ValueError(f"a payload in {path} is damaged")
                        else:
                            n, digest = int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
                        page = warc["x-page-id"]
                        rows.append((int(page) if page else None, warc["warc-target-uri"], n, digest, kind, int(refers) if refers else None, payload if with_payload and kind == "response" else None))
                        size += len(payload) if with_payload else 200
                        if size > 4 << 20:
                            yield emit(rows)
                            rows, size = [], 0
                    if rows:
                        yield emit(rows)

    return run


def read(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the packages; a package is one task."""
    spark = packages.sparkSession
    paths = [r["path"] for r in packages.select("path").collect()]  # a row per package
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, len(paths))).mapInArrow(_read(with_payload), RECORDS)

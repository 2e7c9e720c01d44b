"""Sorted-string-table shards of token ids, keyed by document.

File: data blocks, then the index block, the Bloom filter and a footer of fixed size. A data block holds records in key
order, each as (shared prefix length, rest of the key, value) with a whole key every RESTART records, and is compressed.
The index has each block's last key, offset, size and record count and is searched by bisection; the filter tells of
most absent keys without reading a block. The footer has the places of both, the record and token counts and a magic.

Keys: one byte 0 for null or 1, then the doc_id in eight bytes, big-endian with the sign flipped, so that byte order is
numeric order and nulls come first. Values: ids packed in two or four bytes.

Rows are dealt by ranges of (doc_id, hash of the text), so that a doc_id, null included, that many rows have fills several
shards and is held by no task; every record is written as it comes.

Defined results: a null or empty text is its end id alone; rows with equal doc_id are adjacent, in order of a hash of
their texts, and each is returned; an empty table gives no shard and no rows; other columns are ignored. A task that runs
again writes a file of its own, and only the file of the attempt that Spark accepted is in the manifest.
"""

from __future__ import annotations

import bisect
import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

MAGIC = b"QSSTABL2"
FOOTER = struct.Struct("<QQQQQQI4x8s")
BLOCK_BYTES = 1 << 16
RESTART = 16
BITS_PER_KEY, PROBES = 10, 7
MANIFEST = "part int, path string, first_key binary, last_key binary, n_docs long, n_tokens long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Streams sorted records to a file; memory holds one block, the index and eight bytes per key."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.press = zstandard.ZstdCompressor(level=1)
        self.block, self.in_block = bytearray(), 0
        self.last, self.first = b"", None
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.n = self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.first is not None and key < self.last:
            raise ValueError("keys must come in order")
        shared = 0
        if self.in_block % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.first = key if self.first is None else self.first
        if not self.n or key != self.last:
            self.keys.append(key)
        self.last = key
        self.n += 1
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.in_block:
            packed = self.press.compress(bytes(self.block))
            self.index.append((self.last, self.at, len(packed), self.in_block))
            self.out.write(packed)
            self.at += len(packed)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self.flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(s) + _varint(c) for k, o, s, c in self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 128 >> (p & 7)
        packed = struct.pack("<Q", bits) + bytes(bloom)
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.n, self.tokens, self.width, MAGIC))


class Reader:
    """Looks up keys in, or scans, one shard; f is seekable and read by ranges."""

    def __init__(self, f):
        self.f, self.press = f, zstandard.ZstdDecompressor()
        f.seek(0, io.SEEK_END)
        end = f.tell()
        if end < FOOTER.size:
            raise ValueError("not a shard")
        at, n_index, bloom_at, n_bloom, self.n, self.tokens, self.width, magic = FOOTER.unpack(self._range(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, i, self.index = self._range(at, n_index), 0, []
        while i < len(raw):
            n, i = _read_varint(raw, i)
            k, i = raw[i : i + n], i + n
            o, i = _read_varint(raw, i)
            s, i = _read_varint(raw, i)
            c, i = _read_varint(raw, i)
            self.index.append((k, o, s, c))
        self.lasts = [x[0] for x in self.index]
        bloom = self._range(bloom_at, n_bloom)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def _range(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, count = self.index[i]
        b, at, key = self.press.decompress(self._range(at, size)), 0, b""
        for _ in range(count):
            shared, at = _read_varint(b, at)
            rest, at = _read_varint(b, at)
            n, at = _read_varint(b, at)
            key = key[:shared] + b[at : at + rest]
            at += rest
            yield key, b[at : at + n]
            at += n

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] & (128 >> (p & 7)) for p in _probes(key, self.bits))

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key."""
        out: list[bytes] = []
        if self.may_have(key):
            i = bisect.bisect_left(self.lasts, key)
            while i < len(self.index):
                for k, v in self._block(i):
                    if k > key:
                        return out
                    if k == key:
                        out.append(v)
                i += 1
        return out

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)


def _write(folder: str, file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(file)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        fs, base = common.filesystem(folder)
        fs.create_dir(base, recursive=True)
        path = f"{base}/{uuid.uuid4().hex}.sst"
        w = out = None
        for b in common.merged(common.tables(batches), bpe.ROWS, bpe.BYTES):
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_column(b.column(1), end), strict=True):
                if w is None:
                    out = fs.open_output_stream(path)
                    w = Writer(out, width)
                w.add(key_of(doc), ids)
        if w is not None:
            w.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "first_key": [w.first], "last_key": [w.last], "n_docs": [w.n], "n_tokens": [w.tokens]})

    return run


def write(docs: DataFrame, folder: str, file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards in ascending doc_id order and return their manifest, a row per shard."""
    common.arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    return common.stored(rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").mapInArrow(_write(folder, file, end_id), MANIFEST), "manifest")


def _scan():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids, starts, values, width):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(v) // width for v in values], pa.int64()), pa.array([np.frombuffer(v, f"<u{width}").astype("<u4").tobytes() for v in values], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, p = common.filesystem(path)
                with fs.open_input_file(p) as f:
                    r = Reader(f)
                    ids, starts, values, size = [], [], [], 0
                    for k, v in r.scan():
                        ids.append(id_of(k))
                        starts.append(start)
                        values.append(v)
                        start += len(v) // r.width
                        size += len(v)
                        if size > 4 << 20:
                            yield emit(ids, starts, values, r.width)
                            ids, starts, values, size = [], [], [], 0
                    if ids:
                        yield emit(ids, starts, values, r.width)

    return run


def read(manifest: DataFrame) -> DataFrame:
    """All records of the shards: doc_id, start (ids of all documents before it), n_tokens, ids."""
    spark = manifest.sparkSession
    rows, start = [], 0
    for m in manifest.orderBy("part").collect():  # a row per shard; ranges are numbered in order
        rows.append((m["path"], start))
        start += m["n_tokens"]
    paths = spark.createDataFrame(rows, "path string, start long")
    return paths.repartition(max(1, len(rows)), "path").mapInArrow(_scan(), "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[bytes]]:
    """Point look-ups from the driver: bisect the manifest, then the shard's filter, index and one block."""
    rows = manifest.orderBy("part").collect()
    out: dict[int, list[bytes]] = {}
    for d in doc_ids:
        key, found = key_of(d), []
        for m in rows:
            if bytes(m["first_key"]) <= key <= bytes(m["last_key"]):
                fs, p = common.filesystem(m["path"])
                with fs.open_input_file(p) as f:
                    found += Reader(f).get(key)
        out[d] = found
    return out

"""Concatenate and cut: documents' ids, one after another, cut into windows of a fixed number of tokens.

Pass one encodes each document, writes its ids with the offset inside its partition, and sums the tokens of every
partition. Prefix sums over these totals give each partition its global offset. Pass two cuts every document at the
multiples of the window; a document that crosses a multiple gives a boundary piece on either side. Only the last
sequence can be short, and it alone is padded.

Defined results: a null or empty text is its end id alone; a null doc_id is kept as null; repeated rows are packed
once each; ties do not matter, as the order of documents is that of the input's partitions; an empty table gives no
pieces; other columns, whatever their names, are ignored. A very long text spans as many windows as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

ENCODED = "part int, local long, doc_id long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long, ids binary"


def _encode(file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local, enc = TaskContext.get().partitionId(), 0, bpe.encoder(file)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in common.merged(common.tables(batches), bpe.ROWS, bpe.BYTES):
            ids = enc.encode_column(b.column(1), end)
            n = np.array([len(x) for x in ids], np.int64) // enc.dtype.itemsize
            first = local + np.cumsum(n) - n
            local += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(first), b.column(0), pa.array(n), pa.array(ids, pa.binary())], ["part", "local", "doc_id", "n_tokens", "ids"])

    return run


def encoded(docs: DataFrame, file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: ids of every document, packed in two bytes each where the vocabulary allows, and local offsets."""
    common.arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.stored(rows.mapInArrow(_encode(file, end_id), ENCODED), "encoded")


def _cut(base: dict[int, int], total: int, window: int, width: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.tables(batches):
            rows: list[tuple] = []
            for part, local, doc, n, packed in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.frombuffer(packed, width).astype("<u4")
                at, done = base[part] + local, 0
                while done < n:
                    seq, offset = divmod(at + done, window)
                    k = min(n - done, window - offset)
                    piece = ids[done : done + k].tobytes()
                    last = (seq + 1) * window > total and at + done + k == total
                    rows.append((doc, done, k, zlib.crc32(piece), n, seq, offset, (seq + 1) * window - total if last else 0, piece if with_ids else None))
                    done += k
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:8]), pa.array(cols[8], pa.binary())], [f.split()[0] for f in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, file: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents; ids are little-endian unsigned 32-bit integers (null unless with_ids)."""
    if window < 1:
        raise ValueError("the window must hold a token")
    enc = bpe.encoder(file)
    rows = encoded(docs, file, end_id, id_col, text_col)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per partition
    base, total = {}, 0
    for r in totals:
        base[r["part"]] = total
        total += r["n"]
    return rows.mapInArrow(_cut(base, total, window, enc.dtype.str, with_ids), PIECES)

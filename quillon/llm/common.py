"""Shared folders, scratch tables, Arrow helpers and connected components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to a Python worker; long texts make larger batches a memory risk.
ARROW_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of our own only where none is set and driver and
    executors are one machine, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", given) if _settable(spark) else None
        _OWN[id(spark)] = _OWN.get(id(spark), given)
        given = _OWN[id(spark)]
    return given if urlparse(given).scheme else "file://" + given


_OWN: dict[int, str] = {}


def _settable(spark: SparkSession) -> bool:
    return spark.conf.isModifiable("spark.checkpoint.dir")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillon/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it again: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _scratch:
        _scratch[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that each running narrow() has stored.
_scratch: list[list[str]] = []


def narrow(f):
    """For an operator whose result is a few columns: the result is stored, and all other tables it stored are deleted."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        _scratch.append([])
        try:
            out = f(*args, **kwargs)
            paths = _scratch.pop()
        except BaseException:
            _scratch.pop()
            raise
        kept = stored(out, f.__name__.replace("_", "-"))
        for path in paths:
            deleted(out.sparkSession, path)
        return kept

    return run


def deleted(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by stored(), once nothing will read it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        deleted(df.sparkSession, path)


def arrow_rows(spark: SparkSession, n: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


#: What the operator that ran last has left in this worker for its next tasks, by name.
_remembered: dict[str, Any] = {}


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """What this worker holds under a name, made at first. A worker runs the tasks of many operators in turn and lives as
    long as they keep coming, so whatever it holds under other names goes first."""
    if name not in _remembered:
        forget()
        _remembered[name] = make()
    return _remembered[name]


def forget() -> None:
    """Let go of what other operators have left in this worker, and give its memory back to the system, where Python and
    Arrow would keep it. Operators that remember nothing begin with this."""
    if not _remembered:
        return
    _remembered.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path (file, hdfs, s3, gs, abfs), for the files that Spark has no format for."""
    return pafs.FileSystem.from_uri(uri if urlparse(uri).scheme else "file://" + uri)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of a string column in UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tables(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, large ones in slices, so that what is derived from one stays small."""
    for b in batches:
        k = max(1, -(-b.nbytes // max_bytes))
        step = max(1, -(-b.num_rows // k))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def merged(batches: Iterator[pa.RecordBatch], rows: int, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Several batches as one, up to about so many rows and bytes."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= rows or size >= max_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _is_one_of(keys: list[str], values: list) -> Column:
    """Whether a row's key is among some values: a filter, so that no row passes a join for it."""
    if not values:
        return F.lit(False)
    if len(keys) == 1:
        return F.col(keys[0]).isin([v[0] for v in values])
    return F.struct(*keys).isin([F.struct(*(F.lit(x).alias(k) for k, x in zip(keys, v, strict=True))) for v in values])


def with_group_winner(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Join each row to the one row of its group. Groups with over a thousandth of all rows number below a thousand, so
    their keys may be collected and they may be broadcast; the other groups' rows meet by a shuffle that no key can skew.
    Keys are never null."""
    keys = [key] if isinstance(key, str) else list(key)
    large = F.col(size) * 1000 > F.lit(total)
    found = groups.where(large).select(*keys).collect() if total else []  # below a thousand
    if not found:
        return rows.join(groups, keys)
    hot = _is_one_of(keys, found)
    return rows.where(hot).join(F.broadcast(groups.where(large)), keys).unionByName(rows.where(~hot).join(groups.where(~large), keys))


#: Names of files that may be broadcast (some MB).
FILES = 50_000
#: Below so many rows one task can hold a whole table, so that no key needs a place of its own.
ONE_TASK = 1_000_000


def spread_left(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """rows left join other, which has one row a key. Keys of over a thousandth of all rows meet theirs by broadcast."""
    total = rows.count()
    if total <= ONE_TASK:
        return rows.join(other, key, "left")
    found = rows.groupBy(key).count().where(F.col("count") * 1000 > F.lit(total)).select(key).collect()  # below a thousand
    if not found:
        return rows.join(other, key, "left")
    hot = _is_one_of([key], found)
    return rows.where(hot).join(F.broadcast(other.where(hot)), key, "left").unionByName(rows.where(~hot).join(other, key, "left"))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a number of its own for each row, the file's place among all files, then
    the row's in it. It comes from the files' metadata, so that every reading gives the same; other tables are stored
    first."""
    spark = docs.sparkSession
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        docs = stored(docs, "docs")
    used = {c.lower() for c in docs.columns}
    key = next(k for k in ("row_key" + "_" * i for i in range(len(used) + 1)) if not used & {k, f"{k}_file", f"{k}_at", f"{k}_place"})
    meta = docs.metadataColumn("_metadata")
    files = [r[0] for r in docs.select(meta["file_path"]).distinct().collect()]  # a row per file, as the driver's own listing
    places = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(files))], f"{key}_file string, {key}_place long")
    rows = docs.select("*", meta["file_path"].alias(f"{key}_file"), meta["row_index"].alias(f"{key}_at"))
    rows = rows.join(F.broadcast(places) if len(files) <= FILES else places, f"{key}_file")
    return rows.select(*docs.columns, (F.shiftleft(f"{key}_place", 36) + F.col(f"{key}_at")).alias(key)), key


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each connected component, for every node that has an edge.

    Every round hooks each node to its smallest neighbour, follows these pointers twice more and contracts the
    edges by them; long paths shrink by a constant factor. Nothing is gathered on the driver but a count."""
    e = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "hook")
        for _ in range(2):
            over = hook.select(F.col("node").alias("up"), F.col("up").alias("top")).where("up <> top")
            hook = stored(spread_left(hook, over, "up").select("node", F.coalesce("top", "up").alias("up")), "hook")
        maps.append(hook)
        old = e
        for side in ("a", "b"):
            e = spread_left(e.withColumnRenamed(side, "node"), hook, "node").drop("node").withColumnRenamed("up", side)
        e = stored(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        dropped(old)
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = maps[0].select("node", F.col("up").alias("label"))
    for m in maps[1:]:
        out = stored(spread_left(out, m.select(F.col("node").alias("label"), "up"), "label").select("node", F.coalesce("up", "label").alias("label")), "labels")
    return out

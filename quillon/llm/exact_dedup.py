"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index holds one entry a digest, from the batch that brought it first, in a Parquet table bucketed and sorted by
digest. A batch is reduced to one row a digest, anti-joined with the entries by a sort-merge join that moves no entry, and
what is left is appended. Rows of digests that were there already go to a second table of the same form, so that the
member that stays can be settled over all batches, again without moving the index. A batch counts only once its name is
among the commits, which are written last; what a failed call leaves behind is never read. The number of buckets follows
the rows that the index is made for and is kept with it.

dedup() enters documents in two batches, by the parity of a hash of their ids, and settles over both.

Defined results: null text counts as empty; all empty texts are one group; of equal texts the row with the most code
points in its original text and then the smallest id stays (null ids count as the largest); a repeated row with the
same id and text counts as another member, and every copy of the winning row carries kept = true only if its id is the
keeper's; with row_col, which tells rows apart, exactly one row of a group is kept; an empty table gives no rows; other
columns, whatever their names, are ignored. Very long texts are only hashed and measured.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters that do not count in the comparison of texts.
BLANKS = r"[\x20\x09-\x0D]"
#: Rows that a bucket is made for; and the fewest and most buckets.
ROWS_A_BUCKET, BUCKETS = 500_000, (16, 50_000)
COLUMNS = ("batch", "digest", "keep_id", "keep_row", "size", "members")


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary"), 256)


def digested(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    row = F.col(row_col) if row_col else F.lit(None)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("long").alias("row"), digest(F.col(text_col)).alias("digest"), F.coalesce(F.length(text_col), F.lit(0)).alias("size"))


def _best(size: str, doc_id: str, row: str) -> Column:
    """The order in which members stay: most code points, smallest id, nulls last, first row."""
    return F.struct((-F.col(size)).alias("less"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(row).alias("row"))


class DigestIndex:
    """A digest index at a path of the shared store. rows: how many it is made for, if it is new."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, rows: int = 0):
        self.spark, self.path = spark, path
        if not common.exists(spark, f"{path}/form"):
            n = buckets or min(max(rows // ROWS_A_BUCKET, BUCKETS[0]), BUCKETS[1])
            spark.range(1).select(F.lit(n).alias("buckets")).write.mode("overwrite").parquet(f"{path}/form")
        self.buckets = spark.read.parquet(f"{path}/form").first()["buckets"]
        name = uuid.uuid4().hex
        self.tables = {kind: f"quillon_{kind}_{name}" for kind in ("entries", "revisions")}
        for kind, table in self.tables.items():
            spark.sql(f"CREATE TABLE {table} (batch STRING, digest STRING, keep_id BIGINT, keep_row BIGINT, size INT, members BIGINT) USING parquet OPTIONS (path '{path}/{kind}', compression 'zstd') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def _committed(self) -> list[str]:
        path = f"{self.path}/commits"
        return [r["batch"] for r in self.spark.read.parquet(path).distinct().collect()] if common.exists(self.spark, path) else []  # a row per batch

    def rows(self, kind: str = "entries") -> DataFrame:
        self.spark.catalog.refreshTable(self.tables[kind])
        return self.spark.table(self.tables[kind]).where(F.col("batch").isin(self._committed()))

    def _append(self, kind: str, rows: DataFrame, batch: str) -> None:
        out = rows.withColumn("batch", F.lit(batch)).select(*COLUMNS).repartition(self.buckets, "digest")
        out.write.mode("append").format("parquet").option("compression", "zstd").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.tables[kind])

    def enter(self, narrow: DataFrame) -> DataFrame:
        """Enter digested rows as a batch; (digest, keep_id, keep_row, size, members, entered, known) of its digests:
        entered is the id that the index had, known tells that it had the digest."""
        groups = narrow.groupBy("digest").agg(F.min(_best("size", "doc_id", "row")).alias("b"), F.count("*").alias("members"))
        groups = common.stored(groups.select("digest", F.col("b.id").alias("keep_id"), F.col("b.row").alias("keep_row"), (-F.col("b.less")).alias("size"), "members"), "groups")
        before = self.rows().select("digest", F.col("keep_id").alias("entered"), F.lit(True).alias("known"))
        fresh = groups.join(before.hint("merge"), "digest", "left_anti")
        judged = common.stored(groups.join(before.hint("merge"), "digest", "left").withColumn("known", F.coalesce("known", F.lit(False))), "judged")
        batch = uuid.uuid4().hex
        self._append("entries", fresh, batch)
        self._append("revisions", judged.where("known"), batch)
        self.spark.range(1).select(F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.path}/commits")
        return judged

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Judge docs against the index and themselves, append what is new, and return (doc_id, digest, keep_id,
        group_size, kept, known): known says that the digest was in the index before; then keep_id is the id that it
        was entered with and no row of this call is kept."""
        narrow = common.stored(digested(docs, id_col, text_col), "digests")
        judged = self.enter(narrow).select("digest", F.when(F.col("known"), F.col("entered")).otherwise(F.col("keep_id")).alias("keep_id"), F.col("members").alias("group_size"), "known")
        out = common.with_group_winner(narrow.select("doc_id", "digest"), judged, "digest", "group_size", narrow.count())
        return out.select("doc_id", "digest", "keep_id", "group_size", (~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "known")

    def keepers(self) -> DataFrame:
        """(digest, keep_id, keep_row, group_size): what stays of all members that were ever entered."""
        later = self.rows("revisions").groupBy("digest").agg(F.min(_best("size", "keep_id", "keep_row")).alias("later"), F.sum("members").alias("more"))
        r = self.rows().hint("merge").join(later.hint("merge"), "digest", "left").withColumn("b", F.least(_best("size", "keep_id", "keep_row"), F.col("later")))
        return r.select("digest", F.col("b.id").alias("keep_id"), F.col("b.row").alias("keep_row"), (F.col("members") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def close(self) -> None:
        """Forget the tables' names; the files stay."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


@common.narrow
def _verdicts(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    narrow = common.stored(digested(docs, id_col, text_col, row_col).withColumn("part", part), "digests")
    for k in range(2):
        index.enter(narrow.where(F.col("part") == k))
    out = common.with_group_winner(narrow, common.stored(index.keepers(), "keepers"), "digest", "group_size", narrow.count())
    kept = F.col("row").eqNullSafe(F.col("keep_row")) if row_col else F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", *(["row"] if row_col else []), "digest", "keep_id", "group_size", kept.alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, buckets: int | None = None, row_col: str | None = None) -> DataFrame:
    """One verdict per row of docs, over all that the index at path holds then; by default that is a new index."""
    spark = docs.sparkSession
    at = path or common.new_path(spark, "digest-index")
    index = DigestIndex(spark, at, buckets, docs.count())
    try:
        return _verdicts(docs, index, id_col, text_col, row_col)
    finally:
        index.close()
        if path is None:
            common.deleted(spark, at)

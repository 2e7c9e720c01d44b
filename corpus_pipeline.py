"""A cleaning pipeline over documents: toxicity, exact and near duplicates, benchmark passages, packing.

Every stage takes the documents that the one before kept and all but the last return the columns of documents. Rows are
dropped one at a time: the stages that compare rows give each a key of its own first (its place in the files), so that
neither a null nor a repeated doc_id drops or keeps another row.

Defined results of a stage, for nulls in any column: a null text counts as empty; it is not toxic, one of all empty texts
stays after exact dedup, it has no near copies, holds no leak and is packed as its end id. Of equal texts the row with
the most code points, then the smallest doc_id (null last), then the first row stays; of near copies the first row. Ties
do not occur beyond that. Repeated rows are copies, of which one stays. An empty table gives no rows. Further columns
pass through all but the last stage, whatever their names. Very long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, exact_dedup, minhash, packing, semantic_search, toxicity
from quillon.llm.queries import table, vocabulary

#: Dropped rows up to this many are broadcast (a few MB); more meet the documents by a shuffle.
FEW = 200_000
#: Near copies share so many per cent of their shingles at least; op7 asks for 85 instead.
NEAR = 80


def _without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose key is not among the dropped ones."""
    keys = common.stored(dropped.select(F.col(dropped.columns[0]).alias(key)), "dropped")
    return docs.join(F.broadcast(keys) if keys.count() <= FEW else keys, key, "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = common.keyed(docs)
    return _without(rows, key, exact_dedup.dedup(rows, row_col=key).where("NOT kept").select("row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = common.keyed(docs)
    return _without(rows, key, minhash.near_duplicates(rows, percent=NEAR, id_col=key).where("NOT kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = common.keyed(docs)
    return _without(rows, key, semantic_search.search(rows, table(spark, sf_dir, "benchmark"), id_col=key).where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(), 1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL cannot express the stages that learn or tokenise; run() is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

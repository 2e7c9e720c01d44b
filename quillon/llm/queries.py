"""The queries of these operators, one for each, over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_dedup, lattice_lm, minhash, packing, semantic_search, sharding, sstable, toxicity, url_filter, warc_zip

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc_zip.write(table(spark, sf_dir, "pages"), common.new_path(spark, "wacz"))
    return warc_zip.read(packages, with_payload=False).drop("payload", "url")


def op4_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), 1024, with_ids=False).drop("ids")


def op5_latent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Verdict, host and path of each rule.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op6_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("n_confirmed")


def op8_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_lookup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.place(docs.select("doc_id"), "doc_id", [f"shard-{i:04d}" for i in range(256)])


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write(table(spark, sf_dir, "documents"), common.new_path(spark, "sstable"), vocabulary())
    return sstable.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_lattice_lm": op2_lattice_lm,
    "op3_warc_zip": op3_warc_zip,
    "op4_concat_and_cut": op4_concat_and_cut,
    "op5_latent_search": op5_latent_search,
    "op6_path_templates": op6_path_templates,
    "op7_circulant_minhash": op7_circulant_minhash,
    "op8_digest_index": op8_digest_index,
    "op9_lookup_table": op9_lookup_table,
    "op10_sstable": op10_sstable,
}

ORACLE_SQL: dict[str, str] = {
    "op7_circulant_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
              FROM w WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
        l AS (SELECT a AS doc_id, count(*) AS k FROM e GROUP BY a)
        SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
        FROM c LEFT JOIN n USING (doc_id)""",
    "op8_digest_index": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}

"""Sinks of chunks, documents and header trees."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

RECORD = ("text", "start_page", "end_page", "start_line")


def records(chunks: DataFrame, remove_links: bool = False) -> DataFrame:
    """doc_id and the exported fields of each chunk."""
    text = T.squeeze(T.remove_links(F.col("text"))) if remove_links else F.col("text")
    return chunks.select("doc_id", text.alias("text"), "start_page", "end_page", "start_line")


def save_chunks(chunks: DataFrame, path: str, remove_links: bool = False) -> None:
    """JSON lines, one chunk a line."""
    records(chunks, remove_links).write.mode("overwrite").json(path, ignoreNullFields=False)


def save_one(chunks: DataFrame, path: str, remove_links: bool = False) -> None:
    """A JSON list in one local file, for the chunks of one document."""
    if not path.endswith(".json"):
        raise ValueError("chunks are saved to a .json file")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    rows = [{k: r[k] for k in RECORD} for r in records(chunks, remove_links).orderBy("doc_id", "start_line").toLocalIterator()]
    with open(path, "w", encoding="utf8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=4)


def save_markdown(lines: DataFrame, path: str) -> None:
    """A text file per partition of documents' markdown."""
    docs = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_idx", "text"))).alias("l"))
    docs.select(T.join_lines(F.transform("l", lambda x: x["text"])).alias("value")).write.mode("overwrite").text(path)


def envelope_parts(chunks: DataFrame) -> DataFrame:
    """doc_id and has_part: the chunks of a document as parts of its envelope, with positions."""
    part = F.struct("start_line", "text", "start_page", "end_page")
    got = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    one = lambda c, i: F.struct(F.lit("DocumentChunk").alias("type"), c["text"].alias("text"), i.alias("position"), c["start_page"].alias("page_start"), c["end_page"].alias("page_end"))
    return got.select("doc_id", F.transform("p", one).alias("has_part"))


def envelope_json(envelope: Column, parts: Column) -> Column:
    """The envelope with its parts replaced, in snake case."""
    names = {"@type": "type", "@context": "context", "identifier": "identifier", "name": "name", "url": "url", "fileFormat": "file_format", "dateCreated": "date_created", "dateModified": "date_modified", "keywords": "keywords"}
    return F.to_json(F.struct(*(envelope[k].alias(v) for k, v in names.items()), parts.alias("has_part")), {"ignoreNullFields": "false"})


def tree_json(tree: DataFrame, max_level: int = 6) -> DataFrame:
    """doc_id and its header tree as nested JSON, built from the deepest level up."""
    node = None
    for level in range(max_level, 0, -1):
        own = tree.where(F.col("level") == level).select("doc_id", "section_id", "parent_id", F.to_json(F.struct(F.col("section_id").alias("id"), "title")).alias("own"))
        if node is not None:
            kids = node.groupBy("doc_id", F.col("parent_id").alias("section_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_id", "json"))), lambda x: x["json"]), ",").alias("kids"))
            own = own.join(kids, ["doc_id", "section_id"], "left")
            rest = node.join(own.select("doc_id", F.col("section_id").alias("parent_id")), ["doc_id", "parent_id"], "left_anti").select("doc_id", "section_id", "parent_id", "json")
        else:
            own, rest = own.withColumn("kids", F.lit(None).cast("string")), None
        json_ = F.concat(F.expr("substring(own, 1, length(own) - 1)"), F.lit(',"children":['), F.coalesce("kids", F.lit("")), F.lit("]}"))
        own = own.select("doc_id", "section_id", "parent_id", json_.alias("json"))
        node = own if rest is None else own.unionByName(rest)
    return node.where("parent_id = -1").groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_id", "json"))), lambda x: x["json"]), ","), F.lit("]")).alias("tree"))

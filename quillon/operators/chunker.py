"""Header-aware chunks of markdown.

Lines carry window values that share one exchange on doc_id: the active header of each level, its subtree's word count,
and so the section that owns the line. A section whose subtree fits the soft limit is one chunk; a larger one gives its
own content and lets its children decide. Chunks over the hard word limit, and over the token limit, are cut by folds
over their lines; short chunks go last.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LINE = "struct<line_idx:int,text:string,in_code:boolean,page:int>"
LEVELS = 6


def lines(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md") -> DataFrame:
    """doc_id, line_idx, text, in_code and what kind of line it is."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(md_col).alias("md")).where("md IS NOT NULL")
    rows = rows.select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("line_idx", "raw"))
    rows = T.with_normal_line(rows, "raw", "text")
    w = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, 0)
    fences = F.sum(T.is_fence(F.col("raw")).cast("int")).over(w)
    rows = rows.withColumn("in_code", (F.col("raw") == "```") | (fences % 2 == 1))
    return with_kinds(rows.drop("raw").withColumn("page", F.lit(None).cast("int")))


def with_kinds(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("is_header", T.is_header(F.col("text"), F.col("in_code")))
    rows = rows.withColumn("level", F.when(F.col("is_header"), T.header_level(F.col("text"))))
    return rows.withColumn("is_bullet", T.is_bullet(F.col("text"))).withColumn("in_table", T.in_table(F.col("text"))).withColumn("n_words", T.blank_word_count(F.col("text")))


def _highest(cols: list[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def sections(rows: DataFrame, max_level: int = 4) -> DataFrame:
    """Lines with their place in the header tree: is_node; open_1.. (the active header of each level, as idx, text and
    subtree words, null once a higher header came); total (words of the document)."""
    if not 1 <= max_level <= LEVELS:
        raise ValueError("headers have levels 1 to 6")
    w = Window.partitionBy("doc_id").orderBy("line_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("doc_id").orderBy(F.desc("line_idx")).rowsBetween(Window.unboundedPreceding, -1)  # the lines that follow, nearest last
    rows = rows.withColumn("is_node", F.col("is_header") & (F.col("level") <= max_level))
    rows = rows.withColumn("before", F.sum("n_words").over(upto) - F.col("n_words")).withColumn("total", F.sum("n_words").over(Window.partitionBy("doc_id")))
    next_node = F.struct("before", "line_idx")
    rows = rows.select("*", *(F.last(F.when(F.col("is_node") & (F.col("level") <= k), next_node), True).over(below).alias(f"next_{k}") for k in range(1, max_level + 1)))
    end, stop = F.lit(None), F.lit(None)
    for k in range(1, max_level + 1):
        end, stop = F.when(F.col("level") == k, F.col(f"next_{k}.before")).otherwise(end), F.when(F.col("level") == k, F.col(f"next_{k}.line_idx")).otherwise(stop)
    words = F.coalesce(end, F.col("total")) - F.col("before")
    node = F.struct(F.col("line_idx").alias("idx"), F.col("text").alias("text"), words.alias("words"), stop.alias("stop"))
    rows = rows.select("*", *(F.last(F.when(F.col("is_node") & (F.col("level") == k), node), True).over(upto).alias(f"last_{k}") for k in range(1, max_level + 1)))
    for k in range(1, max_level + 1):
        higher = [F.coalesce(F.col(f"last_{j}.idx"), F.lit(-1)) for j in range(1, k)]
        alive = F.col(f"last_{k}.idx") > _highest(higher) if higher else F.lit(True)
        rows = rows.withColumn(f"open_{k}", F.when(alive, F.col(f"last_{k}")))
    return rows.drop(*(f"{a}_{k}" for a in ("next", "last") for k in range(1, max_level + 1)))


def tree(rows: DataFrame, max_level: int = 4) -> DataFrame:
    """The header tree as rows: doc_id, section_id (title's line), parent_id (-1: root), level, title, end_idx,
    subtree_words, ancestors (titles, outermost first)."""
    r = sections(rows, max_level).where("is_node")
    opened = F.filter(F.array(*(F.col(f"open_{k}") for k in range(1, max_level + 1))), lambda x: x.isNotNull())
    own = F.element_at(opened, -1)
    up = F.filter(opened, lambda x: x["idx"] < F.col("line_idx"))
    return r.select("doc_id", F.col("line_idx").alias("section_id"), F.coalesce(F.try_element_at(up, F.lit(-1))["idx"], F.lit(-1)).alias("parent_id"), "level", F.col("text").alias("title"), own["stop"].alias("end_idx"), own["words"].cast("long").alias("subtree_words"), F.transform(up, lambda x: x["text"]).alias("ancestors"))


def title_by_id(nodes: DataFrame, doc_id: int, section_id: int) -> DataFrame:
    """The node of a tree with that id: one row or none."""
    return nodes.where((F.col("doc_id") == doc_id) & (F.col("section_id") == section_id))


def add_child(nodes: DataFrame, doc_id: int, parent_id: int, section_id: int, title: str, level: int, words: int = 0) -> DataFrame:
    """The tree with one more node below parent_id (-1: the root). Subtree words of all nodes above it grow."""
    spark = nodes.sparkSession
    up = title_by_id(nodes, doc_id, parent_id).select(F.concat("ancestors", F.array("title")).alias("ancestors"), F.lit(1).alias("k"))
    own = spark.createDataFrame([(doc_id, section_id, parent_id, level, title, None, words)], "doc_id long, section_id int, parent_id int, level int, title string, end_idx int, subtree_words long")
    own = own.withColumn("k", F.lit(1)).join(F.broadcast(up), "k", "left").withColumn("ancestors", F.coalesce("ancestors", F.array().cast("array<string>")))
    path, at = set(), parent_id
    while at >= 0:  # a header tree has six levels at most
        row = title_by_id(nodes, doc_id, at).first()
        if row is None:
            raise ValueError(f"document {doc_id} has no section {at}")
        path.add(at)
        at = row["parent_id"]
    above = (F.col("doc_id") == doc_id) & F.col("section_id").isin(path)
    grown = nodes.withColumn("subtree_words", F.when(above, F.col("subtree_words") + words).otherwise(F.col("subtree_words")))
    return grown.unionByName(own.select([F.col(c).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns]))


def section_texts(rows: DataFrame, max_level: int = 4, content_only: bool = False) -> DataFrame:
    """(doc_id, section_id, text): a section's own lines up to the next header, after its title and a blank line."""
    r = sections(rows, max_level)
    opened = F.filter(F.array(*(F.col(f"open_{k}") for k in range(1, max_level + 1))), lambda x: x.isNotNull())
    r = r.withColumn("section_id", F.coalesce(F.try_element_at(opened, F.lit(-1))["idx"], F.lit(-1)))
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_node"), F.struct("line_idx", "text")))), lambda x: x["text"]), "\n")
    g = r.groupBy("doc_id", "section_id").agg(F.first(F.when(F.col("is_node"), F.col("text")), True).alias("title"), own.alias("content"))
    head = F.lit("") if content_only else F.when(F.col("title").isNotNull(), F.concat("title", F.lit("\n\n"))).otherwise("")
    return g.select("doc_id", "section_id", T.strip(F.concat(head, "content")).alias("text"))


def soft_chunks(rows: DataFrame, soft: int = 200, max_level: int = 4) -> DataFrame:
    """doc_id, start_line, headers and content (arrays of lines), by the soft limit alone."""
    r = sections(rows, max_level)
    opened = F.filter(F.array(*(F.col(f"open_{k}") for k in range(1, max_level + 1))), lambda x: x.isNotNull())
    r = r.withColumn("opened", opened)
    fits = F.get(F.filter("opened", lambda x: x["words"] <= soft), F.lit(0))
    deepest = F.try_element_at(F.col("opened"), F.lit(-1))
    r = r.withColumn("owner", F.when(F.col("total") <= soft, F.lit(-1)).otherwise(F.coalesce(fits["idx"], deepest["idx"], F.lit(-1))))
    r = r.withColumn("whole", (F.col("total") <= soft) | fits.isNotNull())
    r = r.withColumn("headers", F.filter("opened", lambda x: F.when(F.col("whole"), x["idx"] < F.col("owner")).otherwise(x["idx"] <= F.col("owner"))))
    r = r.where("whole OR NOT is_node")
    line = F.struct("line_idx", "text", "in_code", "page").cast(LINE)
    got = r.groupBy("doc_id", "owner").agg(F.sort_array(F.collect_list(line)).alias("content"), F.first("headers").alias("headers"), F.first("whole").alias("whole"), F.max(F.col("text") != "").alias("any"))
    as_line = F.transform("headers", lambda h: F.struct(h["idx"].alias("line_idx"), h["text"].alias("text"), F.lit(False).alias("in_code"), F.lit(None).cast("int").alias("page")).cast(LINE))
    return got.where("whole OR any").select("doc_id", F.col("owner").alias("start_line"), as_line.alias("headers"), "content")


def content_text(content: Column) -> Column:
    return F.array_join(F.transform(content, lambda x: x["text"]), "\n")


def chunk_text(headers: Column, content: Column, remove_links: bool = False, prepend_headers: bool = True) -> Column:
    body = content_text(content)
    if prepend_headers:
        head = F.array_join(F.transform(headers, lambda x: x["text"]), "\n\n")
        body = F.concat(F.when(F.size(headers) > 0, F.concat(head, F.lit("\n\n"))).otherwise(F.lit("")), body)
    return T.squeeze(T.remove_links(body) if remove_links else body)


def chunk_words(content: Column) -> Column:
    return T.word_count(T.squeeze(content_text(content)))


def hard_chunks(chunks: DataFrame, hard: int = 400) -> DataFrame:
    """Cut chunks of hard words or more at plain lines; headers, bullets, code and tables are never cut after."""
    if hard < 1:
        raise ValueError("the hard limit must be positive")
    r = chunks.withColumn("wc", chunk_words(F.col("content")))
    size = F.floor(F.col("wc") / (F.floor(F.col("wc") / hard) + 1))
    r = r.withColumn("limit", size.cast("int"))
    none = F.array(*[F.lit(-1)] * (LEVELS + 1))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("from"), F.lit(0).alias("at"), none.alias("seen"), none.alias("snap"), F.array().cast("array<struct<a:int,b:int,h:array<int>>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        text = line["text"]
        header = T.is_header(text, line["in_code"])
        level = T.header_level(text)
        n = acc["n"] + T.blank_word_count(text)
        seen = F.when(header, F.transform(acc["seen"], lambda x, i: F.when(i > level, -1).when(i == level, acc["at"]).otherwise(x))).otherwise(acc["seen"])
        cut = ~header & ~T.is_bullet(text) & ~line["in_code"] & ~T.in_table(text) & (n > F.col("limit"))
        piece = F.struct(acc["from"].alias("a"), (acc["at"] + 1).alias("b"), acc["snap"].alias("h"))
        return F.struct(F.when(cut, 0).otherwise(n).alias("n"), F.when(cut, acc["at"] + 1).otherwise(acc["from"]).alias("from"), (acc["at"] + 1).alias("at"), seen.alias("seen"), F.when(cut, seen).otherwise(acc["snap"]).alias("snap"), F.when(cut, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["from"].alias("a"), acc["at"].alias("b"), acc["seen"].alias("h"))
        return F.when(acc["from"] < acc["at"], F.concat(acc["out"], F.array(rest))).otherwise(acc["out"])

    whole = F.array(F.struct(F.lit(0).alias("a"), F.size("content").alias("b"), none.alias("h")))
    pieces = F.when(F.col("wc") < hard, whole).otherwise(F.aggregate("content", start, step, finish))
    r = r.withColumn("whole", F.col("wc") < hard).withColumn("piece", F.explode(pieces))
    extra = F.transform(F.filter("piece.h", lambda x: x >= 0), lambda x: F.get("content", x))
    content = F.slice("content", F.col("piece.a") + 1, F.col("piece.b") - F.col("piece.a"))
    r = r.select("doc_id", F.col("start_line").alias("s"), F.concat("headers", extra).alias("headers"), content.alias("content"), "whole")
    return r.select("doc_id", F.when(F.col("whole"), F.col("s")).otherwise(F.get("content", F.lit(0))["line_idx"]).alias("start_line"), "headers", "content")


def counter(tokenizer: Any | None) -> Callable[[Column], Column]:
    """Token counts of an array of strings: by blank-separated words, or by an object with encode()."""
    if tokenizer is None:
        return lambda texts: F.transform(texts, T.blank_word_count)
    if not hasattr(tokenizer, "encode"):
        raise ValueError("a tokenizer needs an encode method that turns a string into a list of tokens")

    @F.pandas_udf("array<int>")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: [len(tokenizer.encode(t)) for t in ts])

    return count


def token_chunks(chunks: DataFrame, limit: int | None, tokenizer: Any | None = None) -> DataFrame:
    """Cut chunks of limit tokens or more at lines, and lines over the limit at equal numbers of characters."""
    if limit is None:
        return chunks
    if limit < 1:
        raise ValueError("the token limit must be positive")
    count = counter(tokenizer)
    head = F.array_join(F.transform("headers", lambda x: x["text"]), "\n\n")
    texts = F.concat(F.array(chunk_text(F.col("headers"), F.col("content")), head), F.transform("content", lambda x: F.concat(x["text"], F.lit("\n"))))
    r = chunks.withColumn("t", count(texts))
    total, first = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    per = F.floor(total / (F.floor(total / limit) + 1)).cast("int")
    r = r.withColumn("total", total).withColumn("first", first).withColumn("per", per).withColumn("t", F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0))))
    kind = "array<struct<a:int,b:int,i:int,n:int>>"
    start = F.struct(F.col("first").alias("n"), F.lit(-1).alias("from"), F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def piece(a: Column, b: Column, i: Column | int = 0, n: Column | int = 1) -> Column:
        i, n = (F.lit(x) if isinstance(x, int) else x for x in (i, n))
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), i.cast("int").alias("i"), n.cast("int").alias("n"))

    def step(acc: Column, t: Column) -> Column:
        at, held = acc["at"], acc["from"] >= 0
        flushed = F.when(held, F.concat(acc["out"], F.array(piece(acc["from"], at)))).otherwise(acc["out"])
        n = F.floor(t / limit).cast("int") + 1
        slices = F.transform(F.sequence(F.lit(0), n - 1), lambda i: piece(at, at + 1, i, n))
        over = t > limit
        cut = (acc["n"] + t > F.col("per")) & held
        return F.struct(
            F.when(over, acc["n"]).when(cut, F.col("first") + t).otherwise(acc["n"] + t).alias("n"),
            F.when(over, -1).when(cut | ~held, at).otherwise(acc["from"]).alias("from"),
            (at + 1).alias("at"),
            F.when(over, F.concat(flushed, slices)).when(cut, flushed).otherwise(acc["out"]).alias("out"),
        )

    finish = lambda acc: F.when(acc["from"] >= 0, F.concat(acc["out"], F.array(piece(acc["from"], acc["at"])))).otherwise(acc["out"])
    whole = F.array(piece(F.lit(0), F.size("content")))
    r = r.withColumn("whole", F.col("total") < limit)
    r = r.withColumn("piece", F.explode(F.when(F.col("whole"), whole).otherwise(F.aggregate("t", start, step, finish))))
    part = F.slice("content", F.col("piece.a") + 1, F.col("piece.b") - F.col("piece.a"))
    wide = F.floor(F.length(F.get(part, F.lit(0))["text"]) / F.col("piece.n")) + 1
    sliced = F.transform(part, lambda x: F.struct(x["line_idx"].alias("line_idx"), F.substring(x["text"], (F.col("piece.i") * wide + 1).cast("int"), wide.cast("int")).alias("text"), x["in_code"].alias("in_code"), x["page"].alias("page")).cast(LINE))
    content = F.when(F.col("piece.n") > 1, sliced).otherwise(part)
    start_line = F.when(F.col("whole"), F.col("start_line")).otherwise(F.get(part, F.lit(0))["line_idx"])
    return r.select("doc_id", start_line.alias("start_line"), "headers", content.alias("content"))


def finished(chunks: DataFrame, minimum: int = 15) -> DataFrame:
    """Chunks of minimum words or more, with word_count, pages and text."""
    pages = F.filter(F.transform("content", lambda x: x["page"]), lambda p: p.isNotNull())
    r = chunks.withColumn("word_count", chunk_words(F.col("content"))).where(F.col("word_count") >= minimum)
    return r.withColumn("start_page", F.array_min(pages)).withColumn("end_page", F.array_max(pages)).withColumn("text", chunk_text(F.col("headers"), F.col("content")))


class MarkdownChunker:
    """The size policies in order. max_headers_to_use: h1 to h6."""

    def __init__(self, max_headers_to_use: str = "h4", max_chunk_word_count: int = 200, hard_max_chunk_word_count: int = 400, min_chunk_word_count: int = 15, hard_max_chunk_token_count: int | None = None, tokenizer: Any | None = None):
        if max_headers_to_use not in {f"h{i}" for i in range(1, 7)}:
            raise ValueError("max_headers_to_use is h1 to h6")
        self.max_level = int(max_headers_to_use[1])
        self.soft, self.hard, self.minimum = max_chunk_word_count, hard_max_chunk_word_count, min_chunk_word_count
        self.limit, self.tokenizer = hard_max_chunk_token_count, tokenizer
        if tokenizer is not None:
            counter(tokenizer)

    def chunk(self, rows: DataFrame) -> DataFrame:
        """Chunks of lines."""
        got = hard_chunks(soft_chunks(rows, self.soft, self.max_level), self.hard)
        return finished(token_chunks(got, self.limit, self.tokenizer), self.minimum)

    __call__ = chunk

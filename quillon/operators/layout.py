"""Page layout: spans to lines to blocks to markdown, headers and footers, fonts, links and tables of contents.

Input is a spans table (doc_id, page, order, x0, y0, x1, y1, ox, oy, text, font, size, flags, dir_x, dir_y); decoding
PDF bytes is left to whatever makes that table. Everything shares partitions by doc_id, or by (doc_id, page).
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from .groups import map_groups

#: Characters that fonts misuse, and what they stand for.
CHARACTERS = {
    "\xa0": " ",
    "\uf0a7": "",
    "\uf0b7": "- ",
    "–": "- ",
    "•": "- ",
    "●": "- ",
    "►": "- ",
    "\uf0d8": "- ",
    "\uf07d": "- ",
}
#: The patterns of numbered list items, of lines of a printed table of contents, and of header levels.
NUMBERED = r"^\s*(\d+[.)]\s+|[a-zA-Z][.)]\s+|\([a-zA-Z0-9ivxlIVXL]+\)\s+)"
TOC_LINE = r"(.+?)(?:\s+)?[\.\_\-\s….]{5,}(?:\s+)?(?:[pP]\.\s*)?(\d+)"
LEVELS = ((3, r"^(\d+)[\s\.\)]+(\d+)[\s\.\)]+(\d+)"), (2, r"^(\d+)[\s\.\)]+(\d+)"), (1, r"^(\d+)[\s\.\)]*"))
#: Pages that are searched for a table of contents, lines without an entry that end it, longest header.
TOC_PAGES, TOC_GAP, LONGEST_HEADER = 15, 10, 100
#: Bits of a span's flags.
SUPERSCRIPT, ITALIC, SERIF, MONO, BOLD = 1, 2, 4, 8, 16


class PageNotFoundError(ValueError):
    """A document without pages, or without any in the range asked for."""


class TextNotFoundError(ValueError):
    """A document without text."""


def extract_spans(pages: DataFrame) -> DataFrame:
    """Spans of nested page layouts: pages has doc_id, page and blocks, an array of {lines: [{dir, spans: [{bbox, origin,
    text, font, size, flags}]}]} with bbox, origin and dir as arrays of numbers. order counts a document's spans."""
    r = pages.select("doc_id", "page", F.posexplode("blocks").alias("b", "block"))
    r = r.select("doc_id", "page", "b", F.posexplode("block.lines").alias("l", "line"))
    r = r.select("doc_id", "page", "b", "l", F.col("line.dir").alias("d"), F.posexplode("line.spans").alias("s", "span"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "b", "l", "s")) - 1
    box = [F.col("span.bbox")[i].cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    ends = [c[i].cast("double").alias(n) for c, names in ((F.col("span.origin"), ("ox", "oy")), (F.col("d"), ("dir_x", "dir_y"))) for i, n in enumerate(names)]
    return r.select("doc_id", "page", order.alias("order"), *box, *ends, clean_characters(F.col("span.text")).alias("text"), "span.font", "span.size", "span.flags")


def clean_characters(c: Column) -> Column:
    for bad, good in CHARACTERS.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def font_size(size: Column) -> Column:
    """Rounded as Python does, to even."""
    return F.bround(size).cast("int")


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def page_range(rows: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows of pages from start up to, without, end; an end beyond the last page is that page."""
    if end is not None and start >= end:
        raise ValueError("the page range is empty")
    cond = F.col("page") >= start
    return rows.where(cond if end is None else cond & (F.col("page") < end))


def without_pages(docs: DataFrame, pages: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """(doc_id, error) of documents without a page in the range; one bad document does not stop the others."""
    return docs.select("doc_id").join(page_range(pages, start, end), "doc_id", "left_anti").withColumn("error", F.lit("no pages in the range"))


def flag_repeated(spans: DataFrame) -> DataFrame:
    """is_hf: the same box on more than a third of the pages of a document of three pages or more. The number of pages is
    in a column page_count, or else that of the last page with a span, plus one."""
    box = Window.partitionBy("doc_id", "x0", "y0", "x1", "y1")
    pages = F.col("page_count") if "page_count" in spans.columns else F.max("page").over(Window.partitionBy("doc_id")) + 1
    return spans.withColumn("is_hf", (pages > 2) & (F.count("*").over(box) > pages / 3))


def inside_tables(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """in_table: the span's origin lies in a table's box (doc_id, page, x0, y0, x1, y1) of its page."""
    t = tables.select("doc_id", "page", *(F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")))
    hit = spans.join(t, ["doc_id", "page"]).where("ox >= tx0 AND ox <= tx1 AND oy >= ty0 AND oy <= ty1").select("doc_id", "order").distinct()
    return spans.join(hit.withColumn("in_table", F.lit(True)), ["doc_id", "order"], "left").withColumn("in_table", F.coalesce("in_table", F.lit(False)))


def main_direction(spans: DataFrame) -> DataFrame:
    """Only spans that run as most spans of their page do; among equals the one met first."""
    d = F.struct("dir_x", "dir_y")
    per = spans.groupBy("doc_id", "page", d.alias("d")).agg(F.count("*").alias("n"), F.min("order").alias("o"))
    best = per.groupBy("doc_id", "page").agg(F.max_by("d", F.struct("n", -F.col("o"))).alias("d"))
    return spans.join(best, ["doc_id", "page"]).where((F.col("dir_x") == F.col("d.dir_x")) & (F.col("dir_y") == F.col("d.dir_y"))).drop("d")


def lines(spans: DataFrame) -> DataFrame:
    """Spans with line_id: a span goes on with the line before if its baseline is near, or if it is a superscript."""
    page = Window.partitionBy("doc_id", "page").orderBy("order")
    far = F.abs(F.col("oy") - F.lag("oy").over(page)) > F.greatest(F.lit(3.0), 0.25 * F.lag(F.col("y1") - F.col("y0")).over(page))
    start = F.when(F.lag("oy").over(page).isNull(), 1).when(has_flag(F.col("flags"), SUPERSCRIPT), 0).otherwise(far.cast("int"))
    return spans.withColumn("start", start).withColumn("line_id", F.sum("start").over(page.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("start")


def _weighted_mode(value: Column, name: str) -> Column:
    """Of (value, characters) pairs, the value with most characters; of equals, the first met."""
    pairs = F.collect_list(F.struct(F.col("order").alias("o"), value.alias("v"), F.length("text").alias("n")))
    sums = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["v"])), lambda v: F.struct(F.aggregate(F.filter(pairs, lambda p: p["v"] == v), F.lit(0), lambda a, p: a + p["n"]).alias("n"), (-F.array_min(F.transform(F.filter(pairs, lambda p: p["v"] == v), lambda p: p["o"]))).alias("o"), v.alias("v")))
    return F.array_max(sums)["v"].alias(name)


def with_defaults(spans: DataFrame) -> DataFrame:
    """spans with the columns that earlier steps add, where those were left out."""
    for name, value in (("uri", F.lit(None).cast("string")), ("is_hf", F.lit(False)), ("in_table", F.lit(False)), ("is_footnote", F.lit(False))):
        spans = spans if name in spans.columns else spans.withColumn(name, value)
    return spans


def span_markdown(text: Column, flags: Column, uri: Column) -> Column:
    """Link, superscript, bold and italic marks of a span."""
    t = F.when(uri.isNotNull(), F.concat(F.lit("["), text, F.lit("]("), uri, F.lit(")"))).otherwise(T.strip(text))
    marked = F.when(has_flag(flags, SUPERSCRIPT), F.concat(F.lit("<sup>"), t, F.lit("</sup>"))).otherwise(t)
    marked = F.when(has_flag(flags, BOLD), F.concat(F.lit(" **"), marked, F.lit("** "))).otherwise(marked)
    marked = F.when(has_flag(flags, ITALIC), F.concat(F.lit(" *"), marked, F.lit("* "))).otherwise(marked)
    return F.when(text == "", "").when(T.strip(text) == "", t).otherwise(marked)


def line_table(spans: DataFrame) -> DataFrame:
    """A row per line: box, text, markdown, size and height of most of its characters, weight and kind."""
    s = with_defaults(spans).withColumn("own_height", F.col("y1") - F.col("y0"))
    empty = T.strip(F.col("text")) == ""
    parts = F.sort_array(F.collect_list(F.struct("order", "text", span_markdown(F.col("text"), F.col("flags"), F.col("uri")).alias("md"), "dir_x", "dir_y")))
    joined = lambda c, by: F.array_join(F.transform(parts, lambda p: p[c]), by)
    return s.groupBy("doc_id", "page", "line_id").agg(
        F.min("order").alias("first"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("ox").alias("ox"), F.max("oy").alias("oy"),
        T.strip(joined("text", "")).alias("line"), T.strip(joined("md", " ")).alias("md"), F.get(parts, F.lit(0)).alias("d"),
        _weighted_mode(font_size(F.col("size")), "main_size"), _weighted_mode(F.col("own_height"), "height"),
        F.bool_and(has_flag(F.col("flags"), BOLD) | empty).alias("bold"), F.bool_and("is_hf").alias("is_hf"), F.bool_and(F.col("is_footnote") | empty).alias("is_footnote"),
    ).withColumnsRenamed({"first": "order", "line": "text", "main_size": "size"}).withColumn("level_text", (F.col("d.dir_x") == 1) & (F.col("d.dir_y") == 0)).drop("d")


def line_spacing(rows: DataFrame) -> DataFrame:
    """(doc_id, spacing): the commonest gap, to a tenth, between a line of the commonest size and one that follows it
    further down; between any such lines if those have none. Of equals the first met."""
    per = rows.where("text <> ''").groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.min("order").alias("o"))
    body = per.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("o"))).alias("body"))
    w = Window.partitionBy("doc_id").orderBy("order")
    gaps = rows.select("doc_id", "order", "size", "y0", F.lag("size").over(w).alias("s"), F.lag("y0").over(w).alias("y"), F.round(F.col("y0") - F.lag("y1").over(w), 1).alias("gap")).where("y0 >= y")
    gaps = gaps.join(body, "doc_id", "left").withColumn("own", F.coalesce((F.col("size") == F.col("body")) & (F.col("s") == F.col("body")), F.lit(False)))
    n = gaps.groupBy("doc_id", "own", "gap").agg(F.count("*").alias("n"), F.min("order").alias("o"))
    return n.groupBy("doc_id").agg(F.max_by("gap", F.struct("own", "n", -F.col("o"))).alias("spacing"))


def blocks(rows: DataFrame, spacing: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Lines with block_id: a new block at an empty line before, another size, a wider gap, or a jump up."""
    w = Window.partitionBy("doc_id").orderBy("order")
    r = rows.join(spacing, "doc_id", "left")
    new = (F.lag("text").over(w) == "") | (F.lag("size").over(w) != F.col("size")) | (F.col("y0") - F.lag("y1").over(w) > F.coalesce("spacing", F.lit(0.0)) + tolerance) | (F.col("y1") <= F.lag("y0").over(w))
    return r.withColumn("start", F.coalesce(new, F.lit(True)).cast("int")).withColumn("block_id", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("start", "spacing")


def join_block(name: str) -> Column:
    """A block's text from a column of its lines (structs of text, md and is_toc): bullets, numbers and entries of a table
    of contents are paragraphs; a hyphen before a line that starts with a small letter goes."""
    bullet = lambda x: x["text"].startswith("- ") | x["is_toc"]
    alone = lambda x: bullet(x) | x["text"].rlike(NUMBERED)

    def goes_on(x: Column, before: Column) -> Column:
        return F.coalesce(~bullet(before) & ~alone(x) & before["text"].endswith("-") & before["md"].endswith("-") & x["text"].rlike(r"^\p{Ll}"), F.lit(False))

    def piece(x: Column, i: Column) -> Column:
        cut = goes_on(F.get(F.col(name), i + 1), x)
        md = F.when(cut, F.regexp_replace(x["md"], "-$", "")).otherwise(x["md"])
        lead = F.when((i > 0) & goes_on(x, F.get(F.col(name), i - 1)), "").otherwise(" ")
        return F.when(alone(x), F.concat(F.lit("\n\n"), md, F.when(cut, "").otherwise("\n\n"))).otherwise(F.concat(lead, md))

    return T.strip(F.array_join(F.transform(F.col(name), piece), ""))


def block_table(rows: DataFrame, toc_orders: DataFrame | None = None) -> DataFrame:
    """A row per block of lines with block_id: doc_id, block_id, order, page, first_text, text, md, size, bold, empty,
    is_hf, is_footnote, level_text. toc_orders: (doc_id, order) of lines that belong to a table of contents."""
    r = rows.withColumn("is_toc", F.lit(False)) if toc_orders is None else rows.join(toc_orders.select("doc_id", "order").distinct().withColumn("is_toc", F.lit(True)), ["doc_id", "order"], "left").withColumn("is_toc", F.coalesce("is_toc", F.lit(False)))
    empty = F.col("text") == ""
    l = F.sort_array(F.collect_list(F.struct(F.col("order").cast("int").alias("order"), "text", "md", "is_toc"))).alias("l")  # noqa: E741
    g = r.groupBy("doc_id", "block_id").agg(
        l, F.min("order").alias("order"), F.min_by("page", "order").alias("page"), F.min_by("line_id", "order").alias("line_id"), F.min_by("level_text", "order").alias("level_text"), F.first("size").alias("size"),
        F.bool_and(F.col("bold") | empty).alias("bold"), F.bool_and(empty).alias("empty"), F.bool_and("is_hf").alias("is_hf"), F.bool_and(F.col("is_footnote") | empty).alias("is_footnote"),
    )
    texts = F.transform("l", lambda x: x["text"])
    return g.select("*", F.get(texts, F.lit(0)).alias("first_text"), F.array_join(texts, " ").alias("text"), join_block("l").alias("md")).drop("l")


def body_fonts(rows: DataFrame, share: float = 0.1, bold_share: float = 0.3) -> DataFrame:
    """(doc_id, sizes, body_bold, all_sizes) from level lines with text: sizes of more than a tenth of all lines; bold if
    over three tenths of the lines of these sizes are."""
    real = F.col("text") != ""
    per = rows.groupBy("doc_id", "size").agg(F.count("*").alias("all"), F.count(F.when(real & F.col("level_text"), 1)).alias("n"), F.count(F.when(real, 1)).alias("real"), F.count(F.when(real & F.col("bold"), 1)).alias("b"))
    g = per.groupBy("doc_id").agg(F.sum("all").alias("all"), F.collect_list(F.when(F.col("n") > 0, F.struct("size", "n", "real", "b"))).alias("s"))
    body = F.filter("s", lambda x: x["n"] > F.col("all") * share)
    total = lambda c: F.aggregate(F.col("body"), F.lit(0).cast("long"), lambda a, x: a + x[c])
    g = g.withColumn("body", body)
    return g.select("doc_id", F.sort_array(F.transform("body", lambda x: x["size"])).alias("sizes"), (total("b") > total("real") * bold_share).alias("body_bold"), F.sort_array(F.transform("s", lambda x: x["size"])).alias("all_sizes"))


def flag_footnotes(spans: DataFrame, fonts: DataFrame, pages: DataFrame) -> DataFrame:
    """is_footnote: smaller than the body and in the lowest fifth of the page. pages: doc_id, page, height; spans of
    other pages, headers, footers, tables and superscripts are none."""
    s = with_defaults(spans).drop("is_footnote").join(fonts.select("doc_id", F.array_min("sizes").alias("least")), "doc_id", "left")
    s = s.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"], "left")
    note = (font_size(F.col("size")) < F.col("least")) & (F.col("y0") > 0.8 * F.col("height")) & ~has_flag(F.col("flags"), SUPERSCRIPT) & ~F.col("is_hf") & ~F.col("in_table")
    return s.withColumn("is_footnote", F.coalesce(note, F.lit(False))).drop("least", "height")


def orientation(pages: DataFrame) -> DataFrame:
    """(doc_id, orientation): portrait if the first page is higher than wide."""
    return pages.groupBy("doc_id").agg(F.when(F.min_by(F.col("height") > F.col("width"), "page"), "portrait").otherwise("landscape").alias("orientation"))


def schema_level(text: Column) -> Column:
    """1.1.1 is 3, 1.1 is 2, 1 is 1; at most three."""
    out = F.lit(None).cast("int")
    for level, pattern in reversed(LEVELS):
        out = F.when(text.rlike(f"(?U){pattern}"), level).otherwise(out)
    return out


def size_levels(rows: DataFrame, fonts: DataFrame, top: int = 5) -> DataFrame:
    """Blocks that look like headers, with a level: the rank of their size among the five largest above the body; bold
    blocks of the body's largest size come next. Numbering of the text overrides both."""
    r = rows.join(fonts, "doc_id").withColumn("largest", F.array_max("sizes")).where("largest IS NOT NULL AND level_text AND NOT empty").where(F.length("text") <= LONGEST_HEADER)
    above = F.slice(F.reverse(F.filter("all_sizes", lambda x: x > F.col("largest"))), 1, top)
    r = r.withColumn("above", above)
    rank = F.array_position("above", F.col("size")).cast("int")
    level = F.when(rank > 0, rank).when((F.col("size") == F.col("largest")) & F.col("bold") & ~F.col("body_bold"), F.size("above") + 1)
    r = r.withColumn("level", level).where("level IS NOT NULL")
    return r.select("doc_id", "block_id", "page", "order", "text", "size", F.coalesce(schema_level(F.col("text")), F.col("level")).alias("level"))


def main_title(spans: DataFrame, fonts: DataFrame) -> DataFrame:
    """(doc_id, title): first-page spans of its two largest sizes, those of the body left out, cut after 100 characters."""
    s = spans.where("page = 0").where(T.strip(F.col("text")) != "").withColumn("fs", font_size(F.col("size"))).join(fonts, "doc_id").where(F.size("sizes") > 0)
    level = (F.col("dir_x") == 1) & (F.col("dir_y") == 0)
    s = s.withColumn("large", F.collect_set(F.when(level, F.col("fs"))).over(Window.partitionBy("doc_id"))).withColumn("large", F.slice(F.sort_array("large", False), 1, 2))
    s = s.where(F.array_contains("large", F.col("fs")) & ~F.array_contains("sizes", F.col("fs")))
    t = s.groupBy("doc_id").agg(T.strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), " ")).alias("t"))
    return t.select("doc_id", F.when(F.length("t") > 100, F.concat(F.substring("t", 1, 100), F.lit("[...]"))).otherwise(F.col("t")).alias("title"))


def _toc_fold(key: tuple, rows: list[tuple]) -> list[tuple]:
    """Entries of a printed table of contents among a document's lines (order, page, text, ox)."""
    pattern, out, marked, since = re.compile(TOC_LINE), [], set(), 0
    for i, (order, page, text, x) in enumerate(rows):
        since += 1
        if len(out) > 3 and since > TOC_GAP:
            break
        m = pattern.match(text)
        if not m or len(m[2]) >= 4:
            continue
        since, title, orders = 0, m[1], [order]
        if i > 2 and i - 1 not in marked and i - 2 in marked:  # a title on two lines
            title, x, orders = rows[i - 1][2] + title, rows[i - 1][3], [rows[i - 1][0], order]
            marked.add(i - 1)
        marked.add(i)
        out.append((*key, len(out), title, int(m[2]), page, int(x), orders))
    return out


def toc_lines(rows: DataFrame, pages: int = TOC_PAGES) -> DataFrame:
    """Entries of a printed table of contents on the first pages: nth, title, page, source_page, by_schema, by_offset,
    level (by schema if that tells all levels, else by indentation within the page), orders of its lines."""
    x = F.col("ox") if "ox" in rows.columns else F.col("x0")
    r = rows.where(F.col("page") < pages).select("doc_id", F.col("order").cast("int").alias("order"), "page", "text", x.cast("double").alias("x"))
    r = map_groups(r, ["doc_id"], ["order"], _toc_fold, "doc_id long, nth int, title string, page int, source_page int, x int, orders array<int>")
    r = r.withColumn("by_offset", F.dense_rank().over(Window.partitionBy("doc_id", "source_page").orderBy("x"))).withColumn("by_schema", schema_level(F.col("title")))
    known = F.bool_and(F.col("by_schema").isNotNull()).over(Window.partitionBy("doc_id"))
    return r.select("doc_id", "nth", "title", "page", "source_page", "by_schema", "by_offset", F.when(known, F.col("by_schema")).otherwise(F.col("by_offset")).alias("level"), "orders")


def ratio(a: str, b: str) -> int:
    """Similarity in per cent by insertions and deletions: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100
    size, ends = len(a) + len(b), 0
    if a[:1] == b[:1] or a[-1:] == b[-1:]:  # equal ends belong to every longest subsequence
        head = len(os.path.commonprefix((a, b)))
        a, b = a[head:], b[head:]
        tail = len(os.path.commonprefix((a[::-1], b[::-1])))
        a, b, ends = a[: len(a) - tail], b[: len(b) - tail], head + tail
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
    return round(200 * (ends + len(a) - v.bit_count()) / size)


class _Page:
    """The lines of a page: the first row of each text, and of each first line, and texts by length."""

    def __init__(self, at: int) -> None:
        self.at, self.first, self.line, self.lengths = at, {}, {}, {}
        self._counts: dict[str, dict[str, int]] = {}

    def add(self, order: int, first: str | None, line: str | None) -> None:
        if first is not None and order < self.first.get(first, order + 1):
            self.first[first] = order
        if line is None:
            return
        if line not in self.line:
            self.lengths.setdefault(len(line), []).append(line)
        if order < self.line.get(line, order + 1):
            self.line[line] = order

    def counts(self, line: str) -> dict[str, int]:
        got = self._counts.get(line)
        if got is None:
            got = self._counts[line] = Counter(line)
        return got


def _most_similar(title: str, pages: list[_Page], least: int) -> tuple[int, int] | None:
    """(ratio, order) of the row most like a title, of equals the least order. Lengths, then counts of characters, bound
    the ratio from above, so a row is compared only if it may be the answer."""
    n, best, own = len(title), None, None
    near = [(100 if n + m == 0 else round(200 * min(n, m) / (n + m)), p, m) for p in pages for m in p.lengths]
    for bound, p, m in sorted((x for x in near if x[0] >= least), key=lambda x: -x[0]):
        if best and bound < best[0]:
            break
        for line in p.lengths[m]:
            order = p.line[line]
            if best and bound == best[0] and order >= best[1]:
                continue
            if best or m + n > 60:
                own = Counter(title) if own is None else own
                has = p.counts(line)
                top = 100 if n + m == 0 else round(200 * sum(min(k, has.get(c, 0)) for c, k in own.items()) / (n + m))
                if top < least or best and (top < best[0] or top == best[0] and order >= best[1]):
                    continue
            got = ratio(title, line)
            if got >= least and (not best or got > best[0] or got == best[0] and order < best[1]):
                best = (got, order)
    return best


#: Pages of a document that are dealt out together; the pages beside them go along.
PAGES_TOGETHER = 64


def nearest(titles: DataFrame, rows: DataFrame, least: int = 75) -> DataFrame:
    """titles: doc_id, nth, title, page; rows: doc_id, page, order, first, text -> (doc_id, nth, order, ratio) of the row
    that each title names on the pages page - 1 to page + 1: one whose first line is equal (ratio 101), else the most
    similar of least or more; of equals the first. Titles meet the rows page by page, after one exchange; a task holds
    the rows of three pages and the titles of two."""
    order, nth = rows.schema["order"].dataType, titles.schema["nth"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    exactly = F.col("exact") if "exact" in titles.columns else F.col("title")
    part = lambda page: F.floor(page / PAGES_TOGETHER)
    page = F.col("page").cast("long")
    t = titles.select("doc_id", part(page).alias("part"), page.alias("page"), F.lit(False).alias("is_row"), none("long").alias("order"), F.col("title").alias("a"), exactly.alias("b"), "nth")
    r = rows.select("doc_id", F.explode(F.array_distinct(F.array(part(page - 1), part(page), part(page + 1)))).alias("part"), page.alias("page"), F.lit(True).alias("is_row"), F.col("order").cast("long").alias("order"), F.col("text").alias("a"), F.col("first").alias("b"), none(nth).alias("nth"))
    both = t.unionByName(r).where("doc_id IS NOT NULL AND page IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pages, asked, out = None, [], [], []
        nths: list[pa.Array] = []

        def answer(known: list[_Page], waiting: list[tuple]) -> None:
            for page, title, exact, nth in waiting:
                near = [p for p in known if abs(p.at - page) <= 1]
                same = [p.first[exact] for p in near if exact in p.first]
                got = (101, min(same)) if same else None if title is None else _most_similar(title, near, least)
                if got:
                    out.append((key[0], got[1], got[0]))
                    nths.append(nth)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            nth = pa.concat_arrays(nths) if nths else pa.array([], to_arrow_type(nth_type))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow_type(doc_type)), nth, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["doc_id", "nth", "order", "ratio"])

        for b in batches:
            ids = b.column("nth")
            for i, (doc, part, page, is_row, order, a, c) in enumerate(zip(*(b.column(k).to_pylist() for k in ("doc_id", "part", "page", "is_row", "order", "a", "b")), strict=True)):
                if (doc, part) != key:
                    answer(pages, asked)
                    key, pages, asked = (doc, part), [], []
                elif pages and pages[-1].at < page or asked and asked[-1][0] < page:
                    # titles of the page before the last have now met all rows of their pages
                    ready = [x for x in asked if x[0] + 1 < page]
                    if ready:
                        answer(pages, ready)
                        asked = [x for x in asked if x[0] + 1 >= page]
                    pages = [p for p in pages if p.at >= page - 2]
                if is_row:
                    if not pages or pages[-1].at != page:
                        pages.append(_Page(page))
                    pages[-1].add(order, c, a)
                else:
                    asked.append((page, a, c, ids.slice(i, 1)))
            if out:
                yield batch()
                out, nths = [], []
        answer(pages, asked)
        yield batch()

    doc_type, nth_type = titles.schema["doc_id"].dataType, nth
    schema = S.StructType([S.StructField("doc_id", doc_type), S.StructField("nth", nth_type), S.StructField("order", S.LongType()), S.StructField("ratio", S.IntegerType())])
    got = both.repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", "page").mapInArrow(run, schema)
    return got.select("doc_id", "nth", F.col("order").cast(order).alias("order"), "ratio")


def match_titles(titles: DataFrame, rows: DataFrame, least: int = 75) -> DataFrame:
    """Distinct titles with the line they name: an equal one but for outer blanks, else the most similar."""
    t = titles.select("doc_id", "title", "page").distinct()
    both = t.select("doc_id", "page", F.struct(F.col("title").alias("nth"), "page").alias("nth"), "title", F.trim("title").alias("exact"))
    found = nearest(both, rows.select("doc_id", "page", "order", F.trim("text").alias("first"), F.col("text")), least)
    where = rows.select("doc_id", "order", F.col("page").alias("found_page"), "line_id")
    return found.join(where, ["doc_id", "order"]).select("doc_id", F.col("nth.nth").alias("title"), F.col("nth.page").alias("page"), "found_page", "line_id", F.least("ratio", F.lit(100)).alias("ratio"))


def bind_links(spans: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, page, uri, order): a link's span. One span under it is it; the largest overlap wins if more than twice the
    second, else the largest of those that are smaller than the largest."""
    k = links.select("doc_id", "page", "uri", *(F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")))
    w, h = F.least("x1", "lx1") - F.greatest("x0", "lx0"), F.least("y1", "ly1") - F.greatest("y0", "ly0")
    area = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    hits = spans.join(k, ["doc_id", "page"]).withColumn("area", area).where("area > 0")
    key = ["doc_id", "page", "uri", "lx0", "ly0"]
    g = hits.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("area", (-F.col("order")).alias("o"))), False).alias("a"))
    best, second = F.get("a", F.lit(0)), F.get("a", F.lit(1))
    less = F.get(F.filter("a", lambda x: x["area"] < best["area"]), F.lit(0))
    pick = F.when(F.size("a") == 1, best["o"]).when(best["area"] / 2 > second["area"], best["o"]).otherwise(less["o"])
    return g.select("doc_id", "page", "uri", (-pick).alias("order")).where("order IS NOT NULL")


def cleanup_markdown(c: Column) -> Column:
    c = F.regexp_replace(c, r"\*\* *\*\*", " ")
    c = F.replace(c, F.lit(" ** "), F.lit("**\n"))
    return T.strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def block_markdown(level: Column) -> Column:
    """A block's markdown: a header a level deeper than its title's, a quoted footnote, or its text."""
    md = F.col("md")
    return F.when(F.col("empty"), "").when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level + 1), F.lit(" "), md)).when(F.col("is_footnote"), F.concat(F.lit("> *"), md, F.lit("*"))).otherwise(md)


def items(blocks: DataFrame, levels: DataFrame | None = None, tables: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """(doc_id, order, page, text) of what a document shows, in order: its title, then blocks and tables but for headers
    and footers. levels: doc_id, block_id, level; tables: doc_id, order, page, is_hf, md; titles: doc_id, title."""
    b = blocks.join(levels.select("doc_id", "block_id", "level"), ["doc_id", "block_id"], "left") if levels is not None else blocks.withColumn("level", F.lit(None).cast("int"))
    out = b.where("NOT is_hf").select("doc_id", F.col("order").cast("int").alias("order"), "page", cleanup_markdown(block_markdown(F.col("level"))).alias("text"))
    if tables is not None:
        out = out.unionByName(tables.where("NOT is_hf").select("doc_id", F.col("order").cast("int").alias("order"), "page", cleanup_markdown(F.col("md")).alias("text")))
    if titles is not None:
        head = titles.where("title <> ''").select("doc_id", F.lit(-1).alias("order"), F.lit(0).alias("page"), F.concat(F.lit("# "), T.strip(F.col("title"))).alias("text"))
        out = head.unionByName(out)
    return out


def markdown(shown: DataFrame) -> DataFrame:
    """(doc_id, md) of items, a blank line between them."""
    g = shown.where("text <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("order", "text"))).alias("b"))
    return g.select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("md"))

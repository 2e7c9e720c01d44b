"""Parsers: each turns a table of raw documents (doc_id, raw) into (doc_id, md, metadata), or into lines.

Markdown is cleaned by column functions; opaque formats go through Arrow functions, a document a row.
"""

from __future__ import annotations

import csv
import io
import json
import math
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import html as H
from ..functions import text as T
from ..operators import chunker


class ParserError(ValueError):
    """A document that a parser cannot read."""


#: File endings of each format.
ENDINGS = {"markdown": ("md",), "html": ("html", "htm"), "docx": ("docx",), "csv": ("csv",), "excel": ("xls", "xlsx", "xlsm", "xlsb", "odf", "ods", "odt"), "notebook": ("ipynb",), "json": ("json",), "pdf": ("pdf",)}
BINARY = {"docx", "excel", "pdf"}


def format_of(path: str) -> str:
    end = path.rsplit(".", 1)[-1]
    for kind, ends in ENDINGS.items():
        if end in ends or kind in ("csv", "excel", "pdf") and end.lower() in ends:
            return kind
    raise ValueError(f"no parser for files that end in .{end}")


def read(spark: SparkSession, path: str | Sequence[str], kind: str, recursive: bool = False) -> DataFrame:
    """(doc_id, path, raw) of all files of a format below a path; doc_id is a hash of the path."""
    pattern = "*.{" + ",".join(ENDINGS[kind]) + "}"
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        if "." in p.rsplit("/", 1)[-1] and "*" not in p and format_of(p) != kind:
            raise ValueError(f"{p} is not a {kind} file")
    r = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).format("binaryFile").load(paths)
    raw = F.col("content") if kind in BINARY else F.decode("content", "UTF-8")
    return r.select(F.xxhash64("path").alias("doc_id"), "path", raw.alias("raw"))


def parse_markdown(docs: DataFrame) -> DataFrame:
    """Clean-up, front matter, underlined headers."""
    yaml, md = T.markdown_clean(F.col("raw"))
    return T.small_batches(docs).select("doc_id", md.alias("md"), T.parse_yaml(yaml).alias("metadata"))


def _plain(docs: DataFrame, md: Column) -> DataFrame:
    return T.small_batches(docs).select("doc_id", md.alias("md"), F.create_map().cast("map<string,string>").alias("metadata"))


def parse_html(docs: DataFrame) -> DataFrame:
    return _plain(docs, T.cleanup_html(H.html_to_markdown("raw")))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_html(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(p) -> str:
        out = ""
        for r in p.iter(f"{_W}r"):
            t = "".join("\n" if x.tag == f"{_W}br" else "\t" if x.tag == f"{_W}tab" else x.text or "" for x in r if x.tag in (f"{_W}t", f"{_W}br", f"{_W}tab"))
            t = t.replace("&", "&amp;").replace("<", "&lt;")
            pr = r.find(f"{_W}rPr")
            for tag, mark in (("b", "strong"), ("i", "em")):
                x = None if pr is None else pr.find(f"{_W}{tag}")
                if x is not None and x.get(f"{_W}val") not in ("0", "false") and t.strip():
                    t = f"<{mark}>{t}</{mark}>"
            out += t
        return out

    def block(e) -> str:
        if e.tag == f"{_W}p":
            style, listed = e.find(f"{_W}pPr/{_W}pStyle"), e.find(f"{_W}pPr/{_W}numPr") is not None
            m = re.fullmatch(r"(?i)(?:heading|titre|berschrift)\s*(\d)", "" if style is None else style.get(f"{_W}val") or "")
            t = text(e)
            return f"<h{min(int(m[1]), 6)}>{t}</h{min(int(m[1]), 6)}>" if m else f"<ul><li>{t}</li></ul>" if listed else f"<p>{t}</p>"
        if e.tag == f"{_W}tbl":
            return table(e)
        return ""

    def table(e) -> str:
        grid: list[list[dict]] = []
        for tr in e.iter(f"{_W}tr"):
            row, at = [], 0
            for tc in tr.findall(f"{_W}tc"):
                span, merge = tc.find(f"{_W}tcPr/{_W}gridSpan"), tc.find(f"{_W}tcPr/{_W}vMerge")
                n = int(span.get(f"{_W}val")) if span is not None else 1
                above = next((c for r in reversed(grid) for c in r if c["at"] == at and c["first"]), None)
                goes_on = merge is not None and merge.get(f"{_W}val") != "restart" and above
                if goes_on:
                    above["rows"] += 1
                row.append({"at": at, "cols": n, "rows": 1, "first": not goes_on, "text": "<br>".join(text(p) for p in tc.findall(f"{_W}p"))})
                at += n
            grid.append(row)
        cell = lambda c: "<td" + (f' rowspan="{c["rows"]}"' if c["rows"] > 1 else "") + (f' colspan="{c["cols"]}"' if c["cols"] > 1 else "") + f">{c['text']}</td>"
        return "<table>" + "".join("<tr>" + "".join(cell(c) for c in r if c["first"]) + "</tr>" for r in grid) + "</table>"

    return "".join(block(e) for e in body)


@F.pandas_udf(S.StringType())
def docx_to_html(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else _docx_html(bytes(b)))


def parse_docx(docs: DataFrame) -> DataFrame:
    return _plain(docs, T.cleanup_html(H.html_to_markdown(docx_to_html("raw"))))


def sniff(text: str, lines: int = 5) -> str:
    """The delimiter of CSV text, from its first lines."""
    try:
        return csv.Sniffer().sniff("\n".join(text.split("\n")[:lines])).delimiter
    except csv.Error as e:
        raise ValueError("the delimiter cannot be told; give it") from e


def sheet_to_json_lines(df: pd.DataFrame) -> str:
    return df.to_json(orient="records", lines=True, force_ascii=False)


def _cell(x) -> str:
    return "nan" if x is None or x != x else f"{x:g}" if isinstance(x, float) else str(x)


def sheet_to_pipe_table(df: pd.DataFrame) -> str:
    rows = [[_cell(x).replace("\n", " ") for x in r] for r in df.itertuples(index=False, name=None)]
    return re.sub(r"-{3,}", "---", re.sub(r"\s{3,}", "  ", H.pipe_table([str(c) for c in df.columns], rows)))


def row_measures(names: Sequence, per: Sequence[int]) -> tuple[float, float, float]:
    """Density of values, share of named columns, and evenness of the rows' lengths, from the columns' names and the
    number of values in each row."""
    n, total, wide = len(per), sum(per), len(names)
    named = sum(bool(str(c).strip()) and not str(c).startswith("Unnamed") for c in names if c)
    if not n or not wide:
        return math.nan, named / wide if wide else math.nan, 0.0
    mean = total / n
    spread = math.sqrt(sum((x - mean) ** 2 for x in per) / (n - 1)) if n > 1 else math.nan
    return total / (n * wide), named / wide, 1 - spread / mean if mean > 0 else 0.0


def csv_measures(df: pd.DataFrame) -> tuple[float, float, float]:
    return row_measures(list(df.columns), df.count(axis=1).tolist())


def measures_like(density: float, named: float, even: float) -> bool:
    return bool(density >= 0.6 and named >= 0.8 and even >= 0.7)


def csv_like(df: pd.DataFrame) -> bool:
    """Dense, with named columns, and rows of like length."""
    return len(df) >= 2 and len(df.columns) > 0 and measures_like(*csv_measures(df))


def _render(df: pd.DataFrame, how: str) -> str:
    how = ("json_lines" if csv_like(df) else "markdown_table") if how == "auto" else how
    return sheet_to_json_lines(df) if how == "json_lines" else sheet_to_pipe_table(df)


def _check(how: str, allowed: tuple[str, ...]) -> None:
    if how not in allowed:
        raise ValueError(f"output_format is one of {', '.join(allowed)}")


def parse_csv(docs: DataFrame, output_format: str = "json_lines", delimiter: str | None = None, sample_lines: int = 5) -> DataFrame:
    _check(output_format, ("json_lines", "markdown_table"))

    @F.pandas_udf(S.StringType())
    def convert(raw: pd.Series) -> pd.Series:
        return raw.map(lambda s: None if s is None else _render(pd.read_csv(io.StringIO(s), delimiter=delimiter or sniff(s, sample_lines)), output_format))

    return _plain(docs, convert("raw"))


_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_sheets(data: bytes) -> dict[str, pd.DataFrame]:
    """Sheets of an xlsx workbook; the first row names the columns."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet"):
            target = rels[s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]
            grid: list[list] = []
            for r in ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter(f"{_X}row"):
                row: list = []
                for c in r.findall(f"{_X}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                        at = at * 26 + ord(ch) - 64
                    row += [None] * ((at or len(row) + 1) - 1 - len(row))
                    v, kind = c.find(f"{_X}v"), c.get("t")
                    if kind == "inlineStr":
                        row.append("".join(t.text or "" for t in c.iter(f"{_X}t")))
                    elif v is None or v.text is None:
                        row.append(None)
                    elif kind == "s":
                        row.append(shared[int(v.text)])
                    elif kind in ("str", "e"):
                        row.append(v.text)
                    elif kind == "b":
                        row.append(v.text == "1")
                    else:
                        x = float(v.text)
                        row.append(int(x) if x.is_integer() else x)
                at = int(r.get("r") or len(grid) + 1)
                grid += [[]] * (at - 1 - len(grid))
                grid.append(row)
            width = max(map(len, grid), default=0)
            grid = [r + [None] * (width - len(r)) for r in grid]
            head = [f"Unnamed: {i}" if h is None else h for i, h in enumerate(grid[0])] if grid else []
            out[s.get("name")] = pd.DataFrame(grid[1:], columns=head)
    return out


def parse_excel(docs: DataFrame, output_format: str = "auto") -> DataFrame:
    _check(output_format, ("auto", "json_lines", "markdown_table"))

    @F.pandas_udf(S.StringType())
    def convert(raw: pd.Series) -> pd.Series:
        def one(b):
            if not bytes(b).startswith(b"PK"):
                raise ParserError("only workbooks in the xlsx container can be read")
            return "\n\n".join(f"## {name}\n\n{_render(df, output_format)}" for name, df in xlsx_sheets(bytes(b)).items())

        return raw.map(lambda b: None if b is None else one(b))

    return _plain(docs, convert("raw"))


def _output_text(o: dict) -> str:
    joined = lambda x: "".join(x) if isinstance(x, list) else x
    if o["output_type"] in ("execute_result", "display_data"):
        parts = [json.dumps(v) if k == "application/json" or k.endswith("+json") else joined(v) for k, v in o.get("data", {}).items() if k == "text/plain" or k.endswith("json")]
        return "\n\n".join(parts).strip()
    return joined(o["text"]).strip() if o["output_type"] == "stream" else ""


def notebook_to_markdown(text: str, outputs: bool = False) -> str:
    """Cells of a version 4 notebook; version 3 worksheets are read as well."""
    book = json.loads(text)
    cells = book.get("cells") or [c for w in book.get("worksheets", []) for c in w.get("cells", [])]
    language = book.get("metadata", {}).get("language_info", {}).get("name", "")
    out = ""
    for c in cells:
        source = c.get("source", c.get("input", ""))
        source = "".join(source) if isinstance(source, list) else source
        if c["cell_type"] in ("markdown", "raw"):
            out += source + "\n\n"
        elif c["cell_type"] == "code":
            own = (c.get("metadata", {}).get("vscode") or {}).get("languageId") or language
            out += f"```{own}\n{source}\n```\n\n"
            if outputs and c.get("outputs"):
                out += "\n\n".join(filter(None, map(_output_text, c["outputs"]))) + "\n\n"
    return out


def cells_to_markdown(cells: Column, language: Column) -> Column:
    """The same for cells already in columns: array<struct<cell_type, source, language>>."""
    own = lambda c: F.coalesce(c["language"], language, F.lit(""))
    one = lambda c: F.when(c["cell_type"] == "code", F.concat(F.lit("```"), own(c), F.lit("\n"), c["source"], F.lit("\n```\n\n"))).otherwise(F.concat(c["source"], F.lit("\n\n")))
    return F.array_join(F.transform(cells, one), "")


def parse_notebook(docs: DataFrame, include_code_cells_outputs: bool = False) -> DataFrame:
    @F.pandas_udf(S.StringType())
    def convert(raw: pd.Series) -> pd.Series:
        return raw.map(lambda s: None if s is None else notebook_to_markdown(s, include_code_cells_outputs))

    return _plain(docs, convert("raw"))


#: The JSON envelope: names as written, and the snake-case names that its writer uses.
PART = S.StructType([S.StructField(n, t) for n, t in (("@type", S.StringType()), ("text", S.StringType()), ("pageStart", S.LongType()), ("pageEnd", S.LongType()), ("position", S.LongType()))])
ENVELOPE = S.StructType([S.StructField(n, t) for n, t in (("@type", S.StringType()), ("@context", S.StringType()), ("identifier", S.StringType()), ("name", S.StringType()), ("url", S.StringType()), ("fileFormat", S.StringType()), ("dateCreated", S.StringType()), ("dateModified", S.StringType()), ("keywords", S.ArrayType(S.StringType())), ("hasPart", S.ArrayType(PART)))])
SNAKE = {"@type": "type", "@context": "context", "fileFormat": "file_format", "dateCreated": "date_created", "dateModified": "date_modified", "hasPart": "has_part", "pageStart": "page_start", "pageEnd": "page_end"}


def parse_envelope(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Only the first part is read, as markdown or HTML by fileFormat. A document that is no such envelope has an error
    and no md, and does not stop the others; strict makes it an exception."""
    schema = S.StructType([*ENVELOPE.fields, S.StructField("_bad", S.StringType())])
    r = T.small_batches(docs).withColumn("e", F.from_json("raw", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).withColumn("first", F.get(F.col("e.hasPart"), F.lit(0))["text"])
    kind = F.col("e.fileFormat")
    error = (
        F.when(F.col("raw").isNull(), F.lit("no document"))
        .when(F.col("e").isNull() | F.col("e._bad").isNotNull(), F.lit("not an envelope in JSON"))
        .when(F.col("first").isNull(), F.lit("no first part with text"))
        .when(kind.isNull(), F.lit("no fileFormat"))
        .when(~kind.isin("text/markdown", "text/html"), F.concat(F.lit("unknown fileFormat: "), kind))
    )
    r = r.withColumn("error", error).withColumn("kind", F.when(error.isNull(), kind))
    if strict:
        r = r.withColumn("kind", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("kind")))
    yaml, md = T.markdown_clean(F.when(F.col("kind") == "text/markdown", F.col("first")))
    html = T.cleanup_html(H.html_to_markdown(F.when(F.col("kind") == "text/html", F.col("first"))))
    return r.select("doc_id", F.coalesce(md, html).alias("md"), T.parse_yaml(yaml).alias("metadata"), "error")


def parse_pdf(docs: DataFrame, parser=None, **options) -> DataFrame:
    """Lines of PDF documents, by a parser that has a decoder."""
    if parser is None:
        raise ParserError("PDF bytes need a document.PdfParser with a decoder")
    return parser.parse(docs, **options)


PARSERS = {"markdown": parse_markdown, "html": parse_html, "docx": parse_docx, "csv": parse_csv, "excel": parse_excel, "notebook": parse_notebook, "json": parse_envelope}


def parsed_lines(docs: DataFrame, kind: str, **options) -> DataFrame:
    if kind == "pdf":
        return parse_pdf(docs, **options)
    return chunker.lines(PARSERS[kind](docs, **options))

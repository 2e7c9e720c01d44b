"""Parsers and sinks over small documents of each format."""

import io
import json
import zipfile

import pytest

from quillon.plans.pipeline import EnvelopePipeline, Pipeline
from quillon.operators.chunker import MarkdownChunker
from quillon.sources import parsers, sinks


def _one(spark, kind, raw, **o):
    t = "binary" if kind in parsers.BINARY else "string"
    return parsers.PARSERS[kind](spark.createDataFrame([(1, raw), (2, None)], f"doc_id long, raw {t}"), **o).where("doc_id = 1").first().md


def test_csv(spark):
    raw = "a;b\n1;x\n2;\n"
    assert _one(spark, "csv", raw).split("\n")[0] == '{"a":1,"b":"x"}'
    assert all(x.startswith("|") for x in _one(spark, "csv", raw, output_format="markdown_table").split("\n"))
    with pytest.raises(ValueError):
        parsers.parse_csv(spark.createDataFrame([(1, raw)], "doc_id long, raw string"), "other")


def test_notebook(spark):
    book = {"metadata": {"language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 5, "cells": [{"cell_type": "markdown", "source": ["# t\n", "x"]}, {"cell_type": "code", "metadata": {}, "source": "1+1", "outputs": [{"output_type": "stream", "text": "out"}, {"output_type": "error"}]}]}
    assert _one(spark, "notebook", json.dumps(book)) == "# t\nx\n\n```python\n1+1\n```\n\n"
    assert "out" in _one(spark, "notebook", json.dumps(book), include_code_cells_outputs=True)


def test_docx_and_xlsx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>{p("text")}<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("wide")}</w:tc></w:tr><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    md = _one(spark, "docx", buf.getvalue())
    assert "## Head" in md and md.count("wide") == 1 and "colspan" in md
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {x}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {x}><sheetData><row r="1">{cell("A1", "k")}{cell("B1", "v")}</row><row r="2">{cell("A2", "x")}<c r="B2"><v>1</v></c></row><row r="3">{cell("A3", "y")}<c r="B3"><v>2</v></c></row></sheetData></worksheet>')
    assert _one(spark, "excel", buf.getvalue()) == '## S\n\n{"k":"x","v":1}\n{"k":"y","v":2}\n'


def test_files_and_envelopes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# t\n\n" + "word " * 30)
    chunks = Pipeline("markdown").chunk_files(spark, str(tmp_path / "in/a.md"))
    sinks.save_one(chunks, str(tmp_path / "o/x.json"))
    assert json.loads((tmp_path / "o/x.json").read_text())[0]["start_line"] == -1
    (tmp_path / "in/b.json").write_text(json.dumps({"@type": "Document", "fileFormat": "text/html", "hasPart": [{"text": "<h1>t</h1><p>" + "word " * 30 + "</p>"}]}))
    out = EnvelopePipeline(MarkdownChunker(min_chunk_word_count=0)).chunk_directory(spark, str(tmp_path / "in"))
    got = json.loads(spark.read.text(out).first()[0])
    assert got["has_part"][0]["position"] == 0 and got["file_format"] == "text/html"
    with pytest.raises(ValueError):
        Pipeline("other")
    with pytest.raises(ValueError):
        parsers.read(spark, "x.html", "markdown")

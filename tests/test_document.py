"""The plan from spans to markdown, titles, tables and chunks, on one made document."""

import pytest

from quillon.functions import html
from quillon.operators import chunker, document, layout, tables

SPAN = "doc_id long, page int, order int, x0 double, y0 double, x1 double, y1 double, ox double, oy double, text string, font string, size double, flags int, dir_x double, dir_y double"


def test_spans_to_chunks(spark):
    rows: list[tuple] = []

    def add(page, x, y, text, size=10.0, flags=0):
        rows.append((1, page, len(rows), x, y, x + 4.0 * len(text), y + size, x, y + size, text, "f", size, flags, 1.0, 0.0))

    for page in range(3):
        add(page, 50.0, 5.0, "Running head", 8.0)
        if page == 0:
            add(page, 50.0, 40.0, "Main", 24.0)
        if page == 1:
            add(page, 50.0, 40.0, "1.1 Details", 14.0)
        for k in range(8):
            text = f"page {page} ends with a hy-" if k == 2 else "phen and goes on" if k == 3 else "- a bullet" if k == 5 else f"line {k}"
            add(page, 50.0 + 3 * page, 120.0 + 12 * k, text, flags=16 if k == 6 else 0)
        if page != 1:  # sizes of over a tenth of the lines would be the body's
            add(page, 50.0 + page, 760.0, "a small note", 6.0)
    for r in range(2):
        for c in range(2):
            add(1, 55.0 + 100 * c, 405.0 + 20 * r, f"c{r}{c}", 8.0)
    spans = spark.createDataFrame(rows, SPAN)
    drawings = spark.createDataFrame([(1, 1, k, 50.0, 400.0 + 20 * k, 250.0, 400.0 + 20 * k) for k in range(3)] + [(1, 1, 10 + k, 50.0 + 100 * k, 400.0, 50.0 + 100 * k, 440.0) for k in range(3)], "doc_id long, page int, seg_id int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, p, 600.0, 800.0, 3) for p in range(3)], "doc_id long, page int, width double, height double, page_count int")
    links = spark.createDataFrame([(1, 0, "http://l", 50.0, 120.0, 60.0, 130.0)], "doc_id long, page int, uri string, x0 double, y0 double, x1 double, y1 double")
    got = document.parse(spans, links, drawings, pages)
    md = got.markdown().first().md
    assert md.startswith("# Main\n\n") and "### 1.1 Details" in md and "[line 0](http://l) line 1" in md
    assert "ends with a hyphen and goes on" in md and "> *a small note*" in md and "**line 6**" in md and "Running head" not in md
    assert "| c00  | c01  |\n|:---|:---|\n| c10  | c11  |" in md
    assert [(r.level, r.title, r.source) for r in got.toc.orderBy("order").collect()] == [(1, "Main", "fontsize"), (2, "1.1 Details", "fontsize")]
    chunks = chunker.MarkdownChunker(min_chunk_word_count=1).chunk(got.line_rows()).collect()
    assert {(c.start_page, c.end_page) for c in chunks} == {(0, 2)}
    got.close()


def test_table_text_of_merged_cells():
    plain = [(0, 0, 1, 1, "k"), (0, 1, 1, 1, "v"), (1, 0, 1, 1, "a"), (1, 1, 1, 1, "b"), (2, 0, 1, 1, "a"), (2, 1, 1, 1, "b")]
    assert tables.table_rows(plain) == (["k", "v"], [["a", "b"]])
    merged = [(0, 0, 1, 2, "wide"), (1, 0, 1, 1, "a"), (1, 1, 1, 1, "b")]
    assert tables.demerged(merged) == [["wide", "wide"], ["a", "b"]]
    assert tables.table_markdown(merged) == '<table><tr><th colspan="2">wide</th></tr><tr><td>a</td><td>b</td></tr></table>'


def test_deep_pages_and_options():
    assert html.to_markdown("<div>" * 3000 + "<p>in</p>" + "</div>" * 3000 + "<p>after</p>").split() == ["in", "after"]
    with pytest.raises(ValueError):
        document.PdfParser(use_ocr="sometimes")
    with pytest.raises(ValueError):
        document.PdfParser(use_ocr="never").document
    assert layout.CHARACTERS[""] == ""

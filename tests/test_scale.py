"""Steps whose time or memory once grew too fast, with the same results as before."""

import random
import re
import time
import unicodedata

import pandas as pd
from pyspark.sql import functions

from quillon.functions import text
from quillon.operators import chunker, layout
from quillon.plans import registry
from quillon.sources import parsers


def test_row_measures_equal_a_frame_and_need_none():
    rng = random.Random(5)
    for _ in range(200):
        names = [rng.choice(["", "a", "Unnamed: 3", " ", "key"]) for _ in range(rng.randint(1, 6))]
        df = pd.DataFrame([[rng.choice([None, 1, "x"]) for _ in names] for _ in range(rng.randint(1, 30))], columns=names)
        per = df.count(axis=1)
        want = (per.sum() / df.size, sum(c in ("a", "key") for c in names) / len(names), 1 - per.std() / per.mean() if per.mean() > 0 else 0.0)
        for got in (parsers.csv_measures(df), parsers.row_measures(names, per.tolist())):
            assert all(abs(x - y) < 1e-9 or x != x and y != y for x, y in zip(got, want, strict=True))
    began = time.perf_counter()
    for _ in range(20_000):  # frames took over a millisecond each
        parsers.row_measures(["key", "a", "b", "c", "d"], [5, 4, 3] * 3)
    assert time.perf_counter() - began < 5


def test_similar_lines_are_found_without_comparing_all(monkeypatch):
    rng = random.Random(7)
    for _ in range(300):
        pages = [layout._Page(p) for p in (3, 4, 5)]
        rows = [(o, rng.choice(pages), "".join(rng.choice("ab c") for _ in range(rng.choice([0, 2, 6, 9, 80])))) for o in range(25)]
        for order, page, text in rng.sample(rows, len(rows)):
            page.add(order, text, text)
        line = rng.choice(rows)[2]
        title = "".join(c for c in line if rng.random() > 0.1)
        want = max((layout.ratio(title, x), -o) for o, _, x in rows)
        assert layout._most_similar(title, pages, 75) == ((want[0], -want[1]) if want[0] >= 75 else None)
    asked = []
    monkeypatch.setattr(layout, "ratio", lambda a, b, f=layout.ratio: asked.append(1) or f(a, b))
    page = layout._Page(0)
    lines = ["".join(rng.choice("abcdefg ") for _ in range(50 + 3 * k)) for k in range(40)]
    for k, x in enumerate(lines):
        page.add(k, x, x)
    for k, x in enumerate(lines):
        assert layout._most_similar(x[:30] + x[32:], [page], 75)[1] == k
    assert len(asked) <= 4 * len(lines)  # all pairs of like lengths, over 800, were compared before


def test_common_ends_do_not_change_the_ratio():
    rng = random.Random(9)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert layout.ratio(a, b) == (round(200 * row[-1] / (len(a) + len(b))) if a or b else 100)


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_lines_equal_the_documents_normal_form(spark):
    blanks = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != "\n")
    docs = [(1, f"{blanks}é ﬁne{blanks}\n\t plain \x1f\n\n  ¨x\x00 \n# head\x85"), (2, ""), (3, "\n"), (4, "x\r\n\x1c y \n" + "Å" * 3)]
    want = {(d, i): unicodedata.normalize("NFKD", x.strip()) for d, t in docs for i, x in enumerate(t.split("\n"))}
    rows = chunker.lines(spark.createDataFrame(docs, "doc_id long, md string"))
    assert {(r.doc_id, r.line_idx): r.text for r in rows.collect()} == want
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Generate")  # a document was one value for Python before


def test_documents_reach_python_by_their_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for parse in (parsers.parse_html, parsers.parse_envelope, parsers.parse_markdown):
        spark.conf.unset(key)
        parse(spark.range(1).selectExpr("id AS doc_id", "'<p>x</p>' AS raw"))
        assert int(spark.conf.get(key).rstrip("b")) <= text.BATCH_BYTES  # 64 MB before
    size = functions.pandas_udf("int")(lambda x: pd.Series([len(x)] * len(x)))
    size.func.__annotations__ = {"x": pd.Series, "return": pd.Series}
    docs = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 20000) AS raw")
    assert max(r.n for r in text.small_batches(docs).select(size("raw").alias("n")).collect()) <= 60


def test_spans_are_dealt_out_by_document_alone(spark):
    plan = registry.QUERIES["spans_to_markdown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and all(re.fullmatch(r"doc_id#\d+L?, \d+", x) for x in dealt)  # by page and line as well before
    assert len(dealt) <= plan.count("Scan parquet") + plan.count("ReusedExchange")  # documents, never their spans

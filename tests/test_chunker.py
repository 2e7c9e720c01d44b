"""Chunks against a row-at-a-time model, and at the boundaries of each limit."""

import random

from pyspark.sql import functions as F

from quillon.functions import html, text
from quillon.operators import chunker as C

LINE = "struct<line_idx:int,text:string,in_code:boolean,page:int>"


def model_soft(md: str, soft: int, top: int = 4) -> list[tuple[int, list[str], list[str]]]:
    lines, code, kinds = md.split("\n"), False, []
    for s in lines:
        if s.startswith("```") and "```" not in s[3:]:
            code = not code
        inside = code or s == "```"
        t = s.strip()
        level = len(t.lstrip("- ")) - len(t.lstrip("- ").lstrip("#"))
        kinds.append((t, min(level, 6) if level and not inside else 0))
    nodes = [(-1, 0, "")] + [(i, k, t) for i, (t, k) in enumerate(kinds) if 0 < k <= top]
    out = []

    def end(j):
        return next((nodes[m][0] for m in range(j + 1, len(nodes)) if nodes[m][1] <= nodes[j][1]), len(lines)) if j else len(lines)

    def walk(j, ups):
        i, level, title = nodes[j]
        body = [t for t, _ in kinds[max(i, 0) : end(j)]]
        if sum(len(t.split()) for t in body) <= soft:
            out.append((i, ups, body))
            return
        stop = nodes[j + 1][0] if j + 1 < len(nodes) else len(lines)
        own = [t for t, _ in kinds[i + 1 : stop]]
        here = ups + ([title] if j else [])
        if any(own):
            out.append((i, here, own))
        k = j + 1
        while k < len(nodes) and nodes[k][0] < end(j):
            if all(not (nodes[m][0] < nodes[k][0] < end(m)) for m in range(j + 1, k)):
                walk(k, here)
            k += 1

    walk(0, [])
    return out


def test_soft_chunks_equal_the_model(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(["", "# a", "## b c", "### d", "#### e", "##### deep", "- # x", "```", "some words here", "- item one", "| t | u |", "```x```"]) for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    for soft in (0, 5, 12, 1000):
        got: dict = {}
        for r in C.soft_chunks(C.lines(spark.createDataFrame(docs, "doc_id long, md string")), soft).collect():
            got.setdefault(r.doc_id, []).append((r.start_line, [h.text for h in r.headers], [x.text for x in r.content]))
        for i, md in docs:
            assert sorted(got.get(i, [])) == sorted(model_soft(md, soft)), (soft, md)


def _chunk(spark, lines, header=None):
    ln = lambda i, t: (i, t, False, None)
    return spark.createDataFrame([(1, 0, [ln(0, header)] if header else [], [ln(i + 1, t) for i, t in enumerate(lines)])], f"doc_id long, start_line int, headers array<{LINE}>, content array<{LINE}>")


def test_hard_split_carries_headers(spark):
    w = " ".join(["word"] * 10)
    got = C.finished(C.hard_chunks(_chunk(spark, ["## one", "", w, w, w, "## two", "", w, w, w], "# top"), 10), 0).orderBy("start_line").collect()
    assert [r.start_line for r in got] == [1, 4, 5, 6, 9, 10]
    assert got[3].text == f"# top\n\n## one\n\n## two\n\n{w}"
    assert got[4].text == f"# top\n\n## two\n\n{w}"


def test_limits_at_equality(spark):
    w = " ".join(["w"] * 10)
    c = _chunk(spark, [w, w])
    assert C.hard_chunks(c, 21).first().start_line == 0 and C.hard_chunks(c, 20).first().start_line == 1  # kept, and cut
    assert C.token_chunks(c, 21).count() == 1 and C.token_chunks(c, 20).count() == 2
    assert C.token_chunks(c, 4).count() == 6  # lines of ten tokens, three slices each
    assert C.finished(c, 20).count() == 1 and C.finished(c, 21).count() == 0


def test_text_functions(spark):
    md = "see [a](http://x.y)\nand ![b](c.d 'e')"
    df = spark.createDataFrame([(md, "T\n===\n===\nx\n---\n```\na\n---\n```\n---\nz", "---\na: b\n---\n\nbody")], "l string, s string, f string")
    yaml, body = text.front_matter(F.col("f"))
    r = df.select(text.remove_links(F.col("l")), text.setext_to_atx(F.col("s")), text.parse_yaml(yaml), body).first()
    assert r[0] == "see a\nand b"
    assert r[1] == "# ===\n## x\n```\na\n---\n## ```\nz"
    assert r[2] == {"a": "b"} and r[3] == "body"


def test_html_tables_and_lists():
    assert html.to_markdown("<h2>T</h2><p>a <b>b</b></p><ul><li>x<li>y</ul>") == "## T\n\na **b**\n- x\n- y"
    assert "<td colspan=\"2\">" in html.to_markdown("<table><tr><td colspan=2 class=z>a</td></tr><tr><td>b</td><td>c</td></tr></table>")
    assert html.to_markdown("<table><tr><th>k</th><th>n</th></tr><tr><td>a</td><td>10</td></tr></table>").split("\n")[0] == "| k | n |"

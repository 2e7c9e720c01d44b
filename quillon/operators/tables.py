"""Tables from ruled lines: segments of a page become grids, cells and, with spans, tables in markdown or HTML.

segments: doc_id, page, seg_id, x0, y0, x1, y1, each horizontal or vertical. Joins are within a page."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import pipe_table
from .groups import map_groups

SNAP, THIN, LEAST = 3.0, 5.0, 5.0
BOX = ("x0", "y0", "x1", "y1")


def ruled(drawings: DataFrame, width: float = THIN, least: float = LEAST, annotations: DataFrame | None = None) -> DataFrame:
    """Thin rectangles become their centre lines; only straight lines longer than least stay. Drawings that are the boxes
    of annotations (doc_id, page, x0, y0, x1, y1) go."""
    if annotations is not None:
        drawings = drawings.join(annotations.select("doc_id", "page", *BOX), ["doc_id", "page", *BOX], "left_anti")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    flat, thin = (h < width) & (w >= h), (w < width) & (h > w)
    r = drawings.where(flat | thin)
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    r = r.select(*[c for c in r.columns if c not in BOX], F.round(F.when(flat, F.col("x0")).otherwise(mx), 1).alias("x0"), F.round(F.when(flat, my).otherwise(F.col("y0")), 1).alias("y0"), F.round(F.when(flat, F.col("x1")).otherwise(mx), 1).alias("x1"), F.round(F.when(flat, my).otherwise(F.col("y1")), 1).alias("y1"))
    return r.where(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > least)


def horizontal(s: DataFrame) -> DataFrame:
    return s.where("y0 = y1")


def vertical(s: DataFrame) -> DataFrame:
    return s.where("x0 = x1")


def intersections(segments: DataFrame, snap: float = SNAP) -> DataFrame:
    """Distinct (doc_id, page, x, y) where a horizontal and a vertical line meet, within snap."""
    h = horizontal(segments).select("doc_id", "page", F.col("y0").alias("y"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"))
    v = vertical(segments).select("doc_id", "page", F.col("x0").alias("x"), F.col("y0").alias("vy0"), F.col("y1").alias("vy1"))
    on = f"x >= hx0 - {snap} AND x <= hx1 + {snap} AND y >= vy0 - {snap} AND y <= vy1 + {snap}"
    return h.join(v, ["doc_id", "page"]).where(on).select("doc_id", "page", "x", "y").distinct()


def grid_values(values: DataFrame, gap: float = 5.0, value: str = "v") -> DataFrame:
    """values: doc_id, page, v -> v and grid (the mean of its cluster): a gap of gap or more starts a cluster."""
    w = Window.partitionBy("doc_id", "page").orderBy(value)
    d = values.select("doc_id", "page", value).distinct()
    d = d.withColumn("new", F.coalesce((F.col(value) - F.lag(value).over(w) >= gap).cast("int"), F.lit(0)))
    d = d.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return d.select("doc_id", "page", value, "cluster", F.avg(value).over(Window.partitionBy("doc_id", "page", "cluster")).alias("grid"))


def unit_cells(points: DataFrame) -> DataFrame:
    """Cells between consecutive xs and ys of a page's points."""
    def steps(c: str) -> DataFrame:
        w = Window.partitionBy("doc_id", "page").orderBy(c)
        return points.select("doc_id", "page", c).distinct().withColumn("next", F.lead(c).over(w)).where("next IS NOT NULL")

    x = steps("x").select("doc_id", "page", F.col("x").alias("x0"), F.col("next").alias("x1"))
    y = steps("y").select("doc_id", "page", F.col("y").alias("y0"), F.col("next").alias("y1"))
    return x.join(y, ["doc_id", "page"]).select("doc_id", "page", *BOX)


def area_check(cells: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(doc_id, page, cells, area, box_area, sane): whether cells fill the box around them."""
    g = cells.groupBy("doc_id", "page").agg(F.count("*").alias("cells"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), ((F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0"))).alias("box_area"))
    return g.withColumn("sane", F.abs(F.col("area") - F.col("box_area")) <= tolerance * F.col("box_area"))


def touching(segments: DataFrame, snap: float = SNAP) -> DataFrame:
    """Pairs (a, b) of a page's lines that touch within snap."""
    s = segments.select("doc_id", "page", F.col("seg_id").alias("a"), *BOX)
    t = segments.select("doc_id", "page", F.col("seg_id").alias("b"), *(F.col(c).alias(f"t{c}") for c in BOX))
    return s.join(t, ["doc_id", "page"]).where(f"a < b AND x0 - {snap} <= tx1 AND tx0 - {snap} <= x1 AND y0 - {snap} <= ty1 AND ty0 - {snap} <= y1").select("doc_id", "page", "a", "b")


def _components(boxes: list[tuple], snap: float) -> list[int]:
    """For each (seg_id, x0, y0, x1, y1) the smallest seg_id of those that it touches, directly or not. A sweep by x."""
    up = list(range(len(boxes)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    near: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i][1]):
        _, x0, y0, _, y1 = boxes[i]
        near = [j for j in near if boxes[j][3] >= x0 - snap]
        for j in near:
            if y0 - snap <= boxes[j][4] and boxes[j][2] - snap <= y1:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
        near.append(i)
    least: dict[int, int] = {}
    roots = [top(i) for i in range(len(boxes))]
    for r, box in zip(roots, boxes, strict=True):
        least[r] = min(box[0], least.get(r, box[0]))
    return [least[r] for r in roots]


PAGE = ("doc_id", "page")


def group_lines(segments: DataFrame, snap: float = SNAP) -> DataFrame:
    """(doc_id, page, seg_id, table_id): lines of a page that touch, directly or not, have the smallest seg_id in common."""
    f = lambda key, rows: [(*key, r[0], t) for r, t in zip(rows, _components(rows, snap), strict=True)]
    return map_groups(segments.select(*PAGE, "seg_id", *BOX), PAGE, ["seg_id"], f, "doc_id long, page int, seg_id int, table_id int")


def _cells(xs: list[float], ys: list[float], h: set, v: set) -> list[tuple[int, int, int, int]]:
    """Smallest boxes whose four sides are drawn. h and v: unit sides (line, step) that some line covers."""
    out, taken = [], set()
    for r in range(len(ys) - 1):
        for c in range(len(xs) - 1):
            if (r, c) in taken:
                continue
            found = None
            for r2 in range(r + 1, len(ys)):
                if (c, r2 - 1) not in v:
                    break
                for c2 in range(c + 1, len(xs)):
                    if (r, c2 - 1) not in h:
                        break
                    if all((r2, k) in h for k in range(c, c2)) and all((c2, k) in v for k in range(r, r2)):
                        found = (r, c, r2, c2)
                        break
                if found:
                    break
            if found:
                out.append(found)
                taken |= {(a, b) for a in range(found[0], found[2]) for b in range(found[1], found[3])}
    return out


def _cluster(values: list[float], gap: float) -> list[float]:
    groups: list[list[float]] = []
    for x in sorted(set(values)):
        if groups and x - groups[-1][-1] < gap:
            groups[-1].append(x)
        else:
            groups.append([x])
    return [sum(g) / len(g) for g in groups]


def _page_tables(lines: list[tuple], snap: float, gap: float) -> list[tuple]:
    """(table_id, row, col, rowspan, colspan, x0, y0, x1, y1) of the cells of a page's tables."""
    out = []
    tables: dict[int, list[tuple]] = {}
    for line, table in zip(lines, _components(lines, snap), strict=True):
        tables.setdefault(table, []).append(line[1:])
    for table, boxes in sorted(tables.items()):
        xs, ys = (_cluster([v for b in boxes for v in (b[i], b[i + 2])], gap) for i in (0, 1))
        near = lambda grid, x: min(range(len(grid)), key=lambda i: abs(grid[i] - x))
        h, v = set(), set()
        for x0, y0, x1, y1 in boxes:
            a, b, c, d = near(xs, x0), near(ys, y0), near(xs, x1), near(ys, y1)
            if b == d:
                h |= {(b, k) for k in range(a, c)}
            elif a == c:
                v |= {(a, k) for k in range(b, d)}
        for k in range(len(xs) - 1):  # the outer frame counts as drawn
            h |= {(0, k), (len(ys) - 1, k)}
        for k in range(len(ys) - 1):
            v |= {(0, k), (len(xs) - 1, k)}
        cells = _cells(xs, ys, h, v)
        area = sum((xs[c2] - xs[c]) * (ys[r2] - ys[r]) for r, c, r2, c2 in cells)
        box = (xs[-1] - xs[0]) * (ys[-1] - ys[0])
        if len(cells) > 1 and abs(area - box) <= 0.001 * box:
            out += [(table, r, c, r2 - r, c2 - c, xs[c], ys[r], xs[c2], ys[r2]) for r, c, r2, c2 in cells]
    return out


CELLS = "doc_id long, page int, table_id int, row int, col int, rowspan int, colspan int, x0 double, y0 double, x1 double, y1 double"


def find_cells(segments: DataFrame, snap: float = SNAP, gap: float = 5.0) -> DataFrame:
    """Cells of all tables, merged ones with their spans. Tables of one cell, or whose cells do not fill them, are left out."""
    f = lambda key, rows: [(*key, *r) for r in _page_tables(rows, snap, gap)]
    return map_groups(segments.select(*PAGE, "seg_id", *BOX), PAGE, ["seg_id"], f, CELLS)


TABLE = [*PAGE, "table_id"]


def cell_parts(cells: DataFrame, spans: DataFrame, inset: float = 3.0) -> DataFrame:
    """(cell, order, text, is_hf) of the spans in each cell. A span, less inset points on each side (or its centre, if
    nothing is left), lies in a cell, or meets several; then each gets the share of its characters that its width has."""
    s = spans.select(*PAGE, "order", "text", "uri", "is_hf", *(F.col(c).alias(f"s{c}") for c in BOX))
    fits = (F.col("sx1") - F.col("sx0") >= 2 * inset) & (F.col("sy1") - F.col("sy0") >= 2 * inset)
    for a, b in (("x0", "x1"), ("y0", "y1")):
        middle = (F.col(f"s{a}") + F.col(f"s{b}")) / 2
        s = s.withColumn(f"i{a}", F.when(fits, F.col(f"s{a}") + inset).otherwise(middle)).withColumn(f"i{b}", F.when(fits, F.col(f"s{b}") - inset).otherwise(middle))
    r = cells.join(s, list(PAGE)).where("sx1 > x0 AND sx0 < x1 AND sy1 > y0 AND sy0 < y1")
    inside = F.expr("x0 <= ix0 AND y0 <= iy0 AND x1 >= ix1 AND y1 >= iy1")
    meets = F.expr("greatest(x0, ix0) < least(x1, ix1) AND greatest(y0, iy0) < least(y1, iy1)")
    left = F.greatest("x0", "sx0")
    kept = F.bround((F.least("x1", "sx1") - left) / (F.col("sx1") - F.col("sx0")) * F.length("text"), 0).cast("int")
    part = F.when(left == F.col("sx0"), F.expr("substring(text, 1, kept)")).otherwise(F.expr("substring(text, length(text) - kept + 1)"))
    r = r.where(inside | meets).withColumn("kept", kept).withColumn("text", F.when(inside, F.col("text")).otherwise(part))
    shown = F.when(F.col("uri").isNotNull(), F.concat(F.lit("["), "text", F.lit("]("), "uri", F.lit(")"))).otherwise(F.col("text"))
    return r.select(*TABLE, "row", "col", "order", shown.alias("text"), "is_hf")


def fill_cells(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells with text, first (the order of their table's first span) and table_hf (all its spans are headers or footers).
    Tables with spans in half their cells or less go. spans may lack uri and is_hf."""
    for name, value in (("uri", F.lit(None).cast("string")), ("is_hf", F.lit(False))):
        spans = spans if name in spans.columns else spans.withColumn(name, value)
    key = [*TABLE, "row", "col"]
    got = cell_parts(cells, spans).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("order", "text"))).alias("p"), F.bool_and("is_hf").alias("hf"))
    w = Window.partitionBy(*TABLE)
    out = cells.join(got, key, "left").withColumn("full", F.avg(F.col("p").isNotNull().cast("double")).over(w))
    out = out.withColumn("first", F.min(F.get("p", F.lit(0))["order"]).over(w)).withColumn("table_hf", F.bool_and(F.coalesce("hf", F.lit(True))).over(w)).where("full > 0.5")
    text = F.coalesce(F.array_join(F.transform("p", lambda x: x["text"]), " "), F.lit(""))
    return out.withColumn("text", text).drop("p", "hf", "full")


def demerged(cells: list[tuple]) -> list[list[str]]:
    """Rows of texts from (row, col, rowspan, colspan, text): a merged cell's text stands in each place it covers."""
    grid: dict[tuple[int, int], str] = {(r + i, c + j): t for r, c, h, w, t in cells for i in range(h) for j in range(w)}
    n, m = (1 + max(k[i] for k in grid) for i in (0, 1))
    return [[grid.get((r, c), "") for c in range(m)] for r in range(n)]


def table_rows(cells: list[tuple], has_header: bool = True) -> tuple[list[str], list[list[str]]]:
    """Column names and rows, each row once."""
    rows = demerged(cells)
    head = rows.pop(0) if has_header else [str(i) for i in range(len(rows[0]))]
    return head, [list(r) for r in dict.fromkeys(map(tuple, rows))]


def table_markdown(cells: list[tuple], has_header: bool = True) -> str:
    """A pipe table, or HTML if cells are merged."""
    if any(h > 1 or w > 1 for _, _, h, w, _ in cells):
        out: dict[int, str] = {}
        for r, _, h, w, t in sorted(cells):
            tag = "th" if has_header and r == 0 else "td"
            out[r] = out.get(r, "") + f"<{tag}" + (f' colspan="{w}"' if w > 1 else "") + (f' rowspan="{h}"' if h > 1 else "") + f">{t}</{tag}>"
        return "<table>" + "".join(f"<tr>{x}</tr>" for x in out.values()) + "</table>"
    return re.sub(r"-{3,}", "---", re.sub(r"\s{3,}", "  ", pipe_table(*table_rows(cells, has_header))))


def to_markdown(cells: DataFrame) -> DataFrame:
    """(doc_id, page, table_id, order, is_hf, x0, y0, x1, y1, merged, md): a row per table of filled cells."""

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        box = [f(r[i] for r in rows) for f, i in ((min, 4), (min, 5), (max, 6), (max, 7))]
        cells = [(*r[:4], r[10]) for r in rows]
        return [(*key, rows[0][8], rows[0][9], *box, any(r[2] > 1 or r[3] > 1 for r in rows), table_markdown(cells))]

    c = cells if "first" in cells.columns else cells.withColumn("first", F.lit(0)).withColumn("table_hf", F.lit(False))
    c = c.select(*TABLE, "row", "col", "rowspan", "colspan", *BOX, "first", "table_hf", "text")
    return map_groups(c, TABLE, ["row", "col"], one, "doc_id long, page int, table_id int, order int, is_hf boolean, x0 double, y0 double, x1 double, y1 double, merged boolean, md string")

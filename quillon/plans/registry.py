"""Queries over the operators, with the SQL that gives the same rows. Markdown, spans and segments are made from the
star schema and from documents by expressions that both engines evaluate alike."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import chunker as C
from ..operators import classify, document, layout, tables
from ..operators.groups import map_groups
from ..sources import parsers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _nfkd(c: str) -> str:
    """SQL for the decomposition of the letters that the texts have."""
    for ch in "ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöü":
        c = f"replace({c}, '{ch}', '{unicodedata.normalize('NFKD', ch)}')"
    return c


_WORD = r"[\p{L}\p{N}_]+"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return T.small_batches(_t(spark, sf, "documents")).select("doc_id", F.col("text").alias("md"))


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM documents")
def lines_explode(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("line_idx", "line")).select("doc_id", "line", F.col("line_idx").cast("long").alias("line_idx"))


@query(f"SELECT doc_id, len(regexp_extract_all({_nfkd('text')}, '{_WORD}')) AS words FROM documents")
def doc_word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", T.word_count(T.normal_lines("md")).cast("long").alias("words"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words FROM documents")
def doc_ws_word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", T.blank_word_count(F.col("md")).cast("long").alias("words"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '  ' || chr(10) ELSE chr(10) END),
    '(?:\n\s*){3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS md FROM documents""")
def cleanup_blank_lines(spark, sf):
    gap = F.when(F.col("doc_id") % 2 == 0, F.lit("\n\n  \n")).otherwise(F.lit("\n"))
    return _docs(spark, sf).select("doc_id", T.cleanup(F.replace("md", F.lit("\n"), gap)).alias("md"))


@query(r"SELECT doc_id, trim(text, ' ' || chr(10)) AS md FROM documents")
def strip_base64(spark, sf):
    image = F.concat(F.lit("data:image/"), F.element_at(F.array(*map(F.lit, ("png", "svg+xml", "webp", "jpg"))), (F.col("doc_id") % 4 + 1).cast("int")), F.lit(";base64,iVBORw0KGgo/AA+9=="))
    return _docs(spark, sf).select("doc_id", T.strip(T.cleanup(F.concat(image, "md", image))).alias("md"))


@query(r"""SELECT doc_id, regexp_replace(string_agg(CASE i % 3 WHEN 0 THEN l WHEN 1 THEN '[see' || i || '](http://a.b/c) and ' || l ELSE '![pic](x.png ''title'') ' || l END, chr(10) ORDER BY i),
    '\[?!?\[(.*?)\](\(.*\)\])?\((.*\..+?)(\s.*)?\)', '\1', 'g') AS md
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY doc_id""")
def remove_links(spark, sf):
    one = lambda l, i: F.when(i % 3 == 0, l).when(i % 3 == 1, F.concat(F.lit("[see"), i.cast("string"), F.lit("](http://a.b/c) and "), l)).otherwise(F.concat(F.lit("![pic](x.png 'title') "), l))  # noqa: E731,E741
    return _docs(spark, sf).select("doc_id", T.remove_links(F.array_join(F.transform(F.split("md", "\n", -1), one), "\n")).alias("md"))


@query("SELECT doc_id, lang, source, trim(text, ' ' || chr(10)) AS md FROM documents")
def front_matter(spark, sf):
    d = _t(spark, sf, "documents")
    raw = F.concat(F.lit("---\nlang: "), "lang", F.lit("\nsource: "), "source", F.lit("\n---\n"), "text")
    yaml, body = T.front_matter(raw)
    m = T.parse_yaml(yaml)
    return d.select("doc_id", m["lang"].alias("lang"), m["source"].alias("source"), body.alias("md"))


_SYNTAX = """l AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), ['===', '', '```', 'code', '---', '```', 'tail', '---'])) AS line,
    generate_subscripts(list_concat(string_split(text, chr(10)), ['===', '', '```', 'code', '---', '```', 'tail', '---']), 1) - 1 AS i FROM documents),
  f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') AND NOT contains(substr(line, 4), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS code,
    lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM l)"""


def _syntax(spark, sf):
    return _docs(spark, sf).select("doc_id", F.concat("md", F.lit("\n===\n\n```\ncode\n---\n```\ntail\n---")).alias("md"))


@query(f"""WITH {_SYNTAX},
  u AS (SELECT *, NOT code AND (starts_with(line, '===') OR starts_with(line, '---')) AND trim(coalesce(prev, '')) <> '' AS mark FROM f),
  o AS (SELECT *, lead(mark, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS gone FROM u)
  SELECT doc_id, string_agg(CASE WHEN mark AND starts_with(line, '=') THEN '# ' || prev WHEN mark THEN '## ' || prev ELSE line END, chr(10) ORDER BY i) AS md FROM o WHERE NOT gone GROUP BY doc_id""")
def setext_to_atx(spark, sf):
    return _syntax(spark, sf).select("doc_id", T.setext_to_atx(F.col("md")).alias("md"))


@query(f"WITH {_SYNTAX} SELECT doc_id, i AS line_idx, code OR line = '```' AS in_code FROM f")
def fence_flags(spark, sf):
    return C.lines(_syntax(spark, sf)).select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), "in_code")


#: Markdown of a nation: region, nation, customers, a line per order; some customers have a list, some a table.
_MD = """SELECT n_nationkey AS doc_id, '# ' || r_name || chr(10) || chr(10) || '## ' || n_name || chr(10) || 'Customers of ' || n_name || chr(10) ||
    string_agg(body, chr(10) ORDER BY c_custkey) AS md
  FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN '##### ' WHEN c_custkey % 5 = 0 THEN '#### ' ELSE '### ' END || c_name || chr(10) || chr(10) ||
      coalesce(string_agg(CASE WHEN c_custkey % 3 = 0 THEN '- ' WHEN c_custkey % 11 = 0 THEN '| ' ELSE '' END || 'order ' || o_orderkey || ' has status ' || o_orderstatus || ' and priority ' || o_orderpriority, chr(10) ORDER BY o_orderkey), '') AS body
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_name) JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY n_nationkey, r_name, n_name"""


def synth_md(spark: SparkSession, sf: str) -> DataFrame:
    c, o, n, r = (_t(spark, sf, x) for x in ("customer", "orders", "nation", "region"))
    mark = F.when(F.col("c_custkey") % 3 == 0, "- ").when(F.col("c_custkey") % 11 == 0, "| ").otherwise("")
    line = F.concat(mark, F.lit("order "), "o_orderkey", F.lit(" has status "), "o_orderstatus", F.lit(" and priority "), "o_orderpriority")
    per = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey", "c_nationkey", "c_name").agg(F.sort_array(F.collect_list(F.when(F.col("o_orderkey").isNotNull(), F.struct("o_orderkey", line.alias("l"))))).alias("o"))
    head = F.when(F.col("c_custkey") % 7 == 0, "##### ").when(F.col("c_custkey") % 5 == 0, "#### ").otherwise("### ")
    body = F.concat(head, "c_name", F.lit("\n\n"), F.array_join(F.transform("o", lambda x: x["l"]), "\n"))
    got = per.select("c_nationkey", F.struct("c_custkey", body.alias("b")).alias("b")).groupBy("c_nationkey").agg(F.sort_array(F.collect_list("b")).alias("b"))
    got = got.join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 and 5 rows
    return got.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("# "), "r_name", F.lit("\n\n## "), "n_name", F.lit("\nCustomers of "), "n_name", F.lit("\n"), F.array_join(F.transform("b", lambda x: x["b"]), "\n")).alias("md"))


_TREE = rf"""WITH d AS ({_MD}), l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS text, generate_subscripts(string_split(md, chr(10)), 1) - 1 AS i FROM d),
  k AS (SELECT *, CASE WHEN regexp_matches(text, '^[- ]*#') THEN least(length(regexp_extract(text, '^[- ]*(#+)', 1)), 6) END AS level, len(regexp_extract_all(text, '\S+')) AS n FROM l),
  m AS (SELECT *, level <= 4 AS node FROM k),
  t AS (SELECT a.doc_id, a.i, a.level, a.text, (SELECT min(b.i) FROM m b WHERE b.doc_id = a.doc_id AND b.node AND b.i > a.i AND b.level <= a.level) AS e,
      (SELECT max(b.i) FROM m b WHERE b.doc_id = a.doc_id AND b.node AND b.i < a.i AND b.level < a.level) AS p FROM m a WHERE a.node),
  s AS (SELECT t.doc_id, t.i, t.level, t.text, t.e, t.p, sum(m.n) AS wc FROM t JOIN m ON m.doc_id = t.doc_id AND m.i >= t.i AND m.i < coalesce(t.e, 1000000000) GROUP BY ALL),
  anc AS (SELECT s.doc_id, s.i, list(a.text ORDER BY a.i) FILTER (WHERE a.i IS NOT NULL) AS ups FROM s LEFT JOIN s a ON a.doc_id = s.doc_id AND a.i < s.i AND coalesce(a.e, 1000000000) > s.i GROUP BY ALL)"""


@query(_TREE.replace("level <= 4 AS node", "level IS NOT NULL AS node") + " SELECT doc_id, i AS line_idx, text, level, starts_with(text, '- ') AS is_bullet, starts_with(text, '|') OR starts_with(text, '<table>') AS in_table FROM m")
def line_kinds(spark, sf):
    return C.lines(synth_md(spark, sf)).select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), "text", F.col("level").cast("long").alias("level"), "is_bullet", "in_table")


@query(_TREE + " SELECT s.doc_id, s.i AS section_id, coalesce(p, -1) AS parent_id, level, text AS title, e AS end_idx, wc::BIGINT AS subtree_words, array_to_string(coalesce(ups, []), ' > ') AS ancestors FROM s JOIN anc USING (doc_id, i)")
def toc_tree(spark, sf):
    r = C.tree(C.lines(synth_md(spark, sf)))
    return r.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("section_id", "parent_id", "level")), "title", F.col("end_idx").cast("long").alias("end_idx"), "subtree_words", F.array_join("ancestors", " > ").alias("ancestors"))


_SOFT = _TREE + """,
  tot AS (SELECT doc_id, sum(n) AS w FROM m GROUP BY doc_id),
  c AS (SELECT s.doc_id, s.i, coalesce(ups, []) AS ups, s.i AS lo, coalesce(s.e, 1000000000) AS hi FROM s JOIN anc USING (doc_id, i) JOIN tot USING (doc_id) LEFT JOIN s q ON q.doc_id = s.doc_id AND q.i = s.p
        WHERE s.wc <= 200 AND w > 200 AND (q.i IS NULL OR q.wc > 200)
      UNION ALL SELECT s.doc_id, s.i, list_append(coalesce(ups, []), s.text), s.i + 1, coalesce((SELECT min(b.i) FROM s b WHERE b.doc_id = s.doc_id AND b.i > s.i), 1000000000) FROM s JOIN anc USING (doc_id, i) JOIN tot USING (doc_id) WHERE s.wc > 200 AND w > 200
      UNION ALL SELECT doc_id, -1, [], 0, CASE WHEN w <= 200 THEN 1000000000 ELSE (SELECT coalesce(min(b.i), 1000000000) FROM s b WHERE b.doc_id = tot.doc_id) END FROM tot),
  g AS (SELECT c.doc_id, c.i, c.ups, string_agg(m.text, chr(10) ORDER BY m.i) AS body, bool_or(m.text <> '') AS any_text FROM c JOIN m ON m.doc_id = c.doc_id AND m.i >= lo AND m.i < hi GROUP BY ALL),
  x AS (SELECT doc_id, i AS start_line, trim(regexp_replace(CASE WHEN len(ups) > 0 THEN array_to_string(ups, chr(10) || chr(10)) || chr(10) || chr(10) ELSE '' END || body, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text,
      len(regexp_extract_all(body, '[\\p{L}\\p{N}_]+')) AS word_count FROM g WHERE any_text)"""


@query(_SOFT + " SELECT doc_id, start_line, text, word_count FROM x")
def soft_chunks(spark, sf):
    r = C.finished(C.soft_chunks(C.lines(synth_md(spark, sf)), 200), 0)
    return r.select("doc_id", F.col("start_line").cast("long").alias("start_line"), "text", F.col("word_count").cast("long").alias("word_count"))


@query(_SOFT + " SELECT doc_id, start_line, word_count FROM x WHERE word_count >= 60")
def min_filter(spark, sf):
    r = C.finished(C.soft_chunks(C.lines(synth_md(spark, sf)), 200), 60)
    return r.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("word_count").cast("long").alias("word_count"))


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  k AS (SELECT doc_id, i, len(regexp_extract_all(t, '\S+')) AS n, len(regexp_extract_all({_nfkd('t')}, '{_WORD}')) AS w, NOT (starts_with(trim(t), '- ') OR starts_with(trim(t), '|') OR starts_with(trim(t), '#') OR starts_with(trim(t), '<table>')) AS plain FROM l),
  d AS (SELECT doc_id, sum(w) AS wc, sum(w) // (sum(w) // 400 + 1) AS size FROM k GROUP BY doc_id),
  r AS (SELECT k.doc_id, k.i, k.n, 0 AS piece, k.plain AND k.n > size AND wc >= 400 AS cut FROM k JOIN d USING (doc_id) WHERE i = 0
    UNION ALL SELECT k.doc_id, k.i, CASE WHEN r.cut THEN k.n ELSE r.n + k.n END, CASE WHEN r.cut THEN r.piece + 1 ELSE r.piece END, k.plain AND (CASE WHEN r.cut THEN k.n ELSE r.n + k.n END) > size AND wc >= 400
      FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1 JOIN d ON d.doc_id = k.doc_id)
  SELECT r.doc_id, CASE WHEN wc >= 400 THEN min(r.i) ELSE -1 END AS start_line, count(*) AS n_lines, sum(k.w)::BIGINT AS word_count
  FROM r JOIN k USING (doc_id, i) JOIN d USING (doc_id) GROUP BY r.doc_id, piece, wc HAVING sum(k.w) >= 15""")
def hard_chunks(spark, sf):
    r = C.MarkdownChunker().chunk(C.lines(_docs(spark, sf)))
    return r.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.size("content").cast("long").alias("n_lines"), F.col("word_count").cast("long").alias("word_count"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  k AS (SELECT doc_id, i, len(regexp_extract_all(t, '\S+')) AS n FROM l),
  d AS (SELECT doc_id, sum(n) AS total, sum(n) // (sum(n) // 150 + 1) AS per FROM k GROUP BY doc_id),
  r AS (SELECT k.doc_id, k.i, k.n AS cur, CASE WHEN total >= 150 AND k.n > 150 THEN 0 ELSE 1 END AS held, 0 AS piece, total >= 150 AND k.n > 150 AS over, k.n FROM k JOIN d USING (doc_id) WHERE i = 0
    UNION ALL SELECT doc_id, i, CASE WHEN over THEN prev WHEN cut THEN n ELSE prev + n END, CASE WHEN over THEN 0 ELSE 1 END, CASE WHEN over OR cut OR last_over THEN piece + 1 ELSE piece END, over, n
      FROM (SELECT k.doc_id, k.i, k.n, CASE WHEN r.over AND r.i = 0 THEN 0 ELSE r.cur END AS prev, r.piece, r.over AS last_over, d.total >= 150 AND k.n > 150 AS over, d.total >= 150 AND (CASE WHEN r.over AND r.i = 0 THEN 0 ELSE r.cur END) + k.n > d.per AND r.held = 1 AS cut
        FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1 JOIN d ON d.doc_id = k.doc_id)),
  g AS (SELECT r.doc_id, piece, min(r.i) AS first_line, count(*) AS n_lines, bool_or(over) AS over, max(r.n) AS n FROM r GROUP BY r.doc_id, piece)
  SELECT g.doc_id, CASE WHEN total >= 150 THEN first_line ELSE -1 END AS start_line, CASE WHEN over THEN (n // 150 + 1) ELSE 1 END AS pieces, n_lines FROM g JOIN d USING (doc_id)""")
def token_chunks(spark, sf):
    r = C.token_chunks(C.soft_chunks(C.lines(_docs(spark, sf)), 1 << 30), 150)
    g = r.groupBy("doc_id", "start_line", F.get("content", F.lit(0))["line_idx"].alias("l")).agg(F.count("*").alias("pieces"), F.max(F.size("content")).cast("long").alias("n_lines"))
    return g.select("doc_id", F.col("start_line").cast("long").alias("start_line"), "pieces", "n_lines")


@query(r"""WITH w AS (SELECT n_regionkey, greatest(length('n_nationkey') + 2, max(length(n_nationkey::VARCHAR))) AS a, greatest(length('n_name') + 2, max(length(n_name))) AS b FROM nation GROUP BY n_regionkey),
  l AS (SELECT n_regionkey, n_nationkey AS k, '| ' || lpad(n_nationkey::VARCHAR, a::INT, ' ') || ' | ' || rpad(n_name, b::INT, ' ') || ' |' AS l FROM nation JOIN w USING (n_regionkey))
  SELECT n_regionkey AS doc_id, regexp_replace(regexp_replace('| ' || lpad('n_nationkey', any_value(a)::INT, ' ') || ' | ' || rpad('n_name', any_value(b)::INT, ' ') || ' |' || chr(10) || '|' || repeat('-', (any_value(a) + 1)::INT) || ':|:' || repeat('-', (any_value(b) + 1)::INT) || '|' || chr(10)
    || string_agg(l, chr(10) ORDER BY k), '\s{3,}', '  ', 'g'), '-{3,}', '---', 'g') AS md FROM l JOIN w USING (n_regionkey) GROUP BY n_regionkey""")
def rows_to_pipe_table(spark, sf):
    return parsers.parse_csv(_csv_docs(_t(spark, sf, "nation"), "n_regionkey", ["n_nationkey", "n_name"]), "markdown_table", ",").select("doc_id", "md")


def _csv_docs(df: DataFrame, doc_id: str, columns: list[str]) -> DataFrame:
    """A CSV document for each value of a column, rows in order of the first of the columns."""
    line = F.struct(F.col(columns[0]).alias("k"), F.concat_ws(",", *columns).alias("l"))
    g = df.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(line)).alias("r"))
    return g.select("doc_id", F.concat(F.lit(",".join(columns) + "\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n")).alias("raw"))


@query("""SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || p_size || ',"missing":null}' AS line FROM part""")
def csv_to_jsonl(spark, sf):
    docs = _csv_docs(_t(spark, sf, "part").withColumn("missing", F.lit("")), "p_size", ["p_partkey", "p_name", "p_size", "missing"])
    lines = parsers.parse_csv(docs, "json_lines", ",").select(F.explode(F.split("md", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.get_json_object("line", "$.p_partkey").cast("long").alias("p_partkey"), "line")


@query("""WITH r AS (SELECT o_custkey, 3 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS k FROM orders),
  g AS (SELECT o_custkey, sum(k) / (5.0 * count(*)) AS d, 0.6 + 0.2 * (o_custkey % 3) AS h, 1 - stddev_samp(k) / avg(k) AS e FROM r GROUP BY o_custkey HAVING count(*) > 1)
  SELECT o_custkey, round(d, 6) AS density, round(h, 6) AS named, round(e, 6) AS evenness, d >= 0.6 AND o_custkey % 3 > 0 AND e >= 0.7 AS csv_like FROM g""")
def csv_like_score(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, 1).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, 1).alias("b"))

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        blank = 2 - key[0] % 3  # columns without a name
        names = ["key", "one", "two", "three", "four"][: 5 - blank] + [f"Unnamed: {i}" for i in range(blank)]
        measures = parsers.row_measures(names, [5 - row.count(None) for row in rows])
        return [(key[0], *(round(x, 6) for x in measures), parsers.measures_like(*measures))]

    return map_groups(o, ["o_custkey"], ["o_orderkey"], one, "o_custkey long, density double, named double, evenness double, csv_like boolean")


@query("""SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN '```python' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) ELSE text || chr(10) || chr(10) END, '' ORDER BY turn, role, text) AS md FROM conversations GROUP BY conv_id""")
def notebook_to_md(spark, sf):
    c = _t(spark, sf, "conversations")
    cell = F.struct("turn", "role", "text")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(cell)).alias("c"))
    cells = F.transform("c", lambda x: F.struct(F.when(x["role"] == "assistant", "code").otherwise("markdown").alias("cell_type"), x["text"].alias("source"), F.lit(None).cast("string").alias("language")))
    return g.select("conv_id", parsers.cells_to_markdown(cells, F.lit("python")).alias("md"))


@query("SELECT doc_id, trim(text, ' ' || chr(10)) AS md FROM documents")
def envelope_roundtrip(spark, sf):
    d = _t(spark, sf, "documents")
    raw = F.to_json(F.struct(F.lit("Document").alias("@type"), F.lit("text/markdown").alias("fileFormat"), F.array(F.struct(F.col("text"), F.lit(0).alias("position"))).alias("hasPart")))
    return parsers.parse_envelope(d.select("doc_id", raw.alias("raw"))).select("doc_id", T.strip(F.col("md")).alias("md"))


@query()
def html_to_md(spark, sf):
    return parsers.parse_html(_t(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("raw"))).select("doc_id", "md")


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<li><a ')) AS links, regexp_matches(html, '<h1>') AS headed FROM pages""")
def html_links(spark, sf):
    md = H.html_to_markdown("html")
    return T.small_batches(_t(spark, sf, "pages")).select("page_id", F.regexp_count(md, F.lit(r"(?m)^- \[")).cast("long").alias("links"), md.rlike("(?m)^# ").alias("headed"))


@query()
def html_chunks(spark, sf):
    docs = _t(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("raw"))
    r = C.MarkdownChunker().chunk(parsers.parsed_lines(docs, "html"))
    return sinks.records(r)


#: A span per line: 40 lines a page; line 0 of a page is a heading in a larger font at a fixed place.
_SPANS = r"""sp AS (SELECT doc_id, (i // 40)::INT AS page, i::INT AS "order", 50.0 + 10 * (i % 3) AS x0, 20.0 + 14 * (i % 40) + CASE WHEN i % 40 > 20 THEN 9 ELSE 0 END AS y0,
    50.0 + 10 * (i % 3) + 4 * length(t) AS x1, 32.0 + 14 * (i % 40) + CASE WHEN i % 40 > 20 THEN 9 ELSE 0 END AS y1, t AS text, trim(t) AS tt,
    CASE WHEN i % 40 = 0 THEN 18.0 WHEN i % 11 = 5 THEN 14.0 ELSE 10.0 END AS size, CASE WHEN i % 7 = 3 THEN 16 ELSE 0 END AS flags
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))"""


def synth_spans(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).repartition("doc_id")  # whole documents travel once; all that follows is by doc_id, or finer
    d = d.select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("i", "text"))
    x0 = 50.0 + 10 * (F.col("i") % 3)
    y0 = 20.0 + 14 * (F.col("i") % 40) + F.when(F.col("i") % 40 > 20, 9).otherwise(0)
    size = F.when(F.col("i") % 40 == 0, 18.0).when(F.col("i") % 11 == 5, 14.0).otherwise(10.0)
    return d.select("doc_id", F.floor(F.col("i") / 40).cast("int").alias("page"), F.col("i").alias("order"), x0.alias("x0"), y0.alias("y0"), (x0 + 4 * F.length("text")).alias("x1"), (y0 + 12).alias("y1"), x0.alias("ox"), (y0 + 12).alias("oy"), "text", F.lit("serif").alias("font"), size.alias("size"), F.when(F.col("i") % 7 == 3, 16).otherwise(0).alias("flags"), F.lit(1.0).alias("dir_x"), F.lit(0.0).alias("dir_y"))


@query(f'WITH {_SPANS} SELECT doc_id, "order", max(page) OVER (PARTITION BY doc_id) + 1 > 2 AND count(*) OVER (PARTITION BY doc_id, x0, y0, x1, y1) > (max(page) OVER (PARTITION BY doc_id) + 1) / 3.0 AS is_hf FROM sp')
def header_footer_flags(spark, sf):
    return layout.flag_repeated(synth_spans(spark, sf)).select("doc_id", "order", "is_hf")


_LINES = _SPANS + """, li AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY "order")::INT AS line_id FROM
    (SELECT *, CASE WHEN lag(y1) OVER w IS NULL THEN 1 WHEN abs(y1 - lag(y1) OVER w) > greatest(3.0, 0.25 * lag(y1 - y0) OVER w) THEN 1 ELSE 0 END AS s FROM sp WINDOW w AS (PARTITION BY doc_id, page ORDER BY "order"))),
  bs AS (SELECT doc_id, size AS body FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min("order")) AS r FROM li WHERE tt <> '' GROUP BY doc_id, size) WHERE r = 1),
  gp AS (SELECT doc_id, "order", size, round(y0 - lag(y1) OVER w, 1) AS gap, lag(size) OVER w AS s, y0 >= lag(y0) OVER w AS down FROM li WINDOW w AS (PARTITION BY doc_id ORDER BY "order")),
  sg AS (SELECT doc_id, gap AS spacing FROM (SELECT doc_id, gap, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(size = body AND s = body, false) DESC, count(*) DESC, min("order")) AS r
    FROM gp LEFT JOIN bs USING (doc_id) WHERE down GROUP BY doc_id, gap, coalesce(size = body AND s = body, false)) WHERE r = 1)"""


@query(f'WITH {_LINES} SELECT doc_id, "order", page, line_id FROM li')
def span_lines(spark, sf):
    return layout.lines(synth_spans(spark, sf)).select("doc_id", "order", "page", "line_id")


def _line_table(spark, sf):
    return layout.line_table(layout.lines(synth_spans(spark, sf)))


@query(f"WITH {_LINES} SELECT doc_id, spacing FROM sg")
def line_spacing_mode(spark, sf):
    return layout.line_spacing(_line_table(spark, sf))


_BLOCKED = _LINES + """, lb AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY "order")::INT AS block_id FROM
  (SELECT li.* EXCLUDE (s), coalesce(lag(tt) OVER w = '' OR lag(size) OVER w <> size OR y0 - lag(y1) OVER w > coalesce(spacing, 0) + 2 OR y1 <= lag(y0) OVER w, true)::INT AS s
   FROM li LEFT JOIN sg ON sg.doc_id = li.doc_id WINDOW w AS (PARTITION BY li.doc_id ORDER BY "order")))"""


@query(f'WITH {_BLOCKED} SELECT doc_id, "order", block_id FROM lb')
def line_blocks(spark, sf):
    r = _line_table(spark, sf)
    return layout.blocks(r, layout.line_spacing(r)).select("doc_id", "order", "block_id")


_FONTS = _BLOCKED + """, fz AS (SELECT doc_id, size::INT AS size, count(*) FILTER (WHERE tt <> '') AS n, count(*) FILTER (WHERE tt <> '' AND flags = 16) AS b, sum(count(*)) OVER (PARTITION BY doc_id) AS al FROM li GROUP BY doc_id, size),
  fo AS (SELECT doc_id, coalesce(list(size ORDER BY size) FILTER (WHERE n > 0.1 * al), []) AS sizes, coalesce(list(size ORDER BY size) FILTER (WHERE n > 0), []) AS all_sizes,
    coalesce(sum(b) FILTER (WHERE n > 0.1 * al), 0) > 0.3 * coalesce(sum(n) FILTER (WHERE n > 0.1 * al), 0) AS body_bold FROM fz GROUP BY doc_id),
  bk AS (SELECT doc_id, block_id, min("order") AS "order", any_value(size)::INT AS size, string_agg(tt, ' ' ORDER BY "order") AS text, bool_and(flags = 16 OR tt = '') AS bold, bool_and(tt = '') AS empty FROM lb GROUP BY doc_id, block_id),
  ab AS (SELECT bk.*, list_max(sizes) AS big, body_bold, len([x FOR x IN all_sizes IF x > list_max(sizes)]) AS above, len([x FOR x IN all_sizes IF x >= size]) AS rank FROM bk JOIN fo USING (doc_id) WHERE NOT empty AND length(text) <= 100 AND len(sizes) > 0),
  lv AS (SELECT doc_id, block_id, "order", CASE WHEN regexp_matches(text, '^\\d+[\\s.)]+\\d+[\\s.)]+\\d+') THEN 3 WHEN regexp_matches(text, '^\\d+[\\s.)]+\\d+') THEN 2 WHEN regexp_matches(text, '^\\d+') THEN 1
      WHEN size > big THEN rank ELSE least(above, 5) + 1 END::BIGINT AS level FROM ab WHERE (size > big AND rank <= 5) OR (size = big AND bold AND NOT body_bold))"""


@query(f"WITH {_FONTS} SELECT doc_id, array_to_string(sizes, ',') AS sizes, body_bold FROM fo")
def font_body_sizes(spark, sf):
    r = layout.body_fonts(_line_table(spark, sf))
    return r.select("doc_id", F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"), "body_bold")


def _blocks(spark, sf):
    r = _line_table(spark, sf)
    return layout.block_table(layout.blocks(r, layout.line_spacing(r))), layout.body_fonts(r)


@query(f'WITH {_FONTS} SELECT doc_id, "order", level FROM lv')
def font_levels(spark, sf):
    return layout.size_levels(*_blocks(spark, sf)).select("doc_id", "order", F.col("level").cast("long").alias("level"))


@query(r"""SELECT l_orderkey AS doc_id, title, page, level FROM (SELECT l_orderkey, l_linenumber::INT || '.' || (l_linenumber % 3)::INT || ' part ' || l_partkey AS title, (l_suppkey % 90)::INT AS page, 2 AS level FROM lineitem)""")
def toc_schema(spark, sf):
    li = _t(spark, sf, "lineitem")
    title = F.concat(F.col("l_linenumber").cast("int"), F.lit("."), (F.col("l_linenumber") % 3).cast("int"), F.lit(" part "), "l_partkey")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("int").alias("line_id"), F.col("l_linenumber").cast("int").alias("order"), F.lit(50.0).alias("x0"), F.concat(title, F.lit(" ......... "), (F.col("l_suppkey") % 90).cast("int")).alias("text"))
    return layout.toc_lines(rows).select("doc_id", "title", "page", "level")


@query(r"""SELECT l_orderkey AS doc_id, 'part ' || l_partkey AS title, (l_suppkey % 90)::INT AS page, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3)::INT AS level FROM lineitem""")
def toc_offset(spark, sf):
    li = _t(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("int").alias("line_id"), F.col("l_linenumber").cast("int").alias("order"), (F.col("l_linenumber") % 3 * 10.0).alias("x0"), F.concat(F.lit("part "), "l_partkey", F.lit(" . . . . "), (F.col("l_suppkey") % 90).cast("int")).alias("text"))
    return layout.toc_lines(rows).select("doc_id", "title", "page", F.col("level").cast("int").alias("level"))


_BOXES = "SELECT doc_id, p AS page, 0.0 AS x0, 100.0 AS y0, 300.0 AS x1, 100.0 + 10 * (doc_id % 20) AS y1 FROM documents, (SELECT unnest([0, 1]) AS p)"


@query(f"""WITH {_SPANS}, bx AS ({_BOXES}) SELECT doc_id, "order", EXISTS (SELECT 1 FROM bx WHERE bx.doc_id = sp.doc_id AND bx.page = sp.page AND sp.x0 BETWEEN bx.x0 AND bx.x1 AND sp.y1 BETWEEN bx.y0 AND bx.y1) AS in_table FROM sp""")
def span_in_table(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("page"))
    boxes = d.select("doc_id", "page", F.lit(0.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(300.0).alias("x1"), (100.0 + 10 * (F.col("doc_id") % 20)).alias("y1"))
    return layout.inside_tables(synth_spans(spark, sf), boxes).select("doc_id", "order", "in_table")


@query(f"""WITH {_SPANS}, lk AS (SELECT doc_id, page, "order" AS k, x0 + 2 AS a0, y0 + 3 AS b0, x0 + 30 AS a1, y1 + doc_id % 12 AS b1 FROM sp WHERE "order" % 9 = 4),
  h AS (SELECT lk.doc_id, lk.page, k, sp."order" AS o, greatest(least(x1, a1) - greatest(x0, a0), 0) * greatest(least(y1, b1) - greatest(y0, b0), 0) AS area FROM lk JOIN sp ON sp.doc_id = lk.doc_id AND sp.page = lk.page),
  g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY area DESC, o) AS r, count(*) OVER (PARTITION BY doc_id, k) AS n, max(area) OVER (PARTITION BY doc_id, k) AS best FROM h WHERE area > 0),
  s AS (SELECT doc_id, k, max(n) AS n, max(best) AS best, max(CASE WHEN r = 1 THEN o END) AS o1, max(CASE WHEN r = 2 THEN area END) AS a2, arg_min(o, (-area, o)) FILTER (WHERE area < best) AS o2 FROM g GROUP BY doc_id, k)
  SELECT doc_id, 'u' || k AS uri, CASE WHEN n = 1 OR best / 2 > a2 THEN o1 ELSE o2 END AS "order" FROM s WHERE (CASE WHEN n = 1 OR best / 2 > a2 THEN o1 ELSE o2 END) IS NOT NULL""")
def link_binding(spark, sf):
    s = synth_spans(spark, sf)
    links = s.where(F.col("order") % 9 == 4).select("doc_id", "page", F.concat(F.lit("u"), "order").alias("uri"), (F.col("x0") + 2).alias("x0"), (F.col("y0") + 3).alias("y0"), (F.col("x0") + 30).alias("x1"), (F.col("y1") + F.col("doc_id") % 12).alias("y1"))
    return layout.bind_links(s, links).select("doc_id", "uri", "order")


#: Ruled grids: a document has (3 + doc_id % 3) horizontal and (3 + doc_id % 2) vertical lines a page, slightly off.
_SEG = """sg AS (SELECT doc_id, 0 AS page, k AS seg_id, 10.0 AS x0, 10.0 + 20 * k AS y0, 10.0 + 30 * (2 + doc_id % 2) AS x1, 10.0 + 20 * k AS y1 FROM documents, (SELECT unnest(range(6)) AS k) WHERE k < 3 + doc_id % 3
  UNION ALL SELECT doc_id, 0, 100 + k, 10.0 + 30 * k + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END, 9.0, 10.0 + 30 * k + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END, 10.0 + 20 * (2 + doc_id % 3) FROM documents, (SELECT unnest(range(6)) AS k) WHERE k < 3 + doc_id % 2
  UNION ALL SELECT doc_id, 0, 200, 500.0, 500.0, 600.0, 500.0 FROM documents)"""


def synth_segments(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    k, doc = F.col("k"), F.col("doc_id")
    h = d.where(k < 3 + doc % 3).select("doc_id", F.lit(0).alias("page"), k.alias("seg_id"), F.lit(10.0).alias("x0"), (10.0 + 20 * k).alias("y0"), (10.0 + 30 * (2 + doc % 2)).alias("x1"), (10.0 + 20 * k).alias("y1"))
    x = 10.0 + 30 * k + F.when(doc % 4 == 0, 1).otherwise(0)
    v = d.where(k < 3 + doc % 2).select("doc_id", F.lit(0).alias("page"), (100 + k).alias("seg_id"), x.alias("x0"), F.lit(9.0).alias("y0"), x.alias("x1"), (10.0 + 20 * (2 + doc % 3)).alias("y1"))
    far = _docs(spark, sf).select("doc_id", F.lit(0).alias("page"), F.lit(200).alias("seg_id"), F.lit(500.0).alias("x0"), F.lit(500.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(500.0).alias("y1"))
    return h.unionByName(v).unionByName(far)


_POINTS = _SEG + """, pt AS (SELECT DISTINCT h.doc_id, v.x0 AS x, h.y0 AS y FROM sg h JOIN sg v ON h.doc_id = v.doc_id AND h.y0 = h.y1 AND v.x0 = v.x1 AND v.x0 BETWEEN h.x0 - 3 AND h.x1 + 3 AND h.y0 BETWEEN v.y0 - 3 AND v.y1 + 3)"""


@query(f"WITH {_POINTS} SELECT doc_id, x, y FROM pt")
def line_intersections(spark, sf):
    return tables.intersections(synth_segments(spark, sf)).select("doc_id", "x", "y")


_GRID = _POINTS + """, xs AS (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS x1 FROM (SELECT DISTINCT doc_id, x FROM pt)), ys AS (SELECT doc_id, y, lead(y) OVER (PARTITION BY doc_id ORDER BY y) AS y1 FROM (SELECT DISTINCT doc_id, y FROM pt)),
  ce AS (SELECT doc_id, x AS x0, y AS y0, x1, y1 FROM xs JOIN ys USING (doc_id) WHERE x1 IS NOT NULL AND y1 IS NOT NULL)"""


@query(f"WITH {_GRID} SELECT doc_id, x0, y0, x1, y1 FROM ce")
def grid_cells(spark, sf):
    return tables.unit_cells(tables.intersections(synth_segments(spark, sf))).drop("page")


@query(f"WITH {_GRID} SELECT doc_id, count(*) AS cells, sum((x1 - x0) * (y1 - y0)) AS area, abs(sum((x1 - x0) * (y1 - y0)) - (max(x1) - min(x0)) * (max(y1) - min(y0))) <= 0.001 * (max(x1) - min(x0)) * (max(y1) - min(y0)) AS sane FROM ce GROUP BY doc_id")
def cell_area_check(spark, sf):
    return tables.area_check(tables.unit_cells(tables.intersections(synth_segments(spark, sf)))).select("doc_id", "cells", "area", "sane")


@query(f"""WITH {_SEG}, v AS (SELECT DISTINCT doc_id, x0 AS v FROM sg UNION SELECT DISTINCT doc_id, x1 FROM sg),
  c AS (SELECT *, sum(CASE WHEN v - p >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY v)::INT AS cluster FROM (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY v) AS p FROM v))
  SELECT doc_id, v, cluster, round(avg(v) OVER (PARTITION BY doc_id, cluster), 6) AS grid FROM c""")
def grid_cluster(spark, sf):
    s = synth_segments(spark, sf)
    v = s.select("doc_id", "page", F.explode(F.array("x0", "x1")).alias("v"))
    return tables.grid_values(v).select("doc_id", "v", "cluster", F.round("grid", 6).alias("grid"))


@query(f"""WITH RECURSIVE {_SEG}, e AS (SELECT a.doc_id, a.seg_id AS a, b.seg_id AS b FROM sg a JOIN sg b ON a.doc_id = b.doc_id AND a.x0 - 3 <= b.x1 AND b.x0 - 3 <= a.x1 AND a.y0 - 3 <= b.y1 AND b.y0 - 3 <= a.y1),
  r AS (SELECT doc_id, seg_id AS a, seg_id AS b FROM sg UNION SELECT r.doc_id, r.a, e.b FROM r JOIN e ON r.doc_id = e.doc_id AND r.b = e.a) SELECT doc_id, a AS seg_id, min(b)::INT AS table_id FROM r GROUP BY doc_id, a""")
def segment_components(spark, sf):
    return tables.group_lines(synth_segments(spark, sf)).select("doc_id", F.col("seg_id").cast("long").alias("seg_id"), "table_id")


@query("SELECT doc_id, (2 + doc_id % 3) * (2 + doc_id % 2) AS cells, 0 AS table_id FROM documents")
def table_cells(spark, sf):
    return tables.find_cells(synth_segments(spark, sf)).groupBy("doc_id", "table_id").agg(F.count("*").alias("cells")).select("doc_id", "cells", "table_id")


@query("""SELECT vec_id, list_sum([CASE WHEN abs(x) >= 0.1 THEN 1 ELSE 0 END FOR x IN embedding[1:3]])::BIGINT AS n_classes, abs(embedding[1]) >= 0.1 AS needs_image FROM embeddings""")
def prediction_format(spark, sf):
    e = _t(spark, sf, "embeddings")
    p = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    r = e.select("vec_id", classify.prediction(p, ["image", "table", "text"], 0.1, ["image"]).alias("p"))
    return r.select("vec_id", F.size("p.predicted_classes").cast("long").alias("n_classes"), F.col("p.needs_image_embedding").alias("needs_image"))


@query()
def title_fuzzy_match(spark, sf):
    r = _line_table(spark, sf)
    titles = r.select("doc_id", F.col("page"), F.concat(F.substring("text", 1, 30), F.expr("substring(text, 33)")).alias("title"))
    return layout.match_titles(titles, r)


_MARKDOWN = _FONTS + r""", pc AS (SELECT doc_id, block_id, "order", tt, CASE WHEN flags = 16 AND tt <> '' THEN '**' || tt || '**' ELSE tt END AS md,
    starts_with(tt, '- ') OR regexp_matches(tt, '^\s*(\d+[.)]\s+|[a-zA-Z][.)]\s+|\([a-zA-Z0-9ivxlIVXL]+\)\s+)') AS alone FROM lb),
  pn AS (SELECT *, coalesce(NOT starts_with(lag(tt) OVER w, '- ') AND NOT alone AND ends_with(lag(md) OVER w, '-') AND regexp_matches(tt, '^\p{Ll}'), false) AS goes FROM pc WINDOW w AS (PARTITION BY doc_id, block_id ORDER BY "order")),
  pp AS (SELECT *, lead(goes, 1, false) OVER (PARTITION BY doc_id, block_id ORDER BY "order") AS cut FROM pn),
  bm AS (SELECT doc_id, block_id, min("order") AS "order", trim(string_agg(CASE WHEN alone THEN chr(10) || chr(10) WHEN goes THEN '' ELSE ' ' END || CASE WHEN cut THEN md[:-2] ELSE md END || CASE WHEN alone AND NOT cut THEN chr(10) || chr(10) ELSE '' END, '' ORDER BY "order"), ' ' || chr(10)) AS md FROM pp GROUP BY doc_id, block_id),
  bt AS (SELECT bm.doc_id, bm."order", trim(regexp_replace(replace(regexp_replace(CASE WHEN md <> '' AND level IS NOT NULL THEN repeat('#', (level + 1)::INT) || ' ' || md ELSE md END, '\*\* *\*\*', ' ', 'g'), ' ** ', '**' || chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t
    FROM bm LEFT JOIN lv USING (doc_id, block_id))"""


@query(f"""WITH {_MARKDOWN} SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY "order") AS md FROM bt WHERE t <> '' GROUP BY doc_id""")
def spans_to_markdown(spark, sf):
    blocks, fonts = _blocks(spark, sf)
    return layout.markdown(layout.items(blocks, layout.size_levels(blocks, fonts)))


@query()
def spans_to_chunks(spark, sf):
    d = _docs(spark, sf).select("doc_id")
    pages = synth_spans(spark, sf).groupBy("doc_id").agg((F.max("page") + 1).alias("page_count")).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page"), F.lit(600.0).alias("width"), F.lit(600.0).alias("height"), "page_count")
    parsed = document.parse(synth_spans(spark, sf), drawings=synth_segments(spark, sf).join(d, "doc_id"), pages=pages)
    r = C.MarkdownChunker().chunk(parsed.line_rows())
    return r.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"), F.col("word_count").cast("long").alias("word_count"), "text")

"""Column functions over markdown text. Patterns follow Python's Unicode rules, hence the (?U) and (?d) flags."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Fixed value: image types whose inline data are removed.
IMAGE_TYPES = "bmp|gif|ico|jpg|jpeg|png|svg\\+xml|webp|x-icon"
WORD = "[\\p{L}\\p{N}_]+"
_SPACE = "[\\s\\x1c-\\x1f]"
#: Fixed value: the pattern of links and images.
LINK = "(?d)\\[?!?\\[(.*?)\\](\\(.*\\)\\])?\\((.*\\..+?)(\\s.*)?\\)"


#: Bytes of an Arrow batch of whole documents: a worker holds it several times over, as strings and as results.
BATCH_BYTES = 1 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, whose session hands documents to Python by their bytes; by rows alone a batch is as large as its texts."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{_SPACE}+|{_SPACE}+$(?!\\n)", "")


def squeeze(c: Column) -> Column:
    """Three or more newlines become two; outer white space goes."""
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def cleanup(c: Column, more_types: str = "") -> Column:
    c = F.regexp_replace(strip(c), f"(?U)(?:\n{_SPACE}*){{3,}}", "\n\n")
    return F.regexp_replace(c, f"data:image/({IMAGE_TYPES}{more_types});base64,[A-Za-z0-9+/]+=*", "")


def cleanup_html(c: Column) -> Column:
    return cleanup(c, "|svg")


def remove_links(c: Column) -> Column:
    return F.regexp_replace(c, LINK, "$1")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("int")


def blank_word_count(c: Column) -> Column:
    """Words between runs of white space."""
    return F.regexp_count(c, F.lit(f"(?U)[^\\s\\x1c-\\x1f]+")).cast("int")


@F.pandas_udf(S.StringType())
def normal_lines(md: pd.Series) -> pd.Series:
    """Every line stripped and in Unicode's compatibility decomposition."""
    return md.map(lambda s: None if s is None else "\n".join(x.strip() if x.isascii() else unicodedata.normalize("NFKD", x.strip()) for x in s.split("\n")))


#: Fixed value: what Python's strip() takes for white space.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def with_normal_line(rows: DataFrame, line: str, name: str) -> DataFrame:
    """normal_lines() for a column of single lines. Only lines beyond ASCII go through Python, so its workers hold a batch
    of those and never a document."""
    bare = F.trim(F.col(line), F.lit(BLANKS))
    rows = rows.withColumn(name, bare).withColumn("_wide", nfkd(F.when(F.octet_length(line) > F.length(line), bare)))
    return rows.withColumn(name, F.coalesce("_wide", name)).drop("_wide")


def is_fence(line: Column) -> Column:
    """A line that opens or closes a code block."""
    return line.startswith("```") & ~F.substring(line, 4, 1 << 30).contains("```")


def is_header(text: Column, in_code: Column) -> Column:
    return text.rlike("^[- ]*#") & ~in_code


def header_level(text: Column) -> Column:
    return F.least(F.length(F.regexp_extract(text, "^[- ]*(#+)", 1)), F.lit(6))


def is_bullet(text: Column) -> Column:
    return text.startswith("- ")


def in_table(text: Column) -> Column:
    return text.startswith("|") | text.startswith("<table>")


def join_lines(texts: Column) -> Column:
    """A document's text: header lines get a blank line on either side."""
    return squeeze(F.array_join(F.transform(texts, lambda t: F.when(t.startswith("#"), F.concat(F.lit("\n"), t, F.lit("\n"))).otherwise(t)), "\n"))


def page_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, page, text) of lines: header lines get a blank line on either side. Lines without a page are one page."""
    line = F.when(F.col("text").startswith("#"), F.concat(F.lit("\n"), "text", F.lit("\n\n"))).otherwise(F.concat("text", F.lit("\n")))
    parts = F.sort_array(F.collect_list(F.struct("line_idx", line.alias("t"))))
    return rows.groupBy("doc_id", "page").agg(parts.alias("p")).select("doc_id", "page", squeeze(F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("text"))


def front_matter(md: Column) -> tuple[Column, Column]:
    """(YAML text or null, body): a block between a first line starting with --- and a later line of just ---."""
    lines = F.split(md, "\n", -1)
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    end = F.array_position(rest, "---").cast("int")
    has = md.startswith("---") & (end > 0)
    yaml = F.when(has, F.array_join(F.slice(rest, 1, F.greatest(end - 1, F.lit(0))), "\n"))
    body = F.array_join(F.slice(rest, end + 1, F.greatest(F.size(rest) - end, F.lit(0))), "\n")
    return yaml, F.when(has, strip(body)).otherwise(md)


@F.pandas_udf(S.MapType(S.StringType(), S.StringType()))
def parse_yaml(text: pd.Series) -> pd.Series:
    import yaml

    def one(t):
        if t is None:
            return {}
        try:
            got = yaml.safe_load(t)
        except yaml.YAMLError:
            return {}
        return {str(k): None if v is None else str(v) for k, v in got.items()} if isinstance(got, dict) else {}

    return text.map(one)


@F.pandas_udf(S.StringType())
def setext_to_atx(md: pd.Series) -> pd.Series:
    """Underlined headers become hashed ones, outside code blocks; a line goes if the next one is its underline. One
    pass over the lines of those documents that have an underline."""

    def one(s: str) -> str:
        if s is None or "\n===" not in s and "\n---" not in s:
            return s
        out: list[str] = []
        code, before = False, ""
        for line in s.split("\n"):
            code ^= line.startswith("```") and "```" not in line[3:]
            mark = "" if code or not before.strip() else {"===": "# ", "---": "## "}.get(line[:3], "")
            if mark:
                out[-1] = mark + before
            else:
                out.append(line)
            before = line
        return "\n".join(out)

    return md.map(one)


@F.pandas_udf(S.StringType())
def nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKD", s))


def markdown_clean(md: Column) -> tuple[Column, Column]:
    """(YAML, markdown with hashed headers) of a raw markdown string."""
    yaml, body = front_matter(cleanup(md))
    return yaml, setext_to_atx(body)

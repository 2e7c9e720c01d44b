"""HTML to markdown with the standard library: blocks, lists, links, emphasis and pipe tables.

Elements form a tree that tolerates unclosed and crossed tags; text of script, style and title is dropped. Tables whose
cells span rows or columns stay HTML with their attributes removed. The conversion is repeated until it changes nothing.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Elements without an end tag, without content, and with a line of their own.
VOID = {"br", "hr", "img", "meta", "link", "input", "col", "area", "base", "embed", "source", "track", "wbr"}
DROPPED = {"script", "style", "title", "noscript", "template"}
BLOCK = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "figure", "figcaption", "blockquote", "ul", "ol", "li", "table", "pre", "dl", "dt", "dd", "body", "html", "head", "form", "address"}
HEADERS = {f"h{i}": i for i in range(1, 7)}
KEPT_ATTRIBUTES = {"td": ("rowspan", "colspan"), "th": ("rowspan", "colspan"), "a": ("href", "title")}
#: Elements inside one another that are kept apart; deeper ones add nothing to markdown but their text.
DEPTH = 150


class _Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]
        self.shut: dict[str, int] = {}  # elements too deep to be kept apart, by tag

    def handle_starttag(self, tag, attrs):
        own = [n.tag for n in self.open]
        for closes, until in (({"p"}, BLOCK - {"body", "html", "head"} | set(HEADERS)), ({"li"}, {"li"}), ({"tr", "td", "th"}, {"tr"}), ({"td", "th"}, {"td", "th"})):
            if tag in until:
                inner = max((i for i, t in enumerate(own) if t in closes), default=0)
                limit = max((i for i, t in enumerate(own) if t in ({"table"} if closes & {"td", "tr"} else {"ul", "ol", "table", "td"})), default=0)
                if inner > limit:
                    del self.open[inner:]
                    own = own[:inner]
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            if len(self.open) < DEPTH:
                self.open.append(node)
            else:
                self.shut[tag] = self.shut.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if self.shut.get(tag):
            self.shut[tag] -= 1
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def _tree(text: str) -> _Node:
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def _raw(n: _Node | str) -> str:
    if isinstance(n, str):
        return html.escape(n, quote=False)
    names = dict.fromkeys(("rowspan", "colspan", *KEPT_ATTRIBUTES.get(n.tag, ())))
    keep = "".join(f' {k}="{n.attrs[k]}"' for k in names if k in n.attrs)
    return f"<{n.tag}{keep}>" + "".join(map(_raw, n.kids)) + ("" if n.tag in VOID else f"</{n.tag}>")


def _find(n: _Node, tags: set[str]) -> list[_Node]:
    out = []
    for k in n.kids:
        if isinstance(k, _Node):
            if k.tag in tags:
                out.append(k)
            elif k.tag != "table":
                out += _find(k, tags)
    return out


def pipe_table(header: list[str], rows: list[list[str]]) -> str:
    """A pipe table as the usual writers lay it out: numeric columns to the right, others to the left."""
    width = max([len(header), *map(len, rows)])
    header = header + [""] * (width - len(header))
    rows = [r + [""] * (width - len(r)) for r in rows]
    number = [all(re.fullmatch(r"[+-]?\d+(\.\d+)?", r[i]) for r in rows if r[i]) and any(r[i] for r in rows) for i in range(width)]
    wide = [max([len(header[i]) + 2, *(len(r[i]) for r in rows)]) for i in range(width)]
    line = lambda cells: "| " + " | ".join(c.rjust(w) if n else c.ljust(w) for c, w, n in zip(cells, wide, number, strict=True)) + " |"
    rule = "|" + "|".join("-" * (w + 1) + ":" if n else ":" + "-" * (w + 1) for w, n in zip(wide, number, strict=True)) + "|"
    return "\n".join([line(header), rule, *map(line, rows)])


def _table(n: _Node) -> str:
    cells = _find(n, {"tr"})
    grid = [[c for c in r.kids if isinstance(c, _Node) and c.tag in ("td", "th")] for r in cells]
    if any(str(c.attrs.get(a, "1")).strip() not in ("1", "") for r in grid for c in r for a in ("rowspan", "colspan")):
        return "\n\n" + re.sub(r"\s*\n\s*", "", _raw(n)) + "\n\n"
    rows = [[re.sub(r"\s+", " ", _inline(c)).strip() for c in r] for r in grid if r]
    if not rows:
        return "\n\n"
    return "\n\n" + re.sub(r" {2,}", " ", pipe_table(rows[0], rows[1:])) + "\n\n"


def _inline(n: _Node) -> str:
    return "".join(_convert(k, 0) for k in n.kids)


def _wrap(text: str, mark: str) -> str:
    core = text.strip()
    if not core:
        return text
    at = text.index(core)
    return text[:at] + mark + core + mark + text[at + len(core) :]


def _convert(n: _Node | str, depth: int, number: int | None = None) -> str:
    if isinstance(n, str):
        return n if not n.strip() and "\n" not in n else re.sub(r"[ \t]+", " ", n)
    t = n.tag
    if t in DROPPED:
        return ""
    if t == "table":
        return _table(n)
    if t == "br":
        return "\n"
    if t == "hr":
        return "\n\n---\n\n"
    if t == "img":
        return ""
    if t == "pre":
        return "\n```\n" + "".join(k if isinstance(k, str) else _inline(k) for k in n.kids).strip("\n") + "\n```\n"
    if t in ("ul", "ol"):
        k, out = 0, ""
        for x in n.kids:
            if isinstance(x, _Node) and x.tag == "li":
                k += 1
                out += _convert(x, depth + 1, k if t == "ol" else None)
            elif isinstance(x, _Node):
                out += _convert(x, depth)
        return "\n\n" + out + ("\n" if depth == 0 else "")
    inner = "".join(_convert(k, depth) for k in n.kids)
    if t == "li":
        mark = f"{number}." if number else "-*+"[(depth - 1) % 3]
        return f"{mark} " + re.sub(r"\n{2,}", "\n", inner.strip()).replace("\n", "\n  ") + "\n"
    if t in HEADERS:
        core = re.sub(r"\s+", " ", inner).strip()
        return f"\n\n{'#' * HEADERS[t]} {core}\n\n" if core else "\n"
    if t == "a":
        href = n.attrs.get("href", "")
        core = inner.strip()
        title = f' "{n.attrs["title"]}"' if n.attrs.get("title") else ""
        return f"[{core}]({href}{title})" if core and href else inner
    if t in ("b", "strong"):
        return _wrap(inner, "**")
    if t in ("i", "em"):
        return _wrap(inner, "*")
    if t in ("code", "kbd", "samp"):
        return _wrap(inner, "`")
    if t == "blockquote":
        return "\n" + "\n".join("> " + x for x in inner.strip().split("\n")) + "\n\n" if inner.strip() else ""
    if t in ("figcaption",):
        return "\n" + inner.strip() + "\n"
    if t in BLOCK:
        return "\n" + inner + "\n" if t != "p" else "\n\n" + inner.strip() + "\n\n"
    return inner


def _once(text: str) -> str:
    out = _convert(_tree(text), 0)
    out = re.sub(r"[ \t]*\n[ \t]*", "\n", out) if "```" not in out else re.sub(r"[ \t]+\n", "\n", out)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def _left(text: str) -> int:
    """Signs of tags and entities, which each pass must lessen."""
    return text.count("<") + text.count("&")


def to_markdown(text: str) -> str:
    """Markdown of an HTML string, with a blank line after each header."""
    if "<" not in text:
        out = text
    else:
        out = _once(text)
        while re.search(r"<[a-zA-Z/][^>]*>", re.sub(r"<table>.*?</table>", "", out, flags=re.S)):
            again = _once(out)
            if again == out or _left(again) >= _left(out):
                break
            out = again
    out = re.sub(r"[ \t]+", " ", re.sub(r"\s*\n\s*", "\n", out.strip()))  # as text read as HTML once more
    return re.sub(r"(?m)^(#{1,6} .+)$", r"\1\n", out)


@F.pandas_udf(S.StringType())
def html_to_markdown(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else to_markdown(s))

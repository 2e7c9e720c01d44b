"""URL verdicts by rules and by a tree of path templates.

Rules name a host, which fits its subdomains too, and a path prefix; the longest host and path that fit decide. URLs
that rules decide are the labels of the tree. The tree of a host is grown from the root; where all paths of a node share
their next segments, they are taken at once, and a node with one path is done, so that there are as many rounds as
places where paths part one after another, at any depth.

Where paths part, variable segments (numbers, hexadecimal ids, dates, long mixed ids) become wildcards of their kind.
Of the literal ones, those that are rare among many siblings become a wildcard. The others are compared with the largest
sibling that has the same commonest continuation (the segment that follows, or the end): a branch merges with it if
neither the counts of all their continuations (two-sample chi-square, one per cent) nor their labelled shares differ.
Branches whose labels are known do not merge with branches whose are not. A node with several merged groups names each
by its continuation.

A template's purity is the smoothed share of blocked labels, with that of its siblings under the same parent as the
prior; templates above a threshold are rejected. Hosts without any label keep the prior.

All steps are aggregations over distinct (host, path) and joins in which keys of over a thousandth of the rows are
broadcast, so that one host, template or URL with any share of the rows is spread over tasks.

Defined results: null URLs and those without :// have an empty host and path, no rule and the verdict of the prior;
repeated rows get equal verdicts; among equally long rules the one that blocks wins; among equally large siblings the
last in byte order is compared with; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A literal with less than RARE of its node's URLs, among FAN_OUT siblings or more, is variable.
FAN_OUT, RARE = 20, 0.02
#: The upper one per cent of the normal distribution, and of chi-square with one degree of freedom.
NORMAL, ALIKE = 2.326, 6.63
PRIOR, WEIGHT, REJECT = 0.2, 10.0, 0.5
Rule = tuple[str, str, str]
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({_sql(url)}, instr({_sql(url)}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), *LETTERS)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _sql(c: Column) -> str:
    return c._jc.toString()


def apply_rules(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. rules: (verdict, host, path)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "block", r))
    out = None
    for verdict, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def kind(segment: Column) -> Column:
    """The wildcard of a variable segment by its form, with a file ending kept; else null."""
    end = F.regexp_extract(segment, r"(\.[a-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[a-z]{1,5}$", "")
    what = (
        F.when(stem.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), "<date>")
        .when(stem.rlike(r"^\d+$"), "<n>")
        .when(stem.rlike(r"^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"), "<uuid>")
        .when(stem.rlike(r"^(?=.*\d)[0-9a-f]{8,}$"), "<hex>")
        .when(stem.rlike(r"^(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_-]{16,}$"), "<id>")
    )
    return F.concat(what, end)


def _token(segment: Column) -> Column:
    """What a branch goes on with: a kind, =literal, or nothing at its end."""
    return F.coalesce(kind(segment), F.concat(F.lit("="), segment), F.lit(""))


def critical(degrees: Column) -> Column:
    """The upper one per cent of chi-square, by the cube-root approximation."""
    d = F.greatest(degrees, F.lit(1))
    return d * F.pow(1 - 2 / (9 * d) + NORMAL * F.sqrt(2 / (9 * d)), 3)


NODE = ["host", "template"]


def _merged(here: DataFrame) -> DataFrame:
    """here: host, template, seg, tok, n, blocked, allowed of literal branches -> (host, template, seg, name) of those
    that a wildcard stands for."""
    cont = common.stored(here.groupBy(*NODE, "seg", "tok").agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("allowed").alias("a")), "continuations")
    tops = F.max(F.struct("n", "tok"))["tok"].alias("top")
    per = common.stored(cont.groupBy(*NODE, "seg").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("toks"), tops), "branches")
    total = per.count()
    node = common.stored(per.groupBy(*NODE).agg(F.count("*").alias("kids"), F.sum("n").alias("nn")), "nodes")
    per = common.with_group_winner(per, node, NODE, "kids", total)
    per = common.stored(per.withColumn("rare", (F.col("kids") >= FAN_OUT) & (F.col("n") < RARE * F.col("nn"))).drop("kids", "nn"), "branches")
    group = [*NODE, "top"]
    first = F.max(F.struct("n", "seg", "b", "a", "toks")).alias("l")
    leaders = common.stored(per.where("NOT rare").groupBy(*group).agg(first, F.count("*").alias("size")).where("size > 1"), "leaders")
    pairs = common.with_group_winner(per.where("NOT rare"), leaders, group, "size", total).where("seg <> l.seg")
    nb, nl, bb, bl = F.col("b") + F.col("a"), F.col("l.b") + F.col("l.a"), F.col("b"), F.col("l.b")
    share = (bb + bl) / F.greatest(nb + nl, F.lit(1))
    labels = F.when((share > 0) & (share < 1), F.pow(bb / nb - bl / nl, 2) / (share * (1 - share) * (1 / nb + 1 / nl))).otherwise(0.0)
    pairs = pairs.where((nb > 0) == (nl > 0)).where(labels <= ALIKE)
    pairs = common.stored(pairs.select(*NODE, "seg", "top", "n", "toks", F.col("l.seg").alias("leader"), F.col("l.n").alias("ln"), F.col("l.toks").alias("ltoks")), "pairs")
    key = F.concat_ws("\0", "host", "template", F.col("leader"), "tok")
    own = common.with_group_winner(cont.select(*NODE, "seg", "tok", F.col("n").alias("c")), pairs, [*NODE, "seg"], "toks", cont.count()).withColumn("key", key)
    theirs = cont.withColumnRenamed("seg", "leader").select(key.alias("key"), F.col("n").alias("lc"))
    own = common.spread_left(common.stored(own, "own"), theirs, "key")
    lc = F.coalesce("lc", F.lit(0))
    apart = F.pow(F.sqrt(F.col("ln") / F.col("n")) * F.col("c") - F.sqrt(F.col("n") / F.col("ln")) * lc, 2) / (F.col("c") + lc)
    g = own.groupBy(*NODE, "seg", "top", "leader", "n", "ln", "toks", "ltoks").agg(F.sum(apart).alias("x"), F.sum(lc).alias("met"), F.count("lc").alias("both"))
    x = F.col("x") + F.col("n") / F.col("ln") * (F.col("ln") - F.col("met"))  # the leader's other continuations
    alike = common.stored(g.where(x <= critical(F.col("toks") + F.col("ltoks") - F.col("both") - 1)).select(*NODE, "seg", "top", "leader"), "alike")
    both = alike.select(*NODE, "seg", "top").unionByName(alike.select(*NODE, F.col("leader").alias("seg"), "top").distinct())
    found = common.stored(both.unionByName(per.where("rare").select(*NODE, "seg", F.lit(None).cast("string").alias("top"))), "found")
    several = common.stored(found.groupBy(*NODE).agg((F.countDistinct("top") + F.max(F.col("top").isNull().cast("int"))).alias("groups"), F.count("*").alias("size")), "groups")
    name = F.when(F.col("top").isNull() | (F.col("groups") == 1), "*").otherwise(F.concat(F.lit("*("), F.col("top"), F.lit(")")))
    return common.with_group_winner(found, several, NODE, "size", found.count()).select(*NODE, "seg", name.alias("name"))


def templates(urls: DataFrame) -> DataFrame:
    """urls: host, path, n, blocked, allowed (distinct paths and their labelled counts) -> with template and parent."""
    kept = ["host", "path", "n", "blocked", "allowed", "template", "segs"]
    rows = urls.withColumn("segs", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit("")).select(*kept)
    rows = common.stored(rows, "paths")
    done: list[DataFrame] = []
    named = F.transform("taken", lambda s: F.concat(F.lit("/"), F.coalesce(kind(s), s)))
    while True:
        done.append(rows.where(F.size("segs") == 0))
        live = rows.where(F.size("segs") > 0)
        node = common.stored(rows.groupBy(*NODE).agg(F.count("*").alias("paths"), F.min("segs").alias("lo"), F.max("segs").alias("hi")).where(F.size("hi") > 0), "nodes")
        if node.isEmpty():
            break
        same = F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False)))
        apart = F.array_position(same, False).cast("int")
        node = common.stored(node.select(*NODE, "paths", F.when(apart == 0, F.size("hi")).otherwise(apart - 1).alias("shared")), "nodes")
        live = common.with_group_winner(live, node, NODE, "paths", live.count())
        along = live.where("shared > 0").withColumn("taken", F.expr("slice(segs, 1, shared)"))
        along = along.withColumn("template", F.concat("template", F.array_join(named, ""))).withColumn("segs", F.expr("slice(segs, shared + 1, size(segs))"))
        part = live.where("shared = 0").withColumn("seg", F.get("segs", F.lit(0))).withColumn("wild", kind(F.col("seg"))).withColumn("tok", _token(F.get("segs", F.lit(1))))
        part = common.stored(part.drop("paths", "shared"), "parted")
        names = _merged(part.where("wild IS NULL"))
        key = F.concat_ws("\0", "host", "template", "seg")
        part = common.spread_left(part.withColumn("key", key), common.stored(names.select(key.alias("key"), "name"), "names"), "key")
        part = part.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("wild", "name", "seg"))).withColumn("segs", F.expr("slice(segs, 2, size(segs))"))
        rows = common.stored(along.select(*kept).unionByName(part.select(*kept)), "paths")
    out = reduce(DataFrame.unionByName, done)
    return out.select("host", "path", "n", "blocked", "allowed", "template", F.when(F.col("template") != "", F.regexp_replace("template", "/[^/]*$", "")).alias("parent"))


@common.narrow
def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = common.stored(rows.withColumn("by", apply_rules(F.col("host"), F.col("path"), rules)), "urls")
    label = F.col("by.verdict")
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count(F.when(label == "block", 1)).alias("blocked"), F.count(F.when(label == "allow", 1)).alias("allowed"))
    paths = common.stored(templates(common.stored(urls, "urls")), "paths")
    own = common.stored(paths.groupBy(*NODE, "parent").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.count("*").alias("paths")), "templates")
    above = common.stored(own.groupBy("host", "parent").agg(F.sum("b").alias("pb"), F.sum("a").alias("pa"), F.count("*").alias("size")).where("parent IS NOT NULL"), "parents")
    n_own, with_parent = own.count(), own.where("parent IS NOT NULL")
    joined = common.with_group_winner(with_parent, above, ["host", "parent"], "size", n_own)
    alone = own.where("parent IS NULL").withColumns({"pb": F.lit(0).cast("long"), "pa": F.lit(0).cast("long")})
    prior = (F.col("pb") + WEIGHT * PRIOR) / (F.col("pb") + F.col("pa") + WEIGHT)
    purity = (F.col("b") + WEIGHT * prior) / (F.col("b") + F.col("a") + WEIGHT)
    scored = joined.drop("size").unionByName(alone).select(*NODE, "paths", purity.alias("purity"))
    by_path = common.with_group_winner(paths.select("host", "path", "n", "template"), common.stored(scored, "purity"), NODE, "paths", paths.count())
    out = common.with_group_winner(rows, common.stored(by_path.select("host", "path", "n", "template", "purity"), "judged"), ["host", "path"], "n", rows.count())
    method = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", method).alias("verdict"), "template", "purity")

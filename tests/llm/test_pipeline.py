"""The pipeline against a model that goes row by row, and each stage with nulls, repeated ids, ties and clashing columns."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import common, semantic_search, toxicity
from quillon.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in ("ka", "mo", "ti", "re") for b in ("lan", "dor", "vis", "nu") for c in ("", "s", "e")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(30, 99)) for _ in range(n))
    items = [text(30), text(150)]
    out = [(i, text(rng.randrange(20, 90)) + (" you grobnik" if i % 5 == 0 else "")) for i in range(120)]
    base = text(120).split()

    def near(*at):
        return " ".join("other" + str(k) if k in at else w for k, w in enumerate(base))

    out += [(1000, near()), (1001, near(20, 60)), (1002, near(30, 70, 100)), (None, near(50))]
    out += [(2000, "same text here"), (2000, "same text here"), (2001, "same  text here"), (None, "same text\there"), (2002, "aa"), (2002, "bbbb"), (2003, "bb bb")]
    out += [(3000, text(20) + " " + items[0] + " " + text(20)), (None, text(40) + " " + items[1] + " " + text(9)), (3001, items[0])]
    out += [(4000, None), (None, None), (4001, ""), (4002, " \n"), (4003, "word " * 30_000), (4004, "x <|endoftext|> y"), (None, "alone with a null id"), (4005, "you gr0bn1k again")]
    return out, items


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    docs, items = rows
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in docs], SCHEMA).coalesce(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def model(spark, sf_dir, docs, items):
    """What each stage keeps, as lists of (doc_id, text)."""
    m = toxicity._fitted(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), 20_000, "doc_id", "text")
    kept = [[x for x in docs if m.score((x[1] or "").encode()) < 0.3]]
    best: dict = {}
    for k, (i, t) in enumerate(kept[-1]):
        key = "".join((t or "").split())
        best[key] = min(best.get(key, (1,)), (-len(t or ""), i is None, i or 0, k))
    kept.append([kept[-1][k] for k in sorted(b[3] for b in best.values())])
    sets = []
    for _, t in kept[-1]:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((up[a], up[b]))
                up = [lo if u == hi else u for u in up]
    groups: dict = {}
    for k, u in enumerate(up):
        groups.setdefault(u, []).append(kept[-1][k])
    kept.append(groups)
    return kept


def leaks(text, items):
    d = (text or "").split()
    for item in items:
        w = item.split()
        for o in range(0, max(len(d), 1), semantic_search.STEP):
            near = d[max(0, o - len(w)) : o + semantic_search.WINDOW + len(w)]
            share = semantic_search.lcs(w, near) / len(w)
            if share >= 0.85 or share >= 0.6 and semantic_search.lcs(w[-5:], near) >= 3:
                return True
    return False


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_run_equals_the_model(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    docs, items = rows
    clean, distinct, groups = model(spark, sf_dir, docs, items)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = common.stored(corpus_pipeline.drop_toxic(spark, d, sf_dir), "t")
    assert pairs(one) == sorted(clean, key=str) and len(clean) <= len(docs) - 20 and (4005, "you gr0bn1k again") not in clean
    two = common.stored(corpus_pipeline.drop_copies(spark, one, sf_dir), "t")
    assert pairs(two) == sorted(distinct, key=str) and (2002, "aa") in distinct and sum(t == "same  text here" for _, t in distinct) == 1
    three = common.stored(corpus_pipeline.drop_near_copies(spark, two, sf_dir), "t")
    got = pairs(three)
    assert len(got) == len(groups) and all(sum(x in g for x in got) == 1 for g in groups.values())
    four = common.stored(corpus_pipeline.drop_leaks(spark, three, sf_dir), "t")
    assert pairs(four) == [x for x in got if not leaks(x[1], items)] and len(four.collect()) == len(got) - 3
    assert one.columns == two.columns == three.columns == four.columns == d.columns
    tok = Tokenizer.from_file(vocabulary())
    want = sorted((str(i), *tok.encode(t or "", add_special_tokens=False).ids, 0) for i, t in pairs(four))
    pieces = sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda p: p.sequence_id * 1024 + p.offset)
    whole: list = []
    for p in pieces:
        if p.start == 0:
            whole.append([str(p.doc_id)])
        whole[-1] += np.frombuffer(p.ids, "<u4").tolist()
    assert sorted(map(tuple, whole)) == want


def test_stages_with_clashing_columns_and_no_rows(spark, sf_dir):
    rows = [(None, None, "a", 1, 0.5, b"x", 7), (1, "one two three four five six", None, None, None, None, None), (1, "one two three four five six", "b", 2, 0.1, b"y", 8), (2, "of its own", "c", 3, 0.2, b"z", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row_key string, row long, score double, digest binary, doc_id_ int")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, d, sf_dir)
        assert (got.columns == d.columns) == (name != "packing")
        n = {"toxicity": 4, "exact dedup": 3, "near dedup": 3, "decontamination": 4, "packing": 4}[name]
        assert got.count() == n, name
        assert stage(spark, d.where("false"), sf_dir).count() == 0
    assert corpus_pipeline.drop_near_copies(spark, d, sf_dir).where("doc_id IS NULL OR doc_id = 2").count() == 2


def test_row_keys_are_distinct_and_stable(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, key = common.keyed(d)
    again, _ = common.keyed(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(1).select(*d.columns))
    a, b = rows.collect(), common.keyed(d)[0].collect()
    assert len({r[key] for r in a}) == d.count() == again.select(key).distinct().count() and sorted(map(str, a)) == sorted(map(str, b))

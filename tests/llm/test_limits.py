"""What has no upper bound: lengths, depths, repeated keys; and operators against models that go row by row."""

import base64
import hashlib
import io
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from quillon.llm import common, lattice_lm, minhash, semantic_search, sharding, sstable, toxicity, url_filter, warc_zip
from quillon.llm.queries import RULES, vocabulary

CORPUS = b"the idiot is on the road and the ass and the idea of it is the path to it "


def all_paths(token, logs, spaced):
    """The best restoration of a token, by trying every one."""
    per = [toxicity._steps(c, token[i - 1] if i else "", spaced) for i, c in enumerate(token)]
    best = (-math.inf, "")
    for path in itertools.product(*per):
        text, score = "".join(o for o, _ in path), -sum(c for _, c in path)
        x = y = 0
        for ch in text:
            z = toxicity._CODES.get(ch, 27)
            score, x, y = score + logs[x][y][z], y, z
        score += logs[x][y][0]
        if score > best[0] + 1e-12:
            best = (score, text)
    return best[1]


def test_decoder_equals_all_paths():
    logs = toxicity.trigram_logs(toxicity.count_trigrams(CORPUS * 400)).tolist()
    rng = random.Random(1)
    for k in range(600):
        spaced = k % 3 == 0
        token = "".join(rng.choice("aabtdioss" if spaced else "aabtdi10o5!.s$h-") for _ in range(rng.randrange(1, 8)))
        assert toxicity.decode(token, logs, spaced) == all_paths(token, logs, spaced), token


def test_decoder_has_no_longest_token(monkeypatch):
    r = toxicity.Restorer(toxicity.trigram_logs(toxicity.count_trigrams(CORPUS * 400)))
    for n in (60, 61, 62, 63, 64, 65, 200, 5000):
        assert r.token(b"idi" + b"o" * n + b"t") == [b"idiot"]
    assert b"".join(r.token(b"i.d.i.o.t." * 3000)) == b"idiot" * 3000
    assert r.runs(b"t h e i d i o t ".split() * 300) == [b"the", b"idiot"] * 300
    whole = r.token(b"1d10t-" * 40)
    monkeypatch.setattr(toxicity, "_SETTLE", 7)
    assert r.token(b"1d10t-" * 40) == whole


def test_toxicity_scores_equal_the_model_row_by_row(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["the", "road", "to", "it", "is", "on"], 30)) + (" you 1d10t" if i % 4 == 0 else "")) for i in range(200)] + [(900, None), (901, "word " * 40_000), (None, "the idiot")]
    d = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] * 2, "doc_id long, toxic int")
    model = toxicity._fitted(d, labels, 100, "doc_id", "text")
    want = sorted((str(i), round(model.score((t or "").encode()), 9)) for i, t in rows)
    got = toxicity.score(d, labels, 100).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == want
    kept = toxicity.clean(d, labels, 100)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, s in want if s < 0.3)


def test_lattice_has_no_longest_unit_or_word(monkeypatch):
    long_unit = b"abc" * 8
    units = [bytes([b]) for b in range(256)] + [b"ab", b" a", b"bc", b" ab", b"abc", long_unit]
    logs = np.log(np.full(len(units), 1 / len(units)))
    lat = lattice_lm.Lattice(units, logs)
    without = lattice_lm.Lattice(units[:-1], logs[:-1])
    assert lat.log_probs([long_unit])[0] > without.log_probs([long_unit])[0] + 1e-9
    rng = np.random.default_rng(0)
    words = [bytes(rng.choice(list(b"abc"), n).tolist()) for n in (300, 700, 1)] + [long_unit * 9]
    counts = np.array([1.0, 2, 3, 4])
    whole, expected = lat.log_probs(words), lat.expected(words, counts)
    monkeypatch.setattr(lattice_lm, "LONG_WORD", 100)
    monkeypatch.setattr(lattice_lm, "SEGMENT", 64)
    assert np.allclose(lat.log_probs(words), whole) and np.allclose(lat.expected(words, counts), expected)
    assert max(map(len, lattice_lm.vocabulary(vocabulary("piece_bpe_32k.model"))[0])) > 16


def test_lattice_scores_equal_a_model_row_by_row(spark):
    """The score of a document from its tokens one after another: each is drawn from the urn, then added to it."""
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["aa", "ab", "abc", "ba", "zq", f"u{i}"]) for _ in range(rng.randrange(0, 30))) for i in range(40)}
    d = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in lattice_lm.score(d, vocabulary("piece_bpe_32k.model"), rounds=0).collect()}
    lat = lattice_lm.Lattice(*lattice_lm.vocabulary(vocabulary("piece_bpe_32k.model")))
    train = [w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.split(), None]]
    n, types = len(train), len(set(train))

    def p(w):
        known = max(train.count(w) - lattice_lm.DISCOUNT, 0.0) / n
        return known if w is None else known + lattice_lm.DISCOUNT * types / n * math.exp(lat.log_probs([w.encode()])[0])

    for i, t in texts.items():
        seen, score, lattice = [], 0.0, 0.0
        for w in [*t.split(), None]:
            score += math.log10((lattice_lm.WEIGHT * p(w) + seen.count(w)) / (lattice_lm.WEIGHT + len(seen)))
            lattice += math.log10((train.count(None) + 1) / (n + types + 1)) if w is None else lat.log_probs([w.encode()])[0] / math.log(10)
            seen.append(w)
        assert abs(got[i].score - score) < 1e-6 and abs(got[i].lattice_score - lattice) < 1e-6, i


def test_bands_follow_the_threshold(spark):
    assert minhash.bands_for(85) == minhash.bands_for(80) == (16, 4)
    for percent in (1, 10, 30, 50, 70, 80, 100):
        bands, rows = minhash.bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 3.1e-4
    with pytest.raises(ValueError):
        minhash.bands_for(0)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):  # pairs a little over one half
        w = [f"w{x}" for x in rng.integers(0, 10**6, 90)]
        v = [*w[:62], *(f"v{x}" for x in rng.integers(0, 10**6, 28))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=50).collect()
    assert sum(r.component_id != r.doc_id for r in got) == 120


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(common, "ONE_TASK", 0)
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in range(60)]
    rows = []
    for i in range(60):  # a large group round each of two texts that lie just apart
        w = list(base)
        for k in rng.choice(60, 1 + i % 5, replace=False):
            w[k] = f"v{i}x{k}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    up = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((up[a], up[b]))
            up = {k: lo if v == hi else v for k, v in up.items()}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == up


def template_model(urls):
    """The template of each (host, path) by recursion over nodes. urls: {(host, path): (n, blocked, allowed)}."""
    kind = url_filter_kind
    out = {}

    def grow(paths, template):
        split = {}
        for path, segs in paths:
            if segs:
                split.setdefault(segs[0], []).append((path, segs[1:]))
            else:
                out[path] = template
        if not split:
            return
        if len(split) == 1 and len(paths) == sum(map(len, split.values())):
            (seg, rest), = split.items()
            return grow(rest, f"{template}/{kind(seg) or seg}")
        names = {s: kind(s) for s in split}
        lit = [s for s in split if not names[s]]
        stats = {}
        for s in lit:
            tok: dict = {}
            n = b = a = 0
            for path, rest in split[s]:
                k, x, y = urls[path]
                t = (kind(rest[0]) or "=" + rest[0]) if rest else ""
                tok[t] = tok.get(t, 0) + k
                n, b, a = n + k, b + x, a + y
            stats[s] = (n, b, a, tok, max((c, t) for t, c in tok.items())[1])
        total = sum(v[0] for v in stats.values())
        rare = {s for s in lit if len(lit) >= url_filter.FAN_OUT and stats[s][0] < url_filter.RARE * total}
        groups: dict = {}
        for s in lit:
            if s not in rare:
                groups.setdefault(stats[s][4], []).append(s)
        merged: dict = {}
        for top, members in groups.items():
            lead = max(members, key=lambda s: (stats[s][0], s.encode()))
            for s in members:
                (n, b, a, tok, _), (ln, lb, la, ltok, _) = stats[s], stats[lead]
                if s == lead or (b + a > 0) != (lb + la > 0):
                    continue
                both = set(tok) | set(ltok)
                x = sum((math.sqrt(ln / n) * tok.get(t, 0) - math.sqrt(n / ln) * ltok.get(t, 0)) ** 2 / (tok.get(t, 0) + ltok.get(t, 0)) for t in both)
                d = max(len(both) - 1, 1)
                limit = d * (1 - 2 / (9 * d) + url_filter.NORMAL * math.sqrt(2 / (9 * d))) ** 3
                if b + a:
                    share = (b + lb) / (b + a + lb + la)
                    gap = (b / (b + a) - lb / (lb + la)) ** 2 / (share * (1 - share) * (1 / (b + a) + 1 / (lb + la))) if 0 < share < 1 else 0
                    if gap > url_filter.ALIKE:
                        continue
                if x <= limit:
                    merged.setdefault(top, {lead}).add(s)
        several = len(merged) + bool(rare) > 1
        names |= {s: "*" for s in rare} | {s: f"*({top})" if several else "*" for top, ss in merged.items() for s in ss}
        nodes: dict = {}
        for s, rest in split.items():
            nodes.setdefault(f"{template}/{names[s] or s}", []).extend(rest)
        for t, rest in nodes.items():
            grow(rest, t)

    hosts: dict = {}
    for host, path in urls:
        hosts.setdefault(host, []).append(((host, path), [s for s in path.split("/") if s]))
    for paths in hosts.values():
        grow(paths, "")
    return out


def url_filter_kind(segment):
    return f"<n>{'.html' if segment.endswith('.html') else ''}" if segment.removesuffix(".html").isdigit() else None


def test_templates_equal_a_model_node_by_node(spark):
    rng = random.Random(6)
    paths = {(f"h{h}.com", "/" + "/".join(rng.choice([["docs", "shop", "blog", "x"], ["a", "b", "c", "d", "e"], ["guide", "cart", "7", "8.html", "list"], ["z", "y", "1"]][k]) for k in range(rng.randrange(0, 5)))) for h in range(4) for _ in range(60)}
    paths |= {("wide.com", f"/p/{'big' if i < 40 else f'slug{i}q'}/{i if i < 40 else 'end'}") for i in range(70)} | {("deep.com", "/s" * 60 + f"/{x}/t") for x in "abc"}
    urls = {k: (rng.randrange(1, 6), *rng.choice([(0, 0), (2, 0), (0, 3), (1, 1)])) for k in sorted(paths)}
    d = spark.createDataFrame([(*k, *v) for k, v in urls.items()], "host string, path string, n long, blocked long, allowed long")
    got = {(r.host, r.path): r.template for r in url_filter.templates(d).collect()}
    assert got == template_model(urls)


def test_unlike_branches_stay_apart(spark):
    urls = [(i, f"http://x.com/docs/{w}/guide") for i, w in enumerate(["alpha", "beta", "gamma"])] + [(10 + i, f"http://x.com/shop/{w}/cart") for i, w in enumerate(["shoes", "hats", "ties"])]
    urls += [(100 + i, f"http://deep.com{'/d' * 200}/{w}/end") for i, w in enumerate("ab")] + [(300, "http://x.com/" + "long/" * 5000)] + [(7, None)] * 3
    d = spark.createDataFrame([(i, u, "h", "p") for i, u in urls], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in url_filter.judge(d, RULES).collect()}
    assert {got[i].template for i in range(3)} == {"/docs/*/guide"} and {got[i].template for i in (10, 11, 12)} == {"/shop/*/cart"}
    assert got[100].template == got[101].template == "/d" * 200 + "/*/end" and got[300].template == "/long" * 5000
    tie = [("allow", "com", "/a"), ("block", "com", "/a")]
    assert [r.verdict for r in url_filter.judge(spark.createDataFrame([(1, "http://x.com/ab")] * 2, "page_id long, url string"), tie).collect()] == ["block"] * 2


def test_lookup_table_equals_turns_one_by_one(spark):
    for names, size, weights in ((["a", "b", "c", "d"], 101, None), (["a", "b"], 53, [1, 3])):
        prefer = []
        for name in names:
            h = hashlib.sha256(name.encode()).digest()
            first, step = int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1
            prefer.append([(first + k * step) % size for k in range(size)])
            assert len(set(prefer[-1])) == size
        want: dict = {}
        while len(want) < size:
            for i, order in enumerate(prefer):
                for _ in range((weights or [1] * len(names))[i]):
                    if len(want) < size:
                        want[next(s for s in order if s not in want)] = i
        table = sharding.fill(names, size, weights)
        assert table == [want[s] for s in range(size)]
        d = spark.range(500).withColumnRenamed("id", "k").withColumn("other", sharding.F.lit("x" * 100_000))
        for r in sharding.place(d, "k", names, size, weights).select("slot", "shard", "k").collect():
            assert names[table[r.slot]] == r.shard and 0 <= r.slot < size
    with pytest.raises(ValueError):
        sharding.place(d.withColumnRenamed("other", "SHARD"), "k", ["a"], 101)
    assert {r.shard for r in sharding.place(spark.createDataFrame([(None,), (None,)], "k long"), "k", ["a", "b"], 101).collect()} <= {"a", "b"}


def test_archives_equal_a_model_row_by_row(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), f"http://h/{i}", rng.choice([None, "", "aa", "bb" * 500, f"p{i}", "é" * 50_000])) for i in range(150)]
    d = spark.createDataFrame([(p, u, h, "x") for p, u, h in rows], "page_id long, url string, html string, payload string")
    for least in (0, 10):
        first: dict = {}
        for p, _, h in rows:
            first[h or ""] = min(first.get(h or "", math.inf), math.inf if p is None else p)
        want = []
        for p, _, h in rows:
            data = (h or "").encode()
            again = len(data) >= least and first[h or ""] < (math.inf if p is None else p)
            want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
        got = warc_zip.read(warc_zip.write(d, common.new_path(spark, "w"), least), with_payload=False).collect()
        assert sorted(map(str, want)) == sorted(str((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in got)


def test_every_key_of_a_shard_is_found_by_bisection():
    buf = io.BytesIO()
    w = sstable.Writer(buf, 2)
    keys = [None, None, *range(-50, 4000, 3)]
    for i, k in enumerate(keys):
        w.add(sstable.key_of(k), bytes([i & 255, i >> 8]) * (1 + i % 200))
    w.close()
    r = sstable.Reader(buf)
    assert len(r.index) == 5
    values = dict.fromkeys(keys)
    for i, k in enumerate(keys):
        values[k] = (values[k] or []) + [bytes([i & 255, i >> 8]) * (1 + i % 200)]
    assert all(r.get(sstable.key_of(k)) == v for k, v in values.items())
    absent = [k for k in range(-50, 4000) if k not in values]
    assert not any(r.get(sstable.key_of(k)) for k in absent)
    assert sum(r.may_have(sstable.key_of(k)) for k in absent) < 0.03 * len(absent)


def test_a_repeated_id_fills_several_shards(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(i, "other") for i in range(20)]
    d = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, ids binary")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    m = sstable.write(d, common.new_path(spark, "sst"), vocabulary())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert m.where("first_key = last_key").count() > 1
    got = sorted(sstable.read(m).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + list(range(20)) and len({bytes(r.ids) for r in got}) == 301
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert len(sstable.lookup(m, [None])[None]) == 300


def test_hashes_depend_on_the_word_alone(monkeypatch):
    words = [b"a", b"ab", b"b", b"a", b"x" * 50, "é".encode(), b"ab"]
    h = semantic_search.hashes(words)
    assert h[0] == h[3] and h[1] == h[6] and len(set(h.tolist())) == 5
    monkeypatch.setattr(semantic_search, "_SPAN", 8)
    assert (semantic_search.hashes([w for w in words if len(w) < 8]) == h[[0, 1, 2, 3, 5, 6]]).all()
    assert len(semantic_search.hashes([])) == 0 and len(semantic_search.hashes([b"y" * 100, b"a"])) == 2


def test_sums_of_rows_equal_one_at_a_time():
    rng = np.random.default_rng(0)
    keys, rows = (rng.zipf(1.3, 5000) % 200).astype(np.uint16), rng.integers(0, 300, 5000)
    values = rng.standard_normal((300, 7)).astype(np.float32)
    z, want = np.zeros((200, 7), np.float32), np.zeros((200, 7))
    np.add.at(want, keys, values[rows])
    semantic_search._add_rows(z, keys, rows, values)
    assert np.allclose(z, want, atol=1e-3)
    semantic_search._add_rows(z, keys[:0], rows[:0], values)


def test_latent_search_of_one_very_long_text(spark):
    rng = np.random.default_rng(3)
    w = [f"t{x}" for x in rng.integers(0, 5000, 450_000)]
    items = [[f"t{x}" for x in rng.integers(0, 5000, n)] for n in (40, 120, 400)]
    for at, item in zip((100, 199_990, 440_000), items, strict=True):
        w[at : at + len(item)] = item
    d = spark.createDataFrame([(1, " ".join(w), [1], 0.5)], "doc_id long, text string, item_ids array<int>, share double")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert [list(r.item_ids) for r in semantic_search.search(d, b).collect()] == [[0, 1, 2]]

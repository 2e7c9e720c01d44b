"""Each operator on small tables: against brute force, and with nulls, empty texts, ties, repeated rows, no rows."""

import base64
import hashlib
import io
import zipfile
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import bpe, common, exact_dedup, lattice_lm, minhash, packing, semantic_search, sharding, sstable, toxicity, url_filter, warc_zip
from quillon.llm.queries import RULES, vocabulary

LONG = "word " * 3000 + "end"
TEXTS = [(1, "a b c d e f g h"), (2, " a b\tc d e f g  h"), (3, None), (4, ""), (5, "A B C D E F G H"), (5, "A B C D E F G H"), (9, "x <|endoftext|> y"), (6, LONG), (7, "é ñ  x\n\n y"), (8, "one two")]
SCHEMA = "doc_id long, text string, lang string, n_chars long, size int, digest string, bucket string, label int"


_SPELLINGS = ["<|endoftext|> x", "one two  three", " lead", "trail ", "don't we'll", "a", "two words"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, 1, "x", "y", 2) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_exact_dedup(spark, docs, none):
    got = exact_dedup.dedup(docs).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    assert by[1].keep_id == 2 and by[2].kept and not by[1].kept  # more code points stay
    assert by[3].keep_id == by[4].keep_id == 3 and by[3].group_size == 2
    assert by[5].group_size == 2 and by[5].keep_id == 5
    assert by[8].digest == hashlib.sha256(b"onetwo").hexdigest()
    assert exact_dedup.dedup(none).count() == 0


def test_digest_index_is_kept(spark, docs):
    path = common.new_path(spark, "index")
    exact_dedup.DigestIndex(spark, path, 4).add(docs)
    again = exact_dedup.DigestIndex(spark, path, 4)
    new = spark.createDataFrame([(20, "one  two"), (21, "fresh")], "doc_id long, text string")
    got = {r.doc_id: r for r in again.add(new).collect()}
    assert got[20].known and got[20].keep_id == 8 and not got[20].kept
    assert got[21].kept and not got[21].known
    assert again.rows().count() == 8 and again.buckets == 4
    lost = again.rows().limit(1).withColumn("digest", exact_dedup.F.lit("half done"))
    again._append("entries", lost, "no commit of this batch")
    assert again.rows().count() == 8
    best = {r.digest: r for r in again.keepers().collect()}
    assert best[hashlib.sha256(b"onetwo").hexdigest()].keep_id == 20 and best[hashlib.sha256(b"onetwo").hexdigest()].group_size == 2


def test_minhash_equals_brute_force(spark, docs, none):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            w[k] = f"v{i}x{k}"
        rows.append((100 + i, " ".join(w)))
    every = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = {r.doc_id: r for r in minhash.near_duplicates(every, percent=85).collect()}
    sets = {}
    for i, t in rows + TEXTS:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    assert {i: r.component_id for i, r in got.items()} == up
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert minhash.near_duplicates(none).count() == 0


def test_packing_and_sstable_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    want = sorted((i, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in TEXTS)
    pieces = packing.pack(docs, vocabulary(), 64).collect()
    at = sorted((p.sequence_id * 64 + p.offset, p) for p in pieces)
    assert [a for a, _ in at] == list(np.cumsum([0] + [p.length for _, p in at])[:-1])
    ids: dict = {}
    for _, p in at:
        assert zlib.crc32(p.ids) == p.ids_crc32 and p.length == len(p.ids) // 4 and p.offset + p.length <= 64
        ids.setdefault((p.doc_id, (p.sequence_id * 64 + p.offset) - p.start), []).extend(np.frombuffer(p.ids, "<u4").tolist())
    assert sorted((d, tuple(x)) for (d, _), x in ids.items()) == want
    assert packing.pack(none, vocabulary()).count() == 0
    m = sstable.write(docs, common.new_path(spark, "sst"), vocabulary())
    rows = sorted(sstable.read(m).collect(), key=lambda r: r.start)
    assert [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows] == want
    assert len(sstable.lookup(m, [5])[5]) == 2 and sstable.lookup(m, [99])[99] == []
    assert sstable.read(sstable.write(none, common.new_path(spark, "sst"), vocabulary())).count() == 0


def test_chunked_encoding_equals_the_library():
    from tokenizers import Tokenizer

    e, tok = bpe.Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    assert np.frombuffer(e.encode("a <|endoftext|> b"), e.dtype).tolist() == [64, 220, 50256, 275]
    for t in _SPELLINGS + ["<|endoftext|>", "<|endoftext|><|endoftext|> a<|endoftext|>b", "<|endoftext|", "", " ", "  a", "a  b", "a \n b\n\n c", "x\t\ty", "don't we'll", " lead", "trail ", "é è ñ", "a\x1c b", "<|endoftext|> x", "日本 語", "foo\n \nbar", "😀 😀x", "½ ²x"]:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids
    texts = [*_SPELLINGS, None, "w " * 5000 + "x", *(f"{a}{s}{b}" for a in ("a", "a.", " ", "é", "") for s in (" ", "  ", "\n", "\n ", " \n", "\x85 ", "\xa0", "\xa0 ", "\x1d ", "\u2028 ", "\x0b ") for b in ("b", "", " ", "1!"))]
    for many in (texts, [*texts, "y" * (3 << 20)], [None], [""], ["  "]):
        got = e.encode_column(bpe.pa.array(many, bpe.pa.string()), b"\0\0")
        assert [np.frombuffer(x, e.dtype).tolist() for x in got] == [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in many]


def test_lattice_sums_all_segmentations(spark, docs, none):
    units = [bytes([b]) for b in range(256)] + [b"ab", b" a", b"bc", b" ab", b"abc"]
    logs = np.log(np.full(len(units), 1 / len(units)))
    lat = lattice_lm.Lattice(units, logs)

    def brute(s):
        return 1.0 if not s else sum(np.exp(logs[units.index(s[:k])]) * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in units)

    words = [b"abc", b"a", b"xabcab", b"q" * 40, b"q" * 2000]
    got = lat.log_probs(words)
    assert np.allclose(np.exp(got[:3]), [brute(b" " + w) for w in words[:3]]) and np.isfinite(got).all()
    total = lat.expected([b"abc"], np.ones(1))
    assert abs(sum(total[i] * len(u) for i, u in enumerate(units)) - 4) < 1e-9
    r = {x.doc_id: x for x in lattice_lm.score(docs, vocabulary("piece_bpe_32k.model")).collect()}
    assert r[3].n_tokens == r[4].n_tokens == 1 and all(np.isfinite(x.score) for x in r.values())
    train = [t for i, t in TEXTS if zlib.crc32(str(i).encode()) % 7 != 2]
    words = [w for t in train for w in [*(t or "").lower().split(), None]]
    base = sum(np.log10((words.count(w) + 1) / (len(words) + len(set(words)) + 1)) for w in ["one", "two", None])
    assert abs(r[8].base_score - base) < 1e-9 and r[8].train_tokens == len(words)
    assert lattice_lm.score(none, vocabulary("piece_bpe_32k.model")).count() == 0


def test_toxicity_restores_and_separates(spark, none):
    text = b"the idiot is on the road and the idea of it is the road to it " * 400
    logs = toxicity.trigram_logs(toxicity.count_trigrams(text))
    r = toxicity.Restorer(logs)
    assert r.token(b"1d10t") == [b"idiot"] and r.token(b"idiooot") == [b"idiot"] and r.token(b"i.d.i.o.t") == [b"idiot"]
    assert b"idiot" in b" ".join(r.runs(b"the i d i o t is".split())) and r.token(b"road,") == [b"road"]
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["the", "road", "to", "it", "is", "on"], 30)) + (" you idiot" if i % 4 == 0 else "")) for i in range(400)]
    d = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "the 1d10t"), (902, "the 1d10t")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(d, labels).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400))
    assert got[902].predicted == 1 and got[900].predicted == got[901].predicted == 0 and got[1].held_out == (zlib.crc32(b"1") % 4 == 2)
    assert toxicity.score(none, labels).count() == 0 and toxicity.score(d, labels.where("false")).where("predicted = 1").count() == 0


def test_toxicity_restores_every_spelling():
    logs = toxicity.trigram_logs(toxicity.count_trigrams(b"the idiot is on the road and the ass and the idea of it is the path to it " * 400))
    r = toxicity.Restorer(logs)
    assert r.token(b"1d107") == r.token(b"iiddiioott") == r.token(b"1d10t!") == [b"idiot"]
    assert r.token(b"a55") == [b"ass"] and r.token(b"p47h") == [b"path"] and r.token(b"2024") == [b"2024"]
    assert r.token(b"idio" + b"o" * 100 + b"t") == [b"idiot"] and b"idiot" in b" ".join(r.token(b".".join([b"i.d.i.o.t"] * 9)))


def test_latent_search_finds_leaks(spark, docs, none, monkeypatch):
    rng = np.random.default_rng(5)
    vocab = [f"t{x}" for x in range(3000)]
    item = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, item(int(rng.integers(15, 50)))) for i in range(12)]
    rows, want = [], {}
    for i in range(120):
        body = item(int(rng.integers(20, 200))).split()
        if i % 10 == 0:
            k, t = items[i // 10]
            w = t.split()
            if i % 20 == 0:  # a paraphrase: a tenth of the words change
                for j in rng.choice(len(w) - 5, len(w) // 10, replace=False):
                    w[j] = "other"
            at = int(rng.integers(0, len(body)))
            body[at:at] = w
            want[i] = [k]
        rows.append((i, " ".join(body)))
    d = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    b = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in semantic_search.search(d, b).collect() if r.contaminated}
    assert got == want
    monkeypatch.setattr(semantic_search, "ITEMS_A_PASS", 6)  # two full passes, with a repeated row
    several = semantic_search.search(d.unionByName(d.where("doc_id = 0")), b)
    assert several.count() == len(rows) + 3 and {r.doc_id: list(r.item_ids) for r in several.collect() if r.contaminated} == want
    assert semantic_search.search(none, b).count() == 0 and semantic_search.search(docs, b.where("false")).where("contaminated").count() == 0
    assert semantic_search.lcs("abcbdab", "bdcaba") == 4


def test_latent_search_finds_long_items(spark):
    rng = np.random.default_rng(8)
    item = lambda n: rng.choice([f"t{x}" for x in range(3000)], n).tolist()
    items = [item(n) for n in (100, 112, 149, 186, 224, 300, 500) for _ in range(3)]
    rows = [(i, " ".join(item(50 + 5 * i) + w + item(60))) for i, w in enumerate(items)] + [(1000 + i, " ".join(item(300))) for i in range(40)]
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = semantic_search.search(spark.createDataFrame(rows, "doc_id long, text string"), b).where("contaminated").collect()
    assert {r.doc_id: (list(r.item_ids), r.share) for r in got} == {i: ([i], 1.0) for i in range(len(items))}


def test_latent_search_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    item = lambda n: [f"t{x}" for x in rng.zipf(1.25, n) % 3000]
    items = [item(int(rng.integers(15, 60))) for _ in range(20)]
    rows = []
    for i in range(120):  # up to two fifths of the words change, the answer stays; six alignments
        w = list(items[i % 20])
        for j in rng.choice(len(w) - 5, min(len(w) - 5, int(len(w) * [0.4, 0.37, 0.3][i % 3])), replace=False):
            w[j] = item(1)[0]
        rows.append((i, " ".join(item(48 + [0, 3, 6, 8, 11, 14][i % 6]) + w + item(70))))
    s = [semantic_search.hashes(semantic_search.words_of(" ".join(w).encode())).tolist() for w in items]
    want = {}
    for i, t in rows:
        d = semantic_search.hashes(semantic_search.words_of(t.encode())).tolist()
        for k, w in enumerate(s):
            for o in range(0, len(d), semantic_search.STEP):
                near = d[max(0, o - len(w)) : o + semantic_search.WINDOW + len(w)]
                share = semantic_search.lcs(w, near) / len(w)
                if share >= 0.85 or share >= 0.6 and semantic_search.lcs(w[-5:], near) >= 3:
                    want.setdefault(i, set()).add(k)
    assert sum(i % 20 in want.get(i, ()) for i in range(120)) == 120
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = semantic_search.search(spark.createDataFrame(rows, "doc_id long, text string"), b).where("contaminated").collect()
    assert {r.doc_id: set(r.item_ids) for r in got} == want


def test_warc_zip_round_trip(spark):
    rows = [(3, "http://a/\nx", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (None, "u", "same"), (7, "v", "é" * 9000), (7, "v", "é" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(warc_zip.read(warc_zip.write(pages, common.new_path(spark, "w"))).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(1, "response", None), (2, "response", None), (3, "revisit", 1), (5, "revisit", 2), (7, "response", None), (7, "response", None), (None, "revisit", 1)]
    assert got[2].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode() and got[2].payload_bytes == 4
    assert got[4].payload == ("é" * 9000).encode()
    assert warc_zip.read(warc_zip.write(pages.where("false"), common.new_path(spark, "w"))).count() == 0


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", allowZip64=True) as z:
        z.writestr("a", b"x" * 50)
        z.writestr("b", b"y" * 60)
    assert b"PK\6\6" in buf.getvalue()
    p = warc_zip.Package(buf)
    at, n = p.stored("b")
    assert p.range(at, n) == b"y" * 60
    with pytest.raises(ValueError):
        warc_zip.Package(io.BytesIO(b"no archive"))


def test_url_verdicts(spark):
    urls = [(1, "http://A.example.com/en/7x"), (2, "https://m.x.com/en/9?q"), (3, "http://example.net/de/8#f"), (4, "http://b.net/de/1"), (5, None), (6, "no scheme"), (7, "http://net/de/"), (8, "http://wwwnet/de/2")]
    urls += [(100 + i, f"http://shop.com/{'en' if i % 2 else 'fr'}/{i}") for i in range(60)]
    d = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(d, RULES).collect()}
    assert len(got) == len(urls)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2].rule == "com/en/" and got[2].path == "/en/9" and got[3].rule == "example.net/de/8" and got[3].verdict == "block"
    assert got[4].rule == got[7].rule == "net/de/" and got[8].rule is None
    assert got[5].host == got[6].host == got[5].path == "" and got[5].verdict == "allow"
    assert got[101].template == "/en/<n>" and got[100].verdict == "allow"
    assert url_filter.judge(d.where("false"), RULES).count() == 0


def test_lookup_table(spark, none):
    t = sharding.fill(["a", "b", "c"], 1009)
    assert min(map(t.count, range(3))) >= 336
    less = sharding.fill(["a", "b"], 1009)
    assert sum(x != y for x, y in zip(t, less, strict=True) if x != 2) < 150
    with pytest.raises(ValueError):
        sharding.fill(["a"], 1000)
    d = spark.createDataFrame([(None,), (1,), (1,)], "doc_id long")
    assert len({r.shard for r in sharding.place(d, "doc_id", ["a", "b"], 1009).where("doc_id = 1").collect()}) == 1
    assert sharding.place(none, "doc_id", ["a"], 1009).count() == 0


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_drops_near_copies_from_80_per_cent(spark):
    base = [f"w{x}" for x in range(120)]

    def changed(*at: int) -> str:
        return " ".join(f"v{x}" if x in at else w for x, w in enumerate(base))

    # 116 shingles each; 10 of them change: 106 of 126 shared, 84 per cent; 15: 101 of 131, 77 per cent
    d = spark.createDataFrame([(1, changed()), (2, changed(20, 60)), (3, changed(30, 70, 100))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, "").collect()) == [1, 3]


def test_parities_never_rule_out_a_link(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        n = int(rng.integers(1, 3000))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[: int(len(x) * rng.uniform(0.7, 1)) or 1], rng.integers(0, 1 << 63, n // 20).astype(np.uint64))))
        shared = len(np.intersect1d(x, y))
        rows.append((i, len(x), minhash.parities(x).tolist(), len(y), minhash.parities(y).tolist(), 100 * shared >= 85 * (len(x) + len(y) - shared)))
    df = spark.createDataFrame(rows, "i int, n_a long, bits_a array<long>, n_b long, bits_b array<long>, linked boolean")
    got = df.select("linked", minhash.may_link(df.n_a, df.bits_a, df.n_b, df.bits_b, 85).alias("may")).collect()
    assert any(r.linked for r in got) and any(not r.may for r in got)
    assert all(r.may for r in got if r.linked)

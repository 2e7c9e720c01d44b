"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of WINDOW words. Passages are TF-IDF rows over hashed words, scaled to unit
length. A randomised decomposition (one pass: A'A times a random matrix, then Nystroem's formula) gives the leading
right singular vectors, onto which passages and benchmark items (long ones in pieces) are projected. Candidates are
passages whose cosine with a piece of an item reaches a threshold, and runs of steps as long as the item, each only if
it holds as many words of the item as a leak needs. They are decided by the longest common subsequence of words, of the
whole item and of its answer (its last words).

A document is a leak of an item if the common subsequence has FULL of the item's words, or PART of them together with
the answer. Words in a common subsequence are words of both, so counting drops no leak: one within as many words as the
item has is always a candidate, one that is spread wider if a passage of it is near in cosine. Every passage meets every
item, in blocks of items, as items are a stated query set.

Defined results: words are split at blanks and ASCII punctuation, in lower case; null and empty texts, and items without
words, match nothing; items with equal words are all reported; repeated rows are judged alike; very long texts are
handled in pieces of passages; an empty table or benchmark gives rows without items or no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, STEP = 32, 16
DIMENSIONS, SKETCH, KEPT = 1 << 14, 96, 80
#: The first vector is the mean of all texts and tells passages apart least; it is left out of cosines.
COMMON = 1
COSINE = 0.35
#: Words of an item that share one vector, at most.
PIECE = 64
FULL, PART, ANSWER_WORDS, ANSWER = 0.85, 0.6, 5, 0.6
ITEMS_A_PASS = 512
#: A text's own words recur so many times as often as in all texts; a guess that decides which words are counted first.
BURST = 8
#: Passages of a task that sums projections, at least, if all cores have a task.
PASSAGES_A_TASK = 500_000
_FAN_IN = 64
_TABLE = bytes(32 if chr(b) in " \t\n\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ROWS = 64


def words_of(text: bytes) -> list[bytes]:
    return _plain(text).translate(_TABLE).split()


def _plain(text: bytes) -> bytes:
    return text if text.isascii() else text.decode(errors="replace").lower().encode()


#: An odd multiplier; powers of it and of its inverse (modulo 2^64) give every word's polynomial from one running sum.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at a time, so that both tables of powers stay small.
_SPAN = 1 << 18


def _powers(base: int) -> np.ndarray:
    out = np.full(_SPAN, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_up, _down = _powers(_BASE), _powers(_INVERSE)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(32)).astype(np.uint32)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a translated text, and where each begins. A word's hash depends on its bytes alone."""
    c = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], c == 32, [True]))))
    first, last = edge[::2], edge[1::2]
    out = np.zeros(len(first), np.uint64)
    i = 0
    while i < len(first):
        j = max(int(np.searchsorted(last, first[i] + _SPAN, "right")), i + 1)
        lo, hi = int(first[i]), int(last[j - 1])
        if hi - lo > _SPAN:  # one word longer than the tables
            out[i] = xxhash.xxh3_64_intdigest(data[lo:hi])
        else:
            run = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((c[lo:hi].astype(np.uint64) + np.uint64(1)) * _up[: hi - lo], dtype=np.uint64, out=run[1:])
            out[i:j] = (run[last[i:j] - lo] - run[first[i:j] - lo]) * _down[first[i:j] - lo]
        i = j
    return _mixed(out), first


def hashes(words: list[bytes]) -> np.ndarray:
    return _hashed(b" ".join(words))[0]


def _tokenise():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.tables(batches, 1 << 20):
            texts = [_plain(t) for t in common.as_bytes(b.column(1))]
            h, first = _hashed(b" ".join(texts).translate(_TABLE))
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            cut = 4 * np.searchsorted(first, starts)
            packed = h.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "words"])

    return run


def _documents(batches: Iterator[pa.RecordBatch], words: int = 160_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of some documents at a time, and where each starts; long documents are cut between passages."""
    held: list[np.ndarray] = []
    n = 0
    for b in batches:
        for packed in b.column("words").to_pylist():
            w = np.frombuffer(packed, "<u4")
            for i in range(0, len(w), words):
                held.append(w[i : i + words])
                n += len(held[-1])
                if n >= words:
                    yield np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]])
                    held, n = [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]])


def _steps(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The start of every step of STEP words, and whether the next step belongs to the same document."""
    sizes = np.diff(np.append(starts, n))
    k = -(-sizes // STEP)
    doc = np.repeat(np.arange(len(starts)), k)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    return starts[doc] + at * STEP, np.append(doc[1:] == doc[:-1], False)


def _grid(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashed words of each step, a row each, filled with DIMENSIONS."""
    pos = at[:, None] + np.arange(STEP)
    inside = pos < np.append(at[1:], len(w))[:, None]
    return np.where(inside, (w & np.uint32(DIMENSIONS - 1)).astype(np.int32)[np.minimum(pos, len(w) - 1)], DIMENSIONS)


def _padded(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, *table.shape[1:]), np.float32)]).astype(np.float32)


def _sums(table: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Sums of the rows of a padded table over each step's words."""
    by_place = np.ascontiguousarray(grid.T).astype(np.intp)
    out = table.take(by_place[0], axis=0, mode="clip")
    row = np.empty_like(out)
    for j in range(1, STEP):
        table.take(by_place[j], axis=0, out=row, mode="clip")
        out += row
    return out


def _passages(rows: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Sums over passages (a step and its next) from sums over steps."""
    out = rows.copy()
    out[:-1][follows[:-1]] += rows[1:][follows[:-1]]
    return out


def _add_rows(z: np.ndarray, keys: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """z[key] += values[row] for every (key, row). Each key's rows are summed sixteen at a time, then these sums are,
    until a key has one."""
    order = np.argsort(keys, kind="stable")
    while len(order):
        keys, rows = keys[order], rows[order]
        new = np.append(True, keys[1:] != keys[:-1])
        starts = np.flatnonzero(new)
        within = np.arange(len(keys)) - starts[np.cumsum(new) - 1]
        heads = np.flatnonzero(within & 15 == 0)
        sizes = np.diff(np.append(heads, len(keys)))
        by = np.argsort(-sizes, kind="stable")
        heads, sizes = heads[by], sizes[by]
        out = values.take(rows[heads], axis=0, mode="clip")
        row = np.empty_like(out)
        for j in range(1, int(sizes[0])):
            m = int(np.searchsorted(-sizes, -j, "left"))
            out[:m] += values.take(rows[heads[:m] + j], axis=0, out=row[:m], mode="clip")
        keys = keys[heads]
        if len(heads) == len(starts):
            z[keys] += out
            return
        values, rows = out, np.arange(len(keys))
        order = np.argsort(keys, kind="stable")


def _frequencies():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(DIMENSIONS, np.int64), 0
        for w, starts in _documents(batches):
            at, _ = _steps(starts, len(w))
            grid = np.sort(_grid(w, at), axis=1)
            first = np.ones(grid.shape, bool)
            first[:, 1:] = grid[:, 1:] != grid[:, :-1]
            total += np.bincount(grid[first], minlength=DIMENSIONS + 1)[:DIMENSIONS]
            passages += len(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS, dtype=np.int32)), pa.array(np.append(passages, total))], ["w", "n"])

    return run


def _project(shared):
    """Z = A'(A Omega) and (A Omega)'(A Omega) of a partition, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, omega = shared.value
        weighted, squares, own = _padded(omega * idf[:, None]), _padded(idf**2), np.append(idf, 0)
        z, gram = np.zeros((DIMENSIONS + 1, SKETCH), np.float32), np.zeros((SKETCH, SKETCH))
        any_rows = False
        for w, starts in _documents(batches):
            any_rows = True
            at, follows = _steps(starts, len(w))
            grid = _grid(w, at)
            norm = np.maximum(np.sqrt(_passages(_sums(squares, grid), follows)), 1e-6)[:, None]
            y = _passages(_sums(weighted, grid), follows) / norm
            gram += y.T @ y
            y /= norm
            back = y.copy()
            back[1:][follows[:-1]] += y[:-1][follows[:-1]]
            _add_rows(z, grid.reshape(-1).astype(np.uint16), np.repeat(np.arange(len(grid)), STEP), back)
        z = (z * own[:, None])[:DIMENSIONS].astype(np.float32)
        if any_rows:
            task = TaskContext.get().partitionId()
            n = DIMENSIONS // _ROWS
            rows = [z[i * _ROWS : (i + 1) * _ROWS].tobytes() for i in range(n)] + [gram.astype(np.float32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(n), -1).astype(np.int32)), pa.array(np.full(n + 1, task, np.int32)), pa.array(rows, pa.binary())], ["block", "task", "part"])

    return run


def _sum(key, pdf):
    import pandas as pd

    total = np.frombuffer(pdf["part"].iloc[0], np.float32).astype(float)
    for x in pdf["part"].iloc[1:]:
        total += np.frombuffer(x, np.float32)
    return pd.DataFrame({"block": [key[0]], "task": [key[1]], "part": [total.astype(np.float32).tobytes()]})


def decompose(z: np.ndarray, gram: np.ndarray, k: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of A, from Z = A'A Omega and Omega'A'A Omega."""
    s, u = np.linalg.eigh(gram)
    good = s > max(s.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((len(z), 1)), np.zeros(1)
    f = z @ (u[:, good] / np.sqrt(s[good]))
    v, sigma, _ = np.linalg.svd(f, full_matrices=False)
    return v[:, COMMON if v.shape[1] > COMMON else 0 : k], sigma[:k]


def lcs(a: list | np.ndarray, b: list | np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each position of a."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = places.get(x)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Searcher:
    def __init__(self, idf: np.ndarray, v: np.ndarray, items: list[tuple[int, np.ndarray]]):
        self.items = sorted(items, key=lambda x: len(x[1]))
        self.latent = _padded(v * idf[:, None])
        n = np.array([len(w) for _, w in self.items])
        #: Words that a leak shares at least; steps that as many words as the item has can touch; steps on either side of a judged passage.
        self.need = np.ceil(PART * n - 1e-9).astype(np.int32)
        self.run = -(-(n + STEP - 1) // STEP)
        self.side = -(-n // STEP)
        most = max(len(w) for _, w in items)
        #: Where a word is among the distinct words of an item, from 1; how often the item has each.
        self.place = np.zeros((DIMENSIONS + 1, len(items)), np.uint16 if most < 1 << 16 else np.int32)
        self.often = np.zeros((len(items), most + 1), np.int32)
        #: Some words count as shared without a look; the others are counted, and so many are needed. Which ones is a
        #: matter of speed: those that chance is least likely to supply (a tail bound of the Poisson distribution).
        self.counts = np.uint16 if int(2 * self.side[-1] + 2) * STEP < 1 << 16 else np.uint32
        self.rare, self.rare_need = np.zeros((DIMENSIONS + 1, len(items)), np.uint8), self.need.copy()
        vectors, self.first = [], []
        for i, (_, w) in enumerate(self.items):
            d = w & np.uint32(DIMENSIONS - 1)
            distinct, often = np.unique(d, return_counts=True)
            self.place[distinct, i] = np.arange(1, len(distinct) + 1)
            self.often[i, 1 : len(distinct) + 1] = often
            rates = BURST * self.run[i] * np.exp(-idf[distinct])
            order = np.argsort(-rates / often)
            left = self.need[i] - np.append(0, np.cumsum(often[order]))
            chance = np.maximum(rates.sum() - np.append(0, np.cumsum(rates[order])), 1e-9)
            odds = np.where((left > chance) & (left > 0), left * np.log(np.maximum(left, 1) / chance) - left + chance, -1.0)
            skipped = order[: int(odds.argmax())]
            self.rare[distinct, i] = 1
            self.rare[distinct[skipped], i] = 0
            self.rare_need[i] -= often[skipped].sum()
            self.first.append(len(vectors))
            vectors += [self._unit(self.latent[x].sum(0, keepdims=True))[0] for x in np.array_split(d, -(-len(d) // PIECE))]
        self.vectors = np.stack(vectors)
        self.overlap = int(2 * self.side[-1] + 2) * STEP

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def _enough(self, flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words from lo to hi have enough words of item j, each counted as often as the item has it."""
        out = np.zeros(len(j), bool)
        order = np.argsort(hi - lo, kind="stable")
        i = 0
        while i < len(order):
            some = order[i : i + max(1, 400_000 // max(int((hi - lo)[order[min(i + 4_000, len(order)) - 1]]), 1))][:4_000]
            i += len(some)
            pos = lo[some][:, None] + np.arange(int((hi - lo)[some].max()))
            words = np.where(pos < hi[some][:, None], flat[np.minimum(pos, len(flat) - 1)], DIMENSIONS)
            k = int((self.often[j[some]] > 0).sum(1).max()) + 1
            places = self.place[words, j[some][:, None]] + np.arange(len(some))[:, None] * k
            counts = np.bincount(places.ravel(), minlength=len(some) * k).reshape(-1, k)
            out[some] = np.minimum(counts, self.often[j[some], :k]).sum(1) >= self.need[j[some]]
        return out

    def candidates(self, w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word offset of a passage or run, item) pairs with enough words of the item."""
        at, follows = _steps(starts, len(w))
        grid = _grid(w, at)
        steps = np.arange(len(at))
        ends = np.flatnonzero(~follows) + 1
        doc = np.searchsorted(ends, steps, "right")
        begin, end = np.append(0, ends)[doc], ends[doc]
        total = np.zeros((len(at) + 1, len(self.items)), self.counts)  # differences are right even where sums wrap
        np.cumsum(_sums(self.rare, grid), axis=0, dtype=self.counts, out=total[1:])
        found = np.zeros((len(at), len(self.items)), bool)
        for k in np.unique(self.run):
            lo, hi = np.searchsorted(self.run, [k, k + 1])
            t = total[:, lo:hi]
            found[:, lo:hi] = t[np.minimum(steps + k, end)] - t[:-1] >= self.rare_need[lo:hi].astype(self.counts)
        cosine = self._unit(_passages(_sums(self.latent, grid), follows)) @ self.vectors.T
        if len(self.first) < len(self.vectors):
            cosine = np.maximum.reduceat(cosine, self.first, axis=1)
        p, j = np.divmod(np.flatnonzero(found), len(self.items))
        q, i = np.divmod(np.flatnonzero(cosine >= COSINE), len(self.items))
        first, last = np.maximum(q - self.side[i], begin[q]), np.minimum(q + 2 + self.side[i], end[q])
        wide = total[last, i] - total[first, i] >= self.rare_need[i].astype(self.counts)
        lo, hi = np.append(p, first[wide]), np.append(np.minimum(p + self.run[j], end[p]), last[wide])
        p, j = np.append(p, q[wide]), np.append(j, i[wide])
        bounds = np.append(at, len(w))
        keep = self._enough((w & np.uint32(DIMENSIONS - 1)).astype(np.int32), bounds[lo], bounds[hi], j)
        return at[p[keep]], j[keep]

    def judge(self, w: np.ndarray, offsets: list[int], item: int) -> float:
        """The largest share of the item found near the offsets, or 0 if it is no leak."""
        words = self.items[item][1].tolist()
        n, best, done = len(words), 0.0, -1
        for o in sorted(offsets):
            lo = max(0, o - n)
            hi = o + WINDOW + n
            if hi <= done:
                continue
            done = hi
            near = w[lo:hi].tolist()
            share = lcs(words, near) / n
            answer = words[-ANSWER_WORDS:]
            if share >= FULL or share >= PART and lcs(answer, near) >= ANSWER * len(answer):
                best = max(best, share)
        return best


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            ids, packed = b.column(0).to_pylist(), [np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()]
            found: list[dict[int, float]] = [{} for _ in ids]
            at = 0
            while at < len(ids):
                take, n = [], 0
                while at < len(ids) and (n < 40_000 or not take):
                    if len(packed[at]):
                        take.append(at)
                        n += len(packed[at])
                    at += 1
                for part, first, docs in _pieces(take, packed, s.overlap):
                    where, item = s.candidates(part, first)
                    doc = np.searchsorted(first, where, "right") - 1
                    near: dict[tuple[int, int], list[int]] = {}
                    for o, i, k in zip(where.tolist(), item.tolist(), doc.tolist(), strict=True):
                        near.setdefault((k, i), []).append(o - int(first[k]) + docs[k][1])
                    for (k, i), offsets in near.items():
                        d = docs[k][0]
                        share = s.judge(packed[d], offsets, i)
                        if share:
                            found[d][s.items[i][0]] = max(share, found[d].get(s.items[i][0], 0.0))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(ids, pa.int64()), pa.array([sorted(f) for f in found], pa.list_(pa.int64())), pa.array([max(f.values(), default=0.0) for f in found], pa.float64())], ["row", "doc_id", "item_ids", "share"])

    return run


def _pieces(take: list[int], packed: list[np.ndarray], overlap: int, words: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Groups of documents, and long documents in overlapping pieces, each with (document, offset)."""
    held: list[np.ndarray] = []
    docs: list[tuple[int, int]] = []
    n = 0
    for d in take:
        for i in range(0, len(packed[d]), words):
            held.append(packed[d][i : i + words + overlap])
            docs.append((d, i))
            n += len(held[-1])
        if n >= words:
            yield np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]]), docs
            held, docs, n = [], [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]]), docs


@common.narrow
def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = 7) -> DataFrame:
    """Per document: doc_id, item_ids (the items that it leaks, ascending), share (the largest found), contaminated."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    common.arrow_rows(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = common.stored(rows.mapInArrow(_tokenise(), "doc_id long, words binary").withColumn("row", F.monotonically_increasing_id()), "words")
    only = words.select("words")
    counts = np.zeros(DIMENSIONS + 1, np.int64)
    for r in only.mapInArrow(_frequencies(), "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect():  # a row per dimension
        counts[r["w"] + 1] = r["n"]
    idf = np.log((counts[0] + 1) / (counts[1:] + 1)) + 0.05
    omega = np.random.default_rng(seed).standard_normal((DIMENSIONS, SKETCH)).astype(np.float32)
    tasks = min(max(2 * sc.defaultParallelism, int(counts[0]) // PASSAGES_A_TASK), max(only.rdd.getNumPartitions(), 1))  # a task's part has a fixed size, however few its rows
    parts = only.coalesce(tasks).mapInArrow(_project(sc.broadcast((idf.astype(np.float32), omega))), "block int, task int, part binary")
    while True:  # sums of _FAN_IN parts, then of these sums
        tasks = -(-tasks // _FAN_IN)
        parts = parts.groupBy("block", F.floor(F.col("task") / _FAN_IN).cast("int").alias("task")).applyInPandas(_sum, "block int, task int, part binary")
        if tasks == 1:
            break
    z, gram = np.zeros((DIMENSIONS, SKETCH)), np.zeros((SKETCH, SKETCH))
    for r in parts.collect():  # a fixed number of blocks
        x = np.frombuffer(r["part"], np.float32).reshape(-1, SKETCH)
        if r["block"] < 0:
            gram = x.astype(float)
        else:
            z[r["block"] * _ROWS : (r["block"] + 1) * _ROWS] = x
    v, _ = decompose(z, gram)
    asked = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").orderBy("i")
    passes: list[DataFrame] = []
    block: list[tuple[int, np.ndarray]] = []

    def one_pass() -> None:
        shared = sc.broadcast(Searcher(idf, v, block))  # ITEMS_A_PASS items at most
        passes.append(words.mapInArrow(_search(shared), "row long, doc_id long, item_ids array<long>, share double"))

    for r in asked.toLocalIterator():  # the query set, a block at a time
        w = hashes(words_of(r["t"].encode()))
        if len(w):
            block.append((r["i"], w))
        if len(block) == ITEMS_A_PASS:
            one_pass()
            block = []
    if block:
        one_pass()
    if not passes:
        out = words.select("doc_id", F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("share"))
    elif len(passes) == 1:
        out = passes[0].drop("row")
    else:
        found = reduce(DataFrame.unionByName, passes).groupBy("row", "doc_id")
        out = found.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("share").alias("share")).drop("row")
    return out.withColumn("contaminated", F.size("item_ids") > 0)

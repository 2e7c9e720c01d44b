"""Subword lattice likelihood of documents.

An existing subword vocabulary gives the units. A word is one blank followed by its bytes; every way to cut it into
units is a path of a lattice, single bytes included, so that no word is impossible. A word's probability is the sum over
all paths of the product of unit probabilities, by a forward recursion in log space. Unit scores start from the
vocabulary's own ranks and are re-estimated from the distinct training words by forward and backward expectations over
the same lattices. A word of the training texts is one more path of its lattice: from the mass of its count, DISCOUNT is
taken, and what is taken from all words goes to the paths of subwords. A document's tokens repeat its own: they are
drawn from an urn that starts as WEIGHT tokens of this distribution and gains each token drawn, which has a closed form.

Documents are read once: each block of a partition keeps its distinct words once and its documents as counts of these.
Words are counted, scored and sent back by (block, word), so what is shuffled are distinct words of blocks, not tokens,
no word has more rows than there are blocks, and nothing that grows with the corpus is broadcast or collected. What the
driver sees is a number per unit of the vocabulary.

The product of all words' lattice sums alone, without the paths of whole words and the urn, is a column of its own.

A word of any length has its lattice: one of over LONG_WORD bytes is gone through in segments, so that what is held is
eight bytes a byte of it and the arcs of a segment.

Defined results: null and empty texts are the end token alone; repeated rows each count; rows with a null doc_id are
scored, and belong to training as crc32('') decides; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct words after which a block ends, and tokens likewise; they bound what a task holds.
BLOCK_WORDS, BLOCK_TOKENS = 400_000, 4_000_000
#: Bytes of a word after which its arcs are made a segment of SEGMENT starts at a time.
LONG_WORD, SEGMENT = 4096, 4096
ROUNDS = 3
#: Added to each unit's expected count.
PRIOR = 0.01
DISCOUNT, WEIGHT = 0.7, 2000.0
#: Words that a lattice is asked for at a time.
BATCH = 20_000
_BLANK = 0x20


def vocabulary(file: str) -> tuple[list[bytes], np.ndarray]:
    """Units of a sentencepiece model as bytes, a word's start as a blank, and a first guess of their logs by rank.
    The 256 single bytes are always units. Units with a blank inside are left out: no word has one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    units: dict[bytes, float] = {bytes([b]): -12.0 for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        u = sp.id_to_piece(i).replace("▁", " ").lower().encode()
        if u and b" " not in u[1:]:
            units[u] = max(units.get(u, -99.0), -math.log(i + 20))
    logs = np.array(list(units.values()))
    return list(units), logs - np.log(np.exp(logs).sum())


_MUL = np.uint64(0x9E3779B97F4A7C15)


def _hash(u: bytes) -> int:
    h = 0
    for x in u:
        h = (h * 0x9E3779B97F4A7C15 + x + 1) & (1 << 64) - 1
    return h


class Lattice:
    """Word probabilities under given unit scores, for many words at a time."""

    def __init__(self, units: list[bytes], logs: np.ndarray):
        h = np.array([_hash(u) for u in units], np.uint64)
        self.order = np.argsort(h)
        self.hashes, self.logs = h[self.order], np.append(logs[self.order], -np.inf)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[h >> np.uint64(42)] = True
        self.n, self.longest = len(units), max(map(len, units))

    def _arcs(self, m: np.ndarray) -> np.ndarray:
        """Unit of each (word, start, length - 1), or n."""
        b, size = m.shape
        k = min(self.longest, size)
        arcs = np.full((b, size, k), self.n, np.int32)
        h = np.zeros((b, size), np.uint64)
        for j in range(k):
            h = h[:, : size - j] * _MUL + m[:, j:] + np.uint64(1)
            w, s = np.nonzero(self.filter[h >> np.uint64(42)])
            x = h[w, s]
            at = np.searchsorted(self.hashes, x)
            at[at == self.n] = 0
            hit = self.hashes[at] == x
            arcs[w[hit], s[hit], j] = at[hit]
        return arcs

    def _forward(self, score: np.ndarray) -> np.ndarray:
        b, size, k = score.shape
        alpha = np.full((b, size + 1), -np.inf)
        alpha[:, 0] = 0
        for e in range(1, size + 1):
            d = np.arange(min(k, e))
            c = alpha[:, e - 1 - d] + score[:, e - 1 - d, d]
            top = c.max(1)
            alpha[:, e] = top + np.log(np.exp(c - top[:, None]).sum(1))
        return alpha

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(w) if len(w) < LONG_WORD else -1 for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for g in np.split(order, cuts):
            if len(g) and sizes[g[0]] >= 0:
                step = max(1, 60_000 // (int(sizes[g[0]]) + 1))
                for i in range(0, len(g), step):
                    part = g[i : i + step]
                    m = np.frombuffer(b"".join(b" " + words[j] for j in part), np.uint8).reshape(len(part), -1).astype(np.uint64)
                    yield part, m

    def _segments(self, word: bytes, backwards: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(first start, arcs) of a long word's segments; the arcs of a segment may end beyond it."""
        m = np.frombuffer(b" " + word, np.uint8)
        for s in sorted(range(0, len(m), SEGMENT), reverse=backwards):
            arcs = self._arcs(m[None, s : s + SEGMENT + self.longest].astype(np.uint64))
            yield s, arcs[0, : min(SEGMENT, len(m) - s)]

    def _long_forward(self, word: bytes) -> np.ndarray:
        alpha = np.full(len(word) + 2, -np.inf)
        alpha[0] = 0
        for s, arcs in self._segments(word):
            score = self.logs[arcs]
            for i in range(len(arcs)):  # each start adds its arcs to where they end
                k = min(arcs.shape[1], len(alpha) - 1 - s - i)
                to = alpha[s + i + 1 : s + i + 1 + k]
                np.logaddexp(to, alpha[s + i] + score[i, :k], out=to)
        return alpha

    def _long_expected(self, word: bytes, count: float, out: np.ndarray) -> None:
        alpha = self._long_forward(word)
        beta = np.full(len(alpha), -np.inf)
        beta[-1] = 0
        for s, arcs in self._segments(word, backwards=True):
            score = self.logs[arcs]
            k = arcs.shape[1]
            for i in range(len(arcs) - 1, -1, -1):
                after = beta[s + i + 1 : s + i + 1 + k]
                beta[s + i] = np.logaddexp.reduce(after + score[i, : len(after)])
            at, j = np.nonzero(arcs < self.n)
            p = np.exp(alpha[s + at] + score[at, j] + beta[s + at + j + 1] - alpha[-1]) * count
            out += np.bincount(arcs[at, j], weights=p, minlength=self.n + 1)

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for part, m in self._groups(words):
            out[part] = self._forward(self.logs[self._arcs(m)])[:, -1]
        for i, w in enumerate(words):
            if len(w) >= LONG_WORD:
                out[i] = self._long_forward(w)[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected count of each unit, in the order of the units given."""
        out = np.zeros(self.n + 1)
        for part, m in self._groups(words):
            arcs = self._arcs(m)
            score = self.logs[arcs]
            b, size, k = score.shape
            alpha = self._forward(score)
            beta = np.full((b, size + 1), -np.inf)
            beta[:, size] = 0
            for s in range(size - 1, -1, -1):
                d = np.arange(min(k, size - s))
                c = beta[:, s + 1 + d] + score[:, s, d]
                top = c.max(1)
                beta[:, s] = top + np.log(np.exp(c - top[:, None]).sum(1))
            w, s, j = np.nonzero(arcs < self.n)
            p = np.exp(alpha[w, s] + score[w, s, j] + beta[w, s + j + 1] - alpha[w, -1]) * counts[part][w]
            out += np.bincount(arcs[w, s, j], weights=p, minlength=self.n + 1)
        for w, c in zip(words, counts, strict=True):
            if len(w) >= LONG_WORD:
                self._long_expected(w, float(c), out)
        back = np.empty(self.n)
        back[self.order] = out[: self.n]
        return back


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


BLOCKS = "block long, doc_id long, held_out boolean, n_tokens long, words binary, counts binary, word binary, at int, trained long"


def _blocks():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, tokens = TaskContext.get().partitionId(), 0, 0
        seen: dict[bytes, int] = {}
        trained: list[int] = []
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]

        def batch(cols: dict) -> pa.RecordBatch:
            n = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays([pa.array(cols.get(c, [None] * n), t) for c, t in zip(names, types, strict=True)], names)

        def words() -> Iterator[pa.RecordBatch]:
            ws = list(seen)
            for i in range(0, len(ws), 50_000):
                w = ws[i : i + 50_000]
                yield batch({"block": [block] * len(w), "word": w, "at": list(range(i, i + len(w))), "trained": trained[i : i + len(w)]})

        block = part << 24
        for b in common.tables(batches):
            ids, held = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows: dict[str, list] = {"block": [], "doc_id": [], "held_out": [], "n_tokens": [], "words": [], "counts": []}
            for d, out, text in zip(ids, held, common.as_bytes(b.column(2)), strict=True):
                ws = text.lower().split()
                at = np.fromiter((seen.setdefault(w, len(seen)) for w in ws), np.uint32, len(ws))
                trained += [0] * (len(seen) - len(trained))
                at, n = np.unique(at, return_counts=True)
                if not out:
                    for a, c in zip(at.tolist(), n.tolist(), strict=True):
                        trained[a] += c
                for k, v in zip(rows, (block, d, out, len(ws) + 1, at.astype("<u4").tobytes(), n.astype("<u4").tobytes()), strict=True):
                    rows[k].append(v)
                tokens += len(ws)
            yield batch(rows)
            if len(seen) > BLOCK_WORDS or tokens > BLOCK_TOKENS:
                yield from words()
                seen, trained, tokens = {}, [], 0
                number += 1
                block = (part << 24) + number
        yield from words()

    return run


def _expect(lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, total = lattice.value, np.zeros(lattice.value.n)
        for b in common.merged(batches, BATCH):
            total += lat.expected(b.column(0).to_pylist(), np.ones(b.num_rows))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["unit", "n"])

    return run


def _probe(lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.merged(batches, BATCH):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lattice.value.log_probs(b.column(0).to_pylist()))], ["word", "c", "p"])

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 1 or more: Stirling's series, eight steps up."""
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - sum(np.log(x + i) for i in range(8))


def _score(n: int, v: int, ends: int):
    """Base and model scores of the documents of a block, from its words' counts and subword scores (natural logs)."""

    def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        size = len(words)
        c, p = np.zeros(size), np.zeros(size)
        at = words["at"].to_numpy()
        c[at], p[at] = words["c"].to_numpy(), words["p"].to_numpy()
        base = np.log10((c + 1) / (n + v + 1))
        end = math.log10((ends + 1) / (n + v + 1))
        types, pure = max(v, 1), p / math.log(10)
        p = p + math.log(DISCOUNT * types / max(n, 1)) if n else p
        with np.errstate(divide="ignore"):
            p = np.logaddexp(np.log(np.maximum(c - DISCOUNT, 0) / max(n, 1)), p)
        p_end = math.log(max(ends - DISCOUNT, 1e-3) / max(n, 1))
        mass = WEIGHT * np.exp(p)
        out = []
        for w, k in zip(docs["words"], docs["counts"], strict=True):
            w, k = np.frombuffer(w, "<u4"), np.frombuffer(k, "<u4").astype(float)
            tokens, again = float(k.sum()) + 1, k > 1
            own = p[w].sum() + p_end + len(w) * math.log(WEIGHT) + math.log(WEIGHT)
            own += float((_log_gamma(mass[w][again] + k[again]) - _log_gamma(mass[w][again] + 1)).sum())
            own -= math.lgamma(WEIGHT + tokens) - math.lgamma(WEIGHT)
            out.append((int(k[c[w] > 0].sum()) + (ends > 0), n, float(k @ base[w]) + end, own / math.log(10), float(k @ pure[w]) + end))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
        return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": docs["n_tokens"], "n_known": list(cols[0]), "train_tokens": list(cols[1]), "base_score": list(cols[2]), "score": list(cols[3]), "lattice_score": list(cols[4])})

    return run


@common.narrow
def score(docs: DataFrame, file: str, is_held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and lattice_score, the lattice
    sums of its words and the end token's base probability alone (all three log10)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    common.arrow_rows(spark)
    held = held_out(F.col(id_col)) if is_held_out is None else is_held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    blocks = common.stored(rows.mapInArrow(_blocks(), BLOCKS), "blocks")
    entries = blocks.where("word IS NOT NULL").select("block", "at", "word", "trained")
    doc_rows = blocks.where("word IS NULL").select("block", "doc_id", "held_out", "n_tokens", "words", "counts")
    counts = common.stored(entries.groupBy("word").agg(F.sum("trained").alias("c")), "counts")
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    ends = doc_rows.where("NOT held_out").count()
    n, v = seen["n"] + ends, seen["v"] + (ends > 0)
    units, logs = vocabulary(file)
    trained = counts.where("c > 0")
    for _ in range(rounds if seen["n"] else 0):
        shared = sc.broadcast(Lattice(units, logs))  # of the vocabulary's size
        got = np.full(len(units), PRIOR)
        for r in trained.mapInArrow(_expect(shared), "unit int, n double").groupBy("unit").agg(F.sum("n").alias("n")).collect():  # a row per unit
            got[r["unit"]] += r["n"]
        logs = np.log(got / got.sum())
    scored = counts.mapInArrow(_probe(sc.broadcast(Lattice(units, logs))), "word binary, c long, p double")
    back = entries.select("block", "at", "word").join(scored, "word").select(F.col("block").alias("of"), "at", "c", "p")
    out = doc_rows.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(_score(n, v, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double")
    return out

"""Toxicity scores of texts restored by a noisy-channel decoder.

Channel: a written token is a lattice over its characters. Digits and signs may stand for letters, a repeated letter may
be surplus, signs between single letters may be filler, and a run of single-letter words may be one or more words.
Source: a character trigram model counted over all texts. Viterbi picks the likeliest restored text. Tokens without any
such sign have one path and are left as they are.

Score: words and word beginnings that are over-represented in toxic training documents are weighted by log odds; a
logistic regression over a document's weights gives the probability. Labels come from at most SAMPLE labelled training
documents, those of the smallest hashes: three quarters choose the words, all fit the regression's six numbers. A token
or a run of single letters is decoded as a whole, however long it is, in time and memory that grow with its length.

Defined results: null and empty texts have no hits and get the score of a text without any; repeated rows get equal
scores; of equally likely restorations the one met first is taken; without labels of both kinds every score is the smoothed share of toxic labels; an empty
table gives no rows; other columns are ignored. Labels repeated for a document count once each.
"""

from __future__ import annotations

import math
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 20_000
PREFIXES = range(3, 9)
#: Tokens that a worker remembers.
MEMORY = 400_000
#: Letters that a digit or sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
_SIGNS = re.escape("".join(LEET))
_LETTER = re.compile(rb"[a-z]")
_NOISE = re.compile(rf"[{_SIGNS}]|([a-z])\1".encode())
_SPACED = re.compile(rf"^[a-z{_SIGNS}](?:[.\-_*][a-z{_SIGNS}]){{2,}}$".encode())
_PUNCTUATION = string.punctuation.encode()
_EDGE = string.punctuation.replace("@", "").replace("$", "").replace("|", "").replace("+", "").encode()
_CLASSES = np.full(256, 27, np.uint16)
_CLASSES[list(b" \t\n\x0b\x0c\r")] = 0
_CLASSES[97:123] = np.arange(1, 27)
_CLASSES[65:91] = np.arange(1, 27)
_CODES = {chr(b): b - 96 for b in range(97, 123)} | {" ": 0}
_DOUBTFUL = re.compile(rf"[{_SIGNS}.\-_*]|([a-z])(?=\1)")


def count_trigrams(data: bytes) -> np.ndarray:
    c = _CLASSES[np.frombuffer(b"  " + data + b"  ", np.uint8)]
    return np.bincount(c[:-2] << 10 | c[1:-1] << 5 | c[2:], minlength=1 << 15)


def _count():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 15, np.int64)
        for b in common.tables(batches):
            total += count_trigrams(b" ".join(common.as_bytes(b.column(0))))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    return run


def trigram_logs(counts: np.ndarray) -> np.ndarray:
    """log p(third | first two), smoothed by the model of one letter less."""
    n = counts.reshape(32, 32, 32).astype(float)
    uni = (n.sum((0, 1)) + 1) / (n.sum() + 32)
    two = n.sum(0)
    bi = (two + 20 * uni) / (two.sum(1, keepdims=True) + 20)
    return np.log((n + 5 * bi[None]) / (n.sum(2, keepdims=True) + 5))


#: Characters after which what all paths have in common is put aside, so that a long token holds short paths.
_SETTLE = 1024


def _settled(states: dict, cut: dict) -> tuple[list[str], dict]:
    """What every path begins with, in pieces, and the states with paths that go on from there. A path is a chain of
    (path before, what was put out, length)."""
    paths = {id(p): p for _, p in states.values()}
    while len(paths) > 1:  # the longest steps back first, until all meet
        most = max(p[2] for p in paths.values())
        paths = {id(q): q for q in (p[0] if p[2] == most else p for p in paths.values())}
    common_path = next(iter(paths.values()))
    out = []
    p = common_path
    while p[0] is not None:
        out.append(p[1])
        p = p[0]
    root = (None, "", common_path[2])

    def again(q: tuple) -> tuple:
        tail = []
        while q is not common_path:
            tail.append(q)
            q = q[0]
        new = root
        for x in reversed(tail):
            new = cut.setdefault(id(x), (new, x[1], x[2]))
        return new

    return out[::-1], {k: (s, again(q)) for k, (s, q) in states.items()}


def _steps(ch: str, before: str, spaced: bool) -> list[tuple[str, float]]:
    """What a written character may stand for, and the cost."""
    if ch in LEET:
        steps = [(x, 0.5) for x in LEET[ch]] + [(ch, 2.0)]
    elif ch in ".-_*":
        steps = [("", 0.1), (ch, 2.0)]
    else:
        steps = [(ch, 0.0)]
        if ch == before and "a" <= ch <= "z":
            steps.append(("", 0.7))
    if spaced and before:
        steps += [(" " + x, c + 0.5) for x, c in steps if x and x != ch or ch.isalpha()]
    return steps


def decode(token: str, logs: list, spaced: bool = False) -> str:
    """The likeliest text that token was written for; logs[x][y][z] are nested lists. spaced: it was a run of single
    letters, so words may end inside. Costs of the channel, in nats: a sign for a letter 0.5, a sign kept 2, a surplus
    letter 0.7, filler 0.1. What lies before the first character in doubt, and two characters after the last one, is the
    same on all paths and left out of the search."""
    first, last = (1, len(token)) if spaced else (len(token), 0)
    if not spaced:
        for m in _DOUBTFUL.finditer(token):
            last = m.end() + (m[1] is not None)
            first = min(first, last - 1)
    code = _CODES.get
    start = max(first, 0)
    end = max(start, min(last + 2, len(token)))
    known = "  " + token[:start]
    states: dict[tuple[int, int], tuple[float, tuple]] = {(code(known[-2], 27), code(known[-1], 27)): (0.0, (None, "", 0))}
    done: list[str] = [token[:start]]
    for i in range(start, end):
        steps = _steps(token[i], token[i - 1] if i else "", spaced)
        new: dict[tuple[int, int], tuple[float, tuple, str]] = {}
        for (a, b), (score, path) in states.items():
            for out, cost in steps:
                s, x, y = score - cost, a, b
                for o in out:
                    z = code(o, 27)
                    s += logs[x][y][z]
                    x, y = y, z
                key = (x, y)
                if key not in new or s > new[key][0]:
                    new[key] = (s, path, out)
        states = {k: (s, (path, out, path[2] + 1)) for k, (s, path, out) in new.items()}
        if i % _SETTLE == _SETTLE - 1:
            settled, states = _settled(states, {})
            done += settled
    path = max(((s + logs[a][b][0], -k, p) for k, ((a, b), (s, p)) in enumerate(states.items())), key=lambda x: x[:2])[2]
    tail = []
    while path[0] is not None:
        tail.append(path[1])
        path = path[0]
    return "".join([*done, *tail[::-1], token[end:]])


class Restorer:
    def __init__(self, logs: np.ndarray):
        self.logs = logs.tolist()

    def token(self, w: bytes) -> list[bytes]:
        """The words that a token stands for."""
        core = w.strip(_EDGE)
        if not (_LETTER.search(core) and _NOISE.search(core) or _SPACED.match(core)):
            return [w.strip(_PUNCTUATION)]
        return [x.encode() for x in decode(core.decode(errors="replace"), self.logs).split()]

    def runs(self, words: list[bytes]) -> list[bytes]:
        """Words that runs of three or more single letters stand for."""
        ones = [i for i, w in enumerate(words) if len(w) == 1]
        out: list[bytes] = []
        if len(ones) < 3:
            return out
        start = 0
        for j in range(1, len(ones) + 1):
            if j == len(ones) or ones[j] != ones[j - 1] + 1:
                run = ones[start:j]
                if len(run) >= 3:
                    text = b"".join(words[run[0] : run[-1] + 1])
                    out += [x.encode() for x in decode(text.decode("ascii", "replace"), self.logs, True).split()]
                start = j
        return out


def features(word: bytes) -> list[bytes]:
    """A word itself, marked by a blank, and its beginnings."""
    return [b" " + word, *(word[:k] for k in PREFIXES if k <= len(word))]


class Model:
    def __init__(self, logs: np.ndarray, weights: dict[bytes, float], beta: np.ndarray):
        self.restorer, self.weights, self.beta, self.key = Restorer(logs), weights, beta, uuid.uuid4().hex
        #: The first three letters of every feature; most words have none of these.
        self.heads = {f[1:4] if f[:1] == b" " else f[:3] for f in weights}

    def weight(self, word: bytes) -> float:
        if word[:3] not in self.heads:
            return 0.0
        get = self.weights.get
        return max(get(f, 0.0) for f in features(word))

    def token(self, w: bytes) -> float:
        return max((self.weight(x) for x in self.restorer.token(w) if x), default=0.0)

    def measures(self, text: bytes) -> list[float]:
        words = text.lower().split()
        memory = _memory(self.key)
        total = top = 0.0
        hits = 0
        for w in set(words):
            x = memory.get(w)
            if x is None:
                if len(memory) > MEMORY:
                    memory.clear()
                x = memory[w] = self.token(w)
            if x:
                hits += 1
                total += x
                top = max(top, x)
        for r in self.restorer.runs(words):
            x = self.weight(r)
            if x:
                hits, total, top = hits + 1, total + x, max(top, x)
        n = max(len(words), 1)
        return [1.0, math.log1p(total), top, math.log1p(hits), min(total / math.sqrt(n), 20.0), min(50.0 * total / n, 20.0)]

    def score(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-float(np.dot(self.beta, self.measures(text)))))


def _memory(key: str) -> dict[bytes, float]:
    return common.remembered(f"toxicity {key}", dict)


def _toxic_features(logs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(logs.value), Counter()
        for b in batches:
            for text in common.as_bytes(b.column(0)):
                words = text.lower().split()
                seen.update({f for w in set(words) for x in restorer.token(w) if x for f in features(x)} | {f for x in restorer.runs(words) for f in features(x)})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["f", "n"])

    return run


def _clean_features(logs, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen, known = Restorer(logs.value), Counter(), wanted.value
        for b in batches:
            for text in common.as_bytes(b.column(0)):
                words = text.lower().split()
                own = {f for w in set(words) for x in restorer.token(w) if x for f in features(x) if f in known}
                seen.update(own | {f for x in restorer.runs(words) for f in features(x) if f in known})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["f", "n"])

    return run


def _measure(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([model.value.measures(t) for t in common.as_bytes(b.column(0))], pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _apply(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.tables(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([model.value.score(t) for t in common.as_bytes(b.column(2))], pa.float64())], ["doc_id", "held_out", "score"])

    return run


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _regress(x: np.ndarray, y: np.ndarray, prior: float = 1.0) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + prior * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (y - p) - prior * beta)
    return beta


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of docs' letters and of labels (doc_id, toxic). Only training labels are passed in."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    counts = np.zeros(1 << 15, np.int64)
    for r in docs.select("text").mapInArrow(_count(), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # 32768 rows at most
        counts[r["gram"]] = r["n"]
    logs = trigram_logs(counts)
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "toxic").limit(sample).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)))
    shared = sc.broadcast(logs)
    labelled = common.stored(docs.join(F.broadcast(common.stored(chosen, "chosen")), "doc_id").select("text", "toxic", "fold"), "labelled")  # ids of a sample
    part = labelled.where("fold < 3")
    size = {r["toxic"]: r["n"] for r in part.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t, c = size.get(1, 0), size.get(0, 0)
    if not t or not c:
        return Model(logs, {}, np.array([math.log((t + 0.5) / (c + 4.5)), 0, 0, 0, 0, 0]))
    toxic = part.where("toxic = 1").select("text").mapInArrow(_toxic_features(shared), "f binary, n long").groupBy("f").agg(F.sum("n").alias("n")).where("n >= 3")
    toxic = {bytes(r["f"]): r["n"] for r in toxic.collect()}  # features of three toxic documents of the sample or more
    clean = part.where("toxic = 0").select("text").mapInArrow(_clean_features(shared, sc.broadcast(frozenset(toxic))), "f binary, n long").groupBy("f").agg(F.sum("n").alias("n"))
    clean = {bytes(r["f"]): r["n"] for r in clean.collect()}  # candidates only
    kept = []
    for f, n in toxic.items():
        m = clean.get(f, 0)
        odds = math.log((n + 0.5) / (t + 1)) - math.log((m + 0.5) / (c + 1))
        expected = (m + 0.5) * t / c
        z = (n - expected) / math.sqrt(expected + 1)
        if odds >= 1.2 and z >= 3.5:
            kept.append((f, odds))
    weights = dict(sorted(kept))
    model = Model(logs, weights, np.zeros(6))
    rows = labelled.select("text", "toxic").mapInArrow(_measure(sc.broadcast(model)), "toxic int, x array<double>").collect()  # six numbers for each of the sample
    model.beta = _regress(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    common.dropped(labelled)
    return model


def _fitted(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> Model:
    common.arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return fit(rows, labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))), sample)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of held-out documents are not learned from."""
    model = _fitted(docs, labels, sample, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _pass(model, threshold: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.tables(batches):
            yield b.filter(pa.array([model.value.score(t) < threshold for t in common.as_bytes(b.column(at))], pa.bool_()))

    return run


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score() would not predict to be toxic. Each row is judged where it
    is read, so no rows are joined."""
    model = _fitted(docs, labels, sample, id_col, text_col)
    return docs.mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(model), threshold, docs.columns.index(text_col)), docs.schema)

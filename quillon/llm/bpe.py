"""Ids of texts by a byte-level BPE vocabulary of the tokenizers library.

Byte-level BPE merges nothing across pre-tokens, so each worker lets the library's model encode every distinct
pre-token once and puts documents together from them. Texts are first cut at spaces that follow a character other than
white space: no pre-token crosses such a place and none looks behind it, so the ids are those of the whole text.
Where a text spells one of the vocabulary's added tokens, that is cut out first and has its own id, as the library does
by default; a file whose settings differ from these is left to the library altogether.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Chunks that a worker remembers, at about 150 bytes each; past it the memory starts anew.
MEMORY = 800_000
#: Rows and bytes that are encoded together, about.
ROWS, BYTES = 2000, 8 << 20
#: Bytes of a text after which it is encoded by itself.
LONG = 2 << 20
#: Python's white space before a space or at the end, or a space at the start.
_ODD = r"^ |[\t-\r\x1c-\x1f\x{85}\p{Z}](?: |$)"
_CUT = re.compile(r"(?<=\S)(?= )")
#: Fixed value: the pre-token pattern of byte-level BPE, for ASCII text; other chunks are left to the library.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def _letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else one from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        added = self.tok.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        with open(file) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.model, self.split = self.tok.model, self.tok.pre_tokenizer.pre_tokenize_str
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 65_536 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.letters = _letters()

    def chunks(self, text: str) -> list[str]:
        parts = text.split(" ")
        for p in parts:
            if not p or p[-1].isspace():
                return _CUT.split(text)
        out = [" " + p for p in parts]
        out[0] = parts[0]
        return out

    def _part(self, p: str) -> bytes:
        """One pre-token, in the letters of its bytes."""
        ids = self.parts[p] = array(self.code, [t.id for t in self.model.tokenize(p)]).tobytes()
        return ids

    def _split(self, c: str) -> list[str]:
        """The pre-tokens of a chunk, in the letters of their bytes."""
        return [p.translate(self.letters) for p in _ASCII.findall(c)] if c.isascii() else [p for p, _ in self.split(c)]

    def _chunk(self, c: str) -> bytes:
        """Mostly a chunk is a word, which is one pre-token, or a word and some punctuation, which is another."""
        if len(self.known) > MEMORY:
            self.known.clear()
            self.parts.clear()
        get, part = self.parts.get, self._part
        core = c.rstrip(string.punctuation)
        word = core[1:] if core[:1] == " " else core
        if not word.isalpha():
            out = b"".join([get(p) or part(p) for p in self._split(c)])
        elif len(core) < len(c):
            tail = c[len(core) :]
            out = (self.known.get(core) or self._chunk(core)) + (get(tail) or part(tail))
        else:
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            out = array(self.code, [t.id for t in self.model.tokenize("Ġ" + word if c[0] == " " else word)]).tobytes()
        self.known[c] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text, as packed integers of self.dtype."""
        if not self.plain:
            return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        if self.cut and any(a in text for a in self.added):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += [self._ordinary(text[at : m.start()]), array(self.code, [self.added[m[0]]]).tobytes()]
                at = m.end()
            return b"".join([*out, self._ordinary(text[at:])])
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        get, chunk = self.known.get, self._chunk
        return b"".join([get(c) or chunk(c) for c in self.chunks(text)])


    def _is_odd(self, texts: pa.Array) -> np.ndarray:
        """Texts that are not one chunk a space: spaces at an end or after white space, added tokens, great length."""
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.greater(pc.binary_length(texts), LONG))
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        return odd.to_numpy(zero_copy_only=False)

    def encode_column(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """Ids of many texts (null: empty), each with end after them. The words of all are numbered by Arrow, so that each
        distinct one is looked up once a batch; texts with odd spaces are encoded one at a time."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = self._is_odd(texts) if self.plain else np.ones(len(texts), bool)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.encode(texts[i].as_py()) + end
        rows = np.flatnonzero(~odd)
        if not len(rows):
            return out
        parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        ends = parts.offsets.to_numpy().astype(np.int64)
        ends, words = ends - ends[0], parts.flatten()
        numbered = words.dictionary_encode()
        get, chunk = self.known.get, self._chunk
        pieces = [get(c) or chunk(c) for c in [" " + w for w in numbered.dictionary.to_pylist()]]
        codes = numbered.indices.to_numpy().astype(np.int64)
        codes[ends[:-1]] = len(pieces) + np.arange(len(rows))
        pieces += [(get(w) or chunk(w)) if w else b"" for w in words.take(pa.array(ends[:-1])).to_pylist()]
        codes = np.insert(codes, ends[1:], len(pieces))
        pieces.append(end)
        width = self.dtype.itemsize
        ids = np.frombuffer(b"".join(pieces), self.dtype)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // width
        first = np.cumsum(size) - size
        n = size[codes]
        upto = np.cumsum(n)
        packed = ids[np.repeat(first[codes] - upto + n, n) + np.arange(int(upto[-1]))].tobytes()
        stop = (upto[ends[1:] + np.arange(len(rows))] * width).tolist()
        for i, a, b in zip(rows.tolist(), [0, *stop], stop, strict=False):
            out[i] = packed[a:b]
        return out


def encoder(file: str) -> Encoder:
    """One encoder per worker and file; worker processes are reused, so its memory outlives a task, until another operator
    runs there."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return common.remembered(f"bpe {file}", lambda: Encoder(file))

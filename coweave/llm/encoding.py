"""Exact library token ids of whole batches, each distinct piece encoded once.

For byte-level BPE files the library splits a text by a fixed pattern and merges inside the pieces only, so every border
between pieces is a safe place to split, and the ids of a text are those of its pieces in order.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np

from . import vectext as V


@functools.cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.cache
def is_plain_byte_level(path: str) -> bool:
    """Whether pieces of the byte-level pattern can be encoded one by one."""
    with open(path) as f:
        d = json.load(f)
    pre = d.get("pre_tokenizer") or {}
    plain = d.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(plain and (d.get("model") or {}).get("type") == "BPE" and all(not (a["single_word"] or a["lstrip"] or a["rstrip"]) for a in d["added_tokens"]) and len(d["added_tokens"]) <= 1)


@functools.cache
def special_string(path: str) -> bytes:
    with open(path) as f:
        added = json.load(f)["added_tokens"]
    return added[0]["content"].encode() if added else b""


class Memo:
    """Ids of the pieces seen by this worker. Bounded: when it holds more than ``most`` pieces, only those of the batch stay."""

    def __init__(self, encode, most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, pieces: list[bytes]) -> None:
        flat, sizes = self.encode(pieces)
        n, m = len(self.at), len(self.at) + len(pieces)
        if m > len(self.start):
            self.start, self.size = (np.concatenate([x[:n], np.zeros(m, np.int64)]) for x in (self.start, self.size))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + len(flat), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[n:m] = sizes
        self.start[n:m] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.at.update(zip(pieces, range(n, m), strict=True))

    def _keep(self, pieces: list[bytes]) -> None:
        at = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        flat, sizes, encode = self.flat[V.ranges(self.start[at], self.size[at])], self.size[at], self.encode
        self.clear()
        self.encode = lambda _: (flat, sizes)
        self._add(pieces)
        self.encode = encode

    def __call__(self, pieces: list[bytes]) -> np.ndarray:
        """Places of the distinct pieces in start and size."""
        if len(self.at) > self.most:
            self._keep([p for p in pieces if p in self.at])
        place = np.fromiter(map(self.at.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(place < 0)
        if new.size:
            place[new] = np.arange(len(self.at), len(self.at) + new.size)
            self._add([pieces[i] for i in new.tolist()])
        return place


@functools.cache
def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def library_encode(path: str):
    """Encoder of distinct pieces by the library: by its model alone where the pieces are those of the byte-level pattern, which is all
    that comes before the model then; else each piece as a text."""
    special = special_string(path)

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tok = library(path)
        if is_plain_byte_level(path):
            model, chars, own = tok.model, byte_characters(), [tok.token_to_id(special.decode())] if special else []
            ids = [own if p == special else [t.id for t in model.tokenize(p.decode("latin-1").translate(chars))] for p in pieces]
        else:
            ids = [e.ids for e in tok.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    return encode


def pieces_of(buf: np.ndarray, offs: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Document and code of each piece of all texts, and the bytes of each code; special strings are pieces."""
    cuts, is_special = V.split_special(buf, offs, special)
    start = V.pretokens(buf, cuts)
    if is_special.any():
        lo, hi = cuts[:-1][is_special], cuts[1:][is_special]
        inside = np.searchsorted(lo, start, side="right") - 1
        drop = (inside >= 0) & (start > lo[inside]) & (start < hi[inside])
        start = start[~drop]
    length = np.diff(np.append(start, offs[-1]))
    codes, first = V.factorize_spans(buf, start, length)
    return V.owner(start, offs), codes, V.span_bytes(buf, start[first], length[first])


@functools.cache
def memo(path: str) -> Memo:
    return Memo(library_encode(path))


def encode_texts(buf: np.ndarray, offs: np.ndarray, path: str, memo_: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts in order, and the number of ids of each text."""
    m = memo_ or memo(path)
    doc, codes, distinct = pieces_of(buf, offs, special_string(path))
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
    place = m(distinct)[codes]
    size = m.size[place]
    counts = np.bincount(doc, weights=size, minlength=len(offs) - 1).astype(np.int64)
    return m.flat[V.ranges(m.start[place], size)], counts


def count_texts(buf: np.ndarray, offs: np.ndarray, path: str) -> np.ndarray:
    """The number of ids of each text, without building the ids."""
    m = memo(path)
    doc, codes, distinct = pieces_of(buf, offs, special_string(path))
    if not len(codes):
        return np.zeros(len(offs) - 1, np.int64)
    place = m(distinct)
    return np.bincount(doc, weights=m.size[place][codes], minlength=len(offs) - 1).astype(np.int64)

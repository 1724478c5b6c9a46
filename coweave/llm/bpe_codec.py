"""BPE encoding and decoding over a minimal acyclic transducer lexicon.

``lexicon`` counts the pieces of all documents, compiles the frequent ones into an automaton whose equal suffixes share their
states, and gives a byte string of bounded size. Its arcs carry numbers whose sum along a word is the word's place among all
words, and the ids of a word stand at its place. Workers map that file into memory and walk all distinct pieces of a batch in
step; pieces that the lexicon lacks are merged exactly, all in step as well. The lexicon only changes the speed.

Defined cases: a null text counts as empty; an empty text has no ids; a very long text is encoded whole; the string of the added
token becomes its id, as in the library, and is decoded to itself; rows are treated one by one, so repeated rows, null ids and other columns need no rule; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoding
from . import vectext as V
from .common import id_and_text

NONE = np.int64(1) << 40


# -- the tokenizer's tables -----------------------------------------------------------------------------------


def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tables:
    """Ids of the single bytes, merges by pair of ids, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path) as f:
            d = json.load(f)
        vocab, byte = d["model"]["vocab"], _byte_chars()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte.items():
            self.byte_id[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]]
        left, right, made = (np.array([vocab[x] for x in side], np.int64) for side in (*zip(*merges, strict=True), [a + b for a, b in merges]))
        self.bits = 18
        keys = self.key(left, right)
        keep = np.sort(np.unique(keys, return_index=True)[1])
        self._table(keys[keep], keep, made[keep])
        added = {a["id"]: a["content"].encode() for a in d["added_tokens"]}
        text = {i: bytes(byte[c] for c in s) for s, i in vocab.items()} | added
        parts = [text.get(i, b"") for i in range(max(text) + 1)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.special = {v: k for k, v in added.items()}

    @staticmethod
    def key(a, b):
        return a << np.int64(20) | b

    def _slot(self, keys):
        return (V.mix(keys.astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _table(self, keys, ranks, made) -> None:
        """Open addressing, filled in rounds; a free slot has key -1."""
        n = 1 << self.bits
        self.keys, self.rank, self.made = np.full(n, -1, np.int64), np.full(n, NONE), np.zeros(n, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while todo.size:
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.rank[at[won]], self.made[at[won]] = ranks[won], made[won]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (n - 1)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no such merge) and slot of each pair."""
        keys = self.key(a, b)
        at = self._slot(keys)
        got = self.keys[at]
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while todo.size:
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[todo]]
            todo = todo[(got != keys[todo]) & (got >= 0)]
        return np.where(self.keys[at] == keys, self.rank[at], NONE), at


@functools.cache
def tables(path: str) -> Tables:
    return Tables(path)


# -- exact merging --------------------------------------------------------------------------------------------


def merge_in_step(t: Tables, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces, in order, and the number of ids of each."""
    n = len(pieces)
    lens = np.fromiter(map(len, pieces), np.int64, n)
    out: list = [None] * n
    for lo, hi in ((0, 4), (4, 8), (8, 12), (12, 20), (20, 40), (40, 160)):
        rows = np.flatnonzero((lens > lo) & (lens <= hi))
        for at in range(0, len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)]
            for i, ids in zip(part.tolist(), _merge_block(t, [pieces[i] for i in part.tolist()], lens[part]), strict=True):
                out[i] = ids
    for i in np.flatnonzero(lens > 160).tolist():
        out[i] = _merge_long(t, pieces[i])
    empty = np.zeros(0, np.int64)
    out = [empty if x is None else x for x in out]
    sizes = np.fromiter(map(len, out), np.int64, n)
    return np.concatenate([empty, *out]).astype(np.uint32), sizes


def _merge_block(t: Tables, pieces: list[bytes], lens: np.ndarray) -> list[np.ndarray]:
    n, width = len(pieces), int(lens.max())
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    cell = np.arange(width) < lens[:, None]
    a = np.full((n, width + 1), -1, np.int64)
    a[:, :width][cell] = t.byte_id[raw]
    rank = np.full((n, width + 1), NONE)
    pair = np.zeros((n, width), bool)
    pair[:, : width - 1] = cell[:, 1:]
    if pair.any():
        rank[:, :width][pair] = t.lookup(a[:, :width][pair], a[:, 1:][pair])[0]
    left, lens = np.arange(n), lens.copy()
    final = np.full((n, width), -1, np.int64)
    cols = np.arange(width)
    while left.size:
        j = rank.argmin(axis=1)
        row = np.arange(len(left))
        done = rank[row, j] >= NONE
        if done.any():
            final[left[done], : a.shape[1] - 1] = a[done, :-1]
            a, rank, left, j = a[~done], rank[~done], left[~done], j[~done]
            if not left.size:
                break
            row = np.arange(len(left))
        made = t.made[t.lookup(a[row, j], a[row, j + 1])[1]]
        src = cols + (cols > j[:, None])
        a[:, :-1] = np.take_along_axis(a, src, 1)
        rank[:, :-1] = np.take_along_axis(rank, src, 1)
        a[row, j] = made
        lens[left] -= 1
        for at in (j - 1, j):
            ok = at >= 0
            r, c = row[ok], at[ok]
            has = a[r, c + 1] >= 0
            rank[r[~has], c[~has]] = NONE
            r, c = r[has], c[has]
            rank[r, c] = t.lookup(a[r, c], a[r, c + 1])[0]
    flat = final[final >= 0]
    return np.split(flat, np.cumsum(lens)[:-1])


def _merge_long(t: Tables, piece: bytes) -> np.ndarray:
    """The same for one long piece, by a heap over a linked list."""
    ids = t.byte_id[np.frombuffer(piece, np.uint8)]
    n = len(ids)
    rank, slot = t.lookup(ids[:-1], ids[1:])
    heap = [(r, i, a, b, s) for i, (r, a, b, s) in enumerate(zip(rank.tolist(), ids[:-1].tolist(), ids[1:].tolist(), slot.tolist(), strict=True)) if r < NONE]
    heapq.heapify(heap)
    ids, nxt, prv = ids.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]
    while heap:
        _, i, a, b, s = heapq.heappop(heap)
        j = nxt[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j], nxt[i] = int(t.made[s]), -1, nxt[j]
        if nxt[i] >= 0:
            prv[nxt[i]] = i
        for x, y in ((prv[i], i), (i, nxt[i])):
            if x >= 0 and y >= 0:
                r, s2 = t.lookup(np.array([ids[x]]), np.array([ids[y]]))
                if r[0] < NONE:
                    heapq.heappush(heap, (int(r[0]), x, ids[x], ids[y], int(s2[0])))
    return np.array([x for x in ids if x >= 0], np.int64)


# -- the lexicon ----------------------------------------------------------------------------------------------


def compile_automaton(words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> bytes:
    """Minimal automaton of the sorted, distinct words, with the ids of each, as one byte string.

    States are registered once all their continuations are known; two states are one if they agree in finality and in their
    arcs. An arc's number counts the words that the state accepts before it, so the numbers along a word add up to its place.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []

    def freeze(final: bool, out: list[tuple[int, int]]) -> int:
        sig = (final, tuple(out))
        if sig not in register:
            register[sig] = len(finals)
            finals.append(final)
            arcs.append(sig[1])
        return register[sig]

    path: list[list] = [[False, [], -1]]  # finality, arcs to frozen states, byte of the open arc
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, out, _ = path.pop()
            path[-1][1].append((path[-1][2], freeze(final, out)))

    for w in words:
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        close(k)
        for b in w[k:]:
            path[-1][2] = b
            path.append([False, [], -1])
        path[-1][0] = True
        last = w
    close(0)
    root = freeze(path[0][0], path[0][1])
    count = np.zeros(len(finals), np.int64)
    keys, to, number = [], [], []
    for s in range(len(finals)):  # arcs lead to states that were frozen before
        c = int(finals[s])
        for b, q in arcs[s]:
            keys.append(s << 8 | b)
            to.append(q)
            number.append(c)
            c += int(count[q])
        count[s] = c
    head = np.array([len(finals), len(keys), len(words), len(flat), root], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    parts = (head, np.array(keys, np.int64), np.array(to, np.int32), np.array(number, np.int32), np.array(finals, np.uint8), ends.astype(np.int64), flat.astype(np.uint32))
    return b"".join(p.tobytes() for p in parts)


class Automaton:
    """A compiled lexicon, mapped into memory from an unnamed file of this worker."""

    def __init__(self, data: bytes):
        self.file = tempfile.TemporaryFile()  # noqa: SIM115  kept open as long as it is mapped
        self.file.write(data)
        self.file.flush()
        m = np.memmap(self.file, np.uint8, "r")
        n, a, w, f, self.root = np.frombuffer(m[:40], np.int64).tolist()
        at = 40
        for name, kind, k in (("keys", np.int64, a), ("to", np.int32, a), ("number", np.int32, a), ("final", np.uint8, n), ("ends", np.int64, w + 1), ("ids", np.uint32, f)):
            size = np.dtype(kind).itemsize * k
            setattr(self, name, np.ndarray((k,), kind, m, offset=at))
            at += size
        self.n = n

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """Place of each piece among the words, or -1; all pieces are walked in step."""
        n = len(pieces)
        if not self.n or not len(self.keys):
            return np.full(n, -1, np.int64)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        start = np.cumsum(lens) - lens
        state, place, alive, k = np.full(n, self.root, np.int64), np.zeros(n, np.int64), np.arange(n), 0
        alive = alive[lens > 0]
        while alive.size:
            key = state[alive] << 8 | raw[start[alive] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            place[alive[~hit]] = -1
            state[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            state[alive] = self.to[at]
            place[alive] += self.number[at]
            k += 1
            alive = alive[lens[alive] > k]
        ok = (state >= 0) & (lens > 0)
        ok[ok] = self.final[state[ok]] == 1
        return np.where(ok, place, -1)


def lexicon(docs: DataFrame, tokenizer: str, most: int = 50_000, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The compiled lexicon of the ``most`` most frequent pieces over all documents.

    A batch of about 6 MB of text contributes the pieces that occur ``least`` times in it or oftener; the sums pick the words.
    ``most`` bounds what reaches the driver and what is broadcast (under 8 MB).
    """

    def count(batches):
        for b in V.slices_by_bytes(batches, "text"):
            buf, offs = V.text_buffer(b.column("text"))
            _, codes, distinct = encoding.pieces_of(buf, offs, encoding.special_string(tokenizer))
            n = np.bincount(codes, minlength=len(distinct)) if len(codes) else np.zeros(0, np.int64)
            keep = [i for i in np.flatnonzero(n >= least).tolist() if len(distinct[i]) <= 64]
            yield pa.RecordBatch.from_arrays([pa.array([distinct[i] for i in keep], pa.binary()), pa.array(n[keep].astype(np.int64))], ["piece", "n"])

    counts = id_and_text(docs, id_col, text_col).select("text").mapInArrow(count, "piece binary, n long")
    top = counts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)
    words = sorted(bytes(r[0]) for r in top.select("piece").collect())
    t = tables(tokenizer)
    words = [w for w in words if w not in t.special]
    return compile_automaton(words, *merge_in_step(t, words))


# -- encoding and decoding of batches -------------------------------------------------------------------------


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, tokenizer: str, data: bytes):
        self.path, self.t, self.lexicon = tokenizer, tables(tokenizer), Automaton(data)
        self.memo = encoding.Memo(self.encode_pieces, 200_000)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        place = self.lexicon.find(pieces)
        known = place >= 0
        sizes = np.zeros(len(pieces), np.int64)
        lo = self.lexicon.ends[place[known]] if known.any() else np.zeros(0, np.int64)
        sizes[known] = (self.lexicon.ends[place[known] + 1] - lo) if known.any() else 0
        rest = np.flatnonzero(~known).tolist()
        special = [i for i in rest if pieces[i] in self.t.special]
        rest = [i for i in rest if pieces[i] not in self.t.special]
        flat_rest, sizes_rest = merge_in_step(self.t, [pieces[i] for i in rest])
        sizes[rest] = sizes_rest
        sizes[special] = 1
        out, start = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        if known.any():
            out[V.ranges(start[known], sizes[known])] = self.lexicon.ids[V.ranges(lo, sizes[known])]
        if rest:
            out[V.ranges(start[rest], sizes_rest)] = flat_rest
        for i in special:
            out[start[i]] = self.t.special[pieces[i]]
        return out, sizes

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return encoding.encode_texts(buf, offs, self.path, self.memo)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and the offsets of the texts."""
        size = self.t.size[ids]
        raw = self.t.bytes[V.ranges(self.t.start[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return raw, ends[np.concatenate([[0], np.cumsum(counts)])]


_codecs: dict[tuple, Codec] = {}


def _codec(tokenizer: str, data) -> Codec:
    key = (tokenizer, hashlib.sha1(data.value).digest())
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokenizer, data.value)
    return _codecs[key]


def bpe_encode(docs: DataFrame, tokenizer: str, data: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each row. data: a compiled lexicon, else that of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(data or lexicon(docs, tokenizer, id_col=id_col, text_col=text_col))

    def run(batches):
        for b in V.slices_by_bytes(batches, "text", 4 << 20):
            ids, counts = _codec(tokenizer, shared).encode(*V.text_buffer(b.column("text")))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids; bytes that are not UTF-8 become U+FFFD. Null ids give an empty text."""
    empty = compile_automaton([], np.zeros(0, np.uint32), np.zeros(0, np.int64))
    shared = encoded.sparkSession.sparkContext.broadcast(empty)

    def run(batches):
        for b in batches:
            lists = b.column("ids").fill_null([]) if b.column("ids").null_count else b.column("ids")
            raw, offs = _codec(tokenizer, shared).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(x) for x in lists], np.int64))
            raw = raw.tobytes()
            texts = [raw[p:q].decode("utf-8", "replace") for p, q in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, tokenizer: str, data: bytes | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and the ids if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(data or lexicon(docs, tokenizer, id_col=id_col, text_col=text_col))
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        for b in V.slices_by_bytes(batches, "text", 4 << 20):
            codec = _codec(tokenizer, shared)
            ids, counts = codec.encode(*V.text_buffer(b.column("text")))
            raw, offs = codec.decode(ids, counts)
            ends = np.concatenate([[0], np.cumsum(counts)])
            le, raw = memoryview(ids.astype("<u4").tobytes()), memoryview(raw)
            cols = [b.column("doc_id"), pa.array(counts), pa.array([sha(le[4 * p : 4 * q]) for p, q in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()), pa.array([sha(raw[p:q]) for p, q in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

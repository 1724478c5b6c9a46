"""Vectorised work on whole Arrow text columns: byte buffers, spans, hashes and pre-tokenization.

Every function sees the concatenated UTF-8 bytes of a batch plus document offsets, so the cost is a few
array passes over the bytes, however long or short single texts are.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Zero bytes behind each buffer, so that eight-byte loads never run over its end.
PAD = 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z and nothing else.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_K0, _K1, _K2 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S31, _S29 = np.uint64(31), np.uint64(29)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Padded bytes of all texts (null: empty) and the n + 1 offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(PAD, np.uint8), np.zeros(1, np.int64)
    _, raw, data = column.buffers()
    offs = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    lo, hi = int(offs[0]), int(offs[-1])
    buf = np.zeros(hi - lo + PAD, np.uint8)
    if hi > lo:
        buf[: hi - lo] = np.frombuffer(data, np.uint8)[lo:hi]
    return buf, offs - lo


@functools.cache
def _allocator():
    import ctypes

    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") else None


def give_back_memory() -> None:
    """Return what this worker no longer uses to the system: idle workers are kept for the next task."""
    pa.default_memory_pool().release_unused()
    if _allocator():
        _allocator().malloc_trim(0)


def slices_by_bytes(batches, column: str, most: int = 4 << 20):
    """Arrow record batches cut or passed on so that a piece holds about ``most`` bytes of text; a longer text stays whole."""
    for batch in batches:
        texts = batch.column(column)
        if len(texts) == 0:
            continue
        _, offs = _offsets(texts)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            to = min(to, len(texts))
            yield batch.slice(at, to - at)
            at = to
    give_back_memory()


def _offsets(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()[1]
    offs = np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return column, offs.astype(np.int64)


def member_spans(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of each maximal run of True; runs end at document borders."""
    n = int(offs[-1])
    member = member[:n]
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    brk = np.zeros(n + 1, bool)
    brk[offs] = True
    first = member.copy()
    first[1:] &= ~member[:-1] | brk[1:n]
    last = member.copy()
    last[:-1] &= ~member[1:] | brk[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end - start, owner(start, offs)


def owner(positions: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Document index of each of the sorted byte positions."""
    cuts = np.searchsorted(positions, offs)
    return np.repeat(np.arange(len(offs) - 1), np.diff(cuts))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of ``[^\\x20\\x09-\\x0D]+``."""
    return member_spans((buf != 32) & (buf - np.uint8(9) > 4), offs)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> _S31)) * _K1
    x = (x ^ (x >> _S29)) * _K2
    return x ^ (x >> _S31)


def loads(buf: np.ndarray) -> np.ndarray:
    """View whose element i is the little-endian integer of bytes i to i + 7."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def hash_spans(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes give equal hashes in every batch and process."""
    v = loads(buf)
    h = mix(length.astype(np.uint64) * _K0 ^ (v[start] & _MASKS[np.minimum(length, 8)]))
    idx, k = np.flatnonzero(length > 8), 8
    while idx.size:
        h[idx] = mix(h[idx] * _K0 ^ (v[start[idx] + k] & _MASKS[np.minimum(length[idx] - k, 8)]))
        k += 8
        idx = idx[length[idx] > k]
    return h


def factorize(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each key, the distinct keys, and the first position of each."""
    import pandas as pd

    codes, distinct = pd.factorize(keys)
    first = np.full(len(distinct), -1, np.int64)
    first[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return codes, distinct, first


def factorize_spans(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each span and the first span of each code; codes are equal just if all bytes are."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, _, first = factorize(hash_spans(buf, start, length))
    v, rep = loads(buf), first[codes]
    odd = length != length[rep]
    idx, k = np.flatnonzero(~odd), 0
    while idx.size:
        m = _MASKS[np.minimum(length[idx] - k, 8)]
        wrong = (v[start[idx] + k] & m) != (v[start[rep[idx]] + k] & m)
        odd[idx[wrong]] = True
        k += 8
        idx = idx[length[idx] > k]
    if odd.any():  # different bytes with one hash: give them codes of their own
        seen, first = {}, first.tolist()
        for i in np.flatnonzero(odd).tolist():
            word = buf[start[i] : start[i] + length[i]].tobytes()
            if word not in seen:
                seen[word] = len(first)
                first.append(i)
            codes[i] = seen[word]
        first = np.array(first)
    return codes, first


def span_bytes(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[bytes]:
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), (start + length).tolist(), strict=True)]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of start[i], start[i] + 1, ... (length[i] of them)."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


# -- code points ------------------------------------------------------------------------------------------


def code_points(buf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the lead bytes of all non-ASCII characters among the first n bytes, and their code points."""
    b = buf[:n]
    lead = np.flatnonzero(b >= 0xC0)
    x = b[lead].astype(np.int32)
    c = [buf[lead + k].astype(np.int32) & 0x3F for k in (1, 2, 3)]
    two = (x & 0x1F) << 6 | c[0]
    three = (x & 0x0F) << 12 | c[0] << 6 | c[1]
    four = (x & 0x07) << 18 | c[0] << 12 | c[1] << 6 | c[2]
    return lead, np.where(x < 0xE0, two, np.where(x < 0xF0, three, four))


def byte_classes(buf: np.ndarray, n: int, ascii_table: np.ndarray, wide_table) -> np.ndarray:
    """Class of each byte: that of the character it belongs to. wide_table: maps distinct code points to classes."""
    cls = ascii_table[buf[:n]]
    lead, cps = code_points(buf, n)
    if lead.size:
        distinct, inverse = np.unique(cps, return_inverse=True)
        k = wide_table(distinct)[inverse]
        cls[lead] = k
        first = buf[lead]
        for more, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            has = first >= least
            at = lead[has] + more
            cls[at[at < n]] = k[has][at < n]
    return cls


# -- byte-level pre-tokenization ---------------------------------------------------------------------------

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def _splitter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


@functools.cache
def _class_of(char: str) -> int:
    """What the library's own pattern takes a character for, found by probing it."""
    pieces = lambda s: len(_splitter().pre_tokenize_str(s))
    if pieces("a" + char) == 1:
        return LETTER
    if pieces("1" + char) == 1:
        return NUMBER
    return OTHER if pieces("!" + char) == 1 else SPACE


@functools.cache
def _ascii_classes() -> np.ndarray:
    return np.array([_class_of(chr(i)) if i < 128 else OTHER for i in range(256)], np.uint8)


def _wide_classes(cps: np.ndarray) -> np.ndarray:
    return np.array([_class_of(chr(c)) for c in cps.tolist()], np.uint8)


def pretokens(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Start of each piece of the byte-level pattern over all texts, in order; a piece ends where the next starts.

    The pattern: contractions ('s 't 're 've 'm 'll 'd), runs of letters, numbers or others with one blank before,
    and white space, whose last character goes to the next piece if it is a blank.
    """
    n = int(offs[-1])
    if n == 0:
        return np.zeros(0, np.int64)
    cls = byte_classes(buf, n, _ascii_classes(), _wide_classes)
    brk = np.zeros(n + 1, bool)
    brk[offs] = True
    new = brk[:n].copy()
    new[1:] |= cls[1:] != cls[:-1]
    rs = np.flatnonzero(new)
    rc = cls[rs]
    re_ = np.append(rs[1:], n)
    cut = np.zeros(n + 1, bool)
    cut[rs] = True
    ends_doc = brk[re_]
    # white space before more text: its last character stands alone, or starts the next piece if a blank
    ws = np.flatnonzero((rc == SPACE) & ~ends_doc)
    last = re_[ws] - 1
    ascii_last = buf[last] < 128
    wide = np.flatnonzero(~ascii_last)
    for _ in range(3):
        back = wide[(buf[last[wide]] & 0xC0) == 0x80]
        last[back] -= 1
    cut[last] = True
    blank = buf[re_[ws] - 1] == 32
    cut[re_[ws][blank]] = False  # the next run goes with the blank
    # contractions: a lone quote that starts a piece, then letters
    q = np.flatnonzero((rc[:-1] == OTHER) & (rc[1:] == LETTER) & ~ends_doc[:-1] & (buf[rs[:-1]] == 39) & (re_[:-1] - rs[:-1] == 1)) if len(rs) > 1 else np.zeros(0, np.int64)
    q = q[cut[rs[q]]]
    if q.size:
        nxt, end = re_[q], re_[q + 1]
        a, b = buf[nxt], buf[nxt + 1]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))) & (end - nxt >= 2)
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = size > 0
        cut[nxt[hit]] = False
        stop = nxt[hit] + size[hit]
        inside = stop < end[hit]
        cut[stop[inside]] = True
    return np.flatnonzero(cut[:n])


def split_special(buf: np.ndarray, offs: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Borders at both ends of each left-to-right, non-overlapping occurrence of ``special``: new offsets (a superset of
    the old, without empty pieces but for empty texts) and whether the piece is the special string."""
    n, at = int(offs[-1]), []
    if n and special:
        raw, k = buf[:n].tobytes(), -1
        k = raw.find(special)
        while k >= 0:
            d = int(np.searchsorted(offs, k, side="right")) - 1
            if k + len(special) <= offs[d + 1]:
                at.append(k)
                k = raw.find(special, k + len(special))
            else:
                k = raw.find(special, k + 1)
    if not at:
        return offs, np.zeros(len(offs) - 1, bool)
    at = np.array(at)
    cuts = np.unique(np.concatenate([offs, at, at + len(special)]))
    return cuts, np.isin(cuts[:-1], at)

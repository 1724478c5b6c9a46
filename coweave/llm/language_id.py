"""Language identification by rank-order profiles: a document's most frequent n-grams against those of each language.

N-grams of one to five characters are counted over lower-cased words of letters and marks, whose borders count as a blank;
anything else separates words. A profile lists a language's most frequent n-grams by rank. The out-of-place distance sums, over
the document's own ranking, how far each n-gram's rank is from its rank in the profile; n-grams the profile lacks cost the
profile's length. The nearest language wins, ties by name; score is one less the distance over the largest possible distance.
N-grams, of any script, are known by hashes of 20 bits; equal counts are ranked by them.

Profiles are learned from all given documents: counts by language and n-gram are summed, whatever their number.

Defined cases: null texts and texts without a letter (marks alone are none) are ``und`` with score 0; so is every text if nothing
could be learned; rows with null language teach nothing; repeated rows each give a row; empty tables give no rows; other columns
are ignored or kept; whole texts are used, however long.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectext as V
from .common import id_and_text, ship

LENGTH, LONGEST = 300, 5
BITS = 20
CODES = 1 << BITS
#: Set in the symbols of marks.
_MARK = 1 << 21
_K = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _symbol(cp: int) -> int:
    """0: no letter and no mark; else the lower-cased code point."""
    kind = unicodedata.category(chr(cp))[0]
    return ord(chr(cp).lower()[0]) if kind == "L" else cp | _MARK if kind == "M" else 0


@functools.cache
def _ascii() -> np.ndarray:
    return np.array([_symbol(i) if i < 128 else 0 for i in range(256)], np.int32)


def symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with one 0 between words and around each text, and the offsets of the texts in them."""
    n = int(offs[-1])
    sym = _ascii()[buf[:n]]
    lead, cps = V.code_points(buf, n)
    keep = (buf[:n] & 0xC0) != 0x80
    if lead.size:
        distinct, inverse = np.unique(cps, return_inverse=True)
        sym[lead] = np.array([_symbol(c) for c in distinct.tolist()], np.int32)[inverse]
    brk = np.zeros(n + 1, bool)
    brk[offs] = True
    chars = np.flatnonzero(keep)
    s, first = sym[chars], brk[chars]
    drop = np.zeros(len(s), bool)
    drop[1:] = (s[1:] == 0) & (s[:-1] == 0) & ~first[1:]
    drop |= (s == 0) & first
    s, chars = s[~drop], chars[~drop]
    cut = np.searchsorted(chars, offs[:-1])
    counts = np.diff(np.append(cut, len(s)))
    tail = np.zeros(len(counts), np.int64)  # a text that ends in a letter gets a closing 0 as well
    ends = np.cumsum(counts)
    has = counts > 0
    tail[has] = s[ends[has] - 1] != 0
    total = np.cumsum(counts + 1 + tail)
    out = np.zeros(int(total[-1]) if len(total) else 0, np.int32)
    starts = total - (counts + 1 + tail)
    out[V.ranges(starts + 1, counts)] = s
    return out, np.concatenate([[0], total])


def gram_codes(s: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of one text's symbols: of all runs with a letter or mark but at most one border at either end."""
    x, inner = s.astype(np.uint64) + np.uint64(1), s > 0
    out, h, whole = [], np.zeros(len(s), np.uint64), np.ones(len(s), bool)
    for n in range(1, min(LONGEST, len(s)) + 1):
        h = (h[: len(s) - n + 1] + x[n - 1 :]) * _K
        if n == 1:
            take = inner
        elif n == 2:
            take = inner[1:] | inner[:-1]
        else:
            whole = whole[: len(s) - n + 1] & inner[n - 2 : len(s) - 1]
            take = whole
        if n == 2:
            whole = np.ones(len(s) - 1, bool)
        out.append(((h[take] ^ h[take] >> np.uint64(29)) * _K >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def learn_profiles(docs: DataFrame, length: int = LENGTH, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """The ``length`` most frequent n-gram codes of each language, by rank; bounded by the number of languages."""

    def count(batches):
        for b in V.slices_by_bytes(batches, "text", 3 << 20):
            langs = b.column("lang").to_pylist()
            s, offs = symbols(*V.text_buffer(b.column("text")))
            order = {x: i for i, x in enumerate(sorted(set(langs)))}
            own = np.array([order[x] for x in langs])
            for lang, k in order.items():
                n = np.bincount(gram_codes(s[V.ranges(offs[:-1][own == k], np.diff(offs)[own == k])]), minlength=CODES)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "code", "n"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= length).select("lang", "code", "rank").collect()
    found: dict[str, list[int]] = {}
    for lang, code, _ in sorted(top, key=lambda r: (r[0], r[2])):
        found.setdefault(lang, []).append(code)
    return found


def rank_tables(profiles: dict[str, list[int]], length: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, the column of each code among those of all profiles (the last: in none), and the ranks by name and column."""
    names = sorted(profiles)
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(profiles[x], np.int64) for x in names)]))
    column = np.full(CODES, len(used), np.int32)
    column[used] = np.arange(len(used))
    ranks = np.full((len(names), len(used) + 1), length, np.int32)
    for k, name in enumerate(names):
        ranks[k, column[profiles[name]]] = np.arange(len(profiles[name]))
    return names, column, ranks


def ranking(codes: np.ndarray, length: int) -> np.ndarray:
    """The most frequent codes, by count and then by code."""
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    n = np.diff(np.append(at, len(codes)))
    key = (n.astype(np.int64) << BITS) + (CODES - 1 - codes[at])
    if len(key) > length:
        key = key[np.argpartition(-key, length - 1)[:length]]
    key = -np.sort(-key)
    return CODES - 1 - (key & (CODES - 1))


def predict(s: np.ndarray, names: list[str], column: np.ndarray, ranks: np.ndarray, length: int) -> tuple[str, float]:
    if not names or not ((s > 0) & (s < _MARK)).any():
        return "und", 0.0
    top = ranking(gram_codes(s), length)
    theirs = ranks[:, column[top]]
    far = np.minimum(np.abs(theirs - np.arange(len(top))), length)
    far[theirs == length] = length
    total = far.sum(axis=1)
    k = int(total.argmin())
    return names[k], 1.0 - float(total[k]) / (length * len(top))


def _predictions(text: pa.Array, tables, length: int) -> tuple[list[str], list[float]]:
    s, offs = symbols(*V.text_buffer(text))
    got = [predict(s[p:q], *tables, length) for p, q in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    return [x for x, _ in got], [x for _, x in got]


def identify(docs: DataFrame, profiles: dict[str, list[int]], length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # at most length codes for each language

    def run(batches):
        tables = rank_tables(shared.value, length)
        for b in V.slices_by_bytes(batches, "text", 4 << 20):
            lang, score = _predictions(b.column("text"), tables, length)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: dict[str, list[int]], least: float = 0.0, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text gets a language with a score above ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        tables = rank_tables(shared.value, length)
        for b in batches:
            plain = pa.RecordBatch.from_arrays([b.column(at)], ["text"])
            keep: list[bool] = []
            for part in V.slices_by_bytes([plain], "text", 4 << 20):
                lang, score = _predictions(part.column("text"), tables, length)
                keep += [x != "und" and y > least for x, y in zip(lang, score, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Benchmark decontamination: rare n-gram seeds join passages to test items, and Smith-Waterman alignment scores them.

Words are lower-cased runs of letters, marks and digits. A gram is three words of four in a row: the first two and the third or
the fourth. So a gram stays whole where every third word is changed, left out or has one put before it. A first pass counts in
how many documents each gram of the test items occurs. Seeds are the grams that occur at all in up to RARE documents, and of the
others those that occur at most twice as often as the rarest of some STEP grams in a row around them. (Grams that occur nowhere
match nothing, so they are never the rarest.) A second pass finds the seeds in every document; seeds of one item near one
diagonal make a passage, which is aligned with the item: equal words score 2, others and gaps cost 1. The score is the best local
alignment over the best possible one; a document with a passage of at least ``least`` is contaminated by the item.

Test items are a stated query set. Each distinct text is one query. They are taken in blocks whose total size is checked before
they are collected, so any number of them works; what reaches the driver in a block is bounded by it, or is one longer item.

Defined cases: null texts have no words; items of fewer than three words have no seed and match nothing; whole texts are used,
however long; of equally good passages of a document and an item the last counts; repeated document rows each give their rows;
items with equal text match alike, each under its id; empty tables give no rows; other columns are ignored or kept.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import id_and_text, materialize, ship

GRAM, STEP, LEAST, RARE = 3, 4, 0.5, 1000
BLOCK_BYTES = 8 << 20
_C = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@functools.cache
def _in_word(cp: int) -> bool:
    return unicodedata.category(chr(cp))[0] in "LMN"


@functools.cache
def _ascii() -> np.ndarray:
    return np.array([i < 128 and chr(i).isalnum() for i in range(256)])


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word of all texts."""
    buf, offs = V.text_buffer(pc.utf8_lower(texts))
    n = int(offs[-1])
    member = V.byte_classes(buf, n, _ascii(), lambda cps: np.array([_in_word(c) for c in cps.tolist()]))
    start, length, doc = V.member_spans(member, offs)
    return V.hash_spans(buf, start, length), doc


def grams(h: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Hashes of both grams that start at each word; 0 where the document ends within one."""
    out = []
    for last in (GRAM - 1, GRAM):
        g = np.zeros(len(h), np.uint64)
        if len(h) > last:
            g[:-last] = V.mix(h[:-last] * _C[0] + h[1 : len(h) - last + 1] * _C[1] + h[last:] * _C[2]) | np.uint64(1)
            g[:-last][doc[last:] != doc[:-last]] = 0
        out.append(g)
    return out


class Lookup:
    """Place of each key in a sorted array, or -1; most misses end at a bitmap."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.mask = np.uint64((1 << 22) - 1)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys & self.mask).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x of the keys found, and their places."""
        at = np.flatnonzero(self.bits[(x & self.mask).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        ok = self.keys[place] == x[at]
        return at[ok], place[ok]


class Items:
    """The test items of a block: words, grams, and after ``pick`` their seeds."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        h, doc = normal_words(pa.array(texts, pa.string()))
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.words = [h[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        self.size = np.diff(cut)
        self.grams = [(g[g > 0], doc[g > 0], (np.arange(len(g)) - cut[doc])[g > 0]) for g in grams(h, doc)]  # gram, item, word
        self.all = np.unique(np.concatenate([g for g, _, _ in self.grams]))

    def pick(self, gram: np.ndarray, n: np.ndarray) -> None:
        """Choose the seeds from the document counts of the grams that occur."""
        order = np.argsort(gram)
        gram, n = np.append(gram[order], np.uint64(0)), np.append(n[order], 0)
        chosen = []
        for g, item, at in self.grams:
            place = np.searchsorted(gram[:-1], g)
            f = np.where(gram[place] == g, n[place], 0)
            keep = (f > 0) & ((f <= RARE) | (f <= 2 * _rarest_around(np.where(f > 0, f, np.int64(1) << 60), item)))
            chosen.append((g[keep], item[keep], at[keep]))
        g, item, at = (np.concatenate(x) for x in zip(*chosen, strict=True))
        order = np.lexsort((at, item, g))
        g, self.seed_item, self.seed_at = g[order], item[order], at[order]
        self.lookup = Lookup(g)
        self.first = np.searchsorted(g, self.lookup.keys)
        self.many = np.diff(np.append(self.first, len(g)))
        del self.grams, self.all


def _rarest_around(f: np.ndarray, item: np.ndarray) -> np.ndarray:
    """For each gram of sorted items the greatest of the least counts of the windows of STEP grams that hold it."""
    n = len(f)
    start, end = np.searchsorted(item, item), np.searchsorted(item, item, side="right")
    here, least = np.arange(n), f.copy()
    for k in range(1, STEP):
        inside = here + k < end
        least[inside] = np.minimum(least[inside], f[here[inside] + k])
    least[(here + STEP > end) & (here != start)] = 0
    out = least.copy()
    for k in range(1, STEP):
        inside = here - k >= start
        out[inside] = np.maximum(out[inside], least[here[inside] - k])
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the end of it in text (match 2, mismatch -1, gap -1)."""
    step = np.arange(len(text) + 1, dtype=np.int32)
    row, best, end = np.zeros(len(text) + 1, np.int32), 0, 0
    for w in item:
        t = np.maximum(row - 1, 0)
        t[1:] = np.maximum(t[1:], row[:-1] + np.where(text == w, 2, -1))
        t = np.maximum.accumulate(t + step) - step  # gaps along the row
        row = t.astype(np.int32)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def matches(texts: pa.Array, items: Items, least: float) -> list[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, word after the last) of each contaminated pair of a batch."""
    h, doc = normal_words(texts)
    hits = [items.lookup(g) for g in grams(h, doc)]
    at, place = (np.concatenate(x) for x in zip(*hits, strict=True))
    if not len(at):
        return []
    many = items.many[place]
    seed = V.ranges(items.first[place], many)
    at = np.repeat(at, many)
    item, begin = items.seed_item[seed], at - items.seed_at[seed]
    order = np.lexsort((begin, item, doc[at]))
    item, begin, owner = item[order], begin[order], doc[at][order]
    size = items.size[item]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1]) | (begin[1:] - begin[:-1] > size[1:] // 2 + 4)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(item)) - 1
    enough = (hi > lo) | (size[lo] < 16)  # what scores a half of a longer item holds more than one of its grams
    lo, hi = lo[enough], hi[enough]
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    doc_lo, doc_hi = np.searchsorted(doc, owner[lo]), np.searchsorted(doc, owner[lo], side="right")
    pad = size[lo] // 4 + 4
    a = np.maximum(begin[lo] - pad, doc_lo)
    b = np.minimum(begin[hi] + size[lo] + pad, doc_hi)
    for d, i, p, q, base in zip(owner[lo].tolist(), item[lo].tolist(), a.tolist(), b.tolist(), doc_lo.tolist(), strict=True):
        words, part = items.words[i], h[p:q]
        need = least * 2 * len(words)
        if 2 * int(np.isin(words, part).sum()) < need:
            continue
        score, end = align(words, part)
        if score >= need:
            _, back = align(words[::-1], part[:end][::-1])
            got = (score / (2 * len(words)), p + end - back - base, p + end - base)
            if got > found.get((d, i), (0.0, 0, 0)):
                found[d, i] = got
    return [(*k, *v) for k, v in found.items()]


def _queries(benchmark: DataFrame, text_col: str) -> DataFrame:
    """The distinct texts under a key, the hash of each."""
    rows = benchmark.select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    return rows.select(F.xxhash64("text").alias("item"), "text")


def _blocks(benchmark: DataFrame, text_col: str, block_bytes: int) -> Iterator[tuple[list, list, bool]]:
    """Items and their texts, and whether more may follow; one block is in the driver at a time."""
    rows = _queries(benchmark, text_col)
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = 1 + (int(total) + 16 * int(n)) // block_bytes
    for k in range(parts):
        block = sorted((r["item"], r["text"]) for r in rows.filter(F.pmod("item", F.lit(parts)) == k).collect())  # about block_bytes
        if block:
            yield [i for i, _ in block], [t for _, t in block], k < parts - 1


def _prepared(docs: DataFrame, benchmark: DataFrame, block_bytes: int, doc_col: str, text_col: str):
    """For each block of the benchmark a broadcast of its items, with seeds, and whether more may follow; what a block gave must be
    written before the next one, as its broadcast goes then."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(doc_col).cast("string").alias("text"))
    shared = None
    for ids, contents, more in _blocks(benchmark, text_col, block_bytes):
        items = Items(ids, contents)
        keys = spark.sparkContext.broadcast(items.all)

        def count(batches, keys=keys):
            look = Lookup(keys.value)
            for b in V.slices_by_bytes(batches, "text"):
                h, doc = normal_words(b.column("text"))
                hits = [look(g) for g in grams(h, doc)]
                at, place = (np.concatenate(x) for x in zip(*hits, strict=True))
                pair = np.unique(place * (len(b) + 1) + doc[at]) // (len(b) + 1)
                g, n = np.unique(pair, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(look.keys[g].view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

        seen = texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # grams of this block at most
        items.pick(seen["gram"].to_numpy().view(np.uint64), seen["n"].to_numpy())
        keys.destroy()
        if shared is not None:
            shared.destroy()
        shared = spark.sparkContext.broadcast(items)
        yield shared, more


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: the best passage of each contaminated pair of document row and item."""
    schema = "doc_id long, item long, score double, first_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared, more in _prepared(docs, benchmark, block_bytes, text_col, item_text_col):

        def run(batches, shared=shared):
            for b in V.slices_by_bytes(batches, "text"):
                got = matches(b.column("text"), shared.value, least)
                ids = b.column("doc_id").to_pylist()
                cols = [[ids[m[0]] for m in got], [shared.value.ids[m[1]] for m in got], *([m[k] for m in got] for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item", "score", "first_word", "end_word"])

        found = id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
        out = out.unionByName(materialize(found, "passages") if more else found)
    named = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.xxhash64(F.col(item_text_col).cast("string")).alias("item")).distinct()
    return out.join(named, "item").select("doc_id", "item_id", "score", "first_word", "end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that no item contaminates."""
    k = docs.columns.index(text_col)
    for shared, more in _prepared(docs, benchmark, block_bytes, text_col, item_text_col):

        def run(batches, shared=shared):
            for b in batches:
                plain = pa.RecordBatch.from_arrays([b.column(k)], ["text"])
                keep = []
                for part in V.slices_by_bytes([plain], "text"):
                    ok = np.ones(len(part), bool)
                    ok[[m[0] for m in matches(part.column("text"), shared.value, least)]] = False
                    keep.append(ok)
                yield b.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

        docs = docs.mapInArrow(run, docs.schema)
        if more:
            docs = materialize(docs, "uncontaminated")
    return docs

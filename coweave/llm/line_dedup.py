"""Line deduplication by an exact set-similarity join with prefix, positional and length filters.

A line is the set of its words; lines of fewer than ``least_words`` words are never touched (1: every line with a word takes
part). A line goes if an earlier line, in order of document id and line number, has a Jaccard similarity of at least
``similarity`` with it, whether or not that line itself stays: so the result does not depend on the order in which pairs are found.

1. The texts are read once: every line's place and key, the token hashes of its set, and in how many lines each hash bucket occurs.
   Tokens are ordered by rarity, by the counts of their buckets over all lines, then by hash. Any fixed order gives the same
   result; this one makes prefixes rare. The table of buckets has a fixed size and is broadcast.
2. Lines with equal sets are one key; only keys are joined. A key is 64 bits of the set's hash and 64 bits of its parities.
3. Each key posts the tokens of its prefix with their positions; tokens that no other line has are left out. Equal tokens meet; the length filter, the positional filter and a parity filter (the bits in which the sets' parities differ are at
   most the tokens in which the sets do) drop pairs that cannot reach the similarity. Postings of tokens whose bucket has up to
   LIMIT lines travel packed in groups of bounded size and meet in sorted runs. For the other tokens, each key is first tried
   against the earliest key of each of its tokens, which settles groups of many similar lines in one linear step; only keys
   without a match go on to the full join. Those joins are equi-joins on the token, which Spark splits where a token is hot.
4. Pairs meet 256 bits of both sets' parities, by which most that are not similar go, and both places, by which the earlier is
   known. The others are verified on their whole sets, which a bit set of fixed size picks out: one pair of each later key first,
   and all others only of the keys that this leaves open.

A document is an id with a text. Defined cases: null texts have no lines; rows that repeat an id with the same text are one
document; rows with one id and different texts are different documents, and lines at one place in them are ordered by their sets'
hashes, lines of equal sets by the texts' hashes; a null id comes first; long texts are taken whole; empty tables give no rows;
other columns are ignored or kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .bits import bit_filter, in_filter
from .common import discard, fresh, id_and_text, materialize, shuffle_partitions, whole_runs
from .packed import binary_column, flat_binary, pack_columns, unpack_columns

SIMILARITY, LEAST_WORDS = 0.8, 1
BUCKETS, SLAB = 1 << 22, 1 << 12
#: Tokens in up to so many lines are joined in sorted runs, others by equi-joins that Spark can split.
LIMIT = 1024
#: Postings in a group that meets at once, about 10 MB, and postings that are packed at once.
GROUP, PACKED = 400_000, 400_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POST = np.dtype([("token", "<u4"), ("pos", "<i4")])
_CARD = np.dtype([("token", "<u4"), ("pos", "<i4"), ("size", "<i4"), ("key", "<i8"), ("odd", "<u8")])
_COUNT = np.dtype([("at", "<u2"), ("n", "<u4")])
_NULL_ID = np.iinfo(np.int64).min


def line_sets(texts: pa.Array, least_words: int) -> dict[str, np.ndarray]:
    """The lines of a batch with enough words and their sets: document, line number, set size, key, parities, and the distinct
    token hashes of each (tok, with its line in tok_line, lines in order)."""
    buf, offs = V.text_buffer(texts)
    n = int(offs[-1])
    start, length, doc = V.words(buf, offs)
    brk = np.flatnonzero(buf[:n] == 10)
    h = V.hash_spans(buf, start, length)
    if not len(h):
        e = np.zeros(0, np.int64)
        return {"doc": e, "number": e, "size": e, "key": e, "odd": e.astype(np.uint64), "tok": e.astype(np.uint64), "tok_line": e}
    before = np.concatenate([[0], np.searchsorted(start, brk), [len(start)]])
    line = np.repeat(np.arange(len(brk) + 1), np.diff(before)) + doc  # distinct for each line, as documents are as well
    new = np.ones(len(line), bool)
    new[1:] = line[1:] != line[:-1]
    head = np.flatnonzero(new)
    words = np.diff(np.append(head, len(line)))
    own = np.repeat(np.arange(len(head)), words)
    if least_words > 1:
        keep = words[own] >= least_words
        own, h = own[keep], h[keep]
    h = h[_by_line(own, h, 20)]  # lines stay as they are
    first = np.ones(len(h), bool)
    first[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    own, h = own[first], h[first]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    cut = np.flatnonzero(new)
    at = head[own[cut]]
    number = np.searchsorted(brk, start[at]) - np.searchsorted(brk, offs[:-1])[doc[at]]
    size = np.diff(np.append(cut, len(own)))
    own = np.repeat(np.arange(len(cut)), size)
    key = V.mix(np.add.reduceat(V.mix(h ^ _A), cut) + size.astype(np.uint64) * _B) if len(h) else h
    odd = np.bitwise_xor.reduceat(np.uint64(1) << (h >> np.uint64(50) & np.uint64(63)), cut) if len(h) else h
    return {"doc": doc[at], "number": number, "size": size, "key": key.view(np.int64), "odd": odd, "tok": h, "tok_line": own}


def _by_line(own: np.ndarray, h: np.ndarray, drop: int, rank: np.ndarray | None = None) -> np.ndarray:
    """Order by line (own ascends), rank (under 2^16) and hash, whose lowest bits are left out where the lines' numbers fit beside the
    rest; within a line, ties stay in their order."""
    if len(own) and int(own[-1]) >= 1 << 20:
        return np.lexsort((h, own) if rank is None else (h, rank, own))
    key = own.astype(np.uint64) << np.uint64(44) | h >> np.uint64(drop)
    if rank is not None:
        key |= rank.astype(np.uint64) << np.uint64(28)
    return np.argsort(key, kind="stable")


def signs(tok: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """256 bits of the parities of each line's set, as four words. The first two bits of a token tell its word, so its line's tokens,
    which are sorted, lie word by word."""
    word = line << 2 | (tok >> np.uint64(62)).astype(np.int64)
    many = np.bincount(word, minlength=4 * lines)
    some = np.flatnonzero(many)
    out = np.zeros(4 * lines, np.uint64)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(np.uint64(1) << (tok >> np.uint64(42) & np.uint64(63)), (np.cumsum(many) - many)[some])
    return out.reshape(-1, 4)


def prefix_length(size, similarity: float):
    """Tokens of a set, rarest first, among which every similar set has one of its own prefix."""
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


_LINES = "doc_id long, text_hash long, n_lines int, number int, key long, odd long, size int, set binary, sign binary, slab int, counts binary"


def parsed(docs: DataFrame, least_words: int) -> DataFrame:
    """One row for each line, and one with number -1 for each text without any; a key's first row in a batch carries its set. Each
    task also gives its counts of tokens by bucket, packed slab by slab (rows with a slab). docs: doc_id, text."""
    names = [c.split()[0] for c in _LINES.split(", ")]

    def run(batches):
        total = np.zeros(BUCKETS, np.uint32)  # a task has fewer tokens
        for b in V.slices_by_bytes(batches, "text"):
            s = line_sets(b.column("text"), least_words)
            np.add.at(total, _bucket(s["tok"]), np.uint32(1))
            _, _, lead = V.factorize(s["key"])
            head = np.zeros(len(s["key"]), bool)
            head[lead] = True
            of = np.bincount(s["doc"], minlength=len(b))
            none = np.flatnonzero(of == 0)
            take = pa.array(np.concatenate([s["doc"], none]))
            tail = lambda x, kind, fill=0: pa.array(np.concatenate([x.astype(kind), np.full(len(none), fill, kind)]))
            sets = binary_column(s["tok"][head[s["tok_line"]]], np.concatenate([[0], np.cumsum(np.where(head, s["size"], 0))]))
            sign = binary_column(signs(s["tok"], s["tok_line"], len(head))[head].ravel(), 4 * np.concatenate([[0], np.cumsum(head)]))
            n, blank = len(take), pa.array([b""] * len(none), pa.binary())
            cols = [b.column("doc_id").take(take), b.column("text_hash").take(take), pa.array(of.astype(np.int32)).take(take), tail(s["number"], np.int32, -1), tail(s["key"], np.int64), tail(s["odd"].view(np.int64), np.int64), tail(s["size"], np.int32)]
            yield pa.RecordBatch.from_arrays([*cols, pa.concat_arrays([sets, blank]), pa.concat_arrays([sign, blank]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        at = np.flatnonzero(total)
        rec = np.empty(len(at), _COUNT)
        rec["at"], rec["n"] = at % SLAB, total[at]
        cut = np.searchsorted(at, np.arange(0, BUCKETS + 1, SLAB))
        has = np.flatnonzero(np.diff(cut))
        empty = [pa.nulls(len(has), {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in _LINES.split(", ")[:-2]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(has.astype(np.int32)), binary_column(rec, np.append(cut[has], len(at)))], names)

    return materialize(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, _LINES), "lines")


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """In how many lines each bucket's tokens occur, on a scale of 16 bits: a table of fixed size. Slabs are summed as they arrive."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for slab, raw in zip(b.column("slab").to_pylist(), b.column("counts").to_pylist(), strict=True):
                rec = np.frombuffer(raw, _COUNT)
                sums.setdefault(slab, np.zeros(SLAB, np.int64))[rec["at"]] += rec["n"]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_scaled(s).tobytes() for s in sums.values()], pa.binary())], ["slab", "counts"])

    out = np.zeros(BUCKETS, np.uint16)
    packed = rows.filter("slab IS NOT NULL").select("slab", "counts").repartition("slab")
    for r in packed.mapInArrow(add, "slab int, counts binary").collect():  # 8 MB in all
        out[r["slab"] * SLAB : (r["slab"] + 1) * SLAB] = np.frombuffer(r["counts"], np.uint16)
    return out


def _scaled(n: np.ndarray) -> np.ndarray:
    """Counts as they are up to 32,768, then 1,024 steps for each doubling."""
    return np.where(n < 1 << 15, n, (1 << 15) + 1024 * np.log2(np.maximum(n, 1) / (1 << 15))).astype(np.uint16)


def _bucket(tok: np.ndarray) -> np.ndarray:
    return (tok & np.uint64(BUCKETS - 1)).astype(np.int64)


def _place(*more: str):
    """Order of documents and lines; a null id comes first."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.col("number"), *more)


def _need(sa, sb, similarity: float):
    """The overlap that two sets of these sizes need."""
    return (sa + sb) * (similarity / (1 + similarity)) - 1e-9


def _feasible(similarity: float):
    """Length, positional (for the common token) and parity filter for the columns of two aliases a and b."""
    sa, sb = F.col("a.size"), F.col("b.size")
    need = F.ceil(_need(sa, sb, similarity))
    odd = F.bit_count(F.col("a.odd").bitwiseXOR(F.col("b.odd")))
    return (F.least(sa, sb) >= F.greatest(sa, sb) * similarity - 1e-9) & (F.least(sa - F.col("a.pos"), sb - F.col("b.pos")) >= need) & (odd <= sa + sb - 2 * need)


def meetings(r: dict[str, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one group's postings, once for each key, that share a token and pass the same filters; the lesser key first."""
    token, key, odd, size, pos = (r[c] for c in ("token", "key", "odd", "size", "pos"))
    share = (1 - similarity) / (1 + similarity)  # of both sizes, that may differ
    alive, d, found = np.flatnonzero(token[1:] == token[:-1]), 1, [np.zeros((2, 0), np.int64)]
    while True:
        if d > 1:
            alive = alive[alive + d < len(token)]
            alive = alive[token[alive] == token[alive + d]]
        if not alive.size:
            break
        both = size[alive] + size[alive + d]
        i = alive[np.bitwise_count(odd[alive] ^ odd[alive + d]) <= both * share + 1e-9]
        j = i + d
        sa, sb = size[i], size[j]
        need = np.ceil(_need(sa, sb, similarity)).astype(np.int64)
        ok = (np.minimum(sa, sb) >= np.maximum(sa, sb) * similarity - 1e-9) & (np.minimum(sa - pos[i], sb - pos[j]) >= need)
        found.append(np.stack([i[ok], j[ok]]))
        d += 1
    i, j = np.concatenate(found, axis=1)
    return np.where(key[i] <= key[j], i, j), np.where(key[i] <= key[j], j, i)


def merged(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """A group's postings sorted by token and key, each key once."""
    r = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    both = r["token"].astype(np.uint64) << np.uint64(32) | r["key"].view(np.uint64) >> np.uint64(32)
    order = np.argsort(both)
    both, keys = both[order], r["key"][order]
    if ((both[1:] == both[:-1]) & (keys[1:] != keys[:-1])).any():  # keys that agree in 32 bits may lie mixed
        order = np.lexsort((r["key"], r["token"]))
    r = {c: x[order] for c, x in r.items()}
    new = np.ones(len(order), bool)
    new[1:] = (r["key"][1:] != r["key"][:-1]) | (r["token"][1:] != r["token"][:-1]) | (r["odd"][1:] != r["odd"][:-1])
    return r if new.all() else {c: x[new] for c, x in r.items()}


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(documents: doc_id, text_hash, n_lines of each document; gone: doc_id, text_hash, number of each line that goes; the tables
    that both read, to be discarded after use). n_lines counts lines with enough words; text_hash is xxhash64 of the text."""
    rows = parsed(id_and_text(docs, id_col, text_col), least_words)
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(rows))

    def post(batches):
        """The prefixes of the sets, rarest tokens first, but for tokens that occur once; in two parts, by LIMIT."""
        for b in batches:
            raw, size = flat_binary(b.column("set"))
            tok, size = raw.view(np.uint64), size // 8
            own = np.repeat(np.arange(len(size)), size)
            n = counts.value[_bucket(tok)].astype(np.int64)
            order = _by_line(own, tok, 36, n)
            tok, n = tok[order], n[order]  # lines stay as they are
            start = np.cumsum(size) - size
            joins = size >= (similarity - 1e-9) * (size + 1)  # smaller sets are only similar to equal ones
            at = V.ranges(start, np.where(joins, np.minimum(prefix_length(size, similarity), size), 0))
            at = at[n[at] > 1]
            rec = np.empty(len(at), _POST)
            rec["token"], rec["pos"] = tok[at] >> np.uint64(32), at - start[own[at]]
            posts = [binary_column(rec[some], np.concatenate([[0], np.cumsum(np.bincount(own[at][some], minlength=len(size)))])) for some in (n[at] <= LIMIT, n[at] > LIMIT)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in posted), *posts], [*posted, "cool", "hot"])
        V.give_back_memory()

    def cards(b, column: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
        raw, lengths = flat_binary(b.column(column))
        rec = raw.view(_POST)
        own = np.repeat(np.arange(len(b)), lengths // _POST.itemsize)
        of_line = {"size": b.column("size").to_numpy(), "key": b.column("key").to_numpy(), "odd": b.column("odd").to_numpy().view(np.uint64)}
        return {c: np.ascontiguousarray(rec[c]) if c in ("token", "pos") else of_line[c][own] for c in _CARD.names}, own

    def deal(groups: int):
        def packed(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
            r = {c: np.concatenate([h[c] for h in held]) for c in _CARD.names}
            group = (V.mix(r["token"].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group.astype(np.uint64) << np.uint64(32) | r["token"])
            group, r = group[order], {c: x[order] for c, x in r.items()}
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            cards = [pack_columns(r, p, q) for p, q in zip(cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(group[cut].astype(np.int32)), pa.array(cards, pa.binary())], ["grp", "cards"])

        def run(batches):
            held, size = [], 0
            for b in batches:
                held.append(cards(b, "cool")[0])
                size += len(held[-1]["token"])
                if size >= PACKED:
                    yield packed(held)
                    held, size = [], 0
            if size:
                yield packed(held)
            held.clear()
            V.give_back_memory()

        return run

    def meet(batches):
        for t in whole_runs(batches, ["grp"]):
            group = t["grp"].to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            for p, q in zip(cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True):
                r = merged([unpack_columns(x, _CARD) for x in t["cards"].slice(p, q - p).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(r["key"][k]) for k in meetings(r, similarity)], ["ka", "kb"])

    def spread(batches):
        for b in batches:
            r, own = cards(b, "hot")
            take = pa.array(own)
            cols = [pa.array(r["token"].view(np.int32)), b.column("key").take(take), b.column("odd").take(take), b.column("size").take(take), pa.array(r["pos"])]
            place = [b.column("doc_id").fill_null(_NULL_ID).take(take), b.column("number").take(take)]
            yield pa.RecordBatch.from_arrays([*cols, *place], ["token", "key", "odd", "size", "pos", "doc", "number"])

    posted = ("doc_id", "number", "key", "odd", "size")
    lines = rows.filter("number >= 0").select("doc_id", "text_hash", "number", "key", "odd")
    heads = rows.filter("length(sign) > 0")  # a set goes with its sign, which is shorter to read
    posts = materialize(heads.select(*posted, "set").mapInArrow(post, "doc_id long, number int, key long, odd long, size int, cool binary, hot binary"), "posts")
    total = posts.agg(F.coalesce(F.sum(F.length("cool")), F.lit(0))).first()[0] // _POST.itemsize
    parts = shuffle_partitions(docs.sparkSession)
    groups = max(parts, math.ceil(total / GROUP))
    dealt = posts.filter("length(cool) > 0").select(*posted, "cool").mapInArrow(deal(groups), "grp int, cards binary")
    near = dealt.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(meet, "ka long, kb long").distinct()
    # tokens that may be in many lines: the earliest line of each first, then the full join for lines without a match
    hot = posts.filter("length(hot) > 0").select(*posted, "hot").mapInArrow(spread, "token int, key long, odd long, size int, pos int, doc long, number int")
    hot = materialize(hot.groupBy("token", "key", "odd", "size", "pos").agg(F.min(F.struct("doc", "number", "key")).alias("first")), "hot")
    earliest = hot.groupBy("token").agg(F.min(F.struct("first", "key", "odd", "size", "pos")).alias("e")).select("token", "e.*")
    pair = [F.least("a.key", "b.key").alias("ka"), F.greatest("a.key", "b.key").alias("kb")]
    later = (F.col("a.first") < F.col("b.first")) & _feasible(similarity)
    tried = hot.alias("b").join(earliest.alias("a"), "token").filter(later).select(*pair)
    settled = verified(heads, near.union(tried), similarity)
    rest = hot.join(settled, ["key", "odd"], "left_anti").alias("b").join(hot.alias("a"), "token").filter(later).select(*pair).distinct()
    matched = settled.unionByName(verified(heads, rest, similarity)).withColumn("matched", F.lit(True))
    discard(hot, posts)
    keys = lines.groupBy("key", "odd").agg(F.min(_place("text_hash")).alias("first"), F.count(F.lit(1)).alias("n"))
    state = keys.join(matched, ["key", "odd"], "left").filter("n > 1 OR matched").select(F.col("key").alias("k"), F.col("odd").alias("o"), "first", "matched")
    state = materialize(state, "state")
    flagged = with_keys(lines, state, "k").join(state, (F.col("key") == F.col("k")) & (F.col("odd") == F.col("o")))
    gone = flagged.filter(F.col("matched").isNotNull() | (_place("text_hash") > F.col("first"))).select("doc_id", "text_hash", "number")
    return rows.filter("n_lines IS NOT NULL").select("doc_id", "text_hash", "n_lines").distinct(), gone, [rows, state]


def with_keys(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose key is in the column of ``wanted``, and few others: a bit set of fixed size picks them by their keys alone."""
    bits = rows.sparkSession.sparkContext.broadcast(bit_filter(wanted, column))

    @F.arrow_udf("boolean")
    def wants(key: pa.Array) -> pa.Array:
        return pa.array(in_filter(bits.value, key.to_numpy()))

    return rows.filter(wants("key"))


def verified(heads: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """key, odd of the later of the lines of pairs (ka, kb) whose sets are similar enough. heads: key, odd, doc_id, number, size,
    sign, set; keys may repeat, and lines that share a key only are told apart here."""
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select(F.col("kb").alias("key"), F.col("kb").alias("odd"))
    wanted = materialize(pairs.select(F.col("ka").alias("key")).union(pairs.select("kb")).distinct(), "wanted")
    place = F.min(F.struct(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), "number")).alias("place")
    known = with_keys(heads.select("key", "odd", "doc_id", "number", "size", "sign"), wanted, "key").groupBy("key", "odd").agg(place, F.first("size").alias("size"), F.first("sign").alias("sign"))
    known = materialize(known, "known")

    def near(batches):
        for b in batches:
            (sa, sb), (pa_, pb) = ([b.column(f"{c}{x}") for x in "ab"] for c in ("size", "sign"))
            a, c = (flat_binary(x)[0].view(np.uint64).reshape(-1, 4) for x in (pa_, pb))
            both = sa.to_numpy().astype(np.int64) + sb.to_numpy()
            ok = np.bitwise_count(a ^ c).sum(axis=1) <= both - 2 * np.ceil(_need(sa.to_numpy().astype(np.int64), sb.to_numpy(), similarity))
            yield b.select(["ka", "oa", "kb", "ob"]).filter(pa.array(ok))

    side = lambda x: known.select(F.col("key").alias(f"k{x}"), F.col("odd").alias(f"o{x}"), F.col("place").alias(f"place{x}"), F.col("size").alias(f"size{x}"), F.col("sign").alias(f"sign{x}"))
    first = F.struct("placea", "ka", "oa") < F.struct("placeb", "kb", "ob")
    turned = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("ka", "kb"), ("oa", "ob"), ("kb", "ka"), ("ob", "oa"))]
    met = pairs.join(side("a"), "ka").join(side("b"), "kb").filter("ka <> kb OR oa <> ob").select(*turned, "sizea", "sizeb", "signa", "signb")
    close = materialize(met.mapInArrow(near, "ka long, oa long, kb long, ob long"), "close")
    discard(pairs, wanted, known)
    needed = materialize(close.select(F.col("ka").alias("key")).union(close.select("kb")).distinct(), "wanted")
    sets = materialize(with_keys(heads.select("key", "odd", "set"), needed, "key").dropDuplicates(["key", "odd"]), "sets")

    def compare(batches):
        for b in batches:
            yield b.select(["key", "odd"]).filter(pa.array(similar_pairs(b.column("sa"), b.column("sb"), similarity)))

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "checked")
        a = with_keys(sets, pairs, "ka").select(F.col("key").alias("ka"), F.col("odd").alias("oa"), F.col("set").alias("sa"))
        b = with_keys(sets, pairs, "kb").select(F.col("key").alias("kb"), F.col("odd").alias("ob"), F.col("set").alias("sb"))
        rows = pairs.join(a, ["ka", "oa"]).join(b, ["kb", "ob"]).select(F.col("kb").alias("key"), F.col("ob").alias("odd"), "sa", "sb")
        out = materialize(rows.mapInArrow(compare, "key long, odd long").distinct(), "matched")
        discard(pairs)
        return out

    # one candidate of each key first: it settles most of them, and groups of many similar lines in a linear step
    settled = checked(close.groupBy("kb", "ob").agg(F.min(F.struct("ka", "oa")).alias("a")).select("a.ka", "a.oa", "kb", "ob"))
    others = checked(close.join(settled.select(F.col("key").alias("kb"), F.col("odd").alias("ob")), ["kb", "ob"], "left_anti"))
    discard(close, needed, sets)
    return settled.unionByName(others)


def similar_pairs(a: pa.Array, b: pa.Array, similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of each row's two sets (packed 64-bit tokens) is high enough; all rows at once."""
    (ta, na), (tb, nb) = (((flat := flat_binary(c))[0].view(np.uint64), flat[1] // 8) for c in (a, b))
    row = np.arange(len(a))
    own, tok = np.concatenate([np.repeat(row, na), np.repeat(row, nb)]), np.concatenate([ta, tb])
    order = np.lexsort((tok, own))
    own, tok = own[order], tok[order]
    both = np.bincount(own[1:][(own[1:] == own[:-1]) & (tok[1:] == tok[:-1])], minlength=len(a))
    return both >= similarity * (na + nb - both) - 1e-9


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (lines with enough words), n_removed, removed (sorted line numbers from 0) of each document."""
    documents, gone, used = duplicate_lines(docs, similarity, least_words, id_col, text_col)
    removed = gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("number")).alias("removed"))
    out = documents.alias("d").join(removed.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_hash") == F.col("r.text_hash")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    out = materialize(out.select("d.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed")), "removed")
    discard(*used)
    return out


def drop_lines(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, without the lines that go; rows of which no word is left go as well. Rows are told apart
    by id and text, so another text with the same id keeps its lines."""
    key, hashed, lost, new = fresh(docs, "line_doc", "line_text", "lines_gone", "text_left")
    _, gone, used = duplicate_lines(docs, similarity, least_words, id_col, text_col)
    removed = materialize(gone.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed)).agg(F.collect_set("number").alias(lost)), "removed")
    discard(*used)
    joined = docs.join(removed, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(hashed)), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(lost, i)), "\n")
    changed = F.col(lost).isNotNull()
    rows = joined.withColumn(new, F.when(changed, kept).otherwise(F.col(text_col))).filter(~changed | F.col(new).rlike("[^ \\t-\\r]"))
    return rows.select(*[F.col(new).alias(c) if c == text_col else F.col(c) for c in docs.columns])

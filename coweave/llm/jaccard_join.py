"""N-gram Jaccard join by chosen paths: recursive splitting on sampled shared tokens, brute force in small buckets, repetition.

1. A document is the set of its five-word shingles (all words, if it has fewer). Documents with equal sets are one key.
2. A key's signature holds the least of its shingles under COORDINATES hash functions; (coordinate, value) pairs are the tokens
   of the search: two keys share each with a probability equal to their Jaccard similarity.
3. Each repetition starts at a root that holds all keys. A root samples each coordinate with a probability of
   1 / (similarity * COORDINATES), and its members go on to the child buckets named by their values there. Buckets of up to
   LIMIT members are brute-forced on signatures. A larger one first tries one member as a pivot: what agrees with the pivot by
   NEAR or more is linked to it and leaves the bucket, what agrees by LINK or more is linked as well. As one less the
   similarity is a metric, whatever is similar to a member that left is within LINK of the pivot, so no partner is lost, and a
   bucket of copies of one text empties in a linear step. The rest is split further, on SPLIT sampled coordinates, so that a pair
   of 0.8 stays together in a child with a probability of 0.96. Buckets are routed by their counts; no large one is ever gathered
   in a task.
4. As many roots are taken as make such a pair meet with a probability of RECALL in buckets that come from DEPTH splits. That
   probability is 0.998 after 8 splits and 0.98 after 16, by when a bucket has lost all but a few of the texts that share a passage.
5. Links so far are candidates. Their components are cut into blocks, and pairs of blocks are compared on whole shingle sets,
   which are read from the texts for those keys only. That gives every key's number of links, and its final component. Blocks of
   a large component hold sets of similar size only, as sets that differ more in size cannot be similar.

Sets are known by 64 bits of a hash. A document is an id with a text. Defined cases: null texts and texts without a word belong
to no one (class of their own, no link); a null id is a document of its own row and its class id is the least id of its class, if
any; rows that repeat an id with the same text are one more copy; rows with one id and different texts are different documents;
whole texts are used, however long; empty tables give no rows; other columns are ignored or kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectext as V
from .bits import bit_filter, in_filter
from .common import discard, fresh, id_and_text, materialize, whole_runs
from .components import components, least_labels

SIMILARITY, SHINGLE = 0.8, 5
COORDINATES, LIMIT, BLOCK = 96, 2048, 512
#: Shingles of the sets of a block, 16 MB, and shared shingles that are counted at once.
BLOCK_SHINGLES, STRIP = 1 << 21, 1 << 16
NEAR, LINK, PAIR = 0.72, 0.42, 0.6
RECALL, SPLIT, DEPTH = 0.9999, 2, 3
_RNG = np.random.default_rng(20)
_MULT = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text of a batch, sorted within a text, and the offsets of the texts."""
    buf, offs = V.text_buffer(texts)
    buf = V.ASCII_LOWER[buf]
    start, length, doc = V.words(buf, offs)
    h = V.hash_spans(buf, start, length)
    n = np.bincount(doc, minlength=len(offs) - 1)
    many = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = V.ranges(np.cumsum(n) - n, many)
    own = np.repeat(np.arange(len(n)), many)
    last = np.cumsum(n)[own]
    g = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = at + k < last
        g = V.mix(g + np.where(inside, h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else g, np.uint64(k + 1)))
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    return g[keep], np.concatenate([[0], np.cumsum(np.bincount(own[keep], minlength=len(n)))])


def set_keys(g: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One integer for each set, the same for equal sets; 0 for empty ones."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(V.mix(g ^ _ADD[0]), dtype=np.uint64)])
    n = np.diff(offs)
    key = V.mix(total[offs[1:]] - total[offs[:-1]] + n.astype(np.uint64) * _MULT[0])
    return np.where(n > 0, key, np.uint64(0)).view(np.int64)


def signatures(g: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of each non-empty set under each function."""
    out = np.zeros((len(offs) - 1, COORDINATES), np.uint32)
    has = np.flatnonzero(np.diff(offs))
    if len(has):
        for k in range(COORDINATES):
            out[has, k] = np.minimum.reduceat(((g * _MULT[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), offs[:-1][has])
    return out


def sampled(node: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each bucket samples each coordinate: a matrix of buckets by coordinates."""
    h = V.mix(node.view(np.uint64)[:, None] ^ _MULT[None, :])
    return h < np.uint64(int(2**64 / (similarity * COORDINATES)))


def survival(similarity: float, depth: int) -> float:
    """How likely a pair of just this similarity in a bucket still is in one bucket after ``depth`` splits."""
    return (1 - (1 - similarity) ** SPLIT) ** depth


def roots(similarity: float, depth: int) -> np.ndarray:
    """As many first buckets as make a pair of just this similarity meet with a probability of RECALL in buckets that come from
    ``depth`` splits. Those of a lower depth come first."""
    need = math.log(1 - RECALL) / math.log(1 - similarity * survival(similarity, depth))
    node = V.mix(np.arange(1, 1000 + 2 * math.ceil(need), dtype=np.uint64)).view(np.int64)
    return node[: 1 + int(np.searchsorted(np.cumsum(sampled(node, similarity).sum(axis=1)), need))]


def _children(node: np.ndarray, sig: np.ndarray, row: np.ndarray, k: np.ndarray) -> np.ndarray:
    return V.mix(node.view(np.uint64)[row] + V.mix((k.astype(np.uint64) << np.uint64(32)) | sig[row, k].astype(np.uint64))).view(np.int64)


def first_children(root: int, sig: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and child bucket for each coordinate that a root samples."""
    node = np.full(len(sig), root, np.int64)
    row, k = np.nonzero(np.broadcast_to(sampled(node[:1], similarity), sig.shape)) if len(sig) else (node, node)
    return row, _children(node, sig, row, k)


def split_children(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and child bucket for SPLIT different coordinates that the row's bucket samples."""
    row = np.tile(np.arange(len(node)), SPLIT)
    start, step = V.mix(node.view(np.uint64) ^ _MULT[0]), V.mix(node.view(np.uint64) ^ _MULT[1])
    k = np.concatenate([(start + np.uint64(j) * (np.uint64(1) + step % np.uint64(COORDINATES - 1))) % np.uint64(COORDINATES) for j in range(SPLIT)])
    return row, _children(node, sig, row, k.astype(np.int64))


def _matrix(column: pa.Array, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), COORDINATES)


def candidates(keys: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links among keys (key, sig, sig8) that hold every pair of the similarity within their components. Agreement is counted
    on the lowest eight bits of each coordinate, where one in 256 agrees by chance: links are only candidates."""
    rate = COORDINATES

    def first(start):
        def run(batches):
            for b in batches:
                sig = _matrix(b.column("sig"))
                for r in start:
                    row, child = first_children(r, sig, similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(child), b.column("key").take(pa.array(row))], ["node", "key"])

        return run

    def brute(batches):
        for t in whole_runs(batches, ["node"]):
            node, key, sig = t["node"].to_numpy(), t["key"].to_numpy(), _matrix(t["sig8"], np.uint8)
            a, b, d, alive = [], [], 1, np.arange(len(node))
            while True:
                alive = alive[alive + d < len(node)]
                alive = alive[node[alive] == node[alive + d]]
                if not alive.size:
                    break
                i = alive[(sig[alive] == sig[alive + d]).sum(axis=1) >= PAIR * rate]
                a.append(i)
                b.append(i + d)
                d += 1
            none = np.zeros(0, np.int64)
            lab = least_labels(len(node), np.concatenate([none, *a]), np.concatenate([none, *b]))
            at = np.flatnonzero(lab != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(key[lab[at]])], ["a", "b"])

    def pivot(batches):
        for b in batches:
            sig, other = _matrix(b.column("sig")), _matrix(b.column("pivot_sig"), np.uint8)
            node, key, p = (b.column(c).to_numpy() for c in ("node", "key", "pivot"))
            agree = (sig.astype(np.uint8) == other).sum(axis=1)
            at = np.flatnonzero((agree >= LINK * rate) & (key != p))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(key[at]), pa.array(p[at])], ["node", "key", "to"])
            rest = np.flatnonzero(agree < NEAR * rate)
            row, child = split_children(node[rest], sig[rest])
            yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(key[rest[row]]), pa.nulls(len(row), pa.int64())], ["node", "key", "to"])

    found = []
    rows = materialize(keys.select("key", "sig").mapInArrow(first(roots(similarity, DEPTH)), "node long, key long"), "nodes")
    while True:
        sizes = materialize(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("pivot")).filter("n > 1"), "sizes")
        small = rows.join(sizes.filter(F.col("n") <= LIMIT).select("node"), "node", "left_semi").join(keys.select("key", "sig8"), "key")
        found.append(materialize(small.repartition("node").sortWithinPartitions("node", "key").select("node", "key", "sig8").mapInArrow(brute, "a long, b long"), "links"))
        large = sizes.filter(F.col("n") > LIMIT)
        if large.isEmpty():
            discard(rows, sizes)
            break
        pivots = large.select("node", "pivot").join(keys.select(F.col("key").alias("pivot"), F.col("sig8").alias("pivot_sig")), "pivot")
        tried = rows.join(pivots, "node").join(keys.select("key", "sig"), "key").select("node", "key", "sig", "pivot", "pivot_sig")
        split = materialize(tried.mapInArrow(pivot, "node long, key long, to long"), "split")
        found.append(materialize(split.filter("to IS NOT NULL").select(F.col("key").alias("a"), F.col("to").alias("b")).distinct(), "links"))
        discard(rows, sizes)
        rows = materialize(split.filter("node IS NOT NULL").select("node", "key"), "nodes")
        discard(split)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    links = materialize(out.distinct(), "links")
    discard(*found)
    return links


def exact_links(docs: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """key, links (other keys of the similarity), root (one of them or itself) from candidate groups (key, root): one row for
    each pair of blocks that a key takes part in."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(groups, "key"))

    def fetch(batches):
        for b in V.slices_by_bytes(batches, "text"):
            g, offs = shingle_sets(b.column("text"))
            key = set_keys(g, offs)
            _, _, lead = V.factorize(key)
            lead = np.sort(lead[in_filter(bits.value, key[lead]) & (key[lead] != 0)])
            n = np.diff(offs)[lead]
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key[lead]), pa.ListArray.from_arrays(pa.array(ends), pa.array(g[V.ranges(offs[:-1][lead], n)].view(np.int64)))], ["key", "set"])

    def compare(batches):
        for t in whole_runs(batches, ["root", "i", "j"]):
            group = np.stack([t[c].to_numpy() for c in ("root", "i", "j")])
            cut = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)]))
            key, block = t["key"].to_numpy(), t["block"].to_numpy()
            sets = t["set"].combine_chunks() if isinstance(t["set"], pa.ChunkedArray) else t["set"]
            sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            for p, q in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
                yield _compare_block(key[p:q], block[p:q], flat[ends[p] : ends[q]], sizes[p:q], similarity)

    sets = docs.select("text").mapInArrow(fetch, "key long, set array<long>").groupBy("key").agg(F.first("set").alias("set"))
    member = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").join(sets, "key")
    span = F.floor(F.log(F.size("set").cast("double")) / (math.log(1 / similarity) + 1e-9)).cast("long")  # similar sets: this one or the next
    member = materialize(member.withColumn("span", F.when(F.col("n") > BLOCK, span).otherwise(F.lit(0).cast("long"))), "members")
    many, long = F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.size("set").cast("long")) / BLOCK_SHINGLES)
    blocks = member.groupBy("root", "span").agg(F.greatest(many, long).cast("int").alias("blocks"))
    near = blocks.select("root", F.col("blocks").alias("others"), F.col("span").alias("other_span"), F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1)).alias("span"))
    rows = member.join(blocks, ["root", "span"]).withColumn("block", F.col("span") * (1 << 32) + F.pmod(F.xxhash64("key"), F.col("blocks")))
    rows = rows.join(near, ["root", "span"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others").cast("long") - 1)))
    rows = rows.withColumn("other", F.col("other_span") * (1 << 32) + F.col("other"))
    rows = rows.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "set")
    out = materialize(rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "key").mapInArrow(compare, "key long, links long, root long"), "exact")
    discard(member)
    return out


def _compare_block(key: np.ndarray, block: np.ndarray, flat: np.ndarray, sizes: np.ndarray, similarity: float) -> pa.RecordBatch:
    n = len(key)
    code, distinct, _ = V.factorize(flat)
    own = np.repeat(np.arange(n), sizes)
    shared = np.bincount(code, minlength=len(distinct)) > 1
    new = np.cumsum(shared) - 1
    use = shared[code]
    code, own = new[code[use]], own[use]
    # a bit for each shared shingle; what two sets have in common is counted 64 shingles at a time, and STRIP shingles at once
    both, some = np.zeros((n, n), np.int64), int(shared.sum())
    strips = [(code, own)]
    if some > STRIP:
        order = np.argsort(code, kind="stable")
        code, own = code[order], own[order]
        cuts = np.searchsorted(code, np.arange(0, some, STRIP))
        strips = [(code[p:q] % STRIP, own[p:q]) for p, q in zip(cuts, [*cuts[1:], len(code)], strict=True)]
    for c, rows in strips:
        bits = np.zeros((n, min(STRIP, some) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (rows, c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
        for i in range(n):
            both[i, i:] += np.bitwise_count(bits[i] & bits[i:]).sum(axis=1, dtype=np.int64)
    both = np.maximum(both, both.T)
    total = (sizes[:, None] + sizes[None, :]) - both
    ok = both >= similarity * total - 1e-6
    np.fill_diagonal(ok, False)
    if (block != block[0]).any():
        ok &= block[:, None] != block[None, :]
    x, y = np.nonzero(np.triu(ok))
    lab = least_labels(n, x, y)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ok.sum(axis=1).astype(np.int64)), pa.array(key[lab])], ["key", "links", "root"])


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_hash, key of each row of docs (doc_id, text); state: key, root, links, n of each key)."""

    def sign(batches):
        for b in V.slices_by_bytes(batches, "text"):
            g, offs = shingle_sets(b.column("text"))
            sig = signatures(g, offs)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(set_keys(g, offs)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], ["doc_id", "text_hash", "key", "sig", "sig8"])

    signed = materialize(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(sign, "doc_id long, text_hash long, key long, sig binary, sig8 binary"), "signed")
    keys = materialize(signed.filter("key <> 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("sig").alias("sig"), F.max("sig8").alias("sig8")), "keys")
    rows = materialize(signed.select("doc_id", "text_hash", "key"), "rows")
    discard(signed)
    near = candidates(keys, similarity)
    groups = components(near)
    discard(near)
    links = exact_links(docs, groups, similarity)
    discard(groups)
    final = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    number = links.groupBy("key").agg(F.sum("links").alias("links"))
    state = keys.select("key", "n").join(final, "key", "left").join(number, "key", "left").withColumn("root", F.coalesce("root", "key"))
    state = materialize(state, "state")
    discard(links, final, keys)
    return rows, state


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least id of the documents linked to it, directly or not), n_links (different texts within the
    similarity), n_copies (other documents with the same shingles) of each row."""
    rows, state = _classes(id_and_text(docs, id_col, text_col), similarity)
    least = rows.filter("key <> 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    names = state.join(least, "key").groupBy("root").agg(F.min("least").alias("class_id"))
    state = materialize(state.join(names, "root").select(F.col("key").alias("k"), "class_id", F.coalesce("links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies")), "named")
    out = rows.join(state, rows["key"] == state["k"], "left")
    return out.select("doc_id", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, less all but one of each class: the document with the least id stays (a null id is the
    greatest), of documents with equal ids the one with the least hash of its text, and of rows that repeat both the one with
    the least hash of all columns. Rows without a word stay. Rows are told apart by id and text, so another text with the same id
    has its own fate."""
    at, hashed, rank = fresh(docs, "copy_id", "copy_text", "copy_rank")
    rows, state = _classes(id_and_text(docs, id_col, text_col), similarity)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
    of_key = rows.filter("key <> 0").groupBy("key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    of_key = of_key.withColumn("place", place).join(materialize(state.select("key", "root"), "roots"), "key")
    best = of_key.groupBy("root").agg(F.min("place").alias("best"))
    fates = of_key.join(best, "root").select(F.col("doc_id").alias(at), F.col("text_hash").alias(hashed), (F.col("place") != F.col("best")).alias("gone"), "times")
    fates = materialize(fates.filter("gone OR times > 1"), "fates")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(at)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(hashed))
    single = docs.join(fates, same, "left_anti")
    order = F.row_number().over(Window.partitionBy(F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns if c != text_col])))
    first = docs.join(fates.filter("NOT gone"), same, "left_semi").withColumn(rank, order).filter(F.col(rank) == 1)
    return single.unionByName(first.select(*docs.columns))

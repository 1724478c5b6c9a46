"""LM scoring with Brown class-based n-grams: P(w | v) = P(class of w | class of v) * P(w | class of w).

1. Words of all training documents are counted. The FREQUENT most frequent, and GROUPS groups of all other spellings (by last
   letters and length), are the elements that exchange clustering works on, so its size does not grow with the corpus.
2. Element pairs are counted over all training texts. In one task, whose input is at most the square of the number of elements,
   elements move one by one to the class that raises the likelihood of the class bigrams most, until few move.
3. Every other word is exchanged against those classes: the classes of its neighbours are counted over all training texts, and it
   goes where they are most likely. Words never seen are in the class of their spelling group.
4. Class bigrams are counted once more with the final classes. Transitions are smoothed towards the class frequencies; emissions
   add 0.5 to each word of a class and to one unseen word.
5. Counts and classes of the TABLE most frequent words are broadcast, and texts of such words only are scored where they lie. Other
   texts leave a byte for each word, its class or a gap; classes and counts of the words in the gaps are looked up by a join on the
   word, whose left side is split where a word is hot, and then the gaps are filled. The table only changes the work, not a score.

Words are known by 64-bit hashes. Defined cases: a null text has the end token only; a null id neither trains nor is held out;
without training tokens all counts are 0; of words with equal counts at the table's edge a hash picks which it holds; whole texts
are used, however long; repeated rows each count and each give a row; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import materialize, ship, whole_runs
from .packed import binary_column

FREQUENT, GROUPS, CLASSES, TABLE = 4096, 256, 64, 1 << 18
SWEEPS, PRIOR = 6, 5.0
END = 0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, spelling group (1 to GROUPS) and document of each word, A-Z lower-cased."""
    buf, offs = V.text_buffer(texts)
    buf = V.ASCII_LOWER[buf]
    start, length, doc = V.words(buf, offs)
    last = buf[start + length - 1].astype(np.uint64) | buf[start + np.maximum(length - 2, 0)].astype(np.uint64) << np.uint64(8)
    group = (V.mix(last) % np.uint64(GROUPS // 4)).astype(np.int64) * 4 + np.minimum(length // 4, 3) + 1
    return V.hash_spans(buf, start, length), group, doc


class Exchange:
    """Exchange clustering of a dense matrix of element pair counts; element 0, the end, keeps class 0 for itself."""

    def __init__(self, n: np.ndarray, classes: int):
        self.n, self.k = n, classes
        size = len(n)
        self.total = n.sum(axis=1) + n.sum(axis=0)
        order = np.argsort(-self.total[1:], kind="stable") + 1
        self.cls = np.zeros(size, np.int64)
        self.cls[order] = 1 + np.arange(size - 1) % (classes - 1)
        one = np.zeros((size, classes))
        one[np.arange(size), self.cls] = 1
        self.out, self.into = n @ one, n.T @ one
        self.cc = one.T @ self.out

    def move(self, e: int) -> bool:
        k, g, me = self.k, self.cls[e], float(self.n[e, e])
        out, into = self.out[e].copy(), self.into[e].copy()
        out[g] -= me
        into[g] -= me
        base = self.cc.copy()
        base[g, :] -= out
        base[:, g] -= into
        base[g, g] -= me
        rows, cols = base + out, base + into[:, None]
        gain = (_f(rows) - _f(base)).sum(axis=1) + (_f(cols) - _f(base)).sum(axis=0)
        d = np.arange(k)
        corner = base[d, d]
        gain += _f(corner + out + into + me) - _f(corner + out) - _f(corner + into) + _f(corner)
        left, right = base.sum(axis=1), base.sum(axis=0)
        gain -= _f(left + out.sum() + me) - _f(left) + _f(right + into.sum() + me) - _f(right)
        # what other classes lose or gain through the element's own row and column sums is the same wherever it goes
        gain[0] = -np.inf
        h = int(gain.argmax())
        if gain[h] <= gain[g] + 1e-6:
            return False
        self.cls[e] = h
        for side, c in ((self.out, self.n[:, e]), (self.into, self.n[e])):
            side[:, g] -= c
            side[:, h] += c
        base[h, :] += out
        base[:, h] += into
        base[h, h] += me
        self.cc = base
        return True

    def run(self, sweeps: int) -> np.ndarray:
        order = np.argsort(-self.total[1:], kind="stable") + 1
        for _ in range(sweeps):
            moved = sum(self.move(int(e)) for e in order if self.total[e] > 0)
            if moved <= len(order) // 500:
                break
        return self.cls


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


class Model:
    """What scoring needs, of bounded size."""

    def __init__(self, table: np.ndarray, count: np.ndarray, cls: np.ndarray, group_cls: np.ndarray, cc: np.ndarray, ends: int, tokens_: int, kinds: int, class_n: np.ndarray, class_v: np.ndarray):
        self.table, self.count, self.cls, self.group_cls = table, count, cls, group_cls
        self.ends, self.tokens, self.kinds = ends, tokens_, kinds
        self.step = np.log10(transitions(cc))
        self.mass = np.log10(class_n + 0.5 * (class_v + 1))
        self.base = math.log10(tokens_ + 0.5 * (kinds + 1))


def transitions(cc: np.ndarray) -> np.ndarray:
    """P(next class | class) from the counts of class pairs."""
    share = (cc.sum(axis=0) + 1) / (cc.sum() + len(cc))
    return (cc + PRIOR * share) / (cc.sum(axis=1, keepdims=True) + PRIOR)


def place_in(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
    return at, table[at] == h if len(table) else np.zeros(len(h), bool)


def classes_of(h: np.ndarray, group: np.ndarray, table: np.ndarray, cls: np.ndarray, group_cls: np.ndarray) -> np.ndarray:
    at, hit = place_in(table, h)
    return np.where(hit, cls[at], group_cls[group]) if len(table) else group_cls[group]


def elements(h: np.ndarray, group: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Element of each word: 0 is the end, then the groups, then the frequent words by sorted hash."""
    at, hit = place_in(frequent, h)
    return np.where(hit, GROUPS + 1 + at, group)


def _sequences(e: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Previous and next element of each token of each document; both ends are the end element."""
    n = np.bincount(doc, minlength=docs)
    ends = np.cumsum(n + 1) - 1
    nxt = np.zeros(int((n + 1).sum()), np.int64)
    body = np.ones(len(nxt), bool)
    body[ends] = False
    nxt[body] = e
    prev = np.concatenate([[0], nxt[:-1]]) if len(nxt) else nxt
    return prev, nxt


def _most_frequent(words: DataFrame, most: int) -> Column:
    """Whether a word is one of about ``most`` most frequent, by two histograms: of ranges of counts, and of the counts in the
    range where the edge lies; of the words with just the count at the edge a hash picks a part."""
    span = F.floor(F.log2("n") * 16).cast("int")
    ranges = sorted(((r["b"], r["k"]) for r in words.groupBy(span.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    seen = 0
    for b, k in ranges:
        if seen + k > most:
            break
        seen += k
    else:
        return F.lit(True)
    edge = sorted(((r["n"], r["k"]) for r in words.filter(span == b).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    for n, k in edge:
        if seen + k > most:
            break
        seen += k
    part = (most - seen) * (1 << 20) // k
    return (F.col("n") > n) | ((F.col("n") == n) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < part))


def train(docs: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES, table: int = TABLE, sweeps: int = SWEEPS, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and counts and classes (word, n, cls) of the words that are not in its table."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def count(batches):
        for b in V.slices_by_bytes(batches, "text"):
            h, group, _ = tokens(b.column("text"))
            codes, distinct, first = V.factorize(h)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(group[first].astype(np.int32)), pa.array(np.bincount(codes, minlength=len(distinct)).astype(np.int64))], ["word", "grp", "n"])

    words = materialize(texts.mapInArrow(count, "word long, grp int, n long").groupBy("word").agg(F.first("grp").alias("grp"), F.sum("n").alias("n")), "words")
    ends = texts.count()
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = _most_frequent(words, table)
    known = words.filter(top).toArrow()  # about ``table`` rows
    h, n = known["word"].to_numpy().view(np.uint64), known["n"].to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    often = h[np.sort(np.lexsort((h, -n))[:frequent])]
    shared = spark.sparkContext.broadcast(often)
    size = GROUPS + 1 + len(often)

    def pairs(batches):
        for b in V.slices_by_bytes(batches, "text"):
            w, group, doc = tokens(b.column("text"))
            codes, distinct, first = V.factorize(w)
            e = elements(distinct, group[first], shared.value)[codes] if len(w) else w.astype(np.int64)
            prev, nxt = _sequences(e, doc, len(b))
            codes, distinct, _ = V.factorize(prev * size + nxt)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.bincount(codes, minlength=len(distinct)).astype(np.int64))], ["pair", "n"])

    def packed(key, t):
        cols = [pa.array([t[c].to_numpy().astype(kind).tobytes()], pa.binary()) for c, kind in (("b", np.int32), ("n", np.float64))]
        return pa.table({"a": pa.array([key[0].as_py()], pa.int32()), "cols": cols[0], "counts": cols[1]})

    def cluster(t):
        m = np.zeros((size, size), np.float64)
        for a, c, n in zip(t["a"].to_pylist(), t["cols"].to_pylist(), t["counts"].to_pylist(), strict=True):
            m[a, np.frombuffer(c, np.int32)] = np.frombuffer(n, np.float64)
        x = Exchange(m, classes)
        return pa.table({"cls": pa.array([x.run(sweeps).tolist()], pa.list_(pa.int32())), "cc": pa.array([x.cc.ravel().tolist()], pa.list_(pa.float64()))})

    counts = texts.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    split = counts.select((F.col("pair") / size).cast("int").alias("a"), (F.col("pair") % size).cast("int").alias("b"), "n")
    rows = materialize(split.groupBy("a").applyInArrow(packed, "a int, cols binary, counts binary"), "pairs")
    got = rows.groupBy(F.lit(0).alias("_all")).applyInArrow(cluster, "cls array<int>, cc array<double>").collect()
    element_cls = np.array(got[0]["cls"], np.int64) if got else np.zeros(size, np.int64)
    cc = np.array(got[0]["cc"]).reshape(classes, classes) if got else np.zeros((classes, classes))
    group_cls = element_cls[: GROUPS + 1]
    at, hit = place_in(often, h)
    cls = element_cls[GROUPS + 1 + at] if len(often) else np.zeros(0, np.int64)
    placed = _neighbours(texts, often, element_cls[GROUPS + 1 :], group_cls, classes).mapInArrow(_exchanged(cc, classes), "word long, cls int")
    placed = materialize(placed.join(words.select("word", "n"), "word"), "classes")
    listed = placed.filter(top).select("word", "cls").toArrow()  # the table's at most
    cls[~hit] = listed["cls"].to_numpy()[np.argsort(listed["word"].to_numpy().view(np.uint64))]  # each word occurs, so it has neighbours
    beyond = placed.filter(~top).select("word", "n", "cls")
    if int(kinds) > len(often):
        cc = _class_pairs(texts, h, cls, group_cls, beyond, classes)
    class_n, class_v = np.bincount(cls, n, classes), np.bincount(cls, minlength=classes).astype(float)
    for r in beyond.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():  # one row for each class
        class_n[r["cls"]] += r["n"]
        class_v[r["cls"]] += r["k"]
    class_n[END] += ends
    class_v[END] += ends > 0
    model = Model(h, n, cls, group_cls, cc, ends, int(total) + ends, int(kinds) + (ends > 0), class_n, class_v)
    return model, beyond


def _neighbours(texts: DataFrame, often: np.ndarray, often_cls: np.ndarray, group_cls: np.ndarray, classes: int) -> DataFrame:
    """word, code, n, sorted by word: how often a word that is not in ``often`` stands before class code, or after class code - classes."""
    shared = texts.sparkSession.sparkContext.broadcast((often, often_cls, group_cls))

    def run(batches):
        often, often_cls, group_cls = shared.value
        for b in V.slices_by_bytes(batches, "text"):
            w, group, doc = tokens(b.column("text"))
            codes, distinct, first = V.factorize(w)
            c = classes_of(distinct, group[first], often, often_cls, group_cls)[codes] if len(w) else w.astype(np.int64)
            wanted = ~place_in(often, distinct)[1]
            last = np.ones(len(w), bool)
            last[:-1] = doc[1:] != doc[:-1]
            after = np.where(last, END, np.append(c[1:], END)[: len(c)])
            before = np.where(np.append(True, last[:-1])[: len(c)], END, np.append(END, c[:-1])[: len(c)])
            i = np.flatnonzero(wanted[codes]) if len(w) else codes
            codes, seen, _ = V.factorize(np.concatenate([codes[i] * 2 * classes + after[i], codes[i] * 2 * classes + classes + before[i]]))
            yield pa.RecordBatch.from_arrays([pa.array(distinct[seen // (2 * classes)].view(np.int64)), pa.array((seen % (2 * classes)).astype(np.int32)), pa.array(np.bincount(codes, minlength=len(seen)).astype(np.int64))], ["word", "code", "n"])

    counts = texts.mapInArrow(run, "word long, code int, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))
    return counts.repartition("word").sortWithinPartitions("word")


def _exchanged(cc: np.ndarray, classes: int):
    """From words' neighbour counts the class under which these are most likely; the end's class takes no word."""
    p = transitions(cc)
    back = np.log(p) - np.log((cc.sum(axis=0) + 1) / (cc.sum() + classes))
    value = np.concatenate([np.log(p), back.T], axis=1)  # of a class for each code

    def run(batches):
        for t in whole_runs(batches, ["word"]):
            word = t["word"].to_numpy()
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            for lo in range(0, len(head), 4096):
                a, b = head[lo], head[lo + 4096] if lo + 4096 < len(head) else len(word)
                own = np.searchsorted(head, np.arange(a, b), side="right") - 1 - lo
                m = np.zeros((min(4096, len(head) - lo), 2 * classes))
                m[own, t["code"].to_numpy()[a:b]] = t["n"].to_numpy()[a:b]
                gain = m @ value.T
                gain[:, END] = -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(word[head[lo : lo + 4096]]), pa.array(gain.argmax(axis=1).astype(np.int32))], ["word", "cls"])

    return run


#: Stands for a word whose class is looked up by a join.
GAP = 255


def _gaps(c: np.ndarray, codes: np.ndarray, doc: np.ndarray, hit: np.ndarray, kinds: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of the words that are not in the table, by text: code of each different one and how often it stands there, ends of their
    lists; and of texts with such words the classes of all words with GAPs, and for each gap the place of its word in the list."""
    gap = ~hit[codes] if kinds else np.zeros(0, bool)
    key = doc[gap] * kinds + codes[gap]
    pair, many = np.unique(key, return_counts=True)
    ends = np.concatenate([[0], np.cumsum(np.bincount(pair // max(kinds, 1), minlength=docs))]).astype(np.int64)
    at = (np.searchsorted(pair, key) - ends[doc[gap]]).astype(np.int32)
    gaps = np.bincount(doc[gap], minlength=docs)
    open_ = gaps > 0
    keep = open_[doc]
    filled = np.where(gap, GAP, c[codes] if kinds else c)[keep].astype(np.uint8)
    sizes = np.where(open_, np.bincount(doc, minlength=docs), 0)
    none = pa.array(~open_)
    seq = pc.if_else(none, pa.scalar(None, pa.binary()), binary_column(filled, np.concatenate([[0], np.cumsum(sizes)])))
    places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(gaps)]).astype(np.int32)), pa.array(at))
    return pair % max(kinds, 1), many, ends, seq, places


def _steps(seq: bytes, at: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Previous and next class of each token of a text, its gaps filled, both ends included."""
    c = np.frombuffer(seq, np.uint8).astype(np.int64)
    c[c == GAP] = cls[at]
    return np.append(END, c), np.append(c, END)


def _by_place(cls: Column) -> Column:
    """Classes in the order of the words' places in their text's list."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", cls.alias("cls")))), lambda x: x["cls"])


def _class_pairs(texts: DataFrame, table: np.ndarray, cls: np.ndarray, group_cls: np.ndarray, beyond: DataFrame, classes: int) -> np.ndarray:
    """How often each class follows each over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast((table, cls, group_cls))

    def run(batches):
        total, row = np.zeros(classes * classes, np.int64), TaskContext.get().partitionId() << 40
        for b in V.slices_by_bytes(batches, "text"):
            docs = len(b)
            w, group, doc = tokens(b.column("text"))
            codes, distinct, first = V.factorize(w)
            hit = place_in(shared.value[0], distinct)[1]
            c = classes_of(distinct, group[first], *shared.value) if len(w) else w.astype(np.int64)
            word, _, ends, seq, at = _gaps(c, codes, doc, hit, len(distinct), docs)
            prev, nxt = _sequences(c[codes] if len(w) else c, doc, docs)
            whole = np.repeat(pc.is_null(seq).to_numpy(zero_copy_only=False), np.bincount(doc, minlength=docs) + 1)
            total += np.bincount(prev[whole] * classes + nxt[whole], minlength=classes * classes)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(distinct[word].view(np.int64)))
            part = pa.RecordBatch.from_arrays([pa.nulls(docs, pa.int32()), pa.nulls(docs, pa.int64()), pa.array(row + np.arange(docs)), seq, at, lists], ["pair", "n", "row", "seq", "at", "words"])
            row += docs
            yield part.filter(pc.is_valid(seq))
        k = classes * classes
        empty = pa.array([[]] * k, pa.list_(pa.int32())), pa.array([[]] * k, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(total), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), *empty], ["pair", "n", "row", "seq", "at", "words"])

    def fill(batches):
        total = np.zeros(classes * classes, np.int64)
        for b in batches:
            for seq, at, found in zip(b.column("seq").to_pylist(), b.column("at"), b.column("found"), strict=True):
                prev, nxt = _steps(seq, at.values.to_numpy(), found.values.to_numpy())
                total += np.bincount(prev * classes + nxt, minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes, dtype=np.int32)), pa.array(total)], ["pair", "n"])

    coded = materialize(texts.mapInArrow(run, "pair int, n long, row long, seq binary, at array<int>, words array<long>"), "class-pairs")
    open_ = coded.filter("row IS NOT NULL")
    found = open_.select("row", F.posexplode("words").alias("pos", "word")).join(beyond, "word").groupBy("row").agg(_by_place(F.col("cls")).alias("found"))
    more = open_.select("row", "seq", "at").join(found, "row").select("seq", "at", "found").mapInArrow(fill, "pair int, n long")
    out = np.zeros(classes * classes)
    for r in coded.filter("pair IS NOT NULL").select("pair", "n").union(more).groupBy("pair").agg(F.sum("n").alias("n")).collect():  # classes squared
        out[r["pair"]] = r["n"]
    return out.reshape(classes, classes)


def score(docs: DataFrame, model: Model, rest: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m: Model = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in V.slices_by_bytes(batches, "text"):
            docs_ = len(b)
            w, group, doc = tokens(b.column("text"))
            codes, distinct, first = V.factorize(w)
            at, hit = place_in(m.table, distinct)
            c = np.where(hit, m.count[at], 0) if len(m.table) else np.zeros(len(distinct), np.int64)
            cls = classes_of(distinct, group[first], m.table, m.cls, m.group_cls)
            prev, nxt = _sequences(cls[codes] if len(w) else w.astype(np.int64), doc, docs_)
            n = np.bincount(doc, minlength=docs_)
            own = np.repeat(np.arange(docs_), n + 1)
            step = np.bincount(own, m.step[prev, nxt] - m.mass[nxt], docs_)
            logs = np.where(hit, np.log10(c + 0.5), 0.0)
            listed = np.bincount(doc, logs[codes], docs_) + math.log10(m.ends + 0.5)
            known = np.bincount(doc, hit[codes], docs_).astype(np.int64) + (m.ends > 0)
            word, many, ends, seq, at = _gaps(cls, codes, doc, hit, len(distinct), docs_)
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (distinct[word].view(np.int64), many.astype(np.int32), cls[word].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(docs_)), b.column("doc_id"), b.column("held_out"), pa.array((n + 1).astype(np.int64)), pa.array(known), pa.array(listed), pa.array(step), seq, at, *lists], ["row", "doc_id", "held_out", "n_tokens", "known", "listed", "step", "seq", "at", "words", "many", "guess"])
            row += docs_

    def filled(seq: pa.Array, at: pa.Array, found: pa.Array) -> pa.Array:
        m: Model = shared.value
        out = []
        for x, places, classes in zip(seq.to_pylist(), at, found, strict=True):
            prev, nxt = _steps(x, places.values.to_numpy(), classes.values.to_numpy())
            out.append(float((m.step[prev, nxt] - m.mass[nxt]).sum()))
        return pa.array(out, pa.float64())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    part = materialize(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, listed double, step double, seq binary, at array<int>, words array<long>, many array<int>, guess array<int>"), "scored")
    open_ = part.filter("seq IS NOT NULL")
    left = open_.select("row", F.posexplode(F.arrays_zip("words", "many", "guess")).alias("pos", "e")).select("row", "pos", F.col("e.words").alias("word"), F.col("e.many").alias("many"), F.col("e.guess").alias("guess"))
    found = left.join(rest, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("many")).otherwise(0)).alias("more"), F.sum(F.col("many") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), _by_place(F.coalesce("cls", "guess")).alias("found"))
    whole = part.filter("seq IS NULL").select("doc_id", "held_out", "n_tokens", "known", "listed", "step")
    more = open_.drop("words", "many", "guess").join(found, "row").withColumns({"known": F.col("known") + F.col("more"), "listed": F.col("listed") + F.col("logs"), "step": F.arrow_udf(filled, "double")("seq", "at", "found")})
    out = whole.union(more.select(*whole.columns))
    return out.select("doc_id", "held_out", "n_tokens", F.col("known").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("listed") - F.col("n_tokens") * F.lit(model.base)).alias("base_score"), (F.col("listed") + F.col("step")).alias("score"))

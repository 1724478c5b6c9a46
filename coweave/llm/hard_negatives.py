"""Hard negatives: for each anchor and positive the best rows of other labels in a score window, by vantage-point trees.

Scores are inner products of integer codes, floor(scale * x). With M the greatest norm, a row x gets one more coordinate,
sqrt(M^2 - |x|^2), and a query q gets 0 there, so that the squared distance is |q|^2 + M^2 - 2 * score: the higher the score, the
nearer the row, and a window of scores is an annulus around the query.

Rows of one vector and label are a class, of which only the few smallest ids can be in an answer. A routing tree, fitted on a
sample of at most SAMPLE classes, sends every class to a leaf; the least and greatest distances of all its classes from the vantage
points above bound each leaf. A query goes to the leaves that meet its annulus, whose outer radius shrinks beforehand to the k-th
wanted row of the sample. A leaf is cut into chunks of about CHUNK classes and meets its queries in batches of about QUERIES, each a
group of its own. There a tree of the chunk is walked nearest first inside the annulus until k wanted rows came out, and the answers
of all groups are merged. The sample only changes the work, never the answers: every row is in the trees, and all bounds are safe.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter vectors count as
filled up with zeros; rows that repeat id, label and vector count once; rows with one id but different labels or vectors are rows of
their own; equal scores are in the order of ids; an empty table, or one without
anchors, gives no rows; other columns are ignored. Squared norms of codes from 2^52 raise an error, as scores would not be exact.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, ship, shuffle_partitions

#: Classes of the sample at most (and 32 MB of it), leaves of the routing tree, classes of a chunk, queries of a batch, rows of a bucket.
SAMPLE, SAMPLE_BYTES, LEAVES, CHUNK, QUERIES, BUCKET = 8192, 1 << 25, 512, 8192, 1024, 256


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of codes as exact floats, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy()
    return out


class Space:
    """Distances between rows with the added coordinate; ``m2`` is the greatest squared norm."""

    def __init__(self, m2: float):
        self.m2, self.slack = m2, 1e-6 * math.sqrt(m2) + 1e-9

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.m2 - (x * x).sum(1), 0.0))

    def apart(self, x: np.ndarray, lift_x: np.ndarray, y: np.ndarray, lift_y: np.ndarray) -> np.ndarray:
        """Distances of all rows of x from all rows of y."""
        x2, y2 = (x * x).sum(1) + lift_x**2, (y * y).sum(1) + lift_y**2
        return np.sqrt(np.maximum(x2[:, None] + y2 - 2 * (x @ y.T + np.outer(lift_x, lift_y)), 0.0))

    def radius(self, q2: float, score: float) -> float:
        """Distance from a query of squared norm q2 of the rows with this score."""
        return math.sqrt(max(q2 + self.m2 - 2 * score, 0.0))

    def score(self, q2: float, distance: float) -> float:
        """The greatest score of a row at least this far off."""
        return (q2 + self.m2 - max(distance - self.slack, 0.0) ** 2) / 2


class Tree:
    """Vantage points with a nearer and a farther part each, down to parts of at most ``most`` rows.

    Children are numbers of nodes, or -1 - number of a leaf. ``paths`` has the nodes above each leaf."""

    def __init__(self, space: Space, x: np.ndarray, most: int):
        self.space, self.parts, self.paths = space, [], []
        lift = space.lift(x)
        points, limits, self.children, self.shells = [], [], [], []
        self.root = 0
        todo: list[tuple[np.ndarray, list[int], int, int]] = [(np.arange(len(x)), [], -1, 0)]
        while todo:
            rows, path, parent, side = todo.pop()
            here = -1 - len(self.parts)
            if len(rows) > most:
                far = space.apart(x[rows], lift[rows], x[rows[:1]], lift[rows[:1]])[:, 0]
                vantage = rows[int(far.argmax())]
                d = space.apart(x[rows], lift[rows], x[vantage : vantage + 1], lift[vantage : vantage + 1])[:, 0]
                limit = float(np.partition(d, len(d) // 2)[len(d) // 2])
                near = d < limit
                if near.any():
                    here = len(points)
                    points.append(vantage)
                    limits.append(limit)
                    self.children.append([0, 0])
                    self.shells.append([(float(d[p].min()), float(d[p].max())) for p in (near, ~near)])
                    todo += [(rows[~near], [*path, here], here, 1), (rows[near], [*path, here], here, 0)]
            if here < 0:
                self.parts.append(rows)
                self.paths.append(path)
            if parent >= 0:
                self.children[parent][side] = here
            else:
                self.root = here
        self.points, self.lifts, self.limits = x[points], lift[points], np.array(limits)

    def from_points(self, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        return self.space.apart(x, lift, self.points, self.lifts) if len(self.points) else np.zeros((len(x), 0))

    def leaf_of(self, d: np.ndarray) -> np.ndarray:
        """Leaf of each row, given its distances from all vantage points."""
        at = np.full(len(d), self.root)
        children = np.array(self.children, np.int64).reshape(-1, 2)
        while (inner := np.flatnonzero(at >= 0)).size:
            at[inner] = children[at[inner], (d[inner, at[inner]] >= self.limits[at[inner]]).astype(int)]
        return -1 - at


def walk(tree: Tree, x: np.ndarray, wanted: np.ndarray, ids: list[list[int]], q: np.ndarray, from_points: np.ndarray, lo: float, hi: float, k: int) -> list[tuple[int, int]]:
    """The first k (id, score) of wanted rows with lo <= score <= hi, by falling score, then id: parts and rows come out of one
    queue, nearest first; what lies inside the annulus' inner or outside its outer radius never enters it."""
    space, q2 = tree.space, float(q @ q)
    inner = space.radius(q2, hi) - space.slack
    queue: list[tuple] = [(-math.inf, 0, tree.root, 0.0, math.inf)]
    best: list[float] = []
    out: list[tuple[int, int]] = []
    while queue and len(out) < k:
        key, kind, at, near, far = heapq.heappop(queue)
        if -key < lo:
            break
        if kind:
            out.append((at, int(-key)))
        elif at < 0:
            rows = tree.parts[-1 - at]
            s = x[rows] @ q
            for r in np.flatnonzero(wanted[rows] & (s >= lo) & (s <= hi)).tolist():
                for i in ids[rows[r]]:
                    heapq.heappush(queue, (-s[r], 1, i, 0.0, 0.0))
                    bisect.insort(best, s[r])
            if len(best) >= k:
                del best[:-k]
                lo = max(lo, best[0])
        else:
            for child, (least, most) in zip(tree.children[at], tree.shells[at], strict=True):
                d = from_points[at]
                n, f = max(near, d - most, least - d), min(far, d + most)
                if f >= inner and (above := space.score(q2, n)) >= lo:
                    heapq.heappush(queue, (-above, 0, child, n, f))
    return out


# -- the index -----------------------------------------------------------------------------------------------------------------


class Index:
    """All classes by leaf and chunk, the routing tree, bounds of its leaves, and the sample that it was fitted on."""

    def __init__(self, classes: DataFrame):
        """classes: cid, label, v, ids."""
        spark = classes.sparkSession
        norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
        n, m2, self.dim = classes.agg(F.count(F.lit(1)), F.max(norm2), F.max(F.size("v"))).first()
        if (m2 or 0) >= 2**52:
            raise ValueError("the codes are too large for exact scores")
        self.space, self.dim = Space(m2 or 0.0), self.dim or 0
        most = min(SAMPLE, max(256, SAMPLE_BYTES // (8 * max(self.dim, 1))))
        sample = classes.orderBy(F.xxhash64("v", "label"), "cid").limit(most).select("label", "v").toArrow()
        self.sample, self.sample_label = matrix(sample.column("v"), self.dim), np.array(sample.column("label").to_pylist(), object)
        leaves = min(LEAVES, max(1, -(-n // CHUNK)), max(1, len(self.sample) // 16))
        self.tree = Tree(self.space, self.sample, max(1, -(-len(self.sample) // leaves)))
        self.rows = materialize(self._routed(classes), "routed")
        self.tables = [self.rows]
        sizes = {r["leaf"]: r["n"] for r in self.rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each leaf
        self.chunks = {leaf: max(1, -(-size // CHUNK)) for leaf, size in sizes.items()}
        shells = self.rows.select("leaf", F.posexplode("path")).groupBy("leaf", "pos").agg(F.min("col"), F.max("col")).collect()  # leaves x depth
        self.shells = {(leaf, pos): (lo, hi) for leaf, pos, lo, hi in shells}
        self.spark = spark

    def _routed(self, classes: DataFrame) -> DataFrame:
        tree, space, dim = self.tree, self.space, self.dim

        def run(batches):
            for b in batches:
                x = matrix(b.column("v"), dim)
                d = tree.from_points(x, space.lift(x))
                leaf = tree.leaf_of(d)
                path = [d[r, tree.paths[f]] for r, f in enumerate(leaf.tolist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32)), pa.array(path, pa.list_(pa.float64()))], [*b.schema.names, "leaf", "path"])

        return classes.mapInArrow(run, "cid long, label string, v array<long>, ids array<long>, leaf int, path array<double>")

    def _visits(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """A row for each query and leaf that its annulus meets, with the window's lower end raised by the sample."""
        tree, space, dim, shells, sample, labels = self.tree, self.space, self.dim, self.shells, self.sample, self.sample_label
        leaves = sorted(self.chunks)
        bounds = [(leaf, tree.paths[leaf], np.array([shells[leaf, p] for p in range(len(tree.paths[leaf]))]).reshape(-1, 2)) for leaf in leaves]

        def run(batches):
            for whole in batches:
                for b in (whole.slice(i, 1024) for i in range(0, len(whole), 1024)):
                    q = matrix(b.column("v"), dim)
                    d = space.apart(q, np.zeros(len(q)), tree.points, tree.lifts) if len(tree.points) else np.zeros((len(q), 0))
                    lo, hi = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lo", "hi"))
                    s = q @ sample.T
                    codes, _ = pd.factorize(np.concatenate([np.array(b.column("label").to_pylist(), object), labels]))
                    fit = ((codes[: len(q), None] == codes[len(q) :]) == same) & (s >= lo[:, None]) & (s <= hi[:, None])
                    if s.shape[1] >= k:
                        lo = np.maximum(lo, np.partition(np.where(fit, s, -np.inf), -k, axis=1)[:, -k])
                    q2 = (q * q).sum(1)
                    outer = np.sqrt(np.maximum(q2 + space.m2 - 2 * np.maximum(lo, -1e300), 0)) + space.slack
                    inner = np.sqrt(np.maximum(q2 + space.m2 - 2 * np.minimum(hi, 1e300), 0)) - space.slack
                    for leaf, path, shell in bounds:
                        at = d[:, path]
                        near = np.maximum(at - shell[:, 1], shell[:, 0] - at).max(1, initial=0.0)
                        far = (at + shell[:, 1]).min(1, initial=np.inf)
                        go = pa.array(np.flatnonzero((near <= outer) & (far >= inner)))
                        if len(go):
                            x = b.take(go)
                            yield pa.RecordBatch.from_arrays([x.column("qid"), x.column("label"), x.column("v"), pa.array(lo).take(go), x.column("hi"), pa.array(np.full(len(go), leaf, np.int32))], ["qid", "label", "v", "lo", "hi", "leaf"])

        return queries.select("qid", "label", "v", "lo", "hi").mapInArrow(run, "qid long, label string, v array<long>, lo double, hi double, leaf int")

    def nearest(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """qid, rank, id, score: the first k rows of the same label (or of others) with lo <= score <= hi of each query (qid, label, v,
        lo, hi), by falling score, then id."""
        visits = materialize(self._visits(queries, same, k), "visits")
        asked = visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("asked"))
        chunks = self.spark.createDataFrame(list(self.chunks.items()), "leaf int, chunks int")
        deal = F.broadcast(chunks.join(asked, "leaf").select("leaf", "chunks", F.ceil(F.col("asked") / QUERIES).cast("int").alias("lots")))  # a row for each leaf
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = self.rows.drop("path").join(deal, "leaf").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).withColumn("lot", upto("lots")).drop("chunks", "lots")
        right = visits.join(deal, "leaf").withColumn("lot", F.pmod(F.xxhash64("qid"), F.col("lots")).cast("int")).withColumn("chunk", upto("chunks")).drop("chunks", "lots")
        search = functools.partial(_search, space=self.space, dim=self.dim, same=same, k=k)
        group = ("leaf", "chunk", "lot")
        found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(lambda a, b: search(a, b), "qid long, id long, score long")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
        out = materialize(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "rank", "id", "score"), "nearest")
        discard(visits)
        self.tables.append(out)
        return out

    def drop(self, *more: DataFrame) -> None:
        """Delete the index, the answers read from it and other tables, once all that was made from them is written."""
        discard(*self.tables, *more)


def _search(rows: pa.Table, queries: pa.Table, space: Space, dim: int, same: bool, k: int) -> pa.Table:
    out: list[tuple[int, int, int]] = []
    if len(rows) and len(queries):
        x, ids = matrix(rows.column("v"), dim), rows.column("ids").to_pylist()
        tree = Tree(space, x, BUCKET)
        codes, _ = pd.factorize(np.array(rows.column("label").to_pylist() + queries.column("label").to_pylist(), object))
        label, q_label = codes[: len(rows)], codes[len(rows) :]
        q = matrix(queries.column("v"), dim)
        d = tree.from_points(q, np.zeros(len(q)))
        lo, hi = (queries.column(c).to_numpy() for c in ("lo", "hi"))
        fits = {c: (label == c) == same for c in np.unique(q_label).tolist()}
        for r, qid in enumerate(queries.column("qid").to_pylist()):
            out += [(qid, i, s) for i, s in walk(tree, x, fits[q_label[r]], ids, q[r], d[r], lo[r], hi[r], k)]
    columns = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["qid", "id", "score"])


# -- mining --------------------------------------------------------------------------------------------------------------------


def coded(vectors: DataFrame, is_anchor: Column, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v (integer codes) and anchor of the rows that take part."""
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN is above infinity
    codes = F.transform("x", lambda c: F.floor(c * float(scale)))
    return d.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite).select("id", "label", codes.alias("v"), "anchor")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first ``positives``
    other rows of its label, the first ``negatives`` rows of other labels whose score is at least low_percent of the positive's and
    at most the positive's."""
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(coded(vectors, is_anchor, scale, id_col, vector_col, label_col), "codes")
    place = F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))
    few = rows.select("id", "label", "v").distinct().withColumn("place", place).filter(F.col("place") <= max(positives + 1, negatives))
    classes = few.groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # as many as the filter leaves
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "label", "v", "ids"), "classes")
    index = Index(classes)
    anchors = rows.filter("anchor").select(F.col("id").alias("anchor_id"), "label", "v").distinct()
    own = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c).alias("own")
    named = materialize(anchors.join(classes.select("cid", "label", "v"), ["label", "v"]).select("anchor_id", "cid", own), "anchors")
    asked = classes.join(named.select("cid").distinct(), "cid", "left_semi").select(F.col("cid").alias("qid"), "label", "v")
    asked = materialize(asked.repartition(shuffle_partitions(spark), "qid"), "asked")
    near = index.nearest(asked.withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("inf"))}), True, positives + 1)
    near = near.select(F.col("qid").alias("cid"), F.col("rank").alias("place"), "id", F.col("score").alias("p"))
    # a window for each class of anchors and score of a positive; below 0 it holds nothing
    windows = materialize(near.filter("p >= 0").select("cid", "p").distinct().withColumn("qid", F.monotonically_increasing_id()), "windows")
    least = F.expr(f"(p * {low_percent} + 99) div 100").cast("double")
    spans = windows.join(asked.withColumnRenamed("qid", "cid"), "cid").select("qid", "label", "v", least.alias("lo"), F.col("p").cast("double").alias("hi"))
    hard = index.nearest(spans, False, negatives)
    lists = hard.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("hard"))  # at most ``negatives``
    found = near.join(windows.join(lists, "qid").drop("qid"), ["cid", "p"], "left").groupBy("cid")
    answers = materialize(found.agg(F.sort_array(F.collect_list(F.struct("place", "id", "p", "hard"))).alias("found")), "answers")  # positives + 1
    index.drop(rows, classes, asked, windows)
    itself = lambda f: (f["id"] == F.col("anchor_id")) & (f["p"] == F.col("own"))  # noqa: E731  the anchor's row, or one with its id that is as good
    others = F.sort_array(F.concat(F.filter("found", lambda f: ~itself(f)), F.slice(F.filter("found", itself), 2, positives)))
    d = named.join(answers, "cid").select("anchor_id", F.explode(F.slice(others, 1, positives)).alias("f")).select("anchor_id", "f", F.explode("f.hard").alias("h"))
    return d.select("anchor_id", F.col("f.id").alias("positive_id"), F.col("h.rank").cast("int").alias("rank"), F.col("h.id").alias("negative_id"), F.col("f.p").alias("positive_score"), F.col("h.score").alias("negative_score"))

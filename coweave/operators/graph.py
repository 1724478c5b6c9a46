"""Measures of a graph given as a table of pairs (u, v) of node names, u < v, each once."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict, deque
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .lineage import cut, drop
from .ranges import numbered, running


def neighbours(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def degree(pairs: DataFrame) -> DataFrame:
    return neighbours(pairs).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def _components_within(batches):
    """node, component of all edges of a task: labels of the least node pass along edges and are followed to their end."""
    tables = [pa.Table.from_batches([b]) for b in batches if len(b)]
    if tables:
        table = pa.concat_tables(tables)
        both = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks]).combine_chunks().dictionary_encode()
        nodes = both.dictionary.take(order := pc.array_sort_indices(both.dictionary))
        rank = np.empty(len(nodes), np.int64)
        rank[order.to_numpy()] = np.arange(len(nodes))
        u, v = np.split(rank[both.indices.to_numpy()], 2)
        label = np.arange(len(nodes))
        while len(u):
            least = np.minimum(label[u], label[v])
            np.minimum.at(label, label[u], least)
            np.minimum.at(label, label[v], least)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[u] != label[v]
            u, v = u[open_], v[open_]
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["node", "component"])


def connected_components(pairs: DataFrame, local_edges: int = 1 << 20) -> DataFrame:
    """node, component (its least node). At most ``local_edges`` edges, counted beforehand, are treated in one task; more by alternating
    large and small stars until nothing changes: each pass hangs nodes on the least node they know of, so their number grows with the
    logarithm of the longest path."""
    e = cut(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if e.count() <= local_edges:
        kind = e.schema["u"].dataType
        return e.repartition(1).mapInArrow(_components_within, StructType([StructField("node", kind), StructField("component", kind)]))
    told = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), e)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct(), large)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == told:
            break
        told = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def largest_component(pairs: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """The pairs of the component with most nodes, the one with the least node of several."""
    components = connected_components(pairs) if components is None else components
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    first = F.broadcast(sizes.orderBy(F.desc("n"), "component").limit(1).select("component"))
    return pairs.join(components.join(first, "component").select(F.col("node").alias("u")), "u", "left_semi")


# -- shortest paths ------------------------------------------------------------------------------------------------------------


def _levels(nb: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """By distance from 1 on: s, t and sigma, the number of shortest paths, of the nodes t that far from a source s. A neighbour of a
    level lies in it, in the one before or in the next, so two levels tell what is new."""
    front = cut(nb.join(sources.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("u").alias("s"), F.col("v").alias("t"), F.lit(1.0).alias("sigma")))
    levels: list[DataFrame] = []
    while not front.isEmpty():
        levels.append(front)
        seen = front.select("s", "t") if len(levels) < 2 else front.select("s", "t").union(levels[-2].select("s", "t"))
        step = front.join(nb.select(F.col("u").alias("t"), F.col("v").alias("x")), "t").filter("s <> x").groupBy("s", F.col("x").alias("t")).agg(F.sum("sigma").alias("sigma"))
        front = cut(step.join(seen, ["s", "t"], "left_anti"))
    drop(front)
    return levels


def _batches(nb: DataFrame, batch_rows: int):
    """Nodes in batches of sources, so that a level of a batch makes about ``batch_rows`` rows at most: sources times edges."""
    nodes = nb.select(F.col("u").alias("node")).distinct()
    n = math.ceil(nodes.count() * nb.count() / batch_rows)  # none without an edge
    for k in range(n):
        yield nodes.filter(F.pmod(F.xxhash64("node"), F.lit(n)) == k)


def _by_size(pairs: DataFrame, components: DataFrame | None, local_edges: int) -> tuple[DataFrame, DataFrame]:
    """Pairs with their component, of components of at most ``local_edges`` pairs, and the pairs of the others."""
    of = (connected_components(pairs) if components is None else components).select(F.col("node").alias("u"), "component")
    known = cut(pairs.select("u", "v", *(["w"] if "w" in pairs.columns else [])).join(of, "u"))
    large = known.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > local_edges).select("component")
    return known.join(large, "component", "left_anti"), known.join(large, "component", "left_semi").drop("component")


def _each_component(pairs: DataFrame, measure, schema: str) -> DataFrame:
    """The rows that ``measure`` gives for each component, from its nodes and their neighbours (numbers), with weights if there is a
    column w. A component's rows, of which there are few, follow each other in a task."""
    columns = ["component", "u", "v", *(["w"] if "w" in pairs.columns else [])]

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
        out = []
        for _, own in groupby(rows, lambda r: r[0]):
            number: dict[str, int] = {}
            near: list[list] = []
            for _, u, v, *w in own:
                for x in (u, v):
                    if x not in number:
                        number[x] = len(near)
                        near.append([])
                near[number[u]].append((number[v], *w) if w else number[v])
                near[number[v]].append((number[u], *w) if w else number[u])
            out += measure(list(number), near)
            if len(out) >= 10000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    names = [c.split()[0] for c in schema.split(", ")]
    return pairs.repartition("component").sortWithinPartitions(*columns[:3]).select(*columns).mapInArrow(run, schema)


def _paths_from(s: int, near: list[list[int]]) -> tuple[list[int], list[int], list[float]]:
    """Nodes in the order of their distance from s, distances, and numbers of shortest paths."""
    order, far, paths = [s], [-1] * len(near), [0.0] * len(near)
    far[s], paths[s] = 0, 1.0
    for x in order:
        for y in near[x]:
            if far[y] < 0:
                far[y] = far[x] + 1
                order.append(y)
            if far[y] == far[x] + 1:
                paths[y] += paths[x]
    return order, far, paths


def _shares_within(nodes: list[str], near: list[list[int]]):
    total = [0.0] * len(nodes)
    for s in range(len(nodes)):
        order, far, paths = _paths_from(s, near)
        back = [0.0] * len(nodes)
        for y in order[:0:-1]:
            c = (1 + back[y]) / paths[y]
            for x in near[y]:
                if far[x] == far[y] - 1:
                    back[x] += paths[x] * c
            total[y] += back[y]
    return list(zip(nodes, total, strict=True))


def _lengths_within(nodes: list[str], near: list[list[int]]):
    far = [d for s in range(len(nodes)) for d in _paths_from(s, near)[1] if d > 0]
    return [(len(far), sum(far), max(far))] if far else []


def betweenness(pairs: DataFrame, n_nodes: int | None = None, batch_rows: int = 1 << 30, components: DataFrame | None = None, local_edges: int = 1 << 11) -> DataFrame:
    """node, betweenness: share of the shortest paths between other nodes that lead through it, over all pairs of the ``n_nodes`` nodes
    (those with a pair, unless more are given, as isolated ones).

    Components (node, component; found if not given) of at most ``local_edges`` pairs are each measured within a task, many in one. In
    others sources are taken in batches. From each, levels go out, and what depends on a node is passed back from level to level; only
    a sum for each node stays between batches, and no table of all pairs of nodes is ever made."""
    n = n_nodes or neighbours(pairs).select("u").distinct().count()
    small, large = _by_size(pairs, components, local_edges)
    total = _each_component(small, _shares_within, "node string, b double").union(_shares_by_levels(large, batch_rows))
    return total.select("node", (F.col("b") * (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0)).alias("betweenness"))


def _shares_by_levels(pairs: DataFrame, batch_rows: int) -> DataFrame:
    nb = cut(neighbours(pairs))
    total = cut(nb.select(F.col("u").alias("node"), F.lit(0.0).alias("b")).distinct())
    for sources in _batches(nb, batch_rows):
        levels = _levels(nb, sources)
        below, spent = None, []
        for before, ends in zip(levels[-2::-1], levels[:0:-1], strict=True):
            share = ends.withColumn("x", F.lit(0.0)) if below is None else ends.join(below, ["s", "t"], "left").fillna(0.0, ["x"])
            back = share.select("s", "t", ((1 + F.col("x")) / F.col("sigma")).alias("c")).join(nb.select(F.col("u").alias("t"), F.col("v").alias("w")), "t")
            here = back.join(before.withColumnRenamed("t", "w"), ["s", "w"]).groupBy("s", F.col("w").alias("t")).agg(F.sum(F.col("sigma") * F.col("c")).alias("x"))
            below = cut(here)
            spent.append(below)
        if spent:
            sums = spent[0]
            for s in spent[1:]:
                sums = sums.union(s)
            total = cut(total.union(sums.select(F.col("t").alias("node"), F.col("x").alias("b"))).groupBy("node").agg(F.sum("b").alias("b")), total, *spent)
        drop(*levels)
    drop(nb)
    return total


def path_statistics(pairs: DataFrame, batch_rows: int = 1 << 30, components: DataFrame | None = None, local_edges: int = 1 << 11) -> DataFrame:
    """average_path and diameter over the connected pairs of nodes; components are measured as in ``betweenness``."""
    small, large = _by_size(pairs, components, local_edges)
    sums = _each_component(small, _lengths_within, "paths long, total long, longest long").agg(F.sum("paths"), F.sum("total"), F.max("longest")).first()
    paths, total, longest = (x or 0 for x in sums)
    nb = cut(neighbours(large))
    for sources in _batches(nb, batch_rows):
        levels = _levels(nb, sources)
        for d, level in enumerate(levels, 1):
            rows = level.count()
            paths, total, longest = paths + rows, total + d * rows, max(longest, d)
        drop(*levels)
    drop(nb)
    return pairs.sparkSession.createDataFrame([(total / paths if paths else None, longest or None)], "average_path double, diameter int")


def _closed(kind: list[int], u: np.ndarray, v: np.ndarray, cu: np.ndarray, cv: np.ndarray, step: int = 1 << 20) -> int:
    """Triangles whose ends have the three colours of the sorted list, from all edges between these colours."""
    i, j, k = kind
    base, apex = ((i, j), k) if i == j or j < k else ((j, k), i)  # edges of the base are of two equal colours, if there are any
    n = int(max(u.max(), v.max())) + 1
    start, end, ca, cb = (np.concatenate(x) for x in ((u, v), (v, u), (cu, cv), (cv, cu)))
    near = (cb == apex) & ((ca == base[0]) | (ca == base[1])) & ((end > start) if i == k else True)
    keys = np.sort(start[near] * n + end[near])
    tails, heads = keys % n, np.searchsorted(keys, np.arange(n + 1) * n)
    here = (ca == base[0]) & (cb == base[1]) & ((start < end) if base[0] == base[1] else True)
    x, y = start[here], end[here]
    size = np.diff(heads)
    x, y = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
    upto, found, at = np.cumsum(size[x]), 0, 0
    owners, apexes = np.flatnonzero(size), np.unique(tails)
    words = (len(apexes) + 63) // 64
    if len(owners) * words <= step << 3 and len(x) * words < 16 * int(size[x].sum()):  # dense: a row of bits for each node, eight MB words at most
        row = np.zeros((len(owners) + 1, words * 8), np.uint8)
        line = np.full(n, len(owners))
        line[owners] = np.arange(len(owners))
        spot = np.searchsorted(apexes, tails)
        np.bitwise_or.at(row, (line[np.repeat(np.arange(n), size)], spot >> 3), (1 << (spot & 7)).astype(np.uint8))
        row, each = row.view(np.uint64), max(1, step // (words or 1))
        return sum(int(np.bitwise_count(row[line[x[k : k + each]]] & row[line[y[k : k + each]]]).sum(dtype=np.int64)) for k in range(0, len(x), each))
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, "right")))
        n_each = size[x[at:to]]
        before = np.cumsum(n_each) - n_each
        z = tails[np.repeat(heads[x[at:to]] - before, n_each) + np.arange(n_each.sum())]
        want = np.repeat(y[at:to], n_each) * n + z
        place = np.searchsorted(keys, want)
        found += int((keys[np.minimum(place, len(keys) - 1)] == want).sum()) if len(keys) else 0
        at = to
    return found


def _pack(u: np.ndarray, v: np.ndarray) -> bytes:
    """Pairs in the order of (u, v), each once, as steps of u, numbers of v and steps of v, byte by byte of these."""
    first = np.flatnonzero(np.diff(u, prepend=-1))
    gaps = np.diff(v, prepend=0)
    gaps[first] = v[first]
    whole = np.concatenate([[len(first), len(v)], np.diff(u[first], prepend=0), np.diff(first, append=len(u)), gaps]).astype("<u4")
    return zlib.compress(whole.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.tobytes(), "<u4").astype(np.int64)
    n, m = whole[:2].tolist()
    counts, gaps = whole[2 + n : 2 + 2 * n], whole[2 + 2 * n : 2 + 2 * n + m]
    total, first = np.cumsum(gaps), np.cumsum(counts) - counts
    return np.repeat(np.cumsum(whole[2 : 2 + n]), counts), total - np.repeat(total[first] - gaps[first], counts)


def _colour(x: np.ndarray, colours: int) -> np.ndarray:
    return ((x * 0x9E3779B1 & 0xFFFFFFFF) >> 11) % colours


def _blocks(lists: DataFrame, colours: int, step: int = 1 << 21) -> DataFrame:
    """i, j, data: the different pairs of the lists' nodes (column a, numbers), one packed row for each two colours. A task packs what
    it has of a block before it is shuffled."""

    def by_block(keys: np.ndarray):
        u, v = keys >> 32, keys & 0xFFFFFFFF
        cu, cv = _colour(u, colours), _colour(v, colours)
        block = np.minimum(cu, cv) * colours + np.maximum(cu, cv)
        order = np.argsort(block, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            if len(own):
                yield int(block[own[0]]), _pack(u[own], v[own])

    def pairs_of(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sorted keys of the different pairs."""
        rest = np.repeat(starts + sizes, sizes) - np.arange(sizes.sum()) - 1 if len(sizes) else np.empty(0, np.int64)
        one = np.repeat(np.arange(len(rest)), rest)
        x, y = values[one], values[one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(rest) - rest, rest)]
        keys = np.unique((np.minimum(x, y) << 32) | np.maximum(x, y))
        return keys[(keys >> 32) != (keys & 0xFFFFFFFF)]

    def packed(batches):
        held, n = [], 0

        def rows():
            found = list(by_block(np.unique(np.concatenate(held)))) if held else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.binary())], ["block", "data"])

        for b in batches:
            a = b.column("a")
            values, sizes = a.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(a.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            made = np.cumsum(sizes * (sizes - 1) // 2)
            at = 0
            while at < len(sizes):  # about step pairs at a time
                to = max(at + 1, int(np.searchsorted(made, (made[at - 1] if at else 0) + step, "right")))
                held.append(pairs_of(values[starts[at] : starts[to - 1] + sizes[to - 1]], starts[at:to] - starts[at], sizes[at:to]))
                n, at = n + len(held[-1]), to
                if n >= 2 * step:
                    yield rows()
                    held, n = [], 0
        yield rows()

    def merged(block: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(np.concatenate([(u << 32) | v for u, v in map(_unpack, block["data"])]))
        return pd.DataFrame({"i": [int(block["block"].iloc[0]) // colours], "j": [int(block["block"].iloc[0]) % colours], "data": [_pack(keys >> 32, keys & 0xFFFFFFFF)]})

    return lists.select("a").mapInArrow(packed, "block int, data binary").groupBy(F.col("block").alias("_block")).applyInPandas(merged, "i int, j int, data binary")


def _triangles(blocks: DataFrame, colours: int) -> DataFrame:
    """One row: the number of triangles. A cell of three colours counts the triangles of just these from the blocks of the edges
    between them, in arrays; a packed block is copied once for each colour."""
    third = F.explode(F.sequence(F.lit(0), F.lit(colours - 1)))
    cells = blocks.select("*", third.alias("c")).select(F.array_sort(F.array("i", "j", "c")).alias("cell"), "data")

    def count(cell: pd.DataFrame) -> pd.DataFrame:
        u, v = (np.concatenate(x) for x in zip(*map(_unpack, cell["data"]), strict=True))
        own, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
        colour, m = _colour(own, colours)[codes], len(u)
        return pd.DataFrame({"n": [_closed([int(x) for x in cell["cell"].iloc[0]], codes[:m], codes[m:], colour[:m], colour[m:])]})

    return cells.groupBy(F.col("cell").alias("_cell")).applyInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triangles"))


def _degrees(blocks: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for data in b.column("data").to_pylist():
                nodes, counts = np.unique(np.concatenate(_unpack(data)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts)], ["node", "degree"])

    return blocks.select("data").mapInArrow(run, "node long, degree long").groupBy("node").agg(F.sum("degree").alias("degree"))


def transitivity(pairs: DataFrame, cell_edges: int = 1 << 20) -> DataFrame:
    """Three times the triangles over the connected triples."""
    pairs = cut(pairs.select("u", "v"))
    number = _numbers(neighbours(pairs).select(F.col("u").alias("node")))
    of = lambda c: number.select(F.col("node").alias(c), F.col("number").alias(f"n{c}"))
    return _transitivity(cut(pairs.join(of("u"), "u").join(of("v"), "v").select(F.array("nu", "nv").alias("a")), pairs, number), cell_edges)


def transitivity_of_lists(authors: DataFrame, cell_edges: int = 1 << 20) -> DataFrame:
    """As ``transitivity``, of the graph of all pairs of nodes that a list has (paper_id, node_id)."""
    number = _numbers(authors.select(F.col("node_id").alias("node")))
    lists = authors.join(number.withColumnRenamed("node", "node_id"), "node_id").groupBy("paper_id").agg(F.collect_set("number").alias("a"))
    return _transitivity(cut(lists.filter("size(a) > 1").select("a"), number), cell_edges)


def _numbers(nodes: DataFrame) -> DataFrame:
    return cut(numbered(nodes.distinct(), "node", "number").select("node", F.col("number").cast("int").alias("number")))


def _transitivity(lists: DataFrame, cell_edges: int) -> DataFrame:
    most = lists.agg(F.sum(F.size("a").cast("long") * (F.size("a") - 1) / 2)).first()[0] or 0
    colours = max(4, math.ceil(math.sqrt(6 * most / cell_edges)))
    blocks = cut(_blocks(lists, colours), lists)
    triples = _degrees(blocks).agg(F.coalesce(F.sum(F.col("degree") * (F.col("degree") - 1) / 2), F.lit(0.0)).alias("triples"))
    return _triangles(blocks, colours).crossJoin(triples).select("triangles", F.col("triples").cast("bigint").alias("triples"), (3 * F.col("triangles") / F.nullif("triples", F.lit(0.0))).alias("transitivity"))  # one row each


def density(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs over the possible pairs of the nodes, isolates included."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("n")), pairs.agg(F.count(F.lit(1)).alias("m"))
    return m.crossJoin(n).select((2 * F.col("m") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("density"))  # one row each


def modularity(pairs: DataFrame, partition: DataFrame, weight: str) -> DataFrame:
    """Q of a partition (node, community): share of weight inside, less what the communities' totals let expect."""
    u, v = (partition.toDF(c, f"c{c}") for c in ("u", "v"))
    e = pairs.join(u, "u").join(v, "v").withColumn("w", F.col(weight).cast("double"))
    ends = e.select(F.col("cu").alias("c"), "w").union(e.select("cv", "w")).groupBy("c").agg(F.sum("w").alias("k"))
    inside = e.agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("m"))
    return ends.crossJoin(inside).groupBy("i", "m").agg(F.sum(F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("x")).select((F.col("i") / F.col("m") - F.col("x")).alias("modularity"))  # inside: one row


def community_graph(pairs: DataFrame, partition: DataFrame) -> DataFrame:
    """Edges between different communities."""
    u, v = (partition.toDF(c, f"c{c}") for c in ("u", "v"))
    e = pairs.join(u, "u").join(v, "v").filter("cu <> cv")
    return e.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.count(F.lit(1)).alias("edges"))


def same_attribute_share(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Of the pairs with both attributes (node, attribute) known, the share with equal ones."""
    known = attributes.filter("attribute IS NOT NULL")
    e = pairs.join(known.toDF("u", "au"), "u").join(known.toDF("v", "av"), "v")
    return e.agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("au") == F.col("av")).cast("double")).alias("same"))


def degree_bin(c):
    return F.when(c <= 1, "1").when(c == 2, "2").when(c <= 4, "3-4").when(c <= 8, "5-8").otherwise("9+")


# -- permutation tests ---------------------------------------------------------------------------------------------------------


def draw_keys(seed: str, draws: int, rounds: int) -> np.ndarray:
    """Three numbers under 2^31 for each draw and round: the first hexadecimal digits of the MD5 of seed, draw and round."""
    digests = (hashlib.md5(f"{seed}|{d}|{r}".encode()).hexdigest() for d in range(draws) for r in range(rounds))
    return np.array([[int(h[8 * k : 8 * k + 8], 16) & 0x7FFFFFFF for k in range(3)] for h in digests], np.int64).reshape(draws, rounds, 3)


def shuffled(places: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each of the places (of 0 to size - 1) goes in each draw: rows by places, columns by draws. In every round each place has
    one partner, and a bit that both agree on says whether they swap; so a draw permutes the places of a size, and any place can be
    followed alone."""
    own, at = np.unique(sizes, return_inverse=True)
    whole, bits, last = (np.int32, np.uint32, 31) if own.max(initial=0) < 1 << 31 else (np.int64, np.uint64, 63)
    x, n = np.repeat(places.astype(whole)[:, None], len(keys), 1), sizes.astype(whole)[:, None]
    for r in range(keys.shape[1]):
        a, b, k = keys[:, r].T
        turn = (k % own[:, None]).astype(whole)
        partner = (turn[at] if len(own) > 1 else turn) - x
        partner += (partner >> last) & n  # below 0: the same, modulo n
        met = np.maximum(x, partner).view(bits)
        met *= a.astype(bits)  # modulo a power of two above the bit that is asked for
        met += b.astype(bits)
        met >>= bits(30)
        met &= bits(1)
        partner ^= x
        partner &= -met.view(whole)
        x ^= partner
    return x


def permutation_test(pairs: DataFrame, people: DataFrame, attributes: list[str], draws: int = 1000, seed: str = "0", stratum: str | None = None, rounds: int = 20, local_values: int = 1 << 23) -> DataFrame:
    """attribute, pairs, observed, mean, low, high (2.5 and 97.5 percentiles), p of the share of pairs with equal attributes, when the
    known attributes of the graph's people (node, attributes) are shuffled ``draws`` times, within the column ``stratum`` if given.

    People are numbered within attribute and stratum, and values within an attribute. A task follows the two places of a pair through
    all draws at once and leaves a sum for each draw. It finds the values there in an array of all of their numbers, in the least
    type that holds them, while these have at most the bytes of ``local_values`` integers; executors pack their parts of it, so the
    driver holds nothing else. With more of them, the places are joined with the values, draw by draw."""
    spark = pairs.sparkSession
    seen = neighbours(pairs).select(F.col("u").alias("node")).distinct()
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]))
    known = people.join(seen, "node", "left_semi").select("node", (F.col(stratum).cast("string") if stratum else F.lit("")).alias("s"), each.alias("x")).select("node", "s", "x.*")
    known = known.filter("value IS NOT NULL AND s IS NOT NULL")
    places = cut(running(known, ["attribute", "s", "node"], {"g": F.lit(1)}).withColumn("g", F.col("g") - 1))
    groups = places.groupBy("attribute", "s").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("n"))
    kinds = cut(running(places.select("attribute", "value").distinct(), ["attribute", "value"], {"code": F.lit(1)}))
    kinds = kinds.join(kinds.groupBy("attribute").agg(F.min("code").alias("least")), "attribute").select("attribute", "value", (F.col("code") - F.col("least")).alias("code"))
    placed = cut(places.join(groups, ["attribute", "s"]).join(kinds, ["attribute", "value"]).select("attribute", "node", "code", "g", "start", "n"), places)
    end = lambda c: placed.select("attribute", *[F.col(x).alias(y) for x, y in (("node", c), ("code", f"code_{c}"), ("g", f"g_{c}"), ("start", f"start_{c}"), ("n", f"n_{c}"))])
    met = pairs.select("u", "v").join(end("u"), "u").join(end("v"), ["attribute", "v"])
    e = cut(met.withColumn("h", F.xxhash64("u")).drop("u", "v"))  # names are long, and nothing needs them any more
    real = e.groupBy("attribute").agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("code_u") == F.col("code_v")).cast("double")).alias("observed"))
    size, most = placed.agg(F.count(F.lit(1)), F.max("code")).first()
    least = np.min_scalar_type(most or 0)
    if size * least.itemsize <= 4 * local_values:

        def packed(batches):
            parts = [(b.column("g").to_numpy(), b.column("code").to_numpy().astype(least)) for b in batches if len(b)]
            if parts:
                g, code = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([g.min()]), pa.array([code[np.argsort(g)].tobytes()], pa.binary())], ["g", "codes"])

        parts = placed.select("g", "code").repartitionByRange("g").mapInArrow(packed, "g long, codes binary").collect()
        codes = spark.sparkContext.broadcast(np.concatenate([np.empty(0, least), *(np.frombuffer(r["codes"], least) for r in sorted(parts))]))

        def run(batches):
            keys = draw_keys(seed, draws, rounds)
            tile = max(1, (1 << 15) // draws)
            for b in batches:
                attribute = np.array(b.column("attribute").to_pylist(), object)
                g, start, n = (np.concatenate([b.column(f"{x}_{c}").to_numpy() for c in "uv"]) for x in ("g", "start", "n"))
                nodes, first, where = np.unique(g, return_index=True, return_inverse=True)
                starts = start[first]
                place, at = np.unique(np.stack([n[first], nodes - starts]), axis=1, return_inverse=True)  # one walk for all that have it
                at = at.ravel()
                order, ends = np.argsort(at, kind="stable"), np.searchsorted(np.sort(at), np.arange(0, place.shape[1] + tile, tile))
                drawn = np.empty((len(nodes), draws), least)
                for k in range(len(ends) - 1):
                    to, own = shuffled(place[1, k * tile : (k + 1) * tile], place[0, k * tile : (k + 1) * tile], keys), order[ends[k] : ends[k + 1]]
                    drawn[own] = codes.value[starts[own, None] + to[at[own] - k * tile]]
                one, other = where[: len(b)], where[len(b) :]
                for a in set(attribute.tolist()):
                    own, same = np.flatnonzero(attribute == a), np.zeros(draws, np.int64)
                    for part in np.array_split(own, len(own) // 255 + 1):
                        same += (drawn[one[part]] == drawn[other[part]]).view(np.uint8).sum(0, dtype=np.uint8)  # 255 at most
                    yield pa.RecordBatch.from_arrays([pa.array([a] * draws), pa.array(np.arange(draws)), pa.array(same)], ["attribute", "draw", "same"])

        narrow = e.select("h", "attribute", *[f"{x}_{c}" for x in ("g", "start", "n") for c in "uv"])
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil(e.count() * draws / (1 << 28)))
        near = narrow.repartitionByRange(tasks, "h").sortWithinPartitions("h").drop("h")  # a node's pairs are in one batch
        null = near.mapInArrow(run, "attribute string, draw long, same long").groupBy("attribute", "draw").agg(F.sum("same").alias("same"))
    else:

        def go(batches):
            keys = draw_keys(seed, draws, rounds)
            for whole in batches:
                for b in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                    to = [b.column(f"start_{c}").to_numpy()[:, None] + shuffled(b.column(f"g_{c}").to_numpy() - b.column(f"start_{c}").to_numpy(), b.column(f"n_{c}").to_numpy(), keys) for c in "uv"]
                    yield pa.RecordBatch.from_arrays([b.column("attribute").take(pa.array(np.repeat(np.arange(len(b)), draws))), pa.array(np.tile(np.arange(draws), len(b))), *(pa.array(t.ravel()) for t in to)], ["attribute", "draw", "gu", "gv"])

        moved = e.mapInArrow(go, "attribute string, draw long, gu long, gv long")
        value = lambda c: placed.select(F.col("g").alias(f"g{c}"), F.col("code").alias(f"code_{c}"))
        met = moved.join(value("u"), "gu").join(value("v"), "gv")
        null = met.groupBy("attribute", "draw").agg(F.sum((F.col("code_u") == F.col("code_v")).cast("long")).alias("same"))
    null, real = cut(null), cut(real)  # a row for each draw, and for each attribute
    drop(e, placed)
    d = null.join(real, "attribute").withColumn("share", F.col("same") / F.col("pairs"))
    at = lambda q: F.percentile("share", F.lit(q))  # noqa: E731  over the draws
    return d.groupBy("attribute", "pairs", "observed").agg(F.avg("share").alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"), ((F.count_if(F.col("share") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


# -- communities ---------------------------------------------------------------------------------------------------------------


def _coin(*parts) -> Column:
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), F.lit(2)) == 1


def _moved(edges: DataFrame, part: DataFrame, twice: float, seed: int, level: int, most_rounds: int) -> tuple[DataFrame, float]:
    """part (node, k, loop, c) after nodes have moved to the neighbouring communities that raise modularity most, and its modularity.

    In a round all gains come from one join of the edges with the communities. A node moves by the toss of a coin, so that neighbours
    don't swap places for ever; where moves made at the same time lower modularity, the best partition so far is taken back. It ends
    when hardly any node would still move, or rounds bring nothing."""
    spent = [cut(part)]
    part = spent[0].select("node", "k", "loop", "c")
    best, idle = (-1.0, part), 0
    for turn in range(most_rounds):
        total = part.groupBy("c").agg(F.sum("k").alias("sum"))
        near = edges.join(part.select(F.col("node").alias("v"), F.col("c").alias("to")), "v").groupBy(F.col("u").alias("node"), "to").agg(F.sum("w").alias("w"))
        offers = near.join(part.select("node", F.col("k").alias("_k"), F.col("c").alias("_c")), "node").join(total.withColumnsRenamed({"c": "to", "sum": "sum_to"}), "to")
        here, value = F.col("to") == F.col("_c"), F.col("w") - F.col("_k") * F.col("sum_to") / twice
        offers = offers.groupBy("node").agg(F.sum(F.when(here, F.col("w"))).alias("inside"), F.max(F.when(~here, value)).alias("gain"), F.max_by("to", F.when(~here, F.struct(value, F.xxhash64("to", F.lit(turn))))).alias("to"))
        own = part.join(total, "c").join(offers, "node", "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
        keep = F.col("inside") - F.col("k") * (F.col("sum") - F.col("k")) / twice
        better = F.coalesce(F.col("gain") > keep + 1e-9, F.lit(False))
        chosen = cut(own.withColumns({"better": better, "moves": better & _coin("node", seed, level, turn)}))
        spent.append(chosen)
        nodes, inside, squares, wishes = chosen.agg(F.count(F.lit(1)), F.sum(F.col("inside") + 2 * F.col("loop")), F.sum(F.col("k") * F.col("sum")), F.count_if("better")).first()
        q = inside / twice - squares / twice**2
        idle = 0 if q > best[0] + 1e-6 else idle + 1
        if q > best[0]:
            best = (q, part)
        if wishes <= nodes // 500 or idle == 2:
            break
        part = chosen.select("node", "k", "loop", F.when(F.col("moves"), F.col("to")).otherwise(F.col("c")).alias("c"))
    return cut(best[1], *spent), best[0]


def _refined(edges: DataFrame, part: DataFrame, twice: float, seed: int, level: int, most_rounds: int) -> DataFrame:
    """part with sub, a connected part of each community, built up from single nodes.

    In a round some of the single nodes that are well tied to the rest of their community join a part of it; only parts of which no
    node leaves in this round can be joined, so every part stays connected. Among the parts that raise modularity one is drawn, the
    likelier the more it does."""
    inner = edges.join(part.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(part.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").filter("cu = cv").select("u", "v", "w")
    inner = cut(inner)
    whole = part.groupBy("c").agg(F.sum("k").alias("sum"))
    tied = inner.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("inside"))
    well = F.coalesce(F.col("inside"), F.lit(0.0)) >= F.col("k") * (F.col("sum") - F.col("k")) / twice
    n = part.count()
    sub = cut(part.join(whole, "c").join(tied, "node", "left").select("node", "k", "loop", "c", F.col("node").alias("sub"), F.lit(True).alias("alone"), well.alias("well")))
    for turn in range(min(most_rounds, 6)):
        leaves = F.col("alone") & F.col("well") & _coin("node", seed, level, turn, 1)
        marked = sub.withColumn("leaves", leaves)
        open_ = marked.filter(~F.col("leaves")).groupBy("sub").agg(F.sum("k").alias("sum"))
        ways = inner.join(marked.filter("leaves").select(F.col("node").alias("u"), "k"), "u").join(marked.filter(~F.col("leaves")).select(F.col("node").alias("v"), "sub"), "v")
        ways = ways.groupBy(F.col("u").alias("node"), "k", F.col("sub").alias("to")).agg(F.sum("w").alias("w")).join(open_.withColumnRenamed("sub", "to"), "to")
        gain = F.col("w") - F.col("k") * F.col("sum") / twice
        luck = -F.log(-F.log((F.pmod(F.xxhash64("node", "to", F.lit(seed), F.lit(turn)), F.lit(1 << 30)) + 0.5) / (1 << 30)))
        drawn = ways.withColumn("gain", gain).filter("gain >= 0").groupBy("node").agg(F.max_by("to", F.struct(F.col("gain") / 0.01 + luck, "to")).alias("to"))
        joined = sub.join(drawn, "node", "left")
        met = drawn.select(F.col("to").alias("sub")).distinct().withColumn("met", F.lit(True))
        alone = F.col("alone") & F.col("to").isNull() & F.col("met").isNull()
        after = cut(joined.join(met, "sub", "left").select("node", "k", "loop", "c", F.coalesce("to", "sub").alias("sub"), alone.alias("alone"), "well", F.col("to").isNotNull().alias("new")))
        joins = after.filter("new").count()
        drop(sub)
        sub = after
        if joins <= n // 500 and turn % 2:
            break
    drop(inner)
    return sub.select("node", "k", "loop", "c", "sub")


def _settled(near: list[dict[int, float]], k: list[float], part: list[int], twice: float, rng: random.Random) -> list[int]:
    """part after single moves that raise modularity, node by node, until none does."""
    total: dict[int, float] = defaultdict(float)
    for x, c in enumerate(part):
        total[c] += k[x]
    todo, waits = deque(rng.sample(range(len(near)), len(near))), [True] * len(near)
    while todo:
        x = todo.popleft()
        waits[x] = False
        ties: dict[int, float] = defaultdict(float)
        for y, w in near[x].items():
            ties[part[y]] += w
        total[part[x]] -= k[x]
        value = {c: w - k[x] * total[c] / twice for c, w in ties.items()}
        value.setdefault(part[x], -k[x] * total[part[x]] / twice)
        to = max(value, key=lambda c: value[c])
        if value[to] > value[part[x]] + 1e-9:
            part[x] = to
            for y in near[x]:
                if part[y] != to and not waits[y]:
                    waits[y] = True
                    todo.append(y)
        total[part[x]] += k[x]
    return part


def _split(near: list[dict[int, float]], part: list[int]) -> list[int]:
    """The connected pieces of the parts."""
    piece = [-1] * len(near)
    for s in range(len(near)):
        if piece[s] < 0:
            piece[s], todo = s, [s]
            for x in todo:
                for y in near[x]:
                    if piece[y] < 0 and part[y] == part[x]:
                        piece[y] = s
                        todo.append(y)
    return piece


def _communities_within(twice: float, seed: int, tries: int = 5):
    """Communities of a component: nodes move until none wants to, their parts, in connected pieces, are the nodes of the next graph,
    and so on; at last single nodes move once more. The best of a few orders counts."""

    def measure(nodes: list[str], near: list[list[tuple[int, float]]]):
        ties: list[dict[int, float]] = [dict(x) for x in near]
        k, best = [sum(t.values()) for t in ties], (-math.inf, [])
        for t in range(tries):
            rng = random.Random(f"{seed}|{t}|{min(nodes)}")
            part = list(range(len(nodes)))
            while True:
                part = _split(ties, _settled(ties, k, part, twice, rng))
                name = {c: i for i, c in enumerate(dict.fromkeys(part))}
                lifted: list[dict[int, float]] = [defaultdict(float) for _ in name]
                weight = [0.0] * len(name)
                for x, c in enumerate(part):
                    weight[name[c]] += k[x]
                    for y, w in ties[x].items():
                        if part[y] != c:
                            lifted[name[c]][name[part[y]]] += w
                over = _settled(lifted, weight, list(range(len(name))), twice, rng)
                if over == list(range(len(name))):
                    break
                part = [over[name[c]] for c in part]
            inside, sums = 0.0, defaultdict(float)
            for x, c in enumerate(part):
                sums[c] += k[x]
                inside += sum(w for y, w in ties[x].items() if part[y] == c)
            best = max(best, (inside / twice - sum((z / twice) ** 2 for z in sums.values()), part), key=lambda b: b[0])
        least: dict[int, str] = {}
        for x, c in zip(nodes, best[1], strict=True):
            least[c] = min(x, least.get(c, x))
        return [(x, least[c]) for x, c in zip(nodes, best[1], strict=True)]

    return measure


def leiden(pairs: DataFrame, weight: str = "count", seed: int = 0, most_levels: int = 10, most_rounds: int = 20, components: DataFrame | None = None, local_edges: int = 1 << 11, local_nodes: int = 1 << 22) -> DataFrame:
    """node, community (its least node) of the nodes with a pair: communities of high weighted modularity, each connected.

    No community reaches beyond a component. Components (node, component; found if not given) of at most ``local_edges`` pairs are
    each treated within a task, many in one. Where the others have at most ``local_nodes`` nodes in all, their communities are arrays
    that all tasks read; with more, joins along their edges find them. Gains are those of the whole graph in all cases."""
    both = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col(weight).cast("double").alias("w")).filter("u <> v")
    each = cut(both.groupBy("u", "v").agg(F.sum("w").alias("w")))
    twice = 2 * (each.agg(F.sum("w")).first()[0] or 0.0)
    if not twice:
        return _leiden_by_joins(each, 0.0, seed, most_levels, most_rounds)
    small, large = _by_size(each, components, local_edges)
    found = _each_component(small, _communities_within(twice, seed), "node string, community string")
    nodes = neighbours(large).select(F.col("u").alias("node")).distinct()
    n = nodes.count()
    if not n:
        return found
    rest = _leiden_by_arrays(large, nodes, twice, seed, most_levels, most_rounds) if n <= local_nodes else _leiden_by_joins(large, twice, seed, most_levels, most_rounds)
    return found.union(rest)


def _ranges_of(edges: DataFrame) -> DataFrame:
    """Edges (u, v numbers, w) as one packed row for each range of u, which has all edges of its nodes."""

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if len(b)]
        if tables:
            u, v, w = (pa.concat_tables(tables).column(c).to_numpy() for c in ("u", "v", "w"))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (u.astype(np.int32).tobytes(), v.astype(np.int32).tobytes(), w.tobytes())], ["u", "v", "w"])

    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(edges.count() / (1 << 20)))
    return cut(edges.repartitionByRange(tasks, "u").mapInArrow(run, "u binary, v binary, w binary"))


def _ask(ranges: DataFrame, answer, *state) -> list[np.ndarray]:
    """The arrays that ``answer`` gives for each range of nodes from its edges and the state, which all tasks read, end to end."""
    told = ranges.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        for b in batches:
            for u, v, w in zip(*(b.column(c).to_pylist() for c in "uvw"), strict=True):
                arrays = answer(np.frombuffer(u, np.int32).astype(np.int64), np.frombuffer(v, np.int32).astype(np.int64), np.frombuffer(w, np.float64), *told.value)
                yield pa.RecordBatch.from_arrays([pa.array([[a.dtype.str for a in arrays]]), pa.array([[a.tobytes() for a in arrays]], pa.list_(pa.binary()))], ["kinds", "data"])

    rows = ranges.mapInArrow(run, "kinds array<string>, data array<binary>").collect()
    told.destroy()
    return [np.concatenate([np.frombuffer(r["data"][i], r["kinds"][i]) for r in rows]) for i in range(len(rows[0]["data"]))]


def _ties(u: np.ndarray, to: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, community and their summed weight."""
    keys, at = np.unique(u * n + to, return_inverse=True)
    return keys // n, keys % n, np.bincount(at, w, len(keys))


def _last(node: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Where each node's greatest row is, by several columns, the first one first."""
    order = np.lexsort((*by[::-1], node))
    return order[np.diff(node[order], append=-1) != 0]


def _offers(u, v, w, c, total, k, twice, turn):
    """Nodes that would move, where to, and the weight between nodes of one community."""
    node, to, tie = _ties(u, c[v], w, len(c))
    own, inside = to == c[node], np.zeros(int(u.max()) + 1)
    inside[node[own]] = tie[own]
    node, to, tie = node[~own], to[~own], tie[~own]
    value = tie - k[node] * total[to] / twice
    at = _last(node, value, ((to + 1) * (2 * turn + 1) * 0x9E3779B1) & 0xFFFFFFFF)
    node, to, value = node[at], to[at], value[at]
    better = value > inside[node] - k[node] * (total[c[node]] - k[node]) / twice + 1e-9
    return node[better].astype(np.int32), to[better].astype(np.int32), np.array([inside.sum()])


def _inside(u, v, w, c):
    own = c[u] == c[v]
    node, at = np.unique(u[own], return_inverse=True)
    return node.astype(np.int32), np.bincount(at, w[own], len(node))


def _ways(u, v, w, c, sub, leaves, open_, k, twice, seeds):
    """Nodes that leave, and the part of their community that they join."""
    here = leaves[u] & ~leaves[v] & (c[u] == c[v])
    node, to, tie = _ties(u[here], sub[v[here]], w[here], len(c))
    gain = tie - k[node] * open_[to] / twice
    node, to, gain = node[gain >= 0], to[gain >= 0], gain[gain >= 0]
    luck = np.random.default_rng([*seeds, int(u.min())]).gumbel(size=len(node))
    at = _last(node, gain / 0.01 + luck, to)
    return node[at].astype(np.int32), to[at].astype(np.int32)


def _leiden_by_arrays(pairs: DataFrame, nodes: DataFrame, twice: float, seed: int, most_levels: int, most_rounds: int) -> DataFrame:
    """As ``_leiden_by_joins``, for so few nodes that an array with a number for each can be read by all tasks.

    Edges stay with the tasks, packed by ranges of nodes. In a round each task tells which of its nodes would move and where to; the
    driver tosses the coins and has the arrays of communities, strengths and parts, but no edge."""
    number = _numbers(nodes)
    of = lambda c: number.select(F.col("node").alias(c), F.col("number").alias(f"n{c}"))
    one = cut(pairs.join(of("u"), "u").join(of("v"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"), "w"))
    ranges = _ranges_of(one.union(one.select("v", "u", "w")))
    drop(one)
    n = number.count()
    node, sums = _ask(ranges, _inside, np.zeros(n, np.int32))
    k = np.bincount(node, sums, n)
    loop, c, place, best = np.zeros(n), np.arange(n), np.arange(n), -1.0
    for level in range(most_levels):
        coin = lambda *turn: np.random.default_rng([seed, level, *turn]).random(len(k)) < 0.5  # noqa: B023, E731
        top, idle = (-1.0, c), 0
        for turn in range(most_rounds):
            total = np.bincount(c, k, n)
            wish, to, inside = _ask(ranges, _offers, c, total, k, twice, turn)
            q = (inside.sum() + 2 * loop.sum()) / twice - (total**2).sum() / twice**2
            idle = 0 if q > top[0] + 1e-6 else idle + 1
            if q > top[0]:
                top = (q, c)
            if len(wish) <= n // 500 or idle == 2:
                break
            goes, c = coin(turn)[wish], c.copy()
            c[wish[goes]] = to[goes]
        q, c = top
        found = c[place]
        if len(np.unique(c)) == n or q <= best + 1e-9:
            break
        best = q
        node, sums = _ask(ranges, _inside, c)
        well = np.bincount(node, sums, n) >= k * (np.bincount(c, k, n)[c] - k) / twice
        sub, alone = np.arange(n), np.ones(n, bool)
        for turn in range(min(most_rounds, 6)):
            leaves = alone & well & coin(turn, 1)
            node, to = _ask(ranges, _ways, c, sub, leaves, np.bincount(sub[~leaves], k[~leaves], n), k, twice, (seed, level, turn))
            met = np.zeros(n, bool)
            met[to] = True
            alone &= ~met[sub]
            alone[node] = False
            sub[node] = to
            if len(node) <= n // 500 and turn % 2:
                break
        parts, to = np.unique(sub, return_inverse=True)
        if len(parts) == n:
            break
        ranges, (node, sums) = _lifted(ranges, to)
        n, place = len(parts), to[place]
        k, loop, c = np.bincount(to, k, n), np.bincount(to, loop, n) + np.bincount(node, sums / 2, n), np.unique(c[parts], return_inverse=True)[1]
    drop(ranges)
    least = np.full(len(k) if len(k) > found.max() else int(found.max()) + 1, len(found))
    np.minimum.at(least, found, np.arange(len(found)))
    told = pairs.sparkSession.sparkContext.broadcast(least[found].astype(np.int32))

    def named(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(told.value[b.column("number").to_numpy()])], ["node", "number"])

    return number.mapInArrow(named, "node string, number int").join(number.select("number", F.col("node").alias("community")), "number").select("node", "community")


def _lifted(ranges: DataFrame, to: np.ndarray) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Edges between the parts that nodes are now in (summed in the tasks before they are shuffled), and the weight within each part."""
    told = ranges.sparkSession.sparkContext.broadcast(to)

    def run(batches):
        for b in batches:
            for u, v, w in zip(*(b.column(c).to_pylist() for c in "uvw"), strict=True):
                a, z, tie = _ties(told.value[np.frombuffer(u, np.int32)], told.value[np.frombuffer(v, np.int32)], np.frombuffer(w, np.float64), len(told.value))
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32)), pa.array(tie)], ["u", "v", "w"])

    after = cut(ranges.mapInArrow(run, "u int, v int, w double").groupBy("u", "v").agg(F.sum("w").alias("w")), ranges)
    within = after.filter("u = v").select("u", "w").toArrow()
    out = _ranges_of(after.filter("u <> v"))
    drop(after)
    return out, (within.column("u").to_numpy(), within.column("w").to_numpy())


def _leiden_by_joins(pairs: DataFrame, twice: float, seed: int, most_levels: int, most_rounds: int) -> DataFrame:
    """As ``leiden``, from pairs (u, v, w); twice: the weight of the whole graph, both ways.

    As in the method of that name, nodes move between communities, communities are refined into connected parts, and the graph of the
    parts, which start from the communities found, is treated in the same way, until no part moves. All of it are joins and
    aggregations along the edges: the largest group is the list of communities next to a node."""
    edges = cut(pairs.select("u", "v", "w").union(pairs.select("v", "u", "w")))
    part = edges.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")).withColumns({"loop": F.lit(0.0), "c": F.col("node")})
    place = cut(part.select("node", F.col("node").alias("unit")))
    best, found = -1.0, place
    for level in range(most_levels):
        lifted, (part, q) = part, _moved(edges, part, twice, seed, level, most_rounds) if twice else (cut(part), 0.0)
        found = cut(place.join(part.select(F.col("node").alias("unit"), "c"), "unit").select("node", "c"), *([found, lifted] if level else []))
        n, groups = part.agg(F.count(F.lit(1)), F.count_distinct("c")).first()
        if groups == n or q <= best + 1e-9:
            break
        best = q
        parts = cut(_refined(edges, part, twice, seed, level, most_rounds))
        if parts.select("sub").distinct().count() == n:
            drop(parts)
            break
        of = parts.select("node", "sub")
        place = cut(place.join(of.withColumnRenamed("node", "unit"), "unit").select("node", F.col("sub").alias("unit")), place)
        lifted = edges.join(of.toDF("u", "su"), "u").join(of.toDF("v", "sv"), "v").groupBy("su", "sv").agg(F.sum("w").alias("w"))
        lifted = cut(lifted, edges)
        loops = lifted.filter("su = sv").select(F.col("su").alias("node"), (F.col("w") / 2).alias("more"))
        nodes = parts.groupBy(F.col("sub").alias("node")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"), F.min("c").alias("c"))
        part = cut(nodes.join(loops, "node", "left").select("node", "k", (F.col("loop") + F.coalesce("more", F.lit(0.0))).alias("loop"), "c"), part, parts)
        edges = cut(lifted.filter("su <> sv").toDF("u", "v", "w"), lifted)
    drop(place, part, edges)
    least = found.groupBy("c").agg(F.min("node").alias("community"))
    return found.join(least, "c").select("node", "community")

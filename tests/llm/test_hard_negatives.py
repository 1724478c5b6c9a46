"""Hard negatives against all scores by brute force, with trees of many leaves, chunks and buckets."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coweave.llm import hard_negatives as H
from coweave.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string, anchor string"


def brute(rows, positives=5, negatives=5, low=80):
    """rows: (id, label, vector of floats)."""
    taking = sorted({(i, lab, tuple(math.floor(256 * c) for c in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    x = np.zeros((len(taking), max((len(r[2]) for r in taking), default=0)), np.int64)
    for k, r in enumerate(taking):
        x[k, : len(r[2])] = r[2]
    ids, labels, out = np.array([r[0] for r in taking]), np.array([r[1] for r in taking]), set()
    for k in range(len(taking)):
        if ids[k] % 100:
            continue
        s = x @ x[k]
        order = np.lexsort((ids, -s))
        near = [j for j in order if labels[j] == labels[k] and j != k]
        for p in near[:positives]:
            hard = [j for j in order if labels[j] != labels[k] and low * s[p] <= 100 * s[j] <= 100 * s[p]]
            for rank, j in enumerate(hard[:negatives], 1):
                out.add((int(ids[k]), int(ids[p]), rank, int(ids[j]), int(s[p]), int(s[j])))
    return out


def single(x):
    return np.float32(x).item()


def vectors(seed, n, dim, centres=12, spread=0.3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    own = rng.integers(centres, size=n)
    x = c[own] + spread * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.where(rng.random(n) < 0.7, own % 5, rng.integers(5, size=n))
    return [(int(i), int(labels[k]), [single(v) for v in x[k]]) for k, i in enumerate(rng.permutation(n) * 4)]


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, lab, 1, "v", "a") for i, lab, v in rows], SCHEMA).repartition(5)
    return H.mine(df, F.col("vec_id") % 100 == 0, **options)


@pytest.fixture
def small_parts(monkeypatch):
    for name, value in (("SAMPLE", 300), ("CHUNK", 64), ("QUERIES", 16), ("BUCKET", 8)):
        monkeypatch.setattr(H, name, value)


@pytest.mark.parametrize(("dim", "centres", "spread"), [(8, 12, 0.2), (32, 3, 1.0)])
def test_equals_brute_force(spark, small_parts, dim, centres, spread):
    rows = vectors(dim, 2500, dim, centres, spread)
    got = [tuple(r) for r in mined(spark, rows).collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want and len(want) > 500


def test_edge_rows(spark, small_parts):
    rng = random.Random(3)
    rows = vectors(1, 300, 4)
    same = rows[0][2]
    rows += [(5000 + i, i % 3, same) for i in range(200)]  # a frequent vector, two anchors of each label
    rows += [(0, 1, [0.0] * 4), (100, None, same), (200, 1, None), (300, 1, [math.nan, 0.0, 0.0, 0.0]), (400, 1, [math.inf, 0.0, 0.0, 0.0]), (500, 1, [None, 0.0, 0.0, 0.0]), (None, 1, same)]
    rows += [(600, 2, [0.5]), (700, 2, []), (800, 3, [-0.5, 0.25, 0.0, 0.0]), (800, 3, [0.5, 0.25, 0.0, 0.0]), (900, 1, [7.0, -3.0, 0.5, 0.25]), rows[5], rows[6], rows[6]]
    rows += [(2000 + i, rng.randrange(3), [rng.choice((-0.25, 0.0, 0.25)) for _ in range(4)]) for i in range(150)]  # ties
    got = [tuple(r) for r in mined(spark, rows).collect()]
    assert set(got) == brute(rows)
    some = dict(positives=2, negatives=7, low_percent=33)
    assert {tuple(r) for r in mined(spark, rows, **some).collect()} == brute(rows, 2, 7, 33)


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, []).collect() == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]).collect() == []
    assert mined(spark, [(100, 1, [1.0])]).collect() == []


def test_too_large_codes_raise(spark):
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(100, 1, [1e30]), (2, 1, [1.0])])


def test_parts_outside_the_annulus_are_not_read():
    """A walk touches fewer rows than there are, and finds what a scan finds."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.05, size=(400, 6)) for c in (-1.0, 0.0, 1.0, 2.0)]))
    space = H.Space(float((x * x).sum(1).max()))
    tree = H.Tree(space, x, 16)
    read = []

    class Rows(np.ndarray):
        def __getitem__(self, k):
            read.append(np.size(k))
            return np.asarray(super().__getitem__(k))

    ids = [[i] for i in range(len(x))]
    for q in x[::100]:
        s = x @ q
        d = tree.from_points(q[None], np.zeros(1))[0]
        lo, hi = 0.8 * s.max(), 0.95 * s.max()
        read.clear()
        got = H.walk(tree, x.view(Rows), np.ones(len(x), bool), ids, q, d, lo, hi, 5)
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if lo <= s[i] <= hi]
        assert got == [(int(i), int(s[i])) for i in order[:5]]
        assert sum(read) < len(x)


def test_query(spark, sf):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["label"] is not None and r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op12_hard_negatives"](spark, sf).collect()]
    assert Counter(got) == Counter(brute(rows)) and got

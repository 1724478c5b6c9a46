"""Connected components: in one task while the distinct edges are few, else by alternating large and small stars.

The first way holds at most ``local_edges`` edges, counted beforehand, in an executor; the second has no such bound. Both give
the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component, by hooking and jumping."""
    lab = np.arange(n)
    while True:
        old = lab.copy()
        m = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, a, m)
        np.minimum.at(lab, b, m)
        np.minimum.at(lab, old, lab.copy())
        lab = lab[lab]
        if (lab == old).all():
            return lab


def components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = 1 << 20) -> DataFrame:
    """key, root (the least key of its component) of every end of an edge (pairs of long; loops and repeats may occur)."""
    e = materialize(edges.filter(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    if e.count() > local_edges:
        return _by_stars(e)
    out = materialize(_in_one_task(e), "components")
    discard(e)
    return out


def _in_one_task(e: DataFrame) -> DataFrame:
    def run(batches):
        got = list(batches)
        if got:
            t = pa.Table.from_batches(got)
            u, v = (t[c].to_numpy() for c in ("u", "v"))
            names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            lab = least_labels(len(names), at[: len(u)], at[len(u) :])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[lab])], ["key", "root"])

    return e.coalesce(1).mapInArrow(run, "key long, root long")


def _by_stars(e: DataFrame) -> DataFrame:
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "u", "m")
        hooked = small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        hooked = materialize(hooked, "edges")
        same = [d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (e, hooked)]
        discard(e)
        e = hooked
        if same[0] == same[1]:
            break
    out = materialize(e.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("root")).union(e.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()), "components")
    discard(e)
    return out

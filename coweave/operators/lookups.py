"""Lookups in outside services through caches: what is fetched once, found or not, is never fetched again.

The services are functions of the caller's, so nothing here opens a connection by itself; ``sources.rest`` has a data source that does,
with a budget and with answers that outlive a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..sources.rest import BudgetExhausted, Client  # noqa: F401  part of this interface
from .linkage import wanted_keys
from .papers import first_by


def fill_cache(wanted: DataFrame, cache: DataFrame, fetch: Callable[[list], dict], key: str, per_call: int = 50) -> DataFrame:
    """key, value: the cache with the wanted keys that it lacked, fetched ``per_call`` at a time; keys that were not found have a
    null value, so that they are not asked for again. fetch gives the values of those keys that it finds."""
    missing = wanted_keys(wanted, cache, key, per_call)
    kinds = dict(cache.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(pdf[key].tolist())
        found = fetch(keys)
        return pd.DataFrame({key: keys, "value": [found.get(k) for k in keys]})

    got = missing.groupBy("batch").applyInPandas(run, f"{key} {kinds[key]}, value {kinds['value']}")
    return cache.select(key, "value").unionByName(got)


def fetch_contents(urls: DataFrame, cache: DataFrame, fetch: Callable[[str], bytes | None]) -> DataFrame:
    """id (SHA-1 of the url), content: the cache with the contents that it lacked; empty where there is none."""
    wanted = urls.select("url").distinct().withColumn("id", F.sha1(F.col("url").cast("binary"))).join(cache.select("id"), "id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "content": [fetch(u) or b"" for u in b["url"]]})

    return cache.select("id", "content").unionByName(wanted.select("id", "url").mapInPandas(run, "id string, content binary"))


def _bags(texts: pd.Series) -> np.ndarray:
    """How many characters of each of 64 classes a text has."""
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    rows = np.repeat(np.arange(len(points)), [len(p) for p in points])
    flat = np.concatenate([np.zeros(0, np.uint32), *points]) % 64
    return np.bincount(rows * 64 + flat, minlength=64 * len(points)).reshape(len(points), 64)


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Whether the ratio of matching characters reaches ``least``. No ratio is above that of the characters two texts share in any
    order, so the blocks are only matched for pairs that pass this."""
    from difflib import SequenceMatcher

    known = (a.notna() & b.notna()).to_numpy()
    x, y = a.fillna(""), b.fillna("")
    size = x.str.len().to_numpy() + y.str.len().to_numpy()
    bound = 2 * np.minimum(_bags(x), _bags(y)).sum(1) >= least.to_numpy() * size
    out = np.zeros(len(a), bool)
    for i in np.flatnonzero(known & bound):
        out[i] = SequenceMatcher(None, x.iat[i], y.iat[i]).ratio() >= least.iat[i]
    return pd.Series(out)


def match_items(papers: DataFrame, by_doi: DataFrame, hits: DataFrame, least: float = 0.9) -> DataFrame:
    """paper_id, item, how: the item of the paper's DOI, else the first hit of its title search whose title is as similar as
    ``least``. papers: paper_id, doi, title_key; by_doi: doi, item; hits: paper_id, ord, item, title_key."""
    direct = papers.filter("coalesce(doi, '') <> ''").join(by_doi, "doi").select("paper_id", "item", F.lit("doi").alias("how"))
    rest = papers.join(direct, "paper_id", "left_anti").select("paper_id", F.col("title_key").alias("own"))
    sizes = [F.length("own"), F.length("title_key")]
    near = rest.join(hits, "paper_id").filter(2 * F.least(*sizes) >= least * (sizes[0] + sizes[1])).filter(_alike("own", "title_key", F.lit(least)))
    return direct.unionByName(first_by(near, ["paper_id"], "ord").select("paper_id", "item", F.lit("title").alias("how")))

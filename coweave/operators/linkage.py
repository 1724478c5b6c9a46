"""Record linkage and identity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import METHOD_STRENGTH, PLAUSIBLE_FIELDS
from ..functions.names import compatible
from .papers import first_by
from .ranges import numbered


def wanted_keys(wanted: DataFrame, cache: DataFrame, key: str, per_call: int = 50) -> DataFrame:
    """Keys that the cache lacks (found or known to be missing), in batches of ``per_call`` by ascending key, numbered from 0."""
    missing = wanted.select(key).distinct().join(cache.select(key), key, "left_anti")
    return numbered(missing, key, "_at").select(key, F.floor(F.col("_at") / per_call).cast("int").alias("batch"))


def best_search_hit(searches: DataFrame, hits: DataFrame, key: str, name: str, found: str, tokens=lambda c: c) -> DataFrame:
    """query_id and the columns of its best hit: of the hits of a name search with a compatible name, the best by (home country, works);
    ties to the least id. searches: query_id, key, name; hits: key, author_id, found, is_home, works. Names are token lists, or what
    ``tokens`` makes them of. Under each key a name is cut and compared with another once, whoever bears them; the surname, which
    compatible names share, is a join key. It is never null, else a filter on it would cut the names of all rows, and searches,
    which may be many more than their names, are not broadcast."""
    surname = lambda c: F.coalesce(F.get(c, F.size(c) - 1), F.lit(""))
    cut = lambda df, c, to: df.withColumn(to, tokens(F.col(c))).withColumn("_s", surname(F.col(to)))
    order = (F.desc("is_home"), F.desc("works"), "author_id")
    asked, best = cut(searches.select(key, name).distinct(), name, "_a"), cut(first_by(hits, [key, found], *order), found, "_b")
    met = asked.join(best, [key, "_s"]).filter(compatible(F.col("_a"), F.col("_b"))).drop("_s", "_a", "_b")
    top = first_by(met, [key, name], *order).hint("merge")
    return first_by(searches.select("query_id", key, name).join(top, [key, name]), ["query_id"], *order)


def link_by_name(nodes: DataFrame, works: DataFrame) -> DataFrame:
    """paper_id, node_id, author_id of compatible names on one paper. nodes and works have tokens; the paper and the surname,
    which compatible names share, are the join keys."""
    surname = lambda c: F.get(c, F.size(c) - 1)
    a = nodes.select("paper_id", "node_id", F.col("tokens").alias("ta"), surname(F.col("tokens")).alias("s"))
    b = works.select("paper_id", "author_id", F.col("tokens").alias("tb"), surname(F.col("tokens")).alias("s"))
    return a.join(b, ["paper_id", "s"]).filter(compatible(F.col("ta"), F.col("tb"))).select("paper_id", "node_id", "author_id")


def resolve_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """node_id of each name: an exact key of a known node, else the only node with its surname key, else a new id from its key.
    names: name_id, key, surname; known: node_id, key, surname (placeholders left out by the caller)."""
    exact = known.groupBy("key").agg(F.min("node_id").alias("exact_id"))
    only = known.filter("surname <> ''").groupBy("surname").agg(F.min("node_id").alias("only_id"), F.count_distinct("node_id").alias("n")).filter("n = 1").drop("n")
    new = F.concat(F.lit("EXT-N-"), F.substring(F.sha1(F.col("key").cast("binary")), 1, 16))
    r = names.join(exact, "key", "left").join(only, "surname", "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("only_id").isNotNull(), "surname").otherwise("new")
    return r.select("name_id", F.coalesce("exact_id", "only_id", new).alias("node_id"), how.alias("how"))


def coappearance(links: DataFrame) -> DataFrame:
    """node_id, author_id, votes and method: the author seen most often with a node; one vote is weak evidence."""
    votes = links.groupBy("node_id", "author_id").agg(F.count_distinct("paper_id").alias("votes"))
    top = first_by(votes, ["node_id"], F.desc("votes"), "author_id")
    return top.withColumn("method", F.when(F.col("votes") >= 2, "coappearance").otherwise("coappearance_single"))


def decide(candidates: DataFrame, plausible: tuple[str, ...] = PLAUSIBLE_FIELDS) -> DataFrame:
    """The accepted candidate of each node: candidates: node_id, is_roster, method, author_id, evidence, own_works, field,
    country (null field: no profile known). Tried by own works, strength, method, id and evidence, all descending."""
    strength = F.create_map(*[F.lit(x) for pair in METHOD_STRENGTH for x in pair])
    c = candidates.withColumn("strength", F.try_element_at(strength, F.col("method")))
    known = F.col("field").isNotNull()
    ok, home = F.coalesce("field", F.lit("")).isin(*plausible), F.coalesce("country", F.lit("")) == "TW"
    confidence = (
        F.when(F.col("own_works") >= 2, "high")
        .when(F.col("strength") == 4, "high")
        .when(F.col("own_works") == 1, "medium")
        .when(known & (F.col("strength") >= 2) & ok & (~F.col("is_roster") | home), "low")
        .when(known & (F.col("strength") == 1) & ok & home, "low")
    )
    c = c.withColumn("confidence", confidence).filter("confidence IS NOT NULL")
    best = first_by(c, ["node_id"], *[F.desc(x) for x in ("own_works", "strength", "method", "author_id", "evidence")])
    return best.select("node_id", "author_id", "method", "confidence")


def best_evidence(rows: DataFrame) -> DataFrame:
    """The row of each node with the highest confidence (high, medium, other), then the first."""
    rank = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    return first_by(rows, ["node_id"], F.desc(rank), "ord")


def waterfall(nodes: DataFrame, sources: list[tuple[str, DataFrame]], columns: list[str], none: str = "none") -> DataFrame:
    """Of several sources (node_id and columns, one row a node), the first in order that has the node; ``src`` names it."""
    out = nodes
    for name, s in sources:
        out = out.join(s.select("node_id", F.struct(F.lit(name).alias("src"), *columns).alias(f"_{name}")), "node_id", "left")
    pick = F.coalesce(*[F.col(f"_{name}") for name, _ in sources])
    return out.select(*nodes.columns, F.coalesce(pick["src"], F.lit(none)).alias("src"), *[pick[c].alias(c) for c in columns])


def domain_match(addresses: DataFrame, institutions: DataFrame, domain: str = "domain", suffix: str = "suffix") -> DataFrame:
    """Institution of each domain that equals a suffix or ends with it after a point; the first in order. Every ending of a
    domain is a key, so this is an equi-join."""
    labels = F.split(domain, "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = addresses.withColumn(suffix, F.explode(ends)).join(institutions, suffix)
    best = first_by(keyed, addresses.columns, "ord")
    return addresses.join(best.select(*addresses.columns, "institution"), addresses.columns, "left")


def align_by_position(left: DataFrame, right: DataFrame, key: str, order_left: str, order_right: str, checks: list[str]) -> DataFrame:
    """Rows of both sides of a key paired by their ordinal; ``aligned`` if all the checked columns agree."""
    from pyspark.sql import Window

    number = lambda o: F.row_number().over(Window.partitionBy(key).orderBy(o))
    a = left.withColumn("ordinal", number(order_left))
    b = right.withColumn("ordinal", number(order_right)).withColumnsRenamed({c: f"{c}_right" for c in checks})
    same = F.lit(True)
    for c in checks:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_right"))
    return a.join(b, [key, "ordinal"], "left").withColumn("aligned", same)


def merge_caches(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts of both, added by key."""
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))

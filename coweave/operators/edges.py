"""Collaboration events and their aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANALYSIS_DEFAULT = {"external": False, "scope": "all", "strict_projects": False}
VIEWER_DEFAULT = {"external": True, "scope": "all", "strict_projects": False}


def surrogate(prefix: str, size: int, *parts) -> Column:
    """prefix + first hex digits of the SHA-1 of the parts joined by |."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).cast("binary")), 1, size))


def cap_authors(authors: DataFrame, most: int = 10, *order: str) -> DataFrame:
    """At most ``most`` authors of each paper, by the order given: unmatched (null) last, then by node."""
    keys = [F.col(c).asc_nulls_last() for c in (order or ("ln",))]
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy(*keys, "node_id"))
    return authors.withColumn("list_position", rank).filter(F.col("list_position") <= most)


def pair_weights(n: str) -> dict[str, Column]:
    return {"weight_1n": F.round(1.0 / F.col(n), 8), "weight_pair": F.round(2.0 / (F.col(n) * (F.col(n) - 1)), 8)}


def paper_edges(papers: DataFrame, authors: DataFrame) -> DataFrame:
    """All unordered author pairs of each eligible paper. One shuffle on the paper serves the size and the self-join."""
    listed = authors.select("paper_id", "node_id").distinct().join(papers.filter("edge_eligible").select("paper_id", "year"), "paper_id")
    per = listed.groupBy("paper_id", "year").agg(F.sort_array(F.collect_list("node_id")).alias("a")).withColumn("n_authors", F.size("a")).filter("n_authors > 1")
    first = per.select("*", F.posexplode("a").alias("i", "source_node_id"))
    pairs = first.select("*", F.explode(F.expr("slice(a, i + 2, size(a))")).alias("target_node_id"))
    pairs = pairs.withColumns(pair_weights("n_authors"))
    return pairs.select(surrogate("E-", 20, "paper_id", "source_node_id", "target_node_id").alias("edge_id"), "year", "paper_id", "source_node_id", "target_node_id", "n_authors", "weight_1n", "weight_pair")


def project_edges(rows: DataFrame, block: int = 256) -> DataFrame:
    """rows: family, year, member. Every pair of a family's members in every year of the family, with a mark whether both were
    recorded in that year.

    A family's members are dealt into blocks of about ``block``; a pair of blocks is a cell, and pairs are made within cells. So the
    largest family is many small tasks, and its members are copied once for each of its blocks only."""
    per = rows.groupBy("family", "member").agg(F.collect_set("year").alias("years"))
    size = per.groupBy("family").agg(F.count(F.lit(1)).alias("n_members")).filter("n_members > 1")
    span = rows.groupBy("family").agg(F.collect_set("year").alias("family_years"))
    blocks = F.ceil(F.col("n_members") / block).cast("int")
    dealt = per.join(size, "family").withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    copies = dealt.select("family", "member", "years", "n_members", "b", other).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")})
    left = copies.filter("b = i").select("family", "i", "j", "n_members", F.col("member").alias("m"), F.col("years").alias("ym"))
    right = copies.filter("b = j").select("family", "i", "j", F.col("member").alias("n"), F.col("years").alias("yn"))
    pairs = left.join(right, ["family", "i", "j"]).filter("i < j OR m < n").withColumns({"source_node_id": F.least("m", "n"), "target_node_id": F.greatest("m", "n")})
    out = pairs.join(span, "family").select("*", F.explode("family_years").alias("year"))
    both = (F.array_contains("ym", F.col("year")) & F.array_contains("yn", F.col("year"))).cast("int").alias("both_recorded_this_year")
    key = surrogate("JE-", 16, "family", "year", "source_node_id", "target_node_id").alias("edge_id")
    return out.withColumns(pair_weights("n_members")).select(key, "family", "year", "source_node_id", "target_node_id", F.col("n_members").cast("int").alias("n_members"), both, "weight_1n", "weight_pair")


def edge_events(papers: DataFrame, projects: DataFrame) -> DataFrame:
    """Both layers: layer, year, item, u, v, weight_1n, weight_pair, both_recorded_this_year (null for papers)."""
    a = papers.select(F.lit("pub").alias("layer"), "year", F.col("paper_id").cast("string").alias("item"), F.col("source_node_id").alias("u"), F.col("target_node_id").alias("v"), "weight_1n", "weight_pair")
    b = projects.select(F.lit("proj").alias("layer"), "year", F.concat_ws(":", F.col("family").cast("string"), F.col("year").cast("string")).alias("item"), F.col("source_node_id").alias("u"), F.col("target_node_id").alias("v"), "weight_1n", "weight_pair", "both_recorded_this_year")
    return a.unionByName(b, allowMissingColumns=True)


def select_events(events: DataFrame, nodes: DataFrame, layer: str = "all", year_from: int | None = None, year_to: int | None = None, external: bool = True, scope: str = "all", strict_projects: bool = False) -> DataFrame:
    """The query over events. scope: all; within (both institutions known and equal); across (both known and different);
    cross (not within, so a missing institution counts as cross)."""
    e = events
    if layer != "all":
        e = e.filter(F.col("layer") == layer)
    if year_from is not None:
        e = e.filter(F.col("year") >= year_from)
    if year_to is not None:
        e = e.filter(F.col("year") <= year_to)
    if strict_projects:
        e = e.filter((F.col("layer") != "proj") | (F.col("both_recorded_this_year") == 1))
    if external and scope == "all":
        return e
    own = nodes.select("node_id", "node_type", "institution")
    e = e.join(own.toDF("u", "u_type", "u_inst"), "u").join(own.toDF("v", "v_type", "v_inst"), "v")
    if not external:
        e = e.filter("u_type = 'roster' AND v_type = 'roster'")
    known, equal = F.col("u_inst").isNotNull() & F.col("v_inst").isNotNull(), F.col("u_inst").eqNullSafe(F.col("v_inst"))
    e = {"all": e, "within": e.filter(known & equal), "across": e.filter(known & ~equal), "cross": e.filter(~(known & equal))}[scope]
    return e.drop("u_type", "v_type", "u_inst", "v_inst")


def items_of(item: str, once: bool) -> Column:
    """Number of distinct items of a group. once: a pair has each item in one event at most, as events from ``paper_edges`` and
    ``project_edges`` do; then counting them needs no second shuffle."""
    return F.count(F.lit(1)) if once else F.count_distinct(item)


def aggregate_pairs(events: DataFrame, min_count: int = 1, min_weight: float = 0.0, by_layer: bool = False, with_items: bool = False, once: bool = False) -> DataFrame:
    """Events rolled up to unordered pairs: distinct items, weights, first and last year, and the sorted items if asked for."""
    e = events.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})
    items = [F.array_sort(F.collect_set("item")).alias("items")] if with_items else []
    out = e.groupBy(F.col("a").alias("u"), F.col("b").alias("v"), *(["layer"] if by_layer else [])).agg(items_of("item", once).alias("count"), F.sum("weight_1n").alias("weight_1n"), F.sum("weight_pair").alias("weight_pair"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), *items)
    return out.filter((F.col("count") >= min_count) & (F.col("weight_1n") >= min_weight))


def both_directions(edges: DataFrame, a: str = "source_node_id", b: str = "target_node_id") -> DataFrame:
    one = edges.withColumnsRenamed({a: "ego", b: "alter"})
    return one.unionByName(edges.withColumnsRenamed({a: "alter", b: "ego"}))


def node_class(nodes: DataFrame) -> Column:
    """Class of a node by type and place: roster, home (an external author at a known home institution), domestic, foreign or
    unknown."""
    return (
        F.when(F.col("node_type") == "roster", "roster")
        .when(F.col("unknown_place"), "unknown")
        .when(F.col("institution").isNull(), F.when(F.col("country") == 0, "domestic").otherwise("foreign"))
        .otherwise(F.when(F.col("country") == 0, "home").otherwise("foreign"))
    )


def ego_ties(edges: DataFrame, nodes: DataFrame, max_authors: int | None = None, once: bool = False) -> DataFrame:
    """One row for each roster member and collaborator: count of papers, first and last year, weight, least number of authors of
    their papers, class of the alter. Pairs are summed before they are turned both ways."""
    e = edges if max_authors is None else edges.filter(F.col("n_authors") < max_authors)
    roster = nodes.filter("node_type = 'roster'").select(F.col("node_id").alias("ego"))
    pairs = e.groupBy("source_node_id", "target_node_id").agg(items_of("paper_id", once).alias("count"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("weight_1n").alias("w1n"), F.min("n_authors").alias("least_authors"))
    ties = both_directions(pairs).join(roster, "ego", "left_semi")
    return ties.join(nodes.select(F.col("node_id").alias("alter"), node_class(nodes).alias("cls")), "alter", "left").withColumn("cls", F.coalesce("cls", F.lit("unknown")))


def apply_merges(authors: DataFrame, merges: DataFrame) -> DataFrame:
    """Each node replaced by what it was merged into (one hop), then one row for each paper and node, at its first place."""
    m = merges.select(F.col("from_node_id").alias("node_id"), "to_node_id")
    moved = authors.join(m, "node_id", "left").withColumn("node_id", F.coalesce("to_node_id", "node_id"))
    return moved.groupBy("paper_id", "node_id").agg(F.min("ln").alias("ln"))


def new_and_repeat(edges: DataFrame) -> DataFrame:
    """year, pairs, new pairs (first seen in that year), repeated pairs."""
    p = edges.select("year", F.least("source_node_id", "target_node_id").alias("u"), F.greatest("source_node_id", "target_node_id").alias("v")).distinct()
    first = F.min("year").over(Window.partitionBy("u", "v"))
    p = p.withColumn("new", (F.col("year") == first).cast("int"))
    return p.groupBy("year").agg(F.count(F.lit(1)).alias("pairs"), F.sum("new").alias("new_pairs")).withColumn("repeat_pairs", F.col("pairs") - F.col("new_pairs"))

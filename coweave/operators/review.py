"""Repair of author lists, review queues and reports of what was not found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import resplit
from .papers import first_by


def repair_rule(reasons: Column) -> Column:
    """Which repair a paper's hold reasons call for: incomplete lists first, then conflicting ones, then unresolved names."""
    r = F.split(F.coalesce(reasons, F.lit("")), "\\|")
    return (
        F.when(F.array_contains(r, "incomplete_author_list"), "C_incomplete_web_lookup")
        .when(F.array_contains(r, "published_author_list_conflict"), "A_resplit_author_list")
        .when(F.array_contains(r, "unresolved_author_identity_or_fragment"), "B_drop_unidentifiable")
    )


def is_placeholder(node: Column) -> Column:
    return F.startswith(node, F.lit("EXT-U-"))


def repair_author_lists(papers: DataFrame, sources: DataFrame, lookups: DataFrame, resolved: DataFrame) -> DataFrame:
    """paper_id, rule, n_before, node_ids of the papers that need a repair; placeholders go, first places stay.

    papers: paper_id, hold_reason, node_ids. sources: paper_id, record_id, original_author_list. lookups: paper_id, names found
    by hand. resolved: name, node_id (null if it names nobody), from name resolution."""
    p = papers.withColumn("rule", repair_rule(F.col("hold_reason"))).filter("rule IS NOT NULL")
    longest = first_by(sources, ["paper_id"], F.desc(F.length(F.coalesce("original_author_list", F.lit("")))), "record_id")
    names = p.join(longest.select("paper_id", "original_author_list"), "paper_id", "left").join(lookups.select("paper_id", F.col("names").alias("looked_up")), "paper_id", "left")
    wanted = F.when(F.col("rule").startswith("A"), resplit(F.col("original_author_list"))).when(F.col("rule").startswith("C"), F.col("looked_up"))
    each = names.select("paper_id", F.posexplode(wanted).alias("at", "name")).join(resolved, "name").filter("node_id IS NOT NULL")
    found = each.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node_id"))), lambda x: x["node_id"]).alias("found"))
    none = F.array().cast("array<string>")
    out = p.join(found, "paper_id", "left").withColumn("found", F.coalesce("found", none))
    start = F.when(F.col("rule").startswith("A"), none).otherwise(F.col("node_ids"))
    nodes = F.array_distinct(F.filter(F.concat(start, F.when(F.col("rule").startswith("B"), none).otherwise(F.col("found"))), lambda n: ~is_placeholder(n)))
    return out.select("paper_id", "rule", F.size("node_ids").alias("n_before"), nodes.alias("node_ids"))


def identity_review(roster: DataFrame, external: DataFrame) -> DataFrame:
    """kind, id, priority of profiles marked for review: roster members first by degree, then externals by how many of the
    roster they reach. Both: id, needs_review, degree_roster; externals also degree_all."""
    a = roster.filter("needs_review").select(F.lit("roster").alias("kind"), "id", (1000 + F.coalesce("degree_roster", F.lit(0))).alias("priority"))
    b = external.filter("needs_review").select(F.lit("external").alias("kind"), "id", (F.coalesce("degree_roster", F.lit(0)) * 10 + F.least(F.coalesce("degree_all", F.lit(0)), F.lit(9))).alias("priority"))
    return a.unionByName(b).orderBy(F.desc("priority"), "id")


def missing_queue(rows: DataFrame, column: str, *order) -> DataFrame:
    """Rows without a value, in review order."""
    return rows.filter(F.coalesce(F.col(column), F.lit("")) == "").orderBy(*order)


def not_found(people: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """node_id, reason, rejected_candidate of people without an accepted profile. people: node_id, name_en. rejected: node_id,
    author_id, method, own_works, strength, rule (that of the flag gate, null before it), display_name (null: not fetched)."""
    best = first_by(rejected, ["node_id"], F.desc("own_works"), F.desc("strength"), "author_id")
    p = people.join(accepted.select("node_id"), "node_id", "left_anti").join(best, "node_id", "left")
    reason = (
        F.when(F.col("author_id").isNotNull() & F.startswith(F.coalesce("rule", F.lit("")), F.lit("rule4")), F.concat(F.lit("stopped by a flag: "), "rule"))
        .when(F.col("author_id").isNotNull() & F.col("display_name").isNotNull(), F.concat(F.lit("evidence too weak: "), "method"))
        .when(F.col("author_id").isNotNull(), "profile could not be read")
        .when(F.trim(F.coalesce("name_en", F.lit(""))) == "", "no Latin name to search for")
        .otherwise("no compatible name found")
    )
    return p.select("node_id", reason.alias("reason"), F.coalesce("display_name", "author_id").alias("rejected_candidate"))


def fill_places(places: DataFrame, institutions: DataFrame) -> DataFrame:
    """Coordinates of the institution where a place is one of the roster's, the place's own otherwise."""
    at = institutions.select("institution_code", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    j = places.join(at, "institution_code", "left")
    own = F.col("place_type") == "roster"
    return j.withColumns({"lat": F.coalesce(F.when(own, F.col("_lat")), "lat"), "lon": F.coalesce(F.when(own, F.col("_lon")), "lon")}).drop("_lat", "_lon")

"""Per-person and per-institution measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import ego_ties

CLASSES = ("roster", "home", "domestic", "foreign", "unknown")


def person_activity(nodes: DataFrame, papers: DataFrame, authors: DataFrame, edges: DataFrame, projects: DataFrame, first: int, last: int) -> DataFrame:
    """One row for each node: papers, papers by year over dense years (map), degree, strength, project years, status."""
    own = authors.join(papers.filter("edge_eligible"), "paper_id").select("node_id", "paper_id", "year").distinct()
    by_year = own.filter(F.col("year").between(first, last)).groupBy("node_id", "year").agg(F.count(F.lit(1)).alias("n")).groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("m"))
    pairs = edges.groupBy("source_node_id", "target_node_id").agg(F.sum("weight_1n").alias("w"))
    tie = pairs.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"), "w").groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))
    done = own.groupBy("node_id").agg(F.count(F.lit(1)).alias("papers"))
    proj = projects.select(F.col("member").alias("node_id"), "family", "year").distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("project_years"))
    out = nodes.select("node_id", "node_type").join(done, "node_id", "left").join(by_year, "node_id", "left").join(tie, "node_id", "left").join(proj, "node_id", "left")
    out = out.fillna(0, ["papers", "degree", "strength", "project_years"])
    years = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda y: F.struct(y, F.coalesce(F.try_element_at("m", y), F.lit(0))))
    status = F.when((F.col("papers") > 0) & (F.col("project_years") > 0), "both").when(F.col("papers") > 0, "paper").when(F.col("project_years") > 0, "project").otherwise("none")
    return out.select("node_id", "node_type", "papers", F.map_from_entries(years).alias("papers_by_year"), "degree", "strength", "project_years", status.alias("status"))


def institution_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """institution, members, roster members, internal edges, external edges (once for each end)."""
    who = nodes.groupBy("institution").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("node_type") == "roster").alias("roster")).filter("institution IS NOT NULL")
    at = nodes.select("node_id", "institution")
    e = edges.join(at.toDF("source_node_id", "a"), "source_node_id").join(at.toDF("target_node_id", "b"), "target_node_id")
    ends = e.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("institution"), F.col("a").eqNullSafe(F.col("b")).alias("inside")).filter("institution IS NOT NULL")
    counts = ends.groupBy("institution").agg(F.count_if("inside").alias("internal_edges"), F.count_if(~F.col("inside")).alias("external_edges"))
    return who.join(counts, "institution", "left").fillna(0, ["internal_edges", "external_edges"])


def institution_matrix(papers: DataFrame, authors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Papers shared by each pair of institutions; the diagonal needs two authors of one institution."""
    n = authors.join(papers.filter("edge_eligible").select("paper_id"), "paper_id").join(nodes.filter("institution IS NOT NULL").select("node_id", "institution"), "node_id").groupBy("paper_id", "institution").agg(F.count_distinct("node_id").alias("n"))
    a, b = n.toDF("paper_id", "a", "na"), n.toDF("paper_id", "b", "nb")
    pairs = a.join(b, "paper_id").filter("a < b OR (a = b AND na >= 2)")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("papers"))


def person_collab(edges: DataFrame, nodes: DataFrame, papers: DataFrame, authors: DataFrame, journal: str, big_team: int) -> DataFrame:
    """One row for each roster member: collaborators in all and by class, without big teams, and papers by kind, from one
    conditional aggregation over ties and one over papers."""
    roster = nodes.filter("node_type = 'roster'").select(F.col("node_id").alias("ego"))
    small = F.count_if(F.col("least_authors") < big_team).alias("n_collab_small")
    by_class = ego_ties(edges, nodes, once=True).groupBy("ego").agg(F.count(F.lit(1)).alias("n_collab"), *[F.count_if(F.col("cls") == c).alias(f"n_{c}") for c in CLASSES], small)
    size = F.count(F.lit(1)).over(Window.partitionBy("paper_id"))
    own = authors.select("paper_id", "node_id").distinct().withColumn("n_authors", size).join(papers.filter("edge_eligible").select("paper_id", "pub_category"), "paper_id")
    done = own.groupBy(F.col("node_id").alias("ego")).agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("pub_category") == journal).alias("journal"), F.count_if(F.col("n_authors") >= 2).alias("coauth"), F.count_if(F.col("n_authors") == 1).alias("solo"))
    return roster.join(by_class, "ego", "left").join(done, "ego", "left").fillna(0)


def tie_bins(ties: DataFrame) -> DataFrame:
    """By class of alter: ties, shares of repeated (two or more) and core (three or more) ties, and counts by size of tie."""
    b = F.when(F.col("count") == 1, "1").when(F.col("count") == 2, "2").when(F.col("count") <= 4, "3-4").when(F.col("count") <= 9, "5-9").otherwise("10+")
    return ties.withColumn("bin", b).groupBy("cls", "bin").agg(F.count(F.lit(1)).alias("ties"))


def relation(a: str, b: str):
    """Recode of two ends' classes and institutions."""
    return F.when(F.col("cls") == "unknown", "unknown").when(F.col("cls") == "foreign", "foreign").when(F.col("cls") != "roster", "domestic external").when(F.col(a) == F.col(b), "same institution").otherwise("other institution")

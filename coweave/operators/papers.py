"""Cleaning of publication and project records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import BLOCKING_REASONS, is_blocked, subtract_reasons
from .edges import surrogate
from .ranges import numbered


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def years_of(dates: Column) -> Column:
    """Sorted distinct years of an array of dates that start with one."""
    y = F.transform(dates, lambda d: F.expr("try_cast(NULL AS int)") if d is None else F.substring(d, 1, 4))
    return F.array_sort(F.array_distinct(F.filter(y, lambda x: x.rlike("^[0-9]{4}$"))))


def build_papers(rows: DataFrame) -> DataFrame:
    """rows with publication_dates (array): year is the earliest, year_ambiguous if there are several, year_candidates all."""
    y = rows.withColumn("year_candidates", years_of(F.col("publication_dates")))
    return y.withColumns({"year": F.get("year_candidates", F.lit(0)).cast("int"), "year_ambiguous": F.size("year_candidates") > 1})


def largest_author_set(rows: DataFrame) -> DataFrame:
    """paper_id, node_ids: the largest author set among the records of papers with two records or more; ties to the first
    record. rows: paper_id, record_id, node_id; blank and unresolved nodes are left out."""
    real = rows.filter("coalesce(node_id, '') <> '' AND NOT startswith(node_id, 'EXT-U-')")
    sets = real.groupBy("paper_id", "record_id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))
    many = sets.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("paper_id"))).filter("n > 1")
    return first_by(many, ["paper_id"], F.desc(F.size("node_ids")), "record_id").select("paper_id", "node_ids")


def merge_same_title(papers: DataFrame, title_key: str, authors_key: str) -> DataFrame:
    """Papers of one title key and one author key become the best of them: with a DOI, more sources, earlier, then least id.
    Empty title keys never merge. merged_paper_ids lists the others; an empty DOI is filled from them, sources add up."""
    k = papers.withColumn("_alone", F.when(F.col(title_key) == "", F.col("paper_id").cast("string")))
    order = F.struct(F.coalesce("doi", F.lit("")) == "", -F.col("source_count"), "year", "paper_id")
    whole = F.struct(*[c for c in papers.columns])
    groups = k.groupBy(title_key, authors_key, "_alone").agg(F.min_by(whole, order).alias("_best"), F.array_sort(F.collect_set("paper_id")).alias("_ids"), F.sum("source_count").alias("_sources"), F.max(F.nullif("doi", F.lit(""))).alias("_doi"))
    out = groups.select("_best.*", "_ids", "_sources", "_doi")
    out = out.withColumns({"doi": F.coalesce(F.nullif("doi", F.lit("")), "_doi"), "source_count": F.col("_sources"), "merged_paper_ids": F.array_except("_ids", F.array("paper_id"))})
    return out.drop("_ids", "_sources", "_doi")


def apply_list_fixes(papers: DataFrame, fixes: DataFrame) -> DataFrame:
    """Author lists replaced where a fix exists (paper_id, node_ids)."""
    f = fixes.select("paper_id", F.col("node_ids").alias("_fixed"))
    return papers.join(f, "paper_id", "left").withColumn("node_ids", F.coalesce("_fixed", "node_ids")).drop("_fixed")


def recompute_eligibility(papers: DataFrame, resolved: tuple[str, ...] = (), blocking: tuple[str, ...] = BLOCKING_REASONS) -> DataFrame:
    kept = papers.withColumn("hold_reason", subtract_reasons(F.col("hold_reason"), resolved))
    return kept.withColumn("edge_eligible", ~is_blocked(F.col("hold_reason"), blocking))


def merge_nodes_in_list(nodes: Column, moves: Column) -> Column:
    """A list of nodes with each mapped once, then distinct, first places kept. moves: a map."""
    return F.array_distinct(F.transform(nodes, lambda n: F.coalesce(F.try_element_at(moves, n), n)))


def build_projects(rows: DataFrame) -> DataFrame:
    """One row for each title key and year (also the empty key): rows: title_key, year, title, member, category, record_id.
    Title: the longest, then the first; category: the most frequent, then the first seen."""
    keys = ["title_key", "year"]
    modes = first_by(rows.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("seen")), keys, F.desc("n"), "seen").select(*keys, "category")
    title = F.max_by("title", F.struct(F.length("title"), -F.col("record_id"))).alias("title")
    p = rows.groupBy(*keys).agg(title, F.array_sort(F.collect_set("member")).alias("members"), F.count(F.lit(1)).alias("source_record_count"))
    p = p.join(modes, keys)
    return p.withColumns({"project_key": surrogate("J-", 12, F.col("year"), F.col("title_key")), "project_family_key": surrogate("JF-", 12, F.col("title_key")), "is_multi": F.size("members") > 1})


def duplicate_groups(df: DataFrame, key: str, row: str) -> DataFrame:
    """Rows whose key occurs twice or more, with a group name Gnnn by key order."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col(key) != ""))
    at = (F.col("_at") + 1).cast("string")
    names = numbered(counted, key, "_at").select(key, "n", F.concat(F.lit("G"), F.lpad(at, F.greatest(F.length(at), F.lit(3)), F.lit("0"))).alias("group_id"))
    return df.join(names, key).select("group_id", row, "n")


def representative(rows: DataFrame, key: str, *flags: str) -> DataFrame:
    """The best row of each key: true flags first, in their order, then the latest year, then the least paper id."""
    return first_by(rows, [key], *[F.desc(f) for f in flags], F.desc("year"), "paper_id")

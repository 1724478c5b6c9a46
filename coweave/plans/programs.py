"""The analysis programs: each gives all its result tables in one call, and is registered as one tidy table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.proxy import Views
from . import collab, compose, funding, graphs, network, people  # noqa: F401  register the parts
from .registry import OF_VIEWS, ORACLES, QUERIES

#: Program: its tables, each a registered query with the columns that name a row and those that measure it.
PROGRAMS: dict[str, dict[str, tuple[list[str], list[str]]]] = {
    "fa01_top_recipients": {"i1_top25": (["teacher_id"], ["total"]), "g6_person_table": (["teacher_id"], ["f_1", "f_2", "f_3", "f_4", "f_5", "funding", "funding_research", "n_pi"]), "o23_stacked_shares": (["list", "teacher_id", "part"], ["value", "start", "shown_start", "shown"]), "i7_overlap": (["teacher_id"], [])},
    "fa02_concentration": {"l1_gini": ([], ["gini"]), "o27_without_top": ([], ["gini"]), "l2_top_share": ([], ["top10", "bottom50"]), "l4_lorenz_at": ([], ["cumulative"]), "h14_lorenz": (["teacher_id"], ["population", "cumulative"])},
    "fa03_institutions": {"g8_institution_summary": (["institution"], ["n", "total", "mean", "median", "zero_share", "part"])},
    "fa04_over_time": {"g11_year_category_pivot": (["active_year"], ["urgent", "high", "low"]), "g12_active_people": (["year"], ["people", "researchers"]), "h12_dense_years": (["year"], ["n"]), "h17_stacked": (["year", "grant_category"], ["n", "bottom"])},
    "fa05_categories": {"g10_category_quartiles": (["grant_category"], ["n", "q25", "q50", "q75", "people", "multi_share"]), "g10_top_and_other": (["kept"], ["n", "q25", "q50", "q75", "people", "multi_share"])},
    "fa06_attributes": {"g19_attribute_stats": (["attribute"], ["n", "mean", "median_positive", "zero_share"]), "l9_quantiles": (["attribute"], ["q10", "q50", "q90"]), "o20_recode_rare": (["kept"], ["n", "median"]), "i4_topk_per_group": (["attribute", "teacher_id"], ["rank"])},
    "fa07_funding_and_output": {"l5_ols": ([], ["slope", "intercept", "r", "n"]), "i2_residual_extremes": (["teacher_id"], ["residual"]), "l7_spearman": ([], ["rho", "n"]), "g26_binned_median": (["bin"], ["people", "median"]), "l11_ratio_median": ([], ["median"])},
    "fa08_careers": {"h6_first_event": (["teacher_id", "first_category"], ["first_year"]), "h7_transition_gap": (["teacher_id"], ["start_year", "gap"]), "h8_cohort": (["teacher_id"], ["first_year"]), "h9_active_share": (["teacher_id"], ["active", "share"]), "h10_breaks": (["teacher_id", "year"], ["previous_year"])},
    "ca01_top_collaborators": {"ca01_top_lists": (["part", "key", "measure"], ["value"]), "g7_person_collab": (["ego"], ["n_collab", "n_roster", "n_home", "n_domestic", "n_foreign", "n_unknown", "n_collab_small", "papers", "journal", "coauth", "solo"])},
    "ca02_concentration": {"ca02_measures": (["part", "key", "measure"], ["value"])},
    "ca03_network_overview": {"j1_component_sizes": (["size"], ["components"]), "j3_betweenness": (["node"], ["betweenness"]), "j4_paths": ([], ["average_path", "diameter"]), "j5_transitivity": ([], ["triangles", "triples", "transitivity"]), "j6_density": ([], ["per_million"]), "j8_modularity": ([], ["modularity"]), "j9_community_graph": (["a", "b"], ["edges"]), "g27_top_members": (["component", "country"], ["n"]), "o29_isolates": (["node_id"], ["value"])},
    "ca04_institutions": {"g13_institution_matrix": (["a", "b"], ["papers"]), "g14_composition_share": (["institution", "cls"], ["n", "part"]), "o22_relation_recode": (["relation"], ["ties"]), "i12_top_cells": (["a", "b"], ["papers"])},
    "ca05_over_time": {"g18_year_series": (["year"], ["papers", "team", "foreign_share", "roster_share"]), "f12_new_vs_repeat": (["year"], ["pairs", "new_pairs", "repeat_pairs"]), "h13_new_share": (["year"], ["new_share"]), "o27_without_top": ([], ["gini"])},
    "ca06_external_origins": {"g15_external_origins": (["cls", "country"], ["people", "papers"]), "g15_top_origins": (["kept"], ["people", "papers"]), "g16_dominant_source": (["institution", "ego"], ["part"]), "o26_top_institutions": (["country", "institution"], ["people", "rank"])},
    "ca07_attributes": {"o21_top_values": (["kept"], ["n"]), "j10_homophily": ([], ["pairs", "same"]), "j11_permutation": (["attribute"], ["observed", "mean", "low", "high", "p"]), "j11_permutation_by_degree": (["attribute"], ["observed", "mean", "low", "high", "p"]), "j12_degree_bins": (["bin"], ["nodes"])},
    "ca08_collaboration_and_output": {"ca08_output": (["part", "key", "measure"], ["value"]), "c15_clipped": (["teacher_id"], ["shown", "clipped"])},
    "ca09_persistence": {"g20_tie_bins": (["cls", "bin"], ["ties"]), "f11_incident_pairs": (["u", "v"], ["count", "span"]), "i3_top_pairs": (["u", "v"], ["count", "span"]), "o25_core_collaborators": (["ego"], ["core", "part"])},
    "ca10_funding_link": {"ca10_grants_and_partners": (["part", "key", "measure"], ["value"]), "j13_inside_subset": ([], ["edges"]), "d18_neighbour_percentile": (["node"], ["partners"]), "o30_partners_by_quartile": (["quantile_group"], ["partners"])},
}


def run(spark: SparkSession, sf_dir: str, program: str) -> dict[str, DataFrame]:
    """The result tables of a program by name, from one set of views."""
    v = Views(spark, sf_dir)
    return {part: OF_VIEWS[part](v) for part in PROGRAMS[program]}


def tidy(part: str, table: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """part, key, measure, value: one row for each measure of each row; tables without measures count 1."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
    values = [F.struct(F.lit(m).alias("measure"), F.round(F.col(m).cast("double"), 8).alias("value")) for m in measures] or [F.struct(F.lit("rows").alias("measure"), F.lit(1.0).alias("value"))]
    return table.select(F.lit(part).alias("part"), key.alias("key"), F.explode(F.array(*values)).alias("m")).select("part", "key", "m.*")


def _query(program: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for part, table in run(spark, sf_dir, program).items():
            rows = tidy(part, table, *PROGRAMS[program][part])
            out = rows if out is None else out.unionByName(rows)
        return out

    return build


def _sql(program: str) -> str:
    tables, parts = [], []
    for part, (keys, measures) in PROGRAMS[program].items():
        tables.append(f"t_{part} AS MATERIALIZED (SELECT * FROM ({ORACLES[part]}))")
        key = " || '|' || ".join(f"coalesce(cast({k} AS VARCHAR), '')" for k in keys) or "''"
        for m, value in [(m, f"round(cast({m} AS DOUBLE), 8)") for m in measures] or [("rows", "1.0::DOUBLE")]:
            parts.append(f"SELECT '{part}' AS part, {key} AS key, '{m}' AS measure, {value} AS value FROM t_{part}")
    return f"WITH {', '.join(tables)} {' UNION ALL '.join(parts)}"


for _name in PROGRAMS:
    QUERIES[_name] = _query(_name)
    ORACLES[_name] = _sql(_name)

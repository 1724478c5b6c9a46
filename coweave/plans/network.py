"""Queries on events, pairs and ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from .registry import query

CAPPED = """capped AS (SELECT paper_id, node_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ln, node_id) AS rn FROM pa_p) WHERE rn <= 10),
 sized AS (SELECT c.paper_id, p.year, c.node_id, count(*) OVER (PARTITION BY c.paper_id) AS n FROM capped c JOIN papers_p p ON c.paper_id = p.paper_id WHERE p.edge_eligible),
 pe AS (SELECT a.paper_id, a.year, a.node_id AS s, b.node_id AS t, a.n, round(1.0::DOUBLE / a.n, 8) AS w1, round(2.0::DOUBLE / (a.n * (a.n - 1)), 8) AS w2 FROM sized a JOIN sized b ON a.paper_id = b.paper_id AND a.node_id < b.node_id)"""
PROJECTS = """mem AS (SELECT DISTINCT family, member FROM projects_p), fsize AS (SELECT family, count(*) AS n FROM mem GROUP BY family HAVING count(*) > 1),
 fy AS (SELECT DISTINCT family, year FROM projects_p), here AS (SELECT DISTINCT family, year, member FROM projects_p),
 je AS (SELECT f.family, fy.year, a.member AS s, b.member AS t, f.n, CASE WHEN ha.member IS NOT NULL AND hb.member IS NOT NULL THEN 1 ELSE 0 END AS both_rec, round(1.0::DOUBLE / f.n, 8) AS w1, round(2.0::DOUBLE / (f.n * (f.n - 1)), 8) AS w2
   FROM fsize f JOIN mem a ON a.family = f.family JOIN mem b ON b.family = f.family AND a.member < b.member JOIN fy ON fy.family = f.family
   LEFT JOIN here ha ON ha.family = f.family AND ha.year = fy.year AND ha.member = a.member LEFT JOIN here hb ON hb.family = f.family AND hb.year = fy.year AND hb.member = b.member)"""
EVENTS = f"""{CAPPED}, {PROJECTS}, ev AS (SELECT 'pub' AS layer, year, cast(paper_id AS VARCHAR) AS item, s AS u, t AS v, w1, w2, NULL AS both_rec FROM pe
   UNION ALL SELECT 'proj', year, concat(family, ':', year), s, t, w1, w2, both_rec FROM je)"""
CLASS = """cls AS (SELECT node_id, node_type, institution, CASE WHEN node_type = 'roster' THEN 'roster' WHEN unknown_place THEN 'unknown' WHEN institution IS NULL THEN CASE WHEN country = 0 THEN 'domestic' ELSE 'foreign' END
   ELSE CASE WHEN country = 0 THEN 'home' ELSE 'foreign' END END AS cls FROM nodes_p)"""
TIES = f"""{CAPPED}, {CLASS}, dir AS (SELECT s AS ego, t AS alter, * FROM pe UNION ALL SELECT t, s, * FROM pe),
 ties AS (SELECT ego, alter, count(DISTINCT paper_id) AS cnt, min(year) AS first_year, max(year) AS last_year, sum(w1) AS w1n, any_value(c.cls) AS cls
   FROM dir JOIN nodes_p r ON r.node_id = ego AND r.node_type = 'roster' LEFT JOIN cls c ON c.node_id = alter GROUP BY ego, alter)"""


def edges_of(v):
    return E.paper_edges(v.papers_p, E.cap_authors(v.pa_p))


def events_of(v):
    return E.edge_events(edges_of(v), E.project_edges(v.projects_p))


def ties_of(v):
    return E.ego_ties(edges_of(v), v.nodes_p, once=True)


@query("e15_author_cap", f"WITH {CAPPED} SELECT paper_id, node_id, cast(rn AS INT) AS list_position FROM capped")
def e15(v):
    return E.cap_authors(v.pa_p).select("paper_id", "node_id", "list_position")


@query("f1_paper_edges", f"WITH {CAPPED} SELECT 'E-' || substr(sha1(concat_ws('|', paper_id, s, t)), 1, 20) AS edge_id, year, paper_id, s AS source_node_id, t AS target_node_id, cast(n AS INT) AS n_authors, w1 AS weight_1n, w2 AS weight_pair FROM pe")
def f1(v):
    return edges_of(v)


@query("f2_project_edges", f"WITH {PROJECTS} SELECT 'JE-' || substr(sha1(concat_ws('|', family, year, s, t)), 1, 16) AS edge_id, family, year, s AS source_node_id, t AS target_node_id, cast(n AS INT) AS n_members, both_rec AS both_recorded_this_year, w1 AS weight_1n, w2 AS weight_pair FROM je")
def f2(v):
    return E.project_edges(v.projects_p)


def _rounded(df):
    return df.withColumns({c: F.round(c, 8) for c in ("weight_1n", "weight_pair")})


@query("f3_pair_aggregate", f"WITH {EVENTS} SELECT least(u, v) AS u, greatest(u, v) AS v, count(DISTINCT item) AS count, round(sum(w1), 8) AS weight_1n, round(sum(w2), 8) AS weight_pair, min(year) AS first_year, max(year) AS last_year FROM ev GROUP BY 1, 2")
def f3(v):
    return _rounded(E.aggregate_pairs(events_of(v), once=True))


@query("f3_pair_items", f"WITH {CAPPED} SELECT s AS u, t AS v, string_agg(DISTINCT cast(paper_id AS VARCHAR), ',' ORDER BY cast(paper_id AS VARCHAR)) AS items FROM pe GROUP BY 1, 2")
def f3_items(v):
    e = events_of(v).filter("layer = 'pub'")
    return E.aggregate_pairs(e, with_items=True).select("u", "v", F.array_join("items", ",").alias("items"))


@query("f4_min_count_graph", f"WITH {EVENTS} SELECT least(u, v) AS u, greatest(u, v) AS v, count(DISTINCT item) AS count FROM ev WHERE layer = 'proj' GROUP BY 1, 2 HAVING count(DISTINCT item) >= 3")
def f4(v):
    return E.aggregate_pairs(E.select_events(events_of(v), v.nodes_p, layer="proj"), min_count=3, once=True).select("u", "v", "count")


@query("f5_ego_ties", f"WITH {TIES} SELECT ego, alter, cnt AS count, first_year, last_year, round(w1n, 8) AS w1n, cls FROM ties")
def f5(v):
    return ties_of(v).withColumn("w1n", F.round("w1n", 8)).select("ego", "alter", "count", "first_year", "last_year", "w1n", "cls")


@query("f9_map_pairs", f"WITH {CAPPED}, k AS (SELECT * FROM nodes_p WHERE institution IS NOT NULL) SELECT s AS u, t AS v, round(sum(w1), 8) AS w FROM pe JOIN k a ON a.node_id = s JOIN k b ON b.node_id = t GROUP BY 1, 2 HAVING sum(w1) >= 0.5")
def f9(v):
    placed = v.nodes_p.filter("institution IS NOT NULL").select("node_id")
    e = edges_of(v).join(placed.toDF("source_node_id"), "source_node_id", "left_semi").join(placed.toDF("target_node_id"), "target_node_id", "left_semi")
    return e.groupBy(F.col("source_node_id").alias("u"), F.col("target_node_id").alias("v")).agg(F.sum("weight_1n").alias("w")).filter("w >= 0.5").withColumn("w", F.round("w", 8))


@query("f11_incident_pairs", f"WITH {TIES} SELECT least(ego, alter) AS u, greatest(ego, alter) AS v, max(cnt) AS count, max(last_year) - min(first_year) + 1 AS span FROM ties GROUP BY 1, 2")
def f11(v):
    t = ties_of(v).groupBy(F.least("ego", "alter").alias("u"), F.greatest("ego", "alter").alias("v"))
    return t.agg(F.max("count").alias("count"), (F.max("last_year") - F.min("first_year") + 1).alias("span"))


@query("f12_new_vs_repeat", f"WITH {CAPPED}, p AS (SELECT DISTINCT year, s, t FROM pe), q AS (SELECT *, min(year) OVER (PARTITION BY s, t) AS fy FROM p) SELECT year, count(*) AS pairs, count(*) FILTER (year = fy) AS new_pairs, count(*) FILTER (year <> fy) AS repeat_pairs FROM q GROUP BY year")
def f12(v):
    return E.new_and_repeat(edges_of(v))


@query("h13_new_share", f"WITH {CAPPED}, p AS (SELECT DISTINCT year, s, t FROM pe), q AS (SELECT *, min(year) OVER (PARTITION BY s, t) AS fy FROM p) SELECT year, round(avg(CASE WHEN year = fy THEN 1.0 ELSE 0.0 END), 6) AS new_share FROM q GROUP BY year")
def h13(v):
    return E.new_and_repeat(edges_of(v)).select("year", F.round(F.col("new_pairs") / F.col("pairs"), 6).alias("new_share"))


_END = "JOIN nodes_p a ON a.node_id = u JOIN nodes_p b ON b.node_id = v"
for _scope, _where in {"all": "true", "within": "a.institution = b.institution", "across": "a.institution <> b.institution", "cross": "NOT coalesce(a.institution = b.institution, false)"}.items():

    @query(f"c3_edge_events_{_scope}", f"WITH {EVENTS} SELECT layer, year, item, u, v FROM ev {_END} WHERE year BETWEEN 1996 AND 1998 AND a.node_type = 'roster' AND b.node_type = 'roster' AND {_where}")
    def c3(v, scope=_scope):
        return E.select_events(events_of(v), v.nodes_p, year_from=1996, year_to=1998, external=False, scope=scope).select("layer", "year", "item", "u", "v")


@query("c4_strict_projects", f"WITH {EVENTS} SELECT layer, year, count(*) AS events FROM ev WHERE layer <> 'proj' OR both_rec = 1 GROUP BY 1, 2")
def c4(v):
    return E.select_events(events_of(v), v.nodes_p, strict_projects=True).groupBy("layer", "year").agg(F.count(F.lit(1)).alias("events"))


@query("e17_node_merges", "SELECT paper_id, coalesce(m.to_node_id, a.node_id) AS node_id, min(ln) AS ln FROM pa_p a LEFT JOIN merges_p m ON m.from_node_id = a.node_id GROUP BY 1, 2")
def e17(v):
    return E.apply_merges(v.pa_p, v.merges_p)


@query("i3_top_pairs", f"WITH {TIES}, p AS (SELECT least(ego, alter) AS u, greatest(ego, alter) AS v, max(cnt) AS count, max(last_year) - min(first_year) + 1 AS span FROM ties GROUP BY 1, 2) SELECT * FROM p ORDER BY count DESC, span DESC, u, v LIMIT 20")
def i3(v):
    return f11(v).orderBy(F.desc("count"), F.desc("span"), "u", "v").limit(20)


@query("h5_list_position", "SELECT paper_id, node_id, cast(row_number() OVER (PARTITION BY paper_id ORDER BY ln, node_id) AS INT) AS list_position FROM pa_p")
def h5(v):
    lists = v.pa_p.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("ln", "node_id"))).alias("a"))
    return lists.select("paper_id", F.posexplode("a").alias("i", "x")).select("paper_id", "x.node_id", (F.col("i") + 1).alias("list_position"))


@query("d17_shared_items", f"WITH {CAPPED}, i AS (SELECT node_id, paper_id FROM capped) SELECT a.paper_id FROM i a JOIN i b ON a.paper_id = b.paper_id WHERE a.node_id = '000003' AND b.node_id = '000006'")
def d17(v):
    items = E.cap_authors(v.pa_p).select("node_id", "paper_id")
    return items.filter("node_id = '000003'").select("paper_id").intersect(items.filter("node_id = '000006'").select("paper_id"))


@query("o18_partners", f"WITH {EVENTS} SELECT DISTINCT CASE WHEN u = '000003' THEN v ELSE u END AS partner FROM ev WHERE u = '000003' OR v = '000003'")
def o18(v):
    return events_of(v).filter("u = '000003' OR v = '000003'").select(F.when(F.col("u") == "000003", F.col("v")).otherwise(F.col("u")).alias("partner")).distinct()


def flagship(v):
    """Top pairs: papers to capped author lists to events to pairs."""
    return i3(v)

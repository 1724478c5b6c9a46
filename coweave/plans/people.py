"""Queries on people, institutions and the viewer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import edges as E
from ..operators import people as P
from ..operators import viewer as W
from .network import CAPPED, CLASS, EVENTS, TIES, edges_of, events_of, ties_of
from .registry import query

OWN = "own AS (SELECT DISTINCT c.node_id, c.paper_id, p.year FROM capped c JOIN papers_p p ON p.paper_id = c.paper_id WHERE p.edge_eligible), ends AS (SELECT s AS node_id, t AS o, w1 FROM pe UNION ALL SELECT t, s, w1 FROM pe)"


@query("g1_person_activity", f"WITH {CAPPED}, {OWN}, a AS (SELECT node_id, count(*) AS papers, count(*) FILTER (year = 1996) AS papers_1996 FROM own GROUP BY 1), d AS (SELECT node_id, count(DISTINCT o) AS degree, sum(w1) AS strength FROM ends GROUP BY 1), j AS (SELECT member AS node_id, count(*) AS k FROM (SELECT DISTINCT member, family, year FROM projects_p) GROUP BY 1) SELECT n.node_id, n.node_type, coalesce(papers, 0) AS papers, coalesce(papers_1996, 0) AS papers_1996, coalesce(degree, 0) AS degree, round(coalesce(strength, 0), 8) AS strength, coalesce(k, 0) AS project_years, CASE WHEN papers > 0 AND k > 0 THEN 'both' WHEN papers > 0 THEN 'paper' WHEN k > 0 THEN 'project' ELSE 'none' END AS status FROM nodes_p n LEFT JOIN a ON a.node_id = n.node_id LEFT JOIN d ON d.node_id = n.node_id LEFT JOIN j ON j.node_id = n.node_id")
def g1(v):
    a = P.person_activity(v.nodes_p, v.papers_p, E.cap_authors(v.pa_p), edges_of(v), v.projects_p, 1995, 2001)
    return a.select("node_id", "node_type", "papers", F.try_element_at("papers_by_year", F.lit(1996)).cast("bigint").alias("papers_1996"), "degree", F.round("strength", 8).alias("strength"), "project_years", "status")


@query("g2_externals", f"WITH {CAPPED}, {OWN} SELECT n.node_id, count(*) AS papers FROM nodes_p n JOIN own ON own.node_id = n.node_id WHERE node_type <> 'roster' GROUP BY 1")
def g2(v):
    return g1(v).filter("node_type <> 'roster' AND papers > 0").select("node_id", "papers")


@query("g3_institution_rollup", f"WITH {CAPPED}, w AS (SELECT institution, count(*) AS members, count(*) FILTER (node_type = 'roster') AS roster FROM nodes_p WHERE institution IS NOT NULL GROUP BY 1), e AS (SELECT a.institution AS a, b.institution AS b FROM pe JOIN nodes_p a ON a.node_id = s JOIN nodes_p b ON b.node_id = t), x AS (SELECT a AS institution, (a IS NOT DISTINCT FROM b) AS i FROM e UNION ALL SELECT b, false FROM e WHERE a IS DISTINCT FROM b) SELECT w.*, count(x.i) FILTER (i) AS internal_edges, count(x.i) FILTER (NOT i) AS external_edges FROM w LEFT JOIN x ON x.institution = w.institution GROUP BY ALL")
def g3(v):
    return P.institution_rollup(v.nodes_p, edges_of(v))


@query("g4_share_count", "SELECT page_id, count(*) OVER (PARTITION BY url) AS shared_by FROM pages")
def g4(v):
    from pyspark.sql import Window

    return v.pages.select("page_id", F.count(F.lit(1)).over(Window.partitionBy("url")).alias("shared_by"))


@query("g5_papers_per_person", "SELECT a.node_id, count(*) FILTER (pub_category = '1-URGENT') AS journal, count(*) AS papers FROM pa_p a JOIN papers_p p ON p.paper_id = a.paper_id WHERE edge_eligible GROUP BY 1")
def g5(v):
    own = v.pa_p.select("paper_id", "node_id").dropDuplicates().join(v.papers_p.filter("edge_eligible"), "paper_id")
    return own.groupBy("node_id").agg(F.count_if(F.col("pub_category") == "1-URGENT").alias("journal"), F.count(F.lit(1)).alias("papers"))


_CLASSES = ", ".join(f"count(*) FILTER (cls = '{c}') AS n_{c}" for c in P.CLASSES)


@query("g7_person_collab", f"WITH {TIES}, k AS (SELECT ego, count(*) AS n_collab, {_CLASSES} FROM ties GROUP BY 1), sm AS (SELECT ego, count(DISTINCT alter) AS n_collab_small FROM dir WHERE n < 4 GROUP BY 1), o AS (SELECT c.node_id AS ego, count(*) AS papers, count(*) FILTER (pub_category = '1-URGENT') AS journal, count(*) FILTER (k >= 2) AS coauth, count(*) FILTER (k = 1) AS solo FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS k FROM capped) c JOIN papers_p p ON p.paper_id = c.paper_id WHERE edge_eligible GROUP BY 1) SELECT r.node_id AS ego, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_collab", *(f"n_{c}" for c in P.CLASSES), "n_collab_small", "papers", "journal", "coauth", "solo")) + " FROM nodes_p r LEFT JOIN k ON k.ego = r.node_id LEFT JOIN sm ON sm.ego = r.node_id LEFT JOIN o ON o.ego = r.node_id WHERE r.node_type = 'roster'")
def g7(v):
    return P.person_collab(edges_of(v), v.nodes_p, v.papers_p, E.cap_authors(v.pa_p), "1-URGENT", 4)


@query("g9_node_class", f"WITH {CLASS} SELECT node_id, cls FROM cls")
def g9(v):
    return v.nodes_p.select("node_id", E.node_class(v.nodes_p).alias("cls"))


@query("g13_institution_matrix", f"WITH {CAPPED}, n AS (SELECT c.paper_id, institution, count(DISTINCT c.node_id) AS n FROM capped c JOIN papers_p p ON p.paper_id = c.paper_id JOIN nodes_p x ON x.node_id = c.node_id WHERE edge_eligible AND institution IS NOT NULL GROUP BY 1, 2) SELECT a.institution AS a, b.institution AS b, count(*) AS papers FROM n a JOIN n b ON a.paper_id = b.paper_id AND (a.institution < b.institution OR (a.institution = b.institution AND a.n >= 2)) GROUP BY 1, 2")
def g13(v):
    return P.institution_matrix(v.papers_p, E.cap_authors(v.pa_p), v.nodes_p)


@query("i12_top_cells", f"WITH {CAPPED}, n AS (SELECT DISTINCT c.paper_id, institution FROM capped c JOIN papers_p p ON p.paper_id = c.paper_id JOIN nodes_p x ON x.node_id = c.node_id WHERE edge_eligible AND institution IS NOT NULL) SELECT a.institution AS a, b.institution AS b, count(*) AS papers FROM n a JOIN n b ON a.paper_id = b.paper_id AND a.institution < b.institution GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def i12(v):
    return g13(v).filter("a <> b").orderBy(F.desc("papers"), "a", "b").limit(10)


@query("g14_composition_share", f"WITH {TIES}, x AS (SELECT r.institution, ties.cls, count(*) AS n FROM ties JOIN nodes_p r ON r.node_id = ego WHERE r.institution IS NOT NULL GROUP BY 1, 2) SELECT institution, cls, n, round(n / sum(n) OVER (PARTITION BY institution), 8) AS part FROM x")
def g14(v):
    from ..functions.stats import share_of_total

    x = ties_of(v).join(v.nodes_p.select(F.col("node_id").alias("ego"), "institution"), "ego").filter("institution IS NOT NULL").groupBy("institution", "cls").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("part", F.round(share_of_total(F.col("n"), "institution"), 8))


@query("o22_relation_recode", f"WITH {TIES} SELECT CASE WHEN ties.cls = 'unknown' THEN 'unknown' WHEN ties.cls = 'foreign' THEN 'foreign' WHEN ties.cls <> 'roster' THEN 'domestic external' WHEN a.institution = b.institution THEN 'same institution' ELSE 'other institution' END AS relation, count(*) AS ties FROM ties JOIN nodes_p a ON a.node_id = ego JOIN nodes_p b ON b.node_id = alter GROUP BY 1")
def o22(v):
    at = v.nodes_p.select("node_id", "institution")
    t = ties_of(v).join(at.toDF("ego", "ie"), "ego").join(at.toDF("alter", "ia"), "alter")
    return t.groupBy(P.relation("ie", "ia").alias("relation")).agg(F.count(F.lit(1)).alias("ties"))


_ORIGINS = "FROM dir JOIN nodes_p r ON r.node_id = ego AND r.node_type = 'roster' JOIN cls c ON c.node_id = alter JOIN nodes_p n ON n.node_id = alter"


def _origins(v):
    roster = v.nodes_p.filter("node_type = 'roster'").select(F.col("node_id").alias("ego"))
    n = v.nodes_p.select(F.col("node_id").alias("alter"), E.node_class(v.nodes_p).alias("cls"), "country", "institution")
    return E.both_directions(edges_of(v)).join(roster, "ego", "left_semi").join(n, "alter").filter("cls <> 'roster'")


@query("g15_external_origins", f"WITH {TIES} SELECT cls, n.country, count(DISTINCT alter) AS people, count(DISTINCT paper_id) AS papers {_ORIGINS} WHERE cls <> 'roster' GROUP BY 1, 2")
def g15(v):
    return _origins(v).groupBy("cls", "country").agg(F.count_distinct("alter").alias("people"), F.count_distinct("paper_id").alias("papers"))


@query("g15_top_origins", f"WITH {TIES}, o AS (SELECT n.institution, alter, paper_id {_ORIGINS} WHERE cls <> 'roster'), top AS (SELECT institution AS i FROM o WHERE institution IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12) SELECT coalesce(cast(i AS VARCHAR), 'other') AS kept, count(DISTINCT alter) AS people, count(DISTINCT paper_id) AS papers FROM o LEFT JOIN top ON i = institution GROUP BY 1")
def g15_top(v):
    """The twelve places with most coauthorships, and the others as one: people and papers counted once."""
    return S.keep_top(_origins(v), "institution", 12).groupBy("kept").agg(F.count_distinct("alter").alias("people"), F.count_distinct("paper_id").alias("papers"))


@query("g16_dominant_source", f"WITH {TIES}, x AS (SELECT b.institution, ego, sum(cnt) AS n FROM ties JOIN nodes_p b ON b.node_id = alter WHERE b.node_type <> 'roster' AND b.institution IS NOT NULL GROUP BY 1, 2), y AS (SELECT *, row_number() OVER (PARTITION BY institution ORDER BY n DESC, ego) AS rn, sum(n) OVER (PARTITION BY institution) AS total FROM x) SELECT institution, ego, round(n / total, 8) AS part FROM y WHERE rn = 1 AND n / total >= 0.05")
def g16(v):
    from pyspark.sql import Window

    x = ties_of(v).join(v.nodes_p.filter("node_type <> 'roster' AND institution IS NOT NULL").select(F.col("node_id").alias("alter"), "institution"), "alter").groupBy("institution", "ego").agg(F.sum("count").alias("n"))
    y = x.withColumns({"rn": F.row_number().over(Window.partitionBy("institution").orderBy(F.desc("n"), "ego")), "part": F.col("n") / F.sum("n").over(Window.partitionBy("institution"))})
    return y.filter("rn = 1 AND part >= 0.05").select("institution", "ego", F.round("part", 8).alias("part"))


FLAGS = "fl AS (SELECT c.paper_id, p.year, count(*) FILTER (node_type = 'roster') AS n_roster, bool_or(cls = 'foreign') AS any_foreign, bool_or(cls = 'unknown') AS any_unknown, count(*) AS n FROM capped c JOIN papers_p p ON p.paper_id = c.paper_id JOIN cls ON cls.node_id = c.node_id WHERE edge_eligible GROUP BY 1, 2)"


def flags(v):
    n = v.nodes_p.select("node_id", "node_type", E.node_class(v.nodes_p).alias("cls"))
    own = E.cap_authors(v.pa_p).join(v.papers_p.filter("edge_eligible").select("paper_id", "year"), "paper_id").join(n, "node_id")
    return own.groupBy("paper_id", "year").agg(F.count_if(F.col("node_type") == "roster").alias("n_roster"), F.bool_or(F.col("cls") == "foreign").alias("any_foreign"), F.bool_or(F.col("cls") == "unknown").alias("any_unknown"), F.count(F.lit(1)).alias("n"))


@query("g17_paper_flags", f"WITH {CAPPED}, {CLASS}, {FLAGS} SELECT * FROM fl")
def g17(v):
    return flags(v)


@query("g18_year_series", f"WITH {CAPPED}, {CLASS}, {FLAGS} SELECT year, count(*) AS papers, round(avg(n), 6) AS team, round(avg(CASE WHEN any_foreign THEN 1.0 ELSE 0.0 END), 6) AS foreign_share, round(avg(CASE WHEN n_roster >= 2 THEN 1.0 ELSE 0.0 END), 6) AS roster_share FROM fl GROUP BY 1")
def g18(v):
    share = lambda c, n: F.round(F.avg(c.cast("double")), 6).alias(n)
    return flags(v).groupBy("year").agg(F.count(F.lit(1)).alias("papers"), F.round(F.avg("n"), 6).alias("team"), share(F.col("any_foreign"), "foreign_share"), share(F.col("n_roster") >= 2, "roster_share"))


@query("g20_tie_bins", f"WITH {TIES} SELECT cls, CASE WHEN cnt = 1 THEN '1' WHEN cnt = 2 THEN '2' WHEN cnt <= 4 THEN '3-4' WHEN cnt <= 9 THEN '5-9' ELSE '10+' END AS bin, count(*) AS ties FROM ties GROUP BY 1, 2")
def g20(v):
    return P.tie_bins(ties_of(v))


@query("o25_core_collaborators", f"WITH {TIES}, x AS (SELECT ego, count(*) AS n, count(*) FILTER (cnt >= 10) AS core FROM ties GROUP BY 1) SELECT ego, core, round(core / n::DOUBLE, 8) AS part FROM x WHERE n >= 5")
def o25(v):
    x = ties_of(v).groupBy("ego").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("count") >= 10).alias("core"))
    return x.filter("n >= 5").select("ego", "core", F.round(F.col("core") / F.col("n"), 8).alias("part"))


@query("o24_roster_or_external", f"WITH {CAPPED}, {CLASS}, {FLAGS} SELECT c.node_id, count(*) FILTER (n_roster >= 2) AS with_roster, count(*) FILTER (n >= 2) - count(*) FILTER (n_roster >= 2) AS external_only FROM capped c JOIN fl ON fl.paper_id = c.paper_id JOIN nodes_p r ON r.node_id = c.node_id AND r.node_type = 'roster' GROUP BY 1")
def o24(v):
    roster = v.nodes_p.filter("node_type = 'roster'").select("node_id")
    own = E.cap_authors(v.pa_p).join(roster, "node_id", "left_semi").join(flags(v), "paper_id")
    w = F.count_if(F.col("n_roster") >= 2)
    return own.groupBy("node_id").agg(w.alias("with_roster"), (F.count_if(F.col("n") >= 2) - w).alias("external_only"))


# -- viewer ---------------------------------------------------------------------------------------------------

VIEW = f"""{EVENTS}, vn AS (SELECT *, node_type <> 'roster' AS ext FROM nodes_p WHERE node_type = 'roster' OR NOT unknown_place),
 ve AS (SELECT ev.*, a.ext AS ae, b.ext AS be, a.institution AS ai, b.institution AS bi, a.country AS ac, b.country AS bc FROM ev JOIN vn a ON a.node_id = u JOIN vn b ON b.node_id = v)"""
VPAIRS = f"{VIEW}, vs AS (SELECT * FROM ve WHERE year BETWEEN 1996 AND 1999 AND NOT (ae AND be)), vp AS (SELECT u, v, layer, sum(w1) AS weight, count(DISTINCT item) AS items FROM vs GROUP BY 1, 2, 3 HAVING count(DISTINCT item) >= 2)"
KEY = "kk AS (SELECT node_id, CASE WHEN node_type <> 'roster' THEN 'B' || CASE WHEN unknown_place THEN '?' ELSE cast(country AS VARCHAR) END WHEN institution IS NOT NULL THEN 'I' || institution ELSE 'P' || node_id END AS key FROM nodes_p)"
VQ = W.ViewerQuery(year_from=1996, year_to=1999, peers=False, min_items=2, once=True)


@query("c8_viewer_predicate", f"WITH {VIEW} SELECT layer, year, item, u, v FROM ve WHERE (ai IS NOT DISTINCT FROM 3 OR bi IS NOT DISTINCT FROM 3) AND NOT (ae AND be) AND NOT (coalesce(ai = bi, false) AND NOT ae AND NOT be)")
def c8(v):
    q = W.ViewerQuery(peers=False, institution=3, scope="cross")
    return q.events(events_of(v), v.nodes_p).select("layer", "year", "item", "u", "v")


@query("c8_viewer_country", f"WITH {VIEW} SELECT layer, year, count(*) AS events FROM ve WHERE ac = 2 OR bc = 2 GROUP BY 1, 2")
def c8_country(v):
    return W.ViewerQuery(country=2).events(events_of(v), v.nodes_p).groupBy("layer", "year").agg(F.count(F.lit(1)).alias("events"))


@query("c9_visible_nodes", "SELECT node_id FROM nodes_p WHERE node_type = 'roster' OR NOT unknown_place")
def c9(v):
    return W.ViewerQuery().visible(v.nodes_p).select("node_id")


@query("c13_folded", "SELECT n_nationkey, CASE WHEN n_regionkey = 4 THEN false ELSE cast(n_nationkey AS VARCHAR) IN ('5', '6') OR (n_regionkey = 1 AND cast(n_nationkey AS VARCHAR) NOT IN ('1', '2')) END AS folded FROM nation")
def c13(v):
    n = v.nation.select("n_nationkey", F.col("n_nationkey").cast("string").alias("code"), F.col("n_regionkey").cast("string").alias("county"), F.when(F.col("n_regionkey") == 4, "third").otherwise("first").alias("org"))
    return n.select("n_nationkey", W.folded(False, None, ("5", "6"), {"1": ("1", "2")}).alias("folded"))


@query("f6_viewer_pairs", f"WITH {VPAIRS} SELECT u, v, layer, round(weight, 8) AS weight, items FROM vp")
def f6(v):
    return VQ.pairs(events_of(v), v.nodes_p).withColumn("weight", F.round("weight", 8))


@query("f6_shown_nodes", f"WITH {VPAIRS} SELECT u AS node_id FROM vp UNION SELECT v FROM vp")
def f6_nodes(v):
    return VQ.shown_nodes(events_of(v), v.nodes_p)


@query("f7_group_edges", f"WITH {VPAIRS}, {KEY} SELECT least(a.key, b.key) AS a, greatest(a.key, b.key) AS b, layer, round(sum(weight), 8) AS weight, cast(sum(items) AS BIGINT) AS items, count(*) AS pairs FROM vp JOIN kk a ON a.node_id = u JOIN kk b ON b.node_id = v WHERE a.key <> b.key GROUP BY 1, 2, 3")
def f7(v):
    return VQ.group_edges(events_of(v), v.nodes_p).withColumn("weight", F.round("weight", 8))


@query("f8_group_items", f"WITH {VPAIRS}, {KEY}, g AS (SELECT u, v, layer FROM vp JOIN kk a ON a.node_id = u JOIN kk b ON b.node_id = v WHERE least(a.key, b.key) = 'B1' AND greatest(a.key, b.key) = 'I3') SELECT DISTINCT vs.layer, item FROM vs JOIN g ON g.u = vs.u AND g.v = vs.v AND g.layer = vs.layer")
def f8(v):
    return VQ.group_items(events_of(v), v.nodes_p, "B1", "I3")


@query("g21_group_sizes", f"WITH {VPAIRS}, {KEY}, s AS (SELECT u AS node_id FROM vp UNION SELECT v FROM vp) SELECT key, count(*) AS n FROM s JOIN kk ON kk.node_id = s.node_id GROUP BY 1")
def g21(v):
    return VQ.group_sizes(events_of(v), v.nodes_p)


@query("g22_external_groups", "SELECT country, institution, count(*) AS n FROM nodes_p WHERE node_type <> 'roster' AND institution IS NOT NULL GROUP BY 1, 2")
def g22(v):
    return v.nodes_p.filter("node_type <> 'roster' AND institution IS NOT NULL").groupBy("country", "institution").agg(F.count(F.lit(1)).alias("n"))


@query("o15_profile", f"WITH {CAPPED} SELECT paper_id AS item, year FROM sized WHERE node_id = '000003' ORDER BY year DESC, paper_id LIMIT 80")
def o15(v):
    items = E.cap_authors(v.pa_p).join(v.papers_p.filter("edge_eligible"), "paper_id").select("node_id", F.col("paper_id").alias("item"), "year")
    return W.profile(items, "000003", 80).select("item", "year")


@query("o16_institution_panel", f"WITH {CAPPED}, {OWN} SELECT n.node_id, count(own.paper_id) AS papers FROM nodes_p n LEFT JOIN own ON own.node_id = n.node_id WHERE node_type = 'roster' AND institution = 3 GROUP BY 1")
def o16(v):
    return g1(v).join(v.nodes_p.filter("node_type = 'roster' AND institution = 3").select("node_id"), "node_id", "left_semi").select("node_id", "papers")


@query("o17_place_panel", f"WITH {VPAIRS}, s AS (SELECT u AS node_id FROM vp UNION SELECT v FROM vp), n AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY name) AS r FROM nodes_p) SELECT country, count(*) AS members, count(s.node_id) AS shown, string_agg(name, ',' ORDER BY name) FILTER (r <= 3) AS names FROM n LEFT JOIN s ON s.node_id = n.node_id GROUP BY 1")
def o17(v):
    return W.place_panel(v.nodes_p, VQ.shown_nodes(events_of(v), v.nodes_p))


@query("o19_name_search", "SELECT node_id FROM nodes_p WHERE name = 'Supplier#000000007' OR node_id = '000009'")
def o19(v):
    return v.nodes_p.filter("name = 'Supplier#000000007' OR node_id = '000009'").select("node_id")

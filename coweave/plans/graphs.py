"""Queries on graph measures: people who sign papers together, at a grain at which components, bridges and isolates occur at every
size of the test tables. Events are those of eligible papers with the cap of authors, as everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import graph as G
from ..operators.lineage import cut
from .registry import query

_LISTED = """cap_g AS (SELECT paper_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ln, node_id) AS rn FROM authors_g) WHERE rn <= 10),
 el_g AS (SELECT c.paper_id, c.node_id FROM cap_g c JOIN papers_p p ON p.paper_id = c.paper_id WHERE p.edge_eligible {0})"""
_PAIRS = "gr AS MATERIALIZED (SELECT a.node_id AS u, b.node_id AS v, count(*) AS count FROM el_g a JOIN el_g b ON b.paper_id = a.paper_id AND a.node_id < b.node_id {0} GROUP BY 1, 2 {1})"
_NB = "nb AS MATERIALIZED (SELECT u, v FROM gr UNION ALL SELECT v, u FROM gr)"
_BOTH = "JOIN people_g x ON x.node_id = a.node_id AND x.node_type = 'roster' JOIN people_g y ON y.node_id = b.node_id AND y.node_type = 'roster'"
GRAPH = f"{_LISTED.format('')}, {_PAIRS.format('', '')}, {_NB}"
ROSTER = f"{_LISTED.format('')}, {_PAIRS.format(_BOTH, '')}, {_NB}"
_COMP = "comp(node, component) USING KEY (node) AS (SELECT u, min(least(u, v)) FROM {0} GROUP BY 1 UNION SELECT e.v, min(comp.component) FROM comp JOIN {0} e ON e.u = comp.node JOIN recurring.comp r ON r.node = e.v WHERE comp.component < r.component GROUP BY 1)"
#: Distances and numbers of shortest paths of all connected pairs of nodes, from the pairs of a table.
_PATHS = "sp(s, t, d, sigma) USING KEY (s, t) AS (SELECT u, v, 1, 1.0::DOUBLE FROM {0} UNION SELECT p.s, e.v, p.d + 1, sum(p.sigma) FROM sp p JOIN {0} e ON e.u = p.t LEFT JOIN recurring.sp q ON q.s = p.s AND q.t = e.v WHERE q.s IS NULL AND e.v <> p.s GROUP BY p.s, e.v, p.d)"
_LARGEST = "big AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), lc AS MATERIALIZED (SELECT u, v FROM nb JOIN comp ON node = u JOIN big USING (component))"
_SHARES = "b AS (SELECT l.t AS node, sum(l.sigma * r.sigma / p.sigma) AS b FROM sp l JOIN sp r ON r.s = l.t JOIN sp p ON p.s = l.s AND p.t = r.t AND p.d = l.d + r.d WHERE l.s < r.t GROUP BY 1)"


def graph(v, external: bool = True, layer: str = "pub", year_from: int | None = None, year_to: int | None = None, scope: str = "all", min_count: int = 1) -> DataFrame:
    """Pairs u < v with their counts, of the events that are asked for."""
    papers = E.paper_edges(v.papers_p, E.cap_authors(v.authors_g))
    events = E.select_events(E.edge_events(papers, E.project_edges(v.projects_p)), v.people_g, layer, year_from, year_to, external, scope)
    return E.aggregate_pairs(events, min_count, once=True)


def pairs_of(v, external: bool = True) -> DataFrame:
    """All pairs, or those of roster members, written once for a set of views."""
    return v.once(("pairs", external), lambda: cut(graph(v, external=external)))


def components_of(v, external: bool = True) -> DataFrame:
    return v.once(("components", external), lambda: cut(G.connected_components(pairs_of(v, external))))


def _people(v, *columns: str) -> DataFrame:
    return v.people_g.select(F.col("node_id").alias("node"), *columns)


def _part(v) -> DataFrame:
    return _people(v, F.col("institution").cast("string").alias("community")).filter("community IS NOT NULL")


@query("j1_components", f"WITH RECURSIVE {GRAPH}, {_COMP.format('nb')} SELECT node, component FROM comp")
def j1(v):
    return components_of(v)


@query("j1_component_sizes", f"WITH RECURSIVE {GRAPH}, {_COMP.format('nb')}, z AS (SELECT component, count(*) AS size FROM comp GROUP BY 1) SELECT size, count(*) AS components FROM z GROUP BY 1")
def j1_sizes(v):
    return components_of(v).groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


@query("f4_graph_options", f"WITH {_LISTED.format('AND p.year BETWEEN 1994 AND 1999')}, {_PAIRS.format('JOIN people_g x ON x.node_id = a.node_id JOIN people_g y ON y.node_id = b.node_id AND y.institution = x.institution', 'HAVING count(*) >= 1')} SELECT u, v, count FROM gr")
def f4_options(v):
    return graph(v, year_from=1994, year_to=1999, scope="within").select("u", "v", "count")


@query("j2_degree", f"WITH {GRAPH} SELECT u AS node, count(*) AS degree FROM nb GROUP BY 1")
def j2(v):
    return G.degree(pairs_of(v))


@query("j3_betweenness", f"WITH RECURSIVE {ROSTER}, {_COMP.format('nb')}, {_LARGEST}, {_PATHS.format('lc')}, {_SHARES}, n AS (SELECT count(DISTINCT u) AS n FROM lc) SELECT DISTINCT lc.u AS node, round(coalesce(b.b, 0) * CASE WHEN n > 2 THEN 2.0 / ((n - 1) * (n - 2)) ELSE 1.0 END, 8) AS betweenness FROM lc CROSS JOIN n LEFT JOIN b ON b.node = lc.u")
def j3(v):
    """Within the largest component, by its own number of nodes."""
    within = components_of(v, False)
    return G.betweenness(G.largest_component(pairs_of(v, False), within), components=within).withColumn("betweenness", F.round("betweenness", 8))


@query("j3_betweenness_all", f"WITH RECURSIVE {ROSTER}, {_PATHS.format('nb')}, {_SHARES}, n AS (SELECT count(*)::DOUBLE AS n FROM people_g WHERE node_type = 'roster') SELECT DISTINCT nb.u AS node, round(coalesce(b.b, 0) * 2.0 / ((n - 1) * (n - 2)) * 1e6, 6) AS per_million FROM nb CROSS JOIN n LEFT JOIN b ON b.node = nb.u")
def j3_all(v):
    """Over all pairs of roster members, those without a partner included."""
    n = v.people_g.filter("node_type = 'roster'").count()
    return G.betweenness(pairs_of(v, False), n, components=components_of(v, False)).select("node", F.round(F.col("betweenness") * 1e6, 6).alias("per_million"))


@query("j4_paths", f"WITH RECURSIVE {ROSTER}, {_COMP.format('nb')}, {_LARGEST}, {_PATHS.format('lc')} SELECT round(avg(d), 8) AS average_path, cast(max(d) AS INT) AS diameter FROM sp")
def j4(v):
    within = components_of(v, False)
    return G.path_statistics(G.largest_component(pairs_of(v, False), within), components=within).withColumn("average_path", F.round("average_path", 8))


#: All authors of all papers, at the grain at which nearly everybody knows everybody.
_DENSE = "g0 AS (SELECT DISTINCT a.node_id AS u, b.node_id AS v, a.paper_id FROM pa_p a JOIN pa_p b ON a.paper_id = b.paper_id AND a.node_id < b.node_id), gr AS (SELECT u, v, count(DISTINCT paper_id) AS count FROM g0 GROUP BY 1, 2), nb AS (SELECT u, v FROM gr UNION ALL SELECT v, u FROM gr)"


@query("j5_transitivity", f"WITH {_DENSE}, t AS (SELECT count(*) AS triangles FROM gr a JOIN gr b ON b.u = a.v JOIN gr c ON c.u = a.u AND c.v = b.v), d AS (SELECT u, count(*) AS k FROM nb GROUP BY 1), q AS (SELECT cast(sum(k * (k - 1) / 2) AS BIGINT) AS triples FROM d) SELECT triangles, triples, round(3.0 * triangles / triples, 8) AS transitivity FROM t, q")
def j5(v):
    return G.transitivity_of_lists(v.pa_p.select("paper_id", "node_id")).withColumn("transitivity", F.round("transitivity", 8))


@query("j6_density", f"WITH {GRAPH}, n AS (SELECT count(*) AS n FROM people_g) SELECT round(2e6 * count(*) / any_value(n::DOUBLE * (n - 1)), 8) AS per_million FROM gr, n")
def j6(v):
    return G.density(pairs_of(v), v.people_g).select(F.round(F.col("density") * 1e6, 8).alias("per_million"))


@query("j7_leiden")
def j7(v):
    return G.leiden(pairs_of(v, False), components=components_of(v, False))


@query("j8_modularity", f"WITH {GRAPH}, e AS (SELECT count AS w, a.institution AS cu, b.institution AS cv FROM gr JOIN people_g a ON a.node_id = u JOIN people_g b ON b.node_id = v WHERE a.institution IS NOT NULL AND b.institution IS NOT NULL), m AS (SELECT sum(w) AS m, sum(w) FILTER (cu = cv) AS i FROM e), k AS (SELECT c, sum(w) AS k FROM (SELECT cu AS c, w FROM e UNION ALL SELECT cv, w FROM e) GROUP BY 1) SELECT round(coalesce(any_value(i), 0)::DOUBLE / any_value(m) - sum((k / (2.0 * m)) ** 2), 8) AS modularity FROM k, m")
def j8(v):
    return G.modularity(pairs_of(v), _part(v), "count").select(F.round("modularity", 8).alias("modularity"))


@query("j8_component_modularity", f"WITH RECURSIVE {ROSTER}, {_COMP.format('nb')}, k AS (SELECT component, 2.0 * sum(count) AS k FROM gr JOIN comp ON node = u GROUP BY 1) SELECT round(1 - sum((k / t) ** 2), 8) AS modularity FROM k, (SELECT 2.0 * sum(count) AS t FROM gr)")
def j8_components(v):
    """Components as communities: what any partition into communities has to beat."""
    pairs = pairs_of(v, False)
    return G.modularity(pairs, components_of(v, False).withColumnRenamed("component", "community"), "count").select(F.round("modularity", 8).alias("modularity"))


@query("j9_community_graph", f"WITH {GRAPH} SELECT least(cast(a.institution AS VARCHAR), cast(b.institution AS VARCHAR)) AS a, greatest(cast(a.institution AS VARCHAR), cast(b.institution AS VARCHAR)) AS b, count(*) AS edges FROM gr JOIN people_g a ON a.node_id = u JOIN people_g b ON b.node_id = v WHERE a.institution <> b.institution GROUP BY 1, 2")
def j9(v):
    return G.community_graph(pairs_of(v), _part(v))


@query("j9_leiden_graph")
def j9_leiden(v):
    """Edges between the communities found in the graph of all people, and the modularity of these."""
    pairs = pairs_of(v)
    part = cut(G.leiden(pairs, components=components_of(v)))
    return G.community_graph(pairs, part).crossJoin(F.broadcast(G.modularity(pairs, part, "count")))  # one row


@query("j10_homophily", f"WITH {ROSTER} SELECT count(*) AS pairs, round(avg(CASE WHEN a.institution = b.institution THEN 1.0 ELSE 0.0 END), 8) AS same FROM gr JOIN people_g a ON a.node_id = u JOIN people_g b ON b.node_id = v WHERE a.institution IS NOT NULL AND b.institution IS NOT NULL")
def j10(v):
    return G.same_attribute_share(pairs_of(v, False), _people(v, F.col("institution").alias("attribute"))).withColumn("same", F.round("same", 8))


ATTRIBUTES = ["brand", "kind", "field", "rank_group", "age", "institution"]
_DG = ", dg AS MATERIALIZED (SELECT u, count(*) AS k FROM nb GROUP BY 1)"
_BIN = "CASE WHEN k <= 1 THEN '1' WHEN k = 2 THEN '2' WHEN k <= 4 THEN '3-4' WHEN k <= 8 THEN '5-8' ELSE '9+' END"
_KEYS = ", ".join(f"cast('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) & 2147483647 AS {c}" for k, c in enumerate("abk"))


def _swaps(rounds: int, draws: int) -> str:
    """Each place in each draw, round by round, as the places are in ``att`` (node, s, attribute, i, n)."""
    steps = [f"w0 AS (SELECT draw, node, s, n, i AS x FROM att, range({draws}) d(draw))"]
    for r in range(rounds):
        q = "(k % n - x + n) % n"
        steps.append(f"w{r + 1} AS (SELECT draw, node, s, n, CASE WHEN ((a * greatest(x, {q}) + b) >> 30) & 1 = 1 THEN {q} ELSE x END AS x FROM w{r} JOIN keys USING (draw) WHERE round = {r})")
    return ", ".join(steps)


def _permutations(s: str, attribute: str, draws: int, rounds: int = 20) -> str:
    return f"""WITH {ROSTER}{_DG}, att AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM (SELECT node_id AS node, cast({attribute} AS VARCHAR) AS attribute, {s} AS s FROM people_g JOIN dg ON dg.u = node_id WHERE {attribute} IS NOT NULL)),
 keys AS MATERIALIZED (SELECT draw, round, {_KEYS} FROM (SELECT draw, round, md5(concat_ws('|', '0', draw, round)) AS h FROM range({draws}) d(draw), range({rounds}) r(round))), {_swaps(rounds, draws)},
 pl AS MATERIALIZED (SELECT w.draw, w.node, att.attribute FROM w{rounds} w JOIN att ON att.s = w.s AND att.i = w.x),
 nul AS (SELECT a.draw, avg(CASE WHEN a.attribute = b.attribute THEN 1.0 ELSE 0.0 END) AS share FROM gr JOIN pl a ON a.node = u JOIN pl b ON b.node = v AND b.draw = a.draw GROUP BY 1),
 obs AS (SELECT count(*) AS pairs, avg(CASE WHEN a.attribute = b.attribute THEN 1.0 ELSE 0.0 END) AS observed FROM gr JOIN att a ON a.node = u JOIN att b ON b.node = v)
 SELECT '{attribute}' AS attribute, any_value(pairs) AS pairs, round(any_value(observed), 8) AS observed, round(avg(share), 8) AS mean, round(quantile_cont(share, 0.025), 8) AS low, round(quantile_cont(share, 0.975), 8) AS high, round((count(*) FILTER (share >= observed - 1e-12) + 1) / (count(*) + 1)::DOUBLE, 8) AS p FROM nul, obs"""


def _rounded(df):
    return df.select("attribute", "pairs", *[F.round(c, 8).alias(c) for c in ("observed", "mean", "low", "high", "p")])


@query("j11_permutation", _permutations("''", "institution", 200))
def j11(v):
    return _rounded(G.permutation_test(pairs_of(v, False), _people(v, "institution"), ["institution"], 200))


def _binned(v, pairs):
    return _people(v, *ATTRIBUTES).join(G.degree(pairs), "node").withColumn("bin", G.degree_bin(F.col("degree")))


@query("j11_permutation_by_degree", _permutations(_BIN, "kind", 200))
def j11_degree(v):
    pairs = pairs_of(v, False)
    return _rounded(G.permutation_test(pairs, _binned(v, pairs), ["kind"], 200, stratum="bin"))


@query("j11_all_attributes")
def j11_all(v):
    """1,000 draws of six attributes, freely and within bins of the degree."""
    pairs = pairs_of(v, False)
    people = cut(_binned(v, pairs))
    free, tied = (G.permutation_test(pairs, people, ATTRIBUTES, 1000, stratum=s).withColumn("model", F.lit(s or "free")) for s in (None, "bin"))
    return free.unionByName(tied)


@query("j12_degree_bins", f"WITH {GRAPH}{_DG} SELECT {_BIN} AS bin, count(*) AS nodes FROM dg GROUP BY 1")
def j12(v):
    return G.degree(pairs_of(v)).groupBy(G.degree_bin(F.col("degree")).alias("bin")).agg(F.count(F.lit(1)).alias("nodes"))


@query("j13_inside_subset", f"WITH {GRAPH} SELECT count(*) AS edges FROM gr JOIN people_g a ON a.node_id = u JOIN people_g b ON b.node_id = v WHERE a.value > 950 AND b.value > 950")
def j13(v):
    rich = v.people_g.filter("value > 950").select("node_id")
    p = pairs_of(v)
    return p.join(rich.toDF("u"), "u", "left_semi").join(rich.toDF("v"), "v", "left_semi").agg(F.count(F.lit(1)).alias("edges"))


_PCT = "(rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / count(*) OVER ()"


def _percentiles(v):
    from ..functions.stats import percent_rank_average

    return percent_rank_average(v.people_g.select(F.col("node_id").alias("v"), "value"), "value", "pct").select("v", "pct")


@query("d18_neighbour_percentile", f"WITH {GRAPH}, pc AS (SELECT node_id, {_PCT} AS pct FROM people_g) SELECT nb.u AS node, round(avg(pct), 8) AS partners FROM nb JOIN pc ON pc.node_id = nb.v GROUP BY 1")
def d18(v):
    return G.neighbours(pairs_of(v)).join(_percentiles(v), "v").groupBy(F.col("u").alias("node")).agg(F.round(F.avg("pct"), 8).alias("partners"))


@query("o30_partners_by_quartile", f"WITH {GRAPH}, pc AS (SELECT node_id, value, {_PCT} AS pct FROM people_g), q AS (SELECT quantile_cont(value, 0.25) AS a, median(value) AS b, quantile_cont(value, 0.75) AS c FROM people_g), x AS (SELECT nb.u AS node, avg(pct) AS partners FROM nb JOIN pc ON pc.node_id = nb.v GROUP BY 1) SELECT 1 + cast(value > a AS INT) + cast(value > b AS INT) + cast(value > c AS INT) AS quantile_group, round(avg(partners), 8) AS partners FROM x JOIN pc ON pc.node_id = node, q GROUP BY 1")
def o30(v):
    from ..functions.stats import quantile_group

    own = G.neighbours(pairs_of(v)).join(_percentiles(v), "v").groupBy(F.col("u").alias("node_id")).agg(F.avg("pct").alias("partners"))
    return own.join(quantile_group(v.people_g.select("node_id", "value"), "value"), "node_id").groupBy("quantile_group").agg(F.round(F.avg("partners"), 8).alias("partners"))


@query("o29_isolates", f"WITH {ROSTER} SELECT node_id, institution, value FROM people_g WHERE node_type = 'roster' AND node_id NOT IN (SELECT u FROM nb)")
def o29(v):
    """Roster members without a partner in the roster."""
    return v.people_g.filter("node_type = 'roster'").select("node_id", "institution", "value").join(G.neighbours(pairs_of(v, False)).select(F.col("u").alias("node_id")), "node_id", "left_anti")


@query("g27_top_members", f"WITH RECURSIVE {GRAPH}, {_COMP.format('nb')}, x AS (SELECT component, n.country, count(*) AS n FROM comp JOIN people_g n ON n.node_id = node GROUP BY 1, 2) SELECT component, country, n FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, country) AS rn FROM x) WHERE rn <= 2")
def g27(v):
    c = components_of(v).join(_people(v, "country"), "node").groupBy("component", "country").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), "country"))
    return c.withColumn("rn", rank).filter("rn <= 2").drop("rn")

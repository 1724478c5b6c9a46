"""The analysis programs on collaboration, from one table of roster members: their partners by class, papers, ties and grants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import edges as E
from ..operators import graph as G
from ..operators import people as P
from ..operators.lineage import cut
from . import graphs
from .registry import query

BIG_TEAM, CORE, TOP = 6, 2, 25
_SIZED = """sz AS MATERIALIZED (SELECT paper_id, node_id, count(*) OVER (PARTITION BY paper_id) AS n FROM el_g),
 pr AS MATERIALIZED (SELECT a.paper_id, a.node_id AS ego, b.node_id AS alter, a.n FROM sz a JOIN sz b ON b.paper_id = a.paper_id AND a.node_id <> b.node_id),
 kl AS (SELECT node_id, node_type, CASE WHEN node_type = 'roster' THEN 'roster' WHEN unknown_place THEN 'unknown' WHEN institution IS NULL THEN CASE WHEN country = 0 THEN 'domestic' ELSE 'foreign' END ELSE CASE WHEN country = 0 THEN 'home' ELSE 'foreign' END END AS cls FROM people_g),
 ti AS MATERIALIZED (SELECT ego, alter, any_value(cls) AS cls, count(*) AS cnt, min(n) AS least FROM pr JOIN kl ON kl.node_id = alter GROUP BY 1, 2),
 tc AS (SELECT ego, count(*) AS n_collab, count(*) FILTER (cls = 'roster') AS n_roster, count(*) FILTER (cls = 'home') AS n_home, count(*) FILTER (cls = 'domestic') AS n_domestic, count(*) FILTER (cls = 'foreign') AS n_foreign, count(*) FILTER (cls = 'unknown') AS n_unknown, count(*) FILTER (least < {0}) AS n_collab_small, count(*) FILTER (cnt >= {1}) AS n_core FROM ti GROUP BY 1),
 ro AS (SELECT paper_id, count(*) AS rostered FROM sz JOIN kl USING (node_id) WHERE node_type = 'roster' GROUP BY 1),
 ow AS (SELECT sz.node_id AS ego, count(*) AS papers, count(*) FILTER (pub_category = '1-URGENT') AS journal, count(*) FILTER (n >= 2) AS coauth, count(*) FILTER (n = 1) AS solo, count(*) FILTER (n >= 2 AND rostered >= 2) AS coauth_roster FROM sz JOIN papers_p USING (paper_id) LEFT JOIN ro USING (paper_id) GROUP BY 1),
 fu AS (SELECT node_id AS ego, sum(amount) AS funding FROM grants_g WHERE is_pi AND research GROUP BY 1),
 pt AS MATERIALIZED (SELECT k.node_id AS ego, coalesce(n_collab, 0) AS n_collab, coalesce(n_roster, 0) AS n_roster, coalesce(n_home, 0) AS n_home, coalesce(n_domestic, 0) AS n_domestic, coalesce(n_foreign, 0) AS n_foreign, coalesce(n_unknown, 0) AS n_unknown, coalesce(n_collab_small, 0) AS n_collab_small, coalesce(n_core, 0) AS n_core, coalesce(papers, 0) AS papers, coalesce(journal, 0) AS journal, coalesce(coauth, 0) AS coauth, coalesce(solo, 0) AS solo, coalesce(coauth_roster, 0) AS coauth_roster, coalesce(funding, 0) AS funding
   FROM kl k LEFT JOIN tc ON tc.ego = k.node_id LEFT JOIN ow ON ow.ego = k.node_id LEFT JOIN fu ON fu.ego = k.node_id WHERE k.node_type = 'roster')""".format(BIG_TEAM, CORE)
TABLE = f"{graphs._LISTED.format('')}, {_SIZED}"


def table(v) -> DataFrame:
    """A row for each roster member: partners by class, without big teams and core ones, papers by kind, grants."""
    authors = E.cap_authors(v.authors_g)
    edges = E.paper_edges(v.papers_p, authors)
    base = P.person_collab(edges, v.people_g, v.papers_p, authors, "1-URGENT", BIG_TEAM)
    core = E.ego_ties(edges, v.people_g, once=True).filter(F.col("count") >= CORE).groupBy("ego").agg(F.count(F.lit(1)).alias("n_core"))
    roster = v.people_g.filter("node_type = 'roster'").select("node_id")
    own = authors.select("paper_id", "node_id").join(v.papers_p.filter("edge_eligible").select("paper_id"), "paper_id", "left_semi")
    shared = own.join(roster, "node_id", "left_semi").groupBy("paper_id").agg(F.collect_list("node_id").alias("members")).filter("size(members) >= 2")  # ten at most
    with_roster = shared.select(F.explode("members").alias("ego")).groupBy("ego").agg(F.count(F.lit(1)).alias("coauth_roster"))
    grants = v.grants_g.filter("is_pi AND research").groupBy(F.col("node_id").alias("ego")).agg(F.sum("amount").alias("funding"))
    return cut(base.join(core, "ego", "left").join(with_roster, "ego", "left").join(grants, "ego", "left").fillna(0))


def _tidy(rows: DataFrame, part: str, key: Column, *measures: str) -> DataFrame:
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m).cast("double"), 6).alias("value")) for m in measures])
    return rows.select(F.lit(part).alias("part"), key.cast("string").alias("key"), F.explode(values).alias("m")).select("part", "key", "m.*")


def _tidy_sql(part: str, source: str, key: str, *measures: str) -> str:
    return " UNION ALL ".join(f"SELECT '{part}' AS part, cast({key} AS VARCHAR) AS key, '{m}' AS measure, round(cast({m} AS DOUBLE), 6) AS value FROM {source}" for m in measures)


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# -- who works together most ---------------------------------------------------------------------------------------------------

_BY_PARTNERS = ("n_collab", "n_roster", "n_home", "n_domestic", "n_foreign", "n_unknown", "n_collab_small")
_BY_PAPERS = ("coauth", "coauth_roster", "ext_only", "solo")
_LISTS = f"""{TABLE}, l1 AS (SELECT * FROM pt ORDER BY n_collab DESC, coauth DESC, ego LIMIT {TOP}), l2 AS (SELECT *, coauth - coauth_roster AS ext_only FROM pt ORDER BY coauth DESC, n_collab DESC, ego LIMIT {TOP})"""


@query("ca01_top_lists", f"WITH {_LISTS} {_tidy_sql('partners', 'l1', 'ego', *_BY_PARTNERS)} UNION ALL {_tidy_sql('papers', 'l2', 'ego', *_BY_PAPERS)}")
def ca01(v):
    t = table(v).withColumn("ext_only", F.col("coauth") - F.col("coauth_roster"))
    by_partners = t.orderBy(F.desc("n_collab"), F.desc("coauth"), "ego").limit(TOP)
    by_papers = t.orderBy(F.desc("coauth"), F.desc("n_collab"), "ego").limit(TOP)
    return _all(_tidy(by_partners, "partners", F.col("ego"), *_BY_PARTNERS), _tidy(by_papers, "papers", F.col("ego"), *_BY_PAPERS))


# -- whether few have most of it -----------------------------------------------------------------------------------------------

MEASURES = ("n_collab", "n_collab_small", "n_roster", "coauth")
_LONG = f"{TABLE}, lo AS MATERIALIZED ({' UNION ALL '.join(f'''SELECT '{m}' AS name, ego, {m} AS x FROM pt''' for m in MEASURES)})"
_RANKED = f"{_LONG}, rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY name ORDER BY x, ego) AS i, count(*) OVER (PARTITION BY name) AS n, sum(x) OVER (PARTITION BY name) AS total FROM lo)"


def _long(v) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).alias("x")) for m in MEASURES]))
    return table(v).select("ego", each.alias("e")).select("e.name", "ego", "e.x")


_SHARES = f"""{_RANKED}, gi AS (SELECT name, sum((2 * i - n - 1) * x) / (any_value(n) * any_value(total))::DOUBLE AS gini FROM rk GROUP BY 1),
 ts AS (SELECT name, sum(x) FILTER (i > n - greatest(1, round_even(n * 0.1, 0))) / any_value(total)::DOUBLE AS top10, sum(x) FILTER (i > n - greatest(1, round_even(n * 0.25, 0))) / any_value(total)::DOUBLE AS top25, 1 - sum(x) FILTER (i > n - greatest(1, round_even(n * 0.5, 0))) / any_value(total)::DOUBLE AS bottom50 FROM rk GROUP BY 1),
 cc AS (SELECT name, x, 1 - (min(i) - 1)::DOUBLE / any_value(n) AS ccdf FROM (SELECT name, x, row_number() OVER (PARTITION BY name ORDER BY x) AS i, count(*) OVER (PARTITION BY name) AS n FROM lo WHERE x > 0) GROUP BY 1, 2)"""


@query("ca02_measures", f"WITH {_SHARES} {_tidy_sql('gini', 'gi', 'name', 'gini')} UNION ALL {_tidy_sql('shares', 'ts', 'name', 'top10', 'top25', 'bottom50')} UNION ALL {_tidy_sql('ccdf', 'cc', '''name || '|' || x''', 'ccdf')}")
def ca02(v):
    """Gini, shares of the top and the bottom, and how many reach each value, for the four measures of collaboration."""
    d = _long(v)
    shares = S.top_share(d, "x", 0.1, "name").toDF("name", "top10").join(S.top_share(d, "x", 0.25, "name").toDF("name", "top25"), "name").join(S.top_share(d, "x", 0.5, "name").toDF("name", "half"), "name").withColumn("bottom50", 1 - F.col("half"))
    known = d.filter("x > 0")
    counts = S._counts(known, "x", ["name"])
    totals = known.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    ccdf = counts.join(totals, "name").withColumn("ccdf", 1 - F.col("_a") / F.col("n"))
    return _all(_tidy(S.gini(d, "x", "name"), "gini", F.col("name"), "gini"), _tidy(shares, "shares", F.col("name"), "top10", "top25", "bottom50"), _tidy(ccdf, "ccdf", F.concat_ws("|", "name", F.col("x").cast("string")), "ccdf"))


# -- collaboration and output --------------------------------------------------------------------------------------------------

_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
_FIT = f"""{TABLE}, bo AS MATERIALIZED (SELECT *, log10(n_collab) AS lx, log10(journal) AS ly FROM pt WHERE n_collab > 0 AND journal > 0),
 ft AS (SELECT regr_slope(ly, lx) AS slope, regr_intercept(ly, lx) AS intercept, corr(lx, ly) AS r, count(*) AS n FROM bo),
 rs AS MATERIALIZED (SELECT ego, ly - intercept - slope * lx AS resid FROM bo, ft WHERE journal >= 2 OR n_collab >= 8),
 hi AS (SELECT * FROM rs ORDER BY round(resid, 9) DESC, ego LIMIT 6), ls AS (SELECT * FROM rs ORDER BY round(resid, 9), ego LIMIT 6),
 sp AS (SELECT corr(a, b) AS rho FROM (SELECT {_AVG_RANK.format('n_collab')} AS a, {_AVG_RANK.format('journal')} AS b FROM pt)),
 so AS (SELECT ego, solo / papers::DOUBLE AS solo_share FROM pt WHERE journal >= 1 AND papers > 0 AND solo / papers::DOUBLE >= 0.5)"""


@query("ca08_output", f"WITH {_FIT} {_tidy_sql('fit', 'ft', chr(39) * 2, 'slope', 'intercept', 'r', 'n')} UNION ALL {_tidy_sql('spearman', 'sp', chr(39) * 2, 'rho')} UNION ALL {_tidy_sql('above', 'hi', 'ego', 'resid')} UNION ALL {_tidy_sql('below', 'ls', 'ego', 'resid')} UNION ALL {_tidy_sql('solo', 'so', 'ego', 'solo_share')}")
def ca08(v):
    """Partners against journal papers: the trend of the logarithms, rank correlation, who is far off, and who works alone."""
    t = table(v)
    both = t.filter("n_collab > 0 AND journal > 0").withColumns({"lx": F.log10("n_collab"), "ly": F.log10("journal")})
    off = S.residuals(both, "lx", "ly").filter("journal >= 2 OR n_collab >= 8").withColumnRenamed("residual", "resid")
    above = off.orderBy(F.desc(F.round("resid", 9)), "ego").limit(6)
    below = off.orderBy(F.round("resid", 9), "ego").limit(6)
    solo = t.filter("journal >= 1 AND papers > 0").withColumn("solo_share", F.col("solo") / F.col("papers")).filter("solo_share >= 0.5")
    one = F.lit("")
    return _all(_tidy(S.ols(both, "lx", "ly"), "fit", one, "slope", "intercept", "r", "n"), _tidy(S.spearman(t, "n_collab", "journal"), "spearman", one, "rho"), _tidy(above, "above", F.col("ego"), "resid"), _tidy(below, "below", F.col("ego"), "resid"), _tidy(solo, "solo", F.col("ego"), "solo_share"))


# -- grants and collaboration --------------------------------------------------------------------------------------------------

_RANKS = ("n_collab", "n_collab_small", "n_roster", "btw", "n_core", "n_foreign", "journal")
_CLASS_SUMS = ("n_roster", "n_home", "n_domestic", "n_foreign", "n_unknown")
_LINK = f"""{TABLE}, {graphs._PAIRS.format(graphs._BOTH, '')}, {graphs._NB}, {graphs._PATHS.format('nb')}, {graphs._SHARES},
 pb AS MATERIALIZED (SELECT pt.*, round(coalesce(b.b, 0), 6) AS btw FROM pt LEFT JOIN b ON b.node = pt.ego),
 r0 AS (SELECT corr(a, b) AS rho FROM (SELECT {_AVG_RANK.format('funding')} AS a, {_AVG_RANK.format('n_collab')} AS b FROM pt)),
 r1 AS (SELECT corr(a, b) AS rho FROM (SELECT {_AVG_RANK.format('funding')} AS a, {_AVG_RANK.format('n_collab')} AS b FROM pt WHERE funding > 0)),
 r2 AS (SELECT corr(a, b) AS rho FROM (SELECT {_AVG_RANK.format('funding')} AS a, {_AVG_RANK.format('n_roster')} AS b FROM pt)),
 ra AS (SELECT ego, funding, {', '.join(f"100 * ({_AVG_RANK.format(c)}) / count(*) OVER () AS p_{c}" for c in _RANKS)} FROM pb),
 tp AS (SELECT * FROM ra ORDER BY funding DESC, ego LIMIT {TOP}),
 ba AS MATERIALIZED (SELECT * FROM pt WHERE journal >= 1), bl AS (SELECT regr_slope(log10(funding), log10(journal)) AS s, regr_intercept(log10(funding), log10(journal)) AS i FROM ba WHERE funding > 0),
 br AS MATERIALIZED (SELECT ba.*, round(log10(greatest(funding, 1000)) - i - s * log10(journal), 9) AS resid FROM ba, bl),
 bq AS (SELECT quantile_cont(resid, 0.25) AS lo, quantile_cont(resid, 0.75) AS hi FROM br),
 gr2 AS MATERIALIZED (SELECT 'high' AS grp, br.* FROM br, bq WHERE resid >= hi UNION ALL SELECT 'low', br.* FROM br, bq WHERE resid <= lo),
 gs AS (SELECT grp, count(*) AS n, median(journal) AS journal, median(funding) AS funding, median(n_collab) AS n_collab, median(n_roster) AS partners, {', '.join(f'sum({c}) / sum(n_collab)::DOUBLE AS s_{c}' for c in _CLASS_SUMS)} FROM gr2 GROUP BY 1)"""


@query(
    "ca10_grants_and_partners",
    f"WITH RECURSIVE {_LINK} {_tidy_sql('rho_all', 'r0', chr(39) * 2, 'rho')} UNION ALL {_tidy_sql('rho_funded', 'r1', chr(39) * 2, 'rho')} UNION ALL {_tidy_sql('rho_roster', 'r2', chr(39) * 2, 'rho')} UNION ALL {_tidy_sql('percentiles', 'tp', 'ego', *(f'p_{c}' for c in _RANKS))} UNION ALL {_tidy_sql('groups', 'gs', 'grp', 'n', 'journal', 'funding', 'n_collab', 'partners', *(f's_{c}' for c in _CLASS_SUMS))}",
)
def ca10(v):
    """Grants against partners: rank correlations, where the best funded stand in seven measures, and the partners of those with more
    or less money than their papers let expect."""
    t = table(v)
    shares = G.betweenness(graphs.pairs_of(v, False), 3, components=graphs.components_of(v, False)).select(F.col("node").alias("ego"), F.round("betweenness", 6).alias("btw"))
    t = cut(t.join(shares, "ego", "left").fillna(0.0, ["btw"]), t)
    rho = [_tidy(S.spearman(d, "funding", c), name, F.lit(""), "rho") for name, d, c in (("rho_all", t, "n_collab"), ("rho_funded", t.filter("funding > 0"), "n_collab"), ("rho_roster", t, "n_roster"))]
    top = t.orderBy(F.desc("funding"), "ego").limit(TOP)
    for c in _RANKS:
        place = S.percent_rank_average(t.select("ego", c), c, f"p_{c}").select("ego", (100 * F.col(f"p_{c}")).alias(f"p_{c}"))
        top = top.join(place, "ego")
    base = t.filter("journal >= 1").withColumns({"lj": F.log10("journal"), "lf": F.log10(F.greatest("funding", F.lit(1000.0)))})
    fit = S.ols(base.filter("funding > 0").withColumn("lf", F.log10("funding")), "lj", "lf").select("slope", "intercept")
    base = base.crossJoin(F.broadcast(fit)).withColumn("resid", F.round(F.col("lf") - F.col("intercept") - F.col("slope") * F.col("lj"), 9))  # one row
    base = base.crossJoin(F.broadcast(S.exact_quantiles(base, [], "resid", {"lo": 0.25, "hi": 0.75})))  # one row
    groups = base.filter("resid >= hi").withColumn("grp", F.lit("high")).unionByName(base.filter("resid <= lo").withColumn("grp", F.lit("low")))
    sums = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[(F.sum(c) / F.sum("n_collab")).alias(f"s_{c}") for c in _CLASS_SUMS])
    for c, name in (("journal", "journal"), ("funding", "funding"), ("n_collab", "n_collab"), ("n_roster", "partners")):
        sums = sums.join(S.exact_median(groups, ["grp"], c, name), "grp")
    return _all(*rho, _tidy(top, "percentiles", F.col("ego"), *(f"p_{c}" for c in _RANKS)), _tidy(sums, "groups", F.col("grp"), "n", "journal", "funding", "n_collab", "partners", *(f"s_{c}" for c in _CLASS_SUMS)))

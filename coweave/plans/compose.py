"""Queries on enrichment, lookups, departments and derived tables: whole flows over stand-ins of the outside services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import departments as D
from ..functions import geo as X
from ..operators import enrich as R
from ..operators import lookups as K
from .network import EVENTS, TIES, events_of, ties_of
from .records import FIELDS, STRENGTH
from .registry import query


def _pick(words, number):
    return F.get(F.array(*[F.lit(w) for w in words]), (number % len(words)).cast("int"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("i11_ordered_union", "SELECT o_custkey, array_to_string(list_filter(list_concat(a, b), lambda x, i: list_position(list_concat(a, b), x) = i), ',') AS labels FROM (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderkey % 2 = 0) AS a0, list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderkey % 2 = 1) AS b0, coalesce(a0, []) AS a, coalesce(b0, []) AS b FROM orders GROUP BY 1)")
def i11(v):
    part = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 2 == k, F.struct("o_orderkey", "o_orderpriority")))), lambda x: x["o_orderpriority"])
    lists = v.orders.groupBy("o_custkey").agg(part(0).alias("a"), part(1).alias("b"))
    return lists.select("o_custkey", F.array_join(R.ordered_union(F.col("a"), F.col("b")), ",").alias("labels"))


@query("e18_merge_aliases", "WITH n AS (SELECT s_suppkey AS id, ['a' || s_suppkey % 7, 'b' || s_suppkey % 5] AS l FROM supplier), m AS (SELECT id AS f, id - 1 AS t FROM n WHERE id % 10 = 3), x AS (SELECT n.id, coalesce(o.l, []) AS more, n.l FROM n LEFT JOIN m ON m.t = n.id LEFT JOIN n o ON o.id = m.f WHERE n.id NOT IN (SELECT f FROM m)) SELECT id AS node_id, array_to_string(list_filter(list_concat(l, more), lambda y, i: list_position(list_concat(l, more), y) = i), ',') AS aliases FROM x")
def e18(v):
    k = F.col("s_suppkey")
    nodes = v.supplier.select(k.alias("node_id"), F.array(F.concat(F.lit("a"), (k % 7).cast("string")), F.concat(F.lit("b"), (k % 5).cast("string"))).alias("aliases"))
    merges = v.supplier.filter("s_suppkey % 10 = 3").select(k.alias("from_node_id"), (k - 1).alias("to_node_id"))
    return R.merge_aliases(nodes, merges, "aliases").select("node_id", F.array_join("aliases", ",").alias("aliases"))


PEOPLE = "pe0 AS (SELECT c_custkey AS node_id, c_custkey % 3 = 0 AS is_roster, n_name AS institution, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE n_name || ' University' END AS ext, c_custkey % 11 AS n_papers FROM customer JOIN nation ON n_nationkey = c_nationkey), ou AS (SELECT *, CASE WHEN is_roster THEN CASE WHEN institution < 'M' THEN 'National ' || institution || ' College' ELSE institution END ELSE ext END AS ours FROM pe0)"


def people_of(v):
    k = F.col("c_custkey")
    ext = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat("n_name", F.lit(" University"))))
    return v.customer.join(v.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(k.alias("node_id"), (k % 3 == 0).alias("is_roster"), F.col("n_name").alias("institution"), ext.alias("institutions"), (k % 11).alias("n_papers"))


def institutions_of(v):
    return v.nation.filter("n_name < 'M'").select(F.col("n_name").alias("name"), F.concat(F.lit("National "), "n_name", F.lit(" College")).alias("name_en"))


@query("o4_own_institution", f"WITH {PEOPLE} SELECT node_id, ours FROM ou")
def o4(v):
    return R.own_institution(people_of(v), institutions_of(v)).select("node_id", "ours")


_METHODS = [m for m, _ in C.METHOD_STRENGTH]
_FIELD = "CASE o_orderkey % 4 WHEN 0 THEN 'Energy' WHEN 1 THEN 'Physics' WHEN 2 THEN 'Psychology' ELSE 'Medicine' END"
_TOKENS = "list_filter(list_distinct(regexp_split_to_array(lower({0}), '[^a-z]+')), lambda t: t <> '' AND NOT list_contains(" + _list(C.INSTITUTION_STOP) + ", t))"


@query("o5_enrich", f"""WITH {PEOPLE}, pr AS (SELECT 'A' || o_orderkey AS author_id, {_FIELD} AS field, CASE WHEN o_orderkey % 3 = 0 THEN 'TW' WHEN o_orderkey % 3 = 1 THEN 'US' ELSE '' END AS country, o_orderkey % 500 AS works, CASE WHEN o_orderkey % 2 = 0 THEN n_name || ' University' ELSE 'Other Place' END AS inst, o_custkey AS node_id, ({_list(_METHODS)})[1 + o_orderkey % 7] AS method, o_orderkey % 3 AS own_works, o_orderpriority AS evidence FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
 s AS (SELECT pr.*, {STRENGTH} AS st, field IN ({FIELDS}) AS ok, is_roster, ours, n_papers FROM pr JOIN ou ON ou.node_id = pr.node_id),
 d AS (SELECT *, CASE WHEN own_works >= 2 THEN 'high' WHEN st = 4 THEN 'high' WHEN own_works = 1 THEN 'medium' WHEN st >= 2 AND ok AND (NOT is_roster OR country = 'TW') THEN 'low' WHEN st = 1 AND ok AND country = 'TW' THEN 'low' END AS confidence FROM s),
 c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY own_works DESC, st DESC, method DESC, author_id DESC, evidence DESC) AS rn FROM d WHERE confidence IS NOT NULL) WHERE rn = 1),
 t AS (SELECT *, is_roster AND country NOT IN ('TW', '') AS f1, NOT ok AS f2, works >= 250 AND (n_papers = 0 OR works > 8 * n_papers) AS f3, {_TOKENS.format('ours')} AS ta, {_TOKENS.format('inst')} AS tb FROM c),
 g AS (SELECT *, CASE WHEN NOT (f1 OR f2 OR f3) THEN 'no_flag' WHEN NOT f2 THEN 'rule1_country_or_volume_only' WHEN trim(ours) = '' THEN 'rule3_no_institution_on_record' WHEN len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb)) > 0 AND len(list_intersect(ta, tb)) / least(len(ta), len(tb)) >= 0.5 THEN 'rule2_institution_matches' ELSE 'rule4_keep_our_institution_only' END AS rule FROM t)
 SELECT ou.node_id, CASE WHEN rule NOT LIKE 'rule4%' THEN author_id END AS author_id, CASE WHEN rule NOT LIKE 'rule4%' THEN method ELSE 'none' END AS method, coalesce(rule, '') AS rule FROM ou LEFT JOIN g ON g.node_id = ou.node_id""")
def o5(v):
    k = F.col("o_orderkey")
    at = v.customer.join(v.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    rows = v.orders.join(at, "o_custkey").select(F.col("o_custkey").alias("node_id"), F.concat(F.lit("A"), k.cast("string")).alias("author_id"), _pick(_METHODS, k).alias("method"), (k % 3).alias("own_works"), F.col("o_orderpriority").alias("evidence"), _pick(("Energy", "Physics", "Psychology", "Medicine"), k).alias("field"), _pick(("TW", "US", ""), k).alias("country"), (k % 500).alias("works"), F.when(k % 2 == 0, F.concat("n_name", F.lit(" University"))).otherwise("Other Place").alias("last_institution"))
    found = R.enrich(people_of(v), rows.select("node_id", "method", "author_id", "evidence", "own_works"), rows.select("author_id", "field", "country", "works", "last_institution"), institutions_of(v))
    return found.select("node_id", "author_id", "method", "rule")


@query("o3_institution_tokens", f"SELECT p_partkey, array_to_string(list_sort({_TOKENS.format('concat(p_name, chr(32), p_type)')}), ',') AS tokens FROM part")
def o3(v):
    return v.part.select("p_partkey", F.array_join(F.array_sort(C.institution_tokens(F.concat_ws(" ", "p_name", "p_type"))), ",").alias("tokens"))


@query("o9_missing_affiliations", "SELECT c_custkey AS node_id FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def o9(v):
    src = F.when(F.col("c_mktsegment") == "MACHINERY", "journal_pdf").when(F.col("c_mktsegment") != "BUILDING", "works")
    before = v.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("node_id"))
    return R.missing_affiliations(v.customer.select(F.col("c_custkey").alias("node_id"), src.alias("affil_source")), before).select("node_id")


_RULES = [("Review A", "URGENT|HIGH"), ("Review B", "^[34]-")]


@query("o6_journal_targets", "SELECT o_orderkey AS paper_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Review A' ELSE 'Review B' END AS journal FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 4 = 0)")
def o6(v):
    nodes = v.lineitem.groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.collect_set("l_suppkey").alias("node_ids"))
    papers = v.orders.select(F.col("o_orderkey").alias("paper_id"), F.lit("t").alias("title"), F.col("o_orderpriority").alias("venue")).join(nodes, "paper_id")
    missing = v.supplier.filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("node_id"))
    return R.journal_targets(papers, missing, _RULES).select("paper_id", "journal")


@query("o7_match_titles", "WITH c AS (SELECT p_partkey AS ord, p_name AS a, CASE WHEN p_size % 3 = 0 THEN '' ELSE upper(p_type) || '!' END AS b FROM part WHERE p_partkey % 2 = 0), k AS (SELECT ord, regexp_replace(lower(t), '[^0-9a-z]', '', 'g') AS key FROM (SELECT ord, a AS t FROM c UNION ALL SELECT ord, b FROM c) WHERE t <> ''), f AS (SELECT key, min(ord) AS ord FROM k GROUP BY 1), g AS (SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 4 = 1 THEN p_type ELSE p_name || '.' END AS t FROM part) SELECT paper_id, ord FROM g JOIN f ON f.key = regexp_replace(lower(t), '[^0-9a-z]', '', 'g')")
def o7(v):
    c = v.part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("ord"), F.lit("u").alias("url"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.upper("p_type"), F.lit("!"))).alias("title_en"))
    t = v.part.select(F.col("p_partkey").alias("paper_id"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_type")).otherwise(F.concat("p_name", F.lit("."))).alias("title"))
    return R.match_titles(t, c).select("paper_id", "ord")


@query("o8_page_affiliations", "WITH p AS (SELECT o_orderkey AS paper_id, o_custkey AS a, o_orderkey % 3 AS how FROM orders), x AS (SELECT a AS node_id, '國立清華大學' AS institution, 'place' AS method, 'high' AS confidence, 0 AS r, paper_id FROM p WHERE how = 0 UNION ALL SELECT a, CASE WHEN a % 2 = 0 THEN 'First' ELSE 'Second' END, 'email', 'medium', 1, paper_id FROM p WHERE how = 1) SELECT node_id, institution, method, confidence FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY r, paper_id, institution) AS rn FROM x) WHERE rn = 1")
def o8(v):
    k, name = F.col("o_orderkey") % 3, F.concat(F.lit("n"), F.translate(F.col("o_custkey").cast("string"), "0123456789", "abcdefghij"))
    mail = F.concat(F.lit("write to x@econ."), F.when(F.col("o_custkey") % 2 == 0, "first").otherwise("second"), F.lit(".edu for 經濟"))
    note = F.concat(F.lit("題目\n"), name, F.lit("\n國立清華大學 教授\n"))
    pages = v.orders.select(F.col("o_orderkey").alias("paper_id"), F.when(k == 0, note).when(k == 1, mail).otherwise("nothing here").alias("text"), F.array(name).alias("authors"), F.array("o_custkey").alias("node_ids"))
    people = v.customer.select(F.col("c_custkey").alias("node_id"), F.concat(F.lit("n"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij")).alias("key"))
    domains = v.spark.createDataFrame([("first.edu", "First", 1), ("second.edu", "Second", 2)], "suffix string, institution string, ord int")
    return R.page_affiliations(pages, people, domains)


# -- departments and places -----------------------------------------------------------------------------------


@query("o13_name_variants", "WITH i AS (SELECT n_nationkey, list_filter(list_distinct(list_concat([regexp_replace(lower(n_name), '[^0-9a-z]', '', 'g'), 'univ' || n_nationkey], CASE WHEN n_nationkey % 4 = 0 THEN ['alias' || n_nationkey] ELSE [] END)), lambda x: length(x) > 4) AS names FROM nation) SELECT node_id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN length(own) > 4 THEN [own] ELSE [] END, coalesce(names, CASE WHEN label IS NOT NULL AND length(label) > 4 THEN [label] ELSE [] END)))), ',') AS variants FROM (SELECT s_suppkey AS node_id, 'own' || s_suppkey % 40 AS own, CASE WHEN s_suppkey % 3 = 1 THEN s_nationkey END AS code, CASE WHEN s_suppkey % 3 = 2 THEN 'place' || s_suppkey % 9 END AS label FROM supplier) LEFT JOIN i ON n_nationkey = code")
def o13(v):
    k = F.col("s_suppkey")
    people = v.supplier.select(k.alias("node_id"), F.concat(F.lit("Own "), (k % 40).cast("string")).alias("institution"))
    places = v.supplier.filter("s_suppkey % 3 > 0").select(k.alias("node_id"), F.when(k % 3 == 1, F.col("s_nationkey")).alias("institution_code"), F.when(k % 3 == 2, F.concat(F.lit("Place-"), (k % 9).cast("string"))).alias("label"))
    n = F.col("n_nationkey").cast("string")
    institutions = v.nation.select(F.col("n_nationkey").alias("institution_code"), F.col("n_name").alias("name"), F.concat(F.lit("Univ. "), n).alias("name_en"))
    aliases = v.nation.filter("n_nationkey % 4 = 0").select(F.concat(F.lit("Alias "), n).alias("alias"), F.col("n_name").alias("name"))
    return R.name_variants(people, places, institutions, aliases).select("node_id", F.array_join("variants", ",").alias("variants"))


@query("k14_roster_code", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_nationkey WHEN 1 THEN s_nationkey WHEN 2 THEN CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey END END AS institution_code FROM supplier")
def k14(v):
    n = v.nation.select(F.col("n_nationkey").alias("institution_code"), F.col("n_name").alias("name"), F.concat(F.lit("Univ. "), F.col("n_nationkey").cast("string")).alias("name_en"))
    aliases = v.nation.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("Alias "), F.col("n_nationkey").cast("string")).alias("alias"), F.concat(F.lit("univ "), F.col("n_nationkey").cast("string")).alias("name"))
    k, at = F.col("s_suppkey") % 4, F.col("s_nationkey").cast("string")
    names = v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat(F.lit("UNIV "), at)).when(k == 2, F.concat(F.lit("alias-"), at)).otherwise("nowhere").alias("name"))
    return R.roster_code(names, n, aliases).select("s_suppkey", "institution_code")


@query("k15_guarded_match", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 2 THEN s_nationkey END AS code FROM supplier")
def k15(v):
    return v.supplier.select("s_suppkey", R.guarded_roster_match(_pick(("TW", "", "US"), F.col("s_suppkey")), F.col("s_nationkey")).alias("code"))


_SIGNED = ("Department of Economics, University of {0}, Taipei", "University of {0}, Graduate Institute of Finance", "Ministry of Labor, Division of Work, College of Law, University of {0}", "國立{0}大學財政學系", "University of {0}", "School of Business University of {0} Taiwan")
_UNITS = ("Department of Economics", "Graduate Institute of Finance", "College of Law", "財政學系", None, "School of Business University of {0}")


@query("m10_unit", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Department of Economics' WHEN 1 THEN 'Graduate Institute of Finance' WHEN 2 THEN 'College of Law' WHEN 3 THEN '財政學系' END AS unit FROM supplier")
def m10(v):
    at = F.array(*[F.replace(F.lit(s), F.lit("{0}"), F.col("s_name")) for s in _SIGNED[:5]])
    key = F.array(F.regexp_replace(F.lower(F.concat(F.lit("universityof"), "s_name")), "[^0-9a-z]", ""))
    return v.supplier.select("s_suppkey", D.unit(F.get(at, (F.col("s_suppkey") % 5).cast("int")), key).alias("unit"))


@query("m11_external_departments", """WITH s AS (SELECT l_suppkey AS node_id, 1995 + l_linenumber AS year, CASE l_partkey % 3 WHEN 0 THEN 'Department of Economics' WHEN 1 THEN 'College of Law' ELSE 'Institute of Finance' END AS unit FROM lineitem WHERE l_partkey % 4 <> 3),
 c AS (SELECT node_id, unit, count(*) AS n, max(year) AS last FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, last DESC, unit) AS rn FROM c),
 w AS (SELECT node_id, max(unit) FILTER (rn = 1) AS unit, coalesce(string_agg(unit, ';' ORDER BY rn) FILTER (rn BETWEEN 2 AND 4), '') AS others FROM r GROUP BY 1)
 SELECT s_suppkey AS node_id, CASE WHEN s_suppkey % 5 = 0 THEN '財政學系' ELSE w.unit END AS unit, CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN '財政學系' ELSE '' END WHEN w.unit = 'Department of Economics' THEN '經濟學系' ELSE '' END AS dept, CASE WHEN s_suppkey % 5 = 0 THEN 'manual_verified' ELSE 'works' END AS src, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE others END AS others FROM supplier JOIN w ON w.node_id = s_suppkey""")
def m11(v):
    k = F.col("s_suppkey")
    people = v.supplier.select(k.alias("node_id"), F.when(k % 5 == 0, "manual_verified").otherwise("works").alias("affil_source"), F.when(k % 5 == 0, "國立政治大學財政學系").otherwise("").alias("affil_primary"), F.array().cast("array<string>").alias("affil_all"))
    name = F.concat(F.lit("University of X"), F.col("l_suppkey").cast("string"))
    unit = _pick(("Department of Economics", "College of Law", "Institute of Finance"), F.col("l_partkey"))
    text = F.when(F.col("l_partkey") % 4 == 3, "Department of History, Another Place").otherwise(F.concat_ws(", ", unit, name))
    signed = v.lineitem.select(F.col("l_suppkey").alias("node_id"), (1995 + F.col("l_linenumber")).alias("year"), F.array(text).alias("strings"), F.array().cast("array<string>").alias("institutions"))
    variants = v.supplier.select(k.alias("node_id"), F.array(F.concat(F.lit("universityofx"), k.cast("string"))).alias("variants"))
    have = v.supplier.select(k.alias("node_id"), F.when(k % 2 == 0, F.array(F.lit("經濟學系"), F.lit("財政學系"))).otherwise(F.array(F.lit("經濟學系"))).alias("departments"))
    d = D.external_departments(people, signed, variants, have).join(v.lineitem.filter("l_partkey % 4 <> 3").select(F.col("l_suppkey").alias("node_id")).distinct(), "node_id", "left_semi")
    return d.select("node_id", "unit", "dept", "src", F.array_join("others", ";").alias("others"))


@query("k8_packed_positions", "WITH p AS (SELECT s_suppkey AS node_id, s_nationkey AS place, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3, s_suppkey) - 1 AS i FROM supplier), r AS (SELECT *, cast(ceil((sqrt(9.0 + 12 * i) - 3) / 6) AS INT) AS ring FROM p) SELECT node_id, ring, round(CASE WHEN ring > 0 THEN ring * cos(2 * pi() * (i - 1 - 3 * ring * (ring - 1)) / (6 * ring)) ELSE 0 END, 6) + 0.0 AS dx FROM r")
def k8(v):
    members = v.supplier.select(F.col("s_nationkey").alias("place"), (F.col("s_suppkey") % 3).alias("grp"), F.col("s_suppkey").alias("node_id"))
    return X.packed_positions(members).select("node_id", "ring", (F.round("dx", 6) + 0.0).alias("dx"))


# -- derived tables -------------------------------------------------------------------------------------------


@query("o14_derive_grants", """WITH r AS (SELECT o_orderkey AS record_id, o_custkey AS teacher_id, cast(year(o_orderdate) AS INT) AS y, o_orderkey % 9 = 0 AS bad, o_orderstatus <> 'P' AS is_pi, o_orderkey % 7 = 0 AS marked, o_orderpriority < '4' AND o_orderkey % 9 <> 0 AS research, cast(round(o_totalprice) AS DOUBLE) AS amount FROM orders),
 g AS (SELECT *, CASE WHEN bad THEN NULL ELSE y END AS year FROM r), q AS (SELECT *, CASE WHEN is_pi AND research THEN lead(year) OVER (PARTITION BY teacher_id, is_pi AND research ORDER BY year, record_id) - year END AS gap_next FROM g)
 SELECT record_id, record_id % 11 <> 0 AS aligned, amount, year, is_pi, marked, cast(gap_next AS INT) AS gap_next, cast(CASE WHEN is_pi AND research AND NOT marked AND year >= 2006 THEN least(greatest(coalesce(nullif(gap_next, 0), 1), 1), 3) ELSE 1 END AS INT) AS dur FROM q""")
def o14(v):
    k = F.col("o_orderkey")
    year = F.when(k % 9 == 0, "none").otherwise((F.year("o_orderdate") - 1911).cast("string"))
    title = F.concat(F.lit("Trade "), k.cast("string"), F.when(k % 7 == 0, " (1/3)").otherwise(""))
    role = F.when(F.col("o_orderstatus") != "P", "計畫主持人").otherwise("共同主持人")
    base = v.orders.select(k.alias("record_id"), F.col("o_custkey").alias("teacher_id"), year.alias("roc_year"), F.when(F.col("o_orderpriority") < "4", "專題研究計畫(一般)").otherwise("補助").alias("grant_category"), title.alias("project_title"), role.alias("role"), F.concat(F.lit("NT$ "), F.format_number(F.round("o_totalprice"), 0)).alias("amount_text"))
    page = base.select("teacher_id", F.col("record_id").alias("ord"), "roc_year", F.when(F.col("record_id") % 11 == 0, "changed").otherwise(F.col("project_title")).alias("project_title"), "role", "amount_text")
    people = v.customer.select(F.col("c_custkey").alias("teacher_id"), F.lit("x").alias("node_id"))
    return R.derive_grants(base.drop("amount_text"), page, people).select("record_id", "aligned", "amount", "year", "is_pi", "marked", "gap_next", "dur")


@query("g24_discipline_counts", "WITH c AS (SELECT l_suppkey AS person, CASE WHEN l_returnflag = 'A' THEN 'x' WHEN l_returnflag = 'N' THEN 'y' END AS code, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2) SELECT person, string_agg(code || n, ',' ORDER BY code) AS counts FROM c GROUP BY 1")
def g24(v):
    codes = v.spark.createDataFrame([("A", "x"), ("N", "y")], "discipline string, code string")
    c = R.discipline_counts(v.lineitem.select(F.col("l_suppkey").alias("person"), F.col("l_returnflag").alias("discipline")), codes)
    return c.select("person", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("g25_coverage", "WITH n AS (SELECT node_type, institution, country FROM nodes_p) SELECT node_type AS population, 'institution' AS column, count(institution) AS filled, count(*) AS rows FROM n GROUP BY 1 UNION ALL SELECT node_type, 'country', count(country), count(*) FROM n GROUP BY 1")
def g25(v):
    return R.coverage({k: v.nodes_p.filter(F.col("node_type") == k) for k in ("roster", "external")}, ["institution", "country"])


@query("m3_roster_attributes", "SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS short, CASE WHEN c_mktsegment < 'F' THEN 'topic ' || c_mktsegment END AS topic FROM customer JOIN nation ON n_nationkey = c_nationkey")
def m3(v):
    people = v.customer.join(v.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_name").alias("institution"), F.col("c_mktsegment").alias("topic_code"))
    short = v.nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("institution"), F.lower("n_name").alias("short"))
    topics = v.customer.filter("c_mktsegment < 'F'").select(F.col("c_mktsegment").alias("code")).distinct().withColumn("label", F.concat(F.lit("topic "), "code"))
    return R.roster_attributes(people, short, topics).select("c_custkey", "short", "topic")


@query("o26_top_institutions", f"WITH {TIES}, a AS (SELECT DISTINCT alter FROM ties), n AS (SELECT country, institution, count(*) AS people FROM a JOIN nodes_p ON node_id = alter WHERE institution IS NOT NULL GROUP BY 1, 2) SELECT country, institution, people, cast(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY people DESC, institution) AS rn FROM n) WHERE rn <= 3")
def o26(v):
    return R.top_institutions(ties_of(v), v.nodes_p.select("node_id", "country", "institution"), 3)


@query("f10_edge_payload", f"WITH {EVENTS}, i AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS at FROM nodes_p) SELECT least(a.at, b.at) AS a, greatest(a.at, b.at) AS b, CASE WHEN layer = 'pub' THEN 0 ELSE 1 END AS layer, year, item, round(w1, 4) AS w FROM ev JOIN i a ON a.node_id = u JOIN i b ON b.node_id = v")
def f10(v):
    e = R.edge_payload(events_of(v), v.nodes_p)
    return e.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"), "layer", "year", "item", "w")


# -- lookups --------------------------------------------------------------------------------------------------


@query("a21_fill_cache", "SELECT p_partkey AS key, CASE WHEN p_size % 4 = 0 THEN 'old' ELSE NULL END AS value FROM part WHERE p_size % 4 = 0 UNION ALL SELECT DISTINCT l_partkey, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'v' || l_partkey END FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 4 = 0)")
def a21(v):
    cache = v.part.filter("p_size % 4 = 0").select(F.col("p_partkey").alias("key"), F.lit("old").alias("value"))
    return K.fill_cache(v.lineitem.select(F.col("l_partkey").alias("key")), cache, lambda keys: {k: f"v{k}" for k in keys if k % 3}, "key")


@query("a21_fetch_contents", "SELECT sha1(url) AS id, max(CASE WHEN length(url) % 5 = 0 THEN 0 ELSE length(url) END) AS size FROM pages WHERE url IS NOT NULL GROUP BY 1")
def a21_contents(v):
    cache = v.spark.createDataFrame([], "id string, content binary")
    got = K.fetch_contents(v.pages.filter("url IS NOT NULL"), cache, lambda url: url.encode() if len(url) % 5 else None)
    return got.select("id", F.length("content").alias("size"))


@query("a22_match_items", "SELECT p_partkey AS paper_id, CASE p_partkey % 4 WHEN 0 THEN 'd' || p_partkey WHEN 1 THEN 'near' || p_partkey WHEN 2 THEN 'same' || p_partkey END AS item, CASE WHEN p_partkey % 4 = 0 THEN 'doi' ELSE 'title' END AS how FROM part WHERE p_partkey % 4 < 3")
def a22(v):
    k = F.col("p_partkey")
    key = F.regexp_replace(F.lower(F.concat("p_name", "p_type", F.lit("on growth and trade"))), "[^a-z]", "")
    papers = v.part.select(k.alias("paper_id"), F.when(k % 4 == 0, F.concat(F.lit("doi"), k.cast("string"))).otherwise("").alias("doi"), key.alias("title_key"))
    by_doi = v.part.select(F.concat(F.lit("doi"), k.cast("string")).alias("doi"), F.concat(F.lit("d"), k.cast("string")).alias("item"))
    hit = lambda ord, name, title, where: v.part.filter(where).select(k.alias("paper_id"), F.lit(ord).alias("ord"), F.concat(F.lit(name), k.cast("string")).alias("item"), title.alias("title_key"))
    hits = hit(1, "far", F.lit("zzzzzzzzqqqqqqqqxxxxxx"), "p_partkey % 4 > 0").unionByName(hit(2, "near", F.concat(key, F.lit("x")), "p_partkey % 4 = 1")).unionByName(hit(3, "same", key, "p_partkey % 4 = 2"))
    return K.match_items(papers, by_doi, hits)


@query("a23_first_coordinates", "SELECT id, any_value(lat) AS lat, any_value(lon) AS lon FROM (SELECT c_custkey // 5 AS id, c_custkey, (c_custkey % 70)::DOUBLE + 0.5 AS lat, -(c_custkey % 90)::DOUBLE - 0.25 AS lon, row_number() OVER (PARTITION BY c_custkey // 5 ORDER BY c_custkey) AS rn FROM customer WHERE c_custkey % 7 <> 0) WHERE rn = 1 GROUP BY 1")
def a23(v):
    k = F.col("c_custkey")
    point = F.when(k % 7 == 0, "unknown").otherwise(F.concat(F.lit("Point(-"), (k % 90).cast("string"), F.lit(".25 "), (k % 70).cast("string"), F.lit(".5)")))
    return R.first_coordinates(v.customer.select(F.floor(k / 5).alias("id"), k.alias("ord"), point.alias("point")))


@query("a24_wanted_affiliations", "SELECT l_suppkey AS author_id, l_orderkey AS work, cast(1990 + l_linenumber AS INT) AS year FROM lineitem WHERE l_suppkey % 3 = 0 AND l_linenumber <> 2")
def a24(v):
    one = F.struct(F.col("l_suppkey").alias("author_id"), F.when(F.col("l_linenumber") == 2, F.array().cast("array<string>")).otherwise(F.array(F.col("l_orderkey").cast("string"))).alias("strings"), F.array(F.lit("I")).alias("institutions"))
    works = v.lineitem.groupBy("l_orderkey", (1990 + F.col("l_linenumber")).cast("int").alias("publication_year")).agg(F.collect_list(one).alias("authorships"))
    got = R.wanted_affiliations(works, v.supplier.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("author_id")))
    return got.select("author_id", F.get("strings", F.lit(0)).cast("bigint").alias("work"), "year")

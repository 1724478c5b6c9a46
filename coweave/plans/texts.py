"""Queries on titles, names, affiliations, pages, places and sheets: rules on text built from the tables' own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import affiliations as A
from ..functions import geo as X
from ..functions import names as N
from ..functions import pages as H
from ..operators import linkage as L
from ..operators import papers as R
from ..operators import review as Q
from ..sources import readers as I
from ..sources import sinks as O
from .registry import query


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _pick(words, number):
    return F.get(F.array(*[F.lit(w) for w in words]), (number % len(words)).cast("int"))


# -- titles and names -----------------------------------------------------------------------------------------


@query("e1_norm_title", "SELECT doc_id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]', '', 'g')) AS k FROM documents")
def e1(v):
    return v.documents.select("doc_id", F.md5(N.norm_title(F.col("text")).cast("binary")).alias("k"))


PARTS = "pt AS (SELECT c_custkey, [c_mktsegment, ['A. B.', 'Anna', 'Jo-Ann', 'K.'][1 + c_custkey % 4], n_name, ['and FURNITURE*', 'E.', '王小明', ''][1 + c_custkey % 4], CASE WHEN c_custkey % 7 = 0 THEN 'MACHINERY' ELSE n_name END] AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey)"
CLEAN = "cl AS (SELECT c_custkey, list_filter(list_transform(raw, lambda x: regexp_replace(trim(x), '[*＊]+$', '')), lambda x: x <> '') AS p FROM pt)"
_BARE = "(regexp_matches({0}, '^\\p{{L}}{{2,12}}$') AND NOT regexp_matches({0}, '[\\x{{4e00}}-\\x{{9fff}}]'))"
_GIVEN = "(NOT regexp_matches({0}, '[\\x{{4e00}}-\\x{{9fff}}]') AND regexp_matches({0}, '[. -]') AND NOT " + _BARE + ")"
_WORD = "regexp_replace({0}, '(?i)^(and|與|及)\\s+', '')"


def name_parts(v):
    k = F.col("c_custkey")
    parts = F.array("c_mktsegment", _pick(("A. B.", "Anna", "Jo-Ann", "K."), k), "n_name", _pick(("and FURNITURE*", "E.", "王小明", ""), k), F.when(k % 7 == 0, "MACHINERY").otherwise(F.col("n_name")))
    return v.customer.join(v.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.array_join(parts, "|").alias("raw"))


#: One text is carried along: what is done, and behind ^ a surname that waits for a given name.
_RESPLIT = f"""WITH {PARTS}, {CLEAN} SELECT c_custkey, replace(ltrim(list_reduce(list_prepend('', p), lambda a, x:
    CASE WHEN contains(a, '^') AND {_GIVEN.format("x")} THEN replace(a, '^', '') || ', ' || x
         ELSE replace(a, '^', '') || ';' || CASE WHEN {_BARE.format(_WORD.format("x"))} THEN '^' ELSE '' END || {_WORD.format("x")} END), ';'), '^', '') AS names FROM cl"""


@query("e7_resplit", _RESPLIT)
def e7(v):
    return name_parts(v).select("c_custkey", F.array_join(N.resplit(F.col("raw")), ";").alias("names"))


LISTS = """pp AS (SELECT o_orderkey AS paper_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'incomplete_author_list|x' WHEN '2-HIGH' THEN 'published_author_list_conflict' WHEN '3-MEDIUM' THEN 'unresolved_author_identity_or_fragment' ELSE 'x' END AS hold FROM orders),
 nn AS (SELECT paper_id, list(CASE WHEN node_id LIKE '%5' THEN 'EXT-U-' || node_id ELSE node_id END ORDER BY ln, node_id) AS nodes FROM pa_p GROUP BY 1),
 sc AS (SELECT l_orderkey AS paper_id, l_returnflag AS record_id, list(DISTINCT 'S' || l_suppkey ORDER BY 'S' || l_suppkey) AS names FROM lineitem GROUP BY 1, 2),
 lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY length(array_to_string(names, '|')) DESC, record_id) AS rn FROM sc) WHERE rn = 1)"""


@query("e9_author_repair", f"""WITH {LISTS}, ru AS (SELECT paper_id, CASE WHEN hold LIKE 'incomplete%' THEN 'C_incomplete_web_lookup' WHEN hold LIKE 'published%' THEN 'A_resplit_author_list' WHEN hold LIKE 'unresolved%' THEN 'B_drop_unidentifiable' END AS rule FROM pp),
 fo AS (SELECT paper_id, list_transform(list_filter(names, lambda x: NOT x LIKE '%3'), lambda x: lpad(substr(x, 2), 6, '0')) AS found FROM lo),
 al AS (SELECT ru.paper_id, rule, len(nodes) AS n_before, CASE left(rule, 1) WHEN 'A' THEN found WHEN 'B' THEN nodes ELSE list_concat(nodes, found) END AS a FROM ru JOIN nn ON nn.paper_id = ru.paper_id JOIN fo ON fo.paper_id = ru.paper_id WHERE rule IS NOT NULL)
 SELECT paper_id, rule, cast(n_before AS INT) AS n_before, array_to_string(list_filter(list_filter(a, lambda x, i: list_position(a, x) = i), lambda x: NOT starts_with(x, 'EXT-U-')), ',') AS nodes FROM al""")
def e9(v):
    hold = F.when(F.col("o_orderpriority") == "1-URGENT", "incomplete_author_list|x").when(F.col("o_orderpriority") == "2-HIGH", "published_author_list_conflict").when(F.col("o_orderpriority") == "3-MEDIUM", "unresolved_author_identity_or_fragment").otherwise("x")
    node = F.when(F.col("node_id").endswith("5"), F.concat(F.lit("EXT-U-"), "node_id")).otherwise(F.col("node_id"))
    listed = v.pa_p.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ln", "node_id", node.alias("n")))), lambda x: x["n"]).alias("node_ids"))
    papers = v.orders.select(F.col("o_orderkey").alias("paper_id"), hold.alias("hold_reason")).join(listed, "paper_id")
    name = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    sources = v.lineitem.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("record_id")).agg(F.array_join(F.array_sort(F.collect_set(name)), "|").alias("original_author_list"))
    longest = R.first_by(sources, ["paper_id"], F.desc(F.length("original_author_list")), "record_id")
    lookups = longest.select("paper_id", F.split("original_author_list", "\\|").alias("names"))
    known = v.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("node_id"))
    resolved = known.withColumn("node_id", F.when(~F.col("name").endswith("3"), F.col("node_id")))
    return Q.repair_author_lists(papers, sources, lookups, resolved).select("paper_id", "rule", "n_before", F.array_join("node_ids", ",").alias("nodes"))


@query("e14_list_fixes", f"WITH {LISTS} SELECT nn.paper_id, array_to_string(coalesce(CASE WHEN nn.paper_id % 3 = 0 THEN lo.names END, nodes), ',') AS nodes FROM nn LEFT JOIN lo ON lo.paper_id = nn.paper_id")
def e14(v):
    node = F.when(F.col("node_id").endswith("5"), F.concat(F.lit("EXT-U-"), "node_id")).otherwise(F.col("node_id"))
    listed = v.pa_p.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ln", "node_id", node.alias("n")))), lambda x: x["n"]).alias("node_ids"))
    name = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    sets = v.lineitem.groupBy(F.col("l_orderkey").alias("paper_id"), "l_returnflag").agg(F.array_sort(F.collect_set(name)).alias("node_ids"))
    fixes = R.first_by(sets.filter("paper_id % 3 = 0"), ["paper_id"], F.desc(F.length(F.array_join("node_ids", "|"))), "l_returnflag")
    return R.apply_list_fixes(listed, fixes).select("paper_id", F.array_join("node_ids", ",").alias("nodes"))


# -- profiles -------------------------------------------------------------------------------------------------


@query("e26_flatten_author", "WITH t AS (SELECT o_custkey, list(o_orderpriority || o_orderkey ORDER BY o_orderkey) AS t, count(*) AS n, min(year(o_orderdate)) AS y FROM orders GROUP BY 1) SELECT 'A' || c_custkey AS author_id, n AS n_pubs_total, coalesce(array_to_string(list_slice(t, 1, 5), ','), '') AS topics, coalesce(t[1], '') AS primary_topic, CASE WHEN len(t) > 0 THEN c_mktsegment ELSE '' END AS primary_field, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE n_name END AS last_institution, cast(y AS INT) AS first_pub_year FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN t ON o_custkey = c_custkey")
def e26(v):
    t = v.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("t"), F.count(F.lit(1)).alias("n"), F.collect_set(F.year("o_orderdate")).alias("years"))
    c = v.customer.join(v.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t, "c_custkey", "left")
    topic = lambda x: F.struct(F.concat(x["o_orderpriority"], x["o_orderkey"].cast("string")).alias("display_name"), F.struct(F.col("c_mktsegment").alias("display_name")).alias("field"))
    at = F.array(F.struct(F.col("n_name").alias("display_name"), F.lit("X").alias("country_code")))
    author = F.struct(
        F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("display_name"), F.col("n").alias("works_count"), F.col("n").alias("cited_by_count"), F.struct(F.col("n").alias("h_index"), F.col("n").alias("i10_index")).alias("summary_stats"),
        F.transform("t", topic).alias("topics"), F.when(F.col("c_custkey") % 4 == 0, F.slice(at, 1, 0)).otherwise(at).alias("last_known_institutions"), F.transform("years", lambda y: F.struct(y.alias("year"))).alias("counts_by_year"),
    )
    flat = c.select(author.alias("author")).select(*A.flatten_author("author"))
    return flat.select("author_id", "n_pubs_total", F.array_join("topics", ",").alias("topics"), "primary_topic", "primary_field", "last_institution", F.col("first_pub_year").cast("int").alias("first_pub_year"))


@query("e27_not_found", "WITH c AS (SELECT l_suppkey, l_partkey, l_linenumber % 3 AS own, l_linenumber AS strength, CASE WHEN l_partkey % 3 = 0 THEN 'rule4_keep_our_institution_only' END AS rule, CASE WHEN l_partkey % 2 = 0 THEN 'n' || l_partkey END AS name, l_returnflag AS method FROM lineitem WHERE l_suppkey % 4 <> 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY own DESC, strength DESC, l_partkey, method) AS rn FROM c) WHERE rn = 1) SELECT s_suppkey AS node_id, CASE WHEN l_partkey IS NOT NULL AND rule IS NOT NULL THEN 'stopped by a flag: ' || rule WHEN l_partkey IS NOT NULL AND name IS NOT NULL THEN 'evidence too weak: ' || method WHEN l_partkey IS NOT NULL THEN 'profile could not be read' WHEN s_suppkey % 8 = 1 THEN 'no Latin name to search for' ELSE 'no compatible name found' END AS reason, coalesce(name, 'A' || l_partkey) AS rejected_candidate FROM supplier LEFT JOIN b ON b.l_suppkey = s_suppkey WHERE s_suppkey % 5 <> 2")
def e27(v):
    people = v.supplier.select(F.col("s_suppkey").alias("node_id"), F.when(F.col("s_suppkey") % 8 == 1, " ").otherwise(F.col("s_name")).alias("name_en"))
    accepted = people.filter("node_id % 5 = 2")
    n = F.col("l_partkey")
    rejected = v.lineitem.filter("l_suppkey % 4 <> 1").select(F.col("l_suppkey").alias("node_id"), F.concat(F.lit("A"), n.cast("string")).alias("author_id"), F.col("l_returnflag").alias("method"), (F.col("l_linenumber") % 3).alias("own_works"), F.col("l_linenumber").alias("strength"), F.when(n % 3 == 0, "rule4_keep_our_institution_only").alias("rule"), F.when(n % 2 == 0, F.concat(F.lit("n"), n.cast("string"))).alias("display_name"), n.alias("part"))
    one = R.first_by(rejected, ["node_id"], F.desc("own_works"), F.desc("strength"), "part", "method")
    return Q.not_found(people, accepted, one.drop("part"))


@query("a20_best_search_hit", "WITH h AS (SELECT c.c_custkey AS query_id, s.s_suppkey AS author_id, s.s_nationkey = 3 AS is_home, s.s_suppkey % 17 AS works FROM customer c JOIN supplier s ON s.s_suppkey % 25 = c.c_custkey % 25 WHERE (c.c_custkey % 3) = (s.s_suppkey % 3) OR (c.c_custkey % 3 = 0 AND s.s_suppkey % 3 = 1) OR (c.c_custkey % 3 = 1 AND s.s_suppkey % 3 = 0)) SELECT query_id, author_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_home DESC, works DESC, author_id) AS rn FROM h) WHERE rn = 1")
def a20(v):
    name = lambda k: F.concat(_pick(("ann", "a.", "bea"), k), F.lit(" Lee"))  # noqa: E731  ann and a. fit each other
    c = v.customer.select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 25).alias("j"), name(F.col("c_custkey")).alias("name"))
    s = v.supplier.select(F.col("s_suppkey").alias("author_id"), (F.col("s_suppkey") % 25).alias("j"), name(F.col("s_suppkey")).alias("found"), (F.col("s_nationkey") == 3).alias("is_home"), (F.col("s_suppkey") % 17).alias("works"))
    return L.best_search_hit(c, s, "j", "name", "found", N.name_tokens).select("query_id", "author_id")


# -- affiliations ---------------------------------------------------------------------------------------------

_END = _list(A.ENDINGS)
_NAMED = f"(SELECT CASE WHEN count(*) = 0 THEN '' ELSE substr({{0}}, 1, cast(min_by(instr({{0}}, e) + length(e) - 1, instr({{0}}, e)) AS BIGINT)) END FROM (SELECT unnest({_END}) AS e) WHERE instr({{0}}, e) > 0)"


def _cleaned(text: str) -> str:
    t = f"regexp_replace({text}, '\\s+', '', 'g')"
    for title in A.TITLES:
        t = f"replace({t}, '{title}', '')"
    return t


_HEAD = ("國立", "中央研究院", "王小明為", "教授 ", "特聘教授", "研究", "")
_TAIL = ("大學 副教授", "研究院", "學 院院長", "銀行大學", "", "部", "大學經濟學研究所教授")
SEGMENT = f"sg AS (SELECT p_partkey, ({_list(_HEAD)})[1 + p_partkey % 7] || CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END || ({_list(_TAIL)})[1 + p_size % 7] AS seg FROM part)"


def segments(v):
    text = F.concat(_pick(_HEAD, F.col("p_partkey")), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")), _pick(_TAIL, F.col("p_size")))
    return v.part.select("p_partkey", text.alias("seg"))


_M6 = f"{SEGMENT}, sq AS (SELECT p_partkey, {_cleaned('seg')} AS t FROM sg), sn AS (SELECT p_partkey, {_NAMED.format('t')} AS name FROM sq), si AS (SELECT p_partkey, CASE WHEN length(name) >= 3 AND name NOT IN ({', '.join(repr(x) for x in A.NOT_INSTITUTIONS)}) THEN name ELSE '' END AS institution FROM sn)"


@query("m6_clean_institution", f"WITH {_M6} SELECT p_partkey, institution FROM si")
def m6(v):
    return segments(v).select("p_partkey", A.clean_institution(F.col("seg")).alias("institution"))


_NOTES = f"""{_M6}, g AS (SELECT s.p_partkey // 3 AS grp, list(seg ORDER BY s.p_partkey) AS segs, list(institution ORDER BY s.p_partkey) AS insts, count(*) AS n FROM sg s JOIN si ON si.p_partkey = s.p_partkey GROUP BY 1),
 no AS (SELECT grp, n, insts, '前言。作者' || CASE WHEN grp % 2 = 0 THEN '分別' ELSE '' END || '為' || array_to_string(segs, '、') || CASE WHEN grp % 5 = 0 THEN '' ELSE '。其後' END AS text, regexp_replace(array_to_string(segs, '、'), '\\s+', '', 'g') AS body, array_to_string(segs, '、') AS plain FROM g)"""


def notes(v):
    g = segments(v).groupBy(F.floor(F.col("p_partkey") / 3).cast("long").alias("grp")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "seg"))), lambda x: x["seg"]).alias("segs"))
    text = F.concat(F.lit("前言。作者"), F.when(F.col("grp") % 2 == 0, "分別").otherwise(""), F.lit("為"), F.array_join("segs", "、"), F.when(F.col("grp") % 5 == 0, "").otherwise("。其後"))
    return g.select("grp", F.size("segs").alias("n"), "segs", text.alias("text"))


@query("m7_footnote", f"WITH {_NOTES} SELECT grp, CASE WHEN ok THEN array_to_string(insts, ';') ELSE '' END AS institutions, CASE WHEN ok THEN 'high' ELSE '' END AS confidence FROM (SELECT *, grp % 5 <> 0 AND length(plain) BETWEEN 4 AND 400 AND len(list_filter(string_split(body, '、'), lambda x: x <> '')) = n AND len(list_filter(insts, lambda x: x = '' OR NOT regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}]'))) = 0 AS ok FROM no)")
def m7(v):
    f = A.footnote(F.col("text"), F.col("n"))
    return notes(v).select("grp", F.array_join(f["institutions"], ";").alias("institutions"), f["confidence"].alias("confidence"))


@query("m8_name_lines", f"WITH {SEGMENT}, sq AS (SELECT p_partkey, regexp_replace(seg, '\\s+', '', 'g') AS t FROM sg) SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 OR NOT list_has_any(string_split(t, ''), []) AND NOT ({' OR '.join(f'''contains(t, '{e}')''' for e in A.ENDINGS)}) OR length(t) < 3 THEN '' ELSE t END AS line FROM sq")
def m8(v):
    gap = F.when(F.col("p_partkey") % 4 == 3, "\nx\ny\nzz 1").otherwise(F.when(F.col("p_partkey") % 4 == 1, "\n*1,").otherwise(""))
    page = F.concat(F.lit("題目\n 王 小明"), gap, F.when(F.col("p_partkey") % 4 == 3, "\nabc\ndef\nghi").otherwise(""), F.lit("\n"), F.col("seg"))
    return segments(v).select("p_partkey", F.get(A.under_names(page, F.array(F.lit("王小明"))), F.lit(0)).alias("line"))


@query("o8_author_affiliations", f"WITH {_NOTES} SELECT grp, CASE WHEN length(plain) BETWEEN 4 AND 400 AND len(list_filter(string_split(body, '、'), lambda x: x <> '')) = n AND len(list_filter(insts, lambda x: x = '' OR NOT regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}]'))) = 0 THEN array_to_string(insts, ';') ELSE '國立清華大學' || repeat(';', cast(n AS INT) - 1) END AS institutions FROM no")
def o8(v):
    page = F.concat("text", F.lit("\n\n甲\n國立清華大學 教授"))
    names = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(i == 1, "甲").otherwise(F.concat(F.lit("乙"), i.cast("string"))))
    return notes(v).select("grp", F.array_join(A.author_affiliations(page, names), ";").alias("institutions"))


_MARKS = "[.．·•、,，]"


@query("m9_listed_authors", f"SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{_MARKS}'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|')) AS names FROM documents")
def m9(v):
    return v.documents.select("doc_id", F.md5(F.array_join(A.listed_authors(F.col("text")), "|").cast("binary")).alias("names"))


@query("m9_email_domains", "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\w.%+-]+@((?:[\\w-]+\\.)+[A-Za-z]{2,})', 1), lambda x: lower(x)), ',') AS domains FROM documents")
def m9_domains(v):
    return v.documents.select("doc_id", F.array_join(A.email_domains(F.col("text")), ",").alias("domains"))


@query("d15_names_institution", "WITH k AS (SELECT p_partkey, regexp_replace(lower(p_name || ' of ' || p_type), '[^0-9a-z]', '', 'g') AS k FROM part), w AS (SELECT unnest(['ring', 'small', 'widget', 'plate', 'large']) AS n) SELECT p_partkey, bool_or(instr(k, n) > 0 AND NOT starts_with(substr(k, instr(k, n) + length(n)), 'of') AND NOT starts_with(substr(k, instr(k, n) + length(n)), 'hospital')) AS named FROM k, w GROUP BY 1")
def d15(v):
    variants = F.array(*[F.lit(x) for x in ("ring", "small", "widget", "plate", "large")])
    return v.part.select("p_partkey", A.names_institution(F.concat_ws(" of ", "p_name", "p_type"), variants).alias("named"))


@query("m4_short_category", "WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || '計畫' WHEN 2 THEN p_name || ' (' || p_type || '計畫)' ELSE '計畫' END AS t FROM part), s AS (SELECT p_partkey, t, CASE WHEN ends_with(t, ')') AND contains(t, '(') THEN regexp_extract(t, '^(.*?)\\s*\\((.*)\\)$', 2) ELSE t END AS i FROM t) SELECT p_partkey, CASE WHEN regexp_replace(i, '計畫$', '') = '' THEN t ELSE regexp_replace(i, '計畫$', '') END AS short FROM s")
def m4(v):
    k = F.col("p_size") % 4
    t = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_brand", F.lit("計畫"))).when(k == 2, F.concat("p_name", F.lit(" ("), "p_type", F.lit("計畫)"))).otherwise("計畫")
    return v.part.select("p_partkey", A.short_category(t).alias("short"))


_DEGREE, _SCHOOL, _OTHER = "[Tt]he|que |ung", "and|ion|sch", "www|http"


@query("m12_degree_lines", f"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_DEGREE}') AND regexp_matches(x, '{_SCHOOL}') AND length(x) < 300 AND NOT regexp_matches(x, '{_OTHER}'))) AS lines FROM documents WHERE text IS NOT NULL")
def m12(v):
    lines = A.degree_lines(F.col("text"), _DEGREE, _SCHOOL, _OTHER)
    return v.documents.filter("text IS NOT NULL").select("doc_id", F.size(lines).cast("bigint").alias("lines"))


_CELL = "[^ ]+"
_TABLE = f"l AS (SELECT doc_id, i, trim(string_split(coalesce(text, ''), chr(10))[i], ' ') AS x FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) r(i)), m AS (SELECT *, regexp_full_match(x, '{_CELL}') AS d, regexp_matches(x, '{_SCHOOL}') AS s FROM l), n AS (SELECT a.doc_id, a.i, max(b.i) AS k FROM m a JOIN m b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i - 3 AND a.i - 1 AND b.s WHERE a.d GROUP BY 1, 2), j AS (SELECT n.doc_id, n.i, string_agg(m.x, ' ' ORDER BY m.i) || ' PhD' AS told FROM n JOIN m ON m.doc_id = n.doc_id AND m.i BETWEEN n.k AND n.i - 1 GROUP BY 1, 2)"


@query("m12_table_degree_lines", f"WITH {_TABLE} SELECT doc_id, count(*) AS lines, md5(string_agg(told, '|' ORDER BY i)) AS k FROM j GROUP BY 1")
def m12_table(v):
    lines = A.table_degree_lines(F.col("text"), _CELL, _SCHOOL, "PhD")
    return v.documents.select("doc_id", lines.alias("l")).filter(F.size("l") > 0).select("doc_id", F.size("l").cast("bigint").alias("lines"), F.md5(F.array_join("l", "|").cast("binary")).alias("k"))


@query("m15_manual_over_automatic", "WITH m AS (SELECT c_custkey, c_mktsegment AS school, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'medium' END AS confidence FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS school FROM orders GROUP BY 1) SELECT coalesce(m.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN m.c_custkey IS NOT NULL THEN m.school ELSE a.school END AS school, CASE WHEN m.c_custkey IS NULL THEN 'low' ELSE coalesce(nullif(confidence, ''), 'high') END AS confidence, CASE WHEN m.c_custkey IS NULL THEN 'automatic' ELSE 'manual' END AS src FROM m FULL OUTER JOIN a ON a.c_custkey = m.c_custkey")
def m15(v):
    k = F.col("c_custkey") % 3
    m = v.customer.filter("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("school"), F.when(k == 0, "").when(k == 1, "medium").alias("confidence"))
    return A.manual_over_automatic(m, v.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("school")), "c_custkey", ["school"])


@query("m17_county_key", "SELECT c_custkey, trim(replace(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ['台北市', ' 臺中市 ', '台台縣'][1 + c_custkey % 3] || c_mktsegment END, '台', '臺'), ' ') AS k FROM customer")
def m17(v):
    c = F.when(F.col("c_custkey") % 5 != 0, F.concat(_pick(("台北市", " 臺中市 ", "台台縣"), F.col("c_custkey")), "c_mktsegment"))
    return v.customer.select("c_custkey", A.county_key(c).alias("k"))


# -- pages ----------------------------------------------------------------------------------------------------


@query("a13_cell_after", "WITH c AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(html, '<[^>]+>'), lambda x: trim(x, ' ')), lambda x: x <> '') AS c FROM pages), s AS (SELECT page_id, list_filter(list_transform(string_split(array_to_string(c, '|'), '|'), lambda x: trim(x, ' ')), lambda x: x <> '') AS c FROM c) SELECT page_id, c[list_position(c, 'the') + 1] AS cell FROM s WHERE list_position(c, 'the') > 0")
def a13(v):
    return v.pages.select("page_id", H.cell_after(F.col("html"), "the").alias("cell")).filter("cell IS NOT NULL")


TABLE = "th AS (SELECT p_partkey // 4 AS grp, '<table><tr><th> Brand </th><th>Size</th></tr>' || string_agg('<tr class=\"r\"><td><b>' || p_brand || '</b></td>' || CASE WHEN p_size % 6 = 0 THEN '' ELSE '<td>' || p_size || '</td>' END || '</tr>', chr(10) ORDER BY p_partkey) || '</table>' AS h, list([p_brand, cast(p_size AS VARCHAR)] ORDER BY p_partkey) FILTER (p_size % 6 <> 0) AS r FROM part GROUP BY 1)"


@query("a14_table_rows", f"WITH {TABLE} SELECT grp, 'Brand,Size' || coalesce(';' || array_to_string(list_transform(r, lambda x: array_to_string(x, ',')), ';'), '') AS cells FROM th")
def a14(v):
    row = F.concat(F.lit('<tr class="r"><td><b>'), "p_brand", F.lit("</b></td>"), F.when(F.col("p_size") % 6 == 0, "").otherwise(F.concat(F.lit("<td>"), F.col("p_size").cast("string"), F.lit("</td>"))), F.lit("</tr>"))
    rows = v.part.groupBy(F.floor(F.col("p_partkey") / 4).cast("long").alias("grp")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("r"))
    page = F.concat(F.lit("<table><tr><th> Brand </th><th>Size</th></tr>"), "r", F.lit("</table>"))
    return rows.select("grp", F.array_join(F.transform(H.table_rows(page), lambda r: F.array_join(r, ",")), ";").alias("cells"))


@query("a16_object_values", "SELECT p_partkey // 4 AS grp, string_agg(p_name, '|' ORDER BY p_partkey) AS titles FROM part GROUP BY 1")
def a16(v):
    one = F.concat(F.lit('{no: "'), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit('", title : "')).otherwise('", "title":"'), "p_name", F.lit('"}'))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("o")))), lambda x: x["o"]), ",\n")
    rows = v.part.groupBy(F.floor(F.col("p_partkey") / 4).cast("long").alias("grp")).agg(text.alias("js"))
    return rows.select("grp", F.array_join(H.object_values(F.col("js"), "title"), "|").alias("titles"))


# -- places ---------------------------------------------------------------------------------------------------

_PLACE = "pl AS (SELECT c_custkey, (c_custkey % 160) - 80.0::DOUBLE AS lat, c_custkey * 7 % 360 - 180.0::DOUBLE AS lon FROM customer)"
_ANGLE = "acos(least(greatest(sin(radians(23.7)) * sin(radians(lat)) + cos(radians(23.7)) * cos(radians(lat)) * cos(radians(lon - 121.0)), -1), 1))"


def spots(v):
    k = F.col("c_custkey")
    return v.customer.select("c_custkey", ((k % 160) - 80.0).alias("lat"), ((k * 7 % 360) - 180.0).alias("lon"))


@query("k2_km_from_center", f"WITH {_PLACE} SELECT c_custkey, round(6371 * {_ANGLE} / 10) AS tens FROM pl")
def k2(v):
    km = 6371 * F.radians(X.azimuthal(F.col("lat"), F.col("lon"))["angle"])
    near = F.abs(X.km_from_center(F.col("lat"), F.col("lon")) - km) <= 0.5
    return spots(v).select("c_custkey", F.when(near, F.round(km / 10)).alias("tens"))


@query("k5_great_circle", f"WITH {_PLACE}, q AS (SELECT *, cos(radians(23.7)) * cos(radians(121.0)) AS ax, cos(radians(23.7)) * sin(radians(121.0)) AS ay, sin(radians(23.7)) AS az, cos(radians(lat)) * cos(radians(lon)) AS bx, cos(radians(lat)) * sin(radians(lon)) AS by_, sin(radians(lat)) AS bz, {_ANGLE} AS w, (c_custkey % 10) / 10.0 AS t FROM pl), r AS (SELECT c_custkey, (sin((1 - t) * w) * ax + sin(t * w) * bx) / sin(w) AS x, (sin((1 - t) * w) * ay + sin(t * w) * by_) / sin(w) AS y, (sin((1 - t) * w) * az + sin(t * w) * bz) / sin(w) AS z FROM q) SELECT c_custkey, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(asin(least(greatest(z, -1), 1))), 6) AS lat FROM r")
def k5(v):
    p = X.great_circle(F.lit(121.0), F.lit(23.7), F.col("lon"), F.col("lat"), (F.col("c_custkey") % 10) / 10)
    return spots(v).select("c_custkey", F.round(p["lon"], 6).alias("lon"), F.round(p["lat"], 6).alias("lat"))


def _rings(v):
    point = F.struct(F.col("l_discount").cast("double").alias("x"), F.col("l_tax").cast("double").alias("y"))
    return v.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", point.alias("p")))), lambda z: z["p"]).alias("ring"))


@query("k10_ring_area", "WITH p AS (SELECT l_orderkey, l_discount::DOUBLE AS x, l_tax::DOUBLE AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_tax)) SELECT a.l_orderkey, round(abs(sum(a.x * b.y - b.x * a.y)) / 2, 8) AS area FROM p a JOIN p b ON b.l_orderkey = a.l_orderkey AND b.i = a.i % a.n + 1 GROUP BY 1")
def k10(v):
    return _rings(v).select("l_orderkey", F.round(X.ring_area(F.col("ring")), 8).alias("area"))


@query("k10_densify", "WITH p AS (SELECT l_orderkey, l_discount::DOUBLE AS x, l_tax::DOUBLE AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_tax)) SELECT a.l_orderkey, cast(sum(greatest(1, ceil(round(greatest(abs(a.x - b.x), abs(a.y - b.y)) / 0.03, 6)))) AS BIGINT) AS points FROM p a JOIN p b ON b.l_orderkey = a.l_orderkey AND b.i = a.i % a.n + 1 GROUP BY 1")
def k10_densify(v):
    return _rings(v).select("l_orderkey", F.size(X.densify(F.col("ring"), 0.03)).cast("bigint").alias("points"))


@query("k7_simplify")
def k7(v):
    keep = X.simplify(0.01)
    r = _rings(v)
    return r.select("l_orderkey", keep(F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])).alias("kept"))


# -- sheets ---------------------------------------------------------------------------------------------------


@query("o1_union_master", "SELECT node_id, node_type, name, institution, NULL AS country, NULL AS note FROM nodes_p WHERE node_type = 'roster' UNION ALL SELECT node_id, node_type, name, NULL, country, NULL FROM nodes_p WHERE node_type <> 'roster'")
def o1(v):
    roster, external = I.split_master(v.nodes_p)
    return O.union_master(roster.select("node_id", "node_type", "name", "institution"), external.select("node_id", "node_type", "name", "country"), ["note"])


@query("a6_split_master", "SELECT 'roster' AS kind, count(*) AS n FROM nodes_p WHERE node_type = 'roster' UNION ALL SELECT 'external', count(*) FROM nodes_p WHERE node_type <> 'roster'")
def a6(v):
    roster, external = I.split_master(v.nodes_p)
    n = lambda d, kind: d.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(roster, "roster").unionByName(n(external, "external"))


@query("a8_typed", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_totalprice END AS amount, o_orderstatus = 'F' AS is_pi FROM orders")
def a8(v):
    k = F.col("o_orderkey") % 3
    raw = v.orders.select("o_orderkey", F.when(k == 0, "").when(k == 1, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("amount"), F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "False").otherwise("").alias("is_pi"))
    return I.typed(raw, ("amount",), ("is_pi",))


@query("b6_work_queue", "SELECT o_custkey, 100 * count(DISTINCT o_orderpriority) + least(count(*), 99) AS priority FROM orders GROUP BY 1")
def b6(v):
    p = v.orders.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("degree"), F.count(F.lit(1)).alias("papers"))
    return O.work_queue(p, "o_custkey", "degree", "papers")


@query("b7_payload", "SELECT page_id, md5(replace('{\"page_id\":' || page_id || ',\"html\":' || to_json(substr(html, 1, 80)) || '}', '<', chr(92) || 'u003c')) AS k FROM pages WHERE html IS NOT NULL")
def b7(v):
    return v.pages.filter("html IS NOT NULL").select("page_id", F.md5(O.payload("page_id", "html", cut={"html": 80}).cast("binary")).alias("k"))


@query("o11_identity_review", "SELECT 'roster' AS kind, node_id AS id, 1000 + cast(trunc(value) AS INT) % 50 AS priority FROM nodes_p WHERE node_type = 'roster' AND value < 3000 UNION ALL SELECT 'external', node_id, (cast(trunc(value) AS INT) % 50) * 10 + least(coalesce(country, 0), 9) FROM nodes_p WHERE node_type <> 'roster' AND value < 3000")
def o11(v):
    n = v.nodes_p.select("node_type", F.col("node_id").alias("id"), (F.col("value") < 3000).alias("needs_review"), (F.col("value").cast("int") % 50).alias("degree_roster"), F.col("country").alias("degree_all"))
    roster, external = I.split_master(n)
    return Q.identity_review(roster, external)


@query("o11_missing_queue", "SELECT node_id, name FROM nodes_p WHERE institution IS NULL")
def o11_missing(v):
    return Q.missing_queue(v.nodes_p.withColumn("place", F.col("institution").cast("string")), "place", "name").select("node_id", "name")


@query("o12_fill_places", "WITH i AS (SELECT n_nationkey, n_nationkey * 2.0::DOUBLE AS la, n_regionkey * 3.0::DOUBLE AS lo FROM nation) SELECT node_id, CASE WHEN node_type = 'roster' AND la IS NOT NULL THEN la WHEN node_type <> 'roster' THEN value::DOUBLE END AS lat, CASE WHEN node_type = 'roster' AND lo IS NOT NULL THEN lo WHEN node_type <> 'roster' THEN 1.5 END AS lon FROM nodes_p LEFT JOIN i ON n_nationkey = institution")
def o12(v):
    own = F.col("node_type") == "roster"
    places = v.nodes_p.select("node_id", F.when(own, "roster").otherwise("institution").alias("place_type"), F.col("institution").alias("institution_code"), F.when(~own, F.col("value").cast("double")).alias("lat"), F.when(~own, F.lit(1.5)).alias("lon"))
    institutions = v.nation.select(F.col("n_nationkey").alias("institution_code"), (F.col("n_nationkey") * 2.0).alias("lat"), (F.col("n_regionkey") * 3.0).alias("lon"))
    return Q.fill_places(places, institutions).select("node_id", "lat", "lon")

"""Edge rules on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from coweave.functions import classify as C
from coweave.functions import geo as X
from coweave.functions import names as N
from coweave.functions import pages as H
from coweave.functions import stats as S
from coweave.operators import edges as E
from coweave.operators import grants as G
from coweave.operators import graph as J
from coweave.operators import papers as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_average_rank(spark):
    d = S.percent_rank_average(spark.createDataFrame([(1,), (1,), (3,), (9,)], "v int"), "v", "p")
    assert sorted(r["p"] for r in d.collect()) == [0.375, 0.375, 0.75, 1.0]


def test_gaps(spark):
    rows = [(i, "a", y, True, True, m) for i, (y, m) in enumerate([(2010, False), (2010, False), (2012, False), (2020, False)])] + [(9, "b", 2004, True, True, False), (10, "b", 2006, True, True, True), (11, "b", 2010, True, True, False)]
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "grant_id int, teacher_id string, year int, is_pi boolean, research boolean, marked boolean, amount double")
    got = {r["grant_id"]: (r["gap_next"], r["dur"]) for r in G.with_durations(d).collect()}
    assert got == {0: (0, 1), 1: (2, 2), 2: (8, 3), 3: (None, 1), 9: (2, 1), 10: (4, 1), 11: (None, 1)}


def test_cap_keeps_matched_authors_first(spark):
    rows = [("p", f"n{i:02}", None if i < 3 else i) for i in range(12)]
    kept = E.cap_authors(spark.createDataFrame(rows, "paper_id string, node_id string, ln int"))
    assert [r["node_id"] for r in kept.orderBy("list_position").collect()] == [f"n{i:02}" for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 0)]


def test_merge_to_one_author_gives_no_edges(spark):
    a = spark.createDataFrame([("p", "X1", 1), ("p", "X2", 2)], "paper_id string, node_id string, ln int")
    m = spark.createDataFrame([("X2", "X1")], "from_node_id string, to_node_id string")
    merged = E.apply_merges(a, m)
    papers = spark.createDataFrame([("p", 2000, True)], "paper_id string, year int, edge_eligible boolean")
    assert [r["node_id"] for r in merged.collect()] == ["X1"]
    assert E.paper_edges(papers, merged).count() == 0


def test_family_years(spark):
    rows = spark.createDataFrame([("f", 2016, "A"), ("f", 2018, "B")], "family string, year int, member string")
    got = E.project_edges(rows).orderBy("year").collect()
    assert [(r["year"], r["source_node_id"], r["target_node_id"], r["both_recorded_this_year"]) for r in got] == [(2016, "A", "B", 0), (2018, "A", "B", 0)]


def test_missing_institution_is_cross_but_not_across(spark):
    e = spark.createDataFrame([("pub", 2000, "p", "a", "b", 0.5, 1.0, None)], "layer string, year int, item string, u string, v string, weight_1n double, weight_pair double, both_recorded_this_year int")
    n = spark.createDataFrame([("a", "roster", 1), ("b", "roster", None)], "node_id string, node_type string, institution int")
    assert [E.select_events(e, n, scope=s).count() for s in ("all", "within", "across", "cross")] == [1, 0, 0, 1]


def test_empty_titles_stay_apart(spark):
    rows = [(1, "", "x", "", 1, 2000), (2, "", "x", "", 1, 2000), (3, "t", "x", "", 1, 2001), (4, "t", "x", "d", 1, 2002), (5, "t", "y", "", 9, 2000)]
    d = spark.createDataFrame(rows, "paper_id int, k string, a string, doi string, source_count int, year int")
    assert sorted((r["paper_id"], r["merged_paper_ids"]) for r in R.merge_same_title(d, "k", "a").collect()) == [(1, []), (2, []), (4, [3]), (5, [])]


@pytest.mark.parametrize(("a", "b", "same"), [("Wei-Wei Lee", "Jyh-Wei Lee", False), ("J. Lin", "Jane Lin", True), ("Ann B. Wu", "Ann Wu", True), ("Lee", "Ann Lee", False), ("", "", False)])
def test_compatible(spark, a, b, same):
    d = spark.createDataFrame([(a, b)], "a string, b string").select(N.name_tokens(F.col("a")).alias("x"), N.name_tokens(F.col("b")).alias("y"))
    assert d.select(N.compatible(F.col("x"), F.col("y"))).first()[0] is same


def test_resplit(spark):
    assert one(spark, N.resplit(F.lit("Huang | Chien-Lung | Hao-ChunLu"))) == ["Huang, Chien-Lung", "Hao-ChunLu"]
    assert one(spark, N.resplit(F.lit("Ann Wu|and Bo Li*|Lin"))) == ["Ann Wu", "Bo Li", "Lin"]


def test_keys(spark):
    assert one(spark, N.surname_key(F.lit("Lin, M.-J."))) == one(spark, N.surname_key(F.lit("Ming-Jen Lin"))) == "lin|mj"
    d = spark.createDataFrame([("Ｊosé Ñu_1",), (None,)], "s string")
    assert [tuple(r) for r in d.select(N.name_key(F.col("s")), N.norm_title(F.col("s")), N.strict_title(F.col("s"))).collect()] == [("josenu1", "joséñu_1", "josu1"), ("", "", "")]
    assert [one(spark, N.is_fragment(F.lit(x))) for x in ("Chen, H.-J.", "Chen, Hui", "", "陳")] == [True, False, True, False]


def test_blocking(spark):
    assert one(spark, C.is_blocked(F.lit("x|incomplete_author_list")))
    assert one(spark, C.subtract_reasons(F.lit("conflicting_author_sets|incomplete_author_list"), ("conflicting_author_sets",))) == "incomplete_author_list"


def test_ring_with_hole(spark):
    ring = lambda a, b: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((a, a), (b, a), (b, b), (a, b))])
    shape = F.array(ring(0, 10), ring(4, 6))
    assert [one(spark, X.in_polygon(F.lit(p), F.lit(p), shape)) for p in (5.0, 2.0, 11.0)] == [False, True, False]
    assert one(spark, X.ring_area(ring(0, 10))) == 100


def test_simplify(spark):
    d = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], [0.0, 0.01, 0.0, 5.0])], "x array<double>, y array<double>")
    assert d.select(X.simplify(0.1)(F.col("x"), F.col("y"))).first()[0] == [0, 2, 3]


def test_page_text(spark):
    page = "<title>A &amp; B</title><script>x<y</script><p>One&nbsp;&lt; two</p><div> </div>three<br>four"
    assert one(spark, H.page_text(F.lit(page))) == "A & B One < two\nthree\nfour"
    assert one(spark, H.page_title(F.lit(page))) == "A & B"
    assert one(spark, H.table_rows(F.lit("<tr><th>a</th><th>b</th></tr><tr><td>1</td></tr><tr><td>2</td><td>3</td></tr>"))) == [["a", "b"], ["2", "3"]]


def test_graph_of_two_components(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("x", "y", 1), ("y", "z", 1), ("x", "z", 1)], "u string, v string, count int")
    assert {tuple(r) for r in J.connected_components(pairs).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "x")}
    assert {r["node"]: round(r["betweenness"], 6) for r in J.betweenness(pairs, 7).collect()}["b"] == round(2 / (6 * 5), 6)
    assert J.transitivity(pairs).first()["transitivity"] == 0.75
    com = dict(map(tuple, J.leiden(pairs).collect()))
    assert set(com) == set("abcxyz") and com["x"] == com["y"] == com["z"] != com["a"]


def test_gini_of_nothing_and_equals(spark):
    d = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert S.gini(d, "v").first()[0] == 0
    assert S.gini(d.filter("v > 5"), "v").first()[0] is None

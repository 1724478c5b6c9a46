"""Graphs, departments, lookups, candidate lines and sinks on hand-made rows."""

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from coweave.functions import affiliations as A
from coweave.functions import departments as D
from coweave.functions import geo as X
from coweave.operators import candidates, lookups, ranges
from coweave.operators import graph as G
from coweave.plans import programs
from coweave.sources import readers, sinks


def plain_paths(pairs):
    """Distances, numbers of shortest paths and betweenness by search from every node."""
    near = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    dist, total = {}, dict.fromkeys(near, 0.0)
    for s in near:
        d, sigma, order = {s: 0}, {s: 1.0}, [s]
        for x in order:
            for y in near[x]:
                if y not in d:
                    d[y], sigma[y] = d[x] + 1, 0.0
                    order.append(y)
                if d[y] == d[x] + 1:
                    sigma[y] += sigma[x]
        back = dict.fromkeys(order, 0.0)
        for y in reversed(order[1:]):
            for x in near[y]:
                if d[x] == d[y] - 1:
                    back[x] += sigma[x] / sigma[y] * (1 + back[y])
            total[y] += back[y]
        dist |= {(s, t): k for t, k in d.items() if t != s}
    n = len(near)
    return dist, {x: b / ((n - 1) * (n - 2)) for x, b in total.items()}


def test_paths_and_betweenness(spark):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)})
    d = spark.createDataFrame([(f"{u:02}", f"{v:02}") for u, v in pairs], "u string, v string")
    dist, between = plain_paths([(f"{u:02}", f"{v:02}") for u, v in pairs])
    assert tuple(G.path_statistics(d).first()) == (sum(dist.values()) / len(dist), max(dist.values()))
    for batch_rows in (1 << 30, 500):  # all sources at once, and in batches
        b = {r["node"]: r["betweenness"] for r in G.betweenness(d, batch_rows=batch_rows).collect()}
        assert b.keys() == between.keys() and all(abs(b[k] - x) < 1e-9 for k, x in between.items())
    assert tuple(G.path_statistics(d, batch_rows=500).first()) == (sum(dist.values()) / len(dist), max(dist.values()))
    assert tuple(G.path_statistics(d.limit(0)).first()) == (None, None) and G.betweenness(d.limit(0)).count() == 0


def test_long_chains_are_followed_to_their_end(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(59)]
    d = spark.createDataFrame(chain, "u string, v string")
    assert {r["component"] for r in G.connected_components(d).collect()} == {"000"}
    rng = random.Random(6)
    edges = [(f"{a:03}", f"{b:03}") for a, b in (sorted(rng.sample(range(200), 2)) for _ in range(130))]
    e = spark.createDataFrame(edges, "u string, v string")
    above = {x: x for p in edges for x in p}
    for _ in above:
        for u, v in edges:
            above[u] = above[v] = min(above[u], above[v])
    assert dict(map(tuple, G.connected_components(e).collect())) == above
    sizes = {c: list(above.values()).count(c) for c in set(above.values())}
    most = min(c for c in sizes if sizes[c] == max(sizes.values()))
    assert {x for r in G.largest_component(e).collect() for x in r} == {x for x in above if above[x] == most}


def test_triangles_and_communities(spark):
    two = [(a, b) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w")]
    d = spark.createDataFrame([(*p, 1) for p in two], "u string, v string, count int")
    t = G.transitivity(d).first()
    assert (t["triangles"], t["triples"]) == (8, 6 * 3 + 2 * 6)
    c = {r["node"]: r["community"] for r in G.leiden(d).collect()}
    assert c == {x: "a" for x in "abcd"} | {x: "w" for x in "wxyz"}
    assert G.density(d, spark.range(10)).first()["density"] == 2 * 13 / 90


@pytest.mark.parametrize(
    ("text", "variants", "unit"),
    [
        ("國立政治大學財政學系", [], "財政學系"),
        ("致理技術學院", [], None),
        ("Department of Education, Taipei City Government, Department of Economics, Soochow University", ["soochowuniversity"], "Department of Economics"),
        ("National Taiwan University, Department of Economics", ["nationaltaiwanuniversity"], "Department of Economics"),
        ("National Taiwan University of Science, Department of Economics, School of Law", ["nationaltaiwanuniversity"], "Department of Economics"),
        ("School of Law, Department of Finance Taipei Taiwan", [], "Department of Finance"),
        ("Graduate Institute of Finance 10617 Taipei", [], "Graduate Institute of Finance"),
        ("Department of Life Science National Taiwan University Taipei", [], "Department of Life Science"),
        ("Some Street 5", [], None),
        ("Department of History, Other University, College of Law, Some University", ["someuniversity"], "College of Law"),
        ("Some University, Ministry of Labor, Department of Work", ["someuniversity"], None),
        ("Division of Trade, Department of Economics, Some University, Graduate Institute of Law", ["someuniversity"], "Department of Economics"),
        ("Some University Hospital, School of Nursing, Some University", ["someuniversity"], "School of Nursing"),
        ("Department of Economics, R.O.C.", [], "Department of Economics"),
        ("Dept. of Public Finance and Tax New Taipei City Taiwan", [], "Dept. of Public Finance and Tax"),
        ("國立臺灣大學經濟學系、財政研究所", [], "財政研究所"),
        (None, [], None),
        ("", [], None),
    ],
)
def test_units(spark, text, variants, unit):
    got = spark.range(1).select(D.unit(F.lit(text).cast("string"), F.array(*map(F.lit, variants)).cast("array<string>")).alias("unit")).first()
    assert got["unit"] == unit


def test_client():
    waits, answers = [], iter([(500, None), (503, None), (200, "x")])
    assert lookups.Client(lambda url: next(answers), sleep=waits.append).get("u") == "x" and waits == [1.0, 2.0]
    assert lookups.Client(lambda url: (404, "no"), sleep=waits.append).get("u") is None
    assert lookups.Client(lambda url: (500, None), tries=2, sleep=waits.append).get("u") is None
    assert lookups.Client(None).get("u") is None
    with pytest.raises(lookups.BudgetExhausted):
        lookups.Client(lambda url: (429, None)).get("u")
    with pytest.raises(PermissionError):
        lookups.Client(lambda url: (403, None)).get("u")

    def down(url):
        raise OSError

    assert lookups.Client(down, tries=2, sleep=waits.append).get("u") is None


def test_numbering(spark):
    got = ranges.numbered(spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(6), "k", "at").collect()
    assert all(r["k"] == r["at"] for r in got) and len(got) == 1000


def test_cards_and_stamp(spark, tmp_path):
    pages = spark.createDataFrame([("u", '<body>head<div class="c"><b>One</b> <i>A. B.</i></div><div class="c"><b>Two</b></div></body><div class="c">tail')], "url string, html string")
    cards = readers.read_cards(pages, '<div class="c">', {"title": "<b>(.*?)</b>", "authors": "<i>(.*?)</i>"}).orderBy("ord").collect()
    assert [(r["title"], r["authors"]) for r in cards] == [("One", "A. B."), ("Two", "")]
    assert readers.build_info(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "b.json").write_text('{"built": "today", "n": 3}')
    assert readers.build_info(spark, str(tmp_path / "b.json")) == {"built": "today", "n": 3}


def test_snapshot(spark, tmp_path):
    a, b = spark.range(3).selectExpr("id", "cast(id AS string) AS s"), spark.range(4).selectExpr("id", "cast(id AS string) AS s")
    at = str(tmp_path / "s")
    assert [sinks.snapshot(x, at) for x in (a, a, b, b, a)] == [True, False, True, False, True]


def test_table_degrees(spark):
    page = "國別\n美國\nNew York University\n經濟學系\nPhD\nother\nPhD\n\nUniversity of X\na\nb\nc\nPhD"
    got = spark.range(1).select(A.table_degree_lines(F.lit(page), "PhD|博士", "Universit", "degree").alias("l")).first()["l"]
    assert got == ["New York University 經濟學系 degree", "New York University 經濟學系 PhD other degree"] or got == ["New York University 經濟學系 degree"]


def test_candidate_lines(spark):
    people = spark.createDataFrame([(1, "王小明", "http://a.tw/p1", "http://me.tw/", 1), (2, "陳大文", "http://a.tw/list", None, 3), (3, "林一二", None, None, None), (4, "張三", None, None, None)], "teacher_id long, name string, profile string, website string, shared_by int")
    line = "PhD, University of X 1999"
    pages = spark.createDataFrame([
        ("http://a.tw/p1", "a.tw", "staff", f"王小明 教授\n{line}\n{line}"),
        ("http://me.tw/", "me.tw", "home", f"hello\n{line}"),
        ("http://a.tw/x", "a.tw", "王小明 page", f"林一二 張三 陳大文 王小明\n{line}"),
        ("http://a.tw/list", "a.tw", "all", "陳大文" + "x" * 700 + f"\n{line}"),
    ], "url string, host string, title string, text string")
    got = candidates.find_candidates(people, pages, "PhD", "Universit", "PhD", "nothing").orderBy("teacher_id", "rank").collect()
    assert [(r["teacher_id"], r["src"], r["line"], r["lines_after"], r["other_names"], r["rank"]) for r in got] == [(1, "profile", line, 1, 0, 0.0), (1, "personal", line, 1, 0, 1.0), (1, "host_title", line, 1, 3, 2.5)]


def test_outlines_drop_islands_and_thin_lines(spark):
    square = [(120.0, 23.0), (122.0, 23.0), (122.0, 25.0), (120.0, 25.0)]
    dot = [(121.0, 20.0), (121.01, 20.0), (121.01, 20.01)]
    rows = [(1, "big", [[{"x": x, "y": y} for x, y in r] for r in (square, dot)])]
    d = spark.createDataFrame(rows, "ord int, name string, rings array<array<struct<x:double,y:double>>>")
    got = X.outlines(d, 0.01, 0.01, 0.5).first()
    assert len(got["rings"]) == 1 and 4 <= len(got["rings"][0]) < 17


def test_programs(spark, sf):
    parts = programs.run(spark, sf, "ca05_over_time")
    assert list(parts) == ["g18_year_series", "f12_new_vs_repeat", "h13_new_share"]
    assert len(programs.PROGRAMS) == 18
    years = [r["year"] for r in parts["h13_new_share"].orderBy("year").collect()]
    assert all(a < b for a, b in pairwise(years))

"""Points in polygons that are not broadcast, names of any script on pages, institutions and similar titles."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from coweave.functions import geo as X
from coweave.operators import edges as E
from coweave.operators import lookups
from coweave.operators.candidates import names_on_pages
from coweave.operators.enrich import match_institutions


def test_dense_points_in_cells(spark):
    rng = random.Random(3)
    shapes = []
    for k in range(40):
        cx, cy, r = rng.uniform(0, 100), rng.uniform(-50, 50), rng.choice((0.2, 2, 30))
        shapes.append((k, f"p{k}", [[(float(cx + r * np.cos(a)), float(cy + r * np.sin(a))) for a in sorted(rng.uniform(0, 6.28) for _ in range(5))]]))
    points = [(i, rng.gauss(30, 0.3), rng.gauss(10, 0.3)) for i in range(1500)] + [(2000 + i, rng.uniform(-20, 120), rng.uniform(-70, 70)) for i in range(500)]
    points += [(3000 + i, 31.0, 9.0) for i in range(700)] + [(9000, None, 1.0), (9001, 1.0, None)]
    polygons = spark.createDataFrame(shapes, "ord int, name string, rings array<array<struct<x:double,y:double>>>")
    df = spark.createDataFrame(points, "id int, x double, y double").repartition(4)
    plain = {r["id"]: r["place"] for r in X.locate(df, polygons).collect()}
    cells = X.locate(df, polygons, most_polygons=0, most_points=50)
    assert {r["id"]: r["place"] for r in cells.collect()} == plain and len(plain) == len(points)
    assert 100 < sum(p is not None for p in plain.values()) < len(points)
    assert X.locate(df.limit(0), polygons, most_polygons=0).count() == 0


def test_cells_follow_the_density(spark):
    rows = [(5, 5)] * 300 + [(i % 16, i // 16) for i in range(256)]
    got = X.cells_by_density(spark.createDataFrame(rows, "cx int, cy int"), 20, 4).collect()
    cell = {(r["cx"], r["cy"]): r for r in got}
    assert len(got) == 256 and cell[5, 5]["level"] == 4 and cell[5, 5]["held"] == 301
    assert cell[15, 15]["level"] == 2 and cell[15, 15]["held"] == 16
    assert all(r["held"] <= 20 or r["level"] == 4 for r in got)


def test_names_of_any_script(spark):
    rng = random.Random(8)
    texts = [("u%d" % k, "".join(rng.choice("abc 字名é\n𝄞") for _ in range(400))) for k in range(12)] + [("empty", ""), ("null", None)]
    names = {t[i : i + n] for _, t in texts[:12] for n in (2, 3, 4, 5, 7, 8, 9, 15) for i in (rng.randrange(380),)} | {"x", "", "zz", "字" * 30, "no such name"}
    got = {tuple(r) for r in names_on_pages(spark.createDataFrame(texts, "url string, text string"), spark.createDataFrame([(n,) for n in names] * 2, "name string")).collect()}
    assert got == {(u, n) for u, t in texts for n in names if len(n) >= 2 and t and n in t}


def test_institutions_by_all_four_steps(spark):
    listed = [("A1", 2, "I2", "National  Uni", "TW"), ("A1", 1, "I1", "national uni", "TW"), ("A2", 1, "I3", "National Uni", "US"), ("A3", 1, "I3", "National Uni", "US"), ("A3", 2, "I4", "National Uni", "US"), ("A3", 3, "I5", "Only One", "FR"), (None, 1, None, "x", None)]
    people = [(1, "National Uni", "TW", "A1"), (2, "National Uni", "US", "A9"), (3, "National Uni", "JP", None), (4, "Only One", "JP", None), (5, " Decided  Name ", "TW", "A1"), (6, "Denied", "FR", "A3"), (7, "", "TW", "A1"), (8, None, None, None), (9, "National Uni", "US", "A3"), (10, "Unknown", "TW", "A1")]
    decisions = [("Decided Name", "ll:1.5,2:3"), ("Denied", "none"), ("Empty", "ror:")]
    got = match_institutions(spark.createDataFrame(people, "node_id int, affil string, country string, author_id string"), spark.createDataFrame(decisions, "affil string, decision string"), spark.createDataFrame(listed, "author_id string, ord int, inst_id string, name string, country string"))
    assert {r["node_id"]: (r["kind"], r["ids"]) for r in got.collect()} == {1: ("oa", ["I1", "I2"]), 2: ("oa", ["I3", "I4"]), 4: ("oa", ["I5"]), 5: ("ll", ["1.5,2:3"]), 9: ("oa", ["I3", "I4"])}


def test_similar_titles_need_no_exact_ratio_to_be_sorted_out(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh 字é") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    near = ["".join(c for c in t if rng.random() > 0.07) for t in base]
    a, b = pd.Series([*base, *base, None, "x", ""]), pd.Series([*near, *rng.sample(base, 60), "x", None, ""])
    want = [x is not None and y is not None and SequenceMatcher(None, x, y).ratio() >= 0.9 for x, y in zip(a, b, strict=True)]
    assert lookups._alike.func(a, b, pd.Series([0.9] * len(a))).tolist() == want and sum(want) > 10
    papers = spark.createDataFrame([(1, "", base[0]), (2, "d", "")], "paper_id int, doi string, title_key string")
    hits = spark.createDataFrame([(1, 1, "i1", base[0][::-1] + "zzzzzzzzzz"), (1, 2, "i2", base[0])], "paper_id int, ord int, item string, title_key string")
    got = lookups.match_items(papers, spark.createDataFrame([("d", "j")], "doi string, item string"), hits)
    assert sorted(map(tuple, got.collect())) == [(1, "i2", "title"), (2, "j", "doi")]


def test_families_of_any_size_in_cells(spark):
    rng = random.Random(9)
    rows = [("big", rng.choice((1999, 2000)), f"m{i:03}") for i in range(150)] + [("big", 2001, "m001"), ("two", 2000, "a"), ("two", 2001, "b"), ("two", 2001, "b"), ("one", 2000, "a")]
    here = {(f, y, m) for f, y, m in rows}
    want = set()
    for f in ("big", "two", "one"):
        members = sorted({m for g, _, m in rows if g == f})
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                want |= {(f, y, a, b, len(members), int((f, y, a) in here and (f, y, b) in here)) for y in {y for g, y, _ in rows if g == f}}
    df = spark.createDataFrame(rows, "family string, year int, member string")
    for block in (256, 7):
        got = E.project_edges(df, block).select("family", "year", "source_node_id", "target_node_id", "n_members", "both_recorded_this_year").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert E.project_edges(df, 7).filter(~F.startswith("edge_id", F.lit("JE-"))).count() == 0

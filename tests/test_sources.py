import json

from pyspark.sql import functions as F

from coweave.sources import readers as R
from coweave.sources import sinks as S


def test_csv_keeps_codes_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿code,name,amount,aligned,x_json\n0003,"two\nlines",,True,"[""a""]"\n0004,NA,12,False,\n', encoding="utf-8")
    rows = R.decode_json_columns(R.typed(R.read_csv(spark, str(tmp_path / "a.csv")), ("amount",), ("aligned",))).collect()
    assert [tuple(r) for r in rows] == [("0003", "two\nlines", None, True, ["a"]), ("0004", "NA", 12.0, False, [])]


def test_missing_table_is_empty(spark, tmp_path):
    assert R.Catalog(spark, str(tmp_path), {"none": "a string"})["none"].count() == 0


def test_page_cache(spark, tmp_path):
    for n, page in enumerate([("u", "200", "old"), ("u", "200", "new"), ("v", "404", "x"), ("w", "200", "")]):
        (tmp_path / f"{n}.json").write_text(json.dumps(dict(zip(("url", "status", "text"), page, strict=True))))
    assert [tuple(r) for r in R.read_pages(spark, str(tmp_path)).collect()] == [("u", "new")]


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1]]]
    feature = lambda kind, c: {"type": "Feature", "properties": {"n": kind}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "g.json").write_text(json.dumps({"features": [feature("Polygon", square), feature("MultiPolygon", [square, square])]}))
    got = R.read_geojson(spark, str(tmp_path / "g.json"), "n").orderBy("ord").collect()
    assert [(r["ord"], r["name"], len(r["rings"][0])) for r in got] == [(0, "Polygon", 4), (1000, "MultiPolygon", 4), (1001, "MultiPolygon", 4)]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("n1", 2000, "<b>" + "x" * 9)], "node_id string, year int, title string")
    b = spark.createDataFrame([("n2", "TW")], "node_id string, country string")
    assert S.union_master(a, b, ["more"]).columns == ["node_id", "year", "title", "country", "more"]
    assert a.select(S.payload("node_id", "title", cut={"title": 4})).first()[0] == '{"node_id":"n1","title":"\\u003cb>x"}'
    S.write_by_year(a, str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "y")).filter(F.col("year") == 2000).count() == 1
    S.write_csv(a, str(tmp_path / "c"), ["title", "node_id"])
    assert R.read_csv(spark, str(tmp_path / "c")).columns == ["title", "node_id"]
    q = spark.createDataFrame([("a", 1, 200), ("b", 2, 5)], "k string, d int, p int")
    assert [tuple(r) for r in S.work_queue(q, "k", "d", "p").collect()] == [("b", 205), ("a", 199)]

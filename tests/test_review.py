from coweave.operators import review as R


def test_repairs(spark):
    papers = spark.createDataFrame([
        ("a", "published_author_list_conflict", ["X0"]), ("b", "unresolved_author_identity_or_fragment", ["X1", "EXT-U-9", "X1"]),
        ("c", "incomplete_author_list|published_author_list_conflict", ["X2", "EXT-U-1"]), ("d", "other", ["X3"]), ("e", None, ["X4"]),
    ], "paper_id string, hold_reason string, node_ids array<string>")
    sources = spark.createDataFrame([("a", "r1", "Lin"), ("a", "r2", "Huang | Chien-Lung | H. C.")], "paper_id string, record_id string, original_author_list string")
    lookups = spark.createDataFrame([("c", ["Ann Wu", "Bo Li"])], "paper_id string, names array<string>")
    resolved = spark.createDataFrame([("Huang, Chien-Lung", "N1"), ("H. C.", None), ("Ann Wu", "X2"), ("Bo Li", "N2")], "name string, node_id string")
    got = {r["paper_id"]: (r["rule"][0], r["n_before"], r["node_ids"]) for r in R.repair_author_lists(papers, sources, lookups, resolved).collect()}
    assert got == {"a": ("A", 1, ["N1"]), "b": ("B", 3, ["X1"]), "c": ("C", 2, ["X2", "N2"])}


def test_review_order(spark):
    roster = spark.createDataFrame([("t1", True, 3), ("t2", False, 9)], "id string, needs_review boolean, degree_roster int")
    ext = spark.createDataFrame([("e1", True, 2, 50), ("e2", True, None, 1)], "id string, needs_review boolean, degree_roster int, degree_all int")
    assert [tuple(r) for r in R.identity_review(roster, ext).collect()] == [("roster", "t1", 1003), ("external", "e1", 29), ("external", "e2", 1)]


def test_not_found_reasons(spark):
    people = spark.createDataFrame([("a", "Ann"), ("b", ""), ("c", "Cy"), ("d", "Di"), ("e", "Ed"), ("f", "Fi")], "node_id string, name_en string")
    accepted = spark.createDataFrame([("f",)], "node_id string")
    rejected = spark.createDataFrame([("c", "A1", "name_search", 0, 1, None, "Cyd"), ("d", "A2", "orcid_node", 1, 2, "rule4_x", "Did"), ("e", "A3", "name_search", 0, 1, None, None)], "node_id string, author_id string, method string, own_works int, strength int, rule string, display_name string")
    got = {r["node_id"]: (r["reason"], r["rejected_candidate"]) for r in R.not_found(people, accepted, rejected).collect()}
    assert got == {"a": ("no compatible name found", None), "b": ("no Latin name to search for", None), "c": ("evidence too weak: name_search", "Cyd"), "d": ("stopped by a flag: rule4_x", "Did"), "e": ("profile could not be read", "A3")}


def test_places(spark):
    places = spark.createDataFrame([("n", "roster", "01", None, None), ("m", "institution", None, 1.0, 2.0)], "node_id string, place_type string, institution_code string, lat double, lon double")
    inst = spark.createDataFrame([("01", 25.0, 121.5)], "institution_code string, lat double, lon double")
    assert {r["node_id"]: (r["lat"], r["lon"]) for r in R.fill_places(places, inst).collect()} == {"n": (25.0, 121.5), "m": (1.0, 2.0)}

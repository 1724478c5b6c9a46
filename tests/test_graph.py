"""Communities and permutation tests against plain computations."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coweave.functions import stats as S
from coweave.operators import graph as G


def planted(seed, groups, size, inside, outside):
    rng = random.Random(seed)
    nodes = [(g, f"{g:02}-{i:02}") for g in range(groups) for i in range(size)]
    edges = []
    for k, (g, u) in enumerate(nodes):
        for h, v in nodes[k + 1 :]:
            if rng.random() < (inside if g == h else outside):
                edges.append((u, v, rng.randint(1, 3) if g == h else 1))
    return edges


def modularity(edges, part):
    twice, inside, total = 2 * sum(w for *_, w in edges), 0, defaultdict(float)
    for u, v, w in edges:
        inside += 2 * w * (part[u] == part[v])
        total[part[u]] += w
        total[part[v]] += w
    return inside / twice - sum((k / twice) ** 2 for k in total.values())


def climbed(edges):
    """The best of some partitions that single moves can't improve, from random orders: a plain search."""
    near = defaultdict(dict)
    for u, v, w in edges:
        near[u][v] = near[v][u] = w
    best = -1.0
    for seed in range(5):
        rng = random.Random(seed)
        part, nodes = {u: u for u in near}, sorted(near)
        strength = {u: sum(near[u].values()) for u in near}
        twice, total = sum(strength.values()), dict(strength)
        while True:
            moved = False
            rng.shuffle(nodes)
            for u in nodes:
                ties = Counter()
                for v, w in near[u].items():
                    ties[part[v]] += w
                total[part[u]] -= strength[u]
                to = max([part[u], *ties], key=lambda c: (ties[c] - strength[u] * total[c] / twice, c == part[u]))
                total[to] += strength[u]
                moved, part[u] = moved or to != part[u], to
            if not moved:
                break
        best = max(best, modularity(edges, part))
    return best


@pytest.mark.parametrize(("groups", "size", "inside", "outside"), [(6, 12, 0.6, 0.02), (8, 10, 0.4, 0.04)])
def test_communities_of_planted_graphs(spark, groups, size, inside, outside):
    edges = planted(1, groups, size, inside, outside)
    pairs = spark.createDataFrame(edges, "u string, v string, count int")
    part = dict(map(tuple, G.leiden(pairs).collect()))
    assert set(part) == {x for u, v, _ in edges for x in (u, v)}
    truth = modularity(edges, {x: x[:2] for x in part})
    q = modularity(edges, part)
    assert q >= 0.99 * max(truth, climbed(edges)), (q, truth, climbed(edges))
    frame = spark.createDataFrame(list(part.items()), "node string, community string")
    assert abs(G.modularity(pairs, frame, "count").first()[0] - q) < 1e-9
    check_by_sql(edges, part, q)


def test_communities_from_arrays(spark, monkeypatch):
    """Large components of few nodes take no joins: connected communities, as good as planted; few edges take no stars."""
    edges = planted(3, 8, 12, 0.6, 0.02)
    pairs = spark.createDataFrame(edges, "u string, v string, count int")
    stars = sorted(map(tuple, G.connected_components(pairs, 0).collect()))
    assert sorted(map(tuple, G.connected_components(pairs).collect())) == stars
    monkeypatch.setattr(G, "_leiden_by_joins", lambda *a: pytest.fail("joins along edges"))
    part = dict(map(tuple, G.leiden(pairs, local_edges=0).collect()))
    assert set(part) == {x for u, v, _ in edges for x in (u, v)}
    q = modularity(edges, part)
    assert q >= 0.97 * max(modularity(edges, {x: x[:2] for x in part}), climbed(edges))
    check_by_sql(edges, part, q)


def check_by_sql(edges, part, q):
    """Modularity and connectedness of the communities, and their names, in SQL."""
    db = duckdb.connect()
    db.execute("CREATE TABLE e (u VARCHAR, v VARCHAR, w INT)")
    db.executemany("INSERT INTO e VALUES (?, ?, ?)", edges)
    db.execute("CREATE TABLE p (node VARCHAR, community VARCHAR)")
    db.executemany("INSERT INTO p VALUES (?, ?)", list(part.items()))
    found = db.execute("WITH x AS (SELECT w, a.community AS cu, b.community AS cv FROM e JOIN p a ON a.node = u JOIN p b ON b.node = v), k AS (SELECT c, sum(w) AS k FROM (SELECT cu AS c, w FROM x UNION ALL SELECT cv, w FROM x) GROUP BY 1) SELECT (SELECT sum(w) FILTER (cu = cv) / sum(w) FROM x) - (SELECT sum((k / (SELECT 2.0 * sum(w) FROM x)) ** 2) FROM k)").fetchone()[0]
    assert abs(found - q) < 1e-9
    reached = "WITH RECURSIVE i AS (SELECT u, v FROM e JOIN p a ON a.node = u JOIN p b ON b.node = v AND b.community = a.community UNION SELECT v, u FROM e JOIN p a ON a.node = u JOIN p b ON b.node = v AND b.community = a.community), r AS (SELECT DISTINCT community AS c, community AS node FROM p UNION SELECT c, v FROM r JOIN i ON u = node) SELECT count(*) FROM p LEFT JOIN r ON r.node = p.node AND c = community WHERE c IS NULL"
    assert db.execute(reached).fetchone()[0] == 0  # every node is reached from the least of its community, inside it
    assert db.execute("SELECT count(*) FROM (SELECT community, min(node) AS m FROM p GROUP BY 1) WHERE m <> community").fetchone()[0] == 0


def test_communities_of_small_graphs(spark):
    frame = lambda rows: spark.createDataFrame(rows, "u string, v string, count int")
    assert G.leiden(frame([])).count() == 0
    assert dict(map(tuple, G.leiden(frame([("a", "b", 1)])).collect())) == {"a": "a", "b": "a"}
    ring = [(f"{i:02}", f"{j:02}", 1) for k in range(6) for i, j in ((5 * k + a, 5 * k + b) for a in range(5) for b in range(a + 1, 5))]
    ring += [(f"{5 * k:02}", f"{(5 * k + 9) % 30:02}", 1) for k in range(6)]
    ring = [(min(u, v), max(u, v), w) for u, v, w in ring]
    part = dict(map(tuple, G.leiden(frame(ring)).collect()))
    assert Counter(Counter(part.values()).values()) == Counter({5: 6})
    star = [("hub", f"x{i:03}", 1) for i in range(300)]
    assert set(dict(map(tuple, G.leiden(frame(star)).collect())).values()) == {"hub"}


def test_draws_are_permutations_and_even():
    keys = G.draw_keys("7", 2000, 20)
    for n in (1, 2, 3, 10, 37):
        got = G.shuffled(np.arange(n), np.full(n, n), keys)
        assert (np.sort(got, axis=0) == np.arange(n)[:, None]).all()
    met = np.array([np.bincount(row, minlength=10) for row in G.shuffled(np.arange(10), np.full(10, 10), keys)])
    assert ((met - 200) ** 2 / 200).sum() < 160  # 81 degrees of freedom
    pair = Counter(zip(*G.shuffled(np.arange(4), np.full(4, 4), keys)[:2].tolist(), strict=True))
    assert len(pair) == 12 and max(pair.values()) < 2.0 * min(pair.values())


@pytest.mark.parametrize("stratum", [None, "s"])
def test_permutation_test(spark, stratum):
    rng = random.Random(2)
    people = [(f"{i:02}", rng.choice("ab"), rng.choice(("x", "y", "z", None)), str(i % 3)) for i in range(40)]
    pairs = sorted({tuple(sorted(rng.sample(range(36), 2))) for _ in range(90)})
    pairs = [(f"{u:02}", f"{v:02}") for u, v in pairs]
    frames = spark.createDataFrame(pairs, "u string, v string"), spark.createDataFrame(people, "node string, one string, two string, s string")
    draws = 100
    got = {r["attribute"]: r for r in G.permutation_test(*frames, ["one", "two"], draws, "5", stratum).collect()}
    apart = {r["attribute"]: r for r in G.permutation_test(*frames, ["one", "two"], draws, "5", stratum, local_values=0).collect()}
    keys, seen = G.draw_keys("5", draws, 20), {x for p in pairs for x in p}
    for k, name in enumerate(("one", "two"), 1):
        value = {p[0]: p[k] for p in people if p[0] in seen and p[k] is not None}
        strata = defaultdict(list)
        for p in sorted(people):
            if p[0] in value:
                strata[p[3] if stratum else ""].append(p[0])
        known = [(u, v) for u, v in pairs if u in value and v in value]
        shares = []
        for d in range(draws):
            drawn = {}
            for nodes in strata.values():
                to = G.shuffled(np.arange(len(nodes)), np.full(len(nodes), len(nodes)), keys[d : d + 1])[:, 0]
                drawn |= {x: value[nodes[t]] for x, t in zip(nodes, to.tolist(), strict=True)}
                assert Counter(drawn[x] for x in nodes) == Counter(value[x] for x in nodes)
            shares.append(sum(drawn[u] == drawn[v] for u, v in known) / len(known))
        observed = sum(value[u] == value[v] for u, v in known) / len(known)
        want = (len(known), observed, np.mean(shares), np.percentile(shares, 2.5), np.percentile(shares, 97.5), (sum(s >= observed for s in shares) + 1) / (draws + 1))
        for r in (got[name], apart[name]):
            assert np.allclose(tuple(r)[1:], want), (name, r, want)


def test_exact_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice(("a", "b", None)), rng.choice((1, 2)), rng.choice((None, 0.0, -0.0, 1.5, rng.random(), rng.random() * 100))) for _ in range(2000)]
    rows += [("one", 1, 7.0), ("none", 1, None), ("same", 2, 3.0), ("same", 2, 3.0)] + [("hot", 1, 1.0)] * 3000
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(7)
    cuts = {"low": 0.0, "q10": 0.1, "mid": 0.5, "q99": 0.99, "high": 1.0}
    got = {(r["g"], r["h"]): tuple(r)[2:] for r in S.exact_quantiles(df, ["g", "h"], "v", cuts).collect()}
    groups = defaultdict(list)
    for g, h, v in rows:
        if v is not None:
            groups[g, h].append(v)
    assert got.keys() == groups.keys()
    assert all(np.allclose(got[k], np.quantile(x, list(cuts.values()))) for k, x in groups.items())
    assert np.allclose(tuple(S.exact_quantiles(df, [], "v", cuts).first()), np.quantile([v for *_, v in rows if v is not None], list(cuts.values())))
    assert S.exact_quantiles(df.limit(0), ["g"], "v", cuts).count() == 0


def test_kept_values(spark):
    df = spark.createDataFrame([(k, p) for k, n in (("a", 5), ("b", 3), ("c", 3), ("d", 1), (None, 9)) for p in range(n)], "k string, p int")
    top = {r["kept"]: r["people"] for r in S.keep_top(df, "k", 2).groupBy("kept").agg(F.count_distinct("p").alias("people")).collect()}
    assert top == {"a": 5, "b": 3, "other": 9}
    assert {r["kept"] for r in S.keep_large(df, "k", 4).collect()} == {"a", "other"}

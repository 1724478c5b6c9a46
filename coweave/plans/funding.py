"""Queries on grants, concentration and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import grants as G
from .registry import query

Y0, Y1 = 1995, 2001
DUR = f"""gg AS (SELECT *, CASE WHEN is_pi AND research THEN lead(year) OVER (PARTITION BY teacher_id, (is_pi AND research) ORDER BY year, grant_id) - year END AS gap_next FROM grants_p),
 gd AS (SELECT *, cast(CASE WHEN is_pi AND research AND NOT marked AND year >= {Y0} THEN least(greatest(coalesce(nullif(gap_next, 0), 1), 1), 3) ELSE 1 END AS INT) AS dur FROM gg)"""
PERSON = "per AS (SELECT teacher_id, sum(amount) AS total, count(*) AS n, count(*) FILTER (research) AS m FROM grants_p WHERE is_pi GROUP BY 1)"
GROUPED = "pg AS (SELECT per.*, p.attribute, p.institution, p.value FROM per JOIN persons_p p ON p.teacher_id = per.teacher_id)"


def durations(v):
    return G.with_durations(v.grants_p, Y0)


def persons(v):
    g = v.grants_p.filter("is_pi").groupBy("teacher_id")
    return g.agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"), F.count_if("research").alias("m"))


def attributed(v):
    return persons(v).join(v.persons_p, "teacher_id")


@query("c6_pi_grants", "SELECT grant_id, teacher_id, year, grant_category FROM grants_p WHERE is_pi AND year BETWEEN 1996 AND 1999")
def c6(v):
    return G.pi_grants(v.grants_p, (1996, 1999)).select("grant_id", "teacher_id", "year", "grant_category")


@query("h1_gap_next", f"WITH {DUR} SELECT grant_id, cast(gap_next AS INT) AS gap_next FROM gd")
def h1(v):
    return durations(v).select("grant_id", "gap_next")


@query("h2_duration", f"WITH {DUR} SELECT grant_id, dur FROM gd")
def h2(v):
    return durations(v).select("grant_id", "dur")


@query("h3_amount_per_year", f"WITH {DUR} SELECT grant_id, round(amount / dur, 4) AS amount_per_year FROM gd")
def h3(v):
    return durations(v).select("grant_id", F.round("amount_per_year", 4).alias("amount_per_year"))


SPREAD = f"{DUR}, sp AS (SELECT *, unnest(range(year, year + dur)) AS active_year FROM gd)"


@query("h4_spread_years", f"WITH {SPREAD} SELECT grant_id, cast(active_year AS INT) AS active_year FROM sp WHERE active_year <= {Y1}")
def h4(v):
    return G.spread_years(durations(v), Y1).select("grant_id", "active_year")


@query("h6_first_event", "SELECT teacher_id, year AS first_year, grant_category AS first_category FROM (SELECT *, row_number() OVER (PARTITION BY teacher_id ORDER BY year, grant_id) AS rn FROM grants_p) WHERE rn = 1")
def h6(v):
    return G.first_event(v.grants_p)


@query("h7_transition_gap", "WITH s AS (SELECT teacher_id, min(year) AS start_year FROM grants_p WHERE grant_category = '1-URGENT' GROUP BY 1 HAVING min(year) <= 1998), n AS (SELECT teacher_id, year FROM grants_p WHERE grant_category = '2-HIGH') SELECT s.teacher_id, start_year, cast(min(CASE WHEN year >= start_year THEN year END) - start_year AS INT) AS gap FROM s LEFT JOIN n ON n.teacher_id = s.teacher_id GROUP BY 1, 2")
def h7(v):
    return G.transition_gaps(v.grants_p, F.col("grant_category") == "1-URGENT", F.col("grant_category") == "2-HIGH", 1998)


@query("h8_cohort", "SELECT teacher_id, min(year) AS first_year FROM grants_p WHERE is_pi GROUP BY 1 HAVING min(year) BETWEEN 1996 AND 1998")
def h8(v):
    return v.grants_p.filter("is_pi").groupBy("teacher_id").agg(F.min("year").alias("first_year")).filter("first_year BETWEEN 1996 AND 1998")


@query("h9_active_share", f"WITH {SPREAD} SELECT teacher_id, count(DISTINCT active_year) AS active, round(count(DISTINCT active_year)::DOUBLE / ({Y1} - min(active_year) + 1), 6) AS share FROM sp WHERE active_year <= {Y1} GROUP BY 1")
def h9(v):
    return G.active_share(durations(v), Y1).withColumn("share", F.round("share", 6))


@query("h10_breaks", "SELECT teacher_id, year, previous_year FROM (SELECT *, lag(year) OVER (PARTITION BY teacher_id ORDER BY year) AS previous_year FROM (SELECT DISTINCT teacher_id, year FROM grants_p)) WHERE year - previous_year > 2")
def h10(v):
    return G.breaks(v.grants_p, 2)


@query("h12_dense_years", "SELECT cast(y AS INT) AS year, count(grant_id) AS n FROM range(1993, 2004) t(y) LEFT JOIN grants_p ON year = y GROUP BY 1")
def h12(v):
    spine = v.spark.range(1993, 2004).select(F.col("id").cast("int").alias("year"))
    return spine.join(v.grants_p.select("year", "grant_id"), "year", "left").groupBy("year").agg(F.count("grant_id").alias("n"))


@query("g11_year_category_pivot", f"WITH {SPREAD} SELECT cast(y AS INT) AS active_year, " + ", ".join(f"round(coalesce(sum(CASE WHEN grant_category = '{c}' THEN amount / dur END), 0), 0) AS {n}" for c, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low"))) + f" FROM range({Y0}, {Y1} + 1) t(y) LEFT JOIN sp ON active_year = y GROUP BY 1")
def g11(v):
    rows = G.spread_years(durations(v), Y1)
    cats = ["1-URGENT", "2-HIGH", "5-LOW"]
    wide = G.dense_pivot(rows, "active_year", "grant_category", "amount_per_year", cats, Y0, Y1)
    return wide.select("active_year", *[F.round(F.col(f"`{c}`"), 0).alias(n) for c, n in zip(cats, ("urgent", "high", "low"), strict=True)])


@query("g12_active_people", "SELECT year, count(DISTINCT teacher_id) AS people, count(DISTINCT CASE WHEN research THEN teacher_id END) AS researchers FROM grants_p WHERE is_pi GROUP BY 1")
def g12(v):
    return v.grants_p.filter("is_pi").groupBy("year").agg(F.count_distinct("teacher_id").alias("people"), F.count_distinct(F.when(F.col("research"), F.col("teacher_id"))).alias("researchers"))


CATS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("g6_person_table", "SELECT p.teacher_id, " + ", ".join(f"round(coalesce(sum(amount) FILTER (grant_category = '{c}'), 0), 2) AS f_{c[0]}" for c in CATS) + ", round(coalesce(sum(amount), 0), 2) AS funding, round(coalesce(sum(amount) FILTER (research), 0), 2) AS funding_research, count(g.grant_id) AS n_pi FROM persons_p p LEFT JOIN grants_p g ON g.teacher_id = p.teacher_id AND is_pi GROUP BY 1")
def g6(v):
    g = v.grants_p.filter("is_pi").groupBy("teacher_id").agg(*[F.sum(F.when(F.col("grant_category") == c, F.col("amount"))).alias(f"f_{c[0]}") for c in CATS], F.sum("amount").alias("funding"), F.sum(F.when(F.col("research"), F.col("amount"))).alias("funding_research"), F.count(F.lit(1)).alias("n_pi"))
    out = v.persons_p.select("teacher_id").join(g, "teacher_id", "left")
    return out.select("teacher_id", *[F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in g.columns[1:-1]], F.coalesce("n_pi", F.lit(0)).alias("n_pi"))


_SUMS = "su AS (SELECT p.teacher_id, " + ", ".join(f"coalesce(sum(amount) FILTER (grant_category = '{c}'), 0) AS f_{c[0]}" for c in CATS) + ", coalesce(sum(amount), 0) AS funding, coalesce(sum(amount) FILTER (research), 0) AS funding_research FROM persons_p p LEFT JOIN grants_p g ON g.teacher_id = p.teacher_id AND is_pi GROUP BY 1)"
#: The two lists of top recipients: what ranks them, the parts shown, and where the scale ends.
STACKS = {"all": ("funding", [f"f_{c[0]}" for c in CATS], 2e6), "research": ("funding_research", ["f_1", "f_2", "f_3"], 1.5e6)}


def _stack_sql(name: str) -> str:
    by, parts, most = STACKS[name]
    out = []
    for i, p in enumerate(parts):
        start = " + ".join(["0.0", *parts[:i]])
        out.append(f"SELECT '{name}' AS list, teacher_id, {i} AS ord, '{p}' AS part, round({p}, 2) AS value, round({start}, 2) AS start, round(least({start}, {most}), 2) AS shown_start, round(least({start} + {p}, {most}) - least({start}, {most}), 2) AS shown FROM (SELECT * FROM su ORDER BY {by} DESC, teacher_id LIMIT 25)")
    return " UNION ALL ".join(out)


@query("o23_stacked_shares", f"WITH {_SUMS} {_stack_sql('all')} UNION ALL {_stack_sql('research')}")
def o23(v):
    """The parts of the top recipients' money, stacked, and what is shown of them where bars are cut off."""
    t, out = g6(v), None
    for name, (by, parts, most) in STACKS.items():
        top = t.orderBy(F.desc(by), "teacher_id").limit(25)
        rows = S.clipped_stack(top, "teacher_id", parts, most).select(F.lit(name).alias("list"), "teacher_id", "ord", "part", *[F.round(c, 2).alias(c) for c in ("value", "start", "shown_start", "shown")])
        out = rows if out is None else out.unionByName(rows)
    return out


FULL = "full_p AS (SELECT p.*, coalesce(per.total, 0) AS total FROM persons_p p LEFT JOIN per ON per.teacher_id = p.teacher_id)"


def full(v):
    return v.persons_p.join(persons(v).select("teacher_id", "total"), "teacher_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


@query("g8_institution_summary", f"WITH {PERSON}, {FULL} SELECT institution, count(*) AS n, round(sum(total), 2) AS total, round(avg(total), 4) AS mean, round(median(total), 4) AS median, round(avg(CASE WHEN total = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, round(sum(total) / sum(sum(total)) OVER (), 8) AS part FROM full_p GROUP BY 1")
def g8(v):
    rows = full(v)
    a = rows.groupBy("institution").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("t"), F.avg("total").alias("mean"), F.avg((F.col("total") == 0).cast("double")).alias("zero_share"))
    a = S.by_group(a, S.exact_median(rows, ["institution"], "total"), ["institution"])
    return a.select("institution", "n", F.round("t", 2).alias("total"), F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("zero_share", 6).alias("zero_share"), F.round(S.share_of_total(F.col("t")), 8).alias("part"))


_QUARTILES = "count(*) AS n, round(quantile_cont(amount, 0.25), 4) AS q25, round(median(amount), 4) AS q50, round(quantile_cont(amount, 0.75), 4) AS q75, count(DISTINCT teacher_id) AS people, round(avg(CASE WHEN dur > 1 THEN 1.0 ELSE 0.0 END), 6) AS multi_share"


def _quartiles(rows, by):
    a = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("teacher_id").alias("people"), F.round(F.avg((F.col("dur") > 1).cast("double")), 6).alias("multi_share"))
    q = S.exact_quantiles(rows, [by], "amount", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return S.by_group(a, q, [by]).select(by, "n", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")], "people", "multi_share")


@query("g10_category_quartiles", f"WITH {DUR} SELECT grant_category, {_QUARTILES} FROM gd WHERE is_pi GROUP BY 1")
def g10(v):
    return _quartiles(durations(v).filter("is_pi"), "grant_category")


@query("g10_top_and_other", f"WITH {DUR}, top AS (SELECT grant_category AS c FROM gd WHERE is_pi GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) SELECT coalesce(c, 'other') AS kept, {_QUARTILES} FROM gd LEFT JOIN top ON c = grant_category WHERE is_pi GROUP BY 1")
def g10_top(v):
    """The categories with most grants, and the others as one, their people counted once."""
    return _quartiles(S.keep_top(durations(v).filter("is_pi"), "grant_category", 3), "kept")


@query("g19_attribute_stats", f"WITH {PERSON}, {FULL} SELECT attribute, count(*) AS n, round(avg(total), 4) AS mean, round(median(total) FILTER (total > 0), 4) AS median_positive, round(avg(CASE WHEN total = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM full_p GROUP BY 1")
def g19(v):
    rows = full(v)
    a = rows.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 4).alias("mean"), F.round(F.avg((F.col("total") == 0).cast("double")), 6).alias("zero_share"))
    return S.by_group(a, S.exact_median(rows.filter("total > 0"), ["attribute"], "total", "m"), ["attribute"]).select("attribute", "n", "mean", F.round("m", 4).alias("median_positive"), "zero_share")


@query("g26_binned_median", f"WITH {PERSON} SELECT cast(least(floor(n / 5) * 5, 40) AS BIGINT) AS bin, count(*) AS people, round(median(total), 4) AS median FROM per GROUP BY 1")
def g26(v):
    rows = persons(v).withColumn("bin", F.least(F.floor(F.col("n") / 5) * 5, F.lit(40)).cast("bigint"))
    a = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("people"))
    return S.by_group(a, S.exact_median(rows, ["bin"], "total"), ["bin"]).withColumn("median", F.round("median", 4))


@query("i1_top25", f"WITH {PERSON} SELECT teacher_id, round(total, 2) AS total FROM per ORDER BY total DESC, teacher_id LIMIT 25")
def i1(v):
    return persons(v).orderBy(F.desc("total"), "teacher_id").limit(25).select("teacher_id", F.round("total", 2).alias("total"))


@query("i4_topk_per_group", f"WITH {PERSON}, {GROUPED} SELECT attribute, teacher_id, cast(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY total DESC, teacher_id) AS rn FROM pg) WHERE rn <= 3")
def i4(v):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("total"), "teacher_id"))
    return attributed(v).withColumn("rank", rank).filter("rank <= 3").select("attribute", "teacher_id", "rank")


@query("i7_overlap", f"WITH {PERSON}, a AS (SELECT teacher_id FROM per ORDER BY total DESC, teacher_id LIMIT 100), b AS (SELECT teacher_id FROM per ORDER BY n DESC, teacher_id LIMIT 100) SELECT teacher_id FROM a INTERSECT SELECT teacher_id FROM b")
def i7(v):
    top = lambda c: persons(v).orderBy(F.desc(c), "teacher_id").limit(100).select("teacher_id")
    return top("total").intersect(top("n"))


@query("i10_set_difference", "SELECT teacher_id FROM persons_p EXCEPT SELECT teacher_id FROM grants_p WHERE marked")
def i10(v):
    return v.persons_p.select("teacher_id").subtract(v.grants_p.filter("marked").select("teacher_id"))


@query("l1_gini", f"WITH {PERSON}, {FULL}, r AS (SELECT total, row_number() OVER (ORDER BY total) AS i, count(*) OVER () AS n FROM full_p) SELECT round(sum((2 * i - n - 1) * total) / (any_value(n) * sum(total)), 8) AS gini FROM r")
def l1(v):
    return S.gini(full(v), "total").select(F.round("gini", 8).alias("gini"))


@query("l1_gini_by_attribute", f"WITH {PERSON}, {FULL}, r AS (SELECT attribute, total, row_number() OVER (PARTITION BY attribute ORDER BY total) AS i, count(*) OVER (PARTITION BY attribute) AS n FROM full_p WHERE total > 0) SELECT attribute, round(sum((2 * i - n - 1) * total) / (any_value(n) * sum(total)), 8) AS gini FROM r GROUP BY 1")
def l1_by(v):
    return S.gini(full(v).filter("total > 0"), "total", "attribute").withColumn("gini", F.round("gini", 8))


@query("l2_top_share", f"WITH {PERSON}, {FULL}, r AS (SELECT total, row_number() OVER (ORDER BY total DESC) AS i, count(*) OVER () AS n FROM full_p) SELECT round(sum(total) FILTER (i <= greatest(1, round_even(n * 0.1, 0))) / sum(total), 8) AS top10, round(1 - sum(total) FILTER (i <= greatest(1, round_even(n * 0.5, 0))) / sum(total), 8) AS bottom50 FROM r")
def l2(v):
    a, b = S.top_share(full(v), "total", 0.1), S.top_share(full(v), "total", 0.5)
    return a.select(F.round("share", 8).alias("top10")).crossJoin(b.select(F.round(1 - F.col("share"), 8).alias("bottom50")))  # one row each


LORENZ = f"{PERSON}, {FULL}, lc AS (SELECT teacher_id, row_number() OVER w / count(*) OVER ()::DOUBLE AS population, sum(total) OVER w / sum(total) OVER () AS cumulative FROM full_p WINDOW w AS (ORDER BY total, teacher_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query("h14_lorenz", f"WITH {LORENZ} SELECT teacher_id, round(population, 8) AS population, round(cumulative, 8) AS cumulative FROM lc")
def h14(v):
    return S.lorenz(full(v), "total", "teacher_id").withColumns({c: F.round(c, 8) for c in ("population", "cumulative")})


@query("l4_lorenz_at", f"WITH {LORENZ}, a AS (SELECT max(population) AS p, max(cumulative) AS c FROM lc WHERE population <= 0.8), b AS (SELECT min(population) AS p, min(cumulative) AS c FROM lc WHERE population >= 0.8) SELECT round(a.c + CASE WHEN a.p = b.p THEN 0 ELSE (0.8 - a.p) / (b.p - a.p) END * (b.c - a.c), 8) AS cumulative FROM a, b")
def l4(v):
    return S.at_lorenz(S.lorenz(full(v), "total", "teacher_id"), 0.8).select(F.round("cumulative", 8).alias("cumulative"))


@query("h15_ccdf", f"WITH {PERSON} SELECT teacher_id, n, round(1 - (row_number() OVER (ORDER BY n, teacher_id) - 1) / count(*) OVER ()::DOUBLE, 8) AS ccdf FROM per WHERE n > 0")
def h15(v):
    return S.ccdf(persons(v), "n", "teacher_id").withColumn("ccdf", F.round("ccdf", 8))


@query("h16_pct_rank", f"WITH {PERSON} SELECT teacher_id, round((rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / count(*) OVER (), 8) AS pct FROM per")
def h16(v):
    return S.percent_rank_average(persons(v), "n", "pct").select("teacher_id", F.round("pct", 8).alias("pct"))


@query("l5_ols", f"WITH {PERSON} SELECT round(regr_slope(log10(total), log10(n)), 6) AS slope, round(regr_intercept(log10(total), log10(n)), 6) AS intercept, round(corr(log10(n), log10(total)), 6) AS r, count(*) AS n FROM per")
def l5(v):
    d = persons(v).select(F.log10("n").alias("x"), F.log10("total").alias("y"))
    return S.ols(d, "x", "y").select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r")], "n")


@query("l6_residual_quartiles", f"WITH {PERSON}, f AS (SELECT regr_slope(total, n) AS s, regr_intercept(total, n) AS i, quantile_cont(total, 0.25) AS a, median(total) AS b, quantile_cont(total, 0.75) AS c FROM per) SELECT teacher_id, round(total - i - s * n, 2) AS residual, 1 + cast(total > a AS INT) + cast(total > b AS INT) + cast(total > c AS INT) AS quantile_group FROM per, f")
def l6(v):
    return S.quantile_group(S.residuals(persons(v), "n", "total"), "total").select("teacher_id", F.round("residual", 2).alias("residual"), "quantile_group")


@query("i2_residual_extremes", f"WITH {PERSON}, f AS (SELECT regr_slope(total, n) AS s, regr_intercept(total, n) AS i FROM per) SELECT teacher_id, round(total - i - s * n, 2) AS residual FROM per, f WHERE n >= 3 ORDER BY total - i - s * n DESC, teacher_id LIMIT 8")
def i2(v):
    r = S.residuals(persons(v), "n", "total").filter("n >= 3").orderBy(F.desc("residual"), "teacher_id").limit(8)
    return r.select("teacher_id", F.round("residual", 2).alias("residual"))


_AVG = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query("l7_spearman", f"WITH {PERSON}, r AS (SELECT {_AVG.format('n')} AS a, {_AVG.format('total')} AS b FROM per) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r")
def l7(v):
    return S.spearman(persons(v), "n", "total").select(F.round("rho", 6).alias("rho"), "n")


@query("l8_partial_rank", f"WITH {PERSON}, {GROUPED}, r AS (SELECT {_AVG.format('m')} AS x, {_AVG.format('total')} AS y, {_AVG.format('n')} AS z FROM pg), f AS (SELECT regr_slope(x, z) AS sx, regr_intercept(x, z) AS ix, regr_slope(y, z) AS sy, regr_intercept(y, z) AS iy FROM r) SELECT round(corr(x - ix - sx * z, y - iy - sy * z), 6) AS rho FROM r, f")
def l8(v):
    return S.partial_spearman(attributed(v), "m", "total", "n").select(F.round("rho", 6).alias("rho"))


@query("l9_quantiles", "SELECT attribute, round(quantile_cont(value, 0.1), 4) AS q10, round(median(value), 4) AS q50, round(quantile_cont(value, 0.9), 4) AS q90 FROM persons_p GROUP BY 1")
def l9(v):
    q = S.exact_quantiles(v.persons_p, ["attribute"], "value", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return q.select("attribute", *[F.round(c, 4).alias(c) for c in ("q10", "q50", "q90")])


@query("l10_shares", "SELECT attribute, round(count(*)::DOUBLE / sum(count(*)) OVER (), 8) AS part FROM persons_p GROUP BY 1")
def l10(v):
    a = v.persons_p.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))
    return a.select("attribute", F.round(S.share_of_total(F.col("n")), 8).alias("part"))


@query("l11_ratio_median", f"WITH {PERSON} SELECT round(median(total / nullif(m, 0)), 4) AS median FROM per")
def l11(v):
    return S.exact_median(persons(v).withColumn("ratio", F.col("total") / F.nullif("m", F.lit(0))), [], "ratio").select(F.round("median", 4).alias("median"))


@query("c15_clipped", f"WITH {PERSON} SELECT teacher_id, CASE WHEN m > 0 THEN m::DOUBLE ELSE 0.5 END AS shown, least(greatest(n, 2), 12) AS clipped FROM per")
def c15(v):
    return persons(v).select("teacher_id", F.when(F.col("m") > 0, F.col("m").cast("double")).otherwise(0.5).alias("shown"), F.least(F.greatest("n", F.lit(2)), F.lit(12)).cast("bigint").alias("clipped"))


@query("o20_recode_rare", "WITH k AS (SELECT *, count(*) OVER (PARTITION BY institution) AS c FROM persons_p), g AS (SELECT CASE WHEN c >= 60 THEN cast(institution AS VARCHAR) ELSE 'other' END AS kept, count(*) AS n, median(value) AS m FROM k GROUP BY 1) SELECT kept, n, round(m, 4) AS median, row_number() OVER (ORDER BY m DESC, kept) AS place FROM g")
def o20(v):
    from pyspark.sql import Window

    rows = S.keep_large(v.persons_p, "institution", 60)
    a = rows.groupBy("kept").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("median"), "kept"))  # a row for each kept value
    return S.by_group(a, S.exact_median(rows, ["kept"], "value"), ["kept"]).withColumn("place", place.cast("bigint")).withColumn("median", F.round("median", 4))


@query("o21_top_values", "WITH t AS (SELECT institution, row_number() OVER (ORDER BY count(*) DESC, institution) AS rn FROM persons_p GROUP BY 1) SELECT CASE WHEN rn <= 8 THEN cast(t.institution AS VARCHAR) ELSE 'other' END AS kept, count(*) AS n FROM persons_p p JOIN t ON t.institution = p.institution GROUP BY 1")
def o21(v):
    top = v.persons_p.groupBy("institution").count().orderBy(F.desc("count"), "institution").limit(8).select("institution", F.lit(True).alias("top"))
    return v.persons_p.join(F.broadcast(top), "institution", "left").groupBy(F.when(F.col("top"), F.col("institution").cast("string")).otherwise("other").alias("kept")).agg(F.count(F.lit(1)).alias("n"))  # eight rows


@query("h17_stacked", "SELECT year, grant_category, count(*) AS n, cast(sum(count(*)) OVER (PARTITION BY year ORDER BY grant_category) - count(*) AS BIGINT) AS bottom FROM grants_p GROUP BY 1, 2")
def h17(v):
    from pyspark.sql import Window

    n = v.grants_p.groupBy("year", "grant_category").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("year").orderBy("grant_category").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return n.withColumn("bottom", F.sum("n").over(run) - F.col("n"))


@query("o27_without_top", f"WITH {PERSON}, t AS (SELECT teacher_id FROM per ORDER BY total DESC, teacher_id LIMIT 1), r AS (SELECT total, row_number() OVER (ORDER BY total) AS i, count(*) OVER () AS n FROM per WHERE teacher_id NOT IN (SELECT teacher_id FROM t)) SELECT round(sum((2 * i - n - 1) * total) / (any_value(n) * sum(total)), 8) AS gini FROM r")
def o27(v):
    top = persons(v).orderBy(F.desc("total"), "teacher_id").limit(1).select("teacher_id")
    return S.gini(persons(v).join(top, "teacher_id", "left_anti"), "total").select(F.round("gini", 8).alias("gini"))


@query("b2_partition_counts", "SELECT year, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS of_all FROM papers_p GROUP BY 1")
def b2(v):
    from pyspark.sql import Window

    return v.papers_p.groupBy("year").agg(F.count(F.lit(1)).alias("n")).withColumn("of_all", F.sum("n").over(Window.partitionBy()))

"""Concentration, rank and regression statistics.

Ranks come from counts of distinct values and their running totals by ranges, so no task sees all rows; only groups that the caller
names are ranked within a window, over their distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import running


def _counts(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """group, value, _c (rows with it) and _a (rows of the group with a lesser value)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    if group:
        upto = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("_a", F.sum("_c").over(upto) - F.col("_c"))
    return running(counts, [value], {"_a": F.col("_c")}).withColumn("_a", F.col("_a") - F.col("_c"))


def _with(df: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    return df.join(totals, group) if group else df.crossJoin(F.broadcast(totals))  # one row


def gini(df: DataFrame, value: str, *group: str) -> DataFrame:
    """Gini coefficient of each group: sum of (2i - n - 1) x over n times the sum of x."""
    d, x = _counts(df, value, list(group)), F.col(value) * F.col("_c")
    n, total = F.sum("_c"), F.sum(x)
    return d.groupBy(*group).agg(((F.sum(x * (2 * F.col("_a") + F.col("_c"))) - n * total) / F.nullif(n * total, F.lit(0.0))).alias("gini"))


def top_share(df: DataFrame, value: str, q: float, *group: str) -> DataFrame:
    """Share of the total that the top max(1, round(n q)) hold; halves round to even."""
    d = _counts(df, value, list(group))
    d = _with(d, d.groupBy(*group).agg(F.sum("_c").alias("_n")), list(group))
    k = F.greatest(F.lit(1), F.bround(F.col("_n") * q).cast("long"))
    above = F.col("_n") - F.col("_a") - F.col("_c")
    taken = F.least(F.col("_c"), F.greatest(F.lit(0), k - above))
    return d.groupBy(*group).agg((F.sum(taken * F.col(value)) / F.sum(F.col("_c") * F.col(value))).alias("share"))


def lorenz(df: DataFrame, value: str, key: str) -> DataFrame:
    """population and value shares, cumulated from the poorest; ties by key."""
    d = running(df.select(key, value), [value, key], {"_i": F.lit(1), "_s": F.col(value)})
    d = _with(d, df.agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_total")), [])
    return d.select(key, (F.col("_i") / F.col("_n")).alias("population"), (F.col("_s") / F.col("_total")).alias("cumulative"))


def at_lorenz(curve: DataFrame, x: float) -> DataFrame:
    """Linear interpolation of the curve at a population share."""
    lo = F.max(F.when(F.col("population") <= x, F.struct("population", "cumulative")))
    hi = F.min(F.when(F.col("population") >= x, F.struct("population", "cumulative")))
    b = curve.agg(lo.alias("a"), hi.alias("b"))
    step = F.when(F.col("b.population") == F.col("a.population"), 0.0).otherwise((x - F.col("a.population")) / (F.col("b.population") - F.col("a.population")))
    return b.select((F.col("a.cumulative") + step * (F.col("b.cumulative") - F.col("a.cumulative"))).alias("cumulative"))


def ccdf(df: DataFrame, value: str, key: str) -> DataFrame:
    """Of the positive values in ascending order, 1 - i / n with i from 0; ties by key."""
    d = df.filter(F.col(value) > 0).select(key, value)
    d = _with(running(d, [value, key], {"_i": F.lit(1)}), d.agg(F.count(F.lit(1)).alias("_n")), [])
    return d.select(key, F.col(value), (1 - (F.col("_i") - 1) / F.col("_n")).alias("ccdf"))


def average_rank(df: DataFrame, value: str, name: str, *group: str) -> DataFrame:
    """df with the rank of the value, ties at their mean; null values have none."""
    ranks = _counts(df, value, list(group)).select(*group, value, (F.col("_a") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(ranks, [*group, value], "left").select(*df.columns, name)


def percent_rank_average(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average rank over the number of rows."""
    return _with(average_rank(df, value, name), df.agg(F.count(F.lit(1)).alias("_n")), []).withColumn(name, F.col(name) / F.col("_n")).drop("_n")


def ols(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    return df.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def residuals(df: DataFrame, x: str, y: str) -> DataFrame:
    fit = df.agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_intercept"))
    return df.crossJoin(F.broadcast(fit)).withColumn("residual", F.col(y) - F.col("_intercept") - F.col("_slope") * F.col(x)).drop("_slope", "_intercept")  # one row


def spearman(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_rank(average_rank(d, x, "_rx", *group), y, "_ry", *group)
    return d.groupBy(*group).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Rank correlation of x and y with z's rank taken out of both."""
    d = average_rank(average_rank(average_rank(df, x, "_rx"), y, "_ry"), z, "_rz")
    d = residuals(d, "_rz", "_rx").withColumnRenamed("residual", "_ex")
    d = residuals(d, "_rz", "_ry").withColumnRenamed("residual", "_ey")
    return d.agg(F.corr("_ex", "_ey").alias("rho"))


def _same(left: str, right: str, group: list[str]) -> Column:
    out = F.lit(True)
    for g in group:
        out = out & F.col(f"{left}{g}").eqNullSafe(F.col(f"{right}{g}"))
    return out


def by_group(rows: DataFrame, totals: DataFrame, group: list[str], how: str = "left") -> DataFrame:
    """rows joined with the totals of their group; nulls are a group like others."""
    if not group:
        return rows.crossJoin(F.broadcast(totals))  # one row
    return rows.join(totals.withColumnsRenamed({g: f"_t_{g}" for g in group}), _same("", "_t_", group), how).drop(*[f"_t_{g}" for g in group])


def exact_quantiles(rows: DataFrame, group: list[str], value: str, cuts: dict[str, float]) -> DataFrame:
    """group and a column for each cut: the exact quantile of the known values, between the two nearest of them if it falls there.

    Values are counted, the counts run up along group and value by ranges of both, and the two values that hold a place are picked
    from it by an aggregation: no task sees a group, however many rows or values it has. Groups without a known value have no row."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ran = running(counts, [*group, "_v"], {"_upto": F.col("_n")})
    totals = ran.groupBy(*group).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_all"))
    d = by_group(ran, totals, group, "inner").withColumn("_before", F.col("_upto") - F.col("_n") - F.col("_start"))
    at = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col("_v")))
    picked, out = [], []
    for name, q in cuts.items():
        place = (F.col("_all") - 1) * F.lit(q)
        picked += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_in_{name}")]
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_in_{name}")).alias(name))
    return d.groupBy(*group).agg(*picked).select(*group, *out)


def exact_median(rows: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(rows, group, value, {name: 0.5})


def keep_top(rows: DataFrame, key: str, most: int, name: str = "kept", other: str = "other") -> DataFrame:
    """rows with the key as text if it is one of the ``most`` with most rows (the least of equals first), else ``other``; what is then
    aggregated by the new column, distinct counts too, is right for the rest as a whole."""
    top = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_k").limit(most).select("_k")
    d = rows.join(F.broadcast(top), F.col(key) == F.col("_k"), "left")  # ``most`` rows
    return d.withColumn(name, F.coalesce(F.col("_k").cast("string"), F.lit(other))).drop("_k")


def keep_large(rows: DataFrame, key: str, least: int, name: str = "kept", other: str = "other") -> DataFrame:
    """rows with the key as text if at least ``least`` rows have it, else ``other``."""
    large = rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("_k")
    return rows.join(large, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce(F.col("_k").cast("string"), F.lit(other))).drop("_k")


def quantile_group(df: DataFrame, value: str, cuts: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """1 for values up to the first quantile, and so on."""
    q = exact_quantiles(df, [], value, {f"_q{i}": c for i, c in enumerate(cuts)})
    step = sum(F.when(F.col(value) > F.col(f"_q{i}"), 1).otherwise(0) for i in range(len(cuts)))
    return df.crossJoin(F.broadcast(q)).withColumn("quantile_group", F.lit(1) + step).drop(*[f"_q{i}" for i in range(len(cuts))])  # one row


def clipped_stack(rows: DataFrame, key: str, parts: list[str], most: float) -> DataFrame:
    """key, ord, part, value, start, shown_start, shown: the parts of each row stacked on each other, and what of them is shown where
    the scale ends at ``most``."""
    start, out = F.lit(0.0), []
    for i, p in enumerate(parts):
        end = start + F.col(p)
        cap = lambda c: F.least(c, F.lit(float(most)))
        out.append(F.struct(F.lit(i).alias("ord"), F.lit(p).alias("part"), F.col(p).cast("double").alias("value"), start.alias("start"), cap(start).alias("shown_start"), (cap(end) - cap(start)).alias("shown")))
        start = end
    return rows.select(key, F.explode(F.array(*out)).alias("s")).select(key, "s.*")


def share_of_total(value: Column, *group: str) -> Column:
    return value / F.sum(value).over(Window.partitionBy(*group))

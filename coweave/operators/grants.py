"""Grants: parsing, multi-year spreading, sequences and career measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First year whose research grants are read as possibly spanning several years.
SPREAD_FROM = 2006
#: (1/3)-like marks in ASCII or full-width characters.
PART_MARK = "[(（][0-9０-９]+[/／][0-9０-９]+[)）]"


def roc_year(s: Column) -> Column:
    """Western year of a year of the Republic; null unless all digits."""
    return F.when(s.rlike("^[0-9]+$"), F.expr(f"try_cast({_sql(s)} AS int)") + 1911)


def money(s: Column) -> Column:
    """Amount of a text with separators; null if it has no digit."""
    return F.nullif(F.regexp_replace(s, "[^0-9]", ""), F.lit("")).cast("double")


def _sql(c: Column) -> str:
    return c._jc.toString()


def is_pi(role: Column) -> Column:
    return role.contains("主持人") & ~role.contains("共同")


def is_marked(title: Column) -> Column:
    return title.rlike(PART_MARK)


def pi_grants(grants: DataFrame, years: tuple[int, int]) -> DataFrame:
    return grants.filter(F.col("is_pi") & F.col("year").between(*years))


def with_durations(grants: DataFrame, spread_from: int = SPREAD_FROM) -> DataFrame:
    """gap_next: years to the same person's next research grant (order: year, grant_id); dur: that gap between 1 and 3 for
    unmarked research grants as PI from ``spread_from`` on, else 1; amount_per_year."""
    counts = F.col("is_pi") & F.col("research")
    w = Window.partitionBy("teacher_id", counts).orderBy("year", "grant_id")
    gap = F.when(counts, F.lead("year").over(w) - F.col("year"))
    g = grants.withColumn("gap_next", gap)
    spread = counts & ~F.col("marked") & (F.col("year") >= spread_from)
    clamped = F.least(F.greatest(F.coalesce(F.nullif("gap_next", F.lit(0)), F.lit(1)), F.lit(1)), F.lit(3))
    g = g.withColumn("dur", F.when(spread, clamped).otherwise(1))
    return g.withColumn("amount_per_year", F.col("amount") / F.col("dur"))


def spread_years(grants: DataFrame, last_year: int) -> DataFrame:
    """One row for each year that a grant covers, up to ``last_year``."""
    years = F.explode(F.sequence("year", F.col("year") + F.col("dur") - 1)).alias("active_year")
    return grants.select("*", years).filter(F.col("active_year") <= last_year)


def first_event(grants: DataFrame) -> DataFrame:
    """teacher_id, first_year and the category of the first grant (order: year, grant_id)."""
    w = Window.partitionBy("teacher_id").orderBy("year", "grant_id")
    return grants.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("teacher_id", F.col("year").alias("first_year"), F.col("grant_category").alias("first_category"))


def transition_gaps(grants: DataFrame, start: Column, later: Column, last_start: int) -> DataFrame:
    """teacher_id, start_year, gap to the first later kind of grant from then on (null: none yet) for those who began by
    ``last_start``."""
    s = grants.filter(start).groupBy("teacher_id").agg(F.min("year").alias("start_year")).filter(F.col("start_year") <= last_start)
    n = grants.filter(later).select("teacher_id", "year")
    joined = s.join(n, "teacher_id", "left").groupBy("teacher_id", "start_year").agg(F.min(F.when(F.col("year") >= F.col("start_year"), F.col("year"))).alias("next_year"))
    return joined.select("teacher_id", "start_year", (F.col("next_year") - F.col("start_year")).alias("gap"))


def active_share(grants: DataFrame, last_year: int) -> DataFrame:
    """Share of the years since each person's first that some grant covers."""
    a = spread_years(grants, last_year).groupBy("teacher_id").agg(F.count_distinct("active_year").alias("active"), F.min("active_year").alias("first"))
    return a.select("teacher_id", "active", (F.col("active") / (last_year - F.col("first") + 1)).alias("share"))


def breaks(grants: DataFrame, longer_than: int) -> DataFrame:
    """Consecutive grant years of a person that lie further apart."""
    y = grants.select("teacher_id", "year").distinct()
    prev = F.lag("year").over(Window.partitionBy("teacher_id").orderBy("year"))
    return y.withColumn("previous_year", prev).filter(F.col("year") - F.col("previous_year") > longer_than)


def dense_pivot(rows: DataFrame, key: str, category: str, value: str, categories: list[str], first: int, last: int) -> DataFrame:
    """A row for each year of the range and a column for each category; sums, 0 where there is nothing."""
    spine = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(key))
    wide = rows.groupBy(key).agg(*[F.sum(F.when(F.col(category) == c, F.col(value))).alias(c) for c in categories])
    return spine.join(wide, key, "left").fillna(0, categories)

"""Writers: fixed columns, yearly partitions, tables of two schemas, and payloads for pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, fields: list[str], mode: str = "overwrite") -> None:
    """The fields in order; other columns are dropped. mode 'ignore' keeps what is there, as for sheets under review."""
    rows.select(*fields).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_by_year(rows: DataFrame, path: str, year: str = "year") -> None:
    rows.write.mode("overwrite").partitionBy(year).parquet(path)


def union_master(roster: DataFrame, external: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One table of both schemas: the roster's columns, then those only externals have, then new ones, all null where missing."""
    both = roster.unionByName(external, allowMissingColumns=True)
    order = [*roster.columns, *[c for c in external.columns if c not in roster.columns]]
    for c in extra or []:
        if c not in order:
            both, order = both.withColumn(c, F.lit(None).cast("string")), [*order, c]
    return both.select(*order)


def payload(*columns: str, cut: dict[str, int] | None = None) -> Column:
    """A JSON object safe inside a page: long texts cut, < escaped."""
    parts = [F.substring(c, 1, cut[c]).alias(c) if cut and c in cut else F.col(c) for c in columns]
    return F.replace(F.to_json(F.struct(*parts)), F.lit("<"), F.lit("\\u003c"))


def work_queue(rows: DataFrame, key: str, degree: str, papers: str) -> DataFrame:
    """key, priority (degree * 100 + number of papers, 99 at most), most urgent first."""
    return rows.select(key, (F.col(degree) * 100 + F.least(F.col(papers), F.lit(99))).alias("priority")).orderBy(F.desc("priority"), key)


def snapshot(rows: DataFrame, path: str) -> bool:
    """Write the table unless the one at ``path`` has the same rows; whether it was written."""
    from pyspark.errors import AnalysisException

    digest = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[d[c].cast("string") for c in rows.columns]).cast("decimal(38,0)"))).first())
    try:
        old = digest(rows.sparkSession.read.parquet(path).select(*rows.columns))
    except AnalysisException:
        old = None
    if old == digest(rows):
        return False
    rows.write.mode("overwrite").parquet(path)
    return True

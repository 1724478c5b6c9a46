"""Checks as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key is not known."""
    return rows.join(known.select(F.col(known_key).alias(key)), key, "left_anti")


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def outside(rows: DataFrame, column: str, low, high) -> DataFrame:
    return rows.filter(~F.col(column).between(low, high))


def uneven_weights(edges: DataFrame) -> DataFrame:
    """Papers whose pair weights do not add up to one."""
    return edges.groupBy("paper_id").agg(F.sum("weight_pair").alias("w")).filter(F.abs(F.col("w") - 1) > 1e-5)


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """rule, violations: one row for each check."""
    counts = [d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, d in checks.items()]
    return reduce(DataFrame.unionByName, counts)


def uncovered(rows: DataFrame, key: str, *parts: DataFrame) -> DataFrame:
    """Keys that are in none of the parts or in several: parts should cover the rows without overlap."""
    found = reduce(DataFrame.unionByName, [p.select(key) for p in parts]).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key).distinct().join(found, key, "left").filter(F.coalesce("n", F.lit(0)) != 1)


def uneven_parts(rows: DataFrame, part: str, totals: DataFrame, total: str) -> DataFrame:
    """Parts whose number of rows is not the one stated. totals: part, total."""
    return rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).join(totals.select(part, total), part, "full").filter(~F.col("_n").eqNullSafe(F.col(total)))


def not_applied(rows: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """Rows that still have a key which a decision has replaced."""
    return rows.join(gone.select(F.col(gone_key).alias(key)).distinct(), key, "left_semi")


def missing_files(spark, paths: list[str]) -> list[str]:
    """Of these paths the ones that are not there."""
    fs = spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if not fs(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(p))]


def verdict(errors: dict[str, DataFrame], warnings: dict[str, DataFrame]) -> DataFrame:
    """level (error or warning), rule, violations: one row for each check."""
    levels = [violations(checks).select(F.lit(level).alias("level"), "rule", "violations") for level, checks in (("error", errors), ("warning", warnings)) if checks]
    return reduce(DataFrame.unionByName, levels)


def exit_code(found: DataFrame) -> int:
    """1 if any error is violated, 0 if there are warnings at most."""
    return int(found.filter("level = 'error' AND violations > 0").limit(1).count())


def stamp(tables: dict[str, DataFrame], portable: dict[str, list[str]] | None = None) -> DataFrame:
    """name, n, hash: row count and an order-free hash of each table; of the columns named in ``portable``, one that any engine can
    compute: the sum of the first eight hexadecimal digits of the MD5 of the values joined by |."""

    def digest(name, d):
        if portable and name in portable:
            return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in portable[name]]).cast("binary")), 1, 8), 16, 10).cast("long")
        return F.xxhash64(*d.columns)

    rows = [d.select(digest(name, d).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash")).select(F.lit(name).alias("name"), "n", "hash") for name, d in tables.items()]
    return reduce(DataFrame.unionByName, rows)

"""Running totals and numbers along an order, by ranges of it: no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with a running total, the row itself included, of each of the sums along the order (which should tell all rows apart).

    Ranges of the order are summed apart; what lies before a range is added from one row for each range."""
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ranged.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = whole.select("_part", *[(F.sum(n).over(upto(Window.orderBy("_part"))) - F.col(n)).alias(f"_{n}_before") for n in sums])  # a row for each range
    here = ranged.select("*", *[F.sum(c).over(upto(Window.partitionBy("_part").orderBy(*order))).alias(n) for n, c in sums.items()])
    return here.join(F.broadcast(before), "_part").select(*rows.columns, *[(F.col(n) + F.col(f"_{n}_before")).alias(n) for n in sums])


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows numbered from 0 by an ascending key."""
    return running(rows, [key], {name: F.lit(1)}).withColumn(name, F.col(name) - 1)

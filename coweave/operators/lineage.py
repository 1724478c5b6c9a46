"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A local session without one takes a temporary folder; a cluster without one is an error, as its
    machines share no other."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_coweave_folder", None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = sc._coweave_folder = tempfile.mkdtemp(prefix="coweave-")
    return at


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back. ``spent``: earlier tables of this kind that nothing else is made from
    any more; they are deleted."""
    spark = df.sparkSession
    at = f"{folder(spark)}/coweave-cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(StructType(df.schema.fields)).parquet(at)
    out._coweave_cut = at
    drop(*spent)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t._coweave_cut)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

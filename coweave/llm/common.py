"""What the operators of this folder share: tables, the shared scratch folder and Arrow plumbing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship
from .vectext import give_back_memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Where that is unset a temporary one serves a local
    session, as in tests; a cluster has no other folder that all can see, so it is an error there."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_coweave_scratch", None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = sc._coweave_scratch = tempfile.mkdtemp(prefix="coweave-scratch-")
    return at


def _tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that ``materialize`` has written in this session and that are still there."""
    sc = spark.sparkContext
    if not hasattr(sc, "_coweave_tables"):
        sc._coweave_tables = []
    return sc._coweave_tables


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """The table written to the shared folder and read back: its lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    ship(spark)
    at = f"{scratch_dir(spark)}/coweave-{name}-{uuid.uuid4().hex}"
    _tables(spark).append(at)
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(StructType(df.schema.fields)).parquet(at)
    out._coweave_table = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that was made from them is written itself."""
    for t in tables:
        drop_tables(t.sparkSession, [t._coweave_table])


@contextlib.contextmanager
def only_the_last_stays(spark: SparkSession) -> Iterator[None]:
    """Of the tables that ``materialize`` writes inside, all but the last are deleted at the end."""
    tables = _tables(spark)
    before = len(tables)
    yield
    drop_tables(spark, tables[before:-1])


def last_table(spark: SparkSession) -> str:
    """Path of the table that ``materialize`` wrote last."""
    return _tables(spark)[-1]


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _tables(spark).remove(path)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only these two columns, under fixed names, so that no other column's name can clash."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod5():
    """crc32 of the id as text, modulo 5: the fold of a document."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def whole_runs(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.Table]:
    """From sorted batches, tables that hold every run of equal ``group`` columns whole; only the last run is held back."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        last = np.ones(len(b), bool)
        for c in group:
            x = b.column(c).to_numpy()
            last &= x == x[-1]
        cut = 0 if last.all() else len(b) - int(np.argmin(last[::-1]))
        if held and (cut or any(held[-1].column(c)[-1].as_py() != b.column(c)[0].as_py() for c in group)):
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held.clear()
    give_back_memory()

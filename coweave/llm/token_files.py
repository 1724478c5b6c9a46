"""Token ids in files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

A document's ids end with an end id; documents follow each other in ascending id order. Each row of the files is a segment of
some documents with its ids cut into blocks of BLOCK, which the segment's head records. A block starts from an empty model, so
any of them can be read alone. ``TokenCoder.java`` has the model and the format: order-0 to order-2 predictions of an id, turn by
turn down a tree of the block's ids, mixed into one probability that drives a binary range coder. Any 32-bit id can be coded.

Python encodes the texts; packing and unpacking are functions of columns in the JVM.

Defined cases: a null text is empty and has the end id only; a very long text is one segment; rows with equal ids are ordered by
a hash of their text; null ids come first; an empty table gives no files' rows; other columns are ignored. A block that fails its
checksum raises an error.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding
from . import vectext as V
from .common import id_and_text, scratch_dir, ship, shuffle_partitions
from .jvm_coder import pack, unpack

BLOCK, SEGMENT_BYTES = 1 << 17, 4 << 20
SEGMENT = "shard int, first long, doc_ids array<long>, counts array<long>, data binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_bytes: int = SEGMENT_BYTES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text with the library, append end_id to each, and write the segments to ``path``, documents ascending.

    Shards are ranges of ids; ``first`` counts the ids of the shard before the segment."""

    def run(batches):
        shard, first = TaskContext.get().partitionId(), 0
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for b in V.slices_by_bytes(batches, "text", segment_bytes):
            ids, counts = encoding.encode_texts(*V.text_buffer(b.column("text")), tokenizer)
            ids = np.insert(ids.astype("<u4"), np.cumsum(counts), end_id)
            counts = counts + 1
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([first], pa.int64()), one(b.column("doc_id")), one(pa.array(counts)), pa.array([ids.tobytes()], pa.binary())], ["shard", "first", "doc_ids", "counts", "data"])
            first += len(ids)

    spark, tie = docs.sparkSession, F.xxhash64("text")
    order = (F.col("doc_id").asc_nulls_first(), tie)
    ranged = id_and_text(docs, id_col, text_col).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    coded = ranged.mapInArrow(run, SEGMENT).withColumn("data", pack(spark, F.col("data"), block))
    coded.write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids of each document in the files at ``path``."""
    return _read(spark, path, "ids array<int>", lambda ids, ends: [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of each document."""

    def digest(ids, ends):
        raw = memoryview(ids.tobytes())
        return [pa.array(np.diff(ends)), pa.array([zlib.crc32(raw[4 * p : 4 * q]) for p, q in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())]

    return _read(spark, path, "n_tokens long, ids_crc32 long", digest)


def read_block(spark: SparkSession, path: str, shard: int, first: int, block: int) -> np.ndarray:
    """The ids of one block of the segment of a shard that begins after ``first`` ids; no other block is decoded."""
    rows = spark.read.schema(SEGMENT).parquet(path).filter((F.col("shard") == shard) & (F.col("first") == first))
    got = rows.select(unpack(spark, F.col("data"), block).alias("ids")).first()
    if got is None:
        raise ValueError(f"shard {shard} has no segment at {first}")
    return np.frombuffer(got["ids"], "<u4")


def _read(spark: SparkSession, path: str, schema: str, make) -> DataFrame:
    ship(spark)
    segments = spark.read.schema(SEGMENT).parquet(path)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for r in range(len(b)):
                docs, counts = b.column("doc_ids")[r].values, b.column("counts")[r].values.to_numpy()
                ends = np.concatenate([[0], np.cumsum(counts)])
                at = pa.array(b.column("first")[r].as_py() + ends[:-1])
                shard = pa.array(np.full(len(counts), b.column("shard")[r].as_py(), np.int32))
                ids = np.frombuffer(b.column("ids")[r].as_buffer(), "<u4")
                yield pa.RecordBatch.from_arrays([docs, shard, at, *make(ids, ends)], ["doc_id", "shard", "at", *names])

    decoded = segments.select("shard", "first", "doc_ids", "counts", unpack(spark, F.col("data")).alias("ids"))
    found = decoded.mapInArrow(run, f"doc_id long, shard int, at long, {schema}")
    total = segments.groupBy("shard").agg(F.max(F.col("first") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()  # one row for each shard
    base, seen = [], 0
    for shard, n in sorted((r["shard"], r["n"]) for r in total):
        base.append((shard, seen))
        seen += n
    bases = spark.createDataFrame(base, "shard int, base long")
    return found.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), *names)


def scratch_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/coweave-tokens-{uuid.uuid4().hex}"

"""Fill-in-middle: documents cut at seeded places between words, from an index of distinct texts with their boundary lists.

A text falls into units, each a word with the white space before it; white space at the end is a unit of its own. Equal texts share
one row of the index, which holds the ends of all units, counted in characters, as an Elias-Fano list: the k-th end is read without
the others. A task brings each different text, compared byte by byte, and its list into the index once; rows of many tasks are
merged where digest, text and list agree, so that a clash of digests can never merge two texts. Documents join the index by the
digest of their text and every one selects its own two cuts.

A text with more than one row in HOT is joined by salted keys: no more than HOT texts can be so frequent, whatever the input.

Defined cases: a null text is empty, has no units and stays plain, as do empty texts and those that hold one of the marks; a null
id has the seed's digest with nothing behind the colon; repeated rows each give a row; an empty table gives no rows; a text of any
length is one value; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import id_and_text, materialize, shuffle_partitions
from .packed import binary_column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of so many rows one may be a text's before its documents are dealt out by salted keys.
HOT = 1024

_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


# -- Elias-Fano lists ----------------------------------------------------------------------------------------------------------


def elias_fano(values: np.ndarray, sizes: np.ndarray, universe: np.ndarray) -> pa.Array:
    """A binary row for each list: list i has the next sizes[i] of the rising values, none above universe[i]. Its first byte is the
    number of low bits of a value, which stand there as they are; the rest of a value is unary, a one bit behind as many zeros as
    the rest has grown."""
    sizes, universe = sizes.astype(np.int64), universe.astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spread = universe // np.maximum(sizes, 1)
    low = np.where(spread > 1, np.floor(np.log2(np.maximum(spread, 1))).astype(np.int64), 0)
    low_bytes = (sizes * low + 7) // 8
    size = 1 + low_bytes + (sizes + (universe >> low) + 8) // 8
    ends = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(8 * int(ends[-1]), np.uint8)
    first = 8 * ends[:-1]
    for j in range(8):
        bits[first + j] = (low >> j) & 1
    at = first[owner] + 8 + rank * low[owner]
    for j in range(int(low.max(initial=0))):
        has = low[owner] > j
        bits[at[has] + j] = (values[has] >> j) & 1
    bits[first[owner] + 8 + 8 * low_bytes[owner] + (values >> low[owner]) + rank] = 1
    return binary_column(np.packbits(bits, bitorder="little"), ends)


def select(packed: bytes, size: int, k: int) -> int:
    """The k-th value (from 0) of a list of ``size`` values."""
    low = packed[0]
    low_bytes = (size * low + 7) // 8
    high = np.frombuffer(packed, np.uint8, offset=1 + low_bytes)
    upto = np.cumsum(_ONES[high])
    byte = int(np.searchsorted(upto, k + 1))
    left = k - int(upto[byte - 1]) if byte else k
    bit = int(np.flatnonzero(np.unpackbits(high[byte : byte + 1], bitorder="little"))[left])
    place = k * low
    word = int.from_bytes(packed[1 + place // 8 : 1 + (place + low + 7) // 8], "little")
    return (8 * byte + bit - k) << low | (word >> place % 8) & ((1 << low) - 1)


# -- the index -----------------------------------------------------------------------------------------------------------------


def unit_ends(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the units of all texts in characters of their text, the number of units and of characters of each text."""
    n = int(offs[-1])
    chars = np.concatenate([[0], np.cumsum((buf[:n] & 0xC0) != 0x80)])
    start, length, _ = V.words(buf, offs)
    filled = offs[1:] > offs[:-1]
    tail = offs[1:][filled][V._SPACE[buf[offs[1:][filled] - 1]]]
    ends = np.sort(np.concatenate([start + length, tail]))
    doc = np.searchsorted(offs[1:], ends)  # the first text that ends there or later
    return chars[ends] - chars[offs[doc]], np.bincount(doc, minlength=len(offs) - 1), chars[offs[1:]] - chars[offs[:-1]]


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def text_index(texts: DataFrame) -> DataFrame:
    """key, text, n, boundaries of each different text of the column ``text``, dealt out by key."""

    def run(batches):
        for b in V.slices_by_bytes(batches, "text"):
            buf, offs = V.text_buffer(b.column("text"))
            _, first = V.factorize_spans(buf, offs[:-1], np.diff(offs))
            b = b.take(pa.array(first))
            buf, offs = V.text_buffer(b.column("text"))
            ends, n, chars = unit_ends(buf, offs)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text"), pa.array(n.astype(np.int64)), elias_fano(ends, n, chars)], ["key", "text", "n", "boundaries"])

    keyed = texts.select(text_key(F.col("text")).alias("key"), "text")
    return keyed.mapInArrow(run, "key binary, text string, n long, boundaries binary").repartition(shuffle_partitions(texts.sparkSession), "key").distinct()


# -- cuts ----------------------------------------------------------------------------------------------------------------------


def _ends_at(boundaries: pa.Array, n: pa.Array, i: pa.Array, j: pa.Array) -> pa.Array:
    out = np.zeros((2, len(n)), np.int64)
    for r, (packed, size, *at) in enumerate(zip(boundaries.to_pylist(), n.to_pylist(), i.to_pylist(), j.to_pylist(), strict=True)):
        for side, k in enumerate(at):
            out[side, r] = select(packed, size, k - 1) if k else 0
    return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], ["a", "b"])


def with_text(rows: DataFrame, index: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows (doc_id, key) with text, n and boundaries from the index; keys of ``hot`` (key, salts) by salted joins."""
    hot = F.broadcast(hot)  # at most HOT rows
    plain = rows.join(hot.select("key"), "key", "left_anti").join(index.hint("merge"), "key")
    salted = rows.join(hot, "key").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts")))
    spread = index.join(hot, "key").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    salted = salted.drop("salts").join(spread.drop("salts").hint("merge"), ["key", "salt"])
    return plain.select("doc_id", "text", "n", "boundaries").union(salted.select("doc_id", "text", "n", "boundaries"))


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of each row.

    The first four groups of eight hexadecimal digits of the SHA-256 of "seed:id" decide: both cuts (modulo n + 1, in units), whether
    the document is rearranged (modulo 100 under fim_percent) and whether its suffix comes first (under spm_percent)."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).fillna("", "text")
    names = materialize(rows.select("doc_id", text_key(F.col("text")).alias("key")), "names")
    total = names.count()
    counts = names.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") * HOT > total)
    hot = [(bytes(r["key"]), -(-r["rows"] * HOT // total)) for r in counts.collect()]  # under HOT rows
    joined = with_text(names, text_index(rows.select("text")), spark.createDataFrame(hot, "key binary, salts long"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(F.col("digest"), 8 * g + 1, 8), 16, 10).cast("long") for g in range(4)]
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (h[2] % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    one, two = (x % (F.col("n") + 1) for x in h[:2])
    d = joined.withColumn("digest", digest).withColumns({"form": form, "i": F.least(one, two), "j": F.greatest(one, two)})
    d = d.withColumn("cut", F.arrow_udf(_ends_at, "struct<a: long, b: long>")("boundaries", "n", "i", "j"))
    text, a, b = F.col("text"), F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    before, middle, after = text.substr(F.lit(1), a), text.substr(a + 1, b - a), text.substr(b + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), after, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), after, F.lit(PREFIX), before, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)
    cut = lambda x: F.when(F.col("form") != "plain", x)
    return d.select("doc_id", "n", "form", cut(F.col("cut.a")).alias("prefix_chars"), cut(F.col("cut.b") - F.col("cut.a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from: it holds each mark once, as texts that hold one stay plain."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)

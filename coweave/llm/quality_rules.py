"""Quality rules with adaptive thresholds: per language and source, from mergeable quantile sketches.

Each document gets integer counts and from them a few ratios. The sketch of a ratio is a histogram over geometric buckets of
relative width ``GAMMA``: adding the counts of two sketches gives the sketch of both inputs, exactly and in any order, so a
source of any size is summed before it is shuffled. From a group's sketch come the tenth, fiftieth and ninetieth percentile,
each within one bucket. The spread above is the larger of the distances between neighbours of these, and a ratio fails if it lies
above the ninetieth percentile by more than SPREADS such spreads; where too low is bad as well, it also fails if it lies below the
tenth by more than SPREADS times its distance from the median. A least spread keeps one odd word or line of a short document from
deciding where a group has hardly any spread. Where under a tenth of a group's documents have any of what a rule counts, the three
percentiles are 0 and say nothing; the sketch then speaks through the documents that have some: the limit lies halfway, on a
logarithmic scale, between the least spread and the ninetieth percentile of these. Groups of under ``least_docs`` documents take the thresholds of their language, then
of all documents, as their percentiles say little; the column ``level`` says which were used. Documents join the thresholds of
their group, salted so that a source with a third of all rows is split.

Defined cases: a null text has no words and fails the base rule; null languages and sources are groups of their own; ratios
over nothing are 0; whole texts are counted, however long; repeated rows each count and each give a row; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectext as V
from .common import materialize, ship

GAMMA = 1.02
SPREADS = 3.0
#: So many documents with some of a rare thing give a percentile of their own.
LEAST_SOME = 10
#: Ratio, least spread, and whether too low is bad as well.
RULES = (
    ("symbols_per_word", 0.02, False),
    ("chars_per_word", 0.1, True),
    ("dup_line_share", 0.1, False),
    ("repeat_share", 0.03, False),
    ("upper_share", 0.01, False),
    ("top_word_share", 0.02, False),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_top_word")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags[: int(offs[-1])], dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def counts_of(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text of a batch."""
    docs, n = len(offs) - 1, int(offs[-1])
    start, length, doc = V.words(buf, offs)
    out = {"n_words": np.bincount(doc, minlength=docs)}
    solid = ~V._SPACE[buf[:n]]
    out["word_chars"] = _per_doc(solid & ((buf[:n] & 0xC0) != 0x80), offs)
    out["n_symbols"] = _per_doc(_SYMBOL[buf[:n]], offs)
    out["n_upper"] = _per_doc((buf[:n] >= 65) & (buf[:n] <= 90), offs)
    # lines with a word
    line_start, line_size, line_doc = V.member_spans(buf[:n] != 10, offs)
    filled = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    has = filled[line_start + line_size] > filled[line_start]
    line_start, line_size, line_doc = line_start[has], line_size[has], line_doc[has]
    codes, _ = V.factorize_spans(buf, line_start, line_size)
    _, _, first = V.factorize(codes * docs + line_doc)
    out["n_lines"] = np.bincount(line_doc, minlength=docs)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[first], minlength=docs)
    # words in windows of three that occur again in the text
    codes, first = V.factorize_spans(buf, start, length)
    kinds = max(len(first), 1)
    i = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    two, _, _ = V.factorize(codes[i] * kinds + codes[i + 1])
    three, _, _ = V.factorize(two * kinds + codes[i + 2])
    own, distinct, _ = V.factorize(three * max(docs, 1) + doc[i])
    again = np.bincount(own, minlength=len(distinct))[own] > 1
    inside = np.zeros(len(doc), bool)
    for k in range(3):
        inside[i[again] + k] = True
    out["n_repeat_words"] = np.bincount(doc[inside], minlength=docs)
    own, distinct, first = V.factorize(codes * max(docs, 1) + doc)
    out["n_top_word"] = np.zeros(docs, np.int64)
    np.maximum.at(out["n_top_word"], doc[first], np.bincount(own, minlength=len(distinct)))
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of each row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in V.slices_by_bytes(batches, "text"):
            c = counts_of(*V.text_buffer(b.column("text")))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "lang", "source")), *(pa.array(c[x].astype(np.int64)) for x in COUNTS)], ["doc_id", "lang", "source", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def with_ratios(counts: DataFrame) -> DataFrame:
    def over(a: str, b: str):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    pairs = {"symbols_per_word": ("n_symbols", "n_words"), "chars_per_word": ("word_chars", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"), "top_word_share": ("n_top_word", "n_words")}
    return counts.withColumns({k: over(*v) for k, v in pairs.items()})


def sketches(ratios: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: the sketch of each group. Bucket k holds (GAMMA^(k-1), GAMMA^k]; null bucket: 0."""
    values = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("ratio"), F.col(r[0]).alias("v")) for r in RULES]))
    bucket = F.when(F.col("e.v") > 0, F.ceil(F.log(F.col("e.v")) / math.log(GAMMA)).cast("int")).otherwise(F.lit(-100_000))
    return ratios.select("lang", "source", values.alias("e")).groupBy("lang", "source", F.col("e.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame, least_docs: int = 100) -> DataFrame:
    """level (0: language and source, 1: language, 2: all), lang, source, and low_ and high_ of each ratio."""
    levels = [sketch.select(F.lit(0).alias("level"), "lang", "source", "ratio", "bucket", "n")]
    for level, lang in ((1, F.col("lang")), (2, F.lit(None).cast("string"))):
        levels.append(sketch.groupBy(lang.alias("lang"), "ratio", "bucket").agg(F.sum("n").alias("n")).select(F.lit(level).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "ratio", "bucket", "n"))
    group = ["level", "lang", "source", "ratio"]
    run = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = levels[0].unionByName(levels[1]).unionByName(levels[2])
    s = s.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    value = F.when(F.col("bucket") > -100_000, F.pow(F.lit(GAMMA), F.col("bucket") - 0.5)).otherwise(0.0)
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, value)).alias(f"q{int(q * 100)}")
    some, without = F.col("bucket") > -100_000, F.sum(F.when(F.col("bucket") == -100_000, F.col("n")).otherwise(0)).over(Window.partitionBy(*group))
    s = s.withColumn("without", without)
    of_some = F.min(F.when(some & (F.col("upto") - F.col("without") >= (F.col("all") - F.col("without")) * 0.9), value)).alias("some90")
    q = s.groupBy(*group).agg(F.max("all").alias("docs"), F.max(F.col("all") - F.col("without")).alias("some"), of_some, at(0.1), at(0.5), at(0.9))
    q = q.filter((F.col("level") == 2) | (F.col("docs") >= least_docs))
    out = []
    for name, floor, two_sided in RULES:
        below, above, this = F.col("q50") - F.col("q10"), F.col("q90") - F.col("q50"), F.col("ratio") == name
        rare = (F.col("q90") == 0) & (F.col("some") >= LEAST_SOME)
        high = F.when(rare, F.sqrt(F.col("some90") * floor)).otherwise(F.col("q90") + SPREADS * F.greatest(above, below, F.lit(floor)))
        out.append(F.max(F.when(this, high)).alias(f"high_{name}"))
        if two_sided:
            out.append(F.max(F.when(this, F.col("q10") - SPREADS * F.greatest(below, F.lit(floor)))).alias(f"low_{name}"))
    return q.groupBy("level", "lang", "source").agg(*out)


def judge(docs: DataFrame, least_docs: int = 100, salts: int = 32, **columns) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the names of the ratios that failed, and the level of the thresholds, of each row."""
    ratios = with_ratios(materialize(measure(docs, **columns), "quality"))
    limits = materialize(thresholds(sketches(ratios), least_docs), "limits")
    names = [c for c in limits.columns if c.startswith(("high_", "low_"))]
    packed = F.struct(*names).alias("own")
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    by_source = limits.filter("level = 0").select(F.col("lang").alias("l0"), F.col("source").alias("s0"), packed, salt)
    by_lang = limits.filter("level = 1").select(F.col("lang").alias("l1"), packed.alias("of_lang"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt1"))
    overall = limits.filter("level = 2").select(packed.alias("of_all"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt2"))
    d = ratios.withColumn("salt0", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int"))
    d = d.join(by_source, F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")) & (F.col("salt0") == F.col("salt")), "left")
    d = d.join(by_lang, F.col("lang").eqNullSafe(F.col("l1")) & (F.col("salt0") == F.col("salt1")), "left")
    d = d.join(overall, F.col("salt0") == F.col("salt2"), "left")
    level = F.when(F.col("own").isNotNull(), "source").when(F.col("of_lang").isNotNull(), "language").otherwise("all")
    d = d.withColumn("limit", F.coalesce("own", "of_lang", "of_all")).withColumn("level", level)
    failed = []
    for name, _, two_sided in RULES:
        bad = F.col(name) > F.col(f"limit.high_{name}")
        if two_sided:
            bad = bad | (F.col(name) < F.col(f"limit.low_{name}"))
        failed.append(F.when(bad, F.lit(name)))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = d.withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*failed)))
    return d.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed", "level")

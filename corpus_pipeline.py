"""A training corpus from raw documents in five stages; each takes (spark, docs, sf_dir) and works on all rows it is given.

The stages before the last keep the columns of ``documents``, and more columns if there are, whatever their names; the last returns
doc_id, n_tokens, ids_sha256, decoded_sha256 and ids. Each stage's result is written to the shared folder and read back as the next
one's input; what a stage wrote for itself, and its input once it is used, are deleted.

Every stage takes null texts, empty and very long ones, null ids, rows that repeat others and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coweave.llm import bpe_codec, decontaminate, jaccard_join, language_id, line_dedup
from coweave.llm.common import crc_mod5, drop_tables, last_table, materialize, only_the_last_stays, table

#: Documents whose nearest profile is this far off (of 1: the same ranking) are in no known language.
LEAST_LANGUAGE_SCORE = 0.2


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles come from the labelled rows of the learning folds. Documents without a language go: null and empty texts, texts
    without a letter, and texts unlike all profiles. Repeated rows and rows with null ids are judged like others; where no row
    has a language, nothing can be known and all rows go."""
    return language_id.keep_identified(docs, language_id.learn_profiles(docs.filter(crc_mod5() != 0)), LEAST_LANGUAGE_SCORE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines of any length the first stays; documents of which no word is left go, null and empty ones stay. Lines are
    ordered by id and place, a null id first; rows that repeat id and text lose the same lines."""
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles the one with the least id stays (a null id is the greatest), and of rows that
    repeat id and text one; texts without a word have no copies and stay."""
    return jaccard_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go; null and empty texts have none, and an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each given; a null text is empty and has no ids."""
    import public_tokenizers

    return bpe_codec.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("bpe_codec", encode),
]

#: Rank-order profiles, alignments and token merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with only_the_last_stays(spark):
            done = materialize(stage(spark, docs, sf_dir), name)
        if before:
            drop_tables(spark, [before])
        docs, before = done, last_table(spark)
    return docs

"""Registered queries of this folder; each applies its operator to a whole table."""

from __future__ import annotations

from .common import crc_mod5, table


def _bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: host, path, verdict
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op1_quality_rules(spark, sf_dir):
    from .quality_rules import judge

    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level")


def op2_url_filter(spark, sf_dir):
    from .url_filter import filter_urls

    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_token_files(spark, sf_dir):
    from .token_files import read_digests, scratch_path, write_tokens

    path = scratch_path(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, _bpe(), end_id=2)
    return read_digests(spark, path)


def op4_decontaminate(spark, sf_dir):
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark, sf_dir):
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op6_class_lm(spark, sf_dir):
    from .class_lm import score, train

    docs = table(spark, sf_dir, "documents")
    model, rest = train(docs.filter(crc_mod5() != 1))
    return score(docs, model, rest, crc_mod5() == 1)


def op7_token_counts(spark, sf_dir):
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _bpe(), limit=1024)


def op8_language_id(spark, sf_dir):
    from pyspark.sql import functions as F

    from .language_id import identify, learn_profiles

    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(crc_mod5() != 0))
    held_out = F.coalesce(crc_mod5() == 0, F.lit(False))  # a null id has no fold
    return identify(docs, profiles).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op9_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark, sf_dir):
    from .bpe_codec import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), _bpe())


def op11_fill_in_middle(spark, sf_dir):
    from pyspark.sql import functions as F

    from .fill_in_middle import fill_in_middle, restored

    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2(c.cast("binary"), 256).alias(f"{name}_sha256") for name, c in (("output", F.col("output")), ("restored", restored(F.col("output"), F.col("form"))))]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_hard_negatives(spark, sf_dir):
    from pyspark.sql import functions as F

    from .hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_warc_packages(spark, sf_dir):
    from .warc_zip import round_trip, scratch_path

    records = round_trip(table(spark, sf_dir, "pages"), scratch_path(spark))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_url_filter, op3_token_files, op4_decontaminate, op5_line_dedup, op6_class_lm, op7_token_counts, op8_language_id, op9_jaccard_join, op10_bpe_codec, op11_fill_in_middle, op12_hard_negatives, op13_warc_packages)}

_HOST = "regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*')"

ORACLES: dict[str, str] = {
    "op2_url_filter": f"""
        WITH p AS (
            SELECT page_id, coalesce(url, '') AS url,
                   CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN {_HOST} ELSE '' END AS raw_host
            FROM pages),
        h AS (
            SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   CASE WHEN instr(url, '://') > 0
                        THEN regexp_extract(substr(url, instr(url, '://') + 3 + length(raw_host)), '^[^?#]*') ELSE '' END AS path
            FROM p),
        r(rule_host, rule_path, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        m AS (
            SELECT h.page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   max_by(v, length(rule_host || rule_path)) AS v
            FROM h, r
            WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY h.page_id)
        SELECT h.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id""",
}

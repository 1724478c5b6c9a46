"""The pipeline: each stage against brute force on what it is given, on awkward rows, and as a whole."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from coweave.llm import decontaminate, encoding

from .test_operators import BPE, aligned, lower, removed_lines, shingles, words_of

VOC = {"en": [a + b for a in ("th", "wa", "lo", "ne", "ri") for b in ("ing", "er", "ock", "ade", "est")], "de": [a + b for a in ("sch", "wü", "zei", "pfo", "ge") for b in ("ung", "keit", "los", "ner", "mal")]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, text_hash int, number int, node string"


def make(rows):
    return [(i, t, lang, "s", len(t or ""), "k", 1, 2, "n") for i, t, lang in rows]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    prose = lambda k, n: " ".join(rng.choice(VOC[k]) + rng.choice(("", "", "", ".\n")) for _ in range(n)).strip()
    out = [(i, prose(k, rng.randint(20, 90)), k if rng.random() < 0.9 else None) for i in range(60) for k in [rng.choice(("en", "de"))]]
    out += [(100 + i, out[i][1], "en") for i in range(5)]  # copies
    near = out[7][1].split(" ")
    near[3] = "changed"
    out += [(110, " ".join(near), "en"), (111, None, "en"), (112, "", None), (113, "12 345 !!", "en"), (114, prose("de", 6000), "de"), (None, prose("en", 40), "en"), (None, prose("en", 40), None), (20, prose("en", 30), "en"), (21, out[21][1], out[21][2])]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(make(rows), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    items = [(1, " ".join(rows[9][1].split()[2:30])), (2, "of no document at all it is"), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "bpe_codec"]
    assert all(f.__doc__ for _, f in corpus_pipeline.STAGES)


def plain(df):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in df.collect()))


def test_each_stage_by_hand(spark, rows, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(make(rows), SCHEMA).repartition(4)
    key = lambda i, t: (i is not None, i or 0, t is not None, t or "")
    known = stages["language_id"](spark, docs, folder)
    assert known.columns == docs.columns
    assert plain(known) == sorted(key(i, t) for i, t, _ in rows if i not in (111, 112, 113))

    lines = stages["line_dedup"](spark, docs, folder)
    assert lines.columns == docs.columns
    gone = removed_lines(rows)
    want = []
    for i, t, _ in rows:
        left = [x for n, x in enumerate((t or "").split("\n")) if ((i is not None, i or 0), n, t) not in gone]
        if left == (t or "").split("\n"):
            want.append(key(i, t))
        elif words_of("\n".join(left)):
            want.append(key(i, "\n".join(left)))
    assert plain(lines) == sorted(want)

    once = stages["jaccard_join"](spark, docs, folder)
    assert once.columns == docs.columns
    sets = {s for _, t, _ in rows if (s := shingles(t))}
    kept, todo = [], set(sets)
    while todo:
        group, more = set(), {todo.pop()}
        while more:
            s = more.pop()
            group.add(s)
            near = {o for o in todo if len(s & o) >= 0.8 * len(s | o) - 1e-9}
            more |= near
            todo -= near
        kept.append(min((i is None, i or 0) for i, t, _ in rows if shingles(t) in group))
    got = [(r["doc_id"] is None, r["doc_id"] or 0) for r in once.collect() if shingles(r["text"])]
    assert sorted(got) == sorted(kept)
    assert once.filter("text IS NULL OR text = ''").count() == 2

    clean = stages["decontaminate"](spark, docs, folder)
    assert clean.columns == docs.columns
    item = decontaminate_words(" ".join(rows[9][1].split()[2:30]))
    assert plain(clean) == sorted(key(i, t) for i, t, _ in rows if len(t or "") > 9000 or aligned(item, decontaminate_words(t or "")) < 0.5 * 2 * len(item))

    coded = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in stages["bpe_codec"](spark, docs, folder).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = [e.ids for e in encoding.library(BPE).encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False)]
    assert coded == {(i, sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for (i, t, _), x in zip(rows, ids, strict=True)}


def decontaminate_words(t):
    import pyarrow as pa

    return decontaminate.normal_words(pa.array([t]))[0].tolist()


def test_run_is_the_stages_one_after_another_and_repeats(spark, folder):
    import os

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    want = sorted(map(str, docs.collect()))
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    first = corpus_pipeline.run(spark, folder)
    left = set(os.listdir(shared)) - before
    assert [x for x in left if x.startswith("coweave-")] == [x for x in left if x.startswith("coweave-bpe_codec")]
    assert sorted(map(str, first.collect())) == want == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert 20 < len(want) < 70
    assert first.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_run_over_empty_tables(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lower_is_ascii_only():
    assert lower("AÉ") == "aÉ"

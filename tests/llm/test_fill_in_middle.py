"""Fill-in-middle against cuts of the text by the pattern, and Elias-Fano lists against plain ones."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coweave.llm import fill_in_middle as M
from coweave.llm import queries
from coweave.llm import vectext as V

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, key string, n int, salt int, digest string"


def cut(doc_id, text, seed=42, fim=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * g : 8 * g + 8], 16) for g in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [None, "", " ", "\n\t x", "word", "a <P> b", "<S>", "<<M>", "P> <M", " two  words ", "中文 字é\x1c 字\x85 z", "x" * 5000, " ".join(["very"] * 20000) + "\n"]
    texts += ["".join(rng.choice(("a", "é", "字", " ", "\n", "𝄞", "<", "S", ">")) for _ in range(rng.randint(1, 300))) for _ in range(200)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(1000 + i, "one text of very many documents") for i in range(400)] + [out[3], out[20], (None, texts[30]), (None, None)]
    return [(*r, "k", 1, 2, "d") for r in out]


def test_fill_in_middle_equals_cuts_of_the_text(spark, rows):
    got = M.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert Counter(map(tuple, got.collect())) == Counter(cut(*r[:2]) for r in rows)
    back = got.select("doc_id", M.restored(F.col("output"), F.col("form")).alias("text"))
    assert Counter(map(tuple, back.collect())) == Counter((r[0], r[1] or "") for r in rows)


def test_fill_in_middle_without_frequent_texts(spark, rows, monkeypatch):
    """The same rows whether a text's documents are dealt out by salted keys or not."""
    monkeypatch.setattr(M, "HOT", 1)
    got = M.fill_in_middle(spark.createDataFrame(rows, SCHEMA), seed=7, fim_percent=90, spm_percent=30)
    assert Counter(map(tuple, got.collect())) == Counter(cut(*r[:2], 7, 90, 30) for r in rows)


def test_fill_in_middle_empty_table(spark):
    got = M.fill_in_middle(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and got.count() == 0


def test_index_has_each_text_once(spark, rows):
    index = M.text_index(spark.createDataFrame(rows, SCHEMA).repartition(5).fillna("", "text").select("text"))
    assert Counter(r["text"] for r in index.collect()) == Counter({r[1] or "" for r in rows})


def test_equal_digests_do_not_merge_texts(spark, rows, monkeypatch):
    monkeypatch.setattr(M, "text_key", lambda text: F.lit(b"clash"))
    index = M.text_index(spark.createDataFrame(rows, SCHEMA).fillna("", "text").select("text"))
    assert {r["text"] for r in index.collect()} == {r[1] or "" for r in rows}


def test_lists_give_every_end():
    rng = random.Random(1)
    lists = [sorted(rng.sample(range(u + 1), min(n, u + 1))) for u, n in [(0, 0), (0, 1), (7, 8), (9, 1), (100, 3), (5000, 5000), (1 << 30, 1000), (1 << 30, 1)] * 5]
    packed = M.elias_fano(np.array([v for x in lists for v in x], np.int64), np.array([len(x) for x in lists]), np.array([x[-1] if x else 0 for x in lists]))
    for x, p in zip(lists, packed.to_pylist(), strict=True):
        assert [M.select(p, len(x), k) for k in range(len(x))] == x
    assert len(packed[-2].as_py()) < 1000 * (2 + 21) / 8 + 16


def test_unit_ends():
    import pyarrow as pa

    texts = ["", "a b", " é \n", "  ", "字x 𝄞"]
    ends, n, chars = M.unit_ends(*V.text_buffer(pa.array(texts)))
    want = [np.cumsum([len(u) for u in UNIT.findall(t)]).tolist() for t in texts]
    assert n.tolist() == [len(w) for w in want] and chars.tolist() == [len(t) for t in texts]
    assert ends.tolist() == [e for w in want for e in w]


def test_query_digests(spark, sf):
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op11_fill_in_middle"](spark, sf).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {i: (*(c := cut(i, t))[:5], sha(c[5]), sha(t or "")) for i, t in docs}

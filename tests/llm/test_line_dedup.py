"""Array passes of the line deduplication against plain rules, and what its filters give to Python."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from coweave.llm import line_dedup as L
from coweave.llm import vectext as V
from coweave.llm.packed import pack_columns, unpack_columns


def test_only_keys_leave_the_jvm_to_be_filtered(spark):
    """Sets and signs of lines stay where they are while a bit set picks lines by key."""
    rows = spark.range(1000).select(F.col("id").alias("key"), F.col("id").cast("string").cast("binary").alias("set"))
    picked = L.with_keys(rows, spark.range(7, 500, 100).select(F.col("id").alias("k")), "k")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and re.search(r"ArrowEvalPython \[wants\(\w+#\d+L\)", plan), plan
    assert sorted((r["key"], bytes(r["set"])) for r in picked.collect()) == [(k, b"%d" % k) for k in (7, 107, 207, 307, 407)]


def test_lines_and_signs_by_hand():
    texts = ["b a b\n\n c \n", None, "", "\n", "x", "a b\nb a\na"]
    s = L.line_sets(pa.array(texts), 1)
    assert list(zip(s["doc"].tolist(), s["number"].tolist(), s["size"].tolist())) == [(0, 0, 2), (0, 2, 1), (4, 0, 1), (5, 0, 2), (5, 1, 2), (5, 2, 1)]
    assert s["key"][0] == s["key"][3] == s["key"][4] and len(set(s["key"].tolist())) == 4
    two = L.line_sets(pa.array(texts), 2)
    assert list(zip(two["doc"].tolist(), two["number"].tolist(), two["key"].tolist())) == [(d, n, s["key"][0]) for d, n in ((0, 0), (5, 0), (5, 1))]
    rng = np.random.default_rng(3)
    line = np.sort(rng.integers(0, 50, 700))
    tok = rng.integers(0, 1 << 63, 700).astype(np.uint64) * np.uint64(2)
    tok = tok[np.lexsort((tok, line))]
    want = np.zeros((51, 4), np.uint64)  # the last line has no token
    for i, t in zip(line.tolist(), tok.tolist(), strict=True):
        want[i, t >> 62] ^= np.uint64(1 << (t >> 42 & 63))
    assert (L.signs(tok, line, 51) == want).all() and L.signs(tok[:0], line[:0], 0).shape == (0, 4)


def test_words_end_at_six_blanks():
    raw = bytes(range(1, 128)).decode() + "é 字\x85\xa0x"
    buf, offs = V.text_buffer(pa.array([raw, " a", None, "b "]))
    start, length, doc = V.words(buf, offs)
    got = [(d, buf[a : a + n].tobytes().decode()) for a, n, d in zip(start.tolist(), length.tolist(), doc.tolist(), strict=True)]
    assert got == [(0, w) for w in re.findall(r"[^\x20\x09-\x0D]+", raw)] + [(1, "a"), (3, "b")]


def test_postings_travel_packed():
    r = {c: np.arange(9).astype(L._CARD[c]) for c in L._CARD.names}
    back = unpack_columns(pack_columns(r, 2, 7), L._CARD)
    assert all((back[c] == r[c][2:7]).all() and back[c].dtype == r[c].dtype for c in r)

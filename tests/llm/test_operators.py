"""Operators for training data against brute force, on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coweave.llm import bpe_codec, class_lm, decontaminate, encoding, jaccard_join, jvm_coder, language_id, line_dedup, quality_rules, queries, token_counts, token_files, url_filter
from coweave.llm import vectext as V
from coweave.llm.common import crc_mod5
from coweave.llm.components import components

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, key string, words int, _coweave_id int"
WORDS = [a + b for a in ("ba", "de", "fi", "go", "ku", "lé", "mö", "nu") for b in ("ra", "st", "ti", "vo", "x", "'s", "n", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "", ",", ".\n")) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(40)]
    texts = [None, "", " \n\t ", "word", "word", "!!! ??? 123", "x" * 5000, prose(rng, 8000), "a<|endoftext|>b <|endof", "中文 字 字　é\x1c\x85z", *base, base[0], base[0]]
    for b in base[1:12]:  # near copies
        w = b.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts.append(base[3] + "\n" + base[4].split("\n")[0] + "\n" + base[3])
    out = [(i, t, rng.choice(("en", "fr", None)), rng.choice(("s1", "s1", "s2", None)), "k", 1, 2) for i, t in enumerate(texts)]
    return [*out, out[12], (None, base[5], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def library_ids(texts):
    return [e.ids for e in encoding.library(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def sort_key(r):
    return tuple((x is not None, x) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=sort_key) == sorted(map(tuple, want), key=sort_key)


def test_pieces_are_the_librarys():
    rng = random.Random(1)
    parts = ["a", "b", "'s", "'", "ll", " ", "  ", "\n", " ", "　", "é", "中", "٣", "1", "!", "…", "😀", "\x85", "\x1c", "S", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    buf, offs = V.text_buffer(pa.array(texts))
    start = V.pretokens(buf, offs)
    end = np.append(start[1:], offs[-1])
    got = [buf[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    assert got == [t[a:b].encode() for t in texts if t for _, (a, b) in V._splitter().pre_tokenize_str(t)]


def test_quality_counts(docs, rows, empty):
    want = []
    for r in rows:
        w, t = words_of(r[1]), r[1] or ""
        lines = [x for x in t.split("\n") if words_of(x)]
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)))
    judged = quality_rules.judge(docs, least_docs=5)
    same(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), want)
    assert judged.filter("base_failed AND kept").count() == 0
    assert quality_rules.judge(empty).count() == 0


def test_quality_thresholds_adapt(spark):
    clean = [(i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(80)), "en", f"s{i % 2}") for i in range(300)]
    noisy = [(1000, " ".join(f"w{k * k % 89}### " for k in range(80)), "en", "s0")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(clean + noisy, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept.pop(1000)
    assert all(kept.values())


def test_quality_verdict_by_hand(spark):
    """The verdict from plain counts: percentiles from sorted buckets, by source, language or over all."""
    rng = random.Random(13)

    def text():
        w = [rng.choice(WORDS) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice((0, 0, 1, 4, 30))):
            w[rng.randrange(len(w))] = rng.choice(("XX YY", "same", "\nsame line\n", "verylongwordhereindeed"))
        if rng.random() < 0.08:
            w[0] = "a" + "#" * rng.choice((1, 2, 9, 40))
        return " ".join(w)

    rows = [(i, text(), rng.choice(("en",) * 8 + ("fr",) * 4 + ("it",)), rng.choice(("s1", "s1", "s1", "s2", f"s{i}", None))) for i in range(400)]
    judged = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), least_docs=60).collect()}
    over = {"symbols_per_word": ("n_symbols", "n_words"), "chars_per_word": ("word_chars", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"), "top_word_share": ("n_top_word", "n_words")}
    ratio = {i: {k: r[a] / r[b] if r[b] else 0.0 for k, (a, b) in over.items()} for i, r in judged.items()}
    levels, rare = Counter(), Counter()
    for i, _, lang, source in rows:
        for level, same_group in (("source", lambda r: r[2:] == (lang, source)), ("language", lambda r: r[2] == lang), ("all", lambda r: True)):  # noqa: B023
            group = [ratio[r[0]] for r in rows if same_group(r)]
            if len(group) >= 60 or level == "all":
                break
        failed = []
        for k, floor, two_sided in quality_rules.RULES:
            buckets = sorted(math.ceil(math.log(g[k]) / math.log(1.02)) if g[k] > 0 else -math.inf for g in group)
            q10, q50, q90 = (1.02 ** (b - 0.5) if b > -math.inf else 0.0 for b in (buckets[math.ceil(q * len(buckets) - 1e-9) - 1] for q in (0.1, 0.5, 0.9)))
            some = [1.02 ** (b - 0.5) for b in buckets if b > -math.inf]
            high = math.sqrt(floor * some[math.ceil(0.9 * len(some) - 1e-9) - 1]) if q90 == 0 and len(some) >= 10 else q90 + 3 * max(q90 - q50, q50 - q10, floor)
            rare[k] += q90 == 0 and len(some) >= 10
            if ratio[i][k] > high or two_sided and ratio[i][k] < q10 - 3 * max(q50 - q10, floor):
                failed.append(k)
        r = judged[i]
        levels[level] += 1
        assert (r["level"], r["failed"], r["kept"]) == (level, failed, not failed and not r["base_failed"])
    assert len(levels) == 3 and rare["symbols_per_word"] and 0 < sum(bool(r["failed"]) for r in judged.values()) < 200


def test_quality_limits_of_rare_things_differ_by_group(spark):
    """Symbols that few documents have: the limit comes from those that have some, in each source."""
    def text(i, marks):
        return " ".join([f"w{(i * 7 + k * k) % 97}" for k in range(80)] + ["#" * marks])

    rows = [(1000 * s + i, text(i, often if i < 20 else 0), "en", f"s{s}") for s, often in ((0, 80), (1, 20)) for i in range(300)]
    rows += [(5000, text(1, 9), "en", "s0"), (5001, text(1, 9), "en", "s1")]
    judged = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    failed = {r["doc_id"]: r["failed"] for r in judged.collect()}
    assert failed[5000] == [] and failed[5001] == ["symbols_per_word"]  # 9 / 81, where 0.14 and 0.07 are the limits
    assert sum("symbols_per_word" in f for f in failed.values()) == 41


def test_held_out_of_a_null_id(spark, tmp_path):
    text = "der die das und ist nicht ein eine zu mit " * 20
    spark.createDataFrame([(i, text, "de") for i in range(40)] + [(None, text, None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r["held_out"] for r in queries.QUERIES["op8_language_id"](spark, str(tmp_path)).collect()]
    assert len(got) == 41 and None not in got and sum(got) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(40))


def test_url_filter(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://example.com/en/1?x=/", "https://a.example.com/en/", "http://www.EXAMPLE.com/en/z#q", "http://badexample.com/en/", "http://x.net/es/a", "http://x.net/fr", "http://com", "ftp://com/", None, "", "no scheme", "http://", "http://x.net?/es/", "http://x.net/es/a"]
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame([(i, u, "h", 3) for i, u in enumerate(urls)], "page_id long, url string, key string, salt int"), rules, parts=3).collect()}
    assert got == {
        (0, "example.com", "/en/1", "example.com/en/", "block"), (1, "a.example.com", "/en/", "example.com/en/", "block"), (2, "www.example.com", "/en/z", "www.example.com/en/", "allow"),
        (3, "badexample.com", "/en/", "com/", "allow"), (4, "x.net", "/es/a", "net/es/", "block"), (5, "x.net", "/fr", None, "allow"), (6, "com", "", None, "allow"), (7, "com", "/", "com/", "allow"),
        (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "", "", None, "allow"), (11, "", "", None, "allow"), (12, "x.net", "", None, "allow"), (13, "x.net", "/es/a", "net/es/", "block"),
    }
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/" + "x" * 100_000), (None, "http://a.com/"), (None, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r["verdict"] for r in url_filter.filter_urls(pages, none).collect()] == ["allow"] * 3
    got = url_filter.filter_urls(pages, spark.createDataFrame([("com", "/x", "allow"), ("com", "/x", "block")], "host string, path string, verdict string"))
    same([(r["page_id"], r["rule"], r["verdict"]) for r in got.collect()], [(1, "com/x", "block"), (None, None, "allow"), (None, None, "allow")])


def test_url_filter_against_brute_force(spark):
    rng = random.Random(8)
    names = ["a", "b", "a.b", "b.a", "c.a.b", "b.b.a"]
    rules = {(rng.choice(names), rng.choice(("", "/", "/x", "/x/", "/x/y", "/z"))): rng.choice(("allow", "block")) for _ in range(18)}
    urls = [f"http://{rng.choice(names + ['d.a', 'ab'])}{rng.choice(('', '/', '/x', '/xy', '/x/y/z', '/zz', '/q'))}" for _ in range(300)]
    made = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")
    for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), made, default="none", parts=5).collect():
        fit = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert (r["rule"], r["verdict"]) == (max(fit)[2:] if fit else (None, "none"))


def packed(spark, ids, block):
    raw = spark.createDataFrame([(bytearray(np.asarray(ids).astype("<u4").tobytes()),)], "ids binary")
    return bytes(raw.select(jvm_coder.pack(spark, F.col("ids"), block)).first()[0])


def unpacked(spark, data, block=-1):
    got = spark.createDataFrame([(bytearray(data),)], "data binary").select(jvm_coder.unpack(spark, F.col("data"), block)).first()[0]
    return np.frombuffer(got, "<u4")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 300])
def test_coder(spark, n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), rng.integers(0, 9, n), rng.integers(0, 1 << 32, n), np.full(n, 7), np.minimum(rng.zipf(1.2, n), (1 << 31) - 1)):
        data = packed(spark, ids, 64)
        assert (unpacked(spark, data) == ids).all()
        for k in range(-(-n // 64)):
            assert (unpacked(spark, data, k) == ids[64 * k : 64 * k + 64]).all()
    if n:
        bad = bytearray(data)
        bad[-1] ^= 1
        with pytest.raises(Exception, match="fails its checksum"):
            unpacked(spark, bad)


def test_coder_beats_the_entropy_of_single_ids(spark):
    """Ids that depend on the last one: fewer bits than their own frequencies allow."""
    rng = np.random.default_rng(5)
    ids = [3]
    while len(ids) < 100_000:
        ids.append((ids[-1] * 17 + rng.integers(0, 4)) % 500)
    n = np.bincount(ids)
    n = n[n > 0] / len(ids)
    assert len(packed(spark, ids, 1 << 17)) * 8 / len(ids) < 0.5 * -(n * np.log2(n)).sum()


def test_token_files(spark, docs, rows, empty, tmp_path):
    token_files.write_tokens(docs, str(tmp_path / "t"), BPE, segment_bytes=20_000, block=256)
    tie = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    start, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0], tie[r[0], r[1]])):
        ids = [*library_ids([r[1]])[0], 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(token_files.read_digests(spark, str(tmp_path / "t")).select("doc_id", "start", "n_tokens", "ids_crc32").collect(), want)
    assert {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}[5] == [*library_ids([rows[5][1]])[0], 2]
    first = spark.read.parquet(str(tmp_path / "t")).filter("shard = 0").orderBy("first").first()
    assert (token_files.read_block(spark, str(tmp_path / "t"), 0, first["first"], 1) == unpacked(spark, first["data"])[256:512]).all()
    with pytest.raises(ValueError, match="no segment"):
        token_files.read_block(spark, str(tmp_path / "t"), 0, -5, 0)
    token_files.write_tokens(empty, str(tmp_path / "e"), BPE)
    assert token_files.read_digests(spark, str(tmp_path / "e")).count() == 0


def test_decontaminate(spark, empty):
    rng = random.Random(6)
    items = [(i, prose(rng, 30)) for i in range(6)] + [(6, "two words"), (7, None), (8, "")]
    items += [(9, items[3][1])]  # an equal text
    edited = items[2][1].split(" ")
    edited[3], edited[11] = "other", "words"
    del edited[20]
    rows = [(0, prose(rng, 50) + " " + items[0][1].upper() + " " + prose(rng, 50)), (1, items[1][1]), (2, prose(rng, 20) + " " + " ".join(edited)), (3, prose(rng, 200)), (4, None), (5, ""), (1, items[1][1]), (None, items[3][1]), (5000, prose(rng, 30_000) + items[4][1])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(d, bench)
    got = [(r["doc_id"], r["item_id"]) for r in found.collect()]
    same(got, [(0, 0), (1, 1), (1, 1), (2, 2), (None, 3), (None, 9), (5000, 4)])
    assert found.filter("doc_id = 1").first()["score"] == 1
    same([(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, bench, block_bytes=200).collect()], got)
    for block_bytes in (decontaminate.BLOCK_BYTES, 200):
        same([(r["doc_id"],) for r in decontaminate.drop_contaminated(d, bench, block_bytes=block_bytes).collect()], [(3,), (4,), (5,)])
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(d, bench.filter("item_id > 100")).count() == 0


def aligned(a, b):
    """Best local alignment by the plain table: match 2, mismatch and gap -1."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_decontaminate_finds_evenly_edited_copies(spark):
    """Every document against every item by the plain table; copies with a word changed, left out or put in every 3 to 10 words, beside a whole copy."""
    rng = random.Random(16)
    voc = [f"{a}{b}" for a in WORDS if "'" not in a for b in ("", "an", "or", "ik")]
    text = lambda n: [rng.choice(voc) for _ in range(n)]
    items = [text(n) for n in (60, 24, 60, 40, 18)]
    docs = [text(60) + items[0] + text(40), text(300), text(20)]
    for every in range(3, 11):
        for it in items:
            for edit in ("change", "drop", "add"):
                new = []
                for i, w in enumerate(it):
                    if i % every != every - 1 or edit == "add":
                        new.append(w)
                    if i % every == every - 1 and edit != "drop":
                        new.append(rng.choice(voc))
                docs.append(text(rng.randint(0, 60)) + new + text(rng.randint(0, 60)))
    want = {(d, i): aligned(it, doc) / (2 * len(it)) for d, doc in enumerate(docs) for i, it in enumerate(items)}
    want = {k: s for k, s in want.items() if s >= 0.5}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(d, bench).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.98 * len(want) and len(want) >= 110
    assert all(s >= want[k] - 0.1 for k, s in got.items())


def test_seeds_of_items(spark):
    items = decontaminate.Items([1, 2], ["a b c d e f g h", "x y z"])
    g, item, at = items.grams[0]
    count = np.array([5000, 9000, 0, 4000, 0, 0, 0])
    gram = np.concatenate([g[:6], g[6:7]])
    items.pick(gram[count > 0], count[count > 0])
    assert sorted(items.seed_at.tolist()) == [0, 3]  # 9000 is over twice the rarest of each four grams around it
    items = decontaminate.Items([1], ["a b c d e f g h"])
    items.pick(gram[:2], np.array([2, 900]))
    assert sorted(items.seed_at.tolist()) == [0, 1]


def test_alignment_by_plain_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 20)
        assert decontaminate.align(a, b)[0] == aligned(a, b)


def line_sets(rows):
    """Words of each line by its place: id, line number, text."""
    return {((r[0] is not None, r[0] or 0), i, r[1]): frozenset(words_of(line)) for r in rows for i, line in enumerate((r[1] or "").split("\n")) if words_of(line)}


def removed_lines(rows):
    sets = line_sets(rows)
    return {k for k, s in sets.items() if any(o < k and len(s & t) >= 0.8 * len(s | t) - 1e-9 for o, t in sets.items())}


def test_line_dedup(docs, rows, empty):
    gone = removed_lines(rows)
    for limit in (1024, 2):  # the second sends nearly all tokens through the joins for hot ones
        line_dedup.LIMIT, old = limit, line_dedup.LIMIT
        got = line_dedup.line_dedup(docs).collect()
        line_dedup.LIMIT = old
        same([(r["doc_id"], i) for r in got for i in r["removed"]], [(k[0][1] if k[0][0] else None, k[1]) for k in gone])
        assert all(r["n_removed"] == len(r["removed"]) <= r["n_lines"] for r in got)
        same([(r["doc_id"], r["n_lines"]) for r in got], {(r[0], r[1]): (r[0], sum(bool(words_of(x)) for x in (r[1] or "").split("\n"))) for r in rows}.values())
    assert len(gone) > 10
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.drop_lines(empty).count() == 0


def test_line_dedup_of_edited_lines(spark):
    """Lines that differ in some words only, and words from few to many lines, against all pairs."""
    rng = random.Random(14)
    lines = []
    for _ in range(60):
        w = [rng.choice(WORDS) for _ in range(rng.randint(4, 14))]
        for _ in range(rng.randint(1, 5)):
            v = w[:]
            if rng.random() < 0.7:
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                v.insert(0, rng.choice(WORDS))
            rng.shuffle(v)
            lines.append(" ".join(v))
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(len(lines) // 4)]
    gone = {(k[0][1], k[1]) for k in removed_lines(rows)}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for limit, group in ((1024, 400_000), (16, 40), (2, 400_000)):
        old = line_dedup.LIMIT, line_dedup.GROUP
        line_dedup.LIMIT, line_dedup.GROUP = limit, group
        got = line_dedup.line_dedup(d).collect()
        line_dedup.LIMIT, line_dedup.GROUP = old
        assert {(r["doc_id"], i) for r in got for i in r["removed"]} == gone
    assert 30 < len(gone) < len(lines) - 30


def test_bucket_counts_add_up(spark):
    d = spark.createDataFrame([(1, "a b\na"), (2, "a c"), (3, None)], "doc_id long, text string").repartition(3)
    n = line_dedup.bucket_counts(line_dedup.parsed(d, 1))
    assert sorted(n[n > 0].tolist()) == [1, 1, 3]
    x = line_dedup._scaled(np.array([0, 5, 32767, 32768, 65536, 1 << 40]))
    assert x[:4].tolist() == [0, 5, 32767, 32768] and x[4] == 32768 + 1024 and x[5] == 32768 + 1024 * 25


def test_drop_lines(spark):
    line = "one two three four five six"
    d = spark.createDataFrame([(1, f"{line}\nkeep\n{line}", 7), (2, line, 8), (3, None, 9), (4, "", 9), (5, "short line", 9), (6, "short line", 9)], "doc_id long, text string, number int")
    same(line_dedup.drop_lines(d).collect(), [(1, f"{line}\nkeep", 7), (3, None, 9), (4, "", 9), (5, "short line", 9)])
    same(line_dedup.drop_lines(d, least_words=3).collect(), [(1, f"{line}\nkeep", 7), (3, None, 9), (4, "", 9), (5, "short line", 9), (6, "short line", 9)])


def test_lines_are_dropped_by_row(spark):
    """Rows with one id or none and different texts lose their own lines only; columns with the names used inside stay."""
    line = "one two three four five six"
    rows = [(1, f"x y z\n{line}", 1), (7, f"first of seven\n{line}\nmore", 2), (7, "other of seven\nprecious line that is nowhere else at all", 3), (None, "null text a", 4), (None, f"null text b c d e\n{line}", 5), (7, f"first of seven\n{line}\nmore", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    got = {r["text_hash"]: r["text"] for r in line_dedup.drop_lines(d).collect()}
    assert got == {1: "x y z", 2: "first of seven\nmore", 3: rows[2][1], 4: "null text a", 5: rows[4][1], 6: "first of seven\nmore"}


def test_very_long_line(spark):
    words = [f"w{i}" for i in range(70_000)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(reversed(words[:69_000]))), (3, " ".join(words[:30_000]))], "doc_id long, text string")
    assert {r["doc_id"]: r["removed"] for r in line_dedup.line_dedup(d).collect()} == {1: [], 2: [0], 3: []}


def test_short_lines(spark, tmp_path):
    import corpus_pipeline
    from coweave.llm import queries

    texts = ["menu\none two three four", "Read more\nmenu\na b", "one two three four five\nread more\n\nRead more\nb a c", "b a"]
    d = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_line_dedup(spark, str(tmp_path)).collect()
    same([(r["doc_id"], r["n_lines"], r["removed"]) for r in got], [(0, 2, []), (1, 3, [1]), (2, 4, [0, 3]), (3, 1, [0])])
    same(corpus_pipeline.drop_repeated_lines(spark, d, str(tmp_path)).collect(), [(0, texts[0], 5), (1, "Read more\na b", 5), (2, "read more\n\nb a c", 5)])


def test_blocks_of_long_sets_count_in_strips(monkeypatch):
    """What two sets share is the same however many shingles are counted at once."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 4000, dtype=np.int64)
    sets = [np.unique(np.concatenate([base[k : k + 3000], rng.integers(1, 1 << 62, 100, dtype=np.int64)])) for k in range(0, 1000, 50)]
    key, block, sizes = np.arange(len(sets)), np.zeros(len(sets), np.int64), np.array([len(x) for x in sets])
    whole = jaccard_join._compare_block(key, block, np.concatenate(sets), sizes, 0.8)
    monkeypatch.setattr(jaccard_join, "STRIP", 256)
    strips = jaccard_join._compare_block(key, block, np.concatenate(sets), sizes, 0.8)
    links = [sum(len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    assert whole.equals(strips) and whole.column("links").to_pylist() == links and 0 < sum(links) < len(sets) ** 2 - len(sets)


def test_blocks_are_cut_by_shingles(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(300)]
    rows = [(i, " ".join(w if rng.random() < 0.985 else "other" for w in base)) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, jaccard_join.jaccard_join(d).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 1500)
    assert sorted(map(tuple, jaccard_join.jaccard_join(d).collect())) == plain and max(r[2] for r in plain) > 5


def test_class_lm(docs, rows, empty):
    model, rest = class_lm.train(docs.filter(crc_mod5() != 1), frequent=40, classes=8, table=60)
    got = class_lm.score(docs, model, rest, crc_mod5() == 1).collect()
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows}
    toks = [(r[0], [*words_of(lower(r[1])), None]) for r in rows]
    c = Counter(w for i, ws in toks if i is not None and not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    same([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], [(i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(base(ws), 6)) for i, ws in toks])
    assert all(r["score"] < 0 for r in got)
    assert abs(float((10 ** model.step[0]).sum()) - 1) < 1e-9
    none, rest = class_lm.train(empty)
    assert {r["n_known"] for r in class_lm.score(docs, none, rest, crc_mod5() == 1).collect()} == {0}


def test_class_lm_scores_by_hand(spark):
    """All of the score but the choice of classes, from plain counts; words beyond the table are scored by joins."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(WORDS) if rng.random() < 0.7 else rng.choice("abcdefgh") for _ in range(rng.randint(0, 25)))) for i in range(120)] + [(500, None), (501, "never seen a")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (10_000, 30):
        model, rest = class_lm.train(d.filter(crc_mod5() != 1), frequent=12, classes=6, table=table)
        assert 0.5 * min(table, 70) <= len(model.table) <= 1.5 * table

        far = {r["word"]: r["cls"] for r in rest.collect()}
        assert (table < 100) == bool(far)

        def cls(w, model=model, far=far):
            h, group, _ = class_lm.tokens(pa.array([w]))
            return far.get(int(h.view(np.int64)[0]), int(class_lm.classes_of(h, group, model.table, model.cls, model.group_cls)[0]))

        train = [words_of(lower(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
        c = Counter(w for ws in train for w in [*ws, None])
        group = {w: cls(w) if w else 0 for w in {*c, "never", "seen"}}
        assert all(k > 0 for w, k in group.items() if w)
        pair = Counter((a, b) for ws in train for a, b in zip([0, *(group[w] for w in ws)], [*(group[w] for w in ws), 0], strict=True))
        into, out, total = Counter(), Counter(), sum(pair.values())
        for (a, b), k in pair.items():
            out[a] += k
            into[b] += k
        mass, kinds = Counter(), Counter()
        for w, k in c.items():
            mass[group[w]] += k
            kinds[group[w]] += 1
        step = lambda a, b: (pair[a, b] + 5 * (into[b] + 1) / (total + 6)) / (out[a] + 5)  # noqa: B023, E731
        emit = lambda w: (c[w] + 0.5) / (mass[group[w]] + 0.5 * (kinds[group[w]] + 1))  # noqa: B023, E731
        want = {}
        for i, t in rows:
            ws = [*words_of(lower(t)), None]
            want[i] = sum(math.log10(step(a, group[w]) * emit(w)) for a, w in zip([0, *(group[w] for w in ws)], ws, strict=False))
        got = {r["doc_id"]: r["score"] for r in class_lm.score(d, model, rest, crc_mod5() == 1).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_the_table_changes_no_class_and_no_score(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(WORDS) + (str(rng.randrange(30)) if rng.random() < 0.5 else "") for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    for table in (100_000, 150, 60):
        model, rest = class_lm.train(d.filter(crc_mod5() != 1), frequent=30, classes=6, table=table)
        classes = dict(zip(model.table.view(np.int64).tolist(), model.cls.tolist(), strict=True)) | {r["word"]: r["cls"] for r in rest.collect()}
        seen.append((classes, {r["doc_id"]: (r["n_known"], round(r["base_score"], 8), round(r["score"], 8)) for r in class_lm.score(d, model, rest, crc_mod5() == 1).collect()}))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) > 500


def test_rare_words_join_the_class_of_their_neighbours(spark):
    rng = random.Random(12)
    kinds = [[f"{k}{i}" for i in range(30)] for k in ("red", "big", "car")]
    text = lambda: " ".join(w for _ in range(12) for w in (rng.choice(k[: 3 + rng.randrange(28)]) for k in kinds))
    d = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    model, _ = class_lm.train(d, frequent=12, classes=4, table=1000)
    of = {}
    for k in kinds:
        h, group, _ = class_lm.tokens(pa.array([" ".join(k)]))
        of[k[0]] = Counter(class_lm.classes_of(h, group, model.table, model.cls, model.group_cls).tolist()).most_common(1)[0]
    assert len({c for c, _ in of.values()}) == 3
    assert all(n >= 28 for _, n in of.values())


def test_words_of_equal_count_fill_the_table(spark):
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300)))], "doc_id long, text string")
    model, rest = class_lm.train(d, frequent=20, classes=4, table=60)
    assert 30 <= len(model.table) <= 90 and rest.count() == 300 - len(model.table)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    n = rng.poisson(0.4, (30, 30)).astype(float)
    x = class_lm.Exchange(n.copy(), 5)

    def likelihood(cls):
        cc = np.zeros((5, 5))
        np.add.at(cc, (cls[:, None], cls[None, :]), n)
        f = class_lm._f
        return f(cc).sum() - f(cc.sum(0)).sum() - f(cc.sum(1)).sum()

    before, cls = likelihood(x.cls.copy()), x.run(4)
    assert likelihood(cls) > before
    assert cls[0] == 0 and (cls[1:] > 0).all()


def test_token_counts(docs, rows, empty):
    want = [(r[0], len((r[1] or "").encode()), len(i), len(i) > 100) for r, i in zip(rows, library_ids([r[1] for r in rows]), strict=True)]
    same(token_counts.token_counts(docs, BPE, limit=100).collect(), want)
    assert token_counts.token_counts(empty, BPE).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_files(docs, rows, name):
    path, texts = public_tokenizers.path(name), [r[1] or "" for r in rows]
    if name.endswith(".model"):
        sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=path)
        n = [len(x) for x in sp.encode(texts)]
    else:
        tok = tokenizers.Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        n = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    same([(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs, path).collect()], [(r[0], k) for r, k in zip(rows, n, strict=True)])


def test_language_id(spark, empty):
    rng = random.Random(2)
    voc = {"aa": ["lor", "bim", "sutta", "kora"], "bb": ["schö", "zwurt", "pfell", "über"]}
    text = lambda k: " ".join(rng.choice(voc[k]) for _ in range(30))
    rows = [(i, text(k), k, 1) for i in range(60) for k in voc] + [(900, None, "aa", 1), (901, "123 !", "aa", 1), (902, "", None, 1), (903, text("bb"), None, 1), (None, text("aa"), "aa", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    profiles = language_id.learn_profiles(d.filter(crc_mod5() != 0))
    assert set(profiles) == {"aa", "bb"}
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(d, profiles).collect()}
    assert got == {(i, k) for i in range(60) for k in voc} | {(900, "und"), (901, "und"), (902, "und"), (903, "bb"), (None, "aa")}
    assert all(0 <= r["score"] <= 1 for r in language_id.identify(d, profiles).collect())
    assert language_id.keep_identified(d, profiles, 0.2).count() == len(rows) - 3
    assert language_id.keep_identified(d, profiles, 0.2).columns == d.columns
    assert language_id.learn_profiles(empty) == {}
    assert {r["lang_pred"] for r in language_id.identify(d, {}).collect()} == {"und"}


def test_out_of_place_distance_by_hand(spark):
    """Profiles and predictions from plain strings, in scripts of all kinds; marks alone are no letters."""
    rng = random.Random(21)
    voc = {"de": "wir haben schöne Häuser und Übung".split(), "ru": "мы имеем красивые дома и практику".split(), "zh": "我们 有 漂亮 的 房子 和 练习 时间".split(), "ar": "لدينا بيوت جميلة وممارسة كل يوم".split()}
    rows = [(i, " ".join(rng.choice(voc[k]) for _ in range(rng.randint(1, 40))) + rng.choice(("", " 12!", "...")), k) for i in range(40) for k in voc]
    rows += [(900, "\u0301\u0300", "de"), (901, "a\u0301", "de"), (902, "x", None)]

    def code(g):
        h, mask = 0, (1 << 64) - 1
        for c in g:
            h = (h + c + 1) * 0x9E3779B97F4A7C15 & mask
        return ((h ^ h >> 29) * 0x9E3779B97F4A7C15 & mask) >> 44

    def grams(text):
        kind = lambda c: unicodedata.category(c)[0]
        symbols, out = [0], Counter()
        for c in text:
            x = ord(c.lower()[0]) if kind(c) == "L" else ord(c) | 1 << 21 if kind(c) == "M" else 0
            symbols += [x] if x or symbols[-1] else []
        symbols += [0] if symbols[-1] else []
        for n in range(1, 6):
            for i in range(len(symbols) - n + 1):
                g = symbols[i : i + n]
                if any(g) and 0 not in g[1:-1]:
                    out[code(g)] += 1
        return out

    def top(count):
        return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:300]]

    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {k: top(sum((grams(t) for _, t, lang in rows if lang == k), Counter())) for k in voc}
    profiles = language_id.learn_profiles(d)
    assert profiles == learned
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(d, profiles).collect()}
    want = {}
    for i, t, _ in rows:
        mine = top(grams(t))
        far = {k: sum(min(abs(p.index(g) - r), 300) if g in p else 300 for r, g in enumerate(mine)) for k, p in learned.items()}
        best = min(sorted(far), key=far.get)
        want.setdefault(i, []).append((best, 1 - far[best] / (300 * len(mine))))
    assert got[900] == ("und", 0.0)
    assert all(any(got[i][0] == k and abs(got[i][1] - x) < 1e-9 for k, x in w) for i, w in want.items() if i != 900)


def shingles(t):
    w = words_of(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_join(docs, rows, empty):
    sets = {(r[0], r[1]): shingles(r[1]) for r in rows}
    distinct = {s for s in sets.values() if s}
    near = {s: {t for t in distinct if t != s and len(s & t) >= 0.8 * len(s | t) - 1e-9} for s in distinct}
    got = jaccard_join.jaccard_join(docs).collect()
    assert len(got) == len(rows)
    classes = {}
    for s in distinct:
        seen, todo = {s}, [s]
        while todo:
            for t in near[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        classes[s] = min(k[0] for k, t in sets.items() if t in seen and k[0] is not None)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], r)
    for (i, _), s in sets.items():
        assert by_id[i]["class_id"] == (classes[s] if s else i)
        assert by_id[i]["n_links"] == (len(near[s]) if s else 0)
    assert sum(map(len, near.values())) >= 20
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({by_id[i]["class_id"] if s else i for (i, _), s in sets.items()})
    assert jaccard_join.keep_one(empty).count() == 0
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_jaccard_join_of_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        w = base[:]
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"y{i}_{k}" for k in range(50))) for i in range(20)]
    old, jaccard_join.LIMIT, block, jaccard_join.BLOCK = jaccard_join.LIMIT, 8, jaccard_join.BLOCK, 16
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    jaccard_join.LIMIT, jaccard_join.BLOCK = old, block
    assert {r["class_id"] for r in got if r["doc_id"] < 90} == {0}
    assert {r["n_links"] for r in got if r["doc_id"] < 90} == {89}
    assert all(r["class_id"] == r["doc_id"] and r["n_links"] == 0 for r in got if r["doc_id"] >= 100)


def test_copies_are_dropped_by_row(spark):
    """Rows with one id or none and different texts have their own fates; of rows that repeat id and text one stays."""
    t = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcde"]
    rows = [(1, t[0], 1), (7, t[0], 2), (7, t[1], 3), (None, t[1], 4), (None, t[2], 5), (None, t[2], 6), (None, t[3], 7), (9, t[4], 8), (9, t[4], 9), (3, None, 10), (3, None, 11), (None, "", 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, text_hash int").repartition(3)
    got = sorted(r["text_hash"] for r in jaccard_join.keep_one(d).collect())
    assert [x for x in got if x not in (5, 6, 8, 9)] == [1, 3, 7, 10, 11, 12]
    assert len({5, 6} & set(got)) == 1 and len({8, 9} & set(got)) == 1
    classes = sorted(((r["class_id"] is not None, r["class_id"] or 0, r["n_copies"]) for r in jaccard_join.jaccard_join(d).collect()))
    assert classes == sorted([(True, 1, 1)] * 2 + [(True, 7, 1)] * 2 + [(False, 0, 1)] * 2 + [(False, 0, 0)] + [(True, 9, 1)] * 2 + [(True, 3, 0)] * 2 + [(False, 0, 0)])


def test_jaccard_join_recall_at_depth(spark):
    """Pairs just over the similarity in a table where nearly every bucket is split again and again."""
    rng = random.Random(18)
    common = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(1000):
        own = [f"o{i}_{k}" for k in range(60)]
        rows.append((2 * i, " ".join(common + own)))
        for at in rng.sample(range(5, 55), 2):
            own[at] = f"c{i}_{at}"
        rows.append((2 * i + 1, " ".join(common + own)))
    sets = [shingles(t) for _, t in rows]
    near = [len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1]) for i in range(1000)]
    old, jaccard_join.LIMIT = jaccard_join.LIMIT, 64
    got = {r["doc_id"]: r["class_id"] for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    jaccard_join.LIMIT = old
    found = sum(got[2 * i + 1] == 2 * i for i in range(1000) if near[i])
    assert sum(near) > 900 and found >= 0.95 * sum(near)


def test_jaccard_join_around_a_common_passage(spark):
    """Buckets over LIMIT of texts that share a passage only: every pair of similar ones is found, as brute force finds them."""
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(100)]
    rows = []
    for i in range(700):
        own = [f"o{i}_{k}" for k in range(54)]
        for j in range(2):
            rows.append((2 * i + j, " ".join(shared + own)))
            for at in (10, 27, 44):
                own[at] = f"c{rng.random()}"
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.86 and len(a & shingles(rows[2][1])) < 0.5 * len(a | shingles(rows[2][1]))
    old, jaccard_join.LIMIT = jaccard_join.LIMIT, 128
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    jaccard_join.LIMIT = old
    lost = [i for i in range(700) if got[2 * i + 1]["class_id"] != 2 * i or got[2 * i]["n_links"] != 1]
    assert not lost


def test_components_both_ways(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(500, 530)]
    d = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in components(d).collect()} == {tuple(r) for r in components(d, local_edges=0).collect()}


def test_bpe_round_trip(docs, rows, empty):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(r[0], len(i), sha(np.array(i, "<u4").tobytes()), sha((r[1] or "").encode())) for r, i in zip(rows, library_ids([r[1] for r in rows]), strict=True)]
    same(bpe_codec.bpe_round_trip(docs, BPE).collect(), want)
    encoded = bpe_codec.bpe_encode(docs, BPE)
    same(bpe_codec.bpe_decode(encoded, BPE).collect(), [(r[0], r[1] or "") for r in rows])
    assert bpe_codec.bpe_round_trip(empty, BPE).count() == 0


def test_automaton_shares_suffixes_and_finds_words():
    words = sorted(w.encode() for w in {a + b for a in ("ab", "cb", "dx", "e") for b in ("ing", "ed", "s", "")})
    t = bpe_codec.tables(BPE)
    a = bpe_codec.Automaton(bpe_codec.compile_automaton(words, *bpe_codec.merge_in_step(t, words)))
    assert a.find(words).tolist() == list(range(len(words)))
    assert a.find([b"abin", b"zz", b"", b"abings"]).tolist() == [-1] * 4
    assert a.n < sum(map(len, words)) / 3


def test_merging_against_the_library():
    rng = random.Random(9)
    pieces = [("".join(rng.choice("thequickerbrownésß中") for _ in range(rng.choice((1, 3, 7, 11, 18, 35, 120, 400))))).encode() for _ in range(400)]
    ids, sizes = bpe_codec.merge_in_step(bpe_codec.tables(BPE), pieces)
    want = library_ids([p.decode() for p in pieces])
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]

"""WARC packages: round trips, directories that the standard library writes, random reads and damage."""

import hashlib
import io
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import pytest

from coweave.llm import queries
from coweave.llm import warc_zip as W

SCHEMA = "page_id long, url string, html string, digest string, size int, first string, key string"


def expected(rows, least=100):
    groups, payloads = defaultdict(list), [(i, (h or "").encode()) for i, h in rows]
    for i, p in payloads:
        groups[p].append(i)
    out = []
    for i, p in payloads:
        ids = [x for x in groups[p] if x is not None]
        first = min(ids) if ids and len(p) >= least else None
        revisit = first is not None and i != first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", "x" * 99, "x" * 100, "é" * 50, "é" * 49, "WARC/1.1\r\n\r\nWARC/1.1\r\n\r\n" * 9, "\r\n\r\n" * 40, "<html>\0\x85 字</html>" * 20, "y" * 3_000_000]
    texts += ["".join(rng.choice("abc <>\n") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    urls = [None, "", "http://a.b/c d\r\nWARC-Type: revisit", "http://é.fr/字?q=1", "http://x"]
    out = [(i + 10, rng.choice(urls), t) for i, t in enumerate(texts)]
    out += [(i, "http://copy", "one page of very many " * 9) for i in range(500, 900)]  # a frequent payload
    out += [(i, rng.choice(urls), texts[3 + i % 30]) for i in range(1000, 1060)]
    out += [out[3], out[20], (None, "http://n", texts[20]), (None, None, "only null ids " * 20), (None, "u", "only null ids " * 20), (None, None, None)]
    return [(*r, "d", 1, "f", "k") for r in out]


def contract(records):
    return Counter(map(tuple, records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))


@pytest.mark.parametrize("options", [{}, {"package_bytes": 2000, "level": 1}, {"least_bytes": 1}])
def test_round_trip(spark, tmp_path, rows, options):
    got = W.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(6), str(tmp_path / "w"), **options)
    assert contract(got) == expected([(r[0], r[2]) for r in rows], options.get("least_bytes", 100))


def test_copies_meet_without_a_broadcast(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(W, "HOT", 1)
    got = W.round_trip(spark.createDataFrame(rows, SCHEMA), f"file:{tmp_path}/w")
    assert contract(got) == expected([(r[0], r[2]) for r in rows])


def test_payloads_and_urls_come_back(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = W.write_packages(df, str(tmp_path / "w"), package_bytes=5000)
    got = W.read_packages(manifest, with_payload=True).collect()
    assert sum(r["records"] for r in manifest.collect()) == len(rows) == len(got)
    want = Counter((i, None if u is None else W.quoted(u), (h or "").encode()) for i, u, h, *_ in rows)
    whole = {(r["page_id"], r["payload_digest"]): bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert Counter((r["page_id"], r["url"], whole[(r["page_id"] if r["refers_to"] is None else r["refers_to"], r["payload_digest"])]) for r in got) == want


def test_empty_table(spark, tmp_path):
    got = W.round_trip(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert got.count() == 0 and not list((tmp_path / "w").iterdir())


def test_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    assert contract(queries.QUERIES["op13_warc_packages"](spark, sf)) == expected([tuple(r) for r in pages])


def package(tmp_path, name="p.wacz", comment=b"", before=b"", method=zipfile.ZIP_STORED, records=30):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        gz = lambda b: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + c.flush()
        made = [W.make_record(i, f"http://x/{i}", b"p" * i, i, hashlib.sha256(b"p" * i).hexdigest(), None, "2020-01-01T00:00:00Z") for i in range(records)]
        packed = [gz(m) for m in made]
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        z.writestr("archive/data.warc.gz", b"".join(packed), method)
        lines, at = [], 0
        for p in packed:
            lines.append(f'x 20200101 {{"filename": "data.warc.gz", "offset": "{at}", "length": "{len(p)}"}}')
            at += len(p)
        z.writestr("indexes/index.cdx", "\n".join(lines), zipfile.ZIP_DEFLATED)
        z.comment = comment
    at = tmp_path / name
    at.write_bytes(before + raw.getvalue())
    return str(at), made, packed


def random_access(at, made, packed):
    reader = W.PackageReader(at)
    entries = list(reader.entries())
    assert [e[2] for e in entries] == list(map(len, packed))
    start, size = reader.archives()["data.warc.gz"]
    assert size == sum(map(len, packed))
    for k in (17, 3, len(made) - 1):
        assert zlib.decompress(reader.read(start + entries[k][1], entries[k][2]), 31) == made[k]
    assert W.parse_record(made[5])[2] == b"p" * 5
    reader.close()


def test_reads_what_the_standard_library_writes(tmp_path):
    random_access(*package(tmp_path))
    random_access(*package(tmp_path, comment=b"PK\5\6 in a comment"))
    random_access(*package(tmp_path, before=b"a script before the package " * 50))


def test_zip64_directories(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    at, made, packed = package(tmp_path)
    raw = open(at, "rb").read()
    assert b"PK\6\6" in raw and b"PK\6\7" in raw
    random_access(at, made, packed)
    random_access(*package(tmp_path, before=b"a script before the package"))


def test_packages_with_zip64_from_tasks(spark, tmp_path, rows):
    """The writer's stream has a ZIP64 local header; the standard library reads it as well."""
    manifest = W.write_packages(spark.createDataFrame(rows[:40], SCHEMA).coalesce(1), str(tmp_path / "w"))
    (row,) = manifest.collect()
    with zipfile.ZipFile(row["package"]) as z:
        assert z.testzip() is None and sorted(z.namelist()) == [W.ARCHIVE, W.INDEX]
        assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        assert len(z.read(W.INDEX).splitlines()) == 40


def test_damage_raises(spark, tmp_path, rows):
    at, *_ = package(tmp_path)
    whole = open(at, "rb").read()
    for k, bad in enumerate((b"", whole[:-30], whole.replace(b"PK\1\2", b"PK\1\3"), b"no package")):
        p = tmp_path / f"bad{k}"
        p.write_bytes(bad)
        with pytest.raises(ValueError):
            W.PackageReader(str(p))
    packed, *_ = package(tmp_path, "deflated.wacz", method=zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="not stored"):
        W.PackageReader(packed).archives()
    with pytest.raises(ValueError, match="digest"):
        W.row_of(*W.parse_record(W.make_record(1, None, b"a", 1, "00", None, "2020-01-01T00:00:00Z")))
    records = spark.createDataFrame([(1, None, "revisit", 2, 5, "x")], W.RECORD)
    with pytest.raises(ValueError, match="no response"):
        W.check_revisits(records)

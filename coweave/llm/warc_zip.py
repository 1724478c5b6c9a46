"""WARC records in ZIP packages, written by tasks and read back by ranges.

A package holds two stored members: ``archive/data.warc.gz``, a gzip member for each record, and ``indexes/index.cdx``, a CDXJ line
for each record with its offset and length. The reader takes the end of a package, finds its central directory (that of ZIP64 where
numbers pass 16 or 32 bits), the stored members and the index, and from then on reads only ranges of the archive member: nothing is
extracted or read whole. Ranges of a few megabytes are dealt out evenly, however many records a package has.

Of records with equal payloads of at least ``least_bytes`` that with the least page id is a response and has the payload; the others
are revisits, which have its digest, its length and the response's record id. The least ids come from an aggregation of digests.
Digests of over one in HOT rows, no more than HOT of them, meet the pages by a broadcast, all others by a join on the digest. A task
names its packages anew in every attempt, and only those of the attempts that Spark has committed are in the manifest and read.

Defined cases: a null html is empty; a null page id has a record id without a number, and a payload whose rows all have null ids is
a response each time; rows that repeat id and payload are alike, all responses or all revisits; a null url gives no target line, and
blanks and control characters in a url are percent-encoded; a payload of any length is one record; an empty table gives no package; other
columns are ignored. A record whose payload does not fit its digest, a revisit without its response, or a damaged directory raises.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only_the_last_stays, scratch_dir, ship, shuffle_partitions

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Of so many rows one may have a payload before its digest is broadcast.
HOT = 1024
MANIFEST = "package string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def open_store(uri: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in uri or uri.startswith("file:"):
        return pfs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", uri)))
    return pfs.LocalFileSystem(), uri


# -- records -------------------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def quoted(url: str) -> str:
    return re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def make_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record with its payload, or a revisit record without it where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quoted(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
        payload = b""
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return b"".join(["\r\n".join(lines).encode(), b"\r\n\r\n", http, payload, b"\r\n\r\n"])


def fields(head: bytes) -> dict[str, str]:
    """Header lines by their lower-case names."""
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v.strip() for k, _, v in pairs}


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of the record and of its HTTP message, and the payload."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/"):
        raise ValueError("this is no WARC record")
    warc = fields(raw[:end])
    block = raw[end + 4 : end + 4 + int(warc["content-length"])]
    if len(block) < int(warc["content-length"]):
        raise ValueError(f"the record {warc.get('warc-record-id')} is cut off")
    cut = block.find(b"\r\n\r\n")
    return warc, fields(block[: max(cut, 0)]), block[cut + 4 :] if cut >= 0 else block


# -- packages ------------------------------------------------------------------------------------------------------------------


class PackageWriter:
    """One package: records are appended one by one, the index and the directory at the end."""

    def __init__(self, uri: str, level: int, date: str):
        self.uri, self.level, self.stamp = uri, level, re.sub("[^0-9]", "", date)
        store, at = open_store(uri)
        self.stream = store.open_output_stream(at)
        self.package = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, record: bytes, about: dict) -> None:
        gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        raw = gz.compress(record) + gz.flush()
        self.member.write(raw)
        self.index.append(f"{about.get('url') or '-'} {self.stamp} {json.dumps(about | {'filename': 'data.warc.gz', 'offset': self.size, 'length': len(raw)})}\n")
        self.size += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.package.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.index)))
        self.package.close()
        self.stream.close()
        return self.uri, len(self.index), self.size


@dataclass
class Member:
    name: str
    method: int
    packed: int
    size: int
    head: int  # offset of the local header


class PackageReader:
    """The directory of a package, and ranges of its members."""

    def __init__(self, uri: str):
        store, at = open_store(uri)
        self.file = store.open_input_file(at)
        self.members = {m.name: m for m in self._directory()}

    def read(self, at: int, size: int) -> bytes:
        raw = self.file.read_at(size, at)
        if len(raw) < size:
            raise ValueError("the package is cut off")
        return raw

    def _directory(self) -> Iterator[Member]:
        whole = self.file.size()
        tail_at = max(0, whole - 65_557)
        tail = self.read(tail_at, whole - tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(b"PK\5\6", 0, end)  # the mark may stand in a comment
        if end < 0:
            raise ValueError("no end of a central directory")
        count, size, at = struct.unpack_from("<HII", tail, end + 10)
        stop = tail_at + end
        locator = self.read(stop - 20, 20) if stop >= 20 else b""
        if locator[:4] == b"PK\6\7":
            for wide_at in (int.from_bytes(locator[8:16], "little"), stop - 76):  # as written, or behind data that came before the package
                mark, count, size, at = struct.unpack("<4s28xQQQ", self.read(wide_at, 56))
                if mark == b"PK\6\6":
                    stop = wide_at
                    break
            else:
                raise ValueError("no ZIP64 directory where its locator says")
        elif count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
            raise ValueError("no locator of a ZIP64 directory")
        shift = stop - size - at
        raw, p = self.read(at + shift, size), 0
        for _ in range(count):
            mark, method, packed, plain, names, extras, comments, head = struct.unpack_from("<4s6xH8xIIHHH8xI", raw, p)
            if mark != b"PK\1\2":
                raise ValueError("the central directory is damaged")
            name, extra = raw[p + 46 : p + 46 + names], raw[p + 46 + names : p + 46 + names + extras]
            plain, packed, head = wide_fields(extra, plain, packed, head)
            yield Member(name.decode(), method, packed, plain, head + shift)
            p += 46 + names + extras + comments

    def data_at(self, member: Member) -> int:
        """Where a member's bytes begin: its local header may have another extra field than the directory's."""
        mark, names, extras = struct.unpack("<4s22xHH", self.read(member.head, 30))
        if mark != b"PK\3\4":
            raise ValueError(f"{member.name} has no local header")
        return member.head + 30 + names + extras

    def content(self, member: Member) -> bytes:
        """A whole small member, such as an index."""
        raw = self.read(self.data_at(member), member.packed)
        if member.method not in (0, 8):
            raise ValueError(f"{member.name} is packed by the unknown method {member.method}")
        return raw if member.method == 0 else zlib.decompress(raw, -15)

    def archives(self) -> dict[str, tuple[int, int]]:
        """Offset and size of the stored archive members by file name."""
        found = {m.name.rpartition("/")[2]: m for m in self.members.values() if m.name.startswith("archive/")}
        if packed := [m.name for m in found.values() if m.method != 0]:
            raise ValueError(f"records of {packed} can't be read by ranges: these members are not stored")
        return {name: (self.data_at(m), m.size) for name, m in found.items()}

    def entries(self) -> Iterator[tuple[str, int, int]]:
        """File name, offset and length of every record in the indexes."""
        for m in self.members.values():
            if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj")):
                for line in self.content(m).splitlines():
                    if line.strip() and not line.startswith(b"!"):
                        about = json.loads(line[line.index(b"{") :])
                        yield about["filename"], int(about["offset"]), int(about["length"])

    def close(self) -> None:
        self.file.close()


def wide_fields(extra: bytes, *narrow: int) -> list[int]:
    """Sizes and offset of a directory's entry, those that 32 bits can't hold from its ZIP64 field."""
    wide, p = b"", 0
    while p + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, p)
        if kind == 1:
            wide = extra[p + 4 : p + 4 + size]
        p += 4 + size
    out, p = [], 0
    for x in narrow:
        if x == 0xFFFFFFFF:
            if p + 8 > len(wide):
                raise ValueError("a ZIP64 field is cut off")
            x = struct.unpack_from("<Q", wide, p)[0]
            p += 8
        out.append(x)
    return out


# -- writing -------------------------------------------------------------------------------------------------------------------


def with_first(pages: DataFrame, least_bytes: int) -> DataFrame:
    """The pages (page_id, url, payload) with size, digest, and refers_to of the rows that are to be revisits."""
    spark = pages.sparkSession
    d = pages.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    copies = d.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    payloads = materialize(copies, "payloads")
    total = payloads.agg(F.sum("rows")).first()[0] or 0
    shared = payloads.filter((F.col("rows") > 1) & (F.col("size") >= least_bytes) & F.col("first").isNotNull())
    hot = shared.filter(F.col("rows") * HOT > total).select("digest", "first").collect()  # under HOT rows
    hot = spark.createDataFrame([tuple(r) for r in hot], "digest string, hot_first long")
    rest = shared.filter(F.col("rows") * HOT <= total).select(F.col("digest").alias("key"), "first")
    d = d.join(F.broadcast(hot), "digest", "left")
    spread = F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string"))  # no digest: these need no partner
    d = d.withColumn("key", F.when(F.col("hot_first").isNull() & (F.col("size") >= least_bytes), F.col("digest")).otherwise(spread)).join(rest, "key", "left")
    first = F.coalesce("hot_first", "first")
    return d.select("page_id", "url", "payload", "size", "digest", F.when(~first.eqNullSafe(F.col("page_id")), first).alias("refers_to"))


def write_packages(pages: DataFrame, path: str, least_bytes: int = 100, package_bytes: int = 1 << 30, level: int = 6, date: str = "2020-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row into packages of about ``package_bytes`` in the folder ``path``; their manifest."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    store, at = open_store(path)
    store.create_dir(at, recursive=True)

    def run(batches):
        out, done = None, []
        for b in batches:
            for page_id, url, payload, size, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "refers_to")), strict=True):
                if out is None:
                    out = PackageWriter(f"{path}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.wacz", level, date)
                about = {"url": quoted(url) if url is not None else None, "digest": f"sha256:{digest}", "recordid": record_id(page_id)}
                out.add(make_record(page_id, url, payload, size, digest, refers_to, date), about)
                if out.size >= package_bytes:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["package", "records", "bytes"])

    return materialize(with_first(rows, least_bytes).mapInArrow(run, MANIFEST), "manifest")


# -- reading -------------------------------------------------------------------------------------------------------------------


def record_ranges(packages: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """package, at, packed, lengths: runs of neighbouring records of the packages, of about ``range_bytes`` each."""

    def run(batches):
        for b in batches:
            for uri in b.column("package").to_pylist():
                reader = PackageReader(uri)
                archives, entries = reader.archives(), sorted(reader.entries())
                reader.close()
                runs: list[tuple[int, bool, list[int]]] = []
                end, size = -1, 0
                for name, offset, length in entries:
                    start, whole = archives[name]
                    if offset + length > whole:
                        raise ValueError(f"{uri}: the index points behind the end of {name}")
                    if start + offset != end or size >= range_bytes:
                        runs.append((start + offset, name.endswith(".gz"), []))
                        size = 0
                    runs[-1][2].append(length)
                    end, size = start + offset + length, size + length
                if runs:
                    at, packed, lengths = zip(*runs, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(runs)), pa.array(at), pa.array(packed), pa.array(lengths, pa.list_(pa.int64()))], ["package", "at", "packed", "lengths"])

    return packages.select("package").mapInArrow(run, "package string, at long, packed boolean, lengths array<long>")


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload, null for revisits) of each record in the
    packages of a manifest or any table with their paths in ``package``."""
    spark = packages.sparkSession
    ship(spark)
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        uri, reader = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["package"] != uri:
                    if reader:
                        reader.close()
                    uri = r["package"]
                    reader = PackageReader(uri)
                raw, p, rows = memoryview(reader.read(r["at"], sum(r["lengths"]))), 0, []
                for n in r["lengths"]:
                    record = zlib.decompress(raw[p : p + n], 31) if r["packed"] else bytes(raw[p : p + n])
                    rows.append(row_of(*parse_record(record)))
                    p += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (0, 3, 4) else pa.binary() if i == 6 else pa.string()) for i, c in enumerate(list(zip(*rows, strict=True))[: len(names)])], names)
        if reader:
            reader.close()

    ranges = materialize(record_ranges(packages), "ranges").repartition(shuffle_partitions(spark), "package", "at")
    return ranges.sortWithinPartitions("package", "at").mapInArrow(run, schema)


def row_of(warc: dict[str, str], http: dict[str, str], payload: bytes) -> tuple:
    kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha256:")
    if kind == "revisit":
        return page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), kind, page_of(warc["warc-refers-to"]), int(http["content-length"]), digest, None
    found = hashlib.sha256(payload).hexdigest()
    if found != digest:
        raise ValueError(f"the payload of {warc['warc-record-id']} does not fit its digest")
    return page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), kind, None, len(payload), found, payload


def check_revisits(records: DataFrame) -> None:
    """Raise an error unless every revisit has its response, with the digest and length that it tells."""
    same = ["payload_digest", "payload_bytes", "page_id"]
    told = records.filter("record_type = 'revisit'").groupBy("payload_digest", "payload_bytes", F.col("refers_to").alias("page_id")).agg(F.count(F.lit(1)).alias("rows"))
    lost = told.join(records.filter("record_type = 'response'").select(*same), same, "left_anti").agg(F.sum("rows")).first()[0]
    if lost:
        raise ValueError(f"{lost} revisits have no response")


def scratch_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/coweave-packages-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, path: str, **options) -> DataFrame:
    """The records of all pages as they are read back from their packages at ``path``, every revisit checked against its response."""
    with only_the_last_stays(pages.sparkSession):
        records = materialize(read_packages(write_packages(pages, path, **options)), "records")
    check_revisits(records)
    return records

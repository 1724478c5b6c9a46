"""A REST service as a Spark data source: requests go out from tasks, within a budget, and what was answered is never paid twice.

``spark.read.format("rest")`` reads a folder of Parquet files with the columns url and cost; each file is a partition. An answer is
put into the folder ``answers`` under the SHA-1 of its url before its row is given, so a task that is run again, or a later run, finds
it there. ``ask`` adds a cache of all answers as one table."""

from __future__ import annotations

import hashlib
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

ANSWER = "url string, status int, body binary"


class BudgetExhausted(RuntimeError):
    """The service takes no more requests for now."""


class Client:
    """Requests with retries. send(url) gives (status, body), or raises OSError; it is None where there is no connection."""

    def __init__(self, send: Callable[[str], tuple[int, object]] | None, tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        self.send, self.tries, self.wait, self.sleep = send, tries, wait, sleep

    def answer(self, url: str) -> tuple[int, object]:
        """Status and body; a status from 500 on when it fails for good, and 599 without a connection."""
        status, body = 599, None
        for k in range(self.tries if self.send else 0):
            try:
                status, body = self.send(url)
            except OSError:
                status, body = 599, None
            if status == 429:
                raise BudgetExhausted(url)
            if status in (401, 403):
                raise PermissionError(url)
            if status < 500:
                return status, body
            self.sleep(self.wait * 2**k)
        return status, None

    def get(self, url: str):
        """The body; None for what the service does not have, when it fails for good, and without a connection."""
        status, body = self.answer(url)
        return body if status < 400 else None


def send_over_http(timeout: float = 90.0, agent: str = "coweave") -> Callable[[str], tuple[int, bytes]]:
    def send(url: str) -> tuple[int, bytes]:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                return r.status or 200, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    return send


def store(uri: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in uri or uri.startswith("file:"):
        return pfs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", uri)))
    return pfs.LocalFileSystem(), uri


class Answers:
    """Answers in a shared folder: the status and the body of each url, there as a whole or not at all."""

    def __init__(self, folder: str):
        self.fs, self.at = store(folder)
        self.fs.create_dir(self.at, recursive=True)

    def _name(self, url: str) -> str:
        return f"{self.at}/{hashlib.sha1(url.encode()).hexdigest()}"

    def find(self, url: str) -> tuple[int, bytes] | None:
        if self.fs.get_file_info(self._name(url)).type != pfs.FileType.File:
            return None
        with self.fs.open_input_stream(self._name(url)) as f:
            raw = f.read()
        return int(raw[:3]), raw[4:]

    def put(self, url: str, status: int, body: bytes) -> None:
        part = f"{self._name(url)}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(b"%03d\n" % status + body)
        self.fs.move(part, self._name(url))


class RestSource(DataSource):
    """Options: path (of the requests), answers (a folder), budget (credits, 10000), tries (5), wait (seconds, 1), timeout (90)."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> DataSourceReader:
        return RestReader(dict(self.options))


class RequestFile(InputPartition):
    def __init__(self, path: str, credits: int):
        super().__init__(path)
        self.path, self.credits = path, credits


class RestReader(DataSourceReader):
    """url, status, body of each request. Those that the budget does not reach, or that come after the service has said that it takes no
    more, have a null status; one that the service refuses (401, 403) ends the job, with all answers so far kept."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def _files(self) -> Iterator[tuple[str, int]]:
        fs, at = store(self.options["path"])
        for f in sorted(fs.get_file_info(pfs.FileSelector(at)), key=lambda f: f.path):
            if f.path.endswith(".parquet"):
                yield f.path, sum(pq.read_table(f.path, columns=["cost"], filesystem=fs).column("cost").to_pylist())

    def partitions(self) -> list[RequestFile]:
        """Each file gets the credits that its requests cost, as long as there are any."""
        left, out = int(self.options.get("budget", 10_000)), []
        for path, cost in self._files():
            out.append(RequestFile(path, min(cost, left)))
            left -= out[-1].credits
        return out

    def read(self, partition: RequestFile) -> Iterator[tuple]:
        fs, _ = store(self.options["path"])
        rows = pq.read_table(partition.path, columns=["url", "cost"], filesystem=fs).to_pylist()
        answers, left = Answers(self.options["answers"]), partition.credits
        client = Client(send_over_http(float(self.options.get("timeout", 90))), int(self.options.get("tries", 5)), float(self.options.get("wait", 1)))
        for r in rows:
            known = answers.find(r["url"])
            if known is None and r["cost"] <= left:
                try:
                    status, body = client.answer(r["url"])
                except BudgetExhausted:
                    left = -1
                else:
                    left -= r["cost"]
                    known = status, body or b""
                    if status < 500:  # else another run may have more luck
                        answers.put(r["url"], *known)
            yield (r["url"], *(known or (None, None)))


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """url, status, body of all answers that ``ask`` has taken into its cache."""
    fs, at = store(f"{folder}/cache")
    there = fs.get_file_info(at).type == pfs.FileType.Directory
    return spark.read.schema(ANSWER).parquet(f"{folder}/cache") if there else spark.createDataFrame([], ANSWER)


def ask(requests: DataFrame, folder: str, budget: int = 10_000, per_task: int = 50, **options) -> DataFrame:
    """url, status, body of each different request (url, and cost if it is not 1 each): from the cache in ``folder``, or from the service
    within the budget, and then in the cache as well. Requests that got no answer have nulls, and are asked again next time."""
    spark = requests.sparkSession
    ship(spark)
    spark.dataSource.register(RestSource)
    cost = F.col("cost") if "cost" in requests.columns else F.lit(1)
    wanted = requests.filter("url IS NOT NULL").groupBy("url").agg(F.max(cost.cast("int")).alias("cost"))
    missing = wanted.join(cached(spark, folder).select("url"), "url", "left_anti")
    at = f"{folder}/requests/{uuid.uuid4().hex}"
    missing.repartition(max(1, -(-missing.count() // per_task)), "url").write.parquet(at)
    got = spark.read.format("rest").options(path=at, answers=f"{folder}/answers", budget=budget, **options).load()
    got.filter("status < 500").write.mode("append").parquet(f"{folder}/cache")
    return wanted.select("url").join(cached(spark, folder), "url", "left")

"""The REST source against a server of its own: retries, refusals, budgets that end in the middle, and nothing paid twice."""

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from coweave.sources import rest


@pytest.fixture
def service():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            server = self.server
            with server.lock:
                server.asked[self.path] += 1
                served = sum(n for p, n in server.asked.items())
                status = 200
                if self.path.startswith("/none"):
                    status = 404
                elif self.path.startswith("/flaky") and server.asked[self.path] < 3:
                    status = 503
                elif self.path.startswith("/down"):
                    status = 500
                elif self.path.startswith("/closed"):
                    status = 401
                elif server.most is not None and served > server.most:
                    status = 429
            body = self.path.encode() + b"\0\xff" if status == 200 else b""
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.asked, server.most, server.lock = Counter(), None, threading.Lock()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.url = f"http://127.0.0.1:{server.server_address[1]}"
    yield server
    server.shutdown()


def requests(spark, service, *paths):
    return spark.createDataFrame([(service.url + p,) for p in paths], "url string")


def answers(df, service):
    return {r["url"].removeprefix(service.url): (r["status"], None if r["body"] is None else bytes(r["body"])) for r in df.collect()}


def test_answers_retries_and_cache(spark, service, tmp_path):
    wanted = requests(spark, service, "/a", "/b", "/none", "/flaky", "/down", "/a")
    got = answers(rest.ask(wanted, str(tmp_path), per_task=2, tries=3, wait=0.01), service)
    assert got == {"/a": (200, b"/a\0\xff"), "/b": (200, b"/b\0\xff"), "/none": (404, b""), "/flaky": (200, b"/flaky\0\xff"), "/down": (None, None)}
    assert service.asked == {"/a": 1, "/b": 1, "/none": 1, "/flaky": 3, "/down": 3}
    again = answers(rest.ask(requests(spark, service, "/a", "/none", "/c"), str(tmp_path)), service)
    assert again == {"/a": (200, b"/a\0\xff"), "/none": (404, b""), "/c": (200, b"/c\0\xff")}
    assert service.asked["/a"] == service.asked["/none"] == service.asked["/c"] == 1
    assert rest.cached(spark, str(tmp_path)).count() == 5


def test_budget_ends_in_the_middle(spark, service, tmp_path):
    """The service stops after some answers; these stay, and the next run asks for the rest only."""
    paths = [f"/p{i}" for i in range(30)]
    service.most = 12
    first = answers(rest.ask(requests(spark, service, *paths), str(tmp_path), per_task=5, wait=0.01), service)
    have = {p for p, (status, _) in first.items() if status == 200}
    assert len(have) == 12 and len(first) == 30
    service.most = None
    second = answers(rest.ask(requests(spark, service, *paths), str(tmp_path), per_task=5, wait=0.01), service)
    assert all(status == 200 for status, _ in second.values())
    assert all(service.asked[p] == 1 for p in have)


def test_own_budget_counts_credits(spark, service, tmp_path):
    wanted = requests(spark, service, *[f"/s{i}" for i in range(10)]).withColumn("cost", F.lit(10))
    got = answers(rest.ask(wanted, str(tmp_path), budget=35, per_task=100), service)
    assert sum(status == 200 for status, _ in got.values()) == 3 == sum(service.asked.values())


def test_refusal_ends_the_job_and_keeps_answers(spark, service, tmp_path):
    wanted = requests(spark, service, "/a", "/b", "/c", "/closed").coalesce(1)
    with pytest.raises(Exception, match="PermissionError"):
        rest.ask(wanted, str(tmp_path), per_task=100)
    before = dict(service.asked)
    got = answers(rest.ask(requests(spark, service, "/a", "/b", "/c"), str(tmp_path)), service)
    assert all(status == 200 for status, _ in got.values())
    assert all(service.asked[p] == 1 for p in before if p != "/closed") and service.asked["/a"] == 1


def test_a_task_that_runs_again_pays_nothing(spark, service, tmp_path):
    """Reading twice is what a retried task does."""
    at = str(tmp_path / "wanted")
    requests(spark, service, "/x", "/y").withColumn("cost", F.lit(1)).write.parquet(at)
    spark.dataSource.register(rest.RestSource)
    read = spark.read.format("rest").options(path=at, answers=str(tmp_path / "answers")).load()
    assert answers(read, service) == answers(read, service) == {"/x": (200, b"/x\0\xff"), "/y": (200, b"/y\0\xff")}
    assert service.asked == {"/x": 1, "/y": 1}


def test_nothing_to_ask(spark, tmp_path):
    assert rest.ask(spark.createDataFrame([], "url string"), str(tmp_path)).count() == 0

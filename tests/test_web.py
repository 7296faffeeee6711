"""Live pages in batch and as a stream, against a server on the loopback."""

import functools
import http.server
import socket
import threading

import pytest
from pyspark.sql import functions as F

from weftline.sources import web
from weftline.streaming.run import write_once

NAMES = {"a.example": ["93.184.216.34"], "b.example": ["93.184.216.35"], "c.example": ["93.184.216.36", "93.184.216.37"], "inner.example": ["10.0.0.1"]}


def dial_local(port, address, timeout):
    """Every public address is the server of the test; the first address of c.example does not answer."""
    if address[0] == "93.184.216.36":
        raise ConnectionRefusedError
    return socket.create_connection(("127.0.0.1", port), timeout)


class StubPages(web.WebPages):
    @classmethod
    def name(cls):
        return "stub_pages"

    def getter(self):
        dial = functools.partial(dial_local, int(self.options["port"]))
        return lambda url: web.fetch(url, timeout=5, addresses=NAMES.__getitem__, dial=dial)


@pytest.fixture
def server(spark):
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.headers["Host"] + self.path)
            if self.path.startswith("/to/"):
                self.send_response(302)
                self.send_header("Location", self.path[3:])
                self.end_headers()
                return
            body = f"<p>{self.headers['Host']}{self.path}".encode()
            self.send_response(404 if "gone" in self.path else 200)
            self.send_header("Content-Type", "text/html")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    spark.dataSource.register(StubPages)
    yield s.server_address[1], asked
    s.shutdown()
    s.server_close()


def test_connections_go_to_checked_addresses(server):
    port, asked = server
    get = lambda url: web.fetch(url, timeout=5, addresses=NAMES.__getitem__, dial=functools.partial(dial_local, port))
    assert get("http://A.example/x")[1:8] == (200, "text/html", None, b"<p>A.example/x", "http://A.example/x", None, "a.example")
    assert get("http://c.example/to/y")[4:6] == (b"<p>c.example/y", "http://c.example/y")  # the second address answers
    assert get("http://a.example/gone")[1] == 404
    assert get("http://inner.example/")[6] == "EBLOCKED: blocked address"
    assert get("http://[bad/")[6:8] == ("Network error: ValueError: Invalid IPv6 URL", None)
    assert not any("inner" in a for a in asked)
    asked_names = []

    def once(host):  # a second answer would be an inner address
        asked_names.append(host)
        return ["93.184.216.34"] if len(asked_names) == 1 else ["10.0.0.1"]

    assert web.fetch("http://a.example/z", timeout=5, addresses=once, dial=functools.partial(dial_local, port))[1] == 200 and asked_names == ["a.example"]


def test_a_host_filter_prunes_partitions(spark, server):
    port, asked = server
    urls = [f"http://{h}.example/{i}" for h in "abc" for i in range(5)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pages = spark.read.format("stub_pages").option("port", port).option("urls", "\n".join(urls)).option("urlsPerPartition", "2").option("pushFilters", "true").load()
        one = pages.filter("host = 'b.example'")
        got = {r["url"]: r["part"] for r in one.select("url", F.spark_partition_id().alias("part")).collect()}
        assert sorted(got) == sorted(u for u in urls if "b.ex" in u) and len(set(got.values())) == 3
        assert all(a.startswith("b.example") for a in asked) and one.rdd.getNumPartitions() == 3
        assert pages.filter("host IN ('a.example', 'c.example') AND status = 200").count() == 10
        assert pages.filter("host = 'nowhere.example'").count() == 0
        assert not any(a.startswith("nowhere") for a in asked) and len(asked) == 15
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_the_stream_takes_bounded_batches_and_fetches_nothing_twice(spark, server, tmp_path):
    port, asked = server
    feed, out, checkpoint = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    feed.mkdir()

    def put(name, paths, end="\n"):
        (tmp_path / "new").write_text("\n".join(p and f"http://{p}" for p in paths) + end)
        (tmp_path / "new").rename(feed / name)

    def pages(per_batch=4, **options):
        r = spark.readStream.format("stub_pages").option("port", port).option("path", str(feed)).option("progress", checkpoint + "-progress").option("urlsPerBatch", per_batch)
        return r.options(**options).load().select("url", "status", "host", F.col("body").cast("string").alias("body"))

    put("0001", [f"a.example/{i}" for i in range(6)])
    put("0002", ["b.example/0", "", "b.example/gone"], end="")
    put(".hidden", ["a.example/hidden"])
    first = write_once(pages(), out, checkpoint, paced=True).collect()
    assert sorted(r["url"] for r in first) == [f"http://a.example/{i}" for i in range(6)] + ["http://b.example/0", "http://b.example/gone"]
    taken = {b: sum(r["batch"] == b for r in first) for b in {r["batch"] for r in first}}
    assert max(taken.values()) <= 4 and len(taken) == 3
    n = len(asked)
    assert n == len(set(asked)) == 8
    # a restart fetches nothing again, and then only what is new, with a smaller bound too
    assert len(write_once(pages(), out, checkpoint, paced=True).collect()) == len(first) and len(asked) == n
    put("0003", [f"{h}.example/new{i}" for i in range(3) for h in "ab"])
    again = write_once(pages(per_batch=1), out, checkpoint, paced=True)
    assert again.count() == len(first) + 6 and len(asked) == len(set(asked)) == n + 6
    assert again.filter("status = 404").select("url").collect() == [("http://b.example/gone",)]
    # other hosts are passed over, for good
    put("0004", ["a.example/last", "b.example/last"])
    write_once(pages(hosts="B.example."), out, checkpoint, paced=True)
    assert asked[n + 6 :] == ["b.example/last"]


def test_a_failed_batch_is_planned_again(spark, server, tmp_path):
    port, _ = server
    feed, checkpoint, out = tmp_path / "feed", str(tmp_path / "checkpoint"), str(tmp_path / "out")
    feed.mkdir()
    (feed / "1").write_text("\n".join(f"http://a.example/{i}" for i in range(5)))
    pages = spark.readStream.format("stub_pages").option("port", port).option("path", str(feed)).option("progress", checkpoint + "-progress").option("urlsPerBatch", 2).load().select("url")

    def put(rows, batch):
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if batch == 1:
            raise RuntimeError("lost")

    query = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).start()
    with pytest.raises(Exception):
        query.processAllAvailable()
    got = write_once(pages, out, checkpoint, paced=True)
    assert sorted(tuple(r) for r in got.select("batch", "url").collect()) == [(i // 2, f"http://a.example/{i}") for i in range(5)]


def test_options_are_checked(tmp_path):
    for options in ({"path": str(tmp_path)}, {"path": str(tmp_path), "progress": str(tmp_path), "urlsPerBatch": "0"}):
        with pytest.raises(ValueError):
            web.WebStreamReader(options, web.fetch)

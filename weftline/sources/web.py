"""A data source of pages: stored responses on disk by default, a live fetcher where a network exists.

Every hop of a fetch is checked before it is made: the address by the URL policy, its host's name and all addresses that
the resolver gives by the rules of ``functions/urls.py``. The connection goes to one of the addresses checked, the name is
not resolved again. The transport never follows a redirect by itself.

As a stream the source follows a folder of address files, a bounded number of addresses to a micro-batch.
"""

from __future__ import annotations

import http.client
import json
import os
import socket
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urljoin, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "url string, status int, content_type string, content_encoding string, body binary, final_url string, error string, host string, duration_ms double"
# What every request sends, and which statuses lead on.
HEADERS = {"User-Agent": "weftline/1", "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.5", "Accept-Encoding": "gzip, deflate"}
REDIRECTS = (301, 302, 303, 307, 308)


class Refused(Exception):
    """A hop that the policy does not allow."""


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def resolve(host: str) -> list[str]:
    return sorted({a[4][0] for a in socket.getaddrinfo(host, None, proto=socket.IPPROTO_TCP)})


def host_of(url: str | None) -> str | None:
    """The host as the column ``host`` has it: lower case, without the trailing dots; null where there is none."""
    try:
        return (urlsplit(url or "").hostname or "").rstrip(".").lower() or None
    except ValueError:
        return None


def check(url: str, addresses: Callable[[str], list[str]] = resolve) -> list[str]:
    """The addresses of a URL's host; raises ``Refused`` for what must not be fetched: scheme, credentials, blocked names, blocked or missing addresses."""
    from weftline.config import BLOCKED_HOSTS, BLOCKED_SUFFIXES
    from weftline.functions.urls import blocked_address

    parts = urlsplit(url)
    host = (parts.hostname or "").rstrip(".").lower()
    if parts.scheme not in ("http", "https") or not host:
        raise Refused("Invalid URL format")
    if parts.username is not None or parts.password is not None:
        raise Refused("URLs with embedded credentials are not allowed")
    if host in BLOCKED_HOSTS or host.endswith(tuple(BLOCKED_SUFFIXES)) or blocked_address(host):
        raise Refused("EBLOCKED: blocked host")
    try:
        found = addresses(host)
    except OSError as e:
        raise Refused("ENODATA: no address") from e
    if not found:
        raise Refused("ENODATA: no address")
    if any(blocked_address(a) for a in found):
        raise Refused("EBLOCKED: blocked address")
    return found


def opener(found: list[str], dial: Callable = socket.create_connection) -> Callable:
    """An ``open`` whose connections go to the addresses ``found``, in turn until one answers; names, certificates and Host stay the URL's."""

    def dialled(connection) -> socket.socket:
        for address in found[:-1]:
            try:
                return dial((address, connection.port), connection.timeout)
            except OSError:
                continue
        return dial((found[-1], connection.port), connection.timeout)

    class Http(http.client.HTTPConnection):
        def connect(self):
            self.sock = dialled(self)

    class Https(http.client.HTTPSConnection):
        def connect(self):
            self.sock = ssl.create_default_context().wrap_socket(dialled(self), server_hostname=self.host)

    class Plain(urllib.request.HTTPHandler):
        def http_open(self, request):
            return self.do_open(Http, request)

    class Secure(urllib.request.HTTPSHandler):
        def https_open(self, request):
            return self.do_open(Https, request)

    return urllib.request.build_opener(urllib.request.ProxyHandler({}), _Stay, Plain, Secure).open


def fetch(url: str, timeout: float = 15, limit: int = 10 * 1024 * 1024, hops: int = 5, addresses: Callable[[str], list[str]] = resolve, open_: Callable | None = None, dial: Callable = socket.create_connection) -> tuple:
    """A row of SCHEMA: one GET through at most ``hops`` checked redirects; whatever goes wrong is a row with ``error``. ``duration_ms`` counts all hops, with their checks."""
    at, host, start = url, host_of(url), time.perf_counter()
    spent = lambda: round((time.perf_counter() - start) * 1000, 3)
    try:
        for _ in range(hops + 1):
            found = check(at, addresses)
            try:
                r = (open_ or opener(found, dial))(urllib.request.Request(at, headers=HEADERS), timeout=timeout)
            except urllib.error.HTTPError as e:
                r = e
            with r:
                if r.status in REDIRECTS:
                    target = r.headers.get("Location")
                    if not target:
                        raise Refused("Redirect response missing Location header")
                    at = urljoin(at, target)
                    continue
                return (url, r.status, r.headers.get("Content-Type"), r.headers.get("Content-Encoding"), r.read(limit + 1), at, None, host, spent())
        raise Refused("Too many redirects")
    except Refused as e:
        return (url, None, None, None, None, at, str(e), host, spent())
    except TimeoutError:
        return (url, None, None, None, None, at, "Request timeout", host, spent())
    except Exception as e:
        return (url, None, None, None, None, at, f"Network error: {type(e).__name__}: {e}"[:300], host, spent())


class Chunk(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def by_host(urls: Iterable[str], most: int) -> list[Chunk]:
    """Partitions of one host's addresses each, at most ``most`` to a partition, so that a frequent host is dealt over several."""
    hosts: dict[str | None, list[str]] = {}
    for url in urls:
        hosts.setdefault(host_of(url), []).append(url)
    return [Chunk(held[i : i + most]) for held in hosts.values() for i in range(0, len(held), most)]


class WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str], get: Callable[[str], tuple]):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.per_partition = int(options.get("urlsPerPartition", "64"))
        self.get = get

    def partitions(self) -> list[Chunk]:
        return by_host(self.urls, self.per_partition) or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        return map(self.get, partition.urls)


class PrunedWebReader(WebReader):
    """Filters on ``host`` (equal to one, or one of a list) keep other hosts' addresses from becoming partitions. Spark takes such a reader only with ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("host",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.urls = [u for u in self.urls if host_of(u) in wanted - {None}]
            else:
                yield f


class WebStreamReader(DataSourceStreamReader):
    """The addresses of the files in a folder, a line each, by file name.

    Files come whole (moved in) and under names that sort after those there; other lines than the new ones are not read
    again. An offset is a file and the number of its lines taken. A micro-batch takes at most ``urlsPerBatch`` addresses,
    which is all that the driver holds. Spark asks for the next offset without telling the last one, so the end of each
    planned micro-batch is kept under ``progress``, a folder for this stream alone (beside its checkpoint).
    """

    def __init__(self, options: dict[str, str], get: Callable[[str], tuple]):
        from pyarrow import fs

        for name in ("path", "progress"):
            if not options.get(name):
                raise ValueError(f"web_pages as a stream needs the option {name}")
        self.files, self.folder = fs.FileSystem.from_uri(_uri(options["path"]))
        self.store, self.progress = fs.FileSystem.from_uri(_uri(options["progress"]))
        self.per_batch = int(options.get("urlsPerBatch", "10000"))
        self.per_partition = int(options.get("urlsPerPartition", "64"))
        if min(self.per_batch, self.per_partition) < 1:
            raise ValueError("urlsPerBatch and urlsPerPartition are at least 1")
        self.hosts = {h.strip().rstrip(".").lower() for h in options.get("hosts", "").split(",") if h.strip()}
        self.get = get

    def initialOffset(self) -> dict:
        return {"file": "", "line": 0}

    def latestOffset(self) -> dict:
        at = self._planned()
        for n, (file, line, _) in enumerate(self._lines(at)):
            if n == self.per_batch:
                break
            at = {"file": file, "line": line}
        return at

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        self._keep(end)
        last = (end["file"], end["line"])
        urls = []
        for file, line, url in self._lines(start):
            if (file, line) > last:
                break
            if url and (not self.hosts or host_of(url) in self.hosts):
                urls.append(url)
        return by_host(urls, self.per_partition) or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        return map(self.get, partition.urls)

    def _lines(self, at: dict) -> Iterator[tuple[str, int, str]]:
        """(file, number from 1, line) of all lines after an offset, in order."""
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(self.folder))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name >= at["file"] and f.base_name[0] not in "._")
        for name in names:
            with self.files.open_input_stream(f"{self.folder}/{name}") as f:
                rest = b""
                line = 0
                for block in iter(lambda: f.read(1 << 20), b""):  # noqa: B023
                    *whole, rest = (rest + block).split(b"\n")
                    for text in whole:
                        line += 1
                        if name > at["file"] or line > at["line"]:
                            yield name, line, text.decode("utf-8", "replace").strip()
                if rest and (name > at["file"] or line + 1 > at["line"]):
                    yield name, line + 1, rest.decode("utf-8", "replace").strip()

    def _planned(self) -> dict:
        from pyarrow import fs

        if self.store.get_file_info(f"{self.progress}/planned").type != fs.FileType.File:
            return self.initialOffset()
        with self.store.open_input_stream(f"{self.progress}/planned") as f:
            return json.loads(f.read())

    def _keep(self, end: dict) -> None:
        """Spark plans a micro-batch again after a failure, before it asks for a later offset; an end is never moved back."""
        planned = self._planned()
        if (end["file"], end["line"]) <= (planned["file"], planned["line"]):
            return
        self.store.create_dir(self.progress)
        with self.store.open_output_stream(f"{self.progress}/planned.new") as f:
            f.write(json.dumps(end).encode())
        self.store.move(f"{self.progress}/planned.new", f"{self.progress}/planned")


def _uri(path: str) -> str:
    return path.rstrip("/") if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))


def fetch_pages(urls, timeout: float = 15, limit: int = 10 * 1024 * 1024, hops: int = 5):
    """The same for a table of addresses (url) of any size: fetched where its partitions are, nothing on the driver."""
    import pyarrow as pa

    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.float64())
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(stream):
        for batch in stream:
            for url in batch.column(0).to_pylist():
                row = fetch(url or "", timeout, limit, hops)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return urls.select("url").mapInArrow(run, SCHEMA)


class WebPages(DataSource):
    """``spark.dataSource.register(WebPages)``, then ``spark.read.format("web_pages").option("urls", "\\n".join(urls))``; ``fetch_pages`` takes a table.

    As a stream: ``spark.readStream.format("web_pages").option("path", folder).option("progress", folder_of_its_own)``, with
    ``urlsPerBatch``, ``urlsPerPartition`` and ``hosts`` (separated by commas; other hosts are passed over). For all:
    ``timeoutSeconds``, ``maxBytes``, ``maxRedirects``. With ``pushFilters`` true, filters on ``host`` reach
    the batch source, which needs ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def getter(self) -> Callable[[str], tuple]:
        o = self.options
        timeout, limit, hops = float(o.get("timeoutSeconds", "15")), int(o.get("maxBytes", str(10 * 1024 * 1024))), int(o.get("maxRedirects", "5"))
        return lambda url: fetch(url, timeout, limit, hops)

    def reader(self, schema) -> WebReader:
        kind = PrunedWebReader if self.options.get("pushFilters", "false").lower() == "true" else WebReader
        return kind(self.options, self.getter())

    def streamReader(self, schema) -> WebStreamReader:
        return WebStreamReader(self.options, self.getter())

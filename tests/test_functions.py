"""Operators on single cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.config import MARKER, NoiseConfig
from weftline.functions import codelang, dom, encoding, markdown, noise, render, urls
from weftline.functions.article import content_root, sentences_cut
from weftline.functions.dom import parse
from weftline.functions.metadata import early_metadata, extract_metadata, favicon, merge_metadata
from weftline.functions.noise import strip_noise
from weftline.functions.render import image_source, inline_code, to_html
from weftline.operators import cache, nodes, pages, tasks
from weftline.operators.pages import html_to_markdown, transform_page
from weftline.streaming import state


def test_parser_ends_what_html_ends():
    root = parse("<p>a<p>b<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table><script>var t='</p>';</script><br/>t &amp; &copy;")
    assert [n.tag for n in root.elements()] == ["p", "p", "ul", "li", "li", "table", "tr", "td", "td", "tr", "td", "script", "br"]
    assert root.find("script").children == ["var t='</p>';"]
    assert root.text().endswith("t & ©")
    assert to_html(parse('<a href="x&amp;y">b</a>')) == '<a href="x&amp;y">b</a>'


@pytest.mark.parametrize("html", ["", "<", "<<a", "<a href='", "</p></b>", "<!-- open", "<![CDATA[x]]>", "<p " * 50, "a\x00b", "<b>" * 3000])
def test_parser_takes_anything(html):
    parse(html)
    html_to_markdown(html)


@pytest.mark.parametrize(
    "html, has, lacks",
    [
        ("<body><p>Keep me</p><nav>NAVTEXT</nav><footer>FOOTER</footer><div hidden>HIDDEN</div><div class=promo>PROMO</div><div class=fixed>FIXED</div></body>", ["Keep me", "PROMO", "FIXED"], ["NAVTEXT", "FOOTER", "HIDDEN"]),
        ("<header class=site-header>SITEHEADER</header><header class=article-header><h1>Article Title</h1></header><p>Body text</p>", ["Article Title", "Body text"], ["SITEHEADER"]),
        ("<ul><li>Parent<ul><li>Child<ul><li>Grandchild</li></ul></li></ul></li></ul>", ["- Parent", "    - Child", "        - Grandchild"], []),
        ("<p>Overview</p>", ["Overview"], ["## Overview"]),
        ("<nav><article>INSIDE</article></nav><nav><a href=x>LINKS</a></nav>", ["INSIDE"], ["LINKS"]),
        ("<div role=dialog>short<button>b</button></div><main><div role=dialog>in main</div></main><div role=alertdialog><h2>Hd</h2></div>", ["in main", "Hd"], ["short"]),
        ('<pre><code class="language-js">a = 1</code></pre><pre data-language="bash"><code>ls</code></pre>', ["```js\na = 1\n```", "```bash\nls\n```"], []),
        ("<div class='admonition warning'>W</div><dl><dt>T</dt><dd>D</dd></dl>", ["> [!WARNING]\n> W", "**T**\n: D"], []),
        ("<table><tr><th>A</th></tr><tr><td>1|2</td></tr></table>", ["| A |", "| 1\\|2 |"], []),
        ("<table><tr><td colspan=2>A</td></tr></table>", ["A"], ["|"]),
        ("<p>/* gone */ text `/* kept */`</p>", ["text"], ["gone"]),
    ],
)
def test_html_to_markdown(html, has, lacks):
    text = html_to_markdown(html)
    assert all(x in text for x in has), text
    assert not any(x in text for x in lacks), text


def test_links_and_images():
    text = html_to_markdown('<p><a href="/wiki/Foo_(bar)">x</a></p><img src="my-diagram.png"><img src="data:a" data-src="/b.png">', "https://e.com/p")
    assert "[x](https://e.com/wiki/Foo_(bar))" in text and "![my diagram](https://e.com/my-diagram.png)" in text and "](https://e.com/b.png)" in text
    assert image_source(parse("<img src='data:x'>").find("img")) == "[data URI removed]"
    assert image_source(parse("<img data-srcset='a.png 1x, b.png 2x'>").find("img")) == "a.png"
    assert inline_code("a`b") == "``a`b``" and inline_code("`a") == "`` `a ``" and inline_code(" ") == "``"


def test_late_noise_and_options():
    assert "LATE" not in html_to_markdown("<p>Main content</p>" + "<p>f</p>" * 12_000 + "<nav>LATE</nav>")
    assert "KEEP" in to_html(strip_noise(parse("<main><div class='related fixed'>KEEP</div></main>"), NoiseConfig(aggressive=True)))
    assert "GONE" not in to_html(strip_noise(parse("<p>x</p><div class='related fixed'>GONE</div>"), NoiseConfig(aggressive=True)))
    assert "X" not in to_html(strip_noise(parse("<div class=own>X</div>"), NoiseConfig(extra_selectors=("div.own",))))


def test_metadata():
    found = extract_metadata(parse("<title>T</title><meta property='og:title' content=' OG '><meta name='twitter:title' content='TW'><meta name=author content=A><link rel=icon sizes=32x32 href='assets/i.png'>"), "https://e.com/p/")
    assert (found["title"], found["author"], found["favicon"]) == ("OG", "A", "https://e.com/p/assets/i.png")
    assert favicon("data:x", "https://e.com") is None
    assert early_metadata("<head><title>E</title></head><body>")["title"] == "E" and early_metadata("no head") is None
    assert merge_metadata({"title": "E", "favicon": "f"} | dict.fromkeys(("description", "author", "image", "published_at", "modified_at")), dict.fromkeys(("title", "description", "author", "image", "favicon", "published_at", "modified_at")))["favicon"] is None


def test_page_sources():
    words = "<p>" + "Some words, that say a thing. " * 20 + "</p>"
    assert transform_page(f"<body><article>{words}</article></body>", "https://e.com/")["content_source"] == "article"
    assert transform_page("<body><p>short</p></body>", "https://e.com/")["content_source"] == "body"
    assert transform_page("<body><div id=content>" + "<p>short one</p>" * 20 + "</div></body>", "https://e.com/")["content_source"] in ("root", "article")
    assert transform_page("<html><body><p>Hello</p>", "https://e.com/", truncated=True)["markdown"].endswith(MARKER)
    assert content_root(parse("<main>x</main>")) is None
    assert sentences_cut("\n".join(["a line that has no end at all"] * 4)) and not sentences_cut("one line only without an end")


def test_bad_pages_are_rows(spark):
    rows = [(1, "https://e.com/a", "<p>x</p>"), (2, "ftp://e.com", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "https://e.com/d", None), (5, "https://e.com/e", "a\x00b"), (6, "https://e.com/f.md", "# T\n[a](b)")]
    out = {r["page_id"]: r for r in pages.transform_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1]["error"] is None and out[6]["content_source"] == "raw" and "Source: https://e.com/f.md" in out[6]["markdown"]
    assert [out[i]["error"]["status_code"] for i in (2, 3, 4, 5)] == [400, 400, 400, 415]
    assert pages.transform_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_truncation(spark):
    truncate = lambda text, limit: spark.createDataFrame([(text,)], "t string").select(markdown.truncate_markdown("t", limit)).first()[0]
    assert truncate("short", 100) == "short" and truncate("x" * 50, 0) == "x" * 50
    cut = truncate("```\n" + "a\n" * 200, 100)
    assert cut.endswith("```\n" + MARKER) and len(cut) <= 100
    assert truncate("~~~\n" + "a\n" * 200, 100).endswith("~~~\n" + MARKER)
    assert truncate("a" * 60 + " [link](https://e.com/" + "b" * 80 + ")", 100) == "a" * 60 + " " + MARKER


def test_encodings(spark):
    assert encoding.decode_bytes(b"caf\xe9", "windows-1252") == "café" and encoding.decode_bytes(b"\xe9", "nope") == "�"
    assert encoding.decode_bytes(b"\xff\xfeH\x00i\x00", "utf-16le") == "Hi"
    import gzip
    import zlib

    assert encoding.content_decode(zlib.compress(gzip.compress(b"hello")), "gzip, deflate") == (b"hello", None)
    assert encoding.content_decode(b"abcd", "zip")[1] == "unsupported_content_encoding" and encoding.content_decode(b"abcd", "gzip") == (b"abcd", None)
    df = spark.createDataFrame([("aé<b",), ("ééé",), ("",), (None,)], "h string")
    got = [r[0] for r in df.select(encoding.truncate_html(F.col("h"), 2)).collect()]
    assert got == ["a", "é", "", None]


def test_addresses_and_languages():
    assert [urls.blocked_address(x) for x in ("10.0.0.1", "::1", "::ffff:10.0.0.1", "fe80::1%eth0", "8.8.8.8", None, "")] == [True, True, True, True, False, False, False]
    assert codelang.language_of("SELECT 1;") == "sql" and codelang.language_of(" ") is None
    assert codelang.language_from_attributes("language-ts", "x") == "ts"


def test_cache(spark):
    assert cache.stable_json({"b": 1, "a": [{"d": None, "c": "x"}]}) == '{"a":[{"c":"x","d":null}],"b":1}'
    with pytest.raises(ValueError):
        deep: dict = {}
        for _ in range(25):
            deep = {"a": deep}
        cache.stable_json(deep)
    df = spark.createDataFrame([("n", "u", None), ("n", "u", "v"), ("", "u", None)], "n string, u string, v string")
    keys = [r[0] for r in df.select(cache.cache_key(F.col("n"), F.col("u"), F.col("v"))).collect()]
    assert keys[0] != keys[1] and keys[1].startswith(keys[0] + ".") and keys[2] is None


def test_tasks_and_state(spark):
    now = F.lit(dt.datetime(2026, 1, 1, 0, 1, 30))
    t = spark.createDataFrame([(1, dt.datetime(2026, 1, 1), 1), (2, dt.datetime(2026, 1, 1), 100_000), (3, dt.datetime(2026, 1, 1), None)], "task_id int, created_at timestamp, ttl_ms long")
    assert [r["task_id"] for r in tasks.live(t, now).collect()] == [2]
    both = tasks.cancel_owner(spark.createDataFrame([("a", "working"), ("a", "failed"), ("b", "working")], "owner_key string, status string"), "a")
    assert sorted(r["status"] for r in both.collect()) == ["cancelled", "failed", "working"]
    e = spark.createDataFrame([(i, 7, dt.datetime(2026, 1, 1, 0, 0, 0, i * 1000)) for i in range(101)], "event_id long, user_id long, ts timestamp")
    got = state.rate_limit(e)
    assert got.filter("NOT allowed").count() == 1 and state.rate_limit(e.limit(0)).count() == 0


def test_streams(spark, tmp_path):
    rows = [("a", dt.datetime(2026, 1, 1, 0, 0, s)) for s in (0, 1, 2)] + [("b", dt.datetime(2026, 1, 1, 0, 5))]
    spark.createDataFrame(rows, "key string, ts timestamp").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = state.rate_limit_stream(source, limit=2).writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["key"], r["position"], r["allowed"]) for r in spark.table("rates").collect()) == [("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, True)]


def test_nodes(spark):
    n = nodes.html_nodes(spark.createDataFrame([(1, "<main><p>a<b>c</b></p></main><nav><p>n</p></nav>"), (2, None)], "page_id long, html string"))
    assert {r["tag"] for r in nodes.primary_content(n).filter("kind = 'element'").collect()} == {"main", "p", "b"}
    assert nodes.without(n, n.filter("tag = 'nav'")).filter("tag = 'p'").count() == 1
    assert {r["page_id"]: r["text"] for r in nodes.visible_text(n).collect()} == {1: "acn"}


def test_web_source(spark):
    from weftline.sources.web import WebPages, fetch_pages

    spark.dataSource.register(WebPages)
    got = spark.read.format("web_pages").option("urls", "http://10.0.0.1/\nftp://x").load().collect()
    assert [r["error"] for r in got] == ["EBLOCKED: blocked host", "Invalid URL format"]
    table = spark.createDataFrame([("http://192.168.0.1/a", 1), (None, 2), ("http://u:p@e.com", 3)], "url string, x int").repartition(2)
    assert {(r["url"], r["error"]) for r in fetch_pages(table).collect()} == {("http://192.168.0.1/a", "EBLOCKED: blocked host"), ("", "Invalid URL format"), ("http://u:p@e.com", "URLs with embedded credentials are not allowed")}


class Reply:
    """A stored answer of a server."""

    def __init__(self, status, headers=None, body=b""):
        self.status, self.headers, self.body = status, headers or {}, body

    def read(self, n):
        return self.body[:n]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


HOPS = [
    ({"http://a.example/": Reply(301, {"Location": "/b"}), "http://a.example/b": Reply(200, {"Content-Type": "text/html"}, b"<p>x")}, "http://a.example/b", None),
    ({"http://a.example/": Reply(302, {"Location": "http://169.254.169.254/latest"})}, "http://169.254.169.254/latest", "EBLOCKED: blocked host"),
    ({"http://a.example/": Reply(302, {"Location": "http://inner.example/"})}, "http://inner.example/", "EBLOCKED: blocked address"),
    ({"http://a.example/": Reply(302, {"Location": "http://gone.example/"})}, "http://gone.example/", "ENODATA: no address"),
    ({"http://a.example/": Reply(302, {"Location": "http://u:p@a.example/"})}, "http://u:p@a.example/", "URLs with embedded credentials are not allowed"),
    ({"http://a.example/": Reply(307, {})}, "http://a.example/", "Redirect response missing Location header"),
    ({"http://a.example/": Reply(308, {"Location": "/"})}, "http://a.example/", "Too many redirects"),
]


@pytest.mark.parametrize("replies, final, error", HOPS)
def test_every_hop_is_checked(replies, final, error):
    from weftline.sources.web import fetch

    asked = []
    names = {"a.example": ["93.184.216.34"], "inner.example": ["93.184.216.34", "10.1.2.3"], "gone.example": []}

    def opened(request, timeout):
        asked.append(request.full_url)
        return replies[request.full_url]

    row = fetch("http://a.example/", addresses=names.__getitem__, open_=opened)
    assert (row[5], row[6]) == (final, error) and (row[4] == b"<p>x") == (error is None)
    assert len(asked) <= 6 and not any("169.254" in a or "inner" in a for a in asked)


def test_inflating_stops_at_the_limit():
    import gzip
    import zlib

    bomb = gzip.compress(b"a" * 50_000_000)
    assert len(encoding.content_decode(bomb, "gzip", 1000)[0]) == 1000 and len(encoding.content_decode(gzip.compress(bomb), "gzip, gzip", 60_000)[0]) == 60_000
    raw = b"text " * 100
    flat = zlib.compressobj(wbits=-15)
    for body, coding in ((gzip.compress(raw), "x-gzip"), (zlib.compress(raw), "deflate"), (flat.compress(raw) + flat.flush(), "deflate"), (gzip.compress(raw[:200]) + gzip.compress(raw[200:]), "gzip"), (zlib.compress(gzip.compress(raw)), "gzip, deflate")):
        assert encoding.content_decode(body, coding) == (raw, None)
    assert encoding.content_decode(b"no gzip", "gzip") == (b"no gzip", None) and encoding.content_decode(b"x", "br")[1] == "unsupported_content_encoding"


def test_sql_functions(spark):
    from weftline.plans.sql import register

    register(spark)
    r = spark.sql("SELECT is_blocked_ip('10.1.1.1') a, html_to_markdown('<p>x <b>y</b></p>', '') b, cache_key('n', 'u') c, detect_code_language('SELECT 1;') d, truncate_markdown('abc', 0) e").first()
    assert (r["a"], r["b"], r["d"], r["e"]) == (True, "x **y**", "sql", "abc") and r["c"].startswith("n:")
    assert spark.sql("SELECT tag FROM html_nodes('<p>a<b>c</b></p>') WHERE kind = 'element'").count() == 2
    r = spark.sql("SELECT strip_noise('<body><nav>n</nav><p>x</p></body>') a, extract_content('<p>short</p>') b, detect_encoding(X'FFFE6100', '') c, detect_encoding(encode('<meta charset=KOI8-R>', 'UTF-8'), 'text/html') d").first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ("<p>x</p>", None, "utf-16le", "koi8-r")
    page = "<body><article><h1>T</h1>" + "<p>Some words, and more words follow them here, line by line.</p>" * 12 + "</article></body>"
    assert spark.createDataFrame([(page,)], "h string").selectExpr("extract_content(h) AS m").first()["m"].startswith("# T\n\nSome words,")


def test_sql_functions_are_the_expressions(spark):
    """What SQL and UDFs say of an address, a body, a file name or code is what the expressions say."""
    from weftline.plans.queries import FORGE, SNIPPETS, SPARK_WORD, FILES, choose, worded
    from weftline.plans.sql import register

    register(spark)
    p = spark.range(200).selectExpr("id AS page_id", "id AS doc_id", "concat(if(id % 2 = 0, 'http', 'https'), '://Host.example', if(id % 5 = 0, ':80', ''), '/en/', id, if(id % 3 = 0, '?q=1#f', '.html')) AS url", "concat('word', id, ' text') AS text", "'en' AS lang", "'<p>x' AS html")
    u, c = F.expr(choose("page_id", [f[0] for f in FORGE])), F.expr(worded(choose("doc_id", [s[0] for s in SNIPPETS]), SPARK_WORD))
    name, title = F.expr(choose("page_id", [f[0] for f in FILES])), F.expr(choose("page_id", [f[1] for f in FILES]))
    rows = p.select(u.alias("u"), c.alias("c"), name.alias("name"), title.alias("title"), F.sha2("url", 256).alias("h"), F.encode(F.concat(F.lit("<meta charset='x-"), "page_id", F.lit("'>")), "UTF-8").alias("body"))
    both = rows.selectExpr("*", "normalize_url(name) AS n1", "to_raw_url(u) AS r1", "detect_code_language(c) AS c1", "safe_filename(name, title, h) AS f1", "detect_encoding(body, '') AS e1")
    both = both.select("n1", "r1", "c1", "f1", "e1", urls.normalize_url(F.col("name")).alias("n2"), urls.to_raw_url(F.col("u")).alias("r2"), codelang.detect_code_language(F.col("c")).alias("c2"), cache.safe_filename(F.col("name"), F.col("title"), F.col("h")).alias("f2"), encoding.resolve_charset(F.col("body"), F.lit("")).alias("e2"))
    for r in both.collect():
        assert all(r[k + "1"] == r[k + "2"] for k in "nrcfe"), r


def test_result_shapes(spark):
    from weftline.operators import results

    rows = pages.transform_pages(spark.createDataFrame([(1, "https://e.com/a", "<title></title><p>x</p>")], "page_id long, url string, html string"))
    text = results.structured(rows).first()["structured"]
    assert '"markdown":' in text and '"title"' not in text
    blocks = rows.select(results.content_blocks(F.col("markdown"), F.lit("u"), F.lit("t"), True).alias("b")).first()["b"]
    assert [b["type"] for b in blocks] == ["text", "resource", "resource_link"]


def test_cache_replay(spark):
    ops = [("n", i, "set", f"k{i}", 1, i) for i in range(101)] + [("n", 101, "get", "k0", 0, 101), ("n", 102, "get", "k1", 0, 102), ("n", 103, "get", "k1", 0, 86_400_001), ("n", 104, "set", "x", 0, 104), ("n", 105, "set", "big", 99, 105)]
    got = {r["seq"]: r for r in cache.replay(spark.createDataFrame(ops, "namespace string, seq long, op string, key string, units long, ts_ms long"), 100, 98).collect()}
    assert not got[101]["hit"] and not got[103]["hit"] and got[104]["evicted"] == 0 and got[105]["evicted"] == 0
    assert got[98]["evicted"] == 1 and max(r["size"] for r in got.values()) == 98


RULES = [
    ("## Setup\nRun it.", "## Setup\n\nRun it."),  # a gap after a heading
    ("## Setup\n\nRun it.", "## Setup\n\nRun it."),
    ("### Usage```sh", "### Usage\n\n```sh"),  # a fence glued to a heading
    ("# HTTPServer", "# HTTP\n\nServer"),  # camel case after capitals
    ("a /* b */ c `/* d */`", "a c `/* d */`"),  # comments, but not in code
    ("see [](#top) here", "see here"),  # empty anchors
    ("[Skip to main content](#x)\n\nText", "Text"),
    ("Text\n\nWas this page helpful?", "Text"),
    ("[one](u)[two](v)", "[one](u)\n\n[two](v)"),
    ("[one](u)and `f()`does", "[one](u) and `f()` does"),
    ("`key` \\- its value", "`key` - its value"),
    ("a\\[0\\] b\\.c", "a[0] b.c"),
    ("Shopping:\n- milk\n- eggs", "Shopping:\n\n- milk\n- eggs"),
    ("- a\n  - b\n     - c", "- a\n    - b\n     - c"),  # even indents double
    ("x\n\n\n\n\ny", "x\n\ny"),
    ('host: "a"port: "b"', 'host: "a"\n\nport: "b"'),
    ("~~~\na /* b */\n~~~", "~~~\na /* b */\n~~~"),  # fences stay
    ("Returns: **`int`**\n\nThe number.", "The number."),
]


@pytest.mark.parametrize("before, after", RULES)
def test_cleaning_rules(before, after):
    assert markdown.cleanup(before) == after


def test_completions_in_a_languages_order(spark):
    from weftline.operators.cache import complete

    words = ["Zebra", "zebra", "äpfel", "Apfel", "apfel", "École", "ecole", "eclair", "b1", "B1", "", None, "apfel"]
    frame = spark.createDataFrame([(w,) for w in words], "w string").repartition(3)
    got = lambda prefix, collation, most=100: [r["w"] for r in complete(frame, "w", prefix, most, collation).collect()]
    assert got("", "UNICODE_CI") == ["", "Apfel", "äpfel", "B1", "eclair", "ecole", "École", "Zebra"]
    assert got("", "UNICODE_CI_AI") == ["", "Apfel", "B1", "eclair", "ecole", "Zebra"]
    assert got("", "UNICODE") == ["", "apfel", "Apfel", "äpfel", "b1", "B1", "eclair", "ecole", "École", "zebra", "Zebra"]
    assert got("EC", "UNICODE_CI") == ["eclair", "ecole"] and got("EC", "UNICODE_CI_AI", 1) == ["eclair"] and got("é", "UNICODE_CI") == ["École"]
    assert got("%", "UNICODE_CI") == [] and complete(frame.limit(0), "w", "a", collation="UNICODE_CI").count() == 0
    with pytest.raises(ValueError, match="collation"):
        complete(frame, "w", "a", collation="x'y")


def _cut(text, limit, marker=MARKER):
    """The rules of truncation, step by step."""

    def open_fence(x):
        held = ""
        for line in x.split("\n"):
            bare = line.lstrip(" \t")
            n = len(bare) - len(bare.lstrip(bare[:1])) if bare[:1] in ("`", "~") else 0
            if n >= 3 and not held:
                held = bare[:n]
            elif n >= 3 and bare[0] == held[0] and n >= len(held):
                held = ""
        return held

    if limit <= 0 or len(text) <= limit:
        return text
    room = max(0, limit - len(marker))
    if not room:
        return marker[:limit]
    cut = text[:room]
    fence = open_fence(cut)
    if fence:
        cut = text[: max(0, room - len(fence) - 2)]
        return cut + (f"\n{fence}\n" if open_fence(cut) else "") + marker
    body, end = (cut[:-1], "\n") if cut.endswith("\n") else (cut, "")
    for i, c in enumerate(body):
        if c != "[":
            continue
        label, bracket, rest = body[i + 1 :].partition("]")
        target = not rest or rest[0] == "(" and ")" not in rest and "\n" not in rest
        if "\n" not in label and (not bracket or target):
            return body[: i - (i > 0 and body[i - 1] == "!")] + marker
    return body + end + marker


def test_truncation_by_brute_force(spark):
    import random

    from weftline.plans.sql import register

    rng = random.Random(7)
    parts = ["```", "````", "~~~", "`", "\n", "\n", " ", "[", "]", "(", ")", "!", "![a](b)", "word ", "é", "\r\n", "\u2028", "[x](y"]
    rows = [("".join(rng.choices(parts, k=rng.randint(0, 40))), rng.randint(-2, 70)) for _ in range(3000)] + [(None, 5), ("x" * 30, None)]
    register(spark)
    frame = spark.createDataFrame(rows, "t string, n int")
    got = frame.select("t", "n", markdown.truncate_markdown("t", "n").alias("a"), F.expr("truncate_markdown(t, n)").alias("b")).collect()
    for r in got:
        want = r["t"] if r["t"] is None or r["n"] is None else _cut(r["t"], r["n"])
        assert r["a"] == r["b"] == want, r


def test_elements_without_attributes_are_scored_by_name_alone(monkeypatch):
    """Of a plain table only elements that can be noise are looked at; the rest of the rules still hold."""
    calls = []
    score = noise.score
    monkeypatch.setattr(noise, "score", lambda n, c: calls.append(n.tag) or score(n, c))
    root = parse("<table><tr><td>a</td><td>b</td></tr></table><p>x<b>y</b></p>")
    noise.strip_noise(root)
    noise._noisy_tags(noise.NoiseConfig())
    calls.clear()
    assert to_html(noise.strip_noise(root)) == to_html(parse("<table><tr><td>a</td><td>b</td></tr></table><p>x<b>y</b></p>")) and not calls
    root = parse("<div><form>f</form><nav>n</nav><script>s</script><p hidden>h</p><p class='x'>k</p><i>i</i></div>")
    noise.strip_noise(root)
    assert to_html(root) == to_html(parse("<div><p class='x'>k</p><i>i</i></div>"))
    assert "p" in calls and "i" not in calls


def _shape(node):
    return node.tag, node.attrs, [c if isinstance(c, str) else _shape(c) for c in node.children]


def test_pages_of_simple_tags_are_cut_up_at_once_into_the_same_tree():
    simple = ["<h2>a &amp; b</h2><p>x<p>y<table><tr><td>1<td colspan=\"2\">2</table>z", "<head><b>x</b></head><body class=\"q\">t</br><li>1<li>2", "x&#x2<b>&#x2</b>&lt", "<ul><LI>a</b></LI></ul></p>", "no tag"]
    other = ["<p a='1'>x</p>", "<!-- <b> --><b>x</b>", "a < b", "<title>t</title>", "<td >x", "</p a=\"b\">x", "<p a=\"x>y\">z"]
    for html in simple:
        root, every = dom.parse_elements(html)
        assert dom._simple_tree(html) is not None and _shape(root) == _shape(dom._tree(html).root) and every == list(root.elements())
    for html in other:
        root, every = dom.parse_elements(html)
        assert dom._simple_tree(html) is None and every == list(root.elements())


def test_of_a_table_only_cells_and_caption_are_rendered(monkeypatch):
    seen = []
    element = render.Renderer.element
    monkeypatch.setattr(render.Renderer, "element", lambda self, node, done: seen.append(node.tag) or element(self, node, done))
    html = "<table><caption>c</caption><thead><tr><th>a</th></tr></thead><tbody><tr><td><b>1</b><table><tr><td>in</td></tr></table></td></tr></tbody></table><div><tr><td>out</td></tr></div>"
    assert render.to_markdown(dom.parse(html)) == "c\n\n| a |\n| --- |\n| **1**  \\| in \\| \\| --- \\| |\n| in |\n\nout"
    assert sorted(seen) == sorted("#document table caption th td b table td div tr td".split())

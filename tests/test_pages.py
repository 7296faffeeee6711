"""What passes through the page operators, failures' codes, and canonical JSON."""

import gzip
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from weftline.functions import encoding, urls
from weftline.functions.canonical import canonical_json
from weftline.operators import cache, pages, results

HTML = "<html><head><title>T</title></head><body><article><h1>T</h1><p>" + "Some words of a page. " * 20 + "</p></article></body></html>"


def test_input_columns_and_the_fetch_flag_pass(spark):
    rows = [(1, "https://example.org/a", HTML, True, "x", 5, ("n", [1])), (2, "https://example.org/b", HTML, None, None, 6, None), (3, "ftp://x", HTML, True, "y", 7, None), (4, "https://example.org/c", None, False, "z", 8, None)]
    schema = "page_id long, url string, html string, truncated boolean, `a.b` string, title long, nested struct<name:string,list:array<int>>"
    got = {r["page_id"]: r for r in pages.transform_pages(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i]["a.b"] for i in (1, 2, 3, 4)] == ["x", None, "y", "z"]
    assert got[1]["nested"] == ("n", [1]) and got[1]["title"] == "T"  # an input column of a result's name gives way
    assert [got[i]["truncated"] for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert got[1]["markdown"].count("truncated") == got[2]["markdown"].count("truncated") + 1
    assert pages.transform_pages(spark.createDataFrame(rows, schema).select("page_id", "url", "html")).columns == ["page_id", "url", *pages.RESULT]


def test_failure_codes(spark):
    want = {
        "HTTP 404: Not Found": ("HTTP_404", 404), "binary_content_detected": ("binary_content_detected", 415), "Detailed content type check failed: binary content detected": ("binary_content_detected", 500),
        "URL is required": ("VALIDATION_ERROR", 400), "Blocked host: localhost. Internal hosts are not allowed": ("VALIDATION_ERROR", 400), "Empty page": ("VALIDATION_ERROR", 400), "whatever": ("FETCH_ERROR", 502), "": ("FETCH_ERROR", 502),
    }
    rows = spark.createDataFrame([(m,) for m in want], "m string").select("m", results.failure(F.col("m")).alias("f")).collect()
    assert {r["m"]: (r["f"]["code"], r["f"]["status_code"]) for r in rows} == want


VALUES = [
    ({"b": [1, None], "a": {"z": "x", "é": 'q"\n\\'}}, {"k2": [{"y": True, "x": None}], "k1": []}),
    ({"b": [], "a": {}}, {}),
    (None, None),
]


def test_canonical_json_is_that_of_sorted_keys(spark):
    schema = T.StructType([
        T.StructField("s", T.StructType([T.StructField("b", T.ArrayType(T.IntegerType())), T.StructField("a", T.MapType(T.StringType(), T.StringType()))])),
        T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("y", T.BooleanType()), T.StructField("x", T.DoubleType())])))),
    ])
    frame = spark.createDataFrame(VALUES, schema).coalesce(1)
    got = [tuple(r) for r in frame.select(canonical_json(frame, "s"), canonical_json(frame, "m")).collect()]
    assert got == [tuple(json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for v in row) for row in VALUES]
    assert got == [tuple(cache.stable_json(v) for v in row) for row in VALUES]


def test_canonical_keys_do_not_depend_on_order(spark):
    frame = spark.sql("SELECT map('a', 1, 'b', 2) AS m, named_struct('x', 1, 'y', 2) AS s UNION ALL SELECT map('b', 2, 'a', 1), named_struct('x', 1, 'y', 2)")
    key = cache.cache_key(F.lit("n"), F.lit("u"), canonical_json(frame, "m"))
    assert frame.select(key).distinct().count() == 1
    other = spark.sql("SELECT named_struct('y', 2, 'x', 1) AS s")
    assert other.select(canonical_json(other, "s")).first() == frame.select(canonical_json(frame, "s")).first()


def test_canonical_json_bounds(spark):
    deep = "int"
    for _ in range(22):
        deep = f"array<{deep}>"
    frame = spark.createDataFrame([], f"v {deep}")
    with pytest.raises(ValueError):
        canonical_json(frame, "v")
    with pytest.raises(ValueError):
        twice = spark.sql("SELECT named_struct('a', 1, 'a', 2) AS v")
        canonical_json(twice, "v")


def test_a_plan_does_not_show_the_key(spark):
    import hashlib
    import hmac

    texts = ["", "x", "é" * 100, None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in (b"", b"a secret of its own", b"k" * 64, b"k" * 65):
        out = frame.select("t", cache.hmac_sha256(F.col("t"), key).alias("mac"))
        assert {r["t"]: r["mac"] for r in out.collect()} == {t: None if t is None else hmac.new(key, t.encode(), "sha256").hexdigest() for t in texts}
        plan = out._jdf.queryExecution().toString()
        assert not key or key.decode() not in plan and key.hex().upper() not in plan.upper()


def test_the_footer_is_the_articles_or_the_heads(spark):
    head = "<html><head><title>Head</title><meta name=author content='Of Head'><meta name=description content='About it'></head><body>"
    text = "<p>Some words, and more words follow them here, line by line.</p>" * 12
    rows = [
        (1, "https://example.org/1", f"{head}<article><h1>T</h1><p class=byline>By Line</p>{text}</article></body></html>"),
        (2, "https://example.org/2", f"{head}<article><h1>T</h1>{text}</article></body></html>"),
        (3, "https://example.org/3", f"{head}<p>short</p></body></html>"),
    ]
    out = pages.transform_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), fetched_at="2026-01-02 00:00:00")
    got = {r["page_id"]: (r["content_source"], r["markdown"].rsplit("---\n\n", 1)[1]) for r in out.collect()}
    link = lambda i: f"[_Original Source_](https://example.org/{i}) | _01/02/2026_"
    assert got == {1: ("article", f" _Head_ | _By Line_ | {link(1)}"), 2: ("article", f" _Head_ | {link(2)}"), 3: ("body", f" _Head_ | _Of Head_ | {link(3)}\n <sub>About it</sub>")}


def test_split_params(spark):
    want = {
        "https://e.com/a/b?q=1#f": ("https://e.com/a/b", "#f"), "HTTP://E.com:80": ("http://e.com/", ""), "https://u:p@e.com:8443/x#": ("https://e.com:8443/x", ""), "https://e.com/#a?b": ("https://e.com/", "#a?b"),
        "no url?x#y": ("no url", "#y"), "a#b?c": ("a", "#b?c"), "": ("", ""), "x#": ("x", "#"),
    }
    frame = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r["u"]: tuple(r["s"]) for r in frame.select("u", urls.split_params(F.col("u")).alias("s")).collect()} == want


def test_a_file_name_without_url_title_and_hash_has_the_time(spark):
    frame = spark.createDataFrame([(None, None, None), ("ftp://e.com/a", "", None), ("https://e.com/", "Title", None)], "u string, t string, h string")
    name = cache.safe_filename(F.col("u"), F.col("t"), F.col("h"), now=F.lit("1970-01-02 00:00:00").cast("timestamp"))
    assert [r[0] for r in frame.select(name).collect()] == ["download-86400000.md"] * 2 + ["title.md"]


def test_only_bodies_that_need_it_go_through_python(spark, monkeypatch):
    """Python gets coded bodies, and those that are not valid UTF-8; all come out as before."""
    bodies = [b"<p>\xc3\xa9</p>", b"\xef\xbb\xbf<p>b</p>", b"<p>\xe9</p>", b"<p>\xed\xa0\x80</p>", gzip.compress("<p>é</p>".encode()), None, b""]
    codings = ["identity", None, " Identity , ,identity", "", "gzip", "identity", ","]
    types = ["text/html; charset=utf-8", "text/html", "text/html; charset=latin-1", "text/html", "text/html; charset=UTF8", None, "text/html"]
    rows = [(i, "https://e.com/", 200, t, c, None if b is None else bytearray(b)) for i, (b, c, t) in enumerate(zip(bodies, codings, types))]
    seen = spark.sparkContext.accumulator(0)

    def content(values: pd.Series, codings: pd.Series) -> pd.DataFrame:
        seen.add(int(values.notna().sum()))
        return pd.DataFrame([encoding.content_decode(b, c) for b, c in zip(values, codings)], columns=["body", "error"])

    def html(values: pd.Series, labels: pd.Series) -> pd.Series:
        seen.add(int(values.notna().sum()))
        return pd.Series([encoding.decode_bytes(b, x) for b, x in zip(values, labels)])

    monkeypatch.setattr(encoding, "decode_content", F.pandas_udf(content, "body binary, error string"))
    monkeypatch.setattr(encoding, "decode_html", F.pandas_udf(html, "string"))
    frame = spark.createDataFrame(rows, "page_id long, url string, status int, content_type string, content_encoding string, body binary")
    got = [r["html"] for r in sorted(pages.transform_bodies(frame).collect(), key=lambda r: r["page_id"])]
    plain = [encoding.content_decode(b, c)[0] for b, c in zip(bodies, codings)]
    assert got == [encoding.decode_bytes(b, encoding.charset_of(b, t)) for b, t in zip(plain, types)]
    assert seen.value == 3  # the gzip body, and two that are no valid UTF-8

"""Stage durations, fetches and observed figures of real runs."""

import time

from pyspark.sql import Observation, functions as F

from weftline.operators import metrics, pages
from weftline.sources.web import SCHEMA

HTML = "<html><head><title>T</title></head><body><article><h1>T</h1><p>" + "Some words of a page. " * 20 + "</p></article></body></html>"
ROWS = [(i, f"https://u.example/{i}?token=x#f", HTML) for i in range(40)] + [(40, "ftp://x", HTML), (41, "https://u.example/b", None), (42, "https://u.example/readme.md", "# Raw\n\ntext"), (43, None, HTML)]


def results(spark, rows=ROWS, **kwargs):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    return pages.transform_pages(frame, fetched_at="2026-01-02 00:00:00", timed=True, **kwargs)


def test_stage_runs(spark):
    runs = metrics.stage_runs(results(spark)).collect()
    assert {(r["page_id"], r["stage"]) for r in runs} == {(i, s) for i in range(40) for s in pages.STAGES} and len(runs) == 40 * len(pages.STAGES)
    assert all(r["duration_ms"] >= 0 and not r["slow"] and r["url"] == f"https://u.example/{r['page_id']}" for r in runs)
    assert all(r["slow"] for r in metrics.stage_runs(results(spark), budget_ms=0).collect())


def test_a_row_for_each_stage_and_partition(spark):
    rows = metrics.stage_summary(results(spark), budget_ms=0).collect()
    parts = {r["partition"] for r in rows}
    assert len(parts) > 1 and len(rows) == len(parts) * len(pages.STAGES)
    assert sum(r["pages"] for r in rows) == 40 * len(pages.STAGES)
    assert all(r["slow"] and r["n_slow"] == r["pages"] and 0 <= r["max_ms"] <= r["total_ms"] for r in rows)


def test_timing_changes_no_result(spark):
    timed = results(spark)
    plain = pages.transform_pages(spark.createDataFrame(ROWS, "page_id long, url string, html string"), fetched_at="2026-01-02 00:00:00")
    assert timed.columns == [*plain.columns, *pages.TIMED]
    assert sorted(map(str, timed.drop(*pages.TIMED).collect())) == sorted(map(str, plain.collect()))
    named = spark.createDataFrame([(1, "https://u.example/", HTML, "mine")], "page_id long, url string, html string, stages string")
    assert pages.transform_pages(named).first()["stages"] == "mine"
    assert len(pages.transform_pages(named, timed=True).first()["stages"]) == len(pages.STAGES)


def test_empty_table(spark):
    assert metrics.stage_summary(results(spark, [])).count() == 0


def test_observed_in_a_job(spark, tmp_path):
    seen = Observation("run")
    metrics.observed(results(spark), seen).write.parquet(str(tmp_path / "out"))
    found = seen.get
    assert (found["pages"], found["failed"], found["slow"]) == (44, 3, 0)
    stored = metrics.stage_runs(spark.read.parquet(str(tmp_path / "out"))).groupBy("stage").agg(F.sum("duration_ms").alias("ms")).collect()
    assert all(abs(found[f"{r['stage']}_ms"] - r["ms"]) < 1e-6 for r in stored) and len(stored) == len(pages.STAGES)


def test_observed_in_a_stream(spark, tmp_path):
    schema = "page_id long, url string, html string"
    source = str(tmp_path / "pages")
    for _ in range(2):
        spark.createDataFrame(ROWS, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows = []
    listener = metrics.StageListener("pages", rows.append)
    spark.streams.addListener(listener)
    try:
        out = metrics.observed(pages.transform_pages(stream, timed=True), "pages")
        query = out.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        query.awaitTermination()
        deadline = time.time() + 20
        while sum(r["pages"] or 0 for r in rows) < 88 and time.time() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {r["batch"]: (r["pages"], r["failed"]) for r in rows if r["pages"]} == {0: (44, 3), 1: (44, 3)}
    assert all(r["parse_ms"] > 0 for r in rows if r["pages"])


def test_fetch_runs(spark):
    row = lambda url, status, error, ms: (url, status, None, None, None, url, error, None, ms)
    rows = spark.createDataFrame([row("https://u:p@e.com/a?k=1", 200, None, 5.0), row("https://e.com/b", 404, None, 5001.0), row("https://e.com/c", None, "Request timeout", 5000.0)], SCHEMA)
    got = [tuple(r) for r in metrics.fetch_runs(rows).collect()]
    assert got == [("https://e.com/a", "end", 200, None, 5.0, False), ("https://e.com/b", "error", 404, None, 5001.0, True), ("https://e.com/c", "error", None, "Request timeout", 5000.0, False)]

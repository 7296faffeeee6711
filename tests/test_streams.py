"""Streams run in several micro-batches, restarted and failing, against the batch results."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import tasks
from weftline.streaming import lifecycle, run, state

EVENTS = "task_id string, owner_key string, ts timestamp, status string, ttl_ms long"


def task_events(spark, seed, n=400):
    """Events of 60 tasks over three days, in order of time; some repeated."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        task = r.randrange(60)
        ms = task * 3_000_000 + r.randrange(40_000_000)
        rows.append((f"t{task}", f"o{task % 7}", ms, r.choice(["working", "working", "working", "completed", "failed", "cancelled"]), r.choice([None, 0, 10_000_000, 10**12])))
    rows += rows[:40]
    frame = spark.createDataFrame(sorted(rows, key=lambda x: (x[2], x[3])), "task_id string, owner_key string, ms long, status string, ttl_ms long")
    return frame.select("task_id", "owner_key", F.timestamp_millis("ms").alias("ts"), "status", "ttl_ms"), rows


def expected(rows, delay_ms):
    by = {}
    for task, owner, ms, status, ttl in set(rows):
        by.setdefault(task, []).append((ms, status, owner, ttl))
    end = max(x[2] for x in rows) - delay_ms
    return {t: (*(f := lifecycle.lifecycle(e))[:4], f[4] + 1 <= end) for t, e in by.items()}


def in_parts(spark, frame, folder, bounds):
    """``frame`` as Parquet files of consecutive times, one for each micro-batch."""
    edges = [None, *bounds, None]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        ms = F.unix_millis("ts")
        part = frame.filter((F.lit(True) if a is None else ms >= a) & (F.lit(True) if b is None else ms < b)).coalesce(1)
        part.write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not name.startswith("b"):
                os.rename(f"{folder}/{name}", f"{folder}/b{i}.parquet")
                os.utime(f"{folder}/b{i}.parquet", (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def as_tuples(frame):
    return {r["task_id"]: (r["owner_key"], r["status"], r["created_ms"], r["updated_ms"], r["expired"]) for r in lifecycle.latest(frame).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_task_stream_in_micro_batches(spark, tmp_path, seed):
    frame, rows = task_events(spark, seed)
    stream = in_parts(spark, frame, str(tmp_path / "in"), [60_000_000, 120_000_000])
    out = run.write_once(lifecycle.task_stream(stream, "10 hours"), str(tmp_path / "out"), str(tmp_path / "cp"), "update", lifecycle.PROVIDER)
    assert out.select("batch").distinct().count() >= 3
    want = expected(rows, 36_000_000)
    assert as_tuples(out) == want
    assert {True, False} == {x[-1] for x in want.values()}


def test_task_stream_without_expiry_is_the_task_table(spark, tmp_path):
    frame, _ = task_events(spark, 3)
    frame = frame.withColumn("ttl_ms", F.lit(10**12)).filter(F.unix_millis("ts") % 86_400_000 < 80_000_000)
    frame = frame.withColumn("task_id", F.concat("task_id", F.lit("-"), F.floor(F.unix_millis("ts") / 40_000_000))).dropDuplicates(["task_id", "ts"])
    stream = in_parts(spark, frame, str(tmp_path / "in"), [50_000_000, 100_000_000])
    out = run.write_once(lifecycle.task_stream(stream, "10 days"), str(tmp_path / "out"), str(tmp_path / "cp"), "update", lifecycle.PROVIDER)
    table = {r["task_id"]: (r["owner_key"], r["status"]) for r in tasks.states(frame).collect()}
    assert {k: v[:2] for k, v in as_tuples(out).items()} == table


def test_lifecycle_of_any_order():
    r = random.Random(2)
    events = [(1_000, "working", "o", 5_000), (2_000, "working", None, None), (4_000, "failed", "o", 1), (5_000, "completed", "o", 1), (6_001, "cancelled", "o", 1)]
    for _ in range(20):
        r.shuffle(events)
        assert lifecycle.lifecycle(events) == ("o", "failed", 1_000, 4_000, 6_000)
    assert lifecycle.lifecycle([(0, "working", None, None)]) == (None, "working", 0, 0, 60_000)


def changes(spark, folder):
    frame = spark.createDataFrame([(i, f"internal://cache/markdown/{i % 8:032x}", i) for i in range(60)], "n long, uri string, t long").withColumn("ts", F.timestamp_millis(F.col("t")))
    return frame, in_parts(spark, frame, folder, [20, 40])


def test_change_feed_repeats_nothing_after_a_failing_batch(spark, tmp_path, monkeypatch):
    frame, stream = changes(spark, str(tmp_path / "in"))
    subscriptions = frame.filter("n % 8 IN (1, 2)").select("uri")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    whole = sorted(r["n"] for r in state.changed_subscriptions(frame, subscriptions).collect())
    assert whole == [n for n in range(60) if n % 8 in (1, 2)]

    mode, failing = type(frame.write).mode, {"left": 1}

    def break_(self, how):
        writer = mode(self, how)
        put = writer.parquet

        def parquet(path, *a, **b):
            put(path, *a, **b)
            if path.endswith("batch=1") and failing["left"]:
                failing["left"] -= 1
                raise RuntimeError("lost after writing")

        writer.parquet = parquet
        return writer

    monkeypatch.setattr(type(frame.write), "mode", break_)
    with pytest.raises(Exception, match="lost after writing"):
        state.change_feed(stream, subscriptions, out, checkpoint)
    monkeypatch.undo()
    got = state.change_feed(stream, subscriptions, out, checkpoint)
    assert sorted(r["n"] for r in got.collect()) == whole
    assert got.select("batch").distinct().count() == 3
    again = state.change_feed(stream, subscriptions, out, checkpoint)  # nothing new
    assert sorted(r["n"] for r in again.collect()) == whole


def test_a_stream_of_nothing(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    stream = spark.readStream.schema("uri string").parquet(str(tmp_path / "in"))
    got = state.change_feed(stream, spark.createDataFrame([], "uri string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert got.collect() == [] and got.columns == ["uri", "batch"]


def test_task_stream_keeps_a_bounded_number_of_states(spark, tmp_path):
    fields = [F.col("id").cast("string").alias("task_id"), F.lit("o").alias("owner_key"), F.timestamp_millis(F.col("id") * 1000).alias("ts"), F.lit("working").alias("status"), F.lit(None).cast("long").alias("ttl_ms")]
    frame = spark.range(3000).select(*fields)
    stream = in_parts(spark, frame, str(tmp_path / "in"), [])
    with run.configured(spark, spark__sql__streaming__stateStore__providerClass=lifecycle.PROVIDER):
        query = lifecycle.task_stream(stream).writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators) <= 512

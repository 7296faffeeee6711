"""Session admission: hand-written courses, tenants, micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_streams import in_parts
from weftline.streaming import admission, lifecycle, run

REQUESTS = "tenant string, seq long, ms long, op string, session_id string"


def test_the_oldest_gives_way_and_reservations_count():
    s = admission.Sessions(2, 1_000)
    course = [
        (0, "reserve", "a", "admitted", None), (1, "reserve", "b", "admitted", None), (2, "reserve", "c", "refused", None),  # two in flight
        (3, "open", "a", "opened", None), (4, "reserve", "c", "refused", None),  # one open, one in flight: nothing to free
        (5, "open", "b", "opened", None), (6, "touch", "a", "touched", None), (7, "reserve", "c", "admitted", "b"),  # b is the oldest now
        (8, "touch", "b", "unknown", None), (9, "reserve", "d", "refused", None), (10, "open", "c", "opened", None), (11, "close", "a", "closed", None), (12, "close", "a", "unknown", None),
        (1_011, "touch", "c", "unknown", None), (1_012, "reserve", "e", "admitted", None),  # c has been idle too long
    ]
    for ms, op, session, *want in course:
        assert list(s.step(ms, op, session)) == want, (ms, op)
    none = admission.Sessions(0, 1_000)
    assert none.step(0, "reserve", "a") == ("refused", None)


def requests(seed, n=600):
    r = random.Random(seed)
    return [(r.choice(["x", "x", "y", None]), i, i * 10 + r.randrange(3), r.choice(admission.OPS), r.choice(["a", "b", "c", "d", "e", None])) for i in range(n)]


def plain(rows, most, idle):
    out, held = [], {}
    for tenant, seq, ms, op, session in sorted(rows, key=lambda x: (x[2], x[1])):
        out.append((tenant, seq, *held.setdefault(tenant, admission.Sessions(most, idle)).step(ms, op, session or "")))
    return sorted(out, key=lambda x: x[1])


def test_tenants_are_independent(spark):
    rows = requests(1)
    got = admission.admit(spark.createDataFrame(rows, REQUESTS).repartition(5), 3, 300)
    assert sorted(map(tuple, got.collect()), key=lambda x: x[1]) == plain(rows, 3, 300)
    assert {"refused", "admitted", "unknown"} <= {r["outcome"] for r in got.collect()} and got.filter("evicted IS NOT NULL").count() > 0
    assert admission.admit(spark.createDataFrame([], REQUESTS), 3).collect() == []
    with pytest.raises(Exception, match="not an operation"):
        admission.admit(spark.createDataFrame([("x", 1, 1, "other", "a")], REQUESTS), 3).collect()


def test_micro_batches_are_the_whole(spark, tmp_path):
    rows = requests(2)
    frame = spark.createDataFrame(rows, REQUESTS).withColumn("ts", F.timestamp_millis("ms"))
    stream = in_parts(spark, frame, str(tmp_path / "in"), [2_000, 4_000])
    out = run.write_once(admission.admit_stream(stream, 3, 300), str(tmp_path / "out"), str(tmp_path / "cp"), "append", lifecycle.PROVIDER)
    assert out.select("batch").distinct().count() == 3
    assert sorted(map(tuple, out.drop("batch").collect()), key=lambda x: x[1]) == plain(rows, 3, 300)

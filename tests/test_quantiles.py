"""Quantile sketches and exact quantiles against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import quantiles
from weftline.streaming import state


def values(kind, seed=0):
    r = random.Random(seed)
    return {
        "even": [r.random() for _ in range(3_000)], "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(2_000)], "ties": [r.choice([0.0, 1.5, -2.0]) for _ in range(1_000)],
        "one": [3.25], "two": [-1.0, 2.0], "same": [7.0] * 500, "lumps": [1e300] * 10 + [1.0 + i * 2**-52 for i in range(400)] + [-1e300], "tiny": [5e-324 * i for i in range(100)],
    }[kind]


KINDS = ["even", "wide", "ties", "one", "two", "same", "lumps", "tiny"]


@pytest.mark.parametrize("kind", KINDS)
def test_exact_quantiles(spark, kind):
    x = values(kind)
    rows = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double").repartition(3)
    shares = (0, 0.01, 0.5, 0.95, 0.999, 1)
    got = quantiles.exact_quantiles(rows, "x", shares, parts=16)
    ordered = sorted(x)
    for s, q in zip(shares, got):
        at = s * (len(x) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert q == low + (high - low) * (at - math.floor(at))


def test_no_values(spark):
    none = spark.createDataFrame([], "x double")
    assert quantiles.exact_quantiles(none, "x", (0.5,)) == [None]
    assert tuple(state.duration_stats(none, "x").first()) == (None,) * 7
    assert quantiles.sketch_quantiles(quantiles.sketch(none, [], "x"), [], (0.5,)).filter("n > 0").count() == 0


@pytest.mark.parametrize("accuracy", [0.01, 0.001])
def test_sketches_keep_their_bound_and_merge(spark, accuracy):
    rows = [(k, i % 5, v) for k in ("even", "wide", "ties", "one", "same") for i, v in enumerate(values(k, 4))]
    frame = spark.createDataFrame(rows + [("none", 0, None)], "k string, part int, x double").repartition(4)
    parts = quantiles.sketch(frame, ["k", "part"], "x", accuracy)
    shares = (0, 0.25, 0.5, 0.99, 1)
    whole = quantiles.sketch_quantiles(quantiles.merged(parts, ["k"]), ["k"], shares, accuracy)
    direct = quantiles.sketch_quantiles(quantiles.sketch(frame, ["k"], "x", accuracy), ["k"], shares, accuracy)
    got = {r["k"]: r for r in whole.collect()}
    assert sorted(map(str, got.values())) == sorted(map(str, direct.collect())) and "none" not in got
    for k in ("even", "wide", "ties", "one", "same"):
        ordered = sorted(values(k, 4))
        assert got[k]["n"] == len(ordered)
        for s, q in zip(shares, got[k]["quantiles"]):
            exact = ordered[math.floor(s * (len(ordered) - 1))]
            assert abs(q - exact) <= abs(exact) * accuracy * (1 + 1e-9)
    assert parts.filter("k = 'even'").count() < 5 * 12 / (2 * accuracy)  # bins, not rows


def test_infinities_and_nan_keep_their_places(spark):
    rows = spark.createDataFrame([(v,) for v in (float("nan"), float("inf"), 1.0, 0.0, -0.0, -1.0, float("-inf"))], "x double")
    (r,) = quantiles.sketch_quantiles(quantiles.sketch(rows, [], "x"), [], [i / 6 for i in range(7)]).collect()
    q = r["quantiles"]
    assert q[0] == -math.inf and q[5] == math.inf and math.isnan(q[6]) and q[2] == q[3] == 0 and np.allclose([q[1], q[4]], [-1, 1], rtol=0.01)
    assert rows.select(F.count(F.lit(1))).first()[0] == r["n"]

"""Quantiles of groups: mergeable sketches with a bound on the relative error, and exact ones without a sort of all rows.

A sketch is a histogram whose bins grow by a constant factor (1 + a) / (1 - a), so the middle of a bin is within a share
``a`` of every value in it. Sketches of parts add up bin by bin to the sketch of the whole, in any order; they are rows
(keys, sign, bin, n) and so are built, merged and read by plain aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The share by which a sketch's quantile may be off.
ACCURACY = 0.01
#: Equal parts into which a pass of the exact search cuts what is left of a rank's range.
PARTS = 4096


def growth(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def _bin(x: Column, accuracy: float) -> tuple[Column, Column]:
    """sign and bin of a value."""
    size = F.ceil(F.log(F.abs(x)) / F.lit(math.log(growth(accuracy)))).cast("long")
    sign = F.when(F.isnan(x), 3).when(F.abs(x) == float("inf"), F.signum(x).cast("int") * 2).otherwise(F.signum(x).cast("int"))
    return sign.alias("sign"), F.when(F.abs(sign) == 1, size * sign).otherwise(F.lit(0).cast("long")).alias("bin")


def sketch(rows: DataFrame, keys: Sequence[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(keys, sign, bin, n): how many values of each group lie in each bin.

    sign is -1, 0 or 1 for negative, zero and positive values, -2, 2 and 3 for infinities and NaN, which have a bin of
    their own; bins of one sign ascend with the value. Null values take no part.
    """
    placed = rows.filter(F.col(value).isNotNull()).select(*keys, *_bin(F.col(value).cast("double"), accuracy))
    return placed.groupBy(*keys, "sign", "bin").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups: ``keys`` are some of the sketches' keys, or none."""
    return sketches.groupBy(*keys, "sign", "bin").agg(F.sum("n").alias("n"))


def _middle(sign: Column, bin_: Column, accuracy: float) -> Column:
    g = growth(accuracy)
    finite = sign * F.pow(F.lit(g), bin_ * sign) * F.lit(2 / (1 + g))
    return F.when(sign == 3, float("nan")).when(sign == 2, float("inf")).when(sign == -2, float("-inf")).when(sign == 0, 0.0).otherwise(finite)


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float], accuracy: float = ACCURACY) -> DataFrame:
    """(keys, n, quantiles): for each of ``shares`` the value of rank floor(share * (n - 1)) from 0, off by a share ``accuracy`` at most.

    A group's window is over its bins, whose number grows with the logarithm of its values' range, not with its rows.
    """
    group = W.partitionBy(*keys)
    order = group.orderBy("sign", "bin")
    ranked = sketches.withColumns({"upto": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), "total": F.sum("n").over(group)})
    rank = lambda s: F.floor(F.lit(s) * (F.col("total") - 1))
    first = [F.min(F.when(F.col("upto") > rank(s), F.struct("sign", "bin"))).alias(f"q{i}") for i, s in enumerate(shares)]
    found = ranked.groupBy(*keys).agg(F.first("total").alias("n"), *first)
    return found.select(*keys, "n", F.array(*[_middle(F.col(f"q{i}.sign"), F.col(f"q{i}.bin"), accuracy) for i in range(len(shares))]).alias("quantiles"))


def exact_quantiles(rows: DataFrame, value: str, shares: Sequence[float], parts: int = PARTS) -> list[float | None]:
    """For each of ``shares`` the exact quantile of all finite values, between two values in proportion; None of no values.

    The first pass counts the sketch's bins, each with its least and largest value; every further one cuts what is left
    around each rank into ``parts`` equal parts and goes on in the part that holds the rank, until that is one value. All
    counts are partial aggregates; the driver sees counts, never the values, and a bin is done after five passes or so.
    """
    x = F.col(value).cast("double")
    finite = rows.filter(F.col(value).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(x.alias("x"))
    ends = (F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    bins = sorted(finite.groupBy(*_bin(F.col("x"), ACCURACY)).agg(*ends).collect(), key=lambda r: r["low"])
    n = sum(r["n"] for r in bins)
    if not n:
        return [None] * len(shares)

    def holding(counted: list, rank: int, before: int) -> tuple[float, float, int]:
        """Least and largest value of the part that holds a rank, and how many values come before it."""
        for r in counted:
            if rank < before + r["n"]:
                return r["low"], r["high"], before
            before += r["n"]
        raise AssertionError("the rows have changed between two passes")

    places = [s * (n - 1) for s in shares]
    spans = {rank: holding(bins, rank, 0) for p in places for rank in (math.floor(p), math.ceil(p))}
    while open_ := sorted({s[:2] for s in spans.values() if s[0] < s[1]}):
        at = F.lit(None)
        for i, (low, high) in enumerate(open_):
            part = F.least(F.lit(parts - 1), F.floor((F.col("x") - F.lit(low)) / F.lit(high - low) * parts).cast("int"))
            at = F.when(F.col("x").between(low, high), F.struct(F.lit(i).alias("span"), part.alias("part"))).otherwise(at)
        found: dict[int, list] = {}
        for r in sorted(finite.select("x", at.alias("at")).filter("at IS NOT NULL").groupBy("at").agg(*ends).collect(), key=lambda r: r["low"]):
            found.setdefault(r["at"]["span"], []).append(r)
        spans = {rank: holding(found[open_.index(s[:2])], rank, s[2]) if s[0] < s[1] else s for rank, s in spans.items()}
    at_rank = lambda rank: spans[rank][0]
    return [at_rank(math.floor(p)) + (at_rank(math.ceil(p)) - at_rank(math.floor(p))) * (p - math.floor(p)) for p in places]

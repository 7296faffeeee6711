"""Chains of stored redirects, followed by a bounded number of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.config import DEFAULT
from weftline.functions.urls import url_error

STATUSES = (301, 302, 303, 307, 308)


def follow(requests: DataFrame, hops: DataFrame, most: int = DEFAULT.max_redirects) -> DataFrame:
    """``requests`` (url) with final_url, n_hops and error; ``hops`` has one row (from_url, status, location) for each URL.

    Every hop is checked like a request's URL. More than ``most`` hops, or a redirect without a location, is an error.
    """
    table = hops.filter(F.col("status").isin(*STATUSES)).select(F.col("from_url").alias("_from"), F.col("location").alias("_to"))
    out = requests.withColumn("final_url", F.col("url")).withColumn("n_hops", F.lit(0)).withColumn("error", F.lit(None).cast("string"))
    for step in range(most + 1):
        out = out.join(table, (F.col("final_url") == F.col("_from")) & F.col("error").isNull(), "left")
        moved = F.col("_from").isNotNull()
        problem = F.when(moved & (F.coalesce("_to", F.lit("")) == ""), F.lit("Redirect response missing Location header")).when(moved & F.lit(step == most), F.lit("Too many redirects")).when(moved, url_error(F.col("_to")))
        out = out.select(
            *requests.columns,
            F.when(moved & problem.isNull(), F.col("_to")).otherwise(F.col("final_url")).alias("final_url"),
            (F.col("n_hops") + F.when(moved & problem.isNull(), 1).otherwise(0)).alias("n_hops"),
            F.coalesce("error", problem).alias("error"),
        )
    return out

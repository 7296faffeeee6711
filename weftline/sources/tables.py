"""Tables read and written: pages, node tables, cache downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as it is read, over all cores where the scan gives fewer partitions than that (one small file of one row group, say).

    For scans, whose partitions are known without a job; a stream stays as it is.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shares(df: DataFrame, column: str, each: int = 4 << 20) -> int:
    """Partitions for a shuffle of what is made of ``column``'s texts, one for ``each`` of their bytes and at least the session's number, so that a task's share stays the same as a table grows. Reads the column once."""
    n = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // each))


def downloads(cache: DataFrame) -> DataFrame:
    """What a download of each cache entry gives: file name, media type, content."""
    from weftline.operators.cache import key_hash, safe_filename

    return cache.select("cache_key", safe_filename(F.col("url"), F.col("title"), key_hash(F.col("cache_key"))).alias("filename"), F.lit("text/markdown; charset=utf-8").alias("content_type"), "content")


def write_markdown(results: DataFrame, path: str) -> None:
    """Result rows as Parquet, dealt by key so that files stay even."""
    results.repartition(F.col("cache_key")).write.mode("overwrite").parquet(path)

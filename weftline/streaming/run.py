"""Streams run to the end of what is there, with results that a restart does not repeat."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; a temporary one in local mode where that is unset, an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="streams")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def configured(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``__`` for ``.``) while a stream starts; a running stream keeps them."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", provider: str | None = None, paced: bool = False) -> DataFrame:
    """Runs ``stream`` over all that is available and gives what has been written under ``path`` so far, with ``batch``, the number of the micro-batch.

    A micro-batch overwrites its own folder, ``batch=<number>``, so one that is run again after a failure leaves its rows
    once, and a restart from ``checkpoint`` goes on after the last finished one. ``paced``: micro-batch after micro-batch until
    the source has nothing left, for sources that bound a micro-batch by themselves.
    """
    spark = stream.sparkSession

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    settings = {"spark__sql__streaming__stateStore__providerClass": provider} if provider else {}
    with configured(spark, **settings):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)
        query = (writer if paced else writer.trigger(availableNow=True)).start()
    if paced:
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    else:
        query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # no micro-batch has run yet


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of Parquet files as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")  # as a pattern the path may be one file

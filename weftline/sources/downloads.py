"""A sink of Markdown files: one file for each row, all of a write or none.

Tasks write into folders of their own attempt under ``_staged``; the commit moves the folders of the attempts that
succeeded beside each other and removes what an overwrite replaces. A failed task's folder, and all of a failed write's,
never come into place. The target is a folder that driver and executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, STAGED, PART = "markdown_files", "_staged", "part-"


@dataclass
class Staged(WriterCommitMessage):
    folder: str | None
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        names = schema.fieldNames()
        if "filename" not in names or "content" not in names:
            raise ValueError("a download has the columns filename and content")
        self.path, self.overwrite, self.job = path.removeprefix("file:"), overwrite, uuid.uuid4().hex
        if "://" in self.path:
            raise ValueError("files go to a folder that is mounted on the driver and all executors")
        self.name, self.content = names.index("filename"), names.index("content")

    @property
    def staging(self) -> str:
        return os.path.join(self.path, STAGED, self.job)

    def write(self, iterator: Iterator[Row]) -> Staged:
        context = TaskContext.get()
        folder = os.path.join(self.staging, f"{context.partitionId():06d}-{context.taskAttemptId()}")
        files = 0
        for row in iterator:
            name = row[self.name]
            if not name or name in (".", "..") or "/" in name or "\0" in name:
                raise ValueError(f"not a file name: {name!r}")
            os.makedirs(folder, exist_ok=True)
            with open(os.path.join(folder, name), "x", encoding="utf-8", newline="") as f:  # a name twice in a task is an error, never a lost file
                f.write(row[self.content] or "")
            files += 1
        return Staged(folder if files else None, files)

    def commit(self, messages: list[Staged | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = [n for n in os.listdir(self.path) if n.startswith(PART)] if self.overwrite else []
        for i, m in enumerate(m for m in messages if m and m.folder):
            os.rename(m.folder, os.path.join(self.path, f"{PART}{self.job}-{i:06d}"))
        for name in old:
            shutil.rmtree(os.path.join(self.path, name))
        self._sweep()

    def abort(self, messages: list[Staged | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
        try:
            os.rmdir(os.path.dirname(self.staging))  # unless another write stages there
        except OSError:
            pass


class MarkdownFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "filename string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], schema, overwrite)


def unique_names(rows: DataFrame, key: str = "cache_key") -> DataFrame:
    """``rows`` (filename, key, ...) with a part of the key's hash in the names that more than one row has, before the extension; equal rows of one key are one.

    The number of rows of a name is counted by partial aggregates, so a name that many rows share is no hot task.
    """
    one = rows.dropDuplicates(["filename", key])
    shared = one.groupBy("filename").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(F.col("filename").alias("_name"))
    tag = F.concat(F.lit("-"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16))
    named = F.when(F.col("_name").isNotNull(), F.regexp_replace("filename", r"^(.*?)(\.[^.]*)?$", F.concat(F.lit("$1"), tag, F.lit("$2")))).otherwise(F.col("filename"))
    return one.join(shared, F.col("filename") == F.col("_name"), "left").withColumn("filename", named).drop("_name")


def write_files(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """A file for each row of ``rows`` (cache_key, filename, content) under ``path``, names made unique."""
    register(rows.sparkSession)
    unique_names(rows).select("filename", F.coalesce("content", F.lit("")).alias("content")).write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MarkdownFiles)

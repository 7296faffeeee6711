"""The sink of Markdown files: names of several rows, failing tasks, overwriting."""

import os

import pytest
from pyspark.sql import functions as F

from weftline.sources import downloads


def files(path):
    return sorted(name for folder, _, names in os.walk(path) for name in names)


def contents(path):
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            with open(os.path.join(folder, name), encoding="utf-8", newline="") as f:
                found[name] = f.read()
    return found


ROWS = "cache_key string, filename string, content string"


def test_each_row_is_a_file_and_names_are_unique(spark, tmp_path):
    rows = [(f"m:{i}", "same.md", f"é {i}\r\n") for i in range(6)] + [("m:a", "own.md", None), ("m:b", "none", "x"), ("m:c", "none", "y"), ("m:0", "same.md", "é 0\r\n")]
    downloads.write_files(spark.createDataFrame(rows, ROWS).repartition(4), str(tmp_path / "out"))
    got = contents(tmp_path / "out")
    assert len(got) == 9 and got["own.md"] == "" and sorted(v for k, v in got.items() if k.startswith("same-")) == [f"é {i}\r\n" for i in range(6)]
    assert all(k.endswith(".md") for k in got if k.startswith("same")) and sorted(v for k, v in got.items() if k.startswith("none-")) == ["x", "y"]
    assert not os.path.exists(tmp_path / "out" / downloads.STAGED)


def test_overwrite_and_append(spark, tmp_path):
    out = str(tmp_path / "out")
    write = lambda names, overwrite: downloads.write_files(spark.createDataFrame([(n, n, n) for n in names], ROWS).repartition(3), out, overwrite)
    write(["a.md", "b.md"], True)
    write(["c.md"], False)
    assert files(out) == ["a.md", "b.md", "c.md"]
    write(["b.md", "d.md"], True)
    assert files(out) == ["b.md", "d.md"]
    downloads.write_files(spark.createDataFrame([], ROWS), out)
    assert files(out) == []


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    out = str(tmp_path / "out")
    downloads.write_files(spark.createDataFrame([("k", "a.md", "old")], ROWS), out)
    rows = spark.createDataFrame([(f"k{i}", f"n{i}.md", "new") for i in range(20)] + [("bad", "../x.md", "new")], ROWS).repartition(4)
    with pytest.raises(Exception, match="not a file name"):
        downloads.write_files(rows, out)
    assert contents(out) == {"a.md": "old"} and not os.path.exists(os.path.join(out, downloads.STAGED)) and not os.path.exists(tmp_path / "x.md")


def test_only_attempts_that_succeeded_are_committed(tmp_path):
    from pyspark.sql.types import StructType

    writer = downloads.FileWriter(str(tmp_path), StructType().add("filename", "string").add("content", "string"), True)
    for attempt in ("000000-0", "000000-1"):  # the first attempt was lost after writing
        os.makedirs(os.path.join(writer.staging, attempt))
        with open(os.path.join(writer.staging, attempt, "a.md"), "w") as f:
            f.write(attempt)
    writer.commit([downloads.Staged(os.path.join(writer.staging, "000000-1"), 1), downloads.Staged(None, 0), None])
    assert contents(tmp_path) == {"a.md": "000000-1"}


def test_names_are_counted_without_a_hot_task(spark, capsys):
    rows = spark.createDataFrame([], ROWS)
    downloads.unique_names(rows).explain()
    assert "Window" not in capsys.readouterr().out
    with pytest.raises(Exception, match="filename and content"):
        downloads.register(spark)
        spark.range(1).select(F.col("id").cast("string").alias("x")).write.format(downloads.FORMAT).mode("append").save("/tmp/unused-downloads")

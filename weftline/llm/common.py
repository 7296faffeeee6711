"""Shared helpers: durable intermediate results, word and shingle kernels, chunked exchange of keys."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the words of every operator here.
WORD = r"[^\x20\x09-\x0D]+"
_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPAN = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; a cluster without one is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder: survives lost executors and cuts the lineage."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop shuffle files that nothing refers to any more
    return out


def set_aside(df: DataFrame, clash: Callable[[str], bool]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns whose lower-case names ``clash`` under names that nothing has, and what gives them back (``withColumnsRenamed``)."""
    present = {c.lower() for c in df.columns}
    free = (n for n in (f"_aside{i}" for i in itertools.count()) if n not in present and not clash(n))
    names = {c: next(free) for c in df.columns if clash(c.lower())}
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``set_aside`` of the columns with a dot in their names, which Arrow functions cannot take."""
    return set_aside(df, lambda c: "." in c)


def table_bytes(df: DataFrame, column: str) -> int:
    """Bytes of one text column, from one pass over its lengths."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def lowest(key: Column, wanted: int, total: int | Column) -> Column:
    """Whether a row is among about twice the ``wanted`` of ``total`` rows that are lowest by a hash: a sample's bound for the cluster, before it is cut exactly."""
    share = F.lit(2.0 * wanted) / F.greatest(F.lit(1), total if isinstance(total, Column) else F.lit(total))
    return F.pmod(key, F.lit(1 << 31)) < share * F.lit(float(1 << 31))


#: A join key of more rows than HOT_ROWS is split over SALTS tasks. There are at most HOT_KEYS such keys: any other key has less than 1 / HOT_KEYS of all rows.
HOT_ROWS, HOT_KEYS, SALTS = 256, 1024, 64


def hot_keys(facts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """The keys of most rows, at most HOT_KEYS, by the number of rows in ``size``."""
    return durable(facts.filter(F.col(size) > HOT_ROWS).orderBy(F.desc(size), *keys).limit(HOT_KEYS).select(*keys, F.lit(True).alias("_hot")))


def matched(rows: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (one row for each key); rows of a hot key are dealt by ``by`` over SALTS tasks, its fact is repeated."""
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    right = facts.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose summed lengths stay within ``most``; a longer row is alone."""
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if cache.get("n", 0) < n:
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            cache[key] = np.multiply.accumulate(table)
        cache["n"] = n
    return cache["up"], cache["down"]


def _letter_table(lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint64) + np.uint64(1)
    if lower:
        table[65:91] += np.uint64(32)
    return table


def byte_set(separators: bytes | tuple[int, ...]) -> np.ndarray:
    """For each byte whether it belongs to a word."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


_INSIDE = byte_set(_SEPARATORS)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, inside: np.ndarray = _INSIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word of the rows: hash, start, end (bytes in ``data``), and per row the index of its first word (one more at the end)."""
    own = inside[data]
    first = own.copy()
    first[1:] &= ~own[:-1]
    last = own.copy()
    last[:-1] &= ~own[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = own[cut]
    last[cut - 1] = own[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    table = _letter_table(lower)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _powers(max(_SPAN, high - low) + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * up[: high - low], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        hashes[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, rows: np.ndarray, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``k`` words, in order, and per row the index of its first; a shorter row gives its whole sequence as one."""
    counts = np.diff(rows)
    acc = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k if len(acc) else 0):
        acc = acc * _BASE + hashes[i : len(hashes) - k + 1 + i]
    n = np.maximum(counts - k + 1, 0)
    keep = np.arange(n.sum()) + np.repeat(rows[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64), n) if len(n) else np.zeros(0, np.int64)
    out = mix(acc[keep] + np.uint64(k))
    starts = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k)) if whole_if_short else []
    if len(short):
        extra = []
        for row in short.tolist():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in hashes[rows[row] : rows[row + 1]]:
                    h = h * _BASE + x
                extra.append(h + np.uint64(counts[row]))
        out = np.insert(out, starts[short], mix(np.array(extra, np.uint64)))
        n[short] = 1
        starts = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    return out, starts


def batches(stream: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``text`` stays within ``most`` bytes, however large Spark's batches are."""
    for batch in stream:
        column = batch.column(text)
        lengths = np.diff(utf8(column)[1])
        for a, b in slices(lengths, most):
            yield batch.slice(a, b - a)

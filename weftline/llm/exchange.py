"""Keys of documents meet without a row for each key.

Documents are dealt into groups of a few megabytes by a hash. Each group extracts its keys, combines equal ones (so a key
that a third of all documents hold counts once for each group), and sends one packed block to each key bucket. A bucket
answers each group with one packed block. Groups and buckets are sized by bytes, so memory in a task stays bounded, and
nothing is collected or broadcast. Both passes read the same shuffle of the documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import table_bytes, utf8

GROUP_BYTES = 6 << 20
LEAST_BUCKETS = 32
GROUP = "_exchange_group"
LAST = np.int64(2**63 - 1)


class Exchange:
    """``docs`` (doc_id, text and further columns) dealt into groups; rounds of ``ask`` and ``answer``, at last ``apply``."""

    def __init__(self, docs: DataFrame, keys_per_byte: float, keys_per_bucket: int = 750_000):
        total = table_bytes(docs, "text")
        self.groups = max(1, math.ceil(total / GROUP_BYTES))
        self.buckets = max(LEAST_BUCKETS, math.ceil(total * keys_per_byte / keys_per_bucket))
        rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("doc_id", "text", GROUP)]
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *rest, F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.groups)).alias(GROUP))

    def ask(self, extract: Callable[[pa.Table, pa.Table | None], dict[int, bytes]], answers: DataFrame | None = None) -> DataFrame:
        """(bucket, g, block): what ``extract`` gives for each bucket from a group's documents, and its earlier answers."""
        schema = "bucket long, g long, block binary"

        def rows(g: int, found: dict[int, bytes]) -> pa.Table:
            items = sorted(found.items())
            return pa.table({"bucket": pa.array([k for k, _ in items], pa.int64()), "g": pa.array([g] * len(items), pa.int64()), "block": pa.array([v for _, v in items], pa.binary())})

        if answers is None:
            return self.docs.groupBy(GROUP).applyInArrow(lambda key, t: rows(key[0].as_py(), extract(_ordered(t), None)), schema)
        both = self.docs.groupBy(GROUP).cogroup(answers.groupBy("g"))
        return both.applyInArrow(lambda key, t, a: rows(key[0].as_py(), extract(_ordered(t), a)), schema)

    def answer(self, asked: DataFrame, resolve: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
        """(g, block): ``resolve`` gets a bucket's blocks and gives one answer for each; empty ones are not sent."""

        def run(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("g").to_numpy(), kind="stable")
            groups, blocks = table.column("g").take(order), table.column("block").take(order).to_pylist()
            pairs = [(g, b) for g, b in zip(groups.to_pylist(), resolve(blocks)) if b]
            return pa.table({"g": pa.array([g for g, _ in pairs], pa.int64()), "block": pa.array([b for _, b in pairs], pa.binary())})

        return asked.groupBy("bucket").applyInArrow(run, "g long, block binary")

    def apply(self, answers: DataFrame, finish: Callable[[pa.Table, list[bytes]], pa.Table], schema: T.StructType | str) -> DataFrame:
        """The result rows of every group from its documents and the answers to it."""
        both = self.docs.groupBy(GROUP).cogroup(answers.groupBy("g"))
        return both.applyInArrow(lambda key, t, a: finish(_ordered(t), a.column("block").to_pylist()), schema)


def _ordered(table: pa.Table) -> pa.Table:
    """A group's rows in one order, however the shuffle delivered them: by doc_id, then text."""
    keys = [("doc_id", "ascending"), ("text", "ascending")]
    return table.take(pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=keys)) if table.num_rows else table


def owners(table: pa.Table) -> np.ndarray:
    """doc_id of each row; a null one comes after all others."""
    return np.asarray(table.column("doc_id").combine_chunks().fill_null(int(LAST)).to_numpy(zero_copy_only=False), np.int64) if table.num_rows else np.zeros(0, np.int64)


def texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return utf8(table.column("text"))


def least(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (a structured or plain array), sorted, and the smallest value of each."""
    order = np.lexsort((values, *([keys[n] for n in reversed(keys.dtype.names)] if keys.dtype.names else [keys])))
    k, v = keys[order], values[order]
    first = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    return k[first], v[first]

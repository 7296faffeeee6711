"""Lines that many documents share, found in a sharded minimal perfect hash and dropped everywhere.

A line's key is its text without white space at both ends and with A-Z lower-cased; it is compared by a 128-bit BLAKE2
digest. The digests are counted (one count for each document), dealt into shards, and every shard becomes an index row: a
minimal perfect hash over its distinct digests (levels of bits, a digest's slot being the rank of its bit), and by slot an
array of 32-bit fingerprints and one of counts. Documents do not join with lines: a group of documents sends each shard
one packed block of digests, the shard looks them up in its arrays, and sends back those that reach the limit.

The index is a table of its own: it can be kept and probed by documents that it was not built from. A digest it was not
built from is told by its fingerprint (a foreign line passes with a chance of 2^-32); for its own documents it is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import batches, mix, plain_names, read, stored
from .exchange import Exchange

#: Fixed value: what is stripped from both ends of a line.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Lines of a shard at most, on average; digests that a counting task holds at a time; bits of a level for each of its digests.
SHARD_LINES, HELD, GAMMA = 400_000, 200_000, 2
_STEP = 0xD1B54A32D192ED03
_DIGEST = np.dtype([("h1", "<u8"), ("h2", "<u8")])
EMPTY = b""


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def digest(key: bytes) -> bytes:
    """16 bytes of a key; none for the empty key, which is no line to drop."""
    return blake2b(key, digest_size=16).digest() if key else EMPTY


def line_digests(text: bytes) -> list[bytes]:
    return [digest(line_key(line)) for line in text.split(b"\n")]


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys["h1"] ^ mix(keys["h2"] + np.uint64((level + 1) * _STEP % (1 << 64)))) % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of bits over distinct ``keys``: a level's set bits are the places that one of the keys left to it has alone."""
    levels, live = [], keys
    while len(live):
        size = max(64, GAMMA * len(live))
        places = _places(live, len(levels), size)
        alone = np.bincount(places, minlength=size) == 1
        levels.append(alone)
        live = live[~alone[places]]
    return levels


def slots(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Each key's slot, a number of its own below the number of keys; -1 for keys that no level knows."""
    found, live, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for i, bits in enumerate(levels):
        places = _places(keys[live], i, len(bits))
        rank = np.cumsum(bits) - 1
        hit = bits[places]
        found[live[hit]] = base + rank[places[hit]]
        live = live[~hit]
        base += int(rank[-1]) + 1
    return found


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys["h1"] + keys["h2"]) >> np.uint64(32)).astype(np.uint32)


def _index_row(table: pa.Table) -> pa.Table:
    """A shard's index from its (h1, h2, n)."""
    keys = np.empty(table.num_rows, _DIGEST)
    for c in ("h1", "h2"):
        keys[c] = table.column(c).to_numpy().view(np.uint64)
    n = table.column("n").to_numpy()
    levels = perfect_hash(keys)
    at = slots(keys, levels)
    prints, counts = np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64)
    prints[at], counts[at] = _prints(keys), n
    bits = b"".join(np.packbits(level).tobytes() for level in levels)
    sizes = pa.array([[len(level) for level in levels]], pa.list_(pa.int32()))
    blobs = [pa.array([x], pa.binary()) for x in (bits, prints.tobytes(), counts.tobytes())]
    return pa.table([table.column("shard").slice(0, 1).combine_chunks(), pa.array([len(keys)], pa.int64()), sizes, *blobs], names=["shard", "lines", "sizes", "bits", "prints", "counts"])


class Shard:
    """One index row, unpacked for look-ups."""

    def __init__(self, row: dict):
        self.levels, raw, a = [], np.frombuffer(row["bits"], np.uint8), 0
        for size in row["sizes"]:
            b = a + (size + 7) // 8
            self.levels.append(np.unpackbits(raw[a:b], count=size).astype(bool))
            a = b
        self.prints = np.frombuffer(row["prints"], np.uint32)
        self.counts = np.frombuffer(row["counts"], np.uint32 if len(row["counts"]) == 4 * row["lines"] else np.uint64)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Documents that hold each key; 0 for a key that the index was not built from."""
        at = slots(keys, self.levels)
        known = at >= 0
        known[known] = self.prints[at[known]] == _prints(keys[known])
        return np.where(known, self.counts[np.where(known, at, 0)], 0) if len(self.counts) else np.zeros(len(keys), np.int64)


@dataclass(frozen=True)
class LineIndex:
    """``table`` (shard, lines, sizes, bits, prints, counts), one row for each non-empty one of ``shards`` shards."""

    table: DataFrame
    shards: int


def line_index(docs: DataFrame, shard_lines: int = SHARD_LINES) -> LineIndex:
    """The index of all lines of ``docs`` (text; every row is a document of its own), stored in the shared folder.

    Null and empty texts have one empty line. Empty keys are not indexed. A task counts its documents' lines before the
    shuffle, so that a line that every document holds is a row of each task only.
    """
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    total = docs.agg(F.sum(breaks).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(total / shard_lines))

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(held), _DIGEST)
            columns = [(keys["h1"] % np.uint64(shards)).astype(np.int64), keys["h1"].view(np.int64), keys["h2"].view(np.int64), np.fromiter(held.values(), np.int64, len(held))]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["shard", "h1", "h2", "n"])

        for batch in batches(stream, "text"):
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                held.update({d for d in line_digests(text or b"") if d})
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        yield rows()

    counted = docs.select("text").mapInArrow(count, "shard long, h1 long, h2 long, n long").groupBy("shard", "h1", "h2").agg(F.sum("n").alias("n"))
    schema = "shard long, lines long, sizes array<int>, bits binary, prints binary, counts binary"
    return LineIndex(stored(counted.groupBy("shard").applyInArrow(_index_row, schema), "line-index"), shards)


def drop_lines(docs: DataFrame, least: int = 10, index: LineIndex | None = None) -> DataFrame:
    """``docs`` with every line dropped whose key at least ``least`` documents hold, and n_lines and n_dropped (input columns of those names give way).

    Lines are split at \\n; the others stay as they are, joined by \\n. Without ``index`` the documents' own lines count,
    every row being a document of its own, repeated rows and null doc_ids included. Null texts stay null with one line;
    lines of nothing but white space stay; a text whose lines all go becomes empty. No row is dropped.
    """
    index = index or line_index(docs)
    shards = index.shards
    kept, originals = plain_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]))
    room = Exchange(kept, keys_per_byte=1 / 32)
    order = [c for c in room.docs.columns if c in kept.columns]
    schema = T.StructType([*(room.docs.schema[c] for c in order), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def ask(table: pa.Table, _) -> dict[int, bytes]:
        held: set[bytes] = set()
        for text in table.column("text").cast(pa.large_binary()).to_pylist():
            held.update(line_digests(text or b""))
        held.discard(EMPTY)
        keys = np.sort(np.frombuffer(b"".join(held), _DIGEST))
        shard = keys["h1"] % np.uint64(shards)
        by = np.argsort(shard, kind="stable")
        which, at = np.unique(shard[by], return_index=True)
        return {int(s): keys[by[a:b]].tobytes() for s, a, b in zip(which, at, [*at[1:], len(by)])}

    def probe(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows:
            shard = Shard(rows.to_pylist()[0])
            for g, block in zip(asked.column("g").to_pylist(), asked.column("block").to_pylist()):
                keys = np.frombuffer(block, _DIGEST)
                hits = keys[shard.count(keys) >= least]
                if len(hits):
                    found.append((g, hits.tobytes()))
        return pa.table({"g": pa.array([g for g, _ in found], pa.int64()), "block": pa.array([b for _, b in found], pa.binary())})

    def finish(table: pa.Table, blocks: list[bytes]) -> pa.Table:
        gone = {block[i : i + 16] for block in blocks for i in range(0, len(block), 16)}
        out, sizes, dropped = [], [], []
        for text in table.column("text").cast(pa.large_binary()).to_pylist():
            lines = (text or b"").split(b"\n")
            stay = [line for line in lines if digest(line_key(line)) not in gone]
            out.append(None if text is None else b"\n".join(stay))
            sizes.append(len(lines))
            dropped.append(len(lines) - len(stay))
        text = pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(table.column("text").type)
        return pa.table([*(text if c == "text" else table.column(c) for c in order), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())], names=[*order, "n_lines", "n_dropped"])

    asked = room.ask(ask)
    answers = asked.groupBy("bucket").cogroup(index.table.groupBy("shard")).applyInArrow(probe, "g long, block binary")
    return room.apply(answers, finish, schema).select(*[F.col(f"`{c}`") for c in kept.columns], "n_lines", "n_dropped").withColumnsRenamed(originals)


def op11_lines(spark, sf_dir: str) -> DataFrame:
    out = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), least=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs),
keyed AS (
  SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM keyed ANTI JOIN common USING (k) GROUP BY r)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text: each step doubles it and adds the byte's gear, so its low 16 bits see the
last 16 bytes. Where they fall under a limit a chunk ends (at the next word's start), if it has LEAST_CHUNK bytes by
then. So cuts depend on content alone and an insertion shifts no chunks but those around it. Chunks are compared by
96-bit digests (BLAKE2; with 3e12 chunks, 100 TB, the odds that any two unlike ones agree are under 1e-4). A chunk that a document with a smaller doc_id holds too is a duplicate, and a run of duplicate chunks of
MIN_RUN bytes or more is removed; a shorter one is no evidence, nor is a common short chunk alone.

Each text is chunked once, and each chunk shuffled once, by its digest; digests of many chunks are dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import HOT_KEYS, SALTS, batches, durable, mix, read, set_aside, stored, utf8

MEAN_CHUNK = 32
LEAST_CHUNK = 12
MIN_RUN = 112
#: Bytes hashed at a time, and the furthest that a cut moves to meet a word's start.
BLOCK = 1 << 20
SNAP = 32
LAST = 2**63 - 1
_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_SPACE = np.isin(np.arange(256), (0x20, 9, 10, 11, 12, 13))


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash (16 bits) after each byte of a stream; the first 15 see fewer bytes."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):
        moved = np.zeros_like(h)
        moved[shift:] = h[:-shift] << np.uint32(shift)
        h = h + moved
    return h & np.uint32(0xFFFF)


def _candidates(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the gear hash calls for a cut, and where each cut then falls: the next word's start, or else the next character's, within SNAP bytes."""
    hits, moved = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(data), BLOCK):
        start = max(0, low - 15)
        part = data[start : low + BLOCK]
        hit = np.flatnonzero(gear(part) < np.uint32(0xFFFF // (MEAN_CHUNK - LEAST_CHUNK))) + start + 1
        hit = hit[hit > low]
        near = data[np.minimum(hit[:, None] + np.arange(-1, SNAP + 1), len(data) - 1)] if len(data) else np.zeros((0, SNAP + 2), np.uint8)
        word = _SPACE[near[:, :-1]] & ~_SPACE[near[:, 1:]]
        letter = (near[:, 1:] & 0xC0) != 0x80
        step = np.where(word.any(1), word.argmax(1), letter.argmax(1))
        hits.append(hit)
        moved.append(hit + step)
    return np.concatenate(hits), np.concatenate(moved)


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts in ``data`` and per row the index of its first chunk; every non-empty row starts a chunk."""
    hit, at = _candidates(data)
    row = np.searchsorted(offsets, hit - 1, "right") - 1
    fits = (hit - offsets[row] >= 16) & (at < offsets[row + 1])  # what the hash saw, and the cut, lie in the row
    at, row = at[fits], row[fits]
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    at_ = at.tolist()
    starts: list[int] = []
    first = [0]
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b > a:
            starts.append(a)
            for x in at_[bounds[i] : bounds[i + 1]]:
                if x - a >= LEAST_CHUNK:
                    starts.append(x)
                    a = x
        first.append(len(starts))
    return np.array(starts, np.int64), np.array(first, np.int64)


def _heavy(h: np.ndarray) -> list[dict]:
    """Digests that make at least 1 / HOT_KEYS of a batch's chunks: each digest of as large a share of all chunks is one in some batch."""
    order = np.lexsort((h["h2"], h["h1"]))
    k = h[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    n = np.diff(np.append(at, len(k)))
    some = np.flatnonzero(n >= max(8, len(h) / HOT_KEYS))
    return [{"h1": int(k["h1"][at[i]]), "h2": int(k["h2"][at[i]]), "n": int(n[i])} for i in some]


def _chunked(docs: DataFrame) -> DataFrame:
    """(rid, own, k1, k2, chunks, sizes, heavy) of each row of ``docs`` (own, k1, k2, text) with a non-empty text.

    chunks are digests (h1, h2), sizes their bytes; heavy, on the first row of a batch, are its ``_heavy`` digests.
    """
    kind = pa.struct([("h1", pa.int64()), ("h2", pa.int32())])
    heavy = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int32()), ("n", pa.int64())]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text"):
            data, offsets = utf8(batch.column("text"))
            starts, rows = cuts(data, offsets)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            raw = data.tobytes()
            digest = b"".join([blake2b(raw[a:b], digest_size=12).digest() for a, b in zip(starts.tolist(), ends.tolist())])
            h = np.frombuffer(digest, np.dtype([("h1", "<i8"), ("h2", "<i4")]))
            at = pa.array(rows, pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(h[c])) for c in ("h1", "h2")], fields=list(kind)))
            sizes = pa.ListArray.from_arrays(at, pa.array((ends - starts).astype(np.int32)))
            hot = pa.array([_heavy(h), *[None] * (batch.num_rows - 1)], heavy)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "own", "k1", "k2")), lists, sizes, hot], names=["rid", "own", "k1", "k2", "chunks", "sizes", "heavy"])

    some = docs.filter(F.octet_length("text") > 0).select(F.monotonically_increasing_id().alias("rid"), "own", "k1", "k2", "text")
    out = some.mapInArrow(run, "rid long, own long, k1 long, k2 long, chunks array<struct<h1:long,h2:int>>, sizes array<int>, heavy array<struct<h1:long,h2:int,n:long>>")
    return stored(out, "substrings-chunks")


def _repeated(chunked: DataFrame) -> DataFrame:
    """(rid, place) of every chunk, by its number in the row, that a smaller ``own`` holds too.

    All chunks of a digest meet in one task and learn the smallest ``own`` among them. Those of a hot digest (at most
    HOT_KEYS) are dealt over SALTS tasks; its smallest ``own`` is aggregated before, combined ahead of the shuffle.
    """
    places = chunked.select("rid", "own", F.posexplode("chunks").alias("place", "c")).select("rid", "own", "place", "c.h1", "c.h2")
    hot = chunked.select(F.inline("heavy")).groupBy("h1", "h2").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h1", "h2").limit(HOT_KEYS).select("h1", "h2")
    hot = durable(places.select("h1", "h2", "own").join(F.broadcast(hot), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("own").alias("first")))
    salted = places.join(F.broadcast(hot), ["h1", "h2"], "left")
    salted = salted.withColumn("salt", F.when(F.col("first").isNotNull(), F.pmod(F.xxhash64("rid"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    same = W.partitionBy("h1", "h2", "salt")
    least = F.min("own").over(same)
    known = salted.select("rid", "own", "place", F.coalesce("first", least).alias("first"))
    return known.filter("first < own").select("rid", "place")


def _spans(chunked: DataFrame, least_run: int) -> DataFrame:
    """(own, k1, k2, spans): for each document and text the runs to remove, where there are any."""
    listed = _repeated(chunked).groupBy("rid").agg(F.sort_array(F.collect_list("place")).alias("places"))
    found = chunked.select("rid", "own", "k1", "k2", "sizes").join(listed, "rid").select("own", "k1", "k2", "sizes", "places")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in stream:  # chunks that touch are one run
            sizes, lists = batch.column(3), batch.column(4)
            many = np.asarray(sizes.value_lengths()).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            edge = np.concatenate(([0], np.cumsum(sizes.flatten().to_numpy().astype(np.int64))))
            chunk = (np.cumsum(many) - many)[row] + lists.flatten().to_numpy()
            base = edge[(np.cumsum(many) - many)[row]]
            start, end = edge[chunk] - base, edge[chunk + 1] - base
            new = np.concatenate(([True], (start[1:] != end[:-1]) | (row[1:] != row[:-1])))[: len(start)]
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(start))[: len(head)] - 1
            a, b, r = start[head], end[tail], row[head]
            long_ = b - a >= least_run
            a, b, r = a[long_], b[long_], r[long_]
            which, at = np.unique(r, return_index=True)
            values = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(which)) for i in range(3)), pa.ListArray.from_arrays(pa.array(np.append(at, len(a)), pa.int32()), values)], names=["own", "k1", "k2", "spans"])

    runs = found.mapInArrow(run, "own long, k1 long, k2 long, spans array<struct<start:long,end:long>>")
    return runs.groupBy("own", "k1", "k2").agg(F.first("spans").alias("spans"))


def remove_repeats(docs: DataFrame, least_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with each row's text without its repeated passages, and n_bytes, n_removed and spans (input columns of those names give way, all others pass).

    spans lists the removed [start, end) bytes of the text. A passage stays where its document has the smallest doc_id of
    those that hold it; a null doc_id comes after all others. Repeats within one document, and between rows of one doc_id,
    stay. Null texts stay null with 0 bytes, empty ones empty; a text that is removed whole becomes empty. A text of
    fewer than ``least_run`` bytes is left alone. Repeated rows get equal results. No row is dropped.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_bytes", "n_removed", "spans")])
    order = kept.columns
    kept, originals = set_aside(kept, lambda c: c in ("own", "k1", "k2", "rid", "start", "end", "chunks"))
    names = {v: k for k, v in originals.items()}
    keyed = kept.withColumns({"own": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("text"), "text")})
    spans = _spans(_chunked(keyed.select("own", "k1", "k2", "text")), least_run)
    out = keyed.join(spans, ["own", "k1", "k2"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    out = out.withColumns({"n_bytes": size, "n_removed": F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])})
    raw = F.encode("text", "UTF-8")
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array("n_bytes"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    pieces = F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.array_join(pieces, ""))
    columns = [text.alias("text") if c == "text" else F.col(f"`{names.get(c, c)}`").alias(c) for c in order]
    return out.select(*columns, "n_bytes", "n_removed", "spans")


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), (F.col("n_removed") > 0).alias("repeats"), "spans", "text")

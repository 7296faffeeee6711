"""Exact top-k search by inner product with MaxScore over sharded postings.

A dimension is a term; its posting list in a shard holds every candidate's integer impact. For a query the contribution
of a term is bounded by the list's extremes. Shifted by its lower bound every contribution is non-negative, so the
terms split, by those bounds, into essential ones, which are traversed for the whole shard, and non-essential ones,
which are probed only for candidates that can still reach the current k-th score. The score to beat goes on from shard
to shard of a group; a ranked merge with a partial limit before the shuffle gives the query's best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import read

SHARD_ROWS = 4096
#: Candidates that a task holds at a time, in shards; query blocks stream past them.
GROUP_ROWS = 2 * SHARD_ROWS
QUERY_ROWS = 256
#: Terms probed between two looks at who is still competitive.
PROBE = 4


def impacts(rows: DataFrame, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``vector`` as integers floor(scale * x). Vectors that are null or hold a null or non-finite component take no part."""
    x = F.col(vector)
    bad = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf")))
    whole = x.isNotNull() & ~F.exists(x, bad)
    return rows.filter(whole).withColumn(vector, F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("long")))


def _pack(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Numbered blocks of up to ``size`` rows: ids, row starts and impacts, each as bytes."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
                v = part.column(1)
                starts = np.concatenate(([0], np.cumsum(np.asarray(v.value_lengths().to_numpy(zero_copy_only=False), np.int64))))
                flat = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.int64)
                kind = next(k for k in ("int16", "int32", "int64") if not len(flat) or np.iinfo(k).min <= flat.min() and flat.max() <= np.iinfo(k).max)
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ids, starts, flat.astype(kind))]
                yield pa.RecordBatch.from_arrays([*blobs[:2], pa.array([kind]), blobs[2]], names=["ids", "starts", "kind", "impacts"])

    packed = rows.select(F.col(key).cast("long"), vector).mapInArrow(run, "ids binary, starts binary, kind string, impacts binary")
    return packed.withColumn("no", F.monotonically_increasing_id())


def _matrix(at: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    lengths = np.diff(at)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - at[:-1][rows]] = flat
    return out


def maxscore(
    query: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: int, k: int, beat: float | None = None, reads: list[int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of a shard whose ``postings`` are terms by rows, as far as they reach ``beat``.

    Equal scores go to the smaller id, ``own`` is no candidate. ``reads`` gets the numbers of postings read and of postings held.
    """
    terms = np.flatnonzero(query)
    q = query[terms]
    bounds = np.stack((q * low[terms], q * high[terms]))
    floor, reach = bounds.min(0), bounds.max(0) - bounds.min(0)
    order = np.argsort(-reach, kind="stable")
    terms, q, floor, reach = terms[order], q[order], floor[order], reach[order]
    left = np.concatenate((np.cumsum(reach[::-1])[::-1], [0]))  # what the terms from i on can still add above their floors
    base = np.concatenate((np.cumsum(floor[::-1])[::-1], [0]))
    live = np.flatnonzero(ids != own)
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(live) >= k:
        some = live[: 4 * k]
        reached = np.partition(q @ postings[np.ix_(terms, some)], -k)[-k]
        beat = reached if beat is None else max(beat, reached)
    # non-essential: the tail that, on top of every floor, cannot reach the score to beat alone
    weak = base[0] + left < beat if beat is not None else np.zeros(0, bool)
    essential = int(np.argmax(weak)) if weak.any() else len(terms)
    score = (q[:essential] @ postings[terms[:essential]])[live] if essential else np.zeros(len(live), query.dtype)
    read = essential * len(live)
    i = essential
    while True:
        if len(live) >= k:
            lowest = np.partition(score, -k)[-k] + base[i]
            beat = lowest if beat is None else max(beat, lowest)
        if beat is not None:
            keep = score + base[i] + left[i] >= beat
            if not keep.all():
                live, score = live[keep], score[keep]
        if i >= len(terms) or not len(live):
            break
        j = min(i + PROBE, len(terms))
        score = score + q[i:j] @ postings[terms[i:j]][:, live]
        read += (j - i) * len(live)
        i = j
    if reads is not None:
        reads[0] += read
        reads[1] += len(terms) * len(ids)
    best = np.lexsort((ids[live], -score))[:k]
    return score[best], ids[live[best]]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k best candidates with another id; all, if there are fewer.

    Both sides hold integer vectors (``impacts``). Shorter vectors count as padded with zeros. Rows with a null id take no
    part; repeated candidate rows are candidates each, whatever their vectors; repeated query rows are one query (equal ids
    with other vectors: the smallest vector). Scores must fit 64-bit integers. Candidates are dealt into groups of about
    GROUP_ROWS; each group is sent once, and all query blocks stream past it, so neither side is broadcast, collected or
    held whole.
    """
    one = queries.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(vector).alias(vector))
    cands = candidates.filter(F.col(key).isNotNull())
    groups = max(1, math.ceil(cands.count() / GROUP_ROWS))
    deal = F.pmod(F.xxhash64("no"), F.lit(groups)).alias("grp")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp")
    fields = ["no", "ids", "starts", "kind", "impacts"]
    shards = _pack(cands, key, vector, SHARD_ROWS).select(deal, F.lit(0).alias("side"), *fields)
    blocks = _pack(one, key, vector, QUERY_ROWS).select(every, F.lit(1).alias("side"), *fields)
    dealt = shards.unionByName(blocks).repartition(groups, "grp").sortWithinPartitions("grp", "side", "no")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in stream:
            for r in batch.to_pylist():
                if r["grp"] != at:
                    at, held = r["grp"], []
                ids, starts, flat = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["starts"], np.int64), np.frombuffer(r["impacts"], r["kind"])
                width = int(np.diff(starts).max(initial=1))
                if r["side"] == 0:
                    rows = _matrix(starts, flat, width)
                    small = float(np.abs(rows).max(initial=0)) < 2**20
                    lists = np.ascontiguousarray(rows.T)
                    held.append((lists.astype(np.float64) if small else lists, rows.min(0), rows.max(0), ids, small))
                    continue
                asked = _matrix(starts, flat, width)
                tame = float(np.abs(asked).max(initial=0)) < 2**20 and width < 4096
                out: list[list[np.ndarray]] = [[], [], []]
                for own, query in zip(ids.tolist(), asked):
                    scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    for lists, low, high, names, small in held:
                        kind = np.float64 if small and tame else np.int64  # products below 2**53 are exact in doubles
                        n = min(width, len(lists))
                        beat = scores[-1] if len(scores) == k else None
                        s, f = maxscore(query[:n].astype(kind), lists[:n].astype(kind, copy=False), low[:n].astype(kind), high[:n].astype(kind), names, own, k, beat)
                        scores, found = np.concatenate((scores, s.astype(np.int64))), np.concatenate((found, f))
                        best = np.lexsort((found, -scores))[:k]
                        scores, found = scores[best], found[best]
                    out[0].append(np.full(len(found), own, np.int64))
                    out[1].append(found)
                    out[2].append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    rows = impacts(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(rows.filter("vec_id % 50 = 0"), rows, 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

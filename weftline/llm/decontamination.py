"""Benchmark decontamination by greedy string tiling.

Texts are compared as sequences of tokens (runs of letters, digits and bytes beyond ASCII, in lower case). Seeds are runs
of MIN_MATCH tokens; a document and an item that share seeds are tiled: a running Karp-Rabin pass with a search length
finds maximal matches of unmarked tokens, the longest are marked first, and the search length falls until MIN_MATCH. The
share of an item's tokens under tiles does not depend on their order, so a reordered passage counts like the original.

Documents and items meet by a join on seeds. Of an item's seeds only the rarer ones are joined: the more common ones are
left out as long as they alone cover too little of it to make a leak, so a template that many items share makes no
pairs. A bitmap of fixed size keeps seeds that no item has out of the shuffle. Tiles are laid for the matched pairs alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import batches, byte_set, durable, grams, mix, read, set_aside, utf8, words

MIN_MATCH = 5
#: An item is leaked into a document if this share of its tokens is under tiles.
COVERAGE = 0.5
#: Bits of the bitmap of item seeds, whatever the items: full, it only lets more seeds into the join.
BITS = 1 << 24
#: Rows of a join's small side up to which it is broadcast (16 bytes a row); beyond, both sides are shuffled.
BROADCAST_ROWS = 250_000
#: Items that a task tiles with one held text.
CHUNK = 1024
_TOKENS = byte_set(tuple(c for c in range(128) if not chr(c).isalnum()))
_MASK = (1 << 61) - 1
_RADIX = 1_000_003


def tokenise(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, their byte starts and ends within the row's text, per row the first token, and row offsets."""
    data, offsets = utf8(texts)
    hashes, a, b, rows = words(data, offsets, inside=_TOKENS)
    base = np.repeat(offsets[:-1], np.diff(rows))
    return hashes, a - base, b - base, rows, offsets


def _seeds(tokens: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return grams(tokens, rows, k, whole_if_short=False)


def _bits(seeds: np.ndarray) -> np.ndarray:
    """Two places in the bitmap for each seed."""
    return np.stack((seeds % np.uint64(BITS), mix(seeds) % np.uint64(BITS)), axis=-1).astype(np.int64)


def _next_marked(free: list[bool]) -> list[int]:
    """For each place the first one from it on that is marked."""
    out, at = [len(free)] * len(free), len(free)
    for i in range(len(free) - 1, -1, -1):
        if not free[i]:
            at = i
        out[i] = at
    return out


def _matches(item: list[int], doc: list[int], item_free: list[bool], doc_free: list[bool], candidates: list[int], s: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Maximal matches of at least ``s`` unmarked tokens, (length, item start, doc start), and the longest length, by Karp-Rabin hashes."""

    def windows(seq: list[int], free: list[bool], at: list[int]) -> Iterator[tuple[int, int]]:
        power = pow(_RADIX, s - 1, _MASK)
        marked = _next_marked(free)
        value, previous = 0, -2
        for i in at:
            if i + s > len(seq):
                continue
            if marked[i] < i + s:
                previous = -2
                continue
            if i == previous + 1:
                value = ((value - seq[previous] * power) * _RADIX + seq[i + s - 1]) % _MASK
            else:
                value = 0
                for x in seq[i : i + s]:
                    value = (value * _RADIX + x) % _MASK
            previous = i
            yield i, value

    table: dict[int, list[int]] = {}
    for i, value in windows(item, item_free, list(range(len(item)))):
        table.setdefault(value, []).append(i)
    found, longest = [], 0
    for j, value in windows(doc, doc_free, candidates):
        for i in table.get(value, ()):
            if i and j and item_free[i - 1] and doc_free[j - 1] and item[i - 1] == doc[j - 1]:
                continue  # not maximal to the left
            n = 0
            while i + n < len(item) and j + n < len(doc) and item_free[i + n] and doc_free[j + n] and item[i + n] == doc[j + n]:
                n += 1
            if n >= s:
                found.append((n, i, j))
                longest = max(longest, n)
    return longest, found


def tile(item: list[int], doc: list[int], candidates: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping (length, item start, doc start); ``candidates`` are the doc positions where a match of ``least`` tokens can start."""
    item_free, doc_free = [True] * len(item), [True] * len(doc)
    tiles: list[tuple[int, int, int]] = []
    s = max(least, len(item) // 2)
    while True:
        longest, found = _matches(item, doc, item_free, doc_free, candidates, s)
        if longest > 2 * s:
            s = longest
            continue
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(item_free[i : i + n]) and all(doc_free[j : j + n]):
                item_free[i : i + n] = [False] * n
                doc_free[j : j + n] = [False] * n
                tiles.append((n, i, j))
        if s <= least:
            # matches that earlier tiles have cut short may have left tokens to tile
            if not found:
                return tiles
            continue
        s = max(least, s // 2) if s > 2 * least else least


class Text:
    """A document's tokens, and its seeds of any length in order of their hashes."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def places(self, item: np.ndarray, k: int) -> np.ndarray:
        """Where the document holds any seed of the item, in order."""
        if k not in self.sorted:
            own, _ = _seeds(self.tokens, np.array([0, len(self.tokens)]), k)
            order = np.argsort(own, kind="stable")
            self.sorted[k] = own[order], order
        own, order = self.sorted[k]
        wanted = np.unique(_seeds(item, np.array([0, len(item)]), k)[0])
        low, high = np.searchsorted(own, wanted), np.searchsorted(own, wanted, "right")
        n = high - low
        return np.sort(order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())])


def cover(item: np.ndarray, text: Text, coverage: float) -> tuple[float, list[tuple[int, int]]] | None:
    """(share, token spans of the tiles) if the tiles cover at least ``coverage`` of the item. An item of fewer than MIN_MATCH tokens must occur whole."""
    k = min(MIN_MATCH, len(item))
    places = text.places(item, k).tolist()
    if not places or (len(places) + k - 1) * len(places) < coverage * len(item):
        return None  # even disjoint, the seeds cannot cover enough
    # only the stretches around seeds can hold tiles: they are cut out, a stopper between them
    cut: list[int] = []
    where: list[int] = []
    for p in places:
        if where and p <= where[-1] + 1:
            fresh = range(where[-1] + 1, p + k)
        else:
            if cut:
                cut.append(-len(cut) - 1)
                where.append(-1)
            fresh = range(p, p + k)
        for q in fresh:
            cut.append(int(text.tokens[q]))
            where.append(q)
    index_of = {q: i for i, q in enumerate(where) if q >= 0}
    tiles = tile([int(x) for x in item], cut, [index_of[p] for p in places], k)
    share = sum(n for n, _, _ in tiles) / len(item)
    return (share, sorted((where[j], where[j] + n) for n, _, j in tiles)) if share >= coverage else None


def rare_seeds(seeds: np.ndarray, frequency: np.ndarray, k: int, n: int, coverage: float) -> np.ndarray:
    """Which of an item's seeds (in order of place) a leak must share one of: all but the most frequent ones that together cover less than ``coverage`` of its ``n`` tokens."""
    keep = np.ones(len(seeds), bool)
    covered = np.zeros(n, bool)
    for i in np.lexsort((np.arange(len(seeds)), -frequency)).tolist():
        covered[i : i + k] = True
        if covered.sum() >= coverage * n:
            break
        keep[i] = False
    return keep


def _items(items: DataFrame) -> DataFrame:
    """(no, item_id, n, tokens, seeds) of every item that has a token."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text"):
            tokens, _, _, rows, _ = tokenise(batch.column("text"))
            some = np.flatnonzero(np.diff(rows))
            found, at = grams(tokens, rows, MIN_MATCH)
            seeds = pa.array([found[at[r] : at[r + 1]].view(np.int64) for r in some], pa.list_(pa.int64()))
            blobs = pa.array([tokens[rows[r] : rows[r + 1]].tobytes() for r in some], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(some)), pa.array(np.diff(rows)[some], pa.int64()), blobs, seeds], names=["item_id", "n", "tokens", "seeds"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, n long, tokens binary, seeds array<long>")
    return durable(rows.withColumn("no", F.monotonically_increasing_id()))


def _index(items: DataFrame, coverage: float) -> DataFrame:
    """(seed, no): the seeds of each item by which documents are to be found."""
    placed = items.select("no", "n", F.posexplode("seeds").alias("place", "seed"))
    counted = placed.join(placed.groupBy("seed").agg(F.count(F.lit(1)).alias("f")), "seed")
    whole = counted.groupBy("no", "n").agg(F.sort_array(F.collect_list(F.struct("place", "f", "seed"))).alias("s")).select("no", "n", F.col("s.f").alias("f"), F.col("s.seed").alias("seed"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            kept: list[tuple[int, int]] = []
            for no, n, f, seeds in zip(*(batch.column(i).to_pylist() for i in range(4))):
                kept += [(s, no) for s, k in zip(seeds, rare_seeds(np.array(seeds), np.array(f), min(MIN_MATCH, n), n, coverage)) if k]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in range(2)], names=["seed", "no"])

    return durable(whole.mapInArrow(run, "seed long, no long").distinct())


def _bitmap(index: DataFrame) -> np.ndarray:
    """The index's seeds in BITS bits; what the driver gets is bounded by the bitmap's words."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array(_bits(batch.column(0).to_numpy().view(np.uint64)).ravel())], names=["bit"])

    bits = index.select("seed").mapInArrow(run, "bit long")
    words_ = bits.groupBy(F.shiftright("bit", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 AS int))")).alias("v")).collect()
    out = np.zeros(BITS // 32, np.uint32)
    for r in words_:
        out[r["w"]] = r["v"]
    return out


def _found(docs: DataFrame, bitmap: np.ndarray, lengths: list[int]) -> DataFrame:
    """(h1, h2, seed): the distinct seeds of each document that an item may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches(stream, "text"):
            tokens, _, _, rows, _ = tokenise(batch.column("text"))
            row, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for k in lengths:
                seeds, starts = _seeds(tokens, rows, k)
                hit = np.ones(len(seeds), bool)
                for bit in _bits(seeds).T:
                    hit &= (table[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
                row.append(np.repeat(np.arange(len(starts) - 1), np.diff(starts))[hit])
                seed.append(seeds[hit])
            both = np.unique(np.stack((np.concatenate(row).astype(np.uint64), np.concatenate(seed))), axis=1)
            at = pa.array(both[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("h1").take(at), batch.column("h2").take(at), pa.array(both[1].view(np.int64))], names=["h1", "h2", "seed"])

    return docs.select("h1", "h2", "text").mapInArrow(run, "h1 long, h2 long, seed long")


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("spans", _SPANS)]))


def _tiled(texts: DataFrame, pairs: DataFrame, coverage: float) -> DataFrame:
    """(h1, h2, item_id, coverage, spans) of the ``pairs`` that are leaks; a text is held, its items are streamed past it, CHUNK by CHUNK."""
    where = ["h1", "h2", "chunk"]
    held = texts.select("h1", "h2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("item_id"), F.encode("text", "UTF-8").alias("blob"))
    streamed = pairs.select("h1", "h2", F.pmod(F.xxhash64("no"), "chunks").alias("chunk"), F.lit(1).alias("side"), "item_id", F.col("tokens").alias("blob"))
    dealt = held.unionByName(streamed).repartition(*where).sortWithinPartitions(*where, "side", "item_id")
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, start, end = None, None, None
        for batch in stream:
            out: list[tuple] = []
            for i, (h1, h2, side, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "side", "item_id")))):
                blob = batch.column("blob")[i].as_buffer()
                if side == 0:
                    tokens, start, end, _, _ = tokenise(pa.array([bytes(blob)], pa.binary()))
                    text = Text(tokens)
                    continue
                found = cover(np.frombuffer(blob, np.uint64), text, coverage)
                if found:
                    out.append((h1, h2, item, found[0], [{"start": int(start[x]), "end": int(end[y - 1])} for x, y in found[1]]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), arrow)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["h1", "h2", "item_id", "coverage", "spans"])

    return dealt.mapInArrow(run, "h1 long, h2 long, item_id long, coverage double, spans array<struct<start:long,end:long>>")


def find_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with leaks: array of (item_id, coverage, spans) by item_id, spans being the tiles' [start, end) bytes of the text.

    An item counts if tiles cover at least ``coverage`` of its tokens; one of fewer than MIN_MATCH tokens if it occurs
    whole. Null, empty or token-less texts and items match nothing; an item repeated under several ids counts under each;
    null item ids are kept as null. Rows are neither dropped nor merged; an input column ``leaks`` gives way, all others
    pass, whatever their names. Equal texts are tiled once.
    """
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    kept, originals = set_aside(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "leaks"]), lambda c: c in ("h1", "h2"))
    keyed = kept.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("leaks"), "text"))
    table = _items(items)
    index = _index(table, coverage)
    lengths = sorted(r["k"] for r in table.select(F.least("n", F.lit(MIN_MATCH)).alias("k")).distinct().collect())
    found = _found(keyed.filter(F.col("text").isNotNull()), _bitmap(index), lengths)
    pairs = durable(found.join(small(index, index.count()), "seed").select("h1", "h2", "no").distinct())
    counts = durable(pairs.groupBy("h1", "h2").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")))
    few = small(counts, counts.count())
    texts = keyed.select("h1", "h2", "text").join(few, ["h1", "h2"]).groupBy("h1", "h2", "chunks").agg(F.first("text").alias("text"))
    matched = pairs.join(few, ["h1", "h2"]).join(table.select("no", "item_id", "tokens"), "no")
    tiled = _tiled(texts, matched, coverage)
    leaks = durable(tiled.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("item_id", "coverage", "spans"))).alias("leaks")))
    size = leaks.agg(F.coalesce(F.sum(F.size("leaks")), F.lit(0)).alias("n")).first()["n"]
    out = keyed.join(small(leaks, 8 * size), ["h1", "h2"], "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(_LEAKS)))
    return out.drop("h1", "h2").withColumnsRenamed(originals)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    out = find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_items"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
        F.sort_array(F.transform("leaks", lambda x: x["item_id"])).alias("item_ids"),
    )

"""Phrase collocations of each language: count-min sketches find what can be frequent, exact counts decide.

First pass: every task adds its n-grams (one to ``longest`` words of a piece) into a count-min sketch, whose counters stop
at the limit; blocks of equal counters of all tasks meet in a shuffle and are added. A sketch never counts too little, so
an n-gram below the limit in one of its rows is rare for certain. The rows come back as bitmaps of counters that reach the
limit, a broadcast whose size is a parameter. Second pass: only n-grams that all bitmaps let through are counted, by their
words, combined in the task and before the shuffle. Scores, cuts and subsumption are joins of exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import batches, byte_set, mix, read, stored, table_bytes, utf8, words

#: What separates words, and what ends a piece.
BLANKS, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Rows of a sketch; counters of a row, at least and at most (a task holds a byte for each counter, the broadcast a bit); counters of a shuffled block.
DEPTH, NARROW, WIDE, BLOCK = 3, 1 << 16, 1 << 25, 1 << 14
#: Sketching tasks for each core of the cluster, and rows that a counting task holds at a time.
TASKS, HELD = 2, 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_INSIDE = byte_set(BLANKS + ENDS)
_END = ~byte_set(ENDS)
#: Ways in which candidates are numbered before the last window of a language.
LANES = 64


def width(n_bytes: int, narrow: int = NARROW, wide: int = WIDE) -> int:
    """Counters of a sketch's row for so many bytes of text: a power of two, about one for each 16 bytes, within the bounds."""
    return min(wide, max(narrow, 1 << (n_bytes // 16).bit_length()))


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """A batch's words in order: hash (of word and language), piece number, language number, and the lower-case words themselves."""
    data, offsets = utf8(batch.column("text"))
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    hashes, starts, ends, rows = words(lowered, offsets, lower=False, inside=_INSIDE)
    counts = np.diff(rows)
    row = np.repeat(np.arange(batch.num_rows), counts)
    passed = np.concatenate(([0], np.cumsum(_END[lowered])))
    piece = passed[starts] + row  # grows at every end of a piece and of a row
    sizes = ends - starts
    joined = lowered[_INSIDE[lowered]]
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)), pa.py_buffer(joined)]).cast(pa.large_string())
    langs = batch.column("lang").dictionary_encode()
    number = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    seeds = np.array([_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)
    with np.errstate(over="ignore"):
        keyed = mix(hashes + seeds[number]) if len(hashes) else hashes
    return keyed, piece, number, text


def _hash(lang: str) -> int:
    data = np.frombuffer(b"\0" + lang.encode(), np.uint8).astype(np.uint64)
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in data:
            h = mix(np.array([h * _STEP + x]))[0]
    return int(h)


def gram_hashes(hashes: np.ndarray, piece: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the first words' places of all n-grams within pieces, and the n-grams' hashes."""
    acc, at = hashes, np.arange(len(hashes))
    for k in range(1, longest + 1):
        if k > 1:
            inside = at[at + k - 1 < len(hashes)]
            inside = inside[piece[inside] == piece[inside + k - 1]]
            with np.errstate(over="ignore"):
                acc = mix(acc[np.searchsorted(at, inside)] * _STEP + hashes[inside + k - 1])
            at = inside
        yield k, at, acc


def _places(hashes: np.ndarray, row: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(hashes + np.uint64(row + 1) * _STEP) & np.uint64(size - 1)).astype(np.int64)


def sketch(docs: DataFrame, size: int, least: int, longest: int) -> DataFrame:
    """(row, block, bits): for every block of counters a bitmap of those that reach ``least`` over all ``docs`` (lang, text)."""
    kind = np.uint8 if least < 128 else np.uint32
    cores = docs.sparkSession.sparkContext.defaultParallelism

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((DEPTH, size), kind)
        for batch in batches(stream, "text"):
            hashes, piece, _, _ = tokens(batch)
            for _, _, grams in gram_hashes(hashes, piece, longest):
                distinct, n = np.unique(grams, return_counts=True)
                n = np.minimum(n, least).astype(kind)
                for row in range(DEPTH):
                    places = _places(distinct, row, size)
                    if len(places) * 4 > size:  # colliding n-grams add up
                        counters[row] = np.minimum(counters[row] + np.minimum(np.bincount(places, n, size), least), least)
                    else:
                        at, which = np.unique(places, return_inverse=True)
                        total = counters[row, at] + np.minimum(np.bincount(which, n), least)
                        counters[row, at] = np.minimum(total, least)
        for row in range(DEPTH):
            for block in range(size // BLOCK):
                own = counters[row, block * BLOCK : (block + 1) * BLOCK]
                if own.any():
                    sent = own[::2] | own[1::2] << 4 if least < 16 else own  # two counters to a byte where they fit
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([sent.tobytes()], pa.binary())], names=["row", "block", "counters"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for blob in table.column("counters").to_pylist():
            sent = np.frombuffer(blob, kind)
            if least < 16:
                total[::2] += sent & 15
                total[1::2] += sent >> 4
            else:
                total += sent
        return pa.table([table.column("row").slice(0, 1), table.column("block").slice(0, 1), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["row", "block", "bits"])

    return docs.coalesce(TASKS * cores).mapInArrow(add, "row int, block int, counters binary").groupBy("row", "block").applyInArrow(lambda t: merge(t), "row int, block int, bits binary")


def counts(docs: DataFrame, least: int, longest: int, wide: int = WIDE) -> DataFrame:
    """(lang, k, phrase, f) of every n-gram of ``docs`` (lang, text) that occurs ``least`` times, and each language's number of words (k = 0, phrase empty); exact."""
    size = width(table_bytes(docs, "text"), wide=wide)
    bitmaps = np.zeros((DEPTH, size // 8), np.uint8)
    for r in sketch(docs, size, least, longest).toLocalIterator():  # DEPTH * size bits in all
        bitmaps[r["row"], r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps.tobytes())

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(shared.value, np.uint8).reshape(DEPTH, -1)
        held: list[pa.Table] = []

        def rows() -> Iterator[pa.RecordBatch]:
            if held:
                summed = pa.concat_tables(held).group_by(["lang", "k", "phrase"]).aggregate([("f", "sum")])
                yield from summed.rename_columns(["lang", "k", "phrase", "f"]).to_batches(max_chunksize=1 << 16)
                held.clear()
                del summed
                pa.default_memory_pool().release_unused()  # workers stay for the next stage

        for batch in batches(stream, "text", 1 << 20):
            hashes, piece, lang, text = tokens(batch)
            names = batch.column("lang").dictionary_encode().dictionary.cast(pa.string())
            encoded = text.dictionary_encode()
            word, known = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
            numbers = np.bincount(lang, minlength=len(names))
            held.append(_table(names, np.zeros(len(names), np.int64), pa.array([""] * len(names), pa.large_string()), numbers))
            gram, first = lang, None  # numbers of n-grams: exact, by words and language, not by hash
            for k, at, grams in gram_hashes(hashes, piece, longest):
                before = gram if first is None else gram[np.searchsorted(first, at)]
                pair = before * max(1, len(known)) + word[at + k - 1]
                distinct, where, gram, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                first = at
                own = grams[where]
                likely = np.ones(len(own), bool)
                for row in range(DEPTH):
                    places = _places(own, row, size)
                    likely &= (frequent[row, places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)
                some = at[where[likely]]
                parts = [known.take(pa.array(word[some + i])) for i in range(k)]
                held.append(_table(names.take(pa.array(lang[some])), np.full(len(some), k), pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0], n[likely]))
            if sum(t.num_rows for t in held) > HELD:
                yield from rows()
        yield from rows()

    found = docs.mapInArrow(count, "lang string, k int, phrase string, f long").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return found.filter((F.col("f") >= least) | (F.col("k") == 0) & (F.col("f") > 0))


def _table(lang: pa.Array, k: np.ndarray, phrase: pa.Array, f: np.ndarray) -> pa.Table:
    return pa.table([lang, pa.array(k.astype(np.int32)), phrase.cast(pa.string()), pa.array(f.astype(np.int64))], names=["lang", "k", "phrase", "f"])


def _words(a: int, b: int) -> Column:
    """Words a to b - 1 of ``phrase``, joined by spaces."""
    return F.array_join(F.slice(F.split("phrase", " "), a + 1, b - a), " ")


def scored(found: DataFrame, longest: int) -> DataFrame:
    """Every candidate of ``found`` (the result of ``counts``): lang, k, phrase, a, cut, l, r, score of its lowest-scoring cut (ties: the smallest cut)."""
    phrases = found.filter("k > 1").withColumnRenamed("f", "a")
    parts = None
    for k, cut in ((k, cut) for k in range(2, longest + 1) for cut in range(1, k)):
        sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), _words(0, cut).alias("part")), F.struct(F.lit(1).alias("side"), _words(cut, k).alias("part")))).alias("p")
        one = phrases.filter(F.col("k") == k).select("lang", "k", "phrase", "a", F.lit(cut).alias("cut"), sides).select("lang", "k", "phrase", "a", "cut", "p.side", "p.part")
        parts = one if parts is None else parts.unionByName(one)
    facts = found.filter(F.col("k").between(1, longest - 1)).select("lang", F.col("phrase").alias("part"), "f")
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("f")))
    cuts = parts.join(facts, ["lang", "part"]).groupBy("lang", "k", "phrase", "a", "cut").agg(side(0).alias("l"), side(1).alias("r"))
    score = F.expr("cast(a as decimal(14,0)) * cast(a as decimal(14,0)) * cast(1000000 as decimal(7,0)) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x")
    return cuts.groupBy("lang", "k", "phrase", "a").agg(least).select("lang", "k", "phrase", "a", "x.cut", "x.l", "x.r", "x.score")


def _subsumed(found: DataFrame, longest: int, percent: int) -> DataFrame:
    """(lang, phrase, within): each part of a longer phrase with the most that one of the longer ones occurs."""
    parts = None
    for k in range(3, longest + 1):
        inner = F.explode(F.array(*[_words(i, i + m) for m in range(2, k) for i in range(k - m + 1)]))
        one = found.filter(F.col("k") == k).select("lang", inner.alias("phrase"), "f")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return found.limit(0).select("lang", "phrase", F.col("f").alias("within"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("within"))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, percent: int = 50, wide: int = WIDE) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, from ``docs`` (text, lang); other columns take no part.

    Words are runs without space and tab within pieces, which end at ``.,;:!?`` and line ends; A-Z is lower-cased. A
    phrase of two to ``longest`` words is a candidate if it occurs ``least`` times (a); its score is
    floor(1000000 * a * a / (l * r)) of its lowest cut, l and r being the occurrences of both parts. A candidate within a
    longer one that occurs at least ``percent`` in a hundred times as often goes. Order: score, a (both descending),
    phrase (by bytes). A null lang is ``und``, null and empty texts have no words. Counts are exact up to 10^14; repeated
    rows count again.
    """
    found = stored(counts(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), least, longest, wide), "collocation-counts")
    inner = _subsumed(found, longest, percent)
    rest = scored(found, longest).join(inner, ["lang", "phrase"], "left").filter(F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * percent))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lane = F.pmod(F.xxhash64("phrase"), F.lit(LANES)).alias("lane")
    first = rest.select("lang", "phrase", "a", "l", "r", "score", lane).withColumn("x", F.row_number().over(W.partitionBy("lang", "lane").orderBy(*order))).filter(F.col("x") <= top)
    best = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = found.filter("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"), least=10, longest=3, top=2000, percent=50)


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (SELECT row_number() OVER () AS p, lang, piece FROM pieces WHERE piece <> ''),
split_ AS (SELECT p, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM numbered)),
following AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM split_ WINDOW o AS (PARTITION BY p ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w AS phrase FROM following
  UNION ALL SELECT lang, 2, w || ' ' || w2 FROM following WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM following WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
sides AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (c.a::HUGEINT * c.a * 1000000 // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.cut], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
lowest AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS within FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN longer g USING (lang, phrase) WHERE within IS NULL OR 100 * within < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

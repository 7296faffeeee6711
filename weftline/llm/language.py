"""Language identification by compression.

Each language gets a raw-content zstandard dictionary from its training texts. A text is encoded, block by block, with
every dictionary; the language whose dictionary makes it smallest wins. The margin to the runner-up, relative to the
smallest size, says how sure that is; a narrow one rejects.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import batches, lowest, plain_names, read

#: Bounds of the fit: training texts of a language, and the size of its dictionary and filler. A long text gives FIT_PIECES
#: pieces of PIECE_CHARS characters, spread evenly from its beginning to its end.
FIT_ROWS = 400
FIT_PIECES = 5
PIECE_CHARS = 400
DICTIONARY_BYTES = 96 << 10
FILLER_BYTES = 4 << 10
#: Every language is learned. With more than FULL_LANGUAGES the bounds above shrink in proportion, down to LEAST (rows, pieces, dictionary, filler).
FULL_LANGUAGES = 64
LEAST = (16, 2, 2 << 10, 512)
BLOCK_BYTES = 8 << 10
LEVEL = 7
#: A smaller relative margin rejects.
MIN_MARGIN = 0.002
UNKNOWN = "und"


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id as text) mod 5 is not 0 and that have a text and a language."""
    return docs.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def letters(text: str) -> bytes:
    """The whole text's letters in lower case, a space before and after each word instead of anything else: case and signs tell no language."""
    return b" ".join([b"", *text.lower().encode("utf-8", "replace").translate(_LETTERS).split(), b""])


#: ASCII letters and all bytes beyond ASCII stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _sizes(coders: list, data: bytes) -> list[int]:
    parts = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)] or [b""]
    return [sum(len(c.compress(p)) for p in parts) for c in coders]


def _coders(dictionaries: list[bytes]) -> list:
    import zstandard

    out = []
    for d in dictionaries:
        raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def bounds(languages: int) -> tuple[int, ...]:
    """FIT_ROWS, FIT_PIECES, DICTIONARY_BYTES and FILLER_BYTES for so many languages."""
    full = (FIT_ROWS, FIT_PIECES, DICTIONARY_BYTES, FILLER_BYTES)
    return full if languages <= FULL_LANGUAGES else tuple(max(b, a * FULL_LANGUAGES // languages) for a, b in zip(full, LEAST))


def spread(texts: list[bytes], most: int) -> bytes:
    """Up to ``most`` bytes, of all texts alike: short ones whole, of longer ones a span from a place that their checksum gives."""
    each, left = 0, most
    for i, n in enumerate(sorted(map(len, texts))):
        each = min(n, max(0, left // (len(texts) - i) - 1))
        if each < n:
            break
        left -= n + 1
    return b" ".join(t[at : at + each] for t in texts for at in (zlib.crc32(t) % (max(0, len(t) - each) + 1),))


def fit(rows: DataFrame) -> list[tuple[str, bytes, bytes]]:
    """(language, dictionary, filler) of every language that is not null, those of most rows first; the filler is a bit more of its text.

    The fit reads a bounded sample: of each language the FIT_ROWS distinct texts lowest by their hash, FIT_PIECES pieces from
    all over each (the whole of a shorter text), and spreads dictionary and filler over all of them (less of each where
    there are many languages: ``bounds``). Lines that samples of two languages share (notices, licences) are left out, then texts of each half of the sample that the
    dictionaries of the other half give to another language (wrong labels).
    """
    h = F.xxhash64("text").alias("h")
    rows = rows.filter(F.col("lang").isNotNull())
    counts = rows.groupBy("lang", h).agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    counts = [(r["lang"], r["texts"]) for r in counts.orderBy(F.desc("n"), "lang").collect()]
    names = [n for n, _ in counts]
    n_rows, n_pieces, n_dictionary, n_filler = bounds(len(names))
    raw: dict[str, list[str]] = {n: [] for n in names}
    if names:
        totals = rows.sparkSession.createDataFrame(counts, T.StructType([rows.schema["lang"], T.StructField("total", T.LongType())]))
        step = (F.length("text") - PIECE_CHARS) / F.lit(max(1, n_pieces - 1))
        pieces = F.transform(F.sequence(F.lit(0), F.lit(n_pieces - 1)), lambda i: F.substring("text", F.floor(i * step).cast("int") + 1, F.lit(PIECE_CHARS)))
        taken = F.when(F.length("text") <= n_pieces * PIECE_CHARS, F.col("text")).otherwise(F.array_join(pieces, " "))
        keyed = rows.select("lang", "text", h).join(F.broadcast(totals), "lang")
        sample = keyed.filter(lowest(F.col("h"), n_rows, F.col("total"))).groupBy("lang", "h").agg(F.min(taken).alias("text"))
        for r in sorted(sample.collect(), key=lambda r: (r["h"] % (1 << 31), r["text"])):
            if len(raw[r["lang"]]) < n_rows:
                raw[r["lang"]].append(r["text"])
    seen = Counter(line for rows_ in raw.values() for line in {x for t in rows_ for x in t.split("\n")})
    texts = {n: [letters("\n".join(x for x in t.split("\n") if seen[x] < 2)) for t in ts] for n, ts in raw.items()}
    texts = {n: [t for t in ts if t] for n, ts in texts.items()}

    def build(chosen: dict[str, list[bytes]]) -> list[bytes]:
        parts = {n: spread(chosen[n], n_filler + n_dictionary) for n in names}
        return [parts[n][n_filler:] or parts[n] or n.encode() for n in names]

    if len(names) > 1:
        halves = [{n: ts[i::2] for n, ts in texts.items()} for i in (0, 1)]
        coders = [_coders(build(h)) for h in halves[::-1]]
        own = lambda i, half, t: min(range(len(names)), key=_sizes(coders[half], t).__getitem__) == i
        sure = {n: [t for half in (0, 1) for t in halves[half][n] if own(i, half, t)] for i, n in enumerate(names)}
        texts = {n: sure[n] or texts[n] for n in names}
    return [(n, d, spread(texts[n], n_filler + n_dictionary)[:n_filler]) for n, d in zip(names, build(texts))]


def classify(docs: DataFrame, model: list[tuple[str, bytes, bytes]], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), margin and rejected (input columns of those names give way).

    Null text or no letter: ``und``, score 0, rejected. Otherwise lang_pred is a learned language, ties to the
    more frequent one; where the sizes leave a narrow margin, what the text adds to the language's filler decides (a few
    words alone are stored as they are, whatever the dictionary). With one learned language the margin is 1, with none it is ``und``. Whole texts are encoded.
    """
    named = ("lang_pred", "score", "margin", "rejected")
    kept, originals = plain_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in named]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def smallest(sizes: list[int]) -> tuple[int, float]:
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sorted(sizes[:best] + sizes[best + 1 :])
        return best, (others[0] - sizes[best]) / max(1, others[0]) if others else 1.0

    def judge(value: str | None, names: list[str], fillers: list[bytes], coders: list) -> tuple[str, float, float, bool]:
        if not names or not value or not any(map(str.isalpha, value)):
            return UNKNOWN, 0.0, 0.0, True
        data = letters(value)
        sizes = _sizes(coders, data)
        best, margin = smallest(sizes)
        if margin < MIN_MARGIN:
            sizes = [len(c.compress(f + data[i : i + BLOCK_BYTES])) - len(c.compress(f)) for i in range(0, len(data), BLOCK_BYTES) for c, f in zip(coders, fillers)]
            sizes = [max(0, sum(sizes[i :: len(names)])) for i in range(len(names))]
            best, margin = smallest(sizes)
        weights = sum(math.exp(-min(50.0, 40.0 * (s - sizes[best]) / max(1, sizes[best]))) for s in sizes)
        return names[best], 1.0 / weights, margin, margin < MIN_MARGIN

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, dictionaries, fillers = ([m[i] for m in shared.value] for i in range(3))
        coders = _coders(dictionaries)
        for batch in batches(stream, text):
            got = [judge(x, names, fillers, coders) for x in batch.column(text).to_pylist()]
            new = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *named])

    return kept.mapInArrow(run, schema).withColumnsRenamed(originals)


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(training_rows(docs.select("doc_id", "text", "lang")))
    out = classify(docs.select("doc_id", "text"), model)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")

"""Token counts by a map-side two-tier lookup.

A piece-BPE vocabulary whose pieces never hold a space mark after another character cannot merge across the start of a
run of spaces, nor across a character that no longer piece holds (such as the line feed). So a text's count is the sum
over its pre-tokens. Tier one is a compact broadcast table of pre-tokens and their counts, made from the vocabulary
itself: its whole-word pieces are the frequent pre-tokens, and the table's size is fixed by the vocabulary, not by the
data. What it misses is encoded once per worker and kept in a bounded cache. No pre-token is ever shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import batches, plain_names, read

MARK = "▁"
CACHE_ENTRIES = 200_000
LONGEST_CACHED = 48


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def separators(pieces: list[str]) -> str:
    """Those of the white-space controls that no piece of two or more characters holds: nothing merges with them."""
    held = {c for p in pieces if len(p) > 1 for c in p}
    return "".join(c for c in "\n\x0b\x0c" if c not in held)


class PieceCounter:
    """Counts one text's tokens exactly as the library does."""

    def __init__(self, model: bytes, table: tuple[bytes, np.ndarray, np.ndarray] | None = None):
        self.sp = _processor(model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        #: Pieces that cross words, or white space that the model strips: pre-tokens do not add up, so texts are encoded whole.
        self.whole = any(MARK in p.lstrip(MARK) for p in plain) or self.sp.encode("a") == self.sp.encode(" a") or self.sp.encode("a  b") == self.sp.encode("a b")
        self.breaks = separators(plain)
        self.split = re.compile(rf" *[^ {self.breaks}]+| +|[{self.breaks}]" if self.breaks else r" *[^ ]+| +").findall
        self.mark_first = len(self.sp.encode("\n"))  # a dummy space mark and the line feed
        self.known: dict[str, int] = {c: self._encode(c) for c in self.breaks}
        if table is None:
            self.known |= self._frequent(plain)
        else:
            text, ends, counts = table
            words, a = text.decode(), 0
            for b, n in zip(ends.tolist(), counts.tolist()):
                self.known[words[a:b]] = n
                a = b
        self.cached: dict[str, int] = {}

    def _encode(self, pre: str) -> int:
        """Tokens of a pre-token inside a text: what starts with a space takes the library's own leading mark for it."""
        if pre[0] == " ":
            return len(self.sp.encode(pre[1:])) if len(pre) > 1 else len(self.sp.encode(" ")) and 1
        return len(self.sp.encode("\n" + pre)) - self.mark_first

    def _frequent(self, plain: list[str]) -> dict[str, int]:
        found = {}
        for piece in plain:
            word = piece.replace(MARK, " ")
            if self.split(word) == [word]:
                found[word] = self._encode(word)
        return found

    def table(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The tier-one table, packed: all keys in one string, their ends, their counts."""
        keys = list(self.known)
        return "".join(keys).encode(), np.cumsum([len(k) for k in keys], dtype=np.int32), np.array([self.known[k] for k in keys], np.uint8)

    def __missing(self, pre: str) -> int:
        n = self.cached.get(pre)
        if n is None:
            n = self._encode(pre)
            if len(pre) <= LONGEST_CACHED:
                if len(self.cached) >= CACHE_ENTRIES:
                    self.cached.clear()
                self.cached[pre] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.whole:
            return len(self.sp.encode(text))
        text = " " + text.replace(MARK, " ")  # the library's dummy mark
        known, missing, n = self.known.get, self.__missing, 0
        for pre in self.split(text):
            x = known(pre)
            n += missing(pre) if x is None else x
        return n


@lru_cache(maxsize=1)
def _worker_counter(model: bytes, keys: bytes, ends: bytes, counts: bytes) -> PieceCounter:
    return PieceCounter(model, (keys, np.frombuffer(ends, np.int32), np.frombuffer(counts, np.uint8)))


def count_tokens(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes and n_tokens (those columns of the input give way). Null or empty text: 0 and 0. Rows are neither dropped nor merged."""
    spark = docs.sparkSession
    keys, ends, counts = PieceCounter(model).table()
    shared = spark.sparkContext.broadcast((model, keys, ends.tobytes(), counts.tobytes()))
    kept, originals = plain_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens")]))
    schema = T.StructType([*kept.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker_counter(*shared.value)
        for batch in batches(stream, text):
            column = batch.column(text)
            n = pa.array([counter.count(x) for x in column.to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, n], names=[*batch.schema.names, "n_bytes", "n_tokens"])

    return kept.mapInArrow(run, schema).withColumnsRenamed(originals)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    out = count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 4096 AS over_limit")

"""Quality classification by histogram gradient-boosted trees over document statistics.

The statistics of a text are computed for whole record batches on byte arrays. Training bins them, grows trees level by
level from gradient histograms, and flattens them into arrays; scoring walks all trees for all rows with numpy gathers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import batches, lowest, plain_names, read, utf8, words

#: Bounds of the fit: labelled rows (those lowest by a hash of doc_id), bins of a statistic, trees, their depth.
FIT_ROWS = 12_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.12
L2 = 2.0

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "letters", "upper", "digits", "spaces", "points", "commas", "signs", "bars", "marks", "wide", "lines", "mean_line",
    "distinct_words", "top_word", "adjacent_repeats", "pair_repeats", "distinct_lines", "top_line", "upper_words", "sign_words", "digit_words", "stops",
)


def _byte_classes() -> np.ndarray:
    """One row of 0/1 for each kind of byte: letters, upper, digits, spaces, points, commas, other signs, bars, marks, beyond ASCII."""
    t = np.zeros((10, 256), np.float32)
    code = np.arange(256)
    upper, lower = (code >= 65) & (code <= 90), (code >= 97) & (code <= 122)
    t[0] = upper | lower
    t[1] = upper
    t[2] = (code >= 48) & (code <= 57)
    t[3] = np.isin(code, (32, 9, 10, 11, 12, 13))
    t[4] = np.isin(code, list(b".!?"))
    t[5] = np.isin(code, list(b",;:"))
    t[6] = (code >= 33) & (code < 127) & ~(upper | lower | (t[2] > 0) | (t[4] > 0) | (t[5] > 0))
    t[7] = np.isin(code, list(b"|<>{}[]"))
    t[8] = np.isin(code, list(b"!?"))
    t[9] = code >= 128
    return t


_CLASSES = _byte_classes()


def _per_row(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's keys: the number of distinct ones and the count of the most frequent one."""
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    if not len(k):
        return np.zeros(n), np.zeros(n)
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(k)))
    top = np.zeros(n)
    np.maximum.at(top, r[at], run)
    return np.bincount(r[at], minlength=n).astype(float), top


def statistics(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of STATISTICS for each text, whole; null and empty texts give all zeros."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    histogram = np.zeros((n, 256))
    for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(x, y, 1 << 20):  # no array of more than a few bytes for each byte of text
            histogram[i] += np.bincount(data[at : min(y, at + (1 << 20))], minlength=256)
    classes = histogram @ _CLASSES.T
    per_byte = classes / np.maximum(size, 1)[:, None]
    hashes, a, b, rows = words(data, offsets)
    counts = np.diff(rows)
    many = np.maximum(counts, 1)
    length = (b - a).astype(float)
    running = np.concatenate(([0], np.cumsum(length)))
    squares = np.concatenate(([0], np.cumsum(length**2)))
    span = lambda x: x[rows[1:]] - x[rows[:-1]]
    mean = span(running) / many
    sd = np.sqrt(np.maximum(span(squares) / many - mean**2, 0))

    def share(flags: np.ndarray) -> np.ndarray:
        return span(np.concatenate(([0], np.cumsum(flags)))) / many

    def inside(kind: int) -> np.ndarray:
        member = _CLASSES[kind].astype(np.uint8)[data]
        total = np.cumsum(member, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        return (total[b - 1] - total[a] + member[a]).astype(float) if len(a) else np.zeros(0)

    distinct, top = _per_row(hashes, rows)
    same = np.zeros(len(hashes), bool)
    pair = hashes.copy()
    if len(hashes) > 1:
        same[1:] = hashes[1:] == hashes[:-1]
        pair[1:] = hashes[1:] * np.uint64(3) + hashes[:-1]
    first = rows[:-1][counts > 0]
    same[first] = False
    pairs, _ = _per_row(pair, rows)
    line_at = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate((offsets[:-1][size > 0], line_at[line_at + 1 < len(data)] + 1))) if len(data) else np.zeros(0, np.int64)
    per_line = np.searchsorted(cuts, offsets)
    ends = np.append(cuts[1:], len(data)) if len(cuts) else cuts
    word_cut = np.searchsorted(a, cuts)
    line_key = np.add.reduceat(np.append(hashes, np.uint64(0)), np.minimum(word_cut, len(hashes))) if len(cuts) else np.zeros(0, np.uint64)
    lines = np.diff(per_line)
    distinct_lines, top_line = _per_row(line_key, per_line)
    line_size = np.concatenate(([0], np.cumsum(ends - cuts)))
    upper_words = share(inside(1) >= np.maximum(2, inside(0)))
    sentence = share(_CLASSES[4][data[b - 1]] > 0) if len(b) else np.zeros(n)
    return np.stack((
        np.log1p(size), np.log1p(counts), mean, sd, share(length > 20), per_byte[:, 0], per_byte[:, 1], per_byte[:, 2], per_byte[:, 3], per_byte[:, 4], per_byte[:, 5], per_byte[:, 6], per_byte[:, 7], per_byte[:, 8], per_byte[:, 9],
        np.log1p(lines), (line_size[per_line[1:]] - line_size[per_line[:-1]]) / np.maximum(lines, 1), distinct / many, top / many, share(same), (counts - pairs) / many, distinct_lines / np.maximum(lines, 1), top_line / np.maximum(lines, 1),
        upper_words, share(inside(6) > 0), share(inside(2) > 0), sentence,
    ), axis=1)


@dataclass(frozen=True)
class Forest:
    """Complete trees, flattened: node i of a level has the children 2i and 2i+1 of the next."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; a value above goes right
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (leaf.shape[0] - 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, l2: float = L2, bins: int = BINS) -> Forest:
    """Boosted trees for the logistic loss; no rows or one class give a constant."""
    positive = float(np.clip((y.sum() + 0.5) / (len(y) + 1.0), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base = float(np.log(positive / (1 - positive)))
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if len(np.unique(y)) < 2:
        return Forest(base, features, thresholds, values)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m) * bins
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            index = (flat + (node * (m * bins))[:, None]).ravel()
            g = np.bincount(index, np.repeat(gradient, m), width * m * bins).reshape(width, m, bins)
            h = np.bincount(index, np.repeat(hessian, m), width * m * bins).reshape(width, m, bins)
            gl, hl = g.cumsum(2), h.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            gain[(hl < 1.0) | (ha - hl < 1.0)] = 0
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // bins, best % bins
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            for i in range(width):
                if split[i] and b[i] < len(edges[f[i]]):
                    features[t, width - 1 + i], thresholds[t, width - 1 + i] = f[i], edges[f[i]][b[i]]
            at = width - 1 + node
            node = 2 * node + (x[np.arange(n), features[t, at]] > thresholds[t, at])
        values[t] = rate * np.bincount(node, gradient, leaves) / (np.bincount(node, hessian, leaves) + l2)
        total += values[t][node]
    return Forest(base, features, thresholds, values)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """Trains on rows whose crc32(doc_id as text) mod 5 is not 0: a bounded sample, the ``fit_rows`` lowest by a hash of doc_id.

    Rows with a null label or doc_id are not learned from. Of a doc_id labelled twice the higher label counts, of one that
    many rows hold the text of the smallest hash, so at most ``fit_rows`` rows reach the driver.
    """
    one = labels.filter(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    few = one.filter(lowest(F.xxhash64("doc_id"), fit_rows, labels.count()))
    chosen = few.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most fit_rows ids
    measured = _measured(rows.select("doc_id", F.col("_label").cast("double").alias("_label"), F.xxhash64("text").alias("_h"), "text"))
    each = measured.groupBy("doc_id", "_label").agg(F.min(F.struct("_h", "_x")).alias("_m"))
    table = each.select("_label", "_m._x").toPandas().sort_values(["_label", "_x"], ignore_index=True)
    x = np.stack([np.frombuffer(v, np.float64) for v in table["_x"]]) if len(table) else np.zeros((0, len(STATISTICS)))
    return train(x, table["_label"].to_numpy(float))


def _measured(rows: DataFrame) -> DataFrame:
    schema = T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("_x", T.BinaryType())])
    names = schema.names

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text"):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), pa.array([v.tobytes() for v in x], pa.binary())], names=names)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 (an input column of that name gives way). Null or empty texts are scored too, as all-zero statistics."""
    kept, originals = plain_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"]))
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, text):
            p = shared.value.score(statistics(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])).withColumnsRenamed(originals)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))

"""Exact removal of repeated 50-byte strings by merging Burrows-Wheeler transforms of shards.

1. Every 50-byte window is assigned to its minimizer, the 20-byte string in it with the least hash. Equal windows have equal
   minimizers, so only stretches whose minimizer occurs in two documents can repeat. Groups of documents exchange
   minimizer hashes (exchange.py) to find those.
2. The stretches (up to 31 windows: 50 to 80 bytes) go to the minimizer's bucket, those of equal bytes (compared byte by
   byte) once, with the smallest doc_id: first in each group, then in the bucket. A minimizer of very many documents is cut further, into single windows, which
   the prints of their bytes deal out over parts of it, in proportion to its documents; a part is a key like any other.
3. The groups of documents fall into SHARDS shards of the corpus. In a bucket each shard's strings have their suffixes
   sorted and their transform taken. The transforms are merged by interleave refinement: a vector says for each rank of
   the merged transform which shard it comes from; a pass over the merged symbols, stably dealt out by symbol, orders it
   by STRIDE further bytes. The pass in which a border appears gives the common prefix of the ranks on both sides; runs
   of ranks with common prefixes of 50 bytes are the repeated intervals. No suffix is sorted again across shards, and
   hashes only deal strings out. Strings of equal bytes are one string before the merge; that two windows are equal,
   of unlike strings, is read off the merged intervals, for every key of more than one string, parts of hot ones too.
4. Each window learns the smallest doc_id of its interval; documents drop the windows that a smaller doc_id holds.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import _powers, mix, read, slices
from .exchange import GROUP, LAST, Exchange, owners, texts

WINDOW = 50
SEED = 20
_SPREAD = WINDOW - SEED + 1
STRIDE = 10
SHARDS = 4
#: Symbols merged at a time; minimizers are never split over two merges.
MERGE_SYMBOLS = 100_000
#: The strings of a minimizer of more documents are dealt out as single windows, over a part of it for each PART_DOCUMENTS, so that a key stays bounded.
HOT_DOCUMENTS = 4096
PART_DOCUMENTS = 256
SLICE = 1 << 17
_M = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


# ---- windows and their minimizers


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each position on, composed by doubling."""
    parts = {1: _BYTE[data]}
    n, power = 1, _M
    with np.errstate(over="ignore"):
        while 2 * n <= SEED:
            parts[2 * n] = parts[n][:-n] * power + parts[n][n:]
            n, power = 2 * n, power * power
        m = max(0, len(data) - SEED + 1)
        out, at = None, 0
        for n in sorted(parts, reverse=True):
            if at + n <= SEED:
                piece = parts[n][at : at + m]
                out = piece.copy() if out is None else out * _M ** np.uint64(n) + piece
                at += n
    return mix(out)


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: row, first window, last window (positions in ``data``), hash. Windows never cross rows."""
    if len(data) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    hashes = seed_hashes(data)
    value = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    n = 1
    while 2 * n <= _SPREAD:
        value = np.minimum(value[:-n], value[n:])
        n *= 2
    m = len(hashes) - _SPREAD + 1
    least = (np.minimum(value[:m], value[_SPREAD - n : _SPREAD - n + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    into = np.zeros(len(data) + 1, np.int32)
    np.add.at(into, offsets[1:-1], 1)
    row = np.cumsum(into[:-1])
    at = np.flatnonzero(row[:m] == row[WINDOW - 1 :])
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    chosen, rows = least[at], row[at]
    first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1]))))
    last = np.append(first[1:], len(at)) - 1
    return rows[first].astype(np.int64), at[first], at[last], hashes[chosen[first]]


def _sliced(table: pa.Table):
    """(first row, row offsets, data, where in the row the slice begins) of a group's slices: rows, or pieces of a longer row that share all but one byte of a window."""
    data, offsets = texts(table)
    for a, b in slices(np.diff(offsets), SLICE):
        low, high = int(offsets[a]), int(offsets[b])
        if b > a + 1 or high - low <= SLICE:
            yield a, offsets[a : b + 1] - low, data[low:high], 0
            continue
        for begin in range(0, high - low, SLICE):
            piece = data[low + begin : min(high, low + begin + SLICE + WINDOW - 1)]
            yield a, np.array([0, len(piece)]), piece, begin


def _packed(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 further bits of each hash, which only together tell hashes apart. Buckets have a bounded number of keys at any size, so few are taken for repeated by chance; those only cost work, as all groups take them alike."""
    return (hashes % np.uint64(buckets)).astype(np.int64), ((hashes >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _pack(*arrays: np.ndarray) -> bytes:
    raw = [a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def _unpack(block: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    sizes = struct.unpack_from(f"<{len(kinds)}q", raw)
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


# ---- transforms of shards, and their merge


def ordered(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each value in it is another than the one before) of values below 2 ** ``width``, sorted in one word with their positions where both have room."""
    n = len(values)
    bits = np.uint64(n.bit_length())
    if width + int(bits) <= 64:
        both = (values << bits) | np.arange(n, dtype=np.uint64)
        both.sort()
        order, sorted_ = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits
    else:
        order = np.argsort(values, kind="stable")
        sorted_ = values[order]
    return order, np.concatenate(([False], sorted_[1:] != sorted_[:-1]))[:n]


def ranks(values: np.ndarray, width: int) -> np.ndarray:
    """The number of each value among the distinct ones, in their order, from 0; values are below 2 ** ``width``."""
    order, new = ordered(values, width)
    rank = np.empty(len(values), np.uint64)
    rank[order] = np.cumsum(new, dtype=np.uint64)
    return rank


def suffix_order(number: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in the order of their first WINDOW symbols: first STRIDE empty ones for each string, then the rest.

    ``number`` has the rank of the STRIDE symbols from each position on; every string is followed by more than STRIDE
    zeros. Suffixes that agree in WINDOW symbols come in any order: as the merge goes no deeper, they are in one interval,
    and which of them a rank stands for is all the same (preceded by equal symbols they again agree in WINDOW symbols).
    """
    spans = sizes + STRIDE
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
    known = np.zeros(len(number) + 2 * WINDOW, np.uint64)
    known[: len(number)] = number
    bits = int(known.max(initial=0)).bit_length()
    depth = STRIDE
    while True:
        value = (known[at] << np.uint64(bits)) | known[at + depth]
        depth *= 2
        if depth >= WINDOW:
            return at[ordered(value, 2 * bits)[0]]
        rank = ranks(value, 2 * bits)
        known[:] = 0
        known[at] = rank
        bits = len(at).bit_length()


def places_of(interleave: np.ndarray, shards: int) -> np.ndarray:
    """The ranks of the first shard, then of the second, and so on."""
    return np.concatenate([np.flatnonzero(interleave == s) for s in range(shards)])


def merge_transforms(transforms: list[np.ndarray], empties: list[int], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges shard transforms: (interleave, common prefix of each rank with the one before, in strides, up to ``passes``).

    ``transforms`` hold symbol numbers above 0, and 0 where nothing precedes; the first ``empties`` ranks of each are its
    empty suffixes, which come first in the merged one too, shard by shard.
    """
    sizes = [len(t) for t in transforms]
    symbols = np.concatenate(transforms)
    width = int(symbols.max(initial=0)).bit_length()
    origin = np.repeat(np.arange(len(transforms), dtype=np.uint8), sizes)
    front = np.repeat(np.arange(len(transforms), dtype=np.uint8), empties)
    ends = len(front)
    interleave, block = origin.copy(), np.zeros(len(symbols), np.int32)
    common = np.full(len(symbols), passes, np.int16)
    common[:1] = 0
    merged = np.empty(len(symbols), np.uint64)
    for step in range(passes):
        merged[places_of(interleave, len(transforms))] = symbols
        dealt, border = ordered(merged, width)
        before = block[dealt]
        border[1:] |= before[1:] != before[:-1]
        border[1:ends] = False
        common[border & (common > step)] = step
        interleave = interleave[dealt]
        interleave[:ends] = front
        block = np.cumsum(border, dtype=np.int32)
    return interleave, common


def window_classes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For each window of each string, in order, the number of its interval of equal windows; ``shard`` says which shard of the corpus a string is from."""
    by_shard = np.argsort(shard, kind="stable")
    if (by_shard[1:] < by_shard[:-1]).any():  # strings of a shard together, and back again
        windows = sizes - WINDOW + 1
        found = window_classes(data, starts[by_shard], sizes[by_shard], shard[by_shard])
        at = np.empty(len(sizes), np.int64)
        at[by_shard] = np.cumsum(windows[by_shard]) - windows[by_shard]
        return found[np.repeat(at - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())]
    gap = STRIDE + 1
    places = np.concatenate(([0], np.cumsum(sizes + gap)))[:-1]
    symbols = np.zeros(int((sizes + gap).sum()), np.uint8)
    before = np.cumsum(sizes) - sizes
    step = np.arange(sizes.sum())
    own = data[np.repeat(starts - before, sizes) + step]  # the strings' bytes: ``data`` is a whole bucket's, far more than one merge takes
    used = np.zeros(256, bool)
    used[own] = True
    dense = np.cumsum(used).astype(np.uint8)  # text in UTF-8 never has all 256 values
    symbols[np.repeat(places - before, sizes) + step] = dense[own]
    half = STRIDE // 2
    code = np.zeros(len(symbols), np.uint64)
    for i in range(half):
        code[: len(symbols) - i] |= symbols[i:].astype(np.uint64) << np.uint64(8 * (half - 1 - i))
    number = ranks(code, 8 * half)
    bits = len(symbols).bit_length()
    code = number << np.uint64(bits)
    code[:-half] |= number[half:]
    number = ranks(code, 2 * bits) + np.uint64(1)
    string = np.repeat(np.arange(len(sizes)), sizes + gap)
    transforms, orders, empties = [], [], []
    bounds = np.append(np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))), len(sizes))
    for a, b in zip(bounds[:-1], bounds[1:]):
        low = places[a]
        high = places[b - 1] + sizes[b - 1] + gap
        order = suffix_order(number[low:high], places[a:b] - low, sizes[a:b]) + low
        preceded = order - places[string[order]] >= STRIDE
        transforms.append(np.where(preceded, number[np.maximum(order - STRIDE, 0)], np.uint64(0)))
        orders.append(order)
        empties.append(STRIDE * (b - a))
    interleave, common = merge_transforms(transforms, empties, WINDOW // STRIDE)
    interval = np.cumsum(common < WINDOW // STRIDE, dtype=np.int32)
    of = np.zeros(len(symbols), np.int32)
    of[np.concatenate(orders)] = interval[places_of(interleave, len(transforms))]
    windows = sizes - WINDOW + 1
    at = np.repeat(places - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(windows.sum())
    return of[at]


def least_documents(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For each window of each distinct string the smallest doc among the strings that hold it; ``keys`` (sorted) part the strings; keys are merged together, up to MERGE_SYMBOLS, and never split. A key of one string has nothing to merge with."""
    windows = sizes - WINDOW + 1
    out = np.repeat(docs, windows)
    at = np.concatenate(([0], np.cumsum(windows)))
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    several = np.diff(new) > 1
    members = np.flatnonzero(np.repeat(several, np.diff(new)))
    heads = np.cumsum(np.diff(new)[several])
    cost = np.concatenate(([0], np.cumsum(sizes[members] + STRIDE)))
    begin = 0
    for a, b in slices(np.diff(cost[np.concatenate(([0], heads))]), MERGE_SYMBOLS):
        end = int(heads[b - 1])
        some = members[begin:end]
        begin = end
        group = window_classes(data, starts[some], sizes[some], shard[some])
        place = np.repeat(at[some] - np.concatenate(([0], np.cumsum(windows[some])[:-1])), windows[some]) + np.arange(windows[some].sum())
        best = np.full(int(group.max()) + 1, LAST)
        np.minimum.at(best, group, out[place])
        out[place] = best[group]
    return out


def brought_together(hashes: np.ndarray) -> np.ndarray:
    """Positions in an order that brings equal hashes together, those of one hash as they come. Hashes that agree but for the bits a position takes may lie among each other: a hash can come in several runs, which costs work only."""
    n = len(hashes)
    bits = np.uint64(n.bit_length())
    both = ((hashes >> bits) << bits) | np.arange(n, dtype=np.uint64)
    both.sort()
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the strings of ``sizes`` (WINDOW or more) bytes at ``a`` and at ``b`` are equal, word by word."""
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data.tobytes(), strides=(1,))
    out = np.ones(len(a), bool)
    for step in range(0, WINDOW + _SPREAD - 1, 8):
        at = np.minimum(step, sizes - 8)  # the last word ends with the string
        out &= words[a + at] == words[b + at]
    return out


def prints_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A print of each string, by its bytes and size; the strings follow one another in ``data``, of which a slice is taken at a time."""
    out = np.empty(len(sizes), np.uint64)
    for a, b in slices(sizes, SLICE):
        low, high = int(starts[a]), int(starts[b - 1] + sizes[b - 1])
        up, down = _powers(high - low + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data[low:high]] * up[: high - low], dtype=np.uint64)))
        at = starts[a:b] - low
        out[a:b] = mix((total[at + sizes[a:b]] - total[at]) * down[at] + sizes[a:b].astype(np.uint64))
    return out


def distinct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each string among the distinct ones, the one of the smallest doc for each of those), in the order of ``keys``. A print brings equal strings together; only equal bytes make them one."""
    prints = prints_of(data, starts, sizes)
    order = np.lexsort((docs, prints, keys))
    k, p, z = keys[order], prints[order], sizes[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (z[1:] != z[:-1])))[: len(k)]
    alike = np.flatnonzero(~new)
    new[alike] = ~same_bytes(data, starts[order[alike]], starts[order[alike - 1]], z[alike])
    string = np.empty(len(k), np.int64)
    string[order] = np.cumsum(new) - 1
    return string, order[new]


# ---- the operator


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256, kept) of every row: spans are the maximal removed runs [start, end) of the text's bytes, kept the rest.

    A byte is removed if a 50-byte string that covers it also starts in a document with a smaller doc_id, in the input.
    Null texts are empty. A null doc_id comes after all others; rows of one doc_id never remove from each other, so
    repeated rows get equal results. No row is dropped.
    """
    room = Exchange(docs, 1 / 16)
    buckets = room.buckets

    def ask_seen(table: pa.Table, _) -> dict[int, bytes]:
        own = owners(table)
        hashes, docs_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, offsets, data, _ in _sliced(table):
            rows, _, _, found = stretches(data, offsets)
            hashes.append(found)
            docs_.append(own[a + rows])
        h, d = np.concatenate(hashes), np.concatenate(docs_)
        order = brought_together(h)  # of one hash by document, as the rows are
        h, d = h[order], d[order]
        distinct = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))[: len(h)]
        h = h[distinct]
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)])
        count = np.diff(np.append(new, len(h)))
        h = h[new]
        bucket, rest = _packed(h, buckets)
        order = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | rest)
        bucket, rest, count = bucket[order], rest[order], count[order].astype(np.uint32)
        names, at = np.unique(bucket, return_index=True)
        return {int(n): struct.pack("<q", n) + _pack(rest[x:y], count[x:y]) for n, x, y in zip(names, at, np.append(at[1:], len(rest)))}

    def resolve_seen(blocks: list[bytes]) -> list[bytes]:
        name = blocks[0][:8]
        parts = [_unpack(b[8:], "<u4", "<u4") for b in blocks]
        key, docs_ = (np.concatenate([p[i] for p in parts]) for i in range(2))
        origin = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        total = np.add.reduceat(docs_[order].astype(np.int64), new)
        total = np.repeat(total, np.diff(np.append(new, len(k))))
        told, sums, whose = k[total > 1], np.minimum(total[total > 1], 0xFFFFFFFF).astype(np.uint32), origin[order][total > 1]
        back = np.argsort(whose, kind="stable")
        told, sums, bounds = told[back], sums[back], np.searchsorted(whose[back], np.arange(len(parts) + 1))
        return [name + _pack(told[x:y], sums[x:y]) if y > x else b"" for x, y in zip(bounds[:-1], bounds[1:])]

    def ask_least(table: pa.Table, answers: pa.Table) -> dict[int, bytes]:
        blocks = answers.column("block").to_pylist()
        told = [_unpack(b[8:], "<u4", "<u4") for b in blocks]
        names = [np.uint64(struct.unpack_from("<q", b)[0]) << np.uint64(32) for b in blocks]
        known = np.concatenate([np.zeros(0, np.uint64), *[n | t[0] for n, t in zip(names, told)]])
        holders = np.concatenate([np.zeros(0, np.uint32), *[t[1] for t in told]])
        order = np.argsort(known)
        known, holders = known[order], holders[order].astype(np.int64)
        own = owners(table)
        data_, offsets_ = texts(table)
        keys, prints, docs_, bytes_, sizes, rows_, starts_ = ([] for _ in range(7))
        for a, offsets, data, begin in _sliced(table):
            rows, first, last, found = stretches(data, offsets)
            bucket, rest = _packed(found, buckets)
            asked = (bucket.astype(np.uint64) << np.uint64(32)) | rest
            place = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
            repeated = known[place] == asked if len(known) else np.zeros(len(asked), bool)
            rows, first, last, found = rows[repeated], first[repeated], last[repeated], found[repeated]
            held = holders[place[repeated]] if len(known) else np.zeros(0, np.int64)
            cut = held > HOT_DOCUMENTS
            n = np.where(cut, last - first + 1, 1)
            piece = np.repeat(np.arange(len(first)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            single = cut[piece]
            start = first[piece] + np.where(single, step, 0)
            end = np.where(single, start, last[piece]) + WINDOW
            up, down = _powers(len(data) + 1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
            size = end - start
            print_ = mix((total[end] - total[start]) * down[start] + size.astype(np.uint64))
            part = print_ % np.maximum(1, held[piece] // PART_DOCUMENTS).astype(np.uint64)
            keys.append(np.where(single, mix(found[piece] + part), found[piece]))
            prints.append(print_)
            docs_.append(own[a + rows[piece]])
            rows_.append((a + rows[piece]).astype(np.int32))
            starts_.append((begin + start - offsets[rows[piece]]).astype(np.int64))
            sizes.append(size.astype(np.uint8))
            bytes_.append(offsets_[a] + begin + start)
        key, print_, doc, row, start, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, prints, docs_, rows_, starts_, sizes))
        if not len(key):
            return {}
        at = np.concatenate(bytes_)
        order = brought_together(mix(key + print_))  # of one string by document, as the rows are
        k, p, z = key[order], print_[order], size[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (z[1:] != z[:-1])))
        alike = np.flatnonzero(~new)  # equal prints are only taken for equal strings if the bytes are
        new[alike] = ~same_bytes(data_, at[order[alike]], at[order[alike - 1]], z[alike].astype(np.int64))
        one = order[new]
        bucket = (key[one] % np.uint64(buckets)).astype(np.int64)
        dealt = np.lexsort((key[one], bucket))
        number = np.empty(len(one), np.int32)
        number[dealt] = np.arange(len(one), dtype=np.int32)
        string = np.empty(len(key), np.int32)
        string[order] = number[np.cumsum(new) - 1]
        one = one[dealt]
        names, first = np.unique(bucket[dealt], return_index=True)
        out: dict[int, bytes] = {}
        raw = data_.tobytes()
        group = int(table.column(GROUP)[0].as_py())
        for name, x, y in zip(names.tolist(), first, np.append(first[1:], len(one))):
            mine = one[x:y]
            parts = [raw[b : b + z] for b, z in zip(at[mine].tolist(), size[mine].tolist())]
            out[name] = struct.pack("<qq", name, group) + _pack(_packed(key[mine], 1)[1], doc[mine], size[mine], np.frombuffer(b"".join(parts), np.uint8))
        # what the group needs again with the answers goes along, to a bucket of its own: strings are numbered in the order of the asked blocks
        out[buckets + group] = struct.pack("<qq", -1, group) + _pack(row, start, size, string)
        return out

    def resolve_least(blocks: list[bytes]) -> list[bytes]:
        name = blocks[0][:8]
        if name == struct.pack("<q", -1):
            return blocks
        parts = [_unpack(b[16:], "<u4", "<i8", "u1", "u1") for b in blocks]
        key, doc, size, data = (np.concatenate([p[i] for p in parts]) for i in range(4))
        strings = [len(p[0]) for p in parts]
        shard = np.repeat([struct.unpack_from("<q", b, 8)[0] % SHARDS for b in blocks], strings)
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        string, one = distinct(data, start, size, doc, key)
        found = least_documents(data, start[one], size[one], doc[one], key[one], shard[one])
        windows = size - WINDOW + 1
        from_ = (np.cumsum(windows[one]) - windows[one])[string]
        least = found[np.repeat(from_ - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())]
        out = []
        at = np.concatenate(([0], np.cumsum(windows)))
        for a, b in zip(np.cumsum([0, *strings[:-1]]), np.cumsum(strings)):
            out.append(name + _pack(windows[a:b].astype(np.uint8), least[at[a] : at[b]]))
        return out

    def finish(table: pa.Table, blocks: list[bytes]) -> pa.Table:
        data, offsets = texts(table)
        own = owners(table)
        begins = np.zeros(len(data), np.int8)  # where removed windows begin
        blocks = sorted(blocks, key=lambda b: struct.unpack_from("<q", b)[0])
        if blocks:
            row, start, size, string = _unpack(blocks[0][16:], "<i4", "<i8", "u1", "<i4")
            told = [_unpack(b[8:], "u1", "<i8") for b in blocks[1:]]
            n, least = (np.concatenate([t[i] for t in told]) for i in range(2))
            n = n.astype(np.int64)
            at = np.cumsum(n) - n
            for a in range(0, len(row), 500_000):
                some = slice(a, a + 500_000)
                m = size[some].astype(np.int64) - WINDOW + 1
                step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                smaller = least[np.repeat(at[string[some]], m) + step] < np.repeat(own[row[some]], m)
                where = (np.repeat(offsets[row[some]] + start[some], m) + step)[smaller]
                begins[where] = 1
        count = np.cumsum(begins, dtype=np.int64)
        gone = count > 0  # a window of the last WINDOW places begins here or before; none crosses a row's end
        gone[WINDOW:] = count[WINDOW:] > count[:-WINDOW]
        spans, digests, kept = [], [], []
        for i in range(table.num_rows):
            flags = gone[offsets[i] : offsets[i + 1]]
            raw = data[offsets[i] : offsets[i + 1]]
            if flags.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                raw = raw[~flags]
            else:
                spans.append([])
            kept.append(raw.tobytes())
            digests.append(hashlib.sha256(kept[-1]).hexdigest())
        return pa.table({
            "doc_id": table.column("doc_id"),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_sha256": pa.array(digests, pa.string()),
            "kept": pa.array(kept, pa.binary()),
        })

    seen = room.answer(room.ask(ask_seen), resolve_seen)
    least = room.answer(room.ask(ask_least, seen), resolve_least)
    return room.apply(least, finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")


def op2_suffixes(spark, sf_dir: str) -> DataFrame:
    out = repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept) AS n_removed", "cast(size(spans) AS long) AS n_spans", "kept_sha256")


OP2_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS (SELECT doc_id, c, substr(x, 2 * c + 1, 2 * 549) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49, 500)) AS c FROM h WHERE len(x) >= 100)),
starts AS (SELECT doc_id, c, y, unnest(range(0, least(500, len(y) // 2 - 49))) AS q FROM pieces),
strings AS (SELECT doc_id, c + q AS p, md5(substr(y, 2 * q + 1, 100)) AS s FROM starts),
least_ AS (SELECT s, min(doc_id) AS m FROM strings GROUP BY s),
hits AS (SELECT doc_id, p FROM strings JOIN least_ USING (s) WHERE m < doc_id),
marked AS (SELECT doc_id, p, CASE WHEN p - coalesce(lag(p) OVER w, -1000) > 50 THEN 1 ELSE 0 END AS fresh FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY ALL),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM runs),
kept AS (
  SELECT h.doc_id, any_value(h.x) AS x, count(g.a) AS n_spans, coalesce(sum(g.b - g.a), 0) AS n_removed,
         coalesce(string_agg(substr(h.x, 2 * g.from_ + 1, 2 * (g.a - g.from_)), '' ORDER BY g.a), '') || substr(any_value(h.x), 2 * coalesce(max(g.b), 0) + 1) AS k
  FROM h LEFT JOIN gaps g USING (doc_id) GROUP BY h.doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept
"""

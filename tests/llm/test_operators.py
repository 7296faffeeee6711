"""The training-data operators: brute force on small inputs, and the defined results of odd inputs."""

import hashlib
import math
import os
import random
import re
import time
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from tests.compare import oracle, rows
from weftline.llm import decontamination, exchange, html_text, language, mixing, near_duplicates, quality, registry, substrings, suffixes, token_counts, topk

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def corpus(seed=0, n=60):
    """Words over a small alphabet, copies, near copies, shared passages, odd texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéüñ") for _ in range(r.randint(1, 9))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, texts = text(60), []
    for i in range(n):
        t = text(r.choice([1, 2, 5, 40, 120]))
        if i % 5 == 1 and texts:
            t = r.choice(texts)
        if i % 5 == 2 and texts:
            w = (r.choice(texts) or "x").split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 7 == 3:
            t = t + " " + passage + "\n" + text(5)
        texts.append(t)
    texts += ["", None, " \t\n", "Ein ", "a" * 5000, "A b C", "a B c"]
    return [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "é"][i % 4], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@has_tables
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), oracle(registry.oracle_sql()[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# ---- mixing


def water_fill(sizes, weights, cap):
    total, open_, out = sum(sizes.values()), dict(sizes), {}
    while True:
        share = {s: total * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > cap * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = cap * sizes[s]
            total -= out[s]
            del open_[s]


def test_mixing(spark, docs):
    got = mixing.plan(docs).collect()
    sizes = Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = Counter()
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
        taken[r["source"]] += r["taken"]
        assert len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(5)).collect()))


def test_mix_is_sorted_and_follows_the_schedule(spark):
    d = spark.createDataFrame([(i, "w " * 10, s) for i in range(300) for s in ("a", "b", "c")], "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    early = Counter(r["source"] for r in got if r["position"] < 0.5)
    whole = Counter(r["source"] for r in got)
    assert early["a"] / whole["a"] > 0.58 and early["c"] / whole["c"] < 0.42 and 0.45 < early["b"] / whole["b"] < 0.55


def test_mixing_odd_inputs(spark):
    assert mixing.plan(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(None, None, None, 1), (1, "a b", "x", 2), (1, "a b", "x", 2), (None, "c", None, 3)], "doc_id long, text string, source string, size int")
    got = mixing.plan(odd).collect()
    assert len(got) == 4 and sorted(r["size"] for r in got) == [0, 1, 2, 2]
    assert mixing.plan(spark.createDataFrame([(1, None, "x")], "doc_id long, text string, source string")).first()["taken"] == 0
    with pytest.raises(ValueError):
        mixing.invert([(0, 1)], F.lit(0.5))


def test_mixing_passes_columns_of_any_name(spark):
    extra = ["source_rank", "_mix_bucket", "_MIX_start", "a.b", "_in_3_source_rank", "Position", "Size"]
    d = spark.createDataFrame([(1, "a b", "x", *range(7)), (2, "c d e", None, *range(7))], ["doc_id", "text", "source", *extra])
    got = mixing.mix(d)
    assert got.columns == ["doc_id", "text", "source", *extra[:5], *[c for c in mixing.PLANNED if c != "positions"], "position"]
    assert {r["doc_id"]: (r["source_rank"], r["_mix_bucket"], r["_MIX_start"], r["a.b"], r["size"]) for r in mixing.plan(d).collect()} == {1: (0, 1, 2, 3, 2), 2: (0, 1, 2, 3, 3)}


def test_mixing_of_many_sources(spark):
    """Ranks, water levels and targets over more sources than partitions, against the plain loop."""
    r = random.Random(8)
    sizes = {f"s{i:04}": r.choice([1, 3, 50, 400]) for i in range(500)} | {None: 7}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    assert [g["source"] for g in sorted(got, key=lambda g: g["source_rank"])] == order
    assert all(math.isclose(g["target"], want[g["source"]], rel_tol=1e-9) for g in got)


# ---- suffixes


def brute_repeats(table):
    least = {}
    raw = [(d if d is not None else 1 << 62, (t or "").encode()) for d, t in table]
    for d, b in raw:
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            least[s] = min(d, least.get(s, 1 << 63))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed, hot, part", [(1, 4096, 256), (2, 2, 256), (3, 2, 1)])
def test_suffixes(spark, monkeypatch, seed, hot, part):
    monkeypatch.setattr(suffixes, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(suffixes, "PART_DOCUMENTS", part)
    table = [(r[0], r[1]) for r in corpus(seed)] + [(None, corpus(seed)[3][1]), (3, corpus(seed)[8][1]), (3, corpus(seed)[8][1]), (200, "ab" * 300), (201, "ab" * 200)]
    got = suffixes.repeated_spans(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()
    mine = sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), r["kept_sha256"]) for r in got)
    assert mine == brute_repeats(table)
    assert suffixes.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minimizers_of_one_rest_in_two_buckets(spark, monkeypatch):
    """Groups are told unlike sets of minimizers, many of one rest: hot and cold ones of two buckets must not be taken for each other."""
    whole = suffixes._packed
    monkeypatch.setattr(suffixes, "_packed", lambda h, n: (whole(h, n)[0], whole(h, n)[1] % np.uint32(64)) if n > 1 else whole(h, n))
    monkeypatch.setattr(suffixes, "HOT_DOCUMENTS", 8)
    monkeypatch.setattr(exchange, "GROUP_BYTES", 1_000)
    r = random.Random(5)
    passages = ["".join(r.choice("abcdefgh ") for _ in range(70)) for _ in range(24)]
    texts = [r.choice(passages[1:]) + "".join(r.choice("abcdefgh ") for _ in range(30)) + (passages[0] if i % 2 == 0 else "") for i in range(60)]
    got = suffixes.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((g["doc_id"], g["n_bytes"], g["n_bytes"] - len(g["kept"]), len(g["spans"]), g["kept_sha256"]) for g in got) == brute_repeats(list(enumerate(texts)))


def test_prints_are_no_evidence(spark, monkeypatch):
    """Hashes only deal strings out: with prints that are all alike, the bytes and the merge still tell windows apart."""
    monkeypatch.setattr(suffixes, "mix", lambda x: np.zeros_like(x))
    assert (suffixes.mix(np.arange(3)) == 0).all()
    data = np.frombuffer(b"a" * 60 + b"b" + b"a" * 60 + b"c" + b"a" * 70, np.uint8)
    assert suffixes.same_bytes(data, np.array([0, 0, 0]), np.array([61, 61, 120]), np.array([60, 60, 50])).tolist() == [True, True, False]
    table = [(r[0], r[1]) for r in corpus(6)]
    got = suffixes.repeated_spans(spark.createDataFrame(table, "doc_id long, text string").repartition(2)).collect()
    assert sorted((g["doc_id"], g["n_bytes"], g["n_bytes"] - len(g["kept"]), len(g["spans"]), g["kept_sha256"]) for g in got) == brute_repeats(table)


def test_unlike_strings_of_a_key_enter_the_merge(monkeypatch):
    """Keys are never split over two merges, however small those are; a key of one string has none."""
    strings = [b"a" * 60, b"b" * 55, b"ab" * 30, b"c" + b"b" * 52, b"b" * 51]
    keys = np.array([1, 2, 2, 4, 4], np.uint64)
    data, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings])
    merged, whole = [], suffixes.window_classes
    monkeypatch.setattr(suffixes, "window_classes", lambda data, starts, sizes, shard: merged.append(len(starts)) or whole(data, starts, sizes, shard))
    for most, parts in ((1 << 20, [4]), (1, [2, 2])):
        monkeypatch.setattr(suffixes, "MERGE_SYMBOLS", most)
        merged.clear()
        got = suffixes.least_documents(data, np.cumsum(sizes) - sizes, sizes, np.array([5, 4, 3, 2, 1]), keys, np.array([0, 1, 2, 3, 3]))
        assert merged == parts and len(got) == int((sizes - 49).sum()) and got[-2:].tolist() == [1, 1] and got[-6:-2].tolist() == [2, 1, 1, 1]
    assert suffixes.least_documents(data[:0], sizes[:0], sizes[:0], sizes[:0], keys[:0], sizes[:0]).tolist() == []


def test_groups_come_in_one_order():
    from weftline.llm.exchange import _ordered

    rows_ = [(2, "b"), (None, "x"), (1, None), (2, "a"), (1, "z")]
    table = lambda r: pa.table({"doc_id": pa.array([x[0] for x in r], pa.int64()), "text": pa.array([x[1] for x in r], pa.string())})
    assert _ordered(table(rows_)).equals(_ordered(table(rows_[::-1])))


def test_merged_transform_is_that_of_the_whole():
    r = random.Random(5)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(50, 80))) for _ in range(40)]
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes) - sizes
    windows = [s[i : i + 50] for s in strings for i in range(len(s) - 49)]
    for shards in (1, 2, 7):
        classes = suffixes.window_classes(data, starts, sizes, np.array([r.randrange(shards) for _ in strings])).tolist()
        assert len(set(zip(windows, classes))) == len(set(windows)) == len(set(classes))


def test_a_merge_reads_its_own_strings_alone():
    """A bucket's other bytes, far more than one merge takes, are not gone through again for each merge."""
    strings = [b"a" * 60, b"b" + b"a" * 52, b"ab" * 30]
    data = np.frombuffer(b"".join(strings) + b"x" * (64 << 20), np.uint8)
    sizes = np.array([len(x) for x in strings])
    starts, shard, spent = np.cumsum(sizes) - sizes, np.array([0, 1, 2]), []
    for bytes_ in (data[: sizes.sum()], data):
        runs = []
        for _ in range(5):
            begin = time.perf_counter()
            classes = suffixes.window_classes(bytes_, starts, sizes, shard).tolist()
            runs.append(time.perf_counter() - begin)
        spent.append(min(runs))
    windows = [x[i : i + 50] for x in strings for i in range(len(x) - 49)]
    assert len(set(zip(windows, classes))) == len(set(windows)) == len(set(classes)) and spent[1] < 10 * spent[0]


def test_values_are_ranked_with_and_without_room_for_positions():
    r = np.random.default_rng(4)
    for width in (3, 40, 63):
        values = r.integers(0, 1 << width, 5000, dtype=np.uint64) & ~np.uint64(1)
        values[2500:] = values[:2500]
        order, new = suffixes.ordered(values, width)
        assert order.tolist() == np.argsort(values, kind="stable").tolist() and new.sum() == len(set(values.tolist())) - 1
        assert suffixes.ranks(values, width).tolist() == np.unique(values, return_inverse=True)[1].tolist()
    hashes = np.repeat(r.integers(0, 1 << 63, 100, dtype=np.uint64), 30)[r.permutation(3000)]
    order = suffixes.brought_together(hashes)
    runs = np.split(order, np.flatnonzero(np.diff(hashes[order])) + 1)
    assert len(runs) == 100 and all((np.diff(x) > 0).all() for x in runs)


# ---- top-k


@pytest.mark.parametrize("seed", [0, 1])
def test_topk(spark, seed):
    r = np.random.default_rng(seed)
    v = r.normal(size=(300, 12)).astype(np.float32)
    v[50:90] = v[7]
    odd = [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (1050, [0.0] * 12), (1100, [2.0])]
    table = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + odd
    rows_ = topk.impacts(spark.createDataFrame(table, "vec_id long, embedding array<float>"))
    got = topk.top_k(rows_.filter("vec_id % 50 = 0"), rows_, 5).collect()
    ints = {i: np.floor(256 * np.array(x, np.float64)).astype(np.int64) for i, x in table if x is not None and all(y is not None and math.isfinite(y) for y in x)}
    dot = lambda a, b: int((a[: len(b)] * b[: len(a)]).sum())
    for q in [i for i in ints if i % 50 == 0]:
        want = sorted(((-dot(ints[q], x), i) for i, x in ints.items() if i != q))[:5]
        mine = [(-g["score"], g["vec_id"]) for g in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])]
        assert mine == want
    few = topk.impacts(spark.createDataFrame(table[:3], "vec_id long, embedding array<float>"))
    assert topk.top_k(few.filter("vec_id = 0"), few, 5).count() == 2
    assert topk.top_k(few.limit(0), few.limit(0), 5).count() == 0


def test_topk_of_repeated_ids_in_two_partitions(spark):
    schema = "vec_id long, embedding array<long>"
    a, b = spark.createDataFrame([(1, [1, 0])], schema), spark.createDataFrame([(1, [5, 0]), (2, [0, 9])], schema)
    got = topk.top_k(spark.createDataFrame([(50, [65536, 0])], schema), a.unionByName(b), 5).orderBy("rank").collect()
    assert [(g["vec_id"], g["score"]) for g in got] == [(1, 327680), (1, 65536), (2, 0)]


def test_maxscore_reads_less_where_bounds_tell(spark):
    r = np.random.default_rng(3)
    postings = r.integers(-4, 5, (64, 2000)).astype(np.float64)
    postings[:6] *= 200
    query, ids = np.ones(64), np.arange(2000)
    for beat in (None, float((query @ postings).max())):
        reads = [0, 0]
        score, found = topk.maxscore(query, postings, postings.min(1), postings.max(1), ids, 7, 5, beat, reads)
        want = sorted((-s, i) for i, s in enumerate(query @ postings) if i != 7 and (beat is None or s >= beat))[:5]
        assert list(zip((-score).tolist(), found.tolist())) == want and reads[0] < 0.4 * reads[1]


# ---- near duplicates


def brute_groups(table, k, percent):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = {d: shingles(t) for d, t in table}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((d, len(sets[d]), find(d), d == find(d)) for d in ids)


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    table = [(d[0], d[1]) for d in corpus(4)]
    for i in range(60):  # a group whose members are nearer to the base than to each other
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(120)] = f"x{i}{r.random()}"
        table.append((500 + i, " ".join(w)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(3), k, percent).collect()
    assert sorted((g["doc_id"], g["n_shingles"], g["component_id"], g["kept"]) for g in got) == brute_groups(table, k, percent)


def test_near_duplicates_odd_inputs(spark):
    schema = "doc_id long, text string"
    assert near_duplicates.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = near_duplicates.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "")], schema)).collect()
    assert sorted((str(g["doc_id"]), str(g["component_id"]), g["kept"]) for g in got) == [("2", "2", True)] * 2 + [("3", "3", True), ("4", "4", True), ("None", "None", True)]


def test_super_minhash_estimates():
    r = np.random.default_rng(0)
    found = []
    for n in (1, 4, 60, 2000):
        for _ in range(30):
            a = r.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate((a[: n // 2], r.integers(0, 2**63, n - n // 2).astype(np.uint64)))
            s = near_duplicates.super_minhash(np.concatenate((a, b)), np.array([0, n, 2 * n]))
            assert (s >> np.uint64(32)).max() < near_duplicates.SLOTS
            found.append((s[0] == s[1]).mean() - len(set(a) & set(b)) / len(set(a) | set(b)))
    assert abs(np.mean(found)) < 0.02
    for t in (0.8, 0.85):
        b, k = near_duplicates.banding(t)
        assert (1 - t**k) ** b <= near_duplicates.MISS and b * k <= near_duplicates.SLOTS


# ---- repeated passages


def brute_chunks(raw):
    """Chunks of one text, byte by byte."""
    ends, last, h = [], 0, 0
    gears = [int(x) for x in substrings._GEAR]
    space = b" \t\n\x0b\x0c\r"
    for i in range(len(raw)):
        h = (2 * h + gears[raw[i]]) % 2**32
        seen = h if i < 16 else sum(gears[raw[i - j]] << j for j in range(16))
        if seen % 65536 >= 65535 // (substrings.MEAN_CHUNK - substrings.LEAST_CHUNK) or i < 15:
            continue
        at = [c for c in range(i + 1, i + 2 + substrings.SNAP)]
        byte = lambda c: raw[min(c, len(raw) - 1)]
        cut = next((c for c in at if byte(c - 1) in space and byte(c) not in space), None) or next((c for c in at if byte(c) & 0xC0 != 0x80), at[0])
        if cut < len(raw) and cut - last >= substrings.LEAST_CHUNK:
            ends.append(cut)
            last = cut
    return list(zip([0, *ends], [*ends, len(raw)])) if raw else []


def brute_removed(table):
    """(n_bytes, spans, text) of each row by plain comparison of chunks."""
    first = {}
    own = lambda d: 1 << 63 if d is None else d
    parts = [(own(d), (t or "").encode()) for d, t in table]
    chunks = [brute_chunks(raw) for _, raw in parts]
    for (d, raw), cs in zip(parts, chunks):
        for a, b in cs:
            first[raw[a:b]] = min(d, first.get(raw[a:b], 1 << 64))
    out = []
    for (d, raw), cs, (_, t) in zip(parts, chunks, table):
        spans = []
        for a, b in cs:
            if first[raw[a:b]] < d:
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        spans = [s for s in spans if s[1] - s[0] >= substrings.MIN_RUN]
        kept = b"".join(raw[a:b] for a, b in zip([0] + [s[1] for s in spans], [s[0] for s in spans] + [len(raw)]))
        out.append((len(raw), spans, None if t is None else kept.decode()))
    return out


def test_substrings(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijéü日") for _ in range(r.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    table = [(i, " ".join(word() for _ in range(r.randint(0, 200))) + (" " + passage + " " if i % 3 == 0 else "") + " ".join(word() for _ in range(40))) for i in range(40)]
    table += [(100, None), (101, ""), (102, table[5][1]), (None, table[5][1]), (7, table[7][1]), (103, "no space " + "日本語" * 200), (104, "日本語" * 200), (105, "a" * 3000), (106, "a" * 2000)]
    frame = spark.createDataFrame([(*t, "x", i) for i, t in enumerate(table)], "doc_id long, text string, Spans string, rid long").repartition(3)
    got = substrings.remove_repeats(frame)
    assert got.columns == ["doc_id", "text", "rid", "n_bytes", "n_removed", "spans"]
    got = sorted(got.collect(), key=lambda g: g["rid"])
    want = brute_removed(table)
    assert [(g["n_bytes"], [[s["start"], s["end"]] for s in g["spans"]], g["text"]) for g in got] == want
    assert all((g["n_removed"] > 200) == (i % 3 == 0 and i > 0) for i, g in enumerate(got[:40]))
    assert [got[i]["text"] for i in (40, 41, 42, 43)] == [None, "", "", ""]
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_digests(spark):
    """A line that every document holds a hundred times is dealt over many tasks, and stays in the first document alone."""
    r = random.Random(2)
    line = "".join(r.choice("abcdefgh ") for _ in range(300))
    table = [(i, " ".join([line] * (30 if i < 20 else 0) + ["".join(r.choice("abcdefgh ") for _ in range(200))])) for i in range(30)]
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    chunked = substrings._chunked(frame.select(F.col("doc_id").alias("own"), F.xxhash64("text").alias("k1"), F.lit(0).alias("k2").cast("long"), "text"))
    assert chunked.select(F.inline("heavy")).count() > 0
    got = substrings.remove_repeats(frame).orderBy("doc_id").collect()
    assert [(g["n_bytes"], [[s["start"], s["end"]] for s in g["spans"]], g["text"]) for g in got] == brute_removed(table)


def test_a_very_long_text_in_blocks(spark, monkeypatch):
    """Cuts do not depend on the blocks that a text is hashed in, nor on the rows around it."""
    r = random.Random(9)
    raw = " ".join("".join(r.choice("abcdefghé") for _ in range(r.randint(1, 9))) for _ in range(60_000)).encode()
    whole = substrings.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
    assert [a for a, _ in brute_chunks(raw[:20_000])][:-2] == [a for a in whole if a < 20_000][: len(brute_chunks(raw[:20_000])) - 2]
    monkeypatch.setattr(substrings, "BLOCK", 1000)
    assert substrings.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() == whole
    two = np.frombuffer(b"x" * 37 + raw, np.uint8)
    assert (substrings.cuts(two, np.array([0, 37, len(two)]))[0][1:] - 37).tolist()[-len(whole) :] == whole


def test_chunks_resist_shifts():
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(800)).encode()
    cut = lambda b: {b[x:y] for s in [substrings.cuts(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].tolist()] for x, y in zip(s, [*s[1:], len(b)])}
    before, after = cut(text), cut(text[:100] + b" inserted words " + text[100:])
    assert len(before - after) <= 4 and len(before) > 100


# ---- tokens


def test_token_counts(spark, docs):
    import public_tokenizers
    import sentencepiece

    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    r = random.Random(0)
    odd = ["", " ", "  ", "\n", "\n\n a", "a  b", "▁a▁▁b", "<s> </s><unk>", "x\x00y", "日本語 text", "tab\tand\r\nline", "\x0b\x0c", " lead", "trail ", "🎉🎉 ok", "a" * 3000, "<0x0A>"]
    odd += ["".join(r.choice(" \nabz▁é<>0😀") for _ in range(r.randint(0, 60))) for _ in range(300)]
    counter = token_counts.PieceCounter(model)
    for t in odd:
        assert counter.count(t) == len(sp.encode(t)), repr(t)
    got = token_counts.count_tokens(docs, model).collect()
    assert len(got) == docs.count()
    for g in got:
        assert (g["n_bytes"], g["n_tokens"]) == (len((g["text"] or "").encode()), len(sp.encode(g["text"] or "")))
    counter.whole = True
    assert all(counter.count(t) == len(sp.encode(t)) for t in odd)
    clash = token_counts.count_tokens(spark.createDataFrame([(1, "a", "mine")], "doc_id int, text string, n_tokens string"), model)
    assert clash.first()["n_tokens"] == len(sp.encode("a")) and token_counts.count_tokens(docs.limit(0), model).count() == 0


# ---- quality


def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    forest = quality.train(x[:2000], y[:2000])
    p = forest.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.9
    slow = np.full(20, forest.base)
    for i in range(20):
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (x[2000 + i, f[node]] > t[node])
            slow[i] += leaf[node - len(f)]
    assert np.allclose(1 / (1 + np.exp(-slow)), p[:20])
    assert (quality.train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))) == 0.5).all()
    assert quality.train(x[:10], np.ones(10)).score(x[:3]).min() > 0.9


def test_statistics_by_hand():
    s = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["AB ab ab.\nab 12", None, ""]))[0]))
    assert s["log_words"] == np.log1p(5) and s["upper_words"] == 1 / 5 and s["digit_words"] == 1 / 5 and s["distinct_words"] == 3 / 5
    assert s["adjacent_repeats"] == 1 / 5 and s["stops"] == 1 / 5 and s["lines"] == np.log1p(2)
    assert not quality.statistics(pa.array([None, ""])).any() and quality.statistics(pa.array([], pa.string())).shape[0] == 0


real = quality.train


@has_tables
def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.op7_quality(spark, folder).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    held = got[got["held_out"]].join(labels, how="inner")
    assert len(held) > 30 and (held["predicted"] == held["quality"]).mean() > 0.93 and got["score"].between(0, 1).all()
    empty = spark.createDataFrame([], "doc_id long, text string, quality int")
    assert quality.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), quality.fit(empty.drop("quality"), empty.drop("text"))).count() == 2


def test_one_labelled_id_of_many_rows_is_learned_once(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(quality, "train", lambda x, y: sent.append(len(x)) or real(x, y))
    docs = spark.range(20_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    labels = spark.createDataFrame([(2, 1), (3, 0), (2, 0)], "doc_id long, quality int")
    quality.fit(docs.unionByName(spark.createDataFrame([(3, None)], "doc_id long, text string")), labels)
    assert sent == [2]


# ---- decontamination


def brute_coverage(item, doc, least=5):
    """Greedy tiles by comparing every pair of positions."""
    a, b = [True] * len(item), [True] * len(doc)
    covered = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and a[i + n] and b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered / len(item)
        a[i : i + n] = [False] * n
        b[j : j + n] = [False] * n
        covered += n


def test_tiling(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 40)))) for i in range(12)] + [(50, None), (51, ""), (None, "null id item with enough words in it")]
    table = []
    for i in range(40):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        leak = items[i % 12][1].split()
        if i % 4 == 1:
            w[10:10] = leak
        if i % 4 == 2:
            w[10:10] = leak[len(leak) // 2 :] + ["gap"] + leak[: len(leak) // 2]
        if i % 4 == 3:
            w[5:5] = leak[: len(leak) // 3]
        table.append((i, " ".join(w).upper() if i % 2 else ", ".join(w)))
    table += [(100, None), (101, ""), (102, "Null ID item; with enough words in it!")]
    got = decontamination.find_leaks(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    token = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for g in got:
        want = {i: c for i, t in items if len(token(t)) >= 5 and (c := brute_coverage(token(t), token(g["text"]))) >= 0.5}
        assert {x["item_id"]: round(x["coverage"], 9) for x in g["leaks"]} == {i: round(c, 9) for i, c in want.items()}, g["doc_id"]
        for x in g["leaks"]:
            assert all(0 <= s["start"] < s["end"] <= len(g["text"].encode()) for s in x["spans"])
    assert decontamination.find_leaks(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).filter("size(leaks) > 0").count() == 0


def test_tiling_is_linear_in_long_texts():
    r = random.Random(9)
    item = [r.randrange(1 << 40) for _ in range(20_000)]
    doc = [x if i % 10 else r.randrange(1 << 40) for i, x in enumerate(item)]
    began = time.time()
    tiles = decontamination.tile(item, doc, list(range(len(doc))))
    assert time.time() - began < 1.5
    assert sorted(tiles) == [(9, i, i) for i in range(1, 20_000, 10)]


def test_short_items_and_templates(spark, monkeypatch):
    """Items under MIN_MATCH tokens must occur whole; a template that all items share makes no pairs by itself; items of one text go chunk by chunk."""
    monkeypatch.setattr(decontamination, "CHUNK", 4)
    template = " ".join(f"template{j}" for j in range(9))
    items = [(i, template + " " + " ".join(f"t{i}x{j}" for j in range(15))) for i in range(40)] + [(100, "forty two indeed"), (101, "yes"), (None, "forty two")]
    texts = ["pre " + items[1][1] + " mid " + " ".join(f"t4x{j}" for j in range(15)), template, template + " only", "he said Forty-two, indeed!", "forty and two", "oh yes"]
    texts.append(" ".join(i[1] for i in items[:40]))
    d = spark.createDataFrame([(i, t, "keep", i) for i, t in enumerate(texts)] + [(9, None, "keep", 9)], "doc_id long, text string, Leaks string, h1 long")
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {g["doc_id"]: g for g in decontamination.find_leaks(d, frame).collect()}
    ids = lambda i: [x["item_id"] for x in got[i]["leaks"]]
    assert ids(0) == [1, 4] and ids(1) == ids(2) == ids(4) == ids(9) == [] and ids(3) == [None, 100] and ids(5) == [101] and ids(6) == list(range(40))
    assert all(g["h1"] == i for i, g in got.items()) and got[0].asDict().keys() == {"doc_id", "text", "h1", "leaks"}
    index = decontamination._index(decontamination._items(frame.filter("item_id < 40")), 0.5)
    assert index.groupBy("seed").count().filter("count > 1").count() == 0


# ---- language


@has_tables
def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = language.op9_language(spark, folder).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = got[got["held_out"]].join(truth, how="inner")
    assert len(held) > 100 and (held["lang_pred"] == held["lang"]).mean() > 0.95 and got["rejected"].mean() < 0.03


def test_language_odd_inputs(spark):
    words_ = {"en": "the and with that there which", "de": "und der nicht eine schon über", "fr": "les dans une être où très"}
    r = random.Random(0)
    table = [(i, " ".join(r.choice(words_[l].split()) for _ in range(80)), l) for i, l in enumerate(["en", "de", "fr"] * 30)]
    d = spark.createDataFrame(table, "doc_id long, text string, lang string")
    model = language.fit(language.training_rows(d))
    assert {m[0] for m in model} == set(words_)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "UND DER NICHT EINE", "x"), (5, "les dans une être " * 3000, "x")], "doc_id long, text string, score string")
    got = {g["doc_id"]: g for g in language.classify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["rejected"] and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "de" and got[5]["lang_pred"] == "fr" and 0 < got[5]["score"] <= 1
    none = language.fit(d.limit(0))
    assert none == [] and language.classify(d, none).filter("lang_pred <> 'und'").count() == 0


def test_language_against_plain_compression(spark):
    """The least of the sizes that fresh compressors give; ties go to the more frequent language, in an order that reruns keep."""
    import zstandard

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    some = {l: [word() for _ in range(60)] for l in ("xa", "xb", "xc")}
    text = lambda l, k: " ".join(r.choice(some[l]) for _ in range(k))
    train = [(text(l, 80), l) for i, l in enumerate(some) for _ in range(20 + i)]
    model = language.fit(spark.createDataFrame(train, "text string, lang string"))
    assert [m[0] for m in model] == ["xc", "xb", "xa"]
    table = [(i, text(r.choice("xa xb xc".split()), r.choice([20, 200, 3000]))) for i in range(40)] + [(100, (text("xa", 300) + " ") * 400)]

    def size(data, dictionary):
        coder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(coder.compress(data[a : a + language.BLOCK_BYTES])) for a in range(0, len(data), language.BLOCK_BYTES))

    for g in language.classify(spark.createDataFrame(table, "doc_id long, text string"), model).collect():
        sizes = [size(language.letters(g["text"]), m[1]) for m in model]
        best = min(range(3), key=sizes.__getitem__)
        assert g["margin"] >= language.MIN_MARGIN and g["lang_pred"] == model[best][0] and math.isclose(g["margin"], (sorted(sizes)[1] - sizes[best]) / sorted(sizes)[1])
    twins = [("two", b"one dictionary", b"filler"), ("one", b"one dictionary", b"filler")]
    tie = language.classify(spark.createDataFrame([("some words here",)], "text string"), twins).first()
    assert tie["lang_pred"] == "two" and tie["margin"] == 0 and tie["rejected"]


def test_language_of_copies(spark):
    """A language whose rows are nearly all copies is drawn by its texts, not by its rows."""
    r = random.Random(3)
    words_ = {"en": "the and with that there which", "de": "und der nicht eine schon über"}
    texts = {l: [" ".join(r.choice(w.split()) for _ in range(60)) for _ in range(20)] for l, w in words_.items()}
    table = [(t, "en") for t in texts["en"]] + [(t, "de") for t in texts["de"]]
    copies = spark.range(100_000).select(F.lit(texts["de"][0]).alias("text"), F.lit("de").alias("lang"))
    model = language.fit(spark.createDataFrame(table, "text string, lang string").unionByName(copies))
    assert [m[0] for m in model] == ["de", "en"]
    assert len(model[0][1]) + len(model[0][2]) > sum(len(t) for t in texts["de"])


def test_language_learns_every_language(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    words_ = {f"l{i}": [word() for _ in range(30)] for i in range(70)}
    table = [(" ".join(r.choice(w) for _ in range(60)), l) for l, w in words_.items() for _ in range(6)]
    d = spark.createDataFrame([*table, ("nothing is known of this one", None)], "text string, lang string")
    model = language.fit(d)
    assert {m[0] for m in model} == set(words_)
    assert language.classify(d.filter("lang IS NOT NULL"), model).filter("lang_pred <> lang OR rejected").count() == 0
    assert language.bounds(64) == (400, 5, 96 << 10, 4 << 10) and language.bounds(10**6) == language.LEAST


def test_language_reads_past_a_beginning(spark):
    """Texts that begin with pages of another language teach their own; every sampled text reaches the dictionary."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    some = {l: [word() for _ in range(40)] for l in ("en", "de")}
    text = lambda l, k: " ".join(r.choice(some[l]) for _ in range(k))
    table = [(text("en", 300) + " " + text("de", 2_000), "de") for _ in range(60)] + [(text("en", 300), "en") for _ in range(60)]
    model = language.fit(spark.createDataFrame(table, "text string, lang string"))
    odd = spark.createDataFrame([(text(l, 60), l) for l in some for _ in range(20)], "text string, lang string")
    assert language.classify(odd, model).filter("lang_pred <> lang OR rejected").count() == 0
    marks = [word() for _ in range(300)]
    (_, dictionary, filler), = language.fit(spark.createDataFrame([(" ".join([m] * 400), "en") for m in marks], "text string, lang string"))
    assert all(m.encode() in filler + dictionary for m in marks) and len(dictionary) <= language.DICTIONARY_BYTES
    assert language.spread([b"ab", b"", b"c" * 50], 20).startswith(b"ab  cccc") and len(language.spread([b"x" * 9] * 10, 50)) <= 50 and language.spread([], 9) == b""


# ---- HTML


def brute_cut(odds, edges):
    n = len(odds)
    best = None
    for mask in range(1 << n):
        keep = [bool(mask >> i & 1) for i in range(n)]
        cost = sum(round(abs(x) * 1000) for x, k in zip(odds, keep) if (x > 0) != k and x) + sum(c for a, b, c in edges if keep[a] != keep[b])
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 9)
        odds = [r.uniform(-4, 4) for _ in range(n)]
        edges = [(i, i + 1, r.randint(0, 3000)) for i in range(n - 1)] + [(i, i + 2, r.randint(0, 2000)) for i in range(n - 2)]
        keep = html_text.minimum_cut(odds, edges)
        cost = sum(round(abs(x) * 1000) for x, k in zip(odds, keep) if (x > 0) != k and x) + sum(c for a, b, c in edges if keep[a] != keep[b])
        assert cost == brute_cut(odds, edges)

LONG = "A sentence of some length, with a comma in it, tells what the story is about. "

#: Unlike pages, labelled by hand: (html, main text).
LABELLED = [
    # one form around the whole page
    (f"<body><form action=x><input type=hidden><div id=top><a href=a>Home</a> <a href=b>News</a></div><h1>Council votes</h1><p>{LONG * 3}</p><p>{LONG * 2}</p><div class=footer>Imprint</div></form></body>", f"Council votes\n{(LONG * 3).strip()}\n{(LONG * 2).strip()}"),
    # the article's own header and footer
    (f"<header><a href=/>Paper</a></header><article><header class=entry-header><h1>A title</h1></header><p>{LONG * 2}</p><footer class=entry-footer><a href=t>Tag</a></footer></article>", f"A title\n{(LONG * 2).strip()}"),
    # paragraphs whose class merely holds a listed word
    (f"<article><h1>T one</h1><p>{LONG * 2}</p><p class=alert>Mind the gap, it is wide here.</p><div class=social-history><p>{LONG}</p></div><p>{LONG * 2}</p></article>", f"T one\n{(LONG * 2).strip()}\nMind the gap, it is wide here.\n{LONG.strip()}\n{(LONG * 2).strip()}"),
    # an article inside a wrapper of a misleading name, junk outside
    (f"<div class=sidebar><a href=a>One</a> <a href=b>Two</a></div><div class=notice><article><h1>Found it</h1><p>{LONG * 4}</p></article></div><div class=promo>Buy this now, it is cheap.</div>", f"Found it\n{(LONG * 4).strip()}"),
    # formulas stay
    (f"<main><h1>Roots</h1><p>{LONG}The root is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p></main>", f"Roots\n{LONG}The root is x=2 here."),
    # no markup that tells, links before and after
    (f"<div><a href=a>Start</a></div><div><a href=b>Sports</a></div><div>{LONG * 4}</div><div>Then it rained.</div><div>{LONG * 4}</div><div><a href=c>Older</a></div>", f"{(LONG * 4).strip()}\nThen it rained.\n{(LONG * 4).strip()}"),
    # cookie notice, newsletter form, reader comments with articles of their own
    (f"<div class=cookie-notice><p>We use cookies. You may accept them all, or some.</p></div><article><h1>Rain again</h1><p>{LONG * 3}</p></article><form class=newsletter>Your address <input><button>Send</button></form><section id=comments><h2>Comments</h2><article><p>{LONG * 5}</p></article></section>", f"Rain again\n{(LONG * 3).strip()}"),
    # lists and headings of the article
    (f"<nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><main><h1>How to bake</h1><p>{LONG * 2}</p><h2>You need</h2><ul><li>Flour<li>Two eggs<li>A little salt</ul><p>{LONG * 2}</p></main>", f"How to bake\n{(LONG * 2).strip()}\nYou need\nFlour\nTwo eggs\nA little salt\n{(LONG * 2).strip()}"),
    # a table of the article, and a layout table of links
    (f"<table><tr><td><a href=a>Home</a><td><a href=b>About</a></table><article><h1>Scores</h1><p>{LONG * 2}</p><table><tr><th>Team<th>Points<tr><td>Reds<td>7</table><p>{LONG}</p></article>", f"Scores\n{(LONG * 2).strip()}\nTeam\nPoints\nReds\n7\n{LONG.strip()}"),
    # references, entities, white space, comments, CDATA-free scripts
    (f"<article><h1>Fish &amp;  chips</h1><p>It&nbsp;cost &pound;5,\n\t{LONG}</p><!-- <p>no</p> --><script>document.write('<p>no</p>')</script><style>p{{}}</style></article>", f"Fish & chips\nIt cost £5, {LONG.strip()}"),
    # hidden elements
    (f"<article><h1>Seen</h1><p style='display: none'>{LONG * 3}</p><p hidden>{LONG}</p><p>{LONG * 2}</p></article>", f"Seen\n{(LONG * 2).strip()}"),
    # an advert between paragraphs
    (f"<article><h1>Trains</h1><p>{LONG * 2}</p><div class=ad-slot><p>Fly for less. Book now and save a lot of money.</p></div><p>{LONG * 2}</p></article>", f"Trains\n{(LONG * 2).strip()}\n{(LONG * 2).strip()}"),
    # roles instead of elements
    (f"<div role=banner>The daily site of the town</div><div role=navigation><a href=a>A</a></div><div role=main><h1>Roles</h1><p>{LONG * 2}</p></div><div role=complementary><p>{LONG * 2}</p></div><div role=contentinfo>All rights reserved by us.</div>", f"Roles\n{(LONG * 2).strip()}"),
    # quotes and code
    (f"<article><h1>Loops</h1><p>{LONG}</p><pre>for x in y:\n    print(x)</pre><blockquote>{LONG}</blockquote></article>", f"Loops\n{LONG.strip()}\nfor x in y: print(x)\n{LONG.strip()}"),
    # related links inside the article
    (f"<article><h1>Bees</h1><p>{LONG * 3}</p><div class=related><h3>Related</h3><ul><li><a href=a>Wasps and their nests</a><li><a href=b>Honey</a></ul></div></article>", f"Bees\n{(LONG * 3).strip()}"),
    # links in running text
    (f"<div class=content><h1>Linked</h1><p>The <a href=a>river</a> runs by the <a href=b>old mill</a>, and so does the road. {LONG}</p></div><div id=footer><a href=c>Contact</a></div>", f"Linked\nThe river runs by the old mill, and so does the road. {LONG.strip()}"),
    # unclosed tags
    (f"<body><nav><a href=a>x</a></nav><article><h1>Open<p>{LONG * 2}<p>So it goes.<p>{LONG * 2}", f"Open\n{(LONG * 2).strip()}\nSo it goes.\n{(LONG * 2).strip()}"),
    # line breaks inside a block
    (f"<main><h1>Poem</h1><p>The first line<br>and the second,<br/>and {LONG}</p></main>", f"Poem\nThe first line and the second, and {LONG.strip()}"),
    # share buttons, breadcrumbs, pager
    (f"<ol class=breadcrumb><li><a href=a>Home</a><li>Here</ol><article><h1>Paths</h1><div class='share-buttons'><a href=f>Tell others</a></div><p>{LONG * 3}</p></article><div class=pagination><a href=n>Next</a></div>", f"Paths\n{(LONG * 3).strip()}"),
    # a log-in form inside the article
    (f"<article><h1>Members</h1><p>{LONG * 3}</p><form><label>Name</label><input><label>Password</label><input type=password><button>Go</button></form></article>", f"Members\n{(LONG * 3).strip()}"),
    # a figure and its caption
    (f"<article><h1>Towers</h1><figure><img src=a alt=no><figcaption>The tower at night, seen from the south.</figcaption></figure><p>{LONG * 2}</p></article>", f"Towers\nThe tower at night, seen from the south.\n{(LONG * 2).strip()}"),
    # other scripts
    ("<nav><a href=a>新闻</a></nav><article><h1>今天的天气很好，我们去公园。</h1><p>" + "孩子们在草地上跑来跑去，老人们在树下聊天。" * 4 + "</p></article>", "今天的天气很好，我们去公园。\n" + "孩子们在草地上跑来跑去，老人们在树下聊天。" * 4),
    # a long list of short items
    (f"<nav><a href=a>x</a></nav><article><h1>The team</h1><p>{LONG}</p><ul>" + "".join(f"<li>Name{i}" for i in range(12)) + "</ul></article>", "\n".join(["The team", LONG.strip(), *(f"Name{i}" for i in range(12))])),
    # nothing but navigation
    ("<nav><a href=a>A</a><a href=b>B</a></nav><footer>© 2026</footer>", ""),
    # plain text
    ("Just a text without any tag, as some servers send it.", "Just a text without any tag, as some servers send it."),
]


@pytest.mark.parametrize("i", range(len(LABELLED)))
def test_labelled_pages(i):
    assert html_text.main_text(LABELLED[i][0]) == LABELLED[i][1]


@has_tables
def test_the_cut_changes_labels_and_rightly(spark):
    """On the table's pages an article's short lines are boilerplate by their prose alone; the cut gives them to the article, and nothing else."""
    from weftline.functions.dom import parse

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_text.fit(pages)
    assert (weights == html_text.fit(pages.unionByName(pages).repartition(5))).all()
    changed = 0
    for r in pages.collect():
        page = html_text.Page(parse(r["html"]))
        article = re.search("<article>(.*?)<footer>", r["html"], re.S)[1]
        want = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1|article)>", article)]
        keep = html_text.labels(page, weights)
        assert [t for t, k in zip(page.texts, keep) if k] == [x for x in want if x], r["page_id"]
        changed += sum((o > 0) != k for o, k in zip(html_text.log_odds(page, weights), keep))
    assert changed >= 20


def test_deep_pages_take_linear_time():
    def seconds(depth):
        at = time.perf_counter()
        assert html_text.main_text("<div>" * depth + "Deep text stays where it is." + "</div>" * depth) == "Deep text stays where it is."
        return time.perf_counter() - at

    assert min(seconds(3_000) for _ in range(3)) < 0.5 and min(seconds(24_000) for _ in range(2)) < 4


def test_regression_moves_from_the_prior():
    assert tuple(html_text.regression(np.zeros((0, 8)), np.zeros(0))) == html_text.PRIOR
    x = np.column_stack((np.ones(400), np.tile(np.arange(4.0), 100), *np.zeros((6, 400))))
    w = html_text.regression(x, (x[:, 1] < 1.5).astype(float))
    assert w[1] < 0 and (w[2:] == html_text.PRIOR[2:]).all()


PAGE = """<!doctype html><html><head><title>T</title><style>x{}</style></head><body><header><a href=/>Site name</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies. You may accept them, and so on and on.</div><div class=layout><article><h1>The  title &amp; more</h1><p>First paragraph,
of the article.<p>Short.<div class="ad">Buy this great thing now. It is cheap.</div><p>Last one with a <a href=x>link</a> inside it.</p></article>
<aside class=sidebar><p>Popular: a long text that stands in the sidebar and is no part of it.</p></aside></div>
<section id=comments><article><p>Nice article, I liked to read it a lot!</p></article></section><form>Name <input><button>Send</button></form><footer>&copy; 2026</footer><script>var a="<p>no</p>";</script></body></html>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == "The title & more\nFirst paragraph, of the article.\nShort.\nLast one with a link inside it."
    bare = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html_text.main_text(bare).startswith("The title & more\nFirst paragraph")
    table = [(1, "u", None), (2, "u", ""), (3, None, "plain text"), (4, "u", "<p>" * 2000 + "deep"), (5, "u", PAGE), (5, "u", PAGE)]
    got = html_text.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()
    assert sorted((g["page_id"], g["n_chars"]) for g in got)[:4] == [(1, 0), (2, 0), (3, 10), (4, 4)] and len(got) == 6
    assert all(g["n_chars"] == len(g["text"]) for g in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clash = html_text.extract(spark.createDataFrame([(1, "mine", "<p>x</p>")], "page_id long, text string, html string"))
    assert clash.columns == ["page_id", "text", "n_chars"] and clash.first()["text"] == "x"


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    table = corpus(11, 40)
    item = " ".join(f"benchmark{i}" for i in range(12))
    table += [(900, "pre words here " + item + " after", "en", "s1", 1), (901, None, None, None, None), (None, "some words without an id at all", "en", "s1", 1)]
    spark.createDataFrame(table, DOCS).withColumn("rejected", F.lit("mine")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substrings", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        if name != "mixing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        if name == "near_duplicates":
            sets = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None], 5, 80)
            assert {r["doc_id"] for r in out.collect() if r["doc_id"] is not None} == {d for d, _, _, kept in sets if kept}
        if name == "decontamination":
            assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in out.collect()} == {900}
        docs = out
    assert docs.count() > 0 and "position" in docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], T._parse_datatype_string(DOCS)), str(tmp_path)).count() == 0


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{w}{i}" for i in range(20)) for w in "abc")
    table = [(7, one), (7, two), (5, three), (5, three), (9, two), (3, "z " + one), (3, two), (None, one)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in table], DOCS), "").select("doc_id", "text").collect()
    assert sorted(((g["doc_id"] or 0), g["text"]) for g in got) == sorted([(0, one), (5, three), (3, "z " + one), (3, two)])
    unlike = spark.createDataFrame([(7, one, "en", "s", 1), (7, two, "en", "s", 1)], DOCS)
    assert corpus_pipeline.drop_near_duplicates(spark, unlike, "").count() == 2


# ---- very long texts, clashing names, repeated rows: all operators


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 10))) for _ in range(5_000)]
    return " ".join(r.choice(vocabulary) for _ in range(400_000))


def test_very_long_texts(spark, long_text, tmp_path):
    import public_tokenizers
    import sentencepiece

    raw = long_text.encode()
    assert len(raw) > 2 << 20
    border = (1 << 20) - 30  # a passage across the slices that long rows are cut into
    passage = raw[border : border + 400].decode(errors="ignore")
    table = [(1, "before " + passage + " after"), (2, long_text), (3, long_text + " more"), (4, "short")]
    d = spark.createDataFrame(table, "doc_id long, text string")
    words_ = len(WORD.findall(long_text))
    assert {g["doc_id"]: g["size"] for g in mixing.plan(d.withColumn("source", F.lit("s"))).collect()}[2] == words_
    got = {g["doc_id"]: g for g in suffixes.repeated_spans(d).collect()}
    assert len(got[1]["spans"]) == 0 and len(got[2]["spans"]) == 1 and 398 <= len(raw) - len(got[2]["kept"]) <= 402 and got[3]["kept"][-5:] == b" more" and len(got[3]["kept"]) < 100
    near = {g["doc_id"]: g for g in near_duplicates.near_duplicates(d).collect()}
    assert near[3]["component_id"] == 2 and near[1]["component_id"] == 1 and near[2]["n_shingles"] > 390_000
    cut = {g["doc_id"]: g for g in substrings.remove_repeats(d).collect()}
    assert cut[3]["n_removed"] > 0.99 * len(raw) and 200 < cut[2]["n_removed"] <= 400 and cut[1]["n_removed"] == 0
    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    tokens = {g["doc_id"]: g["n_tokens"] for g in token_counts.count_tokens(d, model).collect()}
    assert tokens[2] == len(sentencepiece.SentencePieceProcessor(model_proto=model).encode(long_text))
    whole = dict(zip(quality.STATISTICS, quality.statistics(pa.array([long_text]))[0]))
    assert math.isclose(whole["log_words"], math.log1p(words_)) and math.isclose(whole["log_bytes"], math.log1p(len(raw)))
    leaks = decontamination.find_leaks(d, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()
    assert {g["doc_id"]: len(g["leaks"]) for g in leaks} == {1: 1, 2: 1, 3: 1, 4: 0}
    learned = language.fit(spark.createDataFrame([(long_text, "xx"), ("der die das und " * 50, "de")], "text string, lang string"))
    assert {g["doc_id"]: g["lang_pred"] for g in language.classify(d, learned).collect()}[3] == "xx"
    page = "<article><h1>Long</h1>" + "".join(f"<p>{long_text[i : i + 500]}</p>" for i in range(0, 2_000_000, 500)) + "</article><footer>x</footer>"
    assert html_text.main_text(page).count("\n") == 4_000 and html_text.main_text("<p>" + long_text) == " ".join(long_text.split())


def test_all_columns_pass(spark):
    """Operators that return their input's columns return all of them, whatever their names, and repeated rows as often as they came."""
    names = ["own", "k1", "rid", "start", "chunks", "h1", "_hot", "_salt", "_mix_hash", "source_rank", "_exchange_group", "_label", "_x", "_node", "_aside0", "a.b", "Place"]
    row = (1, "some words that are long enough to tell a language by", "s", *range(len(names)))
    d = spark.createDataFrame([row, row, (None, None, None, *range(len(names)))], ["doc_id", "text", "source", *names])
    items = spark.createDataFrame([(1, "not in it at all, no")], "item_id long, text string")
    model = [("en", b"words", b"filler"), ("de", b"woerter", b"mehr")]
    import public_tokenizers

    tokens = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    forest = quality.train(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    for out in (mixing.plan(d), substrings.remove_repeats(d), decontamination.find_leaks(d, items), language.classify(d, model), quality.score(d, forest), token_counts.count_tokens(d, tokens)):
        assert out.columns[: len(d.columns)] == d.columns, out.columns
        got = sorted(map(str, (tuple(g)[: len(d.columns)] for g in out.collect())))
        assert got == sorted(map(str, map(tuple, d.collect())))
    clash = spark.createDataFrame([(None, "x", 5.0)], "doc_id long, text string, Score double")
    assert quality.score(clash, forest).columns == ["doc_id", "text", "score"] and quality.score(clash.limit(0), forest).count() == 0

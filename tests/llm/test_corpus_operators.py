"""Line dedup, Merkle manifest and phrase collocations: plain versions on small inputs, and the defined results of odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import collocations, lines, manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- lines


def plain_lines(texts, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if not key(x) or held[key(x)] < least]
        out.append((None if t is None else "\n".join(stay), len(all_), len(all_) - len(stay)))
    return out


def line_texts(seed):
    r = random.Random(seed)
    pool = ["Menu", " menu\t", "MENU\r", "É", "é", "", "  ", "a\x0bb", "All rights reserved ", *[f"line {i}" for i in range(60)]]
    return ["\n".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(80)] + [None, "", "\n", "\n\n ", "x" * 300_000, "Menu\n" * 20_000]


@pytest.mark.parametrize("seed,least,shard_lines", [(0, 10, 1 << 20), (1, 3, 20), (2, 1, 7)])
def test_lines(spark, seed, least, shard_lines):
    texts = line_texts(seed)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    index = lines.line_index(docs, shard_lines)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_lines(docs, least, index).collect()}
    assert [got[i] for i in range(len(texts))] == plain_lines(texts, least)


def test_line_index_is_minimal_and_perfect():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 5_000):
        keys = np.empty(n, lines._DIGEST)
        keys["h1"], keys["h2"] = r.integers(0, 1 << 63, n), r.integers(0, 1 << 63, n)
        if n == 5_000:
            keys["h1"][:10] = keys["h1"][0]  # one half may be equal
        levels = lines.perfect_hash(keys)
        assert sorted(lines.slots(keys, levels).tolist()) == list(range(n))
        assert sum(len(x) for x in levels) <= 4 * n + 64 * 20


def test_foreign_lines_are_told_by_their_fingerprints(spark):
    own = spark.createDataFrame([(i, f"shared\nown {i}") for i in range(40)], "doc_id long, text string")
    other = spark.createDataFrame([(1, "Shared\nforeign 1\nown 3"), (2, "\n".join(f"foreign {i}" for i in range(2_000)))], "doc_id long, text string")
    index = lines.line_index(own)
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.drop_lines(other, 10, index).collect()}
    assert got[1] == ("foreign 1\nown 3", 1) and got[2][1] == 0


def test_lines_odd_inputs(spark):
    none = spark.createDataFrame([], DOCS)
    assert lines.drop_lines(none).collect() == []
    assert lines.drop_lines(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect() == [(1, None, 1, 0), (2, "", 1, 0)]
    rows = [(None, "A\nb", 1, "x", 5)] * 9 + [(7, "a \nc", 1, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, `a.b` string, block long")
    got = lines.drop_lines(docs).collect()
    assert lines.drop_lines(docs).columns == ["doc_id", "text", "a.b", "block", "n_lines", "n_dropped"]
    assert Counter(r["text"] for r in got) == {"b": 9, "c": 1} and {r["n_dropped"] for r in got} == {1}


# ---- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    first = lambda v: (v is not None, v)
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by[s].sort(key=lambda row: (first(row[0]) if row[0] is not None else (False, 0), plain_leaf(row)))
        trees.append(plain_tree([plain_leaf(r) for r in by[s]]))
    over = plain_tree([t[-1][0] for t in trees])
    root, out = over[-1][0], []
    for j, s in enumerate(sources):
        for i, row in enumerate(by[s]):
            siblings, node = [], plain_leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                node = plain_leaf((*row[:4], row[4].replace("\n", "")))
            for levels, at in ((trees[j], i), (over, j)):
                for level in levels[:-1]:
                    a = at - at % 3
                    run = level[a : a + 3]
                    siblings += run[: at - a] + run[at - a + 1 :]
                    node = h(*run[: at - a], node, *run[at - a + 1 :])
                    at //= 3
            out.append((row[0], plain_leaf(row), trees[j][-1][0], root, h(*siblings), node, node == root))
    return out


def altered(docs):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return docs.withColumn("altered", F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


SHAPES = {
    "one row": [(5, "s", None, 3, "a\nb")],
    "one source": [(i, "s", "en", 1, f"t{i}\nx") for i in range(82)],
    "edges of blocks": [(i, f"s{n}", "en", None, f"é\n{i}") for n in (1, 2, 3, 8, 9, 10, 26, 27, 28) for i in range(n)],
    "many sources": [(i, f"s{i}" if i % 7 else None, None, i, None if i % 5 == 0 else f"t\n{i}") for i in range(120)],
    "repeated rows and ids": [(i % 4 if i % 3 else None, "é" if i % 2 else None, "en", 2, ["", "a\n", "b", "a\n"][i % 4]) for i in range(40)],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("depth,top", [(7, 4096), (2, 4), (1, 1)])
def test_manifest(spark, shape, depth, top):
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in SHAPES[shape]], DOCS).repartition(3)
    got = manifest.manifest(altered(docs), depth=depth, top=top).drop("source")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_manifest(SHAPES[shape])))


def test_manifest_odd_inputs(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([(1, "t", "en", "s", 1, 9, "z")], DOCS + ", leaf long, `pos.x` string")
    (r,) = manifest.manifest(docs).collect()
    assert r["leaf"] == r["root"] == r["subroot"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == hashlib.sha256().hexdigest()
    (r,) = manifest.manifest(docs.withColumn("text", F.lit("y" * 1_000_000))).collect()
    assert r["leaf"] == plain_leaf((1, "s", "en", 1, "y" * 1_000_000))


def test_manifest_tells_any_change(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(30)], DOCS)
    got = manifest.manifest(docs.withColumn("altered", F.when(F.col("doc_id") == 11, F.lit("text  11")).otherwise(F.col("text"))))
    assert [r["doc_id"] for r in got.filter("NOT verified").collect()] == [11]


# ---- collocations


def plain_collocations(rows, least=10, longest=3, top=2000, percent=50):
    """rows: (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {(lang, w): a for (lang, w), a in f.items() if len(w) > 1 and a >= least}
    inside = {}
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = (lang, w[i : i + m])
                inside[key] = max(inside.get(key, 0), a)
    out = {}
    for (lang, w), a in found.items():
        score, _, l, r = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        if 100 * inside.get((lang, w), 0) < percent * a:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def phrase_rows(seed):
    r = random.Random(seed)
    vocabulary = ["The", "the", "of", "Ñu", "ñu", "new\xa0york", "york", "city", "a", "𝄞"] + [f"w{i}" for i in range(40)]
    text = lambda: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "?"]) for _ in range(r.randint(0, 60)))
    rows = [(text() + "new york city " * r.randint(0, 2), r.choice(["en", "en", "de", None, "und", ""])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), (" \t.\n", "de"), ("a a a a a a a a a a a a a", "en"), ("of the " * 5_000, "fr")]


@pytest.mark.parametrize("seed,least,longest,top", [(0, 10, 3, 2000), (1, 3, 4, 2000), (2, 2, 2, 7), (3, 200, 3, 50)])
def test_collocations(spark, seed, least, longest, top):
    rows = phrase_rows(seed)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = collocations.collocations(docs, least=least, longest=longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, longest, top)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    rows = phrase_rows(4)
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "NARROW", collocations.BLOCK)
    full = collocations.counts(docs.fillna("und", ["lang"]).fillna("", ["text"]), 5, 3, wide=collocations.BLOCK)
    wide = collocations.counts(docs.fillna("und", ["lang"]).fillna("", ["text"]), 5, 3)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, wide.collect()))


def test_sketches_never_count_too_little(spark):
    size, least = collocations.BLOCK, 4
    docs = spark.createDataFrame([(t, lang or "und") for t, lang in phrase_rows(5) if t is not None], "text string, lang string").repartition(6)
    bits = np.zeros((collocations.DEPTH, size), bool)
    for r in collocations.sketch(docs, size, least, 2).collect():
        bits[r["row"], r["block"] * collocations.BLOCK : (r["block"] + 1) * collocations.BLOCK] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(docs.toPandas())
    hashes, piece, _, _ = collocations.tokens(batch)
    seen = 0
    for _, _, grams in collocations.gram_hashes(hashes, piece, 2):
        distinct, n = np.unique(grams, return_counts=True)
        for g, count in zip(distinct, n):
            let = all(bits[row, collocations._places(np.array([g]), row, size)[0]] for row in range(collocations.DEPTH))
            assert let or count < least
            seen += not let
    assert seen > 100  # and rare ones are held back


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_999_999_999_999
    found = spark.createDataFrame([("en", 1, "x", big), ("en", 1, "y", big - 2), ("en", 2, "x y", big - 5)], "lang string, k int, phrase string, f long")
    (r,) = collocations.scored(found, 2).collect()
    assert r["score"] == 1000000 * (big - 5) ** 2 // (big * (big - 2))


def test_collocations_odd_inputs(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect() == []
    docs = spark.createDataFrame([("b a b a. " * 10, 1, "x")], "text string, k long, phrase string").withColumn("lang", F.lit(None).cast("string"))
    got = collocations.collocations(docs).collect()
    assert [(r["lang"], r["phrase"], r["a"], r["n"]) for r in got] == [(l, p, a, n) for l, _, p, a, _, _, n, _ in plain_collocations([("b a b a. " * 10, None)])]

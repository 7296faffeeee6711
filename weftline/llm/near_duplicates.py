"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, connected groups.

SuperMinHash ranks every element of a set by one random permutation of the slots, drawn lazily: step j gives an element
the value j + r in the slot its permutation names j-th, so slots of one element are correlated and the estimate varies
less than with independent hashes. A row is done once no slot can fall below the next step's values.

Rows with equal sets form a class and are represented once. Classes that share a band bucket are candidates. A bucket is
never expanded into pairs of all its members at first: it is a star around its most central member (the one that shares
the most bucket places), and every arm is confirmed on full sets. Only members that the confirmed links leave in other
components than the rest of their bucket go on: they meet all members of the hub's buckets, set by set within blocks,
less those that sizes or the triangle inequality of the Jaccard distance rule out. So every candidate pair is either
confirmed, or ruled out exactly, or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import batches, durable, grams, hot_keys, matched, mix, read, utf8, words

SLOTS = 128
#: The chance that a pair at the threshold shares no band.
MISS = 1e-6
_STEP = np.uint64(0xD1B54A32D192ED03)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def banding(threshold: float, slots: int = SLOTS) -> tuple[int, int]:
    """(bands, rows): the most rows in a band at which a pair at the threshold is missed with a chance of MISS at most."""
    fits = [r for r in range(1, slots + 1) if (1 - threshold**r) ** (slots // r) <= MISS]
    return slots // max(fits, default=1), max(fits, default=1)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted, end to end, and where each row starts."""
    hashes, _, _, rows = words(*utf8(texts))
    found, starts = grams(hashes, rows, k)
    parts = [np.unique(found[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
    return (np.concatenate(parts) if parts else found), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def super_minhash(elements: np.ndarray, starts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures, one row for each set; a value is the step in the upper and the rank in the lower 32 bits. Empty sets keep the value ``slots`` << 32."""
    n = len(starts) - 1
    signature = np.full((n, slots), np.uint64(slots) << _32, np.uint64)
    flat = signature.ravel()
    row = np.repeat(np.arange(n), np.diff(starts))
    live = np.arange(len(elements))
    place = order = None
    with np.errstate(over="ignore"):
        for j in range(slots):
            z = mix(elements[live] + _STEP * np.uint64(j + 1))
            k = (np.uint64(j) + (((z & _LOW) * np.uint64(slots - j)) >> _32)).astype(np.int64)
            if j:
                slot = order[place, k]
                order[place, k] = order[place, j]
            else:
                slot = k
            np.minimum.at(flat, row[live] * slots + slot, (np.uint64(j) << _32) | (z >> _32))
            unsettled = (signature.max(1) >> _32) > np.uint64(j)
            keep = unsettled[row[live]]
            if not keep.any():
                break
            live = live[keep]
            if j:
                place = place[keep]
            else:
                place = np.arange(len(live))
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(live), 1))
                order[place, k[keep]] = 0
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            keys = mix(keys * _STEP + signature[:, i : bands * rows : rows])
        return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * _STEP).view(np.int64)


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, bands): two fingerprints of the whole set, and its band keys."""
    bands, rows = banding(threshold)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text"):
            elements, starts = shingle_sets(batch.column("text"), k)
            keys = band_keys(super_minhash(elements, starts), bands, rows)
            with np.errstate(over="ignore"):
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements * _STEP + np.uint64(i)), dtype=np.uint64))) for i in (1, 2)]
                prints = [(s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums]
            at = pa.array(np.arange(len(keys) + 1) * bands, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(starts), pa.int64()), *(pa.array(p) for p in prints), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))],
                names=["doc_id", "n_shingles", "fp1", "fp2", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text"):
            elements, starts = shingle_sets(batch.column("text"), k)
            blobs = pa.array([elements[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), blobs], names=["node", "elements"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node long, elements binary")


#: Members of a block, and bytes of the sets that a task holds of it.
BLOCK = 256
BLOCK_BYTES = 16 << 20


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets have in common."""
    if not len(a) or not len(b):
        return 0
    spot = np.searchsorted(b, a)
    spot[spot == len(b)] = 0
    return int(np.count_nonzero(b[spot] == a))


def confirm(arms: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, node, common, total, linked) of the distinct ``arms`` (hub, node), on full sets; linked = 100 * common >= percent * total.

    The arms of a hub are cut into blocks of about BLOCK; a block holds the hub's set, and the arms' sets stream past it.
    """
    degrees = durable(arms.groupBy("hub").agg(F.count(F.lit(1)).alias("degree")))
    placed = matched(arms, degrees, ["hub"], hot_keys(degrees, ["hub"], "degree"), "node")
    placed = placed.select("hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("degree") / BLOCK)).alias("x"), "node")
    streamed = placed.join(sets, "node").select("hub", "x", F.lit(1).alias("side"), "node", "elements")
    held = placed.select("hub", "x").distinct().join(sets.withColumnRenamed("node", "hub"), "hub").select("hub", "x", F.lit(0).alias("side"), F.col("hub").alias("node"), "elements")
    dealt = held.unionByName(streamed).repartition("hub", "x").sortWithinPartitions("hub", "x", "side")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for batch in stream:
            out: list[tuple[int, int, int, int]] = []
            hubs, sides, nodes, blobs = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            for i, hub in enumerate(hubs):
                own = np.frombuffer(blobs[i].as_buffer(), np.uint64)
                if sides[i] == 0:
                    known = np.array(own)
                    continue
                common = _shared(own, known)
                out.append((hub, nodes[i], common, len(own) + len(known) - common))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["hub", "node", "common", "total"])

    found = dealt.mapInArrow(run, "hub long, node long, common long, total long")
    return found.withColumn("linked", F.col("common") * 100 >= F.col("total") * percent)


def _forest(links: DataFrame) -> DataFrame:
    """Each batch's links as a forest of stars to the smallest member: union-find within the batch."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                root = x
                while parent.setdefault(root, root) != root:
                    root = parent[root]
                while parent[x] != root:
                    parent[x], x = root, parent[x]
                return root

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            rows = [(x, find(x)) for x in list(parent) if find(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b) but the components' smallest nodes, by alternating large and small stars."""
    edges = _forest(links)
    while True:
        ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
        both = edges.select(ends).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["w"]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "w"), F.col("a") == F.col("w"))
        pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")
        edges = durable(small.select(pairs).select("e.a", "e.b").filter("a <> b").distinct())
        roles = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("root")), F.struct(F.col("b").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))).alias("r")).select("r.*")
        unsettled = roles.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).filter("leaf > 1 OR leaf = 1 AND root = 1")
        if unsettled.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * common >= percent * united of their sets of distinct k-word shingles (words of
    ASCII-lower-cased text; fewer than k words: the whole sequence as one shingle). component_id is the smallest doc_id of
    the linked group, kept says that the row is it. Null, empty or wordless texts have no shingles and are linked with
    nothing. Repeated rows are equal and share their component; rows of one doc_id with different texts count as one node.
    A null doc_id takes no part: component_id is null and kept is true. Shingles are compared by 64-bit hashes.
    """
    base = durable(signatures(docs, k, percent / 100))
    part = base.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    whole = ["fp1", "fp2", "n_shingles"]
    classes = durable(part.groupBy(*whole).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows")))
    found = _groups(docs, classes, k, percent)
    copies = classes.select(*whole, "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*whole, F.coalesce("component", "rep").alias("component"))
    slim = base.select("doc_id", *whole)
    out = matched(slim.filter("n_shingles > 0"), copies, whole, hot_keys(classes, whole, "rows"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    out = out.unionByName(slim.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _groups(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) by confirmed links that connect every pair of candidates which is linked or joined by linked ones."""
    places = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = durable(places.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    hot = hot_keys(shared, ["key"], "size")
    places = durable(matched(places, shared, ["key"], hot, "rep"))
    possible = (F.col("n") * 100 >= F.col("hub_n") * percent) & (F.col("hub_n") * 100 >= F.col("n") * percent)
    central = durable(places.groupBy("rep").agg(F.sum("size").alias("c")))
    sets = durable(_sets(docs.join(central, docs["doc_id"] == central["rep"], "left_semi"), k))
    rank = F.max(F.struct("c", (-F.col("rep")).alias("r"), "n"))
    hubs = places.join(central, "rep").groupBy("key").agg(rank.alias("h")).select("key", (-F.col("h.r")).alias("hub"), F.col("h.n").alias("hub_n"))
    placed = durable(matched(places.select("key", "rep", "n"), hubs, ["key"], hot, "rep"))
    arms = placed.filter((F.col("rep") != F.col("hub")) & possible)
    tested = durable(confirm(arms.select("hub", F.col("rep").alias("node")).distinct(), sets, percent))
    groups = components(tested.filter("linked").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    labelled = placed.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("key", "hub", "rep", "n", F.coalesce("component", "rep").alias("component"))
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("members"), F.max("n").alias("largest")).filter("members > largest")
    odd = F.max(F.col("component") != F.col("main")).alias("odd")
    apart = matched(labelled, mixed.select("key", "main"), ["key"], hot, "rep").groupBy(F.col("hub").alias("cluster"), F.col("rep").alias("node"), "n", "component").agg(odd)
    apart = durable(apart)
    if apart.isEmpty():
        return groups
    distance = tested.select(F.col("hub").alias("cluster"), "node", (1 - F.col("common") / F.col("total")).alias("d"))
    found = durable(_across(apart, distance, sets, percent))
    if found.isEmpty():
        return groups
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))


def _across(apart: DataFrame, distance: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of a cluster as far as its members' sets do; one of each pair is ``odd``.

    The members of all buckets of one hub are a cluster. Its odd members meet all of its members in blocks of BLOCK by
    BLOCK sets, fewer where sets are large (BLOCK_BYTES), so no pair is ever a row. In a block, pairs of components that
    are joined already are passed over, and so are pairs whose sizes or whose distances to the hub differ too much to be
    linked.
    """
    blocks = lambda rows, size: F.greatest(F.ceil(rows / BLOCK), F.ceil(size * 8 / BLOCK_BYTES))
    odd = F.col("odd").cast("long")
    degrees = apart.groupBy("cluster").agg(F.count(F.lit(1)).alias("degree"), blocks(F.count(F.lit(1)), F.sum("n")).alias("xs"), blocks(F.sum(odd), F.sum(odd * F.col("n"))).alias("ys"))
    degrees = durable(degrees)
    rows = matched(apart, degrees.select("cluster", "xs", "ys"), ["cluster"], hot_keys(degrees, ["cluster"], "degree"), "node").join(distance, ["cluster", "node"], "left")
    rows = rows.withColumn("d", F.when(F.col("node") == F.col("cluster"), 0.0).otherwise(F.col("d")))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    some = ["node", "n", "component", "d"]
    streamed = rows.select("cluster", own("xs").alias("x"), every("ys").alias("y"), F.lit(1).alias("side"), *some)
    held = rows.filter("odd").select("cluster", own("ys").alias("y"), every("xs").alias("x"), F.lit(0).alias("side"), *some)
    dealt = held.unionByName(streamed).join(sets, "node").select("cluster", "x", "y", "side", *some, "elements")
    dealt = dealt.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "side", "node")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, parent = None, [], {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent.setdefault(parent[x], parent[x])
                x = parent[x]
            return x

        for batch in stream:
            links: list[tuple[int, int]] = []
            columns = [batch.column(i).to_pylist() for i in range(8)]
            blobs = batch.column(8)
            for i, (cluster, x, y, side, node, n, component, d) in enumerate(zip(*columns)):
                if (cluster, x, y) != at:
                    at, known, parent = (cluster, x, y), [], {}
                own_set = np.frombuffer(blobs[i].as_buffer(), np.uint64)
                if side == 0:
                    known.append((node, n, component, d, np.array(own_set)))
                    continue
                for b, m, other, e, elements in known:
                    if find(component) == find(other) or n * 100 < m * percent or m * 100 < n * percent:
                        continue
                    if d is not None and e is not None and abs(d - e) * 100 > 100 - percent + 1e-6:
                        continue
                    common = _shared(own_set, elements)
                    if common * 100 >= (n + m - common) * percent:
                        links.append((node, b))
                        parent[find(component)] = find(other)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in range(2)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM words UNION SELECT r.x, s.y FROM reach r JOIN sym s ON s.x = r.y),
least_ AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) JOIN least_ ON least_.x = w.doc_id
"""

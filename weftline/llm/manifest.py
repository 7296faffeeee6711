"""A Merkle manifest of a table: every row's leaf, its proof, and one root over all sources.

Rows are range-sorted by source and id, so a row's place within its source is its place in its partition and one carry for
each partition. Aligned blocks of 3^DEPTH leaves are reduced where they lie; rounds of such blocks go on until few nodes are
left. The driver builds the tree above them and broadcasts each node's way up (its suffix path); going back down, every
round's blocks put their own siblings in front, and the leaves' blocks finish proofs and folds row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from .common import read, stored

#: Fixed value: children of a node.
FAN = 3
#: Levels of a block (2,187 leaves); nodes that the driver's tree has at most; rows of a sorted partition.
DEPTH, TOP, PART_ROWS = 7, 4096, 400_000

#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """H: SHA-256 of the inputs one after the other, digests as hex text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def levels_of(nodes: list[bytes], most: int | None = None) -> list[list[bytes]]:
    """The levels of a tree over ``nodes``, from them up: exactly ``most`` above them, or until one node is left."""
    levels = [nodes]
    while len(levels) <= most if most is not None else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return levels


def _depth(block: int, size: int, depth: int) -> int | None:
    """Levels above a block: a source that is one short block ends in one node, any other block is reduced by ``depth``."""
    return None if block == 0 and size < FAN**depth else depth


def steps(levels: list[list[bytes]], i: int) -> bytes:
    """The way from node ``i`` of the lowest level to the top. A step is its place in its run, the run's size, and the siblings' digests."""
    out = []
    for level in levels[:-1]:
        a = i - i % FAN
        run = level[a : a + FAN]
        out += [bytes((i - a, len(run))), *run[: i - a], *run[i - a + 1 :]]
        i //= FAN
    return b"".join(out)


def walk(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, siblings) of each step of a path."""
    at = 0
    while at < len(path):
        place, size = path[at], path[at + 1]
        at += 2
        yield place, [path[at + 32 * j : at + 32 * j + 32] for j in range(size - 1)]
        at += 32 * (size - 1)


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf's path leads to."""
    for place, others in walk(path):
        leaf = digest(*others[:place], leaf, *others[place:])
    return leaf


def proof(path: bytes) -> bytes:
    """H of all siblings, level by level, left to right."""
    return digest(*(x for _, others in walk(path) for x in others))


def leaves(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (FIELDS) with ``leaf``: H of the fields, each ``-`` where null, else its UTF-8 byte count, ``:`` and the value."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return docs.withColumn("leaf", F.unhex(F.sha2(F.concat(*[field(F.col(text if c == "text" else c)) for c in FIELDS]), 256)))


def _placed(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (source, doc_id, leaf, ...) with s, the number of its source in order (null first), and pos, its place in it (by doc_id, null first, then leaf).

    Sources and rows are numbered within range-sorted partitions. The driver reads one row for each partition, the number
    of its sources and the ends of its first and last ones, and the carries go back as a broadcast of as many rows.
    """
    dealt = rows.repartitionByRange(parts, F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf")
    dealt = dealt.sortWithinPartitions(F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf").withColumn("part", F.spark_partition_id())
    names = dealt.columns

    def number(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, rank, last, begun = 0, -1, None, False
        for batch in stream:
            runs, ranks = [], []
            for source in batch.column("source").to_pylist():
                if begun and source != last:
                    run, rank = run + 1, -1
                begun, last, rank = True, source, rank + 1
                runs.append(run)
                ranks.append(rank)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64()), pa.array(ranks, pa.int64())], names=[*names, "run", "rank"])

    schema = T.StructType([*dealt.schema.fields, T.StructField("run", T.LongType()), T.StructField("rank", T.LongType())])
    numbered = stored(dealt.mapInArrow(number, schema), "manifest-leaves")
    ends = numbered.groupBy("part").agg(F.min_by("source", F.struct("run")).alias("first"), F.max_by("source", F.struct("run")).alias("last"), F.max("run").alias("runs"), F.max(F.struct("run", "rank")).alias("end"))
    s, pos, last, carries = -1, 0, None, []
    for r in ends.orderBy("part").toLocalIterator():
        if s < 0 or r["first"] != last:
            s, pos = s + 1, 0
        carries.append((r["part"], s, pos))
        rows_of_last = r["end"]["rank"] + 1
        pos = pos + rows_of_last if r["runs"] == 0 else rows_of_last
        s, last = s + r["runs"], r["last"]
    carried = rows.sparkSession.createDataFrame(carries, "part int, base_s long, base_pos long")
    out = numbered.join(F.broadcast(carried), "part").withColumn("s", F.col("base_s") + F.col("run"))
    return out.withColumn("pos", F.col("rank") + F.when(F.col("run") == 0, F.col("base_pos")).otherwise(F.lit(0))).drop("part", "run", "rank", "base_s", "base_pos")


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _blocked(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(FAN**depth)))


def _reduced(nodes: DataFrame, depth: int) -> DataFrame:
    """(s, pos, leaf): the node above each block of ``nodes`` (s, pos, leaf)."""

    def run(s: int, block: int, table: pa.Table) -> pa.Table:
        top = levels_of(_ordered(table).column("leaf").to_pylist(), _depth(block, table.num_rows, depth))[-1][0]
        return pa.table({"s": pa.array([s], pa.int64()), "pos": pa.array([block], pa.int64()), "leaf": pa.array([top], pa.binary())})

    return _blocked(nodes.select("s", "pos", "leaf"), depth).groupBy("s", "block").applyInArrow(lambda key, t: run(key[0].as_py(), key[1].as_py(), t), "s long, pos long, leaf binary")


def _descend(nodes: DataFrame, above: DataFrame | Broadcast, depth: int, finish: Callable[[pa.Table, list[bytes], bytes], pa.Table], schema: str) -> DataFrame:
    """``finish`` for every block of ``nodes``: its rows by pos, their paths from there to the root, and the subroot."""

    def run(table: pa.Table, rest: bytes, subroot: bytes) -> pa.Table:
        t = _ordered(table)
        levels = levels_of(t.column("leaf").to_pylist(), _depth(t.column("block")[0].as_py(), t.num_rows, depth))
        return finish(t, [steps(levels, i) + rest for i in range(t.num_rows)], subroot)

    blocks = _blocked(nodes, depth).groupBy("s", "block")
    if isinstance(above, Broadcast):
        return blocks.applyInArrow(lambda key, t: run(t, *above.value[key[0].as_py(), key[1].as_py()]), schema)
    ways = above.groupBy("s", "pos")
    return blocks.cogroup(ways).applyInArrow(lambda t, w: run(t, w.column("path")[0].as_py(), w.column("subroot")[0].as_py()), schema)


def _climb(nodes: DataFrame, depth: int, top: int) -> tuple[DataFrame | Broadcast, bytes]:
    """(s, pos, path, subroot) of every node of ``nodes`` (s, pos, leaf), and the root (nothing of an empty table).

    Up to ``top`` nodes the driver builds the tree. Above, a round of blocks comes first; once every source is one node,
    sources are the leaves of one tree and are reduced by blocks too.
    """
    if nodes.limit(top + 1).count() <= top:
        found: dict[int, list[bytes]] = {}
        for r in nodes.orderBy("s", "pos").collect():
            found.setdefault(r["s"], []).append(bytes(r["leaf"]))
        trees = {s: levels_of(x) for s, x in found.items()}
        over = levels_of([t[-1][0] for t in trees.values()]) if trees else [[b""]]
        ways = {(s, i): (steps(t, i) + steps(over, j), t[-1][0]) for j, (s, t) in enumerate(trees.items()) for i in range(len(t[0]))}
        return nodes.sparkSession.sparkContext.broadcast(ways), over[-1][0]
    across = nodes.filter("pos > 0").isEmpty()
    below = nodes.select(F.lit(0).cast("long").alias("s"), F.col("s").alias("pos"), "leaf") if across else nodes
    above, root = _climb(stored(_reduced(below, depth), "manifest-nodes"), depth, top)

    def finish(t: pa.Table, paths: list[bytes], subroot: bytes) -> pa.Table:
        subroots = t.column("leaf") if across else pa.array([subroot] * len(paths), pa.binary())
        return pa.table([t.column("s"), t.column("pos"), pa.array(paths, pa.binary()), subroots], names=["s", "pos", "path", "subroot"])

    out = stored(_descend(below, above, depth, finish, "s long, pos long, path binary, subroot binary"), "manifest-paths")
    return (out.select(F.col("pos").alias("s"), F.lit(0).cast("long").alias("pos"), "path", "subroot") if across else out), root


def manifest(docs: DataFrame, tampered: DataFrame | None = None, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof, folded_root, verified), one row for each row of ``docs`` (FIELDS and, as ``altered``, the text to verify).

    leaf to folded_root are hex. folded_root is what the row's fields with the ``altered`` text (without such a column:
    the text) lead to by the original siblings; verified says whether that is the root. Rows of a source are ordered by
    doc_id, null first, those of one doc_id by leaf, so repeated rows are leaves of their own beside each other. A null
    source is a source. An empty table has no rows.
    """
    text = F.col("altered" if "altered" in docs.columns else "text").alias("altered")
    rows = leaves(leaves(docs.select(*FIELDS, text), "altered").withColumnRenamed("leaf", "other"))
    rows = rows.select("doc_id", "source", "leaf", F.when(F.col("other") != F.col("leaf"), F.col("other")).alias("other"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    placed = _placed(rows, parts)
    above, root = _climb(stored(_reduced(placed, depth), "manifest-nodes"), depth, top)

    def finish(t: pa.Table, paths: list[bytes], subroot: bytes) -> pa.Table:
        own, others = t.column("leaf").to_pylist(), t.column("other").to_pylist()
        folded = [fold(other or leaf, path) for leaf, other, path in zip(own, others, paths)]
        same = lambda x: [x.hex()] * len(own)
        columns = {"doc_id": t.column("doc_id"), "source": t.column("source"), "leaf": [x.hex() for x in own], "subroot": same(subroot), "root": same(root)}
        return pa.table(columns | {"proof_sha256": [proof(p).hex() for p in paths], "folded_root": [x.hex() for x in folded], "verified": [x == root for x in folded]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _descend(placed, above, depth, finish, schema)


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    docs = docs.withColumn("altered", F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    return manifest(docs).drop("source")


OP12_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text,
    list_reduce([4294967295] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents),
leaves AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS r, doc_id, source, coalesce(xor(crc, 4294967295) % 2 = 0, false) AS cut,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS other
  FROM fields),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY r) - 1 AS pos FROM leaves),
tree AS (
  SELECT s, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM placed
  UNION ALL
  SELECT s, lvl, pos, h, count(*) OVER (PARTITION BY s) AS n
  FROM (SELECT s, lvl + 1 AS lvl, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM tree WHERE n > 1 GROUP BY s, lvl, pos // 3)),
subroots AS (SELECT s, h AS subroot FROM tree WHERE n = 1),
over_ AS (
  SELECT 0 AS lvl, s AS pos, subroot AS h, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT lvl, pos, h, count(*) OVER () AS n
  FROM (SELECT lvl + 1 AS lvl, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM over_ WHERE n > 1 GROUP BY lvl, pos // 3)),
above AS (
  SELECT s, lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs, first(n) AS n FROM tree WHERE n > 1 GROUP BY s, lvl, pos // 3),
over_runs AS (SELECT lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM over_ WHERE n > 1 GROUP BY lvl, pos // 3),
depths AS (SELECT s, max(lvl) AS depth FROM tree GROUP BY s),
climb AS (
  SELECT r, s, 0 AS lvl, pos, CASE WHEN cut THEN other ELSE leaf END AS h, '' AS sib, depth FROM placed JOIN depths USING (s)
  UNION ALL
  SELECT c.r, c.s, c.lvl + 1, CASE WHEN c.lvl + 1 = c.depth THEN c.s ELSE c.pos // 3 END,
    sha256(array_to_string(a.hs[:c.pos % 3] || [c.h] || a.hs[c.pos % 3 + 2:], '')), c.sib || array_to_string(a.hs[:c.pos % 3] || a.hs[c.pos % 3 + 2:], ''), c.depth
  FROM climb c JOIN above a ON a.s = c.s AND a.lvl = c.lvl AND a.run = c.pos // 3 WHERE c.lvl < c.depth),
topped AS (
  SELECT r, 0 AS lvl, s AS pos, h, sib FROM climb WHERE lvl = depth
  UNION ALL
  SELECT c.r, c.lvl + 1, c.pos // 3, sha256(array_to_string(a.hs[:c.pos % 3] || [c.h] || a.hs[c.pos % 3 + 2:], '')), c.sib || array_to_string(a.hs[:c.pos % 3] || a.hs[c.pos % 3 + 2:], '')
  FROM topped c JOIN over_runs a ON a.lvl = c.lvl AND a.run = c.pos // 3),
root AS (SELECT h AS root FROM over_ WHERE n = 1),
done AS (SELECT r, h AS folded_root, sib FROM topped WHERE lvl = (SELECT max(lvl) FROM over_))
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (s) JOIN done USING (r) CROSS JOIN root
"""

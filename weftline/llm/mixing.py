"""Mixing sources to target weights with a time-varying curriculum, in DataFrame expressions only.

Each source gets a share of all words by its weight, at most ``max_epochs`` times its own words; what is over goes to the
others by weight. A source's weight is a piecewise linear schedule over training time 0..1. Its integral is the demand
for the source's words up to a time, so a document whose words start after a fraction q of the source's target is due
when the integrated schedule reaches q: the inverse of the integral gives its position. Repeats are further positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, durable, read, set_aside

Schedule = Sequence[tuple[float, float]]

#: Weight schedules by weight class: the heavy class fades, the light one rises; each has the mean 1.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
WEIGHTS = (5, 2, 1)


def invert(schedule: Schedule, q: Column) -> Column:
    """The time at which the schedule's integral reaches the fraction ``q`` of its whole."""
    knots = [(float(t), float(v)) for t, v in schedule]
    if len(knots) < 2 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(v < 0 for _, v in knots):
        raise ValueError("a schedule needs two or more knots (time, weight >= 0) in rising time")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole = sum(areas)
    if whole <= 0:
        raise ValueError("a schedule needs a positive integral")
    out, before, branches = None, 0.0, []
    for (t0, v0), (t1, v1), area in zip(knots, knots[1:], areas):
        need = q * F.lit(whole) - F.lit(before)
        slope = (v1 - v0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(v0 * v0) + need * F.lit(2 * slope)))
        branches.append((before + area, F.lit(t0) + F.greatest(F.lit(0.0), need * F.lit(2.0) / F.greatest(F.lit(v0) + root, F.lit(1e-300)))))
        before += area
    for limit, value in reversed(branches):
        out = value if out is None else F.when(q * F.lit(whole) <= F.lit(limit), value).otherwise(out)
    return F.least(out, F.lit(knots[-1][0]))


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with ``_mix_no`` (place in ``order``, from 0) and for each of ``sums`` what the rows before hold of it.

    Range partitions are summed first, then the rows of each, so no order over all rows meets in one task.
    """
    dealt = durable(rows.repartitionByRange(*order).withColumn("_mix_part", F.spark_partition_id()))
    sums = {"_mix_no": F.lit(1), **sums}
    totals = dealt.groupBy("_mix_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    parts = W.orderBy("_mix_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each shuffle partition
    before = totals.select("_mix_part", *[F.coalesce(F.sum(n).over(parts), F.lit(0)).alias(f"_before{n}") for n in sums])
    inner = W.partitionBy("_mix_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(before), "_mix_part")
    return placed.select(*rows.columns, *[(F.col(f"_before{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(n) for n, c in sums.items()])


def targets(sources: DataFrame, total_share: float = 1.0, weights: Sequence[int] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size and further columns) with ``source_rank`` (code point order, null last), ``source_weight`` and ``target``.

    Shares above ``max_epochs * source_size`` stop there; the excess goes to the others by weight until none is above.
    In the order of limit by weight the stopped sources come first, so one running sum finds them all.
    """
    kept = sources.columns
    ranked = _running(sources, [F.col("source").asc_nulls_last()], {}).withColumnRenamed("_mix_no", "source_rank")
    ranked = ranked.withColumn("source_weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_mix_limit", F.col("source_size") * max_epochs)
    ratio = (F.col("_mix_limit").cast("double") / F.col("source_weight")).asc()
    ranked = _running(ranked, [ratio, F.col("source_rank").asc()], {"_mix_limits": F.col("_mix_limit"), "_mix_weights": F.col("source_weight")})
    ranked = durable(ranked)
    whole = ranked.agg(F.floor(F.sum("source_size") * F.lit(float(total_share))).cast("long").alias("size"), F.sum("source_weight").alias("weight")).first()
    rest, weights_left = F.lit(whole["size"] or 0) - F.col("_mix_limits"), F.lit(whole["weight"] or 0) - F.col("_mix_weights")
    ranked = ranked.withColumn("_mix_open", rest * F.col("source_weight") <= F.col("_mix_limit") * weights_left)
    level = ranked.filter("_mix_open").agg(F.max(F.struct(weights_left.alias("left"), rest.alias("rest"))).alias("at")).first()["at"] or {"left": 1, "rest": 0}
    share = F.lit(float(level["rest"])) * F.col("source_weight") / F.lit(level["left"])
    return ranked.select(*kept, "source_rank", "source_weight", F.when(F.col("_mix_open"), share).otherwise(F.col("_mix_limit").cast("double")).alias("target"))


#: Columns that ``plan`` adds, and the further one of ``mix``.
PLANNED = ("size", "source_size", "source_weight", "target", "copies", "taken", "positions")


def measure(docs: DataFrame, seed: str = "") -> DataFrame:
    """``docs`` with ``size`` (words) and ``_mix_hash``, the key of a source's order."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in PLANNED]
    return docs.select(*kept, size.alias("size"), key.alias("_mix_hash"))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Schedule] = SCHEDULES, max_epochs: int = 3, total_share: float = 1.0, seed: str = "") -> DataFrame:
    """The documents' columns with size, source_size, source_weight, target, copies, taken and positions (array of times 0..1).

    A source's documents are laid end to end in the order of md5(seed, doc_id), epoch after epoch; a copy is taken if at
    least half of it lies before the target, so a source comes within half a document of its target and no document is
    taken more than ``max_epochs`` times. Starts come from a two-level running sum: per source about sqrt(rows) hash
    buckets, summed, then the rows of each bucket. So a source that holds a third of all rows never meets in one task.

    Null or empty text: size 0, never taken. Null source: a source of its own, last. Null doc_id: ordered as the text
    "null". Equal doc_ids are ordered by size, so repeated rows are interchangeable. An empty table gives an empty one.
    Input columns named like an output column (in any case) give way to it; all others pass, whatever their names. The
    order is a pure function of the rows: reruns agree.
    """
    docs, originals = set_aside(docs, lambda c: c.startswith("_mix_") or c == "source_rank")
    rows = measure(docs, seed)
    slim = durable(rows.select("source", "doc_id", "size", "_mix_hash"))
    return _planned(rows, slim, weights, schedules, max_epochs, total_share).withColumnsRenamed(originals)


def _planned(base: DataFrame, slim: DataFrame, weights: Sequence[int], schedules: Sequence[Schedule], max_epochs: int, total_share: float) -> DataFrame:
    """``plan`` of measured rows; all sums come from ``slim``, their narrow columns computed once."""
    rest = [c for c in base.columns if c not in ("size", "_mix_hash")]
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_mix_rows"))
    facts = targets(per_source, total_share, weights, max_epochs)
    facts = durable(facts.select(F.col("source").alias("_mix_source"), "source_size", "source_rank", "source_weight", "target", F.ceil(F.sqrt("_mix_rows")).cast("long").alias("_mix_buckets")))

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.join(facts, rows["source"].eqNullSafe(facts["_mix_source"]), "left").drop("_mix_source")
        share = F.conv(F.substring("_mix_hash", 1, 8), 16, 10).cast("long") * F.col("_mix_buckets") / F.lit(float(1 << 32))
        return rows.withColumn("_mix_bucket", F.floor(share).cast("long"))

    sums = dealt(slim).groupBy("source_rank", "_mix_bucket").agg(F.sum("size").alias("_mix_sum"))
    up_to = W.partitionBy("source_rank").orderBy("_mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source_rank").alias("_mix_r"), F.col("_mix_bucket").alias("_mix_b"), F.coalesce(F.sum("_mix_sum").over(up_to), F.lit(0)).alias("_mix_before"))
    rows = dealt(base)
    rows = rows.join(sums, (rows["source_rank"] == sums["_mix_r"]) & (rows["_mix_bucket"] == sums["_mix_b"]), "left")
    inner = W.partitionBy("source_rank", "_mix_bucket").orderBy("_mix_hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_mix_start", F.col("_mix_before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    copy_start = lambda e: F.col("_mix_start") + F.col("source_size") * F.lit(e)
    due = [F.when((F.col("size") > 0) & (copy_start(e) + F.col("size") / F.lit(2.0) <= F.col("target")), F.least(copy_start(e) / F.col("target"), F.lit(1.0))) for e in range(max_epochs)]
    rows = rows.withColumn("_mix_due", F.filter(F.array(*due), lambda x: x.isNotNull()))

    def when(q: Column) -> Column:
        out = invert(schedules[0], q)
        for i, s in list(enumerate(schedules))[1:]:
            out = F.when(F.col("source_rank") % len(schedules) == i, invert(s, q)).otherwise(out)
        return out

    rows = rows.withColumn("positions", F.transform("_mix_due", when)).withColumn("copies", F.size("_mix_due")).withColumn("taken", F.col("size") * F.col("copies"))
    return rows.select(*[F.col(f"`{c}`") for c in rest], *PLANNED)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The training sequence: one row per taken copy, with ``position`` (an input column of that name gives way), range-sorted by it (ties by doc_id)."""
    planned = plan(docs, **settings)
    rest = [F.col(f"`{c}`") for c in planned.columns if c.lower() not in ("positions", "position")]
    return planned.select(*rest, F.explode("positions").alias("position")).orderBy("position", F.col("doc_id").asc_nulls_last())


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` in the order of first training position; those not taken come last."""
    slim = durable(measure(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text"))
    planned = _planned(slim, slim, WEIGHTS, SCHEDULES, 3, 1.0)
    first = F.round(F.get("positions", F.lit(0)), 9)
    out = planned.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, ceil(sqrt(count(*)))::BIGINT AS buckets FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS rk, 3 * source_size AS lim
  FROM per_source),
run AS (
  SELECT *, coalesce(sum(lim) OVER (ORDER BY lim::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_,
         (sum(w) OVER (ORDER BY lim::DOUBLE / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS left_,
         (sum(source_size) OVER ())::BIGINT AS all_
  FROM ranked),
opened AS (SELECT *, (all_ - before_) * w <= lim * left_ AS is_open FROM run),
level AS (SELECT left_ AS lw, all_ - before_ AS rest FROM opened WHERE is_open ORDER BY left_ DESC LIMIT 1),
goals AS (
  SELECT source, source_size, buckets, rk,
         CASE WHEN is_open THEN (SELECT rest::DOUBLE FROM level) * w / (SELECT lw FROM level) ELSE lim::DOUBLE END AS target
  FROM opened),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.rk,
         coalesce(sum(s.size) OVER (PARTITION BY g.rk ORDER BY floor(('0x' || substr(s.h, 1, 8))::BIGINT * g.buckets / 4294967296.0), s.h, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
taken AS (
  SELECT *, (CASE WHEN size > 0 THEN (start_ + size / 2.0 <= target)::INT + (start_ + source_size + size / 2.0 <= target)::INT
                     + (start_ + 2 * source_size + size / 2.0 <= target)::INT ELSE 0 END)::BIGINT AS copies
  FROM placed),
due AS (SELECT *, CASE WHEN copies > 0 THEN least(start_ / target, 1.0::DOUBLE) END AS q FROM taken)
SELECT doc_id, size, source_size, target, size * copies AS taken,
       round(CASE WHEN q IS NULL THEN NULL
         WHEN rk % 3 = 0 THEN least(greatest(0.0::DOUBLE, q * 2.0::DOUBLE) / (1.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE + q * -2.0::DOUBLE))), 1.0::DOUBLE)
         WHEN rk % 3 = 1 THEN least(greatest(0.0::DOUBLE, q * 2.0::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE)), 1.0::DOUBLE)
         ELSE least(greatest(0.0::DOUBLE, q * 2.0::DOUBLE) / (0.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + q * 2.0::DOUBLE))), 1.0::DOUBLE) END, 9) AS first_position
FROM due
"""

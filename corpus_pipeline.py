"""A training corpus from raw documents: language, near duplicates, repeated passages, benchmark leaks, mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import decontamination, language, mixing, near_duplicates, substrings
from weftline.llm.common import read, set_aside, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier is sure of; those without a letter or with a narrow margin go."""
    model = language.fit(language.training_rows(docs.select("doc_id", "text", "lang")))
    inner, originals = set_aside(docs, lambda c: c in ("lang_pred", "score", "margin", "rejected"))
    judged = language.classify(inner, model).filter(~F.col("rejected"))
    return judged.drop("lang_pred", "score", "margin", "rejected").withColumnsRenamed(originals)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): the one of the smallest doc_id.

    Rows without a doc_id stay. Of rows with equal doc_id and text one stays; unlike texts of one doc_id are documents of
    their own, in the order of a hash of the text.
    """
    inner, originals = set_aside(docs, lambda c: c in ("_h", "_node", "_kept"))
    h = F.xxhash64("text")
    named = inner.filter(F.col("doc_id").isNotNull())
    keys = named.select("doc_id", h.alias("_h")).distinct()
    if keys.groupBy("doc_id").count().filter("count > 1").isEmpty():
        nodes = named.withColumn("_node", F.col("doc_id"))
    else:
        # numbers in the order of doc_id, fixed by storing them
        keys = stored(keys.orderBy("doc_id", "_h").withColumn("_node", F.monotonically_increasing_id()), "pipeline-nodes")
        nodes = named.withColumn("_h", h).join(keys, ["doc_id", "_h"])
    kept = near_duplicates.near_duplicates(nodes.select(F.col("_node").alias("doc_id"), "text"), k=5, percent=80).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    one = nodes.join(kept, nodes["_node"] == kept["_kept"], "left_semi").dropDuplicates(["_node"])
    columns = [F.col(f"`{c}`") for c in inner.columns]
    return one.select(*columns).unionByName(inner.filter(F.col("doc_id").isNull())).withColumnsRenamed(originals)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of a smaller doc_id holds."""
    inner, originals = set_aside(docs, lambda c: c in ("n_bytes", "n_removed", "spans"))
    out = substrings.remove_repeats(inner).drop("n_bytes", "n_removed", "spans").withColumnsRenamed(originals)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item has leaked."""
    inner, originals = set_aside(docs, lambda c: c == "leaks")
    found = decontamination.find_leaks(inner, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.filter(F.size("leaks") == 0).drop("leaks").withColumnsRenamed(originals)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: a row for each copy that the mix takes, by position."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""From raw documents to a sharded training mix, in five stages.

Each stage works on all rows that the one before it kept, and its result is written as Parquet
before the next one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenumlens.llm import jaccard, leaks, mixing, quality, slots
from plenumlens.llm.tables import read, text_bytes
from plenumlens.session import materialize, scratch_path

SHARDS = 24


def good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject."""
    field = quality.fit_field(docs, read(spark, sf_dir, "labels"))
    return docs.where(quality.scorer(field)(text_bytes()) >= quality.THRESHOLD)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies; of its repeated rows the one whose other columns come first."""
    classes = jaccard.jaccard_classes(docs)
    stay = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    rest = [F.col(c).asc_nulls_first() for c in docs.columns if c not in ("doc_id", "text")]
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*rest)
    return kept.withColumn("__copy", F.row_number().over(same)).where("__copy = 1").drop("__copy")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items; those that consist mostly of them go."""
    return leaks.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: documents left out, kept or repeated."""
    return mixing.take(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, its place there and its virtual slot, by a map that is stored and read back."""
    records = slots.spread_records(docs, keep=docs.columns)
    return slots.place_records(records, slots.update_map(slots.slot_bytes(records), SHARDS, scratch_path(spark, "slot-maps")))


STAGES = [
    ("quality classifier", good_lines),
    ("n-gram jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

#: Neither the classifier nor the suffix automaton can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

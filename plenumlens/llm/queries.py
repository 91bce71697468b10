"""The queries of this subpackage over the driver tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenumlens.llm import bpe, gif, jaccard, leaks, licenses, line_dedup, merkle, mixing, quality, repeats, slots, token_files, whitening
from plenumlens.llm.oracles import ORACLES
from plenumlens.llm.tables import read, text_bytes
from plenumlens.session import materialize, scratch_path

Run = Callable[[SparkSession, str], DataFrame]

SHARDS = 24
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = quality.fit_field(docs, read(spark, sf_dir, "labels"))
    judged = quality.with_lines(docs.select("doc_id", "text"), field)
    good = F.size(F.filter("judged.lines", lambda line: line["label"] == 1))
    return judged.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "judged.score",
                         (F.col("judged.score") >= quality.THRESHOLD).cast("int").alias("predicted"),
                         F.size("judged.lines").alias("n_lines"), good.alias("n_good_lines"))


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "text", F.octet_length(text_bytes()).cast("long").alias("n_bytes"))
    media = materialize(gif.with_media(sized).select("doc_id", "n_bytes", "media"), "media")
    return gif.with_payload(media).select("doc_id", "n_bytes", "payload.*")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_files.document_facts(token_files.read_tokens(spark, path))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leaks.with_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
                       leaks.items_digest(F.col("hits.items")).alias("items_sha256"),
                       (F.col("hits.n_hit") > 0).alias("contaminated"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    records = slots.spread_records(docs.withColumn("text_crc32", crc), keep=["doc_id", "text_crc32"])
    sizes, maps = slots.slot_bytes(records), scratch_path(spark, "slot-maps")
    slots.update_map(sizes, SHARDS - 1, maps)  # as it was before the last shard was added
    placed = slots.place_records(records, slots.update_map(sizes, SHARDS, maps))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = {"n_chars": F.when(tampered, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))}
    return merkle.verify(merkle.manifest(read(spark, sf_dir, "documents"), shown=shown)).withColumnRenamed("key", "doc_id")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    codes = bpe.with_ids(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(codes, ranks, public_tokenizers.PATTERN)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Run] = {
    "op1_quality": op1_quality,
    "op2_gif": op2_gif,
    "op3_token_files": op3_token_files,
    "op4_decontamination": op4_decontamination,
    "op5_licenses": op5_licenses,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_repeats": op10_repeats,
    "op11_merkle": op11_merkle,
    "op12_bpe": op12_bpe,
    "op13_whitening": op13_whitening,
}

"""Lexicons, member tables, proceeding headers, earlier results, CSV, text and binary files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenumlens.functions.fields import media_type
from plenumlens.functions.keywords import Keyword
from plenumlens.schemas import FRAGMENT, MEMBER_FILE, PROCEEDING_FILE, RESULT_FILE
from plenumlens.sources.json_items import read_items
from plenumlens.sources.transcripts import list_files


def parse_lexicon(files: DataFrame, value: str = "value", carry: Sequence[str] = ()) -> DataFrame:
    """``ord, keyword, weight`` from lexicon files held one per row.

    Elements that are no object or have no keyword are skipped; a missing or unreadable
    weight is 1.0.
    """
    items = files.select(*carry, F.posexplode(F.from_json(F.col(value), "array<string>")).alias("ord", "item"))
    keyword = F.get_json_object("item", "$.keyword")
    weight = F.coalesce(F.get_json_object("item", "$.weight").try_cast("double"), F.lit(1.0))
    return items.select(*carry, "ord", keyword.alias("keyword"), weight.alias("weight")).where(
        F.coalesce("keyword", F.lit("")) != ""
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon file as a table of any size."""
    return parse_lexicon(spark.read.text(path, wholetext=True))


def lexicon_literals(lexicon: DataFrame) -> list[Keyword]:
    """The lexicon as plan literals.

    It becomes part of the plan, whatever its size; a lexicon that should stay a table is
    matched by operators.matching.match_keywords.
    """
    rows = lexicon.orderBy("ord").collect()
    named = [r for r in rows if r["keyword"].strip()]
    return [Keyword(i, r["keyword"].strip(), r["weight"]) for i, r in enumerate(named)]


def newest_export(spark: SparkSession, folder: str, glob: str = "*.json") -> list[str]:
    """Paths of all files of the export written last.

    A folder below ``folder`` is one export with everything in it, the part files of one
    Spark write are one, and any other file is one of its own.
    """
    files = list_files(spark, folder, glob, recursive=True)
    depth = len([p for p in folder.split("://")[-1].split("/") if p])
    parts = F.filter(F.split(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), "/"), lambda p: p != "")
    below = F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(0)))
    written = F.regexp_extract("name", r"^part-[0-9]+-([0-9a-f-]{36})", 1)
    export = F.when(F.size(below) > 1, F.concat(F.lit("folder "), F.element_at(below, 1))).when(
        written != "", F.concat(F.lit("write "), written)).otherwise(F.concat(F.lit("file "), "name"))
    known = files.withColumn("export", export)
    newest = known.groupBy("export").agg(F.max("modificationTime").alias("at")).orderBy(F.desc("at"), F.desc("export")).limit(1)
    paths = [r["path"] for r in known.join(newest, "export", "left_semi").select("path").orderBy("path").collect()]
    if not paths:
        raise FileNotFoundError(f"no {glob} in {folder}")
    return paths


def read_members(
    spark: SparkSession, folder: str, glob: str = "*.json", json_lines: bool = False
) -> DataFrame:
    """Members from the newest export, inside an envelope or bare."""
    rows = spark.read.schema(MEMBER_FILE).option("multiLine", str(not json_lines).lower()).json(newest_export(spark, folder, glob))
    names = [f.name for f in rows.schema["data"].dataType.elementType]
    wrapped = F.col("data").isNotNull()
    inner = rows.where(wrapped).select(F.inline("data"))
    return inner.unionByName(rows.where(~wrapped & F.col("id").isNotNull()).select(*names))


def read_proceeding_info(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Proceeding headers; ``data``, ``proceeding_data`` or no envelope."""
    rows = spark.read.schema(PROCEEDING_FILE).option("multiLine", str(not json_lines).lower()).json(path)
    fields = ["number", "title", "dates", "current"]
    return rows.select(*[F.coalesce(f"data.{f}", f"proceeding_data.{f}", f).alias(f) for f in fields])


def read_latest_results(
    spark: SparkSession, folder: str, glob: str = "*.json", json_lines: bool = False
) -> DataFrame:
    """Fragments of the newest result export, with their place in their record."""
    rows = spark.read.schema(RESULT_FILE).option("multiLine", str(not json_lines).lower()).json(newest_export(spark, folder, glob))
    fragments = F.coalesce("data.fragments", "fragments")
    return rows.select(
        F.col("_metadata.file_path").alias("path"), F.coalesce("data.source_file", "source_file").alias("source_file"),
        F.posexplode(fragments).alias("pos", "f")
    ).select("path", "source_file", "pos", "f.*")


def read_result_documents(spark: SparkSession, folder: str, glob: str = "*.json", lines: bool = False) -> DataFrame:
    """Fragments of the newest result export, whose documents are walked and never held whole.

    The columns of :func:`read_latest_results`, the envelope's ``generated_at`` and the error of
    a document that breaks off, as a row without a fragment.
    """
    keep = ["metadata", "data.source_file", "source_file"]
    items = read_items(spark, newest_export(spark, folder, glob), ["data.fragments", "fragments"], keep, glob=glob, lines=lines)
    head = F.from_json("head", "metadata struct<generated_at:string>, `data.source_file` string, source_file string")
    read = items.select(F.col("source_file").alias("path"), "pos", "_corrupt_record", head.alias("h"), F.from_json("item", FRAGMENT).alias("f"))
    return read.select("path", F.coalesce(F.col("h").getField("data.source_file"), "h.source_file").alias("source_file"),
                       F.col("h.metadata.generated_at").alias("generated_at"), "pos", "f.*", "_corrupt_record")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every column is text."""
    return (
        spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
        .option("encoding", "UTF-8").csv(path)
    )


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with their path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files as bytes, with size and time."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def media_inventory(files: DataFrame, logo: Column | bool = False) -> DataFrame:
    """Files and bytes per picture type; only the leading bytes are looked at."""
    if isinstance(logo, Column):
        kind = F.when(F.coalesce(logo, F.lit(False)), media_type(F.col("content"), True)).otherwise(media_type(F.col("content"), False))
    else:
        kind = media_type(F.col("content"), bool(logo))
    return files.select(kind.alias("media_type"), "length").groupBy("media_type").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )

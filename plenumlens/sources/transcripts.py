"""Transcript files in any envelope, discovery and keys taken from paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenumlens.schemas import LANDED_STATEMENT, TRANSCRIPT_FILE
from plenumlens.session import materialize
from plenumlens.sources.json_items import read_items
from plenumlens.storage import store_of

# Fixed value: name of a transcript file; the date is its only key.
FILE_DATE = r"^transkrypty_(.*)\.json$"


#: Entries below a folder up to which Spark's own reader lists them, in the driver's memory.
FEW_ENTRIES = 10_000


def list_files(spark: SparkSession, path: str, glob: str = "*.json", recursive: bool = False, few: int = FEW_ENTRIES) -> DataFrame:
    """``path, name, extension, modificationTime, length`` of files; contents are not read.

    A tree of more than ``few`` entries is listed by tasks, a folder at a time and a level after
    the other, where they can reach the store: the driver never holds it.
    """
    if recursive and not re.search(r"[{\[\\]", glob) and _many_entries(path, few):
        return _named(_tree(spark, path, glob))
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return _named(reader.load(path))


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("name"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("extension"),
        "modificationTime", "length",
    )


def _inside(store: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
    """What a folder holds, without the names that Spark's readers pass over."""
    for info in store.get_file_info(fs.FileSelector(folder)):
        name = info.base_name
        if not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")):
            yield info


def _many_entries(path: str, few: int) -> bool:
    """Whether a folder that Python reaches has more than ``few`` entries below it; no more are looked at, but for one folder's."""
    try:
        store, inner, _ = store_of(path)
        if store.get_file_info(inner).type != fs.FileType.Directory:
            return False
        seen, folders = 0, [inner]
        while folders and seen <= few:
            for info in _inside(store, folders.pop()):
                seen += 1
                if info.type == fs.FileType.Directory and len(folders) <= few:
                    folders.append(info.path)
        return seen > few
    except (ValueError, OSError, ImportError):  # for Spark's own reader
        return False


def _tree(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path, modificationTime, length`` of all files below a folder, each level listed by tasks."""
    _, root, before = store_of(path.rstrip("/"))
    shown = "file:" if before == "file://" else path.rstrip("/")[:len(path.rstrip("/")) - len(root)]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(path)[0]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [i for i in _inside(store, folder) if i.type == fs.FileType.Directory or fnmatchcase(i.base_name, glob)]
                for k in range(0, len(found), 10_000):
                    part = found[k:k + 10_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([i.path for i in part], pa.string()), pa.array([i.type == fs.FileType.Directory for i in part]),
                        pa.array([(i.mtime_ns or 0) // 1_000_000 for i in part], pa.int64()), pa.array([i.size or 0 for i in part], pa.int64())],
                        names=["inner", "is_folder", "at_ms", "length"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    folders, levels = spark.createDataFrame([(root,)], "inner string"), []
    while not folders.isEmpty():
        listed = folders.repartition(tasks).mapInArrow(inside, "inner string, is_folder boolean, at_ms long, length long")
        levels.append(materialize(listed, "listed-files"))
        folders = levels[-1].where("is_folder").select("inner")
    files = reduce(DataFrame.unionAll, levels).where("NOT is_folder")
    return files.select(F.concat(F.lit(shown), "inner").alias("path"), F.timestamp_millis("at_ms").alias("modificationTime"), "length")


def discover(spark: SparkSession, input_dir: str | None, data_dirs: list[str], own_output: str = "detector") -> DataFrame:
    """JSON files of the input folder; if it has none, of the data folders without own results."""
    if input_dir:
        direct = list_files(spark, input_dir)
        if not direct.isEmpty():
            return direct
    found = None
    for folder in data_dirs:
        files = list_files(spark, folder, recursive=True)
        found = files if found is None else found.unionByName(files)
    if found is None:
        raise ValueError("no input folder and no data folders")
    return found.where(~F.contains(F.lower("path"), F.lit(own_output))).orderBy("path")


def read_transcript_files(
    spark: SparkSession, path: str | list[str], recursive: bool = True, json_lines: bool = False
) -> DataFrame:
    """Rows of transcript files in the superset schema, with file name and path.

    A file is one JSON value, or with ``json_lines`` one value per line, as this engine
    writes them: such files are split among tasks, whatever their size.

    A file that cannot be parsed is one row with ``_corrupt_record``; the others go on.
    Directory keys such as ``term=10/proceeding_id=1`` come back as columns when the
    folder is read without recursion.
    """
    reader = spark.read.schema(TRANSCRIPT_FILE).option("multiLine", str(not json_lines).lower())
    reader = reader.option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.json(path).withColumns({
        "source_file": F.col("_metadata.file_path"),
        "file_name": F.col("_metadata.file_name"),
    })


def quarantine(files: DataFrame) -> DataFrame:
    """The unreadable files, and how many statements could be read of each."""
    # the reader refuses a query on the corrupt column alone, so the filter needs another one
    read = F.size(F.coalesce("statements", "data.statements", F.array()))
    broken = files.withColumn("read", read).where(F.col("_corrupt_record").isNotNull() & (F.col("read") >= 0))
    return broken.select("source_file", "file_name", "read", "_corrupt_record")


def _number(*names: str) -> Column:
    """The first field that is a whole number."""
    return F.coalesce(*[F.col(n).try_cast("bigint") for n in names])


def _speaker(speaker: str, name: str) -> Column:
    """The speaker's name, from an object, a plain text or the flat field."""
    value = F.col(speaker)
    is_object = F.startswith(F.ltrim(value), F.lit("{"))
    return F.coalesce(F.when(is_object, F.get_json_object(value, "$.name")).otherwise(value), F.col(name))


def statements_of(files: DataFrame) -> DataFrame:
    """One row per statement: file, position in it, day keys and the statement's fields.

    Accepts ``statements``, ``data.statements`` and bare statements. Bare ones are one row
    each and have their order from ``num``; ``pos`` is their order in a file read whole.
    A field of an unexpected type is null, and its statement stays.
    """
    listed = F.coalesce("statements", "data.statements")
    keys = [
        "source_file", "file_name", _number("metadata.term").cast("int").alias("term"),
        _number("metadata.proceeding_id").cast("int").alias("proceeding_id"), F.col("metadata.date").alias("date"),
    ]
    enveloped = files.where(listed.isNotNull()).select(*keys, F.posexplode(listed).alias("pos", "s")).select(
        "source_file", "file_name", "term", "proceeding_id", "date", F.col("pos").cast("long").alias("pos"),
        _number("s.num", "s.id", "s.statement_id").alias("num"),
        _speaker("s.speaker", "s.name").alias("speaker"),
        F.coalesce(F.nullif("s.text", F.lit("")), F.nullif("s.segment", F.lit("")), F.lit("")).alias("text"),
    )
    bare = files.where(listed.isNull() & (F.col("num").isNotNull() | F.col("text").isNotNull() | F.col("segment").isNotNull()))
    flat = bare.select(
        *keys, F.monotonically_increasing_id().alias("pos"), _number("num", "id", "statement_id").alias("num"),
        _speaker("speaker", "name").alias("speaker"),
        F.coalesce(F.nullif("text", F.lit("")), F.nullif("segment", F.lit("")), F.lit("")).alias("text"),
    )
    return enveloped.unionByName(flat)


def file_date(name):
    """Date in a transcript file's name: ten characters with two dashes, else null."""
    part = F.regexp_extract(name, FILE_DATE, 1)
    dashes = F.length(part) - F.length(F.replace(part, F.lit("-"), F.lit("")))
    return F.when((F.length(part) == 10) & (dashes == 2), part)


def landed_dates(files: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Sorted dates found in file names, per proceeding."""
    dated = files.withColumn("_date", file_date(F.col(name))).where(F.col("_date").isNotNull())
    days = dated.groupBy(*keys, "_date").agg(F.lit(1).alias("_one"))
    return days.groupBy(*keys).agg(F.array_sort(F.collect_list("_date")).alias("dates"))


def read_statements(spark: SparkSession, path: str, glob: str = "*.json", recursive: bool = True, lines: bool = False) -> DataFrame:
    """Statements of the transcript files below ``path``, in the columns of :func:`statements_of`, ``club`` and the file's error.

    Documents are walked while they are read, so that one of any size needs no more memory than a
    statement. Whatever can be read of a broken file stays; one more row has its error in
    ``_corrupt_record`` and no statement. ``pos`` is the statement's place in its file, the same
    in every run. With ``lines`` a file has one value a line and is read in byte ranges.
    """
    items = read_items(spark, path, ["statements", "data.statements"], ["metadata"], bare=True, glob=glob, recursive=recursive, lines=lines)
    head = F.from_json("head", "metadata struct<term:string,proceeding_id:string,date:string>")
    parsed = items.withColumn("s", F.from_json("item", LANDED_STATEMENT)).withColumn("metadata", head["metadata"])
    return parsed.select(
        "source_file", "file_name", _number("metadata.term").cast("int").alias("term"),
        _number("metadata.proceeding_id").cast("int").alias("proceeding_id"), F.col("metadata.date").alias("date"),
        "pos", _number("s.num", "s.id", "s.statement_id").alias("num"), _speaker("s.speaker", "s.name").alias("speaker"),
        F.when(F.startswith(F.ltrim("s.speaker"), F.lit("{")), F.coalesce(
            F.nullif(F.get_json_object("s.speaker", "$.club"), F.lit("")), F.get_json_object("s.speaker", "$.group"))).alias("club"),
        F.when(F.col("item").isNotNull(), F.coalesce(F.nullif("s.text", F.lit("")), F.nullif("s.segment", F.lit("")), F.lit(""))).alias("text"),
        "_corrupt_record",
    )


def broken_files(statements: DataFrame) -> DataFrame:
    """The files that broke off, how many statements could be read of each (of a line, for files of lines), and why."""
    return statements.where(F.col("_corrupt_record").isNotNull()).select(
        "source_file", "file_name", F.col("pos").alias("read"), "_corrupt_record")

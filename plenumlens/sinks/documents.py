"""A data source that writes nested JSON documents, and other text, under names of its own.

Rows carry the text of one item and the texts that open and close the levels around it. A task
gets its rows in order and streams them: it closes and opens levels as they change, and holds
one batch of rows. Documents are staged and take their names when the job has committed, so a task
that runs twice leaves nothing behind, and a name never shows half a document. What is staged is
listed in files beside it and named by tasks: the driver holds one path a task. A document whose
rows come from several tasks becomes numbered parts, whole documents each, with a manifest.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from plenumlens.storage import store_of

#: Rows of a document from which on it may be cut into parts for several tasks.
ROWS_PER_PART = 1_000_000

COLUMNS = ("file", "opens", "closes", "item")


@dataclass
class Staged(WriterCommitMessage):
    """The file where a task has listed what it staged; None for nothing."""

    task: int
    listing: str | None = None


class _Document:
    """One staged document that is written level by level."""

    def __init__(self, stream, name: str, staged: str):
        self.stream, self.name, self.staged = stream, name, staged
        self.open: list[str] = []
        self.closes: list[str] = []
        self.items, self.first = 0, True

    def add(self, opens: list[str], closes: list[str], item: str) -> None:
        same = 0
        while same < len(self.open) and same < len(opens) and self.open[same] == opens[same]:
            same += 1
        out = []
        if same < len(self.open) or same < len(opens):
            out.append("".join(reversed(self.closes[same:])))
            self.first = not self.items
            for text in opens[same:]:
                out.append(text if self.first else ",\n" + text)
                self.first = True
        out.append(item if self.first else ",\n" + item)
        self.first = False
        self.open, self.closes = opens, closes
        self.items += 1
        self.stream.write("".join(out).encode())

    def close(self) -> None:
        self.stream.write("".join(reversed(self.closes)).encode() + b"\n")
        self.stream.close()


class _Writer(DataSourceArrowWriter):
    """Without ``staging`` the commit names the documents itself; with it :func:`_publish` does, by tasks."""

    def __init__(self, path: str, columns: list[str], staging: str | None = None):
        self.path, self.columns = path.rstrip("/"), columns
        self.staging, self.later = staging or _new_staging(), staging is not None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        context = TaskContext.get()
        store, root, _ = store_of(self.path)
        folder = f"{root}/{self.staging}/{context.partitionId():06d}-{context.taskAttemptId()}"
        done, number = Staged(context.partitionId()), 0
        now: _Document | None = None
        listing = None
        try:
            for batch in iterator:
                cols = [batch.column(self.columns.index(c)).to_pylist() for c in COLUMNS]
                for name, opens, closes, item in zip(*cols):
                    if now is None or name != now.name:
                        if now is None:
                            store.create_dir(folder, recursive=True)
                            done.listing = f"{folder}/listing"
                            listing = store.open_output_stream(done.listing)
                        else:
                            now.close()
                            listing.write(_listed(now, done.task, number))
                            number += 1
                        staged = f"{folder}/{number:06d}"
                        now = _Document(store.open_output_stream(staged), name, staged)
                    now.add(opens or [], closes or [], item)
            if now is not None:
                now.close()
                listing.write(_listed(now, done.task, number))
        finally:
            if now is not None and not now.stream.closed:
                now.stream.close()
            if listing is not None:
                listing.close()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The listings of the tasks that count; their documents get their names, a document at a time."""
        store, root, _ = store_of(self.path)
        committed = f"{root}/{self.staging}/{_COMMITTED}"
        store.create_dir(committed, recursive=True)
        listings = []
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            if message.listing is not None:
                listings.append(f"{committed}/{message.task:06d}.json")
                store.move(message.listing, listings[-1])
        if self.later:
            return
        rows = []
        for listing in listings:
            with store.open_input_stream(listing) as lines:
                rows += [json.loads(line) for line in lines.read().splitlines()]
        rows.sort(key=lambda r: r["name"])
        _give_names(self.path, ((r["name"], r["staged"], r["items"]) for r in rows))
        _drop_staging(self.path, self.staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _drop_staging(self.path, self.staging)


_COMMITTED = "committed"


def _new_staging() -> str:
    return f"_staging-{uuid.uuid4().hex}"


def _listed(document: _Document, task: int, number: int) -> bytes:
    row = {"name": document.name, "staged": document.staged, "items": document.items, "task": task, "number": number}
    return json.dumps(row).encode() + b"\n"


def _drop_staging(path: str, staging: str) -> None:
    store, root, _ = store_of(path.rstrip("/"))
    if store.get_file_info(f"{root}/{staging}").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/{staging}")


def _publish(spark: SparkSession, path: str, staging: str) -> None:
    """Give the staged documents their names, in tasks by ranges of names; a task may run twice."""
    listed = spark.read.schema("name string, staged string, items long, task int, number int").json(f"{path}/{staging}/{_COMMITTED}")
    parts = 4 * spark.sparkContext.defaultParallelism  # by number: the rows are few bytes, each stands for a file
    ranged = listed.repartitionByRange(parts, "name").sortWithinPartitions("name", "task", "number")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("name", "staged", "items"))))
        yield pa.RecordBatch.from_pydict({"documents": [_give_names(path, rows)]})

    ranged.mapInArrow(name, "documents long").agg(F.sum("documents")).collect()


def _give_names(path: str, rows: Iterable[tuple[str, str, int]]) -> int:
    """Name the documents of (name, staged path, items), parts of a name together and in order; what else had the name goes."""
    store, root, _ = store_of(path.rstrip("/"))
    done, folder, older = 0, None, {}
    for name, group in groupby(rows, key=lambda r: r[0]):
        staged = [(at, items) for _, at, items in group]
        inside = f"{root}/{name}".rpartition("/")[0]
        if inside != folder:
            store.create_dir(inside, recursive=True)
            folder, older = inside, _older_parts(store, root, name)
        stem, dot, ending = name.rpartition(".")
        names = [name] + [f"{stem}.part-{i:05d}{dot}{ending}" for i in range(1, len(staged))]
        manifest = f"{root}/{_manifest(name)}"
        if len(staged) > 1:
            listed = [{"name": n.rpartition("/")[2], "items": items} for n, (_, items) in zip(names, staged)]
            with store.open_output_stream(f"{staged[0][0]}-manifest") as out:
                out.write(json.dumps({"parts": listed}).encode())
            staged = [*staged, (f"{staged[0][0]}-manifest", 0)]
            names.append(_manifest(name))
        for place, (at, _) in zip(reversed(names), reversed(staged)):  # the first part comes last
            try:
                store.move(at, f"{root}/{place}")
            except OSError:  # an earlier run of this task has moved it
                if {i.type for i in store.get_file_info([at])} != {fs.FileType.NotFound} or store.get_file_info(f"{root}/{place}").type != fs.FileType.File:
                    raise
        for stale in older.get(name, ()):
            if stale != manifest and stale[len(root) + 1:] not in names or stale == manifest and len(staged) == 1:
                store.delete_file(stale)
        done += 1
    return done


def _older_parts(store: fs.FileSystem, root: str, name: str) -> dict[str, list[str]]:
    """Parts and manifests that lie in the folder of ``name`` already, by document."""
    found: dict[str, list[str]] = {}
    folder = name.rpartition("/")[0]
    inside = f"{root}/{folder}".rstrip("/")
    for info in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
        part = re.fullmatch(r"(.*)\.part-\d{5}(\.[^.]*)?", info.base_name)
        listed = re.fullmatch(r"_(.*)\.parts", info.base_name)
        if part or listed:
            base = part[1] + (part[2] or "") if part else listed[1]
            found.setdefault(f"{folder}/{base}" if folder else base, []).append(info.path)
    return found


def _manifest(name: str) -> str:
    """The manifest of a document in parts; readers pass over names that begin with an underscore."""
    folder, slash, base = name.rpartition("/")
    return f"{folder}{slash}_{base}.parts"


class NestedDocuments(DataSource):
    """``df.write.format("nested_documents")`` for rows (file, opens, closes, item); see :func:`write_documents`."""

    @classmethod
    def name(cls) -> str:
        return "nested_documents"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        missing = set(COLUMNS) - set(schema.names)
        if missing:
            raise ValueError(f"rows need the columns {sorted(missing)}")
        return _Writer(self.options["path"], schema.names, self.options.get("staging"))


def level(opening: Column, list_name: str) -> tuple[Column, Column]:
    """Opening and closing text of an object with some fields first and then a list.

    ``opening`` is the JSON text of the fields as an object.
    """
    fields = F.substring(opening, F.lit(2), F.length(opening) - 2)
    comma = F.when(fields == "", F.lit("")).otherwise(F.lit(","))
    return F.concat(F.lit("{"), fields, comma, F.lit(f'"{list_name}":[\n')), F.lit("\n]}")


def write_documents(
    rows: DataFrame, path: str, file: Column, levels: Sequence[tuple[Column, Column]], item: Column,
    order: Sequence[str], rows_per_part: int = ROWS_PER_PART,
) -> None:
    """Write one nested document per value of ``file`` (a name below ``path``), items in ``order``.

    ``levels`` are opening and closing texts from the outside in; ``order`` must keep the rows of a
    level together. Documents of the names that occur are replaced, others stay; a name without
    rows gets no document. Up to ``rows_per_part`` rows a document is one task's; a larger one is
    range-partitioned by ``order`` as well, and its parts stand in order. Rows are sorted and
    streamed: memory does not grow with a document. ``rows`` is read up to three times: pass a
    written table if it is dear to compute. Rows with a null name, item or level are an error.
    """
    rows.sparkSession.dataSource.register(NestedDocuments)
    texts = rows.select(
        file.alias("file"), F.array(*[a for a, _ in levels]).alias("opens"), F.array(*[b for _, b in levels]).alias("closes"),
        item.alias("item"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)])
    checked = texts.withColumn("file", F.when(
        F.col("file").isNull() | F.col("item").isNull() | F.exists(F.concat("opens", "closes"), lambda x: x.isNull()),
        F.raise_error(F.lit("a document's name, item or level is null"))).otherwise(F.col("file")))
    large = texts.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_part)
    large = large.select(F.col("file").alias("__large"))  # one in rows_per_part rows at most
    keys = [f"__{i}" for i in range(len(order))]
    marked = checked.join(large, F.col("file") == F.col("__large"), "left")
    cuts = [F.when(F.col("__large").isNotNull(), F.col(k)) for k in keys]
    ranged = marked.repartitionByRange("file", *cuts).sortWithinPartitions("file", *keys)
    staging = _new_staging()
    try:
        ranged.select(*COLUMNS).write.format("nested_documents").option("staging", staging).mode("append").save(path)
        _publish(rows.sparkSession, path.rstrip("/"), staging)
    finally:
        _drop_staging(path, staging)

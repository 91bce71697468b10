"""A data source for the items of lists within JSON documents, read piece by piece.

Spark's reader of whole JSON documents holds a document in memory. Here a document is walked
while it is read, and each item of the wanted lists becomes a row as soon as it is parsed: a
task needs memory for one item and one batch of rows. Files of a few bytes share a task.
"""

from __future__ import annotations

import codecs
import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plenumlens.storage import files_below, store_of

#: Bytes read at once.
CHUNK = 1 << 20
#: Bytes of the files that share a task, and of the ranges that a file of lines is cut into.
TASK_BYTES = 64 << 20
#: Rows and characters of a batch, at most, beyond one item.
BATCH_ROWS, BATCH_CHARS = 2_000, 8 << 20

COLUMNS = "source_file string, file_name string, pos bigint, head string, item string, _corrupt_record string"

#: An error so close to the end of what is read may be the cut, not the document.
_NEAR_END = 16
_BLANK = " \t\n\r"


class BrokenDocument(ValueError):
    """The text is no JSON from here on."""


class JsonCursor:
    """A place in a JSON text that is read as far as needed."""

    def __init__(self, stream: BinaryIO, chunk: int = CHUNK):
        self._stream, self._chunk = stream, chunk
        self._decode = codecs.getincrementaldecoder("utf-8")().decode
        self._parse = json.JSONDecoder().raw_decode
        self._text, self._at, self._before, self._over = "", 0, 0, False
        if self.peek() == "\ufeff":
            self._at += 1

    @property
    def place(self) -> int:
        """Characters passed so far."""
        return self._before + self._at

    def _more(self) -> bool:
        """Read on; what lies behind is let go. At least as much again, so that long values cost no more than their length."""
        if self._over:
            return False
        self._before += self._at
        rest = self._text[self._at:]
        self._at = 0
        try:
            data = self._stream.read(max(self._chunk, len(rest)))
            self._over = not data
            self._text = rest + self._decode(data, self._over)
        except UnicodeDecodeError as error:
            self._over, self._text = True, rest
            raise BrokenDocument(f"no UTF-8 after {self._before + len(rest)} characters: {error.reason}") from None
        return not self._over

    def peek(self) -> str:
        """The next character that is no white space, or '' at the end."""
        while True:
            text, at = self._text, self._at
            while at < len(text) and text[at] in _BLANK:
                at += 1
            self._at = at
            if at < len(text):
                return text[at]
            if not self._more():
                return ""

    def take(self, wanted: str) -> bool:
        """Pass the next character if it is the wanted one."""
        if self.peek() != wanted:
            return False
        self._at += 1
        return True

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise BrokenDocument(f"expected {wanted!r} at character {self.place}, found {self.peek()!r}")

    def value(self) -> tuple[object, str]:
        """The next value, and its text."""
        if self.peek() == "":
            raise BrokenDocument(f"the text ends at character {self.place}")
        while True:
            try:
                found, end = self._parse(self._text, self._at)
            except json.JSONDecodeError as error:
                cut = error.pos >= len(self._text) - _NEAR_END or error.msg.startswith("Unterminated string")
                if cut and not self._over:
                    self._more()
                    continue
                raise BrokenDocument(f"{error.msg} at character {self._before + error.pos}") from None
            except RecursionError:
                raise BrokenDocument(f"nested too deep at character {self.place}") from None
            if isinstance(found, (int, float)) and len(self._text) - end < _NEAR_END and not self._over:  # a number may go on
                self._more()
                continue
            raw = self._text[self._at:end]
            self._at = end
            return found, raw

    def members(self) -> Iterator[str]:
        """Keys of an object; the caller passes each value."""
        self.need("{")
        if self.take("}"):
            return
        while True:
            key, _ = self.value()
            if not isinstance(key, str):
                raise BrokenDocument(f"a key is no text at character {self.place}")
            self.need(":")
            yield key
            if not self.take(","):
                self.need("}")
                return

    def elements(self) -> Iterator[None]:
        """Once before each element of an array; the caller passes it."""
        self.need("[")
        if self.take("]"):
            return
        while True:
            yield
            if not self.take(","):
                self.need("]")
                return


@dataclass(frozen=True)
class Wanted:
    """Which lists hold items, and which fields on the way go with them (dotted names)."""

    lists: frozenset[str]
    keep: frozenset[str]
    bare: bool

    def on_way(self, name: str) -> bool:
        return any(x.startswith(f"{name}.") for x in (*self.lists, *self.keep))


def walk(cursor: JsonCursor, wanted: Wanted, head: dict[str, str]) -> Iterator[str]:
    """Texts of the items of one top-level value; ``head`` has the kept fields passed so far.

    With ``bare``, the objects of a top-level array are items, and so is a top-level object
    without any of the lists.
    """
    if cursor.peek() == "[" and wanted.bare:
        for _ in cursor.elements():
            found, raw = cursor.value()
            if isinstance(found, dict):
                yield raw
    elif cursor.peek() == "{":
        own: dict[str, str] | None = {} if wanted.bare else None
        seen = False
        for item in _object(cursor, "", wanted, head, own):
            if item is None:
                seen = True
            else:
                yield item
        if own and not seen:
            yield "{" + ",".join(f"{json.dumps(k)}:{v}" for k, v in own.items()) + "}"
    else:
        cursor.value()


def _object(cursor: JsonCursor, name: str, wanted: Wanted, head: dict[str, str], own: dict[str, str] | None) -> Iterator[str | None]:
    """Items within an object; None for each list that is met. ``own`` gets the plain fields of a top-level object."""
    for stale in [k for k in head if name and k.startswith(f"{name}.")]:
        del head[stale]
    for key in cursor.members():
        path = f"{name}.{key}" if name else key
        kind = cursor.peek()
        if path in wanted.lists and kind == "[":
            yield None
            if own is not None:
                own.clear()
                own = None
            for _ in cursor.elements():
                yield cursor.value()[1]
        elif wanted.on_way(path) and kind == "{" and path not in wanted.keep:
            yield from _object(cursor, path, wanted, head, None)
        elif wanted.on_way(path) and kind == "[" and path not in wanted.keep:
            for _ in cursor.elements():
                if cursor.peek() == "{":
                    yield from _object(cursor, path, wanted, head, None)
                else:
                    cursor.value()
        else:
            _, raw = cursor.value()
            if path in wanted.keep:
                head[path] = raw
            elif own is not None:
                own[key] = raw


def _head(fields: dict[str, str]) -> str:
    return "{" + ",".join(f"{json.dumps(k)}:{v}" for k, v in fields.items()) + "}"


def items_of(open_file: Callable[[], BinaryIO], wanted: Wanted, chunk: int = CHUNK) -> Iterator[tuple[int, str, str | None, str | None]]:
    """Rows (pos, head, item, error) of one file: its items in order, then one with the error if it breaks off.

    A file is one JSON value or several after each other. Fields kept from the top level may also
    follow the list, if it is the file's first value: they are then looked for ahead.
    """
    pos, first = 0, True
    late: dict[str, str] = {}
    head: dict[str, str] = {}
    with open_file() as stream:
        try:
            cursor = JsonCursor(stream, chunk)
            while cursor.peek():
                head.clear()
                for item in walk(cursor, wanted, head):
                    if first and not pos and not late and any("." not in k and k not in head for k in wanted.keep):
                        late = _look_ahead(open_file, wanted, chunk)
                    yield pos, _head({**(late if first else {}), **head}), item, None
                    pos += 1
                first = False
        except BrokenDocument as error:
            yield pos, _head({**late, **head}), None, str(error)


def _look_ahead(open_file: Callable[[], BinaryIO], wanted: Wanted, chunk: int) -> dict[str, str]:
    found: dict[str, str] = {}
    with open_file() as stream:
        try:
            for _ in walk(JsonCursor(stream, chunk), wanted, found):
                pass
        except BrokenDocument:
            pass
    return {k: v for k, v in found.items() if "." not in k}


def line_items(stream: BinaryIO, start: int, stop: int, wanted: Wanted) -> Iterator[tuple[int, str, str | None, str | None]]:
    """Rows of the lines that begin within a range of bytes; a place is the line's first byte plus the item's number.

    A line without JSON is one row with the error; the others go on.
    """
    at = start
    if start:  # the line that holds the byte before belongs to the range before
        stream.seek(start - 1)
        at += len(stream.readline()) - 1
    while at < stop and (line := stream.readline()):
        if line.strip():
            head: dict[str, str] = {}
            n = 0
            try:
                cursor = JsonCursor(_Once(line), len(line) + 1)
                for item in walk(cursor, wanted, head):
                    yield at + n, _head(head), item, None
                    n += 1
                if cursor.peek():
                    raise BrokenDocument(f"a second value at character {cursor.place}")
            except BrokenDocument as error:
                yield at + n, _head(head), None, str(error)
        at += len(line)


class _Once:
    """Bytes as a stream."""

    def __init__(self, data: bytes):
        self._data = data

    def read(self, _: int) -> bytes:
        data, self._data = self._data, b""
        return data


@dataclass
class Share(InputPartition):
    """What one task reads: (path, start, stop) of each file; stop is -1 for whole documents."""

    files: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        # options come with their names in lower case
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.glob = options.get("pathglobfilter", "*.json")
        self.recursive = options.get("recursivefilelookup", "true").lower() == "true"
        self.lines = options.get("lines", "false").lower() == "true"
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        names = {k: frozenset(filter(None, options.get(k, "").split(","))) for k in ("lists", "keep")}
        self.wanted = Wanted(names["lists"], names["keep"], options.get("bare", "true").lower() == "true")

    def partitions(self) -> list[Share]:
        shares: list[Share] = []
        held = self.task_bytes
        for root in self.paths:
            for path, size in files_below(root, self.glob, self.recursive):
                ranges = [(path, 0, -1)]
                if self.lines:
                    ranges = [(path, at, min(at + self.task_bytes, size)) for at in range(0, size, self.task_bytes)]
                for one in ranges:
                    weight = max(one[2] - one[1] if self.lines else size, 4096)  # opening a file isn't free
                    if held + weight > self.task_bytes:
                        shares.append(Share([]))
                        held = 0
                    shares[-1].files.append(one)
                    held += weight
        return shares

    def _rows(self, path: str, start: int, stop: int):
        store, _, _ = store_of(self.paths[0])
        if self.lines:
            with io.BufferedReader(store.open_input_file(path), CHUNK) as stream:
                yield from line_items(stream, start, stop, self.wanted)
        else:
            yield from items_of(lambda: store.open_input_stream(path, buffer_size=None), self.wanted)

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        _, _, prefix = store_of(self.paths[0])
        rows: list[tuple] = []
        chars = 0
        for path, start, stop in share.files:
            name = path.rsplit("/", 1)[-1]
            for pos, head, item, error in self._rows(path, start, stop):
                rows.append((prefix + path, name, pos, head, item, error))
                chars += len(item or "") + len(head)
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield _batch(rows)
                    rows, chars = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names)


class JsonItems(DataSource):
    """``spark.read.format("json_items")``; see :func:`read_items` for the options."""

    @classmethod
    def name(cls) -> str:
        return "json_items"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_items(spark: SparkSession, path: str | list[str], lists: list[str], keep: list[str] | None = None, bare: bool = False,
               glob: str = "*.json", recursive: bool = True, lines: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows (source_file, file_name, pos, head, item, _corrupt_record) for the items of all files below ``path`` (or several, of one store).

    ``lists`` and ``keep`` are dotted names, also through arrays of objects. ``item`` is an
    item's JSON text, ``head`` a JSON object of the kept fields that apply to it, by dotted name;
    ``pos`` orders the items of a file and is the same in every run. What is read of a broken file
    stays; one further row without an item has the error. ``lines`` reads files of one value a
    line in byte ranges, each line on its own. A file without items gives no row. Of two of the
    lists in one document both are read.
    """
    spark.dataSource.register(JsonItems)
    reader = spark.read.format("json_items").options(
        lists=",".join(lists), keep=",".join(keep or []), bare=str(bare).lower(), pathGlobFilter=glob,
        recursiveFileLookup=str(recursive).lower(), lines=str(lines).lower(), taskBytes=str(task_bytes))
    return reader.load(path) if isinstance(path, str) else reader.option("paths", json.dumps(path)).load()

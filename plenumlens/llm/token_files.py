"""Token ids as Parquet list columns.

One row per document, in ascending id order over all files, with its ids as a list. The ids are
dictionary encoded (a vocabulary fits in one dictionary page), numbers are delta encoded, row
groups and pages are kept small, and the writer adds page indexes. A reader of a few documents
or of the metadata columns alone therefore touches only their pages.

Each file holds a contiguous range of ids and counts from its own start; the small manifest has
the start of every file.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenumlens.llm.tables import settled, small_batches

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: Pieces of text whose ids a worker keeps.
PIECES_KEPT = 800_000
#: Characters that are tokenized at once.
SLICE = 4 << 20

ROW = "shard int, doc_id long, start_in_shard long, n_tokens long, ids array<int>"


#: A word of Latin letters, perhaps after a line feed and before ASCII signs: the tokenizer cuts it there.
_WORD = re.compile("(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\\[-`{-~]*)")
#: Words that are tokenized in one text, between line feeds.
_TOGETHER = 32
_LED, _BARE, _RAW = 0, 1, 2


#: A blank or line feed within white space that goes on: no border of pieces. Without one of the
#: suspect strings an ASCII text has none, but perhaps at its end.
_JOINED = re.compile(r"\s[ \n](?!\S)")
_SUSPECT = ["  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f"]


class _Pieces(dict):
    """Numbers of the pieces of texts, the parts of each piece, and the ids of each part.

    A piece stands with a blank before it, unless it begins with a line feed or is a tuple (the
    beginning of a text). Its parts are words with a blank before them or without, and anything
    else as it is. New parts wait in ``new`` for their ids.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.size, self.n_parts = tokenizer, 0, 0
        self.parts: tuple[dict[str, int], ...] = ({}, {}, {})
        self.new: tuple[list[str], ...] = ([], [], [])
        self.numbers: tuple[list[int], ...] = ([], [], [])
        self.of: list[int] = []  # parts of the pieces that wait
        self.ends: list[int] = []
        self.line = tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.first = np.zeros(1, np.int64)  # of each part's ids
        self.ids = np.empty(0, np.int32)
        self.first_part = np.zeros(1, np.int64)  # of each piece's parts
        self.part = np.empty(0, np.int64)

    def _part(self, kind: int, text: str) -> int:
        number = self.parts[kind].get(text)
        if number is None:
            number = self.parts[kind][text] = self.n_parts
            self.n_parts = number + 1
            self.new[kind].append(text)
            self.numbers[kind].append(number)
        return number

    def __missing__(self, piece) -> int:
        number = self.size
        self.size = number + 1
        if type(piece) is tuple:
            self.of.append(self._part(_RAW, piece[0]))
        else:
            self[piece] = number
            if piece.isascii() and piece.isalpha():
                self.of.append(self._part(_LED, piece))
            elif (word := _WORD.fullmatch(piece)) is None:
                self.of.append(self._part(_RAW, piece if piece[:1] == "\n" else " " + piece))
            else:
                line, letters, signs = word.groups()
                if line:
                    self.of.append(self._part(_RAW, line))
                self.of.append(self._part(_BARE if line else _LED, letters))
                if signs:
                    self.of.append(self._part(_RAW, signs))
        self.ends.append(len(self.of))
        return number

    def learn(self) -> None:
        """Tokenize the waiting parts: words in lines of one text, whose line feeds mark the borders."""
        known = len(self.first) - 1
        sizes = np.zeros(self.n_parts - known, np.int64)
        found = []
        for kind, texts in enumerate(self.new):
            if not texts:
                continue
            numbers = np.array(self.numbers[kind]) - known
            if kind != _RAW:
                lead = " " if kind == _LED else ""
                texts = [lead + f"\n{lead}".join(texts[i:i + _TOGETHER]) for i in range(0, len(texts), _TOGETHER)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            if kind == _RAW:
                sizes[numbers] = [len(g) for g in got]
                ids = np.fromiter(chain.from_iterable(got), np.int32)
            else:
                marked = np.fromiter(chain.from_iterable(chain.from_iterable(zip(got, repeat([self.line])))), np.int32)
                sizes[numbers] = np.diff(np.flatnonzero(marked == self.line), prepend=-1) - 1
                ids = marked[marked != self.line]
            found.append((numbers, ids))
        self.new, self.numbers = ([], [], []), ([], [], [])
        first = np.concatenate([[0], np.cumsum(sizes)])
        fresh = np.empty(int(first[-1]), np.int32)
        for numbers, ids in found:
            fresh[_runs(first[numbers], sizes[numbers])] = ids
        self.first = np.concatenate([self.first, first[1:] + self.first[-1]])
        self.ids = np.concatenate([self.ids, fresh])
        self.first_part = np.concatenate([self.first_part, np.array(self.ends, np.int64) + self.first_part[-1]])
        self.part = np.concatenate([self.part, np.array(self.of, np.int64)])
        self.of, self.ends = [], []


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions first, first + 1... of runs of the given sizes, one after the other."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer, with the ids of words that come again kept.

    The tokenizer always cuts a text before a blank or line feed that follows a sign, or that
    stands before one; what lies between such borders is tokenized on its own, with the same
    ids. Texts with a blank or line feed that is neither (in long runs of white space), and those
    that hold the name of a special token, are tokenized as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, text: str) -> bool:
        """Whether the text must be tokenized as it is."""
        if any(s in text for s in self.special):
            return True
        if text.isascii() and not any(s in text for s in _SUSPECT):
            return text[-1:] in (" ", "\n") and text[-2:-1].isspace()
        return _JOINED.search(text) is not None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one after the other, and each text's number of ids."""
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        collects = gc.isenabled()
        gc.disable()  # the many lists of strings and ids hold no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.pieces.size > PIECES_KEPT:
            self.pieces = _Pieces(self.tokenizer)
        number = self.pieces.__getitem__
        plan: list[int] = []
        begin = []
        for text in texts:
            begin.append(len(plan))
            if self._whole(text):
                plan.append(number((text,)))
            else:
                head, *rest = text.replace("\n", " \n").split(" ")
                plan.append(number((head,)))
                plan.extend(map(number, rest))
        known = self.pieces
        known.learn()
        at = np.array(plan, np.int64)
        n = known.first_part[at + 1] - known.first_part[at]
        part = known.part[_runs(known.first_part[at], n)]
        size = known.first[part + 1] - known.first[part]
        per_text = np.add.reduceat(np.add.reduceat(size, np.cumsum(n) - n), begin)
        return known.ids[_runs(known.first[part], size)], per_text


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of this worker; what it has learnt serves the worker's next tasks too."""
    return Encoder(path)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= SLICE:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _tokenizer(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in settled(batches):
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids, sizes = encoder.encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(sizes), end)
                sizes = sizes + 1
                last = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(b - a, shard, np.int32)), batch.column(0).slice(a, b - a), pa.array(start + last - sizes),
                    pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.append(0, last).astype(np.int32)), pa.array(ids, pa.int32()))],
                    ["shard", "doc_id", "start_in_shard", "n_tokens", "ids"])
                start += int(last[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END_ID,
                 shards: int | None = None, dictionary: bool = True) -> None:
    """Tokenize ``docs`` and write them below ``path``, ascending by key over the files.

    Null and empty texts have the end id alone, null keys come first, rows of equal keys follow
    each other in the order of a hash of their text, and an empty table writes a table without
    rows. Other columns are left out. ``dictionary=False`` delta-encodes the ids as well.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    ordered = plain.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    (ordered.mapInArrow(_tokenizer(tokenizer, end), ROW).write.mode("errorifexists")
     .option("compression", "zstd").option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", str(dictionary).lower())
     .option("parquet.block.size", str(ROW_GROUP_BYTES)).option("parquet.page.size", str(PAGE_BYTES))
     .option("parquet.page.row.count.limit", str(PAGE_ROWS)).parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; filters on ``doc_id`` and column choices reach the files."""
    return spark.read.schema(ROW).parquet(path)


def manifest(tokens: DataFrame) -> DataFrame:
    """Rows (shard, start, docs, tokens), one per file range; reads the metadata columns only."""
    sums = tokens.groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file range
    return sums.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in settled(batches):
        lists = batch.column(4)
        edges = lists.offsets.to_numpy().tolist()
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())],
                                         ["shard", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"])


def document_facts(tokens: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read back from the files."""
    facts = tokens.select(*[c.split()[0] for c in ROW.split(", ")]).mapInArrow(
        _checksums, "shard int, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long")
    starts = manifest(tokens).select("shard", "start")
    return facts.join(starts, "shard").select("doc_id", (F.col("start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")

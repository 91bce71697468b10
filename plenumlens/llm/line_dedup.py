"""Removing lines that stand, up to one word, earlier in the corpus.

Lines are compared as words. Two lines are near if one word inserted, deleted or replaced turns
one into the other; lines of few words must be equal.

* The deletion neighbourhood of a line is the line and all its variants without one word. Near
  lines have a variant in common: the same place deleted in both (replaced), or one of them whole
  (inserted or deleted). So a group of equal variants needs no pairs: whoever isn't the earliest
  of its group is near to the earliest, and goes.
* Near lines agree in the first or the last half of their words. Lines that share no half with
  another line are left out before any variant is made, without losing a pair.
* Each line that is to go is compared word by word with the earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenumlens.llm.jaccard import text_keys
from plenumlens.llm.tables import mix64, settled, small_batches, text_bytes
from plenumlens.session import materialize

#: Shorter lines are near only if they are equal.
MIN_WORDS = 5
#: Size of the filter that spares lines without a partner a shuffle.
FILTER_BITS = 1 << 26

PLACE = ["id", "k1", "k2", "no"]
_BASE = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def words_of(line: bytes) -> list[bytes]:
    return line.lower().split()


def halves(words: list[bytes]) -> list[int]:
    """Keys of the beginnings and ends that a near line shares: for lines as long, and one word longer or shorter."""
    n, out = len(words), set()
    for m in (n, n + 1):
        for kind, part in ((0, words[: m // 2]), (1, words[max(0, n - (m - 1) // 2 - 1):])):
            if len(part) == (m // 2 if kind == 0 else (m - 1) // 2 + 1):
                out.add(xxhash.xxh64_intdigest(b" ".join(part), m << 1 | kind))
    return sorted(out)


def variants(words: list[bytes]) -> np.ndarray:
    """Hashes of the whole line, and of the line without each of its words in turn."""
    n = len(words)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    # sums of word hashes times powers, from the left and (one power up) from the right
    left = np.concatenate(([np.uint64(0)], np.cumsum(h * power[:n], dtype=np.uint64)))
    raised = np.concatenate(([np.uint64(0)], np.cumsum(h[1:] * power[: n - 1], dtype=np.uint64))) if n else left
    without = left[:-1] + (raised[-1] - raised) if n else left[:0]
    sizes = np.concatenate(([n], np.full(n, n - 1))).astype(np.uint64)
    return mix64(np.concatenate((left[-1:], without)) ^ mix64(sizes))


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = 0
    while same < len(a) and a[same] == b[same]:
        same += 1
    return a[same + (len(a) == len(b)):] == b[same + 1:]


def _digest(words: list[bytes]) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (digest >> 64) - (1 << 63), (digest & _WRAP) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, int, list[bytes], tuple[int, int]]]:
    """Row, batch, line number, words and digest of every line that has words."""
    for batch in settled(batches):
        for i, text in enumerate(batch.column(3).to_pylist()):
            for no, line in enumerate(text.split(b"\n")):
                words = words_of(line)
                if words:
                    yield i, batch, no, words, _digest(words)


PLACES = "h1 long, h2 long, id long, k1 long, k2 long, no int"
HALVES = "h1 long, half long"
TEXTS = "h1 long, h2 long, line binary"
SLICE = 50_000


def _columns(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of every line."""
    h, rows, numbers, of = [], [], [], None

    def out() -> pa.RecordBatch:
        at = pa.array(rows)
        return _columns(PLACES, [x for x, _ in h], [x for _, x in h], *(of.column(c).take(at) for c in range(3)), numbers)

    for i, batch, no, _, digest in _lines(batches):
        if h and (batch is not of or len(h) >= SLICE):
            yield out()
            h, rows, numbers = [], [], []
        of = batch
        h.append(digest)
        rows.append(i)
        numbers.append(no)
    if h:
        yield out()


def _halved(min_words: int):
    """Keys of the halves of every line that is long enough, once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        h, sizes, keys = [], [], []
        for _, _, _, words, (h1, _) in _lines(batches):
            if len(words) < min_words or h1 in seen:
                continue
            seen.add(h1)
            found = halves(words)
            h.append(h1)
            sizes.append(len(found))
            keys += found
            if len(h) >= SLICE:
                yield _columns(HALVES, np.repeat(np.array(h, np.int64), sizes), np.array(keys, np.uint64).view(np.int64))
                h, sizes, keys = [], [], []
        if h:
            yield _columns(HALVES, np.repeat(np.array(h, np.int64), sizes), np.array(keys, np.uint64).view(np.int64))

    return run


def _wanted(shared, min_words: int):
    """Lines that the filter of wanted digests lets through, once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen, rows = shared.value, set(), []
        for _, _, _, words, (h1, h2) in _lines(batches):
            if len(words) >= min_words and passes(bits, h1) and h1 not in seen:
                seen.add(h1)
                rows.append((h1, h2, b" ".join(words)))
                if len(rows) >= SLICE:
                    yield _columns(TEXTS, *zip(*rows, strict=True))
                    rows = []
        if rows:
            yield _columns(TEXTS, *zip(*rows, strict=True))

    return run


def make_filter(keys: DataFrame, column: str) -> bytes:
    """A Bloom filter of ``FILTER_BITS`` bits over uniform 64-bit keys; its size doesn't grow with their number."""
    low = F.col(column).bitwiseAND(FILTER_BITS - 1)
    high = F.shiftright(column, 28).bitwiseAND(FILTER_BITS - 1)
    spots = keys.select(F.explode(F.array(low, high)).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    table = words.toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out.tobytes()


def passes(bits: bytes, key: int) -> bool:
    """Whether the filter may hold the key."""
    low, high = key & (FILTER_BITS - 1), key >> 28 & (FILTER_BITS - 1)
    return bool(bits[low >> 3] >> (low & 7) & 1 and bits[high >> 3] >> (high & 7) & 1)


def _vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each variant of a line: hash, deleted place (-1: none), and the line's earliest place."""
    for batch in settled(batches):
        got = [variants(line.split()) for line in batch.column(0).to_pylist()]
        sizes = np.array([len(g) for g in got])
        at = pa.array(np.repeat(np.arange(len(got)), sizes))
        cut = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64)), pa.array(cut.astype(np.int32)),
                                          batch.column(1).take(at)], ["v", "cut", "place"])


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("id"), *text_keys(text), text_bytes(text).alias("text"))


def _place() -> Column:
    return F.struct(*PLACE).alias("place")


def line_states(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (h1, h2, place, times, near) per distinct line: its earliest place, how often it stands, and an earlier near line's place, or null."""
    spark, rows = docs.sparkSession, _rows(docs, key, text)
    small_batches(spark)
    distinct = materialize(rows.mapInArrow(_places, PLACES).groupBy("h1", "h2").agg(
        F.min(_place()).alias("place"), F.count(F.lit(1)).alias("times")), "lines")
    shared = rows.mapInArrow(_halved(min_words), HALVES).distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("half")))
    several = materialize(shared.where("n > 1").select("h1").distinct(), "several")
    known = spark.sparkContext.broadcast(make_filter(several, "h1"))
    texts = rows.mapInArrow(_wanted(known, min_words), TEXTS).join(several, "h1").groupBy("h1", "h2").agg(F.first("line").alias("line"))
    lines = materialize(texts.join(distinct, ["h1", "h2"]).select("h1", "h2", "line", "place"), "near-lines")
    varied = lines.select("line", "place").mapInArrow(_vary, "v long, cut int, place struct<id:bigint,k1:bigint,k2:bigint,no:int>")
    of_all = Window.partitionBy("v")
    whole = F.min(F.when(F.col("cut") < 0, F.col("place"))).over(of_all)
    short = F.min(F.when(F.col("cut") >= 0, F.col("place"))).over(of_all)
    same = F.min("place").over(Window.partitionBy("v", "cut"))
    met = varied.select("place", "cut", whole.alias("whole"), short.alias("short"), same.alias("same"))
    earliest = F.when(F.col("cut") >= 0, F.least("whole", "same")).otherwise(F.col("short"))
    pairs = met.withColumn("first", earliest).where("first < place").groupBy("place").agg(F.min("first").alias("first"))

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype=bool)

    mine = lines.select("h1", "h2", "place", F.col("line").alias("mine"))
    other = lines.select(F.col("place").alias("first"), F.col("line").alias("other"))
    checked = pairs.join(mine, "place").join(other, "first").where(near("mine", "other")).select("h1", "h2", F.col("first").alias("near"))
    return distinct.join(checked, ["h1", "h2"], "left")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                with_text: bool = False) -> DataFrame:
    """What is left of each document without lines that stand earlier, or nearly so.

    Earlier is the smaller key, then the smaller line number. Of equal lines the earliest stays;
    a line whose earliest place follows that of a near line goes everywhere. Lines without words
    stay. Returns key, n_lines, n_removed, kept_bytes, kept_sha256 and, on demand, ``kept``.
    Null texts are empty, null keys come first, rows of equal key and text are one place (neither
    loses lines to the other), and an empty table gives an empty result. Keys must be integers;
    other columns are left out.
    """
    states = line_states(docs, key, text, min_words).where("times > 1 or near is not null")
    places = _rows(docs, key, text).mapInArrow(_places, PLACES)
    gone = places.join(states, ["h1", "h2"]).where(F.col("near").isNotNull() | (F.col("place") != _place()))
    lists = gone.groupBy("id", "k1", "k2").agg(F.collect_set("no").alias("gone"))
    rows = docs.select(docs[key].alias("key"), *text_keys(text), text_bytes(text).alias("bytes"))
    lists = lists.select(F.col("id").alias("lid"), F.col("k1").alias("l1"), F.col("k2").alias("l2"), "gone")
    joined = rows.join(lists, F.col("key").cast("long").eqNullSafe(F.col("lid")) & (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left")

    @F.pandas_udf("struct<n_lines:bigint,n_removed:bigint,kept:binary>")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for t, g in zip(texts, gone, strict=True):
            lines, drop = t.split(b"\n"), set() if g is None else set(g.tolist())
            out.append((len(lines), len(drop), b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else t))
        return pd.DataFrame(out, columns=["n_lines", "n_removed", "kept"])

    left = joined.withColumn("left", cut("bytes", "gone"))
    return left.select(F.col("key").alias(key), "left.n_lines", "left.n_removed", F.octet_length("left.kept").cast("long").alias("kept_bytes"),
                       F.sha2("left.kept", 256).alias("kept_sha256"), *(["left.kept"] if with_text else []))

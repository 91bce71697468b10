"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all normalised items reads a document word by word and knows, after each
word, the longest stretch of words ending there that also stands in some item. Where that
length reaches the limit (or a short item is complete), the last words are hit.

The items are a stated query set. They are built into automata of bounded size, in blocks:
every block reads every document, and the hits of the blocks are joined. The hits of a block
are written before the next one reads, so that a task holds one automaton at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumlens.llm.tables import cut_points, settled, small_batches, text_bytes
from plenumlens.session import materialize

#: Consecutive item words that make a leak.
SPAN_WORDS = 10
#: Words of the items in one automaton. With at most two states a word, its size is bounded.
BLOCK_WORDS = 300_000
#: A document with a larger share of hit words goes as a whole.
MAX_COVERAGE = 0.5

#: Lower-cases A-Z and turns every other ASCII byte that isn't a letter or digit into a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

CUT = "struct<share:double,text:binary>"
HITS = "struct<n_words:bigint,n_hit:bigint,spans:array<int>,items:array<string>>"


def words_of(text: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and bytes above 0x7F, after lower-casing A-Z."""
    return text.translate(_FOLD).split()


class Automaton:
    """All stretches of the items' words, and which items they come from.

    ``step``, ``link`` and ``size`` are the usual parts: transitions, suffix links, and the
    longest stretch of a state. ``short`` holds, for items below the limit, their length at the
    state that they end in.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], limit: int = SPAN_WORDS):
        self.limit = limit
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.short: dict[int, int] = {}
        worded = [(name, words_of(text)) for name, text in items]
        for _, words in worded:
            at = 0
            for word in words:
                at = self._add(at, word)
        self.items: dict[int, set[str]] = {}
        for name, words in worded:
            self._mark(name, words)
        # the short items that end wherever a state ends, longest first, through the suffix links
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        if self.short:
            for state in sorted(range(1, len(self.link)), key=self.size.__getitem__):
                above = self.ends[self.link[state]]
                self.ends[state] = ((self.short[state], state), *above) if state in self.short else above

    def _copy(self, state: int, size: int) -> int:
        self.step.append(dict(self.step[state]))
        self.link.append(self.link[state])
        self.size.append(size)
        return len(self.link) - 1

    def _turn(self, state: int, word: bytes, old: int, new: int) -> None:
        while state >= 0 and self.step[state].get(word) == old:
            self.step[state][word] = new
            state = self.link[state]

    def _add(self, last: int, word: bytes) -> int:
        """Lengthen the stretch of state ``last`` by a word; returns the state of the longer one."""
        known = self.step[last].get(word)
        if known is not None:
            if self.size[known] == self.size[last] + 1:
                return known
            twin = self._copy(known, self.size[last] + 1)
            self.link[known] = twin
            self._turn(last, word, known, twin)
            return twin
        self.step.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        new, state = len(self.link) - 1, last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            known = self.step[state][word]
            if self.size[known] == self.size[state] + 1:
                self.link[new] = known
            else:
                twin = self._copy(known, self.size[state] + 1)
                self.link[known] = self.link[new] = twin
                self._turn(state, word, known, twin)
        return new

    def _mark(self, name: str | None, words: list[bytes]) -> None:
        """Note the item at the states of its windows (or of itself, if it is short)."""
        limit, at = self.limit, 0
        for i, word in enumerate(words):
            at = self.step[at][word]
            if i + 1 >= limit:
                while self.size[self.link[at]] >= limit:
                    at = self.link[at]
                if name is not None:
                    self.items.setdefault(at, set()).add(name)
        if 0 < len(words) < limit:
            self.short[at] = len(words)
            if name is not None:
                self.items.setdefault(-at, set()).add(name)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit (0/1), and the items found."""
        step, link, size, limit, ends = self.step, self.link, self.size, self.limit, self.ends
        begins, finals, found = [], [], set()
        root, at, length = step[0], 0, 0
        for i, word in enumerate(words):
            to = step[at].get(word)
            if to is None:
                if word not in root:
                    at = length = 0
                    continue
                while to is None:
                    at = link[at]
                    to = step[at].get(word)
                length = size[at]
            at = to
            length += 1
            if length >= limit:
                while size[link[at]] >= limit:  # the state of the last ``limit`` words alone
                    at = link[at]
                length = min(length, size[at])
                begins.append(i + 1 - limit)
                finals.append(i + 1)
                found |= self.items.get(at, set())
            for short, state in ends[at]:
                if short <= length:
                    begins.append(i + 1 - short)
                    finals.append(i + 1)
                    found |= self.items.get(-state, set())
        depth = np.zeros(len(words) + 1, np.int32)
        np.add.at(depth, begins, 1)
        np.add.at(depth, finals, -1)
        return (np.cumsum(depth)[:-1] > 0).astype(np.int8), found


def read_hits(text: bytes, automaton: Automaton, before: dict | None = None) -> dict:
    """A document's hits as in ``HITS``; ``spans`` is start, end, start, end... in words."""
    words = words_of(text)
    hit, found = automaton.read(words)
    if before is not None:
        for first, last in zip(before["spans"][::2], before["spans"][1::2], strict=True):
            hit[first:last] = 1
        found |= set(before["items"])
    first, last = cut_points(hit)
    spans = np.stack([first, last], 1).ravel().astype(np.int32)
    return {"n_words": len(words), "n_hit": int(hit.sum()), "spans": spans.tolist(), "items": sorted(found)}


def cut_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them; a line feed marks each cut."""
    folded = text.translate(_FOLD)
    edge = np.diff(np.concatenate(([0], (np.frombuffer(folded, np.uint8) != 32).astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts, at = [], 0
    for first, last in zip(spans[::2], spans[1::2], strict=True):
        parts += [text[at:starts[first]], b"\n"]
        at = ends[last - 1]
    return b"".join([*parts, text[at:]])


def n_blocks(items: DataFrame, text: str, block_words: int) -> int:
    """In how many blocks the items are read."""
    total = items.select(text_bytes(text).alias("text")).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 + total // (2 * block_words)  # a word and its separator take two bytes at least


def automata(items: DataFrame, key: str, text: str, limit: int, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """The items' automata, one at a time; only one block of items is on the driver at once."""
    sized = items.select(F.col(key).cast("string").alias("name"), text_bytes(text).alias("text"))
    blocks = n_blocks(items, text, block_words)
    for block in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect() if blocks > 1 else sized.collect()
        yield Automaton(sorted(((r["name"], bytes(r["text"])) for r in rows), key=lambda r: (r[1], r[0] or "")), limit)


def _reader(spark, automaton: Automaton, first: bool):
    shared = spark.sparkContext.broadcast(automaton)

    if first:
        @F.pandas_udf(HITS)
        def read_first(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            known = shared.value
            for batch in settled(texts):
                yield pd.DataFrame([read_hits(t, known) for t in batch], columns=["n_words", "n_hit", "spans", "items"])

        return read_first

    @F.pandas_udf(HITS)
    def read_more(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts, before in settled(batches):
            rows = [read_hits(t, known, b) for t, b in zip(texts, before.to_dict("records"), strict=True)]
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "items"])

    return read_more


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
              limit: int = SPAN_WORDS, block_words: int = BLOCK_WORDS, into: str = "hits") -> DataFrame:
    """Add the column ``into``: words, hit words, hit spans (in words) and items found, per document.

    A window is ``limit`` consecutive words of an item, or a whole shorter item; a document word
    within any occurrence of a window is hit. Null and empty texts have no words, items without
    words or an empty item table hit nothing, equal items all count, items with a null id hit
    but are not listed, repeated rows stay, and a column of the name ``into`` is replaced.
    """
    small_batches(docs.sparkSession)
    for k, automaton in enumerate(automata(items, item_key, item_text, limit, block_words)):
        docs = materialize(docs, "hits") if k else docs
        reader = _reader(docs.sparkSession, automaton, k == 0)
        docs = docs.withColumn(into, reader(text_bytes(text)) if k == 0 else reader(text_bytes(text), F.col(into)))
    return docs


def items_digest(items: Column) -> Column:
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", max_coverage: float = MAX_COVERAGE,
          limit: int = SPAN_WORDS, block_words: int = BLOCK_WORDS, item_key: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """The documents without their hit spans, and without the documents that are hit beyond ``max_coverage``.

    Columns are those of ``docs``. The cut is repeated until the text has no hit any more, since
    cutting brings the words around a span together. Texts without hits are left as they are,
    null stays null.
    """
    columns = docs.columns
    # through a scratch struct, so that no column of the input can clash
    row = F.struct(*[docs[c] for c in columns]).alias("row")
    held = docs.select(row, F.col(text).alias("__text"))
    if n_blocks(items, item_text, block_words) > 1:
        cleaned = _clean_in_rounds(held, items, limit, block_words, item_key, item_text)
    else:
        cleaned = held.withColumn("cut", _cutter(next(automata(items, item_key, item_text, limit, block_words)), docs.sparkSession)(text_bytes("__text")))
    kept = cleaned.where(F.col("cut.share") <= max_coverage)
    fresh = F.when(F.col("__text").isNotNull(), F.col("cut.text").cast("string"))
    return kept.select(*[(fresh if c == text else F.col("row")[c]).alias(c) for c in columns])


def _cutter(automaton: Automaton, spark):
    """A column function: the share of hit words of a text, and what is left of it, by one automaton."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(automaton)

    @F.pandas_udf(CUT)
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in settled(texts):
            out = []
            for whole in batch:
                left, share = whole, None
                while True:
                    hits = read_hits(left, shared.value)
                    share = hits["n_hit"] / max(hits["n_words"], 1) if share is None else share
                    if not hits["spans"]:
                        break
                    left = cut_spans(left, hits["spans"])
                out.append((share, left))
            yield pd.DataFrame(out, columns=["share", "text"])

    return cut


def _clean_in_rounds(held: DataFrame, items: DataFrame, limit: int, block_words: int, item_key: str, item_text: str) -> DataFrame:
    """The column ``cut`` as by :func:`_cutter`, for items in several blocks.

    A round has all blocks read the texts and cuts them; those without hits are done, the others
    are read again. Each round shortens every text that goes on, so the rounds come to an end.
    """
    @F.pandas_udf("binary")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t, list(s)) for t, s in zip(texts, spans, strict=True)], dtype=object)

    done, now = [], held.withColumn("cut", F.struct(F.lit(None).cast("double").alias("share"), text_bytes("__text").alias("text")))
    while True:
        left = now.select("row", "__text", F.col("cut.share").alias("share"), F.col("cut.text").alias("left"))
        read = materialize(with_hits(left, items, "left", item_key, item_text, limit, block_words), "cut-hits")
        share = F.coalesce("share", F.col("hits.n_hit") / F.greatest("hits.n_words", F.lit(1)))
        done.append(read.where("size(hits.spans) = 0").select("row", "__text", F.struct(share.alias("share"), F.col("left").alias("text")).alias("cut")))
        now = read.where("size(hits.spans) > 0").select(
            "row", "__text", F.struct(share.alias("share"), without("left", "hits.spans").alias("text")).alias("cut"))
        if now.isEmpty():
            return reduce(DataFrame.unionByName, done)

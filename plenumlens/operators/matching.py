"""Lexicon matching on segment rows: unrolled, or by automata for lexicons too large for that."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenumlens.functions import automaton
from plenumlens.functions import keywords as kw
from plenumlens.session import materialize

#: Bytes of keywords in one automaton; a larger lexicon is matched in blocks of so many.
BLOCK_BYTES = 32 << 20


def match_keywords(
    segments: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "segment", lenient: bool = False,
    suffixes: Sequence[str] = kw.SUFFIXES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keys, ord, keyword, weight, count`` for each hit of a lexicon table of any size in each segment.

    The table (``ord, keyword, weight``) is measured, and goes to the tasks in blocks of at most
    some ``block_bytes``, by a hash of the keyword; each block is one automaton and one pass over
    the segments, which are written first if there are several. Nothing is shuffled. The rows are
    those of :func:`literal_matches`: blank keywords are left out, and of strict duplicates the first counts.
    """
    named = lexicon.select("ord", F.trim("keyword").alias("keyword"), "weight").where(F.col("keyword") != "")
    size = named.agg(F.sum(F.octet_length("keyword") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    source = segments.select(*keys, text)
    if blocks > 1:
        source = materialize(source, "segments")
    parts = []
    for block in range(blocks):
        rows = named if blocks == 1 else named.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == block)
        entries = [kw.Keyword(r["ord"], r["keyword"].strip(), r["weight"]) for r in sorted(rows.collect(), key=lambda r: r["ord"])]
        parts.append(automaton_matches(source, [e for e in entries if e.keyword], keys, text, lenient, suffixes))
    return reduce(DataFrame.unionAll, parts)


def automaton_matches(
    segments: DataFrame, lexicon: Sequence[kw.Keyword], keys: Sequence[str], text: str = "segment", lenient: bool = False,
    suffixes: Sequence[str] = kw.SUFFIXES,
) -> DataFrame:
    """The rows of :func:`literal_matches`, counted by an automaton in Arrow batches."""
    matches = automaton.text_matches(F.col(text), lexicon, lenient, suffixes)
    return segments.select(*keys, F.explode(matches).alias("m")).select(
        *keys, "m.ord", "m.keyword", "m.weight", F.col("m.count").cast("long").alias("count")
    )


def literal_matches(
    segments: DataFrame, lexicon: Sequence[kw.Keyword], keys: Sequence[str], text: str = "segment",
    lenient: bool = False,
) -> DataFrame:
    """The same rows from unrolled patterns: no shuffle at all."""
    column = F.col(text)
    matches = kw.lenient_matches(column, lexicon) if lenient else kw.strict_matches(column, lexicon)
    return segments.select(*keys, F.explode(matches).alias("m")).select(
        *keys, "m.ord", "m.keyword", "m.weight", F.col("m.count").cast("long").alias("count")
    )


def keyword_totals(hits: DataFrame) -> DataFrame:
    """Corpus-wide hits per keyword."""
    return hits.groupBy("keyword").agg(F.sum("count").alias("hits"), F.count(F.lit(1)).alias("segments"))

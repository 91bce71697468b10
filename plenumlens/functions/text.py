"""Normalising, segmenting and shortening text. Every function stays inside one row."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plenumlens.functions.base import collapse_spaces, let
from plenumlens.functions.html import strip_tags, unescape

SEGMENT_LIMIT = 500
CONJUNCTION = " i "

#: Offsets are summed in blocks of this many segments, so that building the running
#: sum of a long text does not copy the growing array once per segment.
_BLOCK = 64


def normalize_text(text: Column, conjunction: str = CONJUNCTION) -> Column:
    """Decode references, spell out ``&``, collapse whitespace, lower-case."""

    def with_ampersand(t: Column) -> Column:
        spelled = F.replace(unescape(t), F.lit("&"), F.lit(conjunction))
        return F.when(F.contains(t, F.lit("&")), spelled).otherwise(t)

    return F.lower(collapse_spaces(let(F.coalesce(text, F.lit("")), with_ampersand)))


def clean_and_normalize(text: Column, conjunction: str = CONJUNCTION) -> Column:
    """``normalize_text(clean_html(text))`` in one fold.

    References are decoded twice, once by cleaning and once by normalising, which also
    spells out ``&``. A text without ``&`` passes both rounds untouched.
    """

    def decode(t: Column, normalizing: Column) -> Column:
        def spell(plain: Column) -> Column:
            return F.when(normalizing, F.replace(plain, F.lit("&"), F.lit(conjunction))).otherwise(plain)

        decoded = collapse_spaces(let(unescape(t), spell))
        return F.when(F.contains(t, F.lit("&")), decoded).otherwise(t)

    rounds = F.array(F.lit(False), F.lit(True))
    return F.lower(F.aggregate(rounds, collapse_spaces(strip_tags(text)), decode))


def _pack(part: Column, separator: str, limit: int) -> Column:
    """Greedy runs of ``separator``-joined pieces, at most ``limit`` long, as (lead, body).

    The pattern takes the longest run that ends at a separator or at the end; a piece
    longer than the limit stands alone. ``lead`` holds the separators skipped before it.
    """
    sep = separator.replace(" ", r"[ ]")
    tail = rf"(?={sep}|\z)"
    pattern = rf"(?s)(?:{sep})*+(.{{1,{limit}}}{tail}|.+?{tail})"
    whole = F.regexp_extract_all(part, F.lit(pattern), 0)
    bodies = F.regexp_extract_all(part, F.lit(pattern), 1)
    return F.zip_with(
        whole,
        bodies,
        lambda w, b: F.struct(F.left(w, F.length(w) - F.length(b)).alias("lead"), b.alias("body")),
    )


def _split_long(part: Column, limit: int) -> Column:
    """Pack on commas; only the last piece, if still too long, is cut at spaces."""

    def cut_last(pieces: Column) -> Column:
        last = F.element_at(pieces, -1)
        head = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        words = F.transform(
            _pack(last["body"], " ", limit),
            lambda w, i: F.struct(F.concat(F.when(i == 0, last["lead"]).otherwise(F.lit("")), w["lead"]).alias("lead"),
                                  w["body"].alias("body")),
        )
        return F.when(F.length(last["body"]) > limit, F.concat(head, words)).otherwise(pieces)

    return let(_pack(part, ", ", limit), cut_last)


def split_sentences(normalized: Column, limit: int = SEGMENT_LIMIT) -> Column:
    """Segments of normalised text as ``array<struct<lead, body>>``.

    ``lead`` is what separates a segment from the one before it, so that leads and
    bodies together spell the text. A segment may exceed ``limit`` where a single word
    or a comma part that is not the last one does; that is how the rule is defined.
    """

    def segment(part: Column, i: Column) -> Column:
        between = F.when(i == 0, F.lit("")).otherwise(F.lit(" "))
        whole = F.array(F.struct(between.alias("lead"), part.alias("body")))
        packed = F.transform(
            _split_long(part, limit),
            lambda s, j: F.struct(
                F.when(j == 0, F.concat(between, s["lead"])).otherwise(s["lead"]).alias("lead"),
                s["body"].alias("body"),
            ),
        )
        return F.when(F.length(part) <= limit, whole).otherwise(packed)

    parts = F.filter(F.split(normalized, r"[ ](?<=[.!?][ ])", -1), lambda p: p != "")
    return F.flatten(F.transform(parts, segment))


def _running_sum(sizes: Column) -> Column:
    """Inclusive running sum of an int array, block by block."""

    def fold(values: Column, start: Column) -> Column:
        return F.aggregate(
            values,
            F.struct(start.alias("total"), F.array().cast("array<int>").alias("sums")),
            lambda acc, v: F.struct(
                (acc["total"] + v).alias("total"), F.concat(acc["sums"], F.array(acc["total"] + v)).alias("sums")
            ),
            lambda acc: acc["sums"],
        )

    def by_block(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v))
        starts = F.concat(F.array(F.lit(0)), fold(totals, F.lit(0)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), fold))

    def blocks_of(values: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(_BLOCK))
        return F.transform(first, lambda at: F.slice(values, at, F.lit(_BLOCK)))

    return let(sizes, lambda values: let(blocks_of(values), by_block))


def locate_segments(segments: Column) -> Column:
    """Add ``start`` and ``end`` offsets (characters of the normalised text) to segments.

    Offsets are true positions. (A search from the previous end would place a segment
    that is a lone comma inside the separator before it; that is not reproduced.)
    """

    def place(segs: Column) -> Column:
        ends = _running_sum(F.transform(segs, lambda s: F.length(s["lead"]) + F.length(s["body"])))
        return F.zip_with(
            segs,
            ends,
            lambda s, e: F.struct(
                s["lead"].alias("lead"), s["body"].alias("body"),
                (e - F.length(s["body"])).alias("start"), e.alias("end"),
            ),
        )

    return let(segments, place)


def _single_mark_table() -> tuple[str, str]:
    """Characters whose NFKD form without combining marks is one other character, or nothing."""
    singles: list[tuple[str, str]] = []
    dropped: list[str] = []
    for code in [*range(0x80, 0x3100), *range(0xFE20, 0xFE30), *range(0xFF01, 0xFFEF)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base == "":
            dropped.append(char)
        elif len(base) == 1 and base != char:
            singles.append((char, base))
    source = "".join(c for c, _ in singles) + "".join(dropped)
    return source, "".join(b for _, b in singles)


_MARKED, _PLAIN = _single_mark_table()


def strip_marks(text: Column) -> Column:
    """Lower-case and drop diacritics; pure-ASCII rows skip the character table.

    Covers every character whose compatibility form is a single letter. Use
    :func:`strip_marks_exact` for text with ligatures, fractions or Hangul.
    """
    return let(
        F.lower(text),
        lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(F.translate(t, _MARKED, _PLAIN)),
    )


#: With all characters up to the last marked one: str.translate is slow on those that a table lacks.
_PLAIN_OF = {i: i for i in range(0x3100)} | {ord(c): _PLAIN[i] if i < len(_PLAIN) else None for i, c in enumerate(_MARKED)}


def drop_marks(text: str) -> str:
    """What :func:`strip_marks` makes of a lower-case text, within a Python function."""
    return text if text.isascii() else text.translate(_PLAIN_OF)


@F.pandas_udf(StringType())
def strip_marks_exact(text: pd.Series) -> pd.Series:
    """Full NFKD variant over Arrow batches."""

    def strip(value):
        if value is None:
            return None
        decomposed = unicodedata.normalize("NFKD", value.lower())
        return "".join(c for c in decomposed if not unicodedata.combining(c))

    return text.map(strip)


def truncate_at_word(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut back to the last space if there is one."""
    head = F.left(text, F.lit(limit))
    cut = let(head, lambda h: F.when(F.contains(h, F.lit(" ")), F.regexp_extract(h, r"(?s)^(.*)[ ]", 1)).otherwise(h))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def preview(text: Column, limit: int, always: bool = False) -> Column:
    """First ``limit`` characters and dots; short text keeps its form unless ``always``."""
    dotted = F.concat(F.left(text, F.lit(limit)), F.lit("..."))
    return dotted if always else F.when(F.length(text) > limit, dotted).otherwise(text)


def content_key(text: Column) -> Column:
    """SHA-256 of the lower-cased, whitespace-collapsed text."""
    return F.sha2(collapse_spaces(F.lower(text)), 256)

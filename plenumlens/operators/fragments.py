"""Segments, scores and context fragments of statements.

Input: one row per statement with key columns and a text column. Everything up to the
fragment rows is a projection and an explode: no shuffle, so the same code runs on a
stream and its cost grows with the text only. A small lexicon is unrolled into column
expressions; a larger one is counted by an automaton in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumlens.functions import automaton
from plenumlens.functions import keywords as kw
from plenumlens.functions import text as tx
from plenumlens.functions.base import compute_once, let

FRAGMENT_KEYS = ["source_file", "statement_id"]


def segment_statements(
    df: DataFrame, keys: Sequence[str], text: str = "text", limit: int = tx.SEGMENT_LIMIT
) -> DataFrame:
    """Keys plus ``segments array<struct<lead, body, start, end>>`` of the normalised text."""
    normalized = tx.clean_and_normalize(F.col(text))
    return compute_once(df, keys, "segments", tx.locate_segments(tx.split_sentences(normalized, limit)))


def explode_segments(segmented: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per segment: ``segment_idx, segment, start_offset, end_offset``."""
    return segmented.select(*keys, F.posexplode("segments").alias("segment_idx", "s")).select(
        *keys, "segment_idx", F.col("s.body").alias("segment"),
        F.col("s.start").alias("start_offset"), F.col("s.end").alias("end_offset"),
    )


def score_segments(
    segments: DataFrame, lexicon: Sequence[kw.Keyword], suffixes: Sequence[str] = kw.SUFFIXES
) -> DataFrame:
    """Add lenient ``matches`` and their ``score`` to segment rows."""
    count = automaton.text_matches if len(lexicon) > kw.UNROLLED else kw.lenient_matches
    matches = count(F.col("segment"), lexicon, **({"lenient": True} if len(lexicon) > kw.UNROLLED else {}), suffixes=suffixes)
    matched = compute_once(segments, segments.columns, "matches", matches)
    return matched.withColumn("score", kw.weighted_score(F.col("matches")))


def keyword_order(
    segments: Column, lexicon: Sequence[kw.Keyword], suffixes: Sequence[str] = kw.SUFFIXES
) -> Column:
    """Distinct keywords of a statement: best-scored segment first, then lexicon order."""

    def scored(segment: Column, i: Column) -> Column:
        return let(
            kw.lenient_matches(segment["body"], lexicon, suffixes),
            lambda m: F.struct(
                (-kw.weighted_score(m)).alias("descending"), i.alias("idx"),
                F.transform(m, lambda x: x["keyword"]).alias("words"),
            ),
        )

    hit = F.filter(F.transform(segments, scored), lambda s: F.size(s["words"]) > 0)
    return F.array_distinct(F.flatten(F.transform(F.array_sort(hit), lambda s: s["words"])))


def _context(segments: Column, at: Column, width: Column | int) -> Column:
    """Segment ``at`` (1-based) with ``width`` neighbours on each side, as start, end, text."""
    first = F.greatest(F.lit(1), at - F.lit(width))
    last = F.least(F.size(segments), at + F.lit(width))
    opening = F.element_at(segments, first)
    following = F.transform(
        F.slice(segments, first + 1, last - first), lambda s: F.concat(s["lead"], s["body"])
    )
    return F.struct(
        (at - 1).cast("int").alias("segment_idx"),
        opening["start"].alias("start_offset"),
        F.element_at(segments, last)["end"].alias("end_offset"),
        F.trim(F.concat(opening["body"], F.array_join(following, ""))).alias("text"),
    )


def cut_contexts(
    segmented: DataFrame,
    keys: Sequence[str],
    lexicon: Sequence[kw.Keyword],
    context: int = 1,
    cut_at: int | None = None,
    carry: Sequence[str] = (),
    among: str | None = None,
    hit: str | None = None,
    near: str | None = None,
) -> DataFrame:
    """One row per segment with a strict hit: its context window.

    ``cut_at`` shortens the window's text from its end, at a word; it may then lose the hit
    that it was chosen for. The window is built from the neighbouring array elements, so no ordering or window
    shuffle is needed. A statement without any text yields one empty row. ``among``
    names an array column of keywords, one of which must be hit; a strict hit can only
    fall outside the lenient ones next to a combining mark, so only such segments are
    looked at twice. ``hit`` names a column that tells which segments are chosen, where that is
    known already; ``near`` one with the matches of each segment's window, of which a row gets its own.
    """

    def is_hit(body: Column) -> Column:
        strictly = kw.any_strict(body, lexicon)
        if among is None:
            return strictly
        unmarked = (F.octet_length(body) == F.char_length(body)) | ~F.rlike(body, F.lit(r"\p{M}"))
        listed = F.exists(kw.strict_matches(body, lexicon), lambda m: F.array_contains(F.col(among), m["keyword"]))
        return strictly & (unmarked | listed)

    at = F.sequence(F.lit(1), F.size("segments"))
    if hit is None:
        hits = F.filter(at, lambda i: let(F.element_at(F.col("segments"), i)["body"], is_hit))
    else:
        hits = F.filter(at, lambda i: F.element_at(F.col(hit), i))

    def window(i: Column) -> Column:
        context_of = _context(F.col("segments"), i, context)
        return context_of if near is None else context_of.withField(near, F.element_at(F.col(near), i))

    windows = F.transform(hits, window)
    none = [] if near is None else [F.array().cast(automaton.MATCHES).alias(near)]
    empty = F.array(F.struct(F.lit(0).alias("segment_idx"), F.lit(0).alias("start_offset"),
                             F.lit(0).alias("end_offset"), F.lit("").alias("text"), *none))
    rows = F.when(F.size("segments") == 0, empty).otherwise(windows)
    exploded = segmented.select(*keys, *carry, F.explode(rows).alias("f")).select(*keys, *carry, "f.*")
    if cut_at is None:
        return exploded.select(*keys, *carry, "segment_idx", "start_offset", "end_offset", "text", *([near] if near else []))
    short = exploded.withColumn("cut", tx.truncate_at_word(F.col("text"), cut_at))
    return short.select(
        *keys, *carry, "segment_idx", "start_offset",
        F.when(F.length("text") > cut_at, F.col("start_offset") + F.length("cut"))
        .otherwise(F.col("end_offset")).alias("end_offset"),
        F.col("cut").alias("text"),
    )


def extract_fragments(
    df: DataFrame,
    lexicon: Sequence[kw.Keyword],
    keys: Sequence[str] = tuple(FRAGMENT_KEYS),
    text: str = "text",
    context: int = 1,
    limit: int = tx.SEGMENT_LIMIT,
    suffixes: Sequence[str] = kw.SUFFIXES,
    cut_at: int | None = None,
) -> DataFrame:
    """Fragments with ``score`` and ``matched_keywords array<struct<keyword, count, weight>>``.

    Fragments are scored strictly on their own text, over the keywords the statement's
    segments match leniently; matches keep the statement's keyword order. ``limit`` is the
    length of a segment, ``cut_at`` that of a window (by default it stays whole).
    """
    segmented = segment_statements(df, keys, text, limit)
    if len(lexicon) > kw.UNROLLED:  # an expression per keyword would be too many; one pass over each text counts them all
        cut, matches = _counted_windows(segmented, lexicon, keys, context, suffixes, cut_at)
    else:
        words = keyword_order(F.col("segments"), lexicon, suffixes)
        ordered = compute_once(segmented, [*keys, "segments"], "keyword_order", words)
        cut = cut_contexts(ordered, keys, lexicon, context, cut_at, carry=["keyword_order"], among="keyword_order")
        matches = _in_order(kw.strict_matches(F.col("text"), lexicon))
    named = F.transform(matches, lambda m: F.struct(
        m["keyword"].alias("keyword"), m["count"].alias("count"), m["weight"].alias("weight")))
    kept = [c for c in cut.columns if c not in ("keyword_order", "_near", "_anew")]
    matched = compute_once(cut, kept, "matched_keywords", named)
    return matched.withColumn("score", kw.weighted_score(F.col("matched_keywords")))


def _in_order(matches: Column) -> Column:
    """The matches of ``keyword_order``, in its order."""

    def place(m: Column) -> Column:
        return F.struct(
            F.array_position(F.col("keyword_order"), m["keyword"]).alias("place"),
            m["keyword"].alias("keyword"), m["count"].alias("count"), m["weight"].alias("weight"),
        )

    return F.array_sort(F.filter(F.transform(matches, place), lambda m: m["place"] > 0))


def _counted_windows(
    segmented: DataFrame, lexicon: Sequence[kw.Keyword], keys: Sequence[str], context: int, suffixes: Sequence[str],
    cut_at: int | None,
) -> tuple[DataFrame, Column]:
    """The windows and their matches by a large lexicon.

    A window's matches are the sums over its segments. Only those of entries that may reach over
    a segment's end, and all in a shortened window, are counted in its text.
    """
    counted = automaton.window_matches(F.col("segments.body"), lexicon, context, suffixes)
    known = compute_once(segmented, [*keys, "segments"], "_m", counted).select(
        *keys, "segments", F.col("_m.keywords").alias("keyword_order"), F.col("_m.hit").alias("_hit"), F.col("_m.near").alias("_near"))
    anew = automaton.across_segments(lexicon) if cut_at is None else lexicon
    if not anew:
        return cut_contexts(known, keys, lexicon, context, hit="_hit", near="_near"), F.col("_near")
    near = "_near" if cut_at is None else None
    cut = cut_contexts(known, keys, lexicon, context, cut_at, carry=["keyword_order"], hit="_hit", near=near)
    cut = compute_once(cut, cut.columns, "_anew", automaton.text_matches(F.col("text"), anew))
    return cut, _in_order(F.concat("_near", "_anew") if near else F.col("_anew"))


def score_audit(fragments: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Recompute each fragment's score twice and flag differences.

    ``score_from_counts`` uses the stored counts; ``score_from_text`` counts each stored
    keyword in the text again, here by cutting the text at the keyword instead of by the
    pattern that produced the counts.
    """
    word = kw.WORD

    def mark_words(text: Column) -> Column:
        # words between marker characters: a hit is then a plain substring
        return F.regexp_replace(F.lower(text), f"({word}+)", "\u0002$1\u0003")

    def recount(marked: Column, m: Column) -> Column:
        needle = mark_words(m["keyword"])
        pieces = F.replace(marked, needle, F.lit(""))
        return (F.char_length(marked) - F.char_length(pieces)) / F.char_length(needle)

    from_text = let(
        mark_words(F.col("text")),
        lambda marked: F.aggregate(
            "matched_keywords", F.lit(0.0), lambda total, m: total + recount(marked, m) * m["weight"]
        ),
    )
    counted = fragments.withColumn("score_from_counts", kw.weighted_score(F.col("matched_keywords")))
    audited = compute_once(counted, counted.columns, "score_from_text", from_text)
    off = (F.abs(F.col("score") - F.col("score_from_counts")) > tolerance) | (
        F.abs(F.col("score") - F.col("score_from_text")) > tolerance
    )
    return audited.withColumn("mismatch", off)

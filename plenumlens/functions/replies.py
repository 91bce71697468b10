"""Prompts for, and replies of, a text or JSON answering evaluator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenumlens.functions.base import let, strip

# Markers that open each part of a text reply; the first family that fits a line wins.
VERDICT_MARKERS = ["ŚMIESZNE:", "SMIESZ", "FUNNY:"]
CONFIDENCE_MARKERS = ["PEWNOŚĆ:", "PEWNOSC:", "CONFIDENCE:"]
CATEGORY_MARKERS = ["KATEGORIA:", "CATEGORY:"]
REASON_MARKERS = ["POWÓD:", "POWOD:", "REASON:"]
AFFIRMATIVE = ["TAK", "YES", "PRAWDA", "TRUE"]

# Category names and the substrings that select them, in order.
CATEGORIES = [
    ("absurd", ["absurd"]),
    ("żart", ["żart", "zart", "joke"]),
    ("ironia", ["ironi"]),
    ("gafa", ["gaf"]),
    ("przesada", ["przesad", "exagger"]),
]
NO_CATEGORY = "brak"

# Reasons given when the reply has none.
REASON_MISSING = "Brak odpowiedzi"
REASON_POSITIVE = "Model rozpoznał element "
REASON_NEGATIVE = "Brak wyraźnych elementów humorystycznych"

DEFAULT_TEMPLATE = (
    "Is the following passage of a parliamentary speech funny?\n\nPASSAGE:\n{text}\n{context}\n"
    "Answer in this form:\nFUNNY: YES or NO\nCONFIDENCE: 0-100%\nCATEGORY: absurd, joke, irony, gaffe, "
    "exaggeration or none\nREASON: one sentence\n"
)

JSON_REPLY = "is_funny boolean, confidence string, reason string"


def _has_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def category_of(text: Column) -> Column:
    """Category named in a reply, by the first substring that fits."""
    lowered = F.lower(text)
    chosen = None
    for name, words in CATEGORIES:
        test = _has_any(lowered, words)
        chosen = F.when(test, F.lit(name)) if chosen is None else chosen.when(test, F.lit(name))
    return chosen.otherwise(F.lit(NO_CATEGORY))


def parse_text_reply(reply: Column) -> Column:
    """``struct<is_funny, confidence, reason, category>`` from a line-by-line reply.

    Each line belongs to the first marker family it contains; of several lines of one
    family the last one counts.
    """
    families = [VERDICT_MARKERS, CONFIDENCE_MARKERS, CATEGORY_MARKERS, REASON_MARKERS]

    def tag(line: Column) -> Column:
        upper = F.upper(line)
        family = None
        for i, markers in enumerate(families):
            test = _has_any(upper, markers)
            family = F.when(test, F.lit(i)) if family is None else family.when(test, F.lit(i))
        return F.struct(family.alias("family"), line.alias("line"))

    def after_colon(line: Column) -> Column:
        return strip(F.regexp_extract(line, r"(?s):(.*)\z", 1))

    def build(tagged: Column) -> Column:
        def last(family: int, only=None) -> Column:
            chosen = F.filter(tagged, lambda t: (t["family"] == family) & (only(t["line"]) if only else F.lit(True)))
            return F.try_element_at(chosen, F.lit(-1))["line"]

        number = last(1, lambda line: F.rlike(line, F.lit(r"\d")))
        digits = F.regexp_extract(number, r"(\d+)", 1).cast("double")
        funny = F.coalesce(_has_any(F.upper(last(0)), AFFIRMATIVE), F.lit(False))
        stated = F.when(digits > 100.0, F.lit(1.0)).otherwise(F.coalesce(digits / 100.0, F.lit(0.0)))
        category = F.coalesce(category_of(after_colon(last(2))), F.lit(NO_CATEGORY))
        reason = F.coalesce(after_colon(last(3)), F.lit(REASON_MISSING))
        return let(
            F.struct(funny.alias("f"), stated.alias("c"), category.alias("k"), reason.alias("r")),
            lambda v: F.struct(
                v["f"].alias("is_funny"),
                F.when(v["f"] & (v["c"] == 0.0), F.lit(0.5)).otherwise(v["c"]).alias("confidence"),
                F.when(~v["r"].isin("", REASON_MISSING), v["r"])
                .when(v["f"], F.concat(F.lit(REASON_POSITIVE), v["k"]))
                .otherwise(F.lit(REASON_NEGATIVE)).alias("reason"),
                v["k"].alias("category"),
            ),
        )

    trimmed = strip(F.coalesce(reply, F.lit("")))
    lines = F.transform(F.split(trimmed, "\n"), strip)
    nothing = F.struct(
        F.lit(False).alias("is_funny"), F.lit(0.0).alias("confidence"),
        F.lit(REASON_MISSING).alias("reason"), F.lit(NO_CATEGORY).alias("category"),
    )
    return F.when(F.length(trimmed) < 10, nothing).otherwise(let(F.transform(lines, tag), build))


def parse_json_reply(reply: Column) -> Column:
    """``struct<ok, is_funny, confidence, reason>`` from the outermost braces of a reply."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    number = lambda p: F.coalesce(p["confidence"], F.lit("0")).try_cast("double")

    def read(p: Column) -> Column:
        ok = p.isNotNull() & number(p).isNotNull()
        return F.struct(
            ok.alias("ok"),
            F.coalesce(ok & p["is_funny"], F.lit(False)).alias("is_funny"),
            F.when(ok, number(p)).otherwise(F.lit(0.0)).alias("confidence"),
            F.when(ok, F.coalesce(p["reason"], F.lit(""))).otherwise(F.lit("")).alias("reason"),
        )

    return let(F.from_json(F.nullif(body, F.lit("")), JSON_REPLY), read)


def build_prompt(
    text: Column, name: Column | None = None, club: Column | None = None, keywords: Column | None = None,
    template: str = DEFAULT_TEMPLATE, limit: int | None = None,
) -> Column:
    """Fill ``template`` with the text (on demand only its first ``limit`` characters) and the context that is known."""
    known = []
    for label, value in (("Speaker", name), ("Club", club)):
        if value is not None:
            known.append(F.concat(F.lit(f"{label}: "), F.nullif(value, F.lit(""))))
    if keywords is not None:
        words = F.array_join(F.transform(keywords, lambda m: m["keyword"]), ", ")
        known.append(F.concat(F.lit("Keywords: "), F.nullif(words, F.lit(""))))
    context = F.array_join(F.array_compact(F.array(*known)), "\n") if known else F.lit("")
    before, rest = template.split("{text}")
    between, after = rest.split("{context}") if "{context}" in rest else (rest, "")
    return F.concat(F.lit(before), text if limit is None else F.left(text, F.lit(limit)), F.lit(between), context, F.lit(after))

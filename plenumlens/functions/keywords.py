"""Weighted keyword lexicon: patterns and in-row matching."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenumlens.functions.base import let
from plenumlens.functions.text import strip_marks

# Inflection endings the lenient pattern allows after a keyword.
SUFFIXES = ["u", "owi", "em", "e", "ie", "a", "y", "ów", "om", "ami", "ach", "i", "ę"]

# The default lexicon, keyword and weight.
DEFAULT_LEXICON = [
    ("kryzys", 2.0), ("śmieszny", 1.5), ("śmieszna", 1.5), ("śmieszni", 1.5), ("śmiesznym", 1.5),
    ("żart", 2.0), ("żartem", 2.0), ("żartobliwy", 1.5), ("humor", 1.0), ("humorem", 1.0),
    ("skandal", 2.5), ("hańba", 2.5), ("wstyd", 2.0), ("buu", 2.0), ("śmiech", 1.5),
    ("śmiechy", 1.5), ("śmiej", 1.5), ("wesołość", 1.5), ("entuzjazm", 1.5), ("oklaski", 2.0),
    ("brawa", 2.0), ("aplauz", 2.0), ("brawo", 2.0), ("gwar", 1.5), ("poruszenie", 1.5),
    ("krzyk", 1.5), ("krzyki", 1.5), ("okrzyki", 1.5), ("cisza", 1.0), ("sprzeciw", 2.0),
    ("sprostowanie", 2.0), ("wniosek formalny", 2.0), ("przerwa w posiedzeniu", 2.0),
    ("przerwa w obradach", 2.0), ("zamykam dyskusję", 1.5), ("wznowienie posiedzenia", 1.5),
    ("kłamstwo", 2.5), ("oszustwo", 2.5), ("groźba", 2.0), ("propozycja czy groźba", 2.0),
    ("sprzedajecie Polskę", 3.0), ("oddają Polskę", 3.0), ("cenzura", 2.0), ("ucieczka marszałka", 2.0),
    ("goebbelsowskie", 3.0), ("narzędzia", 1.0), ("hitlerowcami", 3.0), ("komunistycznych", 2.0),
    ("amen", 1.0), ("wieczny odpoczynek", 1.5), ("światłość wiekuista", 1.5), ("szczęść Boże", 1.0),
    ("ha, ha, ha", 1.5), ("uuu", 1.5), ("uuuu", 1.5), ("brawo wspaniale", 2.0), ("będzie dobrze", 1.5),
    ("daj chusteczkę", 1.5), ("nie działa karta", 1.0), ("słabą kartę daliście", 1.0),
    ("karta nieaktywna", 1.0), ("głos z sali", 2.5),
]

#: Larger lexicons are counted by an automaton instead of an expression per keyword.
UNROLLED = 300

WORD = r"[\p{L}\p{N}_]"


@dataclass(frozen=True)
class Keyword:
    """One lexicon entry; ``ord`` keeps the lexicon's order."""

    ord: int
    keyword: str
    weight: float = 1.0


def make_lexicon(entries: Sequence[tuple[str, float]]) -> list[Keyword]:
    """Entries with blank keywords left out and surrounding space removed."""
    kept = [(k.strip(), float(w)) for k, w in entries if k and k.strip()]
    return [Keyword(i, k, w) for i, (k, w) in enumerate(kept)]


def first_weights(lexicon: Sequence[Keyword]) -> list[Keyword]:
    """One entry per keyword; a repeated keyword keeps its first weight."""
    seen: dict[str, Keyword] = {}
    for entry in lexicon:
        seen.setdefault(entry.keyword, entry)
    return list(seen.values())


def plain_form(keyword: str) -> str:
    """Lower-cased keyword without diacritics."""
    decomposed = unicodedata.normalize("NFKD", keyword.lower())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def _bounded(form: str, ending: str | None = None) -> str:
    """``form`` between word boundaries, as literal text first and then the look-arounds.

    A boundary asks that the far side be the other kind of character. Leading with the
    literal lets the matcher skip ahead to candidates before testing a character class.
    """
    quoted = "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in form)
    before = "<!" if form[0].isalnum() or form[0] == "_" else "<="
    after = f"(?!{WORD})" if form[-1].isalnum() or form[-1] == "_" else f"(?={WORD})"
    if ending:
        after = f"(?:(?:{ending})(?!{WORD})|{after})"
    return f"{quoted}(?{before}{WORD}{quoted}){after}"


def strict_pattern(keyword: str) -> str:
    """The lower-cased keyword between word boundaries."""
    return _bounded(keyword.lower())


def lenient_pattern(keyword: str, suffixes: Sequence[str] = SUFFIXES) -> str:
    """The plain keyword, an optional ending, word boundaries; for mark-free text."""
    return _bounded(plain_form(keyword), "|".join(suffixes))


def _hits(text: Column, lexicon: Sequence[Keyword], literals: list[str], patterns: list[str]) -> Column:
    """Counted hits as ``array<struct<ord, keyword, count, weight>>``, in lexicon order.

    The plain substring test before a pattern spares most texts the regular expression. In
    a small lexicon each pattern is an expression of its own, so a task compiles it once; a
    large one is a literal table, and only patterns whose substring occurs are compiled.
    """
    none = F.array().cast("array<struct<ord:int,keyword:string,count:int,weight:double>>")
    if not lexicon:
        return none
    entries = F.from_json(
        F.lit(json.dumps([asdict(k) for k in lexicon])), "array<struct<ord:int,keyword:string,weight:double>>"
    )
    if len(lexicon) > UNROLLED:
        known = F.filter(_table(lexicon, literals, patterns), lambda k: F.contains(text, k["literal"]))
        found = F.transform(known, lambda k: F.struct(
            k["ord"].alias("ord"), k["keyword"].alias("keyword"),
            F.size(F.regexp_extract_all(text, k["pattern"], F.lit(0))).alias("count"), k["weight"].alias("weight")))
        return F.filter(found, lambda m: m["count"] > 0)
    counts = F.array(*[
        F.when(text.contains(plain), F.regexp_count(text, F.lit(pattern))).otherwise(0)
        for plain, pattern in zip(literals, patterns)
    ])
    counted = F.zip_with(
        entries, counts, lambda k, n: F.struct(k["ord"], k["keyword"], n.alias("count"), k["weight"])
    )
    return F.when(_contains_any(text, literals), F.filter(counted, lambda m: m["count"] > 0)).otherwise(none)


def _table(lexicon: Sequence[Keyword], literals: Sequence[str], patterns: Sequence[str]) -> Column:
    """The lexicon with substrings and patterns as one literal array."""
    rows = [{**asdict(k), "literal": plain, "pattern": p} for k, plain, p in zip(lexicon, literals, patterns)]
    kind = "array<struct<ord:int,keyword:string,weight:double,literal:string,pattern:string>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _contains_any(text: Column, literals: Sequence[str]) -> Column:
    """Cheap test that lets a text without any keyword skip the counting."""
    return _any([text.contains(literal) for literal in dict.fromkeys(literals)])


def _any(tests: list[Column]) -> Column:
    """Whether one of the tests holds, as a shallow tree: a chain of hundreds would exhaust the planner's stack."""
    if len(tests) <= 2:
        return reduce(or_, tests)
    half = len(tests) // 2
    return _any(tests[:half]) | _any(tests[half:])


def strict_matches(text: Column, lexicon: Sequence[Keyword]) -> Column:
    """Strict hits in normalised text."""
    entries = first_weights(lexicon)
    return _hits(text, entries, [k.keyword.lower() for k in entries], [strict_pattern(k.keyword) for k in entries])


def lenient_matches(text: Column, lexicon: Sequence[Keyword], suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Lenient hits; marks are stripped here."""
    return let(
        strip_marks(text),
        lambda t: _hits(
            t, lexicon, [plain_form(k.keyword) for k in lexicon],
            [lenient_pattern(k.keyword, suffixes) for k in lexicon],
        ),
    )


def any_strict(text: Column, lexicon: Sequence[Keyword]) -> Column:
    """Whether any keyword has a strict hit; a pattern runs only where its text occurs."""
    if not lexicon:
        return F.lit(False)
    entries = first_weights(lexicon)
    if len(entries) > UNROLLED:
        rows = _table(entries, [k.keyword.lower() for k in entries], [strict_pattern(k.keyword) for k in entries])
        return F.exists(rows, lambda k: F.contains(text, k["literal"]) & F.rlike(text, k["pattern"]))
    return _any([text.contains(k.keyword.lower()) & text.rlike(strict_pattern(k.keyword)) for k in entries])


def weighted_score(matches: Column) -> Column:
    """Sum of count times weight."""
    return F.aggregate(matches, F.lit(0.0), lambda total, m: total + m["count"] * m["weight"])

"""HTML to text: tag removal in three profiles, exact character references."""

from __future__ import annotations

import json
from html import unescape as unescape_html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenumlens.functions.base import collapse_spaces, let, strip

# The character references each light profile decodes, in decoding order.
ENTITIES_B = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
]
ENTITIES_C = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]

# Text that marks a page as an error page, and tags that mark it as HTML.
ERROR_MARKERS = [
    "error", "błąd", "not found", "nie znaleziono",
    "access denied", "dostęp zabroniony", "supportid",
]
HTML_TAGS = ["<html", "<body", "<p", "<div"]

_CHARREF = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_LEGACY = {name: char for name, char in html5.items() if not name.endswith(";")}
_LOW = {str(code): unescape_html(f"&#{code};") for code in range(0xA0)}
_LEGACY_LENGTHS = sorted({len(name) for name in _LEGACY}, reverse=True)


def _code_point(num: Column) -> Column:
    """Unicode character for a code point column (UTF-32 bytes decoded by the JVM)."""
    return F.decode(F.unhex(F.lpad(F.hex(num), 8, "0")), "UTF-32")


def _numeric_reference(ref: Column, low: Column) -> Column:
    """Decode a code point; ``low`` holds the ones below 0xA0, many of which are remapped."""
    hexadecimal = F.startswith(F.lower(ref), F.lit("#x"))
    digits = F.regexp_replace(ref, "^#[xX]?0*|;$", "")
    # more digits than any code point has: out of range whatever they are
    num = (
        F.when(F.length(digits) > 9, F.lit(0x110000))
        .when(digits == "", F.lit(0))
        .when(hexadecimal, F.conv(digits, 16, 10).cast("long"))
        .otherwise(digits.try_cast("long"))
    )

    def decode(n: Column) -> Column:
        no_character = (F.pmod(n, F.lit(0x10000)) >= 0xFFFE) | n.between(0xFDD0, 0xFDEF)
        return (
            F.when(n < 0xA0, F.try_element_at(low, n.cast("string")))
            .when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
            .when(no_character, F.lit(""))
            .otherwise(_code_point(n))
        )

    return let(num, decode)


def _named_reference(ref: Column, names: Column, legacy: Column) -> Column:
    """Decode a name; one without ``;`` may also be the longest legacy name it starts with."""
    prefixes = [
        F.when(
            F.length(ref) > n,
            F.concat(F.try_element_at(legacy, F.left(ref, F.lit(n))), F.substr(ref, F.lit(n + 1))),
        )
        for n in _LEGACY_LENGTHS
    ]
    return (
        F.when(ref == "amp;", F.lit("&")).when(ref == "nbsp;", F.lit("\u00a0"))
        .when(ref == "lt;", F.lit("<")).when(ref == "gt;", F.lit(">")).when(ref == "quot;", F.lit('"'))
        .otherwise(F.coalesce(F.try_element_at(names, ref), *prefixes, F.concat(F.lit("&"), ref)))
    )


def _table(entries: dict[str, str]) -> Column:
    """A constant map column; Catalyst folds it into one literal."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def unescape(text: Column) -> Column:
    """Decode every HTML5 character reference once, in the JVM.

    The text is cut at its references, each reference is decoded and the pieces are
    joined again. Rows without ``&`` skip all of it.
    """

    def decode_all(t: Column) -> Column:
        refs = F.regexp_extract_all(t, F.lit(_CHARREF), 1)
        gaps = F.split(t, _CHARREF, -1)
        tables = F.struct(
            _table(html5).alias("names"), _table(_LEGACY).alias("legacy"), _table(_LOW).alias("low")
        )
        decoded = let(
            tables,
            lambda known: F.transform(
                refs,
                lambda r: F.when(F.startswith(r, F.lit("#")), _numeric_reference(r, known["low"])).otherwise(
                    _named_reference(r, known["names"], known["legacy"])
                ),
            ),
        )
        joined = F.zip_with(gaps, decoded, lambda g, d: F.concat(g, F.coalesce(d, F.lit(""))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(joined, "")).otherwise(t)

    return let(text, decode_all)


def _drop(text: Column, pattern: str, by: str, only_if: str = "<") -> Column:
    """Replace ``pattern``; rows without ``only_if`` are passed through untouched."""
    return let(
        text,
        lambda t: F.when(F.contains(t, F.lit(only_if)), F.regexp_replace(t, pattern, by)).otherwise(t),
    )


def strip_tags(html: Column) -> Column:
    """Scripts, styles and all other tags become a space; references stay."""
    text = F.coalesce(html, F.lit(""))
    text = _drop(text, r"(?is)<script[^>]*>.*?</script>", " ")
    text = _drop(text, r"(?is)<style[^>]*>.*?</style>", " ")
    return _drop(text, r"<[^>]+>", " ")


def clean_html(html: Column) -> Column:
    """Detector profile: no scripts, styles or tags, all references decoded after that."""
    return collapse_spaces(unescape(strip_tags(html)))


def _decode_fixed(text: Column, entities: list[tuple[str, str]]) -> Column:
    for entity, char in entities:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_to_text_b(html: Column) -> Column:
    """Client profile: comments go too, scripts and styles leave no space, seven references."""
    text = F.coalesce(html, F.lit(""))
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>"):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return collapse_spaces(_decode_fixed(text, ENTITIES_B))


def html_to_text_c(html: Column) -> Column:
    """Storage profile: scripts and styles become a space, four references."""
    text = F.coalesce(html, F.lit(""))
    text = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return collapse_spaces(_decode_fixed(text, ENTITIES_C))


def html_to_text(html: Column, profile: str) -> Column:
    """One entry point for the three profiles ``a``, ``b`` and ``c``."""
    return {"a": clean_html, "b": html_to_text_b, "c": html_to_text_c}[profile](html)


def is_valid_html(html: Column, markers: list[str] = ERROR_MARKERS, min_length: int = 50) -> Column:
    """Long enough, no error marker, and either a known tag or more than 200 characters."""
    lowered = F.lower(F.coalesce(html, F.lit("")))
    size = F.length(strip(F.coalesce(html, F.lit(""))))

    def any_of(words: list[str]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lowered, F.lit(word))
        return hit

    return (size >= min_length) & ~any_of(markers) & (any_of(HTML_TAGS) | (size > 200))

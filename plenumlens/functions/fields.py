"""Small column rules: names, durations, bands, media types, lifetimes, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenumlens.functions.base import let, strip

# Success bands, best first (lower bound in percent, name).
SUCCESS_BANDS = [(70.0, "excellent"), (50.0, "good"), (30.0, "medium")]
WEAKEST_BAND = "weak"

# How long a response to an endpoint stays fresh, in seconds; first rule that fits.
HOUR = 3600
TTL_RULES = [
    ("contains", "/MP", 12 * HOUR),
    ("contains", "/clubs", 12 * HOUR),
    ("endswith", "/term", 24 * HOUR),
    ("contains", "/transcripts/", 24 * HOUR),
    ("contains", "/transcripts", 6 * HOUR),
    ("contains", "/proceedings", HOUR),
]
TTL_DEFAULT = HOUR // 2

# Leading bytes of the picture formats told apart.
PNG_MAGIC = bytes.fromhex("89504e47")
JPEG_MAGIC = bytes.fromhex("ffd8")
GIF_MAGIC = b"GIF"


def full_name(first: Column, last: Column) -> Column:
    """``first last`` without stray spaces; missing parts are empty."""
    empty = F.lit("")
    return strip(F.concat(strip(F.coalesce(first, empty)), F.lit(" "), strip(F.coalesce(last, empty))))


def reversed_name(first: Column, last: Column) -> Column:
    """``last first`` as written in name lists."""
    empty = F.lit("")
    return F.concat(strip(F.coalesce(last, empty)), F.lit(" "), strip(F.coalesce(first, empty)))


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end; missing, unreadable or negative gives null."""
    micros = F.unix_micros(F.try_to_timestamp(end)) - F.unix_micros(F.try_to_timestamp(start))
    return F.when(micros >= 0, F.floor(micros / F.lit(1_000_000)).cast("long"))


def safe_file_stem(name: Column) -> Column:
    """Runs of characters outside ``A-Za-z0-9._-`` become ``_``; none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def safe_member_name(name: Column, limit: int = 50) -> Column:
    """Each character outside ``A-Za-z0-9_-`` becomes ``_``; at most ``limit`` characters."""
    return F.left(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), F.lit(limit))


def ttl_seconds(endpoint: Column) -> Column:
    """Freshness lifetime of an endpoint's response."""
    rule = None
    for kind, text, seconds in TTL_RULES:
        test = F.contains(endpoint, F.lit(text)) if kind == "contains" else F.endswith(endpoint, F.lit(text))
        rule = F.when(test, F.lit(seconds)) if rule is None else rule.when(test, F.lit(seconds))
    return rule.otherwise(F.lit(TTL_DEFAULT))


def success_band(percent: Column, attempts: Column) -> Column:
    """Band of a success percentage; null without attempts."""
    band = F.when(attempts <= 0, F.lit(None).cast("string"))
    for bound, name in SUCCESS_BANDS:
        band = band.when(percent >= bound, F.lit(name))
    return F.when(attempts > 0, band.otherwise(F.lit(WEAKEST_BAND)))


def media_type(content: Column, logo: bool = False) -> Column:
    """File kind from its first bytes; unknown photos count as jpg, unknown logos as png."""
    kind = F.when(F.startswith(content, F.lit(PNG_MAGIC)), F.lit("png"))
    kind = kind.when(F.startswith(content, F.lit(JPEG_MAGIC)), F.lit("jpg"))
    if logo:
        kind = kind.when(F.startswith(content, F.lit(GIF_MAGIC)), F.lit("gif"))
    return kind.otherwise(F.lit("png" if logo else "jpg"))


def validation_errors(term: Column, proceeding: Column, date: Column) -> Column:
    """Names of the keys that are out of range or not a real calendar date."""
    shaped = F.coalesce(F.rlike(date, F.lit(r"^\d{4}-\d{2}-\d{2}\z")), F.lit(False))
    real = F.try_to_date(date, "yyyy-MM-dd").isNotNull()
    return F.array_compact(F.array(
        F.when(~F.coalesce(term.between(1, 20), F.lit(False)), F.lit("term")),
        F.when(~F.coalesce(proceeding.between(1, 200), F.lit(False)), F.lit("proceeding")),
        F.when(~shaped, F.lit("date_format")),
        F.when(shaped & ~real, F.lit("date_value")),
    ))


def first_present(*texts: Column) -> Column:
    """First text that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def is_error_object(payload: Column, key: str = "supportID") -> Column:
    """A JSON object whose only key is ``key`` is an error notice, not data."""
    return F.coalesce(let(payload, lambda p: F.json_object_keys(p) == F.array(F.lit(key))), F.lit(False))

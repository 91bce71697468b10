"""From listing rows to canonical statements: projections, gates and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumlens.functions import fields
from plenumlens.functions import html as hx
from plenumlens.functions.base import compute_once, strip

UNKNOWN_SPEAKER = "Nieznany"

# Least lengths of a page, of its text, of a saved text and of an evaluated text.
MIN_HTML = 50
MIN_TEXT = 20
MIN_SAVED = 10
MIN_EVALUATED = 20


def to_processed(listing: DataFrame, api_prefix: str = "") -> DataFrame:
    """Listing rows to ``num, speaker, timing, content, technical``; missing names get defaults."""
    empty = F.lit("")
    speaker = F.struct(
        F.coalesce("name", F.lit(UNKNOWN_SPEAKER)).alias("name"),
        F.coalesce("function", empty).alias("function"),
        F.coalesce("club", empty).alias("club"),
        F.coalesce("firstName", empty).alias("first_name"),
        F.coalesce("lastName", empty).alias("last_name"),
    )
    start, end = F.col("startDateTime").cast("string"), F.col("endDateTime").cast("string")
    timing = F.struct(
        F.coalesce(start, empty).alias("start_datetime"),
        F.coalesce(end, empty).alias("end_datetime"),
        fields.duration_seconds(start, end).alias("duration_seconds"),
    )
    keys = ["term", "proceeding_id", "date"]
    path = F.concat(
        F.lit(f"{api_prefix}/term"), F.col("term"), F.lit("/proceedings/"), F.col("proceeding_id"), F.lit("/"),
        F.col("date").cast("string"), F.lit("/transcripts/"), F.col("num"),
    )
    original = F.to_json(F.struct(*[c for c in listing.columns if c not in keys]))
    return listing.select(
        *keys, "num", speaker.alias("speaker"), timing.alias("timing"),
        F.struct(path.alias("api_url"), original.alias("original_data")).alias("technical"),
    )


def content_text(content: Column) -> Column:
    """First non-empty of the known text fields, else the text of the page."""
    return strip(fields.first_present(
        content["text"], content["text_content"], content["plain"], hx.html_to_text_c(content["html_content"])
    ))


def to_canonical(processed: DataFrame, min_length: int = MIN_SAVED) -> DataFrame:
    """Processed rows with content to canonical rows; short texts are left out.

    Expects ``speaker struct<name, id, is_mp, club, group>``; an empty club falls back to
    the group. Times are read from ``timing``.
    """
    speaker = F.struct(
        F.col("speaker.name").alias("name"),
        F.col("speaker.id").alias("id"),
        F.col("speaker.is_mp").alias("is_mp"),
        F.coalesce(F.nullif("speaker.club", F.lit("")), F.col("speaker.group")).alias("club"),
    )
    rows = compute_once(processed, processed.columns, "_text", content_text(F.col("content")))
    return rows.where(F.length("_text") >= min_length).select(
        "term", "proceeding_id", "date", "num", speaker.alias("speaker"), F.col("_text").alias("text"),
        F.col("timing.start_datetime").alias("start_time"), F.col("timing.end_datetime").alias("end_time"),
        F.col("timing.duration_seconds").alias("duration_seconds"),
    )


def with_content_gates(pages: DataFrame, html: str = "html", profile: str = "b") -> DataFrame:
    """Add ``text``, ``is_valid`` and ``has_content`` (long enough as page and as text)."""
    cleaned = compute_once(pages, pages.columns, "text", hx.html_to_text(F.col(html), profile))
    long_enough = (F.length(strip(F.col(html))) >= MIN_HTML) & (F.length("text") > MIN_TEXT)
    return cleaned.withColumn("is_valid", hx.is_valid_html(F.col(html))).withColumn(
        "has_content", F.coalesce(long_enough, F.lit(False))
    )


def clean_pages(pages: DataFrame, keys: list[str], html: str = "html", profile: str = "b") -> DataFrame:
    """Pages that pass every gate, as keys, text and its length."""
    gated = with_content_gates(pages.select(*keys, html), html, profile)
    return gated.where("is_valid and has_content").select(*keys, "text", F.length("text").alias("content_length"))


def past_dates(dates: Column, ref: Column) -> Column:
    """Dates up to ``ref``; unreadable ones stay."""
    return F.filter(dates, lambda d: F.coalesce(F.try_to_date(d) <= ref, F.lit(True)))


def all_future(dates: Column, ref: Column) -> Column:
    """Whether there are dates and every one lies after ``ref``; unreadable ones do not."""
    return (F.size(dates) > 0) & F.forall(dates, lambda d: F.coalesce(F.try_to_date(d) > ref, F.lit(False)))


def is_current(dates: Column, current: Column, ref: Column, max_age_days: int = 7) -> Column:
    """Flagged current, or any date from ``max_age_days`` ago to one day ahead; never without dates."""

    def near(d: Column) -> Column:
        return F.coalesce(F.datediff(ref, F.try_to_date(d)).between(-1, max_age_days), F.lit(False))

    flagged = F.coalesce(current, F.lit(False))
    return F.coalesce(F.size(dates) > 0, F.lit(False)) & (flagged | F.exists(dates, near))


def with_id_and_dates(proceedings: DataFrame) -> DataFrame:
    """Proceedings that can be read: a positive number and at least one date."""
    return proceedings.where((F.size("dates") > 0) & (F.col("number") > 0))


def prefer_detail(listing: DataFrame, detail: DataFrame, key: list[str], fields_: list[str]) -> DataFrame:
    """Each listing row with every field taken from its detail row where that has one."""
    d = detail.select(*key, *[F.col(f).alias(f"_d_{f}") for f in fields_], F.lit(True).alias("from_detail"))
    joined = listing.join(d, key, "left")
    return joined.select(
        *key, *[F.coalesce(f"_d_{f}", f).alias(f) for f in fields_],
        F.coalesce("from_detail", F.lit(False)).alias("from_detail"),
    )


def select_proceeding(listing: DataFrame, detail: DataFrame, term: int, number: int, fields_: list[str]) -> DataFrame:
    """One proceeding: its detail row, else its listing row; no row if unknown.

    Both sides are filtered before anything is joined.
    """
    wanted = (F.col("term") == term) & (F.col("number") == number)
    found = detail.where(wanted).select("term", "number", *fields_).withColumn("from_detail", F.lit(True))
    listed = listing.where(wanted).select("term", "number", *fields_).withColumn("from_detail", F.lit(False))
    either = found.unionByName(listed).groupBy("term", "number")
    row = F.max_by(F.struct(*fields_, "from_detail"), F.col("from_detail").cast("int"))
    return either.agg(row.alias("r")).select("term", "number", "r.*")

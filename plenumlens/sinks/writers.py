"""Exports: transcript days, results, member and statement tables, reports and digests.

Nothing is gathered into one value: nested documents are streamed from sorted rows, and a day,
club or source that holds a third of all rows is written by several tasks, as ordered parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenumlens.functions.text import preview
from plenumlens.operators.statements import MIN_SAVED
from plenumlens.sinks.documents import ROWS_PER_PART, level, write_documents

# The columns of the member table export.
MEMBER_COLUMNS = [
    "id", "firstName", "lastName", "club", "voivodeship", "districtName", "districtNum", "numberOfVotes", "email",
]

REPORT_TITLE = "Best fragments"
REPORT_ROWS = 10
REPORT_TEXT = 150


def write_transcripts(
    canonical: DataFrame, path: str, keys: Sequence[str] = ("term", "proceeding_id", "date"),
    order: str = "num", text: str = "text", file_format: str = "json", rows_per_file: int = 100_000,
) -> None:
    """One folder per (term, proceeding, date), rows in ``num`` order, replaced as a whole.

    The range partitioning includes ``num``, so a large day becomes several files whose
    names sort in row order. Days without a long enough text get no folder, and with the
    dynamic overwrite other days are left as they are. The range bounds are sampled, which
    reads ``canonical`` once more: pass a written table if it is dear to compute.
    """
    rows = canonical.where(F.length(text) >= MIN_SAVED)
    ranged = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    (
        ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).format(file_format).save(path)
    )


def _in_name(value: Column) -> Column:
    """A value as part of a file name; null is ``unknown``."""
    return F.coalesce(F.regexp_replace(value.cast("string"), "[^A-Za-z0-9._-]+", "_"), F.lit("unknown"))


def write_transcript_documents(
    canonical: DataFrame, path: str, fields: Sequence[str], generated_at: Column, info: Sequence[str] = (),
    order: str = "num", text: str = "text", rows_per_part: int = ROWS_PER_PART,
) -> None:
    """One document ``transkrypty_<date>.json`` per term, proceeding and day, its statements in ``num`` order.

    ``canonical`` needs ``term, proceeding_id, date``; ``info`` names fields of the proceeding (equal
    for all its rows) for the envelope. A day that is written again is replaced as a whole, other
    days stay, and a day without a long enough text gets no document; see :func:`write_documents`
    for very large days. A null date is filed under ``unknown``.
    """
    rows = canonical.where(F.length(text) >= MIN_SAVED)
    name = F.concat(F.lit("term="), _in_name(F.col("term")), F.lit("/proceeding_id="), _in_name(F.col("proceeding_id")),
                    F.lit("/transcripts/transkrypty_"), _in_name(F.col("date")), F.lit(".json"))
    about = [F.struct(*info).alias("proceeding_info")] if info else []
    metadata = F.struct("term", "proceeding_id", F.col("date").cast("string").alias("date"), generated_at.cast("string").alias("generated_at"), *about)
    envelope = level(F.to_json(F.struct(metadata.alias("metadata"))), "statements")
    write_documents(rows, path, name, [envelope], F.to_json(F.struct(*fields)), [order], rows_per_part)


def in_envelope(df: DataFrame, generated_at: Column, version: str, data: Sequence[str], listed: bool = False) -> DataFrame:
    """``metadata struct<generated_at, scraper_version>, data struct<...>``, or with ``listed`` a list of one struct.

    One record per row: a table in one envelope would have to be gathered in one task.
    """
    metadata = F.struct(generated_at.cast("string").alias("generated_at"), F.lit(version).alias("scraper_version"))
    body = F.struct(*data)
    return df.select(metadata.alias("metadata"), (F.array(body) if listed else body).alias("data"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON records, one per line, in files that end in ``.json``."""
    df.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str, order: str = "line_no", line: str = "line") -> None:
    """The few lines of a report as one text file, in order."""
    lines.orderBy(order).coalesce(1).select(line).write.mode("overwrite").text(path)


def write_result_documents(
    fragments: DataFrame, path: str, source: str, fields: Sequence[Column | str], order: Sequence[str], generated_at: Column,
    version: str, run_id: str, header: Sequence[str] = (), rows_per_part: int = ROWS_PER_PART,
) -> None:
    """One enveloped document per run and source file: ``{metadata, data: {source_file, ..., fragments: [...]}}``.

    ``header`` names further columns of ``data`` (equal for all rows of a source). The documents
    stand in ``run_id=<run>/source_stem=<stem>/``, where :func:`read_result_documents` finds the newest run.
    A null source is filed under ``unknown``.
    """
    base = F.element_at(F.split(F.coalesce(F.col(source), F.lit("unknown")), "/"), -1)
    stem = F.btrim(F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    # sources of one stem in different folders keep documents of their own
    name = F.concat(F.lit(f"run_id={run_id}/source_stem="), stem, F.lit("/results_"), stem, F.lit("_"),
                    F.hex(F.crc32(F.coalesce(F.col(source), F.lit("")).cast("binary"))), F.lit(".json"))
    metadata = F.to_json(F.struct(generated_at.cast("string").alias("generated_at"), F.lit(version).alias("scraper_version")))
    opening, closing = level(F.to_json(F.struct(F.col(source).alias("source_file"), *header)), "fragments")
    envelope = F.concat(F.lit('{"metadata":'), metadata, F.lit(',"data":'), opening), F.concat(closing, F.lit("}"))
    write_documents(fragments, path, name, [envelope], F.to_json(F.struct(*fields)), order, rows_per_part)


def members_csv(members: DataFrame) -> DataFrame:
    """The fixed member columns as text; missing values and columns are empty."""
    have = set(members.columns)
    return members.select(*[
        (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in MEMBER_COLUMNS
    ])


def statements_csv(statements: DataFrame, folder: Column) -> DataFrame:
    """Flat statement rows with a 100-character preview."""

    def text(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    body = F.coalesce("text", F.lit(""))
    return statements.select(
        "term", folder.alias("proceeding_dir"), text("date").alias("date"), text("num").alias("statement_num"),
        text("speaker_name").alias("speaker_name"), text("speaker_function").alias("speaker_function"),
        text("speaker_club").alias("speaker_club"), text("start_time").alias("start_time"),
        text("end_time").alias("end_time"), text("duration_seconds").alias("duration_seconds"),
        (F.length(body) > 0).alias("has_full_content"), preview(body, 100).alias("content_preview"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header and quoted text."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def write_term_documents(
    statements: DataFrame, path: str, exported_at: Column, fields: Sequence[str], order: str = "num",
    term: str = "term", proceeding: str = "proceeding_id", date: str = "date", info: Sequence[str] = (),
    rows_per_part: int = ROWS_PER_PART,
) -> None:
    """One export per term: ``{term, export_timestamp, proceedings: [{directory_name, info, transcripts: [{metadata, statements}]}]}``.

    Proceedings stand in order of their number, transcripts of their date and statements in ``order``; ``info``
    names fields of the proceeding (equal for all its rows). A term over several tasks becomes parts,
    each of which opens its proceedings and transcripts anew.
    """
    digits = F.coalesce(F.col(proceeding).cast("string"), F.lit("unknown"))
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    about = [F.struct(*info).alias("info")] if info else []
    levels = [
        level(F.to_json(F.struct(F.col(term).alias("term"), exported_at.cast("string").alias("export_timestamp"))), "proceedings"),
        level(F.to_json(F.struct(F.concat(F.lit("proceeding_"), padded).alias("directory_name"), *about)), "transcripts"),
        level(F.to_json(F.struct(F.struct(F.col(date).cast("string").alias("date")).alias("metadata"))), "statements"),
    ]
    name = F.concat(F.lit("term_"), _in_name(F.col(term)), F.lit("_export.json"))
    write_documents(statements, path, name, levels, F.to_json(F.struct(*fields)), [proceeding, date, order], rows_per_part)


def report_lines(
    evaluated: DataFrame, order: Sequence[Column], title: str = REPORT_TITLE, rows: int = REPORT_ROWS
) -> DataFrame:
    """Report text: a header with found/total, then the first positives with their reason.

    ``evaluated`` needs ``is_funny, confidence, text, reason``. The first rows come from a
    top-k, which keeps ``rows`` rows per task; counts are one aggregate.
    """
    counts = evaluated.agg(
        F.count_if(F.coalesce("is_funny", F.lit(False))).alias("found"), F.count(F.lit(1)).alias("total")
    )
    header = counts.select(
        F.lit(0).alias("line_no"),
        F.concat(F.lit(title + "\n"), F.lit("Found: "), F.col("found"), F.lit("/"), F.col("total")).alias("line"),
    )
    top = evaluated.where("is_funny").orderBy(*order).limit(rows)
    numbered = top.withColumn("line_no", F.row_number().over(Window.orderBy(*order)))
    body = numbered.select(
        "line_no",
        F.concat(
            F.col("line_no").cast("string"), F.lit(". ["), F.bround(F.col("confidence") * 100, 0).cast("int"),
            F.lit("%] "), F.left("text", F.lit(REPORT_TEXT)), F.lit("...\n   → "), F.coalesce("reason", F.lit("")),
        ).alias("line"),
    )
    return header.unionByName(body)

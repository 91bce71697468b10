"""The two main jobs, composed of the operators: landing a term's days, and detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumlens.functions.keywords import Keyword
from plenumlens.operators.evaluation import Evaluator, evaluate_fragments
from plenumlens.operators.fragments import extract_fragments
from plenumlens.operators.joins import join_content, join_rest, join_speaker
from plenumlens.operators.ranking import topk_per_group
from plenumlens.operators.statements import to_canonical, to_processed
from plenumlens.session import materialize

DAY = ["term", "proceeding_id", "date"]

# Least score and number of fragments evaluated per file.
MIN_SCORE = 1.0
TOP_FRAGMENTS = 100


def land_statements(listing: DataFrame, members: DataFrame, content: DataFrame, member_order: str) -> DataFrame:
    """Listing rows with speaker data and fetched content, as canonical statements.

    ``content`` holds one ``content`` struct per (term, proceeding, date, num); statements
    without one are dropped.
    """
    processed = to_processed(listing).withColumn("_name", F.col("speaker.name"))
    known = join_speaker(processed, members, "_name", member_order)
    speaker = F.struct(
        F.col("speaker.name").alias("name"), F.col("mp_data.id").alias("id"), F.col("is_mp"),
        F.col("speaker.club").alias("club"), F.col("mp_data.club").alias("group"),
    )
    enriched = known.withColumn("speaker", speaker).select(*DAY, "num", "speaker", "timing")
    return to_canonical(join_content(enriched, content, [*DAY, "num"]))


def detect(
    statements: DataFrame, lexicon: Sequence[Keyword], source: str, order: str, limit: int | None = None,
    text: str = "text", ident: Sequence[str] = (),
) -> DataFrame:
    """Fragments of all statements, or on demand of the first ``limit`` of each source.

    ``ident`` names the columns that tell statements of one source and number apart (the
    position in the file); they are kept in the fragments.
    """
    rows = statements.select(source, order, *ident, text)
    if limit is not None:
        rows = topk_per_group(rows, [source], [F.col(order), *[F.col(c) for c in ident]], limit, [order, *ident], rank="_pos").drop("_pos")
    return extract_fragments(rows, lexicon, [source, order, *ident], text)


def evaluate_best(
    fragments: DataFrame, verdicts: DataFrame, providers: Evaluator | Sequence[tuple[str, Evaluator]], source: str, order: str,
    min_score: float = MIN_SCORE, top_n: int = TOP_FRAGMENTS, parallelism: int | None = None, ident: Sequence[str] = (),
    context: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """All fragments, the best ``top_n`` of each source with verdicts, and the verdicts to keep.

    Score filter and top-k come before the providers. Fragments are read three times, so
    they are written once first. Source, ``order``, ``ident`` and segment name a fragment.
    """
    found = materialize(fragments, "fragments")
    keys = [source, order, *ident, "segment_idx"]
    by_rank: list[Column] = [F.col("score").desc(), F.col(order), *[F.col(c) for c in ident], F.col("segment_idx")]
    best = topk_per_group(found.where(F.col("score") >= min_score), [source], by_rank, top_n, [order, *ident])
    judged, kept = evaluate_fragments(best, verdicts, providers, keys, parallelism=parallelism, context=context)
    judged = materialize(judged, "judged")  # at most top_n rows per source, read twice below
    return join_rest(found, judged, keys), kept

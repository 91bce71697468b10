"""Counts and reports per proceeding, term, group, source and run.

Every summary first reduces to small keys with a plain count, which combines before the
shuffle; distinct counts then run over that reduced table. A proceeding or club with a
third of all rows therefore costs no more than its distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumlens.functions import fields
from plenumlens.functions.base import strip
from plenumlens.operators.ranking import topk_per_group

NO_CLUB = "Brak klubu"


def day_partials(statements: DataFrame, keys: Sequence[str], date: str, speaker: str) -> DataFrame:
    """Rows (keys, date, speaker, n): what summaries of any number of days need to know of their statements."""
    return statements.groupBy(*keys, date, speaker).agg(F.count(F.lit(1)).alias("n"))


def store_partials(statements: DataFrame, path: str, keys: Sequence[str], date: str, speaker: str) -> None:
    """Keep the partial aggregates of the days that occur, each in a folder of its own.

    A day that comes again replaces what was kept of it, other days stay and are not read: the
    cost is that of the new days. Pass each day whole.
    """
    partials = day_partials(statements, keys, date, speaker)
    (partials.repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(date).parquet(path))


def read_partials(statements: DataFrame, path: str, keys: Sequence[str], date: str, speaker: str) -> DataFrame:
    """All partial aggregates kept at ``path``; ``statements`` gives the types of the columns only."""
    kinds = dict(statements.dtypes)
    fields_ = [f"`{c}` {kinds[c]}" for c in [*keys, speaker]] + ["n long", f"`{date}` {kinds[date]}"]
    return statements.sparkSession.read.schema(", ".join(fields_)).parquet(path)


def proceeding_summary_of(partials: DataFrame, keys: Sequence[str], date: str, speaker: str) -> DataFrame:
    """Days, statements, distinct named speakers and sorted dates per proceeding, of partial aggregates."""
    return partials.groupBy(*keys).agg(
        F.countDistinct(date).alias("total_days"),
        F.sum("n").alias("total_statements"),
        F.countDistinct(F.nullif(F.col(speaker), F.lit(""))).alias("total_speakers"),
        F.array_sort(F.collect_set(date)).alias("dates"),
    )


def proceeding_summary(statements: DataFrame, keys: Sequence[str], date: str, speaker: str) -> DataFrame:
    """Days, statements, distinct named speakers and sorted dates per proceeding."""
    return proceeding_summary_of(day_partials(statements, keys, date, speaker), keys, date, speaker)


def term_summary_of(partials: DataFrame, term: str, proceeding: str, date: str) -> DataFrame:
    """Proceedings, transcripts (days) and statements per term, and per proceeding within it, of partial aggregates."""
    days = partials.groupBy(term, proceeding, date).agg(F.sum("n").alias("_n"))
    per = days.groupBy(term, proceeding).agg(F.count(F.lit(1)).alias("_days"), F.sum("_n").alias("_n"))
    return per.rollup(term, proceeding).agg(
        F.count(F.lit(1)).alias("proceedings"), F.sum("_days").alias("transcripts"),
        F.sum("_n").alias("total_statements"), F.grouping_id().alias("_level"),
    ).where(F.col("_level") < 3).select(
        term, proceeding, (F.col("_level") == 1).alias("is_term_total"),
        "proceedings", "transcripts", "total_statements",
    )


def term_summary(statements: DataFrame, term: str, proceeding: str, date: str) -> DataFrame:
    """Proceedings, transcripts (days) and statements per term, and per proceeding within it."""
    days = statements.groupBy(term, proceeding, date).agg(F.count(F.lit(1)).alias("n"))
    return term_summary_of(days, term, proceeding, date)


def group_sizes(members: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Members per value of each grouping column; rows without a value are skipped."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(g).alias("group_kind"), F.col(g).cast("string").alias("group_value")) for g in groups
    ]))
    flat = members.select(pairs.alias("g")).select("g.*")
    named = flat.where(F.coalesce("group_value", F.lit("")) != "")
    return named.groupBy("group_kind", "group_value").agg(F.count(F.lit(1)).alias("member_count"))


def members_by_group(members: DataFrame, groups: Sequence[str], listed: Sequence[str]) -> DataFrame:
    """One row per member and group, with the group's size.

    The member list of a group stays rows: it is never gathered into one value, since a
    group may hold any share of the members.
    """
    sizes = group_sizes(members, groups)  # AQE broadcasts it once its bytes are known
    pairs = F.explode(F.array(*[
        F.struct(F.lit(g).alias("group_kind"), F.col(g).cast("string").alias("group_value")) for g in groups
    ]))
    rows = members.select(*listed, pairs.alias("g")).select("g.*", *listed)
    return rows.join(sizes, ["group_kind", "group_value"], "inner")


def group_totals(members: DataFrame, groups: Sequence[str]) -> DataFrame:
    """How many groups of each kind there are, and how many members they hold."""
    sizes = group_sizes(members, groups)
    return sizes.groupBy("group_kind").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("member_count").alias("members")
    )


def club_counts(members: DataFrame, club: str, missing: str = NO_CLUB) -> DataFrame:
    """Members per club; a missing club has its own name."""
    return members.groupBy(F.coalesce(F.col(club), F.lit(missing)).alias("club")).agg(
        F.count(F.lit(1)).alias("members")
    )


def content_stats(
    statements: DataFrame, keys: Sequence[str], date: str, number: str, has_content: str,
    speaker: str, is_member: str, failed: str | None = None, future: str | None = None, beyond: str | None = None,
) -> DataFrame:
    """Attempts, successes, skipped, enrichments and identified speakers.

    Speakers are counted distinct per day and summed over days. ``failed``, ``future`` and
    ``beyond`` name flags of statements whose fetch failed, that lie in the future, or beyond a
    limit; they are counted where they are given.
    """
    flags = {"errors": failed, "future_skipped": future, "limit_skipped": beyond}
    flagged = {name: flag for name, flag in flags.items() if flag is not None}
    numbered = F.col(number).isNotNull()
    fetched = numbered & F.coalesce(F.col(has_content), F.lit(False))
    per_speaker = statements.groupBy(*keys, date, speaker).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(numbered).alias("_tried"), F.count_if(fetched).alias("_got"),
        F.count_if(is_member).alias("_enriched"), *[F.count_if(flag).alias(name) for name, flag in flagged.items()],
    )
    return per_speaker.groupBy(*keys).agg(
        F.sum("_all").alias("statements"),
        F.sum("_tried").alias("attempts"),
        F.sum("_got").alias("successes"),
        F.sum(F.col("_all") - F.col("_got")).alias("skipped"),
        F.sum("_enriched").alias("enrichments"),
        F.count_if(F.col("_enriched") > 0).alias("speakers_identified"),
        *[F.sum(name).alias(name) for name in flagged],
    )


def with_success_band(stats: DataFrame, attempts: str, successes: str) -> DataFrame:
    """Add ``success_percent`` and its band; both null without attempts."""
    percent = F.when(F.col(attempts) > 0, F.col(successes) * 100.0 / F.col(attempts))
    return stats.withColumn("success_percent", percent).withColumn(
        "band", fields.success_band(F.col("success_percent"), F.col(attempts))
    )


def eval_stats(evaluated: DataFrame) -> DataFrame:
    """Evaluated, positive and cached rows per provider used."""
    return evaluated.groupBy("api_used").agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if("is_funny").alias("positive"),
        F.count_if("cached").alias("cached"),
    )


def analysis_stats(analysed: DataFrame, failed: str = "failed") -> DataFrame:
    """Total, positive, rate, mean confidence; failures only count as errors."""
    ok = ~F.col(failed)
    positive = ok & F.col("is_funny")
    rate = F.count_if(positive) * 100.0 / F.nullif(F.count_if(ok), F.lit(0))
    return analysed.agg(
        F.count_if(ok).alias("total_analyzed"),
        F.count_if(positive).alias("positive_found"),
        F.coalesce(rate, F.lit(0.0)).alias("positive_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"),
        F.count_if(failed).alias("errors"),
    )


def hit_rate(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of evaluations answered from the verdict table."""
    return evaluated.groupBy(*by).agg(
        F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"),
        (F.count_if("cached") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("hit_rate"),
    )


def combine_stats(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Sum of the numeric columns of several statistics tables; absent ones count as zero."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    values = [c for c in union.columns if c not in keys]
    return union.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in values])


def state_totals(state: DataFrame, proceeding: str, date: str) -> DataFrame:
    """Processed proceedings and processed (proceeding, date) pairs."""
    pairs = state.groupBy(proceeding, date).agg(F.lit(1).alias("_one"))
    return pairs.agg(
        F.countDistinct(proceeding).alias("processed_proceedings"), F.count(F.lit(1)).alias("processed_dates")
    )


def run_header(statements: DataFrame, fragments: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """Per source: statements, statements processed (``limit`` at most, if there was one), fragments found.

    A null source is a source like any other.
    """
    within = F.col("n_statements") if limit is None else F.least(F.col("n_statements"), F.lit(limit).cast("long"))
    counts = statements.groupBy(source).agg(F.count(F.lit(1)).alias("n_statements")).withColumn("n_processed", within)
    found = fragments.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("n_fragments"))
    joined = counts.join(found, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")
    return joined.withColumn("n_fragments", F.coalesce("n_fragments", F.lit(0)))


def sample_success(
    statements: DataFrame, group: Sequence[str], order: Sequence[Column], spread_by: Sequence[str],
    html: str, name: str, k: int = 3,
) -> DataFrame:
    """First ``k`` statements of each group with success flag and preview."""
    first = topk_per_group(statements, group, order, k, spread_by)
    ok = F.coalesce(F.length(strip(F.col(html))) > 50, F.lit(False))
    return first.select(
        *group, "rank", F.col(name).alias("speaker"), ok.alias("success"),
        F.length(html).alias("content_length"),
        F.when(ok, F.concat(F.left(F.col(html), F.lit(100)), F.lit("..."))).alias("preview"),
    )

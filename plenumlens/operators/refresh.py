"""What to read again: refresh tiers, processed state, health and digests.

The reference day or time is always a parameter; nothing here reads a clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours after which each tier is read again, days state is kept, title length.
FUTURE_HOURS = 24
COMPLETE_HOURS = 168
ONGOING_HOURS = 2
STATE_DAYS = 30
TITLE_LENGTH = 50


def latest_checks(log: DataFrame, keys: Sequence[str], checked_at: str = "checked_at") -> DataFrame:
    """Last check of each proceeding."""
    return log.groupBy(*keys).agg(F.max(checked_at).alias("last_check"))


def refresh_worklist(
    proceedings: DataFrame, existing: DataFrame, checks: DataFrame, keys: Sequence[str], now: Column,
    force: bool = False,
) -> DataFrame:
    """Tier and decision for each proceeding with ``dates``.

    ``existing`` holds the (keys, date) pairs already landed, ``checks`` one last check
    per proceeding. All three sides are reduced to one row per proceeding before joining.
    """
    today = F.to_date(now)
    landed = existing.groupBy(*keys).agg(F.countDistinct("date").alias("landed"))
    joined = proceedings.join(landed, list(keys), "left").join(checks, list(keys), "left")
    valid = F.filter(F.transform("dates", lambda d: F.try_to_date(d)), lambda d: d.isNotNull())
    rows = joined.withColumn("_future", F.size(F.filter(valid, lambda d: d > today))).withColumn(
        "_past", F.size(F.filter(valid, lambda d: d <= today))
    )
    tier = (
        F.when((F.col("_future") > 0) & (F.col("_past") == 0), "future")
        .when((F.col("_past") > 0) & (F.col("_future") == 0),
              F.when(F.coalesce("landed", F.lit(0)) >= F.col("_past"), "complete").otherwise("incomplete"))
        .otherwise("ongoing")
    )
    tiered = rows.withColumn("tier", tier)
    limit = (
        F.when(F.col("tier") == "future", FUTURE_HOURS).when(F.col("tier") == "complete", COMPLETE_HOURS)
        .when(F.col("tier") == "ongoing", ONGOING_HOURS)
    )
    age_hours = (F.unix_micros(now) - F.unix_micros("last_check")) / F.lit(3_600_000_000)
    due = F.lit(force) | F.col("last_check").isNull() | (F.col("tier") == "incomplete") | (age_hours > limit)
    return tiered.select(*keys, "tier", F.coalesce(due, F.lit(True)).alias("refresh"))


def new_dates(
    proceedings: DataFrame, landed: DataFrame, keys: Sequence[str], ref: Column
) -> DataFrame:
    """Work-list of (proceeding, date) up to ``ref`` that are not landed yet."""
    days = proceedings.select(*keys, F.explode("dates").alias("date")).withColumn("date", F.try_to_date("date"))
    due = days.where(F.col("date") <= ref).distinct()
    return due.join(landed.select(*keys, "date").distinct(), [*keys, "date"], "left_anti")


def prune_state(state: DataFrame, date: str, ref: Column, days: int = STATE_DAYS) -> DataFrame:
    """State rows of the last ``days`` days; rows whose date cannot be read are kept."""
    parsed = F.try_to_date(F.col(date).cast("string"))
    return state.where(parsed.isNull() | (parsed >= F.date_sub(ref, days)))


def health(checks: DataFrame, keys: Sequence[str], checked_at: str, now: Column, interval_minutes: int = 30) -> DataFrame:
    """Healthy if the last check is younger than two intervals; unknown if there is none."""
    last = checks.groupBy(*keys).agg(F.max(F.try_to_timestamp(F.col(checked_at).cast("string"))).alias("last_check"))
    hours = (F.unix_micros(now) - F.unix_micros("last_check")) / F.lit(3_600_000_000)
    return last.withColumn(
        "status",
        F.when(F.col("last_check").isNull(), "unknown").when(hours < interval_minutes / 60 * 2, "healthy").otherwise("stale"),
    ).withColumn("hours_since_check", F.round(hours, 2))


def digest_lines(new_days: DataFrame, key: str, date: str, title: str) -> DataFrame:
    """One line per proceeding with new days: sorted dates and the title, cut if long."""
    days = new_days.groupBy(key, date).agg(F.max(title).alias("_title"))
    lines = days.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(F.col(date).cast("string"))), ", ").alias("dates"),
        F.count(F.lit(1)).alias("new_days"), F.max("_title").alias("_title"),
    )
    short = F.when(
        F.length("_title") > TITLE_LENGTH, F.concat(F.left("_title", F.lit(TITLE_LENGTH)), F.lit("..."))
    ).otherwise(F.col("_title"))
    line = F.concat(F.lit("• "), F.col(key).cast("string"), F.lit(": "), F.col("dates"), F.lit("\n  "), short)
    return lines.select(key, "new_days", "dates", line.alias("line"))

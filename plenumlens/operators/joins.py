"""Joins that enrich statements. No side is hinted: AQE broadcasts by measured bytes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenumlens.functions import fields
from plenumlens.functions.base import strip

# The member fields a statement carries; missing text is empty.
MEMBER_TEXT = ["club", "districtName", "profession", "voivodeship"]
MEMBER_DATA = ["id", "club", "districtName", "districtNum", "profession", "voivodeship"]


def speaker_lookup(members: DataFrame, order: str) -> DataFrame:
    """One member per written name: "First Last", "Last First" and "Last".

    Of several members with the same written name the one listed last is kept, and of
    one member's own names the later form. Members without any name are left out.
    """
    first, last = F.col("firstName"), F.col("lastName")
    forms = F.array(
        F.struct(F.lit(0).alias("form"), fields.full_name(first, last).alias("name")),
        F.struct(F.lit(1).alias("form"), fields.reversed_name(first, last).alias("name")),
        F.struct(F.lit(2).alias("form"), strip(F.coalesce(last, F.lit(""))).alias("name")),
    )
    data = F.struct(*[
        (F.coalesce(c, F.lit("")) if c in MEMBER_TEXT else F.col(c)).alias(c) for c in MEMBER_DATA
    ])
    named = members.where(fields.full_name(first, last) != "").select(
        F.col(order).alias("_ord"), data.alias("mp_data"), F.explode(forms).alias("f")
    ).where(F.col("f.name") != "")
    return named.groupBy(F.col("f.name").alias("speaker_key")).agg(
        F.max_by("mp_data", F.struct("_ord", "f.form")).alias("mp_data")
    )


def join_speaker(statements: DataFrame, members: DataFrame, name: str, order: str) -> DataFrame:
    """Add ``mp_data`` and ``is_mp`` by the speaker's trimmed name; every statement stays.

    A frequent speaker makes a hot key: AQE broadcasts the lookup if its measured bytes are
    few, and else splits the hot partition of the outer side.
    """
    lookup = speaker_lookup(members, order)
    keyed = statements.withColumn("_key", F.nullif(strip(F.col(name)), F.lit("")))
    joined = keyed.join(lookup, keyed["_key"] == lookup["speaker_key"], "left")
    return joined.withColumn("is_mp", F.col("speaker_key").isNotNull()).drop("_key", "speaker_key")


def join_content(statements: DataFrame, content: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statements with a number that have content; the others are dropped."""
    return statements.where(F.col(keys[-1]).isNotNull()).join(content, list(keys), "inner")


def without_content(statements: DataFrame, content: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The statements :func:`join_content` drops: no number, or nothing fetched for it."""
    return statements.join(content.select(*keys), list(keys), "left_anti")


def join_member_detail(
    members: DataFrame, details: DataFrame, photos: DataFrame, voting: DataFrame, key: str
) -> DataFrame:
    """Members with details and optional file paths; a member without details counts as an error."""
    found = details.withColumn("_found", F.lit(True))
    return (
        members.join(found, key, "left").join(photos, key, "left").join(voting, key, "left")
        .withColumn("is_error", F.col("_found").isNull()).drop("_found")
    )


def join_rest(fragments: DataFrame, evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Evaluated fragments first, then all others, told apart by identity, not by value.

    Null is a key value like any other; the keys together must name one fragment.
    """
    named = evaluated.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    rest = fragments.join(named, same, "left_anti")
    return evaluated.withColumn("part", F.lit(0)).unionByName(
        rest.withColumn("part", F.lit(1)), allowMissingColumns=True
    )
